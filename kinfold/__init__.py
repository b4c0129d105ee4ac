"""kinfold: file-similarity, co-management and record-linkage analytics as Spark plans."""
