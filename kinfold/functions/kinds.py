"""Kinds of files by extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: extensions of each kind; an extension in two lists has the later kind
KINDS = {
    "text": "txt doc docx rtf dotx dot odt pages tex pdf ps eps prn",
    "image": "jpg jpeg png tiff tif gif bmp heic tga dae",
    "spreadsheet": "tsv csv xls xlsx xltx xlt ods xlsb xlsm xltm",
    "media": "mtp itlp nef asf cbr flv djvu mod mpg cur psd 3gp pak flac heic thm grf mkv fh10 wma pdn map hip ts ogg itl aep avi mov mid m4a cdr "
    "ai xpl rgssad srt vdf ico fh11 wav aiff feq 3gpp gc ithmb itdb m4v m3u wad sfl sfk lvl mp4 aif mp3 ipa jps indd vfs itc2 kmz cr2 dss",
    "presentation": "ppt pptx odp",
}
# fixed values: extensions of the finer kinds of whole names
NAME_KINDS = {
    "image": "jpg jpeg png tiff tif gif bmp",
    "video": "3gp 3g2 avi f4v flv m4v asf wmv mpeg mp4 qt",
    "document": "txt doc docx rtf dotx dot odt pages tex pdf ps eps prn",
    "web": "html xhtml php js xml war ear dhtml mhtml",
    "spreadsheet": "xls xlsx csv tsv xltx xlt ods xlsb xlsm xltm",
    "presentation": "ppt pptx pot potx odp ppsx pps pptm potm ppsm key",
}


def kind(ext: Column) -> Column:
    """Kind of an extension in lower case; 'other' for unknown ones and null."""
    out = F.lit("other")
    for name, exts in KINDS.items():
        out = F.when(ext.isin(*exts.split()), name).otherwise(out)
    return out


def name_kind(path: Column) -> Column:
    """Kind of a name: 'other' for temporary ones (~ or $ in the last part), for those without extension, for those that begin
    with a dot and for those of more than 14 parts."""
    low = F.lower(path)
    last, parts = F.element_at(F.split(low, "/"), -1), F.split(low, r"\.")
    ext = F.element_at(parts, -1)
    out = F.lit("other")
    for name, exts in reversed(NAME_KINDS.items()):
        out = F.when(ext.isin(*exts.split()), name).otherwise(out)
    odd = last.contains("~") | last.contains("$") | ~low.contains(".") | low.startswith(".") | (F.size(parts) > 14)
    return F.when(odd | path.isNull(), "other").otherwise(out)


def pair_kind(kind_a: Column, kind_b: Column) -> Column:
    """Which features suit a pair: those of images, of texts, or those of all files."""
    return F.when((kind_a == "image") & (kind_b == "image"), "image").when((kind_a == "text") & (kind_b == "text"), "text").otherwise("all_other")
