"""Columns for paths, storage labels and document keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import compact

# Media extensions.
VIDEO = ("3gp", "avi", "flv", "m2ts", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "ts", "vob", "webm", "wmv")
AUDIO = ("aac", "aif", "aiff", "alac", "ape", "flac", "m4a", "mp3", "oga", "ogg", "opus", "shn", "shnf", "wav", "wv")
DOCUMENT = ("doc", "docx", "htm", "html", "md", "pdf", "rtf", "txt")
DEFAULT_LABELS = ("local disk", "new volume", "windows")
SYSTEM_FOLDERS = ("$recycle.bin", "system volume information", ".git", ".trash", "lost+found")


def url_host(c: Column) -> Column:
    return F.regexp_extract(c, "://([^/?#]*)", 1)


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, "://[^/?#]*([^?#]*)", 1)


def parts_of(path: Column) -> Column:
    """Non-empty components, without a /mnt/x mount prefix."""
    path = F.regexp_replace(path, "(?i)^/mnt/[a-z](/|$)", "/")
    return F.filter(F.split(path, "/"), lambda x: x != "")


def storage_label(c: Column) -> Column:
    """Label without brackets; default labels of an operating system are blank."""
    label = F.trim(F.regexp_replace(F.trim(c), "^\\[(.*)\\]$", "$1"))
    return F.when(F.lower(label).isin(*DEFAULT_LABELS), "").otherwise(label)


def storage_path(c: Column) -> Column:
    """Path below the volume: no drive letter or mount, single slashes, none at the end."""
    path = F.replace(F.trim(c), F.lit("\\"), F.lit("/"))
    path = F.regexp_replace(F.regexp_replace(path, "^[A-Za-z]:", ""), "(?i)^/mnt/[a-z](/|$)", "/")
    path = F.regexp_replace(path, "/+", "/")
    return F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))


def ancestors(path: Column) -> Column:
    """The path itself and all folders above it, as an array of paths."""
    parts = parts_of(path)
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/"))))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]+)$", 1))


def clean_part(c: Column) -> Column:
    """Component without trailing (...) groups, extension and edge punctuation."""
    c = F.regexp_replace(compact(F.replace(c, F.lit("_"), F.lit(" "))), "(\\s*\\([^()]*\\))+\\s*$", "")
    c = F.regexp_replace(c, "(\\.[A-Za-z][A-Za-z0-9]{1,4})+$", "")
    return compact(F.regexp_replace(c, "^[ ,;:_./\\\\-]+|[ ,;:_./\\\\-]+$", ""))


def key_part(c: Column, dash: bool = False) -> Column:
    """Letters, digits, ( ) & and, if asked, dashes."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9()&-]" if dash else "[^A-Za-z0-9()&]", "")
