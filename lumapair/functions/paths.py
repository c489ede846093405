"""Path expressions: stems, suffixes, sub-dataset names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of image files.
IMAGE_SUFFIXES = ["png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp"]


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """Lower-cased suffix without the dot; empty if the name has none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def is_image(path: Column) -> Column:
    return suffix(path).isin(IMAGE_SUFFIXES)


def sub_name(weather: Column, subdir: Column) -> Column:
    return F.concat_ws("_", weather, subdir)


def sub_dir(name: Column) -> Column:
    """What follows the first underscore; the whole name if there is none."""
    return F.regexp_replace(name, r"^[^_]*_", "")


def checkpoint_step(name: Column) -> Column:
    """Step of a name checkpoint-<int>, else null."""
    return F.regexp_extract(name, r"^checkpoint-(\d+)$", 1).try_cast("long")


def stamp(at: Column) -> Column:
    """A time as a folder name."""
    return F.date_format(at, "yyyyMMdd_HHmmss")
