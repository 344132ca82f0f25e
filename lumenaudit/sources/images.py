"""Image folders and label files as tables of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder names that mean "no label", and the endings of images.
UNLABELED = ("unlabeled", "unlabelled", "unannotated", "unknown", "untagged")
ENDINGS = ("jpg", "jpeg", "png", "bmp", "tiff", "webp")
JUNK = "__MACOSX"


def make_id(path: Column) -> Column:
    """The file's stem: its name without the last ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "(?<=.)\\.[^.]+$", "")


def has_ending(path: Column, endings: tuple[str, ...] = ENDINGS) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1)).isin(*endings)


def folder_label(relative: Column) -> Column:
    """The leaf folder of a path relative to the root; null for loose files and folders that mean no label."""
    parts = F.split(relative, "/")
    leaf = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    return F.when(~F.lower(leaf).isin(*UNLABELED), leaf)


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """``path, relative`` of the real images below ``root``: no hidden or junk part in the relative path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    base = root if "://" in root or root.startswith("file:") else f"file:{root}"
    plain = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    start = base.split(":", 1)[1].lstrip("/").rstrip("/")
    rows = files.withColumn("relative", F.substring(plain, len(start) + 3, 1 << 20))
    parts = F.split("relative", "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | (p == JUNK))
    return rows.where(has_ending(F.col("path")) & ~hidden)


def load_dataset(spark: SparkSession, root: str, structured: bool = True, label_csv: str | None = None) -> DataFrame:
    """``id, path, label``.

    With ``label_csv`` the file's ``path`` column, or ``root/id``, gives the paths and its
    ``label`` column, if any, the labels (empty cells are null); without either column it
    is an error. Otherwise images below ``root`` are listed: labelled by their folder if
    ``structured``, else unlabelled.
    """
    if label_csv:
        rows = spark.read.csv(label_csv, header=True)
        if "path" in rows.columns:
            path = F.col("path")
        elif "id" in rows.columns:
            path = F.concat(F.lit(root.rstrip("/") + "/"), F.col("id"))
        else:
            raise ValueError("the label file needs a column path or id")
        label = F.nullif(F.trim("label"), F.lit("")) if "label" in rows.columns else F.lit(None).cast("string")
        return rows.select(make_id(path).alias("id"), path.alias("path"), label.alias("label"))
    files = list_images(spark, root)
    label = folder_label(F.col("relative")) if structured else F.lit(None).cast("string")
    return files.select(make_id(F.col("path")).alias("id"), "path", label.alias("label")).orderBy("path")


def origin_path(origin: Column) -> Column:
    """The path behind an image's origin: the image source writes it as an address, with blanks and other signs as ``%20`` and so on."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(origin, "\\+", "%2B")), origin)


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """``path, image``: decoded images below ``root``; those that cannot be decoded have a height of -1."""
    rows = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(root)
    return rows.select(origin_path(F.col("image.origin")).alias("path"), "image")
