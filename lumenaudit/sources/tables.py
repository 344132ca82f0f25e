"""Vectors, labels, reports and caches as files."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that mark a column as naming subgroups.
GROUP_WORDS = ("gender", "sex", "age", "group", "race", "region", "ethnicity", "subgroup")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load_embedding_data(spark: SparkSession, vectors: str, labels: str | None = None, edges: str | None = None) -> dict[str, DataFrame]:
    """The vectors and, where the files exist, labels joined by ``vec_id`` and the neighbour graph."""
    out = {"vectors": spark.read.parquet(vectors)}
    if labels and exists(spark, labels):
        rows = out["vectors"].drop("label") if "label" in out["vectors"].columns else out["vectors"]
        out["vectors"] = rows.join(spark.read.parquet(labels).select("vec_id", "label"), "vec_id", "left")
    if edges and exists(spark, edges):
        out["edges"] = spark.read.parquet(edges)
    return out


def newest_file(spark: SparkSession, pattern: str) -> str | None:
    """The most recently changed file of a pattern, null if there is none; contents are not read."""
    try:
        row = spark.read.format("binaryFile").load(pattern).agg(F.max_by("path", "modificationTime")).first()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return row[0]


def read_paths(spark: SparkSession, file: str) -> DataFrame:
    """``path``: one per line, trimmed, blank lines dropped."""
    return spark.read.text(file).select(F.trim("value").alias("path")).where(F.length("path") > 0)


def group_column(columns: Sequence[str], substring: bool = False) -> str | None:
    """The first column that names subgroups, by whole words (``substring``: anywhere in the name)."""
    for c in columns:
        words = re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", c).lower())
        if any((w in c.lower()) if substring else (w in words) for w in GROUP_WORDS):
            return c
    return None


def find_group_attribute(spark: SparkSession, files: Sequence[str], expected: int, substring: bool = False) -> tuple[DataFrame, str] | None:
    """The first existing CSV file with a group column and ``expected`` rows, with that column's name."""
    for f in files:
        if not exists(spark, f):
            continue
        rows = spark.read.csv(f, header=True)
        name = group_column(rows.columns, substring)
        if name and rows.count() == expected:
            return rows, name
    return None


def read_report(spark: SparkSession, file: str) -> DataFrame:
    """``report``: the JSON text of a file; a missing file gives one null row."""
    if not exists(spark, file):
        return spark.createDataFrame([(None,)], "report string")
    return spark.read.text(file, wholetext=True).select(F.col("value").alias("report"))


def signature(rows: DataFrame, *cols: str, group: Sequence[str] = ()) -> DataFrame:
    """``signature, n`` of a set of rows (per ``group``): 16 hex digits that do not depend on their order.

    Sums of per-row digests are combined, so partial results merge and no list of rows is
    ever built. Nulls count as the text ``missing``; repeated rows count.
    """
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in cols])
    digest = F.sha2(text, 256)
    part = lambda i: F.sum(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)"))
    sums = F.concat_ws(":", *[part(i).cast("string") for i in range(4)], F.count("*").cast("string"))
    return rows.groupBy(*group).agg(F.substring(F.sha2(sums, 256), 1, 16).alias("signature"), F.count("*").alias("n"))


def get_or_compute(spark: SparkSession, cache: str, inputs: DataFrame, compute: Callable[[DataFrame], DataFrame], *cols: str) -> DataFrame:
    """The cached result for this set of inputs, or the computed and stored one. Any change of members or of ``cols`` misses."""
    sig = signature(inputs, *cols).first()["signature"]
    path = f"{cache.rstrip('/')}/{sig}"
    if not exists(spark, f"{path}/_SUCCESS"):
        compute(inputs).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def resume(inputs: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Inputs that are not done yet."""
    return inputs if done is None else inputs.join(done.select(key), key, "left_anti")


def lookup(rows: DataFrame, values: DataFrame, key: str, value: str, default: str | None = None) -> DataFrame:
    """Rows with ``value`` looked up by key, or the default; of several values the least."""
    one = values.groupBy(key).agg(F.min(value).alias("_v"))
    found = F.col("_v") if default is None else F.coalesce("_v", F.lit(default))
    return rows.drop(value).join(one, key, "left").withColumn(value, found).drop("_v")


def apply_labels(rows: DataFrame, new: DataFrame, key: str, label: str = "label", default: str = "unknown") -> DataFrame:
    """Labels, else the new labels by key, else the default."""
    one = new.groupBy(key).agg(F.min("final_label").alias("_n"))
    return rows.join(one, key, "left").withColumn(label, F.coalesce(F.col(label).cast("string"), F.col("_n").cast("string"), F.lit(default))).drop("_n")


def low_quality(width: Column, height: Column, contrast: Column) -> Column:
    """Too small, too wide or narrow, or without contrast (0..1)."""
    ratio = width / F.nullif(height, F.lit(0))
    return (width < 64) | (height < 64) | (ratio > 3) | (ratio < 0.33) | (contrast < 0.05)


# -- sinks ----------------------------------------------------------------------------


def save_labels(samples: DataFrame, path: str) -> None:
    """``id, path, label`` as CSV with a header."""
    samples.select("id", "path", "label").write.mode("overwrite").csv(path, header=True)


def save_table(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vectors, neighbour graphs, groups or results as Parquet; the committer makes it all or nothing."""
    rows.write.mode(mode).parquet(path)


def save_csv(rows: DataFrame, path: str) -> None:
    """Any report as CSV; lists become text joined by commas, structs and maps JSON."""
    out = []
    for c, t in rows.dtypes:
        if t.startswith("array<") and "struct" not in t:
            out.append(F.array_join(F.col(c).cast("array<string>"), ", ").alias(c))
        else:
            out.append(F.to_json(c).alias(c) if t.startswith(("struct", "map", "array")) else F.col(c))
    rows.select(*out).write.mode("overwrite").csv(path, header=True)


def save_report(report: DataFrame, path: str) -> None:
    """JSON text, one report per line."""
    report.select("report").write.mode("overwrite").text(path)
