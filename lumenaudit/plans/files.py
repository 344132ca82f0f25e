"""Queries on files: what is written to the shared folder, read back and compared with the tables it came from."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenaudit.functions.labels import label_key, label_key_sql
from lumenaudit.functions.runtime import scratch, table
from lumenaudit.operators import raster as R
from lumenaudit.operators import repair
from lumenaudit.operators.sampling import rebalance
from lumenaudit.operators.similarity import knn_graph
from lumenaudit.plans.registry import query
from lumenaudit.sources import images as I
from lumenaudit.sources import tables as T
from lumenaudit.sources.archives import put, unpack
from lumenaudit.streaming.ingest import stream_embeddings, wait

_K = label_key_sql("label")
#: Parameter: the graph is written for this many neighbours.
NEAR = 3


def _samples(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "image_records").where("path is not null").groupBy("path").agg(F.min(label_key("label")).alias("label"))
    return rows.select(I.make_id(F.col("path")).alias("id"), "path", "label")


_SAMPLES = f"(SELECT regexp_replace(split_part(path, '/', -1), '(.)\\.[^.]+$', '\\1') AS id, path, min({_K}) AS label FROM image_records WHERE path IS NOT NULL GROUP BY path)"


@query(f"SELECT id, path, label FROM {_SAMPLES}")
def labels_file(spark: SparkSession, d: str) -> DataFrame:
    """Samples written as a label file and loaded from it."""
    to = scratch(spark, "labels")
    T.save_labels(_samples(spark, d), to)
    return I.load_dataset(spark, "/images", label_csv=to)


@query(f"SELECT regexp_replace(id, '(.)\\.[^.]+$', '\\1') AS id, '/images/' || id AS path, NULL::VARCHAR AS label FROM {_SAMPLES}")
def ids_file(spark: SparkSession, d: str) -> DataFrame:
    """A label file that names ids only: paths are built from the root, labels are null."""
    to = scratch(spark, "ids")
    T.save_csv(_samples(spark, d).select("id"), to)
    return I.load_dataset(spark, "/images/", label_csv=to)


_GRAPH = f"""(SELECT src, dst, r::INT AS rank FROM (SELECT a.vec_id AS src, b.vec_id AS dst,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS r FROM embeddings a, embeddings b) WHERE r <= {NEAR})"""


@query(f"""
    SELECT e.vec_id, coalesce(e.label, -1)::INT AS label, round(list_sum(e.embedding::DOUBLE[]), 4) AS total, string_agg(g.dst, ',' ORDER BY g.rank) AS neighbors
    FROM embeddings e JOIN {_GRAPH} g ON g.src = e.vec_id GROUP BY ALL
""")
def vectors_and_graph_files(spark: SparkSession, d: str) -> DataFrame:
    """Vectors, labels and neighbour graph written one by one and loaded together."""
    e, to = table(spark, d, "embeddings"), scratch(spark, "vectors")
    T.save_table(e.drop("label"), f"{to}/vectors")
    T.save_table(e.select("vec_id", "label"), f"{to}/labels")
    T.save_table(knn_graph(e, NEAR), f"{to}/edges")
    got = T.load_embedding_data(spark, f"{to}/vectors", f"{to}/labels", f"{to}/edges")
    near = got["edges"].groupBy(F.col("src").alias("vec_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"]), ",").alias("neighbors"))
    total = F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 4)
    return got["vectors"].select("vec_id", F.coalesce("label", F.lit(-1)).cast("int").alias("label"), total.alias("total")).join(near, "vec_id")


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def cached_counts(spark: SparkSession, d: str) -> DataFrame:
    """A result computed once for a set of inputs; the second call must find it, as it has no way to compute it."""
    docs, to = table(spark, d, "documents").select("doc_id", "source", "n_chars"), scratch(spark, "cache")
    T.get_or_compute(spark, to, docs, lambda x: x.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")), "doc_id", "n_chars")

    def never(_: DataFrame) -> DataFrame:
        raise RuntimeError("the cache should have been found")

    return T.get_or_compute(spark, to, docs, never, "doc_id", "n_chars")


@query("SELECT DISTINCT trim(path) AS path FROM image_records WHERE length(trim(path)) > 0")
def paths_file(spark: SparkSession, d: str) -> DataFrame:
    """Paths written with blanks and empty lines between them, and read."""
    to = scratch(spark, "paths")
    rows = table(spark, d, "image_records").where("path is not null").select(F.trim("path").alias("path")).distinct()
    rows.select(F.explode(F.array(F.concat(F.lit("  "), F.col("path"), F.lit(" ")), F.lit(""), F.lit("   "))).alias("value")).write.text(to)
    return T.read_paths(spark, to)


@query("SELECT 'vectors_b.bin' AS newest, false AS found_none")
def newest_file(spark: SparkSession, d: str) -> DataFrame:
    """The file changed last, whatever its name."""
    to = scratch(spark, "newest")
    for name, day in (("a", 2), ("b", 9), ("c", 5)):
        put(spark, f"{to}/vectors_{name}.bin", name.encode(), 1_700_000_000_000 + day * 86_400_000)
    newest = T.newest_file(spark, f"{to}/vectors_*.bin")
    return spark.createDataFrame([(newest.rsplit("/", 1)[-1], T.newest_file(spark, f"{to}/none_*.bin") is not None)], "newest string, found_none boolean")


@query("SELECT 'ageGroup' AS name, n_name AS nation, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def group_attribute_file(spark: SparkSession, d: str) -> DataFrame:
    """The first file with a column that names subgroups and with as many rows as expected."""
    to = scratch(spark, "groups")
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("nation"), F.col("r_name").alias("ageGroup"))
    T.save_csv(nations.select("nation", F.col("ageGroup").alias("message")), f"{to}/first")
    T.save_csv(nations.limit(3), f"{to}/second")
    T.save_csv(nations, f"{to}/third")
    rows, name = T.find_group_attribute(spark, [f"{to}/none", f"{to}/first", f"{to}/second", f"{to}/third"], nations.count())
    return rows.select(F.lit(name).alias("name"), "nation", F.col(name).alias("value"))


@query("""
    SELECT 'Balance classes: the largest is ' || format('{:,.2f}', max(c) / min(c)) || ' times the smallest.' AS suggestions FROM (SELECT count(*) AS c FROM documents GROUP BY source)
    UNION ALL SELECT 'error: no readable report'
""")
def report_file(spark: SparkSession, d: str) -> DataFrame:
    """A report written as JSON and read for its suggestions; a missing file gives an error row."""
    to = scratch(spark, "report")
    counts = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("c"))
    metrics = counts.agg(F.map_from_entries(F.collect_list(F.struct("source", "c"))).alias("class_distribution")).select("class_distribution", F.lit(0).cast("long").alias("high_influence_count"), F.struct(F.lit(False).alias("available"), F.lit(None).cast("double").alias("label_distribution_parity"), F.lit(False).alias("robustness_flag")).alias("group_analysis"))
    T.save_report(repair.to_report(metrics).coalesce(1), to)
    both = T.read_report(spark, to).unionByName(T.read_report(spark, f"{to}/none"))
    return repair.repair_suggestions(both).select(F.array_join("suggestions", " | ").alias("suggestions"))


@query("SELECT source, string_agg(DISTINCT host, ', ' ORDER BY host) AS hosts, count(*)::VARCHAR AS n FROM documents WHERE source IS NOT NULL AND host IS NOT NULL GROUP BY source")
def report_download(spark: SparkSession, d: str) -> DataFrame:
    """A table with lists as CSV: they become text joined by commas."""
    to = scratch(spark, "download")
    rows = table(spark, d, "documents").where("source is not null and host is not null").groupBy("source").agg(F.array_sort(F.collect_set("host")).alias("hosts"), F.count("*").alias("n"))
    T.save_csv(rows, to)
    return spark.read.csv(to, header=True)


@query("""
    WITH c AS (SELECT source, count(*) AS c FROM documents WHERE source IS NOT NULL GROUP BY source), e AS (SELECT max(c) AS mx, min(c) AS mn FROM c)
    SELECT source, count(DISTINCT doc_id) AS n_distinct, any_value(CASE WHEN mx > 1.5 * mn THEN mx ELSE c.c END) AS "count" FROM documents JOIN c USING (source), e GROUP BY source
""")
def repaired_file(spark: SparkSession, d: str) -> DataFrame:
    """A dataset with its classes raised to the largest, as CSV and counted again."""
    to = scratch(spark, "repaired")
    T.save_csv(rebalance(table(spark, d, "documents").where("source is not null").select("doc_id", "source"), "doc_id", "source"), to)
    return spark.read.csv(to, header=True).groupBy("source").agg(F.count_distinct("doc_id").alias("n_distinct"), F.count("*").alias("count"))


# -- image files ------------------------------------------------------------------------


def _png(rgb: list[list[tuple[int, int, int]]]) -> bytes:
    raw = b"".join(b"\0" + bytes(x for p in row for x in p) for row in rgb)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rgb[0]), len(rgb), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


#: Parameter: sides of the pictures of nations.
SIDE = 8


def _nation_files(spark: SparkSession, d: str) -> dict[str, bytes]:
    """A picture of each nation in the folder of its region (25 fixed rows), and files that are none."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name").collect()
    pixel = lambda k, x, y: ((k * 37 + x * 11 + y * 5) % 256, (k * 53 + x * y * 3) % 256, (k * 29 + x * x + y) % 256)
    out = {f"{r.r_name if r.r_name != 'EUROPE' else 'Unlabeled'}/{r.n_name}.png": _png([[pixel(r.n_nationkey, x, y) for x in range(SIDE)] for y in range(SIDE)]) for r in rows}
    extra = ("__MACOSX/ASIA/X.png", ".hidden/Y.png", "ASIA/._Z.png", "ASIA/notes.txt")
    return out | {"loose.PNG": _png([[(1, 2, 3)] * SIDE] * SIDE), "ASIA/broken.png": b"no picture"} | dict.fromkeys(extra, b"x")


def _nation_folder(spark: SparkSession, d: str) -> str:
    to = scratch(spark, "nations")
    for name, content in _nation_files(spark, d).items():
        put(spark, f"{to}/{name}", content)
    return to


_NATIONS = "(SELECT n_nationkey AS k, n_name AS id, CASE WHEN r_name <> 'EUROPE' THEN r_name END AS label, CASE WHEN r_name <> 'EUROPE' THEN r_name ELSE 'Unlabeled' END AS folder FROM nation JOIN region ON n_regionkey = r_regionkey)"
_LISTED = f"SELECT id, folder || '/' || id || '.png' AS file, label FROM {_NATIONS} UNION ALL SELECT 'loose', 'loose.PNG', NULL UNION ALL SELECT 'broken', 'ASIA/broken.png', 'ASIA'"


def _relative(df: DataFrame, root: str) -> DataFrame:
    # the folder's own name is the only part of the path that is known in every file system
    return df.withColumn("file", F.element_at(F.split("path", root.rsplit("/", 1)[-1] + "/"), -1))


@query(_LISTED)
def labelled_folders(spark: SparkSession, d: str) -> DataFrame:
    """Images below a folder, labelled by their own folder; hidden and junk files are left out."""
    root = _nation_folder(spark, d)
    return _relative(I.load_dataset(spark, root), root).select("id", "file", "label")


@query(f"SELECT id, file, NULL::VARCHAR AS label FROM ({_LISTED})")
def unlabelled_folders(spark: SparkSession, d: str) -> DataFrame:
    root = _nation_folder(spark, d)
    return _relative(I.load_dataset(spark, root, structured=False), root).select("id", "file", "label")


@query(_LISTED)
def unpacked_archive(spark: SparkSession, d: str) -> DataFrame:
    """An uploaded archive, unpacked and listed."""
    root, held = scratch(spark, "upload"), io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, content in _nation_files(spark, d).items():
            z.writestr(name, content)
    put(spark, f"{root}/up.zip", held.getvalue())
    to = f"{root}/unpacked"
    unpack(spark, f"{root}/up.zip", to)
    return _relative(I.load_dataset(spark, to), to).select("id", "file", "label")


_NPX = f"""
    px AS (SELECT folder || '/' || id || '.png' AS file, x, y, (k * 37 + x * 11 + y * 5) % 256 AS r, (k * 53 + x * y * 3) % 256 AS g, (k * 29 + x * x + y) % 256 AS b
        FROM {_NATIONS}, (SELECT unnest(range({SIDE})) AS x), (SELECT unnest(range({SIDE})) AS y)
        UNION ALL SELECT 'loose.PNG', x, y, 1, 2, 3 FROM (SELECT unnest(range({SIDE})) AS x), (SELECT unnest(range({SIDE})) AS y)),
    gr AS (SELECT file, x, y, (114 * b + 587 * g + 299 * r + 500) // 1000 AS v FROM px)
"""


@query(f"""
    WITH {_NPX}, nb AS (SELECT file, x, y, v, {SIDE - 1} - abs({SIDE - 1} - abs(x + 1)) AS xr, abs(x - 1) AS xl, {SIDE - 1} - abs({SIDE - 1} - abs(y + 1)) AS yd, abs(y - 1) AS yu FROM gr)
    SELECT a.file, round(var_pop(l.v + r.v + u.v + d.v - 4 * a.v) + 1e-9, 6) AS variance, CASE WHEN var_pop(l.v + r.v + u.v + d.v - 4 * a.v) < 100 THEN 'blurry' ELSE 'good' END AS quality_label
    FROM nb a JOIN gr l ON l.file = a.file AND l.y = a.y AND l.x = a.xl JOIN gr r ON r.file = a.file AND r.y = a.y AND r.x = a.xr JOIN gr u ON u.file = a.file AND u.x = a.x AND u.y = a.yu JOIN gr d ON d.file = a.file AND d.x = a.x AND d.y = a.yd
    GROUP BY a.file
""")
def folder_sharpness(spark: SparkSession, d: str) -> DataFrame:
    """Decoded image files with their sharpness; files that cannot be decoded are skipped."""
    root = _nation_folder(spark, d)
    listed = I.list_images(spark, root).select(F.regexp_replace("path", "^[a-z0-9]+:/*", "/").alias("plain"))
    images = I.read_images(spark, root)
    known = images.join(F.broadcast(listed), F.regexp_replace("path", "^[a-z0-9]+:/*", "/") == F.col("plain"), "left_semi")
    return _relative(R.sharpness(known), root).select("file", F.round(F.col("variance") + 1e-9, 6).alias("variance"), "quality_label")


@query(f"WITH {_NPX}, c AS (SELECT file, list(b ORDER BY y, x) AS b FROM px GROUP BY file) SELECT file, round(len(list_filter(b, lambda v: v < 16)) / {SIDE * SIDE}.0, 6) AS dark_blue FROM c")
def streamed_images(spark: SparkSession, d: str) -> DataFrame:
    """Image files embedded as a stream, stopped and taken up again; a figure of the vectors shows that each file came once."""
    root, out = _nation_folder(spark, d), scratch(spark, "stream")
    for most in (7, 100):
        ended = wait(stream_embeddings(spark, root, f"{out}/vectors", f"{out}/state", files_per_batch=most), 600)
        if ended != "done":
            raise RuntimeError(ended)
    rows = spark.read.parquet(f"{out}/vectors").where(~F.exists(F.split("path", "/"), lambda p: p.startswith(".") | (p == I.JUNK)))
    return _relative(rows, root).select("file", F.round(F.col("embedding")[0].cast("double"), 6).alias("dark_blue"))
