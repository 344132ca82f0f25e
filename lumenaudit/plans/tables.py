"""Queries on paths, joins by key, signatures and gray tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenaudit.functions.register import register_functions
from lumenaudit.functions.runtime import table
from lumenaudit.operators.raster import tile_properties
from lumenaudit.plans.registry import query
from lumenaudit.sources import tables as T
from lumenaudit.sources.images import folder_label, has_ending, make_id

#: Parameter: tiles made from test vectors are rough, so they count as blurry below this variance.
TILE_BLURRY = 5000


@query("SELECT DISTINCT path, regexp_replace(split_part(path, '/', -1), '(.)\\.[^.]+$', '\\1') AS sample_id FROM image_records WHERE path IS NOT NULL")
def make_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "image_records").where("path is not null").select("path", make_id(F.col("path")).alias("sample_id")).distinct()


@query("""
    SELECT DISTINCT path, CASE WHEN lower(split_part(path, '/', -2)) IN ('unlabeled', 'unlabelled', 'unannotated', 'unknown', 'untagged') THEN NULL ELSE split_part(path, '/', -2) END AS label,
        lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('jpg', 'jpeg', 'png', 'bmp', 'tiff', 'webp') AS is_image FROM image_records WHERE path IS NOT NULL
""")
def path_label(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return table(spark, d, "image_records").where("path is not null").select("path", folder_label(p).alias("label"), has_ending(p).alias("is_image")).distinct()


@query("SELECT DISTINCT vec_id FROM vectors WHERE vec_id NOT IN (SELECT vec_id FROM knn_graph)")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return T.resume(table(spark, d, "vectors").select("vec_id").distinct(), table(spark, d, "knn_graph"), "vec_id")


@query("SELECT DISTINCT vec_id FROM vectors WHERE vec_id IN (SELECT vec_id FROM image_records)")
def known_records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vectors").select("vec_id").distinct()
    return rows.join(table(spark, d, "image_records").select("vec_id"), "vec_id", "left_semi")


@query("""
    SELECT r.vec_id, coalesce(v.label, 'unknown') AS label FROM (SELECT DISTINCT vec_id FROM image_records) r
    LEFT JOIN (SELECT vec_id, min(label) AS label FROM vectors GROUP BY vec_id) v USING (vec_id)
""")
def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    return T.lookup(table(spark, d, "image_records").select("vec_id").distinct(), table(spark, d, "vectors"), "vec_id", "label", "unknown")


@query("""
    SELECT doc_id, coalesce(lang, CASE WHEN source = 'manuals' THEN 'manual' END, 'unknown') AS label FROM documents
""")
def apply_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("lang").alias("label"))
    new = docs.where("source = 'manuals'").select("doc_id", F.lit("manual").alias("final_label"))
    return T.apply_labels(docs, new, "doc_id").select("doc_id", "label")


@query("""
    WITH h AS (SELECT source, sha256(coalesce(doc_id::VARCHAR, 'missing') || ':' || coalesce(n_chars::VARCHAR, 'missing')) AS x FROM documents),
    s AS (SELECT source, count(*) AS n, sum(('0x' || substr(x, 1, 12))::BIGINT::HUGEINT) AS a, sum(('0x' || substr(x, 13, 12))::BIGINT::HUGEINT) AS b,
        sum(('0x' || substr(x, 25, 12))::BIGINT::HUGEINT) AS c, sum(('0x' || substr(x, 37, 12))::BIGINT::HUGEINT) AS e FROM h GROUP BY source)
    SELECT source, n, substr(sha256(a || ':' || b || ':' || c || ':' || e || ':' || n), 1, 16) AS signature FROM s
""")
def cache_signature(spark: SparkSession, d: str) -> DataFrame:
    return T.signature(table(spark, d, "documents"), "doc_id", "n_chars", group=["source"])


@query("""
    SELECT vec_id, coalesce(width < 64 OR height < 64 OR width / nullif(height, 0) > 3 OR width / nullif(height, 0) < 0.33 OR c < 0.05, true) AS low_quality
    FROM (SELECT vec_id, min(metadata.width) AS width, min(metadata.height) AS height, min(metadata.std_brightness) / 255 AS c FROM image_records GROUP BY vec_id)
""")
def low_quality_flags(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "image_records").groupBy("vec_id").agg(F.min("metadata.width").alias("w"), F.min("metadata.height").alias("h"), (F.min("metadata.std_brightness") / 255).alias("c"))
    return one.select("vec_id", F.coalesce(T.low_quality(F.col("w"), F.col("h"), F.col("c")), F.lit(True)).alias("low_quality"))


@query("SELECT label, count(*) AS n FROM (SELECT label FROM vectors UNION ALL SELECT label FROM image_records) GROUP BY label")
def union_label_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vectors").select("label").unionByName(table(spark, d, "image_records").select("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


@query("""
    SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dist
    FROM embeddings a, embeddings b WHERE b.vec_id = 1
""")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    register_functions(spark)
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    one = e.where("vec_id = 1").select(F.col("e").alias("f"))
    return e.crossJoin(F.broadcast(one)).selectExpr("vec_id", "round(cosine_sim(e, f), 6) AS sim", "round(l2_dist(e, f), 6) AS dist")


_PX = "(SELECT vec_id, list_transform(embedding::DOUBLE[], lambda e: floor((e + 1) * 127.5)) AS p FROM embeddings)"
_XY = "(SELECT unnest(range(8)) AS x) xs, (SELECT unnest(range(8)) AS y) ys"


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    px = F.transform(F.col("embedding").cast("array<double>"), lambda e: F.floor((e + 1) * 127.5).cast("double"))
    return tile_properties(table(spark, d, "embeddings").select("vec_id", px.alias("p")), "vec_id", "p", 8, TILE_BLURRY)


@query(f"SELECT vec_id AS id, round(list_avg(p), 6) AS brightness, round(list_stddev_pop(p), 6) AS contrast FROM {_PX}")
def tile_stats(spark: SparkSession, d: str) -> DataFrame:
    return _tiles(spark, d).select("id", F.round("brightness", 6).alias("brightness"), F.round("contrast", 6).alias("contrast"))


def _mirror(t: str) -> str:
    return f"(7 - abs(7 - abs({t})))"


def _clamp(t: str) -> str:
    return f"greatest(0, least(7, {t}))"


_LAP = " + ".join(f"p[{_mirror(y)} * 8 + {_mirror(x)} + 1]" for y, x in (("y - 1", "x"), ("y + 1", "x"), ("y", "x - 1"), ("y", "x + 1")))
_NINE = ", ".join(f"p[{_clamp(f'y + {a}')} * 8 + {_clamp(f'x + {b}')} + 1]" for a in (-1, 0, 1) for b in (-1, 0, 1))


@query(f"""
    SELECT vec_id AS id, round(var_pop(lap), 6) AS variance, CASE WHEN var_pop(lap) < {TILE_BLURRY} THEN 'blurry' ELSE 'good' END AS quality_label
    FROM (SELECT vec_id, {_LAP} - 4 * p[y * 8 + x + 1] AS lap FROM {_PX}, {_XY}) GROUP BY vec_id
""")
def tile_sharpness(spark: SparkSession, d: str) -> DataFrame:
    return _tiles(spark, d).select("id", F.round("variance", 6).alias("variance"), "quality_label")


@query(f"SELECT vec_id AS id, round(stddev_pop(v), 6) AS noise FROM (SELECT vec_id, p[y * 8 + x + 1] - list_sort([{_NINE}])[5] AS v FROM {_PX}, {_XY}) GROUP BY vec_id")
def tile_noise(spark: SparkSession, d: str) -> DataFrame:
    return _tiles(spark, d).select("id", F.round("noise", 6).alias("noise"))


@query(f"""
    WITH t AS (SELECT vec_id // 4 AS id, flatten(list(p ORDER BY vec_id)) AS p FROM {_PX} GROUP BY 1 HAVING count(*) = 4),
    s AS (SELECT id, x, abs(p[y * 16 + x + 1] - p[y * 16 + x]) AS step FROM t, (SELECT unnest(range(1, 16)) AS x), (SELECT unnest(range(16)) AS y))
    SELECT id, round(avg(step) FILTER (WHERE x = 8) - avg(step) FILTER (WHERE x <> 8), 6) AS compression FROM s GROUP BY id
""")
def tile_blockiness(spark: SparkSession, d: str) -> DataFrame:
    px = F.transform(F.col("embedding").cast("array<double>"), lambda e: F.floor((e + 1) * 127.5).cast("double"))
    four = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 4).alias("id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", px.alias("p")))).alias("t")).where(F.size("t") == 4)
    tiles = four.select("id", F.flatten(F.transform("t", lambda e: e["p"])).alias("p"))
    return tile_properties(tiles, "id", "p", 16).select("id", F.round("compression", 6).alias("compression"))
