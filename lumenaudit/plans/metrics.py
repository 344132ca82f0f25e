"""Queries on counts, balance, groups and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenaudit.functions.labels import label_key, label_key_sql
from lumenaudit.functions.runtime import table
from lumenaudit.operators import metrics as M
from lumenaudit.operators import repair as R
from lumenaudit.operators import sampling as S
from lumenaudit.plans.registry import query

_K = label_key_sql("label")
_LABELS = f"(SELECT {_K} AS k FROM quality_scores WHERE {_K} IS NOT NULL)"
_COUNTS = f"(SELECT k AS class, count(*) AS c FROM {_LABELS} GROUP BY k)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "quality_scores").withColumn("label", label_key("label"))


@query(f'SELECT class, c AS "count", c / sum(c) OVER () AS proportion FROM {_COUNTS}')
def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    return M.class_distribution(_scores(spark, d), "label")


@query(f"""
    SELECT round(sum(-p * log2(p)), 4) AS shannon_entropy, round(1 - sum(p * p), 4) AS gini_index, round(pow(2, sum(-p * log2(p))), 2) AS effective_classes
    FROM (SELECT c / sum(c) OVER () AS p FROM {_COUNTS})
""")
def diversity_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.diversity_metrics(_scores(spark, d), "label")


@query(f'SELECT class, c AS "count" FROM {_COUNTS} WHERE c < 0.5 * (SELECT avg(c) FROM {_COUNTS})')
def flag_imbalance(spark: SparkSession, d: str) -> DataFrame:
    return M.flag_imbalance(_scores(spark, d), "label")


@query(f"""
    WITH m AS (SELECT round(sum(-p * log2(p)), 4) AS shannon_entropy, round(1 - sum(p * p), 4) AS gini_index, round(pow(2, sum(-p * log2(p))), 2) AS effective_classes
               FROM (SELECT c / sum(c) OVER () AS p FROM {_COUNTS}))
    SELECT class, c AS "count", c / sum(c) OVER () AS proportion, c < 0.5 * avg(c) OVER () AS flagged, shannon_entropy, gini_index, effective_classes FROM {_COUNTS}, m
""")
def imbalance_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.summarize_imbalance(_scores(spark, d), "label")


@query("""
    SELECT count(*) AS n_classes, round(stddev_pop(c) / (avg(c) + 1e-9), 6) AS ratio, stddev_pop(c) / (avg(c) + 1e-9) < 0.15 AS balanced
    FROM (SELECT count(*) AS c FROM embeddings GROUP BY label)
""")
def balance_status(spark: SparkSession, d: str) -> DataFrame:
    return M.balance_status(table(spark, d, "embeddings"), "label").withColumn("ratio", F.round("ratio", 6))


def _images(spark: SparkSession, d: str) -> DataFrame:
    cols = {c: F.col(f"metadata.{c}") for c in ("width", "height", "mean_brightness")}
    corrupt = F.coalesce("metadata.is_corrupt", F.col("metadata").isNull())
    return table(spark, d, "image_records").withColumns(cols | {"is_corrupt": corrupt, "label": label_key("label")})


_IMAGES = f"""(SELECT vec_id, path, {_K} AS label, metadata.width AS width, metadata.height AS height, metadata.mean_brightness AS mean_brightness,
    coalesce(metadata.is_corrupt, metadata IS NULL) AS is_corrupt FROM image_records)"""


@query(f"""
    SELECT count(*) AS total, count(label) AS labeled, count(*) - count(label) AS unlabeled, count(DISTINCT label) AS n_classes, count(*) FILTER (WHERE is_corrupt) AS corrupt,
        round(avg(width) FILTER (WHERE width > 0), 6) AS mean_width, median(width) FILTER (WHERE width > 0)::DOUBLE AS median_width,
        round(avg(height) FILTER (WHERE height > 0), 6) AS mean_height, median(height) FILTER (WHERE height > 0)::DOUBLE AS median_height FROM {_IMAGES}
""")
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    out = M.dataset_summary(_images(spark, d), "label", "width", "height", "is_corrupt")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_width", "mean_height")})


@query(f'SELECT width, height, count(*) AS "count", count(*) OVER () <= 1 AS is_uniform FROM {_IMAGES} WHERE width IS NOT NULL AND height IS NOT NULL GROUP BY width, height')
def resolution_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.resolution_summary(_images(spark, d), "width", "height")


@query(f"""
    SELECT (SELECT count(*) FROM {_IMAGES}) AS total, (SELECT count(*) FILTER (WHERE is_corrupt) FROM {_IMAGES}) AS corrupt,
        (SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT DISTINCT path FROM {_IMAGES} WHERE is_corrupt ORDER BY path LIMIT 20)) AS examples
""")
def corruption_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.corruption_summary(_images(spark, d), "is_corrupt", "path")


@query("""
    WITH e AS (SELECT min(n_chars)::DOUBLE AS a, max(n_chars)::DOUBLE AS b FROM documents),
    c AS (SELECT least(floor((n_chars - a) / ((b - a) / 30)), 29)::INT AS bin, count(*) AS n FROM documents, e WHERE n_chars IS NOT NULL GROUP BY 1)
    SELECT g.bin::INT AS bin, round(a + g.bin * ((b - a) / 30), 6) AS low, round(a + (g.bin + 1) * ((b - a) / 30), 6) AS high, coalesce(n, 0) AS "count"
    FROM (SELECT unnest(range(30)) AS bin) g CROSS JOIN e LEFT JOIN c ON c.bin = g.bin
""")
def value_histogram_30(spark: SparkSession, d: str) -> DataFrame:
    return M.value_histogram(table(spark, d, "documents"), "n_chars").withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query("""
    SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean, quantile_cont(n_chars, 0.25) AS q25, quantile_cont(n_chars, 0.5) AS q50, quantile_cont(n_chars, 0.75) AS q75
    FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL GROUP BY source
""")
def group_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return M.group_quantiles(table(spark, d, "documents"), "source", "n_chars").withColumn("mean", F.round("mean", 6))


@query("""
    SELECT source, doc_id, r::INT AS position FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents
        WHERE source IN (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL ORDER BY source LIMIT 6)) WHERE r <= 8
""")
def label_gallery(spark: SparkSession, d: str) -> DataFrame:
    return M.label_gallery(table(spark, d, "documents"), "source", "doc_id")


_DIST = """
    WITH r AS (SELECT source AS g, lower(lang) AS c FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
    n AS (SELECT g, c, count(*) AS n FROM r GROUP BY g, c), t AS (SELECT g, count(*) AS t FROM r GROUP BY g),
    dist AS (SELECT t.g AS "group", k.c AS class, coalesce(n.n, 0) / t.t AS proportion FROM t CROSS JOIN (SELECT DISTINCT c FROM r) k LEFT JOIN n ON n.g = t.g AND n.c = k.c)
"""
_TVD = _DIST + """, tvd AS (SELECT a."group" AS group_a, b."group" AS group_b, sum(abs(a.proportion - b.proportion)) / 2 AS tvd
    FROM dist a JOIN dist b ON a.class = b.class AND a."group" < b."group" GROUP BY 1, 2)"""


def _langs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("lang", F.lower("lang"))


@query(_DIST + 'SELECT "group", class, round(proportion, 9) AS proportion FROM dist')
def group_distribution(spark: SparkSession, d: str) -> DataFrame:
    return M.group_distribution(_langs(spark, d), "source", "lang").withColumn("proportion", F.round("proportion", 9))


@query(_TVD + "SELECT round(tvd, 4) AS label_distribution_parity, group_a, group_b FROM tvd ORDER BY round(tvd, 9) DESC, group_a, group_b LIMIT 1")
def group_parity(spark: SparkSession, d: str) -> DataFrame:
    return M.group_parity(_langs(spark, d), "source", "lang")


@query(_TVD + """SELECT (SELECT count(DISTINCT source) FROM documents) >= 2 AS available, (SELECT count(DISTINCT source) FROM documents) AS n_groups,
    round(tvd, 4) AS label_distribution_parity, group_a, group_b FROM tvd ORDER BY round(tvd, 9) DESC, group_a, group_b LIMIT 1""")
def group_fairness(spark: SparkSession, d: str) -> DataFrame:
    return M.group_fairness(_langs(spark, d), "source", "lang")


_Z = ", ".join(f"avg({c}) OVER () AS m_{c}, stddev_samp({c}) OVER () AS s_{c}" for c in M.PROPERTIES)
_ZS = " ".join(f"{sign} {('abs(%s)' if c in ('brightness', 'saturation') else '%s') % f'coalesce(({c} - m_{c}) / nullif(s_{c}, 0), 0)'}" for c, sign in zip(M.PROPERTIES, ["", "+", "+", "-", "-", "-", "-"]))
_TIERS = f"""
    WITH r AS (SELECT measure_id, min(label) AS label, {', '.join(f'min({c}) AS {c}' for c in M.PROPERTIES)} FROM quality_scores WHERE NOT coalesce(is_corrupt, false) GROUP BY measure_id),
    z AS (SELECT *, {_Z} FROM r), s AS (SELECT measure_id, {_ZS} AS score FROM z),
    q AS (SELECT quantile_cont(score, 1 / 3.0) AS q1, quantile_cont(score, 2 / 3.0) AS q2 FROM s),
    b AS (SELECT measure_id, score, CASE WHEN score <= q1 THEN 'Low' WHEN score <= q2 THEN 'Medium' ELSE 'High' END AS bucket FROM s, q)
"""


def _tiers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "quality_scores").where(~F.coalesce("is_corrupt", F.lit(False)))
    one = rows.groupBy("measure_id").agg(F.min("label").alias("label"), *[F.min(c).alias(c) for c in M.PROPERTIES])
    return M.quality_tiers(one.withColumn("is_corrupt", F.lit(False)))


@query(_TIERS + "SELECT measure_id, round(score, 6) AS quality_score, bucket AS quality_bucket FROM b")
def quality_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _tiers(spark, d).select("measure_id", F.round("quality_score", 6).alias("quality_score"), "quality_bucket")


@query(_TIERS + """
    SELECT bucket, round(mean, 6) AS mean, round(std, 6) AS std, n AS "count", round(max(mean) OVER () - min(mean) OVER (), 6) AS max_disparity,
        max(mean) OVER () - min(mean) OVER () > 0.15 * (abs(avg(mean) OVER ()) + 1e-9) AS flag
    FROM (SELECT bucket, avg(r.contrast) AS mean, stddev_samp(r.contrast) AS std, count(r.contrast) AS n FROM b JOIN r USING (measure_id) GROUP BY bucket)
""")
def quality_disparity(spark: SparkSession, d: str) -> DataFrame:
    return M.disparity(_tiers(spark, d), "quality_bucket", "contrast").withColumns({c: F.round(c, 6) for c in ("mean", "std", "max_disparity")})


@query("""
    SELECT (d - 1)::INT AS dim, round(corr(e[d]::DOUBLE, code), 6) AS correlation
    FROM (SELECT embedding AS e, dense_rank() OVER (ORDER BY label) - 1 AS code FROM embeddings), (SELECT unnest(range(1, 65)) AS d) GROUP BY d
""")
def dim_group_correlation(spark: SparkSession, d: str) -> DataFrame:
    return M.dimension_correlation(table(spark, d, "embeddings"), "embedding", "label").withColumn("correlation", F.round("correlation", 6))


# -- samples and repairs --------------------------------------------------------------


@query("SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def deterministic_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.sample_rows(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 100)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS position FROM documents")
def deterministic_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return S.shuffle_positions(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("""
    SELECT doc_id, source, CASE WHEN source IS NOT NULL AND row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) <= ceil(0.1 * count(*) OVER (PARTITION BY source))
        THEN 'val' ELSE 'train' END AS split FROM documents
""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return S.stratified_split(table(spark, d, "documents").select("doc_id", "source"), "doc_id", "source")


_COPIES = """
    WITH c AS (SELECT source, count(*) AS c FROM documents WHERE source IS NOT NULL GROUP BY source), e AS (SELECT max(c) AS mx, min(c) AS mn FROM c),
    r AS (SELECT doc_id, source, c, mx, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents JOIN c USING (source), e)
    SELECT doc_id, source, unnest(range(mx // c + CASE WHEN r <= mx % c THEN 1 ELSE 0 END))::INT AS copy FROM r
"""


@query(_COPIES)
def class_rebalance(spark: SparkSession, d: str) -> DataFrame:
    return S.rebalance(table(spark, d, "documents").select("doc_id", "source"), "doc_id", "source")


@query(f'SELECT source, count(*) AS "count" FROM ({_COPIES}) GROUP BY source')
def rebalanced_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.rebalance(table(spark, d, "documents").select("doc_id", "source"), "doc_id", "source").groupBy("source").agg(F.count("*").alias("count"))


@query("""
    WITH c AS (SELECT source, count(*) AS c FROM documents GROUP BY source),
    b AS (SELECT arg_min(source, (-c, source)) AS big, arg_min(source, (c, source)) AS small, max(c) AS mx FROM c),
    r AS (SELECT doc_id, source, c, mx, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents JOIN c USING (source), b WHERE source IN (big, small))
    SELECT source, count(*) AS "count" FROM (SELECT source, unnest(range(mx // c + CASE WHEN r <= mx % c THEN 1 ELSE 0 END)) FROM r) GROUP BY source
""")
def rebalanced_two_classes(spark: SparkSession, d: str) -> DataFrame:
    out = S.rebalance(table(spark, d, "documents").select("doc_id", "source"), "doc_id", "source", mode="minmax")
    return out.groupBy("source").agg(F.count("*").alias("count"))


@query(_TVD + """
    SELECT 'Balance classes: the largest is ' || format('{:,.2f}', r) || ' times the smallest.' || ' | ' || 'Review groups: label shares differ by ' || format('{:,.2f}', t) || '.' || ' | ' || 'Review 3 samples of high influence.' AS suggestions
    FROM (SELECT max(c) / min(c) AS r FROM (SELECT count(*) AS c FROM documents GROUP BY source)), (SELECT round(max(tvd), 4) AS t FROM tvd)
""")
def repair_suggestions(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("c"))
    classes = counts.agg(F.map_from_entries(F.collect_list(F.struct("source", "c"))).alias("class_distribution"))
    parity = M.group_fairness(_langs(spark, d), "source", "lang").select(F.struct("available", "label_distribution_parity", F.lit(False).alias("robustness_flag")).alias("group_analysis"))
    report = R.to_report(classes.crossJoin(parity).withColumn("high_influence_count", F.lit(3).cast("long")))
    return R.repair_suggestions(report).select(F.array_join("suggestions", " | ").alias("suggestions"))
