"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenaudit.functions.runtime import table
from lumenaudit.llm.cross_polytope import similar_vectors
from lumenaudit.llm.density import cluster_vectors, describe_clusters
from lumenaudit.functions.labels import label_key, label_key_sql
from lumenaudit.llm.diverse_subset import diverse_subset, representatives
from lumenaudit.llm.quota_sample import sample_by_targets
from lumenaudit.llm.percentiles import percentile_state, percentiles, regroup_state
from lumenaudit.llm.languages import label_cases, language_stretches
from lumenaudit.llm.leaks import leaked_passages
from lumenaudit.llm.mixing import mix_sources
from lumenaudit.llm.near_duplicates import near_duplicate_groups, pairs_of_groups

Query = Callable[[SparkSession, str], DataFrame]

#: Fixed value: neighbours and cluster members count from this cosine on.
SIMILAR = 0.72


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of which one is among the ten most similar of the other."""
    near = similar_vectors(table(spark, d, "vectors"), k=10, min_similarity=SIMILAR)
    return near.select(F.least("vec_id", "neighbor_id").alias("vec_id_a"), F.greatest("vec_id", "neighbor_id").alias("vec_id_b")).distinct()


def p1_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar other records of every usable record, whatever their similarity."""
    return similar_vectors(table(spark, d, "vectors"), k=10, exact=True)


#: Parameter: the sample's part of all records.
SAMPLE_FRACTION = 0.4


def _sample(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w, h = F.col("metadata.width"), F.col("metadata.height")
    shape = F.when(w.isNull() | h.isNull(), "unknown").when(w == h, "square").when(w > h, "landscape").otherwise("portrait")
    return sample_by_targets(table(spark, d, "image_records"), table(spark, d, "sample_targets"), shape, SAMPLE_FRACTION)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Labels whose target cannot be met: those with flow on their slack arc."""
    return _sample(spark, d)[1].where("shortfall > 0").select("label")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """What each label has, asks for, gets and lacks."""
    return _sample(spark, d)[1]


def p2_shortfalls(spark: SparkSession, d: str) -> DataFrame:
    """What each label has, asks for and lacks: the part of the report that no draw decides."""
    return _sample(spark, d)[1].select("label", "available", "wanted", "shortfall")


def p2_sample_facts(spark: SparkSession, d: str) -> DataFrame:
    """One row on the drawn sample: its size, its distinct records, its rows of labels without a target."""
    rows = _sample(spark, d)[0].join(table(spark, d, "sample_targets").select("label", F.lit(True).alias("known")).distinct(), "label", "left")
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("vec_id").alias("n_records"), F.count_if(F.col("known").isNull()).alias("n_other"))


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    """The records drawn."""
    return _sample(spark, d)[0]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every two records of one group of copies and slight edits."""
    return pairs_of_groups(near_duplicate_groups(table(spark, d, "image_records"), table(spark, d, "vectors")))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per record in a group of copies, with its group and the group's size."""
    return near_duplicate_groups(table(spark, d, "image_records"), table(spark, d, "vectors"))


#: Parameter: members of the varied subset.
SUBSET = 400


def p4_representatives(spark: SparkSession, d: str) -> DataFrame:
    """Each record with the member of the varied subset that stands for it."""
    vectors = table(spark, d, "vectors")
    return representatives(vectors, diverse_subset(vectors, SUBSET))


def p4_varied_subset(spark: SparkSession, d: str) -> DataFrame:
    """Records that cover the variety of vectors and labels, in the order they were chosen."""
    return diverse_subset(table(spark, d, "vectors"), SUBSET).withColumn("gain", F.round("gain", 6))


def p4_facts(spark: SparkSession, d: str) -> DataFrame:
    """One row on the subset: its size, its distinct records, its last rank, and rises of the gains (greedy gains never rise)."""
    out = diverse_subset(table(spark, d, "vectors"), SUBSET)
    next_ = out.select((F.col("rank") - 1).alias("rank"), F.col("gain").alias("next"))
    return out.join(next_, "rank", "left").agg(F.count("*").alias("n_rows"), F.count_distinct("vec_id").alias("n_records"), F.max("rank").alias("last_rank"), F.count_if(F.col("next") > F.col("gain") + 1e-4).alias("n_rises"))


#: Parameter: the percentiles that are reported.
FRACTIONS = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """One row per measurement; repeated rows of a measure_id are one."""
    rows = table(spark, d, "quality_scores").select("measure_id", label_key("label").alias("label"), "scan_day", "quality_score")
    return rows.distinct()


def p5_percentiles_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of quality_score of each label and day; rows without a label are a group of their own."""
    out = percentiles(percentile_state(_scores(spark, d), ["label", "scan_day"], "quality_score"), FRACTIONS)
    return out.withColumn("percentile", F.round("percentile", 8))


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each label over all days, combined from the states of the days."""
    days = percentile_state(_scores(spark, d), ["label", "scan_day"], "quality_score")
    return percentiles(regroup_state(days, ["label"]), FRACTIONS).withColumn("percentile", F.round("percentile", 8))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of the clusters of five or more records."""
    return cluster_vectors(table(spark, d, "vectors"), min_similarity=SIMILAR, min_points=5, min_size=5).select("cluster_id", "vec_id")


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters with size, medoids and label make-up."""
    vectors = table(spark, d, "vectors")
    return describe_clusters(vectors, cluster_vectors(vectors, min_similarity=SIMILAR, min_points=5, min_size=5))


#: Fixed value: consecutive words in common from which on an item counts as leaked.
RUN = 12


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Items found in each page, whole, in part or slightly changed."""
    out = leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"), min_words=RUN)
    return out.withColumn("similarity", F.round("similarity", 6)).withColumn("item_share", F.round("item_share", 6))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a run of twelve or more words of an item."""
    out = leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"), min_words=RUN)
    return out.where(F.col("longest_run") >= RUN).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that stay below their share of all tokens although used as often as they may be: those the fit leaves short."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")).fit.where("short").select("source")


def _shares(report: DataFrame) -> DataFrame:
    return report.withColumns({c: F.round(c, 6) for c in ("wanted_tokens", "expected_tokens", "expected_share", "drawn_share")})


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Wanted, expected and drawn shares of each source in a mixture as large as all documents."""
    return _shares(mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")).report)


def p9_balanced_report(spark: SparkSession, d: str) -> DataFrame:
    """The same of the largest mixture in which every source reaches its share."""
    return _shares(mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"), size="most").report)


def p9_balanced_facts(spark: SparkSession, d: str) -> DataFrame:
    """Does each source reach its share within a hundredth of all tokens, and is none of its pages used too often?"""
    mix = mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"), size="most")
    used = mix.documents.groupBy("source").agg(F.max("copies").alias("most"))
    near = F.abs(F.col("drawn_share") - F.col("target_share")) <= 0.01
    return mix.report.join(used, "source", "left").select("source", near.alias("near_target"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How often each page is used in the largest mixture in which every source reaches its share."""
    out = mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"), size="most").documents
    return out.withColumn("rate", F.round("rate", 6))


#: Fixed value: words from which on a stretch makes a page's language.
STRETCH = 40


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose language label is absent, wrong or one of several, with their languages."""
    return label_cases(language_stretches(table(spark, d, "documents"), min_words=STRETCH), STRETCH).select("doc_id", "lang")


def p10_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of every page with its language and confidence."""
    out = language_stretches(table(spark, d, "documents"))
    return out.withColumns({c: F.round(c, 4) for c in ("doc_confidence", "confidence")})


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    scores = f"(SELECT DISTINCT measure_id, {label_key_sql('label')} AS label, scan_day, quality_score FROM quality_scores WHERE quality_score IS NOT NULL AND NOT isnan(quality_score))"

    def percentile_sql(group: str) -> str:
        one = "SELECT {g}, count(*) AS n_values, {f}::DOUBLE AS fraction, round(quantile_cont(quality_score, {f}), 8) + 0.0 AS percentile FROM {s} GROUP BY {g}"
        return " UNION ALL ".join(one.format(g=group, f=f, s=scores) for f in FRACTIONS)

    latest = f"(SELECT vec_id, k AS label FROM (SELECT vec_id, {label_key_sql('label')} AS k, row_number() OVER (PARTITION BY vec_id ORDER BY scanned_at DESC NULLS LAST, arrived_at DESC NULLS LAST, {label_key_sql('label')} DESC NULLS LAST) AS r FROM image_records WHERE vec_id IS NOT NULL) WHERE r = 1)"
    usable = """(SELECT vec_id, any_value(embedding::DOUBLE[]) AS e FROM vectors WHERE len(embedding) = 128 AND len(list_filter(embedding, lambda x: isfinite(x))) = 128
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id)"""
    near = f"(SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS s FROM {usable} a, {usable} b WHERE round(list_cosine_similarity(a.e, b.e), 6) >= {SIMILAR})"
    tokens = "(SELECT vec_id, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(split_part(path, '/', -1)), '\\.[^.]*$', ''), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM (SELECT vec_id, min(path) AS path FROM image_records GROUP BY vec_id))"
    links = f"""v AS MATERIALIZED (SELECT vec_id, e FROM {usable} WHERE vec_id IN (SELECT vec_id FROM image_records)), n AS MATERIALIZED (SELECT * FROM {tokens} WHERE len(t) > 0),
            l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) > 0.95
                UNION SELECT a.vec_id, b.vec_id FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(list_intersect(a.t, b.t)) >= 0.75 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))),
            r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)"""
    return {
        "p1_found": f"SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM {near} WHERE a <> b) WHERE r <= 10",
        # links of clusters join every two members, so a record's neighbours are its cluster
        "p6_found": f"SELECT min(b) AS cluster_id, a AS vec_id FROM {near} GROUP BY a HAVING count(*) >= 5",
        "p3_groups": f"""
            WITH RECURSIVE {links} SELECT a AS vec_id, least(a, min(b)) AS group_id, count(DISTINCT b) AS size FROM r GROUP BY a
        """,
        "p6_clusters": f"""
            WITH m AS MATERIALIZED (SELECT min(b) AS cluster_id, a AS vec_id FROM {near} GROUP BY a HAVING count(*) >= 5),
            v AS MATERIALIZED (SELECT m.cluster_id, m.vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM m JOIN {usable} x USING (vec_id)),
            c AS (SELECT cluster_id, list(t ORDER BY i) AS mean FROM (SELECT cluster_id, i, avg(u[i]) AS t FROM v, (SELECT unnest(range(1, 129)) AS i) GROUP BY ALL) GROUP BY cluster_id),
            s AS (SELECT v.cluster_id, vec_id, list_cosine_similarity(u, mean) AS s FROM v JOIN c USING (cluster_id)),
            t AS (SELECT cluster_id, string_agg(vec_id, ',' ORDER BY r) AS medoids FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(s, 9) DESC, vec_id) AS r FROM s) WHERE r <= 3 GROUP BY cluster_id),
            k AS (SELECT cluster_id, label, count(*) AS n FROM m JOIN (SELECT vec_id, min({label_key_sql("label")}) AS label FROM vectors WHERE len(embedding) = 128 AND len(list_filter(embedding, lambda x: isfinite(x))) = 128 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id) USING (vec_id) WHERE label IS NOT NULL GROUP BY ALL),
            g AS (SELECT cluster_id, count(*) AS n_labels, string_agg(label || ':' || n, ',' ORDER BY r) FILTER (WHERE r <= 3) AS labels FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, label) AS r FROM k) GROUP BY cluster_id)
            SELECT s.cluster_id, count(*) AS size, coalesce(any_value(n_labels), 0) AS n_labels, any_value(labels) AS labels, any_value(medoids) AS medoids, round(avg(s), 6) AS cohesion
            FROM s JOIN t USING (cluster_id) LEFT JOIN g USING (cluster_id) GROUP BY s.cluster_id
        """,
        "p2_shortfalls": f"""
            SELECT label, available, wanted, greatest(0, wanted - available)::BIGINT AS shortfall FROM (
                SELECT t.label, coalesce(c.n, 0) AS available, ceil(greatest(t.min_rows, t.target_share * {SAMPLE_FRACTION} * (SELECT count(*) FROM {latest})))::BIGINT AS wanted
                FROM sample_targets t LEFT JOIN (SELECT label, count(*) AS n FROM {latest} GROUP BY label) c ON c.label = t.label)
        """,
        # the labels with a target hold more records than the sample asks for, and their minimums take less
        "p2_sample_facts": f"SELECT round({SAMPLE_FRACTION} * count(*))::BIGINT AS n_rows, round({SAMPLE_FRACTION} * count(*))::BIGINT AS n_records, 0::BIGINT AS n_other FROM {latest}",
        # exact copies add nothing; of other vectors there are enough in all test data
        "p4_facts": f"SELECT least({SUBSET}, count(*)) AS n_rows, least({SUBSET}, count(*)) AS n_records, least({SUBSET}, count(*))::INT AS last_rank, 0::BIGINT AS n_rises FROM (SELECT DISTINCT e FROM {usable})",
        "p9_balanced_facts": "SELECT source, true AS near_target, true AS within_cap FROM mix_targets",
        "p3_found": f"""
            WITH RECURSIVE {links}
            SELECT a AS vec_id_a, b AS vec_id_b FROM r WHERE a < b
        """,
        # no source is near its limit, so characters tell the same as tokens
        "p9_found": """
            SELECT t.source FROM mix_targets t LEFT JOIN (SELECT source, sum(length(text)) AS n FROM documents GROUP BY source) d USING (source)
            WHERE t.max_repeats * coalesce(n, 0) < t.target_share * (SELECT sum(length(text)) FROM documents)
        """,
        "p2_found": f"""
            SELECT t.label FROM sample_targets t LEFT JOIN (SELECT label, count(*) AS n FROM {latest} GROUP BY label) c ON c.label = t.label
            WHERE coalesce(c.n, 0) < greatest(t.min_rows, t.target_share * {SAMPLE_FRACTION} * (SELECT count(*) FROM {latest}))
        """,
        "p5_percentiles_by_day": percentile_sql("label, scan_day"),
        "p5_percentiles": percentile_sql("label"),
    }
