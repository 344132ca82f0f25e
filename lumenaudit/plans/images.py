"""Queries on images. The pictures are made from the vectors of ``embeddings``, so that SQL can check every figure."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenaudit.functions.runtime import table
from lumenaudit.operators import raster as R
from lumenaudit.operators.similarity import label_images
from lumenaudit.plans.registry import query

#: Parameters: pixels of a picture, its widths, which pictures are broken, and the bound of a blurry one.
PIXELS, WIDE, NARROW, BROKEN, ROUGH = 256, 32, 16, "vec_id % 10 = 7", 9000.0

_LEVEL = "greatest(0, least(255, floor((e + 1) * 127.5)))"
# blue, green and red of pixel i, numbered row by row, out of the 64 numbers of a vector
_AT = ("cast((i * 7 + i div 64) % 64 as int)", "cast((i * 5 + 1) % 64 as int)", "cast((i * 11 + 2 + i div 16) % 64 as int)")
_WIDTH = f"CASE WHEN vec_id % 3 = 0 THEN {WIDE} ELSE {NARROW} END"

_PX = f"""
    v AS (SELECT vec_id, label, {_WIDTH} AS w, {PIXELS} // ({_WIDTH}) AS h, list_transform(embedding::DOUBLE[], lambda e: {_LEVEL}::BIGINT) AS l FROM embeddings WHERE NOT ({BROKEN})),
    px AS (SELECT vec_id, label, w, h, i, i % w AS x, i // w AS y, {', '.join(f"l[{a.replace(' div ', ' // ')} + 1] AS {c}" for a, c in zip(_AT, "bgr"))} FROM v, (SELECT unnest(range({PIXELS})) AS i)),
    gr AS (SELECT *, ((114 * b + 587 * g + 299 * r + 500) // 1000)::DOUBLE AS gray FROM px),
    im AS (SELECT vec_id, any_value(w) AS w, any_value(h) AS h, list(gray ORDER BY i) AS p FROM gr GROUP BY vec_id)
"""
_NAME = "'tile/' || vec_id || '.png'"


def _mirror(t: str, n: str) -> str:
    return f"(({n} - 1) - abs(({n} - 1) - abs({t})))"


def _clamp(t: str, n: str) -> str:
    return f"greatest(0, least({n} - 1, {t}))"


_LAP = " + ".join(f"p[{_mirror(y, 'h')} * w + {_mirror(x, 'w')} + 1]" for y, x in (("y - 1", "x"), ("y + 1", "x"), ("y", "x - 1"), ("y", "x + 1")))
_NINE = ", ".join(f"p[{_clamp(f'y + {a}', 'h')} * w + {_clamp(f'x + {b}', 'w')} + 1]" for a in (-1, 0, 1) for b in (-1, 0, 1))
_STENCILS = f"""
    st AS (SELECT vec_id, var_pop(lap) AS blur, stddev_pop(dev) AS noise,
            CASE WHEN any_value(h) < 16 OR any_value(w) < 16 THEN 0.0 ELSE avg(step) FILTER (WHERE x % 8 = 0 AND x < w - 1) - avg(step) FILTER (WHERE NOT (x % 8 = 0 AND x < w - 1)) END AS compression
        FROM (SELECT vec_id, w, h, x, {_LAP} - 4 * p[y * w + x + 1] AS lap, p[y * w + x + 1] - list_sort([{_NINE}])[5] AS dev, CASE WHEN x > 0 THEN abs(p[y * w + x + 1] - p[y * w + x]) END AS step
            FROM (SELECT *, i % w AS x, i // w AS y FROM im, (SELECT unnest(range({PIXELS})) AS i)))
        GROUP BY vec_id)
"""


def pictures(spark: SparkSession, d: str) -> DataFrame:
    """``vec_id, label, path, image``: a colour picture of each vector, some of them broken."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.transform(F.col("embedding").cast("array<double>"), lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e + 1) * 127.5))).cast("int")).alias("l"))
    byte = "lpad(hex(l[{}]), 2, '0')"
    text = f"array_join(transform(sequence(0, {PIXELS - 1}), i -> concat({', '.join(byte.format(a) for a in _AT)})), '')"
    broken = F.expr(BROKEN)
    width = F.expr(_WIDTH)
    image = F.struct(
        F.concat(F.lit("tile/"), F.col("vec_id").cast("string"), F.lit(".png")).alias("origin"), F.when(broken, -1).otherwise((PIXELS / width).cast("int")).alias("height"), F.when(broken, -1).otherwise(width).alias("width"),
        F.when(broken, -1).otherwise(3).alias("nChannels"), F.when(broken, -1).otherwise(16).alias("mode"), F.when(broken, F.lit(b"")).otherwise(F.unhex(F.expr(text))).alias("data"),
    )
    return rows.select("vec_id", "label", image.alias("image")).select("vec_id", "label", F.col("image.origin").alias("path"), "image")


def _round(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    # means of whole numbers can end in a 5: a little more decides them alike in both engines
    return df.withColumns({c: F.round(F.col(c) + 1e-9, places) for c in cols})


@query(f"""
    WITH {_PX}, {_STENCILS},
    c AS (SELECT vec_id, any_value(w) AS w, any_value(h) AS h, avg(gray) AS brightness, stddev_pop(gray) AS contrast,
        avg(CASE WHEN greatest(b, g, r) = 0 THEN 0 ELSE (510 * (greatest(b, g, r) - least(b, g, r)) + greatest(b, g, r)) // (2 * greatest(b, g, r)) END) AS saturation FROM gr GROUP BY vec_id)
    SELECT {_NAME} AS path, c.vec_id IS NULL AS is_corrupt, (w * h)::BIGINT AS resolution, w::INT AS width, h::INT AS height, round(brightness + 1e-9, 6) AS brightness, round(contrast + 1e-9, 6) AS contrast,
        round(blur + 1e-9, 6) AS blur, round(noise + 1e-9, 6) AS noise, round(compression + 1e-9, 6) AS compression, round(saturation + 1e-9, 6) AS saturation
    FROM embeddings e LEFT JOIN c USING (vec_id) LEFT JOIN st USING (vec_id)
""")
def image_properties(spark: SparkSession, d: str) -> DataFrame:
    """The seven quality properties of every picture."""
    return _round(R.quality_properties(pictures(spark, d)), "brightness", "contrast", "blur", "noise", "compression", "saturation")


_META = f"""
    m AS (SELECT vec_id, any_value(w) AS w, any_value(h) AS h, (avg(b) + avg(g) + avg(r)) / 3 AS mean_brightness, (stddev_pop(b) + stddev_pop(g) + stddev_pop(r)) / 3 AS std_brightness FROM px GROUP BY vec_id)
"""


@query(f"""
    WITH {_PX}, {_META}
    SELECT {_NAME} AS path, w::INT AS width, h::INT AS height, round(w / h + 1e-9, 6) AS aspect_ratio, round(mean_brightness + 1e-9, 6) AS mean_brightness, round(std_brightness + 1e-9, 6) AS std_brightness,
        CASE WHEN w IS NOT NULL THEN 3 END AS num_channels, CASE WHEN w IS NOT NULL THEN 'RGB' END AS mode, w IS NULL AS is_corrupt, CASE WHEN w IS NULL THEN 'cannot be decoded' END AS error
    FROM embeddings LEFT JOIN m USING (vec_id)
""")
def image_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _round(R.image_metadata(pictures(spark, d)).drop("color_histogram"), "aspect_ratio", "mean_brightness", "std_brightness")


@query(f"""
    WITH {_PX}, a AS (SELECT vec_id, unnest([r, 256 + g, 512 + b]) AS bin FROM px)
    SELECT {_NAME} AS path, bin::INT AS bin, round(count(*) / ({3 * PIXELS} + 1e-9) + 1e-9, 9) AS share FROM a GROUP BY vec_id, bin
""")
def image_color_histogram(spark: SparkSession, d: str) -> DataFrame:
    """The filled bins of the colour histograms."""
    rows = R.image_metadata(pictures(spark, d), histogram=True).where("color_histogram is not null")
    return _round(rows.select("path", F.posexplode("color_histogram").alias("bin", "share")).where("share > 0"), "share", places=9)


@query(f"""
    WITH {_PX}, {_META}
    SELECT {_NAME} AS path, CASE WHEN vec_id % 4 = 0 THEN 1 ELSE w END::INT AS width, CASE WHEN vec_id % 4 = 0 THEN 2 ELSE h END::INT AS height, CASE WHEN vec_id % 4 = 0 THEN false ELSE w IS NULL END AS is_corrupt
    FROM embeddings LEFT JOIN m USING (vec_id)
""")
def filled_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Records that have metadata keep it, the others get that of their picture."""
    fields = [f.split() for f in R.METADATA_SCHEMA.split(", ")][1:]
    known = {"width": F.lit(1), "height": F.lit(2), "is_corrupt": F.lit(False)}
    given = F.struct(*[known.get(n, F.lit(None)).cast(t.replace("long", "bigint")).alias(n) for n, t in fields])
    images = pictures(spark, d)
    out = R.fill_metadata(images.select("path", F.when(F.col("vec_id") % 4 == 0, given).alias("metadata")), images)
    return out.select("path", "metadata.width", "metadata.height", "metadata.is_corrupt")


@query(f"""
    WITH {_PX}, c AS (SELECT vec_id, any_value(w) AS w, any_value(h) AS h, stddev_pop((114 * b + 587 * g + 299 * r) / 255000.0) AS c FROM px GROUP BY vec_id)
    SELECT {_NAME} AS path, vec_id || '.png' AS filename, coalesce(w, 0)::INT AS width, coalesce(h, 0)::INT AS height, coalesce(round(w / h, 2), 0) AS aspect_ratio, coalesce(round(c, 3), 0) AS contrast,
        coalesce(w < 64 OR h < 64 OR w / h > 3 OR w / h < 0.33 OR c < 0.05, true) AS low_quality_flag
    FROM embeddings LEFT JOIN c USING (vec_id)
""")
def image_heuristics(spark: SparkSession, d: str) -> DataFrame:
    return R.quality_heuristics(pictures(spark, d))


_SHARP = f"WITH {_PX}, {_STENCILS} SELECT {_NAME} AS path, round(blur + 1e-9, 6) AS variance, CASE WHEN blur < {ROUGH} THEN 'blurry' ELSE 'good' END AS quality_label FROM st"


@query(_SHARP)
def image_sharpness(spark: SparkSession, d: str) -> DataFrame:
    return _round(R.sharpness(pictures(spark, d), ROUGH), "variance")


@query(f'SELECT quality_label, count(*) AS "count" FROM ({_SHARP}) GROUP BY quality_label')
def sharpness_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.sharpness(pictures(spark, d), ROUGH).groupBy("quality_label").agg(F.count("*").alias("count"))


@query(f"""
    WITH {_PX}, c AS (SELECT vec_id, c, x // 16 AS bin, count(*) / {PIXELS}.0 AS v FROM (SELECT vec_id, unnest([0, 1, 2]) AS c, unnest([b, g, r]) AS x FROM px) GROUP BY ALL)
    SELECT {_NAME} AS path, (c * 16 + bin)::INT AS dim, round(v, 6) AS value FROM c
""")
def image_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The colour part of the built-in embedder's vectors, as far as it is not 0."""
    rows = R.embed_images(pictures(spark, d)).select("path", F.posexplode("embedding").alias("dim", "value"))
    return rows.where("dim < 48 and value > 0").select("path", "dim", F.round(F.col("value").cast("double"), 6).alias("value"))


class MeanColor:
    """An embedder as a user would write it: mean blue, green and red."""

    def embed(self, images: list[np.ndarray]) -> np.ndarray:
        return np.array([x.reshape(-1, 3).mean(0) for x in images])


@query(f"""
    WITH {_PX}, c AS (SELECT vec_id, [avg(b), avg(g), avg(r)] AS m FROM px GROUP BY vec_id)
    SELECT {_NAME} AS path, i::INT AS dim, round((m[i + 1] / sqrt(list_inner_product(m, m))), 4) AS value FROM c, (SELECT unnest(range(3)) AS i)
""")
def own_embedder(spark: SparkSession, d: str) -> DataFrame:
    """A registered embedder of one's own, its vectors normalised."""
    R.register_embedder("mean_color", MeanColor)
    rows = R.embed_images(pictures(spark, d), "mean_color", normalize=True).select("path", F.posexplode("embedding").alias("dim", "value"))
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 4))


_MEANS = f"""
    {_PX}, c AS (SELECT vec_id, any_value(label) AS label, [avg(b)::FLOAT, avg(g)::FLOAT, avg(r)::FLOAT]::DOUBLE[] AS m FROM px GROUP BY vec_id),
    n AS (SELECT a.vec_id AS src, k.label AS l, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.m, k.m), 9) DESC, k.vec_id) AS r
        FROM (SELECT * FROM c WHERE vec_id % 5 <> 0) a, (SELECT * FROM c WHERE vec_id % 5 = 0) k),
    t AS (SELECT src, l, count(*) AS c FROM n WHERE r <= 5 GROUP BY src, l), w AS (SELECT src, arg_min(l, (-c, l)) AS pred, max(c) / sum(c) AS conf FROM t GROUP BY src)
"""


@query(f"""
    WITH {_MEANS} SELECT vec_id, {_NAME} AS path, label::VARCHAR AS resolved_label, round(1e-9, 6) AS confidence FROM c WHERE vec_id % 5 = 0
    UNION ALL SELECT src, 'tile/' || src || '.png', CASE WHEN conf >= 0.4 THEN pred::VARCHAR ELSE 'unknown' END, round(conf + 1e-9, 6) FROM w
""")
def labelled_images(spark: SparkSession, d: str) -> DataFrame:
    """From pictures and a few labels to labels of all, in one call."""
    images = pictures(spark, d)
    samples = images.select("vec_id", "path", F.when(F.col("vec_id") % 5 == 0, F.col("label")).alias("label"))
    out = label_images(images.select("path", "image"), samples, MeanColor, threshold=0.4)
    return _round(out.select("vec_id", "path", "resolved_label", "confidence"), "confidence")
