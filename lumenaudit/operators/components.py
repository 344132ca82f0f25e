"""Connected components of an edge list, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.functions.runtime import cut, drop_cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``node, root``: every node of an edge with the smallest node of its component.

    Alternates large-star and small-star steps (each an aggregate and a join on the
    node), so the number of rounds grows with the logarithm of the longest chain. A node
    of very many edges is reduced by a partial ``min`` before the shuffle and joined back,
    never gathered in a list. Each round is written to the shared folder, so lineage stays
    short and lost executors cost one round. Only two numbers reach the driver per round.

    Null ends and self-loops give no edge; repeated edges count once; an empty edge list
    gives an empty result. Nodes without an edge are not listed.
    """
    kind = edges.schema[src].dataType
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.col(src).isNotNull().alias("a"), F.col(dst).isNotNull().alias("b"))
    e = cut(e.where("a and b and u <> v").select("u", "v").distinct(), "edges")
    mark = _mark(e)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: the larger neighbours of u point to the smallest of u's neighbourhood
        large = e.select(F.col("v").alias("k"), F.col("u").alias("w")).join(least.withColumnRenamed("u", "k"), "k").where("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours point to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        nxt = cut(small, "edges")
        was, mark = mark, _mark(nxt)
        drop_cut(e)
        e = nxt
        if was == mark:
            break
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    nodes = e.select(F.col("u").cast(kind).alias("node"), F.col("v").cast(kind).alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
