"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, settled

MAX_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each node of a link, the least node it is connected with.

    Rounds of large stars and small stars: each node's neighbours are hung on the least of them, until every node
    hangs on its root. Minima are partial before the shuffle, rounds grow with the logarithm of the longest chain, and each
    round's edges are written to the shared folder, and what a round left on the driver (plans, broadcast tables of small rounds) is let go
    before the next. Nothing but two numbers a round reaches the driver. No links give no rows;
    repeated links and links of a node with itself change nothing.
    """
    x, y = F.col(a), F.col(b)
    edges = settled(links.select(F.greatest(x, y).alias("v"), F.least(x, y).alias("m")).filter("v <> m").distinct(), "links")
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        if state[0] == 0:
            break
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(edges.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.filter("w > u").join(least, "u").select(F.col("w").alias("v"), "m").distinct()
        least = large.groupBy("v").agg(F.min("m").alias("least"))
        small = large.join(least, "v")
        small = small.select(F.col("m").alias("v"), F.col("least").alias("m")).unionByName(small.select("v", F.col("least").alias("m")))
        edges = settled(small.filter("v <> m").distinct(), "links")
        before, state = state, _state(edges)
        release(edges.sparkSession)
        if state == before:
            return edges.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(
                edges.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct()
            )
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("v").alias("node"), F.col("m").alias("root"))


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
    return r[0], int(r[1] or 0)
