"""Connected components by alternating stars (large-star, small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import checkpointed


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component.

    ``edges`` has columns src, dst of one ordered type. Each round links every
    node's larger neighbours, then its smaller ones, to the smallest id it
    sees; rounds grow with the logarithm of the longest chain. A round's edges
    are checkpointed in the shared folder, so that a lost executor costs one
    round at most.
    """
    now = checkpointed(edges.filter("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    before = None
    for _ in range(max_rounds):
        both = now.select("src", "dst").unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.join(low, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        joined = large.join(low, "src")
        small = joined.select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(joined.select("src", F.col("low").alias("dst"))).filter("src != dst").distinct()
        now = checkpointed(small)
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.lit(0))).first()
        if before == tuple(state):
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("root"))
