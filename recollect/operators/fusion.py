"""Fusion of ranked lists. Lists have (query_id, id, rank from 0[, score])."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators.search import top_k

RRF = 60
VECTOR_WEIGHT, KEYWORD_WEIGHT, ENTITY_WEIGHT = 0.7, 0.3, 0.5


def rrf_weighted(vector: DataFrame, keyword: DataFrame, entity: DataFrame | None = None, k: int = 7) -> DataFrame:
    """Reciprocal ranks of both lists plus the entity boost; only ids of the vector list, only sums above 0."""
    v = vector.select("query_id", "id", F.col("rank").alias("vr"), F.col("score").alias("vector_score"))
    kw = keyword.select("query_id", "id", F.col("rank").alias("kr"), F.col("score").alias("bm25_score"))
    out = v.join(kw, ["query_id", "id"], "left")
    if entity is None:
        out = out.withColumn("entity_boost", F.lit(0.0))
    else:
        out = out.join(entity.select("query_id", "id", F.col("boost").alias("entity_boost")), ["query_id", "id"], "left")
    base = VECTOR_WEIGHT / (RRF + F.col("vr") + 1)
    extra = F.when(F.coalesce("bm25_score", F.lit(0.0)) > 0, KEYWORD_WEIGHT / (RRF + F.col("kr") + 1)).otherwise(0.0)
    boost = F.coalesce("entity_boost", F.lit(0.0))
    out = out.select("query_id", "id", F.round(base + extra + boost, 9).alias("score"), "vector_score", F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), boost.alias("entity_boost"))
    return top_k(out.filter("score > 0"), k, ["query_id"])


def rrf_alpha(vector: DataFrame, keyword: DataFrame, alpha: float = 0.5, k: int = 5) -> DataFrame:
    """Both lists, weighted ``alpha`` and 1 - ``alpha``; ids of either side count. At 1 or 0 one side stands alone."""
    v = vector.select("query_id", "id", (alpha / (RRF + F.col("rank") + 1)).alias("a"))
    w = keyword.select("query_id", "id", ((1 - alpha) / (RRF + F.col("rank") + 1)).alias("b"))
    how = "left" if alpha >= 1 else "right" if alpha <= 0 else "full"
    out = v.join(w, ["query_id", "id"], how).select("query_id", "id", F.round(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), 9).alias("score"))
    return top_k(out, k, ["query_id"])


def rrf_graph(graph: DataFrame, vector: DataFrame, k: int = 10) -> DataFrame:
    """Graph and vector lists with equal weight, the first rank counting 1/60."""
    g = graph.select("query_id", "id", (1.0 / (RRF + F.col("rank"))).alias("a"))
    v = vector.select("query_id", "id", (1.0 / (RRF + F.col("rank"))).alias("b"))
    out = g.join(v, ["query_id", "id"], "full").select("query_id", "id", F.round(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), 9).alias("score"))
    return top_k(out, k, ["query_id"])


def additive(semantic: DataFrame, keyword: DataFrame, boosts: DataFrame, threshold: float = 0.1, k: int = 10) -> DataFrame:
    """Sum of the signals over the most they could reach, at most 1.

    A signal counts towards the most if it has any row at all for the query.
    """
    kw = keyword.select("query_id", "id", F.col("score").alias("bm25_score"))
    eb = boosts.select("query_id", "id", F.col("boost").alias("entity_boost"))
    has = lambda d, name: d.select("query_id").distinct().withColumn(name, F.lit(True))
    s = semantic.filter("id is not null").select("query_id", "id", F.coalesce("score", F.lit(0.0)).alias("semantic_score")).filter(F.col("semantic_score") >= threshold)
    out = s.join(kw, ["query_id", "id"], "left").join(eb, ["query_id", "id"], "left").join(has(kw, "has_k"), "query_id", "left").join(has(eb, "has_e"), "query_id", "left")
    most = 1.0 + F.when(F.col("has_k"), 1.0).otherwise(0.0) + F.when(F.col("has_e"), ENTITY_WEIGHT).otherwise(0.0)
    b, e = F.coalesce("bm25_score", F.lit(0.0)), F.coalesce("entity_boost", F.lit(0.0))
    raw = F.col("semantic_score") + b + e
    out = out.select("query_id", "id", F.round(F.least(raw / most, F.lit(1.0)), 9).alias("score"), "semantic_score", b.alias("bm25_score"), e.alias("entity_boost"), most.alias("max_possible"))
    return top_k(out, k, ["query_id"])


def entity_boost(matches: DataFrame) -> DataFrame:
    """(query_id, id, boost) of entity matches (query_id, linked_memory_ids): 0.5 / 61 for each match that links the id."""
    linked = matches.select("query_id", F.explode("linked_memory_ids").alias("id"))
    return linked.groupBy("query_id", "id").agg((F.count("*") * (ENTITY_WEIGHT / (RRF + 1))).alias("boost"))


def max_by_source(lists: DataFrame, k: int) -> DataFrame:
    """Union of lists (query_id, id, score, ...) with the best score of each id."""
    best = lists.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return top_k(best, k, ["query_id"])
