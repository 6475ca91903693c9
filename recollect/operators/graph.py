"""Graph operators over edge tables (source_id, target_id, relation): traversal, components, communities, causal paths.

Loops run on the driver, one join a hop; their state is checkpointed in the
shared folder every few hops, so plans stay short and lost executors cost little.
"""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.plans.session import checkpointed

Direction = Literal["out", "in", "both"]


def dedup_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["source_id", "target_id", "relation"])


def neighbors(edges: DataFrame, ids: DataFrame, relation: str | None = None) -> DataFrame:
    out = edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return out.filter(F.col("relation") == relation) if relation else out


def both_directions(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, other, relation, direction) of the edges at each id."""
    seeds = ids.select("id").distinct()
    out = edges.join(seeds, F.col("source_id") == F.col("id")).select("id", F.col("target_id").alias("other"), "relation", F.lit("outgoing").alias("direction"))
    back = edges.join(seeds, F.col("target_id") == F.col("id")).select("id", F.col("source_id").alias("other"), "relation", F.lit("incoming").alias("direction"))
    return out.unionByName(back)


def delete_node(edges: DataFrame, nodes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) without the ids; edges go only with a node that was there."""
    gone = nodes.join(ids, "id", "left_semi").select("id")
    left = edges.join(gone, F.col("source_id") == F.col("id"), "left_anti").join(gone, F.col("target_id") == F.col("id"), "left_anti")
    return left, nodes.join(gone, "id", "left_anti")


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int = 2, direction: Direction = "out", relation: str | None = None) -> DataFrame:
    """(seed, id, depth): least depth of every node within ``max_depth`` hops of each seed, the seed itself left out.

    ``both`` is the union of the two closures (a path never turns), with the lesser depth.
    """
    if direction == "both":
        two = bfs(edges, seeds, max_depth, "out", relation).unionByName(bfs(edges, seeds, max_depth, "in", relation))
        return two.groupBy("seed", "id").agg(F.min("depth").alias("depth"))
    e = edges.filter(F.col("relation") == relation) if relation else edges
    a, b = ("source_id", "target_id") if direction == "out" else ("target_id", "source_id")
    e = e.select(F.col(a).alias("__from"), F.col(b).alias("__to")).distinct()
    front = seeds.select(F.col("seed"), F.col("seed").alias("id"), F.lit(0).cast("long").alias("depth")).distinct()
    seen = front
    for hop in range(1, max_depth + 1):
        step = front.join(e, front["id"] == e["__from"]).select("seed", F.col("__to").alias("id")).distinct()
        front = step.join(seen, ["seed", "id"], "left_anti").withColumn("depth", F.lit(hop).cast("long"))
        seen = seen.unionByName(front)
        if hop % 2 == 0 and hop < max_depth:
            seen = checkpointed(seen)
            front = seen.filter(F.col("depth") == hop)
            if front.isEmpty():
                break
    return seen.filter("depth > 0")


def graph_scores(reached: DataFrame) -> DataFrame:
    return reached.withColumn("score", F.pow(F.lit(0.5), F.col("depth")))


def stats(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes, edges and density to four places: edges / (n (n - 1)), or / 1 for a graph of one node at most.

    ``nodes`` (id) is the node table; without it the ends of the edges are the nodes.
    """
    ids = nodes.select("id") if nodes is not None else edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    n = F.col("nodes")
    return edges.agg(F.count("*").alias("edges")).crossJoin(F.broadcast(ids.agg(F.count_distinct("id").alias("nodes")))).select("nodes", "edges", F.round(F.col("edges") / F.greatest(n * (n - 1), F.lit(1)), 4).alias("density"))


def delete_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges (id, ...) without those of the given ids."""
    return edges.join(ids.select("id"), "id", "left_anti")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, cluster): the smallest id of each node's connected component, by label spreading with pointer jumping."""
    both = checkpointed(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).unionByName(edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))).distinct())
    label = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).withColumnRenamed("a", "id"))
    for _ in range(max_rounds):
        seen = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("l").alias("m"))
        step = label.join(seen, label["id"] == seen["a"]).select("id", F.least("l", "m").alias("l"), F.col("l").alias("old"))
        up = step.select(F.col("id").alias("__p"), F.col("l").alias("__l"))
        jumped = checkpointed(step.join(up, step["l"] == up["__p"]).select("id", F.least("l", "__l").alias("l"), "old"))
        changed = not jumped.filter("l <> old").isEmpty()
        label = jumped.select("id", "l")
        if not changed:
            return label.select("id", F.col("l").alias("cluster"))
    raise RuntimeError("components did not settle")


def clusters(edges: DataFrame) -> DataFrame:
    """Components of more than one node: (cluster, size, members)."""
    return components(edges).groupBy("cluster").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("id")).alias("members")).filter("size > 1")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, label): label propagation; each node takes the most frequent label among its neighbours and itself, of ties the smallest.

    All nodes move at once, so a node's own label counts: else the two ends of an
    edge would swap labels for ever.
    """
    both = checkpointed(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).unionByName(edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))).filter("a <> b").distinct())
    label = both.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct()
    for _ in range(rounds):
        heard = both.join(label, both["b"] == label["id"]).select("a", "label").unionByName(label.select(F.col("id").alias("a"), "label"))
        votes = heard.groupBy("a", "label").agg(F.count("*").alias("n"))
        # the most votes, then the smallest label: one aggregate a node, no sort
        new = checkpointed(votes.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("v")).select(F.col("a").alias("id"), "v.label"))
        same = new.join(label, ["id", "label"], "left_anti").isEmpty()
        label = new
        if same:
            break
    return label


def causal_paths(edges: DataFrame, seeds: DataFrame, direction: str = "effects", max_depth: int = 5) -> DataFrame:
    """(seed, path, relations, confidence): simple paths of 1 to ``max_depth`` edges that end where no edge goes on or at the depth; confidence is the product.

    Edges are (cause, effect, relation, confidence).
    """
    a, b = ("cause", "effect") if direction == "effects" else ("effect", "cause")
    e = edges.select(F.col(a).alias("__a"), F.col(b).alias("__b"), F.col("relation").alias("__r"), F.col("confidence").alias("__c"))
    front = seeds.select("seed", F.array("seed").alias("path"), F.array().cast("array<string>").alias("relations"), F.lit(1.0).alias("confidence"))
    out = None
    for depth in range(1, max_depth + 1):
        step = front.join(e, F.element_at("path", -1) == F.col("__a"), "left").withColumn("__ok", F.coalesce(F.col("__b").isNotNull() & ~F.array_contains("path", F.col("__b")), F.lit(False)))
        longer = step.filter("__ok").select("seed", F.concat("path", F.array("__b")).alias("path"), F.concat("relations", F.array("__r")).alias("relations"), (F.col("confidence") * F.col("__c")).alias("confidence"))
        if depth > 1:
            # a path ends if none of its edges leads to a new event
            ends = step.groupBy("seed", "path", "relations", "confidence").agg(F.max("__ok").alias("__on")).filter("not __on").drop("__on")
            out = ends if out is None else out.unionByName(ends)
        front = longer
    out = front if out is None else out.unionByName(front)
    return out.distinct().withColumn("confidence", F.round("confidence", 9))


def path_confidence(path: Column) -> Column:
    """Product of the edges' confidence; 0 for no edge."""
    return F.when(F.size(path) == 0, 0.0).otherwise(F.aggregate(path, F.lit(1.0), lambda s, e: s * e["confidence"]))


def counterfactual(edges: DataFrame, pairs: DataFrame, depth: int = 3) -> DataFrame:
    """(cause, effect, would_happen, confidence): would the effect happen without the cause?

    Without a direct edge: yes, 0.9. With other causes that lead to it: yes, 0.7 of
    the best. If the edge prevents or inhibits: yes, with its confidence. Else no.
    """
    direct = edges.groupBy("cause", "effect").agg(F.max_by(F.struct("relation", "confidence"), F.struct("confidence", "relation")).alias("d"))
    others = edges.select(F.col("cause").alias("__c"), F.col("effect").alias("effect"), F.col("confidence").alias("__k"))
    best = pairs.join(others, "effect").filter(F.col("__c") != F.col("cause")).groupBy("cause", "effect").agg(F.max("__k").alias("alt"))
    out = pairs.join(direct, ["cause", "effect"], "left").join(best, ["cause", "effect"], "left")
    negative = F.col("d.relation").isin("prevents", "inhibits")
    would = F.col("d").isNull() | F.col("alt").isNotNull() | negative
    conf = F.when(F.col("d").isNull(), 0.9).when(F.col("alt").isNotNull(), F.col("alt") * 0.7).otherwise(F.col("d.confidence"))
    return out.select("cause", "effect", F.coalesce(would, F.lit(False)).alias("would_happen"), F.round(conf, 9).alias("confidence"))
