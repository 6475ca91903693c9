"""Upkeep of memories: links between similar ones, compression, reflection, capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import content_hash, has_sensitive, redact, trim_spaces
from recollect.operators.nearest import best_in_tiles


def zettel_links(entries: DataFrame, existing: DataFrame | None = None, threshold: float = 0.3, most: int = 5) -> DataFrame:
    """(source_id, target_id, score): each entry (id, vector, user_id) to its best ``most`` others of the same user, in both directions.

    Twice as many are fetched; links that exist already are taken out of them
    before the best are kept. All pairs of a user are scored, in tiles.
    """
    q = entries.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"), "user_id")
    scored = best_in_tiles(q, entries, 2 * most - 1, threshold, "user_id").select(F.col("query_id").alias("source_id"), F.col("id").alias("target_id"), "score")
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "target_id"))
    # of twice as many hits one is the entry itself
    near = scored.withColumn("__r", rank).filter(F.col("__r") <= 2 * most - 1).drop("__r")
    if existing is not None:
        near = near.join(existing.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")
    best = near.withColumn("__r", rank).filter(F.col("__r") <= most).drop("__r")
    back = best.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "score")
    return best.unionByName(back).groupBy("source_id", "target_id").agg(F.max("score").alias("score"))


def related(links: DataFrame, rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, related_id, score, content) of the rows that ids are linked to."""
    out = links.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return out.join(rows.select(F.col("id").alias("target_id"), "content"), "target_id").select(F.col("source_id").alias("id"), F.col("target_id").alias("related_id"), "score", "content")


def compress(messages: DataFrame, mode: str = "static", buffer: int = 20, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """(conv, n, evicted, kept, summary): lists longer than ``buffer`` give up their oldest messages for a summary.

    *static* keeps the last ``buffer``; *partial* evicts three tenths, one at least.
    The summary is the evicted text's first 500 characters under a head line.
    """
    if mode not in ("static", "partial"):
        raise ValueError(f"unknown mode: {mode}")
    n = F.count("*").over(Window.partitionBy(by))
    nr = F.row_number().over(Window.partitionBy(by).orderBy(order))
    out = F.col("n") - buffer if mode == "static" else F.greatest(F.lit(1), F.floor(F.col("n") * 0.3))
    rows = messages.select(by, order, "role", "text", n.alias("n"), nr.alias("nr")).withColumn("out", F.when(F.col("n") > buffer, out).otherwise(0).cast("long"))
    gone = F.transform(F.array_sort(F.collect_list(F.when(F.col("nr") <= F.col("out"), F.struct(order, F.concat("role", F.lit(": "), "text").alias("line"))))), lambda x: x["line"])
    agg = rows.groupBy(by).agg(F.max("n").alias("n"), F.max("out").alias("evicted"), F.array_join(gone, "\n").alias("__t"))
    cut = F.concat(F.substring("__t", 1, 500), F.when(F.length("__t") > 500, "...").otherwise(""))
    text = F.when(F.col("evicted") > 0, F.concat(F.lit("[Summary] "), F.col("evicted").cast("string"), F.lit(" messages compressed:\n"), cut))
    return agg.select(by, "n", "evicted", (F.col("n") - F.col("evicted")).alias("kept"), text.alias("summary"))


def lessons(episodes: DataFrame) -> DataFrame:
    """(source_id, statement): lines of five characters and more of a reasoning episode's thoughts and action."""
    lines = F.flatten(F.array(*[F.split(F.trim(F.coalesce(c, F.lit(""))), "\n") for c in ("thoughts", "action")]))
    return episodes.select(F.col("id").alias("source_id"), F.posexplode(lines).alias("pos", "line")).select("source_id", "pos", F.trim("line").alias("statement")).filter(F.length("statement") >= 5)


def alike(a: Column, b: Column) -> Column:
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (a == b) | ((F.length(a) > 10) & b.contains(a)) | ((F.length(b) > 10) & a.contains(b))


def accept_lessons(proposals: DataFrame, rules: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Lessons that no rule says already; of alike proposals the first (by source_id, pos) stays.

    A proposal is dropped only for one that itself was accepted, as if they came one
    by one. Proposals are few (lines of a user's latest episodes): they are folded
    in an array for each value of ``by``, which rules then carry, too.
    """
    known = rules.select("rule", *[F.col(c).alias(f"__{c}") for c in by])
    same = alike(F.col("statement"), F.col("rule"))
    for c in by:
        same = same & (F.col(c) == F.col(f"__{c}"))
    fresh = proposals.join(known, same, "left_anti")
    items = F.array_sort(F.collect_list(F.struct("source_id", "pos", "statement")))
    kind = f"array<struct<source_id:{dict(proposals.dtypes)['source_id']},pos:int,statement:string>>"
    kept = F.aggregate(items, F.array().cast(kind), lambda s, x: F.when(F.exists(s, lambda y: alike(x["statement"], y["statement"])), s).otherwise(F.array_append(s, x)))
    return fresh.groupBy(*by).agg(kept.alias("kept")).select(*by, F.explode("kept").alias("x")).select(*by, "x.source_id", "x.pos", "x.statement")


def capture(rows: DataFrame, by: str = "user_id", order: str = "seq", text: str = "text", blank: bool = False) -> DataFrame:
    """Texts as they would be stored: trimmed, the first of equal ones, secrets hidden; empty and null ones only if ``blank``."""
    clean = rows.withColumn("__t", trim_spaces(F.col(text)))
    clean = (clean if blank else clean.filter("__t <> ''")).withColumn("text_hash", content_hash(F.col("__t")))
    first = F.row_number().over(Window.partitionBy(by, "text_hash").orderBy(F.asc_nulls_last(order)))
    kept = clean.withColumn("__r", first).filter("__r = 1")
    return kept.select(by, order, redact(F.col("__t")).alias("content"), "text_hash", has_sensitive(F.col("__t")).alias("redacted"))


def cluster_edges(links: DataFrame) -> DataFrame:
    return links.select("source_id", "target_id", F.lit("related_to").alias("relation"))
