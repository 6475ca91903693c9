"""Facts, rules, profiles and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KINDS = {
    "attributes": tuple("phone email birthday location occupation age name".split()),
    "preferences": tuple("favorite hates prefers dislikes likes".split()),
    "plans": tuple("goal will intends planning".split()),
    "relationships": tuple("family friend related_to knows has".split()),
}


def conflicts(facts: DataFrame) -> DataFrame:
    """(subject, predicate) pairs with several objects."""
    return facts.groupBy("subject", "predicate").agg(F.count_distinct("object").alias("n_objects"), F.count("*").alias("n_facts")).filter("n_objects > 1")


def resolve_conflicts(facts: DataFrame) -> DataFrame:
    """All facts with ``is_deleted``: of conflicting ones the newest stays (then the one with the larger id)."""
    key = Window.partitionBy("subject", "predicate")
    several = F.min("object").over(key) != F.max("object").over(key)
    newest = F.row_number().over(key.orderBy(F.desc("created_at"), F.desc("id"))) == 1
    return facts.withColumn("is_deleted", F.when(several & ~newest, 1).otherwise(0))


def predicate_kind(predicate: Column) -> Column:
    out = F.lit("raw")
    for kind, names in reversed(_KINDS.items()):
        out = F.when(F.lower(predicate).isin(*names), kind).otherwise(out)
    return out


def profile(facts: DataFrame, user: str = "subject") -> DataFrame:
    """Per user and predicate: its kind, the newest live value, and how many values are active, deleted and there at all."""
    live = F.col("is_deleted") == 0
    newest = F.max_by("object", F.when(live, F.struct("created_at", "id")))
    return facts.groupBy(user, predicate_kind(F.col("predicate")).alias("kind"), "predicate").agg(
        F.when(F.max(F.when(live, 1)).isNotNull(), newest).alias("current"), F.sum(F.when(live, 1).otherwise(0)).alias("active"), F.sum(F.when(live, 0).otherwise(1)).alias("deleted"), F.count("*").alias("total")
    )


def rule_state(outcomes: DataFrame) -> DataFrame:
    """Per rule: counts, confidence, and whether it was ever deprecated (more harm than help, three times at least; it stays so)."""
    w = Window.partitionBy("rule_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h, m = F.sum(F.col("helpful").cast("int")).over(w), F.sum((~F.col("helpful")).cast("int")).over(w)
    seen = outcomes.withColumns({"h": h, "m": m}).withColumn("bad", (F.col("m") > F.col("h")) & (F.col("m") >= 3))
    out = seen.groupBy("rule_id").agg(F.max("h").alias("helpful_count"), F.max("m").alias("harmful_count"), F.max("bad").alias("deprecated"))
    n = F.col("helpful_count") + F.col("harmful_count")
    return out.withColumn("confidence", F.round(F.when(n > 0, F.col("helpful_count") / n).otherwise(0.5), 9))


def injectable(rules: DataFrame, least: float) -> DataFrame:
    return rules.filter(~F.col("deprecated") & (F.col("confidence") >= least))


def rules_prompt(rules: DataFrame) -> DataFrame:
    """One text of all active rules, in order of id; null without any.

    The confidence is rounded from its binary value, as C and Python do it; format_string
    would round the decimal digits that are shown (0.305 to 0.31).
    """
    line = F.concat(F.lit("- "), F.col("rule"), F.lit(" (confidence="), F.call_function("format_number", F.col("confidence"), F.lit("0.00")), F.lit(")"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rule_id", line.alias("line")))), lambda x: x["line"])
    prompt = F.concat(F.lit("<procedural_rules>\n"), F.array_join(lines, "\n"), F.lit("\n</procedural_rules>"))
    return rules.filter(~F.col("deprecated")).agg(F.when(F.count("*") > 0, prompt).alias("prompt"))


def namespace_stats(rows: DataFrame, namespace: str, confidence: Column, topic: Column, order: str, floor: float = 0.0) -> DataFrame:
    """(namespace, n, confidence, score, topics): the score is full at ten rows, times the confidence."""
    n, c = F.count("*"), F.round(F.coalesce(F.avg(confidence), F.lit(0.0)), 9)
    out = rows.agg(n.alias("n"), c.alias("confidence"))
    score = F.round(F.least(F.lit(1.0), F.col("n") / 10.0) * F.greatest(F.lit(floor), F.col("confidence")), 9)
    top = rows.orderBy(order).limit(5).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.substring(topic, 1, 30).alias("t")))), lambda x: x["t"]).alias("topics"))
    return out.crossJoin(F.broadcast(top)).select(F.lit(namespace).alias("namespace"), "n", "confidence", F.when(F.col("n") == 0, 0.0).otherwise(score).alias("score"), "topics")


def coverage(parts: list[DataFrame]) -> DataFrame:
    """Namespaces with their level (weak below 0.3, strong above 0.5) and the overall mean."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    level = F.when(F.col("score") < 0.3, "weak").when(F.col("score") > 0.5, "strong").otherwise("medium")
    mean = rows.agg(F.round(F.avg("score"), 9).alias("overall"))
    return rows.withColumn("level", level).crossJoin(F.broadcast(mean))


def strategy(report: DataFrame) -> DataFrame:
    """What to do about a coverage report: the weakest namespace decides for all."""
    act = lambda s: F.when(s < 0.1, "clarify").when(s < 0.3, "deepen").otherwise("maintain")
    weakest = report.agg(F.min("score").alias("__s"))
    out = report.crossJoin(F.broadcast(weakest)).select("namespace", act(F.col("score")).alias("action"), act(F.col("__s")).alias("overall_action"))
    deep = F.col("action") == "deepen"
    return out.withColumns({"top_k": F.when(deep, 10).otherwise(7).cast("long"), "threshold": F.when(deep, 0.05).otherwise(0.1)})


def entity_global_dedup(entities: DataFrame) -> DataFrame:
    """Entities (text, type, memory_id) by trimmed lower-case text: first spelling, union of memory ids."""
    key = F.lower(F.trim("text"))
    return entities.groupBy(key.alias("key")).agg(F.min("text").alias("text"), F.array_sort(F.collect_set("memory_id")).alias("memory_ids"))


def upsert_latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__nr", F.row_number().over(w)).filter("__nr = 1").drop("__nr")


def apply_decisions(facts: DataFrame, decisions: DataFrame, sure: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Route ADD, UPDATE, DELETE and NOOP decisions (seq, event, id, text, confidence) onto facts (id, text, is_deleted): (facts, results).

    An update or delete that is less than ``sure`` is a NOOP, and so is an update of a
    fact that isn't there or is deleted. An added fact's id is the decision's. Of
    several decisions on one fact the last in order of ``seq`` counts. ``results`` says what
    became of each decision (seq, event).
    """
    live = facts.filter("is_deleted = 0").select("id", F.lit(True).alias("__there"))
    d = decisions.join(live, "id", "left")
    doubtful = F.col("event").isin("UPDATE", "DELETE") & (F.coalesce("confidence", F.lit(0.0)) < sure)
    event = F.when(doubtful | ((F.col("event") == "UPDATE") & F.col("__there").isNull()), "NOOP").otherwise(F.col("event"))
    routed = d.select("seq", "id", "text", event.alias("event"))
    last = routed.filter("event <> 'NOOP'").groupBy("id").agg(F.max_by(F.struct("event", "text"), "seq").alias("__d"))
    kept = facts.join(last, "id", "left").select(
        "id",
        F.when(F.col("__d.event").isin("UPDATE", "ADD"), F.col("__d.text")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("__d.event") == "DELETE", 1).otherwise(F.col("is_deleted")).alias("is_deleted"),
    )
    added = last.filter("__d.event = 'ADD'").join(facts.select("id"), "id", "left_anti").select("id", F.col("__d.text").alias("text"), F.lit(0).alias("is_deleted"))
    return kept.unionByName(added), routed.select("seq", "event")
