"""Access rules, sharing, write checks, working-memory blocks and form drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import content_hash, escape_xml

PERMISSIONS = {"owner": ("read", "write", "admin"), "agent": ("read", "write"), "observer": ("read",)}


def access_check(requests: DataFrame, memories: DataFrame) -> DataFrame:
    """(request_id, allowed, reason) of requests (request_id, memory_id, app_id)."""
    m = memories.select(F.col("id").alias("memory_id"), F.coalesce("state", F.lit("active")).alias("state"), F.lit(True).alias("found"))
    rows = requests.join(m, "memory_id", "left")
    app = F.col("app_id")
    reason = (
        F.when(F.col("found").isNull(), "memory not found")
        .when(F.col("state") != "active", F.concat(F.lit("memory state is "), F.col("state"), F.lit(" (not active)")))
        .when(app.isNull(), "self access")
        .when(F.trim(app) == "", "app_id is empty")
        .otherwise(F.concat(F.lit("app "), app, F.lit(" access granted")))
    )
    allowed = F.col("found").isNotNull() & (F.col("state") == "active") & (app.isNull() | (F.trim(app) != ""))
    return rows.select("request_id", F.coalesce(allowed, F.lit(False)).alias("allowed"), reason.alias("reason"))


def rbac_check(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """(request_id, allowed) of requests (request_id, user_id, agent_id, permission, namespace) by grants (user_id, agent_id, role, namespace); * is every namespace, one's own memory is always open."""
    table = F.create_map(*[x for role, allowed in PERMISSIONS.items() for x in (F.lit(role), F.array(*map(F.lit, allowed)))])
    g = grants.select("user_id", "agent_id", F.col("namespace").alias("__ns"), F.element_at(table, F.col("role")).alias("__may"))
    hit = (F.col("__ns").isin("*") | (F.col("__ns") == F.col("namespace"))) & F.array_contains("__may", F.col("permission"))
    own = (F.col("agent_id") == F.col("user_id")) | (F.col("agent_id") == "self")
    return requests.join(g, ["user_id", "agent_id"], "left").groupBy("request_id").agg(F.bool_or(own | F.coalesce(hit, F.lit(False))).alias("allowed"))


def grant(grants: DataFrame, new: DataFrame) -> DataFrame:
    """Grants (user_id, agent_id, role, namespace) with the new ones; role and namespace default to agent and * where null."""
    more = new.select("user_id", "agent_id", F.coalesce("role", F.lit("agent")).alias("role"), F.coalesce("namespace", F.lit("*")).alias("namespace"))
    return grants.unionByName(more).distinct()


def revoke(grants: DataFrame, pairs: DataFrame) -> DataFrame:
    """Grants without those of (user_id, agent_id)."""
    return grants.join(pairs.select("user_id", "agent_id"), ["user_id", "agent_id"], "left_anti")


def scope(user_id: str, agent_id: str | None = None) -> Column:
    c = F.col("user_id") == user_id
    return c if agent_id is None else c & (F.col("agent_id") == agent_id)


def cross_agent(memories: DataFrame, newest: int = 100) -> DataFrame:
    """(user_id, n_agents, cross_agent): several agents, or one unknown, among a user's newest memories."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("seq"))
    rows = memories.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= newest)
    return rows.groupBy("user_id").agg(F.count_distinct("agent_id").alias("n_agents"), ((F.count_distinct("agent_id") >= 2) | F.bool_or(F.col("agent_id").isNull())).alias("cross_agent"))


def dedup_window(rows: DataFrame, seconds: int = 300, by: str = "user_id", text: str = "text", at: str = "ts", order: str = "id") -> DataFrame:
    """Rows with ``accepted``: a text counts again once more than ``seconds`` have gone by since it was last *accepted*; rejected repeats don't prolong the wait.

    The fold is in order of time, over the repeats of one text of one user.
    """
    moment = F.unix_micros(F.col(at).cast("timestamp"))
    item = F.struct(moment.alias("t"), F.col(order).alias("k"))
    items = F.array_sort(F.collect_list(item))
    kind = f"struct<last:bigint,ids:array<{dict(rows.dtypes)[order]}>>"
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(f"array<{dict(rows.dtypes)[order]}>").alias("ids")).cast(kind)
    fold = F.aggregate(items, start, lambda s, x: F.when(s["last"].isNull() | (x["t"] - s["last"] > seconds * 1_000_000), F.struct(x["t"].alias("last"), F.array_append(s["ids"], x["k"]).alias("ids"))).otherwise(s))
    taken = rows.groupBy(by, content_hash(F.concat_ws(":", F.col(by).cast("string"), F.trim(text))).alias("text_hash")).agg(fold.alias("f"))
    accepted = taken.select(F.explode("f.ids").alias(order), F.lit(True).alias("__ok"))
    return rows.join(accepted, order, "left").select(rows[order], rows[by], F.coalesce("__ok", F.lit(False)).alias("accepted"))


def write_check(rows: DataFrame) -> DataFrame:
    """(id, ok, reason): empty text, then a bad user id, then a repeat of the same text by the same user."""
    first = F.row_number().over(Window.partitionBy("user_id", F.trim("text")).orderBy("id")) == 1
    reason = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty").when(F.coalesce(F.col("user_id").rlike(r"^\s*$|\S\s+\S"), F.lit(True)), "invalid id").when(~first, "duplicate")
    return rows.select("id", reason.isNull().alias("ok"), reason.alias("reason"))


def drift(forms: DataFrame) -> DataFrame:
    """Rows (id, graph, file, vector) with the leading text (graph, else file, else vector) and which forms differ from it or lack it."""
    lead = F.coalesce("graph", "file", "vector")
    off = [(~F.col(c).eqNullSafe(lead)).alias(f"{c}_drift") for c in ("graph", "file", "vector")]
    return forms.select("*", lead.alias("authority"), *off).withColumn("drift", F.col("graph_drift") | F.col("file_drift") | F.col("vector_drift"))


def consistency(drifted: DataFrame) -> DataFrame:
    n = F.count("*")
    hits = [F.sum(F.col(f"{c}_drift").cast("long")).alias(f"{c}_drift") for c in ("graph", "file", "vector")]
    return drifted.agg(n.alias("total"), F.sum(F.col("drift").cast("long")).alias("drifted"), *hits).withColumn("rate", F.round(F.when(F.col("total") > 0, 1 - F.col("drifted") / F.col("total")).otherwise(1.0), 9))


def reconcile(drifted: DataFrame) -> DataFrame:
    """The three forms rewritten to the leading text."""
    return drifted.select("id", *[F.col("authority").alias(c) for c in ("graph", "file", "vector")])


def compile_blocks(blocks: DataFrame) -> DataFrame:
    """(agent_id, xml): an agent's blocks (label, value) as XML in order of label."""
    one = F.concat(F.lit("<"), F.col("label"), F.lit(">"), escape_xml(F.col("value")), F.lit("</"), F.col("label"), F.lit(">"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("label", "id", one.alias("x")))), lambda s: s["x"])
    return blocks.groupBy("agent_id").agg(F.concat(F.lit("<memory_blocks>\n"), F.array_join(lines, "\n"), F.lit("\n</memory_blocks>")).alias("xml"))


def append_block(value: Column, text: Column, limit: int = 2000) -> Column:
    """Appended on a line of its own; the oldest characters go if that is over the limit."""
    joined = F.when(F.coalesce(value, F.lit("")) == "", text).otherwise(F.concat_ws("\n", value, text))
    return F.when(F.length(joined) > limit, F.right(joined, F.lit(limit))).otherwise(joined)


def replace_block(value: Column, old: str, new: str) -> Column:
    """Every occurrence; an error if there is none."""
    return F.when(value.contains(old), F.replace(value, F.lit(old), F.lit(new))).otherwise(F.raise_error(F.lit("the text is not in the block")).cast("string"))


def default_blocks(agents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Empty human and persona blocks for agents (agent_id) without any."""
    none = agents.select("agent_id").distinct().join(blocks.select("agent_id").distinct(), "agent_id", "left_anti")
    return none.select("agent_id", F.explode(F.array(F.lit("human"), F.lit("persona"))).alias("label"), F.lit("").alias("value"), F.lit(2000).cast("long").alias("limit"))


def business_metrics(memories: DataFrame) -> DataFrame:
    """(metric, key, value): memories by state, stored characters and rows."""
    by = memories.groupBy(F.col("state").alias("key")).agg(F.count("*").cast("long").alias("value")).select(F.lit("memories_by_state").alias("metric"), "key", "value")
    size = memories.agg(F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("value")).select(F.lit("stored_characters").alias("metric"), F.lit("content").alias("key"), "value")
    total = memories.agg(F.count("*").cast("long").alias("value")).select(F.lit("total").alias("metric"), F.lit("memories").alias("key"), "value")
    return by.unionByName(size).unionByName(total)
