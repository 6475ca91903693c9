"""Memory records as versions in an append-only log: current state, history, soft deletion, access logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current(log: DataFrame, key: str = "id", order: tuple[str, ...] = ("created_at", "seq"), keep_deleted: bool = False) -> DataFrame:
    """The latest version of each key; deleted ones go."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    out = log.withColumn("__nr", F.row_number().over(w)).filter("__nr = 1").drop("__nr")
    return out if keep_deleted else out.filter("is_deleted = 0")


def add_batch(batch: DataFrame, content: str = "content", order: str = "seq", by: tuple[str, ...] = ()) -> DataFrame:
    """In-batch dedup by md5 of the content: the first row keeps its id, copies get a null one."""
    w = Window.partitionBy(*by, F.md5(F.col(content).cast("binary"))).orderBy(order)
    return batch.withColumn("id", F.when(F.row_number().over(w) == 1, F.col("id")))


def append_add(log: DataFrame, rows: DataFrame) -> DataFrame:
    return log.unionByName(rows, allowMissingColumns=True)


def history_of(log: DataFrame, key: str = "id", order: tuple[str, ...] = ("created_at", "seq")) -> DataFrame:
    """The change log of versions: ADD, UPDATE (with the text before), DELETE, INVALIDATE."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag("content").over(w)
    event = F.when(F.row_number().over(w) == 1, "ADD").when(F.col("is_deleted") == 1, "DELETE").when(~F.col("invalid_at").eqNullSafe(F.lag("invalid_at").over(w)), "INVALIDATE").otherwise("UPDATE")
    return log.select(F.col(key).alias("memory_id"), event.alias("event"), before.alias("old_memory"), F.when(F.col("is_deleted") == 0, F.col("content")).alias("new_memory"), *order)


def update(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Replace content and merge metadata (both optional in ``changes``: content, metadata) of the rows changed."""
    c = changes.select(F.col(key), F.col("content").alias("__content"), F.col("metadata").alias("__metadata"))
    return rows.join(c, key, "left").withColumns({"content": F.coalesce("__content", "content"), "metadata": F.coalesce(merge_metadata(F.col("metadata"), F.col("__metadata")), F.col("metadata"))}).drop("__content", "__metadata")


def merge_metadata(old: Column, new: Column) -> Column:
    """JSON objects merged, the new values winning; keys come out sorted."""
    kind = "map<string,string>"
    a, b = F.coalesce(F.from_json(old, kind), F.create_map().cast(kind)), F.from_json(new, kind)
    both = F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    return F.when(b.isNotNull(), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(both)))))


def soft_delete(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    gone = ids.select(F.col(key), F.lit(1).alias("__gone")).distinct()
    return rows.join(gone, key, "left").withColumns({"is_deleted": F.coalesce("__gone", "is_deleted"), "state": F.when(F.col("__gone") == 1, "deleted").otherwise(F.col("state"))}).drop("__gone")


def invalidate(rows: DataFrame, ids: DataFrame, at: str, now: str, key: str = "id") -> DataFrame:
    """End the validity of ids at ``at``, noting the moment ``now``."""
    gone = ids.select(F.col(key), F.lit(True).alias("__gone")).distinct()
    out = rows.join(gone, key, "left")
    return out.withColumns({"invalid_at": F.when(F.col("__gone"), F.lit(at)).otherwise(F.col("invalid_at")), "expired_at": F.when(F.col("__gone"), F.lit(now))}).drop("__gone")


def page(rows: DataFrame, offset: int, limit: int, order: tuple[str, ...] = ("created_at", "seq")) -> DataFrame:
    """A page of rows with the ``total`` beside them."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def reset(rows: DataFrame) -> DataFrame:
    return rows.limit(0)


def latest_accesses(logs: DataFrame, k: int = 100, by: str = "memory_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("accessed_at"), F.desc("id"))
    return logs.withColumn("__nr", F.row_number().over(w)).filter(F.col("__nr") <= k).drop("__nr")


def timeline(episodes: DataFrame, kinds: list[str] | None = None, since: str | None = None, until: str | None = None, k: int = 50) -> DataFrame:
    out = episodes
    if kinds:
        out = out.filter(F.col("event_type").isin(*kinds))
    if since:
        out = out.filter(F.col("reference_time") >= F.lit(since).cast("timestamp_ntz"))
    if until:
        out = out.filter(F.col("reference_time") <= F.lit(until).cast("timestamp_ntz"))
    return out.orderBy(F.desc("reference_time"), F.desc("id")).limit(k)


def messages_text(messages: DataFrame) -> DataFrame:
    """Conversations as 'role: text' lines in order of turn."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    return messages.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("content"), F.count("*").alias("n"))


def attribute(rows: DataFrame, name: str = "name") -> DataFrame:
    """Who a message is attributed to: its name as actor, its role otherwise."""
    return rows.withColumns({"actor_id": F.col(name), "attributed_to": F.coalesce(F.col(name), F.col("role"))})


def with_identity(facts: DataFrame) -> DataFrame:
    return facts.withColumn("is_identity", F.coalesce(F.array_contains("tags", "identity"), F.lit(False)))


def remove_reference(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """Take memory ids out of entities (id, linked_memory_ids, is_deleted); one that links nothing any more is soft-deleted.

    Links are exploded and anti-joined, so neither side is collected; the entities
    that link a removed id are the only ones regrouped.
    """
    links = entities.select("id", F.explode("linked_memory_ids").alias("__m"))
    hit = links.join(ids.select(F.col("id").alias("__m")).distinct(), "__m", "left_semi").select("id", "__m")
    gone = hit.groupBy("id").agg(F.collect_set("__m").alias("__gone"))
    left = F.when(F.col("__gone").isNotNull(), F.array_except("linked_memory_ids", "__gone")).otherwise(F.col("linked_memory_ids"))
    return entities.join(gone, "id", "left").withColumn("linked_memory_ids", left).withColumn("is_deleted", F.when(F.size("linked_memory_ids") == 0, 1).otherwise(F.col("is_deleted"))).select(entities.columns)
