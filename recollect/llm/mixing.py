"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule takes the golden-ratio point frac(i * phi); the source
whose stretch of the cumulative weights holds it is dealt the slot. The k-th
slot of a source takes the k-th block of that source's shuffled token stream,
going round again once all its blocks are dealt. All blocks but a source's last
hold the same number of tokens: a document that crosses a border is cut there.
Any run of slots is within a few slots of the target weights, and no random
state is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import checkpointed, need, shuffle_partitions, table

PHI = 0.6180339887498949
SEED = "mix-1"
BLOCK_TOKENS = 8192
ALPHA = 0.7
#: Slots and shuffled documents are summed up in stretches first, so that no window holds a whole source.
STRETCH = 65536
#: A point is looked up among the sources whose weights reach into its cell; the cells are broadcast up to so many sources.
CELLS = 4096
BROADCAST_SOURCES = 100_000
_TOKEN = r"[^ \t\n\r\f]+"


def _key(seed: str):
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("text"), F.lit(""))).cast("binary"))


def _documents(docs: DataFrame, seed: str) -> DataFrame:
    """(doc_id, source, tokens, key): key shuffles; rows that tie in it are equal in doc_id, source and text."""
    text = F.coalesce("text", F.lit(""))
    return need(docs, "doc_id", "source", "text").select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        F.regexp_count(text, F.lit(_TOKEN)).cast("long").alias("tokens"),
        _key(seed).alias("key"),
    )


def _placed(rows: DataFrame, block_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(rows with the place of their first token in the source's stream, sources with tokens and n_blocks). The sources are as many as the data has, the rows a document each."""
    rows = rows.withColumn("part", F.substring("key", 1, 3))
    parts = rows.groupBy("source", "part").agg(F.sum("tokens").alias("t"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("t").over(before), F.lit(0))).select("source", "part", "base")
    within = Window.partitionBy("source", "part").orderBy("key", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("tokens").over(within)).join(parts, ["source", "part"])
    sources = rows.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    sources = sources.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_tokens") / F.lit(float(block_tokens)))).cast("long"))
    placed = placed.withColumn("start", F.col("base") + F.col("upto") - F.col("tokens")).join(sources, "source")
    return placed.select("doc_id", "source", "tokens", "key", "start", _block(F.col("start"), block_tokens).alias("block")), sources


def _block(token, block_tokens: int):
    """The block of a token; what follows a source's last token, as texts without any do, belongs to the last."""
    return F.least(F.floor(token / F.lit(float(block_tokens))), F.col("n_blocks") - 1).cast("long")


def _pieces(placed: DataFrame, block_tokens: int) -> DataFrame:
    """A row for each block that a document lies in, with the first of its tokens there and how many are."""
    size = F.lit(block_tokens)
    last = F.when(F.col("tokens") > 0, F.floor((F.col("start") + F.col("tokens") - 1) / F.lit(float(block_tokens)))).otherwise(F.col("block")).cast("long")
    every = placed.select("doc_id", "source", "tokens", "start", F.explode(F.sequence("block", last)).alias("block"))
    first = F.greatest("start", F.col("block") * size) - F.col("start")
    end = F.least(F.col("start") + F.col("tokens"), (F.col("block") + 1) * size) - F.col("start")
    return every.select("source", "block", "doc_id", F.when(F.col("tokens") > 0, first).otherwise(0).cast("long").alias("first_token"), F.when(F.col("tokens") > 0, end - first).otherwise(0).cast("long").alias("tokens"))


def schedule(sources: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, block_tokens: int = BLOCK_TOKENS, budget_tokens: int | None = None) -> DataFrame:
    """(slot, source, epoch, block) of every slot.

    ``weights`` maps sources to target weights (sources it leaves out get none);
    by default a source's weight is its tokens to the power ``alpha``. The
    schedule is as long as the source that takes longest needs to be dealt once;
    blocks still open then (of sources with little or no weight, or short by a
    slot) follow at the end, so that every block is dealt. A large source of little
    weight makes it long, as the others are repeated meanwhile. With
    ``budget_tokens`` it ends after as many blocks as hold them instead, and blocks
    that it has not come to are left out.
    """
    spark = sources.sparkSession
    if weights is None:
        weigh = F.when(F.col("source_tokens") > 0, F.pow(F.col("source_tokens").cast("double"), F.lit(alpha))).otherwise(0.0)
        weighted = sources.withColumn("w", weigh)
    else:
        if any(v < 0 for v in weights.values()):
            raise ValueError("weights must not be negative")
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        weighted = sources.join(F.broadcast(given), "source", "left").withColumn("w", F.when(F.col("source_tokens") > 0, F.coalesce("w", F.lit(0.0))).otherwise(0.0))
    every = Window.partitionBy(F.lit(1))
    order = Window.partitionBy(F.lit(1)).orderBy("source")
    share = F.col("w") / F.sum("w").over(every)
    # one row a source: a single window is no bottleneck
    points = weighted.withColumn("share", F.when(F.sum("w").over(every) > 0, share).otherwise(0.0))
    points = checkpointed(points.withColumn("hi", F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0))).withColumn("top", F.max(F.when(F.col("share") > 0, F.col("hi"))).over(every)))
    length = points.filter("share > 0").agg(F.max(F.ceil(F.col("source_tokens") / F.lit(float(block_tokens)) / F.col("share"))).alias("n")).first()["n"] or 0
    if budget_tokens is not None and length:
        length = -(-budget_tokens // block_tokens)
    u = F.col("id") * F.lit(PHI)
    slots = spark.range(0, int(length)).select(F.col("id").alias("slot"), (u - F.floor(u)).alias("u"))
    stretches = points.filter("share > 0").select("source", "n_blocks", "lo", F.when(F.col("hi") == F.col("top"), F.lit(2.0)).otherwise(F.col("hi")).alias("hi"))
    cells = stretches.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS)))))
    if points.count() <= BROADCAST_SOURCES:
        cells = F.broadcast(cells)
    dealt = slots.withColumn("cell", F.floor(F.col("u") * CELLS)).join(cells, "cell").filter("u >= lo and u < hi").select("slot", "source", "n_blocks", F.floor(F.col("slot") / F.lit(float(STRETCH))).alias("part"))
    parts = dealt.groupBy("source", "part").agg(F.count("*").alias("c"))
    base = F.coalesce(F.sum("c").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("source", "part", base.alias("base"))
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("source", "part").orderBy("slot")) - 1).join(parts, ["source", "part"]).withColumn("r", F.col("r") + F.col("base"))
    main = ranked.select("slot", "source", F.floor(F.col("r") / F.col("n_blocks").cast("double")).cast("long").alias("epoch"), F.pmod("r", "n_blocks").cast("long").alias("block"))
    if budget_tokens is not None:
        return main
    count = ranked.groupBy("source").agg(F.count("*").alias("have"))
    short = points.join(count, "source", "left").select("source", "n_blocks", F.coalesce("have", F.lit(0)).alias("have")).filter("have < n_blocks")
    short = short.withColumn("from", F.coalesce(F.sum(F.col("n_blocks") - F.col("have")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tail = short.select((F.lit(int(length)) + F.col("from")).alias("first"), "source", "have", F.explode(F.sequence("have", F.col("n_blocks") - 1)).alias("block"))
    tail = tail.select((F.col("first") + F.col("block") - F.col("have")).cast("long").alias("slot"), "source", F.lit(0).cast("long").alias("epoch"), F.col("block").cast("long").alias("block"))
    return main.unionByName(tail)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, block_tokens: int = BLOCK_TOKENS, seed: str = SEED, budget_tokens: int | None = None) -> DataFrame:
    """The mixed order: (slot, source, epoch, block, doc_id, first_token, tokens), a row for each piece of a document each time it is dealt.

    A source's documents, shuffled by a seeded hash, make one stream of tokens
    (runs without white space), cut into blocks of ``block_tokens``. A piece are the
    ``tokens`` of a document, from its ``first_token`` on, that lie in the block. See
    ``schedule`` for the slots; without a budget every token is dealt at least once.

    A null source is the source ''. Null and empty texts have no token and go, as a
    piece without tokens, with the block at their place in the stream. A source
    without tokens has no weight; its documents follow at the end. Null doc_ids are
    carried along. Repeated rows are dealt as often as they occur. Documents longer
    than a block are in several. Other columns are ignored. An empty table gives an
    empty schedule.
    """
    # ids, counts and keys without the texts: what is summed up and ranked below is read from the checkpoint, the texts once
    placed, sources = _placed(checkpointed(_documents(docs, seed)), block_tokens)
    slots = schedule(sources, weights, alpha, block_tokens, budget_tokens)
    return slots.join(_pieces(placed, block_tokens), ["source", "block"]).select("slot", "source", "epoch", "block", "doc_id", "first_token", "tokens")


def mix_documents(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, block_tokens: int = BLOCK_TOKENS, seed: str = SEED, budget_tokens: int | None = None) -> DataFrame:
    """``docs`` as they are dealt, in the order of the schedule, all columns as they were.

    Documents stay whole here: each is dealt wherever the block is that its first
    token lies in, so a slot holds a block's tokens up to a document's length.
    Partitions, and rows within them, are in order of slots, and so are the files
    that are written of them. Nulls, empty texts, ties, repeated rows, empty tables
    and other columns as in ``mix``; no column of ``docs`` can clash.
    """
    placed, sources = _placed(checkpointed(_documents(docs, seed)), block_tokens)
    dealt = checkpointed(schedule(sources, weights, alpha, block_tokens, budget_tokens))
    times = dealt.groupBy("source", "block").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    # Rows of equal source and key are equal in doc_id and text; they may lie in neighbouring blocks, so the n-th of them takes
    # the n-th list. The join is on the window's own keys.
    plan = placed.join(times, ["source", "block"]).groupBy(F.col("source").alias("__rc_source"), F.col("key").alias("__rc_key")).agg(F.sort_array(F.collect_list("slots")).alias("__rc_slots"))
    rows = docs.withColumns({"__rc_source": F.coalesce(F.col("source"), F.lit("")), "__rc_key": _key(seed)})
    rows = rows.withColumn("__rc_nr", F.row_number().over(Window.partitionBy("__rc_source", "__rc_key").orderBy("__rc_key")))
    out = rows.join(plan, ["__rc_source", "__rc_key"]).filter(F.col("__rc_nr") <= F.size("__rc_slots")).withColumn("__rc_slot", F.explode(F.col("__rc_slots")[F.col("__rc_nr") - 1]))
    # slots are evenly filled: their number says where each partition begins, no sample is needed
    n, length = shuffle_partitions(docs.sparkSession), max(1, dealt.count())
    out = out.repartitionById(n, F.floor(F.col("__rc_slot") * F.lit(n) / F.lit(float(length))).cast("int")).sortWithinPartitions("__rc_slot", "__rc_key")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(block_tokens: int = BLOCK_TOKENS, alpha: float = ALPHA, seed: str = SEED, docs: str = "documents") -> str:
    """DuckDB SQL for the rows of ``mix`` with default weights."""
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+')) AS tokens,
         md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS key
  FROM {docs}
), s AS (
  SELECT source, sum(tokens) AS source_tokens, greatest(1, CAST(ceil(sum(tokens) / {float(block_tokens)}) AS BIGINT)) AS n_blocks FROM d GROUP BY source
), placed AS (
  SELECT d.doc_id, d.source, d.tokens, n_blocks,
         CAST(sum(d.tokens) OVER (PARTITION BY d.source ORDER BY key, d.tokens ROWS UNBOUNDED PRECEDING) - d.tokens AS BIGINT) AS start
  FROM d JOIN s USING (source)
), spread AS (
  SELECT *, unnest(range(least(start // {block_tokens}, n_blocks - 1), 1 + CASE WHEN tokens > 0 THEN (start + tokens - 1) // {block_tokens} ELSE least(start // {block_tokens}, n_blocks - 1) END)) AS block FROM placed
), pieces AS (
  SELECT doc_id, source, block, CASE WHEN tokens > 0 THEN greatest(start, block * {block_tokens}) - start ELSE 0 END AS first_token,
         CASE WHEN tokens > 0 THEN least(start + tokens, (block + 1) * {block_tokens}) - greatest(start, block * {block_tokens}) ELSE 0 END AS tokens
  FROM spread
), w AS (
  SELECT *, CASE WHEN source_tokens > 0 THEN pow(CAST(source_tokens AS DOUBLE), {alpha}) ELSE 0.0 END AS w FROM s
), sh AS (
  SELECT *, w / (SELECT sum(w ORDER BY source) FROM w) AS share FROM w WHERE (SELECT sum(w) FROM w) > 0
), p AS (
  SELECT *, sum(share) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING) AS hi FROM sh
), q AS (
  SELECT *, coalesce(lag(hi) OVER (ORDER BY source), 0.0) AS lo, (SELECT max(hi) FROM p WHERE share > 0) AS top FROM p
), n AS (
  SELECT CAST(coalesce(max(ceil(source_tokens / {float(block_tokens)} / share)), 0) AS BIGINT) AS n FROM q WHERE share > 0
), dealt AS (
  SELECT i AS slot, q.source, n_blocks, row_number() OVER (PARTITION BY q.source ORDER BY i) - 1 AS r
  FROM (SELECT unnest(range((SELECT n FROM n))) AS i) JOIN q
    ON share > 0 AND i * {PHI} - floor(i * {PHI}) >= lo AND i * {PHI} - floor(i * {PHI}) < CASE WHEN hi = top THEN 2.0 ELSE hi END
), short AS (
  SELECT s.source, n_blocks, coalesce(have, 0) AS have FROM s LEFT JOIN (SELECT source, count(*) AS have FROM dealt GROUP BY source) USING (source) WHERE coalesce(have, 0) < n_blocks
), f AS (
  SELECT *, coalesce(sum(n_blocks - have) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM short
), tail AS (
  SELECT CAST((SELECT n FROM n) + before + block - have AS BIGINT) AS slot, source, 0 AS epoch, block FROM (SELECT *, unnest(range(have, n_blocks)) AS block FROM f)
), slots AS (
  SELECT slot, source, r // n_blocks AS epoch, r % n_blocks AS block FROM dealt UNION ALL SELECT slot, source, epoch, block FROM tail
)
SELECT CAST(slot AS BIGINT) AS slot, source, CAST(epoch AS BIGINT) AS epoch, CAST(block AS BIGINT) AS block, doc_id, CAST(first_token AS BIGINT) AS first_token, CAST(tokens AS BIGINT) AS tokens
FROM slots JOIN pieces USING (source, block)"""


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
