"""Vector and keyword search: batches of queries against a corpus, ranked per query.

Ranks and scores are total orders: score rounded to nine places, then id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import lemmas, tokenize
from recollect.functions.vector import buckets, norm, unit_cosine
from recollect.operators.nearest import best_in_tiles
from recollect.plans.session import checkpointed, small_side

K1, B = 1.5, 0.75


def top_k(scored: DataFrame, k: int, by: list[str], score: str = "score", tie: str = "id", rank: str = "rank") -> DataFrame:
    """The ``k`` best rows of each group, with their rank from 0. Catalyst limits each partition before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k).withColumn(rank, (F.col(rank) - 1).cast("long"))


def cosine_scores(entries: DataFrame, queries: DataFrame, same_tenant: bool = False) -> DataFrame:
    """(query_id, id, score) of every entry (id, vector[, user_id]) and query (query_id, query_vector[, user_id]).

    Scores are kept to [0, 1]. Zero vectors are left out on either side; a
    dimension other than the query's is an error. Queries are the side that is
    joined to every entry; with ``same_tenant`` only those of the entry's user.
    """
    e = entries.withColumn("__n", norm(F.col("vector"))).filter(F.col("__n") > 0)
    q = queries.withColumn("__m", norm(F.col("query_vector"))).filter(F.col("__m") > 0)
    joined = e.join(q, "user_id") if same_tenant else e.crossJoin(small_side(q))
    fits = F.when(F.size("vector") != F.size("query_vector"), F.raise_error(F.lit("vectors differ in dimension")).cast("double"))
    score = fits.otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), unit_cosine(F.col("vector"), F.col("__n"), F.col("query_vector"), F.col("__m")))))
    return joined.select("query_id", "id", F.round(score, 9).alias("score"))


def vector_top_k(entries: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.1, same_tenant: bool = False) -> DataFrame:
    scored = cosine_scores(entries, queries, same_tenant).filter(F.col("score") >= threshold)
    return top_k(scored, k, ["query_id"])


def approximate_top_k(entries: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.5, tables: int = 12, bits: int = 6) -> DataFrame:
    """``vector_top_k`` among the entries that share a bucket of random hyperplanes with the query, instead of all.

    At the defaults a pair with a cosine of 0.9 shares a bucket with a probability of
    0.999, one of 0.8 of 0.98. The pairs of a bucket are scored in tiles, and only the
    best of a query leave a tile: what is shuffled is each vector once a table (and tile
    of the other side), and ``k`` rows a query and table.
    """
    e = entries.select("id", "vector", F.explode(buckets(F.col("vector"), tables, bits)).alias("__b"))
    q = queries.select("query_id", "query_vector", F.explode(buckets(F.col("query_vector"), tables, bits)).alias("__b"))
    scored = best_in_tiles(q, e, k, threshold, "__b", same=True)
    # a pair has the same score in each of its buckets
    return top_k(scored.withColumn("score", F.greatest(F.lit(0.0), "score")).distinct(), k, ["query_id"])


def hydrate(hits: DataFrame, rows: DataFrame, threshold: float = 0.1, k: int = 5) -> DataFrame:
    """Hits (query_id, id, score) of at least ``threshold`` joined to their rows, the best ``k`` a query."""
    return top_k(hits.filter(F.col("score") >= threshold).select("query_id", "id", "score").join(rows, "id"), k, ["query_id"])


def keyword_overlap(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Share of the query's distinct tokens that the document (id, text) has; only those above 0."""
    d = docs.select("id", F.array_distinct(tokenize(F.col("text"))).alias("words"))
    q = queries.select("query_id", F.array_distinct(tokenize(F.col("query"))).alias("terms")).filter(F.size("terms") > 0)
    scored = d.crossJoin(small_side(q)).select("query_id", "id", F.round(F.size(F.array_intersect("terms", "words")) / F.size("terms"), 9).alias("score"))
    return scored.filter("score > 0")


def postings(docs: DataFrame, words: Column) -> DataFrame:
    """(term, id, tf, length): the inverted index of (id, text)."""
    rows = docs.select("id", words.alias("words")).select("id", F.size("words").alias("length"), F.explode_outer("words").alias("term")).filter("term is not null")
    return rows.groupBy("term", "id", "length").agg(F.count("*").alias("tf"))


def term_counts(docs: DataFrame, words: Column) -> DataFrame:
    """(term, df, tf) of (id, text): how many ids have the term, and how often; what ``postings`` gives, summed by term.

    Where no id is repeated, a document's own counts are added up before the shuffle,
    which then has a row a term and task instead of one a term and document.
    """
    if not docs.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        rows = docs.select("id", F.explode_outer(words).alias("term")).filter("term is not null")
        return rows.groupBy("term", "id").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))
    d = docs.select(words.alias("words"))
    both = d.select(F.explode(F.array(F.struct(F.lit(0).alias("df"), "words"), F.struct(F.lit(1).alias("df"), F.array_distinct("words").alias("words")))).alias("x"))
    rows = both.select("x.df", F.explode_outer("x.words").alias("term")).filter("term is not null")
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum(1 - F.col("df")).alias("tf"))


def delete_postings(index: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The inverted index, or the documents that it is made of, without those of the ids; without ids it is cleared."""
    return index.limit(0) if ids is None else index.join(ids.select("id"), "id", "left_anti").select(index.columns)


def bm25(docs: DataFrame, queries: DataFrame, lemmatized: bool = True, k1: float = K1, b: float = B, by: list[str] | None = None) -> DataFrame:
    """BM25 of (id, text[, by...]) for every query (query_id, query); rows above 0.

    Texts are read and cut into words once. Only terms of queries leave the scan:
    documents keep the query terms' counts, not their words, before anything is
    shuffled. A term repeated in a query counts as often. ``by`` names columns (a tenant) with statistics of their own; then
    queries carry them, too.
    """
    by = by or []
    words = lemmas if lemmatized else tokenize
    terms = queries.select("query_id", *by, F.explode(words(F.col("query"))).alias("term")).groupBy("query_id", *by, "term").agg(F.count("*").alias("weight"))
    wanted = terms.select(*by, "term").distinct()
    if lemmatized:  # the few words that have the terms as lemmas, instead of the lemmas of all words
        forms = wanted.select(*by, "term", F.explode(F.array(*[F.concat("term", F.lit(e)) for e in ("", "s", "ed", "ing")])).alias("__w"))
        wanted = forms.filter(F.element_at(lemmas(F.col("__w")), 1) == F.col("term"))
    else:
        wanted = wanted.withColumn("__w", F.col("term"))
    # one pass over the texts: words are counted while they are still beside each other, and each document has a row
    # without a term (the null before its words), which the statistics are taken from
    d = docs.select("id", *by, tokenize(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("__row"))
    each = d.select("id", *by, "__row", F.size("words").alias("dl"), F.explode_outer(F.concat(F.array(F.lit(None).cast("string")), "words")).alias("__w"))
    # (a null text has no words to count; size says -1 or null then)
    met = each.join(small_side(wanted), [*by, "__w"], "left").filter("term is not null or __w is null").groupBy("id", *by, "__row", "dl", "term").agg(F.count("*").alias("f"))
    met = checkpointed(met)
    stats = met.filter("term is null").groupBy(*by).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    counts = met.filter("term is not null").groupBy("id", *by, "dl", "term").agg(F.sum("f").alias("f"))
    df = counts.groupBy(*by, "term").agg(F.count("*").alias("df"))
    scored = counts.join(terms, [*by, "term"]).join(df, [*by, "term"])
    scored = scored.join(stats, by) if by else scored.crossJoin(F.broadcast(stats))
    f, n, m = F.col("f").cast("double"), F.col("n").cast("double"), F.col("df").cast("double")
    part = F.log((n - m + 0.5) / (m + 0.5) + 1.0) * (f * (k1 + 1.0)) / (f + k1 * (1.0 - b + b * F.col("dl") / F.col("avgdl"))) * F.col("weight")
    return scored.groupBy("query_id", *by, "id").agg(F.round(F.sum(part), 9).alias("score")).filter("score > 0")


def bm25_params(terms: Column) -> tuple[Column, Column]:
    """(midpoint, steepness) of the sigmoid by the number of query words."""
    steps = [(3, 5.0, 0.7), (6, 7.0, 0.6), (9, 9.0, 0.5), (15, 10.0, 0.5)]
    mid, steep = F.lit(12.0), F.lit(0.5)
    for most, m, s in reversed(steps):
        mid, steep = F.when(terms <= most, m).otherwise(mid), F.when(terms <= most, s).otherwise(steep)
    return mid, steep


def sigmoid(score: Column, midpoint: Column, steepness: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-steepness * (score - midpoint)))


def bm25_sigmoid(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """BM25 on plain tokens, brought to (0, 1) by the query's length."""
    raw = bm25(docs, queries, lemmatized=False)
    n = queries.select("query_id", F.size(F.filter(F.split(F.trim("query"), r"\s+"), lambda w: w != "")).alias("terms"))
    mid, steep = bm25_params(F.col("terms"))
    return raw.join(n, "query_id").select("query_id", "id", F.round(sigmoid(F.col("score"), mid, steep), 9).alias("score"))


def bm25_max(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """BM25 over the query's best score."""
    raw = bm25(docs, queries, lemmatized=False)
    return raw.withColumn("score", F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), 9))
