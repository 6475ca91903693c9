"""Readers: driver tables, logical memory views, Markdown vaults and JDBC tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Over all cores, where a table has fewer files than there are cores; otherwise as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def _iso(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def _plus(days: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), days.cast("int"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories: tenant, agent and session ids, validity as ISO days, JSON metadata."""
    i = F.col("doc_id")
    valid = F.when(i % 4 == 0, None).otherwise(_iso(_plus(i % 300)))
    return spread(table(spark, sf_dir, "documents")).select(
        F.concat(F.lit("mem-"), i.cast("string")).alias("id"),
        F.col("source").alias("user_id"),
        F.when(i % 7 == 0, None).otherwise(F.col("lang")).alias("agent_id"),
        F.concat(F.lit("s"), (i % 5).cast("string")).alias("session_id"),
        F.col("text").alias("content"),
        F.concat(F.lit('{"lang":"'), F.col("lang"), F.lit('","n_chars":'), F.col("n_chars").cast("string"), F.lit(',"expiration_date":"'), _iso(_plus(i % 700)), F.lit('"}')).alias("metadata"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=i.cast("int"))).alias("created_at"),
        valid.alias("valid_at"),
        F.when((i % 3 == 0) & (i % 4 != 0), _iso(_plus(i % 300 + 90))).alias("invalid_at"),
        F.when(i % 17 == 0, 1).otherwise(0).alias("is_deleted"),
        F.lit("active").alias("state"),
        i.alias("seq"),
    )


def live(rows: DataFrame) -> DataFrame:
    return rows.filter("is_deleted = 0")


def vector_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("user_id"))


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten short queries: the first eight words of benchmark items 0 to 9."""
    return table(spark, sf_dir, "benchmark").filter("item_id < 10").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", "[ \n]+"), 1, 8), " ").alias("query"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("reference_time"), "event_type", "user_id", F.col("props").alias("content"))


def access_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 200).alias("memory_id"), F.col("user_id").alias("app_id"), F.col("event_type").alias("access_type"), F.col("ts").alias("accessed_at"))


def strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = access_logs(spark, sf_dir).groupBy("memory_id").agg(F.count("*").alias("access_count"), F.max("accessed_at").alias("last_accessed"))
    return rows.select("memory_id", F.lit(1.0).alias("strength"), "access_count", "last_accessed", ((F.col("memory_id") % 10) / 10.0).alias("base_value"), (F.col("memory_id") % 23 == 0).alias("archived"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("object"), ((F.col("o_orderkey") % 10 + 1) / 10.0).alias("confidence"), F.col("o_orderdate").alias("created_at"))


def rule_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select((F.col("doc_id") % 100).alias("rule_id"), F.col("doc_id").alias("seq"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("helpful"))


def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse graph over event ids: each id to twice itself (modulo their number) and to itself plus seven."""
    ids = table(spark, sf_dir, "events").select(F.col("event_id").alias("e"))
    n = ids.agg(F.count("*").alias("n"))
    both = ids.join(F.broadcast(n)).select("e", F.explode(F.array(F.struct((F.col("e") * 2 % F.col("n")).alias("t"), F.lit("doubles").alias("r")), F.struct((F.col("e") + 7).alias("t"), F.lit("next").alias("r")))).alias("x"))
    return both.select(F.col("e").alias("source_id"), F.col("x.t").alias("target_id"), F.col("x.r").alias("relation"))


def causal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, each event causes the next one and the one after."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.lead("event_id", 1).over(w).alias("n1"), F.lead("event_id", 2).over(w).alias("n2"))
    out = rows.select("user_id", F.col("event_id").alias("cause"), "event_type", F.explode(F.array("n1", "n2")).alias("effect")).filter("effect is not null")
    kinds = ["causes", "enables", "prevents", "inhibits"]
    relation = F.element_at(F.array(*map(F.lit, kinds)), (F.col("cause") % 4 + 1).cast("int"))
    return out.select("user_id", "cause", "effect", relation.alias("relation"), (0.5 + (F.col("cause") % 5) / 10.0).alias("confidence"))


MARKDOWN = "path string, title string, tags array<string>, frontmatter string, body string, links array<string>"


def parse_markdown(files: DataFrame) -> DataFrame:
    """(path, title, tags, frontmatter, body, links) of (path, value): front matter between --- lines, [[links]] with |aliases and #anchors cut."""
    front = F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?", 1)
    body = F.regexp_replace("value", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")
    key = lambda k: F.trim(F.regexp_extract(front, rf"(?m)^{k}:[ \t]*(.*)$", 1))
    inline = F.regexp_replace(key("tags"), r"[\[\]\"']", "")
    links = F.transform(F.regexp_extract_all(body, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1)), lambda x: F.trim(F.regexp_extract(x, r"^[^|#]*", 0)))
    return files.select("path", F.when(key("title") == "", F.regexp_extract("path", r"([^/]+?)(?:\.md)?$", 1)).otherwise(key("title")).alias("title"), F.filter(F.transform(F.split(inline, ","), lambda x: F.trim(x)), lambda x: x != "").alias("tags"), front.alias("frontmatter"), body.alias("body"), F.array_distinct(F.filter(links, lambda x: x != "")).alias("links"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_markdown(files)


def backlinks(notes: DataFrame) -> DataFrame:
    """(title, linked_from) for every link to a note."""
    out = notes.select(F.explode("links").alias("title"), F.col("title").alias("linked_from"))
    return out.join(notes.select("title").distinct(), "title").distinct()


def render_markdown(title: Column, tags: Column, body: Column) -> Column:
    return F.concat(F.lit("---\ntitle: "), title, F.lit("\ntags: ["), F.array_join(tags, ", "), F.lit("]\n---\n"), body)


def safe_name(name: str) -> str:
    """A file name inside the vault; names that lead out of it are refused."""
    parts = name.replace("\\", "/").split("/")
    if not name.strip() or name.startswith("/") or ".." in parts:
        raise ValueError(f"not a name inside the vault: {name!r}")
    return name


def read_jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A relational table by JDBC; partitioned reading by partitionColumn, lowerBound, upperBound and numPartitions."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def dump(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    if kind not in ("parquet", "json", "csv", "orc"):
        raise ValueError(f"unknown kind: {kind}")
    df.write.mode(mode).format(kind).save(path)

