"""Entities: extraction by rules, triplets of neighbours, matching, search and dedup."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.entity_words import GENERIC, PARTICLES, PLACES, SURNAMES
from recollect.functions.text import normalize
from recollect.functions.vector import cosine
from recollect.operators.nearest import best_in_tiles
from recollect.plans.session import checkpointed, small_side

_PRIORITY = {kind: n for n, kind in enumerate(("IDENTIFIER", "TOPIC", "QUOTED", "PROPER"))}
_CAP = "[A-Z][a-z]+"
_CAPITAL = re.compile(rf"\b{_CAP}\b")
_NAME = re.compile("[" + SURNAMES + "][一-鿿]")
_PLACE = re.compile("|".join(sorted(PLACES, key=len, reverse=True)))
_QUOTES = re.compile("\"([^\"]+)\"|'([^']+)'|「([^」]+)」|“([^”]+)”")
_PART = "[a-z][0-9a-z]*"
_DOTTED = re.compile(rf"\b{_PART}(?:[.]{_PART})+\b")
_CAMEL = re.compile(rf"\b{_CAP}[A-Z]\w*\b")
_SNAKE = re.compile(r"\b[a-z]+_[a-z_]+\b")
_TITLE = re.compile(rf"\b{_CAP}(?:\s+{_CAP})+\b")
_HAN = re.compile("[一-鿿]{2,4}")

ENTITY = "array<struct<text:string,type:string,start:int,end:int>>"


def _norm(text: str) -> str:
    return " ".join(text.lower().split())


def find_entities(text: str) -> list[tuple[str, str, int, int]]:
    """(text, type, start, end) in order of place; of overlapping ones the longest, then the one of higher type, stays."""
    found: list[tuple[str, str, int, int]] = []
    plain = lambda rx, kind, skip: [(m[0], kind, m.start(), m.end()) for m in rx.finditer(text) if not skip(m[0])]
    generic = lambda s: _norm(s) in GENERIC
    found += plain(_CAPITAL, "PROPER", generic) + plain(_NAME, "PROPER", lambda s: s in GENERIC) + plain(_PLACE, "PROPER", lambda s: False)
    found += [(m[m.lastindex], "QUOTED", m.start(), m.end()) for m in _QUOTES.finditer(text)]
    found += plain(_DOTTED, "IDENTIFIER", lambda s: False) + plain(_CAMEL, "IDENTIFIER", lambda s: False) + plain(_SNAKE, "IDENTIFIER", generic)
    found += plain(_TITLE, "TOPIC", lambda s: generic(s) or len(set(s.split())) < 2)
    found += plain(_HAN, "TOPIC", lambda s: s in GENERIC or s in PLACES or any(c in PARTICLES for c in s) or (len(s) < 3 and s[0] in SURNAMES))
    once: dict[tuple[str, str], tuple[str, str, int, int]] = {}
    for e in sorted(found, key=lambda e: (e[2], e[2] - e[3])):
        once.setdefault((_norm(e[0]), e[1]), e)
    kept: list[tuple[str, str, int, int]] = []
    taken = bytearray(len(text))
    for e in sorted(once.values(), key=lambda e: (e[2] - e[3], -_PRIORITY[e[1]])):
        if not any(taken[e[2] : e[3]]):
            kept.append(e)
            taken[e[2] : e[3]] = b"\x01" * (e[3] - e[2])
    return sorted(kept, key=lambda e: e[2])


def extract_entities(text: Column) -> Column:
    """Offsets and greedy overlap resolution need a UDF (Arrow batches)."""

    @F.pandas_udf(ENTITY)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("text", "type", "start", "end"), e)) for e in find_entities(t or "")])

    return run(text)


def neighbour_triplets(text: Column, entities: Column) -> Column:
    """array<struct<source,relation,target>>: each two neighbouring entities, the text between them as relation."""
    from recollect.functions.text import normalize_relation

    n = F.size(entities)
    pairs = F.when(n > 1, F.arrays_zip(F.slice(entities, F.lit(1), n - 1).alias("a"), F.slice(entities, F.lit(2), n - 1).alias("b"))).otherwise(F.array())
    return F.transform(pairs, lambda p: F.struct(p["a"]["text"].alias("source"), normalize_relation(F.substring(text, p["a"]["end"] + 1, p["b"]["start"] - p["a"]["end"])).alias("relation"), p["b"]["text"].alias("target")))


def search_entities(entities: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Entities (id, text, vector) for queries (query_id, query, query_vector): equal 1.0, one inside the other 0.8, else a cosine above 0.3."""
    from recollect.operators.search import top_k

    a, b = normalize(F.col("text")), normalize(F.col("query"))
    near = cosine(F.col("vector"), F.col("query_vector"))
    score = F.when(a == b, 1.0).when((a != "") & (b != "") & (a.contains(b) | b.contains(a)), 0.8).when(near > 0.3, near)
    return top_k(entities.crossJoin(small_side(queries)).select("query_id", "id", F.round(score, 9).alias("score")).filter("score is not null"), k, ["query_id"])


def match_entities(new: DataFrame, known: DataFrame, least: float = 0.95) -> DataFrame:
    """(key, id, how) for new entities (key, text, vector) among known (id, text, vector) of equal name, else of the best cosine of at least ``least``; how is new without one.

    Equal names are an equi-join; only what is left is compared by vector, with every
    known one, in tiles.
    """
    n = new.withColumn("__k", normalize(F.col("text")))
    k = known.select(F.col("id"), normalize(F.col("text")).alias("__k"), F.col("vector").alias("__v"))
    exact = n.join(k.groupBy("__k").agg(F.min("id").alias("id")), "__k").select("key", "id", F.lit("exact").alias("how"))
    rest = n.join(exact.select("key"), "key", "left_anti").select(F.col("key").alias("query_id"), F.col("vector").alias("query_vector"))
    sim = best_in_tiles(rest, k.select("id", F.col("__v").alias("vector")), 1, least, same=True)
    best = sim.groupBy(F.col("query_id").alias("key")).agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b")).select("key", "b.id", F.lit("similar").alias("how"))
    found = exact.unionByName(best)
    return new.select("key").join(found, "key", "left").select("key", "id", F.coalesce("how", F.lit("new")).alias("how"))


def newest(entities: DataFrame, k: int = 100) -> DataFrame:
    """Entities that aren't deleted, newest first, up to ``k`` (a limited sort: each task keeps ``k``)."""
    return entities.filter("is_deleted = 0").orderBy(F.desc("created_at"), F.desc("id")).limit(k)


def link_memories(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Entities with further memory ids (id, memory_id) added to their sorted set."""
    more = links.groupBy("id").agg(F.collect_set("memory_id").alias("__more"))
    return entities.join(more, "id", "left").withColumn("linked_memory_ids", F.array_sort(F.array_union("linked_memory_ids", F.coalesce("__more", F.array().cast("array<string>"))))).drop("__more")


def similar_names(names: DataFrame, least: float = 0.75) -> DataFrame:
    """(a, b, ratio) of different normalised names (name) that difflib finds alike.

    Names whose lengths or letters rule the ratio out are never paired: by length
    band first (2 * shorter / total bounds the ratio), then by shared letters.
    """
    width = -F.log(F.lit(least / (2 - least)))
    rows = names.select(normalize(F.col("name")).alias("a")).filter("a <> ''").distinct().withColumn("band", F.floor(F.log(F.length("a")) / width + 1e-9).cast("int"))
    left = rows.select("a", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("ab"))
    pairs = left.join(rows.select(F.col("a").alias("b"), "band"), "band").filter((F.col("ab") != F.col("band")) | (F.col("a") < F.col("b")))
    n = F.length("a") + F.length("b")
    pairs = pairs.filter(2 * F.least(F.length("a"), F.length("b")) >= least * n).select("a", "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = difflib.SequenceMatcher(autojunk=True)
            out = []
            for a, b in zip(pdf["a"], pdf["b"]):
                a, b = min(a, b), max(a, b)
                m.set_seqs(a, b)
                if m.quick_ratio() >= least and (r := m.ratio()) >= least:
                    out.append((a, b, round(r, 9)))
            yield pd.DataFrame(out, columns=["a", "b", "ratio"])

    return pairs.mapInPandas(run, "a string, b string, ratio double")


def canonical_names(names: DataFrame, least: float = 0.75, max_rounds: int = 100) -> DataFrame:
    """(name, canonical): by alphabet, a name that no canonical before it is alike to is canonical itself; the others go to the first they are alike to.

    Names are only held against canonical ones, so chains of alike names are not
    merged. Rounds decide all names whose earlier neighbours are decided.
    """
    pairs = checkpointed(similar_names(names, least).select("a", "b"))
    key = names.select("name", normalize(F.col("name")).alias("key")).distinct()
    state = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().withColumn("canonical", F.lit(None).cast("string")))
    for _ in range(max_rounds):
        # of each open name: the first canonical before it, and whether one before it is open
        before = pairs.join(state.select(F.col("key").alias("a"), F.col("canonical").alias("c")), "a").groupBy(F.col("b").alias("key")).agg(F.min(F.when(F.col("c") == F.col("a"), F.col("a"))).alias("first"), F.min(F.when(F.col("c").isNull(), F.col("a"))).alias("open"))
        told = F.when(F.col("open").isNull(), F.coalesce("first", "key")).when(F.col("first") < F.col("open"), F.col("first"))
        state = checkpointed(state.join(before, "key", "left").select("key", F.coalesce("canonical", told).alias("canonical")))
        if state.filter("canonical is null").isEmpty():
            return key.join(state, "key", "left").select("name", F.coalesce("canonical", "key").alias("canonical"))
    raise RuntimeError("names did not settle")


def apply_canonical(facts: DataFrame, canon: DataFrame) -> DataFrame:
    """Facts (subject, object, ...) with both names replaced by their canonical form (name, canonical)."""
    s = canon.select(F.col("name").alias("subject"), F.col("canonical").alias("__s"))
    o = canon.select(F.col("name").alias("object"), F.col("canonical").alias("__o"))
    return facts.join(s, "subject", "left").join(o, "object", "left").withColumns({"subject": F.coalesce("__s", "subject"), "object": F.coalesce("__o", "object")}).select(facts.columns)
