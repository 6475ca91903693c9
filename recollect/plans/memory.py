"""A store of memories as append-only tables, with the usual calls on top of the operators.

Every change is appended to the log of its table under ``path``; what is current is
read from the log. Calls take and return few rows (an agent's turn); for many
users, queries or documents use the operators themselves, which are set-oriented.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import text as tx
from recollect.functions.vector import hash_embed
from recollect.operators import entity, evolution, filters, fusion, governance, graph, knowledge, records, rerank, routing, search, strength
from recollect.plans.recipes import recipe as _recipe

Opt, Meta, Strs, Answer = str | None, dict[str, Any] | None, list[str], dict[str, Any]

SCHEMAS = {
    "memories": "id string, user_id string, agent_id string, session_id string, content string, metadata string, created_at string, valid_at string, invalid_at string, expired_at string, is_deleted int, state string, seq long",
    "facts": "id string, user_id string, subject string, predicate string, object string, context string, confidence double, provenance string, tags array<string>, created_at string, is_deleted int, seq long",
    "episodes": "id string, user_id string, agent_id string, event_type string, content string, observation string, thoughts string, action string, result string, reference_time string, is_deleted int, seq long",
    "rules": "id string, user_id string, namespace string, rule string, helpful boolean, is_deleted int, seq long",
    "links": "source_id string, target_id string, relation string, score double, is_deleted int, seq long",
    "causal": "cause string, effect string, relation string, confidence double, user_id string, is_deleted int, seq long",
    "blocks": "agent_id string, label string, value string, is_deleted int, seq long",
    "entities": "id string, user_id string, text string, type string, linked_memory_ids array<string>, is_deleted int, seq long",
    "accesses": "memory_id string, app_id string, access_type string, accessed_at string, seq long",
}


def _now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat(timespec="microseconds")


class Memory:
    """``scorer`` reranks (query, text) pairs, ``llm`` answers prompts (both optional callables)."""

    def __init__(self, spark: SparkSession, path: str, scorer: Callable[[list[tuple[str, str]]], list[float]] | None = None, llm: Callable[[str], str] | None = None):
        self.spark, self.path, self.scorer, self.llm = spark, path.rstrip("/"), scorer, llm
        self._seq = 0

    # == tables

    def _log(self, name: str) -> DataFrame:
        # an empty first part gives the table its schema before anything is written
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], SCHEMAS[name])

    def _append(self, name: str, rows: list[dict[str, Any]]) -> None:
        if not rows:
            return
        for r in rows:
            self._seq = max(self._seq + 1, int(datetime.datetime.now(datetime.UTC).timestamp() * 1e6))
            r["seq"] = self._seq
            r.setdefault("is_deleted", 0)
        names = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        self.spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], SCHEMAS[name]).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def _current(self, name: str, key: str = "id") -> DataFrame:
        return records.current(self._log(name), key, ("seq",))

    def _mine(self, user_id: str) -> DataFrame:
        return self._current("memories").filter(F.col("user_id") == filters.check_id(user_id, "user_id"))

    # == memories

    def add(self, messages: str | list[dict[str, str]], user_id: str, agent_id: Opt = None, session_id: Opt = None, metadata: Meta = None, valid_at: Opt = None, memory_type: Opt = None) -> Strs:
        """Store a text, or each message of a list; equal ones in a call once. ``memory_type`` fact, episode or rule goes to that table."""
        filters.check_id(user_id, "user_id")
        texts = [messages] if isinstance(messages, str) else [m["content"] for m in messages if m.get("content")]
        if memory_type in ("procedural", "rule"):
            return [self.add_rule(t, user_id) for t in texts]
        if memory_type == "fact":
            return [self.add_fact(*[self._triple(t)[k] for k in "subject predicate object".split()], user_id=user_id) for t in texts]
        if memory_type == "episode":
            return [self.add_episode(t, user_id) for t in texts]
        rows = [
            {"id": f"mem-{uuid.uuid4()}", "user_id": user_id, "agent_id": agent_id, "session_id": session_id, "content": t, "metadata": json.dumps(metadata or {}), "created_at": _now(), "valid_at": valid_at, "state": "active"}
            for t in dict.fromkeys(x.strip() for x in texts) if t
        ]
        self._append("memories", rows)
        return [r["id"] for r in rows]

    def _triple(self, text: str) -> dict[str, str]:
        return self.spark.createDataFrame([(text,)], "t string").select(tx.fact_to_triple(F.col("t")).alias("x")).first()["x"].asDict()

    def get(self, memory_id: str) -> DataFrame:
        return self._current("memories").filter(F.col("id") == memory_id)

    def get_all(self, user_id: str, session_id: Opt = None, where: Meta = None, offset: int = 0, limit: int | None = None) -> DataFrame:
        rows = self._mine(user_id)
        if session_id:
            rows = rows.filter(F.col("session_id") == session_id)
        rows = rows.filter(filters.compile_filter(where, rows.columns)).orderBy("seq")
        return rows if limit is None else rows.offset(offset).limit(limit)

    def _change(self, memory_id: str, **new: Any) -> bool:
        old = self.get(memory_id).first()
        if old is None:
            return False
        self._append("memories", [old.asDict() | new])
        return True

    def update(self, memory_id: str, content: Opt = None, metadata: Meta = None) -> bool:
        old = self.get(memory_id).first()
        if old is None:
            return False
        merged = json.loads(old["metadata"] or "{}") | (metadata or {})
        return self._change(memory_id, content=old["content"] if content is None else content, metadata=json.dumps(merged))

    def delete(self, memory_id: str) -> bool:
        return self._change(memory_id, is_deleted=1, state="deleted")

    def delete_all(self, user_id: str) -> int:
        rows = [r.asDict() | {"is_deleted": 1, "state": "deleted"} for r in self._mine(user_id).toLocalIterator()]
        self._append("memories", rows)
        return len(rows)

    def invalidate(self, memory_id: str, at: Opt = None) -> bool:
        return self._change(memory_id, invalid_at=at or _now(), expired_at=_now())

    def get_history(self, memory_id: str) -> DataFrame:
        return records.history_of(self._log("memories").filter(F.col("id") == memory_id), order=("seq",)).orderBy("seq")

    def list_agents(self, user_id: str) -> Strs:
        return sorted(r[0] for r in self._mine(user_id).filter("agent_id is not null").select("agent_id").distinct().collect())

    def list_users(self) -> Strs:
        return sorted(r[0] for r in self._current("memories").select("user_id").distinct().collect())

    # == search

    def search(self, query: str, user_id: str, top_k: int = 7, threshold: float | None = None, recipe: str = "HYBRID_RRF", where: Meta = None, at: Opt = None, show_expired: bool = False, today: Opt = None) -> DataFrame:
        """(id, content, score, rank, ...) of the user's memories, by a recipe."""
        r = _recipe(recipe)
        threshold = (0.0 if r.hybrid else 0.1) if threshold is None else threshold
        filters.check_search(query, top_k, threshold)
        if self.llm and (r.rewrite or r.hyde):
            query = self.llm(f"Rewrite for search: {query}").strip() or query
        rows = self._mine(user_id)
        rows = rows.filter(filters.compile_filter(where, rows.columns))
        if at:
            rows = rows.filter(filters.valid_at(at))
        if not show_expired:
            rows = rows.filter(filters.not_expired(today or _now()[:10]))
        fetch = max(4 * top_k, 60) if r.hybrid else 5 * top_k
        q = self.spark.createDataFrame([("q", query)], "query_id string, query string")
        vectors = rows.select("id", hash_embed(F.col("content")).alias("vector"))
        qv = q.select("query_id", hash_embed(F.col("query")).alias("query_vector"))
        hits = search.vector_top_k(vectors, qv, fetch, threshold)
        out = hits
        if r.hybrid:
            words = search.top_k(search.bm25(rows.select("id", F.col("content").alias("text")), q), fetch, ["query_id"])
            out = fusion.rrf_weighted(hits, words, self._boosts(query, user_id) if r.entity else None, fetch)
        if r.graph:
            reached = graph.graph_scores(graph.bfs(self._links(), hits.select(F.col("id").alias("seed")), 2)).groupBy("id").agg(F.max("score").alias("score"))
            around = search.top_k(reached.select(F.lit("q").alias("query_id"), "id", "score"), fetch, ["query_id"])
            out = fusion.rrf_graph(around, hits, fetch)
        if r.forgetting:
            out = strength.apply_strength(out.select("query_id", "id", "score"), self.strengths(), _now()[:19].replace("T", " ")).select("query_id", "id", F.col("final_score").alias("score"))
            out = search.top_k(out, fetch, ["query_id"])
        if r.reranker == "mmr":
            out = rerank.mmr(out.select("query_id", "id").join(vectors, "id").join(qv, "query_id"), top_k)
        elif r.reranker == "cross_encoder" and self.scorer:
            out = rerank.rerank_with(out.select("query_id", "id").join(rows.select("id", F.col("content").alias("text")), "id").withColumn("query", F.lit(query)), self.scorer, top_k)
        return out.filter(F.col("rank") < top_k).join(rows.select("id", "content", "metadata", "created_at"), "id").orderBy("rank").drop("query_id")

    def _boosts(self, query: str, user_id: str) -> DataFrame:
        known = self._current("entities").filter(F.col("user_id") == user_id).select("id", "text", hash_embed(F.col("text")).alias("vector"), "linked_memory_ids")
        asked = self.spark.createDataFrame([(t,) for t, *_ in entity.find_entities(query)], "query string").select(F.lit("q").alias("g"), F.monotonically_increasing_id().alias("query_id"), "query", hash_embed(F.col("query")).alias("query_vector"))
        found = entity.search_entities(known, asked).join(known.select("id", "linked_memory_ids"), "id")
        return fusion.entity_boost(found.select(F.lit("q").alias("query_id"), "linked_memory_ids"))

    def strengths(self) -> DataFrame:
        a = self._log("accesses").groupBy("memory_id").agg(F.count("*").alias("access_count"), F.max(F.substring("accessed_at", 1, 19)).cast("timestamp_ntz").alias("last_accessed"))
        return a.select("memory_id", F.lit(1.0).alias("strength"), "access_count", "last_accessed", F.lit(0.5).alias("base_value"), F.lit(False).alias("archived"))

    def log_access(self, memory_ids: Strs, access_type: str = "search", app_id: Opt = None) -> None:
        self._append("accesses", [{"memory_id": i, "app_id": app_id, "access_type": access_type, "accessed_at": _now()} for i in memory_ids])

    # == typed memories

    def add_fact(self, subject, predicate, object, user_id="default", context: Opt = None, confidence: float = 1.0, tags: Strs | None = None) -> str:
        i = f"fact-{uuid.uuid4()}"
        self._append("facts", [{"id": i, "user_id": user_id, "object": object, "subject": subject, "predicate": predicate, "context": context, "confidence": confidence, "provenance": "user", "tags": tags or [], "created_at": _now()}])
        return i

    def add_identity(self, key: str, value: str, user_id: str) -> str:
        return self.add_fact("user", "identity", f"{key}: {value}", user_id, tags=["identity"])

    def facts(self, user_id: str) -> DataFrame:
        return self._current("facts").filter(F.col("user_id") == user_id)

    def get_user_profile(self, user_id: str) -> DataFrame:
        latest = records.current(self._log("facts"), "id", ("seq",), keep_deleted=True).filter(F.col("user_id") == user_id)
        return knowledge.profile(latest, "user_id")

    def resolve_conflicts(self, user_id: str) -> int:
        gone = knowledge.resolve_conflicts(self.facts(user_id).drop("is_deleted")).filter("is_deleted = 1")
        rows = [r.asDict() for r in gone.toLocalIterator()]
        self._append("facts", rows)
        return len(rows)

    def add_episode(self, content: str, user_id: str, event_type: str = "fact", at: Opt = None, **fields: str) -> str:
        i = f"epi-{uuid.uuid4()}"
        self._append("episodes", [{"id": i, "user_id": user_id, "event_type": event_type, "content": content, "reference_time": at or _now(), **fields}])
        return i

    def timeline(self, user_id: str, kinds: Strs | None = None, k: int = 50) -> DataFrame:
        rows = self._current("episodes").filter(F.col("user_id") == user_id)
        return (rows.filter(F.col("event_type").isin(*kinds)) if kinds else rows).orderBy(F.desc("reference_time"), F.desc("id")).limit(k)

    def add_rule(self, rule: str, user_id: str, namespace="default") -> str:
        i = f"rule-{uuid.uuid4()}"
        self._append("rules", [{"id": i, "user_id": user_id, "namespace": namespace, "rule": rule}])
        return i

    def record_rule_outcome(self, rule_id: str, helpful: bool) -> None:
        self._append("rules", [{"id": rule_id, "helpful": helpful}])

    def rules(self, user_id: str, include_deprecated: bool = False) -> DataFrame:
        log = self._log("rules")
        named = log.filter("rule is not null").filter(F.col("user_id") == user_id).select(F.col("id").alias("rule_id"), "rule", "namespace")
        state = knowledge.rule_state(log.filter("helpful is not null").select(F.col("id").alias("rule_id"), "seq", "helpful"))
        out = named.join(state, "rule_id", "left").na.fill({"helpful_count": 0, "harmful_count": 0, "deprecated": False, "confidence": 0.5})
        return out if include_deprecated else out.filter("not deprecated")

    def rules_prompt(self, user_id: str) -> str:
        return knowledge.rules_prompt(self.rules(user_id)).first()["prompt"] or ""

    def add_causal_edge(self, cause: str, effect: str, relation="causes", confidence=0.5, user_id: str = "default") -> None:
        self._append("causal", [{"cause": cause, "effect": effect, "relation": relation, "confidence": confidence, "user_id": user_id}])

    def causal_paths(self, event: str, direction: str = "effects", max_depth: int = 5) -> DataFrame:
        seeds = self.spark.createDataFrame([(event,)], "seed string")
        return graph.causal_paths(self._log("causal"), seeds, direction, max_depth).orderBy(F.desc("confidence"))

    def counterfactual(self, cause: str, effect: str) -> DataFrame:
        return graph.counterfactual(self._log("causal"), self.spark.createDataFrame([(cause, effect)], "cause string, effect string"))

    # == blocks, graph, upkeep

    def set_block(self, agent_id, label, value) -> None:
        self._append("blocks", [{"agent_id": agent_id, "label": label, "value": value[:2000]}])

    def blocks(self, agent_id: str) -> DataFrame:
        rows = self._log("blocks").filter(F.col("agent_id") == agent_id)
        return records.current(rows.withColumn("id", F.col("label")), "id", ("seq",))

    def blocks_xml(self, agent_id: str) -> str:
        row = governance.compile_blocks(self.blocks(agent_id)).first()
        return row["xml"] if row else ""

    def _links(self) -> DataFrame:
        return records.current(self._log("links").withColumn("id", F.concat_ws("|", "source_id", "target_id", "relation")), "id", ("seq",))

    def cognify(self, text: str, user_id: str) -> Answer:
        """Store a text with its entities and their relations, and link it to similar memories."""
        ids = self.add(text, user_id)
        found = entity.find_entities(text)
        have = {r["text"].lower(): r.asDict() for r in self._current("entities").filter(F.col("user_id") == user_id).toLocalIterator()}
        self._append("entities", [
            {"id": have.get(t.lower(), {}).get("id") or f"ent-{uuid.uuid4()}", "user_id": user_id, "text": t, "type": kind, "linked_memory_ids": sorted({*have.get(t.lower(), {}).get("linked_memory_ids", []), *ids})} for t, kind, *_ in found
        ])
        triplets = self.spark.createDataFrame([(text,)], "t string").select(entity.neighbour_triplets(F.col("t"), entity.extract_entities(F.col("t"))).alias("x")).first()["x"]
        self._append("links", [{"source_id": t["source"], "target_id": t["target"], "relation": t["relation"], "score": 1.0} for t in triplets])
        return {"memory_ids": ids, "entities": [t for t, *_ in found], "triplets": [t.asDict() for t in triplets]}

    def link(self, user_id: str) -> int:
        rows = self._mine(user_id).select("id", "user_id", hash_embed(F.col("content")).alias("vector"))
        new = [{"source_id": r["source_id"], "target_id": r["target_id"], "relation": "related_to", "score": r["score"]} for r in evolution.zettel_links(rows, self._links()).toLocalIterator()]
        self._append("links", new)
        return len(new)

    def search_graph(self, seed: str, max_depth: int = 2, direction: str = "out") -> DataFrame:
        reached = graph.graph_scores(graph.bfs(self._links(), self.spark.createDataFrame([(seed,)], "seed string"), max_depth, direction))
        return reached.join(self._current("memories").select("id", "content"), "id", "left").orderBy("depth", "id")

    def reflect(self, user_id: str) -> Strs:
        said = evolution.lessons(self.timeline(user_id, ["reasoning"], 20))
        new = evolution.accept_lessons(said, self.rules(user_id)).orderBy("source_id", "pos").collect()
        return [self.add_rule(r["statement"], user_id, "reflection") for r in new]

    def route(self, query: str) -> Strs:
        q = self.spark.createDataFrame([("q", query)], "query_id string, query string")
        return [r["namespace"] for r in routing.route(q).orderBy("rank").collect()]

    # == orchestration

    def remember(self, text: str, user_id: str, agent_id: Opt = None) -> dict[str, Any]:
        """Redact, skip what is stored already, store, and log the raw text as an episode."""
        clean = self.spark.createDataFrame([(text.strip(),)], "t string").select(tx.redact(F.col("t"))).first()[0]
        if not clean or not self._mine(user_id).filter(F.col("content") == clean).isEmpty():
            return {"captured": False, "raw_id": None, "memory_ids": []}
        ids = self.add(clean, user_id, agent_id)
        raw = self.add_episode(clean, user_id, "raw_log")
        if agent_id:
            old = self.blocks(agent_id).filter("label = 'human'").first()
            self.set_block(agent_id, "human", f"{old['value']}\n{clean}"[-2000:] if old and old["value"] else clean)
        return {"captured": True, "raw_id": raw, "memory_ids": ids}

    def recall(self, query: str, user_id: str, top_k: int = 7, budget: int = 2000, agent_id: Opt = None) -> dict[str, Any]:
        hits = self.search(query, user_id, 4 * top_k, recipe="FORGETTING")
        rows = hits.select(F.lit("q").alias("query_id"), "id", "score", F.col("content").alias("text"))
        fit = rerank.token_budget(rows, budget).filter(F.col("pos") < top_k).join(rows.drop("query_id"), "id").orderBy("pos").collect()
        self.log_access([r["id"] for r in fit])
        prompt = "\n".join(x for x in (self.blocks_xml(agent_id) if agent_id else "", self.rules_prompt(user_id)) if x)
        return {"memories": [r.asDict() for r in fit], "injected_prompt": prompt, "route": self.route(query), "used_tokens": fit[0]["used_tokens"] if fit else 0}

    def forget(self, memory_id: str) -> dict[str, Any]:
        found = self.invalidate(memory_id) and self.delete(memory_id)
        gone = self._links().filter((F.col("source_id") == memory_id) | (F.col("target_id") == memory_id))
        self._append("links", [{k: v for k, v in r.asDict().items() if k != "id"} | {"is_deleted": 1} for r in gone.toLocalIterator()])
        return {"event": "FORGET", "id": memory_id, "found": found}

    def improve(self, user_id: str) -> dict[str, int]:
        return {"links": self.link(user_id), "rules": len(self.reflect(user_id)), "conflicts": self.resolve_conflicts(user_id)}

    def reset(self) -> None:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(fs_path, True)
