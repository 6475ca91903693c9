"""Reranking of candidate lists: MMR, metadata boosts, token budgets, pair scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import estimate_tokens, parse_score
from recollect.operators.search import top_k

MMR_LAMBDA, DUPLICATE = 0.7, 0.9


def mmr(candidates: DataFrame, k: int = 5, weight: float = MMR_LAMBDA, duplicate: float = DUPLICATE) -> DataFrame:
    """Maximal marginal relevance, per query: (query_id, id, score, rank) in order of selection.

    Candidates are (query_id, id, vector, query_vector). The next one has the best
    ``weight`` times similarity to the query less the rest times similarity to
    what is selected; after each, candidates more similar to it than ``duplicate``
    go. Selection is sequential, so each query's (few) candidates go to one task.
    """

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        v = unit(np.array(pdf["vector"].tolist(), dtype=float))
        near = v @ unit(np.array([pdf["query_vector"].iloc[0]], dtype=float))[0]
        like = v @ v.T
        left, chosen = list(range(len(pdf))), []
        while left and len(chosen) < k:
            value = [round(weight * near[i] - (1 - weight) * (max(like[i, j] for j in chosen) if chosen else 0.0), 9) for i in left]
            pick = left[int(np.argmax(value))]
            chosen.append(pick)
            left = [i for i in left if i != pick and like[i, pick] <= duplicate]
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[chosen].to_numpy(), "id": pdf["id"].iloc[chosen].to_numpy(), "score": np.round(near[chosen], 9), "rank": np.arange(len(chosen))})

    kinds = dict(candidates.dtypes)
    return candidates.groupBy("query_id").applyInPandas(select, f"query_id {kinds['query_id']}, id {kinds['id']}, score double, rank long")


def metadata_boost(score: Column, metadata: Column, wanted: dict[str, object], weights: dict[str, float] | None = None) -> Column:
    """``score`` times 1 + weight for each wanted value that the metadata has, never above 1; of a list one value is enough."""
    out = score
    for key, weight in (weights or dict(tags=0.2, session_id=0.3, user_id=0.5)).items():
        if key not in wanted:
            continue
        values = wanted[key] if isinstance(wanted[key], (list, tuple)) else [wanted[key]]
        have = F.get_json_object(metadata, f"$.{key}")
        listed = F.from_json(have, "array<string>")
        hit = F.coalesce(F.when(have.startswith("["), F.arrays_overlap(listed, F.array(*[F.lit(str(v)) for v in values]))).otherwise(have.isin(*[str(v) for v in values])), F.lit(False))
        out = F.when(hit, F.least(F.lit(1.0), out * (1 + weight))).otherwise(out)
    return out


def single_turn(messages: DataFrame, scores: Column, k: int) -> DataFrame:
    """Conversations by the best score of their pairs of turns."""
    pairs = messages.groupBy("conv_id", F.floor(F.col("turn") / 2).alias("pair")).agg(F.max(scores).alias("score"))
    best = pairs.groupBy("conv_id").agg(F.round(F.max("score"), 9).alias("score"))
    return best.orderBy(F.desc("score"), "conv_id").limit(k)


def token_budget(rows: DataFrame, budget: int = 2000, by: str = "query_id", text: str = "text") -> DataFrame:
    """Rows of each list, best first, as long as they fit; one that doesn't fit is skipped and the next is tried.

    The order matters, so each list is folded in an array, in the JVM.
    """
    item = F.struct((-F.col("score")).alias("order"), F.col("id"), F.col("score"), estimate_tokens(F.col(text)).alias("tokens"))
    sorted_ = F.array_sort(F.collect_list(item))
    kind = f"struct<used:bigint,ids:array<{dict(rows.dtypes)['id']}>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{dict(rows.dtypes)['id']}>").alias("ids"))
    fold = F.aggregate(sorted_, start.cast(kind), lambda s, x: F.when(s["used"] + x["tokens"] <= budget, F.struct((s["used"] + x["tokens"]).alias("used"), F.array_append(s["ids"], x["id"]).alias("ids"))).otherwise(s))
    return rows.groupBy(by).agg(fold.alias("f")).select(by, F.col("f.used").alias("used_tokens"), F.posexplode("f.ids").alias("pos", "id")).select(by, "id", F.col("pos").cast("long").alias("pos"), "used_tokens")


def passthrough(rows: DataFrame, k: int) -> DataFrame:
    return top_k(rows, k, ["query_id"])


def rerank_with(rows: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]], k: int) -> DataFrame:
    """Any pair scorer (cross-encoder, model, service) over (query, text), Arrow batch by batch; answers are kept to [0, 1]."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = scorer(list(zip(pdf["query"], pdf["text"])))
            yield pd.DataFrame({"query_id": pdf["query_id"], "id": pdf["id"], "score": np.clip(np.asarray(s, dtype=float), 0, 1)})

    return top_k(rows.mapInPandas(run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double"), k, ["query_id"])


def rerank_answers(rows: DataFrame, answer: str = "answer", k: int = 5) -> DataFrame:
    """Rank by the numbers in a model's answers; 0.5 where there is none."""
    return top_k(rows.withColumn("score", parse_score(F.col(answer))), k, ["query_id"])


def dedupe_by_id(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "id").orderBy(F.desc("score"))
    return top_k(rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r"), k, ["query_id"])
