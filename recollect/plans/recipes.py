"""Named search set-ups."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Recipe:
    hybrid: bool = True
    entity: bool = False
    reranker: str = "noop"
    explain: bool = False
    graph: bool = False
    progressive: bool = False
    forgetting: bool = False
    hyde: bool = False
    rewrite: bool = False


RECIPES: dict[str, Recipe] = {
    "HYBRID_RRF": Recipe(),
    "HYBRID_RRF_ENTITY": Recipe(entity=True, explain=True),
    "HYBRID_RRF_CROSS_ENCODER": Recipe(reranker="cross_encoder"),
    "HYBRID_RRF_MMR": Recipe(reranker="mmr"),
    "GRAPH_BFS": Recipe(hybrid=False, graph=True),
    "PROGRESSIVE": Recipe(progressive=True, reranker="mmr"),
    "FORGETTING": Recipe(forgetting=True),
    "OPTIMAL": Recipe(reranker="cross_encoder", explain=True, hyde=True, rewrite=True),
}


def recipe(name: str, **changes: object) -> Recipe:
    if name.upper() not in RECIPES:
        raise ValueError(f"unknown recipe: {name}")
    return replace(RECIPES[name.upper()], **changes)
