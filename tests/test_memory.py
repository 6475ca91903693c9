"""The store's calls, end to end."""

import pytest

from recollect.plans.memory import Memory


@pytest.fixture
def memory(spark, tmp_path):
    return Memory(spark, f"{tmp_path}/store")


def test_preferences_are_recalled(memory):
    said = ["Alice likes dark roast coffee", "Alice prefers trains over planes", "Alice works with Python daily", "Alice plays the cello", "Alice lives in Lisbon"]
    asked = ["coffee roast", "trains or planes", "Python work", "cello plays", "lives Lisbon"]
    memory.add([dict(content=t, role="user") for t in [*said, said[0]]], "alice")
    assert memory.get_all("alice").count() == 5 and memory.get_all("bob").count() == 0
    hits = [said[i] in [r["content"] for r in memory.search(q, "alice", 3, 0.01).collect()] for i, q in enumerate(asked)]
    assert sum(hits) >= 4


def test_life_of_a_memory(memory):
    i, j = memory.add("first text", "u", agent_id="a1", metadata={"k": "1"}), memory.add("second text", "u", agent_id="a2", valid_at="2025-01-01")
    assert memory.update(i[0], "first changed", {"m": "2"}) and not memory.update("nothing", "x")
    row = memory.get(i[0]).first()
    assert row["content"] == "first changed" and '"k": "1"' in row["metadata"] and '"m": "2"' in row["metadata"]
    assert memory.list_agents("u") == ["a1", "a2"] and memory.list_users() == ["u"]
    assert {r["id"] for r in memory.search("text", "u", at="2024-06-01").collect()} == {i[0]}
    assert memory.invalidate(j[0], "2026-01-01") and memory.delete(j[0]) and not memory.delete(j[0])
    assert [r["event"] for r in memory.get_history(j[0]).collect()] == ["ADD", "INVALIDATE", "DELETE"]
    assert memory.delete_all("u") == 1 and memory.get_all("u").count() == 0
    memory.reset()
    assert memory.list_users() == []


def test_typed_memories(memory):
    memory.add("name is Alice", "u", memory_type="fact")
    memory.add_fact("user", "likes", "tea", "u")
    memory.add_fact("user", "likes", "coffee", "u")
    assert {r["predicate"]: r["current"] for r in memory.get_user_profile("u").collect()} == {"name": "Alice", "likes": "coffee"}
    assert memory.resolve_conflicts("u") == 1 and memory.facts("u").count() == 2
    rule = memory.add_rule("check twice", "u")
    for ok in (True, False, False, False):
        memory.record_rule_outcome(rule, ok)
    assert memory.rules("u").count() == 0 and memory.rules("u", True).first()["deprecated"]
    memory.add_causal_edge("A", "B", confidence=0.9)
    memory.add_causal_edge("B", "C", confidence=0.8)
    assert memory.causal_paths("A").first()["confidence"] == 0.72 and memory.counterfactual("A", "B").first()["would_happen"] is False
    memory.add_episode("it ran", "u", "reasoning", thoughts="small steps are safe", action="ran it again slowly")
    assert len(memory.reflect("u")) == 2 and memory.reflect("u") == [] and memory.timeline("u").count() == 1


def test_graph_and_orchestration(memory):
    got = memory.cognify("Alice works at Google", "u")
    assert got["entities"] == ["Alice", "Google"] and got["triplets"][0]["relation"] == "works_at"
    assert [r["id"] for r in memory.search_graph("Alice").collect()] == ["Google"]
    done = memory.remember("my password: hunter2 is secret", "u", "agent")
    assert done["captured"] and not memory.remember("my password: hunter2 is secret", "u")["captured"]
    assert "hunter2" not in memory.get(done["memory_ids"][0]).first()["content"] and "hunter2" not in memory.blocks_xml("agent")
    out = memory.recall("password secret", "u", agent_id="agent")
    assert out["memories"] and out["used_tokens"] > 0 and "<human>" in out["injected_prompt"] and out["route"]
    assert memory.search("works Google", "u", recipe="HYBRID_RRF_ENTITY").first()["entity_boost"] > 0
    assert memory.forget(done["memory_ids"][0])["found"] and not memory.forget("nothing")["found"]
    for name in ("HYBRID_RRF_MMR", "GRAPH_BFS", "FORGETTING"):
        assert memory.search("Alice Google", "u", recipe=name).count() == 1
    assert memory.improve("u") == {"links": 0, "rules": 0, "conflicts": 0}
