"""The driver's contract, with or without the training-data subpackage."""

import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100 and all(map(callable, queries.values()))


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "recollect").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "recollect.llm" not in path.read_text(), path


def test_no_local_checkpoints_and_no_rdds():
    for path in (ROOT / "recollect").rglob("*.py"):
        text = path.read_text()
        assert not re.search(r"localCheckpoint|\.rdd\b|parallelize\(", text), path


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"query_id", "id", "score", "rank"} <= set(df.columns)
