from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from compare import compare, connection
from conftest import SF
from plantweave.plans import catalogue, problems, stages

ALL = {**catalogue.QUERIES, **problems.QUERIES, **stages.QUERIES}
SQL = {**catalogue.SQL, **problems.SQL, **stages.SQL}
EMPTY = {"compose_members", "residual_selection"}


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", [*ALL])
def test_query_equals_sql(spark, duck, name):
    n, m, wrong, _ = compare(spark, SF, name, ALL[name], SQL.get(name), duck)
    assert wrong is None
    assert n > 0 or name in EMPTY


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pipeline(spark):
    from plantweave.plans.pipeline import resolve
    from plantweave.session import table

    out = resolve(table(spark, SF, "build_data"), table(spark, SF, "candidate_index"), table(spark, SF, "bnetza_lookup"))
    assert out.final.count() == out.entries.count() > 0
    assert out.final.filter("matched_id IS NOT NULL").count() > 0


def test_core_does_not_import_llm():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "plantweave"
    for path in root.rglob("*.py"):
        if path.parent.name != "llm":
            assert not re.search(r"(from|import) \S*llm", path.read_text()), path
