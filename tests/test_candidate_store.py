"""Stored candidates: the same rows, and plans without an exchange or a sort."""

import pytest

from specloom.operators import ingest
from specloom.sources.candidate_store import CandidateStore

COLUMNS = "mol_key string, nucleus string, score int, row_index long, solvent string"


@pytest.fixture(scope="module")
def found(spark):
    """A third of the rows are of one molecule; ties of score, null keys and null scores."""
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else None if i % 101 == 1 else f"m{i * 7 % 400}"
        rows.append((key, "1h" if (i // 3) % 2 else "13c", None if i % 53 == 2 else i * 7 % 5, i, ("CDCl3", "", "not_known", "D2O")[i % 4]))
    return spark.createDataFrame(rows, COLUMNS)


def same(a, b):
    return sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("work", [ingest.paired_keys, ingest.top_candidates, ingest.best_pairs])
def test_stored_candidates_are_neither_shuffled_nor_sorted(spark, tmp_path, found, work):
    store = CandidateStore(spark, str(tmp_path / "c"), 8).write(found)
    got = work(CandidateStore(spark, str(tmp_path / "c"), 8).rows())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort " not in plan and "Bucketed: true" in plan
    assert same(got, work(found)) and got.count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("specloom_")] and store.rows().count() == 3000


def test_a_store_is_replaced_and_reset(spark, tmp_path, found):
    store = CandidateStore(spark, str(tmp_path / "c"), 4).write(found)
    store.write(found.limit(10))
    assert store.rows().count() == 10
    store.reset()
    assert store.rows().count() == 0 and store.rows().columns == [*found.columns, "falling"]
    assert ingest.best_pairs(store.rows()).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        CandidateStore(spark, str(tmp_path / "c"), 5).rows()
