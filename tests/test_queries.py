import os

import duckdb
import pytest

from specloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "part orders lineitem events documents embeddings labels conversations customer".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def norm(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.SQL:
        assert got
        return
    r = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    want = sorted((tuple(norm(row[names.index(c)]) for c in columns) for row in r.fetchall()), key=repr)
    assert got == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_the_pool_scores_all_pairs(spark):
    pairs = {(r.target_id, r.id) for r in catalogue.QUERIES["j5_formula_pairs"](spark, DATA).collect()}
    for name in ("t1_group_jaccard", "t6_tanimoto"):
        assert {(r.target_id, r.id) for r in catalogue.QUERIES[name](spark, DATA).collect()} == pairs
    assert {(r.target_id, r.id) for r in catalogue.QUERIES["w7_stable_pool"](spark, DATA).collect()} < pairs


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_all_checks_of_rules_run(spark):
    """Four checks at most without those of fragments; some candidates have more, and all labels are offered."""
    found = {(r.applicable, r.satisfied) for r in catalogue.QUERIES["r10_validation"](spark, DATA).collect()}
    assert max(a for a, _ in found) > 4 and any(0 < s < a for a, s in found)
    assert catalogue.QUERIES["r11_group_support"](spark, DATA).select("label").distinct().count() == 12
