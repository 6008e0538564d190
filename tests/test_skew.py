"""Operators over tables in which one key holds a third of all rows, against plain Python."""

import hashlib
import random
from fractions import Fraction
from itertools import groupby

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specloom.operators import manifest, negatives, order


def sha(*parts):
    return hashlib.sha256(":".join("" if p is None else str(p) for p in parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def molecules():
    """id, canonical_smiles, murcko_scaffold, qc_status: a third of the rows share a scaffold, and a third a structure."""
    rng = random.Random(8)
    rows = []
    for i in range(900):
        scaffold = "hot" if i % 3 == 0 else f"s{rng.randrange(250)}"
        smiles = "same" if i % 3 == 1 else f"m{rng.randrange(400)}"
        rows.append((f"id{i}", smiles, scaffold, "fail" if i % 17 == 0 else "pass"))
    return rows


@pytest.fixture(scope="module")
def table(spark, molecules):
    return spark.createDataFrame(molecules, "id string, canonical_smiles string, murcko_scaffold string, qc_status string").withColumn("split", F.lit("old"))


def brute_splits(rows):
    own = {}
    for _, _, s, status in rows:
        if status == "pass":
            own[s] = own.get(s, 0) + 1
    total = sum(own.values())
    named, before, trained = {}, 0, 0
    for s, n in sorted(own.items(), key=lambda x: (-x[1], sha(3407, x[0]))):
        named[s] = "train" if before < total * 8 // 10 else "val" if before - trained < total // 10 else "test"
        trained += n if named[s] == "train" else 0
        before += n
    return named


def test_scaffold_splits(table, molecules):
    got = {r.id: r.split for r in manifest.scaffold_splits(table).collect()}
    named = brute_splits(molecules)
    assert got == {i: named[s] if status == "pass" else "excluded" for i, _, s, status in molecules}
    assert {"train", "val", "test"} == set(named.values())


@pytest.mark.parametrize("by", [None, "qc_status"])
def test_balanced_order(table, molecules, by):
    got = {r.id: (r.turn, r.position) for r in manifest.balanced_order(table, by=by).collect()}
    want = {}
    for part in [molecules] if by is None else [[m for m in molecules if m[3] == x] for x in ("pass", "fail")]:
        turns = []
        for s, own in groupby(sorted(part, key=lambda m: (m[2], sha(3407, m[0]), m[0])), key=lambda m: m[2]):
            turns += [(k, sha(3407, s), m[0]) for k, m in enumerate(own, 1)]
        want |= {i: (turn, place) for place, (turn, _, i) in enumerate(sorted(turns), 1)}
    assert got == want


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_grouped_splits(table, molecules, block, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK", block)
    got = {r.id: r.split for r in manifest.grouped_splits(table).collect()}
    own = {}
    for _, m, _, _ in molecules:
        own[m] = own.get(m, 0) + 1
    done, named = {"val": 0, "test": 0}, {}
    for m in sorted(own, key=lambda m: sha(3407, m)):
        split = "val" if done["val"] <= done["test"] else "test"
        named[m] = split if done[split] < 90 else "train"
        if named[m] != "train":
            done[split] += own[m]
    assert got == {i: named[m] for i, m, _, _ in molecules} and len(set(named.values())) == 3
    none = manifest.grouped_splits(table.where("false"))
    assert none.count() == 0 and none.columns == [*(c for c in table.columns if c != "split"), "split"]


def brute_groups(sizes, val, test):
    """Splits by the shares as fractions, and the rows of val and of all before each group while both are open."""
    done, named, path = {"val": 0, "test": 0}, [], []
    for n in sizes:
        if done["val"] < val and done["test"] < test:
            path.append((done["val"], done["val"] + done["test"]))
        split = min(("val", "test"), key=lambda s: (Fraction(done[s], (val, test)[s == "test"]) if (val, test)[s == "test"] else 1, done[s]))
        named.append(split if done[split] < (val, test)[split == "test"] else "train")
        if named[-1] != "train":
            done[split] += n
    return named, path


@given(st.lists(st.one_of(st.integers(1, 3), st.integers(1, 60)), min_size=1, max_size=120), st.integers(1, 150), st.integers(1, 150), st.integers(0, 60))
@settings(max_examples=300, deadline=None)
def test_a_block_is_a_function_of_what_val_holds(sizes, val, test, head):
    """Each number that val can hold before the second block goes where a fold of the second block takes it."""
    first, second = sizes[:head], sizes[head:]
    before, widest = sum(first), max(first, default=0)
    pieces = manifest.transitions(second, before, widest, val, test)
    assert len(pieces) <= 2 * len(second) + 3 and all(a[1] < b[0] for a, b in zip(pieces, pieces[1:], strict=False))
    for low, high, filled, flat, at in pieces:
        for v in {low, high, (low + high) // 2}:
            own, s = v, before
            for n in second:
                if own >= val or s - own >= test:
                    break
                a, b = Fraction(own, val), Fraction(s - own, test)
                own, s = (own + n if (a, own) <= (b, s - own) else own), s + n
            over = own >= val or s - own >= test
            assert (filled + (0 if flat else v - low), at) == (own, s if over else None)
    path = brute_groups(sizes, val, test)[1]
    if len(path) > head:  # both still open: the true number is among those of the pieces
        assert any(p[0] <= path[head][0] <= p[1] for p in pieces) or not second


@pytest.mark.parametrize(("block", "val", "test", "hot"), [(30, 0.1, 0.1, 1), (30, 0.3, 0.05, 1), (500, 0.2, 0.0, 1), (20, 0.0, 0.2, 9), (20, 0.25, 0.35, 60), (20, 0.0, 0.0, 1)])
def test_grouped_splits_in_many_blocks(spark, monkeypatch, block, val, test, hot):
    monkeypatch.setattr(manifest, "BLOCK", block)
    sizes = {f"m{k}": 1 + (k * k) % 4 + (hot * 5 if k % 97 == 3 else 0) for k in range(500)}
    ids = [(f"{m}-{i}", m) for m, n in sizes.items() for i in range(n)]
    order = sorted(sizes, key=lambda m: sha(3407, m))
    named, _ = brute_groups([sizes[m] for m in order], round(len(ids) * val), round(len(ids) * test))
    want = dict(zip(order, named, strict=True))
    got = manifest.grouped_splits(spark.createDataFrame(ids, "id string, canonical_smiles string"), val_fraction=val, test_fraction=test)
    assert {r.id: r.split for r in got.collect()} == {i: want[m] for i, m in ids}


def test_jobs_of_grouped_splits_do_not_follow_the_blocks(table, spark, monkeypatch):
    def jobs(block):
        monkeypatch.setattr(manifest, "BLOCK", block)
        spark.sparkContext.setJobGroup(f"blocks-{block}", "")
        manifest.grouped_splits(table)
        found = spark.sparkContext.statusTracker().getJobIdsForGroup(f"blocks-{block}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(found)

    assert abs(jobs(5) - jobs(1_000_000)) <= 2


def test_pools_of_a_common_formula(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    rows = [(f"i{k}", f"m{k % 130}", "hot" if k % 3 else f"f{k % 7}") for k in range(300)]
    got = {(r.target_id, r.id) for r in negatives.formula_pairs(spark.createDataFrame(rows, "id string, smiles string, formula string"), pool=5).collect()}
    first = {}
    for i, s, f in sorted(rows):
        first.setdefault((f, s), i)
    want = set()
    for i, s, f in rows:
        others = [x for (g, t), x in first.items() if g == f and t != s]
        want |= {(i, x) for x in sorted(others, key=lambda x: (sha(3407, i, x), x))[:5]}
    assert got == want


def test_places_with_null_keys(spark):
    rows = spark.createDataFrame([(None, i) for i in range(50)] + [("a", i) for i in range(20)], "k string, i int").withColumn("h", F.sha2(F.col("i").cast("string"), 256))
    got = sorted((str(r.k), r.h, r.place) for r in order.place_by_hash(rows, ["k"], "h", "i").collect())
    assert [p for _, _, p in got] == [*range(1, 51), *range(1, 21)] or [p for _, _, p in got] == [*range(1, 21), *range(1, 51)]


def test_pools_need_no_rank_below_their_size(spark):
    """Where each target takes all structures of its formula in one block, pairs are neither sorted nor ranked; facts of a few
    structures are broadcast, so that the pairs don't move."""
    rows = spark.createDataFrame([(f"i{k}", f"m{k % 40}", f"f{k % 2}") for k in range(300)], "id string, smiles string, formula string")
    facts = spark.createDataFrame([(f"m{k}", "", ["a"], [k]) for k in range(40)], "smiles string, ring_scaffold string, groups array<string>, bits array<int>")
    found = negatives.scored(negatives.formula_pairs(rows, pool=512), facts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("BroadcastHashJoin") >= 4 and found.count() == 300 * 19


@pytest.mark.parametrize("block", [16, 4096])
def test_pools_of_repeated_ids(spark, monkeypatch, block):
    """Rows of one id share its pool, as in SQL's window over the id; a pool as large as the list keeps all."""
    monkeypatch.setattr(negatives, "BLOCK", block)
    rows = [(f"i{k % 50}", f"m{k % 30}", "f" if k % 4 else "g") for k in range(120)]
    unique = {}
    for i, s, f in sorted(rows):
        unique.setdefault((f, s), i)
    pairs = sorted((sha(3407, i, x), i, x) for i, s, f in rows for (g, t), x in unique.items() if g == f and t != s)
    seen, want = {}, []
    for _, i, x in pairs:
        seen[i] = seen.get(i, 0) + 1
        if seen[i] <= 25:
            want.append((i, x))
    got = negatives.formula_pairs(spark.createDataFrame(rows, "id string, smiles string, formula string"), pool=25).collect()
    assert sorted((r.target_id, r.id) for r in got) == sorted(want)
