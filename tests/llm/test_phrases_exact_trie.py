import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.llm import collocation, common, exact, queries, spread, sql, trie


def best_phrases(rows, least=30, top=2000, share=80):
    """op11 by plain counting."""
    f, n = defaultdict(Counter), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for p in re.split("[.,;:!?\x0a-\x0d]", t):
            w = re.findall("[^\x20\x09]+", p)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + d]) for d in range(1, 5) for i in range(len(w) - d + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= share * c[p[i : i + k]]}
        best = []
        for p in found.keys() - inside:
            score, k = min((2000000 * c[p] // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -c[p], " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def whole_trie(rows):
    """op13 by sequences in memory."""
    turns, members, ends = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append((t is not None, t or 0, r, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest(), x))
    own = {c: [(v[2], v[4]) for v in sorted(x)] for c, x in turns.items()}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        s = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items())


def trie_rows(df):
    found = trie.nodes(df).collect()
    every = sorted((r.position, r.subtree_end) for r in found)
    assert [p for p, _ in every] == list(range(1, len(found) + 1))
    assert all(p <= e <= len(found) for p, e in every)
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:8]) for r in found)


def phrase_rows(df, **options):
    return sorted(map(tuple, collocation.collocations(df, **options).collect()))


@pytest.mark.parametrize("name", ["op11_phrases", "op12_exact", "op13_trie"])
def test_queries_equal_sql(spark, data, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    got = queries.QUERIES[name](spark, data)
    want = c.execute(sql.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_phrases_of_odd_tables(spark, odd, none):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert phrase_rows(odd) == best_phrases(rows) != []
    assert phrase_rows(none) == []


def test_phrases_of_many_ranges_and_shards(spark, monkeypatch):
    """Phrases on the bounds of ranges, a hot prefix, slices of one text, flushes inside a piece, and ties."""
    draw = random.Random(5)
    words = ["a", "B", "ab", "É", "né", "é", "zz", "c\x0b", "d.", "e ,", "\t", "a", "a"]
    rows = [(draw.choice(["x", "y", None]), " ".join(draw.choices(words, k=draw.choice([0, 1, 5, 60])))) for _ in range(300)]
    rows += [("x", None), ("x", ""), ("x", " ".join(draw.choices(words, k=6000))), ("y", "a " * 5000), ("z", "a" * 3000 + " b" * 100)]
    for name, value in {"SHARD": 700, "RANGE": 40, "SLICE": 150, "TEXTS": 1000}.items():
        monkeypatch.setattr(collocation, name, value)
    monkeypatch.setattr(spread, "LEAST", 3)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert phrase_rows(df, least=5) == best_phrases(rows, least=5)
    assert phrase_rows(df, least=3, top=4, share=50) == best_phrases(rows, least=3, top=4, share=50)


def test_scores_of_counts_beyond_64_bits(spark):
    big = 10**13
    found = spark.createDataFrame([("x", "p", 1, big + 7, [], True), ("x", "q", 1, big, [], True), ("x", "p q", 2, big - 1, [big + 7], True)], "lang string, phrase string, size int, a long, lefts array<long>, whole boolean")
    row = collocation._scored(found, 30, 3).first()
    assert row.score == 2000000 * (big - 1) // (2 * big + 7) and (row.l, row.r) == (big + 7, big)


def filter_of(values, counts, bits=0):
    return exact.decode(exact.encode(np.asarray(values, np.uint64), np.asarray(counts, np.int64), bits), values[0] >> (64 - bits) if bits else 0)


def test_quotient_filter_is_lossless():
    draw = random.Random(1)
    for bits in (0, 4, 13):
        top = draw.getrandbits(bits) << (64 - bits) if bits else 0
        for n in (1, 2, 3, 50, 3000):
            some = {top | draw.getrandbits(64 - bits) for _ in range(n)} | {top | k for k in range(min(n, 40))} | {top | (1 << 64 - bits) - 1}
            values = sorted(some)
            counts = [draw.choice([1, 1, 2, 3, 70_000, 1 << 40, (1 << 62) + 5]) for _ in values]
            got = filter_of(values, counts, bits)
            assert got[0].tolist() == values and got[1].tolist() == counts


def test_filters_merge_by_partition(spark, monkeypatch):
    monkeypatch.setattr(exact, "FLUSH", 100)
    draw = random.Random(2)
    values = [draw.getrandbits(64) - (1 << 63) for _ in range(400)] + [5] * 700 + [-1, -1, None, 0]
    draw.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "fp long").repartition(6)
    parts = exact.filters(df, 3)
    whole = exact.merged(parts)
    assert parts.count() > whole.count() == whole.select("range").distinct().count() <= 8
    assert {(r.fp, r.n) for r in exact.repeated(whole).collect()} == {(v, n) for v, n in Counter(values).items() if n > 1 and v is not None}
    twice = exact.repeated(exact.merged(whole.unionByName(whole)))
    assert {(r.fp, r.n) for r in twice.collect()} == {(v, 2 * n) for v, n in Counter(values).items() if v is not None}


def groups(rows):
    norm = [re.sub("[ \t-\r]+", " ", t or "") for _, t in rows]
    first = {}
    for (i, _), t in zip(rows, norm, strict=True):
        first[t] = min(first.get(t, math.inf), math.inf if i is None else i)
    size = Counter(norm)
    return Counter((i, None if first[t] == math.inf else first[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm, strict=True))


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, odd, none, monkeypatch, weak):
    """Hot copies, null and repeated ids, blanks, and fingerprints that many texts share."""
    monkeypatch.setattr(spread, "LEAST", 4)
    monkeypatch.setattr(spread, "HOT", 50)
    rows = [(i, "hot  text") for i in range(40)] + [(i, f"t {i % 30}\n") for i in range(60)] + [(i, f"t\x0b{i % 30}\t ") for i in range(5)]
    rows += [(None, "nobody"), (None, "nobody"), (7, "same"), (7, "same"), (7, "a\xa0b"), (8, "a b"), (9, ""), (10, None), (None, " "), (11, "\r\n"), (12, "x" * 100_000)]
    options = {"fingerprint": lambda c: F.pmod(F.xxhash64(c), F.lit(3))} if weak else {}
    got = exact.decisions(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **options).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == groups(rows)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept) and len(kept) == len({r.text_sha256 for r in kept}) == len({r.text_sha256 for r in got})
    assert exact.decisions(none).collect() == [] and exact.keep_first(none).collect() == []
    left = exact.keep_first(odd, **options)
    assert left.columns == odd.columns and left.count() == 4


def test_hot_join_keeps_all_rows(spark):
    rows = spark.range(3000).select((F.col("id") % 3 * F.col("id")).alias("k"), "id")
    right = common.cut(rows.groupBy("k").count().where("k % 2 = 0"), "right")
    got = spread.spread_join(rows, right, ["k"], n="count", total=3000, how="left", least=10)
    assert got.count() == 3000 and got.where("count is null").count() == rows.where("k % 2 = 1").count()
    assert got.select("id").distinct().count() == 3000 and got.where("k = 0").select("count").distinct().collect()[0][0] == 1000


def test_running_sums_over_ranges(spark):
    rows = [(0, k) for k in range(500)] + [(g, k) for g in range(1, 40) for k in range(3)]
    df = spark.createDataFrame(rows, "g long, v long").repartition(5)
    got = spread.running(df, ["g", "v"], ["v"], "t").collect()
    order = sorted(rows)
    sums = np.cumsum([v for _, v in order]).tolist()
    assert {(r.g, r.v): r.sum_v for r in got} == dict(zip(order, sums, strict=True))
    within = spread.running(df, ["g", "v"], ["v"], "t", group="g").collect()
    assert all(r.sum_v == r.v * (r.v + 1) // 2 for r in within) and len(within) == len(rows)


def test_trie_of_odd_conversations(spark, monkeypatch):
    """Long conversations in many blocks, copies, prefixes of one another, turnless ones, nulls and ties."""
    draw = random.Random(3)
    rows = [(c, draw.choice([None, *range(30)]), draw.choice(["a", "b", None]), draw.choice(["", "x", None, "é"])) for c in [*range(-7, 60), None] for _ in range(draw.choice([0, 1, 2, 3, 9, 20]))]
    rows += [(c, k, "u", "y" * (k % 3)) for c, n in ((200, 40), (205, 37), (210, 32), (215, 16)) for k in range(n)] + [(207, k, "u", "q") for k in range(4)]
    for target, name, value in ((trie, "BLOCK", 4), (trie, "SLICE", 3), (spread, "LEAST", 5), (spread, "HOT", 50)):
        monkeypatch.setattr(target, name, value)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit("z"), "node": F.lit(1)})
    assert trie_rows(df) == whole_trie(rows)
    assert trie_rows(df.limit(0)) == []
