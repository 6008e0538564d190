import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from specloom.llm import jaccard, linededup, queries, textkit


def shingles(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute_classes(docs):
    sets = {i: shingles(t) for i, t in docs}
    label, links = {i: i for i in sets}, dict.fromkeys(sets, 0)
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in sets:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (label[i], links[i]) for i in sets}


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 30)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs.append(" ".join(text))
        docs.append("")
    return list(enumerate(docs))


def test_join_equals_brute_force(spark, copies, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 4)  # large groups go through pairs of blocks
    rows = spark.createDataFrame(copies, "doc_id long, text string")
    got = jaccard.similar(rows).collect()
    want = brute_classes(copies)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == want
    assert sum(r.keeper for r in got) == len({c for c, _ in want.values()})
    kept = jaccard.keep_one(rows).collect()
    assert {r.doc_id for r in kept} == {c for c, _ in want.values()}


def test_links_count_once_in_blocks_by_grams(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 40)  # few members make several blocks, of which some stay empty
    rng = random.Random(7)
    docs = []
    for g in range(24):
        base = [f"g{g}x{rng.randrange(10**6)}" for _ in range(60)]
        docs += [" ".join(base), " ".join([*base[:-1], "end"]), " ".join(["begin", *base[1:]])][: 2 + g % 2]
    docs = list(enumerate(docs))
    got = jaccard.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute_classes(docs)


def test_long_words_make_no_false_link(spark):
    docs = []
    for n in (1024, 4096):
        a = "a"
        while len(a) < n:
            a += a.translate(str.maketrans("ab", "ba"))
        docs += [a, a.translate(str.maketrans("ab", "ba"))]
    got = jaccard.similar(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(i, i, 0) for i in range(4)}


def test_join_of_odd_rows(odd, none):
    got = jaccard.similar(odd).collect()
    assert len(got) == 6
    assert {(r.doc_id, r.class_id) for r in got if r.doc_id in (1, 2)} == {(1, 1), (2, 1)}
    assert [r.n_links for r in got if r.doc_id == 3] == [1, 1]
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4]
    assert jaccard.similar(none).count() == 0 and jaccard.keep_one(none).count() == 0


def test_bands_reach_the_recall():
    b, r = jaccard.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999
    sets = [np.unique(np.random.default_rng(i).integers(0, 1 << 63, 50).astype(np.uint64)) for i in range(9)]
    assert jaccard.shared_counts([sets[0], sets[0][:20], sets[1]]).tolist()[0][1] == 20


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r.u: r.v for r in jaccard.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100


def edited(rng, text):
    s = list(text)
    for _ in range(rng.randint(0, 4)):
        k, i = rng.randrange(3), rng.randrange(len(s))
        if k == 0:
            s.insert(i, rng.choice("abcé"))
        elif k == 1:
            del s[i]
        else:
            s[i] = rng.choice("abcé")
    return "".join(s)


def test_automaton_and_filters_against_levenshtein(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(t, edited(rng, t)) for t in texts] + [("", ""), ("", "ab"), ("abc", "")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    for e in (1, 2, 3):
        near = F.levenshtein("a", "b") <= e
        assert df.where(linededup.within(a, b, e) != near).count() == 0
        assert df.where(near & ~linededup.counts_near(a, b, e)).count() == 0
        assert df.where(near & ~linededup.signatures_near(linededup.signature(a), linededup.signature(b), e)).count() == 0


def test_every_near_pair_shares_a_key(spark):
    rng = random.Random(2)
    lines = spark.createDataFrame([("".join(rng.choice("ab") for _ in range(rng.randint(8, 11))),) for _ in range(300)], "s string").distinct()
    n = F.char_length("s")
    own = linededup.own_keys(F.col("s"), n, 2)
    keys = lines.select("s", F.posexplode(F.array(*own, *linededup.probe_keys(F.col("s"), n, 2))).alias("n", "key"))
    pairs = keys.alias("x").join(keys.where("n < 3").alias("y"), "key").select(F.col("x.s").alias("a"), F.col("y.s").alias("b"))
    pairs = pairs.union(pairs.select("b", "a")).distinct()
    near = lines.select(F.col("s").alias("a")).crossJoin(lines.select(F.col("s").alias("b"))).where((F.levenshtein("a", "b") <= 2) & (F.col("a") != F.col("b")))
    assert near.count() > 100 and near.join(pairs, ["a", "b"], "left_anti").count() == 0


def test_lines_to_drop(spark, odd, none):
    long = "a line that is long enough to take part"
    rows = [(1, f"{long}\nshort\n{long}"), (2, f"  {long} \nanother line, also long enough"), (3, long.replace("long", "lung")), (4, "short\nshort"), (None, long), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.dropped) for r in linededup.decisions(df).collect()}
    assert got == {1: (3, 1, "2"), 2: (2, 1, "0"), 3: (1, 1, "0"), 4: (2, 0, ""), None: (1, 1, "0"), 5: (1, 0, "")}
    kept = {r.doc_id: r.text for r in linededup.clean(df).collect()}
    assert kept == {1: f"{long}\nshort", 2: "another line, also long enough", 4: "short\nshort", 5: None}
    clean = linededup.clean(odd)
    assert clean.columns == odd.columns and clean.count() == 6
    assert linededup.decisions(none).count() == 0 and linededup.clean(none).count() == 0


def test_all_lines_take_part(spark):
    rows = [(1, "Les.\nthe nineteenth sign.\n\n\r"), (2, " Les. \nsome more words\n\n\r"), (3, "the ninteenth sign\nLas.\nsome more word")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.dropped for r in linededup.decisions(df, **linededup.ALL_LINES).collect()}
    assert got == {1: "", 2: "0", 3: "0,2"}
    kept = {r.doc_id: r.text for r in corpus_pipeline.without_repeated_lines(spark, df, "").collect()}
    assert kept == {1: rows[0][1], 2: "some more words\n\n\r", 3: "Las."}


def test_shreds_of_copies_go(spark):
    """A near copy of one document goes; one that takes its lines from several, or repeats its own, stays."""
    body = ["the first line of a longer text", "its second line is about as long", "and a third one ends it for now", "four more words here"]
    other = ["other lines that are quite long too", "and that nobody else has written yet"]
    rows = [
        (1, "\n".join(body)), (2, "\n".join([*body[:3], "own!"])), (3, "\n".join(other)), (4, "\n".join([body[0], other[0], body[1], other[1], "and its own end"])),
        (5, "\n".join(["again and again the same words"] * 6)), (6, "\n".join([body[0].replace("longer", "larger"), *body[1:3], "Own"])), (7, None), (None, "\n".join([*body, "x"])),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    all_lines = {r.doc_id: r.text for r in linededup.clean(df, **linededup.ALL_LINES).collect()}
    assert all_lines[2] == "own!" and all_lines[6] == "Own" and all_lines[None] == "x"
    kept = {r.doc_id: r.text for r in linededup.clean(df, copy_share=linededup.COPY_SHARE, **linededup.ALL_LINES).collect()}
    assert kept == {1: rows[0][1], 3: rows[2][1], 4: "and its own end", 5: "again and again the same words", 7: None}
    assert linededup.clean(df.where("false"), copy_share=0.8).count() == 0


def test_all_lines_equal_sql(spark, data):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{data}/documents.parquet'")
    got = sorted(tuple(r) for r in queries.op3_lines(spark, data).collect())
    assert got == sorted(c.execute(queries.SQL["op3_lines"]).fetchall())
    long = linededup.decisions(spark.read.parquet(f"{data}/documents.parquet"))
    assert sum(r[2] for r in got) > sum(r.n_dropped for r in long.collect())


def test_words_that_share_a_quick_hash(spark):
    """Two words of one quick hash, made by running its steps backwards, are neither linked nor copies, alone or in a text."""
    a, b = "botcajhdaaaaadaa", "fpqvuehyzsqzfyhi"
    assert len(set(textkit.word_hashes(pa.array([a, b]))[0].tolist())) == 1
    both = textkit.word_digests(pa.array([a, b]))[0]
    assert both[0, 0] != both[1, 0] and both[0, 1] != both[1, 1]
    rest = " ".join(f"w{i}" for i in range(3))
    df = spark.createDataFrame([(1, a), (2, b), (3, f"{a} {rest}"), (4, f"{b} {rest}"), (5, a)], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similar(df).collect()}
    assert got == {1: (1, 1), 2: (2, 0), 3: (3, 0), 4: (4, 0), 5: (1, 1)}
    assert {r.doc_id for r in jaccard.keep_one(df).collect()} == {1, 2, 3, 4}


def test_a_link_needs_both_sides_of_the_hashes(monkeypatch, spark):
    """If all words share the side by which members meet, they are compared by the other, and short texts stay apart."""
    whole = textkit.word_digests
    monkeypatch.setattr(textkit, "word_digests", lambda texts: (lambda d, at: (np.stack([np.zeros(len(d), np.uint64), d[:, 1]], 1), at))(*whole(texts)))
    sets = [list(jaccard.shingle_sets(pa.array(["p q r s t", "u v w x y"]), 5, side)) for side in (0, 1)]
    assert sets[0][0].tolist() == sets[0][1].tolist() and sets[1][0].tolist() != sets[1][1].tolist()
    assert jaccard.fingerprint(sets[0][0], sets[1][0]) != jaccard.fingerprint(sets[0][1], sets[1][1])
