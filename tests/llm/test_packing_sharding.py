import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from specloom.llm import packing, queries, sharding, textkit

PATH = public_tokenizers.path("byte_bpe_50k.json")
DATA = Path(PATH).read_bytes()


def reference():
    return Tokenizer.from_file(PATH)


def mirrored(n, a="a", b="b"):
    """A word of n letters whose two versions collide under any polynomial hash modulo a power of two."""
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans({a: b, b: a}))
    return word


def test_words_are_told_apart(monkeypatch):
    texts = [mirrored(n, *ab) for n in (1024, 2048, 4096) for ab in ("ab", "ba", "éè", "èé")]
    texts += ["a bb ccc dddd", "words that collide with each other", "日本語 𝒳𝒴 naïve", ""]

    def check():
        ids, offsets = packing.WordEncoder(DATA).encode(texts)
        want = reference().encode_batch(texts, add_special_tokens=False)
        assert all(ids[offsets[i] : offsets[i + 1]].tolist() == w.ids for i, w in enumerate(want))

    check()
    assert len(set(textkit.word_hashes(pa.array(texts[:12]))[0].tolist())) == 12
    real = textkit.span_hashes
    monkeypatch.setattr(textkit, "span_hashes", lambda *a: real(*a) % np.uint64(5))  # hits that aren't the word
    check()


def test_ids_equal_the_library():
    rng = np.random.default_rng(0)
    signs = list(" \n\t'strevdlmABé1½!.,  日<|endoftext|>")
    texts = ["", " ", "a  ", "it's we'll I'd 'start ''s '", "x's", "can't\n\n  foo \n bar", "<|endoftext|>", "a" * 5000]
    texts += ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(3000)]
    ids, offsets = packing.WordEncoder(DATA).encode(texts)
    want = reference().encode_batch(texts, add_special_tokens=False)
    assert all(ids[offsets[i] : offsets[i + 1]].tolist() == w.ids for i, w in enumerate(want))


def test_pieces_are_binary_and_whole(spark, odd, none):
    rows = packing.pack(odd, PATH, max_tokens=64, with_ids=True).collect()
    tok = reference()
    for key, text in {(1, ""), (None, "some words of text here again"), (4, "it's 12½ 日本語  x\n\n  end ")}:
        own = sorted((r.start, r.length, r.ids, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == key)
        want = [*tok.encode(text, add_special_tokens=False).ids, 0]
        assert sum((r[2] for r in own), []) == want and own[0][4] == len(want)
        assert all(n & (n - 1) == 0 and len(i) == n and zlib.crc32(np.asarray(i, "<u4")) == c for _, n, i, c, _ in own)
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    assert all(1 << r.bucket == r.length for r in rows)
    assert packing.pack(none, PATH).count() == 0


def test_added_tokens_are_one_id(spark):
    texts = ["plain words", "<|endoftext|>", "one<|endoftext|> two  <|endoftext|>", "", "it's <|endoftext| >"]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, with_ids=True).collect()
    tok = Tokenizer.from_file(PATH)
    for key, text in enumerate(texts):
        own = sorted((r.start, r.ids) for r in rows if r.doc_id == key)
        assert sum((ids for _, ids in own), []) == [*tok.encode(text, add_special_tokens=False).ids, 0]
    assert packing.WordEncoder(DATA).encode([])[1].tolist() == [0]


def test_binary_lengths():
    assert packing.binary_lengths(2600, 1024) == [1024, 1024, 512, 32, 8]
    assert all(sum(packing.binary_lengths(n, 64)) == n for n in range(1, 300))


def brute_shards(rows, shards, seed):
    import hashlib

    by = {}
    for r in rows:
        key = hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}:{r[2]}:{r[1]}".encode()).hexdigest()
        by.setdefault(r[3], []).append((key, *r))
    flat = []
    for source, own in by.items():
        for k, r in enumerate(sorted(own, key=lambda x: x[0])):
            flat.append(((2 * k + 1) / (2 * len(own)), "" if source is None else "=" + source, *r))
    flat.sort(key=lambda x: x[:3])
    return {(r[3], i * shards // len(flat)) for i, r in enumerate(flat)}


def test_interleaving_equals_brute_force(spark, data, odd, none):
    got = queries.op2_shard(spark, data).collect()
    want = brute_shards([(r.doc_id, r.size, r.text_crc32, r.source) for r in got], 24, 17)
    assert {(r.doc_id, r.shard) for r in got} == want
    counts = {}
    for r in got:
        counts.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in counts.values()) and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert sharding.interleave(odd, shards=3).count() == 6 and sharding.interleave(none, shards=3).count() == 0


def test_the_words_held_can_be_fewer():
    """Where ids go out too, a worker holds fewer words; ids are the same whatever is held."""
    from pathlib import Path

    from specloom.llm import packing
    from specloom.llm.queries import vocabulary

    assert packing.CACHE_WORDS_IDS < packing.CACHE_WORDS
    data = Path(vocabulary("byte_bpe_50k.json")).read_bytes()
    small, large = packing.WordEncoder(data), packing.WordEncoder(data)
    small.most = 50
    for k in range(20):
        texts = [" ".join(f"word{i}x" for i in range(k * 10, k * 10 + 20))]
        assert small.encode(texts)[0].tolist() == large.encode(texts)[0].tolist()
        assert len(small.hashes) <= 70
    assert len(large.hashes) > 200
