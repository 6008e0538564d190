"""Line dedup by a segment-partition edit join, in DataFrame functions alone.

Lines within `edits` edits are found by the pigeonhole principle: of edits + 1 segments of the one line, one is an unchanged
substring of the other, at a place that the lengths and the segment's number bound. Segments and substrings meet by hash;
what meets is verified by a banded bit-parallel automaton.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm import common

#: Edits that make two lines alike, and the least length of lines that take part.
EDITS, MIN_CHARS = 2, 20
#: For all lines: those with a visible sign are held against equal ones, and edits may be a fifth of a line.
ALL_LINES = {"min_chars": 5 * EDITS, "exact_chars": 1}
#: A document of whose visible signs at least this share repeats the lines of one other document is a copy, as similar as
#: near duplicates must be.
COPY_SHARE = 0.8
#: A sign that isn't blank.
VISIBLE = r"[^ \t\n\f\r\x0b]"
#: Signs that are blank.
BLANKS = " \t\n\f\r\x0b"
#: A line is hot if it makes up more than one in so many lines; there can't be more hot lines than that.
HOT = 1000


def segments(length: Column, edits: int) -> list[tuple[Column, Column]]:
    """Start (from 1) and size of each of the edits + 1 segments of a line of that length; the last ones are longer by one."""
    parts = edits + 1
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    out = []
    for i in range(parts):
        extra = F.greatest(F.lit(i) - (F.lit(parts) - longer), F.lit(0))
        out.append((F.lit(1) + base * i + extra, base + F.when(F.lit(i) >= F.lit(parts) - longer, 1).otherwise(0)))
    return out


def windows(edits: int, shorter: int) -> list[tuple[int, int]]:
    """Segments (from 0) of a line shorter by so many signs, and the offsets at which each must be probed.

    If segment i is the first that matches, at most i edits lie before it and edits - i after it; both bound the offset.
    """
    out = []
    for i in range(edits + 1):
        low, high = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
        out += [(i, o) for o in range(low, high + 1)]
    return out


def own_keys(line: Column, n: Column, edits: int) -> list[Column]:
    """Hashes of the own segments of a line of length n."""
    return [F.xxhash64(n, F.lit(i), F.substring(line, start, size)) for i, (start, size) in enumerate(segments(n, edits))]


def probe_keys(line: Column, n: Column, edits: int) -> list[Column]:
    """Hashes of substrings of a line of length n that may be segments of another line of the same length or shorter.

    Own segments stand for the probes at the same place. All windows lie inside a line longer than the segments are many.
    """
    found = []
    for shorter in range(edits + 1):
        own = segments(n - shorter, edits)
        for i, offset in windows(edits, shorter):
            if shorter or offset:
                start, size = own[i]
                found.append(F.xxhash64(n - shorter, F.lit(i), F.substring(line, start + offset, size)))
    return found


#: Letters whose counts, modulo 8, make a line's signature.
LETTERS = "eainrtsold"


def signature(line: Column) -> Column:
    """Counts of frequent letters, three bits each. An edit changes two counts by one at most."""
    out = F.lit(0)
    for i, letter in enumerate(LETTERS):
        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))
        out = out + F.shiftleft(count.bitwiseAND(F.lit(7)), 3 * i)
    return out


def signatures_near(a: Column, b: Column, edits: int) -> Column:
    """Necessary for lines within the edits: their letter counts differ by two for each edit at most."""
    total = F.lit(0)
    for i in range(len(LETTERS)):
        d = (F.shiftright(a, 3 * i) - F.shiftright(b, 3 * i)).bitwiseAND(F.lit(7))
        total = total + F.least(d, 8 - d)
    return total <= 2 * edits


#: Signs whose exact counts are compared before the automaton runs.
COUNTED = "etaoinshrdlucmfwypvbgkqjxz ,."


def counts_near(a: Column, b: Column, edits: int) -> Column:
    """Necessary for lines within the edits: exact counts of many signs differ by two for each edit at most."""
    count = lambda line, sign: F.octet_length(line) - F.octet_length(F.replace(line, F.lit(sign), F.lit("")))
    total = F.lit(0)
    for sign in COUNTED:
        total = total + F.abs(count(a, sign) - count(b, sign))
    return total <= 2 * edits


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are within so many edits, by a banded bit-parallel automaton.

    For each number of edits e up to the limit a word has a bit for each diagonal of the band: bit d + edits says that the
    first j signs of a can become the first j + d of b by e edits. Reading a sign of a updates all diagonals of a word at
    once: equal signs go on along the diagonal; a change, an addition or a removal comes from the word of e - 1 edits.
    The words share one long, `width` bits for each.
    """
    width = 2 * edits + 1
    if width * (edits + 1) > 62:
        raise ValueError("the band doesn't fit in a long")
    mask = (1 << width) - 1
    start = 0
    for e in range(edits + 1):
        start |= sum(1 << d + edits for d in range(e + 1)) << e * width

    def bits(word: Column) -> Column:
        return word.bitwiseAND(F.lit(mask))

    def step(state: Column, j: Column, left: Column, right: Column) -> Column:
        sign = F.get(left, j - 1)
        equal = F.lit(0)
        for d in range(-edits, edits + 1):
            equal = equal + F.when(F.get(right, j - 1 + d) == sign, F.lit(1 << d + edits)).otherwise(F.lit(0))

        def read(same: Column) -> Column:
            new = out = bits(state).bitwiseAND(same)
            for e in range(1, edits + 1):
                less = bits(F.shiftright(state, (e - 1) * width))
                new = bits(F.shiftright(state, e * width)).bitwiseAND(same).bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(new, 1))
                new = bits(new)
                out = out.bitwiseOR(F.shiftleft(new, e * width))
            return out

        return F.transform(F.array(equal.cast("long")), read)[0]

    def run(s: Column) -> Column:
        """Reads all signs; s holds both strings as arrays, made once a pair and not in every step."""
        n, m = F.size(s["a"]), F.size(s["b"])
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        last = F.aggregate(places, F.lit(start).cast("long"), lambda state, j: step(state, j, s["a"], s["b"]))
        return F.transform(F.array(last), lambda x: F.coalesce(*[F.when(m - n == d, x.bitwiseAND(F.lit(1 << edits * width + d + edits)) != 0) for d in range(-edits, edits + 1)], F.lit(False)))[0]

    signs = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    near = F.abs(F.char_length(a) - F.char_length(b)) <= edits
    return F.when(near, F.transform(F.array(F.struct(signs(a).alias("a"), signs(b).alias("b"))), run)[0]).otherwise(F.lit(False))


def visible(text: Column) -> Column:
    """How many signs of a text aren't blank."""
    return F.char_length(F.translate(text, BLANKS, ""))


class Lines:
    """The lines of a table that take part, and the decisions on them."""

    def __init__(self, docs: DataFrame, *, edits: int, min_chars: int, exact_chars: int | None, doc_id: str, text: str):
        if min_chars <= edits + 1:
            raise ValueError("lines must be longer than the segments are many")
        self.edits, self.min_chars, self.doc_id, self.text = edits, min_chars, doc_id, text
        body = F.coalesce(F.col(text), F.lit(""))
        self.docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_hash"))
        split = self.docs.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        takes_part = F.char_length("line") >= min_chars
        if exact_chars is not None:
            takes_part = takes_part | ((F.char_length("line") >= exact_chars) & F.col("line").rlike(VISIBLE))
        split = split.withColumn("line", F.trim("line")).where(takes_part)
        self.lines = split.withColumns({"id": F.xxhash64("line"), "check": F.xxhash64(F.lit(1), "line"), "mark": signature(F.col("line"))})

    @staticmethod
    def place() -> Column:
        """Order of places: by doc_id, null last, then by position."""
        order = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).cast("decimal(38,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("pos")
        return order.cast("decimal(38,0)")

    def distinct(self) -> DataFrame:
        """Each distinct line with its first place and count. Copies are summed up before the shuffle.

        Lines are told apart by 64-bit hashes; a second hash finds different lines that share one, and leaves them alone.
        """
        found = self.lines.groupBy("id").agg(
            F.min(self.place()).alias("first"),
            F.count(F.lit(1)).alias("n"),
            F.min("check").alias("low"),
            F.max("check").alias("high"),
            F.max("mark").alias("mark"),
            F.any_value("line").alias("line"),
        )
        # every use needs all columns, so that Spark plans one shuffle of lines and reads it again
        return found.where("low = high and n > 0 and first is not null and mark is not null and line is not null").select("id", "first", "n", "mark", "line")

    def later(self) -> DataFrame:
        """Ids of distinct lines that are within the edits of a line whose first place comes before theirs, and the first of
        these places as source."""
        lines = self.distinct()
        # length, then keys, are columns of their own, so that each is computed once a line and not in every use
        line, n = F.col("line"), F.col("n_chars")
        own, probes = own_keys(line, n, self.edits), probe_keys(line, n, self.edits)
        sized = lines.select("id", "mark", "line", F.char_length("line").alias("n_chars")).where(F.col("n_chars") >= self.min_chars)

        def spread(columns: list[Column]) -> DataFrame:
            names = [f"k{i}" for i in range(len(columns))]
            rows = sized.select("id", "mark", *(c.alias(k) for c, k in zip(columns, names, strict=True)))
            return rows.select("id", "mark", F.posexplode(F.array(*names)).alias("n", "key"))

        # the lowest bit says whether the key is a probe
        keys = spread([*own, *probes]).select("id", "key", (F.shiftleft(F.col("mark").cast("long"), 1) + F.when(F.col("n") >= len(own), 1).otherwise(0)).alias("flags"))
        index = spread(own).select(F.col("id").alias("other"), F.col("mark").alias("its"), "key")
        apart = (F.col("id") != F.col("other")) & ((F.col("flags").bitwiseAND(F.lit(1)) == 1) | (F.col("id") < F.col("other")))
        near = signatures_near(F.shiftright("flags", 1).cast("int"), F.col("its"), self.edits)
        a, b = F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")
        pairs = keys.alias("k").join(index.alias("o"), (F.col("k.key") == F.col("o.key")) & apart & near).select(a, b).distinct()
        side = lambda name: lines.select(F.col("id").alias(name), F.col("first").alias(f"first_{name}"), F.col("line").alias(f"line_{name}"))
        pairs = pairs.join(side("a"), "a").join(side("b"), "b")
        a, b = F.col("line_a"), F.col("line_b")
        pairs = pairs.where(F.when(counts_near(a, b, self.edits), within(a, b, self.edits)).otherwise(F.lit(False)))
        # two lines can't share a first place, unless different documents share an id; then the smaller hash stays
        gone = F.when(F.col("first_a") > F.col("first_b"), F.col("a")).otherwise(F.col("b")).alias("id")
        return pairs.groupBy(gone).agg(F.min(F.least("first_a", "first_b")).alias("source"))

    def dropped(self, *, shares: bool = False) -> DataFrame:
        """Places of the lines to drop: doc_id, text_hash, and the positions in the document.

        With shares, copied is the number of visible signs in the dropped lines that come from one other document, of the
        document that gives most. Decisions on hot lines are broadcast (HOT at most), those on others joined by hash.
        """
        later = self.later().withColumn("later", F.lit(True))
        decided = self.distinct().select("id", "first", "n").join(later, "id", "left")
        decided = decided.where("n > 1 or later").select("id", "first", F.coalesce("later", F.lit(False)).alias("later"), "n", F.coalesce("source", "first").alias("source"))
        decided = common.cut(decided, "lines")
        places = self.lines.select("doc_id", "text_hash", "pos", "id", *([visible(F.col("line")).alias("signs")] if shares else []))
        kept = ["doc_id", "text_hash", "pos"]
        if shares:
            kept += ["signs", F.floor(F.col("source") / F.lit(1 << 31).cast("decimal(11,0)")).cast("long").alias("source")]
        total = decided.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        hot = F.broadcast(decided.where(F.col("n") > total / HOT).drop("n"))
        cool = decided.where(F.col("n") <= total / HOT).drop("n")
        goes = F.col("later") | (self.place() != F.col("first"))
        found = places.join(hot, "id").where(goes).select(*kept)
        found = found.unionByName(places.join(hot.select("id"), "id", "left_anti").join(cool, "id").where(goes).select(*kept)).distinct()
        if not shares:
            return found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("pos")).alias("dropped"))
        foreign = F.when(F.col("source") != F.coalesce("doc_id", F.lit((1 << 63) - 1)), F.col("signs")).otherwise(0)
        found = found.groupBy("doc_id", "text_hash", "source").agg(F.collect_list("pos").alias("some"), F.sum(foreign).alias("copied"))
        return found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.flatten(F.collect_list("some"))).alias("dropped"), F.max("copied").alias("copied"))


def decisions(docs: DataFrame, *, edits: int = EDITS, min_chars: int = MIN_CHARS, exact_chars: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document row: doc_id, n_lines, n_dropped, dropped (positions from 0, joined by commas).

    Lines end at \\n and are compared without blanks at their ends; those under min_chars signs take no part and stay. Of
    equal lines the first stays: that of the smallest doc_id and position. A distinct line goes altogether if it is within
    `edits` edits of one that comes first earlier. With exact_chars, visible lines from so many signs on are also held
    against equal ones; only the edit join keeps to min_chars then.

    A null text is one empty line; null doc_ids come last in the order; rows with equal doc_id and text are one document
    and lose the same lines; an empty table gives no rows; further columns are ignored.
    """
    own = Lines(docs, edits=edits, min_chars=min_chars, exact_chars=exact_chars, doc_id=doc_id, text=text)
    rows = own.docs.select("doc_id", "text_hash", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    return _with_dropped(rows, own.dropped()).select(
        "doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped")
    )


def _with_dropped(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """rows, which have doc_id and text_hash, with the array dropped, empty where nothing goes."""
    keyed = lambda df: df.withColumns({"__k": F.coalesce("doc_id", F.lit(-1)), "__n": F.col("doc_id").isNull()})
    found = keyed(dropped).drop("doc_id")
    return keyed(rows).join(found, ["__k", "__n", "text_hash"], "left").drop("__k", "__n").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))


def clean(docs: DataFrame, *, edits: int = EDITS, min_chars: int = MIN_CHARS, exact_chars: int | None = None, copy_share: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the lines that decisions() drops, with all their columns.

    A document that loses lines and keeps none that is visible goes. So does, with a copy_share, one of whose visible signs
    at least that share goes as lines of one other document (the first that has them): what is left of a near copy is a
    shred, not a document. One that loses no line is left as it is, null texts too.
    """
    own = Lines(docs, edits=edits, min_chars=min_chars, exact_chars=exact_chars, doc_id=doc_id, text=text)
    names = docs.columns
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    key, body = F.col(f"c{names.index(doc_id)}").cast("long"), F.col(f"c{names.index(text)}")
    rows = rows.withColumns({"doc_id": key, "text_hash": F.xxhash64(F.coalesce(body, F.lit("")))})
    rows = _with_dropped(rows, own.dropped(shares=copy_share is not None))
    kept = F.array_join(F.filter(F.split(body, "\n"), lambda _, i: ~F.array_contains(F.col("dropped"), i)), "\n")
    rows = rows.withColumn("text", F.when(F.size("dropped") > 0, kept).otherwise(body))
    rows = rows.where((F.size("dropped") == 0) | F.col("text").rlike(r"\S"))
    if copy_share is not None:
        rows = rows.where((F.size("dropped") == 0) | (F.col("copied") < F.lit(copy_share) * visible(body)))
    return rows.select(*((F.col("text") if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)))
