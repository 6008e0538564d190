"""From raw spectral records to the best 1H/13C pair of each molecule."""

from __future__ import annotations

import ast
import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specloom.functions import parsing

# What a record scores for a filled table, a known solvent and deuterochloroform; what a pair scores for
# equal known solvents and for deuterochloroform in both; rows between records that cost one point.
FILLED, KNOWN, CHLOROFORM = 100, 10, 5
SAME_SOLVENT, BOTH_CHLOROFORM, ROWS_A_POINT = 1000, 100, 100_000
NO_SOLVENT = ("", "not_known", "nan", "None")


def nucleus(kind: Column) -> Column:
    """1h, 13c, or null for what isn't supported."""
    text = F.lower(F.replace(F.trim(kind), F.lit(" "), F.lit("")))
    return F.when(text.startswith("1h"), F.lit("1h")).when(text.startswith("13c"), F.lit("13c"))


def record_score(processed: Column, solvent: Column) -> Column:
    text = F.coalesce(F.trim(processed), F.lit(""))
    named = F.coalesce(F.trim(solvent), F.lit(""))
    return F.when(~text.isin("", "[]"), FILLED).otherwise(0) + F.when(~named.isin(*NO_SOLVENT), KNOWN).otherwise(0) + F.when(named == "CDCl3", CHLOROFORM).otherwise(0)


def candidates(raw: DataFrame) -> DataFrame:
    """Records of supported nuclei with their score."""
    rows = raw.withColumn("nucleus", nucleus(F.col("nmr_type"))).where("nucleus is not null")
    return rows.withColumn("score", record_score(F.col("processed"), F.col("solvent")))


def counters(raw: DataFrame) -> DataFrame:
    """Rows seen, candidates, and rows of unsupported nuclei, in one pass."""
    kept = nucleus(F.col("nmr_type")).isNotNull()
    return raw.agg(F.count(F.lit(1)).alias("rows"), F.count_if(kept).alias("candidates"), F.count_if(~kept).alias("unsupported"))


def _by_structure(raw: DataFrame, facts: DataFrame) -> DataFrame:
    """Records counted by structure, before they meet its facts: kept (of a supported nucleus), n, and the facts, null for what
    can't be read. A structure of many records is summed up before the shuffle."""
    counted = raw.groupBy("smiles", nucleus(F.col("nmr_type")).isNotNull().alias("kept")).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(facts.select("smiles", "accepted", "isotopes", "violations"), "smiles", "left")


def molecule_counters(raw: DataFrame, facts: DataFrame) -> DataFrame:
    """One row over all raw records: rows seen, candidates, records of unreadable structures and of unsupported nuclei, and
    candidates that had isotope labels, with the number of labels. facts: molecule dimension by smiles. 0 without records."""
    kept, accepted = F.col("kept"), F.coalesce("accepted", F.lit(False))
    total = lambda when, n=F.col("n"): F.coalesce(F.sum(F.when(when, n)), F.lit(0))
    labelled = kept & accepted & (F.col("isotopes") > 0)
    return _by_structure(raw, facts).agg(
        total(F.lit(True)).alias("rows_seen"),
        total(kept & accepted).alias("candidate_rows"),
        total(kept & F.col("accepted").isNull()).alias("invalid_smiles"),
        total(~kept).alias("unsupported_nmr_rows"),
        total(labelled).alias("isotope_normalized_rows"),
        total(labelled, F.col("n") * F.col("isotopes")).alias("isotope_labels_removed"),
    )


def rejections(raw: DataFrame, facts: DataFrame) -> DataFrame:
    """violation, n: records of supported nuclei that each violation rejects. A record may have several."""
    why = F.when(F.col("accepted").isNull(), F.array(F.lit("invalid_smiles"))).when(~F.col("accepted"), F.col("violations"))
    rows = _by_structure(raw, facts).where("kept").select("n", F.explode(why).alias("violation"))
    return rows.groupBy("violation").agg(F.sum("n").alias("n"))


def paired_keys(found: DataFrame) -> DataFrame:
    """Keys that have candidates of both nuclei."""
    both = found.groupBy("mol_key").agg(F.count_if(F.col("nucleus") == "1h").alias("h_count"), F.count_if(F.col("nucleus") == "13c").alias("c_count"))
    return both.where("h_count > 0 and c_count > 0")


def top_candidates(found: DataFrame, k: int = 3) -> DataFrame:
    """The k best records of each key and nucleus: by falling score, then by row."""
    falling = F.asc("falling") if "falling" in found.columns else F.desc("score")  # stored candidates lie in the former order
    rank = F.row_number().over(W.partitionBy("mol_key", "nucleus").orderBy(falling, "row_index"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def pair_score(h: Column, c: Column, rows_a_point: int) -> Column:
    same = (h["solvent"] == c["solvent"]) & ~h["solvent"].isin("", "not_known")
    both = (h["solvent"] == "CDCl3") & (c["solvent"] == "CDCl3")
    apart = F.abs(h["row_index"] - c["row_index"])
    return h["score"] + c["score"] + F.when(same, SAME_SOLVENT).otherwise(0) + F.when(both, BOTH_CHLOROFORM).otherwise(0) - F.floor(apart / rows_a_point)


def best_pairs(found: DataFrame, *, k: int = 3, rows_a_point: int = ROWS_A_POINT) -> DataFrame:
    """The best pair of each key. Ties go to the better 1H record, then to the better 13C record.

    The k best of each side come from one window; the pairs of a key are built and chosen inside its row from two arrays of k
    entries, so that a single exchange by key serves ranking, pairing and choice.
    """
    entry = F.struct("rank", "score", "row_index", "solvent")
    sides = top_candidates(found, k).groupBy("mol_key").agg(
        F.array_sort(F.collect_list(F.when(F.col("nucleus") == "1h", entry))).alias("hs"),
        F.array_sort(F.collect_list(F.when(F.col("nucleus") == "13c", entry))).alias("cs"),
    )

    def pair(h: Column, c: Column) -> Column:
        score = pair_score(h, c, rows_a_point).cast("bigint")
        # without a score (a null score or solvent) a pair is the last choice
        return F.struct(score.isNull().alias("none"), (-score).alias("down"), h["rank"].alias("h_rank"), c["rank"].alias("c_rank"), h["row_index"].alias("h_row"), c["row_index"].alias("c_row"), score.alias("pair_score"))

    pairs = F.flatten(F.transform("hs", lambda h: F.transform("cs", lambda c: pair(h, c))))
    best = sides.where("size(hs) > 0 and size(cs) > 0").select("mol_key", F.array_min(pairs).alias("b"))
    return best.select("mol_key", "b.h_row", "b.c_row", "b.pair_score")


PEAK = "shift double, multiplicity string, J array<double>, integration double, shift_range array<double>"


def _literal(text: str | None):
    if not text or text.isascii() and text.isidentifier() and text not in ("True", "False"):
        return None  # a bare name is no literal
    if not any(x in text for x in ('"', "\\", "#", "'''")):
        bare = "".join(text.split("'")[::2])
        if bare.count("[") != bare.count("]"):
            return None  # what isn't closed
    try:
        return ast.literal_eval(text)
    except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
        return None


#: Between the couplings of one cell, and the fields of a 1H peak given as a mapping with what a missing one counts as.
APART = "\x1f"
H_FIELDS = (("shift", None), ("multiplicity", "s"), ("J", ()), ("integration", 1.0))

# A table's usual shape: a list of rows, which may be mappings, of cells, which may be lists of scalars.
_TEXT = r"'[^'\"\\()\[\]{}N\x00-\x1f]*'"
_SCALAR = rf"(?:{_TEXT}|None|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"


def _listed(item: str) -> str:
    return rf"(?:\[ *(?:{item} *(?:, *{item} *)*(?:, *)?)?\]|\( *(?:{item} *, *(?:{item} *(?:, *{item} *)*(?:, *)?)?)?\))"


_CELL = rf"(?:{_SCALAR}|{_listed(_SCALAR)})"
_PAIR = rf"{_TEXT} *: *{_CELL} *"
_SHAPE = f"^{_listed(f'(?:{_CELL}|{_listed(_CELL)})')}$"
_SHAPE_MAPPINGS = f"^{_listed(f'(?:{_CELL}|{_listed(_CELL)}|{{ *(?:{_PAIR}(?:, *{_PAIR})*(?:, *)?)?}})')}$"


def _read(texts: pa.Array, mappings: bool) -> list:
    """_literal of each text, with lists for tuples. One of the usual shape is JSON but for its quotes, round brackets, None and
    last commas, so these go through the JSON parser at once, many times faster."""
    usual = pc.fill_null(pc.match_substring_regex(texts, _SHAPE_MAPPINGS if mappings else _SHAPE), False)
    json_texts = texts.filter(usual)
    for old, new in (("(", "["), (")", "]"), ("'", '"'), ("None", "null")):
        json_texts = pc.replace_substring(json_texts, old, new)
    json_texts = pc.replace_substring_regex(json_texts, r", *([\]}])", r"\1")
    try:
        read = iter(json.loads(f"[{','.join(json_texts.to_pylist())}]"))
    except ValueError:  # an integer of too many digits
        return [_literal(t) for t in texts.to_pylist()]
    rest = pc.if_else(usual, None, texts).to_pylist()
    return [next(read) if plain else _literal(text) for plain, text in zip(usual.to_pylist(), rest, strict=True)]


def literals(text: Column, fields: tuple[tuple[str, object], ...] = ()) -> Column:
    """The tuples of a Python-literal text as arrays of arrays of texts, null where it doesn't parse.

    Couplings inside a tuple are joined by APART. With fields, a mapping becomes the tuple of these. The only step of ingest
    that needs Python, in Arrow batches; columns of one select share a pass. Declared nondeterministic, as Spark would else
    parse all texts once for a filter on the result and once more for its rows.
    """

    def cell(x) -> str | None:
        if x is None or type(x) is str:
            return x
        return APART.join(["" if y is None else str(y) for y in x]) if isinstance(x, (list, tuple)) else str(x)

    def cells(v) -> list[str | None]:
        if fields and isinstance(v, dict):
            v = [v.get(name, missing) for name, missing in fields]
        return [cell(x) for x in v] if isinstance(v, (list, tuple)) else [cell(v)]

    def whole(value) -> list[list[str | None]] | None:
        if value is None:
            return None
        return [cells(v) for v in (value if isinstance(value, (list, tuple)) else [value])]

    def parse(texts: pa.Array) -> pa.Array:
        return pa.array(map(whole, _read(texts, bool(fields))), pa.list_(pa.list_(pa.string())))

    return F.arrow_udf(parse, "array<array<string>>").asNondeterministic()(text)


def literal_tables(rows: DataFrame, column: str, out: str, fields: tuple[tuple[str, object], ...] = ()) -> DataFrame:
    """Adds out: literals() of a column."""
    return rows.withColumn(out, literals(F.col(column), fields))


def h_peak(t: Column) -> Column:
    """A 1H peak from a tuple of texts: (shift, multiplicity, couplings, integration), or the source's own order
    (multiplicity, couplings, integration, high, low), whose shift is the middle. Null without a shift."""
    at = lambda i: F.get(t, i)

    def peak(shift: Column, mult: Column, js: Column, area: Column, low_high: Column) -> Column:
        return F.struct(
            shift.alias("shift"), parsing.multiplicity(mult).alias("multiplicity"), parsing.couplings(F.split(js, APART)).alias("J"), parsing.integration(F.coalesce(area, F.lit("1"))).alias("integration"), low_high.alias("shift_range")
        )

    def made(n: Column) -> Column:
        first, high, low = (n[x] for x in ("first", "high", "low"))
        ends = F.when(high.isNotNull() & low.isNotNull(), F.array(F.least(high, low), F.greatest(high, low)))
        # both orders in one peak, as a struct's fields are written out for each
        own = peak(F.coalesce(first, (high + low) / 2.0), *(F.when(first.isNull(), at(i)).otherwise(at(i + 1)) for i in range(3)), ends)
        return F.when(first.isNotNull() | ends.isNotNull(), own)

    # the last two count only in the source's order
    first, five = parsing.parse_number(at(0)), F.size(t) >= 5
    bounds = lambda i: F.when(five & first.isNull(), parsing.parse_number(at(i)))
    return parsing.once(F.struct(first.alias("first"), bounds(3).alias("high"), bounds(4).alias("low")), made)


def h_table(tuples: Column) -> Column:
    return F.filter(F.transform(tuples, h_peak), lambda p: p.isNotNull())


def c_table(tuples: Column) -> Column:
    """13C peaks as arrays of shifts; a peak may have several; peaks without a number are left out."""
    peaks = F.transform(tuples, lambda t: F.struct(parsing.couplings(t).alias("shifts")))
    return F.filter(peaks, lambda p: F.size(p["shifts"]) > 0)


def samples(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Nested samples of chosen pairs. pairs: mol_key and structs h, c of raw records; facts: molecule dimension by
    canonical. A pair whose table doesn't parse, or whose molecule isn't accepted, gives none."""
    rows = pairs.withColumns({"h_raw": literals(F.col("h.processed"), H_FIELDS), "c_raw": literals(F.col("c.processed"))})
    rows = rows.where("h_raw is not null and c_raw is not null")
    rows = rows.join(facts.where("accepted").select(F.col("canonical").alias("mol_key"), "formula").distinct(), "mol_key")
    source = lambda s: F.struct(*(F.col(f"{s}.{n}").alias(n) for n in ("filename", "page_mol", "page_para", "location_mol", "location_para")))
    return rows.select(
        parsing.stable_id(F.col("mol_key")).alias("id"),
        F.col("mol_key").alias("canonical_smiles"),
        F.col("formula").alias("molecular_formula"),
        F.struct(F.lit("experimental").alias("source"), source("c").alias("source_13c"), source("h").alias("source_1h")).alias("meta"),
        F.struct("c.frequency", "c.solvent", c_table(F.col("c_raw")).alias("peaks")).alias("c13_nmr"),
        F.struct("h.frequency", "h.solvent", h_table(F.col("h_raw")).alias("peaks")).alias("h1_nmr"),
    )


def first_samples(made: DataFrame, most: int | None = None) -> DataFrame:
    """Samples by their canonical structure, at most so many of those that could be made."""
    ordered = made.orderBy("canonical_smiles")
    return ordered if most is None else ordered.limit(most)
