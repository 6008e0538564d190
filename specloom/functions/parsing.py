"""Column functions over spectral text: numbers, couplings, multiplicities, formulas, identifiers. All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# First number in a text, formula tokens, elements, multiplicity aliases, solvents that say nothing.
NUMBER = r"[-+]?\d*\.?\d+"
FORMULA_TOKEN = r"([A-Z][a-z]?)(\d*)"
ELEMENTS = ("C", "H", "N", "O", "F", "Si", "P", "S", "Cl", "Br", "I")
HALOGENS = ("F", "Cl", "Br", "I")
MULTIPLICITY_ALIASES = {"brs": "brs", "bs": "brs", "broad": "br", "sept": "hept", "quint": "p", "quintet": "p", "multiplet": "m"}
UNKNOWN_SOLVENTS = ("nan", "none", "not_known", "unknown")


def parse_number(text: Column, default: float | None = None) -> Column:
    """First number in the text as a double, or the default. Exponents aren't read, as in the tables' own notation."""
    number = F.regexp_extract(text, NUMBER, 0).try_cast("double")  # the empty text of no match is no double
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def frequency_mhz(text: Column, default: float = 400.0) -> Column:
    """Spectrometer frequency; what isn't positive is the default."""
    value = parse_number(text)
    return F.when(value > 0, value).otherwise(F.lit(float(default)))


def integration(text: Column) -> Column:
    return parse_number(text, 1.0)


def couplings(values: Column) -> Column:
    """Coupling constants of an array of texts; null is none, and what isn't a number is left out."""
    numbers = F.filter(F.transform(values, lambda x: parse_number(x)), lambda x: x.isNotNull())
    return F.coalesce(numbers, F.array().cast("array<double>"))


def multiplicity(text: Column) -> Column:
    """Lower case without blanks and without a leading 'app'; aliases made one; empty is a singlet."""
    plain = F.lower(F.replace(F.trim(text), F.lit(" "), F.lit("")))

    def named(cut: Column) -> Column:
        out = F.when(cut.isNull(), F.lit("s"))
        for alias, name in MULTIPLICITY_ALIASES.items():
            out = out.when(cut == alias, F.lit(name))
        return out.otherwise(cut)

    return once(F.when(plain != "", F.regexp_replace(plain, "^app", "")), named)


def stable_id(smiles: Column) -> Column:
    """'nmr-' and the first 16 digits of the SHA-256 of the canonical structure."""
    return F.concat(F.lit("nmr-"), F.substring(F.sha2(smiles.cast("binary"), 256), 1, 16))


def file_key(text: Column, longest: int = 120) -> Column:
    """Name that any file system takes; long ones end in a digest."""
    safe = F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")
    return F.when(F.length(safe) <= longest, safe).otherwise(F.concat(F.substring(safe, 1, longest - 17), F.lit("-"), F.substring(F.sha2(text.cast("binary"), 256), 1, 16)))


def to_int(value: Column, default: int = 0) -> Column:
    """Integer-like text as an int, cut toward zero."""
    return F.coalesce(value.try_cast("double").try_cast("int"), F.lit(default))


def known_solvent(value: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return (text != "") & ~text.isin(*UNKNOWN_SOLVENTS)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def formula_tokens(formula: Column) -> Column:
    """Array of (element, count) of a neutral formula of one component, null if it is malformed."""
    text = F.trim(formula)
    names = F.regexp_extract_all(text, F.lit(FORMULA_TOKEN), F.lit(1))
    digits = F.regexp_extract_all(text, F.lit(FORMULA_TOKEN), F.lit(2))
    raw = F.zip_with(names, digits, lambda e, n: F.struct(e.alias("e"), n.alias("n")))
    made = lambda p: F.struct(p["e"].alias("element"), F.coalesce(F.nullif(p["n"], F.lit("")).try_cast("int"), F.lit(1)).alias("count"))

    def checked(tokens: Column) -> Column:
        back = F.array_join(F.transform(tokens, lambda p: F.concat(p["e"], p["n"])), "")
        whole = (F.length(text) > 0) & (back == text)
        return once(F.transform(tokens, made), lambda pairs: F.when(whole & F.forall(pairs, lambda p: p["element"].isin(*ELEMENTS) & (p["count"] > 0)), pairs))

    return once(raw, checked)


def element_count(tokens: Column, *elements: str) -> Column:
    """Atoms of the elements; null if the formula is malformed."""
    return F.aggregate(F.filter(tokens, lambda p: p["element"].isin(*elements)), F.lit(0), lambda n, p: n + p["count"])


def formula_counts(formula: Column) -> Column:
    """Map of element to count, repeated elements summed; null if the formula is malformed."""
    tokens = formula_tokens(formula)
    names = F.array_distinct(F.transform(tokens, lambda p: p["element"]))
    total = lambda e: F.aggregate(F.filter(tokens, lambda p: p["element"] == e), F.lit(0), lambda n, p: n + p["count"])
    return F.map_from_arrays(names, F.transform(names, total))


def dbe(formula: Column) -> Column:
    """Double-bond equivalents; null without a formula, for a malformed one, and where they would be negative."""
    def value(t: Column) -> Column:
        n = lambda *e: element_count(t, *e)
        return (2 * n("C", "Si") + 2 + n("N", "P") - n("H") - n(*HALOGENS)) / F.lit(2.0)

    return once(once(formula_tokens(formula), value), lambda v: F.when(v >= 0, v))


def distinct_signals(shifts: Column) -> Column:
    """Distinct shifts after rounding to three decimals."""
    return F.size(F.array_distinct(F.transform(shifts, lambda x: F.bround(x, 3))))


def weighted_draw(seed: int, key: Column, weights: dict[str, float]) -> Column:
    """Name drawn by weight; the draw is the first 64 bits of the SHA-256 of 'seed:key:task' over 2**64."""
    if any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    total = float(sum(weights.values()))
    digits = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), key, F.lit("task")).cast("binary"), 256), 1, 16)
    draw = F.conv(digits, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)
    out, below, names = None, 0.0, [k for k, w in weights.items() if w > 0]
    for name in names[:-1]:
        below += weights[name] / total
        out = F.when(draw < below, F.lit(name)) if out is None else out.when(draw < below, F.lit(name))
    return F.lit(names[-1]) if out is None else out.otherwise(F.lit(names[-1]))


def fixed(value: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", value)


def general(value: Column) -> Column:
    """A double in the shortest decimal form with six digits at most, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.5f", value), "0+$", ""), r"\.$", "")


def peak_table(h_peaks: Column, c_shifts: Column) -> Column:
    """Both peak tables as text, by falling shift. h_peaks: array of (shift, multiplicity, J, integration)."""

    def line(p: Column) -> Column:
        j = F.array_join(F.transform(F.coalesce(p["J"], F.array().cast("array<double>")), lambda x: fixed(x, 1)), ",")
        j = F.when(j == "", F.lit("-")).otherwise(j)
        return F.concat(fixed(p["shift"], 2), F.lit(" ppm | "), F.coalesce(p["multiplicity"], F.lit("s")), F.lit(" | J="), j, F.lit(" Hz | integration="), general(F.coalesce(p["integration"], F.lit(1.0))))

    ranked = F.transform(h_peaks, lambda p, i: F.struct((-p["shift"]).alias("k"), i.alias("i"), p.alias("p")))
    lines = F.transform(F.array_sort(ranked), lambda x: line(x["p"]))
    carbon = F.array_join(F.transform(F.sort_array(c_shifts, asc=False), lambda x: fixed(x, 2)), ", ")
    carbon = F.when(F.coalesce(carbon, F.lit("")) == "", F.lit("-")).otherwise(carbon)
    return F.array_join(F.concat(F.array(F.lit("1H NMR:")), lines, F.array(F.lit(""), F.lit("13C NMR:"), F.concat(carbon, F.lit(" ppm")))), "\n")


def numbered(values: Column) -> Column:
    """Distinct values as a numbered list, in their order."""
    return F.array_join(F.transform(F.array_distinct(values), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
