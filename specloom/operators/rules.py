"""Rules over peak tables: shift regions, fragments, formula evidence, group support, and checks of candidates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specloom.functions import parsing
from specloom.operators import order

# The default rule library. Regions: id, lowest and highest ppm, conclusion, confidence, strength, tip.
H_REGIONS = (
    ("H1_SHIFT_ALKYL", 0.5, 2.0, "Proton signals occur in a common saturated alkyl region.", 0.55, "weak", "Treat this region as non-specific and combine it with integration, multiplicity, and coupling constants."),
    ("H1_SHIFT_PI_OR_CARBONYL_ADJACENT", 1.7, 3.3, "Proton signals may be adjacent to a pi system or carbonyl group.", 0.55, "weak", "Benzylic, allylic, propargylic, and carbonyl-alpha environments overlap substantially in this region."),
    ("H1_SHIFT_HETEROATOM_SP3", 3.0, 4.6, "Proton signals support an sp3 carbon adjacent to an electronegative heteroatom.", 0.68, "moderate", "Use the associated carbon shift and molecular formula to distinguish oxygen, nitrogen, and halogen substitution."),
    ("H1_SHIFT_ALKENE", 4.5, 6.8, "Proton signals are compatible with vinylic environments.", 0.65, "moderate", "Coupling constants and the number of vinylic protons are more diagnostic than chemical shift alone."),
    ("H1_SHIFT_AROMATIC", 6.0, 9.0, "Proton signals are compatible with aromatic or strongly conjugated environments.", 0.68, "moderate", "Use integration and signal patterns to estimate substitution and symmetry; do not assign a ring from shift alone."),
    ("H1_SHIFT_ALDEHYDE", 9.0, 10.6, "A downfield proton signal supports an aldehydic environment.", 0.88, "strong", "Confirm this assignment with a carbon signal in the aldehyde or ketone carbonyl region."),
    ("H1_SHIFT_ACIDIC_OH", 10.0, 13.5, "A very downfield proton signal may be an acidic or strongly hydrogen-bonded proton.", 0.62, "moderate", "Exchangeable-proton positions and integrations vary with concentration, temperature, and sample conditions."),
)
C_REGIONS = (
    ("C13_SHIFT_ALKYL", 0.0, 50.0, "Carbon signals occur in a common saturated alkyl region.", 0.58, "weak", "This broad region is rarely diagnostic without proton evidence or a molecular formula."),
    ("C13_SHIFT_HETEROATOM_SP3", 45.0, 90.0, "Carbon signals support heteroatom-substituted sp3 carbon environments.", 0.68, "moderate", "Oxygenated and nitrogen-bearing carbons overlap; cross-check the elemental composition."),
    ("C13_SHIFT_ALKYNE", 65.0, 100.0, "Carbon signals are compatible with sp-hybridized carbon environments.", 0.52, "weak", "This region overlaps with heteroatom-substituted sp3 carbons, so DBE and proton evidence are essential."),
    ("C13_SHIFT_UNSATURATED", 100.0, 165.0, "Carbon signals support alkene, aromatic, or other conjugated sp2 environments.", 0.70, "moderate", "Count distinct signals and compare them with proton integration to assess substitution and symmetry."),
    ("C13_SHIFT_HETERO_CARBONYL", 160.0, 185.0, "Carbon signals support a carboxylic-acid-derivative or conjugated heteroatom-bearing carbonyl environment.", 0.82, "strong", "Esters, amides, acids, and related carbonyls overlap; use the formula and nearby proton environments."),
    ("C13_SHIFT_ALDEHYDE_KETONE", 185.0, 220.0, "Carbon signals support an aldehyde or ketone carbonyl environment.", 0.90, "strong", "An aldehydic proton near 9-10.6 ppm distinguishes many aldehydes from ketones."),
)
# Single peaks: id, integration, tolerance, multiplicities, lowest and highest ppm, conclusion, confidence, strength, tip.
SINGLES = (
    ("H1_FRAGMENT_TERT_BUTYL_001", 9.0, 1.0, ("s",), None, None, "A 9H singlet supports a tert-butyl-like group or three equivalent methyl groups.", 0.86, "strong", "Confirm that the carbon signal count is compatible with three equivalent methyl groups."),
    ("H1_FRAGMENT_METHOXY_001", 3.0, 0.6, ("s",), 3.0, 4.3, "A 3H singlet in the heteroatom-adjacent region supports a methoxy-like group.", 0.74, "moderate", "N-methyl and other isolated heteroatom-bound methyl groups can produce similar evidence."),
    ("H1_FRAGMENT_ACYL_METHYL_001", 3.0, 0.6, ("s",), 1.8, 2.8, "A 3H singlet in this region supports a methyl group adjacent to a carbonyl or conjugated center.", 0.66, "moderate", "Benzylic and other pi-adjacent methyl groups overlap, so require carbon evidence before assigning an acetyl group."),
)
# Pairs: id, (integration, multiplicities) of both peaks, tolerance of the integration and of J, conclusion, confidence, strength, tip.
PAIRS = (
    ("H1_FRAGMENT_ETHYL_001", (3.0, ("t",)), (2.0, ("q",)), 0.6, 0.5, "A 3H triplet and 2H quartet with matching coupling constants support an ethyl fragment.", 0.92, "strong", "Matching J values are more diagnostic than either multiplicity or chemical shift alone."),
    ("H1_FRAGMENT_ISOPROPYL_001", (6.0, ("d",)), (1.0, ("sept", "hept", "m")), 0.8, 0.7, "A 6H doublet and 1H septet-like signal with matching coupling support an isopropyl fragment.", 0.88, "strong", "Overlap may make the methine appear as a multiplet; verify the 6:1 integration ratio."),
)
FORMULA_TIP = "Account for all unsaturation before accepting a structure."
COUNT_TIP = "Fewer signals than carbons can reflect symmetry, accidental overlap, or weak signals; signal intensity is not quantitative."
STRENGTHS = ("hard", "strong", "moderate", "weak")
# Groups that shifts can support: label, 1H range, 13C range, and whether both are needed.
SUPPORT = (
    ("alcohol", (3.0, 4.6), (45.0, 90.0), False),
    ("ether", (3.0, 4.6), (45.0, 90.0), False),
    ("amine", (3.0, 4.6), (45.0, 90.0), False),
    ("aldehyde", (9.0, 10.6), (185.0, 220.0), True),
    ("ketone", None, (185.0, 220.0), False),
    ("carboxylic_acid", None, (160.0, 185.0), False),
    ("ester", None, (160.0, 185.0), False),
    ("amide", None, (160.0, 185.0), False),
    ("alkene", (4.5, 6.8), (100.0, 165.0), False),
    ("aromatic_ring", (6.0, 9.0), (100.0, 165.0), False),
    ("alkyne", None, (65.0, 100.0), False),
    ("nitrile", None, (105.0, 130.0), False),
)
FRAGMENT_CHECKS = ("H1_FRAGMENT_ETHYL_001", "H1_FRAGMENT_ISOPROPYL_001", "H1_FRAGMENT_TERT_BUTYL_001", "H1_FRAGMENT_METHOXY_001")


@dataclass(frozen=True)
class Library:
    """A rule library; regions, single peaks and pairs in the shapes above."""

    name: str = "nmr_1d"
    h_regions: tuple = H_REGIONS
    c_regions: tuple = C_REGIONS
    singles: tuple = SINGLES
    pairs: tuple = PAIRS

    @property
    def order(self) -> dict[str, int]:
        """Place of each rule in the evidence of a sample."""
        ids = ["FORMULA_DBE_001", "C13_SIGNAL_COUNT_001", *(r[0] for r in (*self.h_regions, *self.c_regions, *self.pairs, *self.singles))]
        return {x: i for i, x in enumerate(ids)}

    def described(self, spark: SparkSession) -> DataFrame:
        """rule_id, rule_order, category, conclusion, confidence, strength, human_tip of the rules with fixed texts."""
        rows = [(r[0], self.order[r[0]], r[0].split("_", 1)[0].lower(), *r[-4:]) for r in (*self.h_regions, *self.c_regions, *self.pairs, *self.singles)]
        return spark.createDataFrame(rows, "rule_id string, rule_order int, category string, conclusion string, confidence double, strength string, human_tip string")


DEFAULT = Library()


def regions_table(spark: SparkSession, regions: tuple) -> DataFrame:
    return spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(regions)], "rule_order int, rule_id string, low double, high double")


#: Cells narrower than 2 to this power are not told apart; the level of ranges without an end, whose one cell holds all.
FINEST, ENDLESS = -20, 1024
#: Values and bounds of a part of interval_summary.
PLACES = 500_000


def cells(low: Column, high: Column) -> Column:
    """(level, cell) of a range: cells of width 2**level start at its multiples; of the least level that is no narrower than
    the range, the one or two cells that it touches. Null where no value can lie in the range."""
    width = high - low
    bounded = F.abs(low) + F.abs(high) < float("inf")
    far = F.greatest(F.abs(low), F.abs(high))
    power = lambda x: F.ceil(F.log2(F.when(x > 0, x))).cast("int")
    level = F.greatest(F.lit(FINEST), power(width), power(far) - 60)  # far from 0 cells are wider, so that their numbers are longs
    level = F.when(bounded & (width < float("inf")), level).otherwise(ENDLESS)
    held = F.sequence(cell(low, level), F.least(cell(high, level), cell(low, level) + 2))  # the logarithm may be an ulp short
    return F.when((low <= high) & ~F.isnan(low) & ~F.isnan(high), F.transform(held, lambda c: F.struct(level.alias("level"), c.alias("cell"))))


def cell(value: Column, level: Column) -> Column:
    return F.when(level == ENDLESS, F.lit(0).cast("bigint")).otherwise(F.floor(value / F.pow(F.lit(2.0), level)))


def interval_join(points: DataFrame, ranges: DataFrame, value: str, *, library: bool = False) -> DataFrame:
    """points ⋈ ranges where low <= value <= high; ranges of any number and widths.

    A range goes to the one or two dyadic cells of its own width, a point to its cell at each level that the ranges have (there
    are at most 1,045, and few in practice); both meet by equal cells, so that neither side is broadcast, a cell is less than
    twice as wide as its ranges, and wide ranges are not copied to narrow cells. Null and not-a-number values meet nothing, and
    neither do ranges with such bounds or with low above high; infinite bounds hold. Repeated rows stay repeated.
    A rule library (library=True), whose size its Library bounds, is broadcast.
    """
    inside = (F.col(value) >= F.col("low")) & (F.col(value) <= F.col("high")) & ~F.isnan(value)
    if library:
        return points.join(F.broadcast(ranges), inside)
    spread = ranges.withColumn("__c", F.explode(cells(F.col("low").cast("double"), F.col("high").cast("double"))))
    levels = [r["level"] for r in spread.select("__c.level").distinct().collect()]
    if not levels:
        return points.join(ranges, F.lit(False))
    number = F.col(value).cast("double")
    probes = F.array(*(F.struct(F.lit(n).alias("level"), cell(number, F.lit(n)).alias("cell")) for n in sorted(levels)))
    probed = points.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("__p", F.explode(probes))
    return probed.join(spread, F.col("__p") == F.col("__c")).where(inside).drop("__p", "__c")


def interval_summary(points: DataFrame, ranges: DataFrame, value: str) -> DataFrame:
    """Ranges that hold values of points, with n (how many), least and most of these; ranges of any number and widths.

    The same values meet the same ranges as in interval_join, but no pair of the two is made: distinct values and bounds stand
    in one order, dealt to parts by range, and a range reads running sums and neighbours at its two bounds. So the work follows
    points and ranges, not how many values the ranges hold.
    """
    low, high = F.col("low"), F.col("high")
    fine = ranges.where((low <= high) & ~F.isnan(low) & ~F.isnan(high))
    held = points.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    # a lower bound stands before its equal value, an upper one after it
    bound = lambda name, side: fine.select(F.col(name).alias("x")).distinct().select("x", F.lit(side).alias("side"), F.lit(0).cast("bigint").alias("n"))
    places = order.cut(held.select("x", F.lit(1).alias("side"), "n").union(bound("low", 0)).union(bound("high", 2)), "places")
    parts = max(1, math.ceil(places.count() / PLACES))
    places = places.repartitionByRange(parts, "x", "side").withColumn("part", F.spark_partition_id())
    dealt = order.cut(places, "dealt")  # the cuts between parts come from a sample and must stay
    seen = F.when(F.col("side") == 1, F.col("x"))
    sums = dealt.groupBy("part").agg(F.sum("n").alias("n"), F.min(seen).alias("first"), F.max(seen).alias("last"))
    earlier, later = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.max("last").over(earlier).alias("x_before"), F.min("first").over(later).alias("x_after"))
    up, down = W.partitionBy("part").orderBy("x", "side"), W.partitionBy("part").orderBy(F.desc("x"), F.desc("side"))
    so_far = lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = dealt.withColumns({"sum": F.sum("n").over(so_far(up)), "below": F.last(seen, True).over(so_far(up)), "above": F.last(seen, True).over(so_far(down))})
    rows = rows.where("side <> 1").join(F.broadcast(sums), "part")
    at = rows.select("x", "side", (F.col("n_before") + F.col("sum")).alias("sum"), F.coalesce("below", "x_before").alias("below"), F.coalesce("above", "x_after").alias("above"))
    lows = at.where("side = 0").select(F.col("x").alias("__low"), F.col("sum").alias("__below"), F.col("above").alias("least"))
    highs = at.where("side = 2").select(F.col("x").alias("__high"), F.col("sum").alias("__to"), F.col("below").alias("most"))
    found = fine.join(lows, low == F.col("__low")).join(highs, high == F.col("__high"))
    found = found.withColumn("n", F.col("__to") - F.col("__below")).where("n > 0")
    return found.select(*ranges.columns, "n", "least", "most")


def region_evidence(points: DataFrame, regions: tuple, *, library: bool = True) -> DataFrame:
    """id, rule_id, shifts (rising): regions that hold a peak of the sample. Bounds belong to their region."""
    hits = interval_join(points, regions_table(points.sparkSession, regions), "shift", library=library)
    return hits.groupBy("id", "rule_id").agg(F.array_sort(F.collect_list("shift")).alias("shifts"))


def region_labels(points: DataFrame, regions: tuple) -> DataFrame:
    """id, labels: the regions of each sample in the order of the rules."""
    hits = interval_join(points, regions_table(points.sparkSession, regions), "shift", library=True).select("id", "rule_order", "rule_id").distinct()
    return hits.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_order", "rule_id"))), lambda x: x["rule_id"]).alias("labels"))


def matches(integration: float, multiplicities: tuple[str, ...], tolerance: float) -> Column:
    return (F.abs(F.col("integration") - integration) <= tolerance) & F.col("multiplicity").isin(*multiplicities)


def region_lists(regions: tuple) -> list[Column]:
    """Aggregates: for each region the shifts in it, rising."""
    return [F.array_sort(F.collect_list(F.when(F.col("shift").between(r[1], r[2]), F.col("shift")))).alias(r[0]) for r in regions]


def first_peaks(rules: tuple) -> list[Column]:
    """Aggregates: for each rule of one peak the first that fits, null if none does."""
    out = []
    for rule, area, tolerance, mults, low, high, *_ in rules:
        ok = matches(area, mults, tolerance)
        ok = ok if low is None else ok & (F.col("shift") >= low)
        ok = ok if high is None else ok & (F.col("shift") <= high)
        out.append(F.min_by(F.struct("pos", "shift", "integration", "multiplicity"), F.when(ok, F.col("pos"))).alias(rule))
    return out


def pair_sides(rules: tuple) -> list[Column]:
    """Aggregates: for each rule of two peaks those that fit its first and its second side, by their places."""
    entry = F.struct("pos", "shift", "integration", "J")
    return [F.array_sort(F.collect_list(F.when(matches(area, mults, rule[3]), entry))).alias(f"{rule[0]}_{k}") for rule in rules for k, (area, mults) in enumerate(rule[1:3])]


def held_lists(regions: tuple) -> list[Column]:
    """For each region the shifts in it, of the rising list `shifts` of a sample."""
    held = lambda low, high: F.filter("shifts", lambda x: x.between(low, high))
    return [held(*r[1:3]).alias(r[0]) for r in regions]


def fits(p: Column, area: float, mults: tuple[str, ...], tolerance: float) -> Column:
    return (F.abs(p["integration"] - area) <= tolerance) & p["multiplicity"].isin(*mults)


def first_held(rule: tuple) -> Column:
    """The first of a sample's list `peaks` (by place) that fits a rule of one peak, null if none does."""
    _, area, tolerance, mults, low, high, *_ = rule

    def ok(p: Column) -> Column:
        held = p["pos"].isNotNull() & fits(p, area, mults, tolerance)
        held = held if low is None else held & (p["shift"] >= low)
        return held if high is None else held & (p["shift"] <= high)

    return F.get(F.filter("peaks", ok), F.lit(0))


def held_sides(rules: tuple) -> list[Column]:
    """For each rule of two peaks those of the list `peaks` that fit its first and its second side, by their places."""
    side = lambda *rule: F.filter("peaks", lambda p: fits(p, *rule))
    return [side(area, mults, rule[3]).alias(f"{rule[0]}_{k}") for rule in rules for k, (area, mults) in enumerate(rule[1:3])]


def first_pair(rule: tuple) -> Column:
    """matching_j, shift_1 and shift_2 of the first two peaks of the sides that share a coupling, null if none do."""
    tolerance = rule[4]

    def mean(x: Column, y: Column) -> Column:
        return F.array_min(F.flatten(F.transform(x["J"], lambda p: F.transform(F.filter(y["J"], lambda q: F.abs(p - q) <= tolerance), lambda q: (p + q) / 2.0))))

    pairs = F.flatten(F.transform(f"{rule[0]}_0", lambda x: F.transform(f"{rule[0]}_1", lambda y: F.struct(F.bround(mean(x, y), 3).alias("matching_j"), x["shift"].alias("shift_1"), y["shift"].alias("shift_2")))))
    return F.get(F.filter(pairs, lambda p: p["matching_j"].isNotNull()), 0)


def _found(rows: DataFrame, entries: list[tuple[str, Column, Column]]) -> DataFrame:
    """id, rule_id and value: a row for each (rule, condition, value) that holds."""
    held = [F.when(ok, F.struct(F.lit(rule).alias("rule_id"), value.alias("value"))) for rule, ok, value in entries]
    return rows.select("id", F.explode(F.array_compact(F.array(*held))).alias("x")).select("id", "x.rule_id", "x.value")


def single_peaks(peaks: DataFrame, rules: tuple = SINGLES) -> DataFrame:
    """id, rule_id and the first peak that fits, for rules of one peak. peaks: id, pos, shift, multiplicity, integration."""
    rows = peaks.groupBy("id").agg(*first_peaks(rules))
    return _found(rows, [(r[0], F.col(r[0]).isNotNull(), F.col(r[0])) for r in rules]).select("id", "rule_id", "value.*")


def paired_multiplets(peaks: DataFrame, rules: tuple = PAIRS) -> DataFrame:
    """id, rule_id, matching_j, shift_1, shift_2: the first two peaks, by their places, that share a coupling within the
    tolerance; the coupling is the least mean. Peaks of a sample meet inside one row, so one exchange by sample does."""
    rows = peaks.groupBy("id").agg(*pair_sides(rules)).select("id", *(first_pair(r).alias(r[0]) for r in rules))
    return _found(rows, [(r[0], F.col(r[0]).isNotNull(), F.col(r[0])) for r in rules]).select("id", "rule_id", "value.*")


def signal_counts(shifts: DataFrame, formulas: DataFrame) -> DataFrame:
    """id, observed (distinct 13C signals), carbons, feasible; feasible is null without a well-formed formula."""
    seen = shifts.groupBy("id").agg(F.countDistinct(F.bround("shift", 3)).alias("observed"))
    carbons = formulas.select("id", parsing.element_count(parsing.formula_tokens(F.col("formula")), "C").alias("carbons"))
    return seen.join(carbons, "id").select("id", "observed", "carbons", F.when(F.col("carbons") > 0, F.col("observed") <= F.col("carbons")).alias("feasible"))


def analyze(samples: DataFrame, h_peaks: DataFrame, c_shifts: DataFrame, *, include_formula: bool = True, library: Library = DEFAULT) -> DataFrame:
    """Evidence of all samples, a row each: id, rule_order, rule_id, category, conclusion, confidence, strength, human_tip,
    metadata (JSON). samples: id, formula, a row a sample; samples with peaks alone have evidence too.

    Each table of peaks is aggregated once, for all rules together, so one exchange by sample does for it; the joins by
    sample need no other.
    """
    spark = samples.sparkSession
    peaks = F.array_sort(F.collect_list(F.struct("pos", "shift", "integration", "multiplicity", "J")))
    h = h_peaks.groupBy(F.col("id").alias("h_id")).agg(peaks.alias("peaks"), F.array_sort(F.collect_list("shift")).alias("shifts"))
    h = h.select("h_id", *held_lists(library.h_regions), *(first_held(r).alias(r[0]) for r in library.singles), *held_sides(library.pairs))
    c = c_shifts.groupBy(F.col("id").alias("c_id")).agg(F.array_sort(F.collect_list("shift")).alias("shifts"))
    c = c.select("c_id", parsing.distinct_signals(F.col("shifts")).alias("observed"), *held_lists(library.c_regions))
    rows = h.join(c, F.col("h_id") == F.col("c_id"), "full").withColumn("peaks_id", F.coalesce("h_id", "c_id"))
    own = [
        F.trim("formula").alias("formula"),
        parsing.dbe(F.col("formula")).alias("dbe"),
        parsing.element_count(parsing.formula_tokens(F.col("formula")), "C").alias("carbons"),
    ]
    if include_formula:
        rows = rows.join(samples.select("id", *own), F.col("peaks_id") == F.col("id"), "full").withColumn("id", F.coalesce("id", "peaks_id"))
    else:
        rows = rows.withColumn("id", F.col("peaks_id"))
    rows = rows.withColumns({r[0]: first_pair(r) for r in library.pairs})
    json = lambda **fields: F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
    entries = [(r[0], F.size(r[0]) > 0, json(matching_shifts_ppm=F.col(r[0]))) for r in (*library.h_regions, *library.c_regions)]
    for r in library.pairs:
        p = F.col(r[0])
        entries.append((r[0], p.isNotNull(), json(matching_j_hz=p["matching_j"], shifts_ppm=F.array(p["shift_1"], p["shift_2"]))))
    for r in library.singles:
        p = F.col(r[0])
        entries.append((r[0], p.isNotNull(), json(shift_ppm=p["shift"], integration=p["integration"], multiplicity=p["multiplicity"])))
    texts = library.described(spark)
    said = F.lit(None).cast("string")
    if include_formula:
        observed, carbons = F.col("observed"), F.col("carbons")
        entries.append(("FORMULA_DBE_001", F.col("dbe").isNotNull(), json(formula=F.col("formula"), dbe=F.col("dbe"))))
        entries.append(("C13_SIGNAL_COUNT_001", (carbons > 0) & (observed <= carbons), json(observed_c13_signals=observed, formula_carbon_count=carbons)))
        given = [(0, "FORMULA_DBE_001", "formula", "", 1.0, "hard", FORMULA_TIP), (1, "C13_SIGNAL_COUNT_001", "cross_spectrum", "", 0.85, "moderate", COUNT_TIP)]
        texts = texts.select("rule_order", "rule_id", "category", "conclusion", "confidence", "strength", "human_tip").unionByName(
            spark.createDataFrame(given, "rule_order int, rule_id string, category string, conclusion string, confidence double, strength string, human_tip string")
        )
        said = F.when(F.col("rule_id") == "FORMULA_DBE_001", F.concat(F.lit("Molecular formula "), F.col("formula"), F.lit(" gives DBE = "), parsing.general(F.col("dbe")), F.lit("."))).when(
            F.col("rule_id") == "C13_SIGNAL_COUNT_001",
            F.concat(F.lit("The "), observed.cast("string"), F.lit(" distinct 13C signals are compatible with the "), carbons.cast("string"), F.lit(" carbons in the supplied formula.")),
        )
    held = [F.when(ok, F.struct(F.lit(rule).alias("rule_id"), value.alias("metadata"))) for rule, ok, value in entries]
    kept = ["formula", "dbe", "carbons", "observed"] if include_formula else []
    found = rows.select("id", *kept, F.explode(F.array_compact(F.array(*held))).alias("x")).select("id", *kept, "x.*")
    found = found.join(F.broadcast(texts), "rule_id").withColumn("conclusion", F.coalesce(said, F.col("conclusion")))  # a row a rule
    return found.select("id", "rule_order", "rule_id", "category", "conclusion", "confidence", "strength", "human_tip", "metadata")


def warnings(samples: DataFrame, h_peaks: DataFrame, c_shifts: DataFrame) -> DataFrame:
    """id, warning: formulas that can't be used, empty tables, and more signals than carbons."""
    rows = samples.join(h_peaks.groupBy("id").agg(F.count(F.lit(1)).alias("h")), "id", "left").join(signal_counts(c_shifts, samples), "id", "left")
    formula = F.nullif(F.trim("formula"), F.lit(""))
    texts = F.array_compact(
        F.array(
            F.when(formula.isNotNull() & parsing.dbe(formula).isNull(), F.lit("Formula constraints skipped.")),
            F.when(F.col("h").isNull(), F.lit("No valid 1H NMR peaks were available for rule analysis.")),
            F.when(F.col("observed").isNull(), F.lit("No valid 13C NMR peaks were available for rule analysis.")),
            F.when(~F.col("feasible"), F.concat(F.lit("Observed "), F.col("observed").cast("string"), F.lit(" distinct 13C signals for a formula with only "), F.col("carbons").cast("string"), F.lit(" carbons."))),
        )
    )
    return rows.select("id", F.explode(texts).alias("warning"))


def strength_rank(strength: Column) -> Column:
    out = F.lit(99)
    for i, s in enumerate(STRENGTHS):
        out = F.when(strength == s, F.lit(i)).otherwise(out)
    return out


def strongest(evidence: DataFrame, k: int = 12) -> DataFrame:
    """The k strongest pieces of each sample: by strength, falling confidence, then order; with their rank."""
    if k <= 0:
        raise ValueError("k must be positive")
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("id").orderBy(strength_rank(F.col("strength")), F.desc("confidence"), "rule_order"))
    return evidence.withColumn("rank", rank).where(F.col("rank") <= k)


def rule_context(evidence: DataFrame, warned: DataFrame | None = None, *, k: int = 12, library: Library = DEFAULT) -> DataFrame:
    """id, context: the text block that puts evidence, then warnings, into a prompt."""
    line = F.concat(F.lit("- ["), "strength", F.lit("; "), "rule_id", F.lit("] "), "conclusion")
    lines = strongest(evidence, k).select("id", F.col("rank"), line.alias("line"))
    if warned is not None:
        lines = lines.unionByName(warned.select("id", F.lit(1_000_000).alias("rank"), F.concat(F.lit("- [warning] "), "warning").alias("line")))
    head = F.lit(f"## Derived 1D NMR Constraints\nRule library: {library.name}")
    body = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    return lines.groupBy("id").agg(body.alias("lines")).select("id", F.concat_ws("\n", head, F.array_join("lines", "\n")).alias("context"))


def group_checks(groups: Column, h_shifts: Column, c_shifts: Column) -> Column:
    """Map of the checkable groups to whether the shifts support them."""
    between = lambda xs, r: F.exists(xs, lambda x: (x >= r[0]) & (x <= r[1]))
    entries = []
    for label, h, c, both in sorted(SUPPORT):
        ok = between(c_shifts, c) if h is None else (between(h_shifts, h) & between(c_shifts, c) if both else between(h_shifts, h) | between(c_shifts, c))
        entries.append(F.when(F.array_contains(groups, label), F.struct(F.lit(label).alias("key"), ok.alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def support_rate(checks: Column) -> Column:
    """Share of supported groups, null if none can be checked."""
    values = F.map_values(checks)
    return F.try_divide(F.size(F.filter(values, lambda x: x)), F.nullif(F.size(values), F.lit(0)))


def validate(candidates: DataFrame, evidence: DataFrame, counts: DataFrame) -> DataFrame:
    """Checks of candidates: id, checks (map), applicable, satisfied, rate, contradictions.

    candidates: id, valid, formula (its own), wanted (the sample's), fragments (rule ids whose pattern it has);
    counts: id, observed. Formulas compare by element counts; a malformed one fails the check and stops nothing.
    """
    found = evidence.where(F.col("rule_id").isin(*FRAGMENT_CHECKS)).groupBy("id").agg(F.collect_set("rule_id").alias("detected"))
    rows = candidates.join(counts.select("id", "observed"), "id", "left").join(found, "id", "left")
    own, wanted = parsing.formula_counts(F.col("formula")), parsing.formula_counts(F.col("wanted"))
    entries = lambda m: F.array_sort(F.map_entries(m))
    given = F.nullif(F.trim("wanted"), F.lit("")).isNotNull()
    carbons = F.coalesce(F.try_element_at(own, F.lit("C")), F.lit(0))
    check = lambda when, name, ok: F.when(when, F.struct(F.lit(name).alias("key"), F.coalesce(ok, F.lit(False)).alias("value")))
    valid = F.coalesce("valid", F.lit(False))
    checks = [
        check(F.lit(True), "valid_smiles", valid),
        check(valid & given, "formula_match", entries(own) == entries(wanted)),
        check(valid & given, "dbe_match", parsing.dbe(F.col("formula")) == parsing.dbe(F.col("wanted"))),
        check(valid & F.col("observed").isNotNull(), "c13_signal_count_feasible", F.col("observed") <= carbons),
        *(check(valid & F.array_contains("detected", r), r, F.array_contains("fragments", r)) for r in FRAGMENT_CHECKS),
    ]
    rows = rows.withColumn("entries", F.array_compact(F.array(*checks)))
    failed = F.transform(F.filter("entries", lambda e: ~e["value"]), lambda e: e["key"])
    n = F.size("entries")
    return rows.select("id", F.map_from_entries("entries").alias("checks"), n.alias("applicable"), (n - F.size(failed)).alias("satisfied"), ((n - F.size(failed)) / n).alias("rate"), failed.alias("contradictions"))
