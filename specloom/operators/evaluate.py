"""Evaluation of predicted structures: candidate filters, ranking, row metrics, and summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specloom.functions import outputs
from specloom.functions.sets import overlap_scores, tanimoto


def filter_candidates(rows: DataFrame) -> DataFrame:
    """Candidates by sample: counts and the lists that stay after each constraint.

    rows: id, pos, connectivity, accepted, isotopes, formula, wanted (the sample's formula or null). A structure stays
    where it comes first; the formula compares as text.
    """
    fine = F.col("accepted") & (F.col("isotopes") == 0) & F.col("connectivity").isNotNull()
    first = F.row_number().over(W.partitionBy("id", "connectivity").orderBy((~F.coalesce(fine, F.lit(False))).cast("int"), "pos"))
    rows = rows.withColumn("kept", F.coalesce(fine, F.lit(False)) & (first == 1))
    wanted = F.nullif(F.trim("wanted"), F.lit(""))
    entry = F.struct("pos", "connectivity")
    names = lambda c: F.transform(F.array_sort(c), lambda x: x["connectivity"])
    out = rows.groupBy("id").agg(
        F.count(F.lit(1)).alias("raw_count"),
        F.first(wanted, ignorenulls=True).alias("wanted"),
        names(F.collect_list(F.when(F.col("kept"), entry))).alias("domain_valid"),
        names(F.collect_list(F.when(F.col("kept") & (F.col("formula") == wanted), entry))).alias("formula_valid"),
    )
    given = F.col("wanted").isNotNull()
    return out.select(
        "id",
        "raw_count",
        F.size("domain_valid").alias("unique_count"),
        "domain_valid",
        "formula_valid",
        given.alias("applicable"),
        (given & (F.size("formula_valid") == 0)).alias("failed"),
        F.when(given, F.col("formula_valid")).otherwise(F.col("domain_valid")).alias("selectable"),
    )


def presort(rows: DataFrame) -> DataFrame:
    """Adds rank: candidates by falling support rate (none counts as 0), then by place. rows: id, pos, support."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc(F.coalesce("support", F.lit(0.0))), "pos")))


def resolve(candidates: Column, answer: Column) -> list[Column]:
    """Prediction and whether ranking failed: the answer if it is a candidate, else the first candidate, else ''."""
    inside = F.coalesce(F.array_contains(candidates, answer), F.lit(False))
    return [F.when(inside, answer).otherwise(F.coalesce(F.get(candidates, 0), F.lit(""))), ~inside]


def constrain_and_rank(filtered: DataFrame, supports: DataFrame, reference: DataFrame, ranker: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Samples from filtered candidates to a prediction: pre-sort, oracle flags, and a ranker where more than one is left.

    supports: id, connectivity, support. reference: id, exact, connectivity. ranker: from (id, candidates) to (id, answer);
    without one the first candidate is taken and counts as failed.
    """
    spread = filtered.select("id", F.posexplode("selectable").alias("pos", "connectivity")).join(supports, ["id", "connectivity"], "left")
    lists = presort(spread).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "connectivity"))), lambda x: x["connectivity"]).alias("candidates"))
    rows = filtered.join(lists, "id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    rows = rows.join(reference.select("id", "exact", F.col("connectivity").alias("reference_connectivity")), "id", "left")
    many = F.size("candidates") > 1
    if ranker is not None:
        rows = rows.join(ranker(rows.where(many).select("id", "candidates")), "id", "left")
    else:
        rows = rows.withColumn("answer", F.lit(None).cast("string"))
    prediction, failed = resolve(F.col("candidates"), F.col("answer"))
    return rows.withColumns(
        {
            "candidate_oracle_exact": F.coalesce(F.array_contains("candidates", F.col("exact")), F.lit(False)),
            "candidate_oracle_connectivity": F.coalesce(F.array_contains("candidates", F.col("reference_connectivity")), F.lit(False)),
            "ranking_attempted": many,
            "ranking_failed": many & failed,
            "prediction": F.when(many, prediction).otherwise(F.coalesce(F.get("candidates", 0), F.lit(""))),
        }
    )


def candidate_ranking(ranked: Column, reference: Column, valid: Column) -> list[Column]:
    """Covered, valid rate, top-1, hits at 3 and 5, reciprocal rank. ranked and valid are arrays."""
    rank = F.coalesce(F.array_position(ranked, reference), F.lit(0))
    flag = lambda c: c.cast("double")
    share = F.coalesce(F.try_divide(F.size(F.filter(valid, lambda x: x)), F.size(valid)), F.lit(0.0))
    return [flag(rank > 0), share, flag(rank == 1), flag((rank > 0) & (rank <= 3)), flag((rank > 0) & (rank <= 5)), F.when(rank > 0, 1.0 / rank).otherwise(0.0)]


DOMAIN_FLAGS = ("has_only_allowed_elements", "is_single_component", "is_neutral", "has_no_radicals", "has_no_isotope_labels", "domain_valid_smiles")
FACTS = ("canonical", "connectivity", "formula", "ring_scaffold", "groups", "bits2048", "accepted", "isotopes", "stereo", "components", "charge", "radicals", "elements_ok")


def evaluate(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Metrics of each prediction. rows: id, prediction (text), reference. facts: molecule dimension by smiles, which has
    every structure of rows (see chemistry.with_facts)."""
    rows = rows.withColumn("extracted", outputs.final_smiles(F.col("prediction")))
    side = lambda p: facts.select(F.col("smiles").alias(f"{p}_smiles"), *(F.col(n).alias(f"{p}_{n}") for n in FACTS))
    rows = rows.join(side("p"), F.col("extracted") == F.col("p_smiles"), "left").join(side("r"), F.col("reference") == F.col("r_smiles"), "left")
    valid = F.col("p_canonical").isNotNull()
    both = valid & F.col("r_canonical").isNotNull()
    same = lambda n: F.coalesce(both & (F.col(f"p_{n}") == F.col(f"r_{n}")), F.lit(False))
    none = F.array().cast("array<string>")
    p, r, f = overlap_scores(F.coalesce("p_groups", none), F.coalesce("r_groups", none), both)
    state = outputs.output_state(F.col("prediction"), lambda s: F.when(s == F.col("extracted"), valid).otherwise(F.lit(False)))
    ring = F.coalesce(F.col("r_ring_scaffold"), F.lit("")) != ""
    return rows.select(
        "id",
        "prediction",
        "reference",
        F.col("p_canonical").alias("predicted_smiles"),
        valid.alias("valid_smiles"),
        same("canonical").alias("exact_match"),
        same("connectivity").alias("connectivity_exact_match"),
        same("formula").alias("formula_match"),
        F.when(ring, same("ring_scaffold")).alias("ring_scaffold_match"),
        ring.alias("ring_scaffold_applicable"),
        F.coalesce("r_stereo", F.lit(False)).alias("reference_stereo"),
        F.when(both, tanimoto(F.col("p_bits2048"), F.col("r_bits2048"))).otherwise(0.0).alias("tanimoto"),
        F.coalesce("p_groups", none).alias("predicted_groups"),
        F.coalesce("r_groups", none).alias("reference_groups"),
        p.alias("group_precision"),
        r.alias("group_recall"),
        f.alias("group_f1"),
        state.alias("output_state"),
        *(F.coalesce(c, F.lit(False)).alias(n) for n, c in domain_flags("p").items()),
    )


def domain_flags(prefix: str) -> dict[str, Column]:
    """Six flags of a structure's place in the domain."""
    c = lambda n: F.col(f"{prefix}_{n}")
    valid = c("canonical").isNotNull()
    return {
        "has_only_allowed_elements": valid & c("elements_ok"),
        "is_single_component": valid & (c("components") == 1),
        "is_neutral": valid & (c("charge") == 0),
        "has_no_radicals": valid & (c("radicals") == 0),
        "has_no_isotope_labels": valid & (c("isotopes") == 0),
        "domain_valid_smiles": c("accepted") & (c("isotopes") == 0),
    }


def rate(flag: str | Column) -> Column:
    c = F.col(flag) if isinstance(flag, str) else flag
    return F.avg(c.cast("double"))


def structure_summary(rows: DataFrame) -> DataFrame:
    """One row of rates over all predictions; those over a stratum are null where it is empty."""
    state = lambda s: rate(F.col("output_state") == s)
    t = F.col("tanimoto")
    return rows.agg(
        F.count(F.lit(1)).alias("num_examples"),
        rate("valid_smiles").alias("valid_smiles"),
        rate("exact_match").alias("exact_match"),
        rate("connectivity_exact_match").alias("connectivity_exact_match"),
        rate("formula_match").alias("formula_accuracy"),
        F.avg(t).alias("mean_tanimoto"),
        F.avg(F.when(F.col("valid_smiles"), t)).alias("mean_tanimoto_valid_only"),
        F.percentile(t, F.lit(0.5)).alias("median_tanimoto"),
        F.percentile(t, F.lit(0.25)).alias("tanimoto_q25"),
        F.percentile(t, F.lit(0.75)).alias("tanimoto_q75"),
        *(rate(t >= x).alias(f"tanimoto_ge_{str(x).replace('.', '_')}") for x in (0.3, 0.5, 0.7, 0.85)),
        state("compliant").alias("output_format_compliant"),
        state("invalid").alias("invalid_bare_output"),
        state("non_bare").alias("non_bare_output"),
        F.avg("group_precision").alias("group_precision_sample_macro"),
        F.avg("group_recall").alias("group_recall_sample_macro"),
        F.avg("group_f1").alias("group_f1_sample_macro"),
        rate(F.when(~F.col("reference_stereo"), F.col("exact_match"))).alias("exact_match_achiral"),
        rate(F.when(F.col("reference_stereo"), F.col("exact_match"))).alias("exact_match_stereo"),
        rate("ring_scaffold_applicable").alias("ring_scaffold_coverage"),
        rate(F.when(F.col("ring_scaffold_applicable"), F.col("ring_scaffold_match"))).alias("ring_scaffold_match"),
        *(rate(n).alias(n) for n in DOMAIN_FLAGS),
    )


def support_summary(rows: DataFrame) -> DataFrame:
    """Coverage, mean where applicable, and mean with 0 elsewhere of the column support."""
    return rows.agg(
        F.coalesce(F.try_divide(F.count("support"), F.count(F.lit(1))), F.lit(0.0)).alias("support_coverage"),
        F.avg("support").alias("support_mean"),
        F.avg(F.coalesce("support", F.lit(0.0))).alias("support_end_to_end"),
    )


def check_rates(rows: DataFrame) -> DataFrame:
    """Each check of the map column checks: applicable, passed, rate."""
    return rows.select(F.explode("checks").alias("check", "ok")).groupBy("check").agg(F.count(F.lit(1)).alias("applicable"), F.count_if("ok").alias("passed"), rate("ok").alias("rate"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _scores(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return p, r, _ratio(2 * p * r, p + r)


def label_counts(rows: DataFrame, space: DataFrame | None = None) -> DataFrame:
    """Per label: tp, fp, fn, support, precision, recall, f1. rows: predicted and reference, arrays of labels.

    Labels of the space that never come are counted with zeros. Each row is read once; only its labels are exploded.
    """
    each = lambda c, p, r: F.transform(F.array_distinct(c), lambda x: F.struct(x.alias("label"), F.lit(p).alias("p"), F.lit(r).alias("r")))
    pred, ref = F.array_distinct("predicted"), F.array_distinct("reference")
    marks = rows.select(F.explode(F.concat(each(F.array_intersect(pred, ref), 1, 1), each(F.array_except(pred, ref), 1, 0), each(F.array_except(ref, pred), 0, 1))).alias("m")).select("m.*")
    counts = marks.groupBy("label").agg(F.sum(F.col("p") * F.col("r")).alias("tp"), F.sum(F.col("p") * (1 - F.col("r"))).alias("fp"), F.sum(F.col("r") * (1 - F.col("p"))).alias("fn"))
    if space is not None:
        counts = counts.join(space.select("label").distinct(), "label", "full").na.fill(0, ["tp", "fp", "fn"])
    p, r, f = _scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select("label", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), p.alias("precision"), r.alias("recall"), f.alias("f1"))


def multilabel_summary(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Exact match, micro scores, macro scores over all labels and over those with support."""
    p, r, f = _scores(F.sum("tp"), F.sum("fp"), F.sum("fn"))
    supported = lambda c: F.coalesce(F.avg(F.when(F.col("support") > 0, F.col(c))), F.lit(0.0))
    total = counts.agg(p.alias("micro_precision"), r.alias("micro_recall"), f.alias("micro_f1"), F.avg("f1").alias("macro_f1"), supported("f1").alias("supported_macro_f1"))
    same = F.array_sort(F.array_distinct("predicted")) == F.array_sort(F.array_distinct("reference"))
    return rows.agg(F.count(F.lit(1)).alias("num_examples"), rate(same).alias("exact_match")).crossJoin(total)  # one row each


def per_label_map(counts: DataFrame) -> DataFrame:
    """All labels' scores as one map."""
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("label").alias("key"), F.struct("precision", "recall", "f1", "support").alias("value"))))).alias("per_label"))


def constrained_summary(rows: DataFrame) -> DataFrame:
    """Coverage, failure, candidate counts, oracles and ranking of constrained generation; no attempts give a failure rate of 0."""
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("num_examples"),
        rate("applicable").alias("formula_constraint_applicable_rate"),
        rate(F.when(F.col("applicable"), ~F.col("failed"))).alias("formula_constraint_coverage"),
        rate("failed").alias("formula_constraint_failure_rate"),
        F.avg("raw_count").alias("mean_raw_candidate_count"),
        F.avg("unique_count").alias("mean_unique_candidate_count"),
        F.avg(F.size("domain_valid")).alias("mean_domain_valid_candidate_count"),
        F.avg(F.size("formula_valid")).alias("mean_formula_valid_candidate_count"),
        rate(flag("candidate_oracle_exact")).alias("candidate_oracle_exact"),
        rate(flag("candidate_oracle_connectivity")).alias("candidate_oracle_connectivity"),
        rate(flag("ranking_attempted")).alias("ranking_attempt_rate"),
        F.coalesce(rate(F.when(flag("ranking_attempted"), flag("ranking_failed"))), F.lit(0.0)).alias("ranking_failure_rate"),
    )


def generation_rows(rows: DataFrame, *, eos: int, max_new: int) -> DataFrame:
    """id, prediction, generated_tokens, ended, truncated, repeated. rows: id, prediction, tokens."""
    names = ("generated_tokens", "ended", "truncated", "repeated")
    return rows.select("id", "prediction", *(c.alias(n) for c, n in zip(outputs.trace(F.col("tokens"), eos, max_new), names, strict=True)))


def generation_summary(rows: DataFrame) -> DataFrame:
    """Token counts, rates of the trace's flags, and the shares of distinct and repeated predictions."""
    unique = F.try_divide(F.countDistinct(F.trim("prediction")), F.count("prediction"))
    return rows.agg(
        F.avg("generated_tokens").alias("mean_generated_tokens"),
        F.percentile("generated_tokens", F.lit(0.5)).alias("median_generated_tokens"),
        rate("ended").alias("eos_rate"),
        rate("truncated").alias("truncation_rate"),
        rate("repeated").alias("repetition_rate"),
        unique.alias("unique_prediction_rate"),
        (1 - unique).alias("duplicate_prediction_rate"),
    )


def log_summary(rows: DataFrame) -> DataFrame:
    """By kind of log entry: count, last loss, least loss and the step at which it first came. rows: kind, pos, step, loss."""
    seen = F.col("loss").isNotNull()
    return rows.groupBy("kind").agg(
        F.count(F.lit(1)).alias("entries"),
        F.max_by("loss", F.when(seen, F.col("pos"))).alias("last_loss"),
        F.min("loss").alias("best_loss"),
        F.min_by("step", F.when(seen, F.struct("loss", "pos"))).alias("best_step"),
    )


def upgrade_rows(rows: DataFrame) -> DataFrame:
    """Prediction rows of the older generation in today's columns: renamed fields, and defaults for those it lacks."""
    have = set(rows.columns)
    first = lambda *n: F.coalesce(*[F.col(x) for x in n if x in have], F.lit(None))
    return rows.select(
        first("id", "sample_id").alias("id"),
        first("prediction", "pred", "response").cast("string").alias("prediction"),
        first("reference", "ref", "target").cast("string").alias("reference"),
        F.coalesce(first("exact_match").cast("boolean"), F.lit(False)).alias("exact_match"),
        F.coalesce(first("tanimoto", "tanimoto_similarity").cast("double"), F.lit(0.0)).alias("tanimoto"),
    )


def aligned(predictions: DataFrame, references: DataFrame, key: str = "id") -> DataFrame:
    """predictions ⋈ references; a key that only one side has stops the job."""
    both = predictions.withColumn("__p", F.lit(True)).join(references.withColumn("__r", F.lit(True)), key, "full")
    bad = F.col("__p").isNull() | F.col("__r").isNull()
    return both.withColumn(key, F.when(bad, F.raise_error(F.lit("predictions and references don't have the same keys"))).otherwise(F.col(key))).drop("__p", "__r")


def funnel_means(rows: DataFrame, stages: tuple[str, ...], by: str = "run") -> DataFrame:
    """by, and for each stage of the candidate funnel its mean; what a row lacks counts as 0."""
    return rows.groupBy(by).agg(*(F.avg(F.coalesce(F.col(s).cast("double"), F.lit(0.0))).alias(s) for s in stages))
