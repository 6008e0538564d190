import random

import pytest
from pyspark.sql import functions as F

from specloom.functions import chemistry
from specloom.operators import evaluate, ingest, manifest, negatives, rules, tasks
from specloom.streaming import ingest as stream

PEAK = "id string, pos int, shift double, multiplicity string, J array<double>, integration double"


def ethanol(spark):
    h = spark.createDataFrame([("e", 1, 3.65, "q", [7.0], 2.0), ("e", 2, 1.18, "t", [7.0], 3.0), ("e", 3, 2.0, "brs", [], 1.0)], PEAK)
    c = spark.createDataFrame([("e", 58.1), ("e", 18.2)], "id string, shift double")
    return spark.createDataFrame([("e", "C2H6O")], "id string, formula string"), h, c


def test_rules_on_ethanol(spark):
    samples, h, c = ethanol(spark)
    found = {r.rule_id: r for r in rules.analyze(samples, h, c).collect()}
    assert {"FORMULA_DBE_001", "H1_FRAGMENT_ETHYL_001", "H1_SHIFT_HETEROATOM_SP3", "C13_SHIFT_HETEROATOM_SP3", "C13_SIGNAL_COUNT_001"} <= set(found)
    assert '"matching_j_hz":7.0' in found["H1_FRAGMENT_ETHYL_001"].metadata and found["FORMULA_DBE_001"].conclusion.endswith("DBE = 0.")
    labels = rules.region_labels(h.select("id", "shift"), rules.H_REGIONS).first().labels
    assert labels == ["H1_SHIFT_ALKYL", "H1_SHIFT_PI_OR_CARBONYL_ADJACENT", "H1_SHIFT_HETEROATOM_SP3"]
    assert rules.region_labels(c, rules.C_REGIONS).first().labels == ["C13_SHIFT_ALKYL", "C13_SHIFT_HETEROATOM_SP3"]
    text = rules.rule_context(rules.analyze(samples, h, c), k=3).first().context
    assert text.count("\n- [") == 3 and "DBE = 0" in text and "ethyl fragment" in text


def test_interval_join_both_ways(spark):
    points = spark.createDataFrame([(i, i * 0.37) for i in range(700)], "id int, shift double")
    ranges = rules.regions_table(spark, rules.C_REGIONS)
    pick = lambda w: {(r.id, r.rule_id) for r in rules.interval_join(points, ranges, "shift", library=w).collect()}
    assert pick(True) == pick(False)
    edge = spark.createDataFrame([(1, 50.0)], "id int, shift double")
    assert rules.interval_join(edge, ranges, "shift").count() == 2
    assert rules.interval_join(points, ranges.where("false"), "shift").count() == 0
    assert rules.interval_join(points.where("false"), ranges, "shift").count() == 0


def test_ranges_of_any_width(spark):
    """Widths from 0 to endless in one table, bounds on and beside cells, against plain Python; each range in three cells at most."""
    rng, inf, nan = random.Random(5), float("inf"), float("nan")
    widths = [0.0, 0.001, 0.3, 1.0, 2.0, 7.5, 1024.0, 1e6, 1e-12]
    own = [(low, low + rng.choice(widths)) for low in (rng.choice([rng.uniform(-1e6, 1e6), float(rng.randrange(-64, 64)), rng.uniform(-2, 2)]) for _ in range(300))]
    own += [(-inf, inf), (-inf, 0.0), (3.0, inf), (inf, inf), (5.0, 4.0), (None, 1.0), (1.0, None), (nan, 1.0), (0.0, nan), (-1.7e308, 1.7e308), (1e300, 1e300), (1.0, 1.0), (1.0, 1.0)]
    values = [x for low, high in own[:200] for x in (low, high, (low + high) / 2)] + [rng.uniform(-3, 3) for _ in range(300)] + [None, nan, inf, -inf, 1e300, 1.0, 1.0, -0.0, 0.0]
    ranges = spark.createDataFrame([(k, *r) for k, r in enumerate(own)], "r int, low double, high double")
    points = spark.createDataFrame(list(enumerate(values)), "p int, x double")
    fine = lambda x: x is not None and x == x
    want = sorted((p, r) for p, x in enumerate(values) if fine(x) for r, (low, high) in enumerate(own) if fine(low) and fine(high) and low <= x <= high)
    assert sorted((h.p, h.r) for h in rules.interval_join(points, ranges, "x").collect()) == want
    copies = ranges.select(F.size(rules.cells(F.col("low"), F.col("high"))).alias("n"), "low", "high").collect()
    assert max(c.n or 0 for c in copies) <= 3


def test_validation(spark):
    samples, h, c = ethanol(spark)
    evidence, counts = rules.analyze(samples, h, c), rules.signal_counts(c, samples)

    def check(smiles, wanted="C2H6O"):
        f = chemistry.inspect(smiles) or {}
        rows = spark.createDataFrame([("e", smiles in ("CCO", "CCCO"), f.get("formula"), wanted, f.get("fragments", []))], "id string, valid boolean, formula string, wanted string, fragments array<string>")
        return rules.validate(rows, evidence, counts).first()

    assert check("CCO").rate == 1.0 and check("CCO", "H6C2O").rate == 1.0
    bad = check("CCCO")
    assert bad.checks["formula_match"] is False and bad.rate < 1
    none = check("nope")
    assert (none.applicable, none.satisfied, none.contradictions) == (1, 0, ["valid_smiles"])


def test_group_support(spark):
    row = spark.createDataFrame([(["alcohol"], ["ketone"], [3.65, 1.18], [58.1, 18.2], [])], "a array<string>, k array<string>, h array<double>, c array<double>, n array<string>")
    rate = lambda g: rules.support_rate(rules.group_checks(F.col(g), F.col("h"), F.col("c")))
    assert row.select(rate("a"), rate("k"), rate("n")).first()[:] == (1.0, 0.0, None)


def test_candidate_filter_and_ranker(spark):
    texts = ["CCO", "OCC", "CCN", "C.C", "not_smiles"]
    rows = []
    for i, t in enumerate(texts):
        f = chemistry.inspect(t) or {}
        rows.append(("a", i, f.get("connectivity"), f.get("accepted", False), f.get("isotopes", 0), f.get("formula"), "C2H6O"))
    df = spark.createDataFrame(rows, "id string, pos int, connectivity string, accepted boolean, isotopes int, formula string, wanted string")
    got = evaluate.filter_candidates(df).first()
    assert (got.raw_count, got.unique_count, got.domain_valid, got.formula_valid, got.failed) == (5, 2, ["CCO", "CCN"], ["CCO"], False)
    pair = spark.createDataFrame([(["CCO", "COC"], "CCN"), (["CCO", "COC"], "COC"), ([], "C")], "c array<string>, a string")
    assert [tuple(r) for r in pair.select(*evaluate.resolve(F.col("c"), F.col("a"))).collect()] == [("CCO", True), ("COC", False), ("", True)]


def test_evaluation_of_two_rows(spark):
    rows = spark.createDataFrame([("a", '{"smiles":"CCO"}', "CCO"), ("b", "not_a_smiles", "CCN")], "id string, prediction string, reference string")
    texts = spark.createDataFrame([("CCO",), ("CCN",), ("not_a_smiles",)], "smiles string")
    got = evaluate.evaluate(rows, chemistry.facts(texts))
    s = evaluate.structure_summary(got).first()
    assert (s.valid_smiles, s.exact_match, s.formula_accuracy, s.mean_tanimoto, s.mean_tanimoto_valid_only) == (0.5, 0.5, 0.5, 0.5, 1.0)
    assert (s.output_format_compliant, s.invalid_bare_output, s.non_bare_output) == (0.5, 0.5, 0.0)
    assert s.ring_scaffold_match is None and s.exact_match_stereo is None


def test_multilabel(spark):
    rows = spark.createDataFrame([(["alcohol"], ["alcohol"]), (["ether"], ["alcohol"])], "predicted array<string>, reference array<string>")
    space = spark.createDataFrame([("alcohol",), ("ether",)], "label string")
    counts = evaluate.label_counts(rows, space)
    s = evaluate.multilabel_summary(rows, counts).first()
    assert (s.exact_match, s.micro_f1, round(s.macro_f1, 6)) == (0.5, 0.5, 0.333333)
    by = {r.label: r for r in counts.collect()}
    assert by["ether"].support == 0 and (by["alcohol"].precision, by["alcohol"].recall) == (1.0, 0.5)


def test_ranking_metrics(spark):
    rows = spark.createDataFrame([(["CCO", "COC", "CCN"],), (["COC", "CCO", "CCN"],), (["COC", "CCN"],)], "c array<string>")
    valid = F.transform("c", lambda x: x.isNotNull())
    assert [r[5] for r in rows.select(*evaluate.candidate_ranking(F.col("c"), F.lit("CCO"), valid)).collect()] == [1.0, 0.5, 0.0]


def test_splits_are_disjoint_and_nested(spark):
    rows = spark.createDataFrame([(str(i), f"m{i}", "C", f"s{i % 37}", [], 5, 3, 3, 0, "CDCl3", "CDCl3") for i in range(1000)], "id string, canonical_smiles string, molecular_formula string, murcko_scaffold string, violations array<string>, heavy_atom_count int, h_peak_count int, c_peak_count int, isotope_label_count int, h_solvent string, c_solvent string")
    split = manifest.scaffold_splits(manifest.quality(rows))
    assert manifest.split_overlap(split).first()[:] == (0, 0, 0) and split.groupBy("split").count().count() == 3
    order = manifest.balanced_order(split, by="split")
    sets = {(r.subset, r.id) for r in manifest.nested_subsets(order, [100, 300]).collect()}
    assert {i for s, i in sets if s == 100} < {i for s, i in sets if s == 300}
    first = [r.scaffold_key for r in order.where("split = 'train'").orderBy("position").limit(20).collect()]
    assert len(set(first)) == 20
    grouped = manifest.grouped_splits(rows.withColumn("canonical_smiles", F.concat(F.lit("g"), (F.col("id").cast("int") % 50).cast("string"))), val_fraction=0.2, test_fraction=0.2)
    assert grouped.groupBy("canonical_smiles").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert {r.split: r["count"] for r in grouped.groupBy("split").count().collect()} == {"train": 600, "val": 200, "test": 200}


def test_sidecar(spark):
    data = [("1", "CCCO", "C3H8O"), ("2", "CC(C)O", "C3H8O"), ("3", "CCOC", "C3H8O"), ("4", "CCN", "C2H7N")]
    rows = spark.createDataFrame(data, "id string, smiles string, formula string")
    facts = chemistry.facts(rows).select("smiles", "ring_scaffold", "groups", F.col("bits1024").alias("bits"))
    got = {r.id: r for r in negatives.sidecar(rows, facts).collect()}
    assert set(got) == {"1", "2", "3"}
    for r in got.values():
        assert len(set(r.candidates)) == 3 and r.target in r.candidates and r.negative_tanimoto == sorted(r.negative_tanimoto, reverse=True)
    assert negatives.report(rows).first()[:] == (4, 3, 1, 0.75)


def test_hardest_negatives_with_ties(spark):
    """Ties of scaffold and groups reach past the last place; fingerprints and names decide among them, as in plain Python."""
    rng = random.Random(2)
    facts = {f"m{k}": ("" if k % 3 == 0 else f"r{k % 2}", [["a"], ["a", "b"], []][k % 3], sorted(rng.sample(range(100), k % 5 * 7))) for k in range(40)}
    table = spark.createDataFrame([(s, *f) for s, f in facts.items()], "smiles string, ring_scaffold string, groups array<string>, bits array<int>")
    pairs = [(f"t{t}", t, "C", s, s) for t in facts for s in facts if s != t]
    got = negatives.hardest(spark.createDataFrame(pairs, "target_id string, target string, formula string, id string, smiles string"), table, 6)

    def score(t, s):
        (r, g, b), (q, h, c) = facts[t], facts[s]
        share = lambda x, y, none: len(set(x) & set(y)) / len({*x, *y}) if {*x, *y} else none
        return r != "" and r == q, share(g, h, 1.0), share(b, c, 0.0), s

    want = {(f"t{t}", s, k, *score(t, s)[:3]) for t in facts for k, s in enumerate(sorted((s for s in facts if s != t), key=lambda s: score(t, s), reverse=True)[:5], 1)}
    assert {(r.target_id, r.smiles, r["rank"], r.same_ring_scaffold, r.group_jaccard, r.tanimoto) for r in got.collect()} == want


def test_ingest_and_stream(spark, tmp_path):
    data = [(i, i % 5, ("1H NMR", "13C NMR", "19F")[i % 3], "CDCl3" if i % 4 else "", "[(1.0,)]") for i in range(300)]
    raw = spark.createDataFrame(data, "row_index long, mol_key long, nmr_type string, solvent string, processed string")
    assert ingest.counters(raw).first()[:] == (300, 200, 100)
    want = sorted(map(tuple, ingest.best_pairs(ingest.candidates(raw)).collect()))
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.start(source, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination(120)
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "state").iterdir() if p.name.startswith("batch="))
    assert sorted(map(tuple, stream.best_pairs(spark, str(tmp_path / "state"), last).collect())) == want


def test_tasks_and_masks(spark):
    rows = spark.createDataFrame(
        [("a", tasks.STRUCTURE, "CCO", None), ("b", tasks.RANKING, "CCO", ["CCO", "CN"]), ("c", tasks.RANKING, "CCO", ["CN"]), ("d", "other", "CCO", None), ("e", tasks.GROUPS, None, None)],
        "id string, task string, target string, candidates array<string>",
    ).withColumns({"template": F.lit(0), "body": F.lit("T"), "connectivity": F.col("target"), "groups": F.array(F.lit("b"), F.lit("a")), "h_regions": F.array().cast("array<string>"), "c_regions": F.array().cast("array<string>")})
    got = {r.id: r for r in tasks.task_examples(rows, labels=("a", "b")).collect()}
    assert got["a"].target == '{"smiles":"CCO"}' and "\n\nT\n\n" in got["a"].prompt
    assert "1. CCO\n2. CN" in got["b"].prompt
    assert (got["c"].reject, got["d"].reject, got["e"].reject) == ("target_not_in_candidates", "unsupported_task", "invalid_target")
    mask = spark.createDataFrame([([10, 11, 12, 13],)], "ids array<int>").select(tasks.response_mask(F.col("ids"), F.lit(2), F.lit(2))).first()[0]
    assert mask == [-100, -100, 12, 13]


def test_counters_of_records_and_structures(spark):
    raw = spark.createDataFrame([("CCO", "1H NMR")] * 5 + [("[13CH3]CO", "13C")] * 2 + [("C.C", "1H"), ("nope", "1H"), (None, "1H"), ("nope", "19F"), ("CCO", None)], "smiles string, nmr_type string")
    facts = chemistry.facts(raw)
    assert ingest.molecule_counters(raw, facts).first()[:] == (12, 7, 2, 2, 2, 2)
    assert {tuple(r) for r in ingest.rejections(raw, facts).collect()} == {("multiple_components", 1), ("invalid_smiles", 2)}
    none = raw.limit(0)
    assert ingest.molecule_counters(none, facts).first()[:] == (0,) * 6 and ingest.rejections(none, facts).count() == 0


def test_ranking_without_candidates_falls_back(spark):
    rows = spark.createDataFrame([(i, tasks.RANKING) for i in range(3)] + [(3, tasks.GROUPS)], "id int, task string")
    sidecar = spark.createDataFrame([(0, ["a"]), (1, [])], "id int, candidates array<string>")
    got = {r.id: r.task for r in tasks.with_fallback(rows, sidecar).collect()}
    assert got == {0: tasks.RANKING, 1: tasks.STRUCTURE, 2: tasks.STRUCTURE, 3: tasks.GROUPS}


def test_sizes_of_splits_and_means_of_the_funnel(spark):
    rows = spark.createDataFrame([("a", "train", 4), ("b", "train", None), ("a", None, 1)], "run string, split string, raw int")
    assert {tuple(r) for r in manifest.split_sizes(rows).collect()} == {("train", 2), ("", 1)}
    assert {tuple(r) for r in evaluate.funnel_means(rows, ("raw",)).collect()} == {("a", 2.5), ("b", 0.0)}
    assert [r.canonical_smiles for r in ingest.first_samples(rows.withColumnRenamed("run", "canonical_smiles"), 2).collect()] == ["a", "a"]


def test_tokens_by_a_vocabulary_file(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer(tokenizers.models.WordLevel({"?": 0, "a": 1, "b": 2}, unk_token="?"))
    own.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    own.save(str(tmp_path / "t.json"))
    rows = spark.createDataFrame([("a b a",), ("c  b",), ("",), (None,), ("a " * 9,)], "t string")
    assert [r.ids for r in tasks.tokenize(rows, "t", str(tmp_path / "t.json")).collect()] == [[1, 2, 1], [0, 2], [], [], [1] * 9]
    assert [r.ids for r in tasks.tokenize(rows, "t", str(tmp_path / "t.json"), length=4, pad=7).collect()] == [[1, 2, 1, 7], [0, 2, 7, 7], [7] * 4, [7] * 4, [1] * 4]


def test_range_summary_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(rules, "PLACES", 7)  # many parts
    inf, nan = float("inf"), float("nan")
    values = [k * 7 % 50 / 2.0 for k in range(80)] + [3.0, 3.0, -5.0, inf, None, nan]
    bounds = [(k % 11 - 3.0, k % 11 - 3.0 + (k % 5) * 2.5) for k in range(40)] + [(3.0, 3.0), (2.6, 2.9), (4.0, 1.0), (-inf, inf), (10.0, inf), (None, 5.0), (nan, 9.0), (200.0, 300.0)]
    points = spark.createDataFrame([(v,) for v in values], "v double")
    ranges = spark.createDataFrame([(k, *b) for k, b in enumerate(bounds)], "k int, low double, high double")
    got = {r.k: (r.n, r.least, r.most) for r in rules.interval_summary(points, ranges, "v").collect()}
    want = {}
    for k, (a, b) in enumerate(bounds):
        inside = [v for v in values if None not in (v, a, b) and a <= v <= b]
        if inside:
            want[k] = (len(inside), min(inside), max(inside))
    assert got == want and len(want) > 30
    # 4,000 ranges that each hold 300,000 values: 1.2e9 pairs, which are never made
    wide = spark.range(4000).select(F.col("id").alias("k"), (-1.0 - F.col("id")).alias("low"), F.lit(1e9).alias("high"))
    monkeypatch.setattr(rules, "PLACES", 500_000)
    rows = rules.interval_summary(spark.range(300_000).select(F.col("id").cast("double").alias("v")), wide, "v")
    assert rows.agg(F.count(F.lit(1)), F.min("n"), F.max("most")).first() == (4000, 300_000, 299_999.0)


def test_evidence_gathers_the_peaks_of_a_sample_once(spark):
    samples = spark.createDataFrame([(1, " C2H6O "), (2, "C0H"), (3, None)], "id long, formula string")
    peaks = spark.createDataFrame([(1, 2, 1.0, "t", [7.0], 3.0), (1, 1, 3.5, "q", [7.2], 2.0), (1, 3, 3.6, "s", [], 3.0), (1, 4, 3.1, "s", [], 3.0)], "id long, pos int, shift double, multiplicity string, J array<double>, integration double")
    shifts = spark.createDataFrame([(1, 60.0), (1, 18.0), (1, None)], "id long, shift double")
    found = rules.analyze(samples, peaks, shifts)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 3 and plan.count("regexp_extract_all") <= 4
    got = {r.rule_id: r.metadata for r in found.collect()}
    assert '"shift_ppm":3.6' in got["H1_FRAGMENT_METHOXY_001"] and '"shifts_ppm":[1.0,3.5]' in got["H1_FRAGMENT_ETHYL_001"]
    assert got["H1_SHIFT_HETEROATOM_SP3"] == '{"matching_shifts_ppm":[3.1,3.5,3.6]}' and '"dbe":0.0' in got["FORMULA_DBE_001"] and "C13_SIGNAL_COUNT_001" in got
