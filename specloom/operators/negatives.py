"""Hard negatives: other molecules of the same formula, nearest first."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specloom.functions.sets import tanimoto
from specloom.operators import order

SEED, POOL, SHOWN = 3407, 512, 8
#: Targets, and structures, of one formula that meet under one key, and pairs of a task.
BLOCK, PAIRS = 1024, 500_000


def stable_hash(seed: int, *columns):
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *columns), 256)


def formula_pairs(rows: DataFrame, *, seed: int = SEED, pool: int = POOL) -> DataFrame:
    """Each target with other structures of its formula: target_id, target, formula, id, smiles.

    A structure counts once, by its first id. Targets with more than `pool` keep those whose hash of (seed, target, id) is
    least. Only keys take part in this join; facts of structures are joined to the survivors. Targets and structures of a
    common formula meet in blocks of BLOCK, a block of structures as one list, of which a target's pool is cut inside its row;
    tasks follow the pairs. Rows are ranked by target only where its structures are in more blocks, or its id isn't its own.
    """
    unique = rows.groupBy("formula", "smiles").agg(F.min("id").alias("id"))
    parts = rows.groupBy("formula").agg(F.count(F.lit(1)).alias("targets"))
    blocks = unique.groupBy("formula").agg(F.count(F.lit(1)).alias("kinds"))
    number = lambda of: F.ceil(F.col(of) / BLOCK).cast("int")
    deal = parts.join(blocks, "formula").select("formula", "targets", "kinds", number("targets").alias("parts"), number("kinds").alias("blocks"))
    all_pairs = F.col("targets") * F.col("kinds")
    sums = deal.agg(F.sum(all_pairs).alias("pairs"), F.sum(F.when(F.col("blocks") > 1, all_pairs)).alias("far"), F.max("kinds").alias("most")).first()
    own_ids = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    tasks = lambda n: max(1, math.ceil((n or 0) / PAIRS))
    deal = deal.select("formula", "parts", "blocks")
    dealt = lambda of, by: F.pmod(F.xxhash64(by), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    keys = ["formula", "part", "block"]
    targets = rows.select(F.col("id").alias("target_id"), F.col("smiles").alias("target"), "formula").join(deal, "formula")
    targets = targets.select("target_id", "target", "formula", "blocks", dealt("parts", "target_id").alias("part"), every("blocks").alias("block"))
    lists = unique.join(deal, "formula").select("formula", "parts", dealt("blocks", "id").alias("block"), F.struct("id", "smiles").alias("s"))
    lists = lists.groupBy("formula", "parts", "block").agg(F.collect_list("s").alias("kinds")).select("formula", "block", "kinds", every("parts").alias("part"))
    n = tasks(sums.pairs)
    met = targets.repartition(n, *keys).join(lists.repartition(n, *keys), keys)
    out = [F.col("target_id"), F.col("target"), F.col("formula")]

    def pairs(met: DataFrame, cut: bool) -> DataFrame:
        others = F.filter("kinds", lambda x: x["smiles"] != F.col("target"))
        if cut:
            hashed = F.transform("others", lambda x: F.struct(stable_hash(seed, "target_id", x["id"]).alias("h"), x["id"].alias("id"), x["smiles"].alias("smiles")))
            first = F.transform(F.slice(F.array_sort(hashed), 1, pool), lambda x: F.struct(x["id"].alias("id"), x["smiles"].alias("smiles")))
            met = met.select(*out, others.alias("others")).select(*out, F.when(F.size("others") <= pool, F.col("others")).otherwise(first).alias("others"))
        else:
            met = met.select(*out, others.alias("others"))
        return met.select(*out, F.explode("others").alias("x")).select(*out, "x.id", "x.smiles")

    if (sums.most or 0) <= pool and own_ids:
        return pairs(met, False)
    far = met if not own_ids else met.where("blocks > 1")
    far = pairs(far, own_ids).repartition(tasks(sums.far if own_ids else sums.pairs), "target_id")
    rank = F.row_number().over(W.partitionBy("target_id").orderBy(stable_hash(seed, "target_id", "id"), "id"))
    far = far.withColumn("pool_rank", rank).where(F.col("pool_rank") <= pool).drop("pool_rank")
    return pairs(met.where("blocks = 1"), True).union(far) if own_ids else far


def overlaps(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds same_ring_scaffold and group_jaccard. facts: smiles, ring_scaffold, groups, one row a structure."""
    groups = F.array_distinct("groups")  # once a structure, so that a pair needs the shared ones alone
    own = facts.select(F.col("smiles").alias("target"), F.col("ring_scaffold").alias("s1"), groups.alias("g1"))
    other = facts.select("smiles", F.col("ring_scaffold").alias("s2"), groups.alias("g2"))
    same = F.coalesce((F.col("s1") != "") & (F.col("s1") == F.col("s2")), F.lit(False))
    shared = F.size(F.array_intersect("g1", "g2"))
    either = F.size("g1") + F.size("g2") - shared
    alike = F.when(either == 0, F.lit(1.0)).otherwise(shared / F.when(either != 0, either))
    rows = pairs.join(own, "target").join(other, "smiles")
    return rows.select("target_id", "target", "formula", "id", "smiles", same.alias("same_ring_scaffold"), alike.alias("group_jaccard"))


def similar(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds tanimoto. facts: smiles, bits, one row a structure."""
    bits = facts.select("smiles", F.col("bits").alias("b1"))
    rows = rows.join(bits.withColumnRenamed("smiles", "target"), "target").join(bits.withColumnRenamed("b1", "b2"), "smiles")
    return rows.withColumn("tanimoto", tanimoto(F.col("b1"), F.col("b2"))).drop("b1", "b2")


def scored(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds same_ring_scaffold, group_jaccard and tanimoto to all pairs. facts: smiles, ring_scaffold, groups, bits."""
    facts = order.cut(facts, "facts")  # of a known size, so that pairs needn't move where the facts are few
    return similar(overlaps(pairs, facts), facts).select("target_id", "target", "formula", "id", "smiles", "same_ring_scaffold", "group_jaccard", "tanimoto")


def hardest(pairs: DataFrame, facts: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The shown - 1 hardest negatives of each target, scored, with their rank.

    Scaffold and groups come before the fingerprints in the order, so a pair that has shown - 1 others before it by these two
    can't be among the hardest: fingerprints are read and moved for the rest only, all ties included.
    """
    if shown < 2:
        raise ValueError("at least one negative must be shown")
    first = (F.desc("same_ring_scaffold"), F.desc("group_jaccard"))
    own = W.partitionBy("target_id")
    facts = order.cut(facts, "facts")  # of a known size, so that pairs needn't move where the facts are few
    near = overlaps(pairs, facts).withColumn("ahead", F.rank().over(own.orderBy(*first))).where(F.col("ahead") < shown).drop("ahead")
    rank = F.row_number().over(own.orderBy(*first, F.desc("tanimoto"), F.desc("smiles")))
    return similar(near, facts).withColumn("rank", rank).where(F.col("rank") < shown)


def sidecar(rows: DataFrame, facts: DataFrame, *, seed: int = SEED, pool: int = POOL, shown: int = SHOWN) -> DataFrame:
    """One record a target: candidates (target and negatives in hashed order), and the negatives with their hardness."""
    best = hardest(formula_pairs(rows, seed=seed, pool=pool), facts, shown)
    entry = F.struct("rank", "smiles", "same_ring_scaffold", F.round("group_jaccard", 6).alias("functional_group_jaccard"), F.round("tanimoto", 6).alias("tanimoto"))
    lists = best.groupBy("target_id", "target", "formula").agg(F.array_sort(F.collect_list(entry)).alias("n"))
    shuffled = F.array_sort(F.transform(F.concat(F.array("target"), F.transform("n", lambda x: x["smiles"])), lambda s: F.struct(F.sha2(F.concat_ws(":", F.lit(str(seed)), "target_id", s), 256).alias("h"), s.alias("s"))))
    return lists.select(
        F.col("target_id").alias("id"),
        F.col("formula").alias("molecular_formula"),
        "target",
        F.transform(shuffled, lambda x: x["s"]).alias("candidates"),
        F.sort_array(F.transform("n", lambda x: x["tanimoto"]), asc=False).alias("negative_tanimoto"),
        F.transform("n", lambda x: x.dropFields("rank")).alias("negative_hardness"),
    )


def report(rows: DataFrame) -> DataFrame:
    """Targets, those with a negative, those without, and the coverage."""
    kinds = rows.groupBy("formula").agg(F.countDistinct("smiles").alias("kinds"))
    have = rows.join(kinds, "formula", "left").agg(F.count(F.lit(1)).alias("input_samples"), F.count_if(F.col("kinds") > 1).alias("candidate_sets"))
    return have.select("input_samples", "candidate_sets", (F.col("input_samples") - F.col("candidate_sets")).alias("omitted_without_negatives"), F.coalesce(F.try_divide("candidate_sets", "input_samples"), F.lit(0.0)).alias("candidate_coverage"))
