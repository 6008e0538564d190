"""Quality manifest, scaffold-disjoint splits, curation filters, balanced order and nested subsets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specloom.functions.parsing import known_solvent
from specloom.operators.order import cut, hash_order, place_by_hash

SEED = 3407
#: Groups of a grouped split that one task folds.
BLOCK = 500_000


def quality(rows: DataFrame) -> DataFrame:
    """Adds qc_status and qc_reason: violations, then what is missing, joined by ';'."""
    missing = [
        F.when(F.col("molecular_formula").isNull(), "missing_formula"),
        F.when(F.col("murcko_scaffold").isNull(), "missing_scaffold"),
        F.when(F.col("h_peak_count") <= 0, "missing_1h_peaks"),
        F.when(F.col("c_peak_count") <= 0, "missing_13c_peaks"),
    ]
    reasons = F.array_compact(F.concat(F.col("violations"), F.array(*missing)))
    return rows.withColumns({"qc_reason": F.array_join(reasons, ";"), "qc_status": F.when(F.size(reasons) == 0, "pass").otherwise("fail")})


def scaffold_splits(rows: DataFrame, *, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = SEED) -> DataFrame:
    """Adds split. Scaffolds, large ones first and equal ones in hashed order, fill train, then val; the rest is test.

    A split takes a scaffold while the rows before it are below its share. Only the classes of scaffolds of equal size are
    summed in one order (there are few, as their sizes add up to the rows); within a class a scaffold's place says how many
    rows come before it. The decisions are joined back. Rows that didn't pass are excluded.
    """
    total = sum(ratios)
    if total <= 0:
        raise ValueError("ratios must have a positive sum")
    passed = rows.where("qc_status = 'pass'")
    sizes = passed.groupBy("murcko_scaffold").agg(F.count(F.lit(1)).alias("n")).withColumn("h", hash_order(seed, "murcko_scaffold"))
    classes = sizes.groupBy("n").agg((F.col("n") * F.count(F.lit(1))).alias("rows"))
    classes = classes.select(F.col("n").alias("size"), (F.sum("rows").over(W.orderBy(F.desc("n"))) - F.col("rows")).alias("ahead"), F.sum("rows").over(W.partitionBy()).alias("all"))
    sizes = place_by_hash(sizes, ["n"], "h", "murcko_scaffold").join(F.broadcast(classes), F.col("n") == F.col("size"))
    train, val = F.floor(F.col("all") * F.lit(ratios[0] / total)), F.floor(F.col("all") * F.lit(ratios[1] / total))
    sizes = sizes.select("murcko_scaffold", "n", (F.col("ahead") + F.col("n") * (F.col("place") - 1)).alias("before"), train.alias("train"), val.alias("val"))
    trained = sizes.where("before < train").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("trained"))
    split = F.when(F.col("before") < F.col("train"), "train").when(F.col("before") - F.col("trained") < F.col("val"), "val").otherwise("test")
    named = sizes.join(F.broadcast(trained)).select("murcko_scaffold", split.alias("split"))  # trained is one row
    return rows.drop("split").join(named, "murcko_scaffold", "left").withColumn("split", F.when(F.col("qc_status") == "pass", F.col("split")).otherwise("excluded"))


def reason_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.split("qc_reason", ";")).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def split_overlap(rows: DataFrame) -> DataFrame:
    """Scaffolds that two splits share, for each pair of splits."""
    own = rows.where("split in ('train', 'val', 'test')").groupBy("murcko_scaffold").agg(F.collect_set("split").alias("s"))
    has = lambda a, b: F.count_if(F.array_contains("s", a) & F.array_contains("s", b))
    return own.agg(has("train", "val").alias("train_val"), has("train", "test").alias("train_test"), has("val", "test").alias("val_test"))


def reject_reason(*, heavy=(2, 60), h_peaks=(1, 80), c_peaks=(1, 120), solvents: str = "any") -> Column:
    """First filter that a manifest row fails, null if it passes all."""
    if solvents not in ("any", "known", "matched", "cdcl3"):
        raise ValueError(f"no solvent policy {solvents}")
    h, c = F.trim(F.coalesce("h_solvent", F.lit(""))), F.trim(F.coalesce("c_solvent", F.lit("")))
    number = lambda n: F.coalesce(F.col(n).cast("string").try_cast("double").cast("int"), F.lit(0))
    reason = (
        F.when(~F.col("qc_status").eqNullSafe("pass"), "manifest_qc_fail")
        .when(F.size("violations") > 0, F.get("violations", 0))
        .when(number("isotope_label_count") > 0, "isotope_labeled_structure")
    )
    for name, column, (low, high) in (("heavy_atoms", "heavy_atom_count", heavy), ("1h_peaks", "h_peak_count", h_peaks), ("13c_peaks", "c_peak_count", c_peaks)):
        reason = reason.when(number(column) < low, f"too_few_{name}").when(number(column) > high, f"too_many_{name}")
    if solvents == "known":
        reason = reason.when(~(known_solvent(h) & known_solvent(c)), "unknown_solvent")
    if solvents == "matched":
        reason = reason.when(h != c, "solvent_mismatch")
    if solvents == "cdcl3":
        reason = reason.when((h != "CDCl3") | (c != "CDCl3"), "not_cdcl3")
    return reason


def filtered(rows: DataFrame, **bounds) -> DataFrame:
    """Adds reject_reason; kept rows have none. Counting it gives the histogram."""
    return rows.withColumn("reject_reason", reject_reason(**bounds))


def balanced_order(rows: DataFrame, *, seed: int = SEED, by: str | None = None) -> DataFrame:
    """Adds turn and position: each turn takes one molecule of every scaffold that has any left, in hashed order.

    Turns within a scaffold and places within a turn are counted in buckets of the hashes, so that neither the commonest
    scaffold nor the first turn, which holds every scaffold, is sorted in one task. by keeps the order apart for each value
    of a column.
    """
    scaffold = F.coalesce(F.nullif(F.col("murcko_scaffold"), F.lit("")), F.nullif(F.col("canonical_smiles"), F.lit("")), F.col("id"))
    keys = [by] if by else []
    rows = rows.withColumn("scaffold_key", scaffold)
    rows = rows.withColumns({"scaffold_hash": hash_order(seed, "scaffold_key"), "id_hash": hash_order(seed, "id")})
    rows = place_by_hash(rows, [*keys, "scaffold_key"], "id_hash", "id", name="turn")
    rows = place_by_hash(rows, [*keys, "turn"], "scaffold_hash")
    counts = rows.groupBy(*keys, "turn").agg(F.count(F.lit(1)).alias("n"))
    before = (F.sum("n").over(W.partitionBy(*keys).orderBy("turn")) - F.col("n")).alias("before")
    counts = counts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("turn").alias("__turn"), before)
    same = F.col("turn") == F.col("__turn")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    rows = rows.join(counts, same).withColumn("position", F.col("before") + F.col("place"))
    return rows.drop("place", "before", "scaffold_hash", "id_hash", "__turn", *(f"__{k}" for k in keys))


def subset_sizes(size: int, *, val_fraction: float = 0.1, test_fraction: float = 0.1) -> dict[str, int]:
    """Rows of each split in a subset of that size; halves round to even."""
    val, test = round(size * val_fraction), round(size * test_fraction)
    if size - val - test <= 0:
        raise ValueError("a subset needs training rows")
    return {"train": size - val - test, "val": val, "test": test}


def nested_subsets(ordered: DataFrame, sizes: list[int], **fractions) -> DataFrame:
    """(subset, split, id) rows: each subset has the first rows of each split's order, so smaller ones are prefixes."""
    wanted = [(s, split, n) for s in sizes for split, n in subset_sizes(s, **fractions).items()]
    table = ordered.sparkSession.createDataFrame(wanted, "subset int, split string, n int")
    return ordered.join(F.broadcast(table), "split").where(F.col("position") <= F.col("n")).select("subset", "split", "id", "position")


def grouped_splits(rows: DataFrame, *, val_fraction: float = 0.1, test_fraction: float = 0.1, seed: int = SEED) -> DataFrame:
    """Adds split; rows of one structure stay together. In hashed order each group goes to val or test, to whichever is
    filled less (shares compared exactly; equal ones: fewer rows), unless that one is full, then to train.

    The order is sequential by nature, but all that a group needs to know is the rows before it, a prefix sum, and how many of
    them went to val. While both are open that number lies within the largest group's size of val's share, so a block of about
    BLOCK groups is a function of it, in few pieces, as paths meet. All blocks' functions are made at once; one task looks up
    the number that each block starts with; all blocks are then folded at once. Once one is full the prefix sum decides alone.
    The number of jobs doesn't depend on the number of blocks, and blocks behind the last decision are not folded.
    """
    if not (0 <= val_fraction < 1 and 0 <= test_fraction < 1 and val_fraction + test_fraction < 1):
        raise ValueError("fractions must leave training rows")
    key = F.coalesce(F.nullif(F.col("canonical_smiles"), F.lit("")), F.col("id"))
    rows = rows.withColumn("structure", key)
    groups = rows.groupBy("structure").agg(F.count(F.lit(1)).alias("n")).withColumn("h", hash_order(seed, "structure"))
    groups = cut(groups, "groups")
    number, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    val, test = round(total * val_fraction), round(total * test_fraction)
    if not val and not test:
        return rows.drop("structure").withColumn("split", F.lit("train"))
    digits = 0
    while number > BLOCK * 16**digits:
        digits += 1
    groups = groups.withColumn("block", F.substring("h", 1, digits))
    ahead = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row a block: at most 16 * number / BLOCK
    blocks = groups.groupBy("block").agg(F.sum("n").alias("size"), F.max("n").alias("most"))
    blocks = cut(blocks.select("block", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("before"), F.coalesce(F.max("most").over(ahead), F.lit(0)).alias("widest")), "blocks")
    starts, filled, at = None, 0, 0
    if val and test:
        opened = groups.select("block", "structure", "h", "n").join(F.broadcast(blocks.where(F.col("before") < val + test)), "block")
        pieces = opened.groupBy("block").applyInPandas(_block_function(val, test), PIECE)
        starts = cut(pieces.repartition(1).sortWithinPartitions("block", "low").mapInPandas(_follow, "block string, start long, filled long, at long"), "starts")
        filled, at = starts.where("at is not null").select("filled", "at").first()  # val's rows and all rows when one got full
    done, want, open_split = (filled, test, "test") if filled >= val else (at - filled, val, "val")
    held = blocks.where(F.col("before") < done + want)
    held = held.withColumn("start", F.lit(None).cast("long")) if starts is None else held.join(F.broadcast(starts.select("block", "start")), "block", "left")
    named = groups.join(F.broadcast(held.drop("widest")), "block").groupBy("block").applyInPandas(_fold(val, test, at, done, want, open_split), "structure string, split string")
    return rows.drop("split").join(cut(named, "split"), "structure", "left").drop("structure").withColumn("split", F.coalesce("split", F.lit("train")))


#: From low to high, rows in val before a block, to those after it: all the same if flat, else rising with them from low's.
#: at: rows of all groups before the first that met a full split, null while both are open.
PIECE = "block string, low long, high long, filled long, flat boolean, at long"


def _most_to_val(before: int, val: int, test: int) -> int:
    """The most rows that val can have of those before a group that goes there while both are open."""
    most, rest = divmod(before * val, val + test)
    return most - 1 if not rest and most > before - most else most


def transitions(sizes: list[int], before: int, widest: int, val: int, test: int) -> list[tuple[int, int, int, bool, int | None]]:
    """The pieces (low, high, filled, flat, at) of a block of groups, for all numbers of val's rows that can precede it.

    Of two shares the lesser grows, so they never differ by more than the widest group so far; that bounds the numbers.
    """
    both = val + test
    low = max(0, before - test + 1, -((widest - before) * val // both))
    high = min(val - 1, before, (before * val + widest * test) // both)
    live, full = [(low, high, low, False)] if low <= high else [], []
    for n in sizes:
        if not live:
            break
        most = _most_to_val(before, val, test)
        before += n
        moved: list[tuple[int, int, int, bool]] = []
        for a, z, v, flat in live:
            for x, y, to in _cuts(a, z, v, flat, most):
                to += n if to <= most else 0
                for i, j, w in _cuts(x, y, to, flat, before - test, val - 1):
                    if w >= val or w <= before - test:
                        full.append((i, j, w, flat, before))
                        continue
                    if moved and moved[-1][1] + 1 == i:
                        p, q, u, even = moved[-1]
                        if u == w and (even or p == q) and (flat or i == j):
                            moved[-1] = (p, j, u, True)
                            continue
                        if not (even and p < q) and not (flat and i < j) and w == u + i - p:
                            moved[-1] = (p, j, u, False)
                            continue
                    moved.append((i, j, w, flat))
        live = moved
    return sorted([(*piece, None) for piece in live] + full)


def _cuts(low: int, high: int, filled: int, flat: bool, *bounds: int) -> list[tuple[int, int, int]]:
    """A piece cut behind each bound (rising) of its values: (low, high, filled)."""
    out = []
    for bound in () if flat else sorted(bounds):
        if filled <= bound < filled + high - low:
            out.append((low, low + bound - filled, filled))
            low, filled = low + bound - filled + 1, bound + 1
    return [*out, (low, high, filled)]


def _block_function(val: int, test: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["h", "structure"])
        name, before, widest = block["block"].iloc[0], int(block["before"].iloc[0]), int(block["widest"].iloc[0])
        found = transitions(block["n"].tolist(), before, widest, val, test)
        out = pd.DataFrame([(name, *piece) for piece in found], columns=["block", "low", "high", "filled", "flat", "at"])
        return out.astype({"at": "Int64"})

    return run


def _follow(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The start of each block while both splits are open, from the pieces of all blocks in order; one of them at a time."""
    state, last = 0, None
    for table in tables:
        out = []
        for block, low, high, filled, flat, at in table.astype({"at": "Int64"}).itertuples(index=False):
            if state is None or block == last or not low <= state <= high:
                continue
            after, over = filled + (0 if flat else state - low), not pd.isna(at)
            out.append((block, state, after if over else None, at if over else None))
            state, last = None if over else after, block
        yield pd.DataFrame(out, columns=["block", "start", "filled", "at"]).astype({"start": "Int64", "filled": "Int64", "at": "Int64"})


def _fold(val: int, test: int, at: int, done: int, want: int, open_split: str):
    """Groups of a block that go to val or test: structure, split. From `at` rows on, open_split takes groups while the rows
    before them less those of the full one (done) are below want."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["h", "structure"])
        before, start = int(block["before"].iloc[0]), block["start"].iloc[0]
        filled, named = None if pd.isna(start) else int(start), []
        for n in block["n"].tolist():
            if before < at:
                named.append("val" if filled <= _most_to_val(before, val, test) else "test")
                filled += n if named[-1] == "val" else 0
            else:
                named.append(open_split if before - done < want else None)
            before += n
        out = pd.DataFrame({"structure": block["structure"], "split": pd.Series(named, index=block.index, dtype=object)})
        return out[out["split"].notna()]

    return run


def summary(rows: DataFrame) -> DataFrame:
    """One row: count, scaffolds, and the least and most heavy atoms (0 without rows)."""
    return rows.agg(
        F.count(F.lit(1)).alias("samples"),
        F.countDistinct(F.coalesce("murcko_scaffold", F.lit(""))).alias("unique_scaffolds"),
        F.coalesce(F.min("heavy_atom_count"), F.lit(0)).alias("heavy_atom_min"),
        F.coalesce(F.max("heavy_atom_count"), F.lit(0)).alias("heavy_atom_max"),
    )


def split_sizes(rows: DataFrame) -> DataFrame:
    """split, n: rows of each split; a missing one is the empty text."""
    return rows.groupBy(F.coalesce("split", F.lit("")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


def top_solvents(rows: DataFrame, k: int = 10) -> DataFrame:
    """The commonest pairs of solvents; ties by name."""
    pairs = rows.groupBy(F.trim("h_solvent").alias("h_solvent"), F.trim("c_solvent").alias("c_solvent")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.orderBy(F.desc("n"), "h_solvent", "c_solvent").limit(k)


