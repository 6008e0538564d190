"""Column functions over arrays as sets: overlaps, Jaccard and Tanimoto similarity, precision and recall."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def tanimoto(a: Column, b: Column) -> Column:
    """Similarity of two sets of bits; two empty ones have none."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(0.0))


def overlap_scores(predicted: Column, reference: Column, valid: Column | None = None) -> list[Column]:
    """Precision, recall and F1 of two label sets: all 1 if both are empty, all 0 if the prediction isn't valid."""
    shared = F.size(F.array_intersect(predicted, reference))
    p = F.coalesce(F.try_divide(shared, F.size(predicted)), F.lit(0.0))
    r = F.coalesce(F.try_divide(shared, F.size(reference)), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    none = (F.size(predicted) == 0) & (F.size(reference) == 0)
    ok = F.lit(True) if valid is None else valid
    return [F.when(~ok, F.lit(0.0)).when(none, F.lit(1.0)).otherwise(x) for x in (p, r, f)]


def unsupported(elements: Column, allowed: tuple[str, ...]) -> Column:
    return F.array_except(elements, F.array(*(F.lit(e) for e in allowed)))
