"""Queries of the molecule kernel: each part gets a structure, and SQL knows what is true of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions import chemistry
from specloom.plans import adapters as A
from specloom.plans.registry import registry

QUERIES, SQL, query = registry()

#: A structure, another writing of it, and a different molecule (of the same skeleton, if it differs in stereo alone).
COLUMNS = "k, a, b, c, formula, heavy, parts, charge, radicals, isotopes, stereo, ring, violations, elements, labels, fragments"
STRUCTURES = (
    ("CCO", "OCC", "C", "C2H6O", 3, 1, 0, 0, 0, False, "", "", "C,H,O", "alcohol", "H1_FRAGMENT_ETHYL_001"),
    ("CC(=O)Oc1ccccc1C(=O)O", "OC(=O)c1ccccc1OC(C)=O", "C", "C9H8O4", 13, 1, 0, 0, 0, False, "c1ccccc1", "", "C,H,O", "aromatic_ring,carboxylic_acid,ester", ""),
    ("CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "Cn1cnc2c1c(=O)n(C)c(=O)n2C", "C", "C8H10N4O2", 14, 1, 0, 0, 0, False, "O=c1[nH]c(=O)c2[nH]cnc2[nH]1", "", "C,H,N,O", "aromatic_ring", ""),
    ("C[C@H](N)C(=O)O", "N[C@@H](C)C(=O)O", "C[C@@H](N)C(=O)O", "C3H7NO2", 6, 1, 0, 0, 0, True, "", "", "C,H,N,O", "amine,carboxylic_acid", ""),
    ("F/C=C/F", r"F\C=C\F", r"F/C=C\F", "C2H2F2", 4, 1, 0, 0, 0, True, "", "", "C,F,H", "alkene,organohalogen", ""),
    (r"F/C=C\F", r"F\C=C/F", "F/C=C/F", "C2H2F2", 4, 1, 0, 0, 0, True, "", "", "C,F,H", "alkene,organohalogen", ""),
    ("CC(C)O", "OC(C)C", "C", "C3H8O", 4, 1, 0, 0, 0, False, "", "", "C,H,O", "alcohol", "H1_FRAGMENT_ISOPROPYL_001"),
    ("CC(C)(C)OC", "COC(C)(C)C", "C", "C5H12O", 6, 1, 0, 0, 0, False, "", "", "C,H,O", "ether", "H1_FRAGMENT_METHOXY_001,H1_FRAGMENT_TERT_BUTYL_001"),
    ("C[N+](=O)[O-]", "CN(=O)=O", "C", "CH3NO2", 4, 1, 0, 0, 0, False, "", "", "C,H,N,O", "nitro", "H1_FRAGMENT_METHOXY_001"),
    ("[13CH3]CO", "CC[18OH]", "C", "C2H6O", 3, 1, 0, 0, 1, False, "", "", "C,H,O", "alcohol", "H1_FRAGMENT_ETHYL_001"),
    ("C[NH3+].[Cl-]", "[Cl-].C[NH3+]", "C", "CH6ClN", 3, 2, 0, 0, 0, False, "", "multiple_components", "C,Cl,H,N", "", "H1_FRAGMENT_METHOXY_001"),
    ("[NH4+]", "[H][N+]([H])([H])[H]", "C", "H4N+", 1, 1, 1, 0, 0, False, "", "nonzero_formal_charge", "H,N", "", ""),
    ("[CH3]", "[H][C]([H])[H]", "C", "CH3", 1, 1, 0, 1, 0, False, "", "radical", "C,H", "", ""),
    ("C[SeH]", "[SeH]C", "C", "CH4Se", 2, 1, 0, 0, 0, False, "", "unsupported_elements:Se", "C,H,Se", "", ""),
    ("Cc1ccccc1", "CC1=CC=CC=C1", "C", "C7H8", 7, 1, 0, 0, 0, False, "c1ccccc1", "", "C,H", "aromatic_ring", ""),
    ("CCN(CC)CC", "N(CC)(CC)CC", "C", "C6H15N", 7, 1, 0, 0, 0, False, "", "", "C,H,N", "amine", "H1_FRAGMENT_ETHYL_001"),
    ("CS(=O)(=O)C", "O=S(C)(C)=O", "C", "C2H6O2S", 5, 1, 0, 0, 0, False, "", "", "C,H,O,S", "sulfone", "H1_FRAGMENT_METHOXY_001"),
    ("C[Si](C)(C)O[Si](C)(C)C", "O([Si](C)(C)C)[Si](C)(C)C", "C", "C6H18OSi2", 9, 1, 0, 0, 0, False, "", "", "C,H,O,Si", "silicon_carbon,siloxane", ""),
    ("O=C1CCCCC1", "C1CCC(=O)CC1", "C", "C6H10O", 7, 1, 0, 0, 0, False, "O=C1CCCCC1", "", "C,H,O", "ketone", ""),
    ("c1ccc2ccccc2c1", "C1=CC=C2C=CC=CC2=C1", "C", "C10H8", 10, 1, 0, 0, 0, False, "c1ccc2ccccc2c1", "", "C,H", "aromatic_ring", ""),
    ("C[C@H]1CC[C@@H](C)CC1", "C[C@@H]1CC[C@H](C)CC1", "C[C@H]1CC[C@H](C)CC1", "C8H16", 8, 1, 0, 0, 0, True, "C1CCCCC1", "", "C,H", "", ""),
    ("C#CCC#N", "N#CCC#C", "C", "C4H3N", 5, 1, 0, 0, 0, False, "", "", "C,H,N", "alkyne,nitrile", ""),
    ("not_a_smiles", "C1CC", "C", None, None, None, None, None, None, None, None, None, None, None, None),
)


def _literal(v: object) -> str:
    return "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"


TRUE_OF = f"""s({COLUMNS}) as (values {", ".join(f"({k}, {', '.join(map(_literal, row))})" for k, row in enumerate(STRUCTURES))}),
t as (select p_partkey id, s.* from part join s on p_partkey % {len(STRUCTURES)} = k)"""


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, and the texts a, b, c and ring (the written scaffold) of the part's structure."""
    k = F.col("p_partkey") % len(STRUCTURES)
    pick = lambda place: F.element_at(F.array(*(F.lit(row[place]) for row in STRUCTURES)), (k + 1).cast("int"))
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *(pick(p).alias(n) for n, p in (("a", 0), ("b", 1), ("c", 2), ("ring", 10))))


def facts_of(spark: SparkSession, sf_dir: str, *texts: str) -> DataFrame:
    """structures with the kernel's facts of these texts, each under a prefix."""
    rows = structures(spark, sf_dir)
    for text in texts:
        rows = chemistry.with_facts(rows, text, prefix=f"{text}_")
    return rows


def _joined(name: str) -> Column:
    return F.array_join(F.col(name), ",")


@query(f"""with {TRUE_OF} select id, formula is not null readable, parts::int components, charge::int charge, radicals::int radicals, isotopes::int isotopes, violations, violations = '' accepted from t""")
def c1_inspect(spark, d):
    r = facts_of(spark, d, "a")
    counts = (F.col(f"a_{n}").alias(n) for n in ("components", "charge", "radicals", "isotopes", "accepted"))
    return r.select("id", F.col("a_canonical").isNotNull().alias("readable"), *counts, _joined("a_violations").alias("violations"))


@query(f"with {TRUE_OF} select id, formula is not null same, formula is not null differs from t")
def c2_canonical(spark, d):
    r = facts_of(spark, d, "a", "b", "c")
    equal = lambda x, y: F.coalesce(F.col(f"{x}_canonical") == F.col(f"{y}_canonical"), F.lit(False))
    return r.select("id", equal("a", "b").alias("same"), (F.col("a_canonical").isNotNull() & ~equal("a", "c")).alias("differs"))


@query(f"with {TRUE_OF} select id, formula is not null same, coalesce(stereo, false) same_skeleton from t")
def c3_connectivity(spark, d):
    r = facts_of(spark, d, "a", "b", "c")
    equal = lambda x, y: F.coalesce(F.col(f"{x}_connectivity") == F.col(f"{y}_connectivity"), F.lit(False))
    return r.select("id", equal("a", "b").alias("same"), equal("a", "c").alias("same_skeleton"))


@query(f"with {TRUE_OF} select id, stereo from t")
def c4_stereo(spark, d):
    return facts_of(spark, d, "b").select("id", F.col("b_stereo").alias("stereo"))


@query(f"with {TRUE_OF} select id, formula from t")
def c5_formula(spark, d):
    return facts_of(spark, d, "b").select("id", F.col("b_formula").alias("formula"))


@query(f"with {TRUE_OF} select id, elements, violations not like 'unsupported%' elements_ok from t")
def c6_elements(spark, d):
    return facts_of(spark, d, "b").select("id", _joined("b_elements").alias("elements"), F.col("b_elements_ok").alias("elements_ok"))


@query(f"with {TRUE_OF} select id, ring = '' acyclic, formula is not null as_written from t")
def c7_scaffold(spark, d):
    r = facts_of(spark, d, "b", "ring")
    acyclic = F.startswith(F.col("b_scaffold"), F.lit("acyclic:"))
    written = F.when(F.col("ring") == "", F.concat(F.lit("acyclic:"), "b_connectivity")).otherwise(F.col("ring_connectivity"))
    return r.select("id", acyclic.alias("acyclic"), F.coalesce(F.col("b_scaffold") == written, F.lit(False)).alias("as_written"))


@query(f"with {TRUE_OF} select id, ring <> '' has_ring, formula is not null as_written from t")
def c8_ring_scaffold(spark, d):
    r = facts_of(spark, d, "b", "ring")
    written = F.when(F.col("ring") == "", F.lit("")).otherwise(F.col("ring_connectivity"))
    return r.select("id", (F.col("b_ring_scaffold") != "").alias("has_ring"), F.coalesce(F.col("b_ring_scaffold") == written, F.lit(False)).alias("as_written"))


@query(f"with {TRUE_OF} select id, heavy::int heavy_atoms from t")
def c9_heavy_atoms(spark, d):
    return facts_of(spark, d, "b").select("id", F.col("b_heavy_atoms").alias("heavy_atoms"))


@query(f"with {TRUE_OF} select id, labels from t")
def c10_groups(spark, d):
    return facts_of(spark, d, "b").select("id", _joined("b_groups").alias("labels"))


@query(f"with {TRUE_OF} select id, formula is not null same, coalesce(stereo, false) same_as_other, formula is not null in_range from t")
def c11_fingerprints(spark, d):
    r = facts_of(spark, d, "a", "b", "c")
    equal = lambda x, y: F.coalesce((F.col(f"{x}_bits1024") == F.col(f"{y}_bits1024")) & (F.col(f"{x}_bits2048") == F.col(f"{y}_bits2048")), F.lit(False))
    inside = F.coalesce((F.array_max("a_bits1024") < 1024) & (F.array_max("a_bits2048") < 2048) & (F.array_min("a_bits2048") >= 0), F.lit(False))
    return r.select("id", equal("a", "b").alias("same"), equal("a", "c").alias("same_as_other"), inside.alias("in_range"))


@query(f"with {TRUE_OF} select id, fragments from t")
def c12_fragments(spark, d):
    return facts_of(spark, d, "b").select("id", _joined("b_fragments").alias("fragments"))
