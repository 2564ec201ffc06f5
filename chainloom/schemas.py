"""Schemas of the tables; readers never infer types, because identifiers such as 1E12 look like numbers."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    kinds = {"s": T.StringType, "i": T.IntegerType, "d": T.DoubleType}
    return T.StructType([T.StructField(n, kinds[k]()) for n, k in (x.split(":") for x in text.split())])


_METRICS = "e1:d e2:d e3:d e4:d e5:d e6:d volume:d tetrahedrality:d"
_FOUR = "{0}1:{1} {0}2:{1} {0}3:{1} {0}4:{1}"
CHAIN_META = T.StructType([
    T.StructField(n, k()) for n, k in (
        ("PDB ID", T.StringType), ("Chain ID", T.StringType), ("R Free", T.DoubleType), ("Structure Title", T.StringType), ("Exp. Method", T.StringType),
        ("Resolution", T.DoubleType), ("Classification", T.StringType), ("Uniprot Acc", T.StringType), ("Source", T.StringType), ("EC No", T.StringType),
        ("Chain Length", T.IntegerType), ("Sequence and Secondary Structure", T.StringType),
    )
])
RESIDUE = _struct("codon:s aa:s res_num:i x:d y:d z:d ss:s")
CA_ATOM = _struct("aa:s res_num:i x:d y:d z:d")
SIMPLEX = _struct(f"simplex:s sorted_simplex:s {_FOUR.format('r', 'i')} residue_distance:i {_METRICS} {_FOUR.format('ss', 's')}")
SIMPLEX_CLASS = _struct(f"chain_id:s sorted_simplex:s {_FOUR.format('r', 'i')} residue_distance:i volume:d tetrahedrality:d {_FOUR.format('ss', 's')}")
STRAND4 = _struct(f"chain_id:s simplex:s {_FOUR.format('r', 'i')} {_METRICS}")
PPI_BOND = _struct(
    "codon1:s res1:i ss1:s atom1:s x1:s y1:s z1:s chain1:s unused:s codon2:s res2:i ss2:s atom2:s x2:s y2:s z2:s chain2:s distance:d bond:s"
)
QUAD_FEATURES = T.StructType([
    *_struct("Ave:d Tetrahedrality:d Volume:d Rotation:d Bend:d Twist:d Class:i").fields, T.StructField("Residue distance", T.IntegerType()),
    T.StructField("Simplex_aa", T.StringType()), T.StructField("Secondary structure", T.StringType()),
])
