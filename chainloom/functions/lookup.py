"""Small fixed vocabularies, as map literals and as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The standard genetic code, by family.  A family's codons are numbered in this order: A1 is GCT, A2 is GCC.
CODONS = {
    "A": ("GCT", "GCC", "GCA", "GCG"),
    "C": ("TGT", "TGC"),
    "D": ("GAT", "GAC"),
    "E": ("GAA", "GAG"),
    "F": ("TTT", "TTC"),
    "G": ("GGT", "GGC", "GGA", "GGG"),
    "H": ("CAT", "CAC"),
    "I": ("ATT", "ATC", "ATA"),
    "K": ("AAA", "AAG"),
    "L": ("TTA", "TTG", "CTT", "CTC", "CTA", "CTG"),
    "M": ("ATG",),
    "N": ("AAT", "AAC"),
    "P": ("CCT", "CCC", "CCA", "CCG"),
    "Q": ("CAA", "CAG"),
    "R": ("CGT", "CGC", "CGA", "CGG", "AGA", "AGG"),
    "S": ("TCT", "TCC", "TCA", "TCG", "AGT", "AGC"),
    "T": ("ACT", "ACC", "ACA", "ACG"),
    "V": ("GTT", "GTC", "GTA", "GTG"),
    "W": ("TGG",),
    "Y": ("TAT", "TAC"),
}
STOPS = ("TAA", "TAG", "TGA")

# Three-letter residue names, by family in alphabetical order.
RESIDUES = {"A": "ALA", "C": "CYS", "D": "ASP", "E": "GLU", "F": "PHE", "G": "GLY", "H": "HIS", "I": "ILE", "K": "LYS", "L": "LEU", "M": "MET", "N": "ASN", "P": "PRO", "Q": "GLN", "R": "ARG", "S": "SER", "T": "THR", "V": "VAL", "W": "TRP", "Y": "TYR"}

# Residue volume and hydropathy, by family in alphabetical order.
VOLUME = {"A": 88.6, "C": 108.5, "D": 111.1, "E": 138.4, "F": 189.9, "G": 60.1, "H": 153.2, "I": 166.7, "K": 168.6, "L": 166.7, "M": 162.9, "N": 114.1, "P": 112.7, "Q": 143.8, "R": 173.4, "S": 89.0, "T": 116.1, "V": 140.0, "W": 227.8, "Y": 193.6}
HYDROPATHIES = {"A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3}

CODON_LABEL = {codon: f"{family}{k}" for family, codons in CODONS.items() for k, codon in enumerate(codons, 1)}
CODON_FAMILY = {codon: label[0] for codon, label in CODON_LABEL.items()} | {stop: "*" for stop in STOPS}
LABEL_CODON = {label: codon for codon, label in CODON_LABEL.items()}
RESIDUE_FAMILY = {name: family for family, name in RESIDUES.items()}
CHAIN_LETTER = {str(n): chr(64 + n) for n in range(1, 27)}


def mapped(key: Column, table: dict) -> Column:
    """``table[key]`` as a literal map; null where it has no such key."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def lookup_table(spark: SparkSession, table: dict, key: str, value: str) -> DataFrame:
    """The same vocabulary as a table, for joins; Spark broadcasts so small a one by itself."""
    kind = "double" if isinstance(next(iter(table.values())), float) else "string"
    return spark.createDataFrame(list(table.items()), f"{key} string, {value} {kind}")
