"""Readers of delimited, fixed-width and multi-line-record text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.functions.sequence import chain_letter, residue_letter


def key_from_name(pattern: str) -> Column:
    """An entity's key out of its file's name."""
    return F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, key: str | None = None, pattern: str = r"^([^_.]+)") -> DataFrame:
    """Headerless TSV; blanks are data.  With ``key``, the file name's match becomes a column."""
    df = spark.read.schema(schema).option("sep", "\t").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return df if key is None else df.withColumn(key, key_from_name(pattern))


def fixed(name: str, start: int, end: int, kind: str = "string", line: str = "value") -> Column:
    """Characters [start, end), counted from 0; numbers that do not parse are null."""
    cut = F.substring(line, start + 1, end - start)
    return (cut if kind == "string" else F.trim(cut).try_cast(kind)).alias(name)


def chain_ids(lines: DataFrame) -> DataFrame:
    """Identifier and chain letter of each line: four characters, and the number after the fifth."""
    return lines.select(F.upper(F.substring("value", 1, 4)).alias("pdb_id"), chain_letter(F.regexp_extract("value", r"^.{5}(\d+)", 1)).alias("chain"))


def pdb_atoms(lines: DataFrame, chain: Column | None = None) -> DataFrame:
    """C-alpha atoms of ATOM lines: family, number, coordinates; other columns than ``value`` are kept."""
    keep = [c for c in lines.columns if c != "value"]
    hit = (F.substring("value", 1, 4) == "ATOM") & (F.substring("value", 14, 2) == "CA")
    if chain is not None:
        hit = hit & (F.substring("value", 22, 1) == chain)
    return lines.where(hit).select(
        *keep, fixed("chain", 21, 22), residue_letter(F.substring("value", 18, 3)).alias("aa"), fixed("res_num", 22, 26, "int"),
        fixed("x", 30, 38, "double"), fixed("y", 38, 46, "double"), fixed("z", 46, 54, "double"),
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, value: each line with its number in its file, from 0, which a plain scan does not keep.

    Files are read in splits; a first pass counts the lines of each, and a line's
    number is what the splits before it hold and its place in its own.  Only the counts,
    a row a split, are ordered.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), "value"
    )
    counts = lines.groupBy("_path", "_split").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_path", "_split", (before - F.col("_first")).alias("_shift"))
    return lines.join(starts, ["_path", "_split"]).select("file", (F.col("_at") + F.col("_shift")).alias("pos"), "value")


def dssp_residues(lines: DataFrame, file: str = "file", pos: str = "pos") -> DataFrame:
    """Residues behind the header line of each file, whose third character is ``#``."""
    head = lines.where(F.substring("value", 3, 1) == "#").groupBy(file).agg(F.min(pos).alias("_head"))
    body = lines.join(head, file).where(F.col(pos) > F.col("_head"))
    out = body.select(
        file, pos, fixed("chain", 11, 12), fixed("res_num", 5, 10, "int"), fixed("aa", 13, 14), fixed("ss", 16, 17),
        fixed("x", 116, 122, "double"), fixed("y", 123, 129, "double"), fixed("z", 130, 136, "double"),
    )
    return out.where("res_num IS NOT NULL")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each multi-line record that begins with ``>`` at a line's start."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    return raw.select(F.regexp_replace("value", r"^>|\n$", "").alias("record")).where("record <> ''")


def record_fields(records: DataFrame, header: list[str], marks: dict[str, str]) -> DataFrame:
    """Header columns by tabs, and one column for each line mark; a line's mark is its first character."""
    lines = F.split("record", "\n")
    head = F.split(F.get(lines, 0), "\t")

    def marked(mark: str) -> Column:
        return F.substr(F.get(F.filter(lines, lambda x, i: (i > 0) & x.startswith(mark)), 0), F.lit(2))

    body = [marked(m).alias(n) for m, n in marks.items()]
    return records.select(*[F.get(head, i).alias(n) for i, n in enumerate(header)], *body)


def bond_fields(lines: DataFrame) -> DataFrame:
    """Interface bonds from tab-separated lines: both residues, atoms and coordinates (as text), distance, and the line's last character.

    The ninth field is not used; other columns than ``value`` are kept.  Fields that a
    line lacks, and numbers that do not parse, are null.
    """
    part = F.split("value", "\t")
    one = lambda k, n, kind="string": F.get(part, F.lit(k)).try_cast(kind).alias(n)
    names = ["codon", "res", "ss", "atom", "x", "y", "z", "chain"]
    side = lambda end, first: [one(first + k, f"{n}{end}", "int" if n == "res" else "string") for k, n in enumerate(names)]
    keep = [c for c in lines.columns if c != "value"]
    return lines.select(*keep, *side(1, 0), *side(2, 9), one(17, "distance", "double"), F.right(F.rtrim("value"), F.lit(1)).alias("bond"))


def read_bonds(spark: SparkSession, path: str) -> DataFrame:
    """The same from files, one a pair of chains; ``pair`` is the first eight characters of the file's name."""
    return bond_fields(spark.read.text(path).select(F.substring(F.col("_metadata.file_name"), 1, 8).alias("pair"), "value"))


def paired_lines(lines: DataFrame, file: str = "file", pos: str = "pos") -> DataFrame:
    """Hits that take two lines each: a title and tab-separated numbers."""
    pair = F.floor(F.col(pos) / 2)
    at = lambda k: F.max(F.when(F.col(pos) % 2 == k, F.col("value")))
    return lines.groupBy(file, pair.alias("hit")).agg(at(0).alias("title"), at(1).alias("numbers")).where("numbers IS NOT NULL")
