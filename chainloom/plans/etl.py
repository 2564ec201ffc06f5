"""From raw text to chains, residues and simplices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.functions import sequence as S
from chainloom.operators import joins, spatial, windows


def clean_chains(meta: DataFrame, wanted: DataFrame) -> DataFrame:
    """Metadata of wanted chains: repaired identifiers, sequence and states apart; without a mark, states are null."""
    seq, ss = S.split_first(F.col("Sequence and Secondary Structure"), "#")
    rows = meta.withColumn("chain_id", F.concat(S.repair_id(F.col("PDB ID")), F.col("Chain ID"))).withColumns({"seq": seq, "ss": ss})
    return rows.join(wanted.select(F.concat("pdb_id", "chain").alias("chain_id")), "chain_id", "left_semi")


def best_hits(hits: DataFrame) -> DataFrame:
    """First hit of each chain, in file order, that is neither predicted nor a poor match."""
    from chainloom.sources.remote import good_match, not_predicted

    good = not_predicted(F.col("title")) & good_match(F.col("title"), F.col("organism"), F.col("align_len"), F.col("identities"))
    return windows.first_hit(hits, ["chain_id"], ["hit"], good).withColumn("acc", S.accession(F.col("title")))


def validate_strands(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add strand, after gaps, ambiguity codes and unknown residues are dealt with; the second table holds rejects."""
    rows = hits.withColumns({"query": S.drop_gaps(F.col("query")), "subject": S.drop_gaps(F.col("subject")), "nt": S.first_base(F.col("nt"))})
    ahead, back = S.drop_unknown(F.col("subject"), F.col("nt")), S.drop_unknown(F.col("subject"), F.col("nt"), backward=True)
    rows = rows.withColumns({"_ahead": ahead, "_back": back, "subject": F.replace("subject", F.lit("X"), F.lit(""))})
    nt = F.when(S.translate(F.col("_ahead")) == F.col("subject"), F.col("_ahead")).when(S.translate(S.reverse_complement(F.col("_back"))) == F.col("subject"), F.col("_back"))
    rows = rows.withColumn("nt", F.coalesce(nt, "nt")).drop("_ahead", "_back").withColumn("strand", S.strand_of(F.col("nt"), F.col("subject")))
    bad = rows.where("strand IS NULL").withColumn("reject_reason", F.lit("translation differs"))
    return rows.where("strand IS NOT NULL"), bad


def match_sequences(validated: DataFrame, least: int = 20) -> DataFrame:
    """Longest common part of query and subject, with its nucleotides; longer than ``least``.

    Positions of the part in the whole chain and in the whole nucleotide sequence count
    from ``q_start``, and from ``s_start`` forward or ``s_end`` backward: match_q_start,
    match_q_end, match_nt_start and match_nt_end, all included.  Forward, the original
    reading offsets nucleotides by the query's place; ``match_nt_by_subject`` is where
    the cut nucleotides themselves begin.
    """
    rows = validated.withColumn("m", S.longest_common_substring("query", "subject")).where(F.col("m.length") > least)
    ahead = F.substr("nt", F.col("m.start2") * 3 + 1, F.col("m.length") * 3)
    back = S.reverse_complement(F.col("nt"))
    first = F.when(F.col("strand") == 0, F.col("s_start") + F.col("m.start1") * 3).otherwise(F.col("s_end") - F.col("m.end2") * 3 + 1)
    return rows.withColumns({
        "aa": F.col("m.text"), "match_len": F.col("m.length"), "match_q_start": F.col("q_start") + F.col("m.start1"), "match_q_end": F.col("q_start") + F.col("m.end1") - 1,
        "match_nt_start": first, "match_nt_end": first + F.col("m.length") * 3 - 1, "match_nt_by_subject": F.when(F.col("strand") == 0, F.col("s_start") + F.col("m.start2") * 3).otherwise(first),
        "matched_ss": F.substr("ss", F.col("m.start1") + 1, F.col("m.length")), "nt_match": F.when(F.col("strand") == 0, ahead).otherwise(F.substr(back, F.col("m.start2") * 3 + 1, F.col("m.length") * 3)),
    }).drop("m")


def assemble_residues(atoms: DataFrame, matched: DataFrame, least: int = 19) -> tuple[DataFrame, DataFrame]:
    """Residue rows with codon and state for chains whose atoms match a sequence; and chains without one.

    ``atoms``: chain_id, pos, aa, res_num, x, y, z; ``matched``: chain_id, aa, matched_ss, nt_match.
    """
    once = windows.run_dedupe(atoms, ["chain_id"], ["pos"], "res_num")
    summary = windows.sequence_summary(once, ["chain_id"], "pos", {"aa": "chain_aa"})
    found, missing = joins.split_rejects(summary.select("chain_id", "chain_aa"), matched.select("chain_id", F.col("aa").alias("match_aa"), "matched_ss", "nt_match"), ["chain_id"], "no sequence")
    found = found.withColumn("m", S.longest_common_substring("chain_aa", "match_aa")).where(F.col("m.length") > least)
    place = F.row_number().over(windows.Window.partitionBy("chain_id").orderBy("pos"))
    numbered = once.withColumn("pos", place).join(found.select("chain_id", "m", "matched_ss", "nt_match"), "chain_id")
    at = F.col("pos") - F.col("m.start1") + F.col("m.start2")
    inside = (F.col("pos") > F.col("m.start1")) & (F.col("pos") <= F.col("m.end1"))
    rows = numbered.where(inside).select(
        "chain_id", S.codon_label(F.substr("nt_match", (at - 1) * 3 + 1, F.lit(3))).alias("codon"), "aa", "res_num", "x", "y", "z", F.substr("matched_ss", at, F.lit(1)).alias("ss")
    )
    return rows, missing


def summarise_chains(meta: DataFrame, residues: DataFrame) -> DataFrame:
    """Metadata of the chains that have residues, with chain_length (rows) and the residues' letters, codons and states in order.

    ``residues``: chain_id, res_num, aa, codon, ss.  Residues are aggregated first, so
    the join is one row against one row a chain.
    """
    whole = windows.sequence_summary(residues, ["chain_id"], "res_num", {"aa": "aa_seq", "codon": "nt_seq", "ss": "secondary_structure"})
    return meta.join(whole.select("chain_id", F.col("n_rows").alias("chain_length"), "aa_seq", "nt_seq", "secondary_structure"), "chain_id")


def simplices(residues: DataFrame, cutoff: float = 12.0) -> DataFrame:
    """Tessellate every chain's residues and describe the simplices; edges up to the cutoff, itself included."""
    points = residues.select("chain_id", F.col("res_num").cast("long").alias("pos"), "x", "y", "z", F.col("codon").alias("leaf"), F.col("ss").alias("state"))
    return spatial.simplex_table(spatial.tessellate(points, "chain_id"), points, "chain_id", cutoff)
