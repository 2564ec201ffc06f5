"""Readers, writers and the path from raw text to residues."""

import pytest
from pyspark.sql import functions as F

from chainloom import schemas
from chainloom.plans import etl, strand
from chainloom.sources import files, remote, sinks
from chainloom.streaming.runs import streaming_runs


def test_tsv_keeps_blanks(spark, tmp_path):
    (tmp_path / "1ABCA_residue").write_text("A1\tA\t17\t1.000\t0.000\t0.000\tE\nA2\tA\t18\t2.000\t0.000\t0.000\t \n")
    rows = files.read_tsv(spark, str(tmp_path), schemas.RESIDUE, "chain_id", r"^(.{5})_").orderBy("res_num").collect()
    assert [(r.chain_id, r.res_num, r.ss) for r in rows] == [("1ABCA", 17, "E"), ("1ABCA", 18, " ")]


def test_records(spark, tmp_path):
    (tmp_path / "r").write_text(">1ABCA\tXX1\n$ACDE\n&HHHH\n@GCT\n>2ABCB\tXX2\n$FG\n&EE\n@TTT\n")
    out = files.record_fields(files.read_records(spark, str(tmp_path)), ["chain_id", "acc"], {"$": "query", "&": "ss", "@": "nt"})
    assert sorted(tuple(r) for r in out.collect()) == [("1ABCA", "XX1", "ACDE", "HHHH", "GCT"), ("2ABCB", "XX2", "FG", "EE", "TTT")]


def test_fixed_width(spark, tmp_path):
    atom = "ATOM      2  CA  ALA A  17      11.104   6.134  -6.504  1.00  0.00"
    out = files.pdb_atoms(spark.createDataFrame([(atom,), (atom.replace("CA ", "CB "),), ("HETATM",)], "value string")).collect()
    assert [tuple(r) for r in out] == [("A", "A", 17, 11.104, 6.134, -6.504)]
    line = list(" " * 140)
    for at, text in ((5, "   17"), (11, "A"), (13, "A"), (16, "E"), (116, "  11.1"), (123, "   6.1"), (130, "  -6.5")):
        line[at : at + len(text)] = text
    (tmp_path / "x.dssp").write_text("header\n  # RESIDUE\n" + "".join(line) + "\n")
    r = files.dssp_residues(files.numbered_lines(spark, str(tmp_path))).collect()
    assert [(x.chain, x.res_num, x.aa, x.ss, x.x) for x in r] == [("A", 17, "A", "E", 11.1)]
    ids = files.chain_ids(spark.createDataFrame([("1abc 12",)], "value string")).collect()
    assert [tuple(x) for x in ids] == [("1ABC", "L")]


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_files_in_ranges(spark, tmp_path, split):
    """Files cut into many ranges give the numbered lines and the records of whole ones."""
    texts = {f"f{k}": [f">r{k}.{i}\tx" if i % 3 == 0 else f"${'A' * (i * 7 % 40)}" if i % 3 == 1 else "" for i in range(60)] for k in range(3)}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    (tmp_path / "crlf").write_bytes(b"one\r\ntwo\r\n\r\nlast")
    texts["crlf"] = ["one", "two", "", "last"]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        df = files.numbered_lines(spark, str(tmp_path))
        assert split > 1000 or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        assert sorted((r.file, r.pos, r.value) for r in df.collect()) == sorted((f, i, x) for f, lines in texts.items() for i, x in enumerate(lines))
        records = files.record_fields(files.read_records(spark, str(tmp_path / "f*")), ["id"], {"$": "seq"})
        assert sorted((r.id, r.seq) for r in records.collect()) == sorted((f"r{k}.{i}", "A" * ((i + 1) * 7 % 40)) for k in range(3) for i in range(0, 60, 3))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_sinks_are_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0005, None), ("b", 2.0, "x")], "k string, v double, s string")
    for _ in range(2):
        sinks.write_partitioned(df, str(tmp_path / "p"), ["k"])
        sinks.write_tsv(df, str(tmp_path / "t"), {"v": "%.2f"})
        sinks.route(df, str(tmp_path / "r"), F.length("k"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2 == spark.read.parquet(str(tmp_path / "r")).count()
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["a\t1.00\tNA", "b\t2.00\tx"]
    good, bad = sinks.split_rejected(df, F.when(F.col("s").isNull(), "no s"))
    assert good.count() == 1 and bad.first().reject_reason == "no s"


def test_hits(spark):
    lines = spark.createDataFrame([("c", 0, "gi|1|gb|XX1.1|PREDICTED: thing"), ("c", 1, "5\t5"), ("c", 2, "gi|2|gb|XX2.1| homo gene, x"), ("c", 3, "200\t199")], "file string, pos int, value string")
    hits = files.paired_lines(lines).select(F.col("file").alias("chain_id"), "hit", "title", F.split("numbers", "\t")[0].cast("int").alias("align_len"), F.split("numbers", "\t")[1].cast("int").alias("identities"), F.lit("homo").alias("organism"))
    assert [r.acc for r in etl.best_hits(hits).collect()] == ["XX2.1"]
    assert remote.ranges_from_table(spark.createDataFrame([("XX2.1", 2, 4)], "acc string, s_start int, s_end int"), spark.createDataFrame([("XX2.1", "ACGTA")], "acc string, sequence string")).first().nt == "CGT"


def test_etl_round_trip(spark):
    aa, nt = "ACDEFGHIKLMNPQRSTVWYACDEFG", "GCTTGTGATGAATTTGGTCATATTAAATTAATGAATCCTCAACGTTCTACTGTTTGGTATGCTTGTGATGAATTTGGT"
    place = "chain_id string, query string, subject string, ss string, nt string, q_start int, s_start int, s_end int"
    raw = spark.createDataFrame([("1ABCA", aa, aa, "H" * len(aa), nt, 5, 101, 100 + len(nt)), ("2ABCB", aa, aa, "E" * len(aa), "A" * 9, 1, 1, 9)], place)
    good, bad = etl.validate_strands(raw)
    assert [r.chain_id for r in bad.collect()] == ["2ABCB"]
    matched = etl.match_sequences(good)
    m = matched.first()
    assert m.aa == aa and m.nt_match == nt and m.matched_ss == "H" * len(aa)
    assert (m.match_q_start, m.match_q_end, m.match_nt_start, m.match_nt_end) == (5, 4 + len(aa), 101, 100 + len(nt))
    atoms = [("1ABCA", 2 * i + d, a, i + 1, float(i), float(i * i % 7), float(i % 3)) for i, a in enumerate(aa) for d in (0, 1)] + [("9ZZZZ", 0, "A", 1, 0.0, 0.0, 0.0)]
    rows, missing = etl.assemble_residues(spark.createDataFrame(atoms, "chain_id string, pos int, aa string, res_num int, x double, y double, z double"), matched.select("chain_id", "aa", "matched_ss", "nt_match"))
    got = rows.orderBy("res_num").collect()
    assert len(got) == len(aa) and (got[0].codon, got[1].codon, got[0].ss) == ("A1", "C1", "H") and [r.chain_id for r in missing.collect()] == ["9ZZZZ"]
    assert etl.simplices(rows, 50.0).count() > 0
    feats = strand.strand_features(strand.four_runs(rows.withColumnsRenamed({"codon": "leaf"}), F.col("ss") == "H"))
    assert len(feats.columns) == 32 and feats.count() == len(aa) - 3


def test_clean_chains(spark):
    meta = spark.createDataFrame([("1.00E+12", "A", 0.2, "t", "m", 1.5, "c", "u", "s", "e", 3, "ACD#HHE"), ("9ZZZ", "B", 0.2, "t", "m", 1.5, "c", "u", "s", "e", 3, "ACD")], schemas.CHAIN_META)
    out = etl.clean_chains(meta, spark.createDataFrame([("1E12", "A")], "pdb_id string, chain string")).collect()
    assert [(r.chain_id, r.seq, r.ss) for r in out] == [("1E12A", "ACD", "HHE")]


def test_streaming_runs(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "chain string, pos long, s string"
    spark.createDataFrame([("a", i, "E" if i != 3 else "H") for i in range(10)], schema).coalesce(1).write.parquet(str(src / "1"))
    stream = spark.readStream.schema(schema).parquet(str(src / "*"))
    q = streaming_runs(stream, "chain", "pos", "s", "E", 4).writeStream.format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        q.processAllAvailable()
        assert sorted(r.start for r in spark.table("runs").collect()) == [4, 5, 6]
    finally:
        q.stop()


def test_matched_coordinates(spark):
    """Both strands of a match in the middle, counted in the whole sequences."""
    protein, coding = "ACDEFGHIKL", "GCTTGTGATGAATTTGGTCATATTAAATTA"
    back = coding[::-1].translate(str.maketrans("ACGT", "TGCA"))
    raw = spark.createDataFrame([("f", protein, "QQ" + protein[3:], "ssstttuuuu", "CAACAA" + coding[9:], 11, 201, 227, 0), ("b", protein, "QQ" + protein[3:], "ssstttuuuu", back[: 21] + "TTGTTG", 11, 201, 227, 1)],
                                "chain_id string, query string, subject string, ss string, nt string, q_start int, s_start int, s_end int, strand int")
    f, b = etl.match_sequences(raw, 5).orderBy(F.desc("chain_id")).collect()
    assert (f.match_len, f.match_q_start, f.match_q_end, f.nt_match, f.matched_ss) == (7, 14, 20, coding[9:], "tttuuuu")
    assert (f.match_nt_start, f.match_nt_end, f.match_nt_by_subject) == (210, 230, 207)  # the query's place, and the cut nucleotides' own
    assert (b.nt_match, b.match_nt_start, b.match_nt_end) == (coding[9:], 201, 221)


def test_bonds(spark, tmp_path):
    fields = ["A1", "7", "H", "CA", "1", "2", "3", "A", "skip", "C2", "9", "E", "N", "4", "5", "6", "B", "3.25", "bond H"]
    (tmp_path / "1ABCA_2X_codon").write_text("\t".join(fields) + "\nA1\tx\n")
    rows = files.read_bonds(spark, str(tmp_path)).orderBy("distance").collect()
    assert tuple(rows[1]) == ("1ABCA_2X", "A1", 7, "H", "CA", "1", "2", "3", "A", "C2", 9, "E", "N", "4", "5", "6", "B", 3.25, "H")
    assert rows[0].codon1 == "A1" and rows[0].res1 is None and rows[0].distance is None


def test_tables_in_the_catalog(spark):
    spark.sql("DROP TABLE IF EXISTS kept_rows")
    for _ in range(2):
        sinks.create_table(spark, "kept_rows", schemas.T.StructType.fromDDL("v double, k string"), ["k"])
        sinks.append_rows(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double"), "kept_rows", ["k"])
    assert sorted((r.k, r.v) for r in spark.table("kept_rows").collect()) == [("a", 1.0), ("b", 2.0)]
    for _ in range(2):  # null and repeated keys
        sinks.append_rows(spark.createDataFrame([(None, 5.0), (None, 4.0), ("c", 7.0), ("c", 6.0), ("a", 9.0)], "k string, v double"), "kept_rows", ["k"])
    assert sorted((r.k or "", r.v) for r in spark.table("kept_rows").collect()) == [("", 4.0), ("a", 1.0), ("b", 2.0), ("c", 6.0)]
    assert [r.v for r in sinks.table_column(spark, "kept_rows", "v", F.col("k") == "b").collect()] == [2.0]
    spark.sql("DROP TABLE kept_rows")


class Files:
    def download(self, name):
        return name.encode() * 2


def test_downloads(spark):
    got = remote.download_files(spark.createDataFrame([("a",), ("b",)], "name string"), Files).collect()
    assert sorted((r.name, bytes(r.content)) for r in got) == [("a", b"aa"), ("b", b"bb")]


def test_chain_summary(spark):
    meta = spark.createDataFrame([("c", "title"), ("none", "t")], "chain_id string, title string")
    rows = spark.createDataFrame([("c", 2, "C", "C1", "H"), ("c", 1, "A", "A2", "E"), ("x", 1, "A", "A1", "E")], "chain_id string, res_num int, aa string, codon string, ss string")
    assert [tuple(r) for r in etl.summarise_chains(meta, rows).collect()] == [("c", "title", 2, "AC", "A2C1", "EH")]


@pytest.mark.parametrize("name", ["chain_meta", "t"])
def test_tables(spark, name, tmp_path):
    sinks.write_sheets({name: spark.range(3)}, str(tmp_path))
    assert sinks.read_sheet(spark, str(tmp_path), name).count() == 3
