"""Registered queries: sequences, scans of text and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainloom.functions import sequence as S
from chainloom.functions.lookup import CODON_FAMILY, CODON_LABEL
from chainloom.operators import homology, joins
from chainloom.plans import etl
from chainloom.session import table
from chainloom.sources import files, remote, sinks

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Part names as nucleotides: their letters fall on four bases.
_NT_SQL = "nt AS (SELECT p_partkey, translate(regexp_replace(lower(p_name || p_type || p_brand), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS nt FROM part)"
_BASES = ("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def _nt(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.regexp_replace(F.lower(F.concat("p_name", "p_type", "p_brand")), "[^a-z]", "")
    return table(spark, sf_dir, "part").select("p_partkey", F.translate(letters, *_BASES).alias("nt"))


@query(f"WITH {_NT_SQL} SELECT p_partkey, reverse(translate(nt, 'ACGT', 'TGCA')) AS reversed FROM nt")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nt(spark, sf_dir).select("p_partkey", S.reverse_complement(F.col("nt")).alias("reversed"))


_CODE = ", ".join(f"('{c}', '{a}')" for c, a in CODON_FAMILY.items())
_PROTEIN_SQL = f"""{_NT_SQL}, code AS (SELECT * FROM (VALUES {_CODE}) AS t(codon, aa)), triplets AS (SELECT p_partkey, i, substr(nt, i * 3 + 1, 3) AS codon FROM nt, range(0, 100) AS r(i) WHERE (i + 1) * 3 <= length(nt)),
    protein AS (SELECT p_partkey, string_agg(aa, '' ORDER BY i) AS protein FROM triplets JOIN code USING (codon) GROUP BY p_partkey)"""


@query(f"WITH {_PROTEIN_SQL} SELECT p_partkey, protein FROM protein")
def translate_codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nt(spark, sf_dir).where(F.length("nt") >= 3).select("p_partkey", S.translate(F.col("nt")).alias("protein"))


@query("SELECT p_partkey, translate(upper(p_name), 'YRWSKMDVHBXN', 'CAAGTCAAACAA') AS plain FROM part")
def iupac_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.first_base(F.upper("p_name"), S.IUPAC_A).alias("plain"))


@query("SELECT p_partkey, translate(upper(p_name), 'RYSWKMBDHVN', 'ACGAGACAAAA') AS plain FROM part")
def iupac_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.first_base(F.upper("p_name"), S.IUPAC_B).alias("plain"))


#: Translations of whole sequences; every letter of a protein comes from its own triplet.
_WHOLE_SQL = f"""{_NT_SQL}, whole AS (SELECT p_partkey, substr(nt, 1, CAST(length(nt) // 3 * 3 AS BIGINT)) AS nt FROM nt WHERE length(nt) >= 3),
    code AS (SELECT * FROM (VALUES {_CODE}) AS t(codon, aa))"""


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nt(spark, sf_dir).where(F.length("nt") >= 3).withColumn("nt", F.substr("nt", F.lit(1), F.floor(F.length("nt") / 3) * 3))


@query(f"""WITH {_WHOLE_SQL},
    seen AS (SELECT p_partkey, nt, CASE WHEN p_partkey % 3 = 1 THEN reverse(translate(nt, 'ACGT', 'TGCA')) ELSE nt END AS s FROM whole),
    reads AS (SELECT p_partkey, 'given' AS kind, nt AS s FROM seen UNION ALL SELECT p_partkey, 'ahead', s FROM seen UNION ALL SELECT p_partkey, 'back', reverse(translate(s, 'ACGT', 'TGCA')) FROM seen),
    parts AS (SELECT p_partkey, kind, i, substr(s, i * 3 + 1, 3) AS codon FROM reads, range(0, 200) AS r(i) WHERE (i + 1) * 3 <= length(s)),
    proteins AS (SELECT p_partkey, kind, string_agg(coalesce(aa, 'X'), '' ORDER BY i) AS protein FROM parts LEFT JOIN code USING (codon) GROUP BY p_partkey, kind),
    wide AS (SELECT p_partkey, max(protein) FILTER (kind = 'ahead') AS ahead, max(protein) FILTER (kind = 'back') AS back, CASE WHEN p_partkey % 3 = 2 THEN '?' ELSE max(protein) FILTER (kind = 'given') END AS protein FROM proteins GROUP BY p_partkey)
    SELECT p_partkey, CAST(CASE WHEN ahead = protein THEN 0 WHEN back = protein THEN 1 END AS INTEGER) AS strand FROM wide""")
def strand_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the sequences is turned round, a third faces a protein that is none of theirs."""
    case = F.col("p_partkey") % 3
    seen = F.when(case == 1, S.reverse_complement(F.col("nt"))).otherwise(F.col("nt"))
    protein = F.when(case == 2, F.lit("?")).otherwise(S.translate(F.col("nt")))
    # a sequence that reads the same both ways counts as forward
    return _whole(spark, sf_dir).select("p_partkey", S.strand_of(seen, protein).cast("int").alias("strand"))


@query(f"""WITH {_WHOLE_SQL}, parts AS (SELECT p_partkey, i, length(nt) // 3 AS n, nt, substr(nt, i * 3 + 1, 3) AS codon FROM whole, range(0, 200) AS r(i) WHERE (i + 1) * 3 <= length(nt)),
    letters AS (SELECT parts.*, coalesce(aa, 'X') IN ('S', 'L', 'X') AS gone FROM parts LEFT JOIN code USING (codon)),
    faced AS (SELECT a.p_partkey, a.i, a.codon, a.gone, b.gone AS gone_back FROM letters a JOIN letters b ON b.p_partkey = a.p_partkey AND b.i = a.n - 1 - a.i)
    SELECT p_partkey, coalesce(string_agg(codon, '' ORDER BY i) FILTER (NOT gone), '') AS kept, coalesce(string_agg(codon, '' ORDER BY i) FILTER (NOT gone_back), '') AS kept_back FROM faced GROUP BY p_partkey""")
def x_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two letters of each protein count as unknown; their triplets go, counted from the beginning and from the end."""
    protein = F.translate(S.translate(F.col("nt")), "SL", "XX")
    rows = _whole(spark, sf_dir).withColumn("protein", protein)
    return rows.select("p_partkey", S.drop_unknown(F.col("protein"), F.col("nt")).alias("kept"), S.drop_unknown(F.col("protein"), F.col("nt"), backward=True).alias("kept_back"))


_LABELS = ", ".join(f"('{c}', '{a}')" for c, a in CODON_LABEL.items())


@query(f"WITH {_NT_SQL}, code AS (SELECT * FROM (VALUES {_LABELS}) AS t(codon, label)) SELECT p_partkey, CAST(i AS INTEGER) AS i, substr(nt, i * 3 + 1, 3) AS codon, label FROM nt, range(0, 200) AS r(i) LEFT JOIN code ON codon = substr(nt, i * 3 + 1, 3) WHERE (i + 1) * 3 <= length(nt)")
def codon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nt(spark, sf_dir).select("p_partkey", F.posexplode(S.codons(F.col("nt"))).alias("i", "codon"))
    return rows.select("p_partkey", "i", "codon", S.codon_label(F.col("codon")).alias("label"))


@query(f"""WITH {_NT_SQL}, code AS (SELECT * FROM (VALUES {_LABELS}) AS t(codon, label))
    SELECT label, codon, count(*) AS times FROM nt, range(0, 200) AS r(i) JOIN code ON codon = substr(nt, i * 3 + 1, 3) WHERE (i + 1) * 3 <= length(nt) GROUP BY label, codon""")
def codon_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of all triplets, turned back into triplets."""
    rows = _nt(spark, sf_dir).select(F.explode(S.codons(F.col("nt"))).alias("codon")).select(S.codon_label(F.col("codon")).alias("label"))
    counted = rows.where("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("times"))
    return counted.select("label", S.label_codon(F.col("label")).alias("codon"), "times")



def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", F.col("p_name").alias("a")).join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey")


_LCS_SQL = """p AS (SELECT x.p_partkey, x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1),
    s AS (SELECT p_partkey, i, j, n FROM p, range(0, 80) AS r(i), range(0, 80) AS q(j), range(1, 41) AS k(n) WHERE i + n <= length(a) AND j + n <= length(b) AND substr(a, i + 1, n) = substr(b, j + 1, n)),
    k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, i + n, j + n) AS rank FROM s),
    m AS (SELECT p.p_partkey, a, b, n, i, j, substr(a, CAST(i AS BIGINT) + 1, CAST(n AS BIGINT)) AS text FROM k JOIN p USING (p_partkey) WHERE rank = 1)"""


@query(f"WITH {_LCS_SQL} SELECT p_partkey, CAST(n AS INTEGER) AS length, CAST(i AS INTEGER) AS start1, CAST(j AS INTEGER) AS start2, text FROM m")
def lcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _name_pairs(spark, sf_dir).withColumn("m", S.longest_common_substring("a", "b")).where("m.length > 0")
    return rows.select("p_partkey", "m.length", "m.start1", "m.start2", "m.text")


@query(f"""WITH {_LCS_SQL} SELECT p_partkey, CAST(i + t + 1 AS INTEGER) AS pos, substr(a, CAST(i + t + 1 AS BIGINT), 1) AS a, substr(b, CAST(j + t + 1 AS BIGINT), 1) AS b FROM m, range(0, 80) AS r(t) WHERE t < n""")
def lcs_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of both names that face each other in the longest common part."""
    rows = _name_pairs(spark, sf_dir).withColumn("m", S.longest_common_substring("a", "b"))
    spell = lambda c: rows.select("p_partkey", "m", F.posexplode(F.split(c, "")).alias("p", c)).select("p_partkey", "m", (F.col("p") + 1).alias("pos"), c)
    pairs = joins.aligned(spell("a"), spell("b").drop("m"), ["p_partkey"], F.col("m.start1"), F.col("m.start2"), F.col("m.length"))
    return pairs.select("p_partkey", "pos", "a", "b")


@query(f"""WITH {_LCS_SQL}, t AS (SELECT m.*, p_size, p_partkey % 2 AS strand, regexp_replace(translate(regexp_replace(lower(b), '[^a-z]', 'a', 'g'), '{_BASES[0]}', '{_BASES[1]}'), '(.)', '\\1AC', 'g') AS nt FROM m JOIN part USING (p_partkey) WHERE n > 2),
    f AS (SELECT *, CASE WHEN strand = 0 THEN 101 + i * 3 ELSE 100 + length(nt) - (j + n) * 3 + 1 END AS first FROM t)
    SELECT p_partkey, text AS aa, CAST(n AS INTEGER) AS match_len, CAST(p_size + i AS INTEGER) AS match_q_start, CAST(p_size + i + n - 1 AS INTEGER) AS match_q_end,
      CAST(first AS INTEGER) AS match_nt_start, CAST(first + n * 3 - 1 AS INTEGER) AS match_nt_end, CAST(CASE WHEN strand = 0 THEN 101 + j * 3 ELSE first END AS INTEGER) AS match_nt_by_subject,
      substr(upper(a), CAST(i + 1 AS BIGINT), CAST(n AS BIGINT)) AS matched_ss, CASE WHEN strand = 0 THEN substr(nt, CAST(j * 3 + 1 AS BIGINT), CAST(n * 3 AS BIGINT))
      ELSE reverse(translate(substr(nt, CAST(length(nt) - (j + n) * 3 + 1 AS BIGINT), CAST(n * 3 AS BIGINT)), 'ACGT', 'TGCA')) END AS nt_match FROM f""")
def lcs_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of both strands in coordinates of the whole chain and nucleotide sequence; names stand for proteins, three bases for a letter."""
    letters = F.translate(F.regexp_replace(F.lower("b"), "[^a-z]", "a"), *_BASES)
    hits = _name_pairs(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(
        "p_partkey", F.col("a").alias("query"), F.col("b").alias("subject"), F.upper("a").alias("ss"), F.regexp_replace(letters, "(.)", "$1AC").alias("nt"),
        F.col("p_size").alias("q_start"), F.lit(101).alias("s_start"), (F.length("b") * 3 + 100).alias("s_end"), (F.col("p_partkey") % 2).alias("strand"),
    )
    out = etl.match_sequences(hits, 2)
    return out.select("p_partkey", "aa", "match_len", *[F.col(f"match_{c}").cast("int").alias(f"match_{c}") for c in ("q_start", "q_end", "nt_start", "nt_end", "nt_by_subject")], "matched_ss", "nt_match")


@query("SELECT c_custkey, CASE WHEN length(x) > 4 THEN substr(x, 1, 1) || substr(x, 5, 1) || right(x, 2) ELSE x END AS id FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 10 AS VARCHAR) || '.00E+1' || CAST(c_custkey % 7 AS VARCHAR) ELSE '1ABC' END AS x FROM customer)")
def id_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 2 == 0, F.concat((k % 10).cast("string"), F.lit(".00E+1"), (k % 7).cast("string"))).otherwise("1ABC")
    return table(spark, sf_dir, "customer").select("c_custkey", S.repair_id(text).alias("id"))


@query("SELECT s_suppkey, 'A' AS chain, 'A' AS aa, CAST(s_suppkey % 10000 AS INTEGER) AS res_num, round(s_suppkey % 997 / 8.0, 3) AS x, CAST(-1.5 AS DOUBLE) AS y, CAST(s_nationkey AS DOUBLE) AS z FROM supplier")
def fixed_width_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.format_string("ATOM  %5d  CA  ALA A%4d    %8.3f%8.3f%8.3f", (F.col("s_suppkey") % 100000), F.col("s_suppkey") % 10000, F.col("s_suppkey") % 997 / 8.0, F.lit(-1.5), F.col("s_nationkey").cast("double"))
    return files.pdb_atoms(table(spark, sf_dir, "supplier").select("s_suppkey", line.alias("value")))


@query("""SELECT s_suppkey, 'A1' AS codon1, CAST(s_suppkey AS INTEGER) AS res1, ' ' AS ss1, 'CA' AS atom1, '1.50' AS x1, '-2' AS y1, CAST(s_nationkey AS VARCHAR) AS z1, 'A' AS chain1, 'C2' AS codon2,
    CAST(CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey + 1 END AS INTEGER) AS res2, 'E' AS ss2, 'N' AS atom2, '0' AS x2, '1' AS y2, '2' AS z2, 'B' AS chain2, CAST(s_suppkey % 9 AS DOUBLE) / 4 AS distance,
    CASE WHEN s_suppkey % 2 = 0 THEN 'H' ELSE 'S' END AS bond FROM supplier""")
def interface_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of interface bonds; a third of the second residue numbers is not a number."""
    k = F.col("s_suppkey")
    line = F.concat_ws("\t", F.lit("A1"), k.cast("string"), F.lit(" "), F.lit("CA"), F.lit("1.50"), F.lit("-2"), F.col("s_nationkey").cast("string"), F.lit("A"), F.lit("unused"), F.lit("C2"),
                       F.when(k % 3 > 0, (k + 1).cast("string")).otherwise("none"), F.lit("E"), F.lit("N"), F.lit("0"), F.lit("1"), F.lit("2"), F.lit("B"), ((k % 9) / 4).cast("string"),
                       F.when(k % 2 == 0, "bond H").otherwise("bond S"))
    # the field between the chain and the second codon is not used
    return files.bond_fields(table(spark, sf_dir, "supplier").select("s_suppkey", line.alias("value")))


@query("SELECT c_name AS chain_id, c_mktsegment AS organism, CAST(c_nationkey AS VARCHAR) AS query, CAST(c_custkey AS VARCHAR) AS nt FROM customer")
def record_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("c_name", F.lit("\t"), "c_mktsegment", F.lit("\n$"), F.col("c_nationkey").cast("string"), F.lit("\n@"), F.col("c_custkey").cast("string"))
    return files.record_fields(table(spark, sf_dir, "customer").select(text.alias("record")), ["chain_id", "organism"], {"$": "query", "@": "nt"})


@query("""SELECT p_partkey FROM part WHERE NOT regexp_matches(lower(array_to_string(list_slice(string_split(p_name, ' '), 1, 3), ' ')), 'predicted|synthetic|a')
    AND (contains(lower(p_name), 'e') OR (p_size >= 20 AND p_retailprice / 2000.0 >= 0.5))""")
def title_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.substring_index("p_name", " ", 3)
    good = remote.not_predicted(F.col("p_name")) & ~F.lower(start).rlike("a") & remote.good_match(F.col("p_name"), F.lit("e"), F.col("p_size"), F.col("p_retailprice") / 2000.0 * F.col("p_size"), 20, 0.5)
    return table(spark, sf_dir, "part").where(good).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey, 'no order' AS reject_reason FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.split_rejects(table(spark, sf_dir, "customer"), orders, ["c_custkey"], "no order")[1].select("c_custkey", "reject_reason")


def _order_sql(direction: str) -> str:
    return f"""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate {direction}, o_orderkey {direction}) AS k FROM orders) ON o_custkey = c_custkey AND k = 1"""


def _customer_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")


@query(_order_sql("DESC"))
def last_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.last_match(*_customer_orders(spark, sf_dir), ["c_custkey"], ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey")


@query(_order_sql("ASC"))
def first_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.first_match(*_customer_orders(spark, sf_dir), ["c_custkey"], ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3")
def all_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").where("c_nationkey = 3").select("c_custkey")
    return customers.join(_customer_orders(spark, sf_dir)[1], "c_custkey").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, coalesce(CAST(o_orderkey AS VARCHAR), 'NA') AS o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_totalprice > 250000 GROUP BY o_custkey) ON o_custkey = c_custkey")
def null_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "orders").where("o_totalprice > 250000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "customer").join(best, "c_custkey", "left").select("c_custkey", sinks.na("o_orderkey"))


@query("SELECT name, count(*) AS rows FROM (SELECT 'customer' AS name FROM customer UNION ALL SELECT 'supplier' FROM supplier) GROUP BY name")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda n: table(spark, sf_dir, n).select(F.lit(n).alias("name"))
    return one("customer").unionByName(one("supplier")).groupBy("name").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT o_orderkey, r AS rank FROM (SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS r FROM orders) WHERE r <= 100")
def top_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("o_totalprice"), F.col("o_orderkey")]
    best = table(spark, sf_dir, "orders").orderBy(*order).limit(100)
    return best.select("o_orderkey", F.row_number().over(Window.orderBy(*order)).alias("rank"))


@query()
def homology_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three forward readings of every hundredth part against all parts in six frames; stops count as unknown."""
    nt = _nt(spark, sf_dir)
    reads = nt.where("p_partkey % 100 = 0").select("p_partkey", "nt", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("frame"))
    chains = reads.select((F.col("p_partkey") * 10 + F.col("frame")).alias("chain_id"), F.translate(S.translate(F.substr("nt", F.col("frame"))), "*", "X").alias("seq"))
    subjects = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("gi|0|part|"), "p_partkey", F.lit("| "), "p_name").alias("title")).join(nt, "p_partkey")
    return homology.search(chains, subjects.withColumnRenamed("p_partkey", "acc"))
