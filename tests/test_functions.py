"""Hand-derived expectations for column functions."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainloom.functions import distributions as D
from chainloom.functions import geometry as G
from chainloom.functions import sequence as S
from chainloom.functions.lookup import CODON_LABEL, HYDROPATHIES, LABEL_CODON, VOLUME


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_codes(spark):
    assert len(CODON_LABEL) == 61 and LABEL_CODON["A2"] == "GCC"
    r = one(
        spark, rc=S.reverse_complement(F.lit("GCTGCC")), aa=S.translate(F.lit("GCTGCCTAA")), a=S.first_base(F.lit("KM"), S.IUPAC_A), b=S.first_base(F.lit("KM"), S.IUPAC_B),
        label=S.codon_label(F.lit("GCN")), stop=S.codon_label(F.lit("TAA")), x=S.residue_letter(F.lit("SEC")), chain=S.chain_letter(F.lit("12")), back=S.label_codon(F.lit("Y2")),
        id=S.repair_id(F.lit("1.00E+12")), short=S.repair_id(F.lit("1ABC")), acc=S.accession(F.lit("gi|1|gb|XX1.1|t")), none=S.field(F.lit("a\tb"), 5), gap=S.drop_gaps(F.lit("A-C-")),
        part=S.one_based_slice(F.lit("HHHEE"), F.lit(2), F.lit(4)),
    )
    assert r.asDict() == {
        "rc": "GGCAGC", "aa": "AA*", "a": "TC", "b": "GA", "label": "A3", "stop": None, "x": "X", "chain": "L", "back": "TAC", "id": "1E12", "short": "1ABC", "acc": "XX1.1",
        "none": None, "gap": "AC", "part": "HHE",
    }


def test_split_and_unknown_residues(spark):
    seq, ss = S.split_first(F.lit("ACD#HHE"), "#")
    whole, nothing = S.split_first(F.lit("ACD"), "#")
    r = one(spark, seq=seq, ss=ss, whole=whole, nothing=nothing, ahead=S.drop_unknown(F.lit("AXC"), F.lit("GCTAAATGT")), back=S.drop_unknown(F.lit("AXC"), F.lit("ACATTTAGC"), True))
    assert (r.seq, r.ss, r.whole, r.nothing) == ("ACD", "HHE", "ACD", None)
    assert r.ahead == "GCTTGT" and r.back == "ACAAGC"


def test_strand(spark):
    df = spark.createDataFrame([("GCTTGT", "AC"), ("ACAAGC", "AC"), ("GGGGGG", "AC")], "nt string, aa string")
    assert [r[0] for r in df.select(S.strand_of(F.col("nt"), F.col("aa"))).collect()] == [0, 1, None]


@given(st.text("AB", max_size=12), st.text("AB", max_size=12))
def test_longest_common_substring_rules(a, b):
    n, s1, e1, s2, e2, text = S._longest_common(a, b)
    assert a[s1:e1] == b[s2:e2] == text and len(text) == n
    best = max((len(a[i:j]) for i in range(len(a) + 1) for j in range(i, len(a) + 1) if a[i:j] in b), default=0)
    assert n == best == S._longest_common(b, a)[0]


def test_longest_common_substring(spark):
    df = spark.createDataFrame([("ABABC", "BABCA"), ("", "A"), (None, "A")], "a string, b string")
    rows = [r.m for r in df.select(S.longest_common_substring("a", "b").alias("m")).collect()]
    assert tuple(rows[0]) == (4, 1, 5, 0, 4, "BABC") and rows[1].length == 0 and rows[2].length == 0


def points(spark, *ps):
    return spark.range(1).select(*[F.struct(*[F.lit(float(v)).alias(c) for c, v in zip("xyz", p)]).alias(f"p{k}") for k, p in enumerate(ps, 1)])


def test_tetra_metrics(spark):
    r = G.tetra_metrics(points(spark, (0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)), ["p1", "p2", "p3", "p4"]).first()
    assert [r[f"e{k}"] for k in range(1, 7)] == [1, 1, 1, 1.414, 1.414, 1.414]
    assert (r.volume, r.tetrahedrality) == (0.167, 0.071)


@pytest.mark.parametrize("z, twist, rotation", [(1, 117.035692, 206.565051), (-1, -117.035692, 153.434949)])
def test_strand_angles(spark, z, twist, rotation):
    r = G.strand_angles(points(spark, (0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 1, z)), ["p1", "p2", "p3", "p4"]).first()
    assert r.twist == pytest.approx(twist, abs=1e-5) and r.bend == pytest.approx(60, abs=1e-5) and r.rotation == pytest.approx(rotation, abs=1e-5)


def test_plane_and_feet(spark):
    a, b, c, p = (G.Vec(*[F.lit(float(v)) for v in q]) for q in ((0, 0, 0), (1, 0, 0), (0, 1, 0), (2, 3, 5)))
    normal, offset = G.plane(a, b, c)
    r = one(spark, plane=G.foot_on_plane(normal, offset, p).struct(), line=G.foot_on_line(a, b, p).struct(), turn=G.turn(b, c, G.Vec(F.lit(0.0), F.lit(0.0), F.lit(-1.0))), angle=G.angle(b, c))
    assert tuple(r.plane) == (2, 3, 0) and tuple(r.line) == (2, 0, 0) and r.turn == 270 and r.angle == pytest.approx(90)


@pytest.mark.parametrize("r, want", [((5, 6, 7, 8), 4), ((5, 6, 7, 9), 3), ((5, 7, 8, 9), 3), ((5, 6, 8, 9), 2), ((5, 7, 9, 11), 0), ((5, 7, 8, 10), 1)])
def test_adjacency(spark, r, want):
    assert one(spark, c=G.adjacency_class([F.lit(v) for v in r])).c == want
    assert one(spark, d=G.residue_distance(F.lit(r[0]), F.lit(r[3]))).d == r[3] - r[0] - 3


def test_property_features(spark):
    r = one(spark, **G.property_features([F.lit(a) for a in "AGWC"], VOLUME, HYDROPATHIES))
    assert (r.a1, r.a2, r.a3, r.a4) == ("G", "A", "C", "W") and (r.v0, r.v3) == (60.1, 227.8) and r.v_edge0 == pytest.approx(148.7)
    assert r.aa_v_ave == pytest.approx(121.25) and r.aa_h_ave == pytest.approx((1.8 - 0.4 - 0.9 + 2.5) / 4)


def test_distributions(spark):
    want = [0.0544125, 0.1572372, 0.2957340, 0.4481259, 0.5933640]
    assert [D._tail(3.7, d) for d in range(1, 6)] == pytest.approx(want, abs=1e-7)
    assert one(spark, p=D.chi_square_even(F.lit(3.7), 4)).p == pytest.approx(want[3], abs=1e-7)
    assert D._t_quantile(0.975, 10) == pytest.approx(2.2281389, abs=1e-6) and math.isnan(D._t_quantile(0.975, 0))
