"""Registered queries: association, runs and statistics over ordered events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions.distributions import chi_square_even
from chainloom.functions.geometry import adjacency_class, residue_distance
from chainloom.operators import assoc, joins, ranges, stats, windows
from chainloom.plans import etl
from chainloom.session import table

from .views import FOUR_SQL, RESIDUE_SQL, four, residue

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _r(c: Column, name: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name)


def _llh_sql(source: str, items: str, two_pairs: int = 6) -> str:
    return f"""
    WITH {source}, s AS (SELECT {items} AS items, count(*) AS n, avg(value) AS v FROM four WHERE pos4 IS NOT NULL GROUP BY 1),
    i AS (SELECT item, sum(n) AS c FROM (SELECT unnest(items) AS item, n FROM s) GROUP BY item), t AS (SELECT sum(c) AS places FROM i),
    j AS (SELECT s.*, places, CAST(a.c AS DOUBLE)/places*b.c/places*c.c/places*d.c/places AS p,
            len(list_distinct(s.items)) AS k, s.items[2] <> s.items[3] AS m
          FROM s, t, i a, i b, i c, i d WHERE a.item = s.items[1] AND b.item = s.items[2] AND c.item = s.items[3] AND d.item = s.items[4])
    SELECT array_to_string(items, '') AS simplex,
      round(log10(n * 4.0 / places / ((CASE WHEN k = 1 THEN 1 WHEN k = 2 AND m THEN {two_pairs} WHEN k = 2 THEN 4 WHEN k = 3 THEN 12 ELSE 24 END) * p)), 6) AS llh,
      round(n * 4.0 / places, 9) AS frequency, CAST(n AS BIGINT) AS count, round(v, 8) AS avg_value FROM j"""


def _llh(rows: DataFrame, items: str, compat: bool = False) -> DataFrame:
    out = assoc.set_log_likelihood(rows, items, 4, ("value",), compat)
    return out.select(F.array_join(items, "").alias("simplex"), _r(F.col("llh"), "llh"), _r(F.col("frequency"), "frequency", 9), "count", _r(F.col("avg_value"), "avg_value", 8))


@query(_llh_sql(FOUR_SQL, "items"))
def simplex_llh_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _llh(four(spark, sf_dir), "items")


@query(_llh_sql(FOUR_SQL, "list_sort(families)"))
def simplex_llh_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _llh(four(spark, sf_dir).withColumn("sets", F.array_sort("families")), "sets")


@query(_llh_sql(FOUR_SQL, "list_sort(families)", 4))
def simplex_llh_family_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _llh(four(spark, sf_dir).withColumn("sets", F.array_sort("families")), "sets", compat=True)


@query(f"""WITH {FOUR_SQL}, i AS (SELECT unnest(items) AS item FROM four WHERE pos4 IS NOT NULL)
    SELECT item, count(*) AS count, round(count(*) * 1.0 / sum(count(*)) OVER (), 9) AS frequency FROM i GROUP BY item""")
def item_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assoc.item_frequencies(four(spark, sf_dir), "items").select("item", "count", _r(F.col("frequency"), "frequency", 9))


_EDGE_SQL = f"""{RESIDUE_SQL}, q AS (
      SELECT chain, [pos, lead(pos, 1) OVER w, lead(pos, 2) OVER w, lead(pos, 3) OVER w] AS r, [leaf, lead(leaf, 1) OVER w, lead(leaf, 2) OVER w, lead(leaf, 3) OVER w] AS l,
        [value, lead(value, 1) OVER w, lead(value, 2) OVER w, lead(value, 3) OVER w] AS v FROM residue WINDOW w AS (PARTITION BY chain ORDER BY pos)),
    e AS (SELECT DISTINCT chain, r[a] AS ra, r[b] AS rb, l[a] AS la, l[b] AS lb, abs(v[a] - v[b]) AS length
      FROM q, (VALUES (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)) AS k(a, b) WHERE r[4] IS NOT NULL),
    s AS (SELECT least(la, lb) AS a, greatest(la, lb) AS b, count(*) AS n, avg(length) AS length FROM e GROUP BY ALL),
    i AS (SELECT item, sum(n) AS c FROM (SELECT a AS item, n FROM s UNION ALL SELECT b, n FROM s) GROUP BY item), t AS (SELECT sum(c) AS places FROM i),
    edges AS (SELECT s.a || s.b AS edge, s.a = s.b AS same, log10(n * 2.0 / places / ((CASE WHEN s.a = s.b THEN 1 ELSE 2 END) * (CAST(x.c AS DOUBLE) / places * y.c / places))) AS llh,
      n * 2.0 / places AS frequency, CAST(n AS BIGINT) AS count, length FROM s, t, i x, i y WHERE x.item = s.a AND y.item = s.b)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.sliding(residue(spark, sf_dir), ["chain"], ["pos"], ["pos", "leaf", "value"], 4)
    at = [F.struct(F.col(f"pos{k}").alias("r"), F.col(f"leaf{k}").alias("l"), F.col(f"value{k}").alias("v")) for k in range(1, 5)]
    pairs = rows.select("chain", "pos", F.explode(assoc.pairs_of(at)).alias("p"))
    flat = pairs.select("chain", "pos", "p.n", F.col("p.a.r").alias("ra"), F.col("p.b.r").alias("rb"), F.col("p.a.l").alias("la"), F.col("p.b.l").alias("lb"), F.abs(F.col("p.a.v") - F.col("p.b.v")).alias("length"))
    return assoc.pair_log_likelihood(assoc.distinct_edges(flat, ["chain"], "ra", "rb", ["pos", "n"]), "la", "lb", "length")


@query(f"WITH {_EDGE_SQL} SELECT edge, round(llh, 6) AS llh, round(frequency, 9) AS frequency, count, round(length, 8) AS average_length FROM edges")
def edge_llh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("edge", _r(F.col("llh"), "llh"), _r(F.col("frequency"), "frequency", 9), "count", _r(F.col("average_length"), "average_length", 8))


@query(f"""WITH {_EDGE_SQL}, k AS (SELECT same, row_number() OVER (ORDER BY round(llh, 6) DESC, edge) AS rank FROM edges)
    SELECT CAST(n AS INTEGER) AS top, CAST(count(*) FILTER (same AND rank <= n) AS BIGINT) AS identical FROM k, (VALUES (10), (50), (100), (200), (500)) AS t(n) GROUP BY n""")
def identical_pair_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir).withColumn("llh", F.round("llh", 6))
    same = F.substring("edge", 1, 2) == F.substring("edge", 3, 2)
    return assoc.identical_in_top(edges, F.col("edge"), same, [F.desc("llh"), F.col("edge")], (10, 50, 100, 200, 500))


_LINES_SQL = """l AS (SELECT o, list_sort(list_distinct(list(n))) AS r FROM (SELECT l_orderkey AS o, l_linenumber AS n FROM lineitem) GROUP BY o)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("r"))
    return rows.where(F.size("r") >= 4).select("l_orderkey", *[F.col("r")[k].alias(f"r{k + 1}") for k in range(4)])


@query(f"""WITH {_LINES_SQL}, d AS (SELECT o, r[1] AS r1, r[4] AS r4, r[2] - r[1] = 1 AS a, r[3] - r[2] = 1 AS b, r[4] - r[3] = 1 AS c FROM l WHERE len(r) >= 4)
    SELECT o AS l_orderkey, CAST(r4 - r1 - 3 AS INTEGER) AS residue_distance,
      CAST(CASE WHEN a AND b AND c THEN 4 WHEN (a AND b) OR (b AND c) THEN 3 WHEN a AND c THEN 2 WHEN NOT a AND NOT b AND NOT c THEN 0 ELSE 1 END AS INTEGER) AS class FROM d""")
def adjacency_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = [F.col(f"r{k}") for k in range(1, 5)]
    return _lines(spark, sf_dir).select("l_orderkey", residue_distance(r[0], r[3]).cast("int").alias("residue_distance"), adjacency_class(r).alias("class"))


@query(f"""WITH {_LINES_SQL}, d AS (SELECT r[2] - r[1] = 1 AS a, r[3] - r[2] = 1 AS b, r[4] - r[3] = 1 AS c FROM l WHERE len(r) >= 4)
    SELECT class, count(*) AS rows FROM (SELECT CAST(CASE WHEN a AND b AND c THEN 4 WHEN (a AND b) OR (b AND c) THEN 3 WHEN a AND c THEN 2 WHEN NOT a AND NOT b AND NOT c THEN 0 ELSE 1 END AS INTEGER) AS class FROM d) GROUP BY class""")
def class_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacency_classes(spark, sf_dir).groupBy("class").agg(F.count(F.lit(1)).alias("rows"))


@query(f"""WITH {FOUR_SQL} SELECT chain, pos, states[1] AS state FROM four WHERE pos4 IS NOT NULL AND len(list_distinct(states)) = 1 AND states[1] IN ('view', 'click')""")
def strand4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = four(spark, sf_dir).where((F.size(F.array_distinct("states")) == 1) & F.col("states")[0].isin("view", "click"))
    return rows.select("chain", "pos", F.col("states")[0].alias("state"))


@query(f"""WITH {FOUR_SQL}, s AS (SELECT chain, pos, items FROM four WHERE pos4 IS NOT NULL AND len(list_distinct(states)) = 1)
    SELECT chain, pos FROM s WHERE NOT EXISTS (SELECT 1 FROM four f WHERE f.chain = s.chain AND f.pos4 IS NOT NULL AND f.items = s.items AND f.pos < s.pos)""")
def strand_not_in_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = four(spark, sf_dir)
    strands = rows.where(F.size(F.array_distinct("states")) == 1)
    earliest = rows.groupBy("chain", "items").agg(F.min("pos").alias("pos"))
    return joins.set_difference(strands, strands.join(earliest.withColumnRenamed("pos", "first"), ["chain", "items"]).where("first < pos"), ["chain", "pos"]).select("chain", "pos")


@query(f"""WITH {RESIDUE_SQL}, g AS (SELECT *, pos - row_number() OVER (PARTITION BY chain, state ORDER BY pos) AS run FROM residue),
    r AS (SELECT chain, pos, state, min(pos) OVER w AS s, max(pos) OVER w AS e, count(*) OVER w AS n FROM g WINDOW w AS (PARTITION BY chain, state, run))
    SELECT chain, pos, state, s AS run_start, e AS run_end, n AS run_length, CAST(CASE WHEN pos - s <= 0 OR e - pos <= 0 THEN 1 ELSE 2 END AS INTEGER) AS place FROM r WHERE n >= 2""")
def strand_position_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = windows.islands(residue(spark, sf_dir), ["chain"], ["pos"], "state", "pos").where("run_length >= 2")
    place = windows.run_position(F.col("run_start"), F.col("run_end"), F.col("pos"), width=1, margin=0)
    return runs.select("chain", "pos", "state", "run_start", "run_end", "run_length", place.alias("place"))


@query(f"""WITH {RESIDUE_SQL}, f AS (SELECT chain, pos, state = 'view' AS e FROM residue),
    g AS (SELECT chain, pos, count(*) FILTER (e) OVER (PARTITION BY chain ORDER BY pos ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) = 2 AS inside,
      count(*) FILTER (e) OVER (PARTITION BY chain ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) = 1 AS a,
      count(*) FILTER (e) OVER (PARTITION BY chain ORDER BY pos ROWS BETWEEN 2 FOLLOWING AND 2 FOLLOWING) = 1 AS b FROM f)
    SELECT chain, pos, a AND b AS middle FROM g WHERE inside""")
def strand_position_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.context_frame(residue(spark, sf_dir), ["chain"], ["pos"], F.col("state") == "view", 2, 1, 1).where("inside").select("chain", "pos", "middle")


@query(f"""WITH {RESIDUE_SQL}, g AS (SELECT chain, pos, class3, lag(class3) OVER (PARTITION BY chain ORDER BY pos) AS b FROM residue)
    SELECT chain, pos, class3 FROM g WHERE pos = 1 OR b IS DISTINCT FROM class3""")
def run_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.run_dedupe(residue(spark, sf_dir), ["chain"], ["pos"], "class3").select("chain", "pos", "class3")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k
    FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'P') WHERE k = 1""")
def first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = (F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") != "P")
    return windows.first_hit(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], good).select("o_custkey", "o_orderkey")


@query(f"""WITH {RESIDUE_SQL} SELECT chain, string_agg(family, '' ORDER BY pos) AS families, string_agg(leaf, '' ORDER BY pos) AS leaves, min(pos) AS first_position, max(pos) AS last_position,
    max(pos) - min(pos) + 1 AS span, count(*) AS n_rows, CAST(min(pos) AS VARCHAR) || '-' || CAST(max(pos) AS VARCHAR) AS range_label FROM residue GROUP BY chain""")
def seq_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sequence_summary(residue(spark, sf_dir), ["chain"], "pos", {"family": "families", "leaf": "leaves"})


@query(f"""WITH {RESIDUE_SQL} SELECT chain, arg_min(leaf, pos) AS first_leaf, arg_max(leaf, pos) AS last_leaf FROM residue GROUP BY chain""")
def first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(spark, sf_dir).groupBy("chain").agg(F.min_by("leaf", "pos").alias("first_leaf"), F.max_by("leaf", "pos").alias("last_leaf"))


def _obs_sql(column: str, classes: int) -> str:
    obs = ", ".join(f"count(*) FILTER ({column} = {c}) AS obs_{c}" for c in range(classes))
    row = " + ".join(f"obs_{c}" for c in range(classes))
    exp = ", ".join(f"round(CAST({row} AS DOUBLE) / sum({row}) OVER f * sum(obs_{c}) OVER f, 6) AS exp_{c}" for c in range(classes))
    return f"""WITH {RESIDUE_SQL}, o AS (SELECT family, leaf, {obs} FROM residue GROUP BY family, leaf)
    SELECT family, leaf, {", ".join(f"obs_{c}" for c in range(classes))}, {exp} FROM o WINDOW f AS (PARTITION BY family)"""


def _obs(spark: SparkSession, sf_dir: str, column: str, classes: int) -> DataFrame:
    counts = stats.class_counts(residue(spark, sf_dir), ["family", "leaf"], F.col(column), list(range(classes)))
    out = stats.expected_counts(counts, "family", list(range(classes)))
    return out.select("family", "leaf", *[f"obs_{c}" for c in range(classes)], *[_r(F.col(f"exp_{c}"), f"exp_{c}") for c in range(classes)])


@query(_obs_sql("class3", 3))
def obs_exp_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _obs(spark, sf_dir, "class3", 3)


@query(_obs_sql("class8", 8))
def obs_exp_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _obs(spark, sf_dir, "class8", 8)


@query(f"""WITH {RESIDUE_SQL} SELECT family, leaf, {", ".join(f"count(*) FILTER (class3 = {c}) AS obs_{c}" for c in range(3))}, CASE WHEN grouping(leaf) = 0 THEN 'leaf' ELSE 'family' END AS level
    FROM residue GROUP BY GROUPING SETS ((family, leaf), (family))""")
def obs_exp_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rollup_counts(residue(spark, sf_dir), "family", "leaf", F.col("class3"), [0, 1, 2])


@query(f"""WITH {RESIDUE_SQL}, o AS (SELECT family, leaf, class3 AS c, count(*) AS n FROM residue GROUP BY ALL),
    g AS (SELECT f.family, f.leaf, k.c, coalesce(o.n, 0) AS n FROM (SELECT DISTINCT family, leaf FROM residue) f CROSS JOIN (VALUES (0), (1), (2)) k(c) LEFT JOIN o ON o.family = f.family AND o.leaf = f.leaf AND o.c = k.c),
    e AS (SELECT *, CAST(sum(n) OVER (PARTITION BY family, leaf) AS DOUBLE) / sum(n) OVER (PARTITION BY family) * sum(n) OVER (PARTITION BY family, c) AS e FROM g),
    x AS (SELECT family, CAST(c AS INTEGER) AS class, sum((n - e) * (n - e) / e) AS x2, count(*) - 1 AS df FROM e GROUP BY family, c)
    SELECT family, class, round(x2, 6) AS x2, df, round(exp(-x2 / 2) * (1 + x2 / 2), 6) AS p FROM x""")
def chi_square_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stats.class_counts(residue(spark, sf_dir), ["family", "leaf"], F.col("class3"), [0, 1, 2])
    return stats.chi_square_families(counts, "family", [0, 1, 2]).select("family", "class", _r(F.col("x2"), "x2"), "df", _r(chi_square_even(F.col("x2"), 4), "p"))


@query(f"""WITH {RESIDUE_SQL}, o AS (SELECT family, leaf, class8 AS c, count(*) AS n FROM residue GROUP BY ALL),
    g AS (SELECT f.family, f.leaf, k.c, coalesce(o.n, 0) AS n FROM (SELECT DISTINCT family, leaf FROM residue) f CROSS JOIN range(0, 8) k(c) LEFT JOIN o ON o.family = f.family AND o.leaf = f.leaf AND o.c = k.c),
    e AS (SELECT *, CAST(sum(n) OVER (PARTITION BY family, leaf) AS DOUBLE) / sum(n) OVER (PARTITION BY family) * sum(n) OVER (PARTITION BY family, c) AS e FROM g),
    x AS (SELECT family, CAST(c AS INTEGER) AS class, sum(CASE WHEN e > 0 THEN (n - e) * (n - e) / e END) AS x2, count(*) - 1 AS df FROM e GROUP BY family, c)
    SELECT family, class, round(x2, 6) AS x2, df, round(exp(-x2 / 2) * (1 + x2 / 2), 6) AS p FROM x""")
def chi_square_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general tail function; five leaves a family give four degrees of freedom."""
    counts = stats.class_counts(residue(spark, sf_dir), ["family", "leaf"], F.col("class8"), list(range(8)))
    out = stats.with_p_value(stats.chi_square_families(counts, "family", list(range(8))))
    return out.select("family", "class", _r(F.col("x2"), "x2"), "df", _r(F.col("p"), "p"))


@query(f"""WITH {RESIDUE_SQL}, r AS (SELECT * FROM residue WHERE leaf[2] <> '5'), o AS (SELECT family, leaf, class8 AS c, count(*) AS n FROM r GROUP BY ALL),
    g AS (SELECT f.family, f.leaf, k.c, coalesce(o.n, 0) AS n FROM (SELECT DISTINCT family, leaf FROM r) f CROSS JOIN range(0, 8) k(c) LEFT JOIN o ON o.family = f.family AND o.leaf = f.leaf AND o.c = k.c),
    e AS (SELECT *, CAST(sum(n) OVER (PARTITION BY family, leaf) AS DOUBLE) / sum(n) OVER (PARTITION BY family) * sum(n) OVER (PARTITION BY family, c) AS e FROM g),
    x AS (SELECT family, CAST(c AS INTEGER) AS class, sum(CASE WHEN e > 0 THEN (n - e) * (n - e) / e END) AS x2, count(*) - 1 AS df FROM e GROUP BY family, c),
    z AS (SELECT *, x2 / 2 AS h FROM x), p AS (SELECT family, class, any_value(x2) AS x2, any_value(df) AS df, 1 - exp(-any_value(h)) * sum(pow(h, k + 0.5) / gamma(k + 1.5)) + 2 / sqrt(pi()) * sqrt(any_value(h)) * exp(-any_value(h)) AS p FROM z, range(0, 150) AS t(k) GROUP BY family, class)
    SELECT family, class, round(x2, 6) AS x2, df, round(p, 6) AS p FROM p""")
def chi_square_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four leaves a family: three degrees of freedom."""
    rows = residue(spark, sf_dir).where(F.substring("leaf", 2, 1) != "5")
    counts = stats.class_counts(rows, ["family", "leaf"], F.col("class8"), list(range(8)))
    out = stats.with_p_value(stats.chi_square_families(counts, "family", list(range(8))))
    return out.select("family", "class", _r(F.col("x2"), "x2"), "df", _r(F.col("p"), "p"))


_LETTERS = "HGIEBSTCMN"
_FIVE = {"Helix": list("HGI"), "Sheet": list("EB"), "Curvature/Turn": list("ST"), "Blank": ["M"], "None": ["N"]}
_NINE = {"3-10 helix": ["G"], "Alpha helix": ["H"], "Pi helix": ["I"], "Beta bridge": ["B"], "Beta bulge": ["E"], "Turn": ["T"], "Curvature": ["S"], "Blank": ["C"], "None": ["N"]}


def _composition_sql(buckets: dict[str, list[str]]) -> str:
    pairs = ", ".join(f"('{n}', '{x}')" for n, xs in buckets.items() for x in xs)
    return f"""WITH {RESIDUE_SQL}, l AS (SELECT chain, pos, substr('{_LETTERS}', 1 + event_id % 10, 1) AS s FROM residue),
    w AS (SELECT [s, lead(s, 1) OVER o, lead(s, 2) OVER o, lead(s, 3) OVER o] AS f, lead(pos, 3) OVER o AS p FROM l WINDOW o AS (PARTITION BY chain ORDER BY pos)),
    s AS (SELECT unnest(f) AS s FROM w WHERE p IS NOT NULL), b AS (SELECT * FROM (VALUES {pairs}) AS t(label, s)), c AS (SELECT label, count(x.s) AS count FROM b LEFT JOIN s x ON x.s = b.s GROUP BY label)
    SELECT label, count, round(count * 1.0 / sum(count) OVER (), 9) AS share FROM c"""


def _composition(spark: SparkSession, sf_dir: str, buckets: dict[str, list[str]]) -> DataFrame:
    """The buckets of the states in all windows of four."""
    letter = F.substr(F.lit(_LETTERS), (F.col("event_id") % 10 + 1).cast("int"), F.lit(1))
    rows = windows.sliding(residue(spark, sf_dir).withColumn("s", letter), ["chain"], ["pos"], ["s"], 4)
    return stats.bucket_composition(rows, F.array(*[F.col(f"s{k}") for k in range(1, 5)]), buckets).select("label", "count", _r(F.col("share"), "share", 9))


@query(_composition_sql(_FIVE))
def composition_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _composition(spark, sf_dir, _FIVE)


@query(_composition_sql(_NINE))
def composition_9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _composition(spark, sf_dir, _NINE)


@query(f"""WITH {FOUR_SQL}, s AS (SELECT unnest(states) AS s FROM four WHERE pos4 IS NOT NULL), c AS (SELECT CASE WHEN s IN ('view', 'click') THEN s ELSE 'other' END AS label, count(*) AS count FROM s GROUP BY 1)
    SELECT label, count, round(count * 1.0 / sum(count) OVER (), 9) AS share FROM c""")
def composition_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.composition(four(spark, sf_dir), F.col("states"), ["view", "click"]).select("label", "count", _r(F.col("share"), "share", 9))


@query(f"""WITH {RESIDUE_SQL}, o AS (SELECT family, leaf, CAST(count(*) FILTER (class3 = 0) AS DOUBLE) AS o, CAST(count(*) FILTER (class3 = 1) AS DOUBLE) AS e FROM residue GROUP BY family, leaf),
    x AS (SELECT family, CASE WHEN min(e) > 0 THEN sum((o - e) * (o - e) / e) END AS x2, count(*) - 1 AS df FROM o GROUP BY family HAVING count(*) > 1)
    SELECT family, round(x2, 6) AS x2, df, round(exp(-x2 / 2) * (1 + x2 / 2), 6) AS p FROM x""")
def chi_square_against(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One class's counts of each family's leaves against another's; five leaves, so four degrees of freedom."""
    counts = stats.class_counts(residue(spark, sf_dir), ["family", "leaf"], F.col("class3"), [0, 1])
    out = stats.with_p_value(stats.chi_square_against(counts, "family", "obs_0", "obs_1"))
    return out.select("family", _r(F.col("x2"), "x2"), "df", _r(F.col("p"), "p"))


@query(f"""WITH {RESIDUE_SQL}, w AS (SELECT chain, count(*) AS chain_length, string_agg(family, '' ORDER BY pos) AS aa_seq, string_agg(leaf, '' ORDER BY pos) AS nt_seq, string_agg(substr(state, 1, 1), '' ORDER BY pos) AS secondary_structure FROM residue GROUP BY chain)
    SELECT c_custkey AS chain_id, c_name, c_mktsegment, chain_length, aa_seq, nt_seq, secondary_structure FROM customer JOIN w ON chain = c_custkey""")
def chain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the chains that have residues, with their residues' letters in order."""
    rows = residue(spark, sf_dir).select(F.col("chain").alias("chain_id"), F.col("pos").alias("res_num"), F.col("family").alias("aa"), F.col("leaf").alias("codon"), F.substring("state", 1, 1).alias("ss"))
    meta = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chain_id"), "c_name", "c_mktsegment")
    return etl.summarise_chains(meta, rows)


_ANGLE_SQL = f"{RESIDUE_SQL}, a AS (SELECT family, CAST((event_id * 37) % 361 AS DOUBLE) AS angle FROM residue)"


@query(f"""WITH {_ANGLE_SQL}, q AS (SELECT family, count(*) FILTER (angle > 0 AND angle < 90) AS q1, count(*) FILTER (angle > 90 AND angle < 180) AS q2,
    count(*) FILTER (angle > 180 AND angle < 270) AS q3, count(*) FILTER (angle > 270 AND angle < 360) AS q4 FROM a GROUP BY family)
    SELECT *, q1 + q4 AS right_half, q2 + q3 AS left_half, q1 + q2 AS upper_half, q3 + q4 AS lower_half FROM q""")
def quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = residue(spark, sf_dir).withColumn("angle", ((F.col("event_id") * 37) % 361).cast("double"))
    return stats.quadrant_counts(rows, F.col("angle"), ["family"])


@query("""WITH p AS (SELECT l_extendedprice AS x, l_quantity AS y FROM lineitem), e AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM p)
    SELECT CAST(least(floor((x - a) / (b - a) * 100), 99) AS INTEGER) AS bx, CAST(least(floor((y - c) / (d - c) * 100), 99) AS INTEGER) AS "by", count(*) AS count FROM p, e GROUP BY 1, 2""")
def hist2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    return stats.histogram_2d(rows, "x", "y")


@query(f"""WITH {RESIDUE_SQL}, v AS (SELECT value, state = 'purchase' AS pos FROM residue WHERE value IS NOT NULL), j AS (SELECT CAST(range AS INTEGER) AS j FROM range(0, 40))
    SELECT j, CAST(j * 5.0 AS DOUBLE) AS boundary, round(avg(CASE WHEN (value > j * 5.0) = pos THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM v, j GROUP BY j""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.threshold_sweep(residue(spark, sf_dir), "value", F.col("state") == "purchase", 0, 40, 5.0)
    return out.select("j", _r(F.col("boundary"), "boundary"), _r(F.col("accuracy"), "accuracy", 9))


@query(f"""WITH {RESIDUE_SQL}, s AS (SELECT state, min(value) AS lo, max(value) AS hi, count(value) AS n, stddev_samp(value) * pow(count(value), -0.2) AS h FROM residue GROUP BY state),
    g AS (SELECT s.*, CAST(i AS INTEGER) AS i, lo + (hi - lo) * i / 49 AS x FROM s, range(0, 50) AS r(i) WHERE h > 0)
    SELECT g.state, g.i, round(any_value(x), 6) AS x, round(sum(exp(-(x - value) * (x - value) / (2 * h * h))) / (any_value(n) * any_value(h) * 2.5066282746310002), 9) AS density
    FROM g JOIN residue r ON r.state = g.state WHERE value IS NOT NULL GROUP BY g.state, g.i""")
def kde_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.kernel_density(residue(spark, sf_dir), "value", 50, ["state"])
    return out.select("state", "i", _r(F.col("x"), "x"), _r(F.col("density"), "density", 9))


def _pairs_sql(where: str) -> str:
    return f"""WITH {FOUR_SQL}, s AS (SELECT families AS f FROM four WHERE pos4 IS NOT NULL{where}),
    i AS (SELECT 'leaf' AS kind, unnest(f) AS item FROM s UNION ALL SELECT 'pair', least(f[k], f[k + 1]) || greatest(f[k], f[k + 1]) FROM s, range(1, 4) AS r(k)),
    c AS (SELECT kind, item, count(*) AS count FROM i GROUP BY kind, item)
    SELECT kind, item, count, round(count * 1.0 / sum(count) OVER (PARTITION BY kind), 9) AS frequency FROM c"""


@query(_pairs_sql(""))
def leaf_pair_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.leaf_and_pair_composition(four(spark, sf_dir), "families")
    return out.select("kind", "item", "count", _r(F.col("frequency"), "frequency", 9))


@query(_pairs_sql(" AND value <= 40"))
def leaf_pair_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.leaf_and_pair_composition(four(spark, sf_dir).where("value <= 40"), "families")
    return out.select("kind", "item", "count", _r(F.col("frequency"), "frequency", 9))


@query(f"""WITH {RESIDUE_SQL}, v AS (SELECT event_id, value, CASE WHEN state = 'purchase' THEN 'yes' ELSE 'no' END AS label FROM residue),
    p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(event_id AS VARCHAR) || ':0'), event_id) AS k FROM v), n AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM v GROUP BY label)),
    d AS (SELECT 'all' AS dataset, value, label FROM v UNION ALL SELECT 'balanced', value, label FROM p, n WHERE k <= m), j AS (SELECT CAST(range AS INTEGER) AS j FROM range(0, 20))
    SELECT dataset, j, CAST(j * 10.0 AS DOUBLE) AS boundary, round(avg(CASE WHEN (value > j * 10.0) = (label = 'yes') THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM d, j WHERE value IS NOT NULL GROUP BY dataset, j""")
def balanced_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = residue(spark, sf_dir).select("event_id", "value", F.when(F.col("state") == "purchase", "yes").otherwise("no").alias("label"))
    out = stats.balanced_sweep(rows, "event_id", "label", "yes", "value", 0, 20, 10.0)
    return out.select("dataset", "j", "boundary", _r(F.col("accuracy"), "accuracy", 9))


#: All events in the order of their times: one chain that holds every row.
_STREAM_SQL = """stream AS (SELECT CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS pos, event_id, ts, event_type AS state, CAST(json_extract(props, '$.k') AS INTEGER) % 8 > 0 AS on_ FROM events)"""


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(F.lit(0).alias("chain"), "event_id", "ts", F.col("event_type").alias("state"), (k % 8 > 0).alias("on"))


@query(f"WITH {_STREAM_SQL}, g AS (SELECT *, lag(state) OVER (ORDER BY pos) AS b FROM stream) SELECT event_id, state FROM g WHERE pos = 1 OR b IS DISTINCT FROM state")
def long_chain_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.run_dedupe(_stream(spark, sf_dir), ["chain"], ["ts", "event_id"], "state", size=ranges.SIZE).select("event_id", "state")


@query(f"""WITH {_STREAM_SQL}, g AS (SELECT event_id, count(*) FILTER (on_) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) = 4 AS inside,
      count(*) FILTER (on_) OVER (ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3 AS a, count(*) FILTER (on_) OVER (ORDER BY pos ROWS BETWEEN 4 FOLLOWING AND 6 FOLLOWING) = 3 AS b FROM stream)
    SELECT event_id, a AND b AS middle FROM g WHERE inside""")
def long_chain_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four, with three rows in front and three behind."""
    rows = windows.context_frame(_stream(spark, sf_dir), ["chain"], ["ts", "event_id"], F.col("on"), 4, 3, 3, size=ranges.SIZE)
    return rows.where("inside").select("event_id", "middle")


@query(f"""WITH {_STREAM_SQL}, g AS (SELECT *, pos - row_number() OVER (PARTITION BY on_ ORDER BY pos) AS run FROM stream),
    r AS (SELECT *, min(pos) OVER w AS s, max(pos) OVER w AS e, count(*) OVER w AS n FROM g WINDOW w AS (PARTITION BY on_, run))
    SELECT event_id, s AS run_start, e AS run_end, n AS run_length, CAST(CASE WHEN pos - s <= 2 OR e - (pos + 3) <= 2 THEN 1 ELSE 2 END AS INTEGER) AS place FROM r WHERE on_ AND e - pos >= 3""")
def long_chain_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and, for windows of four in them, whether the run ends within two rows."""
    placed = ranges.ranked(_stream(spark, sf_dir), ["ts", "event_id"], "pos").withColumn("pos", F.col("pos") + 1)
    runs = windows.islands(placed, ["chain"], ["pos"], "on", "pos", size=ranges.SIZE).where(F.col("on") & (F.col("run_end") - F.col("pos") >= 3))
    return runs.select("event_id", "run_start", "run_end", "run_length", windows.run_position(F.col("run_start"), F.col("run_end"), F.col("pos")).alias("place"))
