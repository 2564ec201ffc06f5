"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codebooks, dac, decontam, hilbert, mixing, mixlm, naming, neardup, packing, repair, tokencount, toxicity, warc


def tokenizer_path(name: str) -> str:
    """Where the installed package of public tokenizers keeps a vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard_documents(_table(spark, sf_dir, "documents"), 8)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("shares")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.token_ids(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_mixing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixlm.score_documents(_table(spark, sf_dir, "documents"))


def op8_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.exact_duplicates(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(_table(spark, sf_dir, "embeddings"))


def op12_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return repair.repair_report(turns, repair.damage(turns))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hilbert_shards, op2_source_mix, op3_toxicity, op4_warc_archives, op5_decontamination, op6_token_files,
        op7_mixing_scores, op8_block_naming, op9_token_counts, op10_near_duplicates,
        op11_vector_codes, op12_packed_sequences, op13_conversation_repair, pipeline,
    )
}


def _code_rounds(rounds: int) -> str:
    """SQL of ``rounds`` assignments and updates, and a last assignment ``a{rounds}``: every part against every entry."""
    dist = "(x.x1-b.x1)*(x.x1-b.x1) + (x.x2-b.x2)*(x.x2-b.x2) + (x.x3-b.x3)*(x.x3-b.x3) + (x.x4-b.x4)*(x.x4-b.x4)"
    floor = lambda c: f"CAST((sum({c}) - ((sum({c}) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS {c}"
    out = []
    for k in range(rounds + 1):
        out.append(f"a{k} AS (SELECT r, p, min(({dist}) * 64 + e) AS best FROM x JOIN b{k} b USING (p) GROUP BY r, p)")
        if k < rounds:
            new = ", ".join(floor(f"x{i}") for i in range(1, 5))
            out.append(f"m{k} AS (SELECT p, best % 64 AS e, {new} FROM a{k} JOIN x USING (r, p) GROUP BY p, best % 64)")
            out.append(f"b{k + 1} AS (SELECT p, e, " + ", ".join(f"coalesce(m.x{i}, b.x{i}) AS x{i}" for i in range(1, 5)) + f" FROM b{k} b LEFT JOIN m{k} m USING (p, e))")
    return ", ".join(out)



def _walk_sql() -> str:
    """SQL of the least (cost, audit, lines) in each state behind each row: e nothing yet, s, u, v after an assistant."""
    def go(state: str, cost: str, letter: str, line: str = "") -> str:
        text = f"{state}.t || chr(10) || {line}" if line else f"{state}.t"
        return f"CASE WHEN {state} IS NOT NULL THEN struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letter}', t := {text}) END"

    def insert(state: str, role: str) -> str:
        return go(state, "5", "I", f"'{role}:'")

    def stay(letter: str, when: str, cost: str, line: str, *states: str) -> str:
        return f"CASE WHEN {when} THEN list_min([{', '.join(go(s, cost, letter, line) for s in states)}]) END"

    def filled(table: str) -> str:
        """With the insertions before the next row."""
        one = f"SELECT *, list_min([u, {insert('e', 'user')}, {insert('s', 'user')}, {insert('v', 'user')}]) AS u1 FROM {table}"
        return f"(SELECT *, list_min([v, {insert('u1', 'assistant')}]) AS v1 FROM ({one}))"

    none = "CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR))"
    return f"""
        z AS (SELECT conv_id, 0 AS p, struct_pack(c := 0, a := '', t := '') AS e, {none} AS s, {none} AS u, {none} AS v FROM g
              UNION ALL
              SELECT conv_id, p + 1, {go('e', '2', 'D')}, list_min([{go('s', '2', 'D')}, {stay('K', "k = 's'", 'x', 'me', 'e')}]),
                list_min([{go('u1', '2', 'D')}, {stay('K', "k = 'u'", 'x', 'me', 'e', 's', 'v1')}, {stay('R', 'k IS NOT NULL', '(1 + x)', "'user:' || text", 'e', 's', 'v1')}]),
                list_min([{go('v1', '2', 'D')}, {stay('K', "k = 'a'", 'x', 'me', 'u1')}, {stay('R', 'k IS NOT NULL', '(1 + x)', "'assistant:' || text", 'u1')}])
              FROM (SELECT w.*, f.text, f.role || ':' || f.text AS me, CASE WHEN fault IN ('', 'truncated') THEN left(f.role, 1) END AS k, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS x
                    FROM {filled('z')} w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.p = w.p + 1)),
        done AS (SELECT w.conv_id, list_min([e, v1]) AS best FROM {filled('z')} w JOIN g ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND w.p = g.rows)"""


ORACLE_SQL: dict[str, str] = {
    "op2_source_mix": r"""
        WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
        f AS (SELECT *, sum(n) OVER () AS total, sum(w) OVER () - sum(w) OVER o + w AS rest, sum(n) OVER () - sum(3 * n) OVER o + 3 * n AS remains
              FROM s WINDOW o AS (ORDER BY 3 * n / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
        g AS (SELECT *, 3 * n * rest <= remains * w AS whole FROM f),
        t AS (SELECT source, n, total, CASE WHEN whole THEN CAST(3 * n AS DOUBLE)
                ELSE (SELECT arg_max(CAST(remains AS DOUBLE) / CAST(rest AS DOUBLE), rest) FROM g WHERE NOT whole) * w END AS target FROM g),
        seats AS (SELECT source, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source NULLS LAST, k) AS r
                  FROM t, range(1, CAST((SELECT max(total) FROM t) / 32 + 50 AS BIGINT)) AS k(k) WHERE target > 0 AND k <= target / 32 + 40),
        q AS (SELECT source, count(*) AS blocks FROM seats WHERE r <= (SELECT floor(max(total) / 32 + 0.5) FROM t) GROUP BY source),
        p AS (SELECT t.source, n, target, least(coalesce(blocks, 0) * 32, 3 * n) AS words FROM t LEFT JOIN q ON t.source IS NOT DISTINCT FROM q.source),
        o AS (SELECT d.*, n, target, CASE WHEN n > 0 THEN words // n ELSE 0 END AS passes, CASE WHEN n > 0 THEN words % n ELSE 0 END AS part,
                coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix-1:' || CAST(doc_id AS VARCHAR)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
              FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, n AS source_size, target, CAST(passes * size + greatest(least(start + size, part) - start, 0) AS BIGINT) AS taken, source FROM o
    """,
    "op4_warc_archives": """
        WITH h AS (SELECT page_id, coalesce(html, '') AS t FROM pages), b AS (SELECT page_id, strlen(t) AS n, sha1(t) AS x, max(page_id) OVER (PARTITION BY t) AS best FROM h),
        c AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1), '' ORDER BY i) AS code
              FROM b, range(0, 32) AS r(i) GROUP BY page_id)
        SELECT page_id, n AS payload_bytes, code AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id <> best THEN best END AS refers_to FROM b JOIN c USING (page_id)
    """,
    "op8_block_naming": """
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
              FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
    """,
    "op11_vector_codes": f"""
        WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, q) AS r, * FROM (
                SELECT vec_id, label, list_transform(embedding, lambda z: CAST(floor(256 * z) AS BIGINT)) AS q FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0)),
        x AS (SELECT r, p, q[4 * p + 1] AS x1, q[4 * p + 2] AS x2, q[4 * p + 3] AS x3, q[4 * p + 4] AS x4 FROM v, range(0, 16) AS t(p)),
        b0 AS (SELECT p, r - 1 AS e, x1, x2, x3, x4 FROM x WHERE r <= 64),
        {_code_rounds(2)},
        c AS (SELECT r, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY r),
        s AS (SELECT sha256(string_agg(concat_ws(',', x1, x2, x3, x4), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c USING (r), s
    """,
    "op13_conversation_repair": rf"""
        WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            xor(4294967295, list_reduce(list_transform(range(1, len(k) + 1), lambda i: CAST(ascii(k[i]) AS UBIGINT)), lambda c, z:
              list_reduce([xor(c, z), 1, 1, 1, 1, 1, 1, 1, 1], lambda a, n: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)), CAST(4294967295 AS UBIGINT))) % 20 AS fate
          FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations)),
        d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
              FROM o, range(0, CASE WHEN fate = 3 THEN 2 WHEN fate = 0 THEN 0 ELSE 1 END) AS t(i)),
        n AS (SELECT *, row_number() OVER w AS p, lag(role[1]) OVER w AS was, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
              FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), md5(text))),
        f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM n),
        g AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (p > 1 AND was || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM f GROUP BY conv_id),
        {_walk_sql()}
        SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
          CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t[2:], '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN g ON q.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN done ON q.conv_id IS NOT DISTINCT FROM done.conv_id
    """,
}
