"""The pipeline's stages by brute force on a small corpus."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from chainloom.llm import queries

from .conftest import DOCS
from .test_operators import component_ids, prose, sets_of, toxic_corpus


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    texts, labels = toxic_corpus(700, 3)
    items = [prose(rng, 30) for _ in range(5)]
    clean = [i for i, _, y in labels if not y]
    for k in clean[:10]:
        texts[k] = prose(rng, 12) + " " + items[k % 5] + " " + prose(rng, 9)
    for k in clean[20:30]:
        texts[k] = texts[clean[31]] + f" tail{k}" if len(texts[clean[31]].split()) > 30 else texts[k]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)] + [(None, "no id", None, None, None), (5000, None, None, "src1", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "source_mix", "token_ids"] and corpus_pipeline.ORACLE_SQL is None

    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append(sorted((r.doc_id for r in docs.collect() if r.doc_id is not None)))
    toxic = {i for i, _, y in labels if y}
    gone = set(range(700)) - set(kept[0])
    assert len(gone & toxic) > 0.95 * len(toxic) and len(gone - toxic) <= 3 and 5000 in kept[0]
    ids = [i for i in kept[0] if i < 700]
    comp = component_ids(ids, sets_of([texts[i] for i in ids], 5), 0.8)
    assert kept[1] == sorted([i for i in ids if comp[i] == i] + [5000])
    assert kept[2] == [i for i in kept[1] if not any(t in (texts[i] if i < 700 else "") for t in items)]
    assert set(kept[3]) <= set(kept[2])

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mixed = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got = sorted(corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect(), key=lambda r: r.start)
    start = 0
    for r, d in zip(got, mixed, strict=True):
        ids = [*model.encode(d.text or "", add_special_tokens=False).ids, 0]
        assert tuple(r) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    whole = sorted(tuple(r) for r in queries.pipeline(spark, str(tmp_path)).collect() if r.doc_id is not None)
    assert whole == sorted(tuple(r) for r in got if r.doc_id is not None)


def test_mix_keeps_every_row(spark, tmp_path):
    """Rows without doc_id reach the token stage, and rows of one doc_id are taken by their own size."""
    rng = random.Random(5)
    short, long = prose(rng, 10), prose(rng, 1000)
    rows = [(None, prose(rng, 40), "en", "a", 1), (None, prose(rng, 40), None, "a", 1), (7, short, "en", "a", 1), (7, long, "en", "a", 1), (8, long, "en", "a", 2), (8, long, "en", "a", 2)]
    docs = spark.createDataFrame(rows, DOCS)
    want = Counter()
    for r in corpus_pipeline.mixing.mix(docs, keep=("text",)).collect():
        want[r.doc_id, r.text] += int(r.taken / r.size + 0.5)
    mixed = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert Counter((r.doc_id, r.text) for r in mixed.collect()) == +want and want[7, short] == 1 and want[7, long] == 1
    tokens = Counter(r.doc_id for r in corpus_pipeline.write_token_ids(spark, mixed, str(tmp_path)).collect())
    assert tokens[None] == 2 and tokens[7] == 2 and tokens[8] == 2


def test_decisions_reach_rows_without_doc_id(spark, tmp_path):
    """Rows without doc_id and repeated ones are judged like others; of each group one row stays; extra columns are dropped and empty tables pass."""
    rng = random.Random(21)
    texts, labels = toxic_corpus(700, 5)
    items = [prose(rng, 30)]
    same, other, long = prose(rng, 50), prose(rng, 60), prose(rng, 400_000)
    bad = next(texts[i] for i, _, y in labels if y and i % 2)
    odd = [(None, bad), (None, same), (None, same), (9001, same), (9001, other), (9001, other), (9002, other + " tail"), (None, items[0] + " x"), (None, ""), (None, None), (9003, ""), (9004, long), (9005, long), (None, None)]
    rows = [(i, t, "en", "src0", len(t), "extra") for i, t in enumerate(texts)] + [(i, t, None, None, None, "extra") for i, t in odd]
    docs = spark.createDataFrame(rows, DOCS + ", key string")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    toxic = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert toxic.columns == corpus_pipeline.COLUMNS and toxic.where(F.col("text") == bad).count() == 0 and toxic.where("doc_id IS NULL").count() == 6
    near = corpus_pipeline.drop_near_duplicates(spark, toxic, str(tmp_path))
    kept = Counter((r.doc_id, r.text) for r in near.where("doc_id >= 9000 OR doc_id IS NULL").collect())
    assert kept == Counter([(9001, same), (9001, other), (None, items[0] + " x"), (None, ""), (None, None), (None, None), (9003, ""), (9004, long)])
    clean = corpus_pipeline.drop_contaminated(spark, near, str(tmp_path))
    assert clean.where(F.col("text").startswith(items[0])).count() == 0 and clean.count() == near.count() - 1
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0
