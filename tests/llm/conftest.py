import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHES = ("tag", "h", "name", "size", "k", "m", "s", "p", "n", "rid", "pos", "key", "band", "node", "shard", "slot", "rank", "_rank", "_n", "features", "toxic_", "kind", "sha", "digest", "bucket", "words")


def documents(spark, texts, **more):
    """Documents numbered from 0; an item may be a text or (doc_id, text)."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, ("en", "de", None)[k % 3], (f"src{k % 2}", None)[k % 5 == 4], len(t or "")) for k, (i, t) in enumerate(rows)], DOCS)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing columns."""
    long = " ".join(f"word{i % 97} x{i}" for i in range(30_000))
    return documents(spark, ["", None, "a", "a b", " \t\n", long, long, "Ünï cödé — text, 'quoted' <|endoftext|> <s>", (None, "no id"), (None, None), (3, "a b"), (7, "other text of the same id"), "same words here again", "same words here again"])


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, ["x"]).limit(0)
