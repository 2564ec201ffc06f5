"""Longest common substrings against the plain table, and in linear time."""

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from chainloom.functions.sequence import _longest_common, longest_common_substring


def plain(a, b):
    """The first longest by the earliest end in the first text, then in the second."""
    best, row = (0, 0, 0), [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row = [0, *(row[j] + 1 if x == y else 0 for j, y in enumerate(b))]
        j = row.index(max(row))
        if row[j] > best[0]:
            best = (row[j], i, j)
    n, i, j = best
    return n, i - n, i, j - n, j, a[i - n : i]


@given(st.text("ab", max_size=25), st.text("abc", max_size=25))
@settings(max_examples=600, deadline=None)
def test_equals_table(a, b):
    assert _longest_common(a, b) == plain(a, b)


@given(st.text(max_size=12), st.text(max_size=12))
def test_any_letters(a, b):
    assert _longest_common(a, b) == plain(a, b)


def long_pair(n):
    rng = random.Random(n)
    common = "".join(rng.choices("ACGT", k=n // 10))
    rest = lambda k: "".join(rng.choices("ACGT", k=k))
    return rest(n // 2) + common + rest(n // 3), rest(n // 5) + common + rest(n // 2), common


def test_long_texts(spark):
    a, b, common = long_pair(100_000)
    df = spark.createDataFrame([(a, b), (b, a), (None, a), ("", "")], "a string, b string").coalesce(1)
    rows = [r.m for r in df.select(longest_common_substring("a", "b").alias("m")).collect()]
    assert common in rows[0].text and rows[0].length < len(common) + 40 and rows[0].text == rows[1].text
    for r, x, y in ((rows[0], a, b), (rows[1], b, a)):
        assert x[r.start1 : r.end1] == y[r.start2 : r.end2] == r.text
    assert rows[2].length == rows[3].length == 0


def test_time_is_about_linear():
    took = []
    for n in (20_000, 80_000):
        a, b, _ = long_pair(n)
        start = time.process_time()
        _longest_common(a, b)
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0]  # sixteen times by a table
