"""Operators on ordered rows within a partition: runs, sliding windows, context frames, first hits.

With ``size`` the rows are cut into blocks of so many, across partitions and within
them, for chains that are too long for a task (see ``ranges``); results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from . import ranges


def _ordered(df: DataFrame, part: list[str], order: list[str], before: int, after: int, size: int | None) -> tuple[DataFrame, WindowSpec]:
    """Rows and the window that holds ``before`` rows in front of each and ``after`` behind."""
    if size is None:
        return df, Window.partitionBy(*part).orderBy(*order)
    return ranges.blocks(df, [*part, *order], before, after, size), Window.partitionBy("_block", *part).orderBy("_rank")


def _once(df: DataFrame, size: int | None) -> DataFrame:
    return df if size is None else ranges.owned(df)


def run_dedupe(df: DataFrame, part: list[str], order: list[str], value: str, size: int | None = None) -> DataFrame:
    """Keep the first row of each run of equal values; a value that returns later is kept again."""
    df, w = _ordered(df, part, order, 1, 0, size)
    keep = (F.row_number().over(w) == 1) | ~F.lag(value).over(w).eqNullSafe(F.col(value))
    return _once(df.withColumn("_keep", keep).where("_keep").drop("_keep"), size)


def sliding(df: DataFrame, part: list[str], order: list[str], cols: list[str], k: int, size: int | None = None) -> DataFrame:
    """Windows of ``k`` consecutive rows: ``c1 .. ck`` for each column ``c``; the last k - 1 rows begin none."""
    df, w = _ordered(df, part, order, 0, k - 1, size)
    out = df.withColumns({f"{c}{i + 1}": F.lead(c, i).over(w) for c in cols for i in range(k)})
    return _once(out.withColumn("_left", F.count(F.lit(1)).over(w.rowsBetween(0, k - 1))).where(F.col("_left") == k).drop("_left"), size)


def context_frame(df: DataFrame, part: list[str], order: list[str], flag: Column, width: int, before: int, after: int, size: int | None = None) -> DataFrame:
    """Add ``inside``: the ``width`` rows from this one all hold the flag; ``middle``: so do ``before`` rows in front and ``after`` behind.

    A frame that the partition's ends cut short is not in the middle.
    """
    df, w = _ordered(df, part, order, before, width + after - 1, size)

    def all_of(a: int, b: int) -> Column:
        return F.count_if(flag).over(w.rowsBetween(a, b)) == b - a + 1

    inside = all_of(0, width - 1)
    middle = inside & all_of(-before, -1) & all_of(width, width + after - 1)
    return _once(df.withColumns({"inside": inside, "middle": middle}), size)


def islands(df: DataFrame, part: list[str], order: list[str], value: str, position: str, size: int | None = None) -> DataFrame:
    """Add run_start, run_end and run_length of the maximal run of equal values that each row belongs to."""
    if size is not None:
        return ranges.run_bounds(df, part, order, value, position, size)
    w = Window.partitionBy(*part).orderBy(*order)
    run = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*part, value).orderBy(*order))
    df = df.withColumn("_run", run)
    same = Window.partitionBy(*part, value, "_run")
    return df.withColumns({
        "run_start": F.min(position).over(same), "run_end": F.max(position).over(same), "run_length": F.count(F.lit(1)).over(same),
    }).drop("_run")


def run_position(start: Column, end: Column, number: Column, width: int = 4, margin: int = 2) -> Column:
    """1 if a window of ``width`` lies within ``margin`` of its run's end, else 2."""
    return F.when((number - start <= margin) | (end - (number + width - 1) <= margin), 1).otherwise(2)


def first_hit(df: DataFrame, part: list[str], order: list[Column | str], condition: Column) -> DataFrame:
    """The first row of each partition that fulfils the condition."""
    rank = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    return df.where(condition).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def sequence_summary(df: DataFrame, part: list[str], position: str, cols: dict[str, str], sep: str = "", size: int | None = None) -> DataFrame:
    """Ordered concatenation of columns, first and last position, their span and the number of rows.

    With ``size`` each block is joined first, so a chain's rows meet as a text a block.
    """
    def joined(rows: DataFrame, by: list[str], at: str, names: dict[str, str], **more: Column) -> DataFrame:
        one = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, F.col(c).alias("v")))), lambda s: s["v"]), sep)
        text = one if at != "_rank" else lambda c: F.when(F.count(c) > 0, one(c))  # a block of nulls adds no separator
        return rows.groupBy(*by).agg(*[text(c).alias(name) for c, name in names.items()], *[v.alias(k) for k, v in more.items()])

    if size is None:
        out = joined(df, part, position, cols, first_position=F.min(position), last_position=F.max(position), n_rows=F.count(F.lit(1)))
    else:
        rows = ranges.blocks(df, [*part, position], size=size)
        texts = joined(rows, ["_block", *part], "_rank", cols, _first=F.min(position), _last=F.max(position), _rows=F.count(F.lit(1)))
        same = {name: name for name in cols.values()}
        out = joined(texts, part, "_block", same, first_position=F.min("_first"), last_position=F.max("_last"), n_rows=F.sum("_rows"))
    first, last = F.col("first_position"), F.col("last_position")
    return out.select(
        *part, *cols.values(), first, last, (last - first + 1).alias("span"), "n_rows",
        F.concat_ws("-", first.cast("string"), last.cast("string")).alias("range_label"),
    )
