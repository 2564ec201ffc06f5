"""An extension: find runs of a state in a stream of ordered events, chain by chain."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streaming_runs(events: DataFrame, key: str, order: str, value: str, state: str, width: int = 4) -> DataFrame:
    """Emit (key, start) whenever ``width`` consecutive events of a key have the state.

    Events of a key must arrive in order from batch to batch; the state kept for a
    key is the last ``width`` - 1 positions of its open run.
    """
    kind = events.schema[key].dataType.simpleString()

    def step(name: tuple, batches: Iterator[pd.DataFrame], memory: GroupState) -> Iterator[pd.DataFrame]:
        tail = list(memory.get[0]) if memory.exists else []
        starts: list[int] = []
        rows = pd.concat(list(batches)).sort_values(order)
        for at, what in zip(rows[order], rows[value]):
            tail = [*tail, int(at)][-width:] if what == state else []
            if len(tail) == width:
                starts.append(tail[0])
        memory.update((tail[-(width - 1):] if width > 1 else [],))
        yield pd.DataFrame({key: [name[0]] * len(starts), "start": starts})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, start long", "tail array<long>", "append", GroupStateTimeout.NoTimeout)
