"""Batches of one resolution over an unbounded stream.

State is keyed by bucket and holds the rows of its unfinished batch, fewer than batch_size. A batch is
given out when its last row arrives; order holds within a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_batches(stream: DataFrame, bucket: str, order: str, names: list[str], batch_size: int) -> DataFrame:
    """Rows of whole batches: bucket, batch (number in its bucket), pos, order and names."""
    kinds = dict(stream.dtypes)
    columns = [order, *names]
    held = ", ".join(f"{c} array<{kinds[c]}>" for c in columns)
    out = f"{bucket} {kinds[bucket]}, batch long, pos long, " + ", ".join(f"{c} {kinds[c]}" for c in columns)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        given, *lists = state.get if state.exists else (0, *[[] for _ in columns])
        waiting = pd.DataFrame(dict(zip(columns, map(list, lists), strict=True)), columns=columns)
        arrived = pd.concat([f[columns] for f in frames]).sort_values(order, kind="stable")
        rows = pd.concat([waiting, arrived], ignore_index=True) if len(waiting) else arrived.reset_index(drop=True)
        whole = len(rows) // batch_size * batch_size
        left = rows.iloc[whole:]
        state.update((given + whole // batch_size, *[left[c].tolist() for c in columns]))
        ready = rows.iloc[:whole]
        place = pd.Series(range(whole))
        yield pd.concat([pd.DataFrame({bucket: [key[0]] * whole, "batch": given + place // batch_size, "pos": place % batch_size}), ready.reset_index(drop=True)], axis=1)

    return stream.select(bucket, *columns).groupBy(bucket).applyInPandasWithState(step, out, f"given long, {held}", "append", GroupStateTimeout.NoTimeout)
