"""Search over a stream of queries.

A query is complete in its micro-batch, so each batch is searched like a table
and nothing is kept between batches, unless results of one query may come in
parts, which :func:`running_top` merges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def search_stream(queries: DataFrame, search: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, drain: bool = True, every: str = "1 second") -> StreamingQuery:
    """Runs ``search`` on each micro-batch of a streaming DataFrame and hands the result to ``sink``.

    ``drain`` works off what has arrived and stops; otherwise a batch starts
    ``every`` so often.  The source's own limits (maxFilesPerTrigger) bound a
    batch.  A batch that is run again after a failure has the same number, so
    a sink that writes by it is exactly-once.
    """

    def step(batch: DataFrame, number: int) -> None:
        sink(search(batch), number)

    out = queries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if drain else out.trigger(processingTime=every)).start()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to its own folder, replaced when the batch is run again."""
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def running_top(results: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, dist) of a stream of partial results (query_id, vec_id, dist): the k best so far, sent anew whenever they change."""

    def merge(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = list(zip(*state.get, strict=True)) if state.exists else []
        best = {int(v): float(d) for d, v in old}
        for df in batches:
            for v, d in zip(df["vec_id"], df["dist"], strict=True):
                best[int(v)] = min(float(d), best.get(int(v), float("inf")))
        new = sorted((d, v) for v, d in best.items())[:k]
        state.update(([d for d, _ in new], [v for _, v in new]))
        if new != old:
            yield pd.DataFrame({"query_id": key[0], "rank": range(1, len(new) + 1), "vec_id": [v for _, v in new], "dist": [d for d, _ in new]})

    return results.groupBy("query_id").applyInPandasWithState(merge, "query_id long, rank int, vec_id long, dist double", "dists array<double>, ids array<long>", "update", GroupStateTimeout.NoTimeout)
