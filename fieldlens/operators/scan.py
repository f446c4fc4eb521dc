"""Folds over ordered rows of a key, of any length, dealt out by ranges of the order."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.sources.shared import cut


class Fold(NamedTuple):
    """step(state, row) -> (state, output or None) over rows in order, from start.

    What a stretch of rows does to a state is summed up as a value: add(summary, row) from nothing on, and apply(summary,
    state) -> state. Steps have to be associative in that sense: applying the summary of rows is going through them.
    """

    start: Any
    step: Callable[[Any, tuple], tuple[Any, tuple | None]]
    nothing: Any
    add: Callable[[Any, tuple], Any]
    apply: Callable[[Any, Any], Any]


def range_scan(df: DataFrame, key: str, order: str, values: list[str], fold: Fold, schema: str) -> DataFrame:
    """Rows of the schema (key, order, what step outputs) from a fold over each key's rows in order.

    Rows are dealt out by ranges of key and order, and written. Each task first sums up its last key's rows, for only those
    go on in the next range; these summaries, one for each task, give the state that each range begins with, and then each
    task goes through its own rows. So neither a key nor its output is ever one row or one task.
    """
    rows = df.select(key, order, *values)
    written = cut(rows.repartitionByRange(key, order).withColumn("__part", F.spark_partition_id()), "scan").repartition("__part").sortWithinPartitions("__part", key, order)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Any, tuple]]:
        for f in batches:
            yield from zip(f["__part"].tolist(), f[key].tolist(), zip(*(f[c] for c in (order, *values)), strict=True), strict=True)

    def sums(batches):
        at, first, last, n, total = None, None, None, 0, fold.nothing
        found = []
        for part, k, row in parts(batches):
            if part != at:
                if at is not None:
                    found.append((at, first, last, n, pickle.dumps(total)))
                at, first, last, n, total = part, k, k, 0, fold.nothing
            if k != last:
                last, n, total = k, n + 1, fold.nothing
            total = fold.add(total, row)
        if at is not None:
            found.append((at, first, last, n, pickle.dumps(total)))
        yield pd.DataFrame(found, columns=["part", "first", "last", "changes", "total"])

    kind = df.schema[key].dataType.simpleString()
    ranges = written.mapInPandas(sums, f"part int, first {kind}, last {kind}, changes long, total binary").collect()  # a row for each task
    begins, state, before = {}, fold.start, None
    for r in sorted(ranges, key=lambda r: r.part):
        begins[r.part] = state if before is not None and before == r.first else fold.start
        state, before = fold.apply(pickle.loads(r.total), begins[r.part] if not r.changes else fold.start), r.last

    def run(batches):
        at, now, state = None, None, None
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        for f in batches:
            out = []
            for part, k, row in parts([f]):
                if part != at:
                    at, now, state = part, k, begins[part]
                elif k != now:
                    now, state = k, fold.start
                state, got = fold.step(state, row)
                if got is not None:
                    out.append((k, row[0], *got))
            yield pd.DataFrame(out, columns=names)

    return written.mapInPandas(run, schema)
