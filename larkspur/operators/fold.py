"""Ordered folds: a state machine for each key that sees its rows in order, a step at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Machine = Callable[[list[dict]], list[dict]]


def ordered_fold(rows: DataFrame, key: list[str], step: list[str], order: list[str], machine: Callable[[], Machine], schema: str) -> DataFrame:
    """Rows are dealt by key and sorted by key, step and order; each key gets a new machine, which is called with the rows of
    each step and returns output rows. Rows stream through, so a task holds one machine and one step, however long a key's
    sequence is. Null keys make a key of their own.
    """
    out = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = part = None
        held: list[dict] = []
        made: list[dict] = []
        m: Machine | None = None
        for b in batches:
            for row in b.to_pylist():
                k, s = tuple(row[c] for c in key), tuple(row[c] for c in step)
                if (k, s) != (at, part):
                    if held:
                        made += m(held)
                        held = []
                    if k != at:
                        m = machine()
                    at, part = k, s
                held.append(row)
            if len(made) > 10_000:
                yield _batch(made)
                made = []
        if held:
            made += m(held)
        yield _batch(made)

    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
    arrow = pa.schema([(f.split()[0], types[f.split(" ", 1)[1]]) for f in schema.split(", ")])

    def _batch(made: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{c: r.get(c) for c in out} for r in made], schema=arrow)

    return rows.repartition(*key).sortWithinPartitions(*key, *step, *order).mapInArrow(run, schema)
