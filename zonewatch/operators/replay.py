"""Run a recursive per-key state machine over an ordered table.

The step keeps O(state) memory: rows arrive sorted in Arrow batches and the state is
carried from batch to batch, so no key is ever collected. When one key is too large for
one task, its rows are cut into range slices that run in parallel from assumed start
states; then, of each key, the first slice that started from a wrong state is run again.
A machine that forgets is settled after that. Where start states are still wrong after
`ROUNDS` such rounds, the machine does not forget, and what is left of its key runs once
more in order, slice after slice in one task. So rows are read a fixed number of times,
however many slices there are, and the result is that of the sequential run.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from zonewatch.operators.ordered import SLICE, slices
from zonewatch.session import has_hot_group, materialize, release

# (state or None, columns of one key's rows in order) -> (state, output columns, same length)
Rows = dict[str, np.ndarray]
Step = Callable[[Any, Rows], tuple[Any, dict[str, Any]]]
STATE = "_state"
ROUNDS = 2


def _key_runs(pdf: pd.DataFrame, keys: list[str]):
    """(key, start, end) of each run of equal keys in a sorted batch."""
    k = pdf[keys]
    prev = k.shift()
    change = ((k != prev) & ~(k.isna() & prev.isna())).any(axis=1).to_numpy().copy()
    change[0] = True
    edges = [*change.nonzero()[0], len(pdf)]
    for a, b in zip(edges[:-1], edges[1:]):
        yield tuple(None if pd.isna(v) else v for v in k.iloc[a]), a, b


def _exact(batch: pa.RecordBatch, columns: list[str]) -> pd.DataFrame:
    """Columns in which whole numbers stay whole where some are null (a step sees them as doubles)."""
    return batch.select(columns).to_pandas(integer_object_nulls=True)


def _columns(pdf: pd.DataFrame) -> Rows:
    return {c: pdf[c].to_numpy() for c in pdf.columns}


def _emit(batch: pa.RecordBatch, keep: list[str], results: list[dict], extra: pa.Schema) -> pa.RecordBatch:
    """The kept columns as they came, and the step's columns."""
    added = [pa.array([v for r in results for v in r[f.name]], f.type, from_pandas=True) for f in extra]
    return pa.record_batch([*[batch.column(c) for c in keep], *added], names=[*keep, *extra.names])


def replay(df: DataFrame, by: list[str], order: list[str], step: Step,
           out: T.StructType | str, keep: list[str] | None = None) -> DataFrame:
    """Add the step's output columns to `keep` (default: all input columns)."""
    by, order = list(by), list(order)
    keep = list(keep or df.columns)
    extra = T._parse_datatype_string(out) if isinstance(out, str) else out
    schema = T.StructType([df.schema[c] for c in keep] + list(extra.fields))
    if has_hot_group(df, by):
        return _replay_sliced(df, by, order, step, keep, extra, schema)

    added = to_arrow_schema(extra)

    def run(batches):
        key, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols, results = _columns(batch.to_pandas()), []
            for k, a, b in _key_runs(_exact(batch, by), by):
                if k != key:
                    key, state = k, None
                state, res = step(state, {c: v[a:b] for c, v in cols.items()})
                results.append(res)
            yield _emit(batch, keep, results, added)

    return (df.repartition(*by).sortWithinPartitions(*by, *order)
            .mapInArrow(run, schema=schema))


def _replay_sliced(df, by, order, step, keep, extra, schema) -> DataFrame:
    parts = slices(df, by, order)
    spans = materialize(parts.groupBy(*by, SLICE).agg(F.count(F.lit(1)).alias("_n")))
    w = Window.partitionBy(*by).orderBy(SLICE)
    several = F.count(F.lit(1)).over(Window.partitionBy(*by)) > 1
    chain = materialize(spans.withColumn("_several", several).filter("_several")
                        .withColumn("_prev", F.lag(SLICE).over(w)).drop("_several", "_n"))
    keys = by + [SLICE]
    no_state = F.lit(None).cast("binary")

    def rows_with(starts: DataFrame | None, rows: DataFrame) -> DataFrame:
        data = rows.withColumn(STATE, no_state).withColumn("_kind", F.lit(1))
        if starts is not None:
            heads = starts.select(*keys, STATE).withColumn("_kind", F.lit(0))
            data = data.unionByName(heads, allowMissingColumns=True)
        return data.repartition(*keys).sortWithinPartitions(*keys, "_kind", *order)

    added = to_arrow_schema(extra)

    def drive(emit_rows: bool, goes_on: bool = False):
        """The step over slices: its rows, or the state at the end of each slice. `goes_on`: a slice without a
        start state of its own takes over that of the slice before."""
        def run(batches):
            key, state = None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                cols, results = _columns(batch.to_pandas()), []
                for k, a, b in _key_runs(_exact(batch, keys), keys):
                    if k != key:
                        if key is not None and not emit_rows:
                            yield _end(key, state)
                        state = state if goes_on and key is not None and k[:-1] == key[:-1] else None
                        key = k
                    if cols["_kind"][a] == 0:  # the start state leads its slice
                        if cols[STATE][a] is not None:
                            state = pickle.loads(cols[STATE][a])
                        a += 1
                    if a < b:
                        state, res = step(state, {c: v[a:b] for c, v in cols.items()})
                        results.append(res)
                if emit_rows and results:
                    yield _emit(batch.filter(pa.compute.equal(batch.column("_kind"), 1)), keep, results, added)
            if key is not None and not emit_rows:
                yield _end(key, state)
        return run

    end_schema = T.StructType([parts.schema[c] for c in keys] + [T.StructField(STATE, T.BinaryType())])
    end_arrow = to_arrow_schema(end_schema)

    def _end(key, state):
        return pa.record_batch([pa.array([v], f.type) for v, f in zip([*key, pickle.dumps(state, protocol=4)], end_arrow)], schema=end_arrow)

    def ends_of(starts, rows) -> DataFrame:
        return materialize(rows_with(starts, rows).mapInArrow(drive(False), end_schema))

    starts = None
    if chain.limit(1).count():
        # all slices at once from empty states; then, of each key, the first slice whose start was
        # wrong. Everything before it is settled.
        ends = ends_of(None, parts.join(chain.select(*keys), keys, "left_semi"))
        starts = materialize(chain.select(*keys).withColumn(STATE, no_state))
        first = Window.partitionBy(*by).orderBy(SLICE)
        rounds = 0
        while True:
            before = ends.select(*by, F.col(SLICE).alias("_prev"), F.col(STATE).alias("_in"))
            moved = materialize(chain.join(before, by + ["_prev"]).join(starts, keys)
                                .filter(~F.col("_in").eqNullSafe(F.col(STATE)))
                                .withColumn("_rn", F.row_number().over(first)).filter("_rn = 1")
                                .select(*keys, F.col("_in").alias(STATE)))
            if not moved.limit(1).count():
                release(moved)
                break
            rounds += 1
            if rounds > ROUNDS:
                left = moved.select(*by, F.col(SLICE).alias("_from"))
                heads = moved.withColumn("_kind", F.lit(0))
                data = (parts.join(left, by).filter(F.col(SLICE) >= F.col("_from")).drop("_from")
                        .withColumn(STATE, no_state).withColumn("_kind", F.lit(1)).unionByName(heads, allowMissingColumns=True))
                data = data.repartition(*by).sortWithinPartitions(*by, SLICE, "_kind", *order)
                again = materialize(data.mapInArrow(drive(False, goes_on=True), end_schema))
                settled = ends.join(again.select(*keys), keys, "left_anti").unionByName(again)
                before = settled.select(*by, F.col(SLICE).alias("_prev"), F.col(STATE))
                new_starts = materialize(chain.join(before, by + ["_prev"]).select(*keys, STATE))
                release(starts, moved, again)
                starts = new_starts
                break
            again = ends_of(moved, parts.join(moved.select(*keys), keys, "left_semi"))
            new_ends = materialize(ends.join(again.select(*keys), keys, "left_anti").unionByName(again))
            new_starts = materialize(starts.join(moved.select(*keys), keys, "left_anti").unionByName(moved))
            release(ends, starts, moved, again)
            ends, starts = new_ends, new_starts
        release(ends)
    return rows_with(starts, parts).mapInArrow(drive(True), schema=schema)
