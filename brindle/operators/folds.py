"""Sequential folds of a key's rows in order: state goes from row to row, so a key of any length needs constant memory."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def running(df: DataFrame, key: str, order: tuple[str, ...], inputs: tuple[str, ...], fields: str, start: Callable[[], object], step: Callable) -> DataFrame:
    """df with `fields` (DDL): step(state, *inputs) gives the next state and the values of a row, in `order` of its key."""
    added = StructType.fromDDL(fields)
    kinds, names = to_arrow_schema(added), df.columns
    at = [names.index(c) for c in (key, *inputs)]

    def run(batches):
        now, state = None, None
        for batch in batches:
            out = []
            for name, *values in zip(*[batch.column(i).to_pylist() for i in at]):
                if state is None or name != now:
                    now, state = name, start()
                state, got = step(state, *values)
                out.append(got)
            if out:
                new = [pa.array(c, kinds.field(i).type) for i, c in enumerate(zip(*out))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, *kinds.names])

    rows = df.repartition(F.col(key)).sortWithinPartitions(key, *order)
    return rows.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


def totals(df: DataFrame, key: str, order: tuple[str, ...], inputs: tuple[str, ...], fields: str, start: Callable[[], object], step: Callable, finish: Callable) -> DataFrame:
    """One row a key: the key, and what finish(state) gives after step(state, *inputs) of all its rows in order."""
    added = StructType.fromDDL(fields)
    kinds, kind = to_arrow_schema(added), df.schema[key]

    def row(name, state):
        key_type = to_arrow_schema(StructType([kind])).field(0).type
        return pa.RecordBatch.from_arrays([pa.array([name], key_type), *[pa.array([v], kinds.field(i).type) for i, v in enumerate(finish(state))]], names=[key, *kinds.names])

    def run(batches):
        now, state = None, None
        for batch in batches:
            for name, *values in zip(*[c.to_pylist() for c in batch.columns[: 1 + len(inputs)]]):
                if state is not None and name != now:
                    yield row(now, state)
                    state = None
                if state is None:
                    now, state = name, start()
                state = step(state, *values)
        if state is not None:
            yield row(now, state)

    rows = df.select(key, *inputs, *[F.col(c).alias(f"_order{i}") for i, c in enumerate(order)]).repartition(F.col(key))
    return rows.sortWithinPartitions(key, *[f"_order{i}" for i in range(len(order))]).mapInArrow(run, StructType([kind, *added.fields]))
