"""Python judgement of some rows, in place: no row moves to another task."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def judged(df: DataFrame, text: Column, asked: Column, judge: Callable[[str], tuple], fields: str, start: Callable[[], object] | None = None) -> DataFrame:
    """df with `fields` (DDL) that judge(text) gives where `asked` is true, and nulls elsewhere.

    Texts that a batch repeats are judged once.  start, if given, makes once a task what judge
    gets as its second argument.
    """
    added = StructType.fromDDL(fields)
    kinds = to_arrow_schema(added)
    names = df.columns

    def run(batches):
        more = (start(),) if start else ()
        for batch in batches:
            known: dict[str, tuple] = {}
            rows = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                if t is None:
                    rows.append(None)
                else:
                    if t not in known:
                        known[t] = judge(t, *more)
                    rows.append(known[t])
            new = [pa.array([None if r is None else r[i] for r in rows], kinds.field(i).type) for i in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*names, *kinds.names])

    sent = df.select(*[F.col(f"`{c}`") for c in names], F.when(asked, text).alias("_judged_text"))
    return sent.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))
