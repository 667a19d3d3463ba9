"""Ordered folds: per key, rows in order, through a state that is never larger than the operator needs.

A key's rows stream through one task in Arrow batches; they are not collected. What limits a hot key is its own
order, not memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

from folio.runtime import ship, shuffle_parts


class State(Protocol):
    def row(self, r: Any) -> list[tuple]: ...

    def finish(self) -> list[tuple]: ...


def _folder(key: list[str], make: Callable[[], State], names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            out: list[tuple] = []
            ks = list(zip(*(pdf[k] for k in key)))
            for k, r in zip(ks, pdf.itertuples(index=False)):
                if state is None or k != now:
                    if state is not None:
                        out += [(*now, *x) for x in state.finish()]
                    now, state = k, make()
                out += [(*k, *x) for x in state.row(r)]
            if out:
                yield pd.DataFrame(out, columns=names)
        if state is not None:
            out = [(*now, *x) for x in state.finish()]
            if out:
                yield pd.DataFrame(out, columns=names)

    return run


def ordered_fold(df: DataFrame, key: list[str], order: list[str], make: Callable[[], State], schema: str) -> DataFrame:
    """Rows that ``make()``'s state yields for each key, after the key columns. schema: of the yielded columns."""
    ship(df.sparkSession)
    own = StructType([df.schema[k] for k in key])
    whole = StructType([*own.fields, *_parse_datatype_string(schema).fields])
    placed = df.repartition(shuffle_parts(df.sparkSession), *key).sortWithinPartitions(*key, *order)
    return placed.mapInPandas(_folder(key, make, whole.names), whole)
