"""Records that come nearly in order of position, put in order as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: What a row of the result is: in its place, or after its contig had passed it.
LATE = "late boolean"


class BelowBound(StatefulProcessor):
    """Holds a contig's records from its bound on, and gives out, in order, those below.

    The bound is the farthest position less ``slack``. A record that comes when the bound has
    passed it is given out at once, as late. A record without position ends its contig: all
    that is held goes out, and the contig's state with it.
    """

    def __init__(self, schema: str, pos: str, order: list[str], slack: int) -> None:
        self.schema, self.pos, self.order, self.slack = schema, pos, order, slack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", self.schema)
        self.bound = handle.getValueState("bound", "bound long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        new = pd.concat(list(rows), ignore_index=True)
        bound = self.bound.get()[0] if self.bound.exists() else None
        done = new[self.pos].isna().any()
        new = new[new[self.pos].notna()]
        late = new[self.pos] < bound if bound is not None else pd.Series(False, index=new.index)
        if late.any():
            yield new[late].assign(late=True)
        fresh = new[~late]
        if len(fresh):
            far = int(fresh[self.pos].max()) - self.slack
            bound = far if bound is None else max(bound, far)
        before = pd.DataFrame(list(self.held.get()), columns=list(new.columns)) if self.held.exists() else new.iloc[:0]
        every = pd.concat([x for x in (before, fresh) if len(x)], ignore_index=True) if len(before) or len(fresh) else fresh
        every[self.pos] = every[self.pos].astype("int64")
        out = every if done else every[every[self.pos] < (bound if bound is not None else 0)]
        if len(out):
            yield out.sort_values([self.pos, *self.order], kind="stable").assign(late=False)
        if done:
            self.held.clear()
            self.bound.clear()
            return
        rest = every.drop(out.index)
        self.held.clear()
        if len(rest):
            self.held.appendList([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in rest.itertuples(index=False)])
        if bound is not None:
            self.bound.update((bound,))

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, slack: int, order: list[str], chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """``stream`` with ``late``: the records of each contig in order of ``pos`` and ``order``, batch after batch.

    A record must come before another of its contig that is more than ``slack`` bases ahead;
    else it is late. A contig's state holds its records of the last ``slack`` bases alone. A
    record whose ``pos`` is null ends its contig and isn't given out. Needs the RocksDB state
    store and output mode append.
    """
    schema = StructType(list(stream.schema.fields))
    text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return stream.groupBy(chrom).transformWithStateInPandas(statefulProcessor=BelowBound(text, pos, order, slack), outputStructType=f"{text}, {LATE}", outputMode="Append", timeMode="None")


def end_marks(stream: DataFrame, contigs: DataFrame, chrom: str = "chrom") -> DataFrame:
    """A record without anything but its name for each contig, to end it with."""
    return contigs.select(*[F.col(chrom) if f.name == chrom else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields])
