"""Scans in order through groups of rows, where one group may be most of a table.

A window over a group sorts it in one task. Here rows are ranged by group and
order and written, so that a group that is large lies in several ranges. A
range is scanned by itself; what it says about a group is one row, a summary,
and summaries are merged in the order of their ranges. Only groups that lie in
several ranges need one, which are no more than two a range, whatever the
table's size: these are broadcast.

Three kinds of summaries: a count or sum (merged by addition), a last value
that is not null (the later one, if there is one) and the events of a stack.

An event of a stack leaves its first `cut` elements, or all if there are fewer,
and puts a value on top. A range's events are summarised by those that are
still on the stack after it, had it been empty before. That is enough: the more
elements there were before, the higher each event lies, so an event that a
later one removes from the stack that was empty, it removes from any; and
without it, the later one still cuts to the same place. Summaries are merged by
playing one after the other, and hold no more events than the deepest cut and one.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from ..sources.tables import written

EVENTS = "array<struct<cut: int, value: string>>"
ARROW_EVENTS = pa.list_(pa.struct([("cut", pa.int32()), ("value", pa.string())]))


def play(stack: list, events: list | None) -> None:
    """Plays events, (cut, value) each, on a stack of events."""
    for event in events or ():
        del stack[max(event["cut"], 0) :]
        stack.append(event)


class Ranged(NamedTuple):
    """rows: a table with _range; shared: _range and group of each group in several ranges."""

    rows: DataFrame
    by: list[str]
    order: list[str]
    shared: DataFrame

    def window(self, end: int):
        return W.partitionBy("_range", *self.by).orderBy(*self.order).rowsBetween(W.unboundedPreceding, end)

    def of_shared(self, columns: list[Column | str]) -> DataFrame:
        """The rows of groups in several ranges: _range, the group, and these columns."""
        named = self.shared.select(*[F.col(c).alias(f"_s{c}") for c in self.shared.columns])
        same = [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in self.shared.columns]
        return self.rows.join(F.broadcast(named), same, "left_semi").select("_range", *self.by, *columns)

    def with_start(self, start: DataFrame) -> DataFrame:
        """rows with what `start` (_range, group, columns) says of a group before a range; null where it says nothing."""
        named = start.withColumnsRenamed({c: f"_s{c}" for c in ("_range", *self.by)})
        same = [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in ("_range", *self.by)]
        return self.rows.join(F.broadcast(named), same, "left").drop(*[f"_s{c}" for c in ("_range", *self.by)])

    def earlier(self):
        """The ranges of a group before one: a row each."""
        return W.partitionBy(*self.by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)

    def last(self, values: dict[str, Column], own: bool = False) -> "Ranged":
        """Adds for each name the last value that is not null on a group's earlier rows, or (`own`) up to the row itself."""
        here = self.of_shared([F.struct(*self.order).alias("_at"), *[v.alias(f"_v_{n}") for n, v in values.items()]])
        ends = here.groupBy("_range", *self.by).agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("_at"))).alias(f"_v_{n}") for n in values])
        start = ends.select("_range", *self.by, *[F.last(f"_v_{n}", True).over(self.earlier()).alias(f"_b_{n}") for n in values])
        window = self.window(0 if own else -1)
        found = {n: F.coalesce(F.last(v, True).over(window), F.col(f"_b_{n}")) for n, v in values.items()}
        return self._replace(rows=self.with_start(start).withColumns(found).drop(*[f"_b_{n}" for n in values]))

    def sums(self, values: dict[str, Column], own: bool = True) -> "Ranged":
        """Adds for each name the sum of a column over a group's rows up to the row itself, or only the earlier ones. Null counts as 0."""
        full = {n: F.coalesce(v.cast("long"), F.lit(0).cast("long")) for n, v in values.items()}
        here = self.of_shared([v.alias(f"_v_{n}") for n, v in full.items()])
        ends = here.groupBy("_range", *self.by).agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in values])
        start = ends.select("_range", *self.by, *[F.sum(f"_v_{n}").over(self.earlier()).alias(f"_b_{n}") for n in values])
        window = self.window(0 if own else -1)
        found = {n: F.coalesce(F.sum(v).over(window), F.lit(0)) + F.coalesce(F.col(f"_b_{n}"), F.lit(0)) for n, v in full.items()}
        return self._replace(rows=self.with_start(start).withColumns(found).drop(*[f"_b_{n}" for n in values]))

    def stacks(self, name: str, events: Column) -> "Ranged":
        """Adds the stack after each row: an array of values, the topmost last.

        events: a row's, in order, as EVENTS; null for none. An event without a
        cut, or with one below 0, empties the stack; its value may be null.
        """
        told = F.transform(events, lambda e: F.struct(F.coalesce(e["cut"], F.lit(0)).cast("int").alias("cut"), e["value"].alias("value")))
        here = self.of_shared([*self.order, told.alias("_events")]).withColumn("_start", F.lit(None).cast(EVENTS))
        ends = played(self._replace(rows=here), "_stack", only_ends=True).select("_range", *self.by, "_stack")
        # A row for each range of a group, in one task for the group.
        merged = ends.groupBy(*self.by).agg(F.array_sort(F.collect_list(F.struct("_range", "_stack"))).alias("_ends"))
        starts = merged.mapInArrow(merge_ends(self.by), StructType([*[self.rows.schema[c] for c in self.by], *ends.select(F.col("_range"), F.col("_stack").alias("_start")).schema]))
        rows = self.with_start(starts).withColumn("_events", told)
        out = played(self._replace(rows=rows), "_stack").withColumn(name, F.transform("_stack", lambda e: e["value"]))
        return self._replace(rows=out.drop("_stack", "_start", "_events"))


def ranged(rows: DataFrame, by: list[str], order: list[str], ranges: int | None = None) -> Ranged:
    """rows, written in ranges of group and order. A row's group and order should tell it from all others: else equal rows come in any order.

    Nulls come first in the order; rows whose group is null are a group. ranges: how many; the session's shuffle partitions, where none is given.
    """
    parts = [ranges] if ranges else []
    cut = written(rows.repartitionByRange(*parts, *by, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    group = F.struct(*by)
    ends = cut.groupBy("_range").agg(F.min(group).alias("_a"), F.max(group).alias("_b"))
    ends = ends.select("_range", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_g")).select("_range", "_g.*")
    several = ends.withColumn("_n", F.count("_range").over(W.partitionBy(*by))).where("_n > 1").drop("_n")
    return Ranged(cut, by, order, written(several, "shared"))


def played(r: Ranged, name: str, only_ends: bool = False) -> DataFrame:
    """Adds the stack of events after each row of a range, from _start and _events; or keeps only the last row of each group."""
    window = W.partitionBy("_range", *r.by).orderBy(*r.order)
    rows = r.rows.withColumn("_first", F.row_number().over(window) == 1).withColumn("_last", F.lead(F.lit(1)).over(window).isNull())
    rows = rows.sortWithinPartitions("_range", *r.by, *r.order)  # as the window left them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list = []
        for batch in batches:
            first, start, events = (batch.column(c).to_pylist() for c in ("_first", "_start", "_events"))
            after = []
            for new, before, more in zip(first, start, events):
                if new:
                    stack = list(before or ())
                play(stack, more)
                after.append(list(stack))
            made = pa.RecordBatch.from_arrays([*batch.columns, pa.array(after, ARROW_EVENTS)], [*batch.schema.names, name])
            yield made.filter(made.column("_last")) if only_ends else made

    schema = rows.withColumn(name, F.lit(None).cast(EVENTS)).schema
    return rows.mapInArrow(run, schema).drop("_first", "_last")


def merge_ends(by: list[str]):
    """Summaries of a group's ranges, in order, to the stack before each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ranges, starts = [], [], []
            for i, ends in enumerate(batch.column("_ends").to_pylist()):
                stack: list = []
                for end in ends:
                    at.append(i)
                    ranges.append(end["_range"])
                    starts.append(list(stack))
                    play(stack, end["_stack"])
            groups = [batch.column(c).take(pa.array(at, pa.int64())) for c in by]
            yield pa.RecordBatch.from_arrays([*groups, pa.array(ranges, pa.int32()), pa.array(starts, ARROW_EVENTS)], [*by, "_range", "_start"])

    return run
