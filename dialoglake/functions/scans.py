"""What stands before or after a row of a recording, without a task that holds the recording.

A recording is cut into parts along its order. Every part is summed up in one row, a window over those rows tells what each
part is handed by the parts before it, and a window inside the part does the rest. Rows are shuffled once, by recording and part,
but read twice: what a scan reads from other scans should be kept first (``sources.storage.kept``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a recording that one part holds, and seconds, where rows are ordered by time.
PLACES, STRETCH = 10_000, 600.0

HOW = {"last": lambda c: F.last(c, ignorenulls=True), "next": lambda c: F.last(c, ignorenulls=True), "sum": F.sum, "max": F.max, "min": F.min}
BOTH = {"last": F.coalesce, "next": F.coalesce, "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}


def by_place(place: str) -> Column:
    """The part of a row with a running number."""
    return F.floor(F.col(place) / PLACES)


def by_time(seconds: str) -> Column:
    """The part of a row with a time."""
    return F.floor(F.col(seconds) / STRETCH)


def scan(rows: DataFrame, part: Column, order: list[Column], found: dict[str, tuple[str, Column]], keys: tuple[str, ...] = ("media_id",), back: bool = False) -> DataFrame:
    """``rows`` with a column for each of ``found`` (name: how, value): the last, sum, max or min of the value over the rows before, along ``order`` inside ``keys``.

    ``order`` ascends, nulls first, and ``part`` never falls along it; ``back`` takes the rows after instead, and "next" the first value after in any case.
    Null values are passed over; where nothing stands before, a sum is 0 and the others are null. Null keys are a key of their own.
    """
    held = rows.withColumn("_part", F.struct(*keys, part.alias("_of_part"))).select("*", *[v.alias(f"_value_{name}") for name, (_, v) in found.items()])
    at = F.struct(*order)

    def whole(how: str, value: Column) -> Column:
        if how in ("last", "next"):
            return (F.min_by if back or how == "next" else F.max_by)(value, F.when(value.isNotNull(), at))
        return HOW[how](value)

    def before(how: str, by: list[Column], within: list[Column]) -> Window:
        turned = back or how == "next"
        return Window.partitionBy(*within).orderBy(*[c.desc() if turned else c for c in by]).rowsBetween(Window.unboundedPreceding, -1)

    sums = held.groupBy("_part").agg(*[whole(how, F.col(f"_value_{name}")).alias(name) for name, (how, _) in found.items()])
    same = [F.col("_part")[k] for k in keys]
    handed = sums.select("_part", *[HOW[how](F.col(name)).over(before(how, [F.col("_part._of_part")], same)).alias(f"_handed_{name}") for name, (how, _) in found.items()])
    own = held.select("*", *[HOW[how](F.col(f"_value_{name}")).over(before(how, order, [F.col("_part")])).alias(f"_own_{name}") for name, (how, _) in found.items()])
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in found]
    return own.join(handed, "_part", "left").select(*kept, *[BOTH[how](F.col(f"_own_{name}"), F.col(f"_handed_{name}")).alias(name) for name, (how, _) in found.items()])


def number(rows: DataFrame, part: Column, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: numbers from 1 along ``order`` in each recording."""
    return scan(rows, part, order, {name: ("sum", F.lit(1))}).withColumn(name, (F.col(name) + 1).cast("int"))
