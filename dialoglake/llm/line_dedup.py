"""Line dedup by winnowing over line hashes.

A text is its sequence of lines with a word. In every window of ``run`` lines the least hash is selected; equal windows
select equal lines, so any run of ``run`` lines that two places share is guaranteed a common fingerprint. Each selected
line is one row, about one in two, with the hashes of the ``run`` - 1 lines before and after it. Only fingerprints that
occur in two places or more go on. There a place is extended both ways over the lines beside it, to every window that
selected it; of places that agree over such a window the first (by id, then line) is joined to the others, and those are
repeats. Consecutive repeats form runs of any length; their lines are deleted. So a line goes exactly if it lies in
``run`` or more consecutive lines that stand, in the same order, at an earlier place, and the first place always stays.
With ``min_words``, shorter windows that hold that many words or more count as well, so that a long passage on one or two
lines goes too.

What repeats grows with the input and has no size bound, so the joins are merge joins at every size: a plan seen on a small
input is the plan of a large one.

Defined results: a null text stays null, an empty one empty; lines without a word are passed over and stay; rows with a
null id come last; rows equal in id and text count as one place and get the same result; without ``min_words`` a
text of fewer than ``run`` lines keeps them all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dialoglake.llm.common import settle, text_key

PLACE = ["without", "id", "k1", "k2", "line"]


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, "u8").view("i8"))


def selected(text: bytes, run: int, min_words: int | None = None) -> list[tuple[int, list[int], list[int], list[tuple[int, int]]]]:
    """The text's fingerprints: hash; hashes and numbers of the lines around; windows that select it (first line in these lists, from 1, and size)."""
    lines = [(n, x) for n, x in enumerate(text.split(b"\n")) if x.strip()]
    if len(lines) < run and min_words is None:
        return []
    hashed = [xxhash.xxh64_intdigest(x, 1) for _, x in lines]
    words = [0, *accumulate(len(x.split()) for _, x in lines)] if min_words is not None else []
    won: dict[int, list[tuple[int, int]]] = {}
    for size in [run] if min_words is None else range(1, run + 1):
        for a in range(len(lines) - size + 1):
            if size < run and words[a + size] - words[a] < min_words:
                continue
            least = max(range(a, a + size), key=lambda i: (-hashed[i], i))  # the last of equals
            low = max(0, least - run + 1)
            won.setdefault(least, []).append((a - low + 1, size))
    return [(hashed[i], hashed[max(0, i - run + 1) : i + run], [n for n, _ in lines[max(0, i - run + 1) : i + run]], spans) for i, spans in won.items()]


def _prints(run: int, min_words: int | None = None):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, text = batch.columns
            for a in range(0, len(text), 256):
                found = [selected(t or b"", run, min_words) for t in text[a : a + 256].cast(pa.large_binary()).to_pylist()]
                take = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                flat = [w for f in found for w in f]

                def nested(values: list[list], kind: pa.Array) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), kind)

                near, at, spans = ([w[i] for w in flat] for i in (1, 2, 3))
                pairs = pa.StructArray.from_arrays([pa.array([x[i] for s in spans for x in s], pa.int32()) for i in (0, 1)], ["first", "size"])
                yield pa.RecordBatch.from_arrays(
                    [k[a : a + 256].take(take) for k in keys]
                    + [_signed([w[0] for w in flat]), nested(near, _signed([h for n in near for h in n])), nested(at, pa.array([n for x in at for n in x], pa.int32())), nested(spans, pairs)],
                    [*batch.schema.names[:-1], "fp", "near", "at", "spans"],
                )

    return read


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the lines of the last column, ``gone``, from the texts in the column before it; a few texts at a time."""

    def cut(text: str | None, gone: list[int] | None) -> str | None:
        if text is None or gone is None:
            return text
        out = set(gone)
        return "\n".join(x for n, x in enumerate(text.split("\n")) if n not in out)

    for batch in batches:
        *rest, text, gone = batch.columns
        for a in range(0, batch.num_rows, 256):
            t, g = text[a : a + 256], gone[a : a + 256]
            if g.null_count < len(g):
                t = pa.array(map(cut, t.to_pylist(), g.to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*[c[a : a + 256] for c in rest], t], batch.schema.names[:-1])


def repeated_lines(docs: DataFrame, run: int = 3, min_words: int | None = None) -> DataFrame:
    """``docs``: id, k1, k2, _text. -> k1, k2, gone: the numbers of the lines to delete, for texts that have any."""
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"without boolean, id {kind}, k1 long, k2 long, fp long, near array<long>, at array<int>, spans array<struct<first:int,size:int>>"
    prints = settle(docs.select(F.col("id").isNull().alias("without"), "id", "k1", "k2", "_text").mapInArrow(_prints(run, min_words), schema))
    # Both tables of keys are counted with partial sums and written, so that Spark can split a hot key's rows in the joins.
    shared = settle(prints.groupBy("fp").count().where("count > 1").select("fp"))
    reach = prints.join(shared.hint("merge"), "fp", "left_semi").withColumn("span", F.explode("spans"))

    def cut(lines: str) -> Column:
        return F.slice(lines, F.col("span.first"), F.col("span.size"))

    whole = [F.xxhash64(F.lit(x), F.col("span.size"), cut("near")).alias(x) for x in ("w1", "w2")]
    reach = reach.select("without", "id", "k1", "k2", "fp", *whole, F.element_at(cut("at"), 1).alias("line"), cut("at").alias("lines"))
    place, key = F.struct(*PLACE), ["fp", "w1", "w2"]
    first = settle(reach.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("end")).where("first <> end").drop("end"))
    later = reach.join(first.hint("merge"), key).where(place > F.col("first"))
    return later.groupBy("k1", "k2").agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("gone"))


def dedup_lines(docs: DataFrame, run: int = 3, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None, min_words: int | None = None) -> DataFrame:
    """``docs`` with repeated runs of lines deleted from ``text_col``; ``removed_col``, if named, gets their number.

    Texts are shuffled once, to meet the lines to delete.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain, text, ident = docs.toDF(*names), names[docs.columns.index(text_col)], names[docs.columns.index(id_col)]
    key = text_key(F.col(ident), F.col(text))
    keyed = plain.select(*names, key.alias("_key")).select(*names, F.col("_key.a").alias("k1"), F.col("_key.b").alias("k2"))
    gone = settle(repeated_lines(keyed.select(F.col(ident).alias("id"), "k1", "k2", F.col(text).alias("_text")), run, min_words))
    met = keyed.join(gone.hint("merge"), ["k1", "k2"], "left")
    rest = [n for n in names if n != text]
    more = [F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("_removed")] if removed_col else []
    ready = met.select(*rest, *more, text, "gone")
    out = ready.mapInArrow(_without, StructType(ready.schema.fields[:-1])).select(*names, *(["_removed"] if removed_col else []))
    return out.toDF(*docs.columns, *([removed_col] if removed_col else []))
