"""URL filters by a sort-merge range join.

A url's canonical key is its host with the labels reversed, each closed by a dot, followed by its path:
``www.example.org`` and ``/en/1`` give ``org.example.www./en/1``. A rule (host, path prefix) becomes the interval of all keys
that start with its own key. To let a rule reach subdomains, a url is probed with those ancestors of its host that have as
many labels as some rule's host; every probe is a pure prefix test on one sorted line, where intervals nest. The line is
cut into ranges at sampled keys, rules are copied to each range that their interval touches, and one sweep over each
sorted range keeps a stack of open rules.

Defined results: a null url or one without ``://`` has an empty host and path; no rule or an empty rule table gives the
default action; repeated rows stay repeated; a rule with a null host or path is ignored; of rules that fit, the longest
(code points of host and path) wins, then the longer host, then ``block``, which also settles contradicting twins; a host
of any number of labels costs time and space in line with its length; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoglake.llm.common import settle, tasks

#: Keys sampled for each range; the sample, and with it what the driver holds, is bounded by this times the ranges.
SAMPLE_PER_RANGE = 64
LAST = "\U0010ffff" * 4


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(labels: Column) -> Column:
    """Labels of a host (in reading order) -> reversed, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("."))


def _probes(urls: DataFrame, depths: list[int]) -> DataFrame:
    """A row for each of a url's ancestors with one of ``depths`` labels, or one with an empty key; ``own`` marks one row for each url."""
    labels = F.split("host", r"\.", -1)
    held = F.filter(F.array(*[F.lit(d) for d in depths]).cast("array<int>"), lambda d: d <= F.size(labels))
    spread = urls.select("*", F.posexplode_outer(held).alias("nth", "depth"))
    key = F.concat(host_key(F.slice(labels, F.size(labels) - F.col("depth") + 1, F.col("depth"))), F.col("path"))
    own = F.coalesce(F.col("nth") == 0, F.lit(True))
    return spread.select("id", "host", "path", own.alias("own"), F.coalesce(key, F.lit("")).alias("key"))


def _cuts(probes: DataFrame, urls: int, ranges: int) -> list[str]:
    """At most ``ranges`` - 1 keys that split the sorted line about evenly.

    The sampled key also carries the row's hash, so that one very frequent key is split as well.
    """
    share = min(1.0, SAMPLE_PER_RANGE * ranges / max(1, urls))
    most = 2 * SAMPLE_PER_RANGE * ranges
    keys = sorted(r[0] for r in probes.select("line").sample(share, 7).limit(most).collect())
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def _range_of(cuts: list[str]):
    @F.pandas_udf("int")
    def number(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts, object), key.to_numpy(object), side="right").astype("int32"))

    return number


#: No rule: the answer below all others.
NONE = (-1, -1, False, None)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one or more ranges, each sorted by key with rules first; a stretch between two starts or ends of rules gets one answer."""
    at, stack = None, []  # key and best answer of each open rule
    for batch in batches:
        held = {c: batch.column(c) for c in batch.schema.names}
        parts, is_url = (np.asarray(held[c].to_numpy(zero_copy_only=False)) for c in ("part", "is_url"))
        lines = np.array([*held["line"].to_pylist(), None], object)[:-1]
        answers, pick = [NONE], np.zeros(len(parts), "i4")
        stops = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(parts)) + 1, np.flatnonzero(~is_url), np.flatnonzero(~is_url) + 1, [len(parts)]])).tolist()
        for a, b in zip(stops, stops[1:], strict=False):
            if parts[a] != at:
                at, stack = parts[a], []
            if not is_url[a]:
                while stack and not lines[a].startswith(stack[-1][0]):
                    stack.pop()
                key, rule, *rank = (held[c][a].as_py() for c in ("key", "rule", "size", "host_size", "block"))
                stack.append((key, max(stack[-1][1] if stack else NONE, (*rank, rule), key=lambda x: x[:3])))
                continue
            while a < b and stack:
                end = a + int(np.searchsorted(lines[a:b], stack[-1][0] + LAST))
                if end > a:
                    pick[a:end] = len(answers)
                    answers.append(stack[-1][1])
                if (a := end) < b:
                    stack.pop()
        asked, best = np.flatnonzero(is_url), [pa.array(x, t) for x, t in zip(zip(*answers, strict=True), (pa.int32(), pa.int32(), pa.bool_(), pa.string()), strict=True)]
        yield pa.RecordBatch.from_arrays([held[c].take(pa.array(asked)) for c in KEPT] + [x.take(pa.array(pick[asked])) for x in best], [*KEPT, "size", "host_size", "block", "rule"])


KEPT = ["id", "host", "path", "own"]


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Verdict for every url. ``rules``: host, path, action (``allow`` or ``block``).

    Returns id_col, host, path, rule (host and path of the winner, else null) and verdict. Two rows with the same id and
    the same host and path get one answer each. Work: one range shuffle of short keys (as many rows as rules' hosts have numbers of labels) and
    one aggregation that brings the probes of a url together.
    """
    ranges = max(1, tasks(pages))
    urls = settle(pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")))
    # No other path can be the beginning of a url's.
    fit = rules.where(F.col("host").isNotNull() & ((F.col("path") == "") | F.col("path").startswith("/")))
    once = Window.partitionBy("host", "path").orderBy(F.desc(F.col("action") == "block"))
    fit = fit.select("host", "path", "action").withColumn("n", F.row_number().over(once)).where("n = 1")
    labels = F.split("host", r"\.", -1)
    depths = sorted(r[0] for r in fit.select(F.size(labels)).distinct().collect())
    probes = _probes(urls, depths).withColumn("line", F.concat("key", F.lit("\x00"), F.hex(F.xxhash64("id", "host"))))
    number = _range_of(_cuts(probes, urls.count(), ranges))
    fit = fit.select(
        F.concat(host_key(labels), F.col("path")).alias("key"),
        F.concat("host", "path").alias("rule"),
        (F.length("host") + F.length("path")).alias("size"),
        F.length("host").alias("host_size"),
        (F.col("action") == "block").alias("block"),
    )
    spread = F.explode(F.sequence(number("key"), number(F.concat("key", F.lit(LAST)))))
    same = {"is_url": F.lit(False), "line": F.col("key"), "id": F.lit(None).cast(urls.schema["id"].dataType), "host": F.lit(""), "path": F.lit(""), "own": F.lit(False)}
    opened = fit.withColumn("part", spread).withColumns(same)
    asked = probes.drop("key").withColumn("part", number("line")).withColumns(
        {"is_url": F.lit(True), "key": F.lit(None).cast("string"), "rule": F.lit(None).cast("string"), "size": F.lit(-1), "host_size": F.lit(-1), "block": F.lit(False)}
    )
    line = opened.unionByName(asked).repartitionById(ranges, "part").sortWithinPartitions("part", "line", "is_url", "size")
    kind = urls.schema["id"].dataType.simpleString()
    found = line.mapInArrow(_sweep, f"id {kind}, host string, path string, own boolean, size int, host_size int, block boolean, rule string")
    best = F.max(F.struct("size", "host_size", "block", "rule"))
    won = found.groupBy("id", "host", "path").agg(best.alias("best"), F.sum(F.col("own").cast("int")).alias("copies"))
    return won.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.when(F.col("best.rule").isNull(), F.lit(default)).when(F.col("best.block"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )
