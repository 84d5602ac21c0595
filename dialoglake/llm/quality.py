"""Quality rules as a bitmask ledger.

Every rule is evaluated once. The ledger keeps what was measured and one bit for each rule that failed; policies are
named sets of rules, applied to the stored bits, and an ablation is read off a count of bit patterns, so neither looks at
the texts again.

Defined results: a null text counts as empty and has no words, so it fails the first rule; repeated rows are judged each;
extra columns are carried only where asked for, and one that has a measurement's name gets ``kept_`` before it; an empty
table gives no rows. Very long texts are measured whole; a task holds one batch of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

#: Rule -> its condition of failure over the measurements. The order gives the bits and must only be appended to.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
}
#: Version -> the rules that reject. "base" is the fixed contract; later versions add to it.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "short_words", "long_words", "repeated_lines"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Number of words that lie in a window of 8 words found twice or more; exact, by naming windows of 2, 4 and 8 words."""
    if len(words) <= window:
        return 0
    names: dict[bytes, int] = {}
    code = np.fromiter((names.setdefault(w, len(names)) for w in words), "i8", len(words))
    size, count = len(names), len(words)
    if size < 50_000:
        code, span = (code[:-3] * size + code[1:-2]) * size**2 + code[2:-1] * size + code[3:], 4
    else:
        span = 1
    while True:
        _, code, seen = np.unique(code, return_inverse=True, return_counts=True)
        if seen.max() < 2:
            return 0
        if span == window:
            break
        code, span = code[:-span] * len(code) + code[span:], 2 * span
    hit = np.flatnonzero(seen[code] > 1)
    edges = np.zeros(count + 1, "i8")
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    held = text.translate(None, SPACES)
    return len(words), len(held.decode()), len(text) - len(text.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


@F.arrow_udf(StructType([StructField(m, LongType()) for m in MEASURES]))
def _measured(texts: pa.Array) -> pa.Array:
    rows = [measure(t or b"") for a in range(0, len(texts), 256) for t in texts[a : a + 256].cast(pa.large_binary()).to_pylist()]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))], MEASURES)


#: Never evaluated twice, whatever is done with its fields.
measures = _measured.asNondeterministic()


def ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, every measurement and ``failed``: bit i is set where rule i failed. No shuffle; texts go to Python once and don't come back."""
    out = [f"kept_{c}" if c in (*MEASURES, "failed") else c for c in keep]
    held = [f"_k{i}" for i in range(len(keep))]
    book = docs.select(*[F.col(c).alias(h) for c, h in zip(keep, held, strict=True)], measures(F.col(text_col)).alias("_m"))
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    found = book.select(*held, "_m.*").withColumn("failed", failed.cast("long"))
    return found.select(*[F.col(h).alias(c) for c, h in zip(out, held, strict=True)], *MEASURES, "failed")


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(r) for r in POLICIES[policy])


def passes(policy: str, failed: Column | None = None) -> Column:
    """Whether the stored bits pass the policy."""
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(mask(policy))) == 0


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: rows that fail it, rows that only it rejects, and rows kept without it.

    One aggregation to at most 2^rules patterns, then bit arithmetic on those.
    """
    m, n = mask(policy), F.col("n")
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    rules = book.sparkSession.createDataFrame([(r, 1 << list(RULES).index(r)) for r in POLICIES[policy]], "rule string, bit long")
    met = patterns.withColumn("r", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])))
    bit = F.col("r.bit")
    sums = met.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, n).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("bits") == bit, n).otherwise(0)).alias("only_this"),
        F.sum(F.when((F.col("bits") == bit) | (F.col("bits") == 0), n).otherwise(0)).alias("kept_without"),
    )
    zero = F.lit(0).cast("long")
    return rules.select("rule").join(sums, "rule", "left").select("rule", *[F.coalesce(c, zero).alias(c) for c in ("failing", "only_this", "kept_without")])


def filter_documents(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the policy, all columns as they were. No shuffle and no join."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    book = ledger(docs.toDF(*names), names[docs.columns.index(text_col)], tuple(names))
    return book.where(passes(policy)).select(*names).toDF(*docs.columns)
