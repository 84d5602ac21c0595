"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source is wanted target / size-of-source times: a whole number of copies and a fraction. Fractions are
settled in pairs: words move from one document's fraction to the other's until one of the two is 0 or 1, the direction
drawn so that each fraction keeps its expectation. Words, not documents, are moved, so the words that a source gives stay
exactly the same in every step. Groups of ``FAN`` documents, alike in size, are settled at once and leave one fraction
each; these meet in groups again, up a tree, until a source has one left, which is drawn alone. A source thus misses its
target by less than one document.

Everything runs on DataFrame functions. Draws are hashes of documents and seed, and groups follow from hashes too, so
reruns agree whatever the partitions.

Defined results: a null text has no words; null is a source of its own and comes last; a source or document without words
takes nothing; documents that agree in id, text and source are one unit with a count, whose copies are shared out evenly;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoglake.llm.common import n_words, one_row_each, settle, text_key

FAN = 32
NEVER = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """source, source_size, docs -> the same with target.

    Weights repeat over the sources by code point, null last. A target is at most ``most`` times its source's size; what
    is over goes to the others by weight. The level L of sum(min(cap, L * weight)) = total is found by rising steps: each
    leaves out the sources that the last level fills, in one sum over all sources, until none joins them. Sources may be
    many (domains, say): they are sorted and summed in parallel, and the driver sees two sums a step and a count a partition.
    """
    in_part = 2**33
    placed = settle(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("_n", F.monotonically_increasing_id()))
    part, upto, starts = F.floor(F.col("_n") / in_part).cast("long"), 0, []
    for p, n in sorted(placed.groupBy(part.alias("part")).count().collect()):
        starts += [F.lit(p).cast("long"), F.lit(upto).cast("long")]
        upto += n
    if not starts:
        return placed.select("source", "source_size", "docs", F.lit(0.0).alias("target"))
    rank = F.element_at(F.create_map(*starts), part) + F.col("_n") % in_part
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = settle(placed.select("source", "source_size", "docs", F.element_at(listed, (rank % len(weights) + 1).cast("int")).alias("weight")))
    cap, level = F.lit(float(most)) * F.col("source_size"), 0.0
    while True:
        full = F.lit(level) * F.col("weight") >= cap
        total, filled, weight = ranked.select(F.sum("source_size"), F.sum(F.when(full, F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        higher = (total - most * filled) / weight if weight else level
        if higher <= level:
            break
        level = higher
    return ranked.select("source", "source_size", "docs", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def _draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11).cast("double") / F.lit(float(2**53))


def _settle_group(group: Column, seed: int, level: int) -> Column:
    """Fold over an array of (k1, k2, size, p): -> struct(left, done array of (k1, k2, more))."""
    empty = F.array().cast("array<struct<k1:long,k2:long,more:int>>")
    first = F.element_at(group, 1)

    def step(state: Column, new: Column) -> Column:
        old = state["left"]
        a, u, b, v = old["p"], old["size"], new["p"], new["size"]
        up = F.least((1 - a) * u, b * v)  # words that the first can gain, and can lose
        down = F.least(a * u, (1 - b) * v)
        gains = _draw(seed + level, old["k1"], old["k2"], new["k1"], new["k2"]) * (up + down) < down
        moved = F.when(gains, up).otherwise(-down)
        p = a + moved / u
        q = b - moved / v
        # The one nearer to 0 or 1 is settled; in exact arithmetic it is there.
        gap_p, gap_q = F.least(F.abs(p), F.abs(1 - p)), F.least(F.abs(q), F.abs(1 - q))
        out_old = gap_p <= gap_q
        settled = F.struct(
            F.when(out_old, old["k1"]).otherwise(new["k1"]).alias("k1"),
            F.when(out_old, old["k2"]).otherwise(new["k2"]).alias("k2"),
            F.when(out_old, (p > 0.5).cast("int")).otherwise((q > 0.5).cast("int")).alias("more"),
        )
        left = F.struct(
            F.when(out_old, new["k1"]).otherwise(old["k1"]).alias("k1"),
            F.when(out_old, new["k2"]).otherwise(old["k2"]).alias("k2"),
            F.when(out_old, v).otherwise(u).alias("size"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(out_old, q).otherwise(p))).alias("p"),
        )
        return F.struct(left.alias("left"), F.concat(state["done"], F.array(settled)).alias("done"))

    return F.aggregate(F.slice(group, 2, F.size(group)), F.struct(first.alias("left"), empty.alias("done")), step)


def draw_copies(units: DataFrame, seed: int = 17) -> DataFrame:
    """``units``: source, k1, k2 (unique within a source), size, p in (0, 1), grade. -> source, k1, k2, more (0 or 1).

    ``grade`` keeps documents alike in size together on the first level. Each level is one shuffle of short rows,
    FAN times fewer than the level before, and is written before the next one reads it.
    """
    rows, level, done = units.select("source", "k1", "k2", "size", "p", "grade"), 0, None
    n = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    while n > 1:
        groups = max(1, -(-n // (FAN if level else 4 * FAN)))  # the first level splits each group by grade
        key = [F.col("source"), F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "k1", "k2"), F.lit(groups)).alias("part")]
        if level == 0:
            key.append(F.col("grade"))
        met = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("size", "k1", "k2", "p"))).alias("members"))
        met = met.withColumn("members", F.transform("members", lambda x: F.struct(x["k1"], x["k2"], x["size"], x["p"])))
        folded = settle(met.select("source", _settle_group(F.col("members"), seed, level).alias("s")))
        out = folded.select("source", F.explode("s.done").alias("d")).select("source", "d.*")
        done = out if done is None else done.unionByName(out)
        rows = folded.select("source", "s.left.*")
        now = rows.groupBy("source").count().agg(F.max("count")).first()[0]
        level, n = level + 1, now
    last = rows.select("source", "k1", "k2", (_draw(seed, F.col("k1"), F.col("k2")) < F.col("p")).cast("int").alias("more"))
    return last if done is None else done.unionByName(last)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = 17, key_cols: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each distinct (id, text, source) or ``key_cols``: id, source, key_a, key_b, rows (of the input), size, source_size, target, copies (of all its rows together)."""
    key = text_key(*[F.col(c) for c in key_cols or (id_col, text_col, source_col)])
    read = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"), n_words(F.col(text_col)).alias("size"))
    units = settle(read.select("id", "source", F.col("key.a").alias("k1"), F.col("key.b").alias("k2"), "size").groupBy("id", "source", "k1", "k2", "size").agg(F.count("*").alias("rows")))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("docs"))
    aims = settle(targets(sizes, weights, most))
    aims = aims.select(F.col("source").alias("aim"), "source_size", "target")
    aimed = units.join(aims, F.col("source").eqNullSafe(F.col("aim"))).drop("aim")
    wanted = aimed.withColumn("want", F.when(F.col("size") > 0, F.col("rows") * F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    wanted = wanted.withColumn("whole", F.floor(F.col("want") + NEVER)).withColumn("p", F.col("want") - F.col("whole"))
    open_ = wanted.where(f"p > {NEVER}").withColumn("grade", F.floor(F.log2(F.col("size").cast("double"))).cast("int"))
    more = draw_copies(open_, seed)
    joined = wanted.alias("w").join(more.select(F.col("k1").alias("m1"), F.col("k2").alias("m2"), "more"), (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")), "left")
    return joined.select("id", "source", F.col("k1").alias("key_a"), F.col("k2").alias("key_b"), "rows", "size", "source_size", "target", (F.col("whole") + F.coalesce("more", F.lit(0))).alias("copies"))


def copies_by_row(mixed: DataFrame) -> DataFrame:
    """One row for each row of the input; a unit's copies are shared out so that its rows differ by one at most."""
    return mixed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn(
        "copies", F.floor(F.col("copies") / F.col("rows")) + (F.col("nth") < F.col("copies") % F.col("rows")).cast("long")
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it was drawn, with the columns of ``docs``."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = {c: names[i] for i, c in reversed(list(enumerate(docs.columns)))}
    plain = docs.toDF(*names)
    cols = {k: at[options.pop(k, d)] for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    drawn = settle(mix(plain, **cols, **options, key_cols=tuple(names)).where("copies > 0").select("key_a", "key_b", "rows", "copies"))
    out = one_row_each(plain, names, drawn, "copies")
    return out.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*names).toDF(*docs.columns)
