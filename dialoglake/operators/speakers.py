"""Whose voice it is: clusters, voiceprints and the speaker of each segment.

No speaker name is ever a partition key alone; order-dependent steps run inside one ``media_id``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoglake.functions.text import is_unknown, valid_name
from dialoglake.functions.vectors import l2_normalize
from dialoglake.operators.overlaps import REACH, TURN, fits, overlaps
from dialoglake.operators.voices import nearest_voices

#: Seconds of the shortest time bin of the overlap join, and the registry rows that one matrix product takes.
BIN, REGISTRY_BLOCK = 60.0, 4096


def dominant_cluster(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """segments (media_id, seq, start, end) with cluster_id: the cluster that overlaps longest; of equals the one whose first overlapping turn comes first; none gives null.

    Overlaps are added up by sweeping over stretches of time (``overlaps``), so that turns that lie on each other cost no pairs. Only rows
    of more than an hour, segments of more than ten minutes and times finer than microseconds are joined instead (``met_by_levels``).
    Rows without a start or end meet nothing.
    """
    # What has no length or no time meets nothing.
    timed = F.col("end") > F.col("start")
    s = segments.where(timed).select("media_id", "seq", "start", "end", fits(REACH).alias("_fits"))
    t = turns.where(timed).select("media_id", "track_seq", "cluster_id", "start", "end", fits(TURN).alias("_fits"))
    rows, other = s.groupBy("media_id", "seq").agg(F.count("*").alias("n"), F.count_if(~F.col("_fits")).alias("o")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("o"), F.lit(0))).first()
    far = t.where("not _fits").drop("_fits")
    parted = other > 0 or not far.isEmpty()
    s, odd, near = s.where("_fits").drop("_fits"), s.where("not _fits").drop("_fits"), t.where("_fits").drop("_fits")
    each = overlaps(s, near, best=rows < 2 and not parted)
    if parted:
        each = each.unionByName(met_by_levels(odd, t.drop("_fits"))).unionByName(met_by_levels(s, far))
    if rows > 1 or parted:
        each = each.groupBy("media_id", "seq", "cluster_id").agg(F.sum("us").alias("us"), F.min("first").alias("first"))
        each = each.groupBy("media_id", "seq").agg(F.max(F.struct("us", -F.col("first"), "cluster_id")).alias("best")).select("media_id", "seq", "best.cluster_id", "best.us")
    return segments.join(each.select("media_id", "seq", "cluster_id", (F.col("us") / 1e6).alias("overlap")), ["media_id", "seq"], "left")


def met_by_levels(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """media_id, seq, cluster_id, us, first: microseconds that each cluster overlaps each segment, and its first overlapping turn, by joining them.

    Of two that overlap one begins inside the other. So each row stands once as a span, in the bin where it begins, at the level whose bins
    are at least as long as it is, and its beginning is looked up in two bins of every level that the other side has. Spans of ten hours
    and of ten seconds take one row each, and a long recording spreads over many tasks. Levels grow fourfold, so they are few; one row holds them all.
    """

    def level() -> Column:
        return F.greatest(F.ceil(F.log(4.0, (F.col("end") - F.col("start")) / BIN)), F.lit(0)).cast("int")

    def placed(df: DataFrame, others: DataFrame, inside: bool) -> DataFrame:
        """``df`` once as a span and twice for each level of ``others``; ``inside`` tells whose beginnings are looked up, those of segments or of turns."""

        def at(looked_up: bool, level: Column, back: int = 0) -> Column:
            size = F.lit(BIN) * F.pow(F.lit(4.0), level)
            return F.struct(F.lit(inside == looked_up).alias("inside"), level.alias("level"), (F.floor(F.col("start") / size) - back).alias("bin"))

        levels = others.agg(F.collect_set(level()).alias("_levels"))  # one row of a few dozen numbers
        asks = F.flatten(F.transform("_levels", lambda n: F.array(at(True, n, 1), at(True, n))))
        places = F.explode(F.concat(F.array(at(False, level())), asks))
        return df.join(F.broadcast(levels)).withColumn("_at", places).select("media_id", "_at.*", *[c for c in df.columns if c != "media_id"])

    # ``inside``: the segment begins inside the turn, or with it; otherwise the turn begins inside the segment.
    left, right = placed(segments, turns, True), placed(turns, segments, False).withColumnsRenamed({"start": "t_start", "end": "t_end"})
    low, high = F.greatest("start", "t_start"), F.least("end", "t_end")
    met = left.join(right, ["media_id", "inside", "level", "bin"]).where((F.round(high - low, 6) > 0) & (F.col("inside") == (F.col("t_start") <= F.col("start"))))
    return met.groupBy("media_id", "seq", "cluster_id").agg(F.sum(F.round((high - low) * 1_000_000).cast("long")).alias("us"), F.min("track_seq").cast("long").alias("first"))


def representative_segment(turns: DataFrame) -> DataFrame:
    """Longest turn of each cluster, of equals the earliest."""
    span = F.struct(F.round(F.col("end") - F.col("start"), 6).alias("dur"), (-F.col("start")).alias("less"), F.col("end").alias("end"))
    return turns.groupBy("media_id", "cluster_id").agg(F.max(span).alias("m")).select("media_id", "cluster_id", (-F.col("m.less")).alias("rep_start"), F.col("m.end").alias("rep_end"))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of unit vectors."""
    return 1 - F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distances(clusters: DataFrame, registry: DataFrame) -> DataFrame:
    """Every cluster with every registered voice: matrix products of cluster batches with registry blocks.

    The registry is packed into blocks of at most ``REGISTRY_BLOCK`` voices, one row each, so the clusters meet a few rows.
    -> media_id, cluster_id, candidates (array of struct distance, reg_order, speaker) per block, one for each name.
    """
    kind = clusters.schema["media_id"].dataType.simpleString()
    reg = registry.select("speaker", "reg_order", l2_normalize(F.col("embedding")).alias("v")).where("v is not null")
    # Dealt by all that a row holds, at three quarters of a block's size, so that repeated names spread too and none overflows.
    blocks = max(1, -(-4 * reg.count() // (3 * REGISTRY_BLOCK)))
    number = F.pmod(F.xxhash64("speaker", "reg_order", "v"), F.lit(blocks))
    packed = reg.groupBy(number.alias("block")).agg(F.array_sort(F.collect_list(F.struct("reg_order", "speaker", "v"))).alias("voices"))
    rows = clusters.select("media_id", "cluster_id", l2_normalize(F.col("embedding")).alias("v")).where("v is not null")

    def product(frames):
        at, orders, names, mat = None, [], [], None
        for frame in frames:
            out = []
            for media, cluster, v, block, voices in zip(frame["media_id"], frame["cluster_id"], frame["v"], frame["block"], frame["voices"], strict=True):
                if block != at:
                    at, orders, names, mat = block, [x["reg_order"] for x in voices], [x["speaker"] for x in voices], np.array([x["v"] for x in voices])
                found = sorted(zip((1 - mat @ np.asarray(v)).tolist(), orders, names, strict=True))
                nearest = {s: {"distance": x, "reg_order": o, "speaker": s} for x, o, s in reversed(found)}  # of a name's voices the nearest
                out.append((media, cluster, list(nearest.values())))
            yield pd.DataFrame(out, columns=["media_id", "cluster_id", "candidates"])

    tiles = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(packed, "block")
    return tiles.mapInPandas(product, f"media_id {kind}, cluster_id string, candidates array<struct<distance:double,reg_order:long,speaker:string>>")


def identify(clusters: DataFrame, registry: DataFrame, threshold: float = 0.5, k: int | None = None) -> DataFrame:
    """clusters (media_id, cluster_id, embedding?) -> speaker, distance, candidates (name -> distance).

    The nearest registered voice names the cluster if it is within the threshold; of equals the first registered. All
    others are numbered ``Unknown_01``... by cluster, those without a usable vector first. With ``k`` the candidates are the
    k nearest names, found without measuring blocks of the registry that can't hold them; else they are all names.
    """
    if k is None:
        near = distances(clusters, registry).groupBy("media_id", "cluster_id").agg(F.array_sort(F.flatten(F.collect_list("candidates"))).alias("c"))
    else:
        near = nearest_voices(clusters, registry, k).withColumnRenamed("candidates", "c")
    met = clusters.select("media_id", "cluster_id", "embedding").join(near, ["media_id", "cluster_id"], "left")
    best = F.try_element_at("c", F.lit(1))
    hit = F.coalesce(best["distance"] <= threshold, F.lit(False))
    named = met.withColumn("hit", hit).withColumn("failed", F.coalesce(l2_normalize(F.col("embedding")).isNull(), F.lit(True)))
    named = number_unknowns(named.withColumn("speaker", F.when(F.col("hit"), best["speaker"])))
    # A name may have voices in several blocks; sorted by distance, its first is the nearest.
    names = F.col("c.speaker")
    once = F.when(F.size(F.array_distinct(names)) == F.size(names), F.col("c")).otherwise(F.filter("c", lambda x, i: F.array_position(names, x["speaker"]) == i + 1))
    by_name = F.map_from_entries(F.transform(once, lambda x: F.struct(x["speaker"], x["distance"])))
    return named.select("media_id", "cluster_id", "speaker", best["distance"].alias("distance"), by_name.alias("candidates"))


def number_unknowns(rows: DataFrame) -> DataFrame:
    """Rows without a speaker get ``Unknown_%02d`` inside their recording: failures first, then by cluster."""
    without = F.col("speaker").isNull()
    order = Window.partitionBy("media_id", without).orderBy(F.desc("failed"), "cluster_id")
    return rows.withColumn("speaker", F.when(without, F.format_string("Unknown_%02d", F.row_number().over(order))).otherwise(F.col("speaker")))


def label_all_unknown(clusters: DataFrame) -> DataFrame:
    """Without any registry: every cluster is unknown, in order."""
    return number_unknowns(clusters.withColumn("speaker", F.lit(None).cast("string")).withColumn("failed", F.lit(False))).drop("failed")


def resolve_speaker(segments: DataFrame, clusters: DataFrame) -> DataFrame:
    """Segments with speaker, distance and candidates: no cluster gives ``Unknown``, an unmapped cluster its own id."""
    kept = [c for c in ("speaker", "distance", "candidates") if c in clusters.columns]
    met = segments.join(clusters.select("media_id", "cluster_id", *kept), ["media_id", "cluster_id"], "left")
    return met.withColumn("speaker", F.when(F.col("cluster_id").isNull(), "Unknown").otherwise(F.coalesce("speaker", "cluster_id")))


def relabel(transcript: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace speakers by ``mapping`` (media_id, old, speaker, distance?) and overwrite their distance; ``replaced`` tells which."""
    new = mapping.select("media_id", F.col("old").alias("speaker"), F.col("speaker").alias("_new"), F.col("distance").alias("_distance"), F.lit(True).alias("_hit"))
    met = transcript.join(new, ["media_id", "speaker"], "left").withColumn("replaced", F.coalesce("_hit", F.lit(False)))
    out = met.withColumn("speaker", F.coalesce("_new", "speaker"))
    if "distance" in transcript.columns:
        out = out.withColumn("distance", F.when(F.col("replaced"), F.col("_distance")).otherwise(F.col("distance")))
    return out.select(*transcript.columns, "replaced")


def new_voices(clusters: DataFrame, labelled: DataFrame) -> DataFrame:
    """Labelled clusters (media_id, cluster_id, name) as voices: speaker, reg_order, embedding.

    Names that can't be registered and unusable vectors give none; of a name given twice the last by recording and cluster stays.
    """
    given = labelled.select("media_id", "cluster_id", valid_name(F.col("name")).alias("speaker")).join(clusters.select("media_id", "cluster_id", "embedding"), ["media_id", "cluster_id"])
    usable = given.where(F.col("speaker").isNotNull() & l2_normalize(F.col("embedding")).isNotNull())
    last = usable.groupBy("speaker").agg(F.max(F.struct("media_id", "cluster_id", "embedding")).alias("m"))
    # Only the order among themselves matters: whoever was registered before comes first.
    return last.select("speaker", F.xxhash64("speaker").alias("reg_order"), "m.embedding")


def with_voices(registry: DataFrame, new: DataFrame) -> DataFrame:
    """``registry`` (speaker, reg_order, embedding) with ``new`` ones behind the others; a name already there is overwritten."""
    kept = registry.select("speaker", F.lit(0).alias("_new"), F.col("reg_order").cast("long").alias("reg_order"), F.col("embedding").cast("array<double>").alias("embedding")).join(new.select("speaker"), "speaker", "left_anti")
    both = kept.unionByName(new.select("speaker", F.lit(1).alias("_new"), "reg_order", F.col("embedding").cast("array<double>").alias("embedding")))
    last = kept.agg(F.coalesce(F.max("reg_order"), F.lit(-1)).alias("_last"))
    behind = both.where("_new = 1").withColumn("_n", F.row_number().over(Window.orderBy("speaker")))
    placed = behind.join(F.broadcast(last)).select("speaker", (F.col("_last") + F.col("_n")).alias("reg_order"), "embedding")
    return kept.select("speaker", "reg_order", "embedding").unionByName(placed)


def rematch_unknowns(clusters: DataFrame, registry: DataFrame, labelled: DataFrame, threshold: float = 0.5, recompute: bool = False) -> DataFrame:
    """After names were given: ``labelled`` (media_id, cluster_id, name) become them and are registered; then every other unknown is matched again.

    Where ``clusters`` hold their ``candidates`` (name -> distance, nearest first, as ``identify`` gives them), only the voices
    just registered are measured, and merged into the stored distances; those to a name that was overwritten no longer count.
    Otherwise unknowns meet the whole registry. Of equal distances the voice registered first wins, new ones by name.

    -> media_id, cluster_id, old, speaker, distance, how (manual, auto, or null for what stays). A labelled cluster has no
    distance; an unknown that stays one takes over its new distance. With ``recompute`` a labelled cluster gets its distance to
    the registry as it is now, and an unknown that stays one keeps what it had.
    """
    new = new_voices(clusters, labelled)
    marked = clusters.join(labelled, ["media_id", "cluster_id"], "left")
    asked = marked.where(F.col("embedding").isNotNull() & F.when(F.col("name").isNull(), is_unknown(F.col("speaker"))).otherwise(F.lit(recompute)))
    if "candidates" in clusters.columns:
        near = merged_nearest(asked, registry, new)
    else:
        found = identify(asked.select("media_id", "cluster_id", "embedding"), with_voices(registry, new), float("inf"))
        near = found.where("distance is not null").select("media_id", "cluster_id", F.col("speaker").alias("_near"), F.col("distance").alias("_d"))
    met = marked.join(near, ["media_id", "cluster_id"], "left")
    given = F.col("name").isNotNull()
    hit = ~given & F.coalesce(F.col("_d") <= threshold, F.lit(False))
    how = F.when(given, "manual").when(hit, "auto")
    stays = F.col("distance") if recompute else F.coalesce("_d", "distance")
    distance = F.when(given, F.col("_d") if recompute else F.lit(None).cast("double")).when(hit, F.col("_d")).otherwise(stays)
    speaker = F.when(given, F.col("name")).when(hit, F.col("_near")).otherwise(F.col("speaker"))
    return met.select("media_id", "cluster_id", F.col("speaker").alias("old"), speaker.alias("speaker"), distance.alias("distance"), how.alias("how"))


def merged_nearest(asked: DataFrame, registry: DataFrame, new: DataFrame) -> DataFrame:
    """media_id, cluster_id, _near, _d: the nearest of the stored candidates that still hold and of the ``new`` voices, which alone are measured.

    A cluster whose stored candidates, being the k nearest, were all overwritten is measured against what else is registered.
    """
    keys = ["media_id", "cluster_id"]
    stored = asked.select(*keys, F.posexplode(F.map_entries("candidates")).alias("at", "c")).select(*keys, F.lit(0).alias("age"), F.col("at").cast("long").alias("at"), F.col("c.key").alias("speaker"), F.col("c.value").alias("d"))
    overwritten = registry.select("speaker").join(new.select("speaker"), "speaker", "left_semi")
    old = stored.join(overwritten, "speaker", "left_anti").groupBy(*keys).agg(F.min(F.struct("d", "age", "at", "speaker")).alias("m"))
    if not overwritten.isEmpty():
        lost = asked.where(F.size("candidates") > 0).join(old, keys, "left_anti")
        again = nearest_voices(lost, registry.join(overwritten, "speaker", "left_anti")).select(*keys, F.col("candidates")[0].alias("c"))
        old = old.unionByName(again.select(*keys, F.struct(F.col("c.distance").alias("d"), F.lit(0).alias("age"), F.lit(0).cast("long").alias("at"), F.col("c.speaker").alias("speaker")).alias("m")))
    fresh = distances(asked.select(*keys, "embedding"), new).select(*keys, F.explode("candidates").alias("c"))
    rows = fresh.select(*keys, F.struct(F.col("c.distance").alias("d"), F.lit(1).alias("age"), F.lit(0).cast("long").alias("at"), F.col("c.speaker").alias("speaker")).alias("m"))
    best = old.unionByName(rows).groupBy(*keys).agg(F.min("m").alias("m"))
    return best.select(*keys, F.col("m.speaker").alias("_near"), F.col("m.d").alias("_d"))


def missing_embeddings(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (namespace, path, content) against the cache (namespace, content_sha256, embedding) -> hits, and one file of each missing content."""
    hashed = files.withColumn("content_sha256", F.sha2("content", 256))
    names = hashed.drop("content")
    hits = names.join(cache, ["namespace", "content_sha256"])
    # Contents don't travel while the files to read are found; only those are fetched.
    first = names.join(cache, ["namespace", "content_sha256"], "left_anti").groupBy("namespace", "content_sha256").agg(F.min("path").alias("path"))
    misses = hashed.join(first, ["namespace", "content_sha256", "path"], "left_semi").dropDuplicates(["namespace", "content_sha256"])
    return hits, misses


def compute_embeddings(files: DataFrame, embed: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """Vectors of missing contents by a caller's batch function -> rows for the cache."""

    def run(frames):
        for frame in frames:
            if len(frame):
                yield frame[["namespace", "content_sha256"]].assign(embedding=[np.asarray(v, "f4") for v in embed(list(frame["content"]))])

    return files.select("namespace", "content_sha256", "content").mapInPandas(run, "namespace string, content_sha256 string, embedding array<float>")


def upsert_voiceprints(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Add speakers (db, speaker, embedding): a name already there is overwritten, the last of ``new`` (by ``seq``) wins, an unusable name is left out."""
    named = new.withColumn("speaker", valid_name(F.col("speaker"))).where("speaker is not null").withColumn("_age", F.col("seq") + 1)
    every = registry.withColumn("_age", F.lit(0).cast("long")).unionByName(named.select(*registry.columns, F.col("_age").cast("long").alias("_age")))
    latest = Window.partitionBy("db", "speaker").orderBy(F.desc("_age"))
    return every.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "_age")


def rename_speaker(registry: DataFrame, db: str, old: str, new: str) -> DataFrame:
    """Rename inside one database; fails where the target exists, and does nothing for the same name."""
    if old == new:
        return registry
    if not registry.where((F.col("db") == db) & (F.col("speaker") == new)).isEmpty():
        raise ValueError(f"{new!r} is registered already")
    return registry.withColumn("speaker", F.when((F.col("db") == db) & (F.col("speaker") == old), F.lit(new)).otherwise(F.col("speaker")))


def registration_crop(files: DataFrame, trim: float = 0.5, least: float = 0.5) -> DataFrame:
    """Voice files with ``duration`` -> crop_start, crop_end; short files and those of unknown length stay whole (nulls)."""
    fits = F.col("duration") >= 2 * trim + least
    return files.withColumn("crop_start", F.when(fits, trim)).withColumn("crop_end", F.when(fits, F.col("duration") - trim))


def database_summary(registry: DataFrame) -> DataFrame:
    return registry.groupBy("db").agg(F.count("*").alias("speakers"))
