"""Joins, windows, chains and reports, against plain Python and literals. Two recordings at once, so that leaks show."""

import pickle
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F


from dialoglake.functions import scans
from dialoglake.operators import chains, cleaning, clips, evaluation, matching, sinks, speakers, stats, voices
from dialoglake.plans import jobs
from dialoglake.sources.embedding_store import EmbeddingStore

SEG = "media_id string, seq int, start double, end double, text string"
TURN = "media_id string, track_seq int, cluster_id string, start double, end double"
ENTRY = "media_id string, entry_no int, start double, end double, speakers array<string>, body string"


# ---- voices


def plain_nearest(registry, v, k):
    """The k nearest names by measuring every voice: (distance, reg_order, speaker)."""
    unit = lambda x: np.array(x, "f8") / np.linalg.norm(x)
    best = {}
    for d, o, s in sorted((round(round(1 - float(unit(v) @ unit(x)), 12), 9) + 0.0, o, s) for s, o, x in registry if x is not None and any(x)):
        best.setdefault(s, (d, o, s))
    return list(best.values())[:k]


@pytest.mark.parametrize("k", [1, 3, 500])
def test_nearest_voices_match_measuring_all(spark, k):
    r = np.random.default_rng(k)
    middles = r.normal(size=(12, 16))
    near = lambda m: [float(x) for x in (middles[m] + r.normal(scale=0.15, size=16)).astype("f4")]
    # A third of the voices are one and the same, names have up to three voices, some vectors are unusable.
    same = near(0)
    registry = [(f"s{n // 3}", n, same if n % 3 == 0 else near(n % 12)) for n in range(240)] + [("gone", 240, None), ("zero", 241, [0.0] * 16)]
    clusters = [("ab"[n % 2], f"c{n:02d}", near(n % 12)) for n in range(40)] + [("a", "same", same), ("a", "none", None), ("b", "zero", [0.0] * 16), ("b", "far", [float(-x) for x in middles[3].astype("f4")])]
    reg = spark.createDataFrame(registry, "speaker string, reg_order long, embedding array<float>")
    clu = spark.createDataFrame(clusters, "media_id string, cluster_id string, embedding array<float>")
    for size in (16 * 8 * 1000, 16 * 8 * 20, 16 * 8):  # one block, a dozen, one voice a block
        got = {(x.media_id, x.cluster_id): [(round(c.distance, 9) + 0.0, c.reg_order, c.speaker) for c in x.candidates] for x in voices.nearest_voices(clu, reg, k, size).collect()}
        assert got == {(m, c): plain_nearest(registry, v, k) for m, c, v in clusters if v is not None and any(v)}
    assert voices.nearest_voices(clu, reg.limit(0), k).isEmpty() and voices.nearest_voices(clu.limit(0), reg, k, 16 * 8 * 20).isEmpty()


def test_far_blocks_of_voices_are_skipped(spark):
    r = np.random.default_rng(5)
    middles = r.normal(size=(40, 32))
    rows = [(n, [float(x) for x in middles[n % 40] + r.normal(scale=0.1, size=32)]) for n in range(4000)]
    reg = spark.createDataFrame([(f"s{n}", n, v) for n, v in rows if n % 4], "speaker string, reg_order long, embedding array<float>")
    clu = spark.createDataFrame([("a", f"c{n}", v) for n, v in rows if n % 4 == 0], "media_id string, cluster_id string, embedding array<float>")
    seen = []
    plain = voices.blocks_to_search
    with pytest.MonkeyPatch.context() as m:
        m.setattr(voices, "blocks_to_search", lambda *a: seen.append((plain(*a).count(), a[2].selectExpr("sum(size(bounds))").first()[0])) or plain(*a))
        voices.nearest_voices(clu, reg, 1, 32 * 8 * 100).collect()
    pairs, blocks = seen[0]
    assert pairs + 1000 < 0.4 * 1000 * blocks


def test_blocks_to_measure_travel_as_bits_of_a_shard(spark):
    r = np.random.default_rng(6)
    middles = r.normal(size=(30, 8))
    for spread, share in ((10.0, 1.0), (0.02, 0.4)):  # voices without any order, where nothing can be skipped, and of 30 speakers
        rows = [(n, [float(x) for x in (middles[n % 30] + r.normal(scale=spread, size=8)).astype("f4")]) for n in range(900)]
        registry, clusters = [(f"s{n // 3}", n, v) for n, v in rows if n % 3], [("a", f"c{n}", v) for n, v in rows if n % 3 == 0]
        reg = spark.createDataFrame(registry, "speaker string, reg_order long, embedding array<float>")
        clu = spark.createDataFrame(clusters, "media_id string, cluster_id string, embedding array<float>")
        seen, plain = [], voices.measured
        with pytest.MonkeyPatch.context() as m:
            m.setattr(voices, "measured", lambda asked, packed, *a: seen.append((asked.collect(), packed.selectExpr("sum(size(sizes))").first()[0] if "sizes" in packed.columns else packed.count())) or plain(asked, packed, *a))
            got = {x.cluster_id: [(round(c.distance, 9) + 0.0, c.reg_order, c.speaker) for c in x.candidates] for x in voices.nearest_voices(clu, reg, 3, 8 * 8 * 20).collect()}
        assert got == {c: plain_nearest(registry, v, 3) for _, c, v in clusters}
        (first, _), (rest, blocks) = seen
        assert len(first) == 300 and len(rest) <= 300 and blocks >= 30  # one row for each cluster and shard, not for each block
        assert sum(int.from_bytes(x.wanted).bit_count() for x in rest) + 300 <= share * 300 * blocks


def test_candidates_that_were_all_overwritten_are_measured_again(spark):
    reg = spark.createDataFrame([("x", 0, [1.0, 0.0]), ("y", 1, [0.8, 0.6]), ("z", 2, [0.0, 1.0])], "speaker string, reg_order long, embedding array<float>")
    clu = spark.createDataFrame([("m", "c0", [0.9, -0.1]), ("m", "c1", [-1.0, 0.0])], "media_id string, cluster_id string, embedding array<float>")
    named = speakers.identify(clu, reg, 0.0, 1).join(clu, ["media_id", "cluster_id"])
    labelled = spark.createDataFrame([("m", "c1", "x")], "media_id string, cluster_id string, name string")
    plain, whole = (sorted(map(str, speakers.rematch_unknowns(d, reg, labelled, 0.5).withColumn("distance", F.round("distance", 9)).collect())) for d in (named, named.drop("candidates")))
    assert plain == whole and "speaker='y'" in "".join(plain)


def test_dominant_cluster_matches_plain(spark):
    r = random.Random(1)
    turns = [("ab"[i % 2], i, f"c{r.randrange(4)}", s := r.randrange(0, 3000) / 10, s + r.randrange(0, 900) / 10) for i in range(80)]
    segs = [("ab"[i % 2], i, s := r.randrange(0, 3000) / 10, s + r.randrange(0, 200) / 10, "") for i in range(120)]
    got = {(x.media_id, x.seq): x.cluster_id for x in speakers.dominant_cluster(spark.createDataFrame(segs, SEG), spark.createDataFrame(turns, TURN)).collect()}
    assert len(got) == len(segs)
    for m, n, s, e, _ in segs:
        total, first = {}, {}
        for tm, k, c, a, b in turns:
            if tm == m and (o := round(min(e, b) - max(s, a), 6)) > 0:
                total[c] = total.get(c, 0) + round(o * 1e6)
                first.setdefault(c, k)
        want = max(total, key=lambda c: (total[c], -first[c])) if total else None
        assert got[(m, n)] == want


def plain_dominant(segs, turns):
    """(media_id, seq) -> cluster and microseconds, by comparing every segment with every turn; rows of one number count together."""
    each = {}
    for m, n, s, e, _ in segs:
        for tm, k, c, a, b in turns:
            if tm == m and (us := round((min(e, b) - max(s, a)) * 1e6)) > 0:
                of = each.setdefault((m, n), {}).setdefault(c, [0, k])
                of[:] = of[0] + us, min(of[1], k)
    return {key: max((us, -first, c) for c, (us, first) in of.items())[::-2] for key, of in each.items()}


def dense_spans(seed):
    """Turns that lie on each other, most of them in two clusters at once, over several stretches of time."""
    r = random.Random(seed)
    span = lambda n: (a := r.randrange(0, 6_000_000) / 1000, a + r.randrange(0, n) / 1000)
    turns = [("ab"[i % 2], i * 7919 % 600, f"c{i % 4}", *span(500_000)) for i in range(300)]
    turns += [(m, k + 600, f"c{k % 5}", a, b) for m, k, _, a, b in turns]
    return [("ab"[i % 2], i, *span(560_000 if i % 3 else 5000), "") for i in range(400)], turns


def test_dense_overlaps_are_added_up_without_pairs(spark):
    segs, turns = dense_spans(3)
    df = speakers.dominant_cluster(spark.createDataFrame(segs, SEG), spark.createDataFrame(turns, TURN))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # segments with what was found, not with turns
    got = {(x.media_id, x.seq): (x.cluster_id, round(x.overlap * 1e6)) for x in df.collect() if x.cluster_id}
    assert got == plain_dominant(segs, turns)
    # Long spans, times finer than microseconds and numbers given twice.
    segs += [("a", 900 + i, 10.0 * i, 10.0 * i + 700 + i / 3, "") for i in range(30)] + [("b", i, 50.0 * i, 50.0 * i + 20, "") for i in range(1, 80, 2)]
    turns += [("a", 2000 + i, f"c{i % 3}", 5.0 * i, 5.0 * i + 4000 + i / 7) for i in range(20)]
    more = speakers.dominant_cluster(spark.createDataFrame(segs, SEG), spark.createDataFrame(turns, TURN)).collect()
    assert len(more) == len(segs) and {(x.media_id, x.seq): (x.cluster_id, round(x.overlap * 1e6)) for x in more if x.cluster_id} == plain_dominant(segs, turns)


def test_sweep_over_stretches_in_small_batches(monkeypatch):
    import pyarrow as pa

    from dialoglake.operators import overlaps

    segs, turns = dense_spans(4)
    turns += [("a", 5000 + i, None, 20.0 * i, 20.0 * i + 90) for i in range(300)]
    us = lambda x: round(x * 1e6)
    rows = [(us(s) // overlaps.STRETCH, m, n, None, us(s), us(e), None) for m, n, s, e, _ in segs if e > s]
    for m, k, c, a, b in turns:
        rows += [(p, m, None, c, us(a), us(b), k) for p in range((us(a) - overlaps.REACH) // overlaps.STRETCH, (us(b) - 1) // overlaps.STRETCH + 1) if b > a]
    names, kinds = ["part", "media_id", "seq", "cluster_id", "lo", "hi", "first"], [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    rows.sort(key=lambda x: x[:2])
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    want = plain_dominant(segs, [t[:2] + (t[2] or "",) + t[3:] for t in turns])
    for many, pairs in ((20, 30), (10**6, 10**6)):
        monkeypatch.setattr(overlaps, "ROWS", many)
        monkeypatch.setattr(overlaps, "PAIRS", pairs)
        best, every = ([x for t in overlaps.whole_stretches(table.to_batches(7)) for b in overlaps.found(t, flag) for x in b.to_pylist()] for flag in (True, False))
        assert {(x["media_id"], x["seq"]): (x["cluster_id"] or "", x["us"]) for x in best} == want and len(best) == len(want)
        most = {}
        for x in every:
            most.setdefault((x["media_id"], x["seq"]), []).append((x["us"], -x["first"], x["cluster_id"] or ""))
        assert {k: max(v)[::-2] for k, v in most.items()} == want


def test_long_and_odd_spans_meet_each_other_once(spark):
    r = random.Random(2)
    lengths = [0.0, 0.5, 59.0, 60.0, 61.0, 240.0, 241.0, 36_000.0, 1e6]
    span = lambda: (a := float(r.randrange(-3000, 40_000)), a + r.choice(lengths))
    turns = [("m", i, f"c{i}", *span()) for i in range(60)] + [("m", 60, "gone", None, 5.0), ("m", 61, "back", 9.0, 5.0)]
    segs = [("m", i, *span(), "") for i in range(60)] + [("m", 60, None, 1.0, ""), ("m", 61, 5.0, None, ""), ("n", 0, 0.0, 5.0, "")]
    t = spark.createDataFrame(turns, TURN)
    got = {(x.media_id, x.seq): (x.cluster_id, x.overlap) for x in speakers.dominant_cluster(spark.createDataFrame(segs, SEG), t).collect()}
    assert len(got) == len(segs)
    for m, n, s, e, _ in segs:
        met = [(min(e, b) - max(s, a), -k, c) for tm, k, c, a, b in turns if tm == m and None not in (s, e, a, b) and min(e, b) > max(s, a)]
        assert got[m, n] == ((best := max(met))[2], best[0]) if met else got[m, n] == (None, None)
    assert speakers.dominant_cluster(spark.createDataFrame(segs, SEG), t.limit(0)).where("cluster_id is null").count() == len(segs)


def test_identify_threshold_ties_and_numbers(spark):
    reg = spark.createDataFrame([("Ann", 0, [1.0, 0.0]), ("Bob", 1, [0.0, 1.0]), ("Cat", 2, [2.0, 0.0])], "speaker string, reg_order long, embedding array<float>")
    rows = [("m", "c0", [5.0, 0.0]), ("m", "c1", [1.0, 1.0]), ("m", "c2", [0.0, 0.0]), ("m", "c3", [-1.0, 0.1]), ("m", "c4", None), ("n", "c0", [0.0, 3.0])]
    got = {(x.media_id, x.cluster_id): x for x in speakers.identify(spark.createDataFrame(rows, "media_id string, cluster_id string, embedding array<float>"), reg, 1 - 2**-0.5 + 1e-9).collect()}
    assert [got[("m", f"c{i}")].speaker for i in range(5)] == ["Ann", "Ann", "Unknown_01", "Unknown_03", "Unknown_02"] and got[("n", "c0")].speaker == "Bob"
    assert got[("m", "c3")].distance > 0.5 and got[("m", "c2")].distance is None
    none = speakers.identify(spark.createDataFrame(rows, "media_id string, cluster_id string, embedding array<float>"), reg.limit(0)).collect()
    assert all(x.speaker.startswith("Unknown_") and x.distance is None for x in none)


def test_rematch_relabel_and_manifest(spark):
    reg = spark.createDataFrame([("Ann", 0, [1.0, 0.0])], "speaker string, reg_order long, embedding array<float>")
    clusters = spark.createDataFrame([("m", "c0", "Unknown_01", None, [1.0, 0.1]), ("m", "c1", "Unknown_02", None, [0.0, 1.0]), ("m", "c2", "Bob", 0.1, [0.0, 1.0]), ("m", "c3", "Unknown_03", 0.9, None)], "media_id string, cluster_id string, speaker string, distance double, embedding array<float>")
    labelled = spark.createDataFrame([("m", "c1", "Zoe")], "media_id string, cluster_id string, name string")
    got = {x.cluster_id: (x.old, x.speaker, x.how) for x in speakers.rematch_unknowns(clusters, reg, labelled).collect()}
    assert got == {"c0": ("Unknown_01", "Ann", "auto"), "c1": ("Unknown_02", "Zoe", "manual"), "c2": ("Bob", "Bob", None), "c3": ("Unknown_03", "Unknown_03", None)}
    t = spark.createDataFrame([("m", 0, "Unknown_02", 0.7), ("n", 0, "Unknown_02", 0.7)], "media_id string, seq int, speaker string, distance double")
    m = spark.createDataFrame([("m", "Unknown_02", "Zoe", None)], "media_id string, old string, speaker string, distance double")
    assert sorted((x.media_id, x.speaker, x.distance, x.replaced) for x in speakers.relabel(t, m).collect()) == [("m", "Zoe", None, True), ("n", "Unknown_02", 0.7, False)]
    reps = spark.createDataFrame([("m", "c0", 1.0, 2.0), ("m", "c2", 1.0, 2.0)], "media_id string, cluster_id string, rep_start double, rep_end double")
    named = clusters.withColumn("candidates", F.lit(None).cast("map<string,double>"))
    assert [(x.label, x.clip) for x in sinks.unknown_cluster_manifest(named, reps).collect()] == [("Unknown_01", "clip_c0.wav")]


def test_a_named_voice_is_registered_before_the_others_are_matched(spark):
    reg = spark.createDataFrame([("Ann", 0, [1.0, 0.0, 0.0]), ("Zoe", 1, [0.0, 0.0, 1.0])], "speaker string, reg_order long, embedding array<float>")
    rows = [("m", "c0", [0.0, 1.0, 0.0]), ("m", "c1", [0.01, 1.0, 0.0]), ("m", "c2", [0.6, 0.6, 0.6]), ("m", "c3", None), ("n", "c0", [0.0, 0.9, 0.1]), ("n", "c1", [0.0, 0.1, 1.0]), ("n", "c2", [-1.0, -1.0, 0.0])]
    voices = spark.createDataFrame(rows, "media_id string, cluster_id string, embedding array<float>")
    named = speakers.identify(voices, reg, 0.05).join(voices, ["media_id", "cluster_id"])
    labelled = spark.createDataFrame([("m", "c0", "New")], "media_id string, cluster_id string, name string")
    whole = speakers.rematch_unknowns(named.drop("candidates"), reg, labelled, 0.05)
    merged = speakers.rematch_unknowns(named, reg, labelled, 0.05)
    got = {(x.media_id, x.cluster_id): (x.speaker, x.how) for x in merged.collect()}
    assert got[("m", "c1")] == ("New", "auto") and got[("n", "c0")] == ("New", "auto") and got[("m", "c0")] == ("New", "manual") and got[("n", "c1")] == ("Zoe", None)
    plain = lambda df: sorted((x.media_id, x.cluster_id, x.old, x.speaker, x.distance and round(x.distance, 9), x.how) for x in df.collect())
    assert plain(whole) == plain(merged)
    # A registered name given again is overwritten: distances to its old voice no longer count.
    again = spark.createDataFrame([("m", "c0", "Zoe")], "media_id string, cluster_id string, name string")
    for flow in (False, True):
        a, b = (plain(speakers.rematch_unknowns(x, reg, again, 0.05, flow)) for x in (named.drop("candidates"), named))
        assert a == b and {x[1:4] for x in a if x[0] == "m" and x[1] == "c1"} == {("c1", "Unknown_03", "Zoe")}
    manual = next(x for x in speakers.rematch_unknowns(named, reg, again, 0.05, True).collect() if x.how == "manual")
    assert abs(manual.distance) < 1e-9
    now = {x.speaker: (x.reg_order, x.embedding) for x in speakers.with_voices(reg, speakers.new_voices(named, again)).collect()}
    assert now == {"Ann": (0, [1.0, 0.0, 0.0]), "Zoe": (1, [0.0, 1.0, 0.0])}


def test_cache_and_registry(spark):
    f = spark.createDataFrame([("n", "a", bytearray(b"1")), ("n", "b", bytearray(b"1")), ("n", "c", bytearray(b"2")), ("o", "d", bytearray(b"1"))], "namespace string, path string, content binary")
    cache = f.where("path = 'c'").select("namespace", F.sha2("content", 256).alias("content_sha256"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    hits, misses = speakers.missing_embeddings(f, cache)
    assert [x.path for x in hits.collect()] == ["c"] and sorted(x.path for x in misses.collect()) == ["a", "d"]
    assert speakers.compute_embeddings(misses, lambda c: [np.ones(2) for _ in c]).count() == 2
    old = spark.createDataFrame([("d", "Ann", 1), ("d", "Bob", 1)], "db string, speaker string, embedding int")
    new = spark.createDataFrame([("d", " Ann ", 2, 0), ("d", "Ann", 3, 1), ("d", "x/y", 9, 2)], "db string, speaker string, embedding int, seq int")
    assert sorted((x.speaker, x.embedding) for x in speakers.upsert_voiceprints(old, new).collect()) == [("Ann", 3), ("Bob", 1)]
    with pytest.raises(ValueError):
        speakers.rename_speaker(old, "d", "Ann", "Bob")
    assert {x.speaker for x in speakers.rename_speaker(old, "d", "Ann", "Cid").collect()} == {"Cid", "Bob"}


def test_stored_vectors_are_computed_once(spark, tmp_path):
    f = spark.createDataFrame([("n", "d", "Ann", "a", bytearray(b"12")), ("n", "d", "Bob", "b", bytearray(b"12")), ("", "d", "Cid", "c", bytearray(b"12")), ("n/1", "d", "Dan", "e", bytearray(b"3"))], "namespace string, db string, speaker string, path string, content binary")
    embed = lambda c: [[float(len(x)), 1.0] for x in c]
    store = EmbeddingStore(str(tmp_path / "store"))
    assert store.read(spark).isEmpty()
    first, computed = jobs.build_registry_from_store(f.where("speaker <> 'Dan'"), store, embed)
    assert computed == 2 and first.count() == 3  # equal contents of a namespace once, and once for the empty namespace
    assert jobs.build_registry_from_store(f, store, embed)[1] == 1
    batches = store.batches()

    def fails(contents):
        raise RuntimeError("no vector should be computed")

    again, computed = jobs.build_registry_from_store(f, store, fails)
    assert computed == 0 and {x.speaker: [round(y, 6) for y in x.embedding] for x in again.collect()} == {**{s: [0.894427, 0.447214] for s in ("Ann", "Bob", "Cid")}, "Dan": [0.707107, 0.707107]}
    # A run that fails leaves nothing that is read, nor does a batch that was never published.
    with pytest.raises(Exception, match="no vector"):
        jobs.build_registry_from_store(f.withColumn("content", F.lit(b"new")), store, fails)
    (tmp_path / "store" / "batch=lost").mkdir()
    assert store.batches() == batches
    store.add(store.read(spark, ["n/1"]))  # as if two runs had added it at once
    assert store.read(spark).count() == 3 and [x.namespace for x in store.read(spark, ["n/1"]).collect()] == ["n/1"]


def test_hallucinations_remember_what_was_accepted(spark):
    said = ["はい。", "はい", "おわり", "はい！", " ", "。。", "別", "はい", "ハイハイハイ", "はい", None]
    rows = spark.createDataFrame([(m, i, 0.0, 1.0, t) for m in "ab" for i, t in enumerate(said)], SEG)
    phrases = spark.createDataFrame([("おわり",)], "phrase string")
    got = [x.reason for x in cleaning.mark_hallucinations(rows, phrases).where("media_id = 'a'").orderBy("seq").collect()]
    assert got == [None, "duplicate", "phrase", "duplicate", "blank", None, None, None, "repeat", "duplicate", "blank"]


# ---- figures and clips


def test_variables_and_overlap(spark):
    rows = [("m", 1, 0.0, 2.0, ["A"], "x"), ("m", 2, 2.0, 3.0, [], "y"), ("m", 3, 3.0, 4.0, ["A"], ""), ("m", 4, 4.0, 6.0, ["B", "A"], "z"), ("m", 5, 6.0, 7.0, [], ""), ("n", 1, 5.0, 4.0, ["A"], "x")]
    d = spark.createDataFrame([("m", 60.0), ("n", 0.0), ("o", 9.0)], "media_id string, duration double")
    got = {x.media_id: x for x in stats.clip_variables(spark.createDataFrame(rows, ENTRY), ["media_id"], d).collect()}
    m = got["m"]
    assert (m.utterance_count, m.speaker_count, m.speaker_change_count, m.speaker_change_per_min, m.overlap_entry_ratio) == (4, 2, 1, 1.0, 0.25) and abs(m.speech_time_ratio - 0.1) < 1e-9
    assert [tuple(c) for c in m.utterance_counts] == [("A", 3), ("B", 1)]
    assert got["n"].speech_time_ratio == 0 and got["o"].utterance_count == 0
    turns = spark.createDataFrame([("m", 0, "a", 0.0, 3.0), ("m", 1, "b", 2.0, 5.0), ("n", 0, "a", 1.0, 1.0)], TURN)
    assert {x.media_id: x.overlap_time_ratio for x in stats.overlap_time_ratio(turns).collect()} == {"m": 0.2, "n": 0.0}


def test_overlap_ratio_is_the_same_in_any_stretches(spark):
    r = random.Random(8)
    turns = [("ab"[n % 2], n, "c", s := r.randrange(0, 400) / 10, s + r.choice([0, 0.1, 2.5, 20, 90])) for n in range(60)] + [("c", 0, "c", 5.0, 5.0), ("d", 0, "c", 0.0, 36000.0), ("d", 1, "c", 9000.0, 18000.0), ("d", 2, "c", 36500.0, 36600.0)]
    want = {}
    for m in "abcd":
        ms = lambda x: round(x * 10)
        depth = [0] * 370_000
        for _, _, _, s, e in (t for t in turns if t[0] == m):
            for i in range(ms(s), ms(e)):
                depth[i] += 1
        one = sum(d >= 1 for d in depth)
        want[m] = round(sum(d >= 2 for d in depth) / one, 9) if one else 0.0
    for stretch in (0.7, 13.0, 600.0, 1e6):
        assert {x.media_id: round(x.overlap_time_ratio, 9) for x in stats.overlap_time_ratio(spark.createDataFrame(turns, TURN), stretch).collect()} == want


def test_clip_pairs_match_exhaustive_search(spark):
    r = random.Random(4)
    rows = []
    for m in "abc":
        t = 0.0
        for i in range(120):
            length = r.randrange(5, 60) / 10
            rows.append((m, i + 1, t, t + length, r.sample("ABCD", r.randrange(0, 3)), "x" if r.random() < 0.8 else ""))
            t += length + r.randrange(0, 10) / 10
    e = spark.createDataFrame(rows, ENTRY)
    o = clips.ClipOptions(length=30.0, tolerance=3.0, target_speakers=2)
    out = jobs.select_clips(e, o)
    windows = [x for x in out["windows"].collect()]
    for m in "abc":
        speech = [x for x in rows if x[0] == m and (x[4] or x[5])]
        ends = sorted({x[3] for x in speech})
        want = [(x[2], end) for x in speech for end in [next((b for b in ends if b >= x[2] + 30 - 1e-6), None)] if end is not None and abs(end - x[2] - 30) <= 3]
        mine = sorted([w for w in windows if w.media_id == m], key=lambda w: w.window_no)
        assert [(w.start, w.end) for w in mine] == want
        best, pick = -1.0, None
        for i in range(len(mine)):
            for j in range(i + 1, len(mine)):
                a, b = mine[i], mine[j]
                if not (a.start < b.end - 1e-6 and b.start < a.end - 1e-6) and abs(a.score - b.score) > best:
                    best, pick = abs(a.score - b.score), (a.window_no, b.window_no) if a.score >= b.score else (b.window_no, a.window_no)
        got = next(x for x in out["pairs"].collect() if x.media_id == m)
        assert abs(got.difference - best) < 1e-9 and (got.hard, got.calm) == pick
    assert out["report"].count() == 6 and out["cuts"].count() == 6 and out["entries"].where("start < 0").count() == 0


def test_window_figures_match_members(spark):
    r = random.Random(11)
    rows = []
    for m in "abcd":
        t = 0.0
        for i in range(150):
            start, length = round(t, 2), r.choice([0.0, 1.0, 2.5, 7.0, 45.0, -3.0, -400.0] if m == "b" else [0.5, 2.0, 5.0])
            rows.append((m, i + 1 if m != "c" else 1000 - i, start, round(start + length, 2), [r.choice(["A", " A", "B", "", "C"]) for _ in range(r.randrange(0, 4))], r.choice(["x", "", " "])))
            t += r.choice([0.0, 0.3, 2.0])
    rows += [("a", 999, None, 5.0, ["A"], "x"), ("a", 998, 5.0, None, ["A"], "x")]
    e, o = spark.createDataFrame(rows, ENTRY), clips.ClipOptions(length=20.0, tolerance=8.0)
    windows = clips.enumerate_windows(e, o)
    d = windows.select("media_id", "window_no", (F.col("end") - F.col("start")).alias("duration"))
    # Membership as it is said: every entry against every window of its recording.
    held = windows.withColumnsRenamed({"start": "w_start", "end": "w_end"}).join(e, "media_id").where("start >= w_start - 1e-6 and end <= w_end + 1e-6")
    want = {(x.media_id, x.window_no): x for x in stats.clip_variables(held, ["media_id", "window_no"], d).collect()}
    got = clips.window_variables(windows, e, o).collect()
    assert len(got) == len(want) > 200
    for x in got:
        w = want[x.media_id, x.window_no]
        for name in ("utterance_count", "speaker_count", "speaker_change_count", "overlap_entry_count"):
            assert x[name] == w[name], (name, x)
        assert abs(x.speech_time_ratio - w.speech_time_ratio) < 1e-9 and x.duration == w.duration
    assert clips.window_variables(windows.limit(0), e, o).count() == 0


# ---- scripts


def test_ngrams(spark):
    rows = [("m", i, s, t) for i, (s, t) in enumerate([("A", "a"), ("A", "b"), ("B", "c")])] + [("n", 7, "A", "z")]
    df = spark.createDataFrame(rows, "media_id string, id int, speaker string, dialogue string")
    got = [(x.ngram_id, x.n, x.start_index, x.end_index, x.original_ids, x.text) for x in matching.ngrams(df, "dialogue", 3, by_speaker=True).where("media_id = 'm'").orderBy("ngram_id").collect()]
    assert got == [(0, 1, 0, 0, [0], "a"), (1, 1, 1, 1, [1], "b"), (2, 1, 2, 2, [2], "c"), (3, 2, 0, 1, [0, 1], "a b")]
    assert matching.ngrams(df, "dialogue", 0).count() == 0


def plain_chain(f):
    w, n = f["weighted_similarity"].tolist(), len(f)
    low, high = f[["start_time", "end_time"]].min(axis=1).tolist(), f[["start_time", "end_time"]].max(axis=1).tolist()
    best, back = list(w), [-1] * n
    for i in range(n):
        for j in range(i):
            if f["script_end"][j] < f["script_start"][i] and high[j] <= low[i] and best[j] + w[i] > best[i]:
                best[i], back[i] = best[j] + w[i], j
    at, out = max(range(n), key=lambda i: (best[i], -i)), []
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def random_candidates(r, n):
    f = pd.DataFrame([{"weighted_similarity": r.randrange(-3, 9) / 4, "script_start": (s := r.randrange(6)), "script_end": s + r.randrange(-1, 3), "start_time": float(r.randrange(8)), "end_time": float(r.randrange(8))} for _ in range(n)])
    return f.sort_values("script_start", kind="stable").reset_index(drop=True)


def test_best_chain_matches_quadratic_search():
    r = random.Random(8)
    for _ in range(400):
        f = random_candidates(r, r.randrange(1, 14))
        low, high = f[["start_time", "end_time"]].min(axis=1), f[["start_time", "end_time"]].max(axis=1)
        rows = list(zip(f.index, f["script_start"], f["script_end"], low, high, f["weighted_similarity"], strict=True))
        for size in (1, 3, 14):  # handed on after every so many rows
            frontier, back = chains.Frontier(), []
            for a in range(0, len(rows), size):
                frontier = pickle.loads(pickle.dumps(frontier))
                back += frontier.follow(rows[a : a + size])
            at, got = frontier.best[1], []
            while at >= 0:
                got.append(at)
                at = back[at]
            assert got[::-1] == plain_chain(f)


@pytest.mark.parametrize("block", [1, 2, 100])
def test_chains_over_blocks_match_quadratic_search(spark, block):
    r, frames, want = random.Random(block), [], []
    for m in range(6):
        f = random_candidates(r, (1, 40, 60, 25, 60, 2)[m]).assign(media_id=f"m{m}", stt_start=lambda x: range(len(x)), similarity=1.0, script_ngram_id=0, rank=0)
        frames.append(f)
        want += [(f"m{m}", i, k) for k, i in enumerate(plain_chain(f))]
    df = spark.createDataFrame(pd.concat(frames)).repartition(3)
    assert sorted((x.media_id, x.stt_start, x.chain_no) for x in chains.weighted_chain(df, block).collect()) == sorted(want)
    assert chains.weighted_chain(df.limit(0), block).count() == 0


def test_knn_matches_plain_and_breaks_ties_by_id(spark):
    r = np.random.default_rng(2)
    kind = "media_id string, ngram_id long, vec array<double>"
    q = [("ab"[i % 2], i, r.integers(0, 3, 4).astype(float).tolist()) for i in range(20)]
    x = [("ab"[i % 2], i, r.integers(0, 3, 4).astype(float).tolist()) for i in range(30)]
    got = matching.knn_join(spark.createDataFrame(q, kind), spark.createDataFrame(x, kind), 3, block=4).collect()
    for m, i, v in q:
        want = sorted(((-np.dot(v, u), j) for mm, j, u in x if mm == m))[:3]
        assert [(g.stt_ngram_id, g.similarity) for g in sorted(got, key=lambda g: g.rank) if g.media_id == m and g.script_ngram_id == i] == [(j, -s) for s, j in want]


def test_correspondence_order_and_times(spark):
    script = spark.createDataFrame([("m", i, f"S{i}", f"line {i}") for i in range(5)] + [("n", 0, "A", "only")], "media_id string, id int, speaker string, dialogue string")
    stt = spark.createDataFrame([("m", 0, 1.0, 2.0, "one", ""), ("m", 1, 2.5, 3.0, "noise", "N"), ("m", 2, 8.0, 9.0, "three", "")], "media_id string, id int, start double, end double, text string, stt_speaker string")
    a, b = matching.ngrams(script, "dialogue", 1, by_speaker=True), matching.ngrams(stt, "text", 1, timed=True)
    chosen = spark.createDataFrame([("m", 1, 0, 1.0, 1, 1), ("m", 4, 2, 1.0, 1, 1)], "media_id string, script_ngram_id int, stt_ngram_id int, similarity double, script_n int, stt_n int")
    matched = matching.matched_rows(chosen, a, b, stt)
    rows = [(x.media_id, x.type, x.script_start_id, x.start_time, x.end_time) for x in matching.correspondence(matched, script, stt).orderBy("media_id", "row_no").collect()]
    assert rows == [
        ("m", "Unmatched_Script", 0, "00:00:00,000", "00:00:01,000"),
        ("m", "Matched", 1, "00:00:01,000", "00:00:02,000"),
        ("m", "Unmatched_STT", None, "00:00:02,500", "00:00:03,000"),
        ("m", "Unmatched_Script", 2, "00:00:03,000", "00:00:05,500"),
        ("m", "Unmatched_Script", 3, "00:00:05,500", "00:00:08,000"),
        ("m", "Matched", 4, "00:00:08,000", "00:00:09,000"),
        ("n", "Unmatched_Script", 0, "00:00:00,000", "00:00:00,000"),
    ]
    use = {x.media_id: (x.matches, x.script_used, x.script_total, x.stt_percent) for x in matching.usage_stats(matched, script, stt).collect()}
    assert use["m"][:3] == (2, 2, 5) and use["n"] == (0, 0, 1, 0.0)


def test_match_script_finds_its_own_lines(spark):
    script = spark.createDataFrame([("m", i, "AB"[i // 3], t) for i, t in enumerate(["good morning", "how are you", "fine thanks", "and the weather", "it rains", "goodbye"])], "media_id string, id int, speaker string, dialogue string")
    stt = script.where("id <> 3").select("media_id", F.when(F.col("id") > 3, F.col("id") - 1).otherwise(F.col("id")).alias("id"), (F.col("id") * 2.0).alias("start"), (F.col("id") * 2.0 + 1).alias("end"), F.col("dialogue").alias("text"), F.lit("").alias("stt_speaker"))
    out = jobs.match_script(script, stt)
    assert {i for r in out["matched"].collect() for i in r.script_ids} >= {0, 1, 2, 4, 5}
    doc = jobs.export_subtitles(out["table"]).collect()[0].document
    assert doc.startswith("1\n00:00:00,000 --> ") and "(A)good morning" in doc and "(B)" in doc


# ---- evaluation


def test_pairing(spark):
    assert evaluation.pair_keys(["a", "b"], ["a", "x", "b"], 0.6) == [(0, 0), (None, 1), (1, 2)]
    assert evaluation.pair_keys(["hello there", "zzz"], ["hello theme", "hello there!"], 0.6) == [(0, 1), (1, None), (None, 0)]
    assert evaluation.pair_keys([], ["a"], 0.6) == [(None, 0)]


def test_evaluation_report(spark):
    ref = spark.createDataFrame([("m", 1, 0.0, 1.0, ["A"], "hi"), ("m", 2, 1.0, 2.0, [], "you"), ("m", 3, 2.0, 3.0, ["B"], "bye"), ("m", 4, 3.0, 4.0, ["C"], "gone"), ("n", 1, 0.0, 1.0, ["A"], "alone")], ENTRY)
    gen = spark.createDataFrame([("m", 1, 0.2, 1.0, ["A"], "hi"), ("m", 2, 1.8, 2.0, ["Unknown_01"], "you"), ("m", 3, 2.0, 3.0, ["A"], "bye"), ("m", 4, 3.0, 4.0, [], ""), ("n", 1, 0.0, 1.0, ["A"], "else!")], ENTRY)
    out = jobs.evaluate_subtitles(ref, gen, spark.createDataFrame([("A",)], "speaker string"), (0.3, 1.0))
    s = {x.media_id: x for x in out["report"].collect()}
    m = s["m"]
    assert (m.matched_count, m.unmatched_gt_count, m.unmatched_app_count, m.correct_count, m.false_negative_count, m.false_positive_count) == (3, 1, 0, 1, 1, 1)
    assert m.in_point_accuracies == {0.3: 0.6667, 1.0: 1.0} and (m.registered_speaker_count, m.unregistered_speaker_count) == (1, 2)
    assert (s["n"].matched_count, s["n"].unmatched_gt_count, s["n"].unmatched_app_count, s["n"].speaker_accuracy) == (0, 1, 1, 0.0)
    nobody = evaluation.with_registration(spark.createDataFrame([("A",)], "gt_speaker string"), spark.createDataFrame([], "speaker string"))
    assert nobody.first().registered


# ---- documents


def test_prefix_resets_after_a_blank_row(spark):
    rows = [("m", i, "00:00:00,000", "00:00:01,000", s, t) for i, (s, t) in enumerate([("A", "1"), ("A", "2"), ("", "3"), ("A", "4"), ("B", ""), ("B", " "), ("B", "5")])]
    doc = sinks.render_subtitles(spark.createDataFrame(rows, "media_id string, row_no int, start_time string, end_time string, speaker string, subtitle_text string")).first().document
    assert [x.split("\n")[2] for x in doc.strip().split("\n\n")] == ["(A)1", "2", "3", "(A)4", "(B) ", "5"]  # white space alone is content, no text at all is not


def test_files_that_go_out(spark, tmp_path):
    segs = spark.createDataFrame([("m", 0, 0.0, 1.5, 'say "x"'), ("m", 1, 5.0, 6.0, "later")], SEG)
    turns = spark.createDataFrame([("m", 0, "c0", 0.0, 2.0)], TURN)
    out = jobs.build_transcripts(segs, turns, None, None, spark.createDataFrame([("none",)], "phrase string"))
    recordings = spark.createDataFrame([("m",), ("silent",)], "media_id string")
    sinks.write_transcript_csv(out["transcript"], str(tmp_path / "t"), recordings)
    text = (tmp_path / "t" / "m.csv").read_text("utf-8-sig")
    assert (tmp_path / "t" / "silent.csv").read_text("utf-8-sig") == '"start","end","speaker","text","cosine_distance"\n'
    assert text.splitlines()[0] == '"start","end","speaker","text","cosine_distance"' and '"Unknown_01"' in text and '"Unknown"' in text
    assert out["rttm"].first().document == "SPEAKER m 1 0.000 2.000 <NA> <NA> Unknown_01 <NA> <NA>\n"
    assert '"num_speakers":1' in sinks.recording_document(out["segments"], speakers.representative_segment(turns)).first().document
    sinks.append_metrics(turns.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    sinks.append_metrics(turns, str(tmp_path / "m"))
    sinks.append_metrics(turns, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    for run in ("7", "8", "8"):
        sinks.append_metrics(turns, str(tmp_path / "runs"), run)
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2
    for clash in (turns.drop("end"), turns.withColumn("more", F.lit(1)), turns.withColumn("end", F.col("end").cast("string"))):
        with pytest.raises(ValueError, match="the table has"):
            sinks.append_metrics(clash, str(tmp_path / "runs"), "9")
    with pytest.raises(ValueError, match="the table has"):
        sinks.append_metrics(turns, str(tmp_path / "runs"))


def test_recordings_without_usable_rows_have_empty_documents(spark):
    recordings = spark.createDataFrame([("m",), ("blank",), ("none",)], "media_id string")
    rows = spark.createDataFrame([("m", 0, "00:00:01:000", "00:00:02:000", "A", "hi"), ("blank", 0, "00:00:01:000", "00:00:02:000", "A", " ")], "media_id string, seq int, start string, end string, speaker string, text string")
    assert {x.media_id: x.document for x in sinks.render_transcript_srt(rows, recordings).collect()} == {"m": "1\n00:00:01,000 --> 00:00:02,000\n[A] hi\n", "blank": "", "none": ""}
    assert {x.media_id for x in sinks.render_transcript_srt(rows).collect()} == {"m", "blank"}
    edited = rows.selectExpr("media_id", "seq as row_no", "start as start_time", "end as end_time", "speaker", "nullif(text, ' ') as subtitle_text")
    assert {x.media_id: x.document for x in sinks.render_subtitles(edited, recordings=recordings).collect()} == {"m": "1\n00:00:01:000 --> 00:00:02:000\n(A)hi\n", "blank": "", "none": ""}
    turns = spark.createDataFrame([("m", 0, "c0", 0.0, 2.0), ("m", 1, "c1", 1.0, 2.0)], TURN)
    got = {x.media_id: x.document for x in sinks.render_rttm(turns, turns.selectExpr("media_id", "cluster_id", "upper(cluster_id) as speaker"), recordings).collect()}
    assert got == {"m": "SPEAKER m 1 0.000 2.000 <NA> <NA> C0 <NA> <NA>\nSPEAKER m 1 1.000 1.000 <NA> <NA> C1 <NA> <NA>\n", "blank": "", "none": ""}


def test_document_files_are_published_whole_or_not_at_all(spark, tmp_path):
    from dialoglake.sources.documents import write_documents

    def docs(*rows):
        return spark.createDataFrame(list(rows), "media_id string, document string").repartition(3)

    def there():
        return {p.name: p.read_text() for p in (tmp_path / "d").rglob("*") if p.is_file()}

    path = str(tmp_path / "d")
    write_documents(docs(("a", "1\n"), ("b", None), ("c d", "é")), path, "srt")
    first = {"a.srt": "1\n", "b.srt": "", "c d.srt": "é"}
    assert there() == first
    with pytest.raises(Exception, match="already"):
        write_documents(docs(("z", "x"), ("a", "2")), path, "srt")
    with pytest.raises(Exception, match="two documents"):
        write_documents(docs(("y", "1"), ("y", "2")), path, "srt", overwrite=True)
    for bad in ("x/y", ".hidden", "", None, " a"):
        with pytest.raises(Exception, match="can't name"):
            write_documents(docs(("ok1", "1"), ("ok2", "1"), (bad, "1")), path, "srt")
    # A task that fails after others have written leaves nothing behind.
    broken = docs(*[(f"n{i}", "x") for i in range(30)]).withColumn("document", F.when(F.col("media_id") == "n17", F.raise_error(F.lit("boom"))).otherwise(F.col("document")))
    with pytest.raises(Exception, match="boom"):
        write_documents(broken, path, "srt")
    assert there() == first and [p.name for p in (tmp_path / "d").iterdir() if p.is_dir()] == []
    write_documents(docs(("a", "2"), ("e", "5")), path, "rttm")
    write_documents(docs(("a", "3")), path, "srt", overwrite=True, bom=True)
    assert there() == {"a.srt": "\ufeff3", "a.rttm": "2", "e.rttm": "5"}
    from dialoglake.sources import files

    write_documents(docs(("empty", None)), path, "rttm")
    assert {x.media_id: x.document for x in files.read_documents(spark, path, "rttm").collect()} == {"a": "2", "e": "5", "empty": ""}
    assert files.read_documents(spark, path, "srt").first().document == "3"


def test_every_benchmark_line_is_a_phrase(spark, sf, tmp_path):
    from dialoglake.plans import catalog

    spark.createDataFrame([(10, "first of ten\nlater of ten"), (11, "first of eleven\nlater of eleven")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    lines = ["first of ten", "later of ten", "first of eleven", "later of eleven", "something else"]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.text: x.reason for x in catalog.QUERIES["f6_w3_hallucinations_whole"](spark, str(tmp_path)).collect()}
    assert got == {x: "phrase" for x in lines[:4]} | {"something else": None}


def test_clips_without_row_caps(spark, sf):
    from dialoglake.plans import catalog
    from dialoglake.sources import adapters

    rows = adapters.entries(spark, sf).select("media_id", "entry_no", "start", "end").collect()
    docs = catalog.QUERIES["snk5_clip_srt_whole"](spark, sf).collect()
    assert sum(x.document.count(" --> ") for x in docs) == len(rows) > 50 * len(docs) * 0.5
    assert max(x.document.count(" --> ") for x in docs) > 50 or max(r.entry_no for r in rows) <= 50
    windows = catalog.QUERIES["j7_windows"](spark, sf).collect()
    want = {(w.media_id, w.window_no): sum(r.media_id == w.media_id and r.start >= w.start - 1e-6 and r.end <= w.end + 1e-6 for r in rows) for w in windows}
    got = {}
    for x in catalog.QUERIES["f9_f10_shift_and_cut_whole"](spark, sf).collect():
        got[x.media_id, x.window_no] = got.get((x.media_id, x.window_no), 0) + 1
    assert got == want and max(w for _, w in want) > 1


# ---- what the rules say at their edges


def test_ratio_of_long_texts_leaves_out_frequent_characters():
    import difflib

    ours, theirs = "abcdefgh " * 34, "abcdxfgh " * 20 + "hgfe dcba " * 13
    plain = difflib.SequenceMatcher(a=ours, b=theirs).ratio()
    assert abs(plain - difflib.SequenceMatcher(a=ours, b=theirs, autojunk=False).ratio()) > 0.05
    assert evaluation.pair_keys([ours], [theirs], plain) == [(0, 0)]
    assert evaluation.pair_keys([ours], [theirs], plain + 1e-6) == [(0, None), (None, 0)]


def plain_pairs(ours, theirs, least):
    import difflib

    out = []
    for tag, i0, i1, j0, j1 in difflib.SequenceMatcher(a=ours, b=theirs, autojunk=False).get_opcodes():
        free = list(range(j0, j1))
        taken = -1
        for i in range(i0, i1):
            if tag == "equal":
                out.append((i, j0 + i - i0))
                continue
            scored = [(difflib.SequenceMatcher(a=ours[i], b=theirs[j]).ratio(), j) for j in free if j > taken]
            best = max((s for s in scored if s[0] >= least), default=None)
            out.append((i, best and best[1]))
            taken = best[1] if best else taken
        used = {j for _, j in out if j is not None}
        out += [(None, j) for j in free if j not in used]
    return out


def test_pairing_matches_plain_search():
    r = random.Random(11)
    for _ in range(60):
        texts = ["".join(r.choice("ab cd") for _ in range(r.choice([0, 3, 8, 260]))) for _ in range(12)]
        ours, theirs = ([r.choice(texts)[: r.choice([2, 6, 300])] for _ in range(r.randrange(8))] for _ in range(2))
        assert evaluation.pair_keys(ours, theirs, 0.6) == plain_pairs(ours, theirs, 0.6)


def test_registry_loses_no_voice_to_an_empty_block(spark, monkeypatch):
    monkeypatch.setattr(speakers, "REGISTRY_BLOCK", 3)
    reg = spark.createDataFrame([("one", i, [float(i + 1), 1.0]) for i in range(40)], "speaker string, reg_order long, embedding array<double>")
    clusters = spark.createDataFrame([("m", f"c{i}", [float(i + 1), 1.0]) for i in range(40)], "media_id string, cluster_id string, embedding array<double>")
    got = speakers.identify(clusters, reg, 0.0001).collect()
    assert len(got) == 40 and {x.speaker for x in got} == {"one"} and all(x.distance < 1e-9 for x in got)


def test_transcripts_of_blank_and_null_speakers(spark):
    rows = [("m", 0, "00:00:01:000", "00:00:02:000", " ", " a "), ("m", 1, "00:00:03:000", "00:00:04:000", None, "b"), ("m", 2, "00:00:03:000", "00:00:04:000", "x", "  "), ("m", 3, " ", "00:00:04:000", "x", "c"), ("m", 4, "00:00:05:000", "00:00:06:000", " x ", "d")]
    doc = sinks.render_transcript_srt(spark.createDataFrame(rows, "media_id string, seq int, start string, end string, speaker string, text string")).first().document
    assert [b.split("\n")[0::2] for b in doc.strip().split("\n\n")] == [["1", "a"], ["2", "b"], ["3", "[x] d"]]


def test_clip_text_put_together_has_no_sounds(spark):
    rows = [("m", 1, 0.0, 1.0, ["A"], ["bell"], "hi", ""), ("m", 2, 1.0, 2.0, [], ["bell"], None, None), ("m", 3, 2.0, 3.0, ["A"], [], "x", "raw")]
    df = spark.createDataFrame(rows, "media_id string, index int, start double, end double, speakers array<string>, non_speech_labels array<string>, body string, raw_text string")
    times = [f"{i}\n00:00:0{i - 1},000 --> 00:00:0{i},000\n" for i in (1, 2, 3)]
    assert sinks.render_clip_srt(df).first().document == f"{times[0]}（A）hi\n\n{times[1]}\n\n{times[2]}raw\n"


def test_recordings_without_a_window_are_told(spark):
    rows = [("long", i, 10.0 * i, 10.0 * i + 10, ["A" if i % 3 else "B"], "x") for i in range(40)] + [("short", 1, 0.0, 5.0, ["A"], "x")]
    pairs = jobs.select_clips(spark.createDataFrame(rows, ENTRY), clips.ClipOptions(length=60.0, tolerance=5.0))["pairs"]
    assert {x.media_id: x.status for x in pairs.collect()} == {"long": "ok", "short": "no window"}


def test_voice_files_with_problems_are_errors(spark):
    import pytest

    from dialoglake.sources import files

    def scan(*paths):
        return files.checked_voice_files(spark.createDataFrame([(p, 1, None) for p in paths], "path string, length long, modificationTime timestamp")).collect()

    assert [x.speaker for x in scan("file:/v/db/ann.wav", "file:/v/db/note.txt")] == ["ann"]
    for bad in (("file:/v/db/note.txt",), ("file:/v/db/ann.wav", "file:/v/db/ann.mp3"), ("file:/v/db/.wav",)):
        with pytest.raises(ValueError):
            scan(*bad)


def test_confusion_is_ranked(spark):
    df = spark.createDataFrame([("m", "a", "b")] * 2 + [("m", "a", "a"), ("m", "b", "b")], "media_id string, gt_speaker string, app_speaker string")
    assert [(x.gt_speaker, x.app_speaker) for x in evaluation.confusion(df).orderBy("rank").collect()] == [("a", "b"), ("a", "a"), ("b", "b")]


def test_encoder_matches_plain_hashing():
    texts = ["", "a", "ab", "abc", "日本語 text", "x" * 50, "😀é"]
    for row, text in zip(matching.hashed_trigrams(texts), texts, strict=True):
        want = [0] * matching.DIM
        for n in (1, 2, 3):
            for i in range(len(text) - n + 1):
                h = 0
                for c in text[i : i + n]:
                    h = (h * 1_000_003 + ord(c) + n) & 0x7FFFFFFF
                want[h % matching.DIM] += 1
        assert row.tolist() == want


# ---- scans


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_scans_match_plain_in_any_parts(spark, size):
    r = random.Random(size)
    rows = [(r.choice([None, "a", "b"]), i, r.choice([None, r.randint(-5, 5)])) for i in range(80)]
    df = spark.createDataFrame(rows, "media_id string, n int, v int")
    v = F.col("v")
    for back in (False, True):
        found = {"nearest": ("last", v), "next": ("next", v), "total": ("sum", v), "least": ("min", v), "most": ("max", F.when(v.isNotNull(), F.struct(v.alias("a"), "n")))}
        got = {(x.media_id, x.n): (x.nearest, x.next, x.total, x.least, x.most["a"] if x.most else None) for x in scans.scan(df, F.floor(F.col("n") / size), [F.col("n")], found, back=back).collect()}
        want = {}
        for m, n, _ in rows:
            after = [w for k, j, w in rows if k == m and j > n and w is not None]
            before = after[::-1] if back else [w for k, j, w in rows if k == m and j < n and w is not None]
            want[m, n] = (before[-1] if before else None, after[0] if after else None, sum(before), min(before, default=None), max(before, default=None))
        assert got == want
    assert scans.scan(df.limit(0), F.col("n"), [F.col("n")], {"x": ("last", v)}).isEmpty()
    placed = {(x.media_id, x.n): x.at for x in scans.number(df, F.floor(F.col("n") / size), [F.col("n")], "at").collect()}
    assert placed == {(m, n): sum(k == m and j <= n for k, j, _ in rows) for m, n, _ in rows}


def test_tables_are_the_same_in_small_parts(spark, monkeypatch):
    r = random.Random(3)
    entries = spark.createDataFrame([("ab"[n % 2], n, float(n), n + 1.0, [s] if (s := r.choice(["", "X", "Y"])) else [], "t") for n in range(60)], ENTRY)
    lines = spark.createDataFrame([("ab"[n % 2], n, float(n), n + 1.0, r.choice(["one", "two", "", "..."])) for n in range(60)], SEG)
    script = spark.createDataFrame([("m", n, "S", f"line number {n}") for n in range(30)], "media_id string, id int, speaker string, dialogue string")
    heard = spark.createDataFrame([("m", n, 2.0 * n, 2.0 * n + 1, f"line number {n}", "") for n in range(3, 24) if n % 5 < 3], "media_id string, id int, start double, end double, text string, stt_speaker string")
    phrases = spark.createDataFrame([("nothing",)], "phrase string")

    def results():
        tables = [evaluation.fill_omitted_speakers(entries), cleaning.mark_hallucinations(lines, phrases), stats.speaker_changes(entries, ["media_id"])]
        matched = spark.createDataFrame([("m", "Matched", n, n, "S", f"line number {n}", n, n, "", f"line number {n}", f"00:00:{2 * n:02d},000", f"00:00:{2 * n + 1:02d},000", "S", "x", [n], [n]) for n in (3, 5, 6, 12, 20)], "media_id string, type string, script_start_id int, script_end_id int, script_speaker string, script_dialogue string, stt_start_id int, stt_end_id int, stt_speaker string, stt_text string, start_time string, end_time string, speaker string, subtitle_text string, script_ids array<int>, stt_ids array<int>")
        return [sorted(map(repr, t.collect())) for t in [*tables, matching.correspondence(matched, script, heard)]]

    whole = results()
    monkeypatch.setattr(scans, "PLACES", 2)
    monkeypatch.setattr(scans, "STRETCH", 5.0)
    assert results() == whole and all(whole)


def test_distances_equal_when_rounded_go_to_the_voice_registered_first(spark):
    from dialoglake.operators import voices as near

    angle = [2e-5, 1e-5]  # distances of 2e-10 and 5e-11: equal at 9 places, not at 12
    registry = spark.createDataFrame([("late", 2, [float(np.cos(angle[1])), float(np.sin(angle[1]))]), ("early", 1, [float(np.cos(angle[0])), float(np.sin(angle[0]))]), ("far", 3, [0.0, 1.0])], "speaker string, reg_order long, embedding array<double>")
    clusters = spark.createDataFrame([(1, "c", [1.0, 0.0])], "media_id long, cluster_id string, embedding array<double>")
    got = {p: [c.speaker for c in near.nearest_voices(clusters, registry, 1, places=p).first().candidates] for p in (9, 12)}
    assert got == {9: ["early"], 12: ["late"]}


@pytest.mark.parametrize("name", ["job1_build_transcripts", "snk8_recording_document", "j2_resolved_transcript"])
def test_queries_on_overlaps_join_no_pairs(spark, sf, name):
    from dialoglake.plans import catalog

    # Segments and turns would meet in a join on these.
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "mapinarrow" in plan.lower() and "inside#" not in plan and "bin#" not in plan
