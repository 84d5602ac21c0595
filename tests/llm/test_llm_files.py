"""Token files, importance resampling and hard negatives against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dialoglake.llm import importance, negatives, rans, token_files
from dialoglake.llm import queries as q

TEXTS = "doc_id long, text string"


# ---- token files


@pytest.mark.parametrize("vocabulary, skew", [(49408, 0.05), (3, 1.0), (1, 1.0), (2**20, 0.001)])
def test_coder_round_trip_and_size(vocabulary, skew):
    r = np.random.default_rng(vocabulary)
    odds = r.dirichlet(np.full(vocabulary, skew))
    ids = r.choice(vocabulary, rans.BLOCK * 2, p=odds).astype("u4")
    counts = np.bincount(ids, minlength=vocabulary)
    freq = rans.frequencies(counts)
    assert freq.sum() == 2**rans.SCALE and ((freq > 0) == (counts > 0)).all()
    table = rans.Table(freq)
    coded = rans.encode(ids.reshape(2, -1, rans.LANES), table)
    for (states, at, words), block in zip(coded, ids.reshape(2, -1), strict=True):
        assert (rans.decode(states, at, words, rans.MARK, table).reshape(-1) == block).all()
        # Any checkpoint alone is enough.
        assert (rans.decode(states[2:3], at[2:3], words, rans.MARK, table).reshape(-1) == block[2 * rans.SEGMENT : 3 * rans.SEGMENT]).all()
    share = counts[counts > 0] / len(ids)
    assert sum(32 * len(w) for *_, w in coded) <= 1.02 * len(ids) * -(share * np.log2(share)).sum() + 64 * rans.LANES


def plain_tokens(rows):
    """(doc_id, start, n, crc) in the order of the files, by the tokenizer itself."""
    t = Tokenizer.from_file(q.tokenizer_path())
    out, at = [], 0
    for i, text in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(x) for x in q.op12_token_files(spark, sf).collect())
    assert got == plain_tokens([tuple(x) for x in docs])


def test_token_files_of_odd_rows_and_over_many_files(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    words = [f"w{n}" for n in range(300)]
    rows = [(i, " ".join(r.choices(words, k=r.randrange(0, 900)))) for i in range(150)] + [(500, " ".join(r.choices(words, k=150_000))), (501, None), (502, ""), (None, "no id"), (503, "<|endoftext|> x<|endoftext|>é 漢字 ẞ")]
    df = spark.createDataFrame(rows, TEXTS).repartition(3)
    monkeypatch.setattr(token_files, "READ_BLOCKS", 1)  # so the long document spans several readers' ranges
    folder = str(tmp_path / "tokens")
    listed = token_files.write_token_files(df, folder, q.TOKENIZER)
    want = plain_tokens(rows)
    assert listed.count() > 1 and listed.agg({"n_docs": "sum"}).first()[0] == len(rows)
    back = token_files.read_token_files(spark, folder, whole=True).collect()
    assert sorted((tuple(x)[:4] for x in back), key=lambda x: x[1]) == want
    assert all(zlib.crc32(x.ids) == x.ids_crc32 and len(x.ids) == 4 * x.n_tokens for x in back)
    twice = token_files.write_token_files(spark.createDataFrame([(7, "a b"), (7, "c"), (7, "a b")], TEXTS), str(tmp_path / "same"), q.TOKENIZER)
    assert twice.agg({"n_ids": "sum"}).first()[0] == 8 and sorted(x.start for x in token_files.read_token_files(spark, str(tmp_path / "same")).collect()) in ([0, 3, 6], [0, 2, 5], [0, 3, 5])
    none = str(tmp_path / "none")
    assert token_files.write_token_files(spark.createDataFrame([], TEXTS), none, q.TOKENIZER).count() == 0 and token_files.read_token_files(spark, none).count() == 0


def test_ids_may_be_text_and_columns_clash(spark, tmp_path):
    df = spark.createDataFrame([("b", "x", 1), ("a", None, 2)], "doc_id string, text string, ids int")
    token_files.write_token_files(df, str(tmp_path / "t"), q.TOKENIZER)
    got = token_files.read_token_files(spark, str(tmp_path / "t"), "string").collect()
    assert sorted((x.id, x.start, x.n_tokens) for x in got) == [("a", 0, 1), ("b", 1, 2)]


def test_damage_is_found_and_unlisted_files_are_not_read(spark, tmp_path):
    table = rans.Table(freq := rans.frequencies(np.array([5, 3, 2])))
    folder = str(tmp_path)
    (tmp_path / token_files.TABLE_NAME).write_bytes(token_files.TABLE + np.array([3, zlib.crc32(freq.astype("<u4").tobytes())], "<u4").tobytes() + freq.astype("<u4").tobytes())
    token_files._table.cache_clear()
    writer = token_files._Writer(folder, table, zlib.crc32(freq.astype("<u4").tobytes()), 0)
    ids = np.random.default_rng(1).integers(0, 3, 100_000).astype("<u4")
    writer.add(ids)
    writer.close(pa.table({"id": pa.array([1, 2]), "n": pa.array([30_000, 70_000])}))
    path = tmp_path / writer.name
    whole = token_files.TokenFile(folder, writer.name)
    assert [(a, len(x)) for a, x in whole.documents(0, 2)] == [(0, 30_000), (30_000, 70_000)]
    assert (next(iter(whole.documents(1, 2)))[1] == ids[30_000:]).all()
    held = bytearray(path.read_bytes())
    held[20_000] ^= 1
    path.write_bytes(held)
    with pytest.raises(token_files.DamagedFile):
        list(token_files.TokenFile(folder, writer.name).documents(0, 2))
    path.write_bytes(bytes(held[:-3]))
    with pytest.raises(token_files.DamagedFile):
        token_files.TokenFile(folder, writer.name)
    lost = token_files._Writer(folder, table, 0, 1)
    lost.drop()
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("part")] == [writer.name]


# ---- importance resampling


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("stretches", [1, 7, 4096, 10**6])
def test_window_crcs_match_zlib(monkeypatch, stretches):
    monkeypatch.setattr(importance, "STRETCHES", stretches)
    r = random.Random(stretches)
    texts = ["".join(r.choice("abZ ,.é漢0\n-") for _ in range(r.randrange(0, 200))) for _ in range(200)] + ["", "x" * 5000 + " y z", "a", "b"]
    data = np.frombuffer("".join(texts).encode(), "u1")
    ends = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    words, sizes, flat = importance.features(data, ends, 3, 10_000)
    held = [plain_words(t) for t in texts]
    want = [[zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)] for w in held]
    assert words.tolist() == [len(w) for w in held] and sizes.tolist() == [len(w) for w in want] and flat.tolist() == [b for w in want for b in w]


def plain_resample(docs, target, share=(10, 100), least=20, most=1, buckets=10_000):
    def hashed(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    held = [(i, len(plain_words(t)), hashed(t)) for i, t in docs]
    s, t = Counter(b for *_, h in held for b in h), Counter(b for x in target for b in hashed(x))
    n, m = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets)))) for b in {*s}}
    rows = []
    for i, words, h in held:
        weight = sum(gain[b] for b in h) // len(h) if h else 0
        u = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, words, len(h), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296)))))
    able = sorted((x for x in rows if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = Counter((x, k) for k, x in enumerate(able[: len(able) * share[0] // share[1]], 1))
    rest = able[len(able) * share[0] // share[1] :] + [x for x in rows if x[1] < least]
    return drawn + Counter((x, None) for x in rest)


def resampled(df):
    return Counter(((x.id, x.words, x.n_features, x.weight, x.score), x["rank"]) for x in df.collect())


@pytest.mark.parametrize("most, share", [(1, (10, 100)), (3, (1, 3))])
def test_resampling_matches_plain(spark, most, share):
    r = random.Random(most)
    words = [f"w{n}" for n in range(200)] + ["É", "漢字", "Zed"]
    docs = [(i, " ".join(r.choices(words, k=r.randrange(0, 60)))) for i in range(300)] + [(400, None), (401, ""), (None, "one two " * 30), (5, "w1 " * 40), (5, "w1 " * 40), (402, "w2 " * 100_000), (403, "--- ***")]
    target = [" ".join(r.choices(words[:40], k=50)) for _ in range(20)] + [None, ""]
    df, t = spark.createDataFrame(docs, TEXTS).repartition(5), spark.createDataFrame([(x,) for x in target], "text string")
    assert resampled(importance.resample(df, t, share=share, most=most)) == plain_resample(docs, target, share=share, most=most)


def test_resampling_of_empty_tables_and_clashing_columns(spark):
    t = spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(spark.createDataFrame([], TEXTS), t).count() == 0
    docs = spark.createDataFrame([(1, "a " * 25, 7, 8)], "doc_id long, text string, score int, held int")
    assert importance.resample(docs, t.limit(0), share=(1, 1)).first()["rank"] == 1


def test_ranks_over_many_ranges(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 as score").repartition(9)
    got = importance.ranked(df, [F.desc("score"), F.col("id")]).orderBy("rank").collect()
    assert [(x.id, x["rank"]) for x in got] == [(i, k) for k, i in enumerate(sorted(range(5000), key=lambda i: (-(i % 7), i)), 1)]


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_importance"])
def test_query_and_twin_agree(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(q.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert Counter(map(tuple, q.QUERIES[name](spark, sf).select(*names).collect())) == Counter(cur.fetchall())


# ---- hard negatives


def plain_negatives(rows, wanted, k=5, m=3):
    out = Counter()
    for i, label, v in rows:
        if not wanted(i):
            continue
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), j, lab) for j, lab, w in rows if j != i and len(w) == len(v))
        for s, j, lab in [x for x in scored if x[2] == label][:k]:
            fit = [(-n, o) for n, o, other in scored if other != label and 50 * -s <= 100 * -n <= 95 * -s]
            out.update((i, j, rank, o, -s, n) for rank, (n, o) in enumerate(fit[:m], 1))
    return out


VECTORS = "id long, label int, vec array<double>"


@pytest.mark.parametrize("shard, at_once", [(2**23, 512), (2048, 1), (4096, 7)])
def test_hard_negatives_match_plain_search(spark, monkeypatch, shard, at_once):
    for name, value in (("SHARD_BYTES", shard), ("ANCHOR_BYTES", 512), ("AT_ONCE", at_once), ("CODES", 5), ("SAMPLE", 60), ("FAN", 3)):
        monkeypatch.setattr(negatives, name, value)
    r = np.random.default_rng(shard)
    rows = [(i, int(i % 4), r.integers(-3, 6, 6).astype(float).tolist()) for i in range(250)]
    rows += [(7, 3, [5.0] * 6), (7, 3, [5.0] * 6), (300, 1, [1.0]), (301, 2, [2.0]), (302, 1, [2.0]), (303, 1, []), (304, 2, []), (2**60, 0, [4.0] * 6), (305, 9, [0.0] * 6)]
    odd = [(400, None, [1.0] * 6), (401, 1, None), (402, 1, [None] * 6), (403, 1, [float("nan")] * 6), (404, 1, [float("inf")] * 6), (None, 1, [1.0] * 6)]
    df = spark.createDataFrame(rows + odd, VECTORS).repartition(6)
    wanted = lambda i: i % 10 == 0 or i in (7, 303)
    got = negatives.hard_negatives(df.where("id % 10 = 0 or id in (7, 303)"), df)
    assert Counter(map(tuple, got.collect())) == plain_negatives(rows, wanted)


def test_bounds_hold_every_row_of_a_cell_and_fall():
    r = np.random.default_rng(2)
    vectors = np.floor(256 * r.normal(size=(3000, 16)) * np.repeat([1, 5], 1500)[:, None])
    books = (negatives.codebook(vectors[:500, :8]), negatives.codebook(vectors[:500, 8:]))
    shard = negatives.Shard(np.arange(3000), np.zeros(3000, int), vectors, books)
    for anchor in vectors[:20]:
        cells, last = list(shard.walk(anchor)), np.inf
        assert sorted(x for _, _, a, b in cells for x in range(a, b)) == list(range(3000))
        for most, least, a, b in cells:
            scores = shard.vectors[a:b] @ anchor
            assert most <= last and least <= scores.min() and scores.max() <= most
            last = most


def test_a_walk_stops_before_it_has_seen_all_rows(monkeypatch):
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16)) * 400
    vectors = np.floor(centres[r.integers(0, 40, 8000)] + r.normal(size=(8000, 16)) * 4)
    shard = negatives.Shard(np.arange(8000), np.arange(8000) % 3, vectors, (negatives.codebook(vectors[:2000, :8]), negatives.codebook(vectors[:2000, 8:])))
    seen, plain = [], shard.scores
    monkeypatch.setattr(shard, "scores", lambda anchor, ranges: seen.append(sum(b - a for a, b in ranges)) or plain(anchor, ranges))
    found = shard.positives(-1, 1, vectors[5], 5)
    scores = vectors @ vectors[5]
    want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if shard.labels[np.flatnonzero(shard.ids == i)[0]] == 1)[:5]
    assert [(-s, i) for s, i in found] == [(int(s), i) for s, i in want] and sum(seen) < 4000


def test_hard_negatives_of_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    some = spark.createDataFrame([(1, 1, [1.0]), (2, 1, [2.0])], VECTORS)
    assert negatives.hard_negatives(none, none).count() == negatives.hard_negatives(none, some).count() == negatives.hard_negatives(some, some).count() == 0


def test_ids_are_counted_in_the_task_that_makes_them():
    texts = ["the cat sat", None, "", "the café the"] * 50
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 100), pa.int64()), pa.array(texts[a : a + 100])], ["id", "text"]) for a in (0, 100)]
    *rows, counts = token_files._ids(q.TOKENIZER, 1)(iter(batches))
    assert sum(r.num_rows for r in rows) == len(texts) and all(r.column(3).null_count == r.num_rows for r in rows)
    ids = np.concatenate([token_files._wide(h, n) for r in rows for n, h in zip(r.column(1).to_pylist(), r.column(2).to_pylist(), strict=True)])
    assert counts.column(1).null_count == 1 and np.frombuffer(counts.column(3)[0].as_py(), "<i8").tolist() == np.bincount(ids).tolist()
    assert not list(token_files._ids(q.TOKENIZER, 1)(iter([])))
