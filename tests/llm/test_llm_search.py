"""Top-k search, URL rules, line dedup, chats, passages and the pipeline against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoglake.llm import chat, line_dedup, passages, topk, url_filter
from dialoglake.llm import queries as q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- top-k


def test_top_k_matches_plain_search(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.integers(-3, 4, 6).astype(float).tolist()) for i in range(400)] + [(7, [9.0] * 6), (7, [1.0] * 6), (900, [2.0**40] * 6), (901, [2.0**31] * 6), (902, [1.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>").repartition(5)
    got = {}
    for x in topk.top_k(df.where("id % 50 = 0 or id = 7"), df, 5, block=32).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    for query in {i for i, _ in rows if i % 50 == 0 or i == 7}:
        scored = [(-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), j) for i, v in rows if i == query for j, w in rows if j != query and len(v) == len(w)]
        want = [(n, j, min(2**63 - 1, -s)) for n, (s, j) in enumerate(sorted(scored)[:5], 1)]
        assert sorted(got.get(query, [])) == want


def test_vectors_that_take_no_part(spark):
    rows = [(1, [0.5, -0.1]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 0.0]), (6, [])]
    got = {x.id: x.v for x in spark.createDataFrame(rows, "id long, e array<float>").select("id", topk.whole_parts(F.col("e")).alias("v")).collect()}
    assert got == {1: [128.0, -26.0], 2: None, 3: None, 4: None, 5: None, 6: []}
    empty = spark.createDataFrame([], "id long, vec array<double>")
    assert topk.top_k(empty, empty).count() == 0


# ---- URL rules


def plain_verdict(url, rules):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h) + len(p), len(h), a == "block", h + p) for h, p, a in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], "allow" if best is None or not best[2] else "block"


@pytest.mark.parametrize("many", [False, True])
def test_url_rules_match_plain_search(spark, many):
    r = random.Random(6)
    labels, parts = ["org", "com", "a", "b", "example", "", "x:80"], ["", "/", "/a", "/a/b", "/es/", "/en/1", "/é"]
    urls = [None, "", "no url", "://", "http://", "HTTP://WWW.Example.ORG/es/?q#f", "http://org?x/y", "x://y://z/w"]
    urls += ["http://" + ".".join(r.choice(labels) for _ in range(r.randrange(1, 5))) + r.choice(parts) + r.choice(["", "?a=/b", "#c"]) for _ in range(600)]
    rules = list(q.URL_RULES) + [(None, "/", "block")]
    if many:
        rules += [(".".join(r.choice(labels) for _ in range(r.randrange(1, 4))), r.choice(parts), r.choice(["allow", "block"])) for _ in range(60)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, "http://a.org/"), (3, "://"), (3, "://")], "page_id long, url string").repartition(4)
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, action string"))
    want = Counter((i, *plain_verdict(u, rules)) for i, u in [*enumerate(urls), (None, "http://a.org/"), (3, "://"), (3, "://")])
    assert Counter(tuple(x) for x in got.collect()) == want
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(rules, "host string, path string, action string")).count() == 0


# ---- line dedup


def plain_line_dedup(rows, run=3):
    seen, out = set(), {}
    for i, text in sorted({r[:2] for r in rows}, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
        lines = [(n, x) for n, x in enumerate((text or "").split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
        gone, own = set(), []
        for a in range(len(lines) - run + 1):
            key = tuple(x for _, x in lines[a : a + run])
            if key in seen:
                gone |= {n for n, _ in lines[a : a + run]}
            seen.add(key)
        out[(i, text)] = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)
    return out


def test_line_dedup_matches_plain(spark):
    r = random.Random(3)
    rows = [(i, "\n".join(r.choice(["a", "b", "c", "d e", "", " ", "long line"]) for _ in range(r.randrange(0, 14)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "x\n" * 5000), (302, "x\n" * 5000)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), removed_col="gone").collect()
    want = plain_line_dedup(rows)
    assert Counter((x.doc_id, x.text) for x in got) == Counter((i, want[(i, t)]) for i, t in rows)
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_line_dedup_takes_long_passages_on_few_lines(spark, sf):
    import corpus_pipeline

    one, two = " ".join(f"a{i}" for i in range(50)), [" ".join(f"b{i}{k}" for i in range(30)) for k in "xy"]
    short = " ".join(f"c{i}" for i in range(49))
    rows = [(1, one), (2, "\n".join(two)), (3, short), (4, one), (5, "top\n\n" + "\n\n".join(two) + "\nend"), (6, short), (7, two[1] + "\n" + two[0]), (8, one + "\n" + one)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    want = dict(rows) | {4: "", 5: "top\n\n\nend", 8: ""}
    assert {x.doc_id: x.text for x in corpus_pipeline.repeated_lines(spark, df, sf).collect()} == want


def test_line_dedup_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 5, 6), (None, "a\nb\nc", 7, 8)], "doc_id long, text string, k1 int, line int")
    assert sorted((x.text, x.k1) for x in line_dedup.dedup_lines(df).collect()) == [("", 7), ("a\nb\nc", 5)]


# ---- chats


def plain_chats(rows):
    held = {}
    for c, t, role, text in {(c, t if c is not None else 0, role, text) for c, t, role, text in rows}:
        held.setdefault(("lone", role, text) if c is None else c, []).append(((t is not None, t or 0) if c is not None else 0, (role is not None, role or ""), (text is not None, text or "")))
    seqs = {c: [(ro, te) for _, ro, te in sorted(v)] for c, v in held.items()}
    keep = []
    for c, s in seqs.items():
        longer = any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values())
        rank = lambda x: (isinstance(x, tuple), x if not isinstance(x, tuple) else 0)
        if not longer and not any(o == s and rank(d) < rank(c) for d, o in seqs.items() if d != c):
            keep.append((None if isinstance(c, tuple) else c, len(s)))
    return Counter(keep)


def test_chats_match_plain(spark):
    r = random.Random(7)
    rows = []
    for c in range(120):
        base = random.Random(r.randrange(12))
        rows += [(c, t, base.choice(["user", "bot", None]), base.choice(["a", "b", "", None, "<|x"])) for t in range(r.randrange(1, 6))]
    rows += rows[:20] + [(500, None, "user", "a"), (None, 0, "user", "a"), (None, 1, "user", "a"), (None, 0, "zzz", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df).collect()
    assert Counter((x.conv_id, x.n_turns) for x in got) == plain_chats(rows)
    assert all("<|x" not in x.chat for x in got) and chat.format_chats(df.limit(0)).count() == 0


def test_chats_whose_turns_agree_in_number_and_role(spark):
    r = random.Random(8)
    rows = [(c, r.choice([0, 0, 1, None]), r.choice(["user", None]), r.choice(["a", "b", "c", "", None])) for c in range(150) for _ in range(r.randrange(1, 5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df).collect()
    assert Counter((x.conv_id, x.n_turns) for x in got) == plain_chats(rows)
    first = spark.createDataFrame([(1, 5, "u", "b"), (1, 5, "u", "a"), (1, None, "u", "z")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(first).first().chat == "".join(f"<|u|>\n{x}\n<|end|>\n" for x in "zab")


# ---- passages


def words(r, n):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def test_passages_finds_exact_and_fuzzy_repeats(spark):
    r = random.Random(5)
    base = words(r, 80)
    fuzzy = base.copy()
    fuzzy[30] = "changed"
    moved = [*base[:25], "added", "words", *base[25:50], *base[52:]]
    rows = {1: [*words(r, 40), *base, *words(r, 40)], 2: [*words(r, 300), *base, *words(r, 10)], 3: [*words(r, 20), *fuzzy, *words(r, 70)], 4: [*moved, *words(r, 50)], 5: words(r, 400), 6: [*base[:30], *words(r, 60)], 7: [*words(r, 5), *base]}
    rows |= {10 + i: words(r, 120) for i in range(30)}
    half = words(r, 70)
    rows |= {50: half[:35] + words(r, 50), 51: half, 52: words(r, 9) + half}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()] + [(60, None), (61, ""), (62, "a b"), (2, " ".join(rows[2]))], "doc_id long, text string").repartition(4)
    got = {x.id: x for x in passages.repeated_passages(df).collect()}
    assert set(got) == {2, 3, 4, 7, 52}
    assert (got[2].first, got[2].end, got[2].from_id) == (300, 380, 1)
    assert (got[3].first, got[3].end) == (20, 100) and got[3].matched == 79
    assert got[4].first == 0 and got[4].end == 80 and got[7].end == 85
    assert (got[52].first, got[52].end) == (9, 79)  # its halves have their first places in different documents
    assert passages.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_passages_of_similarity_090_are_found(spark):
    r = random.Random(8)
    rows, want = {}, set()
    for i in range(60):
        base = [f"p{i}x{k}" for k in range(60)]
        near = base.copy()
        for k in r.sample(range(60), 6):
            near[k] = f"new{i}x{k}"
        rows[i], rows[100 + i] = words(r, 70) + base + words(r, 70), words(r, 90) + near + words(r, 90)
        want.add(100 + i)
    # A single seed: of 60 words every fifth differs but for one run of nine.
    base = [f"s{k}" for k in range(60)]
    rows[200], rows[201] = words(r, 70) + base + words(r, 70), words(r, 90) + [w if k % 5 < 4 or k == 29 else f"d{k}" for k, w in enumerate(base)] + words(r, 90)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    assert {x.id for x in passages.repeated_passages(df).collect()} == want | {201}


def test_passages_made_of_pieces_known_from_elsewhere(spark):
    r = random.Random(9)
    rows, want = {}, set()
    for i in range(40):
        one, two = [f"a{i}x{k}" for k in range(35)], [f"b{i}x{k}" for k in range(35)]
        whole = [*one, f"mid{i}", *two]
        near = whole.copy()
        near[33] = near[37] = "other"  # no seed over the middle is left: the nearest earlier document has to be asked
        for n, w in enumerate([one, two, whole, one, whole]):
            rows[i * 10 + n] = words(r, 60) + w + words(r, 60)
        rows[1000 + i * 10], rows[1001 + i * 10] = words(r, 60) + whole + words(r, 60), words(r, 60) + near + words(r, 60)
        want |= {i * 10 + 4, 1000 + i * 10, 1001 + i * 10}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    assert {x.id for x in passages.repeated_passages(df).collect()} == want


def test_passages_whose_seeds_stand_in_other_documents_before_and_between(spark):
    r = random.Random(21)
    rows, want = {}, {}
    for i in range(30):
        base = [f"m{i}x{k}" for k in range(64)]
        # Every five words of the passage also stand in the first and in the nearest earlier document, but in short pieces only.
        for n in (1, 2, 7, 8):
            rows[10 * i + n] = [w for a in range(0, 60, 6) for w in [*words(r, 25), *base[a : a + 10]]]
        rows[10 * i + 5], rows[10 * i + 9] = words(r, 70) + base + words(r, 70), words(r, 90 * (i % 2)) + base + words(r, 90 * (i // 2 % 2))
        want[10 * i + 9] = (90 * (i % 2), 90 * (i % 2) + 64, 10 * i + 5)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    assert {x.id: (x.first, x.end, x.from_id) for x in passages.repeated_passages(df).collect()} == want
    texts = passages._texts(df, "doc_id", "text")
    seen = [passages.met(texts, *a) for a in ((), (3, 1))]  # hot seeds dealt by ranges give all their places too
    assert len({frozenset(Counter(map(tuple, s.where("h is not null").collect())).items()) for s in seen}) == 1


def test_a_poor_alignment_hides_no_good_one(spark):
    found = spark.createDataFrame([(9, 0, 1, 0, 523, 391), (9, 0, 2, 0, 541, 498), (9, 0, 1, 600, 700, 70), (9, 0, 2, 800, 830, 30), (9, 0, 3, 830, 860, 25)], "oid long, k1 long, from_oid long, first int, end int, hits int")
    got = sorted((x["first"], x["end"], -x.source.less) for x in passages.passages_of(found, 50, 0.8).collect())
    assert got == [(0, 541, 2), (800, 860, 2)]


def test_places_without_a_passage_give_few_further_matches(spark):
    r = random.Random(31)
    short = words(r, 45)  # alike in hundreds of documents, but too short for a passage
    base = words(r, 64)
    rows = {i: [w if r.random() > 0.03 else f"x{i}" for w in short] for i in range(300)}
    # The passage's seeds stand in the first document and in the nearest earlier one, but in short pieces only.
    for n in (1000, 1001, 1500, 1501):
        rows[n] = [w for a in range(0, 60, 6) for w in [*words(r, 25), *base[a : a + 10]]]
    for n in range(1100, 1130):
        rows[n] = words(r, 70) + base + words(r, 70)
    rows[1600] = words(r, 80) + base + words(r, 80)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    texts = passages._texts(df, "doc_id", "text")
    none = spark.createDataFrame([], "oid long, k1 long, first int, end int")
    more = passages.further(texts, passages.met(texts), none, 50, 0.8).collect()
    assert not [m for m in more if m.oid < 1000]
    assert {m.from_oid for m in more if m.oid == 1600} <= set(range(1100, 1130)) and 1 <= len([m for m in more if m.oid == 1600]) <= 64
    assert len({(m.oid, m.pos) for m in more}) == len(more)
    small = passages.TILE_ASKS, passages.TILE_PLACES
    try:  # seeds dealt over several tiles find a partner for the same places, and may find one in each
        passages.TILE_ASKS, passages.TILE_PLACES = 8, 16
        tiled = passages.further(texts, passages.met(texts), none, 50, 0.8).collect()
    finally:
        passages.TILE_ASKS, passages.TILE_PLACES = small
    assert {(m.oid, m.pos) for m in tiled} >= {(m.oid, m.pos) for m in more} and not [m for m in tiled if m.oid < 1000]
    assert {x.id: (x.first, x.end) for x in passages.repeated_passages(df).collect()}[1600] == (80, 144)


def test_every_long_exact_repeat_is_covered(spark, sf):
    texts = {x.doc_id: (x.text or "").split() for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {}
    for x in q.op10_passages(spark, sf).collect():
        found.setdefault(x.doc_id, set()).update(range(x.first_word, x.end_word))
    seen = {}
    for d in sorted(texts):
        w = texts[d]
        for a in range(len(w) - 49):
            key = tuple(w[a : a + 50])
            if key in seen and seen[key] != (d, a):
                assert len(found.get(d, set()) & set(range(a, a + 50))) >= 45
            seen.setdefault(key, (d, a))


def test_chains_follow_diagonals_and_part_where_they_break():
    long_, gap = np.arange(0, 3000, 6), 3000 + 100
    later = np.arange(gap, gap + 30, 6)
    a, b = np.concatenate([long_, later, [3200]]), np.concatenate([long_ + 50, later + 57, [9]])
    assert sorted(passages.chain(a, b)) == [(0, 2994, 50, 3044, 500), (3100, 3124, 3157, 3181, 5), (3200, 3200, 9, 9, 1)]


def test_chain_scores_match_quadratic_search():
    r = random.Random(3)
    for _ in range(300):
        n = r.randrange(1, 9)
        a, b = (np.array(sorted(r.sample(range(40), n))), np.array([r.randrange(40) for _ in range(n)]))
        score = []
        for j in range(n):
            score.append(max([float(passages.K), *[score[i] - passages.GAP * (a[j] - a[i] + b[j] - b[i]) + passages.K for i in range(j) if b[i] < b[j]]]))
        first = passages._chain_cluster(a, b)[0]
        assert (first[1], first[3]) in {(int(a[j]), int(b[j])) for j in range(n) if score[j] >= max(score) - 1e-9}


def test_winnowing_guarantee():
    r = random.Random(1)
    for _ in range(200):
        shared = [str(r.randrange(50)).encode() for _ in range(passages.K + passages.W - 1)]
        x, y = ([str(r.randrange(50)).encode() for _ in range(r.randrange(40))] + shared + [str(r.randrange(50)).encode() for _ in range(r.randrange(40))] for _ in range(2))
        assert set(passages.seeds(x)[0].tolist()) & set(passages.seeds(y)[0].tolist())


# ---- the pipeline


def test_pipeline_takes_effect_in_every_stage(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, sizes = docs.columns, [docs.count()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        if n < 4:
            assert docs.columns == names
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3]
    assert {x.doc_id for x in docs.select("doc_id").distinct().collect()} <= {x.doc_id for x in spark.read.parquet(str(tmp_path / "2")).collect()}
    per = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert per.where("n <> m or n > 2048").count() == 0


def test_pipeline_on_odd_rows(spark, sf):
    import corpus_pipeline

    odd = [(1, None, None, None, None), (2, "", "", "", 0), (3, "one two three " * 20, None, None, 5), (3, "one two three " * 20, None, None, 5), (None, " ".join(f"u{i}" for i in range(60)), "x", "s", 9), (None, " ".join(f"v{i}" for i in range(60)), "x", "s", 9)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, DOCS)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() == (2 if rows else 0)
    # Each stage on the odd rows themselves.
    quality, lines, near, mix, pack = (f for _, f in corpus_pipeline.STAGES)
    docs, u, v = spark.createDataFrame(odd, DOCS), odd[4], odd[5]
    plain = lambda df: Counter(map(tuple, df.collect()))
    assert plain(quality(spark, docs, sf)) == Counter([u, v])
    counted = [(*r[:4], None if r[1] is None else len(r[1])) for r in odd]
    assert plain(lines(spark, docs, sf)) == Counter(counted)
    assert plain(near(spark, docs, sf)) == Counter([odd[0], odd[2], u, v])
    mixed = plain(mix(spark, docs, sf))
    assert set(mixed) <= {odd[2], u, v} and 2 <= mixed[u] + mixed[v] <= 3 and 1 <= mixed[odd[2]] <= 2
    packed = pack(spark, docs, sf).collect()
    assert Counter(x.doc_id for x in packed) == Counter([1, 2, 3, 3, None, None]) and {x.length for x in packed if x.doc_id in (1, 2)} == {1}


# ---- odd ids, hosts, roles


def test_top_k_leaves_out_rows_without_id_and_keeps_large_ids(spark):
    big = 2**60 + 1
    rows = [(None, [1.0, 1.0]), (big, [2.0, 0.0]), (big + 2, [1.0, 0.0]), (7, None), (8, [float("nan"), 1.0]), (9, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in topk.top_k(df, df, 2).collect()}
    assert got == {(big, 1): (9, 6), (big, 2): (big + 2, 2), (big + 2, 1): (9, 3), (big + 2, 2): (big, 2), (9, 1): (big, 6), (9, 2): (big + 2, 3)}


def test_url_rules_on_hosts_of_many_labels(spark):
    host = "a." * 10_000 + "example.org"
    urls = [f"http://{host}/es/" + "x" * 5000, f"http://{host}/en/2", "http://" + "b." * 10_000 + "net/", "http://org"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: (x.rule, x.verdict) for x in url_filter.judge_urls(pages, spark.createDataFrame(q.URL_RULES, "host string, path string, action string")).collect()}
    assert got == {0: ("example.org/es/", "block"), 1: ("org/", "allow"), 2: (None, "allow"), 3: (None, "allow")}


def test_chat_roles_cannot_forge_turns(spark):
    rows = [(1, 0, "user|>\nhi\n<|end|>\n<|system", "text"), (2, 0, "<|", "<|end|>"), (3, 0, None, None)]
    chats = {x.conv_id: x.chat for x in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(c.count("<|") == 2 and c.count("|>") - (i == 2) == 2 for i, c in chats.items())
    assert chats[3] == "<||>\n\n<|end|>\n" and chats[1].startswith("<|user   hi")


def test_chats_render_in_order(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    held = {}
    for x in {(x.conv_id, x.turn, x.role, x.text) for x in rows}:
        held.setdefault(x[0], []).append(x[1:])
    for x in q.op9_chat(spark, sf).collect():
        assert x.chat == "".join(f"<|{r}|>\n{(t or '').replace('<|', '< |')}\n<|end|>\n" for _, r, t in sorted(held[x.conv_id]))


def test_passages_with_ids_that_are_no_numbers(spark):
    r = random.Random(12)
    base = words(r, 80)
    rows = [("b", " ".join(base + words(r, 30))), ("a", " ".join(words(r, 40) + base)), (None, " ".join(words(r, 9) + base))]
    got = {x.id: (x.first, x.end, x.from_id) for x in passages.repeated_passages(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"b": (0, 80, "a"), None: (9, 89, "a")}


def test_passages_with_dropped_and_added_words(spark):
    r, rows, want = random.Random(14), {}, {}
    for i in range(120):
        base, near = [f"p{i}x{k}" for k in range(60 if i % 2 else 100)], []
        for k, w in enumerate(base):
            kind = r.randrange(3) if r.random() < 0.1 else None
            near += {0: [f"new{k}"], 1: [], 2: [w, f"more{k}"]}.get(kind, [w])
        before = words(r, r.randrange(120))
        rows[i], rows[1000 + i] = words(r, 60) + base + words(r, 60), before + near + words(r, r.randrange(120))
        want[1000 + i] = (len(before), len(before) + len(near))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    got = {x.id: x for x in passages.repeated_passages(df).collect()}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert all(got[i].first >= want[i][0] and got[i].end <= want[i][1] and got[i].end - got[i].first >= 0.8 * (want[i][1] - want[i][0]) for i in got)


def test_line_dedup_carries_fewer_rows_than_lines(spark, sf):
    texts = [x.text or "" for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    lines = sum(1 for t in texts for x in t.split("\n") if x.strip(" \t\r\x0b\x0c"))
    assert sum(len(line_dedup.selected(t.encode(), 3)) for t in texts) < 0.65 * lines


def test_winnowed_lines_select_every_window_once():
    r = random.Random(5)
    for _ in range(300):
        text = "\n".join(r.choice("abcd") for _ in range(r.randrange(12))).encode()
        found = line_dedup.selected(text, 3)
        assert sorted(at[first - 1] for _, _, at, spans in found for first, _ in spans) == list(range(max(0, len(text.split(b"\n")) - 2 if text else 0)))


def plain_pipeline(rows):
    """The first three stages in plain Python: rows (id, text, source) -> those that stay, with what is left of their texts."""
    from dialoglake.llm import neardup, quality

    kept = [r for r in rows if not failed(r[1] or "", quality)]
    seen, cut = set(), []
    for i, text, source in sorted(kept, key=lambda r: (r[0], r[1])):
        lines = [(n, x) for n, x in enumerate(text.split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
        gone = set()
        for size in (1, 2, 3):
            for a in range(len(lines) - size + 1):
                key = tuple(x for _, x in lines[a : a + size])
                if size < 3 and len(" ".join(key).split()) < 50:
                    continue
                if key in seen:
                    gone |= {n for n, _ in lines[a : a + size]}
                seen.add(key)
        cut.append((i, "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone), source))
    sets = [set(neardup.shingles(t.encode()).tolist()) for _, t, _ in cut]
    root = list(range(len(cut)))
    for i in range(len(cut)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if k == root[i] else k for k in root]
    return [min((cut[i] for i in range(len(cut)) if root[i] == c), key=lambda r: r[0]) for c in sorted(set(root))]


def failed(text, quality):
    import re

    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    found = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    again = {i + k for i in range(len(ws) - 7) if found[tuple(ws[i : i + 8])] > 1 for k in range(8)}
    chars, symbols, double = sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    n = len(ws)
    return n < 20 or 100 * len(again) > 30 * n or 10 * symbols > n or chars < 2 * n or chars > 15 * n or 2 * double > len(lines)


def test_pipeline_matches_plain_stages(spark, sf):
    import corpus_pipeline
    import zlib

    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    kept = plain_pipeline([(r.doc_id, r.text, r.source) for r in docs])
    got = corpus_pipeline.run(spark, sf).collect()
    size, total, largest = {}, Counter(), Counter()
    for i, t, s in kept:
        size[i] = (s, len(t.split()))
        total[s] += size[i][1]
        largest[s] = max(largest[s], size[i][1])
    order, left, free, aims = sorted(total), float(sum(total.values())), set(total), {}
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    while over := {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * total[s]}:
        aims |= {s: 3.0 * total[s] for s in over}
        left, free = left - sum(aims[s] for s in over), free - over
    aims |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    whole, pieces, taken = Tokenizer.from_file(q.tokenizer_path()), Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), Counter()
    copies = Counter(r.doc_id for r in got if r.piece == 0)
    want = Counter()
    for i, t, s in kept:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
        for n, a in enumerate(range(0, len(ids), 8192)):
            if copies[i]:
                want[(i, n, a // 4, len(ids[a : a + 8192]) // 4, zlib.crc32(ids[a : a + 8192]))] = copies[i]
        assert copies[i] <= 3
        taken[s] += copies[i] * size[i][1]
    assert pieces == want
    assert all(abs(taken[s] - aims[s]) <= largest[s] for s in total)


def test_seeds_of_many_texts_are_those_of_each():
    r = random.Random(41)
    for _ in range(40):
        texts = [[str(r.randrange(r.choice([1, 2, 50, 3000]))).encode() for _ in range(r.choice([0, 1, 4, 5, 11, 12, 13, 20, 40, 100, 300]))] for _ in range(r.randrange(1, 8))]
        text, *got = passages.seeds_of(texts)
        for i, words_ in enumerate(texts):
            assert [g[text == i].tolist() for g in got] == [w.tolist() for w in passages.seeds(words_)]


def test_words_over_and_over_keep_few_seeds():
    r = random.Random(43)
    for period in (1, 2, 3, 4):
        for _ in range(20):
            edge = [[f"e{r.randrange(10**6)}".encode() for _ in range(30)] for _ in (0, 1)]
            text = edge[0] + [f"p{k % period}x".encode() for k in range(400)] + edge[1]
            h, at, *_ = passages.seeds(text)
            at = at[(at >= 30) & (at <= 425)]
            assert len(at) <= 400 // passages.RUN + 6 and np.diff(at).max() <= passages.RUN + 3


def test_hot_seeds_dealt_by_ranges_give_the_same_matches(spark):
    r = random.Random(11)
    phrases = [words(r, 40) for _ in range(3)]
    rows = []
    for i in range(400):
        text = [*words(r, 3), *phrases[0], *words(r, r.randrange(3))]
        if i % 3 == 0:
            text += [*phrases[1], *words(r, 2), *phrases[0][:30]]
        if i > 350:
            text += phrases[2]
        rows += [(None if i % 40 == 7 else i // 2, " ".join(text))] * (1 + (i % 50 == 0))
    texts = passages._texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert passages.hot_seeds(texts, 50, 1).count() > 0 and passages.hot_seeds(texts).count() == 0
        plain, dealt = (Counter(map(tuple, passages.matches(texts, *a).collect())) for a in ((), (50, 1)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert plain and plain == dealt
