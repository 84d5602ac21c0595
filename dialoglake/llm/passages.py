"""Substring dedup: fuzzy passages that repeat an earlier one, by collinear chaining.

A seed is the hash of ``K`` consecutive words whose first pair of words has the least hash of the ``K`` - 1 pairs in it:
about one place in K - 1. Whether a place is such a seed depends on its own K words only, so edits around it don't matter.
Where ``W`` places in a row are none, the one with the least hash is a seed too, so any run of K + W - 1 words that two
places share has a common seed. Every seed place meets the seed's first place (by document, then
position) and its place in the nearest earlier document, never all others, so a seed of n places gives fewer than 2n
matches. A match counts if the ``NEAR`` words before it, or those after it, are alike in both places: each seed carries two
64-bit sketches of these words, and in a passage of ``min_words`` or more every seed has a side with that many words of the
passage. So short phrases that happen to recur cost nothing beyond this step. Places that no passage found so far holds then
meet every other earlier place of their seed, in tiles of bounded size (``further``), and keep one sure partner, or all that may be one. Inside a pair of documents a
Fenwick tree over the earlier document's positions chains matches that go forward in both, each paying for the gap to the
one before; chains far apart or off their diagonal come apart. Neighbouring chains of a document, whatever sources they
lead to, form a region, because parts of one passage may have their first places in different documents. Regions, those of
a single seed too, are aligned word by word with the places they lead to, also beyond both ends, and count if at least
``min_words`` words of them lie in alignments and at least ``similarity`` of those words match.

Defined results: null and empty texts and texts of fewer than K words have no seeds; rows that repeat id and text count as
one text; rows with one id and different texts are different places; null ids come last; ids that aren't whole numbers are
numbered in their order first; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain as chained

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from dialoglake.llm.common import settle, tasks, text_key

K, W, BLOCK = 5, 8, 128
#: Words of a sketch, and the share of its bits that both places must have. Sketches need ``NEAR`` words on that side.
NEAR, ALIKE = 16, 0.55
#: Places that ask, and places asked, in one tile of a seed's places; pairs that a task looks at together, pairs from which a tile
#: is large, how many words beyond a passage's least a window holds, and partners that are aligned in search of a sure one.
TILE_ASKS, TILE_PLACES, PAIRS, LARGE, SHIFT, TRIES = 4096, 8192, 2**17, 2**12, 10, 4
#: A seed of more than ``HOT`` places, and more than half of a task's mean, is dealt by ranges of documents, at most ``RANGES``;
#: one document in ``SAMPLE`` tells which and where. The draw decides about tasks only, never about matches.
HOT, RANGES, SAMPLE = 20_000, 64, 64
#: Of a run of equal seeds (one to four words over and over) one for every ``RUN`` words stays, and the second.
RUN = 20
#: Words whose hashes one Python process remembers.
REMEMBERED = 600_000
#: Words that an alignment may at least go past a chain's ends (``min_words`` if that is more), the widest gap that a chain crosses or a region holds, and how far
#: an alignment's score may fall below its best before it ends.
MARGIN, JUMP, DROP = 32, 24, 24
#: What a chain pays for each word of a gap, in either document.
GAP = 0.1
NO_ID = 2**63 - 1
U1, U2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
LOWER = np.uint64(2**32 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(U2)
    return x ^ (x >> np.uint64(29))


def _slide(x: np.ndarray, w: int, best) -> np.ndarray:
    """best over every window of w, by doubling."""
    span = 1
    while span < w:
        step = min(span, w - span)
        x = best(x[:-step], x[step:])
        span += step
    return x


class _Hashes(dict):
    """Hashes of words, remembered up to ``REMEMBERED`` of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


HASHES = _Hashes()


def seeds_of(texts: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """Words of texts -> text's number, hash and position of each selected seed, sketches of the words before and after it, and 32-bit ones of the ``NEAR`` words beyond these."""
    sizes = np.array([len(t) for t in texts], "i8")
    total = int(sizes.sum())
    n = total - K + 1
    if n < 1:
        return (np.zeros(0, "i8"), np.zeros(0, "u8"), np.zeros(0, "i8"), *(np.zeros(0, "u8") for _ in range(3)))
    one = np.fromiter(map(HASHES.__getitem__, chained.from_iterable(texts)), "u8", total)
    starts = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)
    pos = np.arange(total) - starts[text]
    left = sizes[text] - pos  # words from a place on
    place = left[:n] >= K
    h = np.zeros(n, "u8")
    for i in range(K):
        h = h * np.uint64(U1) + one[i : i + n]
    h = _mix(h)
    pairs = _mix(one[:-1] * np.uint64(U2) + one[1:])
    chosen = (_slide(pairs, K - 1, np.minimum) == pairs[:n]) & place
    # Windows of W places without a seed get their least one, so that every run of K + W - 1 words holds a seed.
    if n >= W:
        whole = left[: n - W + 1] >= K + W - 1
        least = np.where(whole & ~_slide(chosen, W, np.logical_or), _slide(h, W, np.minimum), np.uint64(0))
        edge = np.zeros(W - 1, "u8")
        more = _slide(np.concatenate([edge, least, edge]), W, np.maximum) == h
    else:
        more = np.zeros(n, bool)
    for i in np.flatnonzero((sizes >= K) & (sizes < K + W - 1)):
        own = slice(starts[i], starts[i] + sizes[i] - K + 1)
        if not chosen[own].any():
            more[own] = h[own] == h[own].min()
    chosen |= more & place
    # Any K + RUN + 2 words inside a run of equal seeds still hold one of them; its second one tells that the run repeats itself.
    at = np.flatnonzero(chosen)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (h[at[1:]] != h[at[:-1]]) | (np.diff(at) >= K) | (text[at[1:]] != text[at[:-1]])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    step = (at - at[first]) // RUN
    at = at[fresh | np.roll(fresh, 1) | (step != np.roll(step, 1))]
    sketch = _slide(np.concatenate([np.uint64(1) << (one >> np.uint64(58)), np.zeros(NEAR, "u8")]), NEAR, np.bitwise_or)

    def words(first: np.ndarray, there: np.ndarray) -> np.ndarray:
        return np.where(there, sketch[np.clip(first, 0, total)], np.uint64(0))

    before, after = words(at - NEAR, pos[at] >= NEAR), words(at + K, left[at] >= K + NEAR)
    far_before, far_after = words(at - 2 * NEAR, pos[at] >= 2 * NEAR), words(at + K + NEAR, left[at] >= K + 2 * NEAR)
    far_before, far_after = ((x | x >> np.uint64(32)) & LOWER for x in (far_before, far_after))
    return text[at], h[at], pos[at], before, after, far_before << np.uint64(32) | far_after


def seeds(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """``seeds_of`` one text."""
    return seeds_of([words])[1:]


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *keys, text = batch.columns
        for a in range(0, len(text), 256):
            take, h, at, before, after, far = seeds_of([(t or b"").split() for t in text[a : a + 256].cast(pa.large_binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [k[a : a + 256].take(pa.array(take)) for k in keys] + [pa.array(h.view("i8")), pa.array(at.astype("i4")), pa.array(before.view("i8")), pa.array(after.view("i8")), pa.array(far.view("i8"))],
                [*batch.schema.names[:-1], "h", "pos", "before", "after", "far"],
            )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *keys, text = batch.columns
        for a in range(0, len(text), 64):
            rows: tuple[list, ...] = ([], [], [])
            for i, t in enumerate(text[a : a + 64].cast(pa.large_binary()).to_pylist()):
                words = (t or b"").split()
                for at in range(0, len(words), BLOCK):
                    for column, value in zip(rows, (i, at // BLOCK, zlib.compress(b" ".join(words[at : at + BLOCK]), 1)), strict=True):
                        column.append(value)
            take = pa.array(rows[0], pa.int32())
            yield pa.RecordBatch.from_arrays([k[a : a + 64].take(take) for k in keys] + [pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary())], [*batch.schema.names[:-1], "block", "words"])


def clusters(a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of matches that can stand in one chain: neighbours in diagonal, then in a, are at most ``JUMP`` words apart."""

    def split(rows: np.ndarray, by: np.ndarray) -> list[np.ndarray]:
        rows = rows[np.argsort(by[rows], kind="stable")]
        return np.split(rows, np.flatnonzero(np.diff(by[rows]) > JUMP) + 1)

    waiting = [np.arange(len(a))]
    while waiting:
        rows = waiting.pop()
        parts = [q for p in split(rows, b - a) for q in split(p, a)]
        if len(parts) == 1:
            yield parts[0]
        else:
            waiting.extend(parts)


def chain(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Matches -> chains (first a, last a, first b, last b, matches) that go forward in both documents."""
    out = []
    for rows in clusters(a, b):
        x, y = a[rows], b[rows]
        step = np.diff(x)
        if (step > 0).all() and (np.diff(y) == step).all():  # one diagonal, or one match
            out.append((int(x[0]), int(x[-1]), int(y[0]), int(y[-1]), len(x)))
        else:
            out.extend(_chain_cluster(x, y))
    return out


def _chain_cluster(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Best chains of one cluster, heaviest first, each match in one.

    A chain's score is K for every match less ``GAP`` for every word from one to the next, in both documents. What a match
    at (a, b) can get from one at (a', b') is score' + GAP * (a' + b'), the same for all that come later: so a Fenwick
    tree of prefix maxima over the ranks of b, filled in order of a, finds the best predecessor.
    """
    order = np.lexsort((-b, a))
    a, b = a[order].tolist(), b[order].tolist()
    ranks = {v: i + 1 for i, v in enumerate(sorted(set(b)))}
    size = len(ranks)
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)
    score, back, entered = [float(K)] * len(a), [-1] * len(a), 0
    for j in range(len(a)):
        while a[entered] < a[j]:
            i, held = ranks[b[entered]], (score[entered] + GAP * (a[entered] + b[entered]), entered)
            while i <= size:
                tree[i] = max(tree[i], held)
                i += i & -i
            entered += 1
        i, best = ranks[b[j]] - 1, (float("-inf"), -1)
        while i > 0:
            best = max(best, tree[i])
            i -= i & -i
        if best[1] >= 0:
            p = best[1]
            gain = best[0] - GAP * (a[j] + b[j]) + K
            if gain > score[j]:
                score[j], back[j] = gain, p
    out, used = [], [False] * len(a)
    for j in sorted(range(len(a)), key=lambda j: -score[j]):
        path, i = [], j
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = back[i]
        if path:
            out.append((a[path[-1]], a[path[0]], b[path[-1]], b[path[0]], len(path)))
    return out


def _whole(batches: Iterator[pa.RecordBatch], n_keys: int = 1) -> Iterator[pa.Table]:
    """Rows in which equal keys, the first columns, are neighbours -> tables that part no key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(c) for c in batch.columns[:n_keys]]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if held and any(held[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(n_keys)):
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            yield pa.Table.from_batches([*held, batch.slice(0, change[-1])])
            held = []
        held.append(batch.slice(change[-1]) if len(change) else batch)
    if held:
        yield pa.Table.from_batches(held)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by both documents, then position -> a row for each chain: documents, a0, a1, b0, b1 (words, ends exclusive)."""
    names = [*PAIR, "a0", "a1", "b0", "b1"]

    def batch_of(docs: list, spans: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(d, "i8")) for d in docs] + [pa.array(np.asarray(x, "i4")) for x in spans], names)

    for table in _whole(batches, 4):
        *docs, a, b = (table.column(i).to_numpy().astype("i8") for i in range(6))
        new = np.ones(len(a), bool)
        new[1:] = np.any([d[1:] != d[:-1] for d in docs], axis=0)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(a))
        step = np.diff(a, prepend=0)
        on = new | (step > 0) & (step <= JUMP) & (np.diff(b, prepend=0) == step)
        plain = np.logical_and.reduceat(on, starts)  # one diagonal without a wide gap, or one match: one chain
        x, y = starts[plain], ends[plain] - 1
        if len(x):
            yield batch_of([d[x] for d in docs], [a[x], a[y] + K, b[x], b[y] + K])
        out = []
        for x, y in zip(starts[~plain], ends[~plain], strict=True):
            key = [int(d[x]) for d in docs]
            out.extend((*key, a0, a1 + K, b0, b1 + K) for a0, a1, b0, b1, _ in chain(a[x:y], b[x:y]))
        if out:
            columns = list(zip(*out, strict=True))
            yield batch_of(columns[:4], columns[4:])


def extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Align two word sequences from their beginnings: one point for a word that matches, one off for each replaced, added or dropped.

    After an edit the nearest place where three words in a row agree (two, for a replaced word or two) is taken; the end is
    where the score was best, once it has fallen ``DROP`` below or nothing agrees within that. -> words of a, matches.
    """
    i = j = score = best = end = hits = best_hits = 0
    step = 32
    while i < len(a) and j < len(b):
        n = min(step, len(a) - i, len(b) - j)
        unlike = a[i : i + n] != b[j : j + n]
        run = int(unlike.argmax()) if unlike.any() else n
        i, j, score, hits = i + run, j + run, score + run, hits + run
        if score > best:
            end, best, best_hits = i, score, hits
        if run == n:
            step *= 4
            continue
        step, most = 32, DROP - (best - score)
        x, y = a[i : i + most + 3].tolist(), b[j : j + most + 3].tolist()
        move = next(((s, s) for s in (1, 2) if s <= most and len(x[s : s + 2]) == 2 and x[s : s + 2] == y[s : s + 2]), None)
        if move is None:
            at: dict[tuple, int] = {}
            for q in range(len(y) - 3, -1, -1):
                at[tuple(y[q : q + 3])] = q
            near = [(max(p, q), p, q) for p in range(len(x) - 2) if (q := at.get(tuple(x[p : p + 3]))) is not None and 0 < max(p, q) <= most]
            if not near:
                break
            move = min(near)[1:]
        # Words that agree inside a stretch of equal length count, as in a, x, b against c, x, d.
        same = sum(u == v for u, v in zip(x[: move[0]], y[: move[1]], strict=True)) if move[0] == move[1] else 0
        i, j, score, hits = i + move[0], j + move[1], score - max(move) + 2 * same, hits + same
    return end, best_hits


def align(x: np.ndarray, y: np.ndarray, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int, int]]:
    """A chain's alignments (first, end, matches) in the first text: from its first seed both ways, and from its last where that stops short."""

    def around(p: int, q: int) -> tuple[int, int, int]:
        on, right = extend(x[p:], y[q:])
        back, left = extend(x[:p][::-1], y[:q][::-1])
        return p - back, p + on, left + right

    out = [around(a0, b0)]
    if out[0][1] < a1:
        out.append(around(a1, b1))
    return out


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Alignments with one source (first, end, matches) -> the stretches that they cover; a word counts once, for the first that has it."""
    out: list[list[float]] = []
    for first, end, hits in sorted(s for s in spans if s[0] < s[1]):
        if out and first <= out[-1][1]:
            out[-1][2] += hits * max(0, end - out[-1][1]) / (end - first)
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end, hits])
    return [(int(a), int(b), round(h)) for a, b, h in out]


def _segments(held: list[dict], names: dict[bytes, int]) -> list[tuple[int, np.ndarray]]:
    """Blocks of a text -> its stretches without a hole: first word's position, words as numbers."""
    out: list[tuple[int, list[bytes]]] = []
    held.sort(key=lambda x: x["block"])
    for n, x in enumerate(held):
        if n and x["block"] == held[n - 1]["block"] + 1:
            out[-1][1].extend(zlib.decompress(x["words"]).split())
        else:
            out.append((x["block"] * BLOCK, zlib.decompress(x["words"]).split()))
    return [(at, np.fromiter((names.setdefault(w, len(names)) for w in words), "i4", len(words))) for at, words in out]


def _align_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["oid", "k1", "from_oid", "first", "end", "hits"]
    for batch in batches:
        for n in range(0, batch.num_rows, 64):
            out = []
            for r in batch.slice(n, 64).to_pylist():
                known: dict[bytes, int] = {}
                ours, theirs = (_segments(r[c], known) for c in ("ours", "theirs"))
                done: list[tuple[int, int]] = []
                spans: list[tuple[int, int, int]] = []
                for c in sorted(r["chains"], key=lambda c: c["a0"] - c["a1"]):
                    (a_at, a), (b_at, b) = (max((s for s in side if s[0] <= p), key=lambda s: s[0]) for side, p in ((ours, c["a0"]), (theirs, c["b0"])))
                    low, high = max(c["a0"] - K - 1, a_at), min(c["a1"] + K + 1, a_at + len(a))
                    if any(first <= low and high <= end for first, end in done):
                        continue  # a longer chain's alignment holds it and all that it could reach before another seed
                    for first, end, hits in align(a, b, c["a0"] - a_at, c["a1"] - a_at, c["b0"] - b_at, c["b1"] - b_at):
                        done.append((first + a_at, end + a_at))
                        spans.append((first + a_at, end + a_at, hits))
                out.extend((r["oid"], r["k1"], r["from_oid"], *x) for x in merged(spans))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64() if i < 3 else pa.int32()) for i in range(6)], names)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text) with ids that aren't whole numbers -> id, oid: numbers in the order of the ids."""
    ids = docs.select("id").where("id is not null").distinct()
    return settle(ids.orderBy("id").withColumn("oid", F.monotonically_increasing_id()))


PAIR = ["oid", "k1", "from_oid", "from_k1"]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = text_key(F.col(id_col), F.col(text_col))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("oid"), key["a"].alias("k1"), F.col(text_col).alias("_text"))


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the sketches (before, after) of two places, row by row, have a side in common."""
    good = np.zeros(len(x), bool)
    for i in (0, 1):
        own = np.bitwise_count(x[:, i])
        good |= (own > 0) & (np.bitwise_count(x[:, i] & y[:, i]) >= ALIKE * own)
    return good


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, those of a seed together -> each place with the seed's first place and with its last place in the document before, where alike.

    Rows marked as known stand for earlier places that another task meets; they are met here but meet nothing themselves.
    The places of a seed with three or more, or marked with 2 as those of a hot one, are given too, with the seed's hash and
    their sketches, for ``further``.
    """
    names = [*PAIR, "pos", "from_pos", "h", "before", "after", "far"]
    for table in _whole(batches):
        deal = table.column(0).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(deal[1:] != deal[:-1]) + 1])
        sizes = np.diff(np.append(starts, len(deal)))
        keep = np.flatnonzero(np.repeat(sizes > 1, sizes) | (table.column("known").to_numpy() == 2))
        if not len(keep):
            continue
        deal, h, oid, k1, pos, before, after, known, far = (c.to_numpy().astype("i8")[keep] for c in table.columns)
        order = np.lexsort((2 * pos + (known == 1), k1, oid, np.repeat(np.arange(len(sizes)), sizes)[keep]))
        deal, h, oid, k1, pos, before, after, known, far = (c[order] for c in (deal, h, oid, k1, pos, before, after, known, far))
        new = np.ones(len(h), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in (deal, oid, k1, pos)], axis=0)
        if not new.all():  # rows that repeat id and text
            deal, h, oid, k1, pos, before, after, known, far = (c[new] for c in (deal, h, oid, k1, pos, before, after, known, far))
        at = np.arange(len(h))
        new_h = np.ones(len(h), bool)
        new_h[1:] = deal[1:] != deal[:-1]
        new_doc = new_h.copy()
        new_doc[1:] |= (oid[1:] != oid[:-1]) | (k1[1:] != k1[:-1])
        first = np.maximum.accumulate(np.where(new_h, at, 0))
        start = np.maximum.accumulate(np.where(new_doc, at, 0))
        last = np.where(start == first, -1, start - 1)
        own = ~new_h & (known != 1)
        one = np.flatnonzero(own)
        # In the first document of a seed, and where both are one place, there is no second match.
        two = np.flatnonzero(own & (last > first))
        a, b = np.concatenate([one, two]), np.concatenate([first[one], last[two]])
        sketch = np.stack([before, after], axis=1).view("u8")
        good = alike(sketch[a], sketch[b])
        a, b = a[good], b[good]
        starts = np.flatnonzero(new_h)
        sizes = np.diff(np.append(starts, len(h)))
        rest = np.flatnonzero((known == 2) | (known == 0) & np.repeat(sizes > 2, sizes))
        if len(a):
            told = [oid[a], k1[a], oid[b], k1[b], pos[a].astype("i4"), pos[b].astype("i4")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in told] + [pa.nulls(len(a), pa.int64())] * 4, names)
        if len(rest):
            no = [pa.nulls(len(rest), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(oid[rest]), pa.array(k1[rest]), *no, pa.array(pos[rest].astype("i4")), pa.nulls(len(rest), pa.int32()), *(pa.array(c[rest]) for c in (h, before, after, far))], names)


def _places(texts: DataFrame) -> DataFrame:
    return texts.mapInArrow(_seed_rows, "oid long, k1 long, h long, pos int, before long, after long, far long").select("h", "oid", "k1", "pos", "before", "after", "far")


def hot_seeds(texts: DataFrame, hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """h, cuts: seeds with more places than a task should hold, no more than two for each task, and the ids that part their places."""
    drawn = settle(_places(texts.where(F.pmod("k1", F.lit(sample)) == 0)).select("h", "oid"))
    limit = max(hot, sample * drawn.count() // (2 * tasks(texts)))
    many = settle(drawn.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") * sample > limit).select("h"))
    steps = [i / RANGES for i in range(1, RANGES)]
    return settle(drawn.join(F.broadcast(many), "h").groupBy("h").agg(F.percentile_approx("oid", steps).alias("cuts")))


def met(texts: DataFrame, hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """``matches``, and rows with ``h``: the places of all seeds that have three or more.

    The places of a hot seed are dealt by ranges of documents. Each range is given the two places that it needs of the ranges
    before it, the first of all and the last, so it finds the same matches as one task with all places would.
    """
    kinds = "oid long, k1 long, from_oid long, from_k1 long, pos int, from_pos int, h long, before long, after long, far long"
    held = ("deal", "h", "oid", "k1", "pos", "before", "after", "known", "far")
    found, many = _places(texts), hot_seeds(texts, hot, sample)
    if many.isEmpty():
        return found.repartition("h").sortWithinPartitions("h").withColumn("deal", F.col("h")).withColumn("known", F.lit(0)).select(*held).mapInArrow(_meet, kinds)
    many = F.broadcast(many)
    part = F.size(F.filter("cuts", lambda c: c < F.col("oid")))
    place = F.struct("oid", "k1", "pos", "before", "after", "far")
    ends = settle(found.join(many, "h").groupBy("h", part.alias("part")).agg(F.min(place).alias("low"), F.max(place).alias("high")))
    earlier = Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    needed = ends.select("h", "part", F.array_distinct(F.array(F.min("low").over(earlier), F.max("high").over(earlier))).alias("places")).select("h", "part", F.explode("places").alias("p"))
    known = needed.where("p is not null").select("h", "part", "p.*", F.lit(1).alias("known"), F.xxhash64("h", "part").alias("deal"))
    dealt = found.join(many, "h", "left").withColumn("part", F.coalesce(F.when(F.col("cuts").isNotNull(), part), F.lit(0)))
    dealt = dealt.withColumn("known", F.when(F.col("cuts").isNotNull(), 2).otherwise(0)).withColumn("deal", F.when(F.col("cuts").isNotNull(), F.xxhash64("h", "part")).otherwise(F.col("h")))
    return dealt.select(*held).unionByName(known.select(*held)).repartition("deal").sortWithinPartitions("deal").mapInArrow(_meet, kinds)


def matches(texts: DataFrame, hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """Each seed place with the seed's first place and with its place in the nearest earlier document, where alike."""
    return first_matches(met(texts, hot, sample))


def first_matches(seen: DataFrame) -> DataFrame:
    return seen.where("from_oid is not null").select(*PAIR, "pos", "from_pos")


def may_hold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two places (before, after, far), which broadcast, may share a passage: windows of ``NEAR`` words that it spans are alike.

    Of 50 words around a seed, ``NEAR`` or nearly stand on both sides, or twice as many on one. A text that ends before a
    window is full has no sketch of it; then the passage ends there too and the other side tells.
    """

    def near(a, b):
        own = np.bitwise_count(a)
        return (own > 0) & (np.bitwise_count(a & b) >= ALIKE * own)

    half = np.uint64(32)
    before, after = (near(x[..., i], y[..., i]) for i in (0, 1))
    far_before, far_after = near(x[..., 2] >> half, y[..., 2] >> half), near(x[..., 2] & LOWER, y[..., 2] & LOWER)
    no_before, no_after = ((x[..., i] == 0) | (y[..., i] == 0) for i in (0, 1))
    short_before, short_after = ((x[..., 2] >> half == 0) | (y[..., 2] >> half == 0)), ((x[..., 2] & LOWER == 0) | (y[..., 2] & LOWER == 0))
    return before & after | before & (far_before | short_before & no_after) | after & (far_after | short_after & no_before)


def may_reach(x: np.ndarray, y: np.ndarray, min_words: int, similarity: float) -> np.ndarray:
    """Words around two places, a byte each (``_windows``) -> by how many words a passage that holds both may at most be above the bar; below 0, none can.

    The longest common subsequence of the words on each side, for every number of the first place's words, bounds what any
    alignment can match there. It is found for many pairs at once, the second place's words as bits (Hyyro).
    """
    need, width = min_words - K, x.shape[1] // 2
    gains = []
    for side in (slice(0, width), slice(width, None)):
        own, other = x[:, side], np.pad(y[:, side], ((0, 0), (0, 64 - width)))
        gain, free = np.zeros((len(x), width + 1), "f4"), np.full(len(x), 2**64 - 1, "u8")
        for i in range(width):
            met = free & np.packbits(other == own[:, i : i + 1], axis=1, bitorder="little").view("<u8")[:, 0]
            free = (free + met) | (free - met)
            gain[:, i + 1] = np.bitwise_count(~free) - np.float32(similarity * (i + 1))
        gain[:, 1:][own == 0] = -np.inf  # no such word
        gains.append(gain)
    # Words on one side, and the best of so many or more on the other that both make up min_words; those beyond a window count as met.
    best = np.maximum.accumulate(gains[1][:, ::-1], axis=1)[:, ::-1]
    least = need - np.arange(width + 1)
    beyond = (1 - similarity) * np.maximum(0, least - width)
    return (gains[0] + best[:, np.clip(least, 0, width)] + beyond + K * (1 - similarity)).max(axis=1) + 1e-3


def holds(x: np.ndarray, y: np.ndarray, min_words: int, similarity: float) -> bool:
    """Whether the windows of two places, aligned, are a passage already."""
    width, words, hits = len(x) // 2, K, K
    for side in (slice(0, width), slice(width, None)):
        own, other = (w[side][: np.count_nonzero(w[side])] for w in (x, y))
        end, met = extend(own, other)
        words, hits = words + end, hits + met
    return words >= min_words and hits >= similarity * words


def _windows(width: int):
    """oid, k1, rows of tiles, text -> those rows, each with a byte for every of ``width`` words before it (nearest first) and after its seed, 0 where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = np.zeros(width, "u1")
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lists = part.column("rows")
                ends, rows = np.cumsum(pc.list_value_length(lists).to_numpy()), lists.flatten()
                pos, windows, low = rows.field(1).to_numpy(), [], 0
                for text, high in zip(part.column("_text").cast(pa.large_binary()).to_pylist(), ends.tolist(), strict=True):
                    told = np.concatenate([edge, np.array([1 + zlib.crc32(w) % 255 for w in text.split()], "u1"), edge])
                    at = pos[low:high, None].astype("i8") + np.arange(width)
                    windows.append(np.concatenate([told[at][:, ::-1], told[at + width + K]], axis=1))
                    low = high
                take = pa.array(np.repeat(np.arange(part.num_rows), np.diff(ends, prepend=0)))
                held = pa.array([w.tobytes() for w in np.concatenate(windows)], pa.binary())
                fields = [rows.field(i) for i in range(rows.type.num_fields)]
                yield pa.RecordBatch.from_arrays([part.column("oid").take(take), part.column("k1").take(take), *fields, held], ["oid", "k1", *[rows.type.field(i).name for i in range(rows.type.num_fields)], "window"])

    return run


#: A place in a tile: what it does there (0 asks, 1 is asked, 2 both), its number in its seed if the tile holds the whole seed, and that
#: of its nearest place in an earlier document, which it has met already, as it has the seed's first place.
PLACE = ["tile", "role", "oid", "k1", "pos", "before", "after", "far", "nth", "tried"]
PLACE_KINDS = "tile long, role int, oid long, k1 long, pos int, before long, after long, far long, nth int, tried int"


def _tiles(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple[pa.Table, dict[str, np.ndarray]]]:
    """Rows, those of a tile together -> whole tiles in which someone asks, places in order and each once in its role; their columns."""
    for table in _whole(batches):
        tile, role = (table.column(n).to_numpy() for n in ("tile", "role"))
        starts = np.concatenate([[0], np.flatnonzero(tile[1:] != tile[:-1]) + 1])
        sizes = np.diff(np.append(starts, len(tile)))
        live = np.logical_or.reduceat(role != 1, starts) & np.logical_or.reduceat(role != 0, starts) & (sizes > 1)
        table = table.filter(pa.array(np.repeat(live, sizes)))
        if not len(table):
            continue
        columns = [table.column(n).to_numpy().astype("i8") for n in ("role", "pos", "k1", "oid", "tile")]
        order = np.lexsort(columns)
        new = np.ones(len(order), bool)
        new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
        table = table.take(pa.array(order[new]))
        yield table, {n: table.column(n).to_numpy().astype("i8") for n in PLACE if n in table.column_names}


def _numbered(c: dict[str, np.ndarray]) -> None:
    """Tells the places of tiles that hold a whole seed their numbers, and which of them they have met."""
    at = np.arange(len(c["tile"]))
    new = np.ones(len(at), bool)
    new[1:] = c["tile"][1:] != c["tile"][:-1]
    first = np.maximum.accumulate(np.where(new, at, 0))
    new[1:] |= (c["oid"][1:] != c["oid"][:-1]) | (c["k1"][1:] != c["k1"][:-1])
    start = np.maximum.accumulate(np.where(new, at, 0))
    whole = np.logical_and.reduceat((c["role"] != 0), np.flatnonzero(first == at))[np.cumsum(first == at) - 1] & (c["nth"] == 0)
    c["nth"], c["tried"] = np.where(whole, at - first, -1), np.where(whole & (start > first), start - 1 - first, -2)


def _tile_pairs(c: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tiles -> row numbers of each place that asks and of every earlier place asked there that it hasn't met and may share a passage with; one that asks stays in one piece."""
    new_tile = np.ones(len(c["tile"]), bool)
    new_tile[1:] = c["tile"][1:] != c["tile"][:-1]
    new = new_tile.copy()
    new[1:] |= np.any([c[n][1:] != c[n][:-1] for n in ("oid", "k1", "pos")], axis=0)
    at = np.arange(len(new))
    place, tile = (np.maximum.accumulate(np.where(x, at, 0)) for x in (new, new_tile))
    sketch = np.stack([c[n] for n in ("before", "after", "far")], axis=1).view("u8")
    ask, asked = np.flatnonzero(c["role"] != 1), np.flatnonzero(c["role"] != 0)
    # Rows of one place are neighbours, so none is its own partner.
    low = np.searchsorted(asked, tile[ask])
    count = np.searchsorted(asked, place[ask]) - low
    apart = lambda p, q: (c["nth"][q] != 0) & (c["nth"][q] != c["tried"][p])
    near = lambda p, q: alike(sketch[p, :2], sketch[q, :2])
    both = lambda p, q: may_hold(sketch[p], sketch[q])

    def kept(p: np.ndarray, q: np.ndarray, *rules) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for rule in rules:
            good = rule(p, q)
            p, q = p[good], q[good]
        if len(p):
            yield p, q

    # Of large tiles all that are asked are held against some that ask at once, without rows for their pairs.
    own = np.bitwise_count(sketch[ask, :2])
    bars = np.where(own > 0, np.ceil(ALIKE * own), 255).astype("u1")
    starts = np.flatnonzero(np.diff(low, prepend=-1)) if len(low) else np.zeros(0, "i8")
    ends = np.append(starts[1:], len(ask)).astype("i8")
    most = np.maximum.reduceat(count, starts) if len(starts) else count
    large = (ends - starts) * most >= LARGE
    for x, y, n in zip(starts[large].tolist(), ends[large].tolist(), most[large].tolist(), strict=True):
        there = asked[low[x] : low[x] + n]
        at_once = max(1, 8 * PAIRS // max(1, n))
        for a in range(x, y, at_once):
            b = min(y, a + at_once)
            good = np.zeros((b - a, n), bool)
            for i in (0, 1):
                good |= np.bitwise_count(sketch[ask[a:b], i][:, None] & sketch[there, i][None, :]) >= bars[a:b, i][:, None]
            good &= np.arange(n) < count[a:b, None]
            p, q = np.nonzero(good)
            yield from kept(ask[a + p], there[q], apart, both)
    small = np.repeat(~large, ends - starts)
    ask, low, count = ask[small], low[small], count[small]
    # As many that ask as make up PAIRS pairs at a time.
    cut = np.searchsorted(np.cumsum(count), np.arange(PAIRS, count.sum() + PAIRS, PAIRS), "right")
    for a, b in zip([0, *cut], [*cut, len(ask)], strict=True):
        if a < b:
            p = np.repeat(ask[a:b], count[a:b])
            q = asked[np.arange(len(p)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b]) + np.repeat(low[a:b], count[a:b])]
            yield from kept(p, q, apart, near, both)


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of tiles -> those in any pair."""
    for table, c in _tiles(batches):
        _numbered(c)
        met = np.zeros(len(table), bool)
        for p, q in _tile_pairs(c):
            met[p] = met[q] = True
        if met.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[n][met].astype("i4") if n in ("role", "pos", "nth", "tried") else c[n][met]) for n in PLACE], PLACE)


def _further(min_words: int, similarity: float):
    """Rows of tiles with windows -> each place that asks with a partner whose window makes a passage with its own; if none of the best ``TRIES`` does, with every partner not ruled out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, c in _tiles(batches):
            held = table.column("window").to_pylist()
            windows = np.frombuffer(b"".join(held), "u1").reshape(len(held), -1)
            out: list[tuple[int, int]] = []
            for ps, qs in _tile_pairs(c):
                score = np.concatenate([may_reach(windows[ps[a : a + 4096]], windows[qs[a : a + 4096]], min_words, similarity) for a in range(0, len(ps), 4096)])
                order = np.lexsort((qs, -score, ps))
                order = order[score[order] > 0]
                ps, qs = ps[order], qs[order]
                starts = np.flatnonzero(np.diff(ps, prepend=-1))
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ps)], strict=False):
                    p = int(ps[a])
                    found = next((q for q in qs[a : min(b, a + TRIES)].tolist() if holds(windows[p], windows[q], min_words, similarity)), None)
                    out.extend((p, q) for q in (qs[a:b].tolist() if found is None else [found]))
            if out:
                p, q = np.array(out).T
                columns = [c["oid"][p], c["k1"][p], c["oid"][q], c["k1"][q], c["pos"][p].astype("i4"), c["pos"][q].astype("i4")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [*PAIR, "pos", "from_pos"])

    return run


def further(texts: DataFrame, seen: DataFrame, kept: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """Matches of places that no passage of ``kept`` holds with earlier places of their seed, any but those they have met, that share a passage with them.

    A seed's places are one tile, or are dealt into tiles where they are many, so no task holds a large seed; places inside
    passages are asked but don't ask. Sketches tell which places have a partner at all; the words around those then tell
    which pairs leave room for a passage. A passage has one source, so a place whose partner is sure needs no other.
    """
    spans = kept.groupBy("oid", "k1").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    inside = F.exists("spans", lambda s: (s["first"] <= F.col("pos")) & (F.col("pos") + K <= s["end"]))
    places = seen.where("h is not null").select("h", "oid", "k1", "pos", "before", "after", "far")

    def opened(rows: DataFrame) -> DataFrame:
        return rows.join(spans, ["oid", "k1"], "left").withColumn("open", ~F.coalesce(inside, F.lit(False))).drop("spans")

    many = settle(places.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > TILE_PLACES))
    if large := not many.isEmpty():
        # At most one seed for every TILE_PLACES rows.
        sizes = opened(places.join(F.broadcast(many), "h")).groupBy("h").agg(F.first("n").alias("n"), F.count_if("open").alias("asks"))
        many = settle(sizes.select("h", F.ceil(F.col("asks") / TILE_ASKS).cast("int").alias("down"), F.ceil(F.col("n") / TILE_PLACES).cast("int").alias("across")))
    rows = opened(places).withColumn("nth", F.lit(0))
    if not large:
        rows = rows.select(F.col("h").alias("tile"), F.when(F.col("open"), 2).otherwise(1).alias("role"), *PLACE[2:9])
    else:
        dealt = rows.join(F.broadcast(many), "h", "left").withColumn("deal", F.xxhash64("oid", "k1", "pos"))
        no_tile = F.array().cast("array<struct<tile:bigint,role:int,nth:int>>")

        def dealt_to(row, column, role: int):
            return F.struct(F.xxhash64("h", row, column).alias("tile"), F.lit(role).alias("role"), F.lit(-1).alias("nth"))

        # Numbers from 1, so that a seed without open places has no tile.
        asked = F.when(F.col("down") > 0, F.transform(F.sequence(F.lit(1), F.col("down")), lambda i: dealt_to(i, (F.pmod("deal", F.col("across")) + 1).cast("int"), 1)))
        asks = F.when(F.col("open") & (F.col("down") > 0), F.transform(F.sequence(F.lit(1), F.col("across")), lambda i: dealt_to((F.pmod("deal", F.col("down")) + 1).cast("int"), i, 0)))
        own = F.array(F.struct(F.col("h").alias("tile"), F.when(F.col("open"), 2).otherwise(1).alias("role"), F.lit(0).alias("nth")))
        placed = F.when(F.col("down").isNull(), own).otherwise(F.concat(F.coalesce(asked, no_tile), F.coalesce(asks, no_tile)))
        rows = dealt.select(F.explode(placed).alias("t"), "oid", "k1", "pos", "before", "after", "far").select("t.tile", "t.role", *PLACE[2:8], "t.nth")
    rows = rows.withColumn("tried", F.lit(0)).select(*PLACE)
    involved = settle(rows.repartition(tasks(seen), "tile").sortWithinPartitions("tile").mapInArrow(_involved, PLACE_KINDS))
    wanted = involved.groupBy("oid", "k1").agg(F.collect_list(F.struct("tile", "pos", "role", "before", "after", "far", "nth", "tried")).alias("rows"))
    kinds = "oid long, k1 long, tile long, pos int, role int, before long, after long, far long, nth int, tried int, window binary"
    windows = texts.join(wanted, ["oid", "k1"]).select("oid", "k1", "rows", "_text").mapInArrow(_windows(min(64, max(NEAR, min_words - K + SHIFT))), kinds)
    pairs = windows.repartition(tasks(seen), "tile").sortWithinPartitions("tile").select(*PLACE, "window")
    return pairs.mapInArrow(_further(min_words, similarity), "oid long, k1 long, from_oid long, from_k1 long, pos int, from_pos int")


def candidates(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Chains of the matches ``found``, gathered by region and source; ``ask`` numbers the groups. No length is asked here: a passage may keep one seed."""
    pairs = found.repartition(tasks(texts), *PAIR).sortWithinPartitions(*PAIR, "pos", "from_pos")
    chains = pairs.mapInArrow(_chains, "oid long, k1 long, from_oid long, from_k1 long, a0 int, a1 int, b0 int, b1 int")
    along = Window.partitionBy("oid", "k1").orderBy("a0", "a1", "from_oid", "from_k1", "b0")
    so_far = along.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("a0") > F.max("a1").over(so_far) + JUMP, F.lit(True)).cast("int")
    numbered = chains.withColumn("new", new).withColumn("region", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    asks = numbered.groupBy(*PAIR, "region").agg(F.collect_list(F.struct("a0", "a1", "b0", "b1")).alias("chains"))
    return settle(asks.withColumn("ask", F.monotonically_increasing_id()))


def aligned(texts: DataFrame, asks: DataFrame, min_words: int) -> DataFrame:
    """Alignments of the chains: only the blocks of words around them are brought together, once for each region and source."""

    margin = max(MARGIN, min_words)

    def wanted(side: str, oid: str, k1: str, first: str, end: str) -> DataFrame:
        def of(c):
            return F.sequence(F.greatest(F.lit(0), F.floor((c[first] - margin) / BLOCK)).cast("int"), F.floor((c[end] + margin) / BLOCK).cast("int"))

        blocks = F.array_distinct(F.flatten(F.transform("chains", of)))
        return asks.select("ask", F.lit(side).alias("side"), F.col(oid).alias("oid"), F.col(k1).alias("k1"), F.explode(blocks).alias("block"))

    blocks = texts.mapInArrow(_blocks, "oid long, k1 long, block int, words binary")
    asked = wanted("a", "oid", "k1", "a0", "a1").unionByName(wanted("b", "from_oid", "from_k1", "b0", "b1"))
    held = F.struct("block", "words")
    sides = asked.join(blocks, ["oid", "k1", "block"]).groupBy("ask").agg(*[F.collect_set(F.when(F.col("side") == s, held)).alias(n) for s, n in (("a", "ours"), ("b", "theirs"))])
    rows = asks.join(sides, "ask").select("oid", "k1", "from_oid", "chains", "ours", "theirs")
    return rows.mapInArrow(_align_rows, "oid long, k1 long, from_oid long, first int, end int, hits int")


def _in_regions(found: DataFrame) -> DataFrame:
    """Alignments with their ``region``, those that meet being one, and the words that each adds to it, ``fresh``, with those matched, ``good``."""
    order = Window.partitionBy("oid", "k1").orderBy("first", "end", "from_oid", "hits")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", F.coalesce(F.col("first") > before, F.lit(True)).cast("int")).withColumn("before", before)
    found = found.withColumn("region", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.when(F.col("new") == 0, F.col("before"))
    found = found.withColumn("fresh", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("first"), F.coalesce(before, F.lit(0)))))
    length = F.col("end") - F.col("first")
    return found.withColumn("good", F.col("hits") * F.col("fresh") / length).withColumn("length", length)


def passages_of(found: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """Alignments -> those stretches that they cover which are long and alike enough.

    Where a stretch as a whole isn't, because a poor alignment covers words of a good one, those alignments count that are passages by themselves.
    """
    columns = ["oid", "k1", "from_oid", "first", "end", "hits"]
    parts = _in_regions(found.where("end > first").select(*columns))
    region = Window.partitionBy("oid", "k1", "region")
    whole = (F.sum("fresh").over(region) >= min_words) & (F.sum("good").over(region) >= similarity * F.sum("fresh").over(region) - 1e-6)
    alone = (F.col("length") >= min_words) & (F.col("hits") >= similarity * F.col("length"))
    parts = _in_regions(parts.withColumn("whole", whole).where(F.col("whole") | alone).select(*columns))
    regions = parts.groupBy("oid", "k1", "region").agg(
        F.min("first").alias("first"), F.max("end").alias("end"), F.sum("fresh").alias("covered"), F.sum("good").alias("good"), F.max(F.struct("length", (-F.col("from_oid")).alias("less"))).alias("source")
    )
    # Words matched are parts of whole numbers: a sum that is the bar itself must not fall below it by rounding.
    return regions.where((F.col("covered") >= min_words) & (F.col("good") >= similarity * F.col("covered") - 1e-6))


def repeated_passages(docs: DataFrame, min_words: int = 50, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each repeated passage: id, first and end (words from 0, end exclusive), from_id (where most of it stands earlier), matched."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not isinstance(docs.schema["id"].dataType, IntegralType):
        names = numbered(docs)
        known = repeated_passages(docs.join(names, "id", "left").select("oid", "text"), min_words, similarity, "oid")
        for c in ("id", "from_id"):
            known = known.join(names.select(F.col("id").alias(f"_{c}"), F.col("oid").alias(c)), c, "left")
        return known.select(F.col("_id").alias("id"), "first", "end", F.col("_from_id").alias("from_id"), "matched")
    texts = _texts(docs, "id", "text")
    seen = settle(met(texts))
    found = settle(aligned(texts, candidates(texts, first_matches(seen)), min_words))
    kept = settle(passages_of(found, min_words, similarity))
    more = settle(further(texts, seen, kept, min_words, similarity))
    if not more.isEmpty():
        asks = candidates(texts, more)
        asked = asks.select("oid", "k1").unionByName(asks.select(F.col("from_oid").alias("oid"), F.col("from_k1").alias("k1"))).distinct()
        found = found.unionByName(aligned(texts.join(asked, ["oid", "k1"], "left_semi"), asks, min_words))
        kept = passages_of(settle(found), min_words, similarity)
    no = F.lit(NO_ID)
    return kept.select(
        F.when(F.col("oid") != no, F.col("oid")).alias("id"), "first", "end", F.when(-F.col("source.less") != no, -F.col("source.less")).alias("from_id"), F.round("good").cast("long").alias("matched")
    )
