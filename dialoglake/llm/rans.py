"""A static range asymmetric numeral system over token ids, many lanes and many blocks at a time.

One table of frequencies, of ``2**SCALE`` in all, serves every block. A block deals its ids in turn to ``LANES`` states of
64 bits, which give off 32 bits whenever they would overflow; lanes share one stream of words, in the order in which a
decoder asks for them. Every ``MARK`` rounds the states and the place in the stream are kept: a checkpoint, from which a
decoder can start, so all checkpoints of all blocks at hand are decoded at once, side by side.
"""

from __future__ import annotations

import numpy as np

SCALE, LOW, LANES, MARK = 20, np.uint64(2**31), 128, 128
#: Ids between two checkpoints, and in a full block.
SEGMENT, BLOCK = LANES * MARK, 4 * LANES * MARK
_BITS, _WORD, _MASK = np.uint64(SCALE), np.uint64(32), np.uint64(2**SCALE - 1)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Whole frequencies in proportion to ``counts`` that sum to ``2**SCALE``; what occurs gets 1 at least, what doesn't gets 0."""
    total = int(counts.sum())
    if np.count_nonzero(counts) > 2**SCALE:
        raise ValueError(f"more than {2**SCALE} different ids")
    if not total:
        return np.zeros(len(counts), "u4")
    exact = counts.astype("f8") * (2**SCALE / total)
    held = np.where(counts > 0, np.maximum(1, np.floor(exact)), 0).astype("i8")
    order = np.argsort(-held, kind="stable")
    while over := int(held.sum()) - 2**SCALE:
        if over < 0:
            held[order[0]] -= over
        else:
            large = order[held[order] > 1][:over]
            held[large] -= 1
    return held.astype("u4")


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype("u8")
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype("u8") if len(freq) else np.zeros(0, "u8")
        self.most = self.freq << np.uint64(63 - SCALE)  # a state at or above it gives off a word first
        self.symbol = np.repeat(np.arange(len(freq), dtype="u4"), freq)
        self.filler = int(freq.argmax()) if len(freq) else 0  # pads a last, unfilled round


def encode(ids: np.ndarray, table: Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``ids`` (blocks, rounds, LANES) -> for each block: states at its checkpoints, their places in the words, the words."""
    blocks, rounds, lanes = ids.shape
    x = np.full((blocks, lanes), LOW, "u8")
    words, given = np.empty((rounds, blocks, lanes), "u4"), np.empty((rounds, blocks, lanes), bool)
    states = np.empty((-(-rounds // MARK), blocks, lanes), "u8")
    for t in range(rounds - 1, -1, -1):
        now = ids[:, t]
        f = table.freq[now]
        given[t] = full = x >= table.most[now]
        words[t] = x  # its lower half
        x = np.where(full, x >> _WORD, x)
        quotient = x // f
        x = (quotient << _BITS) + (x - quotient * f) + table.start[now]
        if t % MARK == 0:
            states[t // MARK] = x
    out = []
    for b in range(blocks):
        before = np.concatenate([[0], np.cumsum(given[:, b].sum(axis=1))])
        out.append((states[:, b], before[:rounds:MARK].astype("u4"), words[:, b][given[:, b]]))
    return out


def decode(states: np.ndarray, at: np.ndarray, words: np.ndarray, rounds: int, table: Table) -> np.ndarray:
    """From each checkpoint (``states`` row, place ``at`` in ``words``) so many rounds on -> ids (checkpoints, rounds, lanes)."""
    x, at, words = states.copy(), at.astype("i8")[:, None], np.append(words, np.uint32(0)).astype("u8")
    out = np.empty((len(x), rounds, x.shape[1]), "u4")
    for t in range(rounds):
        slot = x & _MASK
        out[:, t] = now = table.symbol[slot]
        x = table.freq[now] * (x >> _BITS) + slot - table.start[now]
        short = x < LOW
        asked = np.cumsum(short, axis=1)
        x = np.where(short, (x << _WORD) | words[np.minimum(at + asked - 1, len(words) - 1)], x)
        at = at + asked[:, -1:]
    return out
