"""Token ids of a text by a word-end BPE file, word by word.

The file's tokenizer drops white space and never merges across it, so a text's ids are its words' ids in order. Frequent
words are looked up. Other words of plain characters are merged by a byte-pair engine that holds the same merges (a
closing byte stands for the word end); any other word goes through the tokenizer itself.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

END = "\x00"
#: Words remembered in one Python process.
REMEMBERED = 600_000
#: Characters on which composing and lower-casing are plain.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
WORD_BREAK = re.compile("[ \n]")


def _byte_letters() -> dict[int, str]:
    """Printable stand-ins of bytes: themselves where printable, else the next free code points from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


class WordTokens:
    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split)
        close = spec["model"]["end_of_word_suffix"]
        letters = _byte_letters()
        code = {v: k for k, v in letters.items()}
        tail = END.encode()

        def raw(symbol: str) -> bytes:
            return bytes(code[c] for c in symbol.removesuffix(close)) + tail * symbol.endswith(close)

        ranks, ids = {bytes([b]): b for b in range(256)}, np.zeros(512 + len(merges), "<u4")
        for b, c in letters.items():
            ids[b] = vocab[c]
            if b:
                ranks[bytes([b, 0])] = 256 + b
                ids[256 + b] = vocab[c + close]
        for i, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if ranks.setdefault(raw(a + b) if not a.endswith(close) else b"", 512 + i) == 512 + i:
                ids[512 + i] = vocab[a + b]
        self.ids = ids
        self.closes = np.zeros(len(ids), bool)
        for token, rank in ranks.items():
            self.closes[rank] = token.endswith(tail) and len(token) > 1
        self.engine = tiktoken.Encoding("words", pat_str=f"[^{END}]*{END}", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {"": b""}

    def _look_up(self, words: set[str]) -> dict[str, bytes]:
        letters = [w for w in words if w.isascii() and w.isalpha() and len(w) < 1000]  # one piece each
        others = words.difference(letters)
        plain = [w for w in others if len(w) < 1000 and PLAIN.fullmatch(w) and "<|" not in w]
        found = {w: np.array(self.whole.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in others.difference(plain)}
        if letters or plain:
            parts = [[low] if (low := w.lower()).isalpha() else self.pieces.findall(low) for w in plain]
            pieces = [w.lower() for w in letters]
            pieces.extend(p for ps in parts for p in ps)
            rank = np.array(self.engine.encode_ordinary(END.join(pieces) + END), "i8")
            ends = np.flatnonzero(self.closes[rank]) + 1
            last = np.cumsum(np.array([1] * len(letters) + [len(p) for p in parts]))
            stops = np.concatenate([[0], ends[last - 1]]) * 4
            flat, stops = self.ids[rank].tobytes(), stops.tolist()
            found.update((w, flat[a:b]) for w, a, b in zip(letters + plain, stops, stops[1:], strict=False))
        return found

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` each of a few texts: words that aren't remembered are looked up together, and forgotten again where there are too many."""
        split = [text.replace("\n", " ").split(" ") for text in texts]
        known = self.known
        new = set().union(*split).difference(known)
        if new:
            known.update(self._look_up(new))
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        if len(known) > REMEMBERED:
            for word in new:
                del known[word]
        return out


def find_tokenizer(name: str) -> str:
    """A path as it is; a name without a folder is looked up among this machine's public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def word_tokens(name: str) -> WordTokens:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokens(find_tokenizer(name))
