"""Token ids of a byte-level BPE vocabulary of the tokenizers library, many texts at once.

Byte-level BPE works inside pieces (a word with its leading blank, a number, a
run of signs, white space), and most pieces come again. Pieces are cut and
hashed with array operations; the library encodes each distinct piece once per
worker. Texts with characters outside the checked ranges go to the library whole.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np

from spectraloom.llm.common import factorize, segments

#: distinct pieces that a worker keeps; beyond it those go that did not come again, and all if more than half would stay
KEPT_PIECES = 1_500_000
#: pieces that the library encodes at a time: what it returns takes about a kilobyte a piece
NEW_PIECES = 5_000
LETTER, NUMBER, OTHER, SPACE, END, UNKNOWN = 1, 2, 3, 4, 5, 6
BREAK = 0x110000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point that has been stable in Unicode for long; the others are UNKNOWN."""
    table = np.full(BREAK + 1, UNKNOWN, np.uint8)
    for low, high in ((0x20, 0x250), (0x370, 0x600), (0x2000, 0x2070), (0x20A0, 0x20BE), (0x2190, 0x2300), (0x3041, 0x3097), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4)):
        for c in range(low, high):
            kind = unicodedata.category(chr(c))
            table[c] = {"L": LETTER, "N": NUMBER, "Z": SPACE}.get(kind[0], OTHER) if kind not in ("Cn", "Cc", "Cf") else UNKNOWN
    table[9:14] = SPACE
    table[BREAK] = END
    return table


def _piece_starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pieces begin: ``'s``-like endings, runs of one class with one leading blank, white space."""
    n = len(points)
    start = np.ones(n, bool)
    start[1:] = kinds[1:] != kinds[:-1]
    space = kinds == SPACE
    after = np.zeros(n, bool)
    after[:-1] = space[:-1] & ~space[1:] & (kinds[1:] != END)
    at = np.flatnonzero(after)
    start[at] = True
    blank = at[points[at] == 32]
    start[blank + 1] = False
    quote = np.flatnonzero((points == 39) & start)
    if len(quote):
        padded = np.concatenate([points, [BREAK, BREAK, BREAK]])
        one, two = padded[quote + 1], padded[quote + 2]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for mask, size in ((single, 1), (double & ~single, 2)):
            begin = quote[mask]
            start[begin + 1] = False
            rest = begin + 1 + size
            rest = rest[rest < n]
            start[rest] = True
    start[kinds == END] = True
    return start


class Encoder:
    """Ids of whole texts, equal to the library's own for each text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # texts that hold the string of an added token go to the library whole
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        self.keys, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)

    def _drop_unused(self) -> None:
        """Keep the pieces that came again since the last time; most pieces come once."""
        stay = np.flatnonzero(self.again)
        size = self.size[stay]
        stop = np.cumsum(size, dtype=np.int64)
        total = int(stop[-1]) if len(stop) else 0
        self.ids = self.ids[np.arange(total) - np.repeat(stop - size, size) + np.repeat(self.at[stay], size)]
        self.keys, self.at, self.size, self.again = self.keys[stay], stop - size, size, np.zeros(len(stay), bool)

    def _keep(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Remember pieces for later calls; a full store drops pieces that did not come again."""
        if len(self.keys) + len(keys) > KEPT_PIECES:
            self._drop_unused()
            if 2 * max(len(self.keys), len(keys)) > KEPT_PIECES:
                self._reset()
        if len(keys) > KEPT_PIECES:
            return
        order = np.argsort(keys)
        at = (len(self.ids) + np.cumsum(size) - size)[order]
        self.ids = np.concatenate([self.ids, ids])
        # both are sorted: merged, not sorted again
        into = np.searchsorted(self.keys, keys[order])
        self.at, self.size = np.insert(self.at, into, at), np.insert(self.size, into, size[order])
        self.again = np.insert(self.again, into, False)
        self.keys = np.insert(self.keys, into, keys[order])

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        out: list[np.ndarray | None] = [None] * len(texts)
        joined = chr(0x10FFFF).join(texts) + chr(0x10FFFF)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths + 1) - 1
        points[ends] = BREAK
        kinds = _classes()[points]
        odd = np.add.reduceat(kinds == UNKNOWN, np.concatenate([[0], ends[:-1] + 1]))
        odd += np.fromiter((any(x in t for x in self.added) for t in texts), np.int64, len(texts))
        start = _piece_starts(points, kinds)
        begin = np.flatnonzero(start)
        end = np.concatenate([begin[1:], [len(points)]])
        real = kinds[begin] != END
        begin, end = begin[real], end[real]
        doc = np.searchsorted(ends, begin)
        fine = odd[doc] == 0
        begin, end, doc = begin[fine], end[fine], doc[fine]
        codes, keys = factorize(segments(points, begin, end))
        # this call's own table of pieces: what the store knows, and the rest from the library
        place, known = self._places(keys)
        sizes, starts = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        sizes[known], starts[known] = self.size[place[known]], self.at[place[known]]
        self.again[place[known]] = True
        table = self.ids
        if not known.all():
            first = np.empty(len(keys), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            new = np.flatnonzero(~known)
            parts = []
            for low in range(0, len(new), NEW_PIECES):
                some = new[low : low + NEW_PIECES]
                got = [e.ids for e in self.tokenizer.encode_batch_fast([joined[begin[first[i]] : end[first[i]]] for i in some], add_special_tokens=False)]
                sizes[some] = np.fromiter(map(len, got), np.int64, len(got))
                parts.append(np.fromiter((i for x in got for i in x), np.uint32))
            fresh = np.concatenate(parts)
            starts[new] = len(table) + np.cumsum(sizes[new]) - sizes[new]
            table = np.concatenate([table, fresh])
            self._keep(keys[new], sizes[new], fresh)
        at, size = starts[codes], sizes[codes]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        flat = table[np.arange(total) - np.repeat(stop - size, size) + np.repeat(at, size)]
        per_doc = np.bincount(doc, weights=size, minlength=len(texts)).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(per_doc)])
        for i in range(len(texts)):
            out[i] = flat[bounds[i] : bounds[i + 1]] if not odd[i] else np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
