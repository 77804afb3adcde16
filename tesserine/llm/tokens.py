"""Token ids of a byte-level BPE vocabulary, word by distinct word.

Texts are cut into the vocabulary's pre-tokens with array operations over whole batches: the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
splits only where the kind of character changes, so its marks follow from the runs of letters, numbers, white
space and other signs. Each distinct pre-token goes to the tokenizer once and is remembered; within a block pre-tokens are
told apart by a 64-bit hash.

The strings of the vocabulary's special tokens get their ids wherever they stand in a text, as in the library's default mode;
with `special=False` they are ordinary text (the library's `encode_special_tokens`).
"""

from __future__ import annotations

import os
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

from . import anchors

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Code points worked on at once, pre-tokens remembered at most.
BLOCK, REMEMBERED = 1 << 19, 1 << 18
#: Unicode's White_Space.
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
DEFAULT = "byte_bpe_50k.json"


@lru_cache(1)
def _kinds() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    first = np.array([unicodedata.category(chr(i))[0] for i in range(0x30000)] + ["C"] * 0, dtype="U1")
    table[: len(first)][first == "L"] = LETTER
    table[: len(first)][first == "N"] = NUMBER
    for i in range(0x30000, 0x32400):
        if unicodedata.category(chr(i))[0] == "L":
            table[i] = LETTER
    table[_WHITE] = SPACE
    return table


@lru_cache(1)
def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: itself if visible, else the next from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


def vocabulary_path(name: str = DEFAULT) -> str:
    """The file of a public tokenizer; a path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def pretokens(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in code points of several texts; starts: where texts begin, ascending, the first at 0."""
    n = len(points)
    kind = _kinds()[points]
    fresh = np.zeros(n + 1, bool)
    fresh[starts] = True
    fresh[n] = True
    edge = fresh.copy()
    edge[1:n] |= kind[1:] != kind[:-1]
    begin = np.flatnonzero(edge[:n])
    end = np.append(begin[1:], n)
    of = kind[begin]
    mark = np.zeros(n + 1, bool)
    space = of == SPACE
    mark[begin[space]] = True
    followed = space & ~fresh[end] & (end - begin > 1)
    mark[end[followed] - 1] = True
    solid = begin[~space]
    attached = (solid > 0) & ~fresh[solid] & (points[solid - 1] == 32)
    mark[solid[~attached]] = True
    # Contractions: a lone apostrophe that no space precedes, and letters after it.
    lone = np.flatnonzero((of[:-1] == OTHER) & (of[1:] == LETTER) & (end[:-1] - begin[:-1] == 1)) if len(of) > 1 else np.zeros(0, int)
    if len(lone):
        at = begin[lone]
        lone = lone[(points[at] == 39) & ~fresh[at + 1] & ~((at > 0) & ~fresh[at] & (points[at - 1] == 32))]
        at, stop = begin[lone], end[lone + 1]
        one = points[at + 1]
        two = points[np.minimum(at + 2, n - 1)]
        long = (at + 2 < stop) & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        size = np.where(np.isin(one, [115, 116, 109, 100]), 2, np.where(long, 3, 0))
        at, size, stop = at[size > 0], size[size > 0], stop[size > 0]
        mark[at + 1] = False
        after = (at + size)[at + size < stop]
        mark[after] = True
    return np.flatnonzero(mark[:n])


class WordTokenizer:
    """Token ids of many texts with one vocabulary file of the tokenizers library."""

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.marks = [t.content for t in self.whole.get_added_tokens_decoder().values()] if special else []
        self.known: dict[str, bytes] = {}

    def ids(self, word: str) -> bytes:
        """The ids of a pre-token, four bytes each."""
        found = self.known.get(word)
        if found is None:
            letters = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(_byte_letters())
            found = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        marked = [i for i, t in enumerate(texts) if any(m in t for m in self.marks)]
        if marked:  # texts with special tokens are left to the library
            plain = iter(self.encode([t for i, t in enumerate(texts) if i not in set(marked)]))
            return [np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32) if i in set(marked) else next(plain) for i, t in enumerate(texts)]
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK):
                size += len(texts[to])
                to += 1
            out += self._encode(texts[at:to])
            at = to
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        sizes = np.array([len(t) for t in texts], np.int64)
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return [np.zeros(0, np.uint32)] * len(texts)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        begin = pretokens(points, np.unique(bounds[:-1][sizes > 0]))
        end = np.append(begin[1:], len(points))
        total = anchors.sums(points.astype(np.uint64) + np.uint64(1))
        keys = anchors.spans(total, begin, end)
        distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
        found = [self.ids(whole[begin[i] : end[i]]) for i in where.tolist()]
        each = np.array([len(x) for x in found], np.int64) // 4
        pool, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(each) - each
        count = each[back]
        stop = np.cumsum(count)
        flat = pool[np.arange(int(stop[-1])) - np.repeat(stop - count, count) + np.repeat(first[back], count)]
        tokens = np.concatenate(([0], stop))[np.searchsorted(begin, bounds)]
        return [flat[a:b] for a, b in zip(tokens[:-1].tolist(), tokens[1:].tolist(), strict=True)]


@lru_cache(2)
def word_tokenizer(path: str, special: bool = True) -> WordTokenizer:
    return WordTokenizer(path, special)
