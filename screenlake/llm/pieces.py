"""Exact encoding with the tokenizers library: each distinct stretch of text is encoded once per worker.

A safe cut is a place where the pre-tokenizers of both vocabularies always start a new token: a blank
(space or newline) between two other characters, or ASCII punctuation after a Latin letter. A text's ids
are the ids of the stretches between its safe cuts, in order. Texts with a special token's string inside
go to the library whole. In texts with unusual white space only blanks and punctuation between ASCII
characters are cuts.

Texts are cut, looked up and put together as arrays: a batch's bytes are one buffer, stretches are
offsets into it, their distinct strings are found by Arrow and the ids are gathered by numpy.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than space and newline, and characters of no width (RE2 syntax). Fixed values.
ODD = r"[\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 10]] = True
ASCII = np.zeros(256, dtype=bool)
ASCII[33:127] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII punctuation without the apostrophe, which may start a token with letters.
MARK = ASCII & ~LETTER
MARK[[39, *range(48, 58)]] = False


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] of all i, in order."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one array, and where each starts, with the end last; nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    return data, at - at[0]


def safe_cuts(data: np.ndarray, bounds: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Sorted places of ``data`` that start a stretch: each text's start, its safe cuts, and the end."""
    if not len(data):
        return np.zeros(1, dtype=np.int64)
    blank = BLANK[data]
    ok = ~blank
    if odd.any():
        strict = np.repeat(odd, np.diff(bounds))
        ok = np.where(strict, ASCII[data], ok)
    cut = np.zeros(len(data), dtype=bool)
    cut[1:-1] = blank[1:-1] & ok[:-2] & ok[2:]
    letter = LETTER[data]
    two = np.zeros(len(data), dtype=bool)  # the second byte of a Latin-1 letter
    two[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut[1:] |= MARK[data[1:]] & (letter | two)[:-1]
    cut[bounds[:-1][bounds[:-1] < len(data)]] = True
    # a blank at the end of a text, or before a blank start of the next one, has no character after it in its text
    last = bounds[1:][np.diff(bounds) > 0] - 1
    cut[last[blank[last] & ~np.isin(last, bounds[:-1])]] = False
    return np.append(np.flatnonzero(cut), len(data))


class Memo:
    """Ids by stretch, in arrays. Beyond ``limit`` stretches, the half that was used last is kept."""

    def __init__(self, limit: int):
        self.limit, self.turn = limit, 0
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.starts, self.lengths, self.used = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.firm = np.zeros(0, dtype=bool)
        self.flat = np.zeros(0, dtype=np.uint32)

    def find(self, stretches: pa.Array) -> np.ndarray:
        """The place of each stretch, -1 where it isn't known."""
        self.turn += 1
        at = pc.fill_null(pc.index_in(stretches, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.used[at[at >= 0]] = self.turn
        return at

    def add(self, stretches: pa.Array, found: list[bytes | None]) -> np.ndarray:
        """The places of new stretches; None stands for ids that depend on what is around."""
        self.firm = np.concatenate([self.firm, np.array([x is not None for x in found], dtype=bool)])
        first, lengths = len(self.known), np.array([len(x or b"") // 4 for x in found], dtype=np.int64)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used = np.concatenate([self.used, np.full(len(found), self.turn)])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(x for x in found if x), dtype="<u4")])
        self.known = pa.concat_arrays([self.known, stretches])
        return np.arange(first, len(self.known))

    def ids(self, at: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.starts[at], self.lengths[at])]

    def trim(self) -> None:
        if len(self.known) > self.limit:
            self.keep(np.sort(np.argsort(-self.used, kind="stable")[: self.limit // 2]))

    def keep(self, places: np.ndarray) -> None:
        """Drop all stretches but those at ``places``."""
        flat, lengths = self.ids(places), self.lengths[places]
        self.known, self.used, self.firm = self.known.take(pa.array(places)), self.used[places], self.firm[places]
        self.flat, self.lengths, self.starts = flat, lengths, np.cumsum(lengths) - lengths


class PieceEncoder:
    """Ids of texts as unsigned 32-bit integers.

    ``limit``: stretches that the memo holds.
    ``separator``: a text whose ids, when they are one alone, stand between two stretches without joining
    either; new stretches are then encoded many at a time. By default the first of a newline and " 0 " that has one id.
    """

    def __init__(self, path: str, limit: int = 700_000, separator: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.separator = separator or next((s for s in ("\n", " 0 ") if len(self.library(s)) == 1), "")
        mark = self.library(self.separator) if self.separator else []
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.memo = Memo(limit)

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def library_all(self, texts: list[str], at_once: int = 16) -> Iterator[bytes]:
        """Ids of each text as bytes; few texts at once, as the library's own results are large."""
        for k in range(0, len(texts), at_once):
            for e in self.tok.encode_batch_fast(texts[k : k + at_once], add_special_tokens=False):
                yield array("I", e.ids).tobytes()

    def encode_new(self, texts: list[str], together: int = 200) -> list[bytes]:
        """Ids of each of ``texts`` as bytes; those that a separator can't disturb go ``together``."""
        out: list[bytes] = [b""] * len(texts)
        bare, alone, groups = self.separator.strip() or self.separator, [], [[]]
        for i, t in enumerate(texts):
            if self.mark is None or not t or bare in t or t[-1].isspace() or (t[0].isspace() and (t[0] != " " or t[1:2].isspace())):
                alone.append(i)
            else:
                if len(groups[-1]) == together:
                    groups.append([])
                groups[-1].append(i)
        for group, raw in zip(groups, self.library_all([self.separator.join(texts[i] for i in g) for g in groups])):
            cuts = np.flatnonzero(np.frombuffer(raw, dtype="<u4") == self.mark) * 4
            if len(cuts) != len(group) - 1:
                alone += group
                continue
            for i, a, b in zip(group, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)]):
                out[i] = raw[a:b]
        for i, raw in zip(alone, self.library_all([texts[i] for i in alone], 256)):
            out[i] = raw
        return out

    def bounds(self, data: np.ndarray, starts: np.ndarray, odd: np.ndarray) -> np.ndarray:
        return safe_cuts(data, starts, odd)

    def learn(self, data: np.ndarray, starts: np.ndarray, bounds: np.ndarray, first: np.ndarray, texts: list[str]) -> list[bytes | None]:
        """Ids of new stretches; ``first``: the number of each one's first occurrence among ``bounds``."""
        return self.encode_new(texts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and each text's number of ids."""
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), dtype=bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        try:
            return self.mixed(texts, whole)
        finally:
            pa.default_memory_pool().release_unused()  # else it keeps the most that any slice took

    def mixed(self, texts: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``; texts marked in ``whole`` go to the library."""
        rest = texts.filter(pa.array(~whole)) if whole.any() else texts
        ids, counts, weak = self.cut(rest)
        if weak.any():
            again = whole.copy()
            again[np.flatnonzero(~whole)[weak]] = True
            return self.mixed(texts, again)
        if not whole.any():
            return ids, counts
        by, parts = (np.frombuffer(x, dtype="<u4") for x in self.library_all(texts.filter(pa.array(whole)).to_pylist())), iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [])
        each = [next(by) if w else next(parts) for w in whole]
        return np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and their numbers through stretches, and which texts hold a stretch without ids of its own."""
        data, starts = joined(texts)
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=bool)
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        bounds = self.bounds(data, starts, odd)
        offsets = pa.py_buffer(np.ascontiguousarray(bounds, dtype=np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary
        self.memo.trim()
        at = self.memo.find(distinct)
        new = np.flatnonzero(at < 0)
        if len(new):
            first = np.full(len(distinct), -1, dtype=np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            strings = distinct.take(pa.array(new))
            at[new] = self.memo.add(strings, self.learn(data, starts, bounds, first[new], strings.cast(pa.large_string()).to_pylist()))
        places = at[codes]
        inner = np.searchsorted(bounds, starts)
        ends = np.concatenate([[0], np.cumsum(self.memo.lengths[places])])
        loose = np.concatenate([[0], np.cumsum(~self.memo.firm[places])])
        return self.memo.ids(places), np.diff(ends[inner]), np.diff(loose[inner]) > 0

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian bytes."""
        ids, counts = self.encode(pa.array(texts, pa.string()))
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(texts) else []


_SHARED: dict[tuple[type, str], PieceEncoder] = {}


def shared(kind: type, path: str) -> PieceEncoder:
    """The worker process's encoder for ``path``, which keeps its memo from task to task."""
    if (kind, path) not in _SHARED:
        _SHARED.clear()  # one at a time bounds the memory
        _SHARED[kind, path] = kind(path)
    return _SHARED[kind, path]
