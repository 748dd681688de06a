"""Ids of plain words by a tokenizer's merges, for many words at once.

A plain word has Latin letters (ASCII, Latin-1) only, with or without a blank before it. The tokenizers that ``of`` takes
put letters to lower case, drop blanks and make one token of a run of letters, so a word's ids are what the merges
make of its bytes: the pair of the lowest rank first, the leftmost of equal ones, until no pair has a rank.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PLAIN = r"^[ \n]?[A-Za-zÀ-ÖØ-öø-ÿ]{1,64}\z"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Settings of a model that merges as described; others may stand there with these values only.
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
NONE = np.iinfo(np.int32).max


def letters_of_bytes() -> list[str]:
    """The character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class PlainWords:
    @classmethod
    def of(cls, path: str) -> PlainWords | None:
        """None for a tokenizer of another kind."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec["normalizer"] != NORMALIZER or spec["pre_tokenizer"] != PRE_TOKENIZER or spec["post_processor"] or any(model.get(k, v) != v for k, v in MODEL.items()):
            return None
        vocab, suffix, letters = model["vocab"], model.get("end_of_word_suffix") or "", letters_of_bytes()
        if any(c + s not in vocab for c in letters for s in ("", suffix)) or any(t.get("normalized") for t in spec["added_tokens"]):
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        return cls([vocab[c] for c in letters], [vocab[c + suffix] for c in letters], merges)

    def __init__(self, inner: list[int], last: list[int], merges: dict[tuple[int, int], tuple[int, int]]):
        self.inner, self.last = np.array(inner), np.array(last)
        keys = np.array([a << 32 | b for a, b in merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], *(np.array([m[k] for m in merges.values()], dtype=np.int32)[order] for k in (0, 1))
        self.some = np.zeros(1 << 22, dtype=bool)
        self.some[self.spot(self.keys)] = True

    @staticmethod
    def spot(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).view(np.int64)

    @staticmethod
    def fits(texts: pa.Array) -> np.ndarray:
        return pc.match_substring_regex(texts, PLAIN).to_numpy(zero_copy_only=False)

    def places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair among the merges, -1 for none."""
        keys, out = left.astype(np.int64) << 32 | right, np.full(len(left), -1)
        some = np.flatnonzero(self.some[self.spot(keys)])
        keys = keys[some]
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out[some] = np.where(self.keys[found] == keys, found, -1)
        return out

    def ids(self, words: list[str]) -> list[bytes]:
        """Ids of each of ``words``, which fit, as bytes."""
        if not words:
            return []
        lengths = np.fromiter((len(w.encode()) - (w[0] in " \n") for w in words), dtype=np.int64, count=len(words))
        data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
        data = data[(data != 32) & (data != 10)]
        lower = np.where((data >= 65) & (data <= 90), data + 32, data)
        after = np.zeros(len(data), dtype=bool)  # the second byte of a Latin-1 letter
        after[1:] = data[:-1] == 0xC3
        lower = np.where(after & (data <= 0x9E), data + 32, lower)
        ends = np.cumsum(lengths)
        symbols, word = self.inner[lower], np.repeat(np.arange(len(words)), lengths)
        symbols[ends - 1] = self.last[lower[ends - 1]]
        done, of = [], []
        place = np.full(len(symbols), -1)  # of the pair that begins here
        place[:-1] = np.where(word[:-1] == word[1:], self.places(symbols[:-1], symbols[1:]), -1)
        while len(symbols):
            rank = np.where(place < 0, NONE, self.rank[place])
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            active = best < NONE
            if not active.all():
                done.append(symbols[~active])
                of.append(word[~active])
                symbols, word, place, rank, best = (x[active] for x in (symbols, word, place, rank, best))
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == best)
            at = at[np.diff(word[at], prepend=-1) != 0]  # the leftmost of each word
            symbols[at] = self.made[place[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # a symbol fell away for each word before
            symbols, word, place = symbols[keep], word[keep], place[keep]
            for near in (at[(at > 0) & (word[at - 1] == word[at])] - 1, at):
                within = near[near + 1 < len(word)]
                place[near] = -1
                within = within[word[within] == word[within + 1]]
                place[within] = self.places(symbols[within], symbols[within + 1])
        word = np.concatenate(of)
        ids = np.concatenate(done)[np.argsort(word, kind="stable")].astype("<u4").tobytes()
        cuts = [0, *(np.cumsum(np.bincount(word, minlength=len(words))) * 4).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]
