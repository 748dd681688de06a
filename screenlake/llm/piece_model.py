"""Byte-level BPE through a sentencepiece model that is serialised from the ranks, not trained.

Each byte has a printable character, each token of the rank file is the piece of its bytes' characters with
the negative rank as its score, and text isn't normalised. Such a model joins the neighbours of highest
score first, leftmost first among equals: the merges of the ranks. A text is split into pre-tokens by the
pattern; the model encodes those that are not tokens themselves, and ids go back to bytes through the pieces.
The model's one piece without a token, the unknown one, stands between pre-tokens that are encoded together:
no piece holds its character, so nothing joins across it.

The pattern's letters and numbers are those of the library that ranks files are made for. Where the regular
expressions know newer characters, texts with one of those are split by a pattern without them.

Cases: a null text counts as empty (no ids, the hash of nothing); a text of any length is split a bounded
number of pre-tokens at a time; an empty table gives an empty result; all other columns and repeated rows are
kept as they are; columns of the result with the name of an input column replace it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import with_text_columns
from .pieces import ragged

#: Stands between pre-tokens: a byte that no text has, and the character it is mapped to, which no other byte is.
BREAK, BETWEEN = b"\xff", "▁"
#: Distinct pre-tokens a worker remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 500_000, 64
#: Texts with more characters are split AT_ONCE pre-tokens at a time.
LONG_TEXT, AT_ONCE = 1 << 20, 100_000
SLICE = 1 << 20


def byte_characters() -> list[str]:
    """A printable character for each byte: its own in Latin-1 if that is visible, else one from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    at = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [at[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"the ranks of {path} have gaps")
    return [ranks[i] for i in range(len(ranks))]


def serialised(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model with the pieces of ``tokens``, in order, and the unknown piece after them."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model, characters = proto.ModelProto(), byte_characters()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(characters[b] for b in token), score=-float(rank), type=proto.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    t, n = model.trainer_spec, model.normalizer_spec
    t.model_type, t.vocab_size, t.unk_id, t.bos_id, t.eos_id, t.pad_id = proto.TrainerSpec.BPE, len(tokens) + 1, len(tokens), -1, -1, -1
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


def newer_characters(kind: str) -> str:
    """The characters that the regular expressions, but not the library, count as ``kind``, as ranges of a set."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    known = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    ours, theirs = set(regex.findall(kind, every)), set(bytes(known.encode_ordinary(every)).decode())
    if theirs - ours:
        raise ValueError(f"the library counts more characters as {kind} than the regular expressions")
    codes = np.array(sorted(map(ord, ours - theirs)), dtype=np.int64)
    runs = np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1) if len(codes) else []
    return "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs)


class PieceModel:
    """Encodes and decodes texts in one process. ``tokens``: byte strings by rank; ``pattern``: of pre-tokens."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(tokens))
        self.unknown, characters = self.model.unk_id(), byte_characters()
        coded = [c.encode() for c in characters[:-1]] + [BETWEEN.encode()]
        self.mapped = np.array([list(c.ljust(3, b"\0")) for c in coded], dtype=np.uint8)
        self.filled = np.arange(3) < np.array([[len(c)] for c in coded])
        to_bytes = {ord(c): b for b, c in enumerate(characters)}
        self.whole = {t: i for i, t in enumerate(tokens)}
        decoded = [self.model.id_to_piece(i).translate(to_bytes).encode("latin-1") for i in range(len(tokens))]
        self.lengths = np.array([len(t) for t in decoded], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(decoded), dtype=np.uint8)
        letters, numbers = newer_characters(r"\p{L}"), newer_characters(r"\p{N}")
        self.newer = f"[{letters}{numbers}]" if letters or numbers else None
        self.plain, exact = regex.compile(pattern), pattern
        for kind, ranges in ((r"\p{L}", letters), (r"\p{N}", numbers)):
            if ranges:
                exact = exact.replace(kind, f"[{kind}--[{ranges}]]")
        self.exact = regex.compile(exact, regex.V1)
        self.memo: dict[str, bytes] = {}

    def pre_tokens(self, text: str, newer: bool) -> Iterator[list[str]]:
        pattern = self.exact if newer else self.plain
        if len(text) <= LONG_TEXT:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while part := list(islice(found, AT_ONCE)):
            yield part

    def learn(self, new: list[str]) -> None:
        """Remember the ids of pre-tokens as bytes: of tokens by the table, of others by the model, many at a time."""
        raw = [t.encode() for t in new]
        ranks = list(map(self.whole.get, raw))
        self.memo.update((t, r.to_bytes(4, "little")) for t, r in zip(new, ranks) if r is not None)
        rest = [i for i, r in enumerate(ranks) if r is None]
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            together = np.frombuffer(BREAK.join([raw[i] for i in part]), dtype=np.uint8)
            ids = np.array(self.model.encode(self.mapped[together][self.filled[together]].tobytes()), dtype="<u4")
            flat, ends = ids.tobytes(), np.flatnonzero(ids == self.unknown) * 4
            self.memo.update((new[i], flat[a:b]) for i, a, b in zip(part, [0, *(ends + 4).tolist()], [*ends.tolist(), len(flat)], strict=True))

    def joined(self, pre: list[list[str]]) -> list[bytes]:
        """The ids of each list of pre-tokens in a row."""
        if len(self.memo) > REMEMBERED:
            self.memo.clear()
        new = list(set(chain.from_iterable(pre)).difference(self.memo))
        self.learn(new)
        out = [b"".join(map(self.memo.__getitem__, p)) for p in pre]
        for t in new:
            if len(t) > LONGEST:
                del self.memo[t]
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null is empty."""
        texts = pc.fill_null(texts, "")
        newer = pc.match_substring_regex(texts, self.newer).to_pylist() if self.newer else [False] * len(texts)
        each = [(t, n, len(t) <= LONG_TEXT) for t, n in zip(texts.to_pylist(), newer)]
        short = iter(self.joined([next(self.pre_tokens(t, n)) for t, n, one in each if one]))
        raw = [next(short) if one else b"".join(self.joined([p])[0] for p in self.pre_tokens(t, n)) for t, n, one in each]
        return [np.frombuffer(x, dtype="<u4") for x in raw]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.flat[ragged(self.starts[ids], self.lengths[ids])].tobytes() if len(ids) else b""


_MODEL: dict[tuple[str, str], PieceModel] = {}


def model_of(ranks: str, pattern: str) -> PieceModel:
    """The worker process's model, which keeps its memo from task to task."""
    if (ranks, pattern) not in _MODEL:
        _MODEL.clear()
        _MODEL[ranks, pattern] = PieceModel(read_ranks(ranks), pattern)
    return _MODEL[ranks, pattern]


def encode_decode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256, and on demand ids and decoded (both binary).

    ``ranks``: the rank file, where every executor finds it; ``pattern``: of the pre-tokens.
    """
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    added += [T.StructField("ids", T.BinaryType())] * keep_ids + [T.StructField("decoded", T.BinaryType())] * keep_text

    def start():
        model = model_of(ranks, pattern)

        def compute(texts: pa.Array) -> list[pa.Array]:
            out: list[list] = [[] for _ in added]
            for ids in model.encode(texts):
                raw, decoded = ids.tobytes(), model.decode(ids)
                for column, value in zip(out, [len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest(), *[raw] * keep_ids, *[decoded] * keep_text]):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.string(), *[pa.binary()] * keep_ids, *[pa.binary()] * keep_text]
            return [pa.array(column, kind) for column, kind in zip(out, kinds)]

        return compute

    return with_text_columns(docs, text_col, added, start, SLICE)
