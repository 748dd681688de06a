"""The serialised model against the library that rank files are made for."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from screenlake.llm import piece_model
from screenlake.llm import queries as q

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(piece_model.read_ranks(RANKS))}, special_tokens={})


@pytest.fixture(scope="module")
def model():
    return piece_model.PieceModel(piece_model.read_ranks(RANKS), P.PATTERN)


def hostile(n):
    """Texts of any characters, letters newer than the library's among them."""
    rng = random.Random(2)
    some = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    bits = ["\U000323b0", "࢏", "\U00016ff4", "▁", "<unk>", "\x00", "'s", "'S", "don't", "\n\n", "  ", "\t", "\xa0", "\x1c", "é", "é", "क़", "🙂‍↔️", "abc", "12", "...", " "]
    return ["".join(rng.choice([rng.choice(some), rng.choice(bits), rng.choice(some[:2000])]) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_hostile_texts(model, library):
    texts = hostile(2000)
    ids = model.encode(pa.array(texts))
    assert [x.tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert [model.decode(x) for x in ids] == [t.encode() for t in texts]


def test_long_texts_and_a_small_memory(monkeypatch, library):
    monkeypatch.setattr(piece_model, "REMEMBERED", 50)
    monkeypatch.setattr(piece_model, "LONG_TEXT", 200)
    monkeypatch.setattr(piece_model, "AT_ONCE", 30)
    small = piece_model.PieceModel(piece_model.read_ranks(RANKS), P.PATTERN)
    texts = ["word " * 900, "x" * 5000, "\n" * 300 + "a", "", *hostile(40), "ab12 \t" * 500]
    assert [x.tolist() for x in small.encode(pa.array(texts))] == [library.encode_ordinary(t) for t in texts]
    assert max(map(len, small.memo)) <= piece_model.LONGEST


def test_the_model_is_the_library_s_own_kind(tmp_path):
    """The bytes written are a model file that the library opens, with the pieces in the order of the ranks."""
    import sentencepiece

    tokens = piece_model.read_ranks(RANKS)
    (tmp_path / "m.model").write_bytes(piece_model.serialised(tokens))
    m = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    assert m.get_piece_size() == len(tokens) + 1 and m.unk_id() == len(tokens)
    assert m.get_score(777) == -777 and m.id_to_piece(m.encode("Ġthe")[0]) == "Ġthe"


def test_ranks_with_gaps_are_refused(tmp_path):
    (tmp_path / "r").write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        piece_model.read_ranks(str(tmp_path / "r"))


def test_query(spark, small, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in q.op12_piece_model(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        raw = (r["text"] or "").encode()
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest())


def test_odd_rows(spark, library):
    docs = spark.createDataFrame([(1, None, 3), (None, "", 3), (2, "a b", None), (2, "a b", None), (3, "word " * 30_000, 1)], "doc_id long, text string, n long").withColumn("N_Tokens", F.lit("x")).withColumn("a.b", F.lit(1))
    rows = piece_model.encode_decode(docs, RANKS, P.PATTERN, keep_ids=True, keep_text=True).collect()
    assert len(rows) == 5 and all("a.b" in r.asDict() for r in rows)
    for r in rows:
        ids = library.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids) and bytes(r["ids"]) == np.array(ids, "<u4").tobytes() and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert piece_model.encode_decode(docs.where("false"), RANKS, P.PATTERN).count() == 0
