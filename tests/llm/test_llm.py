"""The training-data operators against brute force, round trips and held-out accuracy, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import values
from pyspark.sql import functions as F
from screenlake.llm import ann, bpe, common, components, language_id, lm_scoring, mixing, near_dedup, quality, token_store, topk, url_filter
from screenlake.llm import queries as q
from screenlake.llm.pieces import PieceEncoder

ODD_BITS = [" ", "  ", "\n", "\t", "a", "B", "é", "é", "ß", "'s", "0", "12", ".", "!!", "中", "\xa0", "<|endoftext|>", "wordy", "İ", "Σ", "\x00", "क़"]
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, copy int"


def odd_texts(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD_BITS) for _ in range(rng.randint(0, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, extra and clashing columns."""
    rows = [(1, "the cat sat on the mat " * 9, "en", "a", 1, "x", 7), (1, "the cat sat on the mat " * 9, "en", "a", 1, "x", 7), (2, None, None, None, None, None, None), (3, "", "de", "b", 0, "y", 1), (None, "no id here at all", None, None, 3, None, None), (4, "word " * 30_000, "en", "a", 5, "z", 2), (5, "... 123 \t\n", "de", "b", 1, None, 3)]
    return spark.createDataFrame(rows, DOC)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_sql(spark, small, duck, name):
    got = [r.asDict(recursive=True) for r in q.QUERIES[name](spark, small).collect()]
    cursor = duck.execute(q.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert values(got) == values([dict(zip(names, r)) for r in cursor.fetchall()])


@pytest.mark.parametrize("name,separator", [("byte_bpe_50k.json", "\n"), ("word_bpe_49k.json", " 0 ")])
def test_pieces_are_exact(name, separator):
    encoder = PieceEncoder(public_tokenizers.path(name), separator=separator)
    texts = odd_texts(1500)
    assert encoder.encode_all(texts) == [encoder.library(t).tobytes() for t in texts]
    assert PieceEncoder(public_tokenizers.path(name)).encode_all(texts) == encoder.encode_all(texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("bits", [2, 6])
def test_chunks_are_exact(monkeypatch, name, bits):
    monkeypatch.setattr(bpe, "cut_points", lambda data, cut=bpe.cut_points: cut(data, 4, bits))
    encoder = bpe.ChunkEncoder(public_tokenizers.path(name), limit=3000)  # the memo is trimmed on the way
    texts = odd_texts(1500, 1) + ["".join(odd_texts(30, k)) for k in range(10)] + ["some shared passage of words, " * 50 + t for t in odd_texts(20, 3)]
    want = [encoder.library(t).tobytes() for t in texts]
    for at in range(0, len(texts), 400):
        assert encoder.encode_all(texts[at : at + 400]) == want[at : at + 400]
    assert encoder.encode_all(texts) == want


def test_shared_passages_are_encoded_once():
    encoder, sent = bpe.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json")), []
    library = encoder.library_all
    encoder.library_all = lambda texts, *k: sent.append(sum(map(len, texts))) or library(texts, *k)
    rng = random.Random(3)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(4000))
    encoder.encode_all([f"one {passage} end"])
    first = sum(sent)
    encoder.encode_all([f"{k} {passage} more {k}" for k in range(50)])
    # 50 texts of the same passage: new are their own two ends, about a chunk each, and the passage's joins once
    assert first > len(passage) * 0.9 and sum(sent) - first < 0.01 * 50 * len(passage) and sum(sent) - first < 0.05 * first + 50 * 2 * 256


def test_chunks_of_the_corpus_are_encoded_once(spark, monkeypatch):
    """Cores that texts share have one row with the library's ids, and reach each text that holds them; results don't depend on them."""
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(9)
    passages = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(700)) for _ in range(3)]
    texts = [f"{k} start {passages[k % 3]} end {rng.random()}" for k in range(30)] + [passages[0]] * 40 + odd_texts(200, 5) + ["<|endoftext|> " + passages[1]] * 2 + [None, ""]
    only = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    docs = only.select("*", F.lit("mine").alias("TEXT"))
    encoder = bpe.ChunkEncoder(path)
    seen = Counter(c for t in texts for c in encoder.cores(pa.array([t], pa.string()))[0].to_pylist())
    repeats = bpe.Repeats(only, path)
    assert repeats.hold(pa.array([c for c, n in seen.items() if n > 1], pa.binary())).all()
    assert repeats.hold(pa.array([c for c, n in seen.items() if n == 1], pa.binary())).mean() < 0.1
    table = {bytes(r["core"]): bytes(r["ids"]) for r in bpe.chunk_ids(only, path, repeats).collect()}
    assert table == {bpe.hash_of(c): encoder.library(c.decode()).tobytes() for c, n in seen.items() if n > 1}
    long = [c for c, n in seen.items() if n > 1 and len(c) > 100]
    assert sum(map(len, long)) > 0.8 * sum(map(len, passages))
    lists = {r["_key"]: r["chunks"] for r in bpe.chunks_of_texts(only, path, repeats).collect()}
    assert max(len(x) for x in lists.values()) <= max(len(encoder.cores(pa.array([t]))[0]) for t in texts if t)
    got = {r["doc_id"]: bytes(r["ids"]) for r in bpe.encode_decode(docs, path, keep_ids=True).collect()}
    assert got == {d: encoder.library(t or "").tobytes() for d, t in enumerate(texts)}
    alone = {r["doc_id"]: bytes(r["ids"]) for r in bpe.encode_decode(docs, path, keep_ids=True, across=False).collect()}
    assert alone == got
    made = bpe.Repeats.__init__
    monkeypatch.setattr(bpe.Repeats, "__init__", lambda self, *a: (made(self, *a), self.bits.fill(255))[1])  # a filter that is full
    assert bpe.Repeats(only, path).hold(pa.array([b"none of them"])).all()
    assert {r["doc_id"]: bytes(r["ids"]) for r in bpe.encode_decode(docs, path, keep_ids=True).collect()} == got


def test_chunks_from_the_table_are_not_encoded_again():
    encoder, sent = bpe.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json")), []
    rng = random.Random(11)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(4000))
    cores = encoder.cores(pa.array([text]))[0].to_pylist()
    encoder.given = {bpe.hash_of(c): encoder.library(c.decode()).tobytes() for c in cores}
    want, library = encoder.library(text).tobytes(), encoder.library_all
    encoder.library_all = lambda texts, *k: sent.append(sum(map(len, texts))) or library(texts, *k)
    assert encoder.encode_all([text]) == [want] and sum(sent) < 0.15 * len(text)


def test_joins_widen_until_ids_agree(monkeypatch):
    """With cuts that aren't safe, ids beside a join disagree: more is taken, and at last the library does the text."""
    monkeypatch.setattr(bpe, "safe_cuts", lambda data, starts, odd: np.unique(np.concatenate([starts, np.arange(0, len(data), 5)])))
    encoder = bpe.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(bpe, "cut_points", lambda data: np.arange(2, len(data), 5))
    text = "unbelievable characterisations of internationalisation"
    assert encoder.encode_all([text]) == [encoder.library(text).tobytes()]
    assert encoder.cut(pa.array([text]))[2].all()


def test_bpe_of_odd_rows(spark, odd_docs):
    got = bpe.encode_decode(odd_docs.withColumn("N_Tokens", F.lit("mine")).withColumn("a.b", F.lit(1)), public_tokenizers.path("word_bpe_49k.json"), keep_ids=True, keep_text=True)
    rows = got.collect()
    assert [c for c in got.columns if c.lower() == "n_tokens"] == ["n_tokens"] and {"score", "copy", "a.b"} <= set(got.columns)
    assert len(rows) == 7 and sorted(r["doc_id"] or 0 for r in rows) == [0, 1, 1, 2, 3, 4, 5]
    encoder = bpe.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for r in rows:
        ids = encoder.library(r["text"] or "")
        assert r["n_tokens"] == len(ids) and r["ids"] == ids.tobytes() and r["decoded"] == encoder.decode(ids)
    assert bpe.encode_decode(odd_docs.where("false"), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_bpe_query(spark, small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in q.op7_bpe(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert tuple(got[r["doc_id"]])[1:] == want


def test_token_store_query(spark, small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: tuple(r)[1:] for r in q.op3_token_store(spark, small).collect()}
    start = 0
    for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        assert got[r["doc_id"]] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_store_of_odd_rows(spark, odd_docs, tmp_path):
    token_store.write_tokens(odd_docs, f"{tmp_path}/s", public_tokenizers.path("byte_bpe_50k.json"))
    got = token_store.read_tokens(spark, f"{tmp_path}/s").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2, 3, 4, 5] and [r["n_tokens"] for r in got][3:5] == [1, 1]
    hot = spark.range(300).select(F.when(F.col("id") < 100, 7).when(F.col("id") >= 200, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 3).alias("text"))
    token_store.write_tokens(hot, f"{tmp_path}/h", public_tokenizers.path("word_bpe_49k.json"))
    got = token_store.read_tokens(spark, f"{tmp_path}/h").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 100 + [7] * 100 + list(range(200, 300)) and got[-1]["start"] == sum(r["n_tokens"] for r in got[:-1])
    assert spark.read.parquet(f"{tmp_path}/h/blocks").select("bucket").distinct().count() > 8
    token_store.write_tokens(odd_docs.where("false"), f"{tmp_path}/e", public_tokenizers.path("byte_bpe_50k.json"))
    assert token_store.read_tokens(spark, f"{tmp_path}/e").count() == 0


@pytest.mark.parametrize("symbols", [1, 2, 3, 300])
def test_huffman_round_trip(symbols):
    rng = np.random.default_rng(symbols)
    counts = rng.zipf(1.2, symbols).clip(max=10**9).astype(np.int64)
    bits = token_store.code_lengths(counts, 12)
    assert bits.max() <= 12 and (2.0 ** -bits).sum() <= 1
    coder = token_store.Coder(np.arange(symbols) * 7, bits)
    ids = rng.integers(0, symbols, 5000) * 7
    raw, points = coder.encode(ids)
    assert all((x == ids).all() for x in coder.decode([(raw, points, len(ids))] * 2))


def test_language_held_out(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    r = q.op1_language_id(spark, small).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([x["lang"] == x["lang_pred"] for x in r]) > 0.9


def test_language_of_odd_rows(odd_docs):
    rows = language_id.predict(odd_docs, language_id.fit(odd_docs)).collect()
    by = {(r["doc_id"], r["text"]): r for r in rows}
    assert len(rows) == 7 and by[2, None]["lang_pred"] == by[3, ""]["lang_pred"] == by[5, "... 123 \t\n"]["lang_pred"] == "und" and by[2, None]["score"] == 0
    assert {r["lang_pred"] for r in language_id.predict(odd_docs, language_id.fit(odd_docs.where("false"))).collect()} == {"und"}


def test_language_without_letters_leaves_training_whole(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    more = docs.union(spark.createDataFrame([(-1, "", "xx"), (-2, "... 12", "yy")], docs.schema))
    held = [r for r in docs.where(q.fold(F.col("doc_id")) == 1).collect()]
    right = []
    for labelled in (docs, more):
        names, _ = language_id.fit(labelled.where(q.fold(F.col("doc_id")) != 1)).predict([r["text"] for r in held])
        right.append(np.mean([r["lang"] == n for r, n in zip(held, names)]))
    assert right[0] == right[1] > 0.9


def test_backpropagation_matches_differences():
    net = language_id.Network(["a", "b"], seed=1)
    side, rng = net.sides[0], np.random.default_rng(0)
    for k in side.p:
        side.p[k] = side.p[k].astype("f4")
    x = rng.integers(0, 256, (5, 3)).astype(np.uint8)
    d = rng.normal(size=(5, language_id.HIDDEN, 3)).astype("f4")
    grads = side.backward(side.forward(x, keep=True)[1], d)
    for key, at in (("u", (0, 1)), ("u", (20, 3)), ("w", (17, int(x[2, 1]))), ("w", (3, int(x[0, 0])))):
        loss = []
        for step in (1e-2, -1e-2):
            side.p[key][at] += step
            loss.append(float((side.forward(x)[0] * d).sum()))
            side.p[key][at] -= step
        assert abs((loss[0] - loss[1]) / 2e-2 - grads[key][at]) < 0.02


def test_quality_of_labelled_and_odd_rows(spark, odd_docs, small):
    good, bad = ["a calm and plain sentence number %d about things" % i for i in range(60)], ["BUY!! ### %d $$$ &&& NOW!!" % i for i in range(60)]
    model = quality.train(good + bad, [1] * 60 + [0] * 60)
    scores = model.scores(["a calm and plain sentence number 99", "BUY!! ### $$$ &&& NOW!!"])
    assert scores[0] > 0.5 > scores[1]
    assert quality.score(odd_docs, model).where("score between 0 and 1").count() == 7
    none = quality.fit(odd_docs, spark.read.parquet(f"{small}/labels.parquet").where("false"))
    assert {r["score"] for r in quality.score(odd_docs, none).collect()} == {0.5}


def test_mixing_draws_poisson(spark, odd_docs):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") < 3000, F.lit("big")).otherwise(F.lit("small")).alias("source"))
    n = {r["source"]: r["count"] for r in mixing.mix(df).groupBy("source").count().collect()}
    assert abs(n["big"] - 2000) < 180 and abs(n["small"] - 2000) < 180
    assert mixing.mix(odd_docs).columns[-2:] == ["copy", "position"] and mixing.mix(odd_docs.where("false")).count() == 0
    for rate in (0.3, 4.0):
        u = spark.range(1000).select(((F.col("id") + 0.5) / 1000).alias("u"))
        mean = u.select(F.avg(mixing.poisson(F.lit(rate), F.col("u")))).first()[0]
        assert abs(mean - rate) < 0.02


def test_mixing_draws_large_rates(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 1000)
    df = spark.createDataFrame([(0, "a", "one")], "doc_id long, text string, source string").union(spark.range(1, 1001).select("id", F.lit("abcdef"), F.lit("big")))
    assert mixing.rates(df).where("source = 'one'").first()["rate"] == 3000.5
    n = {r["source"]: r.asDict() for r in mixing.mix(df).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id", "copy").alias("copies"), F.max("copy").alias("last")).collect()}
    assert n["one"]["n"] == n["one"]["copies"] == n["one"]["last"] + 1 and abs(n["one"]["n"] - 3000) < 330
    many = spark.range(400).select(mixing.draws(F.lit(2000.0), F.lit("s"), F.col("id")).alias("n")).agg(F.avg("n"), F.variance("n")).first()
    assert abs(many[0] - 2000) < 12 and 1400 < many[1] < 2700


def test_lm_scores_sum_to_one_and_learn(spark, odd_docs):
    text = " ".join(["red blue green"] * 40)
    docs = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    known, weights = lm_scoring.fit(docs)
    counts = np.zeros(lm_scoring.TOKENS)
    counts[:3] = 1600
    net, start = lm_scoring.Network(weights), lm_scoring.Network(counts=counts)
    tape, at = lm_scoring.laid_out(*lm_scoring.Numbers(known)(pa.array([text])))
    assert net.log_probs(tape, at).sum() > start.log_probs(tape, at).sum() + 10
    total = 0.0
    for token in range(0, lm_scoring.TOKENS):  # the masked token's own value must not matter
        other = tape.copy()
        other[at[5]] = token
        total += np.exp(net.log_probs(other, at[5:6])[0])
    assert abs(total - 1) < 1e-3
    got = lm_scoring.score(odd_docs, known, weights)
    assert got.count() == 7 and got.where("doc_id = 2").first()["log_prob"] == 0
    assert lm_scoring.score(odd_docs.where("false"), known, weights, counts=lm_scoring.word_counts(docs)).count() == 0


def test_lm_gradient_matches_differences():
    net = lm_scoring.Network(seed=2)
    rng = np.random.default_rng(1)
    tape, at = lm_scoring.laid_out(rng.integers(0, lm_scoring.TOKENS, 60), np.array([30, 30]))
    for key, where in (("w", (3, 2)), ("b", (1,)), ("cw", (4, 7)), ("tw", (int(tape[at[0]]) // lm_scoring.SIZE, 3, 5)), ("embed", (int(tape[at[9]]), 2))):
        loss = []
        for move in (1e-2, -1e-2):
            net.p[key][where] += move
            loss.append(-net.log_probs(tape, at).mean())
            net.p[key][where] -= move
        sums = net.zeros()
        net.add_gradient(tape, at, sums)
        assert abs((loss[0] - loss[1]) / 2e-2 - sums[key][where] / len(at)) < 2e-3


def test_lm_trains_on_every_position(spark):
    words = [f"w{i:02}" for i in range(16)]
    for text in ("w00 w01", " ".join(words)):
        weights = lm_scoring.trained(lm_scoring.numbered(spark.createDataFrame([(text,)], "text string"), words), lm_scoring.Network().flat())
        bias = lm_scoring.Network(weights).p["tb"].reshape(-1)
        assert (bias[: len(text.split())] > 0).all()  # the bias of every token that was trained on rises


@pytest.mark.parametrize("listed", [lm_scoring.KNOWN + 20, lm_scoring.LISTED])
def test_lm_scores_against_brute_force(spark, odd_docs, listed):
    rng = random.Random(4)
    common_words = [f"c{i:04}" for i in range(lm_scoring.KNOWN - 10)]
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) + rng.choice(["", "x", "y"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += texts[:5] + texts[:2] + ["only", "only", None, "  "] + [" ".join(common_words)] * 30 + [" ".join(rng.choice(common_words[:6]) for _ in range(200)) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("Log_Prob", F.lit("mine")).withColumn("a.b", F.col("doc_id"))
    counts = lm_scoring.word_counts(docs)
    known, weights = lm_scoring.fit(docs, counts=counts)
    count = Counter(w for t in texts for w in (t or "").split())
    assert {r["word"]: r["count"] for r in counts.collect()} == count and known == sorted(count, key=lambda w: (-count[w], w))[: lm_scoring.KNOWN]
    assert len(count) > lm_scoring.KNOWN
    net, numbers = lm_scoring.Network(weights), lm_scoring.Numbers(known)
    share, places, each = Counter(), Counter(), []
    for w, n in count.items():
        share[int(numbers.of(pa.array([w]))[0][0])] += n
    for t in texts:
        tape, at = lm_scoring.laid_out(*numbers(pa.array([t])))
        asked = set(lm_scoring.anchors(tape, at)[0].tolist())
        each.append((tape, at, asked))
        places.update((int(tape[i - 1]), int(tape[i + 1]), int(tape[i])) for k, i in enumerate(at) if k in asked)
    sides = Counter()
    for (left, right, _), n in places.items():
        sides[left, right] += n
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, known, weights, counts=counts, listed=listed).collect()}
    assert len(got) == len(texts)
    for d, t in enumerate(texts):
        tape, at, asked = each[d]
        want, words = 0.0, (t or "").split()
        for k, (i, logp) in enumerate(zip(at, net.log_probs(tape, at))):
            key = (int(tape[i - 1]), int(tape[i + 1]))
            if k in asked:
                c, c_all = places[(*key, int(tape[i]))], sides[key]
                logp = np.log((c - 1 + np.exp(logp)) / c_all)
            want += logp
            if words[k] not in known:
                want += np.log(count[words[k]] / (share[int(tape[i])] + lm_scoring.UNSEEN))
        assert got[d]["n_tokens"] == len(words) and got[d]["log_prob"] == pytest.approx(want, abs=1e-3) and got[d]["a.b"] == d
        assert got[d]["log_prob_per_token"] == pytest.approx(want / max(1, len(words)), abs=1e-3)
    odd = lm_scoring.score(odd_docs, known, weights, counts=counts)
    assert odd.count() == 7 and odd.columns[: len(odd_docs.columns)] == odd_docs.columns


def test_lm_asks_the_corpus_at_every_position(spark, monkeypatch):
    """Brute force over all places, in many blocks and parts, with neighbours that are frequent."""
    rng = random.Random(8)
    monkeypatch.setattr(lm_scoring, "PART", 3)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 30))) for _ in range(80)] + ["a " * 3000, "b a " * 500, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    counts = lm_scoring.word_counts(docs)
    known, weights = lm_scoring.fit(docs, counts=counts)
    net, numbers, places, sides = lm_scoring.Network(weights), lm_scoring.Numbers(known), Counter(), Counter()
    laid = [lm_scoring.laid_out(*numbers(pa.array([t], pa.string()))) for t in texts]
    for tape, at in laid:
        places.update((int(tape[i - 1]), int(tape[i + 1]), int(tape[i])) for i in at)
        sides.update((int(tape[i - 1]), int(tape[i + 1])) for i in at)
    got = {r["doc_id"]: r["log_prob"] for r in lm_scoring.score(docs, known, weights, counts=counts).collect()}
    for d, (tape, at) in enumerate(laid):
        want = sum(np.log((places[int(tape[i - 1]), int(tape[i + 1]), int(tape[i])] - 1 + np.exp(p)) / sides[int(tape[i - 1]), int(tape[i + 1])]) for i, p in zip(at, net.log_probs(tape, at)))
        assert got[d] == pytest.approx(want, abs=1e-3, rel=1e-5)


def test_lm_tells_documents_that_occur_twice(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:20])), "doc_id long, text string")
    counts = lm_scoring.word_counts(docs)
    got = {r["doc_id"]: r["log_prob_per_token"] for r in lm_scoring.score(docs, *lm_scoring.fit(docs, counts=counts), counts=counts).collect()}
    once = sorted(got[i] for i in range(20, 120))
    assert sum(got[i] > once[90] for i in range(20)) >= 18


def test_lm_is_the_same_however_rows_lie_in_tasks(spark, small):
    docs = spark.read.parquet(small + "/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.limit(1).crossJoin(spark.range(40)).select((F.col("id") + 10**6).alias("doc_id"), "text"))
    counts = common.staged(lm_scoring.word_counts(docs), "words")
    got = {}
    for n in (1, 8, 32):
        dealt = docs.repartition(n, "doc_id")
        tokens = common.staged(lm_scoring.numbered(dealt, lm_scoring.most_frequent(counts), counts=counts), "tokens", by="step")
        known, weights = lm_scoring.fit(dealt, counts=counts, tokens=tokens)
        got[n] = {r["doc_id"]: r["log_prob_per_token"] for r in lm_scoring.score(dealt, known, weights, counts=counts, tokens=tokens).collect()}
        numbers = lm_scoring.Numbers(known)
        tape, at = lm_scoring.laid_out(*numbers(pa.array([r["text"] for r in docs.collect()])))
        totals = np.bincount(tape[at], minlength=lm_scoring.TOKENS)
        gain = (lm_scoring.Network(weights).log_probs(tape, at) - lm_scoring.Network(counts=totals).log_probs(tape, at)).mean()
        assert gain > 0.3
    assert len(got[1]) == docs.count()
    for n in (8, 32):
        assert max(abs(got[n][d] - got[1][d]) for d in got[1]) < 1e-3


def test_columns_that_clash_but_for_case(spark, small):
    for name, tab, search in (("embedding", "embeddings", lambda d: ann.search(d, F.col("vec_id") % 20 == 0, k=3)), ("embedding", "embeddings", lambda d: topk.top_k(topk.quantised(d), F.col("vec_id") % 50 == 0, k=3)), ("url", "pages", lambda d: url_filter.judge(d, q.URL_RULES))):
        plain = spark.read.parquet(f"{small}/{tab}.parquet")
        key = plain.columns[0]
        clash = plain.toDF(*(f"x{i}" for i in range(len(plain.columns)))).withColumn("a.b", F.lit(1)).withColumn("more", F.lit("x")).withColumn("too", F.lit(None).cast("long"))
        clash = clash.toDF(*plain.columns, "a.b", name.upper(), key.upper())
        got, want = (sorted(map(str, search(d).collect())) for d in (clash, plain))
        assert got == want and want


def brute_components(docs, n, percent):
    ids, sets = [], []
    for i, t in docs:
        words = (t or "").encode().lower().split()
        ids.append(i)
        sets.append({b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set())
    label = {i: i for i in ids}
    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(ids[a]), root(ids[b])
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    docs = []
    for g in range(6):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 6, 60, 150]))]
        for _ in range(40):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 18))):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 9)}"
            docs.append((len(docs), " ".join(words)))
    docs += [(1000, None), (1001, ""), (1002, "solo"), (1003, "SOLO \t")]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), n=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(docs, 4, 80)


def test_members_are_found_and_false_hits_change_nothing(spark, monkeypatch):
    ids = spark.range(0, 7000, 7).select(F.col("id").alias("doc_id"))
    some = common.Members(ids)
    rows = spark.range(7000).select("id", some.may_hold(spark, F.col("id")).alias("hit"), *some.places(F.col("id"))).toPandas()
    assert (some.mask([rows.iloc[:, k].to_numpy() for k in (2, 3, 4)]) == rows["hit"]).all()
    assert rows["hit"][::7].all() and rows["hit"].mean() < 0.16
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i // 2}" + " x" * (i % 5 == 0)) for i in range(40)] + [(50, None), (None, "a b c d e")], "doc_id long, text string")
    results = []
    for bits in (16, 0):  # 0: every bit counts as set
        monkeypatch.setattr(common.Members, "BITS", bits)
        if not bits:
            monkeypatch.setattr(common.Members, "mask", lambda self, places: np.ones(len(places[0]), dtype=bool))
            monkeypatch.setattr(common.Members, "may_hold", lambda self, spark, key: key.isNotNull())
        results.append((sorted(map(str, near_dedup.near_duplicates(docs).collect())), sorted(map(str, near_dedup.without_near_duplicates(docs).collect()))))
    assert results[0] == results[1] and len(results[0][1]) < 42


def test_without_near_duplicates_against_brute_force(spark):
    rng, texts = random.Random(8), []
    for g in range(5):
        base = [f"w{rng.randint(0, 300)}" for _ in range(60)]
        texts += [" ".join(base[: 60 - k] + [f"y{k}"] * k) for k in (0, 1, 2, 3, 30)] + [" ".join(base)] * 20
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(500, None, "n"), (501, None, None), (502, "", "e"), (0, texts[0], "again"), (3, "another text of this id with seven words", "b"), (None, texts[0], "z"), (None, texts[0], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").withColumn("kept", F.lit(1)).withColumn("component_id", F.lit("mine"))
    label = brute_components([(i, t) for i, t, _ in rows if i is not None], 5, 80)
    kept = near_dedup.without_near_duplicates(docs)
    got = kept.collect()
    assert kept.columns == docs.columns and sum(r["doc_id"] is None for r in got) == 2
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(i for i, c in label.items() if i == c)
    assert all(r["kept"] == 1 and r["component_id"] == "mine" for r in got)


def test_ids_with_several_texts_link_their_groups(spark):
    words = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(30))
    rows = [(5, words), (9, words), (9, other), (7, other), (20, other), (11, None), (11, words)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, 5) for i in (5, 7, 9, 11, 20)}


def test_near_duplicates_of_odd_rows(odd_docs):
    got = near_dedup.near_duplicates(odd_docs).collect()
    assert len(got) == 7 and all(r["kept"] for r in got)
    kept = near_dedup.without_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 6
    assert near_dedup.near_duplicates(odd_docs.where("false")).count() == 0


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 99), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got.values()) == {0, 99} and all(got[i] == 0 for i in range(41))


def test_ann_recall_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, x[3].tolist()) for i in range(40)] + [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [1.0]), (None, x[0].tolist())]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=10).collect()
    ids = np.array([i for i, v in rows[:1540]])
    full = np.array([v for _, v in rows[:1540]])
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = []
    for i, v in zip(ids, full):
        if i % 20 == 0:
            s = full @ v
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:10]
            mine = sorted(found[i])
            assert [m[0] for m in mine] == list(range(1, 11))
            hits.append(len({m[1] for m in mine} & set(ids[order].tolist())) / 10)
    assert np.mean(hits) >= 0.9 and set(found) == {int(i) for i in ids if i % 20 == 0}
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


def test_topk_odd_rows(spark):
    rows = [(0, [1.0, -0.5]), (50, [1.0, -0.5]), (1, [2.0]), (2, None), (3, [float("inf"), 1.0]), (4, []), (None, [1.0, 1.0]), (1, [2.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(map(tuple, topk.top_k(v, F.col("vec_id") % 50 == 0).collect()))
    assert [r[2:] for r in got if r[0] == 0] == [(1, 131072), (1, 131072), (50, 81920), (4, 0)]


def test_url_rules_and_link_graph(spark, small):
    rows = [(1, "https://A.com/x?q", '<a href="http://good.org/">'), (2, "http://x.example.com/en/1", '<a href="//bad.org/p">'), (3, "http://www.example.com/en/1", None), (4, "http://bad.org/", '<a class=k href=http://x.example.com/en/>'), (5, "http://good.org/#a", ""), (6, None, None), (7, "nothing", "<a href='/x'>"), (8, "http://s.net/es/", None), (9, "http://notcom/", None)]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), q.URL_RULES).collect()}
    assert got[1] == ("a.com", "/x", "com/", "allow") and got[2][2:] == ("example.com/en/", "block") and got[3][2:] == ("www.example.com/en/", "allow")
    assert got[4][2:] == (None, "block") and got[5][2:] == (None, "allow") and got[6] == ("", "", None, "allow") and got[7][3] == "allow" and got[8][2:] == ("net/es/", "block") and got[9][2] is None


def test_pagerank_against_power_iteration(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3)]
    r = {x["host"]: x["rank"] for x in url_filter.spread(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame([("a", 1.0)], "host string, seed double"), iterations=6).collect()}
    rank, names = np.array([1.0, 0, 0]), "abc"
    m = np.zeros((3, 3))
    for s_, d, n in edges:
        m[names.index(d), names.index(s_)] = n / sum(k for x, _, k in edges if x == s_)
    for _ in range(6):
        moved = 0.85 * m @ rank
        rank = moved + np.array([1.0, 0, 0]) * (1 - moved.sum())
    assert all(abs(r[n] - rank[i]) < 1e-9 for i, n in enumerate(names))


def test_pipeline(spark, small):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small}/documents.parquet")
    language = p.identify_language(spark, docs, small)
    assert language.columns == docs.columns and language.count() >= 0.95 * docs.count()
    out = p.run(spark, small)
    assert 0 < out.count() and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_plain_words_are_merged_as_the_library_does(monkeypatch):
    """Words of Latin letters don't go to the library, which took most of op7_bpe's CPU; their ids are the library's."""
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(13)
    encoder, sent, library = bpe.ChunkEncoder(path), [], bpe.PieceEncoder.library_all
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
    words = ["".join(rng.choice(rng.choice([letters, letters[:26], "ab", "lo", "es"])) for _ in range(rng.randint(1, 64))) for _ in range(3000)]
    words += [t.removesuffix("</w>") for t in encoder.tok.get_vocab() if t.removesuffix("</w>").isascii() and t.removesuffix("</w>").isalpha() and len(t) < 64][:20_000]
    words += ["a" * k for k in range(1, 65)] + ["ß", "ÿ", "İ", "ſ", "ª", "á", "x×y", "a÷b", "naïve", "École", "word\n", "z" * 65]
    words += [b + w for b in " \n" for w in words[:3000]]
    want = [encoder.library(w).tobytes() for w in words]
    fits = encoder.plain.fits(pa.array(words, pa.large_string()))
    assert [w for w, f in zip(words[-6012:-6000], fits[-6012:-6000]) if f] == ["ß", "ÿ", "naïve", "École"]
    assert encoder.encode_each(pa.array(words)) == want and list(encoder.library_all(words)) == want
    monkeypatch.setattr(bpe.PieceEncoder, "library_all", lambda self, texts, *k: sent.append(sum(map(len, texts))) or library(self, texts, *k))
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(4000))
    assert encoder.encode_all([text]) == [encoder.library(text).tobytes()] and sum(sent) < 0.1 * len(text)
    assert bpe.PlainWords.of(public_tokenizers.path("byte_bpe_50k.json")) is None


def test_listed_words_are_hashed_once(monkeypatch):
    """Words that share a number are hashed when the list is made, not again for each slice of texts."""
    listed = [f"w{k}" for k in range(lm_scoring.KNOWN + 500)]
    numbers, crc, asked = lm_scoring.Numbers(listed), lm_scoring.zlib.crc32, []
    monkeypatch.setattr(lm_scoring.zlib, "crc32", lambda x: asked.append(x) or crc(x))
    got = numbers(pa.array([" ".join(listed), "w3 new w2100 new", None, ""]))
    want = [k if k < lm_scoring.KNOWN else lm_scoring.KNOWN + crc(w.encode()) % (lm_scoring.TOKENS - lm_scoring.KNOWN) for k, w in enumerate(listed)]
    unknown = lm_scoring.KNOWN + crc(b"new") % (lm_scoring.TOKENS - lm_scoring.KNOWN)
    assert got[0].tolist() == [*want, 3, unknown, want[2100], unknown] and got[1].tolist() == [len(listed), 4, 0, 0]
    assert asked == [b"new"]
    assert len(lm_scoring.Numbers([])(pa.array(["a b"]))[0]) == 2 and not len(numbers(pa.array([None], pa.string()))[0])


@pytest.mark.parametrize("scale", [1, 40])
def test_blocks_of_the_network_agree_with_double_precision(scale):
    """Scores and gradients over several blocks and batches, with logits beyond the range of exp too."""
    rng, net = np.random.default_rng(4), lm_scoring.Network(seed=5)
    for k in ("cw", "tw"):
        net.p[k] = (net.p[k] * 20 * scale).astype("f4")
    net.p["tb"] += rng.normal(0, 1, net.p["tb"].shape).astype("f4")
    sizes = np.array([3, 0, lm_scoring.BATCH + 700, 1, lm_scoring.BLOCK + 1])
    tape, at = lm_scoring.laid_out((rng.random(int(sizes.sum())) ** 3 * lm_scoring.TOKENS).astype(np.int64), sizes)
    p = {k: v.astype("f8") for k, v in net.p.items()}
    x = p["embed"][tape[at[:, None] + lm_scoring.OFFSETS]].reshape(len(at), -1)
    h, c, j = np.tanh(x @ p["w"] + p["b"]), tape[at] // lm_scoring.SIZE, tape[at] % lm_scoring.SIZE
    outer, inner = h @ p["cw"] + p["cb"], np.einsum("nh,nhs->ns", h, p["tw"][c]) + p["tb"][c]
    shares = [np.exp(z - z.max(axis=1, keepdims=True)) for z in (outer, inner)]
    shares = [e / e.sum(axis=1, keepdims=True) for e in shares]
    rows, logp = np.arange(len(at)), 0
    for z, right in ((outer, c), (inner, j)):
        logp = logp + z[rows, right] - z.max(axis=1) - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1))
    got = net.log_probs(tape, at)
    mild = logp > -80  # beyond, the single precision of exp ends
    assert np.abs(got - logp)[mild].max() < 1e-3 and mild.mean() > 0.5
    d, e = (s.copy() for s in shares)
    d[rows, c] -= 1
    e[rows, j] -= 1
    tw = np.zeros_like(p["tw"])
    for n in range(lm_scoring.CLASSES):
        tw[n] = h[c == n].T @ e[c == n]
    dz = (d @ p["cw"].T + np.einsum("ns,nhs->nh", e, p["tw"][c])) * (1 - h**2)
    embed = np.zeros_like(p["embed"])
    np.add.at(embed, tape[at[:, None] + lm_scoring.OFFSETS].reshape(-1), (dz @ p["w"].T).reshape(-1, lm_scoring.EMBED))
    want = {"embed": embed, "w": x.T @ dz, "b": dz.sum(axis=0), "cw": h.T @ d, "cb": d.sum(axis=0), "tw": tw, "tb": np.stack([e[c == n].sum(axis=0) for n in range(lm_scoring.CLASSES)])}
    sums = net.zeros()
    net.add_gradient(tape, at, sums)
    for k, v in want.items():
        assert np.abs(sums[k] - v).max() < 1e-3 * np.abs(v).max() + 1e-3, k


def test_lm_words_travel_packed(spark):
    """A slice sends a row to each part, not one for each of its words; counts and sums stay exact, with long and odd words too."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(3000)] + ["é" * 40, "日本語", "x" * 64, "y" * 65, "z" * 70_000]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 200))) for _ in range(60)] + [None, "", "  ", " ".join(words), " ".join(words[-5:] * 3)]
    texts += texts[:3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    assert lm_scoring.crc32s(pa.array(words)[7:]).tolist() == [zlib.crc32(w.encode()) for w in words[7:]]
    counts = lm_scoring.word_counts(docs)
    count = Counter(w for t in texts for w in (t or "").split())
    assert {r["word"]: r["count"] for r in counts.collect()} == count and counts.count() == len(count) > 2000
    listed = sorted(count, key=lambda w: (-count[w], w))[:20]
    sent = lm_scoring.words_of_texts(docs, listed, "text", 4)
    assert sent.count() <= 3 * 16 and sent.agg(F.sum("n")).first()[0] >= len(count) - 20
    seen = counts.where("word <> 'yyy' and length(word) < 60000 and count > 1")  # words that were never counted have UNSEEN
    keys = {r["doc_id"]: r["k"] for r in docs.select("doc_id", F.xxhash64("text").alias("k")).collect()}
    want, known = Counter(), {r["word"]: r["count"] for r in seen.collect()}
    for d, t in enumerate(texts):
        want[keys[d]] += sum(np.log(known.get(w, lm_scoring.UNSEEN)) for w in (t or "").split() if w not in listed)
    got = Counter()
    for r in lm_scoring.rare_logs(docs, listed, seen, bits=4).collect():
        got[r["_key"]] += r["log"]
    assert all(got[k] == pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in want.items()) and set(got) <= set(want)
    assert lm_scoring.word_counts(docs.where("false")).count() == lm_scoring.rare_logs(docs.where("false"), listed, seen).count() == 0


def test_lm_plain_sort_gives_the_order():
    rng = np.random.default_rng(3)
    for bits, dtype in ((39, "i8"), (32, "u4"), (62, "i8")):  # the last has no room for the places
        x = rng.integers(0, 1 << bits, 5000, dtype="i8").astype(dtype) >> np.array(bits - 10, dtype)
        x[:3] = [(1 << bits) - 1, 0, (1 << bits) - 1]
        values, order = lm_scoring.in_order(x, bits)
        assert (order == np.argsort(x, kind="stable")).all() and (values == x[order]).all()
    tape, at = lm_scoring.laid_out(np.arange(50) * 83, np.array([20, 0, 30]))
    assert (lm_scoring.contexts(tape, at) == tape[at[:, None] + lm_scoring.OFFSETS]).all() and tape.max() == lm_scoring.EDGE
