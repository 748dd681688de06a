"""Masked pseudo-likelihood of documents under a bidirectional window network.

Words are the tokens: the KNOWN most frequent of the whole corpus have a number each, all others share
hashed numbers. The probability of a masked word has three parts:

* The network sees the REACH words on either side and predicts the number by a softmax over classes and one
  over the numbers of its class. It starts from the numbers' frequencies.
* At every place what the corpus has between the same neighbours elsewhere is mixed in:
  (c - 1 + PRIOR * p) / (C - 1 + PRIOR) for c of C such places with this number, this place itself left out.
  Both are counted in Spark over all places of the corpus. Passages that the corpus repeats score high by it.
* A word that shares its number has its own share of the number's count, from the counts of all words;
  words that were never counted have UNSEEN together.

A document's score is the sum of the log probabilities of all its words. The counts of words and of
neighbours grow with the corpus and are held by no task: both are joined in Spark, and the logs are summed
by the hash of the text (64 bits), over its copies, and divided by their number. Only the counts of the
LISTED most frequent words are given to every task, so that few words need the join. Words travel packed:
they are dealt to parts by their crc32, and a slice of texts sends one row to each part. Texts lie in blocks (a slice
of a task's texts); a block asks for each different triple of neighbours and number once, so frequent neighbours
arrive as few numbers, and gets the counts back.

Every document takes part in all counts and in training. Rows are dealt to STEPS mini-batches by a hash of
their columns. In each step tasks compute in numpy the gradient over all positions of their rows of that batch,
Spark adds the gradients of all tasks, and the driver makes one step with the mean (Adam, its rate falling
to 0). So every position is trained on once, and how rows lie in tasks changes no more than the rounding of sums.
The texts' numbers are written once, in a folder for each step, and read by training and by scoring.

Cases: null texts and texts without words have 0 tokens and score 0; other columns and repeated rows are
kept and rows with equal texts score alike; columns named n_tokens, log_prob and log_prob_per_token, in
any case, are replaced; an empty table gives an empty result; words with equal counts are ordered by the word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, discard, others, staged, text_slices

KNOWN, CLASSES, SIZE = 2048, 64, 64  # CLASSES * SIZE token numbers
EMBED, HIDDEN, REACH = 8, 16, 2
BATCH, STEPS, RATE = 16_384, 32, 0.08
#: Positions whose arrays stay in a core's cache; they are in order of their classes, so few classes meet in one block.
BLOCK = 2048
DECAY = (0.8, 0.95)  # of Adam's means of gradients and of their squares
TOKENS = CLASSES * SIZE
EDGE = TOKENS  # stands beyond either end of a document
UNSEEN = 0.5  # the count of all words of a number that the corpus doesn't have
PRIOR = 1.0
#: Bits of a token number or EDGE; of two of them; and the odd number that spreads neighbours over all parts.
BITS, PAIR, SPREAD = 13, 26, 0x2545F49
#: Asked triples are dealt to 128 parts or more, so that 32 bits tell those of a part; more where a part would have more places than PART.
LEAST, PART = 7, 1 << 21
LISTED = 100_000
SLICE = 8 << 20
#: Words of up to LONG bytes are hashed together, if they aren't FEW.
LONG, FEW = 64, 64
CRC = np.arange(256, dtype="u4")
for _ in range(8):
    CRC = np.where(CRC & 1, CRC >> 1 ^ np.uint32(0xEDB88320), CRC >> 1)
OFFSETS = np.array([*range(-REACH, 0), *range(1, REACH + 1)])
NARROW = np.int16 if EDGE < 1 << 15 else np.int32  # holds a token number or EDGE
SHAPES = {"embed": (TOKENS + 1, EMBED), "w": (2 * REACH * EMBED, HIDDEN), "b": (HIDDEN,), "cw": (HIDDEN, CLASSES), "cb": (CLASSES,), "tw": (CLASSES, HIDDEN, SIZE), "tb": (CLASSES, SIZE)}
#: Gradients travel in rows of this many numbers, which are added one row's place at a time: 8 KB from each task.
CHUNK = 1024


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, split at white space, and each text's number of words."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    flat, parent = split.flatten(), pc.list_parent_indices(split).to_numpy()
    some = pc.not_equal(flat, "")
    return flat.filter(some), np.bincount(parent[some.to_numpy(zero_copy_only=False)], minlength=len(texts))


def crc32s(words: pa.Array) -> np.ndarray:
    """The crc32 of each word, as Spark's: a byte of all words at a time; few words and those of more than LONG bytes one by one."""
    if len(words) < FEW:
        return np.array([zlib.crc32(w.encode()) for w in words.to_pylist()], dtype="u4")
    ends, data = np.frombuffer(words.buffers()[1], dtype="<i4")[words.offset : words.offset + len(words) + 1], np.frombuffer(words.buffers()[2] or b"", dtype="u1")
    size, crc = np.diff(ends), np.full(len(words), 0xFFFFFFFF, dtype="u4")
    order = np.argsort(-np.minimum(size, LONG).astype(np.int16), kind="stable")
    at = ends[:-1][order].astype(np.int64)
    for k in range(LONG):
        n = np.count_nonzero(size > k)
        if not n:
            break
        crc[:n] = CRC[(crc[:n] ^ data[at[:n] + k]) & 255] ^ crc[:n] >> 8
    out = np.empty_like(crc)
    out[order] = ~crc
    for k in np.flatnonzero(size > LONG):
        out[k] = zlib.crc32(data[ends[k] : ends[k + 1]])
    return out


def dealt(words: pa.Array, bits: int) -> tuple[np.ndarray, list[tuple[int, int]], dict[str, pa.Array]]:
    """Different words in order of 2**bits parts by their hashes: the order, the span of each part, and a row for each part with its words' lengths and bytes."""
    part = (crc32s(words) & (1 << bits) - 1).astype(np.int16 if bits < 16 else np.int32)
    order = np.argsort(part, kind="stable")
    part, words = part[order], words.take(pa.array(order))
    ends, data = np.frombuffer(words.buffers()[1], dtype="<i4")[: len(words) + 1], words.buffers()[2].to_pybytes()
    cuts = starts_of(part)
    spans, sizes = [*zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)])], np.diff(ends)
    rows = {"part": pa.array(part[cuts], pa.int32()), "n": pa.array([b - a for a, b in spans], pa.int64()), "sizes": pa.array([planes(sizes[a:b]) for a, b in spans], pa.binary()), "words": pa.array([data[ends[a] : ends[b]] for a, b in spans], pa.binary())}
    return order, spans, rows


def from_dealt(rows: pa.Table, name: str) -> tuple[pa.Array, np.ndarray]:
    """The words of rows of ``dealt``, and the number that the column ``name`` has for each, as ``planes``."""
    n = rows["n"].to_pylist()
    sizes, numbers = (np.concatenate([from_planes(x, k) for x, k in zip(rows[c].to_pylist(), n)]) for c in ("sizes", name))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(rows["words"].to_pylist()))]), numbers


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, count) over all documents, counted in each task before the shuffle; a task sends its words of a part as one row.

    There are two parts or more for each of Spark's shuffle partitions.
    """
    bits = max(LEAST, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")).bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 2 * SLICE):
            counted = words_of(batch.column(0))[0].value_counts()
            if len(counted):
                order, spans, rows = dealt(counted.field("values"), bits)
                counts = counted.field("counts").to_numpy()[order]
                yield pa.RecordBatch.from_pydict(rows | {"counts": pa.array([planes(counts[a:b]) for a, b in spans], pa.binary())})

    def added(rows: pa.Table) -> pa.Table:
        words, counts = from_dealt(rows, "counts")
        coded = words.dictionary_encode()
        return pa.table({"word": coded.dictionary.cast(pa.string()), "count": np.bincount(coded.indices.to_numpy(), counts).astype(np.int64)})

    sent = docs.select(column(text_col).alias("text")).mapInArrow(run, "part int, n bigint, sizes binary, words binary, counts binary")
    return sent.groupBy("part").applyInArrow(added, "word string, count bigint")


def bucket(word: Column) -> Column:
    """What ``Numbers`` adds to KNOWN for a word that isn't known."""
    return F.pmod(F.crc32(word), F.lit(TOKENS - KNOWN))


def shared_counts(counts: DataFrame, known: list[str]) -> np.ndarray:
    """For each token number the count that its words share; 0 for known words."""
    listed = counts.sparkSession.createDataFrame([(w,) for w in known], "word string")
    totals = counts.join(F.broadcast(listed), "word", "left_anti").groupBy(bucket(F.col("word")).alias("b")).agg(F.sum("count").alias("n")).collect()  # a row a number
    out = np.zeros(TOKENS)
    out[KNOWN:] = UNSEEN
    for r in totals:
        out[KNOWN + r["b"]] += r["n"]
    return out


def words_of_texts(docs: DataFrame, listed: list[str], text_col: str, bits: int) -> DataFrame:
    """Rows of ``dealt`` for the words of a slice that aren't listed; times: how often each occurs; keys: 8 bytes for each time, of the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip = pa.array(listed, pa.string())
        for batch in text_slices(batches, "text", SLICE):
            words, sizes = words_of(batch.column(0))
            rare = pc.invert(pc.is_in(words, skip))
            keys = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), sizes)[rare.to_numpy(zero_copy_only=False)]
            coded = words.filter(rare).dictionary_encode()
            if not len(coded):
                continue
            order, spans, rows = dealt(coded.dictionary, bits)
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            ranks, places = in_order(rank[coded.indices.to_numpy()], 32)
            times, keys = np.bincount(ranks), keys[places].astype("<i8")
            ends = np.concatenate([[0], np.cumsum(times)])
            more = {"times": pa.array([planes(times[a:b]) for a, b in spans], pa.binary()), "keys": pa.array([keys[ends[a] : ends[b]].tobytes() for a, b in spans], pa.binary())}
            yield pa.RecordBatch.from_pydict(rows | more)

    return docs.select(column(text_col).alias("text"), F.xxhash64(column(text_col)).alias("key")).mapInArrow(run, "part int, n bigint, sizes binary, words binary, times binary, keys binary")


def rare_logs(docs: DataFrame, listed: list[str], counts: DataFrame, text_col: str = "text", bits: int = LEAST) -> DataFrame:
    """(_key, log): for the hash of a text, sums of the logs of the counts of its words that aren't listed, one from each of 2**bits parts of the words that has some."""

    def run(asks: pa.Table, found: pa.Table) -> pa.Table:
        keys, sums = np.zeros(0, dtype=np.int64), np.zeros(0)
        if asks.num_rows:
            words, times = from_dealt(asks, "times")
            place = pc.fill_null(pc.index_in(words, value_set=found["word"].combine_chunks().cast(pa.large_string())), -1).to_numpy(zero_copy_only=False)
            logs = np.repeat(np.log(np.append(found["count"].to_numpy(), UNSEEN))[place], times)
            keys, at = np.unique(np.frombuffer(b"".join(asks["keys"].to_pylist()), dtype="<i8")[logs != 0], return_inverse=True)
            sums = np.bincount(at, logs[logs != 0], minlength=len(keys))
        return pa.table({"_key": keys, "log": sums})

    known = counts.select(F.crc32("word").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("part"), "word", "count")
    return words_of_texts(docs, listed, text_col, bits).groupBy("part").cogroup(known.groupBy("part")).applyInArrow(run, "_key bigint, log double")


def hashed(words: pa.Array) -> np.ndarray:
    """The numbers of words that aren't known, as ``bucket`` has them."""
    return KNOWN + crc32s(words).astype(np.int64) % (TOKENS - KNOWN)


class Numbers:
    """Token numbers of words, and the logs of the counts of those that share theirs.

    ``listed``: words by their counts, the known ones first; ``logs``: what each adds, 0 for known ones.
    """

    def __init__(self, listed: list[str], logs: np.ndarray | None = None):
        self.listed, self.logs = pa.array(listed, pa.string()), np.zeros(len(listed) + 1)
        if logs is not None:
            self.logs[:-1] = logs
        self.number = np.concatenate([np.arange(min(KNOWN, len(listed))), hashed(self.listed[KNOWN:])])

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = words.dictionary_encode()
        place = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.listed), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        number, rare = np.append(self.number, 0)[place], np.flatnonzero(place < 0)
        number[rare] = hashed(coded.dictionary.take(pa.array(rare)))
        codes = coded.indices.to_numpy() if len(words) else number[:0]
        return number[codes], self.logs[place][codes]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of the texts, and each text's number of words."""
        words, sizes = words_of(texts)
        return self.of(words)[0], sizes


def laid_out(numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All documents in a row with edges between them, and the positions of the tokens."""
    at = np.arange(len(numbers)) + REACH * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    tape = np.full(len(numbers) + REACH * (len(sizes) + 1), EDGE, dtype=np.int64)
    tape[at] = numbers
    return tape, at


def contexts(tape: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The numbers of the neighbours of each position, read along the tape; a row is so short that taking rows in any order is cheap."""
    small, out = tape.astype(NARROW), np.empty((len(at), len(OFFSETS)), dtype=NARROW)
    for k, offset in enumerate(OFFSETS):
        out[:, k] = small[at + offset]
    return out


def spots(e: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Where in the flat ``e`` each row's entry ``right`` is."""
    return np.arange(0, e.size, e.shape[1]) + right


def by_class(token: np.ndarray) -> np.ndarray:
    """The places of the tokens in order of their classes."""
    return np.argsort((token // SIZE).astype(np.int16), kind="stable")


def classes(c: np.ndarray) -> list[tuple[int, int, int]]:
    """(class, start, end) of each class in ``c``, which is in order."""
    cuts = np.flatnonzero(np.diff(c, prepend=-1)).tolist()
    return [*zip(c[cuts].tolist(), cuts, [*cuts[1:], len(c)])]


class Network:
    def __init__(self, flat: np.ndarray | None = None, seed: int = 0, counts: np.ndarray | None = None):
        """``counts`` of the token numbers: a new network starts from their shares."""
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([rng.normal(0, 0.0 if k.endswith("b") else 0.2 if k in ("embed", "w") else 0.02, int(np.prod(s))) for k, s in SHAPES.items()])
        cuts = np.cumsum([int(np.prod(s)) for s in SHAPES.values()])[:-1]
        self.p = {k: x.reshape(s).astype("f4") for (k, s), x in zip(SHAPES.items(), np.split(np.asarray(flat), cuts))}
        if counts is not None:
            share = np.maximum(counts, UNSEEN).reshape(CLASSES, SIZE)
            self.p["cb"], self.p["tb"] = np.log(share.sum(axis=1) / share.sum()).astype("f4"), np.log(share / share.sum(axis=1, keepdims=True)).astype("f4")

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].reshape(-1) for k in SHAPES])

    def inputs(self, context: np.ndarray) -> np.ndarray:
        return np.take(self.p["embed"], context.reshape(-1), axis=0).reshape(len(context), -1)

    def hidden(self, x: np.ndarray) -> np.ndarray:
        """What the hidden units make of ``inputs``, and a 1 for the biases."""
        h = np.ones((len(x), HIDDEN + 1), dtype="f4")
        e = x @ self.p["w"]
        e += self.p["b"]
        e *= 2
        with np.errstate(over="ignore"):
            np.exp(e, out=e)
        e += 1
        np.subtract(1, np.divide(2, e, out=e), out=h[:, :-1])  # tanh
        return h

    def levels(self) -> list[tuple[np.ndarray, bool]]:
        """The weights of the softmax over classes, then of each class, with biases as the last row; whether a logit may be large."""
        p = self.p
        both = [np.concatenate([p["cw"], p["cb"][None]]), *np.concatenate([p["tw"], p["tb"][:, None]], axis=1)]
        return [(w, bool(np.abs(w).sum(axis=0).max() > 60)) for w in both]

    @staticmethod
    def softmax(h: np.ndarray, w: np.ndarray, large: bool) -> tuple[np.ndarray, np.ndarray]:
        """exp of each row's logits, less a common number where they may be large, and the rows' sums."""
        e = h @ w
        if large:
            e -= e.max(axis=1, keepdims=True)
        np.exp(e, out=e)
        return e, e @ np.ones(e.shape[1], dtype=e.dtype)

    def log_probs(self, tape: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log p(token | both sides) at the positions ``at``."""
        levels, out, order = self.levels(), np.empty(len(at), dtype="f8"), by_class(tape[at])
        context, tokens = np.take(contexts(tape, at), order, axis=0), tape[at][order]
        for k in range(0, len(at), BLOCK):
            h = self.hidden(self.inputs(context[k : k + BLOCK]))
            token = tokens[k : k + BLOCK]
            c, j = token // SIZE, token % SIZE
            e, total = self.softmax(h, *levels[0])
            result = np.log(e.reshape(-1)[spots(e, c)]) - np.log(total)
            for n, a, b in classes(c):
                e, total = self.softmax(h[a:b], *levels[1 + n])
                result[a:b] += np.log(e.reshape(-1)[spots(e, j[a:b])]) - np.log(total)
            out[order[k : k + BLOCK]] = result
        return out

    def zeros(self) -> dict[str, np.ndarray]:
        return {k: np.zeros(v.shape) for k, v in self.p.items()}

    def add_gradient(self, tape: np.ndarray, at: np.ndarray, sums: dict[str, np.ndarray]) -> None:
        """Add to ``sums`` the gradient of the summed loss at the positions ``at``."""
        levels, order = self.levels(), by_class(tape[at])
        contexts_, tokens = np.take(contexts(tape, at), order, axis=0), tape[at][order]
        for k in range(0, len(at), BATCH):
            context, token = contexts_[k : k + BATCH], tokens[k : k + BATCH]
            dx = np.empty((len(token), context.shape[1] * EMBED), dtype="f4")
            for a in range(0, len(token), BLOCK):
                dx[a : a + BLOCK] = self.add_block(context[a : a + BLOCK], token[a : a + BLOCK], levels, sums)
            flat = context.reshape(-1).astype(np.int64)
            for d in range(EMBED):
                sums["embed"][:, d] += np.bincount(flat, dx.reshape(-1, EMBED)[:, d], minlength=TOKENS + 1)

    def add_block(self, context: np.ndarray, token: np.ndarray, levels: list[tuple[np.ndarray, bool]], sums: dict[str, np.ndarray]) -> np.ndarray:
        """Add the gradient of all weights but the embeddings, for tokens in order of their classes; returns that of ``inputs``."""
        p, c, j = self.p, token // SIZE, token % SIZE
        x = self.inputs(context)
        h = self.hidden(x)

        def level(h: np.ndarray, n: int, right: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Add the gradient of level ``n`` to ``w`` and ``b``; returns that of ``h``. Divisions by the rows' sums are left to the narrow side."""
            e, total = self.softmax(h, *levels[n])
            e.reshape(-1)[spots(e, right)] -= total
            share = 1 / total[:, None]
            g = (h * share).T @ e
            w += g[:-1]
            b += g[-1]
            dh = e @ levels[n][0][:-1].T
            dh *= share
            return dh

        dh = level(h, 0, c, sums["cw"], sums["cb"])
        for k, a, b in classes(c):
            dh[a:b] += level(h[a:b], 1 + k, j[a:b], sums["tw"][k], sums["tb"][k])
        dh *= 1 - h[:, :-1] ** 2
        sums["w"] += x.T @ dh
        sums["b"] += np.ones(len(x), dtype="f4") @ dh
        return dh @ p["w"].T


def flattened(parts: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([parts[k].reshape(-1) for k in SHAPES])


class Adam:
    """Steps of a flat vector of weights along mean gradients; the rate falls in a straight line to 0 over STEPS."""

    def __init__(self, weights: np.ndarray):
        self.at, self.mean, self.square, self.n = np.asarray(weights, dtype="f8"), 0.0, 0.0, 0

    def step(self, gradient: np.ndarray, rate: float) -> None:
        self.n += 1
        self.mean = DECAY[0] * self.mean + (1 - DECAY[0]) * gradient
        self.square = DECAY[1] * self.square + (1 - DECAY[1]) * gradient**2
        self.at = self.at - rate * (self.mean / (1 - DECAY[0] ** self.n)) / (np.sqrt(self.square / (1 - DECAY[1] ** self.n)) + 1e-6)


def numbered(docs: DataFrame, known: list[str], text_col: str = "text", counts: DataFrame | None = None, listed: int = LISTED) -> DataFrame:
    """(_key, numbers, own, block, step): a text's hash, its words' numbers (2 bytes each), what its listed words add for having shares of their numbers, and its block.

    Rows lie by their step of training and by where they were, so that each step is a few files, more with more
    rows. A step is chosen by all plain columns of a row, so copies of a text with ids of their own are spread.
    """
    names, logs, shared = listed_words(counts, known, listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, task = Numbers(names, logs), TaskContext.get().partitionId() << 32
        for k, batch in enumerate(text_slices(batches, "text", SLICE // 2)):
            words, sizes = words_of(batch.column(1))
            flat, extra = numbers.of(words)
            starts, some = np.cumsum(sizes) - sizes, sizes > 0
            own = np.zeros(len(sizes))
            own[some] = np.add.reduceat(extra - shared[flat], starts[some]) if some.any() else 0.0
            ends = np.concatenate([[0], np.cumsum(sizes * 2)]).astype("i4")
            packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(flat.astype("<i2").tobytes())])
            block = pa.array(np.full(len(sizes), task + k))
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array(own), block, *batch.columns[2:]], ["_key", "numbers", "own", "block", "step", "place"])

    plain = [column(f.name) for f in docs.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    step = F.pmod(F.xxhash64(*plain), F.lit(STEPS)).cast("int")
    rows = docs.select(F.xxhash64(column(text_col)).alias("_key"), column(text_col).alias("text"), step.alias("step"), F.floor(F.spark_partition_id() / 16).cast("int").alias("place"))
    return rows.mapInArrow(run, "_key bigint, numbers binary, own double, block bigint, step int, place int").repartition("step", "place").drop("place")


def unpacked(numbers: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of ``numbered`` in a row, and how many each text has."""
    lists = numbers.to_pylist()
    return np.frombuffer(b"".join(lists), dtype="<i2").astype(np.int64), np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)) // 2


def gradient(tokens: DataFrame, weights: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of positions in the rows of ``tokens`` and the summed gradient over them."""
    schema = "part int, n bigint, sums binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen = Network(weights), 0
        sums = net.zeros()
        for batch in text_slices(batches, "numbers", SLICE // 4):
            tape, at = laid_out(*unpacked(batch.column(0)))
            net.add_gradient(tape, at, sums)
            seen += len(at)
        if seen:
            flat = flattened(sums)
            parts = [flat[k : k + CHUNK].tobytes() for k in range(0, len(flat), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["part", "n", "sums"])

    def added(frame: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype="f8") for x in frame["sums"].to_pylist())
        return pa.table({"part": frame["part"][:1], "n": [pc.sum(frame["n"]).as_py()], "sums": pa.array([total.tobytes()], pa.binary())})

    each = tokens.select("numbers").mapInArrow(run, schema)
    rows = sorted(each.groupBy("part").applyInArrow(added, schema).collect(), key=lambda r: r["part"])  # the network once
    return (rows[0]["n"], np.concatenate([np.frombuffer(r["sums"], dtype="f8") for r in rows])) if rows else (0, np.zeros(0))


def trained(tokens: DataFrame, start: np.ndarray) -> np.ndarray:
    """The weights reached from ``start`` by a step on each of the STEPS mini-batches of ``tokens`` that has words."""
    adam = Adam(start)
    for k in range(STEPS):
        n, sums = gradient(tokens.where(F.col("step") == k), adam.at.astype("f4"))
        if n:
            adam.step(sums / n, RATE * (1 - k / STEPS))
    return adam.at.astype("f4")


def most_frequent(counts: DataFrame) -> list[str]:
    return [r["word"] for r in counts.orderBy(F.desc("count"), "word").limit(KNOWN).collect()]


def other_words(counts: DataFrame, known: list[str], listed: int) -> list[Row]:
    """The listed words that aren't known, with their counts."""
    of_known = set(known)
    return [r for r in counts.orderBy(F.desc("count"), "word").limit(listed).collect() if r["word"] not in of_known] if known else []


def listed_words(counts: DataFrame | None, known: list[str], listed: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The known and the other listed words, the logs of their counts (0 if known), and for each number the log of the count that its words share."""
    names, own, shared = known, np.zeros(len(known)), np.zeros(TOKENS)
    if counts is not None:
        shared[KNOWN:] = np.log(shared_counts(counts, known)[KNOWN:])
        more = other_words(counts, known, listed)
        names, own = [*known, *(r["word"] for r in more)], np.concatenate([own, np.log([r["count"] for r in more])])
    return names, own, shared


def fit(docs: DataFrame, text_col: str = "text", seed: int = 0, counts: DataFrame | None = None, tokens: DataFrame | None = None) -> tuple[list[str], np.ndarray]:
    """The known words and the network's weights; ``counts`` and ``tokens``: the word counts and ``numbered``, if they are at hand."""
    counts = word_counts(docs, text_col) if counts is None else counts
    top = counts.orderBy(F.desc("count"), "word").limit(KNOWN).collect()
    known, totals = [r["word"] for r in top], shared_counts(counts, [r["word"] for r in top])
    totals[: len(top)] = [r["count"] for r in top]
    own = staged(numbered(docs, known, text_col), "tokens", by="step") if tokens is None else None
    weights = trained(tokens if own is None else own, Network(seed=seed, counts=totals).flat())
    discard(own)
    return known, weights


def anchors(tape: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the positions ``at`` ask the corpus, all of them, and the numbers of their neighbours, spread over PAIR bits."""
    return np.arange(len(at)), (tape[at - 1] << BITS | tape[at + 1]) * SPREAD & (1 << PAIR) - 1


def triples(tape: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for the neighbours and the token of each position; its high bits are of the neighbours."""
    return anchors(tape, at)[1] << BITS | tape[at]


def planes(x: np.ndarray) -> bytes:
    """Counts as all their lowest bytes, then all their second ones and so on, as few as the largest needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return x.astype("<u8").view("u1").reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype="u1")
    out[:, : len(raw) // n] = np.frombuffer(raw, dtype="u1").reshape(-1, n).T
    return out.reshape(-1).view("<u8").astype(np.int64)


def starts_of(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def in_order(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``x``, of numbers below 2**bits, in order, and the places they had. The place goes into the low bits: a plain sort is some times faster than an argsort."""
    low = len(x).bit_length()
    if bits + low > 64:
        order = np.argsort(x, kind="stable")
        return x[order], order
    both = np.sort(x.astype("u8") << np.uint64(low) | np.arange(len(x), dtype="u8"))
    return (both >> np.uint64(low)).view("i8"), (both & np.uint64((1 << low) - 1)).view("i8")


def asked(tokens: DataFrame, bits: int) -> DataFrame:
    """(part, block, codes, n): for each block and each of 2**bits parts of the neighbours the different triples in order (their low 32 bits), and how often each occurs."""

    def run(frame: pa.Table) -> pa.Table:
        found, n = np.unique(triples(*laid_out(*unpacked(frame["numbers"]))), return_counts=True)
        part = found >> PAIR + BITS - bits
        cuts = starts_of(part) if len(part) else part
        ends = [*cuts[1:].tolist(), len(part)]
        codes, spans = found.astype("<u4"), [*zip(cuts.tolist(), ends)]
        columns = [pa.array(part[cuts], pa.int64()), pa.array([frame["block"][0].as_py()] * len(cuts), pa.int64())]
        columns += [pa.array([codes[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([planes(n[a:b]) for a, b in spans], pa.binary())]
        return pa.table(columns, ["part", "block", "codes", "n"])

    return tokens.groupBy("block").applyInArrow(run, "part bigint, block bigint, codes binary, n binary")


def answered(asks: DataFrame) -> DataFrame:
    """(block, part, same, all): for each code of ``asked`` how often the corpus has the triple, and how often its neighbours."""

    def run(frame: pa.Table) -> pa.Table:
        lists = frame["codes"].to_pylist()
        sizes = [len(x) // 4 for x in lists]
        codes = np.frombuffer(b"".join(lists), dtype="<u4")
        n = np.concatenate([from_planes(x, k) for x, k in zip(frame["n"].to_pylist(), sizes)])
        ordered, order = in_order(codes, 32)
        first = starts_of(ordered)
        same, side = np.add.reduceat(n[order], first), ordered[first] >> BITS
        top = starts_of(side)
        whole = np.repeat(np.add.reduceat(same, top), np.diff(np.append(top, len(side))))
        times, cuts, back = np.diff(np.append(first, len(codes))), np.cumsum([0, *sizes]).tolist(), []
        for x in (same, whole):
            y = np.empty_like(n)
            y[order] = np.repeat(x, times)
            back.append(pa.array([planes(y[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()))
        return pa.table([frame["block"], frame["part"], *back], ["block", "part", "same", "all"])

    return asks.groupBy("part").applyInArrow(run, "block bigint, part bigint, same binary, all binary")


def text_sums(net: Network, numbers: pa.Array | pa.ChunkedArray, own: np.ndarray, replies: pa.Table | None = None, bits: int = LEAST) -> list[pa.Array]:
    """_key's companions n and log of texts: their words, and the sum of the logs with what the corpus has between the same neighbours mixed in."""
    flat, sizes = unpacked(numbers)
    tape, at = laid_out(flat, sizes)
    logs = net.log_probs(tape, at)
    if replies is not None and len(at):
        ordered, order = in_order(triples(tape, at), PAIR + BITS)
        begins = starts_of(ordered)
        found, times = ordered[begins], np.diff(np.append(begins, len(ordered)))
        first = starts_of(found >> PAIR + BITS - bits)
        counts = np.diff(np.append(first, len(found))).tolist()
        replies = replies.sort_by("part")
        same, whole = (np.repeat(np.concatenate([from_planes(x, k) for x, k in zip(replies[c].to_pylist(), counts, strict=True)]), times) for c in ("same", "all"))
        logs[order] = np.log((same - 1 + PRIOR * np.exp(logs[order])) / (whole - 1 + PRIOR))
    starts, some, sums = np.cumsum(sizes) - sizes, sizes > 0, own.copy()
    sums[some] += np.add.reduceat(logs, starts[some]) if some.any() else 0.0
    return [pa.array(sizes, pa.int64()), pa.array(sums)]


def score(docs: DataFrame, known: list[str], weights: np.ndarray, text_col: str = "text", counts: DataFrame | None = None, listed: int = LISTED, tokens: DataFrame | None = None) -> DataFrame:
    """``docs`` with n_tokens, log_prob (the sum) and log_prob_per_token.

    ``counts``: the word counts of the corpus; without them the network alone scores, and words that share a number aren't told apart.
    ``tokens``: ``numbered`` of the same documents, counts and ``listed``, if it is at hand.
    """
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("log_prob_per_token", T.DoubleType())]
    kept = [f.name for f in others(docs, *(f.name for f in added))]
    own = staged(numbered(docs, known, text_col, counts, listed), "tokens", by="step") if tokens is None else None  # once, as blocks are
    tokens = tokens if own is None else own

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(weights)
        for batch in text_slices(batches, "numbers", SLICE // 8):
            yield pa.RecordBatch.from_arrays([batch.column(0), *text_sums(net, batch.column(1), batch.column(2).to_numpy())], ["_key", "n", "log"])

    def mixed(texts: pa.Table, replies: pa.Table) -> pa.Table:
        return pa.table([texts["_key"], *text_sums(Network(weights), texts["numbers"], texts["own"].to_numpy(), replies, bits)], ["_key", "n", "log"])

    key, schema, more = F.xxhash64(column(text_col)).alias("_key"), "_key bigint, n bigint, log double", None
    if counts is None:
        scored = tokens.select("_key", "numbers", "own").mapInArrow(alone, schema)
    else:
        places = counts.agg(F.sum("count")).first()[0] or 0
        bits = min(PAIR, max(LEAST, (places // PART).bit_length()))
        texts = tokens.select("block", "_key", "numbers", "own")
        scored = texts.groupBy("block").cogroup(answered(asked(texts, bits)).groupBy("block")).applyInArrow(mixed, schema)
        more = rare_logs(docs, [*known, *(r["word"] for r in other_words(counts, known, listed))], counts, text_col, bits)
    none = F.lit(0).cast("bigint")
    parts = scored.select("_key", "log", "n", F.lit(1).cast("bigint").alias("copies"))
    if more is not None:
        parts = parts.unionByName(more.select("_key", "log", none.alias("n"), none.alias("copies")))
    by_text = parts.groupBy("_key").agg(F.sum("copies").alias("_copies"), F.sum("log").alias("_log"), F.sum("n").alias("_n"))
    of_text = staged(by_text.select("_key", (F.col("_n") / F.col("_copies")).cast("bigint").alias("_n"), (F.col("_log") / F.col("_copies")).alias("_log")), "texts")
    discard(own)
    rows = docs.select(key, *(column(c).alias(f"c{i}") for i, c in enumerate(kept))).join(of_text, "_key")
    per = F.col("_log") / F.greatest(F.col("_n"), F.lit(1))
    return rows.select(*(f"c{i}" for i in range(len(kept))), "_n", "_log", per.alias("_per")).toDF(*kept, *(f.name for f in added))
