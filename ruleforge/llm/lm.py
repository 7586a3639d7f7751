"""Masked pseudo-likelihood: a window network predicts every token from both sides; log-probabilities score documents.

The vocabulary is counted over all documents: the VOCABULARY - OTHERS most frequent words (ties by bytes) have ids of
their own, the rest share OTHERS hashed ids. The network embeds SPAN tokens on each side of a masked one, each side
and distance with its own part of the hidden layer, and gives the token in LEVELS softmax steps down a tree of the ids
by frequency, each among SIDE branches; their product is a proper distribution over all ids.

Training covers every token of all documents: the positions of a document fall by hash into as many parts as there are
rounds, and each round masks another part, so that every token is predicted once.
Rows are dealt to as many partitions as the corpus needs, about PART_BYTES of text to each; each runs numpy stochastic
gradient descent (AdaGrad) from the same start over its own rows, and the changes of weights and squares (as bfloat16)
are averaged, weighted by tokens, for ROUNDS rounds. What is gathered (counts, a set of weights for each partition, summed by slices of the
weights in Spark) thus grows with the corpus; what the driver gets is one set of weights. A document's score is the sum
of the log-probabilities of all its tokens, given all others nearby.

Defined cases: null texts are empty; a text without words has no tokens, score 0 and no mean (null); places beyond
the ends of a text hold a mark of their own; repeated rows score alike; an empty corpus gives the untrained network
and an empty result; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of

BITS, LEVELS = 4, 3
SIDE = 1 << BITS
VOCABULARY = SIDE**LEVELS
OTHERS = 512
SPAN = 2
WIDTH = 16
HIDDEN = 32
ROUNDS = 2
BATCH = 4096
RATE = 0.1
PART_BYTES = 32 << 20
_EDGE = VOCABULARY
_CACHE = 300_000
_TOGETHER = 100_000
_SLICE = 4096
#: Columns by which the rows of a batch's matrices are longer than the batch: rows a power of two apart share few places of a cache.
_APART = 16
_GROUPS = 64
_WEIGHTS = {"embed": (VOCABULARY + 1, WIDTH), "mix": (2 * SPAN * WIDTH, HIDDEN), "shift": (HIDDEN,)} | {f"tree{n}": (SIDE**n, SIDE, HIDDEN + 1) for n in range(LEVELS)}
#: Sums of squared gradients, by which AdaGrad divides: one for each embedded token, else one a weight.
_SHAPES = _WEIGHTS | {f"{k}_squares": (s[0], 1) if k == "embed" else s for k, s in _WEIGHTS.items()}


def _columns(rows: int, n: int, dtype: np.dtype) -> np.ndarray:
    """A matrix of n columns that is not set."""
    return np.empty((rows, n + _APART), dtype=dtype)[:, :n]


@dataclass
class Network:
    """The weights, and the sums of their squared gradients, by name."""

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        made = {k: np.full(s, 1e-8) if k.endswith("squares") else rng.normal(0, 0.1, s) if k != "shift" else np.zeros(s) for k, s in _SHAPES.items()}
        for n in range(LEVELS):
            made[f"tree{n}"][:, :, HIDDEN] = 0
        return cls({k: v.astype(np.float32) for k, v in made.items()})

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights[k].ravel() for k in _SHAPES])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for k, s in _SHAPES.items():
            n = int(np.prod(s))
            out[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n
        return cls(out)

    def _hidden(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs by row, and hidden values by column with a last row of ones."""
        w = self.weights
        x = w["embed"].take(around, axis=0).reshape(len(around), -1)
        h = _columns(HIDDEN + 1, len(around), x.dtype)
        np.matmul(w["mix"].T, x.T, out=h[:HIDDEN])
        h[:HIDDEN] += w["shift"][:, None]
        np.tanh(h[:HIDDEN], out=h[:HIDDEN])
        h[HIDDEN] = 1
        return x, h

    def _branches(self, h: np.ndarray, tokens: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Logits of the branches below each token's node of a level, by column; the branch it takes; (node, from, to) of the runs. tokens ascend."""
        node = tokens >> (BITS * (LEVELS - level))
        starts = np.concatenate(([0], np.flatnonzero(node[1:] != node[:-1]) + 1))
        runs = list(zip(node[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(tokens)], strict=True))
        z, tree = _columns(SIDE, len(tokens), h.dtype), self.weights[f"tree{level}"]
        for n, a, b in runs:
            np.matmul(tree[n], h[:, a:b], z[:, a:b])
        z -= z.max(axis=0)
        return z, (tokens >> (BITS * (LEVELS - 1 - level))) & (SIDE - 1), runs

    def log_probabilities(self, around: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Of each token, given the 2 * SPAN around it."""
        order = np.argsort(tokens, kind="stable")
        around, tokens = around[order], tokens[order]
        _, h = self._hidden(around)
        found, at = np.zeros(len(tokens), dtype=np.float32), np.arange(len(tokens))
        for level in range(LEVELS):
            z, branch, _ = self._branches(h, tokens, level)
            found += z[branch, at]
            found -= np.log(np.exp(z, out=z).sum(axis=0))
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradients(self, around: np.ndarray, tokens: np.ndarray) -> dict[str, tuple[np.ndarray | slice, np.ndarray]]:
        """By name the rows concerned and the gradient of the mean of minus the log-probability."""
        w, out = self.weights, {}
        order = np.argsort(tokens, kind="stable")
        around, tokens = around[order], tokens[order]
        x, h = self._hidden(around)
        to_h, some, at = _columns(HIDDEN + 1, len(tokens), h.dtype), _columns(HIDDEN + 1, len(tokens), h.dtype), np.arange(len(tokens))
        for level in range(LEVELS):
            z, branch, runs = self._branches(h, tokens, level)
            tree = w[f"tree{level}"]
            np.exp(z, out=z)
            z /= z.sum(axis=0)
            z[branch, at] -= 1
            z *= z.dtype.type(1 / len(tokens))
            grad = np.empty((len(runs), SIDE, HIDDEN + 1), dtype=z.dtype)
            into, turned, by_row = some if level else to_h, tree.transpose(0, 2, 1), h.T
            for mine, (n, a, b) in zip(grad, runs, strict=True):
                part = z[:, a:b]
                np.matmul(turned[n], part, into[:, a:b])
                np.matmul(part, by_row[a:b], mine)
            if level:
                to_h += some
            out[f"tree{level}"] = np.array([n for n, _, _ in runs]), grad
        to_sum = to_h[:HIDDEN] * (1 - h[:HIDDEN] * h[:HIDDEN])
        to_x = (to_sum.T @ w["mix"].T).reshape(-1, WIDTH)
        out["mix"], out["shift"] = (slice(None), x.T @ to_sum.T), (slice(None), to_sum.sum(axis=1))
        order = np.argsort(around, axis=None, kind="stable")
        ids = around.ravel()[order]
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        out["embed"] = ids[first], np.add.reduceat(to_x.take(order, axis=0), first)
        return out

    def step(self, around: np.ndarray, tokens: np.ndarray, rate: float = RATE) -> None:
        """One AdaGrad step on a batch."""
        for name, (at, grad) in self.gradients(around, tokens).items():
            squares = self.weights[f"{name}_squares"]
            square = grad * grad
            found = squares[at] + (square.mean(axis=1, keepdims=True) if name == "embed" else square)
            squares[at] = found
            grad *= grad.dtype.type(rate)
            grad /= np.sqrt(found, out=found)
            self.weights[name][at] -= grad


def windows(ids: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """For each token, or those at the given places, the SPAN ids before and the SPAN after it."""
    padded = np.concatenate((np.full(SPAN, _EDGE, dtype=ids.dtype), ids, np.full(SPAN, _EDGE, dtype=ids.dtype)))
    steps = [d for d in range(-SPAN, SPAN + 1) if d]
    if at is not None:
        return np.stack([padded[at + (SPAN + d)] for d in steps], axis=1)
    return np.stack([padded[SPAN + d : SPAN + d + len(ids)] for d in steps], axis=1)


def masked(n: int, seed: int, turn: int, rounds: int) -> np.ndarray:
    """The positions below n that training masks in a round; each is masked in one of the rounds."""
    at = np.arange(n, dtype=np.uint64) + np.uint64(seed & 0xFFFFFFFF)
    mixed = (at * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return np.flatnonzero(mixed % np.uint64(rounds) == turn)


def examples(keys: list[int], ids: list[bytes], turn: int, rounds: int) -> Iterator[np.ndarray]:
    """Rows of a masked token and the ids around it, those of many texts together (see windows)."""
    edge, steps = np.full(SPAN, _EDGE, dtype="<i2").tobytes(), [0, *(d for d in range(-SPAN, SPAN + 1) if d)]
    held, n = [], 0
    for key, text in zip(keys, ids, strict=True):
        held.append((key, text))
        n += len(text) // 2
        if n >= _TOGETHER * rounds:
            yield from _rows_of(held, edge, steps, turn, rounds)
            held, n = [], 0
    if n:
        yield from _rows_of(held, edge, steps, turn, rounds)


def _rows_of(texts: list[tuple[int, bytes]], edge: bytes, steps: list[int], turn: int, rounds: int) -> Iterator[np.ndarray]:
    # the texts lie in one array with edges between them, so that each step around the masked tokens is read at once
    padded = np.frombuffer(edge + b"".join(t + edge for _, t in texts), dtype="<i2")
    at, start = [], SPAN
    for key, text in texts:
        at.append(masked(len(text) // 2, key, turn, rounds) + start)
        start += len(text) // 2 + SPAN
    at = np.concatenate(at)
    for i in range(0, len(at), 2 * _TOGETHER):
        yield np.stack([padded[at[i : i + 2 * _TOGETHER] + d] for d in steps], axis=1)


class _Known(dict):
    """Ids by word; a word that is missing gets its hashed id."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = VOCABULARY - OTHERS + xxhash.xxh64_intdigest(word, 3) % OTHERS
        return found


class Ids:
    """Ids of words, kept in a bounded dictionary."""

    def __init__(self, words: list[bytes]) -> None:
        self.own = {w: i for i, w in enumerate(words)}
        self.known = _Known(self.own)

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.split()
        if len(self.known) > _CACHE:
            self.known = _Known(self.own)
        return np.fromiter(map(self.known.__getitem__, words), dtype="<i2", count=len(words))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column("_text").cast(pa.binary()):
            counts.update(text.as_py().split())
            if len(counts) > _CACHE:
                yield flush()
    yield flush()


def vocabulary(docs: DataFrame) -> list[bytes]:
    """The most frequent words of all documents, as many as have ids of their own, the most frequent first.

    Words that occur once are most of all and rarely in; of the others a small table of counts by powers of two says
    from which power on there are enough, so that the driver gets no top list of every partition.
    """
    most = VOCABULARY - OTHERS
    counts = docs.select(text_of().alias("_text")).mapInArrow(_word_counts, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    again = staged(counts.where("n > 1"), "lm-words")
    powers = sorted(((r["power"], r["words"]) for r in again.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    enough = [power for i, (power, _) in enumerate(powers) if sum(n for _, n in powers[: i + 1]) >= most]
    some = again.where(F.floor(F.log2("n")) >= enough[0]) if enough else counts
    return [bytes(r["word"]) for r in some.orderBy(F.desc("n"), "word").limit(most).collect()]


def dealt(tokens: DataFrame, parts: int) -> DataFrame:
    """key, doc_id and ids in as many partitions, by text and id, so that copies of one text are spread."""
    return tokens.select("key", "doc_id", "ids").repartition(parts, F.xxhash64("key", "doc_id")).sortWithinPartitions("key", "doc_id")


def _packed(values: np.ndarray) -> bytes:
    """Numbers as bfloat16: the upper half of a float32, rounded."""
    bits = values.astype(np.float32).view(np.uint32)
    return ((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16).astype("<u2").tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return (np.frombuffer(packed, dtype="<u2").astype(np.uint32) << 16).view(np.float32)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of the rows of each slice, weighted by what they have seen; the slices of one set of weights at most are held."""
    sums: dict[int, tuple[np.ndarray, int]] = {}
    for batch in batches:
        for k, delta, seen in zip(batch.column("slice").to_pylist(), batch.column("delta"), batch.column("seen").to_pylist(), strict=True):
            mine, n = sums.get(k, (0.0, 0))
            sums[k] = mine + _unpacked(delta.as_py()).astype(np.float64) * seen, n + seen
    yield _slices({k: (total / n, n) for k, (total, n) in sums.items()}, 0)


def _slices(means: dict[int, tuple[np.ndarray, int]], part: int) -> pa.RecordBatch:
    columns = [pa.array(list(means), pa.int32()), pa.array([_packed(d) for d, _ in means.values()], pa.binary()), pa.array([n for _, n in means.values()], pa.int64()), pa.array([part] * len(means), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["slice", "delta", "seen", "part"])


def train(tokens: DataFrame, rounds: int = ROUNDS, rate: float = RATE, part_bytes: int = PART_BYTES) -> Network:
    """Averaged descent over all of tokens (see tokenized); part_bytes: text for one copy of the weights."""
    sc = tokens.sparkSession.sparkContext
    size = tokens.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(2, -(-size // part_bytes))
    net = Network.fresh()
    schema = "slice int, delta binary, seen bigint, part bigint"
    for turn in range(rounds):
        start = sc.broadcast(net.flat())

        def run(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            mine, seen, first = Network.of(start.value), 0, 0
            for batch in batches:
                first = first or (batch.column("key")[0].as_py() if batch.num_rows else 0)
                for data in examples(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), turn, rounds):
                    data = data[np.random.default_rng(turn).permutation(len(data))]
                    for at in range(0, len(data), BATCH):
                        mine.step(data[at : at + BATCH, 1:], data[at : at + BATCH, 0], rate)
                    seen += len(data)
            if seen:
                delta = mine.flat() - start.value
                yield _slices({at // _SLICE: (delta[at : at + _SLICE], seen) for at in range(0, len(delta), _SLICE)}, first)

        deltas = dealt(tokens.where("octet_length(ids) > 0"), parts).select("key", "ids").mapInArrow(run, schema)
        # first in groups of parts, so that a slice of very many parts is no single task's work
        some = deltas.repartition("slice", F.pmod("part", F.lit(_GROUPS))).mapInArrow(_added, schema)
        moved = some.repartition("slice").mapInArrow(_added, schema).toArrow()
        start.unpersist()
        flat = net.flat()
        for k, delta in zip(moved.column("slice").to_pylist(), moved.column("delta").to_pylist(), strict=True):
            flat[k * _SLICE : (k + 1) * _SLICE] += _unpacked(delta)
        net = Network.of(flat)
    return net


def tokenized(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """doc_id, key, n_bytes and ids (int16) of every row."""
    shared_words = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(shared_words.value)
        for batch in batches:
            keys, sizes, whole = [], [], []
            for text in batch.column("_text").cast(pa.binary()):
                text = text.as_py()
                keys.append(xxhash.xxh64_intdigest(text, 5) >> 1)
                sizes.append(len(text))
                whole.append(ids(text).tobytes())
            columns = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(whole, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "key", "n_bytes", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("_text"))
    return rows.mapInArrow(run, "doc_id bigint, key bigint, n_bytes bigint, ids binary")


def score(tokens: DataFrame, net: Network) -> DataFrame:
    """Per row: doc_id, n_tokens, score (summed log-probability), mean_score (by token; null without tokens)."""
    shared = tokens.sparkSession.sparkContext.broadcast(net.flat())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Network.of(shared.value)
        for batch in batches:
            sizes, sums = [], []
            found: list[np.ndarray] = []

            def flush(found=found, sizes=sizes, sums=sums) -> None:
                if found:
                    around, ids = np.concatenate([windows(f) for f in found]), np.concatenate(found)
                    got = np.concatenate([mine.log_probabilities(around[i : i + BATCH], ids[i : i + BATCH]) for i in range(0, len(ids), BATCH)]) if len(ids) else np.zeros(0, dtype=np.float32)
                    at = 0
                    for f in found:
                        sums.append(float(got[at : at + len(f)].sum(dtype=np.float64)))
                        sizes.append(len(f))
                        at += len(f)
                    found.clear()

            held = 0
            for ids in batch.column("ids"):
                found.append(np.frombuffer(ids.as_py(), dtype="<i2"))
                held += len(found[-1])
                if held > 50_000:
                    flush()
                    held = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())], names=["doc_id", "n_tokens", "score"])

    rows = tokens.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, n_tokens bigint, score double")
    return rows.withColumn("mean_score", F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens")))


def pseudo_likelihood(docs: DataFrame, **settings) -> DataFrame:
    """Trains on docs (doc_id, text) and scores them. Texts are read once for the vocabulary and once for ids, which are kept."""
    tokens = staged(tokenized(docs, vocabulary(docs)), "lm-tokens")
    return score(tokens, train(tokens, **settings))
