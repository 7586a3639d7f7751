"""Supervised subword embeddings: averaged vectors of hashed words and character n-grams under a softmax.

A word (A-Z lower-cased) gives its own hashed feature and those of the character n-grams of <word>. A document's vector is the mean
of the features' vectors of its different words, with NEUTRAL zero vectors among them so that a few words don't
decide alone; a linear softmax over it gives the class. (Repeats are left out: one line repeated a thousand times
would otherwise drown the rest.) Vectors and softmax are trained
together in numpy by stochastic gradient descent, one document a step, with AdaGrad step sizes.

As the softmax is linear, a trained model scores a document from one number a word: the sum over the word's features
of vector times class difference. Workers keep those numbers in a bounded dictionary and compute missing ones for a
whole batch at once.

Defined cases: null and empty texts and texts of white space only say nothing by words; they all score the share of
class 1 among such texts of the sample, smoothed with two texts at the share among all labels. Equal texts have equal
scores; labels of ids without a document and null labels are left out, of several labels of one id the greatest holds;
of several rows of one id the sample has the text of the least hash; where training saw one class every score is the
smoothed share of class 1; an empty table gives an empty result; further columns are not read.

Training sees a bounded sample: for each class the `per_class` labelled documents of the least hashed id, whole texts.
It runs in one task of an executor, which can be run again anywhere and gives the same model; the driver gets the
weights, one number a feature. It takes `steps` steps whatever the size of the sample. Scores cover whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import astuple, dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

GRAMS = (3, 4, 5)
BUCKETS = 1 << 18
#: Zero vectors in each document's mean.
NEUTRAL = 150
_CACHE = 400_000
_TOGETHER = 256
_PART = 20_000
#: Words of a document from which its features are summed in parts.
_LONG = 5_000
_MUL = np.uint32(0x9E3779B1)
#: The token read for a word that repeats the one before.
REPEAT = b"\x00="


def _loose(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of all words, in no order, and the word that each belongs to."""
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), dtype=np.uint8).astype(np.uint32)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    ends = np.cumsum(sizes).astype(np.int32)[owner]
    ids = [np.array([xxhash.xxh64_intdigest(w, 1) % buckets for w in words], dtype=np.int64)]
    owners = [np.arange(len(words), dtype=np.int32)]
    for n in GRAMS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        inside = np.flatnonzero(np.arange(m, dtype=np.int32) + n <= ends[:m])
        h = np.full(len(inside), n, dtype=np.uint32)
        for k in range(n):
            h = (h ^ data[inside + k]) * _MUL
            h ^= h >> np.uint32(15)
        ids.append((h % np.uint32(buckets)).astype(np.int64))
        owners.append(owner[inside])
    return np.concatenate(ids), np.concatenate(owners)


def features(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of all words, one word after another, and how many each word has. Each word has one at least."""
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    ids, where = _loose(words, buckets)
    return ids[np.argsort(where, kind="stable")], np.bincount(where, minlength=len(words))


def tokens(text: bytes) -> tuple[set[bytes], int]:
    """The different words of a text, A-Z lower-cased, and how many of its words repeat the one before."""
    words = text.lower().split()
    return set(words), sum(map(eq, words, islice(words, 1, None)))


@dataclass
class SubwordModel:
    """weight: for each feature its vector times the difference of the class rows; bias of the logit; blank: the score of texts without words."""

    weight: np.ndarray
    bias: float
    blank: float

    def word_values(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each word the sum of its features' weights, and their number."""
        ids, where = _loose(words, len(self.weight))
        return np.bincount(where, weights=self.weight[ids], minlength=len(words)), np.bincount(where, minlength=len(words))

    def scorer(self):
        """A function from UTF-8 texts to probabilities of class 1."""
        value: dict[bytes, float] = {}
        number: dict[bytes, int] = {}
        (again,), (parts,) = (x.tolist() for x in self.word_values([REPEAT]))

        def some(texts: list[bytes]) -> list[float]:
            sets, repeats = zip(*map(tokens, texts), strict=True)
            fresh = [w for w in set().union(*sets) if w not in value]
            if len(value) + len(fresh) > _CACHE:
                value.clear()
                number.clear()
                fresh = list(set().union(*sets))
            for at in range(0, len(fresh), 50_000):
                part = fresh[at : at + 50_000]
                sums, counts = self.word_values(part)
                value.update(zip(part, sums.tolist()))
                number.update(zip(part, counts.tolist()))
            # sorted: a sum of floats must not depend on the order of a set
            return [(sum(sorted(map(value.__getitem__, words))) + n * again) / (NEUTRAL + sum(map(number.__getitem__, words)) + n * parts) if words else np.nan for words, n in zip(sets, repeats)]

        def score(texts: Iterable[bytes]) -> np.ndarray:
            texts, out = iter(texts), []
            while part := list(islice(texts, _TOGETHER)):
                out += some(part)
            logit = np.array(out, dtype=np.float64)
            found = 1 / (1 + np.exp(-np.clip(logit + self.bias, -500, 500)))
            return np.where(np.isnan(logit), self.blank, found)

        return score


def _document(at: np.ndarray, times: np.ndarray, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of a document's words (places in starts and counts) and their shares of the mean."""
    n = counts[at]
    flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[at], n)
    if len(at) < _LONG:
        uniq, back = np.unique(ids[flat], return_inverse=True)
        return uniq.astype(np.int32), np.bincount(back, weights=np.repeat(times, n), minlength=len(uniq))
    found = np.bincount(ids[flat], weights=np.repeat(times, n), minlength=buckets)
    uniq = np.flatnonzero(found)
    return uniq.astype(np.int32), found[uniq]


def train(bags: Iterable[tuple[Iterable[bytes], int]], labels: Sequence[int], prior: float, buckets: int = BUCKETS, dim: int = 8, steps: int = 20_000, rate: float = 0.1, scale: float = 50.0, decay: float = 1e-6, seed: int = 7) -> SubwordModel:
    """Fits the model. bags: the tokens of each text; labels: 0 or 1 for each, read after the bags; prior: share of class 1 among all labelled rows.

    The scores hold for classes that are equally frequent, so that the rare class is found as well as the other.
    With one class or none in the sample every score is the prior.
    """
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    # words become numbers as they come, and features are made a part at a time: few texts are held at once
    spot: dict[bytes, int] = {REPEAT: 0}
    held = [(np.fromiter((spot.setdefault(w, len(spot)) for w in b), dtype=np.int32), repeats) for b, repeats in bags]
    labels = np.array(labels, dtype=np.int64)
    blanks = labels[[not len(b) for b, _ in held]] if held else labels
    blank = (int(blanks.sum()) + 2 * prior) / (len(blanks) + 2)
    if len(set(labels.tolist())) < 2:
        return SubwordModel(np.zeros(buckets, dtype=np.float32), float(np.log(prior / (1 - prior))), blank)
    rng = np.random.default_rng(seed)
    words = list(spot)
    del spot
    parts = [features(words[at : at + _PART], buckets) for at in range(0, len(words), _PART)]
    ids, counts = np.concatenate([i.astype(np.int32) for i, _ in parts]), np.concatenate([c for _, c in parts])
    del words, parts
    starts = np.cumsum(counts) - counts
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    for b, repeats in held:
        at, times = (np.append(b, 0), np.append(np.ones(len(b)), repeats)) if repeats else (b, np.ones(len(b)))
        uniq = np.zeros(0, dtype=np.int32)
        if len(at):
            pieces = [_document(at[i : i + _PART], times[i : i + _PART], ids, starts, counts, buckets) for i in range(0, len(at), _PART)]
            uniq, part = pieces[0]
            if len(pieces) > 1:
                whole = sum(np.bincount(u, weights=p, minlength=buckets) for u, p in pieces)
                uniq = np.flatnonzero(whole).astype(np.int32)
                part = whole[uniq]
        docs.append((uniq, (part / (NEUTRAL + part.sum())).astype(np.float32)) if len(uniq) else (uniq, np.zeros(0, dtype=np.float32)))
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    vectors_sq = np.full((buckets, 1), 1e-6, dtype=np.float32)
    rows = rng.uniform(-1, 1, (2, dim)).astype(np.float32)
    rows_sq = np.full((2, dim), 1e-6, dtype=np.float32)
    share = float(labels.mean())
    bias = np.log(np.array([1 - share, share], dtype=np.float32))
    touched = np.zeros(buckets, dtype=bool)
    done = 0
    while done < steps:
        for i in rng.permutation(len(docs))[: steps - done]:
            at, part = docs[i]
            step = rate * (1 - done / steps)
            done += 1
            if not len(at):
                continue
            vec = vectors[at]
            mean = scale * (part @ vec)
            logit = rows @ mean + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1
            to_vec = scale * (p @ rows)
            grad = part[:, None] * to_vec[None, :] + decay * vec
            square = vectors_sq[at] + (grad * grad).mean(axis=1, keepdims=True)
            vectors_sq[at] = square
            vectors[at] = vec - step * grad / np.sqrt(square)
            to_rows = p[:, None] * mean[None, :]
            rows_sq += to_rows * to_rows
            rows -= step * to_rows / np.sqrt(rows_sq)
            touched[at] = True
    weight = scale * (vectors @ (rows[1] - rows[0]))
    weight[~touched] = 0  # features that training never met say nothing
    return SubwordModel(weight.astype(np.float32), 0.0, blank)


def labelled(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id and _label (0 or 1) of the rows to learn from: crc32(doc_id as text) mod 5 is not 0; null labels are left out."""
    rows = labels.select(F.col(id_col).cast("bigint").alias("_id"), F.col(label).cast("int").alias("_label")).where("_id IS NOT NULL AND _label IN (0, 1)")
    return rows.where(~held_out("_id")).groupBy("_id").agg(F.max("_label").alias("_label"))


def held_out(id_col: str):
    """Whether a row is kept from training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str, per_class: int = 2000, **settings) -> SubwordModel:
    """Trains on a bounded sample of the labelled documents; labels of learning rows only."""
    known = labelled(labels, label).join(docs.select(F.col("doc_id").cast("bigint").alias("_id")).distinct(), "_id", "left_semi")
    shares = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = None
    for c in (0, 1):
        part = known.where(F.col("_label") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        some = part if some is None else some.unionByName(part)
    total = sum(shares.values())
    prior = shares.get(1, 0) / total if total else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: list[int] = []

        def bags() -> Iterator[tuple[set[bytes], int]]:
            for batch in batches:
                for text, mark in zip(batch.column("_text").cast(pa.binary()), batch.column("_label").to_pylist(), strict=True):
                    marks.append(mark)
                    yield tokens(text.as_py())

        model = train(bags(), marks, prior, **settings)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias]), pa.array([model.blank])], names=["weight", "bias", "blank"])

    # some has 2 * per_class rows at most, and so have the texts: one for each id
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_id"), text_of().alias("_text")).join(F.broadcast(some), "_id")
    texts = texts.groupBy("_id").agg(F.min_by(F.struct("_text", "_label"), F.xxhash64("_text")).alias("_one")).select("_id", "_one.*")
    made = texts.repartition(1).sortWithinPartitions("_id").mapInArrow(run, "weight binary, bias double, blank double").first()
    if made is None:
        return train([], [], prior, **settings)
    return SubwordModel(np.frombuffer(made["weight"], dtype=np.float32), made["bias"], made["blank"])


def score_documents(docs: DataFrame, model: SubwordModel, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = SubwordModel(*shared.value).scorer()
        for batch in batches:
            texts = (t.as_py() for t in batch.column("_text").cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(texts))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("_text")).mapInArrow(run, "doc_id bigint, score double")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, label: str, threshold: float, **settings) -> DataFrame:
    """Trains on labels and scores every row of docs."""
    return score_documents(docs, fit(docs, labels, label, **settings), threshold)


def accepted(docs: DataFrame, labels: DataFrame, label: str, threshold: float, **settings) -> DataFrame:
    """The rows of docs that score at the threshold or above, with all their columns and in no shuffle."""
    model = fit(docs, labels, label, **settings)
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = SubwordModel(*shared.value).scorer()
        for batch in batches:
            texts = ((t.as_py() or b"") for t in batch.column("text").cast(pa.binary()))
            yield batch.filter(pa.array(score(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
