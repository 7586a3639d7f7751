"""SimHash near-duplicates: fingerprints linked at a Hamming distance of 4 or less through Golay-code keys.

A fingerprint's 64 bits make three segments of 22, 21 and 21 bits. Of four differing bits at most two fall into some
pair of segments: one in each, or none in one and two in the other. So a pair of segments gives three kinds of keys:
both segments' nearest codewords (looked up with all keys of both segments: one differing bit in each), and one
segment as it is with the other's keys (no bit in one, two in the other), either way round. Equal keys are joined
and every candidate is verified; each pair within distance 4 meets under one key at least.

Documents fold to distinct fingerprints first. Near copies in thousands would meet in all pairs, so a first round
links fingerprints to a few hubs under the nearest-codeword keys; the full round then only compares fingerprints from
different components of the first. Where a component has HOT rows or more under a key, its rows lie on a side of
their own that the component's own queries don't read: rows under a hot key meet those of other components only.
Links found are a spanning set: components are exact, nothing is capped. Tables that grow with the corpus are merged,
never broadcast, since the driver would hold them: Spark's estimate of a table's bytes knows nothing of the keys that
a fingerprint has.

Defined cases: null texts are empty; a text without words has fingerprint 0, linked like any other; one to three
words make one shingle; a null id has no part in the least id (component_id is null if there is no other); repeated
rows give repeated rows; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .common import beside, staged, text_of
from .graph import components

SHINGLE = 4
DISTANCE = 4
_SEGMENTS = ((0, 22), (22, 21), (43, 21))
_PAIRS = ((0, 1), (0, 2), (1, 2))
#: Rows of one component under one key from which they get a side of their own.
HOT = 64
_PIECE = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a UTF-8 text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist() if len(words) >= shingle else [len(line)]
    hashed = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, dtype=np.int64), len(stops)
    for at in range(0, n, _PIECE):
        h = np.array([hashed(line[a:b], 42) for a, b in zip(starts[at : at + _PIECE], stops[at : at + _PIECE])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("_text").cast(pa.binary())
        prints = np.fromiter((fingerprint(t.as_py()) for t in texts), dtype="<u8", count=len(texts)).view("<i8")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints), batch.column("told")], names=["doc_id", "fp", "told"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit number) and told, which tells texts of one id and fingerprint apart."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("_text"), F.xxhash64(text_of(text_col)).alias("told"))
    return rows.mapInArrow(_fingerprints, "doc_id bigint, fp bigint, told bigint")


def _parts(fp: np.ndarray) -> list[np.ndarray]:
    bits = fp.view(np.uint64)
    return [((bits >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in _SEGMENTS]


def _rows(fp: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and, for each, the place of its fingerprint. kind: 'near' (nearest codewords), 'index' or 'query' side of the full join."""
    parts = _parts(fp)
    names, counts = zip(*(golay.keys(p) for p in parts), strict=True)
    held = [np.arange(6)[None, :] < c[:, None] for c in counts]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    place = np.arange(len(fp))

    def put(tag: int, keys: np.ndarray, valid: np.ndarray | None = None) -> None:
        keys = keys.reshape(len(fp), -1) | (tag << 44)
        where = np.broadcast_to(place[:, None], keys.shape)
        out.append((keys.ravel(), where.ravel()) if valid is None else (keys[valid.reshape(keys.shape)], where[valid.reshape(keys.shape)]))

    for n, (a, b) in enumerate(_PAIRS):
        if kind == "query":
            put(n * 3, names[a][:, :, None] << 12 | names[b][:, None, :], held[a][:, :, None] & held[b][:, None, :])
        else:
            put(n * 3, names[a][:, 0] << 12 | names[b][:, 0])
        if kind != "near":
            put(n * 3 + 1, parts[a][:, None] << 12 | names[b], held[b])
            put(n * 3 + 2, parts[b][:, None] << 12 | names[a], held[a])
    return np.concatenate([k for k, _ in out]), np.concatenate([w for _, w in out])


def _keyed(prints: DataFrame, kind: str) -> DataFrame:
    """key, fp, comp: a row for each key of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, comps = batch.column("fp").to_numpy(), batch.column("comp").to_numpy()
            for at in range(0, len(fps), 2000):
                fp, comp = fps[at : at + 2000], comps[at : at + 2000]
                keys, where = _rows(fp, kind)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[where]), pa.array(comp[where])], names=["key", "fp", "comp"])

    return prints.select("fp", "comp").mapInArrow(run, "key bigint, fp bigint, comp bigint")


def _labelled(prints: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """prints with comp replaced by the component that edges between comps make."""
    found = components(edges, name)
    joined = prints.withColumnRenamed("comp", "_was").join(found.hint("merge"), F.col("_was") == F.col("node"), "left")
    return staged(joined.withColumn("comp", F.coalesce("component", "_was")).drop("_was", "node", "component"), name)


def link_fingerprints(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """prints (distinct fp, further columns) with comp, the same for all fingerprints that links connect. distance: 4 at most."""
    if not 0 <= distance <= 4:
        raise ValueError("the keys hold for distances up to 4")
    close = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= distance
    prints = prints.withColumn("comp", F.col("fp"))
    near = _keyed(prints, "near")
    hubs = near.groupBy("key").agg(F.array_distinct(F.array(F.min("fp"), F.max("fp"), F.min_by("fp", F.xxhash64("fp")), F.max_by("fp", F.xxhash64("fp")))).alias("hubs"))
    hubs = hubs.where("size(hubs) > 1").select("key", F.explode("hubs").alias("fp"))
    first = near.alias("l").join(hubs.alias("r").hint("merge"), (F.col("l.key") == F.col("r.key")) & close & (F.col("l.fp") != F.col("r.fp")))
    prints = _labelled(prints, first.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")), "simhash-hubs")
    homes = beside(_homes(prints))
    left, right = _sided(_keyed(prints, "index"), homes, False).alias("l"), _sided(_keyed(prints, "query"), homes, True).alias("r")
    full = left.join(right.hint("merge"), (F.col("l.key") == F.col("r.key")) & (F.col("l.comp") != F.col("r.comp")) & close)
    return _labelled(prints, full.select(F.col("l.comp").alias("a"), F.col("r.comp").alias("b")), "simhash-links")


def _homes(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """key, home: for each key under which a component has `hot` index rows or more, the component with most."""
    large = prints.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hot).select("comp")
    held = _keyed(prints.join(beside(staged(large, "simhash-large")), "comp", "left_semi"), "index").groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hot)
    return staged(held.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("home")), "simhash-homes")


def _sided(rows: DataFrame, homes: DataFrame, query: bool) -> DataFrame:
    """rows with the key's side in the key: index rows of a home are on side 1, others on side 0; queries read side 0, and those from elsewhere side 1 of keys with a home."""
    rows = rows.join(homes, "key", "left")
    own = F.col("comp") == F.col("home")
    side = F.explode(F.when(own | F.col("home").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))) if query else F.when(own, 1).otherwise(0)
    return rows.select("key", "fp", "comp", side.alias("side")).select((F.col("key") * 2 + F.col("side")).alias("key"), "fp", "comp")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp, told), staged, and for each fingerprint (_fp) its comp and component_id, staged."""
    rows = staged(fingerprints(docs, id_col, text_col), "simhash-rows")
    prints = link_fingerprints(staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-prints"))
    # written, so that both sides of the join are plain exchanges, of which Spark splits what a large group makes hot
    least = staged(prints.groupBy("comp").agg(F.min("first").alias("component_id")), "simhash-least")
    return rows, staged(prints.join(least.hint("merge"), "comp").select(F.col("fp").alias("_fp"), "comp", "component_id"), "simhash-table")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (least doc_id that links reach)."""
    rows, table = _grouped(docs, id_col, text_col)
    return rows.join(table.hint("merge"), rows["fp"] == table["_fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the least id, a null id being the last.

    Of several rows of a group with that id one stays, that of the least (fingerprint, text hash).
    """
    rows, table = _grouped(docs, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "told")
    best = rows.join(table.hint("merge"), rows["fp"] == table["_fp"]).groupBy("comp").agg(F.min(order).alias("best"))
    stay = best.select(F.col("best.doc_id").alias("_id"), F.col("best.told").alias("_told"))
    # the columns of docs travel as one, so that none of theirs can clash with one of ours
    told = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("bigint").alias("_own"), F.xxhash64(text_of(text_col)).alias("_mine"))
    kept = told.join(stay.hint("merge"), told["_own"].eqNullSafe(stay["_id"]) & (told["_mine"] == stay["_told"]))
    return kept.dropDuplicates(["_id", "_told"]).select("_row.*")
