"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

A bin takes at most one document of each source and of each duplicate cluster; it carries both as bitmaps. Documents
go in by falling size. The open bins lie ordered by residual space; the search starts at the successor of the size,
the tightest bin that has room, and goes on to the next until one is compatible; without one a bin is opened.

Rows are dealt to shards by the hash of their id and cluster, about `shard_rows` rows each, and every shard is packed in one
task, so the work of a task is bounded and a hot source or cluster is in all shards alike. Only sizes travel, no texts.

Defined cases: a text longer than a bin is cut into pieces; all but the last fill a bin each (piece numbers from 0,
`start` in words) and nothing is dropped; texts without words take no room and get one row with piece 0, length 0 and
no bin (null); null sources and null clusters conflict with nothing; ties go by id, then cluster, then size; repeated
rows are packed as rows of their own; an empty table gives an empty result; columns beside those named are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, text_of

CAPACITY = 2048
SHARD_ROWS = 2048
SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, shard bigint, bin bigint, position int, offset bigint"


@dataclass
class Bins:
    """Open bins ordered by (residual, number), with their bitmaps."""

    capacity: int
    order: list[tuple[int, int]] = field(default_factory=list)
    sources: list[int] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    filled: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int, int]:
        """Bin, position and offset for an item; source and cluster are bits, or 0."""
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            number = self.order[at][1]
            if not (self.sources[number] & source or self.clusters[number] & cluster):
                break
            at += 1
        if at < len(self.order):
            residual, number = self.order.pop(at)
        else:
            residual, number = self.capacity, len(self.sources)
            for column in (self.sources, self.clusters, self.filled, self.count):
                column.append(0)
        self.sources[number] |= source
        self.clusters[number] |= cluster
        spot = number, self.count[number], self.filled[number]
        self.count[number] += 1
        self.filled[number] += size
        if residual > size:
            insort(self.order, (residual - size, number))
        return spot


def pack_rows(rows: list[tuple], capacity: int = CAPACITY) -> list[tuple]:
    """Packs (doc_id, size, source, cluster) rows. Gives (doc_id, piece, start, length, bin, position, offset)."""
    source_bit = {s: 1 << i for i, s in enumerate(sorted({r[2] for r in rows if r[2] is not None}))}
    several = sorted(c for c, n in Counter(r[3] for r in rows if r[3] is not None).items() if n > 1)
    cluster_bit = {c: 1 << i for i, c in enumerate(several)}  # a cluster's only row can't conflict
    items = []
    out: list[tuple] = []
    for doc_id, size, source, cluster in rows:
        whole = max(0, size - 1) // capacity
        key = (doc_id is not None, doc_id or 0, cluster or "", size)
        items += [(-capacity, key, k, doc_id, source, cluster) for k in range(whole)]
        items.append((whole * capacity - size, key, whole, doc_id, source, cluster))
    bins = Bins(capacity)
    for less, _, piece, doc_id, source, cluster in sorted(items, key=lambda x: x[:3]):
        if less == 0:
            out.append((doc_id, piece, 0, 0, None, None, None))
        else:
            number, position, offset = bins.place(-less, source_bit.get(source, 0), cluster_bit.get(cluster, 0))
            out.append((doc_id, piece, piece * capacity, -less, number, position, offset))
    return out


def text_cluster(text_col: str = "text") -> Column:
    """A cluster for each distinct text, white space aside."""
    return F.md5(F.regexp_replace(text_of(text_col), SPACE + "+", ""))


def pack(docs: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Packs docs (doc_id, text, source). cluster: what copies share, by default the text. Gives SCHEMA; a bin is (shard, bin)."""
    shards = max(1, -(-docs.count() // shard_rows))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.regexp_count(text_of(), F.lit(WORD)).cast("bigint").alias("size"), F.col("source").cast("string").alias("source"), (text_cluster() if cluster is None else cluster).cast("string").alias("cluster"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        given = [(None if pd.isna(d) else int(d), int(n), s if isinstance(s, str) else None, c if isinstance(c, str) else None) for d, n, s, c in zip(pdf["doc_id"].astype("Int64"), pdf["size"], pdf["source"], pdf["cluster"], strict=True)]
        made = pd.DataFrame(pack_rows(given, capacity), columns=["doc_id", "piece", "start", "length", "bin", "position", "offset"], dtype=object)
        return made.assign(shard=int(key[0]))[["doc_id", "piece", "start", "length", "shard", "bin", "position", "offset"]].astype({"doc_id": "Int64", "piece": "int32", "start": "int64", "length": "int64", "bin": "Int64", "position": "Int32", "offset": "Int64"})

    return rows.groupBy("shard").applyInPandas(run, SCHEMA)


def assemble(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """The texts of bins: shard, bin, doc_ids, text (pieces joined by an empty line, words of a piece by one space).

    Rows of docs that share an id are matched by size.
    """
    words = F.regexp_extract_all(text_of(), F.lit(f"({WORD})"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_id"), words.alias("_words"))
    texts = texts.withColumn("_n", F.row_number().over(Window.partitionBy("_id").orderBy(F.size("_words"))))
    parts = packed.where("bin IS NOT NULL")
    sizes = Window.partitionBy("doc_id", "piece").orderBy("length", "shard", "bin")
    last = Window.partitionBy("doc_id")
    parts = parts.withColumn("_of", F.row_number().over(sizes)).withColumn("_rows", F.max("_of").over(last))
    pieces = parts.join(texts, parts["doc_id"].eqNullSafe(texts["_id"]) & (parts["_of"] == texts["_n"]))
    pieces = pieces.withColumn("_text", F.array_join(F.expr("slice(_words, CAST(start AS INT) + 1, CAST(length AS INT))"), " "))
    bins = pieces.groupBy("shard", "bin").agg(F.sort_array(F.collect_list(F.struct("position", "doc_id", "_text"))).alias("_parts"))
    return bins.select("shard", "bin", F.col("_parts.doc_id").alias("doc_ids"), F.array_join(F.col("_parts._text"), "\n\n").alias("text"))
