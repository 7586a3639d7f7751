"""Media columns: texts stored as 8-bit PCM sound in a chunk store, rebuilt from ordered chunk lists and verified.

A payload (UTF-8, padded with spaces to a positive multiple of 192 bytes) becomes the samples of a mono WAV file. Its
stored form is a header and an ordered list of chunk digests. Chunks end where a rolling gear hash of the last 32
bytes has CUT zero bits, not before LEAST nor after MOST bytes, so an edit moves few cuts. Copies of a text fold to
one medium by hash, copies of a chunk to one stored chunk by digest; a join of lists with the store brings the bytes
back. Media of one chunk are complete there; the chunks of others are dealt by medium, sorted and streamed into files,
of which one at a time is in memory. Every file rebuilt must have the SHA-256 noted when it was cut.

Defined cases: a null text is empty; an empty text is 192 spaces; repeated rows and equal texts share one medium and
have equal values; null ids stay null; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import bz2
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of

UNIT = 192
RATE = 8000
LEAST, MOST, CUT = 1024, 16384, 11
_DIGEST = 16
_HEADER = 44
_TOGETHER = 1 << 22
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
_SEEN = 200_000


def payload(text: bytes) -> bytes:
    """The samples of a text."""
    return text + b" " * (UNIT - len(text) if not text else -len(text) % UNIT)


def wav_header(n: int) -> bytes:
    """The header of a mono 8-bit PCM WAV file of n samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def wav_samples(media: bytes) -> bytes:
    """The samples of such a file; raises ValueError if it isn't one."""
    kind, _, wave, _, _, pcm, channels, _, _, _, bits, data, n = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:_HEADER])
    if (kind, wave, pcm, channels, bits, data, n) != (b"RIFF", b"WAVE", 1, 1, 8, b"data", len(media) - _HEADER):
        raise ValueError("not a mono 8-bit PCM file")
    return media[_HEADER:]


def gear(data: np.ndarray) -> np.ndarray:
    """For each byte the gear hash of the 32 bytes that end there: h = 2 h + table[byte], by doubling the span."""
    h = _GEAR[data]
    for span in (1, 2, 4, 8, 16):
        more = h[:-span] << np.uint32(span)
        h[span:] += more
    return h


def cuts(payloads: list[bytes]) -> list[list[int]]:
    """The ends of the chunks of each payload."""
    data = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    marks = np.flatnonzero(gear(data) >> np.uint32(32 - CUT) == 0) + 1
    out, base = [], 0
    for p in payloads:
        ends, start, n = [], 0, len(p)
        own = marks[np.searchsorted(marks, base) : np.searchsorted(marks, base + n, side="right")] - base
        own = own.tolist()
        k = 0
        while n - start > LEAST:
            while k < len(own) and own[k] < start + LEAST:
                k += 1
            end = min(n, start + MOST, own[k] if k < len(own) else n)
            ends.append(end)
            start = end
        if start < n:
            ends.append(n)
        out.append(ends)
        base += n
    return out


def _chunked(texts: Iterator[bytes]) -> Iterator[tuple[bytes, bytes, list[bytes]]]:
    """Text, payload and chunks, in order; small payloads are hashed together."""
    held: list[tuple[bytes, bytes]] = []
    size = 0

    def flush() -> Iterator[tuple[bytes, bytes, list[bytes]]]:
        for (text, data), ends in zip(held, cuts([p for _, p in held]), strict=True):
            yield text, data, [data[a:b] for a, b in zip([0, *ends], ends)]
        held.clear()

    for text in texts:
        held.append((text, payload(text)))
        size += len(held[-1][1])
        if size > _TOGETHER:
            yield from flush()
            size = 0
    yield from flush()


def digest(chunk: bytes) -> bytes:
    """The name of a chunk in the store."""
    return hashlib.blake2b(chunk, digest_size=_DIGEST).digest()


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, shas, lists = [], [], []
        for text, data, chunks in _chunked(t.as_py() for t in batch.column("_text").cast(pa.binary())):
            sizes.append(len(text))
            shas.append(hashlib.sha256(wav_header(len(data)) + data).digest())
            lists.append(b"".join(map(digest, chunks)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary()), pa.array(lists, pa.binary())], names=["doc_id", "n_bytes", "media", "chunks"])


def _stores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        names, packed, size = [], [], 0
        for _, _, chunks in _chunked(t.as_py() for t in batch.column("_text").cast(pa.binary())):
            for chunk in chunks:
                name = digest(chunk)
                if name not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()  # what is forgotten is found again after the shuffle
                    seen.add(name)
                    names.append(name)
                    packed.append(bz2.compress(chunk))
                    size += len(packed[-1])
            if size > _TOGETHER:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(packed, pa.binary())], names=["digest", "bytes"])
                names, packed, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(packed, pa.binary())], names=["digest", "bytes"])


def feature(samples: bytes) -> str:
    """Whole-number features of samples: peak, sum, energy, zero crossings and an 8-bin histogram."""
    x = np.frombuffer(samples, dtype=np.uint8)
    level = x.astype(np.int32) - 128
    bins = np.bincount(x >> 5, minlength=8)
    return f"max={int(np.abs(level).max())};sum={int(level.sum(dtype=np.int64))};energy={int((level.astype(np.int64) ** 2).sum())};crossings={int(np.count_nonzero((level[1:] < 0) != (level[:-1] < 0)))};hist=" + ",".join(map(str, bins.tolist()))


_READ = "media binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by medium and place -> one row for each medium, from the bytes read back."""
    rows: list[tuple] = []
    now, parts = None, []

    def close() -> None:
        body = b"".join(parts)
        media = wav_header(len(body)) + body
        sha = hashlib.sha256(media).digest()
        if sha != now:
            raise ValueError(f"medium {now.hex()} was rebuilt as {sha.hex()}")
        samples = wav_samples(media)
        rows.append((now, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), sha.hex(), feature(samples)))

    def batch_of() -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _READ.split(", ")])

    for batch in batches:
        for media, packed in zip(batch.column("media"), batch.column("bytes"), strict=True):
            media = media.as_py()
            if media != now:
                if now is not None:
                    close()
                now, parts = media, []
            parts.append(bz2.decompress(packed.as_py()))
        if rows:
            yield batch_of()
    if now is not None:
        close()
        yield batch_of()


def chunk_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, media (SHA-256 of the stored file), chunks (the digests, one after another)."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("_text")).mapInArrow(_lists, "doc_id bigint, n_bytes bigint, media binary, chunks binary")


def chunk_store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every chunk once: digest, bytes (compressed)."""
    return docs.select(text_of(text_col).alias("_text")).mapInArrow(_stores, "digest binary, bytes binary").dropDuplicates(["digest"])


def read_media(lists: DataFrame, store: DataFrame) -> DataFrame:
    """Rebuilds every medium of lists from the store and reads it: one row for each, media first."""
    media = lists.groupBy("media").agg(F.min("chunks").alias("chunks"))
    media = media.withColumn("_n", F.expr(f"octet_length(chunks) div {_DIGEST}"))
    places = media.select("media", "_n", F.posexplode(F.expr(f"transform(sequence(0, _n - 1), i -> substring(chunks, CAST(i * {_DIGEST} + 1 AS INT), {_DIGEST}))")).alias("place", "digest"))
    found = places.join(store, "digest", "left")  # a chunk that is missing must show, as a null
    one = found.where("_n = 1").select("media", "bytes").mapInArrow(_rebuild, _READ)
    more = found.where("_n > 1").select("media", "place", "bytes").repartition("media").sortWithinPartitions("media", "place").select("media", "bytes").mapInArrow(_rebuild, _READ)
    return one.unionByName(more)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as media and reads it back. Per row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    lists = staged(chunk_lists(docs, id_col, text_col), "media-lists")
    read = read_media(lists, chunk_store(docs, text_col))
    return lists.drop("chunks").join(read, "media").drop("media")
