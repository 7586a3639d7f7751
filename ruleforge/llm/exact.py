"""Exact dedup by 128-bit content hash with byte comparison inside groups.

Texts are compared after white space is deleted. The grouping key is (hash, normalised text), so the engine's own
key comparison checks the bytes and a hash collision can't merge two texts; the hash spreads and orders the rows.
Copies fold on the map side, so a group that holds a third of all rows crosses the shuffle once a task, and no
task gathers a group. Only digests go back to the documents.

Defined cases: a null text is empty; empty texts are equal to one another and to texts of white space only; a null
id ranks behind every other; rows repeated under one id count in group_size, and each row with the kept id is
flagged; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, staged, text_of


def content_hash(text: Column) -> Column:
    """128 bits of a text's bytes."""
    return F.unhex(F.md5(text))


def _keyed(docs: DataFrame, id_col: str, text_col: str, hash_of: Callable[[Column], Column]) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text"))
    rows = rows.select("doc_id", F.char_length("_text").alias("_chars"), F.regexp_replace("_text", SPACE + "+", "").alias("_norm"))
    return rows.select("doc_id", "_chars", "_norm", hash_of(F.col("_norm")).alias("_hash"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per distinct normalised text: _hash, _sha, keep_id, group_size."""
    keyed = _keyed(docs, id_col, text_col, hash_of)
    # one number orders by most characters, then by smallest id; a null id comes last
    rank = F.col("_chars").cast("decimal(10,0)") * F.lit(str(10**20)).cast("decimal(21,0)") - F.coalesce(F.col("doc_id").cast("decimal(19,0)"), F.lit(str(2**63)).cast("decimal(19,0)"))
    texts = keyed.groupBy("_hash", "_norm").agg(F.count(F.lit(1)).alias("group_size"), F.max_by("doc_id", rank).alias("keep_id"))
    texts = texts.select("_hash", F.unhex(F.sha2("_norm", 256)).alias("_sha"), "keep_id", "group_size")
    clash = F.raise_error(F.lit("two texts share both digests"))
    found = texts.groupBy("_hash", "_sha").agg(F.count(F.lit(1)).alias("_texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    return found.withColumn("group_size", F.when(F.col("_texts") == 1, F.col("group_size")).otherwise(clash.cast("bigint"))).drop("_texts")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    rows = _keyed(docs, id_col, text_col, hash_of).select("doc_id", "_hash", F.unhex(F.sha2("_norm", 256)).alias("_sha"))
    # written, so that both sides of the join are plain exchanges, of which Spark splits what a hot text makes large
    joined = rows.join(staged(groups(docs, id_col, text_col, hash_of), "exact-groups"), ["_hash", "_sha"])
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: one row for each distinct text."""
    # the columns of docs travel as one, so that none of theirs can clash with one of ours
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.regexp_replace(text_of(text_col), SPACE + "+", "").alias("_norm"))
    rows = rows.select("_row", "_id", content_hash(F.col("_norm")).alias("_hash"), F.unhex(F.sha2("_norm", 256)).alias("_sha"))
    best = groups(docs, id_col, text_col).select(F.col("_hash").alias("_h"), F.col("_sha").alias("_s"), F.col("keep_id").alias("_keep"))
    kept = rows.join(best, (rows["_hash"] == best["_h"]) & (rows["_sha"] == best["_s"]) & rows["_id"].eqNullSafe(best["_keep"]))
    return kept.dropDuplicates(["_hash", "_sha"]).select("_row.*")


ORACLE = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_max(doc_id, chars::HUGEINT * 100000000000000000000 - doc_id) AS keep_id FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g USING (norm)
"""
