"""Mixing sources to target weights over fixed-length blocks, in DataFrame and SQL functions only.

The words of each source form a stream, cut into blocks of `block` words; a source of fewer than FINE blocks has blocks
of a FINE-th of its words (one word at least), so that small sources meet their targets too. Every output shard draws a multinomial
count for each source, with the block quotas as probabilities; what a source draws beyond its quota goes, in shard
order, to sources below theirs, so the totals are exact. The n-th slot of a source takes block perm(n mod blocks)
of pass n div blocks, where perm is a swap-or-not permutation with a key for each source and pass: no block is
taken more than twice, as quotas stop at two passes. Slots and documents meet in a join by block index.

Only the table of sources (one row a source: the components of the mix) goes to the driver; it is joined as a written
table, which Spark broadcasts only below its size threshold. Stream offsets are
running totals on two levels with about sqrt(rows) buckets, so a hot source is spread over all tasks.

Defined cases: a null text or one without words has size 0 and takes nothing; a null source is a source of its own,
the last; a null doc_id comes first in its bucket, which its text chooses; repeated rows are separate rows with offsets of their own; no
words at all give targets of 0; extra columns are not read. Every run over the same rows agrees.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, running_start, staged, text_of

BLOCK = 128
FINE = 100
SHARD_SLOTS = 1024
ROUNDS = 8
_P = 2147483647


def _mix(x: str, k: str) -> str:
    """SQL for a pseudorandom number below 2^31 - 1 of two non-negative integers; the same in Spark and DuckDB."""
    y = f"((({x}) % {_P} * 48271 + ({k}) % {_P} * 69621 + 12345) % {_P})"
    z = f"({y} * (({y} + 1013904223) % {_P}) % {_P})"
    return f"(({z} * 16807 + {y}) % {_P})"


def _bucket(n: str, div: str) -> str:
    return f"{_mix('abs(coalesce(doc_id, told) % 1000003)', f'abs(coalesce(doc_id, told) {div} 1000003)')} % {n}"


def _draw(i: str, total: str, div: str) -> str:
    return f"(({_mix(i, f'7 + ({i} {div} {_P}) * 7919')} * 2147483648 + {_mix(i, f'8 + ({i} {div} {_P}) * 7919')}) % {total})"


def _key(r: str, n: str, key: str) -> str:
    """The round key of the permutation of n places."""
    return f"{_mix(f'{key} * 64 + {r}', '99')} % {n}"


def _round(acc: str, k: str, n: str, div: str) -> str:
    """One involution of the permutation: acc and k - acc change places if the bit that both share says so."""
    other = f"(({k} - {acc} + {n}) % {n})"
    bit = f"(({_mix(f'greatest({acc}, {other})', f'{k} * 7919 + {n}')} {div} 4096) % 2)"
    return f"CASE WHEN {bit} = 1 THEN {other} ELSE {acc} END"


_SOURCES = """
WITH s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, count(*) AS docs FROM {sized} GROUP BY source),
w AS (SELECT *, CAST(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS BIGINT) AS src FROM s),
v AS (SELECT *, CASE src % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM w),
k AS (SELECT *, CAST(2 * n AS DOUBLE) / weight AS ratio,
        coalesce(sum(2 * n) OVER (ORDER BY CAST(2 * n AS DOUBLE) / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(weight) OVER (ORDER BY CAST(2 * n AS DOUBLE) / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
        sum(n) OVER () AS total FROM v),
l AS (SELECT *, (CAST(3 * total AS DOUBLE) / 2 - CAST(capped AS DOUBLE)) / CAST(open AS DOUBLE) AS level FROM k),
f AS (SELECT min(src) AS src, min(level) AS level FROM (SELECT *, row_number() OVER (ORDER BY ratio, src) AS place FROM l WHERE level <= ratio) AS fits WHERE place = 1),
t AS (SELECT l.source, l.src, l.n, l.docs, l.weight, least(CAST(2 * l.n AS DOUBLE), coalesce((SELECT level FROM f), 0) * l.weight) AS target FROM l),
u AS (SELECT *, CAST(greatest(1, least({block}, n {div} {fine})) AS BIGINT) AS width FROM t),
b AS (SELECT *, CAST((n + width - 1) {div} width AS BIGINT) AS blocks, CASE WHEN n = 0 THEN 0 ELSE CAST(floor(target / n) AS BIGINT) END AS passes FROM u)
SELECT source, src, n, docs, weight, target, width, blocks, CAST(passes * blocks + floor((target - passes * n) / width + 0.5) AS BIGINT) AS quota FROM b
"""


@dataclass
class Mix:
    """rows: doc_id, source, size, src, width (of the source's blocks), start (offset in its stream); sources: one row a source; slots: shard, src, pass, block."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame

    def usage(self) -> DataFrame:
        """src, block, times: how often the mix takes each block."""
        return self.slots.groupBy("src", "block").agg(F.count(F.lit(1)).alias("times"))

    def pieces(self) -> DataFrame:
        """The overlaps of documents with blocks: keys of the row, words from..to of the document, times."""
        spans = self.rows.where("size > 0").withColumn("block", F.explode(F.expr("sequence(start div width, (start + size - 1) div width)")))
        spans = spans.withColumn("first", F.expr("greatest(start, block * width) - start")).withColumn("last", F.expr("least(start + size, (block + 1) * width) - start"))
        # tables that grow with the corpus are merged: Spark's estimate of their bytes is below what the driver would hold
        return spans.join(self.usage().hint("merge"), ["src", "block"], "left").fillna(0, ["times"])


def _array(values: list[int]) -> str:
    return "array(" + ", ".join(f"{v}L" for v in values) + ")"


def _at(values: list[int], index: str) -> str:
    return f"get({_array(values)}, CAST({index} AS INT))"


def _search(df: DataFrame, ends: list[int], value: str, out: str) -> DataFrame:
    """Adds out: how many of the ascending ends are not above the value, by binary search, one projection a step."""
    df = df.withColumn(out, F.lit(0).cast("bigint"))
    step = 1 << max(0, len(ends).bit_length() - 1)
    while step:
        end = _at(ends, f"{out} + {step - 1}")
        df = df.withColumn(out, F.expr(f"CASE WHEN {out} + {step} <= {len(ends)} AND {end} <= {value} THEN {out} + {step} ELSE {out} END"))
        step //= 2
    return df


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and told (a number of the text where the id is null) of every row."""
    told = F.when(F.col("doc_id").isNull(), F.conv(F.substring(F.md5(text_of()), 1, 7), 16, 10).cast("bigint"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.regexp_count(text_of(), F.lit(WORD)).cast("bigint").alias("size"), told.alias("told"))


def plan_mix(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> Mix:
    """Draws the mix of docs (doc_id, text, source)."""
    spark = docs.sparkSession
    counted = staged(sized(docs), "mix-sized")
    sources = staged(spark.sql(_SOURCES.format(sized="{sized}", block=block, fine=FINE, div="div"), sized=counted), "mix-sources")
    known = sources.orderBy("src").collect()  # one row a source
    rows_in_all = sum(r["docs"] for r in known)
    buckets = max(1, int(ceil_sqrt(rows_in_all)))

    keyed = counted.join(sources.select(F.col("source").alias("_source"), "src", "width"), counted["source"].eqNullSafe(F.col("_source"))).drop("_source")
    keyed = keyed.withColumn("_bucket", F.expr(_bucket(str(buckets), "div")))
    rows = staged(running_start(keyed, ["src"], "_bucket", [F.asc_nulls_first("doc_id"), "size"], "size", "start").drop("_bucket", "told"), "mix-rows")

    quota, total = [r["quota"] for r in known], sum(r["quota"] for r in known)
    ends = [sum(quota[: i + 1]) for i in range(len(quota))]
    drawn = spark.range(0, total, 1, max(1, min(1000, total // 50_000))).select(F.expr(f"id div {shard_slots}").alias("shard"), F.expr(_draw("id", str(max(total, 1)), "div")).alias("_u"))
    drawn = _search(drawn, ends, "_u", "src")
    counts = staged(drawn.groupBy("shard", "src").agg(F.count(F.lit(1)).alias("drawn")), "mix-counts")
    counts = counts.withColumn("_bucket", F.expr("shard div 256"))
    got = {r["src"]: r["n"] for r in counts.groupBy("src").agg(F.sum("drawn").alias("n")).collect()}  # one row a source
    lacks = [max(0, q - got.get(i, 0)) for i, q in enumerate(quota)]

    if known:
        parts = max(1, min(1000, total // 50_000))
        owned = running_start(counts, ["src"], "_bucket", ["shard"], "drawn", "_from").withColumn("_kept", F.expr(f"greatest(0L, least(drawn, {_at(quota, 'src')} - _from))"))
        own = owned.where("_kept > 0").repartition(parts, "shard", "src").select("shard", "src", F.explode(F.expr("sequence(_from, _from + _kept - 1)")).alias("n"))
        over = owned.groupBy("_bucket", "shard").agg(F.sum(F.expr("drawn - _kept")).alias("_over")).where("_over > 0")
        lack_ends = [sum(lacks[: i + 1]) for i in range(len(lacks))]
        moved = running_start(over, [], "_bucket", ["shard"], "_over", "_from").repartition(parts, "shard").select("shard", F.explode(F.expr("sequence(_from, _from + _over - 1)")).alias("_i"))
        moved = _search(moved, lack_ends, "_i", "src")
        moved = moved.select("shard", "src", F.expr(f"{_at([q - x for q, x in zip(quota, lacks, strict=True)], 'src')} + _i - {_at([e - x for e, x in zip(lack_ends, lacks, strict=True)], 'src')}").alias("n"))
        slots = own.unionByName(moved).withColumn("_blocks", F.expr(_at([r["blocks"] for r in known], "src")))
        slots = slots.withColumn("pass", F.expr("n div _blocks")).withColumn("_at", F.expr("n % _blocks"))
        # each round is a projection of its own, so that its inputs are computed once, in generated code
        for r in range(ROUNDS):
            slots = slots.withColumn("_k", F.expr(_key(str(r), "_blocks", "(src * 3 + pass)"))).withColumn("_at", F.expr(_round("_at", "_k", "_blocks", "div")))
        # written, as a filter pushed into the rounds would copy their expressions into one another
        slots = staged(slots.select("shard", "src", "n", "pass", F.col("_at").alias("block")), "mix-slots")
    else:
        slots = spark.createDataFrame([], "shard bigint, src bigint, n bigint, pass bigint, block bigint")
    return Mix(rows, sources, slots)


def ceil_sqrt(n: int) -> int:
    """The least integer whose square is n or more."""
    r = int(n**0.5)
    while r * r < n:
        r += 1
    return r


def mix_counts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target (of the source), taken (words that the mix takes)."""
    mix = plan_mix(docs, block)
    taken = mix.pieces().groupBy("src", "start", "doc_id", "size").agg(F.sum(F.expr("(last - first) * times")).alias("taken"))
    none = mix.rows.where("size = 0").select("src", "start", "doc_id", "size", F.lit(0).cast("bigint").alias("taken"))
    about = mix.sources.select("src", "source", F.col("n").alias("source_size"), "target")
    return taken.unionByName(none).join(about, "src").select("doc_id", "source", "size", "source_size", "target", "taken")


def mix_blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mixed corpus itself: shard, slot of the source (src, n), block, and its text (words joined by one space)."""
    mix = plan_mix(docs, block)
    words = _worded(docs, mix).withColumn("block", F.explode(F.expr("sequence(start div width, (start + size - 1) div width)")))
    words = words.select("src", "block", "start", F.expr("slice(words, CAST(greatest(start, block * width) - start + 1 AS INT), CAST(least(start + size, (block + 1) * width) - greatest(start, block * width) AS INT))").alias("words"))
    texts = words.groupBy("src", "block").agg(F.sort_array(F.collect_list(F.struct("start", "words"))).alias("parts"))
    texts = texts.select("src", "block", F.array_join(F.flatten("parts.words"), " ").alias("text"))
    return mix.slots.join(texts, ["src", "block"]).select("shard", "src", "n", "block", "text")


def _worded(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of the mix that have words, each with its own text's words; repeated ids pair by size and offset."""
    by_size = Window.partitionBy("_id", "_source").orderBy("_size")
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.regexp_extract_all(text_of(), F.lit(f"({WORD})")).alias("words")).withColumn("_size", F.size("words"))
    texts = texts.where("_size > 0").withColumn("_nth", F.row_number().over(by_size))
    rows = mix.rows.where("size > 0").withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source").orderBy("size", "start")))
    return rows.join(texts, rows["doc_id"].eqNullSafe(texts["_id"]) & rows["source"].eqNullSafe(texts["_source"]) & (rows["nth"] == texts["_nth"])).drop("_id", "_source", "_size", "_nth", "nth")


def mix_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs after the mix, with the columns of docs: a row for the first and one for the second time that words are taken.

    A row holds the words taken that time, in order; a text taken whole keeps its white space. n_chars follows.
    """
    mix = plan_mix(docs, block)
    keys = ["src", "start"]
    spans = mix.pieces().where("times > 0").groupBy(*keys, "doc_id", "source", "size").agg(F.sort_array(F.collect_list(F.struct("first", "last", "times"))).alias("_spans"))
    by_size = Window.partitionBy("doc_id", "source").orderBy("size", "start")
    plan = mix.rows.where("size > 0").select("doc_id", "source", "size", *keys, F.row_number().over(by_size).alias("_nth"))
    plan = plan.join(spans.select(*keys, "_spans").hint("merge"), keys).select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), "_nth", F.col("size").alias("_size"), "_spans")
    # the columns of docs travel as one, so that none of theirs can clash with one of ours
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "source", text_of().alias("text"), F.regexp_count(text_of(), F.lit(WORD)).cast("bigint").alias("_words")).where("_words > 0")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "source").orderBy("_words")))
    both = rows.join(plan.hint("merge"), rows["doc_id"].eqNullSafe(plan["_id"]) & rows["source"].eqNullSafe(plan["_src"]) & (rows["_n"] == plan["_nth"]))
    both = both.withColumn("_time", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("_mine", F.expr("filter(_spans, s -> s.times >= _time)")).where("size(_mine) > 0")
    whole = F.expr("aggregate(_mine, 0L, (n, s) -> n + s.last - s.first) = _size")
    parts = F.expr(r"array_join(flatten(transform(_mine, s -> slice(_all, CAST(s.first AS INT) + 1, CAST(s.last - s.first AS INT)))), ' ')")
    both = both.withColumn("_all", F.when(~whole, F.regexp_extract_all("text", F.lit(f"({WORD})")))).withColumn("_new", F.when(whole, F.col("text")).otherwise(parts))
    return both.select(*[F.col("_new").alias(c) if c == "text" else F.char_length("_new").cast("bigint").alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in docs.columns])


def _oracle() -> str:
    keys = f"list_transform(range({ROUNDS}), lambda r: {_key('r', 'blocks', '(src * 3 + pass)')})"
    turn = _round("acc", "k", "blocks", "//")
    return rf"""
WITH sized AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CASE WHEN doc_id IS NULL THEN CAST('0x' || substr(md5(coalesce(text, '')), 1, 7) AS BIGINT) END AS told, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
sources AS ({_SOURCES.format(sized="sized", block=BLOCK, fine=FINE, div="//")}),
n AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS buckets FROM sized),
keyed AS (SELECT doc_id, size, src, width, {_bucket("buckets", "//")} AS bucket FROM sized JOIN sources ON sized.source IS NOT DISTINCT FROM sources.source, n),
places AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY src ORDER BY bucket, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM keyed),
ends AS (SELECT list(e ORDER BY src) AS cuts, max(e) AS total FROM (SELECT src, CAST(sum(quota) OVER (ORDER BY src) AS BIGINT) AS e FROM sources) AS q),
drawn AS (SELECT i // {SHARD_SLOTS} AS shard, len(list_filter(cuts, lambda e: e <= {_draw("i", "total", "//")})) AS src, i FROM ends, (SELECT unnest(range(total)) AS i FROM ends) AS r),
ranked AS (SELECT d.*, row_number() OVER (PARTITION BY src ORDER BY shard, i) - 1 AS n FROM drawn AS d),
own AS (SELECT r.src, r.n FROM ranked AS r JOIN sources AS s USING (src) WHERE r.n < s.quota),
lacks AS (SELECT s.src, s.quota - count(o.src) AS lack, count(o.src) AS have FROM sources AS s LEFT JOIN own AS o USING (src) GROUP BY s.src, s.quota),
moved AS (SELECT src, have + unnest(range(lack)) AS n FROM lacks),
slots AS (SELECT x.src, x.n // s.blocks AS pass, x.n % s.blocks AS spot, s.blocks FROM (SELECT src, n FROM own UNION ALL SELECT src, n FROM moved) AS x JOIN sources AS s USING (src)),
used AS (SELECT src, list_reduce(list_prepend(spot, {keys}), lambda acc, k: {turn}) AS block FROM slots),
usage AS (SELECT src, block, count(*) AS times FROM used GROUP BY src, block),
cut AS (SELECT *, unnest(range(start // width, (start + size - 1) // width + 1)) AS block FROM places WHERE size > 0),
taken AS (SELECT c.src, c.start, c.doc_id, c.size, CAST(sum((least(c.start + c.size, (c.block + 1) * c.width) - greatest(c.start, c.block * c.width)) * coalesce(u.times, 0)) AS BIGINT) AS taken
  FROM cut AS c LEFT JOIN usage AS u ON c.src = u.src AND c.block = u.block GROUP BY ALL
  UNION ALL SELECT src, start, doc_id, size, 0 FROM places WHERE size = 0)
SELECT t.doc_id, s.source, t.size, s.n AS source_size, s.target, t.taken FROM taken AS t JOIN sources AS s USING (src)
"""


ORACLE = _oracle()
