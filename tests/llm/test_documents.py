"""Operators on documents against brute force, on a fixture with nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from ruleforge.llm import common, exact, golay, graph, lm, media, mixing, packing, passages, simhash, subword

SPACES = re.compile("[\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _text string, fp bigint, size string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, rng.choice([3, 30, 120, 400])) for _ in range(40)]
    texts = base + [base[0], base[0] + "\n", " ".join(base[3].split()[:-1] + ["zzz"]), base[5].replace(" ", "\t\n", 3), base[7] + " " + base[7]]
    texts += [None, "", " \n", "one", "one two", "ONE two three", words(rng, 9000), "ünïcode ß 東京 " * 20, "same " * 300]
    passage = words(rng, 80)
    texts += [words(rng, 60) + " " + passage + " " + words(rng, 90), words(rng, 20) + " " + passage.replace(passage.split()[40], "changed") + " " + words(rng, 10)]
    out = [(i, t, "en", rng.choice(["hot", "hot", "a", "b", None]), None if t is None else len(t), "clash", i, "clash") for i, t in enumerate(texts)]
    return [*out, out[4], (None, "no id " * 10, "en", "a", 60, "clash", 0, "clash")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(text):
    return SPACES.sub("", text or "")


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r)
    found = exact.exact_dedup(docs).collect()
    assert len(found) == len(rows)
    wanted = Counter()
    for text, members in groups.items():
        keep = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        for r in members:
            wanted[r[0], keep, len(members), r[0] == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, found)) == wanted
    assert exact.exact_dedup(empty).count() == 0
    stay = exact.distinct_documents(docs)
    assert stay.columns == docs.columns
    assert sorted(norm(r.text) for r in stay.collect()) == sorted(groups)


def test_exact_dedup_sees_through_hash_collisions(docs):
    from pyspark.sql import functions as F

    weak = lambda text: F.unhex(F.lpad(F.hex(F.char_length(text) % 2), 2, "0"))
    assert Counter(map(tuple, exact.exact_dedup(docs, hash_of=weak).collect())) == Counter(map(tuple, exact.exact_dedup(docs).collect()))


def shingle_bits(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, empty):
    found = simhash.near_duplicates(docs).collect()
    prints = {r[1]: shingle_bits(r[1]) for r in rows}
    parent = {p: p for p in prints.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(parent, 2):
        if (a ^ b).bit_count() <= 4:
            parent[root(a)] = root(b)
    least = {}
    for r in rows:
        if r[0] is not None:
            k = root(prints[r[1]])
            least[k] = min(r[0], least.get(k, r[0]))
    wanted = Counter((r[0], f"{prints[r[1]]:016x}", least.get(root(prints[r[1]]))) for r in rows)
    assert Counter(map(tuple, found)) == wanted
    assert simhash.near_duplicates(empty).count() == 0
    stay = simhash.representatives(docs)
    assert stay.columns == docs.columns
    assert Counter(r.doc_id for r in stay.collect()) == Counter(least.get(k) for k in {root(p) for p in prints.values()})


def test_every_pair_within_four_bits_meets_under_a_key():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.int64)
    for distance in range(5):
        other = base.copy()
        for i in range(len(other)):
            for bit in rng.choice(64, distance, replace=False):
                other[i] ^= np.int64(np.uint64(1 << int(bit)).view(np.int64)) if bit < 63 else np.iinfo(np.int64).min
        ki, wi = simhash._rows(base, "index")
        kq, wq = simhash._rows(other, "query")
        index, query = defaultdict(set), defaultdict(set)
        for k, w in zip(ki.tolist(), wi.tolist()):
            index[w].add(k)
        for k, w in zip(kq.tolist(), wq.tolist()):
            query[w].add(k)
        assert all(index[i] & query[i] for i in range(len(base)))


def test_golay_code_is_perfect():
    words_ = np.arange(0, 1 << 23, 997)
    names, counts = golay.keys(words_)
    assert set(np.unique(counts)) <= {1, 6}
    assert np.array_equal(golay.keys(words_ ^ 1)[0][:, 0] >= 0, np.ones(len(words_), dtype=bool))


def test_fingerprint_links_of_near_copies_in_thousands(spark):
    """A large cloud of fingerprints around one, each within a few bits of another, is one component."""
    rng = random.Random(1)
    center = rng.getrandbits(64)
    cloud = {center} | {center ^ (1 << a) ^ (1 << b) for a, b in combinations(range(40), 2)}
    far = {rng.getrandbits(64) for _ in range(50)}
    signed = [(int(np.uint64(x).view(np.int64)), 0) for x in cloud | far]
    found = simhash.link_fingerprints(spark.createDataFrame(signed, "fp bigint, first bigint")).collect()
    comp = {r.fp: r.comp for r in found}
    assert len({comp[int(np.uint64(x).view(np.int64))] for x in cloud}) == 1
    assert len(set(comp.values())) == 1 + len(far - cloud)


def test_mixing_equals_sql_and_meets_targets(docs, rows, empty):
    con = duckdb.connect()
    import pandas as pd

    documents = pd.DataFrame([r[:4] for r in rows], columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    key = lambda rs: sorted(((r[0] is None, r[0] or 0), r[1] or "~", r[2], r[3], round(r[4], 6), r[5]) for r in rs)
    found = mixing.mix_counts(docs).collect()
    assert key(found) == key(con.execute(mixing.ORACLE).fetchall())
    size, taken, target = Counter(), Counter(), {}
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.size == len(re.findall("[^\x20\x09-\x0d]+", next(x[1] or "" for x in rows if x[0] == r.doc_id)))
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-9 and abs(taken[s] - target[s]) <= max(1, size[s] / mixing.FINE)
    assert mixing.mix_counts(empty).count() == 0


@pytest.mark.parametrize("n", [1, 60, 100, 1000])
def test_small_sources_meet_their_targets(spark, n):
    """Three sources of n words each, in documents of a few: targets by the contract are n times 2, 5/6 and 5/3."""
    rng = random.Random(n)
    rows = [(f"{s}", words(rng, k)) for s in "abc" for k in ([n] if n < 10 else [n // 10] * 10)]
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id int, text string, source string")
    taken = Counter()
    for r in mixing.mix_counts(docs).collect():
        assert abs(r.target - {"a": 2 * n, "b": 5 * n / 6, "c": 5 * n / 3}[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= max(1, n / mixing.FINE) for s, t in (("a", 2 * n), ("b", 5 * n / 6), ("c", 5 * n / 3))), taken


def test_whole_rows_keep_columns_whose_names_clash(spark, rows):
    """Columns named like those that the operators add come through as they were."""
    names = ["_norm", "_hash", "_sha", "_mine", "_id", "_told", "_words", "_n", "_all", "_new", "_row", "_keep", "src", "start", "size", "told", "width"]
    docs = spark.createDataFrame([(r[0], r[1], r[3], *[f"{n}{r[0]}" for n in names]) for r in rows if r[0] is not None], "doc_id bigint, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for made in (exact.distinct_documents(docs), simhash.representatives(docs), mixing.mix_documents(docs)):
        assert made.columns == docs.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in made.collect() for n in names)


def test_mixed_documents_broadcast_nothing_that_grows(docs):
    plan = mixing.mix_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert [j.split()[0] for j in re.findall(r"\w+Join \[.*", plan)] == ["SortMergeJoin"] * 3


def test_mixed_documents_hold_the_words_taken(docs):
    counts = Counter({(r.doc_id, r.source): r.taken for r in mixing.mix_counts(docs.dropDuplicates(["doc_id"])).collect()})
    out = mixing.mix_documents(docs.dropDuplicates(["doc_id"]))
    assert out.columns == docs.columns
    made = Counter()
    for r in out.collect():
        made[r.doc_id, r.source] += len(SPACES.split(r.text.strip("\x20\x09\x0a\x0b\x0c\x0d")))
    assert +made == +counts


def naive_pack(rows, capacity):
    """Best fit by trying all open bins, for pieces already in order."""
    bins, out = [], []
    for size, source, cluster in rows:
        fits = [i for i, b in enumerate(bins) if b[0] >= size and (source is None or source not in b[1]) and (cluster is None or cluster not in b[2])]
        at = min(fits, key=lambda i: (bins[i][0], i)) if fits else len(bins)
        if not fits:
            bins.append([capacity, set(), set()])
        bins[at][0] -= size
        bins[at][1] |= {source} - {None}
        bins[at][2] |= {cluster} - {None}
        out.append(at)
    return out


def test_packing_is_best_fit_under_conflicts():
    rng = random.Random(9)
    given = [(i, rng.choice([0, 1, 3, 9, 20, 50, 64, 130]), rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, "c", "d", f"own{i}"])) for i in range(200)]
    got = packing.pack_rows(given, 64)
    pieces = defaultdict(int)
    for doc_id, piece, start, length, number, position, offset in got:
        pieces[doc_id] += length
    assert all(pieces[i] == n for i, n, _, _ in given)
    several = {c for c, n in Counter(x[3] for x in given if x[3]).items() if n > 1}
    known = {i: (s, c if c in several else None) for i, _, s, c in given}
    placed = [g for g in got if g[4] is not None]
    assert [g[4] for g in placed] == naive_pack([(g[3], *known[g[0]]) for g in placed], 64)
    fill = defaultdict(list)
    for g in placed:
        fill[g[4]].append((g[5], g[6], g[3]))
    for items in fill.values():
        at = 0
        for i, (position, offset, length) in enumerate(sorted(items)):
            assert (position, offset) == (i, at)
            at += length
        assert at <= 64


def test_pack_covers_every_row(docs, rows, empty):
    out = packing.pack(docs, capacity=256, shard_rows=16).collect()
    total = Counter()
    for r in out:
        total[r.doc_id] += r.length
    wanted = Counter()
    for r in rows:
        wanted[r[0]] += len(re.findall("[^\x20\x09-\x0d]+", r[1] or ""))
    assert set(total) == {r[0] for r in rows} and +total == +wanted
    assert packing.pack(empty).count() == 0
    texts = packing.assemble(docs, packing.pack(docs, capacity=256, shard_rows=16)).collect()
    assert sum(len(t.text.split()) for t in texts) == sum(wanted.values())


def test_media_round_trip(docs, rows, empty):
    found = media.store_media(docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in found:
        body = media.payload(texts[r.doc_id])
        assert r.n_bytes == len(texts[r.doc_id]) and r.payload_bytes == len(body) and len(body) % 192 == 0 and body
        assert r.payload_sha256 == hashlib.sha256(body).hexdigest() and r.tail_crc32 == zlib.crc32(body[-16:])
        file = media.wav_header(len(body)) + body
        assert r.media_bytes == len(file) and r.media_sha256 == hashlib.sha256(file).hexdigest()
        assert r.feature == media.feature(body)
    assert media.store_media(empty).count() == 0


def test_gear_cuts_follow_content():
    rng = np.random.default_rng(2)
    data = rng.integers(32, 120, 200_000, dtype=np.uint8)
    h, slow = media.gear(data), 0
    for i in range(400):
        slow = (slow * 2 + int(media._GEAR[data[i]])) % (1 << 32)
        if i >= 40:
            assert int(h[i]) == slow
    whole = data.tobytes()
    edited = whole[:50_000] + b"inserted" + whole[50_000:]
    a, b = media.cuts([whole])[0], media.cuts([edited])[0]
    pieces = lambda d, ends: {d[x:y] for x, y in zip([0, *ends], ends)}
    assert len(pieces(whole, a) & pieces(edited, b)) > 0.9 * len(a)
    assert all(y - x <= media.MOST for x, y in zip([0, *a], a)) and a[-1] == len(whole)


def test_rows_of_a_hot_key_meet_those_of_other_components_only(spark):
    """Under a key with many rows of one component, each other component's row meets all, and those rows not one another."""
    prints = spark.createDataFrame([(i, 1) for i in range(200)] + [(1000, 2), (1001, 3)], "fp bigint, comp bigint")
    keyed = prints.selectExpr("7 AS key", "fp", "comp").unionByName(prints.selectExpr("fp AS key", "fp", "comp"))
    homes = spark.createDataFrame([(7, 1)], "key bigint, home bigint")
    left, right = simhash._sided(keyed, homes, False), simhash._sided(keyed, homes, True)
    met = [(r[0], r[1]) for r in left.alias("l").join(right.alias("r"), "key").selectExpr("l.fp", "r.fp").collect()]
    comp = {r.fp: r.comp for r in prints.collect()}
    under = {(a, b) for a in comp for b in comp if comp[a] != comp[b]}
    assert under <= set(met) and len(met) < 1500


def test_simhash_broadcasts_nothing_that_grows(spark, docs, monkeypatch):
    """Below Spark's default threshold too, only the few homes and large components, counted before, go through the driver."""
    plans, write = [], graph.staged

    def planned(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def watched(df, *more):
        plans.append(planned(df))
        return write(df, *more)

    monkeypatch.setattr(graph, "staged", watched)
    monkeypatch.setattr(simhash, "staged", watched)
    plans += [planned(simhash.near_duplicates(docs)), planned(simhash.representatives(docs))]
    joins = re.findall(r"\w+Join \[.*", "\n".join(plans))
    counted = [j for j in joins if "LeftSemi" in j or re.search(r"Join \[key#\w+\], \[key#\w+\], LeftOuter", j)]
    assert len(counted) == 6 and len(joins) > 20
    assert {j.split()[0] for j in joins if j not in counted} == {"SortMergeJoin"}
    few = spark.range(20).withColumnRenamed("id", "key")
    for most, kind in ((20, "BroadcastHashJoin"), (19, "SortMergeJoin")):
        assert kind in planned(few.join(common.beside(few, most), "key", "left"))


def test_missing_chunk_fails(docs):
    lists = media.chunk_lists(docs)
    with pytest.raises(Exception):  # noqa: B017
        media.read_media(lists, media.chunk_store(docs).limit(3)).collect()


def test_passages_find_what_repeats(docs, rows, empty):
    found = passages.repeated_passages(docs).collect()
    ids = [r[0] for r in rows if r[1] and "changed" in r[1]]
    fuzzy, original = ids[0], ids[0] - 1
    texts = {r[0]: r[1].split() for r in rows if r[1] is not None and r[0] is not None}
    mine = [r for r in found if r.doc_id == original]
    assert len(mine) == 1 and mine[0].partner_id == fuzzy and abs(mine[0].start - 60) <= 2 and abs(mine[0].n_words - 80) <= 3 and 0.9 < mine[0].identity < 1
    copies = {r.doc_id for r in found if r.identity == 1.0 and r.n_words == len(texts[r.doc_id])}
    assert {0, 40, 41} <= copies
    alone = {r.doc_id for r in found} - copies
    assert not alone & {i for i in range(8, 40)}, "invented words share nothing"
    assert passages.repeated_passages(empty).count() == 0


def planted(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.mark.parametrize("gap", [35, 140])
def test_two_passages_of_one_pair_are_both_found(spark, gap):
    rng = random.Random(gap)
    one, two = words(rng, 60), words(rng, 60)
    texts = [" ".join([words(rng, 30), one, words(rng, gap), two, words(rng, 30)]) for _ in range(2)]
    for r in (found := passages.repeated_passages(planted(spark, texts)).collect()):
        assert r.identity >= passages.IDENTITY and r.links == 1
    for d in (0, 1):
        covered = {i for r in found if r.doc_id == d for i in range(r.start, r.start + r.n_words)}
        assert {*range(30, 90), *range(90 + gap, 150 + gap)} <= covered
        assert len([r for r in found if r.doc_id == d]) == 2


def test_frequent_phrases_do_not_hide_a_passage(spark):
    """Every phrase of a passage of two texts is frequent, each in texts of its own; a third text has another passage three times."""
    rng = random.Random(8)
    passage, thrice = words(rng, 64), words(rng, 55)
    w = passage.split()

    def within(low, high, make):
        """A text whose class lies in this part of all classes."""
        while True:
            if low <= passages.class_of(passages.words_of((text := make()).encode())) / 2**63 < high:
                return text

    both = [within(*r, lambda: " ".join([words(rng, 80), passage, words(rng, 80)])) for r in ((0.3, 0.4), (0.6, 0.7))]
    parts = [within(*r, lambda: " ".join([words(rng, 70), *w[at : at + 24], words(rng, 70)])) for at in range(0, 48, 8) for r in ((0, 0.3), (0.4, 0.6)) for _ in range(2)]
    three = within(0, 0.2, lambda: " ".join(x for _ in range(3) for x in (words(rng, 100), thrice)))
    texts = [*both, three, *(within(0.5, 1, lambda: words(rng, 60) + " " + thrice) for _ in range(3)), *parts]
    found = passages.repeated_passages(planted(spark, texts)).collect()
    covered = {d: {i for r in found if r.doc_id == d for i in range(r.start, r.start + r.n_words)} for d in range(6)}
    assert all(set(range(80, 144)) <= covered[d] for d in (0, 1))
    assert {i for n in range(3) for i in range(155 * n + 100, 155 * n + 155)} <= covered[2]
    assert not {r.doc_id for r in found} & set(range(6, len(texts)))


def found_in_pair(x, y):
    """Passages of two texts by all matches of their seeds."""
    x, y = x.encode().split(), y.encode().split()
    (h, p), (g, q) = passages.seeds(x), passages.seeds(y)
    pairs = sorted({(int(p[i]), int(q[j])) for i in range(len(h)) for j in np.flatnonzero(g == h[i])})
    a, b = np.array([m[0] for m in pairs], dtype=int), np.array([m[1] for m in pairs], dtype=int)
    paths = [c for c in passages.chains(a, b) if min(a[c[-1]] - a[c[0]], b[c[-1]] - b[c[0]]) >= 1]
    return [r for c in paths for r in passages.align(x, y, [pairs[i] for i in c])]


def test_passages_with_many_edits():
    rng = random.Random(9)
    for every, least in ((10, 99), (8, 95), (7, 85)):
        hits = 0
        for _ in range(100):
            passage = words(rng, 65).split()
            edited = [words(rng, 1) + "x" if i % every == every - 1 else w for i, w in enumerate(passage)]
            hits += bool(found_in_pair(" ".join([words(rng, 40), *passage, words(rng, 40)]), " ".join([words(rng, 55), *edited, words(rng, 30)])))
        assert hits >= least, (every, hits)


@pytest.mark.parametrize("period", [1, 2, 3, 5, 11])
def test_seeds_of_periodic_passages_reach_over_them(period):
    rng = random.Random(period)
    line = words(rng, period)
    at = passages.seeds([*words(rng, 30).encode().split(), *((line + " ") * (600 // period)).encode().split(), *words(rng, 30).encode().split()])[1]
    inside = at[(at >= 30) & (at < 30 + 600 // period * period - passages.K)]
    assert len(inside) > 600 / 16 - 2 and np.diff(inside).max() <= 20 and inside[-1] - inside[0] > 560


def test_good_runs_against_brute_force():
    rng = random.Random(6)
    for _ in range(40):
        columns = [rng.choice([(1, 1, True)] * 12 + [(1, 1, False), (1, 0, False), (0, 1, False)]) for _ in range(90)]
        at = np.concatenate((np.zeros((1, 3), dtype=int), np.cumsum(np.array(columns, dtype=int), axis=0)))
        fits = [(i, j) for i in range(90) for j in range(i + 1, 91) if columns[i][2] and columns[j - 1][2] and 5 * (at[j] - at[i])[2] >= 4 * (j - i) and (at[j] - at[i])[:2].min() >= passages.LEAST]
        words_of_x = lambda spans: {w for i, j in spans for w in range(at[i][0], at[j][0])}
        assert {w for r in passages.good(columns) for w in range(r[0], r[1])} == words_of_x(fits)


def test_fenwick_and_chains_against_brute_force():
    rng = random.Random(4)
    for _ in range(30):
        pairs = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(25)})
        a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        best = {}
        for i in sorted(range(len(pairs)), key=lambda i: pairs[i]):
            x, y = pairs[i]
            best[i] = passages.K + max([0.0, *(best[j] - passages.GAP * (x + y - pairs[j][0] - pairs[j][1]) for j in best if pairs[j][0] < x and pairs[j][1] < y)])
        made = passages.chains(a, b)
        assert sorted(i for c in made for i in c) == list(range(len(pairs)))
        top = made[0]
        assert all(a[i] < a[j] and b[i] < b[j] for i, j in zip(top, top[1:]))
        score = passages.K * len(top) - passages.GAP * sum((a[j] + b[j]) - (a[i] + b[i]) for i, j in zip(top, top[1:]))
        assert abs(score - max(best.values())) < 1e-9


@pytest.fixture(scope="module")
def sample(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_classifier_on_held_out_rows(sample):
    docs, labels = sample
    found = subword.classify(docs, labels, "quality", 0.3).join(labels, "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.quality).mean() > 0.9
    assert found.score.between(0, 1).all()


def test_classifier_defined_cases(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(10_000, 1, 0)], "doc_id bigint, quality int, toxic int")
    found = subword.classify(docs, labels, "quality", 0.3).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[0].score == by_id[40].score, "equal texts, equal scores"
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    blank = {by_id[r[0]].score for r in rows if r[0] is not None and not (r[1] or "").split()}
    assert len(blank) == 1 and 0 < blank.pop() < 1, "texts without words score alike"
    assert {r.score for r in subword.classify(docs, labels, "toxic", 0.5).collect()} != set(), "labels all null"
    assert subword.classify(empty, labels, "quality", 0.3).count() == 0
    assert subword.accepted(docs, labels, "quality", 0.0).count() == len(rows)


def test_texts_without_words_score_by_their_share():
    given = [(["bad", f"w{i}"], 0) for i in range(30)] + [(["fine", f"v{i}"], 0) for i in range(170)]
    pack = lambda bags: [([w.encode() for w in b], n) for b, n in bags]
    rare = subword.train(pack(given), [1] * 30 + [0] * 170, 0.15)
    assert abs(rare.scorer()([b""])[0] - 0.15) < 1e-9 and rare.scorer()([b" \n"])[0] == rare.scorer()([b""])[0]
    seen = subword.train(pack([*given, *[([], 0)] * 38]), [1] * 30 + [0] * 170 + [1] * 38, 0.3)
    assert seen.scorer()([b""])[0] == (38 + 0.6) / 40


def test_training_reads_whole_texts_and_one_row_of_an_id(spark):
    """The only telling word is the last of 30000; rows of one id count once."""
    rng = random.Random(1)
    filler = words(rng, 30_000)
    texts = [(i, (filler if i < 8 else words(rng, 20)) + (" worthless" if i % 2 else " splendid")) for i in range(60)]
    docs = spark.createDataFrame(texts + [(3, words(rng, 5))] * 50, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    model = subword.fit(docs, labels, "quality")
    bad, good = model.scorer()([b"worthless", b"splendid"])
    assert bad > 0.5 > good


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = subword.classify(docs.join(labels.where("toxic IS NOT NULL").select("doc_id"), "doc_id", "left_semi"), labels, "toxic", 0.5).join(labels, "doc_id").where("held_out").toPandas()
    toxic, clean = found[found.toxic == 1], found[found.toxic == 0]
    assert toxic.predicted.mean() > 0.7 and clean.predicted.mean() < 0.05


def test_misspellings_share_vectors():
    rng = random.Random(2)
    bags, labels = [], []
    for i in range(300):
        text = words(rng, 30).split()
        if i % 2:
            text[3] = "worthless"
        bags.append((text, 0))
        labels.append(i % 2)
    model = subword.train([([w.encode() for w in b], n) for b, n in bags], np.array(labels), 0.5)
    score = model.scorer()
    clean = words(rng, 30)
    bad, plain = score([(clean + " worthles worthlesss").encode(), (clean + " wirkung haus").encode()])
    assert bad > 0.5 > plain


def test_language_model_is_a_distribution_and_learns(docs, rows, empty, sample):
    net = lm.Network.fresh()
    around = np.full((lm.VOCABULARY, 2 * lm.SPAN), 5)
    total = np.exp(net.log_probabilities(around, np.arange(lm.VOCABULARY)).astype(np.float64)).sum()
    assert abs(total - 1) < 1e-3
    rng = np.random.default_rng(0)
    a, t = rng.integers(0, 50, (256, 4)), rng.integers(0, 50, 256)
    before = net.log_probabilities(a, t).mean()
    for _ in range(40):
        net.step(a, t)
    assert net.log_probabilities(a, t).mean() > before + 1
    found = lm.pseudo_likelihood(docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    for r in found:
        n = len((next(x[1] for x in rows if x[0] == r.doc_id) or "").split())
        assert r.n_tokens == n and r.score <= 0 and (r.mean_score is None) == (n == 0)
    assert lm.pseudo_likelihood(empty).count() == 0


def test_language_model_trains_on_every_token():
    texts = [np.arange(n, dtype="<i2") for n in (0, 1, 5, 400, 4000)]
    for rounds in (1, 2, 3):
        seen = Counter()
        for turn in range(rounds):
            for data in lm.examples([3, 9, 1 << 62, 77, 5], [t.tobytes() for t in texts], turn, rounds):
                seen.update(data[:, 0].tolist())
                middle = data[(data[:, 1] != lm._EDGE) & (data[:, 2] != lm._EDGE)]
                assert (middle[:, 2] == middle[:, 0] - 1).all() and (middle[:, 1] == middle[:, 0] - 2).all()
        assert seen == Counter(i for t in texts for i in t.tolist())


def test_language_model_reads_many_texts_at_once():
    """Thousands of short texts come as a few arrays, with the rows that each text has alone; matrices don't lie in steps of a page."""
    rng = np.random.default_rng(7)
    texts = [rng.integers(0, 4096, n).astype("<i2") for n in [0, 1, 2, 3, *rng.integers(0, 90, 3000), 450_000]]
    keys = rng.integers(0, 1 << 62, len(texts)).tolist()
    for turn in range(2):
        got = list(lm.examples(keys, [t.tobytes() for t in texts], turn, 2))
        wanted = [np.column_stack((t[at], lm.windows(t, at))) for t, k in zip(texts, keys) for at in [lm.masked(len(t), k, turn, 2)]]
        assert np.array_equal(np.concatenate(got), np.concatenate(wanted)) and max(map(len, got)) <= 2 * lm._TOGETHER
    net, some = lm.Network.fresh(), np.concatenate(got)[: lm.BATCH]
    h = net._hidden(some[:, 1:])[1]
    z = net._branches(h, np.sort(some[:, 0]), 1)[0]
    assert len(some) == lm.BATCH and h.strides[0] % 4096 and z.strides[0] % 4096


def test_language_model_deals_copies_to_all_parts(spark):
    tokens = spark.createDataFrame([(i, 7, bytearray(b"ab")) for i in range(400)], "doc_id bigint, key bigint, ids binary")
    parts = [len(p) for p in lm.dealt(tokens, 4).rdd.glom().collect()]
    assert len(parts) == 4 and max(parts) < 150


def test_language_model_gradient():
    """Gradients against numeric ones."""
    rng = np.random.default_rng(1)
    around, tokens = rng.integers(0, 200, (16, 4)), rng.integers(0, 200, 16)
    start = {k: v.astype(np.float64) for k, v in lm.Network.fresh().weights.items()}
    loss = lambda w: -lm.Network(w).log_probabilities(around, tokens).astype(np.float64).mean()
    found = lm.Network(start).gradients(around, tokens)
    for name, at in (("mix", (3, 4)), ("embed", (int(around[0, 0]), 2)), ("tree0", (0, 1, 7)), ("tree1", (0, int(tokens[0]) // 16, lm.HIDDEN)), ("tree2", (int(tokens[0]) // 16, int(tokens[0]) % 16, 5)), ("shift", (1,))):
        up = {k: v.copy() for k, v in start.items()}
        down = {k: v.copy() for k, v in start.items()}
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        whole = np.zeros_like(start[name])
        rows_, grad = found[name]
        whole[rows_] = grad
        slope = (loss(up) - loss(down)) / 2e-3
        assert abs(whole[at] - slope) < 1e-3 + 0.05 * abs(slope), name


def test_language_model_scores_against_a_slow_version(spark, docs, rows):
    """Vocabulary, ids, windows and sums of log-probabilities recomputed word by word."""
    count = Counter(w for r in rows for w in (r[1] or "").encode().split())
    known = sorted(count, key=lambda w: (-count[w], w))[: lm.VOCABULARY - lm.OTHERS]
    assert lm.vocabulary(docs) == known
    wide = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 700, 6000, 1 + i % 5))) for i in range(40)], "doc_id bigint, text string")
    often = Counter(w for r in wide.collect() for w in r.text.encode().split())
    assert lm.vocabulary(wide) == sorted(often, key=lambda w: (-often[w], w))[: lm.VOCABULARY - lm.OTHERS]
    net = lm.Network.fresh(5)
    own = {w: i for i, w in enumerate(known)}
    number = lambda w: own[w] if w in own else lm.VOCABULARY - lm.OTHERS + xxhash.xxh64_intdigest(w, 3) % lm.OTHERS
    w = net.weights

    def slow(text):
        ids = [lm._EDGE] * 2 + [number(x) for x in text.encode().split()] + [lm._EDGE] * 2
        total = 0.0
        for i in range(2, len(ids) - 2):
            x = np.concatenate([w["embed"][ids[i + d]] for d in (-2, -1, 1, 2)])
            h = np.append(np.tanh(x @ w["mix"] + w["shift"]), 1.0)
            for level in range(lm.LEVELS):
                z = w[f"tree{level}"][ids[i] // 16 ** (3 - level)] @ h
                total += z[ids[i] // 16 ** (2 - level) % 16] - np.log(np.exp(z).sum())
        return total

    short = [r for r in rows if len(r[1] or "") < 2000]
    texts = {r[0]: r[1] or "" for r in short}
    for r in lm.score(lm.tokenized(docs, known), net).collect():
        if r.doc_id in texts and (r.doc_id is not None):
            assert abs(r.score - slow(texts[r.doc_id])) < 1e-3 * max(1, r.n_tokens)


def test_language_model_averages_by_tokens(spark):
    """One round over two parts is the mean of two networks trained apart, weighted by their tokens."""
    rng = np.random.default_rng(4)
    given = [(int(i), i, 100, bytearray(rng.integers(0, 60, int(rng.integers(20, 90)), dtype="<i2").tobytes())) for i in range(30)]
    tokens = spark.createDataFrame(given, "key bigint, doc_id bigint, n_bytes bigint, ids binary")
    found = lm.train(tokens, rounds=1).flat()
    start, total, seen = lm.Network.fresh().flat().astype(np.float64), 0.0, 0
    for part in lm.dealt(tokens, 2).rdd.glom().collect():
        net = lm.Network.fresh()
        data = np.concatenate(list(lm.examples([r.key for r in part], [bytes(r.ids) for r in part], 0, 1)))
        data = data[np.random.default_rng(0).permutation(len(data))]
        net.step(data[:, 1:], data[:, 0])
        total, seen = total + (net.flat() - start) * len(data), seen + len(data)
    mean = total / seen
    assert np.abs(found - (start + mean)).max() < 1e-4 + np.abs(mean).max() / 100


@pytest.mark.parametrize("length", [50, 64])
def test_every_two_texts_with_one_passage_are_linked(spark, length):
    """A passage of many texts: each has all others as links, not only the first one and the one before."""
    rng = random.Random(length)
    passage = words(rng, length)
    found = passages.repeated_passages(planted(spark, [" ".join([words(rng, 40), passage, words(rng, 40)]) for _ in range(20)])).collect()
    assert {r.doc_id: r.links for r in found} == dict.fromkeys(range(20), 19)
    assert all(r.start <= 40 and r.start + r.n_words >= 40 + length for r in found)


def test_links_count_partners_of_all_parts_of_an_interval(spark):
    rng = random.Random(12)
    whole = words(rng, 150).split()
    parts = [" ".join([words(rng, 30), *whole[a:b], words(rng, 30)]) for a, b in ((0, 150), (0, 80), (70, 150), (30, 100))]
    found = passages.repeated_passages(planted(spark, parts)).collect()
    assert [(r.start, r.n_words, r.links) for r in found if r.doc_id == 0] == [(30, 150, 3)]


def test_short_chains_are_not_aligned_column_by_column(monkeypatch):
    """Texts that share too few words for a passage cost neither columns nor runs; equal ones no edit alignment."""
    rng = random.Random(21)
    made = Counter()
    for name in ("good", "_edit"):
        monkeypatch.setattr(passages, name, lambda *args, _made=getattr(passages, name), _name=name: made.update([_name]) or _made(*args))
    line, passage = words(rng, 12), words(rng, 300)
    x, y = (" ".join([words(rng, 70), line, words(rng, 70)]).encode().split() for _ in range(2))
    assert passages.align(x, y, [(70, 70), (73, 73), (77, 77)]) == [] and not made
    x, y = (" ".join([words(rng, n), passage, words(rng, 70)]).encode().split() for n in (10, 20))
    assert [(r[:4], round(r[4], 9)) for r in passages.align(x, y, [(10 + i, 20 + i) for i in range(0, 296, 3)])] == [((10, 310, 20, 320), 1.0)]
    assert made == {"good": 1}


def test_minimizers_of_many_texts_at_once():
    """Texts that lie one after another, short ones and runs of one word among them, have the seeds that each has alone."""
    rng = random.Random(22)
    texts = [t.encode().split() for t in ["", *(words(rng, n) for n in (0, 1, 4, 5, 6, 7, 8, 9, 40, 200)), "x " * 6, "x " * 90, words(rng, 3) + " y" * 30, words(rng, 8)]]
    one, sizes = np.concatenate([passages.hashed(t) for t in texts]), np.array([len(t) for t in texts])
    h, at = passages.minimizers(one, sizes)
    ends, wanted = np.cumsum(sizes), []
    for t, e in zip(texts, ends.tolist()):
        alone = [xxhash.xxh64_intdigest(w, 19) for w in t]
        names = []
        for i in range(len(t) - passages.K + 1):
            v = 0
            for u in alone[i : i + passages.K]:
                v = (v ^ u) * int(passages._MIX) % 2**64
                v ^= v >> 31
            names.append(v)
        windows = range(max(1, len(names) - passages.W + 1)) if names else []
        least = sorted({min(range(i, min(i + passages.W, len(names))), key=lambda j: (names[j], j)) for i in windows})
        mine = [(int(a) - e + len(t), int(v) % 2**64) for a, v in zip(at, h) if e - len(t) <= a < e]
        assert set(mine) <= {(i, names[i]) for i in least}
        if len(set(names)) == len(names):
            assert mine == [(i, names[i]) for i in least]
        wanted += [e - len(t) + int(i) for i in passages.seeds(t)[1]]
    assert at.tolist() == wanted


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_chains_of_many_pairs_at_once(rows):
    """Pairs of classes over batches of any size, repeated matches among them, have the chains that each has alone."""
    rng = random.Random(rows)
    given = defaultdict(list)
    for pair in range(40):
        if pair % 4 == 0:
            given[pair // 3, pair] += [(3 * i, 3 * i + pair) for i in range(rng.choice([1, 2, 30]))]
        else:
            given[pair // 3, pair] += [(rng.randrange(60), rng.randrange(60)) for _ in range(rng.choice([1, 2, 9]))]
        given[pair // 3, pair] += given[pair // 3, pair][:2]
    matches = [(a, b, x, y) for (a, b), found in sorted(given.items()) for x, y in found]
    columns = [pa.array(c, t) for c, t in zip(zip(*matches), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
    batches = pa.RecordBatch.from_arrays(columns, names=["a", "b", "x", "y"])
    made = [r for i in range(0, len(matches), rows) for r in [batches.slice(i, rows)]]
    wanted = []
    for (a, b), found in given.items():
        p, q = (np.array(c) for c in zip(*sorted(set(found))))
        wanted += [(a, b, p[c].tolist(), q[c].tolist()) for c in passages.chains(p, q) if len(c) > 1]
    found = [r for batch in passages._chain_rows(iter(made)) for r in batch.to_pylist()]
    assert sorted((r["a"], r["b"], r["p"], r["q"]) for r in found) == sorted(wanted)
    assert all((r["a_from"], r["a_to"], r["b_from"], r["b_to"]) == (r["p"][0], r["p"][-1] + passages.K, r["q"][0], r["q"][-1] + passages.K) for r in found)


def test_every_pair_of_rows_of_a_seed(spark):
    rng = random.Random(5)
    given = sorted({(rng.randrange(9), rng.randrange(3), rng.randrange(6), at) for at in range(80)} | {(20, -1, c, 7) for c in range(3)})
    made = passages._paired_rows(spark.createDataFrame(given, "seed bigint, core bigint, cls bigint, at int"))
    wanted = Counter((c, p + d, c2, p + d, p2 + d) for s, k, c, p in given for s2, k2, c2, p2 in given if s == s2 and c2 < c for d in ([0, passages.CORE - passages.K] if k == k2 >= 0 else [0]))
    assert Counter((r.a, r.x, *r._to) for r in made.collect()) == wanted


def test_frequent_phrases_cost_a_passage_no_link(spark):
    """Every phrase of a passage of eight texts is frequent elsewhere, but not the passage: each of them has all others as links."""
    rng = random.Random(13)
    passage = words(rng, 60)
    w = passage.split()
    texts = [" ".join([words(rng, 40), passage, words(rng, 40)]) for _ in range(8)]
    texts += [" ".join([words(rng, 30), *w[at : at + 20], words(rng, 30)]) for at in range(0, 48, 8) for _ in range(passages.FEW)]
    found = passages.repeated_passages(planted(spark, texts)).collect()
    assert {r.doc_id: r.links for r in found} == dict.fromkeys(range(8), 7)
    assert all(r.start <= 40 and r.start + r.n_words >= 100 for r in found)


def test_links_over_ranges_of_classes(spark):
    """Classes of all ranges: the links, and the rows of a key, are those of one order, and no task has a whole hot key."""
    rng = random.Random(14)
    classes = [rng.randrange(1 << 63) for _ in range(60)] + [3, (1 << 63) - 1]
    given = sorted({(rng.choice([5, 5, 5, rng.randrange(30)]), rng.choice(classes), at) for at in range(400)} | {(99, classes[0], i) for i in range(9)})
    rows = passages._linked(spark.createDataFrame(given, "seed bigint, cls bigint, at int"), ["seed"], "links")
    out = {(r.seed, r.cls, r.at): (r.links, r.links_rows) for r in rows.collect()}
    assert len(out) == len(given)
    for (seed, cls, at), (links, size) in out.items():
        group = [(c, p) for s, c, p in given if s == seed]
        others, before = [x for x in group if x[0] != cls], next(reversed(group[: group.index((cls, at))]), None)
        assert size == len(group) and (links is None) == (not others)
        if others:
            assert [tuple(r) if r else None for r in links] == [others[0], before if before and before[0] != cls else None]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    ordered = [line for line in plan.splitlines() if "Window [" in line and "at#" in line]
    assert ordered and all("_range#" in line for line in ordered)


def test_links_against_brute_force(spark):
    """Every row of a seed of several classes has its two links, a hot seed among them."""
    rng = random.Random(3)
    given = sorted({(rng.choice([5, 5, 5, rng.randrange(60)]), rng.randrange(6), at) for at in range(150)} | {(9, 4, 500 + i) for i in range(20)})
    out = {(r.seed, r.cls, r.at): r.links for r in passages._linked(spark.createDataFrame(given, "seed bigint, cls bigint, at int"), ["seed"], "links").collect()}
    for seed, cls, at in given:
        group = [(c, p) for s, c, p in given if s == seed]
        others = [x for x in group if x[0] != cls]
        before = next((x for x in reversed(group[: group.index((cls, at))])), None)
        if not others:
            assert out[seed, cls, at] is None
        else:
            one, two = out[seed, cls, at]
            assert (one.cls, one.at) == others[0]
            assert (tuple(two) if two else None) == (before if before and before[0] != cls else None)
