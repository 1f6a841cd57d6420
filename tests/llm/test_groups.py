"""Operators 1, 2, 4, 7 and 8, components and hashing, against plain Python."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from almanac.llm import components, fuzzy_lines, kneser_ney, minhash, mixture, token_rollup, wordhash
from almanac.llm.queries import QUERIES, SQL
from tools.check_oracle import compare, duckdb_views

from ..conftest import SF_CHECK, SF_SMALL
from . import brute


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()


# --- components and word hashes

def test_components_of_chains_stars_and_random_graphs(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 200 + i) for i in range(50)] + [(9, 9)]
    edges += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(260)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_split_and_match():
    texts = ["a b", " A\tb\r\nb ", "", None, "ÉTÉ été", "x" * 50, "\x85 \xa0", "a\x00b"]
    for t in texts:
        words = brute.plain_words(brute.bytes_lower(t))
        h = wordhash.word_hashes(t)
        assert len(h) == len(words)
        assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(h)) for j in range(len(h)))
    long = "word " * 500_000 + "y" * 3_000_000
    h = wordhash.word_hashes(long)
    assert len(h) == 500_001 and len(set(h.tolist())) == 2
    assert h[0] == wordhash.word_hashes("word")[0] and h[-1] == wordhash.word_hashes("y" * 3_000_000)[0]


# --- 4: near duplicates

def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()
    want = brute.near_components([(r.doc_id, r.text) for r in docs], 2)
    got = QUERIES["op4_minhash"](spark, SF_CHECK).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert any(v[1] != i for i, v in want.items())


def near_copies(n, seed=2):
    """A group of near copies of one text, many of which are not linked to each other directly."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice((0, 1, 2, 4, 5))):
            w[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("centres", [1, 3])
def test_group_of_near_copies_loses_no_link(spark, monkeypatch, centres):
    monkeypatch.setattr(minhash, "CENTRES", centres)
    rows = near_copies(150) + [(1000 + i, "w0 w1 w2") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs, size=2).collect()
    assert {r.doc_id: (r.near.n_shingles, r.near.component_id) for r in got} == brute.near_components(rows, 2)


def test_estimate_is_corrected_for_collisions(spark):
    a, b = wordhash.shingles(np.arange(1, 1001, dtype=np.uint64), 1), wordhash.shingles(np.arange(201, 1201, dtype=np.uint64), 1)
    rows = [(minhash.signature(x)[1].tolist(), minhash.signature(y)[1].tolist()) for x, y in ((a, b), (a, a))]
    out = spark.createDataFrame(rows, "a array<long>, b array<long>").select(
        minhash.equal_groups(F.col("a"), F.col("b")).alias("m")).collect()
    chance = 2.0 ** -minhash.BITS
    estimate = [(r.m / minhash.SKETCHED - chance) / (1 - chance) for r in out]
    assert abs(estimate[0] - 800 / 1200) < 0.15 and estimate[1] == 1


def test_near_duplicate_edges(spark):
    docs = brute.edge_table(spark)
    rows = minhash.near_duplicates(docs, size=5).collect()
    assert len(rows) == docs.count()
    assert {r.near.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert all(r.near.n_shingles == 0 and r.near.kept for r in rows if r.doc_id in (3, 4, 5))
    kept = minhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 8, 9, 10]
    assert minhash.keep_one(docs).columns == docs.columns
    assert minhash.keep_one(brute.table(spark, [])).count() == 0


def test_null_and_repeated_ids_lose_no_document(spark):
    apart = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdefgh"]
    near = apart[0].replace("a39", "zz")                       # only null ids on either side
    of_known = apart[7].replace("h39", "zz")
    rows = [(None, t) for t in apart[:5]] + [(None, near), (None, apart[1])]
    rows += [(5, apart[5]), (5, apart[6]), (8, apart[7]), (None, of_known)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.text_hash: r.near for r in minhash.near_duplicates(docs).collect()}
    assert len({n.component for n in found.values()}) == 8
    kept = [(r.doc_id, r.text) for r in minhash.keep_one(docs).collect()]
    first = [(i, t) for i, t in kept if i is None and t in (apart[0], near)]
    assert len(first) == 1 and len(kept) == 8
    assert set(kept) - set(first) == {(None, t) for t in apart[1:5]} | {(5, apart[5]), (5, apart[6]), (8, apart[7])}


# --- 7: mixing

def test_mix_matches_sql_and_sharing(spark):
    ok, detail = compare(spark, duckdb_views(SF_SMALL), QUERIES["op7_mix_sources"], SQL["op7_mix_sources"], SF_SMALL)
    assert ok, detail
    rows = QUERIES["op7_mix_sources"](spark, SF_CHECK).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert r.taken <= 2 * r.size
    want = brute.targets(sizes)
    for s in sizes:
        assert math.isclose(target[s], want[s], rel_tol=1e-12)
        assert abs(taken[s] - target[s]) < 0.35 * target[s]      # 50 documents each
    assert abs(sum(taken.values()) / sum(target.values()) - 1) < 0.05


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 0, "c": 1, None: 5}, {"x": 7}, {"a": 1, "b": 1000, "c": 1, "d": 1},
                                   {chr(97 + i): (i * 37) % 11 + 1 for i in range(12)}])
def test_targets_by_sharing_again(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixture.source_targets(rows).collect()}
    want = brute.targets(sizes)
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in sizes)


def test_mix_edges(spark):
    docs = brute.edge_table(spark)
    once, twice = mixture.mix(docs), mixture.mix(docs)
    assert once.columns == docs.columns
    assert sorted(once.collect(), key=str) == sorted(twice.collect(), key=str)
    key = mixture.draw_key(F.col("doc_id"), F.col("text"))
    plan = mixture.mix_plan(docs, mixture.n_words(F.col("text")), key).collect()
    assert len(plan) == docs.count() and all(0 <= r.mix.copies <= 2 for r in plan)
    assert all(r.mix["size"] == len(brute.plain_words(r.text)) for r in plan)
    assert mixture.mix(brute.table(spark, [])).count() == 0
    named = mixture.mix(docs.withColumn("mix", F.lit("kept")))
    assert named.columns[-1] == "mix" and {r.mix for r in named.collect()} == {"kept"}


def test_mix_draws_by_text_under_null_and_repeated_ids(spark):
    """With a third of the ids null, or all equal, no source is further off its target than without."""
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    size, key = mixture.n_words(F.col("text")), mixture.draw_key(F.col("doc_id"), F.col("text"))

    def off(df):
        found = mixture.mix_plan(df, size, key).groupBy("source").agg(
            (F.sum(F.col("mix.size") * F.col("mix.copies")) / F.first("mix.target")).alias("r")).collect()
        return {r.source: abs(r.r - 1) for r in found}
    usual = max(off(docs).values())
    nulls = docs.withColumn("doc_id", F.when(F.xxhash64("text") % 3 != 0, F.col("doc_id")))
    assert max(off(nulls).values()) <= usual + 0.1
    assert max(off(docs.withColumn("doc_id", F.lit(7).cast("long"))).values()) <= usual + 0.1


@pytest.mark.parametrize("make", [
    lambda df: mixture.mix(df), lambda df: minhash.keep_one(df), lambda df: fuzzy_lines.dedup_lines(df).drop("dropped")])
def test_columns_of_any_name_stay(spark, make):
    docs = brute.edge_table(spark)
    for name in ("doc", "row", "of", "part", "salt", "key", "of_id", "of_hash", "kept_id", "__t", "__id", "__size", "__text_hash"):
        docs = docs.withColumn(name, F.lit(name))
    rows = make(docs)
    assert rows.columns == docs.columns
    assert {(r.doc, r.row, r.of, r.part, r.key, r.of_id) for r in rows.collect()} == {("doc", "row", "of", "part", "key", "of_id")}


def test_rows_equal_in_id_and_text_leave_the_smallest(spark):
    rows = [(1, brute.SENTENCE, lang, source) for lang in ("fr", "en") for source in ("b", "a")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert [tuple(r) for r in minhash.keep_one(docs).collect()] == [(1, brute.SENTENCE, "en", "a")]


# --- 8: fuzzy lines

def links_of(names):
    """Pairs of lines by edit similarity alone: every pair is compared.

    Numbers of characters that one line has more of than the other bound the distance from
    below; only pairs that pass that need it worked out, on single-byte characters.
    """
    chars = sorted(set("".join(names)))
    assert len(chars) < 127
    byte = {ord(c): chr(i + 1) for i, c in enumerate(chars)}
    counts = np.array([[x.count(c) for c in chars] for x in names], np.int32)
    length = counts.sum(axis=1)
    pairs = []
    for i in range(len(names) - 1):
        most = np.floor(np.maximum(length[i], length[i + 1:]) * (1 - fuzzy_lines.SIMILARITY) + 1e-9)
        more = counts[i + 1:] - counts[i]
        least = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))
        pairs += [(i, int(j) + i + 1, int(most[j])) for j in np.flatnonzero(least <= most)]
    con = duckdb.connect()
    con.register("lines", pa.table({"i": list(range(len(names))), "s": [x.translate(byte) for x in names]}))
    con.register("pairs", pa.table({k: pa.array(v, pa.int64()) for k, v in zip("abm", zip(*pairs, strict=True), strict=True)}))
    return con.execute("SELECT a, b FROM pairs JOIN lines x ON x.i = a JOIN lines y ON y.i = b "
                       "WHERE levenshtein(x.s, y.s) <= m").fetchall()


def brute_lines(docs):
    """Dropped (doc_id, line) pairs, comparing every pair of lines by edit similarity alone."""
    nodes = {}
    for i, text in docs:
        for k, line in enumerate(fuzzy_lines.normal_lines(text)):
            if len(fuzzy_lines.tokens_in(line).split()) >= fuzzy_lines.MIN_TOKENS:
                nodes.setdefault(line.decode(), []).append((i, k))
    names = list(nodes)
    parent = list(range(len(names)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, j in links_of(names):
        p, q = root(i), root(j)
        parent[max(p, q)] = min(p, q)
    groups = {}
    for i, x in enumerate(names):
        groups.setdefault(root(i), []).extend(nodes[x])
    return {p for g in groups.values() for p in g if p != min(g)}


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fuzzy_rows():
    rng = random.Random(8)
    base = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = []
    for i in range(80):
        line = list(base)
        for _ in range(i % 4):
            line[rng.randrange(len(line))] = rng.choice("xyz")
        extra = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(12))
        rows.append((i, f"{extra}\n{''.join(line).upper() if i % 5 == 0 else ''.join(line)}!\nshort line"))
    return rows


def test_fuzzy_lines_equal_brute_force(spark, small):
    """Against every pair compared by edit similarity alone, without blocks or SimHash."""
    for docs in (fuzzy_rows(), [(r.doc_id, r.text) for r in small]):
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = {(r.doc_id, k) for r in fuzzy_lines.dropped_lines(df).collect() for k in r.dropped}
        want = brute_lines(docs)
        assert got <= want and len(got) >= 0.98 * len(want) > 0


def test_edit_limits_equal_the_distance(spark):
    rng = random.Random(6)
    pairs = [("", ""), ("a", ""), ("a b c", "a c"), ("a b", "b a b"), ("x a", "a"), ("a a a", "a a"), ("é b", "e b c")]
    for _ in range(300):
        w = [rng.choice("ab") * rng.randint(1, 3) for _ in range(rng.randint(1, 9))]
        v = list(w)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(v) + 1)
            v[i:i + rng.randint(0, 1)] = [rng.choice(["a", "bb", "c"])] * rng.randint(0, 2)
        pairs.append((" ".join(w), " ".join(v)))
    rows = [(a, b, m) for a, b in pairs for m in (0, 1, 2, 3, 5)]
    df = spark.createDataFrame(rows, "a string, b string, m int")
    got = df.select("*", fuzzy_lines.edit_limits(F.col("a"), F.col("b"), F.col("m")).alias("ok")).collect()
    assert all(r.ok == (edit(r.a, r.b) <= r.m) for r in got)


HAN = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜金生丽水玉出昆冈剑号巨阙珠称夜光果珍李柰菜重芥姜"


def edited(rng, line, words):
    """A line with a twentieth of its words, one at least, put in, left out, replaced or mistyped."""
    w = line.split(" ")
    for _ in range(max(1, len(w) // 20)):
        k, r = rng.randrange(len(w)), rng.random()
        if r < 0.5 or len(w[k]) > 20:
            i = rng.randrange(len(w[k]))
            w[k] = w[k][:i] + rng.choice(HAN if w[k][0] in HAN else "qxzk") + w[k][i + 1:]
        elif r < 0.7:
            w[k] = rng.choice(words)
        elif r < 0.85:
            w.insert(k, rng.choice(words))
        else:
            w.pop(k)
    return " ".join(w)


def test_recall_of_near_lines_by_length(spark):
    """At least nine of ten lines that edit similarity alone would drop, in each class of length."""
    rng = random.Random(4)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    lines = sorted({x.decode() for t in texts for x in fuzzy_lines.normal_lines(t)})
    words = sorted({w for x in lines for w in x.split()})
    classes = {(5, 9): [], (10, 19): [], (20, 39): [], (40, 400): []}
    for x in rng.sample(lines, len(lines)):
        for (lo, hi), of in classes.items():
            if lo <= len(x.split()) <= hi and len(of) < 120:
                of.append(x)
    classes["han"] = ["".join(rng.choices(HAN, k=rng.randint(12, 60))) for _ in range(120)]
    docs, kind = [], {}
    for name, of in classes.items():
        for x in of:
            for line in (x, edited(rng, x, words)):
                kind[len(docs)] = name
                docs.append((len(docs), line))
    want = {i for i, _ in brute_lines(docs)}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id for r in fuzzy_lines.dropped_lines(df).collect()}
    assert got <= want
    recall = {c: len([i for i in got if kind[i] == c]) / len([i for i in want if kind[i] == c]) for c in classes}
    print("recall by words in a line:", recall)
    assert all(len([i for i in want if kind[i] == c]) > 50 for c in classes)
    assert min(recall.values()) >= 0.9


def test_one_edit_leaves_a_block_of_short_lines():
    rng = random.Random(1)
    for n in range(5, 20):
        for _ in range(50):
            a = [f"{rng.choice('abcdef')}w{rng.randrange(500)}" for _ in range(n)]
            b = list(a)
            k = rng.randrange(n)
            b[k:k + rng.randint(0, 1)] = ["changed"][:rng.randint(0, 1)] if n > 5 else ["changed"]
            if len(b) > fuzzy_lines.SHORT:
                continue
            lines = [" ".join(x).encode() for x in (a, b)]
            _, _, blocks = fuzzy_lines.line_hashes(lines, np.array([len(a), len(b)]))
            x, y = blocks.to_pylist()
            assert set(x) & set(y)


def test_short_lines_with_two_edited_words_are_found(spark):
    """Blocks of all tokens but one alone missed these."""
    rng = random.Random(11)
    docs = []
    for n in range(5, 20):
        for _ in range(12):
            a = ["".join(rng.choices("abcdefghij", k=rng.randint(5, 9))) for _ in range(n)]
            b = list(a)
            for k in rng.sample(range(n), 2):
                b[k] = "x" + b[k][1:]
            docs += [(len(docs), " ".join(a)), (len(docs) + 1, " ".join(b))]
    want = brute_lines(docs)
    got = {(r.doc_id, k) for r in fuzzy_lines.dropped_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
           for k in r.dropped}
    assert got <= want and len(want) == len(docs) // 2 and len(got) >= 0.98 * len(want)


def test_every_pair_of_edited_tokens_leaves_a_block():
    rng = random.Random(2)
    for n in range(5, 20):
        a = [f"{rng.choice('abcdef')}w{rng.randrange(500)}" for _ in range(n)]
        for i in range(n):
            for j in range(i):
                b = [f"new{k}" if k in (i, j) else w for k, w in enumerate(a)]
                _, _, blocks = fuzzy_lines.line_hashes([" ".join(x).encode() for x in (a, b)], np.array([n, n]))
                x, y = blocks.to_pylist()
                assert set(x) & set(y)


def test_edit_distances_of_many_few_and_long_lines():
    """Many pairs share a table, few or long ones are worked out in the bits of a number."""
    rng = random.Random(12)

    def pair(size, alphabet):
        a = rng.choices(alphabet, k=size)
        b = list(a)
        for _ in range(rng.randint(0, max(2, size // 6))):
            k = rng.randrange(len(b) + 1)
            b[k:k + rng.randint(0, 1)] = rng.choices(alphabet, k=rng.randint(0, 1))
        return "".join(a), "".join(b)
    cases = [[pair(rng.randint(0, 70), "ab é天") for _ in range(fuzzy_lines.FEW_PAIRS * 4)],
             [pair(rng.randint(0, 70), "ab") for _ in range(20)],
             [pair(fuzzy_lines.LONG_LINE + 40, "abc ") for _ in range(3)]]
    for pairs in cases:
        a, b = (list(x) for x in zip(*pairs, strict=True))
        far = [edit(x, y) for x, y in pairs]
        for more in (-1, 0, 3):
            most = np.maximum(np.array(far) + more, 0)
            assert fuzzy_lines.within(a, b, most).tolist() == [d <= m for d, m in zip(far, most, strict=True)]


def test_large_buckets_are_compared_by_chunks(spark, monkeypatch):
    """Lines that share a passage and stay apart make no row a pair, and the same links."""
    rng = random.Random(21)

    def words(n):
        return ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(n)]
    passage = words(110)
    docs = [(i, " ".join(words(rng.randint(20, 26)) + passage)) for i in range(300)]
    docs += [(i + 500, f"{text} more") for i, text in docs[::6]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen, one = [], fuzzy_lines.verified
    monkeypatch.setattr(fuzzy_lines, "verified", lambda pairs, *rest: (seen.append(pairs.count()), one(pairs, *rest))[1])
    gone, rows = [], []
    for size in (32, 1_000):        # many chunks in the bucket; all pairs in rows of their own
        monkeypatch.setattr(fuzzy_lines, "CHUNK", size)
        gone.append({(r.doc_id, k) for r in fuzzy_lines.dropped_lines(df).collect() for k in r.dropped})
        rows.append(max(seen))
        seen.clear()
    assert gone[0] == gone[1] and len(gone[0]) >= 50
    # A row a node and bucket at most, for its centre.
    assert rows[0] <= fuzzy_lines.RUNS * len(docs) < rows[1], rows


def test_a_task_gives_the_blocks_of_a_line_once():
    line = " ".join(f"word{c}" for c in "abcdefgh")
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text_hash": [1, 2, 3], "text": [line, f"{line}\n{line}", "x " + line]})
    rows = pa.Table.from_batches(fuzzy_lines.lines_of(iter([batch]))).to_pylist()
    assert [bool(r["blocks"]) for r in rows] == [True, False, False, True]
    assert len({r["node"] for r in rows}) == 2 and set(rows[0]["blocks"]) & set(rows[3]["blocks"])


def short_edits(rng, line):
    """A line with as many letters changed, put in or left out as the similarity allows, one at least."""
    w = list(line)
    for _ in range(rng.randint(1, max(1, len(w) // 10))):
        k = rng.randrange(1, len(w))
        w[k:k + rng.randint(0, 1)] = rng.choices("abcdefgh ", k=rng.randint(0, 1))
    return " ".join("".join(w).split())


def test_similar_lines_of_few_tokens_have_a_letter_block():
    rng = random.Random(31)
    met = []
    for _ in range(1_500):
        a = " ".join("".join(rng.choices("abcdeé天 ", k=rng.randint(9, 98))).split())
        b = short_edits(rng, a)
        if 0 < len(a) <= 100 >= len(b) > 0 and a != b and edit(a, b) <= max(len(a), len(b)) // 10:
            of, block, odd = fuzzy_lines.letter_blocks([a.encode(), b.encode()], np.array([True, True]), fuzzy_lines.SIMILARITY)
            met.append(bool(set(block[of == 0]) & set(block[of == 1])))
            assert int(odd[0] ^ odd[1]).bit_count() <= 2 * edit(a, b)
    assert len(met) > 800 and all(met)


def test_lines_of_few_tokens_are_decided_like_all_others(spark, monkeypatch):
    """Such lines were left alone, equal ones too; also where edits make a line of more tokens of one."""
    rng = random.Random(32)
    docs = [(0, "menu\nhome\n\n--"), (1, "home\n\n--\nabout us"), (2, "About us!\nmenu"), (3, "item 12 of 30"), (4, "item 77 of 41")]
    for n in range(1, 5):
        for _ in range(25):
            a = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 26))) for _ in range(n))
            docs += [(len(docs), a), (len(docs) + 1, short_edits(rng, a))]
    # A family that no edit links, and those that link to it: compared by chunks.
    base = "".join(rng.choices("abcdefgh", k=70))
    docs += [(len(docs) + i, f"{base} {''.join(rng.choices('abcdefgh', k=25))}") for i in range(40)]
    docs += [(len(docs) + i, short_edits(rng, text)) for i, (_, text) in enumerate(docs[-10:])]
    want, df = brute_lines(docs), spark.createDataFrame(docs, "doc_id long, text string")
    assert {(1, 0), (2, 0), (2, 1), (4, 0)} <= want and len(want) > 60
    few = {i for i, text in docs if len(text.split()) < fuzzy_lines.FEW}
    for size in (8, 1_000):
        monkeypatch.setattr(fuzzy_lines, "CHUNK", size)
        got = {(r.doc_id, k) for r in fuzzy_lines.dropped_lines(df).collect() for k in r.dropped}
        assert got <= want and len(got) >= 0.98 * len(want)
        assert not {i for i, _ in want - got} & few


def test_queries_take_short_lines_of_all_scripts(spark, tmp_path):
    docs = spark.createDataFrame([(i, text, "zh", "s", len(text)) for i, text in enumerate([HAN[:4], f"{HAN[:4]}。", "天\nmenu", "menu\n天"])],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r.dropped_lines for r in QUERIES["op8_fuzzy_lines"](spark, str(tmp_path)).collect()}
    assert rows == {0: "", 1: "", 2: "", 3: "0,1"}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()} == {
        0: HAN[:4], 1: f"{HAN[:4]}。", 2: "天\nmenu"}
    copies = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10))
    assert {r.doc_id for r in fuzzy_lines.dropped_lines(copies, min_wide=1).collect()} == {3, 10, 11, 12, 13}


def test_lines_of_scripts_without_spaces(spark):
    docs = [(0, HAN[:30]), (1, HAN[:30]), (2, "天" + HAN[1:29] + "。"), (3, HAN[30:60]), (4, "ภาษาไทยไม่มีช่องว่างระหว่างคำ"),
            (5, "ภาษาไทยไม่มีช่องว่างระหว่างคำ"), (6, HAN[:4]), (7, HAN[:4])]
    out = fuzzy_lines.dropped_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in out} == {1, 2, 5}


def test_fuzzy_line_names(spark):
    docs = brute.edge_table(spark)
    for name in ("doc", "of_id", "of_hash", "text_hash", "__id", "line", "node"):
        docs = docs.withColumn(name, F.lit(name))
    rows = fuzzy_lines.dedup_lines(docs).drop("dropped")
    assert rows.columns == docs.columns and all(r.doc == "doc" and r.of_id == "of_id" for r in rows.collect())


def test_fuzzy_line_edges(spark):
    docs = brute.edge_table(spark)
    out = fuzzy_lines.dedup_lines(docs).collect()
    assert len(out) == docs.count()
    texts = {r.doc_id: r.text for r in out if r.doc_id is not None}
    # The null id orders first, so its near copy of the sentence is the one that stays.
    assert brute.SENTENCE + " again" in [r.text for r in out if r.doc_id is None]
    assert texts[1] == texts[2] == "" and texts[3] is None and texts[4] == ""
    assert texts[10] == "one\ntwo\n" and texts[6] == brute.LONG
    assert fuzzy_lines.dedup_lines(brute.table(spark, [])).count() == 0
    rows = QUERIES["op8_fuzzy_lines"](spark, SF_SMALL).collect()
    assert all(r.n_dropped == len(r.dropped_lines.split(",")) if r.n_dropped else r.dropped_lines == "" for r in rows)


def test_lines_under_null_and_repeated_ids_are_decided_apart(spark):
    lines = {c: " ".join(f"{c}{chr(97 + i)}word" for i in range(9)) for c in "abcdefgh"}
    a, b, c, d, e, f, g, h = lines.values()
    rows = [(1, a), (None, f"{b}\n{a}"), (None, f"{c}\n{d}"), (None, f"{e}\n{d}"),
            (7, f"{f}\n{b}"), (7, f"{g}\n{h}"), (8, h)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r.doc_id, r.text) for r in fuzzy_lines.dedup_lines(docs).collect()]
    assert len(out) == len(rows)
    left = [line for _, text in out for line in text.split("\n") if line]
    assert sorted(left) == sorted(lines.values())              # each line once: none lost, no copy left
    assert (1, "") in out and (None, f"{b}\n{a}") in out        # a null id orders first
    assert (7, f) in out and (7, f"{g}\n{h}") in out and (8, "") in out


# --- 1: Kneser-Ney

def brute_kneser_ney(trusted, texts):
    """Mean negative log probability per character by dictionaries of tuples."""
    n = kneser_ney.ORDER

    def grams(text):
        text = " ".join(text.split()) if text else ""
        if not text:
            return []
        codes = [2] * (n - 1) + [min(ord(c), 0xFFFF) for c in text] + [3]
        return [tuple(codes[i:i + n]) for i in range(len(codes) - n + 1)]
    count = {n: {}}
    for t in trusted:
        for g in grams(t):
            count[n][g] = count[n].get(g, 0) + 1
    for m in range(n - 1, 0, -1):
        count[m] = {}
        for g in count[m + 1]:
            count[m][g[1:]] = count[m].get(g[1:], 0) + 1
    model = {}
    for m in range(1, n + 1):
        c = [0] + [sum(v == k for v in count[m].values()) for k in (1, 2, 3, 4)]
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0
        d = [min(max(k - (k + 1) * y * c[k + 1] / c[k], 0.05), k) if c[1] and c[k] and c[k + 1] else 0.5 for k in (1, 2, 3)]
        total, mass = {}, {}
        for g, v in count[m].items():
            total[g[:-1]] = total.get(g[:-1], 0) + v
            mass[g[:-1]] = mass.get(g[:-1], 0) + d[min(v, 3) - 1]
        model[m] = (d, total, mass)

    def p(g):
        m = len(g)
        if not m:
            return 1 / (len(count[1]) + 1)
        d, total, mass = model[m]
        h = g[:-1]
        if h not in total:
            return p(g[1:])
        v = count[m].get(g, 0)
        return ((v - d[min(v, 3) - 1]) / total[h] if v else 0) + mass[h] / total[h] * p(g[1:])
    out = []
    for t in texts:
        g = grams(t)
        out.append(-sum(math.log(p(x)) for x in g) / len(g) if g else None)
    return out


def test_kneser_ney_equals_dictionaries(spark, small, monkeypatch):
    monkeypatch.setattr(kneser_ney, "BLOCK_BYTES", 50_000)      # several blocks and shards
    some = small[:60]
    docs = spark.createDataFrame([(r.doc_id, r.lang, r.text[:600]) for r in some] + [(9999, "en", "zq ☃ 𝄞"), (None, None, "The")],
                                 "doc_id long, lang string, text string")
    good = [r.doc_id for r in some if r.doc_id % 2]
    ids = spark.createDataFrame([(i,) for i in good + good[:3] + [None]], "doc_id long")
    rows = kneser_ney.classify(docs, ids).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    want = brute_kneser_ney([text[i] for i in good], [text[r.doc_id] for r in rows])
    assert len(rows) == 62
    for r, w in zip(rows, want):
        assert math.isclose(r.nats, w, rel_tol=1e-4)
        assert r.trusted == (r.doc_id in good) and math.isclose(r.perplexity, math.exp(r.nats))


def test_kneser_ney_keeps_clean_and_drops_junk(spark):
    rows = QUERIES["op1_kneser_ney"](spark, SF_CHECK).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
    kept = {q: [r.kept for r in rows if labels.get(r.doc_id) == q] for q in (0, 1)}
    assert np.mean(kept[1]) > 0.97 and np.mean(kept[0]) < 0.25


def test_kneser_ney_edges(spark):
    docs = brute.edge_table(spark)
    rows = kneser_ney.classify(docs, docs.select("doc_id")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.nats is None) == (r.n_chars == 0)
        assert r.kept or r.nats is None or r.perplexity > r.threshold
    blind = kneser_ney.classify(docs, docs.where("false")).collect()
    assert all(r.kept == (r.nats is not None) and r.threshold is None for r in blind)
    assert kneser_ney.classify(docs.where("false"), docs.select("doc_id")).count() == 0


# --- 2: token rollups

def encoders():
    import base64

    import tiktoken
    out = {}
    for path in token_rollup.VOCABULARIES:
        version, content = token_rollup.load_vocabulary(path)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        out[version] = tiktoken.Encoding(version, pat_str=token_rollup.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return out


def direct(rows, enc):
    out = {}
    for source, lang, text in rows:
        for v, e in enc.items():
            docs, tokens = out.get((source, lang, v), (0, 0))
            out[source, lang, v] = docs + 1, tokens + len(e.encode_ordinary(text or ""))
    return out


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_rollup_follows_inserts_revisions_and_deletes(spark, tmp_path, small):
    enc, rollup = encoders(), token_rollup.TokenRollup(spark, str(tmp_path / "rollup"))
    schema = "doc_id long, source string, lang string, text string, deleted boolean"

    def batch(rows):
        return spark.createDataFrame([(*r, False)[:5] if len(r) == 4 else r for r in rows], schema)
    state = {r.doc_id: (r.source, r.lang, r.text) for r in small[:40]} | {500: (None, None, None), 501: ("s", "en", "")}
    load = batch([(i, *v) for i, v in state.items()])
    assert rollup.commit("b1", load) and not rollup.commit("b1", load)
    assert totals(rollup) == direct(state.values(), enc)
    change = [(0, "moved", "xx", "new text here", False), (1, None, None, None, True), (600, "s", "en", "added", None),
              (777, None, None, None, True), (2, *state[2], False)]
    state |= {0: change[0][1:4], 600: change[2][1:4]}
    del state[1]
    assert rollup.commit("b2", batch(change)) and not rollup.commit("b2", batch(change))
    assert totals(rollup) == direct(state.values(), enc)
    # A batch that died between its deltas and its sums doesn't count, and is then written anew.
    load.limit(3).selectExpr("doc_id", "source", "lang", "'t' AS tokenizer", "1L AS docs", "9L AS tokens").write.parquet(
        f"{rollup.path}/deltas/batch=b3")
    assert totals(rollup) == direct(state.values(), enc)
    assert rollup.commit("b3", batch([(600, None, None, None, True)]))
    del state[600]
    assert totals(rollup) == direct(state.values(), enc)
    assert rollup.commit("b4", load.where("false")) and totals(rollup) == direct(state.values(), enc)


def test_rollup_query_and_edges(spark, tmp_path, small):
    enc = encoders()
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in QUERIES["op2_token_rollup"](spark, SF_SMALL).collect()}
    assert got == direct([(r.source, r.lang, r.text) for r in small], enc)
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "edges"))
    rollup.commit("x", brute.edge_table(spark))
    rows = {r: None for r in brute.edge_rows()}      # the repeated row counts once
    assert totals(rollup) == direct([(r[3], r[2], r[1]) for r in rows], enc)


def test_long_texts_are_counted_exactly(monkeypatch):
    enc = next(iter(encoders().values()))
    text = "Some words,  with  odd   spaces\n\n and 12 numbers's " * 300
    monkeypatch.setattr(token_rollup, "PART", 1000)
    parts = list(token_rollup.parts_of(text))
    assert "".join(parts) == text and len(parts) > 5
    assert sum(len(enc.encode_ordinary(p)) for p in parts) == len(enc.encode_ordinary(text))
