"""Operators 11, 12 and 13: dual-tree search, Merkle manifest, URL rules, against plain Python."""

import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm import dual_tree, merkle, url_rules
from almanac.llm.queries import QUERIES, SQL

from ..conftest import SF_SMALL
from . import brute


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name, tables", [("op11_dual_tree", ("documents", "benchmark")),
                                          ("op12_merkle_manifest", ("documents",))])
def test_equals_its_sql(spark, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    df, want = QUERIES[name](spark, SF_SMALL), con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(rows_of(df.select(*columns))) == sorted(want.fetchall())


# --- 11: search

def search_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", brute.bytes_lower(text))


def ranked(docs, items, k):
    """item_id -> [(doc_id, score)], by scoring every document."""
    counts = [(i, search_terms(t)) for i, t in docs]
    counts = [(i, w, {x: w.count(x) for x in set(w)}) for i, w in counts if w]
    n_docs, length = len(counts), sum(len(w) for _, w, _ in counts)
    df = {}
    for _, _, c in counts:
        for x in c:
            df[x] = df.get(x, 0) + 1
    asked, out = {}, {}
    for item_id, text in items:
        if item_id is not None:
            asked.setdefault(item_id, set()).update(search_terms(text))
    for item_id, terms in asked.items():
        found = []
        for i, w, c in counts:
            m = 10 + (90 * len(w) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                        * ((1000000000 * c[x]) // (1000 * c[x] + 8 * m)) for x in terms if x in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out[item_id] = [(i, -s) for s, _, _, i in sorted(found)[:k]]
    return out


def check_search(spark, docs, items, k=3):
    got = {}
    for r in dual_tree.search(docs, items, k).orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(got[r.item_id])
    want = ranked([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], k)
    assert got == {i: v for i, v in want.items() if v}


def test_search_edges(spark):
    items = spark.createDataFrame([("a", "fox lazy DOG"), ("b", None), ("c", " $% "), (None, "fox"), ("d", "où w3x3 zebra"),
                                   ("a", "today"), ("e", "nowhere")], "item_id string, text string")
    docs = brute.edge_table(spark)
    check_search(spark, docs, items)
    check_search(spark, docs.where("doc_id = 6"), items)
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (docs.where("text IS NULL"), items)):
        assert dual_tree.search(d, i).count() == 0


def test_search_of_copies_and_ties(spark):
    rnd = random.Random(5)
    words = [f"w{int(rnd.paretovariate(0.7)) % 300}" for _ in range(4000)]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(300)] + [(-3, docs[7][1]), (None, docs[7][1])]
    items = [(i, docs[i * 3][1]) for i in range(40)] + [(99, docs[7][1]), (100, " ".join(set(words)))]
    check_search(spark, spark.createDataFrame(docs, "doc_id long, text string"),
                 spark.createDataFrame(items, "item_id long, text string"), k=10)


@pytest.mark.parametrize("dtype", [np.float64, np.int64])
def test_walk_prunes_and_is_exact(dtype):
    """Clustered documents: most pairs are never scored, and nothing is lost."""
    rng = np.random.default_rng(3)
    clusters, width, n, k = 40, 400, 40 * 64, 5
    dense = np.zeros((n, width), np.int64)
    for d in range(n):
        own = (d // 64) * 10 + rng.choice(10, 4, replace=False)
        dense[d, own] = rng.integers(1, 1000, 4)
    items = np.zeros((clusters, width), dtype)
    for i in range(clusters):
        items[i, i * 10 + rng.choice(10, 3, replace=False)] = rng.integers(1, 30, 3)
    ids = rng.permutation(n).astype(np.int64)
    rows, cols = np.nonzero(dense)
    tops, scored = dual_tree.dual_tree(k, items, rows, cols, dense[rows, cols].astype(dtype), ids,
                                       np.zeros(clusters, np.int64), np.full(clusters, -1, np.int64))
    for i in range(clusters):
        scores = dense @ items[i].astype(np.int64)
        want = sorted((-int(s), int(ids[d]), d) for d, s in enumerate(scores) if s > 0)[:k]
        assert tops.best[i] == want
    assert scored < 0.1 * n * clusters


def test_search_does_not_depend_on_node_sizes(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text")
    want = sorted(rows_of(dual_tree.search(docs, items)))
    for shelf, block in ((16, 8), (1, 40)):
        monkeypatch.setattr(dual_tree, "SHELF", shelf)
        monkeypatch.setattr(dual_tree, "BLOCK", block)
        assert sorted(rows_of(dual_tree.search(docs, items))) == want


# --- 12: manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def brute_leaf(r, text=None):
    values = [r[f] for f in FIELDS[:-1]] + [r["text"] if text is None else text]
    return brute.sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(nodes):
    """(root, witnesses as [(place, siblings)]) by building all levels."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 16] for i in range(0, len(nodes), 16)]
        for s, i in zip(steps, at, strict=True):
            run, place = runs[i // 16], i % 16
            s.append((place, "".join(run[:place] + run[place + 1:])))
        at, nodes = [i // 16 for i in at], [brute.sha("".join(r)) for r in runs]
    return (nodes[0] if nodes else None), steps


def brute_manifest(ordered):
    """source -> rows in order; -> {(source, position): (leaf, subroot, root, steps)}."""
    names = sorted((s for s in ordered if s is not None), key=str.encode)
    names = ([None] if None in ordered else []) + names
    trees = {s: brute_tree([brute_leaf(r) for r in ordered[s]]) for s in names}
    root, tops = brute_tree([trees[s][0] for s in names])
    return {(s, i): (brute_leaf(r), trees[s][0], root, trees[s][1][i] + tops[n])
            for n, s in enumerate(names) for i, r in enumerate(ordered[s])}


def in_order(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r))):
        out.setdefault(r["source"], []).append(r)
    return out


def check_manifest(manifest, ordered):
    want = brute_manifest(ordered)
    got = {(None if r.tree == "-" else r.tree[1:], r.position): (
        r.leaf, r.subroot, r.root, list(zip(r.places, r.siblings, strict=True))) for r in manifest.witnesses().collect()}
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 255, 256, 257, 4095, 4096])
def test_open_tree_equals_all_levels(n):
    nodes = [brute.sha(str(i)) for i in range(n)]
    if n:
        assert merkle.streamed(nodes, n) == brute_tree(nodes)


def test_manifest_of_many_blocks(spark, tmp_path):
    """Two rounds of blocks in one source, a source of exactly one block, one of one row."""
    docs = [(i, "t", "big", None, i) for i in range(2 * merkle.BLOCK + 17)]
    docs += [(i, str(i), "one", "x", 1) for i in range(merkle.BLOCK)] + [(5, None, None, None, None), (6, "q", "zß", "en", 3)]
    random.Random(1).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long")
    manifest = merkle.Manifest(spark, str(tmp_path / "m"))
    assert manifest.append("a", df) and not manifest.append("a", df)
    check_manifest(manifest, in_order([r.asDict() for r in df.collect()]))


def test_appends_extend_witnesses(spark, tmp_path, monkeypatch):
    """Batches that leave blocks open, complete them, go past them; what is complete isn't hashed again."""
    monkeypatch.setattr(merkle, "BLOCK", 16)
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    manifest, ordered, at = merkle.Manifest(spark, str(tmp_path / "m")), {}, 0
    for batch, sizes in enumerate([(3, 16, 0), (12, 1, 5), (1, 0, 11), (40, 40, 1), (0, 0, 0)]):
        docs = []
        for source, n in zip(("a", None, "c"), sizes, strict=True):
            docs += [(at + i, f"text {at + i}", source, "en", i) for i in range(n)]
            at += n
        df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long")
        manifest.append(str(batch), df)
        for source, rows in in_order([r.asDict() for r in df.collect()]).items():
            ordered.setdefault(source, []).extend(rows)
        check_manifest(manifest, ordered)
    hashed = spark.read.schema(merkle.ROOTS).parquet(f"{manifest.path}/roots/batch=3")
    assert hashed.where("tree = 'sa' AND block = 0").count() == 0       # complete before the batch
    assert hashed.where("tree = 'sc' AND block = 1").count() == 1       # opened again or begun


def test_half_written_batch_is_redone_and_a_stream_appends(spark, tmp_path):
    df = brute.edge_table(spark).select(*FIELDS)
    manifest = merkle.Manifest(spark, str(tmp_path / "m"))
    spark.range(3).write.parquet(f"{manifest.path}/leaves/batch=stream-0")       # died before its roots
    df.write.parquet(str(tmp_path / "in"))
    (spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(manifest.appender())
     .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination())
    check_manifest(manifest, in_order([r.asDict() for r in df.collect()]))


def test_manifest_query_and_empty_table(spark, tmp_path):
    docs = brute.edge_table(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(got) == docs.count()
    for r in got:
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        texts = [d.text for d in docs.where(F.col("doc_id").eqNullSafe(r.doc_id)).collect()]
        changed = any(t and brute.bytes_lower(t) != t for t in texts)
        assert r.verified == (r.folded_root == r.root) and (r.verified or (hit and changed))
    empty = str(tmp_path / "empty")
    docs.where("false").write.parquet(f"{empty}/documents.parquet")
    assert merkle.op12_merkle_manifest(spark, empty).count() == 0


# --- 13: URL rules

LISTED = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
          ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def brute_listed(url):
    """(host, path, rule, verdict) by the contract's words."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    host = brute.bytes_lower(host)
    fits = [(len(h + p), h + p, v) for v, h, p in LISTED
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = [None, "", "x", "://", "http://", "http://A.ORG", "http://a.org/", "HTTP://Example.ORG/es/x?q#f", "http://xexample.org/es/",
        "http://example.org/es", "http://m.example.org/en/12", "http://example.org/en/2", "http://a.com/fr/1", "http://a.com/de/1",
        "http://com/de/", "http://com?x=/de/", "a://b://c.org/p", "http://é.org/ü\n/x", "http://a.org?x#y/z", "https://spam-farm.example.net/en/1"]


def test_listed_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[7], None)] * 2,
                                  "page_id long, url string, host string")
    none = url_rules.mine(spark.createDataFrame([], "url string, bad boolean"))
    got = url_rules.judge(pages.withColumn("tokens", F.lit(1)).withColumn("page", F.lit(2)), none).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path, rule, verdict = brute_listed(r.url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), r.url
        assert (r.tokens, r.page) == (1, 2)


def test_rules_equal_counting_all_combinations(spark):
    rnd = random.Random(2)
    hosts = ["spam-farm.example.net", "good.example.net", "news.example.com", "cheap-pills.example.com"]
    rows = []
    for i in range(300):
        h, q = rnd.choice(hosts), rnd.choice(["", "?page=2&ref=x", "?utm_source=feed"])
        bad = rnd.random() < (0.9 if "spam" in h else 0.85 if "pills" in h and q else 0.1)
        rows.append((f"https://{h}/{rnd.choice(['en', 'fr'])}/{i}{q}", bad))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    sets = [(frozenset(r.t), r.bad) for r in df.select(url_rules.tokens_of(F.col("url")).alias("t"), "bad").collect()]
    counts = {}
    for s, bad in sets:
        items = sorted(s)
        for mask in range(1, 1 << len(items)):
            sub = frozenset(x for j, x in enumerate(items) if mask >> j & 1)
            n, b = counts.get(sub, (0, 0))
            counts[sub] = n + 1, b + bad
    n_bad = sum(b for _, b in sets)
    sure = {s: b / n for s, (n, b) in counts.items()
            if b >= 8 and b >= math.ceil(0.05 * n_bad) and b / n >= 0.7}
    want = {s: c for s, c in sure.items() if not any(o < s and sure[o] >= c for o in sure)}
    rules = url_rules.mine(df, min_support=0.05, min_count=8, min_confidence=0.7)
    got = {frozenset(r["items"]): (r.confidence, r.support) for r in rules.collect()}
    assert {s: c for s, (c, _) in got.items()} == pytest.approx(want) and want
    assert all(got[s][1] == counts[s][1] for s in got)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    for r, (s, _) in zip(url_rules.judge(pages, rules, ()).orderBy("page_id").collect(), sets, strict=True):
        assert r.verdict == ("block" if any(x <= s for x in want) else "allow")


def test_labels(spark):
    pages = spark.createDataFrame([(9, "http://a.org/en/1.html"), (8, "http://a.org/en/2/"), (1, "http://a.org/en/3?x=1"),
                                   (2, "http://a.org/en"), (3, None), (4, "http://a.org/en/1#5")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, None), (3, 0, 0), (5, 0, 0), (None, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    got = sorted(rows_of(url_rules.labelled(pages, labels)))
    assert got == [("http://a.org/en/1#5", True), ("http://a.org/en/1.html", True), ("http://a.org/en/2/", False),
                   ("http://a.org/en/3?x=1", True)]


def test_url_query(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op13_url_rules"](spark, SF_SMALL).collect()}
    assert len(got) == len(pages)
    for p in pages:
        host, path, rule, verdict = brute_listed(p.url)
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.mined else "allow"))
