"""Benchmark decontamination (operator 10).

One Aho-Corasick automaton holds every 10-word window of the normalised
benchmark texts; each document is normalised, scanned once from end to end, and
every occurrence is mapped back to code points of the original text.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, that is
ASCII digits and letters and everything outside ASCII. On UTF-8 bytes that rule
is one table look-up per byte, so normalising costs no regular expression.

Size: the automaton grows with the benchmark and never with the documents. Its
input is measured first; beyond ``chunk_words`` benchmark words the items are
dealt over several automata by a hash, each within the bound, and a document is
scanned once per automaton. No item is ever left out.

Edge cases: a null or empty text has no words and no hits; null, empty or
wordless items have no window; repeated items or ids count once per item id; a
null item id is skipped; an empty benchmark leaves every document clean;
documents keep all their other columns, whatever their names, and repeated or
null ``doc_id`` rows are scanned row by row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

WINDOW = 10
CHUNK_WORDS = 40_000
# Normalisation by byte: A-Z to a-z, other ASCII but 0-9 and a-z to a space.
_WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz"
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _WORD_BYTES else 32
              for b in range(256))
ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
HITS = "n_words long, hits array<struct<first:long,last:long,start:long,end:long,item_id:string>>"


def normalised(text: str | None) -> str:
    """`` word word ... `` with one space around each word, one char per byte."""
    if not text:
        return " "
    words = text.encode("utf-8", "surrogatepass").translate(TABLE).split()
    return f" {b' '.join(words).decode('latin-1')} " if words else " "


def windows(text: str | None, size: int = WINDOW) -> set[str]:
    """Normalised windows of ``size`` consecutive words; a shorter text is one."""
    words = normalised(text).split(" ")[1:-1]
    last = max(len(words) - size, 0)
    return {f" {' '.join(words[i:i + size])} " for i in range(last + 1)} if words else set()


def automaton(items: list[tuple[str, str]], size: int) -> ahocorasick.Automaton | None:
    """Automaton over the windows of ``items``; a window's value is the ids that hold it."""
    ids: dict[str, set[str]] = {}
    for item_id, text in items:
        for w in windows(text, size):
            ids.setdefault(w, set()).add(item_id)
    if not ids:
        return None
    out = ahocorasick.Automaton()
    for w, of in ids.items():
        out.add_word(w, (len(w), w.count(" ") - 1, sorted(of)))
    out.make_automaton()
    return out


def occurrences(scan: ahocorasick.Automaton | None, text: str | None):
    """(number of words, merged occurrences per item as word and code-point ranges)."""
    norm = normalised(text)
    n = norm.count(" ") - 1 if len(norm) > 1 else 0
    found: dict[str, list[list[int]]] = {}
    at, word = 0, 0   # words begin after spaces; `word` is the number of spaces before `at`
    ends = [] if scan is None else scan.iter(norm)
    for end, (length, words, ids) in ends:
        stop = end - 1                      # the closing space may open the next word
        word += norm.count(" ", at, stop)
        at = stop
        first, last = word - words, word    # spaces before the last char, less the window
        for item in ids:
            spans = found.setdefault(item, [])
            if spans and first <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], last)
            else:
                spans.append([first, last])
    if not found:
        return n, []
    place = [m.span() for m in ORIGINAL_WORD.finditer(text)]
    return n, [(a, b, place[a][0], place[b - 1][1], item)
               for item in sorted(found) for a, b in found[item]]


def scan_column(spark: SparkSession, items: list[tuple[str, str]], size: int):
    """A UDF text -> (n_words, hits) over one broadcast chunk of the benchmark."""
    shared = spark.sparkContext.broadcast(items)

    @F.pandas_udf(HITS)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        built = automaton(shared.value, size)
        for batch in texts:
            rows = [occurrences(built, t if isinstance(t, str) else None) for t in batch]
            yield pd.DataFrame({
                "n_words": pd.Series([r[0] for r in rows], dtype="int64"),
                "hits": pd.Series([[dict(zip(("first", "last", "start", "end", "item_id"), h, strict=True))
                                    for h in r[1]] for r in rows], dtype=object)})
    return scan


def covered(hits: Column) -> Column:
    """Words inside the union of the hits' word ranges."""
    ranges = F.array_sort(F.transform(hits, lambda h: F.struct(h["first"].alias("a"), h["last"].alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(
        ranges, zero,
        lambda s, r: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("long"), r["b"] - F.greatest(r["a"], s["to"]))).alias("n"),
            F.greatest(s["to"], r["b"]).alias("to")),
        lambda s: s["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, size: int = WINDOW,
                  chunk_words: int = CHUNK_WORDS, into: str = "scan") -> DataFrame:
    """``docs`` with a struct column ``into`` (in place of one of this name): ``n_words``, ``n_hit`` and ``hits``.

    ``hits`` lists, per benchmark item, the merged occurrences as word ranges
    [first, last) and code-point ranges [start, end) of the original text.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(
        F.col("item_id").isNotNull() & F.col("text").isNotNull())
    # A bound on the words: at most one per two bytes, and measured before anything is shared.
    total = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    chunks = max(1, -(-int(total) // chunk_words))
    chunk = F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks))
    out, parts = docs.select(F.struct("*").alias("doc"), "text"), []
    for c in range(chunks):
        rows = [(r.item_id, r.text) for r in items.where(chunk == c).toLocalIterator()]
        parts.append(f"scan_{c}")
        out = out.withColumn(parts[-1], scan_column(spark, rows, size)("text"))
    hits = F.flatten(F.array(*[F.col(p)["hits"] for p in parts]))
    return out.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c != into], F.struct(
        F.col(parts[0])["n_words"].alias("n_words"), covered(hits).alias("n_hit"), hits.alias("hits")).alias(into))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark's 10-word windows."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    out = decontaminate(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))
    ids = F.array_sort(F.array_distinct(F.transform("scan.hits", lambda h: h["item_id"])))
    return out.select(
        "doc_id", F.col("scan.n_words").alias("n_words"), F.col("scan.n_hit").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("scan.n_hit") > 0).alias("contaminated"))
