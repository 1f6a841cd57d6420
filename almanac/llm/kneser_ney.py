"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model (operator 1).

The model is a character ``ORDER``-gram model, so it has no unknown words in any
language. It is trained on all trusted texts. Documents that are less likely than
a quantile of the trusted documents of their own language are not kept.

How the counts are joined. Characters are 16-bit codes, so a 4-gram is exactly one
long. Documents are dealt into blocks of about ``BLOCK_BYTES`` by a hash of their
id; a block's distinct 4-grams, with their trusted counts, are dealt into shards by
a hash of the 4-gram. Shards sum the counts; from the sums the discounts, context
totals, back-off weights and interpolated probabilities of all orders are made with
DataFrame joins; shards then answer each block's list, and blocks score their
documents. A block asks for each 4-gram once, however often its texts have it,
so what is shuffled is a small share of the n-grams in the texts.

Size: blocks and shards grow in number with the input, not in size; a task holds
one block's packed texts or one shard's lists. Texts travel zstd-packed. Discounts
(three numbers an order) are all that reaches the driver.

Edge cases: a null, empty or blank text has perplexity null and isn't kept; with no
trusted text every character is equally likely and thresholds are null: then
every text with a character is kept; a language without ``MIN_TRUSTED`` trusted
documents, and a null one, has the threshold of all; null ids are scored, never
trusted; repeated rows count and are scored each; characters beyond the 16-bit
plane share one code; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, written
from .wordhash import mixed

ORDER = 4
QUANTILE = 0.99
SLACK = 0.05             # allowed above the quantile, in nats per character
NOISE = 2.0              # a mean over n characters is judged less NOISE / sqrt(n): short texts vary more
MIN_TRUSTED = 50
BLOCK_BYTES = 16_000_000
PACK_BYTES, HELD_BYTES = 1_000_000, 48_000_000
START, END = 2, 3        # codes before and after a text
BIN = 0.001              # width of the histogram that quantiles are read from
SCORED = "doc_id long, lang string, trusted boolean, n_chars long, nats double"


def grams_of(text: str | None) -> np.ndarray:
    """The text's 4-grams as unsigned longs, one per character and one for the end."""
    text = " ".join(text.split()) if isinstance(text, str) else ""
    if not text:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate([[START] * (ORDER - 1), np.minimum(codes, 0xFFFF), [END]]).astype(np.uint64)
    n, out = len(codes) - ORDER + 1, np.zeros(len(codes) - ORDER + 1, np.uint64)
    for j in range(ORDER):
        out = (out << np.uint64(16)) | codes[j:j + n]
    return out


def packed(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, docs): zstd-packed lists of (doc_id, lang, text)."""
    key = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.xxhash64("text"))
    rows = docs.select(F.pmod(key, F.lit(blocks)).cast("int").alias("block"),
                       F.col("doc_id").cast("long"), "lang", "text")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        size: dict[int, int] = {}
        squeeze = zstandard.ZstdCompressor(level=9)

        def given(numbers):
            numbers = list(numbers)
            out = pd.DataFrame({"block": numbers, "docs": [squeeze.compress(pickle.dumps(held.pop(b))) for b in numbers]})
            for b in numbers:
                del size[b]
            return out

        for batch in batches:
            for block, doc_id, lang, text in zip(batch.block, batch.doc_id.astype(object), batch.lang, batch.text,
                                                 strict=True):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                held.setdefault(block, []).append((doc_id, lang, text))
                size[block] = size.get(block, 0) + len(text or "") + 64
                if size[block] > PACK_BYTES:
                    yield given([block])
            if sum(size.values()) > HELD_BYTES:
                yield given(held)
        if held:
            yield given(held)
    return rows.mapInPandas(pack, "block int, docs binary")


def unpacked(rows: pd.DataFrame) -> Iterator[tuple]:
    for blob in rows.docs:
        yield from pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def squeezed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.tobytes())


def loosened(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def differences(keys: np.ndarray) -> bytes:
    """Sorted keys, packed as their differences."""
    return squeezed(np.diff(keys, prepend=np.uint64(0)))


def keys_from(blob: bytes) -> np.ndarray:
    return np.cumsum(loosened(blob, np.uint64), dtype=np.uint64)


def block_lists(texts: DataFrame, trusted_ids: DataFrame, blocks: int, shards: int) -> DataFrame:
    """(block, shard, grams, counts): each block's distinct 4-grams and their trusted counts."""
    def listed(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        good = set(right.doc_id)
        seen, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting: list[tuple[np.ndarray, int]] = []

        def merge():
            nonlocal seen, times
            every = np.concatenate([seen, *(g for g, _ in waiting)])
            count = np.concatenate([times, *(np.full(len(g), t, np.int64) for g, t in waiting)])
            seen, at = np.unique(every, return_inverse=True)
            times = np.bincount(at, weights=count, minlength=len(seen)).astype(np.int64)
            waiting.clear()

        n = 0
        for doc_id, _, text in unpacked(left):
            g = grams_of(text)
            waiting.append((g, int(doc_id in good)))
            n += len(g)
            if n > 1_000_000:
                merge()
                n = 0
        merge()
        shard = (mixed(seen) % np.uint64(shards)).astype(np.int32)
        out = [(key[0], s, differences(seen[shard == s]), squeezed(times[shard == s])) for s in np.unique(shard)]
        return pd.DataFrame(out, columns=["block", "shard", "grams", "counts"])

    ids = trusted_ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "doc_id")
    return texts.groupBy("block").cogroup(ids.groupBy("block")).applyInPandas(
        listed, "block int, shard int, grams binary, counts binary")


def summed(lists: DataFrame) -> DataFrame:
    """(shard, gram, n): every 4-gram of the corpus with its trusted count, 0 included."""
    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys = [keys_from(b) for b in rows.grams]
        seen, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([loosened(b, np.int64) for b in rows.counts]), minlength=len(seen))
        return pd.DataFrame({"shard": key[0], "gram": seen.view(np.int64), "n": n.astype(np.int64)})
    return lists.groupBy("shard").applyInPandas(add, "shard int, gram long, n long")


def context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, 16)


def suffix(gram: Column, order: int) -> Column:
    """The last ``order - 1`` characters of a gram of ``order``."""
    return gram.bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more."""
    r = counts.agg(*[F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n = [0, *(float(x or 0) for x in r)]
    if not n[1]:
        return 0.5, 0.5, 0.5
    y = n[1] / (n[1] + 2 * n[2])
    return tuple(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k) if n[k] and n[k + 1] else 0.5 for k in (1, 2, 3))


def orders(counts: DataFrame) -> tuple[dict[int, DataFrame], dict[int, DataFrame], float]:
    """Probability tables (gram, p) and back-off tables (ctx, gamma) by order, and p of an unseen character."""
    level = {ORDER: counts.where("n > 0").select("gram", "n")}
    for m in range(ORDER - 1, 0, -1):       # continuation counts: distinct characters before
        level[m] = written(level[m + 1].groupBy(suffix(F.col("gram"), m + 1).alias("gram")).agg(
            F.count("*").alias("n")), f"order-{m}")
    unseen = 1.0 / (level[1].count() + 1)
    p, back = {}, {}
    for m in range(1, ORDER + 1):
        d = discounts(level[m])
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = level[m].withColumn("ctx", context(F.col("gram")))
        back[m] = written(rows.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum(off).alias("mass")).select(
            "ctx", "total", (F.col("mass") / F.col("total")).alias("gamma")), f"context-{m}")
        of = rows.join(back[m], "ctx").withColumn("own", (F.col("n") - off) / F.col("total"))
        if m == 1:
            p[m] = of.select("gram", (F.col("own") + F.col("gamma") * unseen).alias("p"))
        else:
            lower = p[m - 1].select(F.col("gram").alias("shorter"), F.col("p").alias("q"))
            p[m] = of.withColumn("shorter", suffix(F.col("gram"), m)).join(lower, "shorter").select(
                "gram", (F.col("own") + F.col("gamma") * F.col("q")).alias("p"))
        p[m] = written(p[m], f"probability-{m}")
    return p, back, unseen


def log_probabilities(grams: DataFrame, p: dict[int, DataFrame], back: dict[int, DataFrame], unseen: float) -> DataFrame:
    """(shard, gram, logp) for all 4-grams: the longest known gram, times the back-off weights above it."""
    out = grams.select("shard", "gram", F.col("gram").alias("g"))
    value = F.lit(unseen) * F.coalesce("gamma1", F.lit(1.0))
    for m in range(ORDER, 0, -1):
        out = out.withColumn("ctx", context(F.col("g")))
        out = out.join(p[m].select(F.col("gram").alias("g"), F.col("p").alias(f"p{m}")), "g", "left")
        out = out.join(back[m].select("ctx", F.col("gamma").alias(f"gamma{m}")), "ctx", "left")
        out = out.withColumn("g", suffix(F.col("g"), m)).drop("ctx")
    for m in range(1, ORDER + 1):
        lower = value if m == 1 else F.coalesce(f"gamma{m}", F.lit(1.0)) * value
        value = F.coalesce(f"p{m}", lower)
    return out.select("shard", "gram", F.log(value).alias("logp"))


def answers(lists: DataFrame, logs: DataFrame) -> DataFrame:
    """(block, grams, logs): every block's lists, answered by the shards."""
    def look_up(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(right.gram.to_numpy().view(np.uint64))
        keys, logp = right.gram.to_numpy().view(np.uint64)[order], right.logp.to_numpy()[order]
        return pd.DataFrame({"block": left.block, "grams": left.grams, "logs": [
            squeezed(logp[np.searchsorted(keys, keys_from(b))].astype(np.float32)) for b in left.grams]})
    return lists.select("block", "shard", "grams").groupBy("shard").cogroup(logs.groupBy("shard")).applyInPandas(
        look_up, "block int, grams binary, logs binary")


def scored(texts: DataFrame, answered: DataFrame, trusted_ids: DataFrame, blocks: int) -> DataFrame:
    """Every document with its mean negative log probability per character."""
    ids = trusted_ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "doc_id",
                             F.lit(None).cast("binary").alias("grams"), F.lit(None).cast("binary").alias("logs"))
    both = answered.select("block", F.lit(None).cast("long").alias("doc_id"), "grams", "logs").unionByName(ids)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        good = set(right.doc_id[right.grams.isna()].astype("int64"))
        lists = right[right.grams.notna()]
        keys = np.concatenate([np.zeros(0, np.uint64), *map(keys_from, lists.grams)])
        logp = np.concatenate([np.zeros(0, np.float32), *(loosened(b, np.float32) for b in lists.logs)])
        order = np.argsort(keys)
        keys, logp = keys[order], logp[order].astype(float)
        rows = []
        for doc_id, lang, text in unpacked(left):
            g = grams_of(text)
            nats = -logp[np.searchsorted(keys, g)].mean() if len(g) else None
            rows.append((doc_id, lang, doc_id in good, max(len(g) - 1, 0), nats))
        out = pd.DataFrame(rows, columns=["doc_id", "lang", "trusted", "n_chars", "nats"])
        return out.astype({"doc_id": "Int64", "nats": "float64"})
    return texts.groupBy("block").cogroup(both.groupBy("block")).applyInPandas(score, SCORED)


def quantile_bins(trusted: DataFrame, quantile: float, *by: str) -> DataFrame:
    """(by, at_most): the quantile's histogram bin, from counts per bin."""
    bins = trusted.groupBy(*by, F.floor(F.col("nats") / BIN).alias("bin")).agg(F.count("*").alias("n"))
    lists = bins.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("h"), F.sum("n").alias("n"))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("bin"))
    found = F.aggregate("h", zero, lambda s, b: F.struct(
        (s["sum"] + b["n"]).alias("sum"),
        F.coalesce(s["bin"], F.when(s["sum"] + b["n"] >= F.col("n") * quantile, b["bin"])).alias("bin")))
    return lists.select(*by, "n", ((found["bin"] + 1) * BIN).alias("at_most"))


def classify(docs: DataFrame, trusted_ids: DataFrame, *, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """(doc_id, lang, trusted, n_chars, nats, perplexity, threshold, kept) of every document.

    ``docs`` has doc_id, lang and text; ``trusted_ids`` the doc_ids of trusted texts.
    """
    trusted_ids = trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = shards = max(4, -(-int(size) // BLOCK_BYTES))
    lists = written(block_lists(packed(docs, blocks), trusted_ids, blocks, shards), "gram-lists")
    counts = written(summed(lists), "gram-counts")
    logs = log_probabilities(counts.select("shard", "gram"), *orders(counts))
    answered = written(answers(lists, logs), "gram-answers")
    rows = written(scored(packed(docs, blocks), answered, trusted_ids, blocks), "scored")

    judged = F.col("nats") - NOISE / F.sqrt(F.col("n_chars") + 1)
    trusted = rows.where("trusted AND nats IS NOT NULL").withColumn("nats", judged)
    own = quantile_bins(trusted.where("lang IS NOT NULL"), quantile, "lang").where(F.col("n") >= MIN_TRUSTED)
    whole = quantile_bins(trusted, quantile).first()
    common = F.lit(whole.at_most if whole else None).cast("double")
    out = rows.join(own.select("lang", F.col("at_most").alias("own")), "lang", "left")
    threshold = F.coalesce("own", common) + slack + (F.col("nats") - judged)
    return out.select(
        "doc_id", "lang", "trusted", "n_chars", "nats", F.exp("nats").alias("perplexity"),
        F.exp(threshold).alias("threshold"),
        F.coalesce(F.col("nats") <= F.coalesce(threshold, F.lit(float("inf"))), F.lit(False)).alias("kept"))


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document; trusted: quality label 1."""
    docs = read(spark, sf_dir, "documents", "doc_id", "lang", "text")
    good = read(spark, sf_dir, "labels", "doc_id", "quality").where("quality = 1").select("doc_id")
    out = classify(docs, good)
    return out.select("doc_id", "lang", "n_chars", F.round("perplexity", 4).alias("perplexity"),
                      F.round("threshold", 4).alias("threshold"), "kept")
