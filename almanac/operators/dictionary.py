"""Tags from a dictionary kept as a table (F1, A14, R4 with many thousands of words).

The rule is that of :func:`almanac.operators.tags.extract_tags`, which builds a regex and so
suits small dictionaries. Here the dictionary is a DataFrame and no regex over its words exists:

1. Tags are classed by the power of two that their length reaches (1, 2-3, 4-7, ..); a tag's
   first so many characters are its head. The heads' hashes make a bitmap of fixed size.
2. Every place of a text has one gram per class, hashed many at a time in numpy, a piece of the
   texts at a time; the hash of a gram is made of those of its halves. Only places whose gram
   is in the bitmap become rows. They are joined by the hash with the tags' heads;
   whole tags are compared within the join.
3. At each place the first tag by rank stays. Matches that overlap form chains, found
   by a running maximum; within a chain they are taken from left to right.

The join is a map-side one where the dictionary's letters, counted first, are at most
``BROADCAST_CHARS``; a larger dictionary is shuffled with the grams. The matches are
shuffled once, by text. The bitmap only spares rows: one full of a very large dictionary's heads
leaves every gram to the join.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .tags import HANGUL, PARTICLES

PIECE_CHARS = 1 << 18            # characters that are hashed at a time
BROADCAST_CHARS = 8_000_000
BITMAP_BITS = 24                 # a bit for every value of a hash's upper bits
_ODD = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def dictionary_frame(spark: SparkSession, tag_sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """(class, tag, rank) rows of dictionary classes; the rank is the place in the list."""
    rows = [(cls, tag, rank) for cls, tags in tag_sets.items() for rank, tag in enumerate(tags)]
    return spark.createDataFrame(rows, "class string, tag string, rank long")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _ODD[0]
    h = (h ^ (h >> np.uint64(27))) * _ODD[1]
    return h ^ (h >> np.uint64(31))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _gram_hashes(codes: np.ndarray, widths: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(width, hash of the gram of so many characters at every place that has one); widths are powers of two."""
    h, width = _mixed(codes.astype(np.uint64) + _ODD[2]), 1
    while len(h) and width <= max(widths):
        if width in widths:
            yield width, h
        h, width = _mixed(h[:-width] * _ODD[2] + h[width:]), 2 * width


def _bits(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _with_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (class, tag, rank, n, width) with ``head``, the hash of the tag's first ``width`` characters, and its ``bit``."""
    for batch in batches:
        heads = [next(h for _, h in _gram_hashes(_codes(tag)[:width], [width]))[0]
                 for tag, width in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        head = np.array(heads, np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(head.view(np.int64)), pa.array(_bits(head))],
                                         names=[*batch.schema.names, "head", "bit"])


def _prepared(dictionary: DataFrame) -> DataFrame:
    """(class, tag, rank, n, width, head, bit) of the distinct tags that aren't empty, written once.

    ``width`` is the largest power of two up to the tag's length and ``head`` the hash of the tag's first
    so many characters. Without a column ``rank`` longer tags come first, then smaller ones."""
    n = F.length("tag")
    rank = F.col("rank").cast("long") if "rank" in dictionary.columns else F.lit(0).cast("long") - n
    tags = (dictionary.where("tag <> ''").select("class", "tag", rank.alias("rank"))
            .groupBy("class", "tag").agg(F.min("rank").alias("rank")))
    width = F.pow(F.lit(2), F.floor(F.log2(n.cast("double")) + 1e-9)).cast("int")
    rows = tags.withColumns({"n": n, "width": width}).select("class", "tag", "rank", "n", "width")
    rows = rows.mapInArrow(_with_heads, T.StructType([*rows.schema.fields, T.StructField("head", T.LongType()),
                                                      T.StructField("bit", T.LongType())]))
    path = scratch_path(dictionary.sparkSession, "dictionary")
    rows.write.parquet(path)
    return dictionary.sparkSession.read.schema(rows.schema).parquet(path)


def _bitmap(tags: DataFrame) -> bytes:
    """The bits of the heads: ``2 ** BITMAP_BITS`` of them, whatever the dictionary's size."""
    # Spark numbers the bits of a bitmap from 1; a part has 32,768 bits.
    parts = tags.withColumn("bit", F.col("bit") + 1).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = bytearray((1 << BITMAP_BITS) // 8)
    for r in parts:
        out[(r["part"] - 1) * 4096:r["part"] * 4096] = r["bits"]
    return bytes(out)


def _grams(docs: DataFrame, key: Sequence[str], widths: Sequence[int], bitmap: bytes) -> DataFrame:
    """(key.., at, before, gram, window) of the places of ``__text`` and the widths whose gram is in the bitmap: its hash,
    the character before it and the characters that a tag of this width's class may need."""
    shared, size = docs.sparkSession.sparkContext.broadcast(bitmap), PIECE_CHARS
    reach = max(2 * widths[-1] - 1, 3)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").view(bool)

        def rows(batch, pieces):
            """Rows of pieces (row number, start, whether a character comes before, that with the piece and what follows, length)."""
            text = "".join(p for _, _, _, p, _ in pieces)
            ends = np.cumsum([len(p) for _, _, _, p, _ in pieces])
            of, at, before, gram, window = [], [], [], [], []
            codes = _codes(text)
            for w, h in _gram_hashes(codes, widths):
                found = np.flatnonzero(known[_bits(h)])
                piece = np.searchsorted(ends, found, "right")
                more = max(2 * w - 1, 3)
                for i, k, g in zip(found.tolist(), piece.tolist(), h[found].view(np.int64).tolist(), strict=True):
                    row, start, lead, p, n = pieces[k]
                    place = i - (int(ends[k]) - len(p))
                    if lead <= place < lead + n and place + w <= len(p):
                        of.append(row)
                        at.append(start + place - lead + 1)
                        before.append(p[place - 1] if place else "")
                        gram.append(g)
                        window.append(p[place:place + more])
            taken = [c.take(pa.array(of, pa.int64())) for c in batch.columns[:-1]]
            return pa.RecordBatch.from_arrays([*taken, pa.array(at, pa.int32()), pa.array(before, pa.string()),
                                               pa.array(gram, pa.int64()), pa.array(window, pa.string())],
                                              names=[*key, "at", "before", "gram", "window"])

        for batch in batches:
            held, chars = [], 0
            for row, value in enumerate(batch.column(len(key)).cast(pa.binary())):
                text = (value.as_py() or b"").decode("utf-8", "replace")
                for start in range(0, len(text), size):
                    lead = min(start, 1)
                    piece = text[start - lead:start + size + reach]
                    held.append((row, start, lead, piece, min(size, len(text) - start)))
                    chars += len(piece)
                    if chars >= size:
                        yield rows(batch, held)
                        held, chars = [], 0
            if held:
                yield rows(batch, held)

    kinds = [docs.schema[k] for k in key]
    found = T.StructType([*kinds, T.StructField("at", T.IntegerType()), T.StructField("before", T.StringType()),
                          T.StructField("gram", T.LongType()), T.StructField("window", T.StringType())])
    return docs.select(*key, "__text").mapInArrow(grams, found)


def dictionary_matches(docs: DataFrame, key: Sequence[str], text: str, dictionary: DataFrame) -> DataFrame:
    """(key.., class, tag): the distinct tags found in each text, a class at a time.

    ``dictionary`` has columns class and tag, and may have rank: at one place one-character tags come first, then
    the lowest rank, then the longest tag. One-character tags must stand alone among Hangul syllables or
    carry one particle; longer tags match anywhere. Matches are taken from left to right and don't overlap.
    ``key`` identifies a text: texts of equal keys count as one. Null texts, and null or empty tags, match nothing.
    """
    names, key = list(key), [f"__key{i}" for i in range(len(key))]
    docs = docs.select(*[F.col(c).alias(k) for c, k in zip(names, key, strict=True)], F.col(text).alias("__text"))
    tags = _prepared(dictionary)
    found = tags.agg(F.sort_array(F.collect_set("width")).alias("widths"), F.sum("n").alias("chars")).first()
    widths = found["widths"]                     # at most the logarithm of the longest tag's length
    if not widths:
        return docs.select(*key, F.lit("").alias("class"), F.lit("").alias("tag")).where(F.lit(False)).toDF(
            *names, "class", "tag")
    grams = _grams(docs, key, widths, _bitmap(tags))

    def hangul(c: Column) -> Column:
        return c.between(HANGUL[0], HANGUL[-1])
    second, third = (F.substr("window", F.lit(i), F.lit(1)) for i in (2, 3))
    carries = second.isin(PARTICLES) & ~hangul(third)
    alone = ~hangul(F.col("before")) & (carries | ~hangul(second))
    fits = F.startswith("window", "tag") & ((F.col("n") > 1) | alone)
    side = tags.hint("broadcast") if found["chars"] <= BROADCAST_CHARS else tags
    hits = grams.join(side, (F.col("gram") == F.col("head")) & fits).select(
        *key, "class", "at", F.struct(
            (F.col("n") > 1).alias("longer"), "rank", (-F.col("n")).alias("shorter"), "tag",
            F.when((F.col("n") == 1) & carries, 2).otherwise(F.col("n")).alias("n")).alias("hit"))

    # One shuffle by text serves the choice at a place, the chains and the tags of a text.
    first = hits.repartition(*key).groupBy(*key, "class", "at").agg(F.min("hit").alias("hit"))
    order = Window.partitionBy(*key, "class").orderBy("at")
    reach = F.max(F.col("at") + F.col("hit.n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = first.withColumn("opens", (reach.isNull() | (F.col("at") >= reach)).cast("int"))
    chains = (opens.withColumn("chain", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy(*key, "class", "chain")
              .agg(F.sort_array(F.collect_list(F.struct("at", F.col("hit.n").alias("n"), F.col("hit.tag").alias("tag"))))
                   .alias("links")))
    taken = F.aggregate("links", F.struct(F.lit(0).alias("stop"), F.array().cast("array<string>").alias("tags")),
                        lambda s, x: F.when(x["at"] >= s["stop"], F.struct(
                            (x["at"] + x["n"]).alias("stop"),
                            F.when(F.array_contains(s["tags"], x["tag"]), s["tags"]).otherwise(
                                F.concat(s["tags"], F.array(x["tag"]))).alias("tags"))).otherwise(s))["tags"]
    return chains.select(*key, "class", F.explode(taken).alias("tag")).distinct().toDF(*names, "class", "tag")


def dictionary_tags(docs: DataFrame, key: Sequence[str], text: str, dictionary: DataFrame, classes: Sequence[str],
                    prefix: str = "tags_") -> DataFrame:
    """One row per key with the sorted tags of each of ``classes`` in a column ``<prefix><class>``, empty if none."""
    none = docs.select(*key, F.lit(None).cast("string").alias("class"), F.lit(None).cast("string").alias("tag"))
    rows = dictionary_matches(docs, key, text, dictionary).unionByName(none)
    return rows.groupBy(*key).agg(*[
        F.sort_array(F.collect_set(F.when(F.col("class") == c, F.col("tag")))).alias(f"{prefix}{c}") for c in classes])
