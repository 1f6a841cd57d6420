"""Near-duplicate detection by b-bit MinHash (operator 4).

A document's set is its distinct word shingles. Equal sets form a class, named by
a 64-bit key of the set, so copies in any number are one node from here on.
``BANDS * ROWS`` minima are taken per class. Bands of ``ROWS`` minima make
candidate buckets; the low ``BITS`` bits of the first ``SKETCHED`` minima are packed
into 64-bit words, and counting equal groups of bits estimates the similarity,
corrected for the ``2**-BITS`` matches that chance gives. Pairs whose estimate is
``MARGIN`` standard errors below the limit are dropped, the others are confirmed
on their full sets, and links make connected components.

No pairs of a bucket are emitted. Classes are first compared to one member of each
bucket (its smallest, then the one with the fullest buckets, then hash-chosen ones),
which joins most of a group. What then stays apart in a bucket is compared in
full, without caps: sketches alone make neighbourhoods, outside of which no link is
plausible; within one, everything but its largest component is compared to all of it on the
full sets, in blocks of at most about ``BLOCK`` by ``BLOCK`` classes. A block pair is one task's
work and gives no more than one link for each class and component.

A link at similarity s is missed if no band agrees: ``(1 - s**ROWS)**BANDS``, 6e-7
at 0.8 and less above.

Edge cases: a null, empty or blank text has an empty set and is linked with
nothing; rows with a null id belong to their text's component but are never its
name, and are kept only if no id in it is known, one of them by ``keep_one``; an id
over several texts stands for each of them apart; repeated rows are copies; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, written
from .components import components
from .wordhash import mixed, set_key, shingles, word_hashes

ROWS, BANDS = 5, 36
BITS, SKETCHED = 4, 160
MARGIN = 5.0
CENTRES = 3              # members of each bucket that all its members are compared to
BLOCK = 256              # classes on either side of a block
_LOW = 0x1111111111111111


def minima(shingle_set: np.ndarray, count: int) -> np.ndarray:
    """``count`` minima of a set under as many hash functions."""
    odd = mixed(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingle_set), 2048):
        part = shingle_set[at:at + 2048, None] * odd[None, :]
        np.minimum(out, (part >> np.uint64(32)).min(0), out=out)
    return out


def signature(shingle_set: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, packed low bits) of a set."""
    m = minima(shingle_set, ROWS * BANDS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + m[r::ROWS])
    low = (m[:SKETCHED] & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    packed = (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64)
    return key.view(np.int64), packed.view(np.int64)


def signer(size: int):
    @F.pandas_udf("n long, node long, bands array<long>, sketch array<long>")
    def sign(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                s = shingles(word_hashes(text if isinstance(text, str) else None), size)
                rows.append((len(s), set_key(s), *signature(s)) if len(s) else (0, 0, [], []))
            yield pd.DataFrame(rows, columns=["n", "node", "bands", "sketch"])
    return sign


def shingler(size: int):
    @F.pandas_udf("node long, shingles array<long>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            sets = [shingles(word_hashes(t if isinstance(t, str) else None), size) for t in batch]
            yield pd.DataFrame({"node": [set_key(s) for s in sets],
                                "shingles": pd.Series([s.view(np.int64) for s in sets], dtype=object)})
    return cut


def equal_groups(a: Column, b: Column) -> Column:
    """Number of equal bit groups of two sketches (arrays of packed longs)."""
    total = F.lit(0)
    for i in range(SKETCHED * BITS // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for shift in (1, 2):        # folds a group's bits into its lowest
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + (64 // BITS) - F.bit_count(x.bitwiseAND(F.lit(_LOW)))
    return total


def plausible(a: str, b: str, percent: int) -> Column:
    """Whether the sizes allow the similarity and the corrected estimate doesn't refute it."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    chance, limit = 2.0 ** -BITS, percent / 100
    matching = chance + (1 - chance) * limit
    error = (matching * (1 - matching) / SKETCHED) ** 0.5 / (1 - chance)
    estimate = (equal_groups(F.col(f"{a}.sketch"), F.col(f"{b}.sketch")) / SKETCHED - chance) / (1 - chance)
    return ((F.least(na, nb) * 100 >= F.greatest(na, nb) * percent)
            & (estimate >= limit - MARGIN * error))


class Linker:
    """Confirmed links between classes, and what has been linked so far."""

    def __init__(self, classes: DataFrame, sets: DataFrame, percent: int):
        self.classes, self.sets, self.percent = classes, sets, percent
        self.links: DataFrame | None = None

    def confirm(self, pairs: DataFrame) -> None:
        """Check pairs (a, b) on sketches and then on full sets; keep the links."""
        full = (self.plausible_pairs(pairs).join(self.sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
                .join(self.sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"))
        common = F.size(F.array_intersect("sa", "sb"))
        found = full.where(common * 100 >= (F.size("sa") + F.size("sb") - common) * self.percent).select("a", "b")
        self.links = written(found if self.links is None else self.links.unionByName(found), "links")

    def labelled(self, buckets: DataFrame, edges: DataFrame | None = None) -> DataFrame:
        """Rows (band, node) of the buckets that hold several components, with ``component``:
        of the links, or of ``edges``."""
        found = components(self.links if edges is None else edges)
        of = buckets.select("band", "node").join(found, "node", "left").select(
            "band", "node", F.coalesce("component", "node").alias("component"))
        mixed_bands = of.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where(
            "lo <> hi").select("band")
        return written(of.join(mixed_bands, "band", "left_semi"), "open-buckets")

    def plausible_pairs(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that sketches and sizes don't refute."""
        side = self.classes.select("node", "n", "sketch")
        return (pairs.distinct().join(side.alias("x"), F.col("a") == F.col("x.node"))
                .join(side.alias("y"), F.col("b") == F.col("y.node"))
                .where(plausible("x", "y", self.percent)).select("a", "b"))

    def neighbourhoods(self, apart: DataFrame) -> DataFrame:
        """(node, hood) of the nodes of open buckets; plausible pairs of a bucket share a hood."""
        nodes = apart.select("node", "component").distinct()
        edges = nodes.select(F.col("component").alias("a"), F.col("node").alias("b"))
        for turn in range(CENTRES):
            pairs = centre_pairs(apart, turn)
            edges = written(edges.unionByName(self.plausible_pairs(pairs)), "hood-edges")
        left = self.labelled(apart, edges)
        most = (left.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band")
                .agg(F.max_by("component", F.struct("n", "component")).alias("main")))
        details = self.classes.select("node", "n", "sketch", "bands")
        full = written(left.join(details, "node").join(most, "band"), "open-rows")
        x, y = full.where("component <> main").alias("x"), full.alias("y")
        first_shared = F.array_position(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), True)
        each_once = (F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
        rest = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.component") != F.col("y.component"))
                      & each_once & plausible("x", "y", self.percent)
                      & (F.get("x.bands", (first_shared - 1).cast("int")) == F.col("x.band")))
        edges = edges.unionByName(rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
        return written(nodes.join(components(edges).withColumnRenamed("component", "hood"), "node", "left").select(
            "node", "component", F.coalesce("hood", "node").alias("hood")), "hoods")

    def settle(self, apart: DataFrame) -> None:
        """Compare in full, within each neighbourhood, what is not in its largest component."""
        hoods = self.neighbourhoods(apart)
        parts = hoods.groupBy("hood", "component").agg(F.count("*").alias("n"))
        sizes = parts.groupBy("hood").agg(
            F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("members"),
            (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
        rows = hoods.join(sizes, "hood").join(self.sets, "node")

        def chunk(size):
            return F.pmod(F.xxhash64("node"), F.ceil(F.col(size) / BLOCK)).cast("int")

        def every(size):
            return F.explode(F.sequence(F.lit(0), (F.ceil(F.col(size) / BLOCK) - 1).cast("int")))
        left = rows.where("component <> main").select("hood", chunk("others").alias("p"), every("members").alias("q"),
                                                      "node", "component", "shingles")
        # Names of their own: both sides come from one table.
        right = rows.select(F.col("hood").alias("of_hood"), every("others").alias("of_p"), chunk("members").alias("of_q"),
                            F.col("node").alias("of"), F.col("component").alias("of_component"),
                            F.col("shingles").alias("of_shingles"))
        percent = self.percent

        def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return block_links(a, b, percent)

        found = left.groupBy("hood", "p", "q").cogroup(right.groupBy("of_hood", "of_p", "of_q")).applyInPandas(
            compare, "a long, b long")
        self.links = written(self.links.unionByName(found), "links")


def block_links(a: pd.DataFrame, b: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A link from each class of ``a`` to each other component in ``b`` that it has one to.

    ``a`` has node, component and shingles, ``b`` the same as of, of_component, of_shingles."""
    out: list[tuple[int, int]] = []
    if len(a) and len(b):
        size = np.fromiter(map(len, b.of_shingles), np.int64, len(b))
        every = np.concatenate([np.asarray(s, np.int64) for s in b.of_shingles])
        owner = np.repeat(np.arange(len(b)), size)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        component, node = b.of_component.to_numpy(), b.of.to_numpy()
        for x, own, s in zip(a.node, a.component, a.shingles, strict=True):
            s = np.asarray(s, np.int64)
            lo, hi = np.searchsorted(every, s, "left"), np.searchsorted(every, s, "right")
            held = hi - lo
            at = np.repeat(lo - np.cumsum(held) + held, held) + np.arange(held.sum())
            common = np.bincount(owner[at], minlength=len(b))
            linked = np.flatnonzero((100 * common >= percent * (len(s) + size - common)) & (component != own))
            for i in linked[np.unique(component[linked], return_index=True)[1]]:
                out.append((x, node[i]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def centre_pairs(apart: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each bucket's centre and its members of other components: first the
    member whose buckets are fullest, then hash-chosen ones."""
    if turn == 0:
        filled = apart.groupBy("band").agg(F.count("*").alias("n"))
        weight = apart.join(filled, "band").groupBy("node").agg(F.sum("n").alias("w"))
        ranked, order = apart.join(weight, "node"), F.struct(-F.col("w"), "node")
    else:
        ranked, order = apart, F.xxhash64("node", F.lit(turn))
    centre = ranked.groupBy("band").agg(F.min_by(F.struct("node", "component"), order).alias("c"))
    return apart.join(centre, "band").where("component <> c.component").select(
        F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_hash, near) of every row of ``docs``; near: n_shingles, component_id, kept, component.

    ``component`` names the component whatever ids its rows have, and is null for empty sets;
    ``component_id`` is the smallest id in it, null if no id in it is known.

    ``docs`` has doc_id and text. Documents are linked if
    ``100 * |intersection| >= percent * |union|`` of their shingle sets.
    """
    signed = written(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), signer(size)("text").alias("s"))
                     .select("doc_id", "text_hash", "s.*"), "signatures")
    some = signed.where("n > 0")
    # One row per class: the signature and text hash of its smallest id, found by a combined minimum.
    named = some.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    first = F.col("doc_id").eqNullSafe(F.col("first_id"))
    classes = written(some.join(named, "node").where(first).dropDuplicates(["node"]).drop("doc_id")
                      .withColumnRenamed("text_hash", "first_hash"), "classes")

    rows = classes.select("node", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre <> last")
    buckets = written(rows.join(shared.select("band", "centre"), "band"), "buckets")

    wanted = buckets.select("node").distinct().join(classes.select("node", "first_id", "first_hash"), "node")
    # By id and text: a null id is many documents, and an id may stand over several texts.
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("__h")).join(
        wanted.select("first_id", "first_hash").hint("shuffle_hash"),
        F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("__h") == F.col("first_hash")), "left_semi")
    texts = texts.dropDuplicates(["doc_id", "__h"])
    sets = texts.select(shingler(size)("text").alias("s")).select("s.*")
    sets = written(sets.join(wanted.select("node").hint("shuffle_hash"), "node", "left_semi"), "candidate-sets")

    linker = Linker(classes, sets, percent)
    linker.confirm(buckets.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")))
    for turn in range(CENTRES - 1):
        linker.confirm(centre_pairs(linker.labelled(buckets), turn))
    linker.settle(linker.labelled(buckets))

    member = classes.select("node", "first_id").join(components(linker.links), "node", "left").select(
        "node", "first_id", F.coalesce("component", "node").alias("component"))
    ids = member.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = member.join(ids, "component").select(F.col("node").alias("__node"), "component_id", "component")
    result = signed.select("doc_id", "text_hash", "n", "node").join(
        named, (F.col("node") == F.col("__node")) & (F.col("n") > 0), "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return result.select("doc_id", "text_hash", F.struct(
        F.col("n").alias("n_shingles"), own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, own.isNull()).alias("kept"), "component").alias("near"))


def keep_one(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, in all its columns."""
    near = near_duplicates(docs, size=size, percent=percent).where("near.kept")
    # Of a component's rows with its smallest id, or with none, the one with the smallest text hash.
    empty = F.col("near.n_shingles") == 0
    stays = near.groupBy("near.component", F.when(empty, F.col("doc_id")).alias("empty_id"),
                         F.when(empty, F.col("text_hash")).alias("empty_hash")).agg(
        F.min("doc_id").alias("kept_id"), F.min("text_hash").alias("kept_hash")).select("kept_id", "kept_hash")
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("of_id"), F.xxhash64("text").alias("of_hash"))
    same = F.col("of_id").eqNullSafe(F.col("kept_id")) & (F.col("of_hash") == F.col("kept_hash"))
    once = rows.join(stays.distinct().hint("shuffle_hash"), same, "left_semi")
    # Rows equal in id and text: the smallest in the order of the columns.
    return once.groupBy("of_id", "of_hash").agg(F.min("doc").alias("doc")).select("doc.*")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents by two-word shingles."""
    out = near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), size=2)
    return out.select("doc_id", "near.n_shingles", "near.component_id", "near.kept")
