"""Merkle manifest of a dataset with incremental witnesses (operator 12).

Every row is a leaf; leaves of one source stand in one tree of fan-out 16, and the
sources' roots in one more tree. ``OpenTree`` takes nodes one by one: a node joins the
open run of its level, and a run that completes gives each of its members, and all
leaves below them, the siblings of that level. So witnesses grow from the leaf up
and are never computed from a finished tree.

Distribution: ``BLOCK`` = 16^3 aligned leaves are a subtree that no other leaf touches.
A task streams one block, and the block's root is appended to the tree above like any
node; blocks of block roots follow until one root per source is left, and the
sources' roots are streamed in the same way. Leaves get what happened above as one
witness per block. Work is dealt by (source, block), so a source of any size is split.

``Manifest`` keeps leaves and block roots by batch in a folder. A batch goes after all
earlier ones (by doc_id within itself); it opens each source's last, incomplete block
again, and blocks that are complete are never read or hashed anew. A batch counts
once its roots are complete, committing it again changes nothing, and one that died
halfway is written anew.

Edge cases: null fields are ``-``; null ids come first, rows equal in id order by
leaf, and repeated rows are leaves of their own; null sources are one source, the
first; a source of one row has its leaf as root, and with one source its root is the
root; an empty table has no rows and no root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import ascii_lower, read, written
from .positions import numbered

FANOUT = 16
HEIGHT = 3
BLOCK = FANOUT ** HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, position long, total long, node string"
STEPS = "places array<int>, siblings array<string>"
LEAVES = "tree string, position long, doc_id long, leaf string, candidate string"
ROOTS = "tree string, block long, n long, node string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class OpenTree:
    """A tree that is appended to; members' witnesses are lists of (place, siblings) that grow."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout, self.runs = fanout, [[]]

    def append(self, node: str, witness: list) -> None:
        self._add(0, node, [witness])

    def _add(self, level: int, node: str, below: list[list]) -> None:
        if level == len(self.runs):
            self.runs.append([])
        self.runs[level].append((node, below))
        if len(self.runs[level]) == self.fanout:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        nodes = [node for node, _ in run]
        for place, (_, below) in enumerate(run):
            step = place, "".join(nodes[:place] + nodes[place + 1:])
            for witness in below:
                witness.append(step)
        self._add(level + 1, digest("".join(nodes)), [w for _, below in run for w in below])

    def finish(self, height: int | None = None) -> str:
        """Complete what is open and return the root: at ``height``, or where one node is left."""
        level = 0
        while True:
            above = any(self.runs[level + 1:])
            if level == height or (height is None and not above and len(self.runs[level]) == 1):
                return self.runs[level][0][0]
            if self.runs[level]:
                self._complete(level)
            level += 1


def streamed(nodes: Iterable[str], total: int) -> tuple[str, list[list]]:
    """Root and witnesses of one block of a tree that has ``total`` nodes in all."""
    tree, witnesses = OpenTree(), []
    for node in nodes:
        witnesses.append([])
        tree.append(node, witnesses[-1])
    return tree.finish(HEIGHT if total > BLOCK else None), witnesses


def block_root(key: tuple, rows: pa.Table) -> pa.Table:
    """One row for a block: (tree, block, n, node)."""
    rows = rows.sort_by("position")
    root, _ = streamed(rows["node"].to_pylist(), rows["total"][0].as_py())
    return pa.table({"tree": [key[0].as_py()], "block": pa.array([key[1].as_py()], pa.int64()),
                     "n": pa.array([rows.num_rows], pa.int64()), "node": [root]})


def block_steps(rows: pa.Table) -> pa.Table:
    """Nodes of a block with their steps to its root, which is ``above``."""
    rows = rows.sort_by("position")
    root, witnesses = streamed(rows["node"].to_pylist(), rows["total"][0].as_py())
    return pa.table({
        "tree": rows["tree"], "position": rows["position"], "total": rows["total"], "node": rows["node"],
        "places": pa.array([[p for p, _ in w] for w in witnesses], pa.list_(pa.int32())),
        "siblings": pa.array([[s for _, s in w] for w in witnesses], pa.list_(pa.string())),
        "above": pa.array([root] * rows.num_rows, pa.string())})


def leaf_witnesses(rows: pa.Table, blocks: pa.Table) -> pa.Table:
    """Leaves of a block with their steps to the root of all."""
    names = ["tree", "position", "doc_id", "leaf", "candidate"]
    rows = rows.sort_by("position").select(names)
    up = blocks.to_pylist()[0]
    root, witnesses = streamed(rows["leaf"].to_pylist(), up["total"])
    if root != up["node"]:
        raise ValueError(f"a stored block of {up['tree']!r} doesn't have its stored root")
    n = rows.num_rows
    return pa.table({
        **{name: rows[name] for name in names},
        "places": pa.array([[*[p for p, _ in w], *up["places"]] for w in witnesses], pa.list_(pa.int32())),
        "siblings": pa.array([[*[s for _, s in w], *up["siblings"]] for w in witnesses], pa.list_(pa.string())),
        "subroot": pa.array([up["subroot"]] * n, pa.string()), "root": pa.array([up["root"]] * n, pa.string())})


def block_of(position: str = "position") -> Column:
    return F.floor(F.col(position) / F.lit(BLOCK)).cast("long")


def climbed(nodes: DataFrame, name: str) -> DataFrame:
    """(tree, position, total, node) -> the same with steps to the tree's ``root``.

    Each round streams blocks and appends their roots above; a round divides the nodes by ``BLOCK``.
    """
    # The key of a group must not be a field of its rows, hence the second name.
    here = written(nodes.withColumn("block", block_of()).withColumn("of", F.col("tree")).groupBy("of", "block")
                   .applyInArrow(block_steps, f"{NODE}, {STEPS}, above string"), name)
    most = here.agg(F.max("total")).first()[0]
    if most is None or most <= BLOCK:
        return here.withColumnRenamed("above", "root")
    tops = here.select("tree", block_of().alias("position"), F.ceil(F.col("total") / F.lit(BLOCK)).alias("total"),
                       F.col("above").alias("node")).distinct()
    upper = climbed(tops, name).select(
        "tree", F.col("position").alias("block"), F.col("places").alias("p"), F.col("siblings").alias("s"), "root")
    return written(here.withColumn("block", block_of()).join(upper, ["tree", "block"]).select(
        "tree", "position", "total", "node", F.concat("places", "p").alias("places"),
        F.concat("siblings", "s").alias("siblings"), "root"), name)


def leaf_of(text: Column | None = None) -> Column:
    """Digest of a row of ``documents``, with another text if one is given."""
    parts = [F.col(f).cast("string") if f != "text" or text is None else text for f in FIELDS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-"))
                             for p in parts]), 256)


def folded(leaf: Column, places: str = "places", siblings: str = "siblings") -> Column:
    """Root that a leaf and its witness lead to."""
    width = 64
    return F.aggregate(F.arrays_zip(places, siblings), leaf, lambda node, s: F.sha2(F.concat(
        F.substr(s[siblings], F.lit(1), s[places] * width), node,
        F.substr(s[siblings], s[places] * width + 1, F.length(s[siblings]))), 256))


class Manifest:
    """Leaves and block roots stored by batch under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _committed(self) -> list[str]:
        """Folders of the batches that count, named ``batch=<id>``."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/roots")
        files = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        folders = [s.getPath() for s in files.listStatus(top)] if files.exists(top) else []
        return [p.getName() for p in folders if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{name}" for name in self._committed()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths)

    def blocks(self) -> DataFrame:
        """(tree, block, n, node) as of the last batch: of an open block the longest state counts."""
        return self._read("roots", ROOTS).groupBy("tree", "block").agg(
            F.max("n").alias("n"), F.max_by("node", "n").alias("node"))

    def append(self, batch: str, docs: DataFrame, candidate: Column | None = None) -> bool:
        """Append the rows of ``docs``; False if the batch was committed before.

        ``candidate`` is a digest to hold against the manifest later, as of a row found changed.
        """
        if f"batch={batch}" in self._committed():
            return False
        tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))  # null first, then bytewise
        leaves = written(docs.select(
            tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of().alias("leaf"),
            (F.lit(None) if candidate is None else candidate).cast("string").alias("candidate"),
            F.monotonically_increasing_id().alias("nth")), "manifest-leaves")
        sizes = written(self.blocks().groupBy("tree").agg(F.sum("n").alias("size")), "manifest-sizes")
        new = numbered(leaves, "tree", ["doc_id", "leaf", "nth"], "manifest-order").join(sizes, "tree", "left")
        size = F.coalesce("size", F.lit(0))
        (new.withColumn("position", F.col("position") + size)
         .select("tree", "position", "doc_id", "leaf", "candidate",
                 F.floor(F.col("position") / F.lit(BLOCK)).cast("long").alias("block"),
                 (F.col("total") + size).alias("total"))
         .write.mode("overwrite").parquet(f"{self.path}/leaves/batch={batch}"))
        added = self.spark.read.schema(f"{LEAVES}, block long, total long").parquet(f"{self.path}/leaves/batch={batch}")
        # Open again: incomplete last blocks of the sources that grow. Their earlier leaves are few.
        grown = added.groupBy("tree").agg(F.max("total").alias("total"))
        opened = sizes.where(F.col("size") % BLOCK > 0).join(grown, "tree").select(
            "tree", "total", block_of("size").alias("block"))
        columns = ["tree", "block", "position", "total", F.col("leaf").alias("node")]
        again = self._read("leaves", f"{LEAVES}, block long").join(opened, ["tree", "block"])
        (added.select(*columns).unionByName(again.select(*columns)).groupBy("tree", "block")
         .applyInArrow(block_root, ROOTS).write.mode("overwrite").parquet(f"{self.path}/roots/batch={batch}"))
        return True

    def appender(self):
        """For ``writeStream.foreachBatch``: every micro-batch is one append."""
        return lambda docs, number: self.append(f"stream-{number}", docs)

    def witnessed_blocks(self) -> DataFrame:
        """(tree, block, node, total, places, siblings, subroot, root): steps from each block's root to the top."""
        blocks = written(self.blocks(), "manifest-blocks")
        of = Window.partitionBy("tree")  # one row per block, not per leaf
        in_source = climbed(blocks.select("tree", F.col("block").alias("position"), F.count("*").over(of).alias("total"),
                                          "node"), "manifest-source")
        sources = in_source.select("tree", F.col("root").alias("node")).distinct().withColumn("all", F.lit("all"))
        tops = numbered(written(sources, "manifest-subroots"), "all", ["tree"], "manifest-tops")
        above = climbed(tops.select(F.col("all").alias("tree"), "position", "total", "node"), "manifest-root").join(
            tops.select("position", F.col("tree").alias("of")), "position")
        above = above.select(F.col("of").alias("tree"), F.col("places").alias("p"), F.col("siblings").alias("s"), "root")
        leaves = blocks.groupBy("tree").agg(F.sum("n").alias("leaves"))
        return written(in_source.withColumnRenamed("root", "subroot").join(above, "tree").join(leaves, "tree").select(
            "tree", F.col("position").alias("block"), "node", F.col("leaves").alias("total"),
            F.concat("places", "p").alias("places"), F.concat("siblings", "s").alias("siblings"), "subroot", "root"),
            "manifest-witnesses")

    def witnesses(self) -> DataFrame:
        """Every leaf with its witness: per level its place in the run and its siblings' digests in one string."""
        leaves = self._read("leaves", f"{LEAVES}, block long")
        return leaves.groupBy("tree", "block").cogroup(self.witnessed_blocks().groupBy("tree", "block")).applyInArrow(
            leaf_witnesses, f"{LEAVES}, {STEPS}, subroot string, root string")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, and which of the (partly tampered) rows it verifies."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_of(ascii_lower(F.col("text"))))
    manifest = Manifest(spark, scratch_path(spark, "manifest"))
    manifest.append("load", read(spark, sf_dir, "documents", *FIELDS), candidate=tampered)
    found = manifest.witnesses().withColumn("folded_root", folded(F.coalesce("candidate", "leaf")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP12_SQL = r"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos,
    coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
      || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
      || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
    text,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM documents),
hashed AS (
  SELECT doc_id, coalesce('s' || source, '-') AS tree, pos,
    sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(octet_length(encode(text)) || ':'
      || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS lowered,
    xor(crc, 4294967295) % 5 = 0 AS hit
  FROM leaves),
levels AS (
  SELECT tree, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM hashed GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, list_transform(range((len(nodes) + 15) // 16),
    lambda i: sha256(array_to_string(nodes[i * 16 + 1:i * 16 + 16], '')))
  FROM levels WHERE len(nodes) > 1),
subroots AS (
  SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM levels WHERE len(nodes) = 1),
tops AS (
  SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 15) // 16),
    lambda i: sha256(array_to_string(nodes[i * 16 + 1:i * 16 + 16], '')))
  FROM tops WHERE len(nodes) > 1),
steps AS (
  SELECT tree, level AS step, nodes, 0 AS top FROM levels WHERE len(nodes) > 1
  UNION ALL
  SELECT s.tree, h.height + t.level, t.nodes, 1 FROM subroots s
  JOIN (SELECT tree, max(level) AS height FROM levels GROUP BY tree) h USING (tree)
  JOIN tops t ON len(t.nodes) > 1),
heights AS (SELECT tree, max(level) AS height FROM levels GROUP BY tree),
walk AS (
  SELECT h.doc_id, h.tree, h.pos AS leaf_pos, 0 AS step, h.pos AS at, '' AS proof,
    CASE WHEN hit THEN lowered ELSE leaf END AS node
  FROM hashed h
  UNION ALL
  SELECT w.doc_id, w.tree, w.leaf_pos, w.step + 1, x.place // 16,
    w.proof || array_to_string(x.before, '') || array_to_string(x.after, ''),
    sha256(array_to_string(x.before, '') || w.node || array_to_string(x.after, ''))
  FROM walk w JOIN (
    SELECT s.tree, s.step, s.nodes, s.top, h.height, r.pos AS source_pos
    FROM steps s JOIN heights h USING (tree) JOIN subroots r USING (tree)) s
    ON s.tree = w.tree AND s.step = w.step,
  LATERAL (SELECT CASE WHEN s.step = s.height THEN s.source_pos ELSE w.at END AS place) p,
  LATERAL (SELECT p.place AS place, s.nodes[(p.place // 16) * 16 + 1:p.place] AS before,
    s.nodes[p.place + 2:(p.place // 16) * 16 + 16] AS after) x),
ends AS (
  SELECT doc_id, tree, leaf_pos AS pos, arg_max(proof, step) AS proof, arg_max(node, step) AS folded_root
  FROM walk GROUP BY ALL)
SELECT h.doc_id, h.leaf, r.subroot, t.nodes[1] AS root, sha256(e.proof) AS proof_sha256, e.folded_root,
  e.folded_root = t.nodes[1] AS verified
FROM hashed h JOIN ends e ON e.tree = h.tree AND e.pos = h.pos JOIN subroots r ON r.tree = h.tree
JOIN tops t ON len(t.nodes) = 1
"""
