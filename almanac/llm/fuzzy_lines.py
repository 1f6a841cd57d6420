"""Fuzzy line deduplication (operator 8).

Lines are normalised (A-Z lower-cased, digits alike, punctuation and spacing
dropped). Equal normalised lines are one node. Tokens are words; characters of
scripts written without spaces are tokens of their own. A line's blocks are fingerprints
of parts of its tokens, chosen so that by the pigeonhole principle edits leave one
alone: of a line of up to 12 tokens all but one or two; of one of 12 to 20 all but one (up to
19) and its windows of four, of which edits of two tokens leave one; of a longer one its runs, cut where a
token's hash is the smallest around. Two edited tokens of a longer line, or three of any, can
still leave none; an edit similarity of 0.9 allows more, so the join is not exact. Lines with a block in common, SimHashes of few
differing bits (``DISTANCE``) and similar lengths are verified by the edit similarity of the
normalised lines, links make connected groups, and of every group one occurrence
stays: the first by (doc_id, text hash, line number).

Blocks of the SimHash's own bits would need nearly all bits equal: with its 64 bits
cut into 5 blocks, 0.6 % of one-letter edits in lines of 5 to 9 words were found and
61 % in lines of 40 words or more; the blocks above find all in short lines.

Every line with a token takes part. One of fewer than ``FEW`` tokens has hardly a part that
edits leave alone, so that such lines, and those that edits could make of them, meet by
letters: where one edit is allowed by the line without any one of its characters, where more are by parts
of it, one more than edits, at all places that those could move them to (Li et al., Pass-Join). That is exact up to
``LETTERS`` characters; beyond them lines meet in runs of characters, and
three or more tokens in common count too. Bounds on lengths and on letters that occur an odd number of times
lose nothing. ``min_wide`` leaves lines alone that are fewer characters of scripts without spaces and nothing
else: a word or two; the queries take them all.

Most blocks are a single line's, and a semi join finds lines that have a partner; only
their texts are fetched. A task gives the blocks of a repeated line once.
As in a bucket of thousands of similar lines
pairs would be many, nodes are then linked to a few nodes per bucket; only what stays
apart is compared to the others of its bucket, within the join, and just pairs near
enough come out, and their edit distances are worked out for many pairs at a time. In a
bucket of more than ``CHUNK`` nodes a row is two chunks of nodes, and only links come out: comparisons
still grow with the square of lines that are alike but stay apart, rows and memory of a task don't. A line that stands in a third of all documents is one node by
a map-side combined aggregate, and its occurrences are narrow rows that the skew
join can split.

Edge cases: a null text has no lines; empty and short lines never count as
copies; line numbers start at 0; a document is a doc_id with a text, so texts under
a null or repeated id are decided apart, and rows that repeat both are one document, in
all of which its lines go or stay; a null id orders first; an empty table gives
an empty result; other columns stay where texts are cleaned, whatever their names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, written
from .components import components
from .wordhash import byte_word_hashes, mixed

MIN_TOKENS = 1
MIN_WIDE = 5             # characters of a line of scripts without spaces alone, if the caller doesn't say
FEW = 5                  # lines of fewer tokens meet by letters
KINDS = 2, 0, 3, 1       # of blocks, by their last bits: by letters, all tokens but some, windows, runs; the loosest bound first
# Differing bits of lines that meet in all tokens but one or two, in a window or as short lines in a run, and in a run.
DISTANCE = 28, 18, 10
SHORT_LINE = 250         # characters
SHORT, LONG = 19, 12     # tokens up to, and from; lines of both kinds have both kinds of blocks
TWO, WINDOWS = (5, 12), (12, 20)          # tokens of lines with blocks of all tokens but two, and of windows
WINDOW = 4
LEAST = 3                # tokens of a block of a line without some of its tokens
LETTERS = 100, 40        # characters up to which a line of few tokens, and another, meets few-token lines exactly
LETTER_RUNS, LETTER_REACH, MIN_LETTER_RUN, GRAM = 34, 6, 8, 4      # lines from so many characters on have runs of them
RUN_REACH, MIN_RUN, RUNS = 2, 4, 12       # a run's token is smallest of so many on either side
SIMILARITY = 0.9
HASHED_BYTES = 1_000_000
SEEN = 100_000           # nodes that a task remembers
PAIRS, FEW_PAIRS, LONG_LINE = 1024, 64, 1500    # pairs whose edit distances are worked out together, up to a length
CENTRES = 3              # nodes of each bucket that its nodes are compared to before the rest
CHUNK = 128              # nodes of a larger bucket that are compared to as many others in one row
# Bytes of a normalised line: a-z and non-ASCII as they are, A-Z lower, digits 0, the rest spaces.
NORMAL = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90
               else 48 if 48 <= b <= 57 else 10 if b == 10 else 32 for b in range(256))
# Characters from U+0E00 on: of scripts without spaces, and a few others.
WIDE = re.compile(rb"\xe0[\xb8-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
# Bytes of which no such character begins.
NARROW = bytes(range(0xE0))
# Bytes that don't begin a character.
INNER = bytes(range(0x80, 0xC0))
WIDE_ALONE = re.compile(rb"(?:(?:%s) ?)+" % WIDE.pattern)
LINES = "doc_id long, text_hash long, line int, node long, simhash long, length int, letters long, blocks array<long>"
PLACE = ("doc_id", "text_hash", "line")


def normal_lines(text: str | None) -> list[bytes]:
    """Normalised lines of a text, one space between words."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(NORMAL)
    return [b" ".join(line.split()) for line in data.split(b"\n")]


def tokens_in(line: bytes) -> bytes:
    """A normalised line with one space between tokens."""
    if line.isascii() or not WIDE.search(line):
        return line
    return b" ".join(WIDE.sub(rb" \g<0> ", line).split())


# A nibble's four bits in the four 16-bit lanes of a word, so that adding words adds bits.
LANES = np.array([sum((v >> b & 1) << 16 * b for b in range(4)) for v in range(16)], np.uint64)
LANE_MOST = 60_000


def bit_counts(words: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(lines, 64): in how many of a line's words each bit is set."""
    if n.max() > LANE_MOST:      # a lane holds so many; longer lines are added up in parts
        parts = -(-n // LANE_MOST)
        at = np.concatenate([np.arange(s, s + k, LANE_MOST) for s, k in zip(start, n, strict=True)])
        size = np.diff(np.append(at, len(words)))
        return np.add.reduceat(bit_counts(words, at, size), np.cumsum(parts) - parts, axis=0)
    out = np.empty((len(n), 64), np.int64)
    for i in range(0, len(n), 256):          # bounds the lanes in memory; a line's words stay together
        a, b = start[i], start[i + 256] if i + 256 < len(n) else len(words)
        byte = words[a:b].view(np.uint8).reshape(-1, 8)
        lanes = np.empty((b - a, 16), np.uint64)
        lanes[:, 0::2], lanes[:, 1::2] = LANES[byte & 15], LANES[byte >> 4]
        sums = np.add.reduceat(lanes, start[i:i + 256] - a, axis=0)
        out[i:i + 256] = sums.view(np.uint16).astype(np.int64)
    return out


def runs(words: np.ndarray, order: np.ndarray, start: np.ndarray, n: np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
    """(line, size, hash) of the runs of lines, cut where ``order`` is the smallest of ``reach`` on either side."""
    line = np.repeat(np.arange(len(n)), n)
    cut = np.ones(len(words), bool)
    for k in range(1, reach + 1):
        same = line[k:] == line[:-k]
        cut[k:] &= ~same | (order[k:] < order[:-k])
        cut[:-k] &= ~same | (order[:-k] <= order[k:])
    cut[start] = True
    at = np.flatnonzero(cut)
    size = np.diff(np.append(at, len(words)))
    place = (np.arange(len(words)) - np.repeat(at, size)).astype(np.uint64)
    return line[at], size, mixed(np.add.reduceat(mixed(words + mixed(place + np.uint64(2))), at))


def line_blocks(words: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, block) pairs, sorted and distinct, of lines of ``n`` tokens each."""
    line = np.repeat(np.arange(len(n)), n)
    h = mixed(words + np.uint64(7))
    total = np.add.reduceat(h, start)
    # The last two bits of a block tell its kind: a run's are 1, a window's 3, those of letters 2, others' 0.
    every, each = (n <= SHORT) & (n >= LEAST), (n[line] <= SHORT) & (n[line] > LEAST)
    lines = [np.flatnonzero(every), line[each]]
    blocks = [mixed(x) & ~np.uint64(3) for x in (total[every], total[line[each]] - h[each])]
    few = np.flatnonzero((n[line] >= TWO[0]) & (n[line] <= TWO[1]))
    for k in range(1, TWO[1]):
        a, b = few[:-k], few[k:]
        pair = line[a] == line[b]
        lines.append(line[a[pair]])
        blocks.append(mixed(total[line[a[pair]]] - h[a[pair]] - h[b[pair]]) & ~np.uint64(3))
    at = np.flatnonzero((n[line] >= WINDOWS[0]) & (n[line] <= WINDOWS[1]))
    at = at[at + WINDOW <= (start + n)[line[at]]]
    lines.append(line[at])
    blocks.append(mixed(sum((mixed(words[at + k] + np.uint64(k + 11)) for k in range(WINDOW)), np.zeros(len(at), np.uint64)))
                  | np.uint64(3))
    if (n >= LONG).any():
        of, size, run = runs(words, mixed(words + np.uint64(3)), start, n, RUN_REACH)
        use = (size >= MIN_RUN) & (n[of] >= LONG)
        of, run = of[use], run[use] & ~np.uint64(2) | np.uint64(1)
        by = np.lexsort((run, of))              # a line of thousands of runs keeps the smallest
        of, run = of[by], run[by]
        few = np.arange(len(of)) - np.searchsorted(of, of) < RUNS
        lines.append(of[few])
        blocks.append(run[few])

    line, block = np.concatenate(lines), np.concatenate(blocks)
    by = np.lexsort((block, line))
    line, block = line[by], block[by]
    once = np.append(True, (line[1:] != line[:-1]) | (block[1:] != block[:-1]))[:len(line)]
    return line[once], block[once]


def line_hashes(lines: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """(node keys, SimHashes, blocks) of lines of ``n`` tokens each, at least one.

    A node key's last bit tells that the line has few tokens."""
    words, few = byte_word_hashes(b"\n".join(lines)), (n < FEW).astype(np.uint64)
    start = np.cumsum(n) - n
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(start, n).astype(np.uint64)
    node = np.add.reduceat(mixed(words + mixed(place + np.uint64(1))), start)
    of, block = line_blocks(words, start, n)
    offsets = np.searchsorted(of, np.arange(len(n) + 1)).astype(np.int32)
    blocks = pa.ListArray.from_arrays(pa.array(offsets), pa.array(block.view(np.int64)))
    # Each distinct token of a line has one vote, or the commonest would make
    # unrelated lines alike.
    line = np.repeat(np.arange(len(n)), n)
    # By line and the upper 40 bits of the hash: enough to bring equal tokens together.
    order = np.argsort((line.astype(np.uint64) << np.uint64(40)) | (words >> np.uint64(24)))
    words, line = words[order], line[order]
    once = np.concatenate([[True], (words[1:] != words[:-1]) | (line[1:] != line[:-1])])
    words, n = words[once], np.bincount(line[once], minlength=len(n))
    start = np.cumsum(n) - n
    simhash = np.packbits(bit_counts(words, start, n) * 2 > n[:, None], axis=1).view(np.uint64).ravel()
    return (mixed(node) & ~np.uint64(1) | few).view(np.int64), simhash.view(np.int64), blocks


_POWERS = {name: np.cumprod(np.array([1] + [base] * (max(LETTERS) + 1), np.uint64))
           for name, base in (("up", 0x9E3779B97F4A7C15), ("down", pow(0x9E3779B97F4A7C15, -1, 1 << 64)))}


@functools.cache
def letter_parts(length: int, similarity: float) -> tuple[bool, np.ndarray, np.ndarray, np.ndarray]:
    """By what a line of so many characters meets similar ones: whether by all but one of them, and (start, size,
    key) of parts. Of the shorter line of two, parts are one more than the edits that the longer one allows, and the
    longer one's lie as far from them as the edits before, and those after, can move them."""
    def allowed(n):
        return int(n * (1 - similarity) + 1e-9)

    def cut(n, parts):
        size, more = divmod(n, parts)
        return [(i, i * size + min(i, more), size + (i < more)) for i in range(parts)]

    longest = int((length + 1e-9) / similarity)
    edits = {allowed(n) for n in range(length, longest + 1)}
    found = {(at, size, few, length, i) for few in edits if few > 1 for i, at, size in cut(length, few + 1)}
    few = allowed(length)
    for shorter in range(length - few, length + 1) if few > 1 else ():
        more = length - shorter
        for i, at, size in cut(shorter, few + 1):
            found |= {(p, size, few, shorter, i) for p in range(
                max(at - i, at + more - (few - i), 0), min(at + i, at + more + few - i, length - size) + 1)}
    at, size, *key = np.array(sorted(found), np.int64).reshape(-1, 5).T
    return 1 in edits, at, size, mixed((key[0] << 40 | key[1] << 20 | key[2]).astype(np.uint64))


def letter_blocks(lines: list[bytes], few: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, block) pairs of the normalised ``lines`` by their letters, and bits of the letters that occur an odd
    number of times, of which an edit changes two at the most. ``few``: whether a line has few tokens."""
    texts = [x.decode("utf-8", "surrogatepass") for x in lines]
    n = np.array([len(x) for x in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    start, h = np.cumsum(n) - n, mixed(codes.astype(np.uint64) + np.uint64(1))
    odd = np.bitwise_xor.reduceat(np.uint64(1) << (h >> np.uint64(58)), start)
    of, blocks = [], []
    exact = n <= np.where(few, *LETTERS)
    for length in np.unique(n[exact]).tolist():
        at = np.flatnonzero(exact & (n == length))
        whole, p, size, key = letter_parts(length, similarity)
        sums = np.zeros((len(at), length + 1), np.uint64)
        np.cumsum(h[start[at][:, None] + np.arange(length)] * _POWERS["up"][:length], axis=1, out=sums[:, 1:])
        found = [mixed((sums[:, p + size] - sums[:, p]) * _POWERS["down"][p]) + key]
        if whole:
            found += [sums[:, -1:], sums[:, :-1] + (sums[:, -1:] - sums[:, 1:]) * _POWERS["down"][1]]
        found = mixed(np.concatenate(found, axis=1))
        of.append(np.repeat(at, found.shape[1]))
        blocks.append(found.ravel())
    long = np.flatnonzero(n >= LETTER_RUNS)
    if len(long):
        c, m = h[np.repeat(n >= LETTER_RUNS, n)], n[long]
        line, order = np.repeat(long, m), c.copy()
        for k in range(1, GRAM):
            order[:-k] += np.where(line[k:] == line[:-k], mixed(c[k:] + np.uint64(k)), np.uint64(0))
        at, size, run = runs(c, mixed(order), np.cumsum(m) - m, m, LETTER_REACH)
        of.append(long[at[size >= MIN_LETTER_RUN]])
        blocks.append(run[size >= MIN_LETTER_RUN])
    pairs = np.unique(np.stack([np.concatenate(of).astype(np.uint64), np.concatenate(blocks) & ~np.uint64(1) | np.uint64(2)]), axis=1)
    return pairs[0].astype(np.int64), pairs[1], odd


def lines_of(batches: Iterator[pa.RecordBatch], similarity: float = SIMILARITY, min_wide: int = MIN_WIDE) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text_hash, line, node, simhash, length, letters, blocks) of the lines of (doc_id, text_hash,
    text) rows, hashed many at a time. ``length`` is the normalised line's, in characters; ``letters`` are null where a
    line meets none by letters; they are null and ``blocks`` empty where a task has lately given those of the same node."""
    seen = set()

    def rows(ids, hashes, numbers, sizes, lengths, lines, normals):
        n, length = np.array(sizes, np.int64), np.array(lengths, np.int64)
        node, simhash, blocks = line_hashes(lines, n)
        new = np.zeros(len(node), bool)
        for i, x in enumerate(node.tolist()):
            if x not in seen:
                new[i] = True
                seen.add(x)
        if len(seen) > SEEN:
            seen.clear()
        # A node's blocks are needed once: a line in many documents would fill the tasks of its blocks.
        of = np.repeat(np.arange(len(n)), np.diff(blocks.offsets.to_numpy()))
        of, block = of[new[of]], blocks.values.to_numpy()[new[of]]
        # An edit takes a token away at the most, or two where one is a character of its own.
        most = np.floor(np.floor((length + 1e-9) / similarity) * (1 - similarity) + 1e-9)
        wide = np.array([x != y for x, y in zip(lines, normals, strict=True)])
        by_letters = np.flatnonzero(new & (most > 0) & (n - FEW < np.where(wide, 2 * most, most)))
        letters = np.zeros(len(n), np.int64)
        if len(by_letters):
            line, more, odd = letter_blocks([normals[i] for i in by_letters], n[by_letters] < FEW, similarity)
            letters[by_letters] = odd.view(np.int64)
            of, block = np.append(of, by_letters[line]), np.append(block, more.view(np.int64))
            by = np.argsort(of, kind="stable")
            of, block = of[by], block[by]
        none = np.ones(len(n), bool)
        none[by_letters] = False
        blocks = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(n) + 1)).astype(np.int32)), pa.array(block))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(numbers, pa.int32()),
             pa.array(node), pa.array(simhash), pa.array(lengths, pa.int32()), pa.array(letters, mask=none), blocks],
            names=[*PLACE, "node", "simhash", "length", "letters", "blocks"])

    for batch in batches:
        held, size = [], 0
        for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                           batch.column(2), strict=True):
            lines = normal_lines(text.as_py())
            wide = any(x.translate(None, NARROW) for x in lines)
            for number, normal in enumerate(lines):
                line = tokens_in(normal) if wide else normal
                n = line.count(b" ") + 1 if line else 0
                if n >= MIN_TOKENS and not (n < min_wide and wide and WIDE_ALONE.fullmatch(line)):
                    length = len(normal) if normal.isascii() else len(normal.translate(None, INNER))
                    held.append((doc_id, text_hash, number, n, length, line, normal))
                    size += len(line)
            if size > HASHED_BYTES:
                yield rows(*zip(*held, strict=True))
                held, size = [], 0
        if size:
            yield rows(*zip(*held, strict=True))


def edits(longer: Column, similarity: float) -> Column:
    """How many edits the edit similarity allows to lines of which the longer one has so many characters."""
    return F.floor(longer * (1 - similarity) + 1e-9).cast("int")


def near(similarity: float, x: str, y: str = "") -> Column:
    """Whether rows of one block, with columns ``x`` and ``y``, may be similar lines.

    Lengths differ by one edit each at least, so that bound loses nothing; nor does that of letters, by which only
    lines of few tokens meet others.
    """
    bits = F.bit_count(F.col(f"{x}simhash").bitwiseXOR(F.col(f"{y}simhash")))
    whole, window, run = DISTANCE
    longer = F.greatest(F.col(f"{x}length"), F.col(f"{y}length"))
    kind = F.col(f"{x}block").bitwiseAND(F.lit(3))
    most = edits(longer, similarity)
    odd = F.bit_count(F.col(f"{x}letters").bitwiseXOR(F.col(f"{y}letters")))
    return F.when(kind == 2, few_tokens(f"{x}node", f"{y}node") & (odd <= 2 * most)).otherwise(
        bits <= F.when(kind == 1, F.when(longer <= SHORT_LINE, window).otherwise(run)).when(kind == 3, window).otherwise(whole)) & (
        F.abs(F.col(f"{x}length") - F.col(f"{y}length")) <= most)


def few_tokens(x: str, y: str) -> Column:
    """Whether a node of two has few tokens."""
    return F.col(x).bitwiseOR(F.col(y)).bitwiseAND(F.lit(1)) == 1


def met_first(x: str, y: str) -> Column:
    """Whether the block in which rows meet is the first that they share, of the kind with the loosest bound."""
    shared = F.array_intersect(f"{x}blocks", f"{y}blocks")
    letters, whole, window, run = (F.array_min(F.filter(shared, lambda b, k=k: b.bitwiseAND(F.lit(3)) == k)) for k in KINDS)
    return F.col(f"{x}block") == F.coalesce(F.when(few_tokens(f"{x}node", f"{y}node"), letters), whole, window, run)


def partnered(lines: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(block, node, simhash, length, letters, times) of the nodes with another node within the distance in that block.

    No pairs are formed: the join only asks whether a row has a partner at all.
    """
    # One shuffle of two longs and a sort; most blocks are of one node, so what else is asked of nodes is joined after.
    every = Window.partitionBy("block")
    several = (lines.select("node", F.explode("blocks").alias("block"))
               .select("node", "block", F.min("node").over(every).alias("lo"), F.max("node").over(every).alias("hi"),
                       F.max(F.col("node").bitwiseAND(F.lit(1))).over(every).alias("few"))
               .where("lo <> hi and (few = 1 or block & 3 <> 2)").select("block", "node").distinct())
    shared = written(several.join(nodes.select("node", "simhash", "length", "letters", "times").hint("shuffle_hash"), "node"),
                     "line-blocks")
    x, y = shared.alias("x"), shared.alias("y")
    # Hashed, not sorted: a partition of these narrow rows is small, and one shuffle serves both sides.
    met = x.join(y.hint("shuffle_hash"), (F.col("x.block") == F.col("y.block")) & (F.col("x.node") != F.col("y.node"))
                 & near(similarity, "x.", "y."), "left_semi")
    return written(met, "line-candidates")


def same_document(id_a: str, hash_a: str, id_b: str, hash_b: str) -> Column:
    return F.col(id_a).eqNullSafe(F.col(id_b)) & (F.col(hash_a) == F.col(hash_b))


def line_texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text): the normalised lines of nodes, cut from the documents where they first stand."""
    places = wanted.select("node", "first.*").groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("line", "node")).alias("at"))

    @F.pandas_udf("array<struct<node:long,text:string>>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, ats in batches:
            out = []
            for text, at in zip(texts, ats, strict=True):
                lines = normal_lines(text)
                out.append([{"node": p["node"], "text": lines[p["line"]].decode("utf-8", "replace")}
                            for p in at if p["line"] < len(lines)])
            yield pd.Series(out, dtype=object)

    found = (docs.select(F.col("doc_id").alias("of_id"), "text", F.xxhash64("text").alias("of_hash"))
             .join(places.hint("shuffle_hash"), same_document("of_id", "of_hash", "doc_id", "text_hash"))
             .select(F.explode(cut("text", "at")).alias("r")).select("r.*"))
    # Rows that repeat a document give a node's line more than once.
    return written(found.groupBy("node").agg(F.max("text").alias("text")), "line-texts")


def banded(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the edit distances of pairs of texts are at most ``most``, each pair a column of ``x`` and ``y``.

    ``m`` <= ``n`` are the texts' sizes, apart by ``most`` at the most. All pairs advance together over the
    antidiagonals of their tables, on the diagonals that so few edits can reach and return from."""
    out = np.zeros(len(m), bool)
    at = np.arange(len(m))
    tall, wide = len(x), len(y)
    back = x[::-1]
    spare = (most - (n - m)) // 2
    left, right = int(spare.max()), int((n - m + spare).max())
    big = 16_000 if wide < 16_000 else 1 << 30
    # By diagonal (j - i), with a row that stays big on either side: the last value on it.
    v = np.full((left + right + 3, len(m)), big, np.int16 if big == 16_000 else np.int32)
    v[left + 1] = 0
    out[(m + n == 0)] = True
    for s in range(1, int((m + n).max()) + 1):
        low, high = max(-left, 2 - s, s - 2 * tall), min(right, s - 2, 2 * wide - s)
        low, high = low + (s - low) % 2, high - (s - high) % 2
        if low <= high:
            i, j, size = (s - low) // 2, (s + low) // 2, (high - low) // 2 + 1
            c = low + left + 1
            to = v[c:c + 2 * size - 1:2]
            side = np.minimum(v[c - 1:c + 2 * size - 2:2], v[c + 1:c + 2 * size:2])
            side += 1
            to += back[tall - i:tall - i + size] != y[j - 1:j - 1 + size]
            np.minimum(to, side, out=to)
        if s <= left:
            v[left + 1 - s] = s
        if s <= right:
            v[left + 1 + s] = s
        done = np.flatnonzero(m + n == s)
        if len(done):
            out[at[done]] = v[(n - m)[done] + left + 1, done] <= most[done]
        if s % 32 == 0:
            # What a diagonal's value lacks to the last one must come as well.
            further = np.abs(np.arange(-left - 1, right + 2)[:, None] - (n - m)[None, :])
            open_ = (m + n > s) & ((v + further).min(axis=0) <= most)
            if 2 * open_.sum() <= len(at):
                at, m, n, most = at[open_], m[open_], n[open_], most[open_]
                if not len(at):
                    break
                back, y, v = back[:, open_], y[:, open_], np.ascontiguousarray(v[:, open_])
    return out


def distance(x: np.ndarray, y: np.ndarray) -> int:
    """The edit distance of two texts, a column of its table in the bits of two numbers (Myers)."""
    every = (1 << len(x)) - 1
    where = {c: int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little") for c in np.unique(x).tolist()}
    up, down, last = every, 0, len(x)
    for c in y.tolist():
        same = where.get(c, 0) | down
        flat = ((((same & up) + up) ^ up) | same) & every
        more, less = down | (every ^ (up | flat)), up & flat
        # The highest bit tells whether the last row's value grows.
        last += (more.bit_length() == len(x)) - (less.bit_length() == len(x))
        more = (more << 1 | 1) & every
        up, down = (less << 1 | (every ^ (more | flat))) & every, more & flat
    return last


def within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the edit distances of the texts ``a`` and ``b`` are at most ``most``."""
    out, rest = np.zeros(len(a), bool), []
    for k, (p, q) in enumerate(zip(a, b, strict=True)):
        few = most[k]
        if abs(len(p) - len(q)) > few:
            continue
        u, v = p.split(" "), q.split(" ")
        # Words put for words at the same places bound the distance from above.
        if len(u) == len(v) and sum(max(len(c), len(d)) for c, d in zip(u, v, strict=True) if c != d) <= few:
            out[k] = True
            continue
        x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in sorted((p, q), key=len))
        other = np.flatnonzero(x != y[:len(x)])
        # What both have at either end costs nothing; the first difference is before the end of x.
        head = other[0] if len(other) else len(x)
        x, y = x[head:], y[head:]
        other = np.flatnonzero(x[::-1] != y[len(y) - len(x):][::-1])
        tail = other[0] if len(other) else len(x)
        x, y = x[:len(x) - tail], y[:len(y) - tail]
        if len(y) <= few:
            out[k] = True
        else:
            rest.append((len(y), k, x, y))
    # Longest first, so that pairs of a like size share a table; few or long ones would make slow ones.
    rest.sort(key=lambda r: r[:2])
    while rest:
        part = PAIRS if rest[-1][0] <= LONG_LINE else 1
        rest, now = rest[:-part], rest[-part:]
        of = np.array([r[1] for r in now])
        if len(now) < FEW_PAIRS:
            out[of] = [(distance(x, y) if len(x) else len(y)) <= most[k] for _, k, x, y in now]
            continue
        m, n = (np.array([len(r[c]) for r in now]) for c in (2, 3))
        kind = np.uint8 if all(r[c].max(initial=0) < 256 for r in now for c in (2, 3)) else np.uint32
        x, y = np.zeros((m.max(), len(now)), kind), np.zeros((n.max(), len(now)), kind)
        for i, (_, _, p, q) in enumerate(now):
            x[:len(p), i], y[:len(q), i] = p, q
        out[of] = banded(x, y, m, n, most[of])
    return out


def edit_limits(a: Column, b: Column, most: Column) -> Column:
    """Whether the edit distance of two normalised lines is at most ``most``."""
    @F.pandas_udf("boolean")
    def decided(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y, limits in batches:
            yield pd.Series(within(x.tolist(), y.tolist(), limits.to_numpy(np.int64)))
    return decided(a, b, most)


def similar(a: Column, b: Column, similarity: float) -> Column:
    """Whether two normalised lines have the edit similarity."""
    return edit_limits(a, b, edits(F.greatest(F.length(a), F.length(b)), similarity))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose lines have the edit similarity.

    Pairs are few bytes and much work, so their number of partitions isn't left to their size."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    both = pairs.distinct().join(a, "a").repartition(parts, "b").join(b.repartition(parts, "b"), "b")
    # Links are few and read in every round after; without the shuffle each would open a file a partition.
    return written(both.where(similar(F.col("ta"), F.col("tb"), similarity)).select("a", "b").repartition("a"), "line-links")


def apart(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (block, node, simhash, length, letters) of the blocks that hold several components, with ``component``."""
    found = blocks.select("block", "node", "simhash", "length", "letters").join(components(links), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    several = found.groupBy("block").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where(
        "lo <> hi").select("block")
    return written(found.join(several, "block", "left_semi"), "line-open")


def chunk_links(block: int, xs: list, ys: list, same: bool, similarity: float) -> list[dict]:
    """Links {a, b} of the nodes ``xs`` to the nodes ``ys`` of one bucket: the pairs that the join of a small
    bucket makes by ``near`` and ``met_first``, and then verifies. ``same``: both are one list."""
    (n, h, size, of, odd), (m, g, wide, to, other) = (
        [np.array([r[c] for r in rows], np.int64) for c in ("node", "simhash", "length", "component", "letters")] for rows in (xs, ys))
    longer = np.maximum(size[:, None], wide[None, :])
    whole, window, run = DISTANCE
    most = window if block & 3 == 3 else np.where(longer <= SHORT_LINE, window, run) if block & 3 == 1 else whole
    limit, few = np.floor(longer * (1 - similarity) + 1e-9), (n[:, None] | m[None, :]) & 1 == 1
    bits, most = (odd[:, None] ^ other[None, :], 2 * limit) if block & 3 == 2 else (h[:, None] ^ g[None, :], most)
    ok = (np.bitwise_count(bits.view(np.uint64)) <= most) & (of[:, None] != to[None, :]) & (few | (block & 3 != 2)) & (
        np.abs(size[:, None] - wide[None, :]) <= limit)
    if same:
        ok &= n[:, None] < m[None, :]
    kept, p, q = [], [set(r["blocks"]) for r in xs], [set(r["blocks"]) for r in ys]
    for i, j in zip(*(k.tolist() for k in np.nonzero(ok)), strict=True):
        shared = p[i] & q[j]
        if block == next(min(of_kind) for kind in KINDS if few[i, j] or kind != 2
                         if (of_kind := [b for b in shared if b & 3 == kind])):
            kept.append((i, j))
    a, b = [xs[i]["text"] for i, _ in kept], [ys[j]["text"] for _, j in kept]
    limits = np.floor(np.array([max(len(t), len(u)) for t, u in zip(a, b, strict=True)]) * (1 - similarity) + 1e-9)
    return [{"a": min(n[i], m[j]), "b": max(n[i], m[j])}
            for (i, j), link in zip(kept, within(a, b, limits.astype(np.int64)), strict=True) if link]


def chunked(rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) within large buckets. ``rows`` are (block, node, simhash, length, letters, component,
    blocks, main, n_other, n_main).

    Pairs of such a bucket are too many for rows of their own, so a row is a chunk of nodes outside the bucket's
    main component and another chunk; nodes of the main component aren't compared to each other. A chunk's rows
    are dealt out by the other chunk, so that a bucket is spread over tasks, and a task holds two chunks."""
    other, main = (F.ceil(F.col(c) / CHUNK) for c in ("n_other", "n_main"))
    number = F.xxhash64("node")
    chunks = written(
        rows.join(texts, "node").withColumn("k", other).withColumn("chunks", other + main)
        .withColumn("chunk", F.when(F.col("component") == F.col("main"), other + F.pmod(number, F.greatest(main, F.lit(1))))
                    .otherwise(F.pmod(number, F.greatest(other, F.lit(1)))))
        .groupBy("block", "k", "chunks", "chunk").agg(F.collect_list(F.struct(
            "node", "simhash", "length", "letters", "component", "blocks", "text")).alias("nodes")), "line-chunks")

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def found(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([chunk_links(block, xs, ys, same, similarity) for block, xs, ys, same
                             in zip(*batch, strict=True)], dtype=object)

    x = chunks.where("chunk < k").select("block", F.col("chunk").alias("own"), F.col("nodes").alias("xs"), F.explode(
        F.sequence("chunk", F.col("chunks") - 1)).alias("chunk"))
    both = x.join(chunks.select("block", "chunk", "nodes").hint("shuffle_hash"), ["block", "chunk"])
    return written(both.select(F.explode(found("block", "xs", "nodes", F.col("own") == F.col("chunk"))).alias("r"))
                   .select("r.*").distinct(), "line-links")


def line_groups(lines: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, group, keep): keep is the ``PLACE`` that stays of each node's group."""
    nodes = written(lines.groupBy("node").agg(
        F.min("simhash").alias("simhash"), F.min("length").alias("length"), F.coalesce(F.max("letters"), F.lit(0)).alias("letters"),
        F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("times")), "line-nodes")
    rows = partnered(lines, nodes, similarity)
    shared = rows.groupBy("node").agg(F.collect_list("block").alias("blocks"))
    texts = line_texts(nodes.join(rows.select("node").distinct(), "node", "left_semi"), docs)

    # A bucket's commonest line is the likeliest original of the others, so most are near it.
    centres = rows.groupBy("block").agg(F.max(F.struct("times", "node", "simhash", "length", "letters")).alias("centre"),
                                        F.count("*").alias("n")).where("n > 1").drop("n")
    open_rows = written(rows.drop("times").join(centres, "block"), "line-buckets")
    star = open_rows.where((F.col("node") != F.col("centre.node")) & near(similarity, "", "centre."))
    # One centre for each node, whatever blocks it shares with others: what that leaves apart follows below.
    first = star.groupBy(F.col("node").alias("b")).agg(F.max(F.struct("centre.times", "centre.node"))["node"].alias("a"))
    links = verified(first.select("a", "b"), texts, similarity)

    for turn in range(CENTRES - 1):
        rows = apart(open_rows, links)
        centre = rows.groupBy("block").agg(F.min_by(F.struct("node", "simhash", "length", "letters", "component"), F.xxhash64(
            "node", F.lit(turn))).alias("c"))
        pairs = rows.join(centre, "block").where((F.col("component") != F.col("c.component"))
                                                 & near(similarity, "", "c."))
        links = links.unionByName(verified(pairs.select(
            F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")), texts, similarity))

    # What is still apart is compared within its bucket; a pair comes out of the first block it shares.
    rows = apart(open_rows, links).join(shared, "node")
    main = (rows.groupBy("block", "component").agg(F.count("*").alias("n")).groupBy("block")
            .agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"))
            .select("block", F.col("most.component").alias("main"), F.col("most.n").alias("n_main"),
                    (F.col("n") - F.col("most.n")).alias("n_other")))
    every = rows.join(main, "block")
    full, large = every.where(f"n_main + n_other <= {CHUNK}"), every.where(f"n_main + n_other > {CHUNK}")
    x, y = full.where("component <> main").alias("x"), full.alias("y")
    rest = x.join(y, (F.col("x.block") == F.col("y.block")) & (F.col("x.component") != F.col("y.component"))
                  & near(similarity, "x.", "y.") & met_first("x.", "y.")
                  & ((F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))))
    links = links.unionByName(verified(rest.select(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")), texts, similarity))
    links = links.unionByName(chunked(large, texts, similarity))

    grouped = nodes.join(components(links), "node", "left").select(
        "node", "first", "times", F.coalesce("component", "node").alias("group"))
    keep = grouped.groupBy("group").agg(F.min("first").alias("keep"), F.sum("times").alias("members"))
    return grouped.select("node", "group").join(keep.where("members > 1"), "group").select("node", "group", "keep")


def dropped_lines(docs: DataFrame, similarity: float = SIMILARITY, min_wide: int = MIN_WIDE) -> DataFrame:
    """(doc_id, text_hash, dropped): the sorted numbers of the lines that go, where there are any.

    A line of fewer than ``min_wide`` characters of scripts without spaces, and nothing else, stays."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    lines = written(rows.mapInArrow(lambda batches: lines_of(batches, similarity, min_wide), LINES), "lines")
    groups = written(line_groups(lines, docs, similarity), "line-groups")
    copies = lines.join(groups, "node").where(~F.struct(*PLACE).eqNullSafe(F.col("keep")))
    return written(copies.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set("line")).alias("dropped")), "dropped-lines")


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, into: str = "dropped", min_wide: int = MIN_WIDE) -> DataFrame:
    """``docs`` with those lines taken out of ``text`` and a column ``into`` (in place of one of this
    name) of their numbers."""
    gone = dropped_lines(docs, similarity, min_wide)
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("of_id"),
                       F.xxhash64("text").alias("of_hash"))
    out = rows.join(gone.hint("shuffle_hash"), same_document("of_id", "of_hash", "doc_id", "text_hash"), "left")
    text, dropped = F.col("doc.text"), F.col("dropped")
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(dropped, i))
    cleaned = F.when(dropped.isNull(), text).otherwise(F.array_join(kept, "\n")).alias("text")
    columns = [cleaned if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns if c != into]
    return out.select(*columns, F.coalesce(dropped, F.array().cast("array<int>")).alias(into))


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that go from every document."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    every = docs.select(F.col("doc_id").alias("of_id"), F.xxhash64("text").alias("of_hash"),
                        F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"))
    out = every.join(dropped_lines(docs, min_wide=1), same_document("of_id", "of_hash", "doc_id", "text_hash"), "left")
    return out.select(
        F.col("of_id").alias("doc_id"), "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join(F.transform("dropped", lambda i: i.cast("string")), ","), F.lit("")).alias("dropped_lines"))
