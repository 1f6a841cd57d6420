"""Language ID by segmentation-marginalised unigrams (operator 9).

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability is the sum over all its segmentations into pieces, by the
forward algorithm; a text's is the product over its words, and the prediction is
the language with the largest. Piece probabilities come from expected counts
(forward-backward) over the labelled training texts.

Words are runs of letters in lower case, each with the vocabulary's word mark in
front; whole words and whole texts are scored, the forward table being rescaled along
long words (in the fit alone, words are cut every ``MAX_WORD`` letters). Words repeat, so a
task segments each distinct word once, for many words at a time in numpy.

The posterior says which learned language is likeliest, never whether any is. For that
``fit``, the log probability per letter, is held against the mean of the predicted
language's training words: ``known`` is false where it is over ``MOST_UNLIKE`` times that, and
``SHORT_SLACK`` / sqrt(letters) more, since few letters vary much. In prose of the learned
languages it is 1.0 to 1.6 times, in random letters, base64 and other languages 2.4 to 4.

Size: the model is (pieces of the vocabulary) x (learned languages) numbers, set
by the vocabulary file and not by the documents. It is fitted on about
``per_language`` training documents of each language, chosen by a hash of
``doc_id``, with all their text (a documented bound of the fit); every document
is scored. No row meets another in scoring, so no key can be hot.

Edge cases: a null text or one without a letter is ``und`` with score 0, as is
every text if nothing could be learned; characters outside the vocabulary have a
small fixed probability; ties go to the smaller language name; null ids and
labels are never learned from; other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PER_LANGUAGE = 4000
EM_STEPS = 2
MAX_WORD = 40            # letters; words of the training texts only
RESCALE = 32             # letters after which the forward table is rescaled
MOST_UNLIKE, SHORT_SLACK = 2.0, 4.0
MARK = "▁"          # word mark of the vocabulary
RARE = 1e-6              # probability of a character that is no piece, and floor of all pieces
KNOWN_WORDS = 200_000    # words whose scores a task remembers at once
SCORED_WORDS = 50_000    # words of texts, repeats counted, that are scored at once
LETTERS = re.compile(r"[^\W\d_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_in(text: str | None, most: int | None = None) -> Iterator[list[str]]:
    """Lists, of bounded length, of the text's words, cut every ``most`` letters if that is given."""
    found = (m.group() for m in LETTERS.finditer(text.lower())) if text else iter(())
    while words := list(islice(found, SCORED_WORDS)):
        if not any(c.isalpha() for w in words for c in w):      # fractions and the like only
            continue
        if most and max(map(len, words)) > most:
            words = [w[i:i + most] for w in words for i in range(0, len(w), most)]
        yield words


class Lattice:
    """The vocabulary's pieces as hashes of all their prefixes."""

    def __init__(self, pieces: list[str]):
        prefix: dict[int, int] = {}
        with np.errstate(over="ignore"):
            for number, piece in enumerate(pieces):
                h = np.uint64(0)
                for c in piece:
                    h = h * BASE + np.uint64(ord(c) + 1)
                    prefix.setdefault(int(h), -1)
                prefix[int(h)] = number
        self.hashes = np.array(sorted(prefix), dtype=np.uint64)
        self.piece = np.array([prefix[int(h)] for h in self.hashes], dtype=np.int32)
        self.n = len(pieces)
        self.longest = max(map(len, pieces), default=1)

    def arcs(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of all pieces in equally long words, by start."""
        n, length = codes.shape
        for start in range(length):
            rows, h = np.arange(n), np.zeros(n, np.uint64)
            for end in range(start + 1, length + 1):
                h = h * BASE + codes[rows, end - 1]
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                known = self.hashes[at] == h
                if end == start + 1:    # a character outside the vocabulary is an arc of its own
                    yield start, end, rows[~known], np.full(int((~known).sum()), self.n, np.int32)
                    alone = known & (self.piece[at] < 0)
                    yield start, end, rows[alone], np.full(int(alone.sum()), self.n, np.int32)
                rows, h, at = rows[known], h[known], at[known]
                if not len(rows):
                    break
                piece = self.piece[at]
                full = piece >= 0
                if full.any():
                    yield start, end, rows[full], piece[full]


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, code matrix with the word mark in front) of equally long words."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        of = np.flatnonzero(sizes == size)
        text = "".join([MARK + words[i] for i in of])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        yield of, codes.reshape(len(of), size + 1).astype(np.uint64) + np.uint64(1)


def log_likelihoods(lattice: Lattice, p: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(word | language), summed over all segmentations; p is (pieces + 1, languages)."""
    out = np.empty((len(words), p.shape[1]))
    with np.errstate(over="ignore"):
        for of, codes in by_length(words):
            forward = np.zeros((codes.shape[1] + 1, len(of), p.shape[1]))
            forward[0] = 1
            scale, scaled = np.zeros((len(of), 1)), 0
            for start, end, rows, piece in lattice.arcs(codes):
                if start >= scaled + RESCALE:    # all that leads to here is summed up
                    most, scaled = forward[start].max(1, keepdims=True), start
                    forward[start:start + lattice.longest + 1] /= most
                    scale += np.log(most)
                forward[end][rows] += forward[start][rows] * p[piece]
            out[of] = np.log(np.maximum(forward[-1], np.finfo(float).tiny)) + scale
    return out


def expected_counts(lattice: Lattice, p: np.ndarray, words: list[str], times: np.ndarray) -> np.ndarray:
    """Expected uses of each piece under one language's p (pieces + 1), by forward-backward."""
    out = np.zeros(lattice.n + 1)
    with np.errstate(over="ignore"):
        for of, codes in by_length(words):
            arcs = list(lattice.arcs(codes))
            forward = np.zeros((codes.shape[1] + 1, len(of)))
            backward = np.zeros_like(forward)
            forward[0], backward[-1] = 1, 1
            for start, end, rows, piece in arcs:
                forward[end][rows] += forward[start][rows] * p[piece]
            for start, end, rows, piece in reversed(arcs):
                backward[start][rows] += backward[end][rows] * p[piece]
            share = times[of] / forward[-1]
            for start, end, rows, piece in arcs:
                np.add.at(out, piece, forward[start][rows] * p[piece] * backward[end][rows] * share[rows])
    return out


def pieces_of(vocabulary: str) -> list[str]:
    """The vocabulary's pieces that can stand in a lower-case word of letters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    found = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        body = piece[1:] if piece.startswith(MARK) else piece
        if not model.is_control(i) and not model.is_byte(i) and (piece == MARK or (
                LETTERS.fullmatch(body) and body == body.lower())):
            found.append(piece)
    return found


class LanguageModel:
    """Fitted piece probabilities: languages (sorted), pieces, (pieces + 1) x languages; and the mean
    log probability per letter of each language's training words."""

    def __init__(self, languages: list[str], pieces: list[str], p: np.ndarray, typical: np.ndarray):
        self.languages, self.pieces, self.p, self.typical = languages, pieces, p, typical


def fit(docs: DataFrame, *, vocabulary: str = VOCABULARY, per_language: int = PER_LANGUAGE,
        steps: int = EM_STEPS) -> LanguageModel:
    """Fit on (doc_id, text, lang); rows with a null in any of them are left out."""
    spark = docs.sparkSession
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    pieces, languages = pieces_of(vocabulary), sorted(sizes)
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces) + 1, 0)), np.zeros(0))
    share = F.element_at(F.create_map(*chain.from_iterable(
        (F.lit(k), F.lit(min(1.0, per_language / n))) for k, n in sizes.items())), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            for text, lang in zip(batch.text, batch.lang, strict=True):
                for words in words_in(text, MAX_WORD):
                    for w in words:
                        seen[lang, w] = seen.get((lang, w), 0) + 1
            yield pd.DataFrame({"lang": pd.Series([k[0] for k in seen], dtype=object),
                                "word": pd.Series([k[1] for k in seen], dtype=object),
                                "n": pd.Series(list(seen.values()), dtype="int64")})

    counts = written(usable.where(draw < share).select("text", "lang")
                     .mapInPandas(counted, "lang string, word string, n long")
                     .groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    p = np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1))
    p[-1] = RARE
    for _ in range(steps):
        shared = spark.sparkContext.broadcast((pieces, languages, p))

        def expected(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            pieces, languages, p = shared.value
            lattice, total = Lattice(pieces), np.zeros_like(p)
            for batch in batches:
                for k, lang in enumerate(languages):
                    own = batch[batch.lang == lang]
                    if len(own):
                        total[:, k] += expected_counts(lattice, np.ascontiguousarray(p[:, k]),
                                                       list(own.word), own.n.to_numpy(float))
            piece, k = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "k": k, "n": total[piece, k]})

        sums = (counts.mapInPandas(expected, "piece long, k long, n double")
                .groupBy("piece", "k").agg(F.sum("n").alias("n")))
        p = np.zeros_like(p)
        for r in sums.toLocalIterator():     # at most pieces x languages rows
            p[r.piece, r.k] = r.n
        p = np.round(p, 3)                   # sums may differ in their last digits between runs
        p[-1] = 0
        p = np.maximum(p / np.maximum(p.sum(0), 1), RARE)
    shared = spark.sparkContext.broadcast((pieces, languages, p))

    def unlikely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, languages, p = shared.value
        lattice = Lattice(pieces)
        for batch in batches:
            words, n = list(batch.word), batch.n.to_numpy(float)
            own = batch.lang.map({x: k for k, x in enumerate(languages)}).to_numpy()
            log = log_likelihoods(lattice, p, words)[np.arange(len(words)), own]
            yield pd.DataFrame({"k": own, "log": n * log, "letters": n * np.array([len(w) for w in words], float)})

    typical = np.full(len(languages), -np.inf)      # of a language without a word: nothing is unlike it
    for r in (counts.mapInPandas(unlikely, "k long, log double, letters double").groupBy("k")
              .agg(F.sum("log").alias("log"), F.sum("letters").alias("letters")).toLocalIterator()):
        typical[r.k] = round(r.log / r.letters, 6)
    return LanguageModel(languages, pieces, p, typical)


class WordScores:
    """Scores of the words a task has met, ``KNOWN_WORDS`` at most at a time."""

    def __init__(self, pieces: list[str], p: np.ndarray):
        self.lattice, self.p = Lattice(pieces), p
        self.row: dict[str, int] = {}
        self.values = np.empty((0, p.shape[1]))

    def of(self, words: list[str]) -> np.ndarray:
        """log P(word | language) of each of ``words``."""
        new = list(set(words).difference(self.row))
        if len(self.row) + len(new) > KNOWN_WORDS:
            self.row, self.values, new = {}, self.values[:0], list(set(words))
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.values = np.concatenate([self.values, log_likelihoods(self.lattice, self.p, new)])
        return self.values[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))]


def text_scores(scores: WordScores, texts: list[str | None], at_once: int = SCORED_WORDS):
    """(number of letters, sum of word scores per language) of each text."""
    count = np.zeros(len(texts), np.int64)
    total = np.zeros((len(texts), scores.p.shape[1]))
    pending: list[tuple[int, list[str]]] = []

    def flush() -> None:
        if pending:
            values = scores.of(list(chain.from_iterable(w for _, w in pending)))
            starts = np.cumsum([0, *(len(w) for _, w in pending[:-1])])
            np.add.at(total, [i for i, _ in pending], np.add.reduceat(values, starts))
            pending.clear()

    held = 0
    for i, text in enumerate(texts):
        for words in words_in(text):
            pending.append((i, words))
            count[i] += sum(map(len, words))
            held += len(words)
            if held >= at_once:
                flush()
                held = 0
    flush()
    return count, total


def predict(model: LanguageModel, text: Column, spark: SparkSession) -> Column:
    """Struct (lang_pred, score, fit, known).

    The score is the posterior under equal priors; ``fit`` is the log probability per letter under the
    predicted language, and ``known`` whether that is like the language's own.
    """
    shared = spark.sparkContext.broadcast((model.languages, model.pieces, model.p, model.typical))

    @F.pandas_udf("lang_pred string, score double, fit double, known boolean")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        languages, pieces, p, typical = shared.value
        scores = WordScores(pieces, p)
        for batch in batches:
            names, values = np.full(len(batch), "und", dtype=object), np.zeros(len(batch))
            fit, known = np.full(len(batch), -np.inf), np.zeros(len(batch), bool)
            if languages:
                count, total = text_scores(scores, [t if isinstance(t, str) else None for t in batch])
                some = np.flatnonzero(count)
                best = total[some].argmax(1)
                names[some] = np.array(languages, dtype=object)[best]
                values[some] = 1 / np.exp(total[some] - total[some].max(1, keepdims=True)).sum(1)
                fit[some] = total[some].max(1) / count[some]
                known[some] = fit[some] >= MOST_UNLIKE * typical[best] - SHORT_SLACK / np.sqrt(count[some])
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": values, "fit": fit, "known": known})
    return score(text)


def identify(docs: DataFrame, model: LanguageModel, into: str = "language") -> DataFrame:
    """``docs`` with the struct column ``into`` (in place of one of this name): lang_pred, score, fit, known."""
    return docs.withColumn(into, predict(model, F.col("text"), docs.sparkSession))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                        F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("score"))
