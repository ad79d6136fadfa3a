"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Every language has a probability for each piece of the vocabulary. The probability of a word is the sum,
over all ways to cut it into pieces, of the products of the pieces' probabilities; the forward algorithm
adds them up from left to right. A text's probability is the product over its words, and with the
languages' shares as prior it turns into a posterior. Any single character may be a piece of its own, at
a small probability where the vocabulary does not hold it, so no word is impossible.

Learning is expectation-maximisation: forward and backward sums give each piece's expected count over
all cuts of the training words, first with equal probabilities, then with those just found. Words are
counted per language by Spark, every round runs over the distinct words in tasks, and the driver sees
only the counts per piece and language, whose number the vocabulary bounds.

What is learned from a sample: ``sample_docs`` documents of each language, the first by a hash of the id;
whole texts of these. Priors count all training documents. Rows without id or language teach nothing,
and of rows that share an id each is taken. At most ``MAX_LANGUAGES`` languages are accepted.

Defined results: words are runs of letters (with their marks) of the lower-cased text. A text that is NULL
or has no letter is ``und`` with score 0; so is every text if there is nothing to learn from. Equal
posteriors go to the first language by name. Repeated rows give repeated results; results depend on the
text alone; other columns are carried along, but for the two results, which are replaced.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import saved, whole
from riskspark.llm.words import chunks

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNDETERMINED = "und"
START = "▁"  # fixed value: how the vocabulary marks the start of a word
MAX_LANGUAGES = 200
SAMPLE_PARTS = 64
TINY = 1e-150
# words of up to this length are scored many at a time, without a scale of their own
SHORT_WORD = 30
# probabilities remembered by a task, and text scored at a time, per language
CACHE_CELLS = 2_000_000
CHUNK_CELLS = 8 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def read_pieces(vocabulary: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces that can lie in a word of letters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    body = regex.compile(rf"{START}?[\p{{L}}\p{{M}}]+|{START}")
    return sorted({p for p in found if body.fullmatch(p) and p == p.lower()})


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    pieces: tuple[str, ...]
    probabilities: np.ndarray  # pieces and, last, an unknown character, by language
    prior: np.ndarray  # logarithms


def _characters(words: list[str]) -> np.ndarray:
    """One row of code points per word, filled up with zeros."""
    width = max(map(len, words))
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)


class Lattice:
    """Piece probabilities with a look-up by text; scores words by the forward algorithm."""

    def __init__(self, pieces: tuple[str, ...], probabilities: np.ndarray):
        self.number = {piece: k for k, piece in enumerate(pieces)}
        self.longest = max((len(p) for p in pieces), default=1)
        self.unknown = len(pieces)
        self.probabilities = probabilities
        self.beginnings: list[tuple[np.ndarray, np.ndarray]] | None = None

    def _beginnings(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per length: the sorted hashes of what pieces begin with, and the piece of that text or -1."""
        if self.beginnings is None:
            self.beginnings = []
            for n in range(1, self.longest + 1):
                starts = sorted({p[:n] for p in self.number if len(p) >= n})
                codes = _characters(starts).astype(np.uint64)
                hashes = np.zeros(len(starts), np.uint64)
                for column in codes.T:
                    hashes = hashes * _BASE + column
                order = np.argsort(hashes)
                self.beginnings.append((hashes[order], np.array([self.number.get(x, -1) for x in starts])[order]))
        return self.beginnings

    def _all_edges(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[tuple[int, int]]]:
        """Marked lengths of the words; row, start, length and piece of all edges; slices of one end and length.

        Slices come by end, and a word has one edge at most in a slice.
        """
        marked = [START + word for word in words]
        codes = _characters(marked).astype(np.uint64)
        lengths = np.array([len(x) for x in marked])
        row, at = np.nonzero(np.arange(codes.shape[1]) < lengths[:, None])
        hashes = np.zeros(len(row), np.uint64)
        edges = []
        for n, (known, piece) in enumerate(self._beginnings(), 1):
            inside = at + n <= lengths[row]
            row, at, hashes = row[inside], at[inside], hashes[inside]
            if not len(row):
                break
            hashes = hashes * _BASE + codes[row, at + n - 1]
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            found = known[place] == hashes
            here = np.where(found, piece[place], -1)
            if n == 1:
                edges.append((row, at, np.ones(len(row), np.int64), np.where(here < 0, self.unknown, here)))
            else:
                whole_piece = np.flatnonzero(here >= 0)
                edges.append((row[whole_piece], at[whole_piece], np.full(len(whole_piece), n), here[whole_piece]))
            row, at, hashes = row[found], at[found], hashes[found]
        row, at, size, piece = (np.concatenate(c) for c in zip(*edges, strict=True))
        step = (at + size) * (self.longest + 1) + size
        order = np.argsort(step, kind="stable")
        cuts = np.flatnonzero(np.diff(step[order])) + 1
        slices = list(itertools.pairwise([0, *cuts.tolist(), len(step)]))
        return lengths, [x[order] for x in (row, at, size, piece)], slices

    def forward_all(self, words: list[str]) -> np.ndarray:
        """``forward`` of many words of at most ``SHORT_WORD`` letters, one row each."""
        lengths, (row, at, size, piece), slices = self._all_edges(words)
        sums = np.zeros((lengths.max() + 1, len(words), self.probabilities.shape[1]))
        sums[0] = 1
        for a, b in slices:
            start, rows = at[a], row[a:b]
            sums[start + size[a], rows] += sums[start, rows] * self.probabilities[piece[a:b]]
        return np.log(sums[lengths, np.arange(len(words))])

    def expected_all(self, words: list[str], languages: np.ndarray, weights: np.ndarray, into: np.ndarray) -> None:
        """``expected`` of many words of at most ``SHORT_WORD`` letters, each in its language."""
        lengths, (row, at, size, piece), slices = self._all_edges(words)
        p = self.probabilities[piece, languages[row]]
        left, right = (np.zeros((lengths.max() + 1, len(words))) for _ in range(2))
        left[0] = 1
        right[lengths, np.arange(len(words))] = 1
        for a, b in slices:
            left[at[a] + size[a], row[a:b]] += left[at[a], row[a:b]] * p[a:b]
        for a, b in reversed(slices):
            right[at[a], row[a:b]] += right[at[a] + size[a], row[a:b]] * p[a:b]
        uses = left[at, row] * p * right[at + size, row] / right[0, row] * weights[row]
        np.add.at(into, (piece, languages[row]), uses)

    def edges(self, marked: str) -> list[list[tuple[int, int]]]:
        """For each end 1..n the (start, piece number) of the pieces that end there."""
        found: list[list[tuple[int, int]]] = []
        get = self.number.get
        for end in range(1, len(marked) + 1):
            here = [
                (start, k)
                for start in range(max(0, end - self.longest), end)
                if (k := get(marked[start:end])) is not None
            ]
            if not here or here[-1][0] != end - 1:
                here.append((end - 1, self.unknown))
            found.append(here)
        return found

    def forward(self, word: str) -> np.ndarray:
        """Natural logarithm of the word's probability in each language, summed over all its cuts."""
        marked = START + word
        p = self.probabilities
        scale = np.zeros(p.shape[1])
        sums = [np.ones(p.shape[1])]
        for end, here in enumerate(self.edges(marked), 1):
            total = sums[here[0][0]] * p[here[0][1]]
            for start, k in here[1:]:
                total = total + sums[start] * p[k]
            sums.append(total)
            if total.min() < TINY:  # long words: keep the sums that may still be used within range
                first = max(0, end + 1 - self.longest)
                for j in range(first, end + 1):
                    sums[j] = sums[j] / total
                scale += np.log(total)
        return scale + np.log(sums[-1])

    def expected(self, word: str, language: int, weight: float, into: np.ndarray) -> None:
        """Add the expected number of uses of each piece over all cuts of the word in one language."""
        marked = START + word
        p = self.probabilities[:, language]
        edges = self.edges(marked)
        n = len(marked)
        # each sum is kept as a number and the logarithm of its scale, so words of any length work
        left, left_log = [1.0], [0.0]
        for here in edges:
            top = max(left_log[start] for start, _ in here)
            total = sum(left[start] * p[k] * math.exp(left_log[start] - top) for start, k in here)
            left.append(1.0)
            left_log.append(top + math.log(total))
        right_log = [-math.inf] * n + [0.0]
        for end in range(n, 0, -1):
            for start, k in edges[end - 1]:
                value = right_log[end] + math.log(p[k])
                a, b = max(value, right_log[start]), min(value, right_log[start])
                right_log[start] = a + math.log1p(math.exp(b - a))
        for end, here in enumerate(edges, 1):
            for start, k in here:
                share = math.exp(left_log[start] + math.log(p[k]) + right_log[end] - left_log[n])
                into[k, language] += weight * share


def _sample(docs: DataFrame, lang: str, doc_id: str, text: str, languages: list[str], sample_docs: int) -> DataFrame:
    """(language, text) of the first documents of each language by a hash of the id."""
    known = docs.filter(F.col(lang).isin(languages) & F.col(doc_id).isNotNull())
    rows = known.select(F.col(lang).alias("_li_lang"), F.col(doc_id).alias("_li_id"))
    chosen = rows.withColumn("_li_order", F.xxhash64("_li_id", F.lit("language")))
    # a language may hold most rows: the first of each part of it, then the first of these
    for part in ([F.pmod(F.col("_li_order"), F.lit(SAMPLE_PARTS))], []):
        first = Window.partitionBy("_li_lang", *part).orderBy("_li_order", "_li_id")
        chosen = chosen.withColumn("_li_n", F.row_number().over(first)).filter(F.col("_li_n") <= sample_docs)
    chosen = saved(chosen.select("_li_lang", "_li_id").distinct(), "language-sample")
    texts = known.select(F.col(lang).alias("_li_lang"), F.col(doc_id).alias("_li_id"), whole(text).alias("_li_text"))
    # languages x sample_docs ids at most
    return texts.join(F.broadcast(chosen), ["_li_lang", "_li_id"]).select("_li_lang", "_li_text")


def _word_counts(sample: DataFrame, languages: list[str], name: str) -> DataFrame:
    """(language number, word, n) of the sample's texts, written once for all rounds."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(words_of)

    number = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("_li_lang")).cast("int") - 1
    words = sample.select(number.alias("language"), F.explode(split("_li_text")).alias("word"))
    return saved(words.groupBy("language", "word").agg(F.count("*").alias("n")), name)


def _round(counts: DataFrame, pieces: tuple[str, ...], now: np.ndarray, smooth: float) -> np.ndarray:
    """Probabilities re-estimated from the expected counts under ``now``."""

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, now)
        into = np.zeros_like(now)
        for batch in batches:
            language, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            words = batch.column(1).to_pylist()
            short = [k for k, word in enumerate(words) if len(word) <= SHORT_WORD]
            if short:
                lattice.expected_all([words[k] for k in short], language[short], n[short], into)
            for k in set(range(len(words))) - set(short):
                lattice.expected(words[k], language[k], n[k], into)
        piece, language = np.nonzero(into)
        if len(piece):
            columns = [pa.array(language, pa.int32()), pa.array(piece, pa.int32()), pa.array(into[piece, language])]
            yield pa.RecordBatch.from_arrays(columns, names=["language", "piece", "uses"])

    found = counts.select("language", "word", "n").mapInArrow(expect, "language int, piece int, uses double")
    uses = np.zeros_like(now)
    # at most (pieces + 1) x languages rows; rounded, so that the order of the sum leaves no trace
    for row in found.groupBy("language", "piece").agg(F.round(F.sum("uses"), 3).alias("uses")).collect():
        uses[row["piece"], row["language"]] = row["uses"]
    uses += smooth
    return uses / uses.sum(axis=0)


def fit(
    docs: DataFrame,
    lang: str = "lang",
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    sample_docs: int = 1000,
    rounds: int = 2,
    smooth: float = 0.05,
) -> Model:
    """Learn from the rows of ``docs``; leave held-out rows out before calling."""
    shares = docs.filter(F.col(lang).isNotNull()).groupBy(lang).count().limit(MAX_LANGUAGES + 1).collect()
    if len(shares) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    shares = sorted((r[0], r[1]) for r in shares)
    languages = [name for name, _ in shares]
    pieces = tuple(read_pieces(vocabulary))
    if not languages:
        return Model((), pieces, np.zeros((len(pieces) + 1, 0)), np.zeros(0))
    counts = _word_counts(_sample(docs, lang, doc_id, text, languages, sample_docs), languages, "language-words")
    now = np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1))
    for _ in range(rounds):
        now = _round(counts, pieces, now, smooth)
    total = sum(n for _, n in shares)
    return Model(tuple(languages), pieces, now, np.log([n / total for _, n in shares]))


class Scorer:
    """Scores texts in one task; remembers the words it has met, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.lattice = Lattice(model.pieces, model.probabilities)
        self.limit = max(1, CACHE_CELLS // max(1, len(model.languages)))
        self.known: dict[str, int] = {}
        self.values = np.zeros((0, len(model.languages)))

    def _learn(self, words: set[str]) -> None:
        """Hold the probabilities of all ``words``."""
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > self.limit:
            self.known, self.values, fresh = {}, self.values[:0], list(words)
        short = [w for w in fresh if len(w) <= SHORT_WORD]
        long = [w for w in fresh if len(w) > SHORT_WORD]
        parts = [self.values]
        if short:
            parts.append(self.lattice.forward_all(short))
        parts += [self.lattice.forward(w)[None] for w in long]
        self.values = np.concatenate(parts)
        for word in (*short, *long):
            self.known[word] = len(self.known)

    def log_probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logarithm of prior times probability per text and language, and the texts' numbers of words."""
        found = [words_of(text) for text in texts]
        counts = np.array([len(words) for words in found])
        flat = [word for words in found for word in words]
        total = np.tile(self.model.prior, (len(texts), 1))
        if flat:
            self._learn(set(flat))
            values = self.values[np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))]
            some = np.flatnonzero(counts)
            total[some] += np.add.reduceat(values, (np.cumsum(counts) - counts)[some], axis=0)
        return total, counts

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.model.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        logs, counts = self.log_probabilities(texts)
        best = logs.argmax(axis=1)
        share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        names = [self.model.languages[k] if n else UNDETERMINED for k, n in zip(best, counts, strict=True)]
        return names, np.where(counts > 0, share, 0.0)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, the posterior of that language."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        limit = CHUNK_CELLS // max(1, len(model.languages))
        for batch in batches:
            names, scores = [], [np.zeros(0)]
            for a, b in chunks(batch, limit):
                found, score = scorer.predict(batch.slice(a, b - a).to_pylist())
                names += found
                scores.append(score)
            columns = [pa.array(names, pa.string()), pa.array(np.concatenate(scores))]
            yield pa.StructArray.from_arrays(columns, ["lang_pred", "score"])

    own = ("lang_pred", "score")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    found = docs.withColumn("_li_found", predict(whole(text)))
    return found.select(*kept, *[F.col(f"_li_found.{c}").alias(c) for c in own])
