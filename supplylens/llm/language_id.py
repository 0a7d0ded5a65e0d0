"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability in each language. A word's likelihood
is the sum over all ways of cutting it into pieces, computed by the forward algorithm; a
text's is the product over its words. Probabilities are learned by expectation-maximisation: the
backward pass gives every piece its expected count over all segmentations.

Words are runs of letters in lower case behind the vocabulary's word mark. A letter that no piece covers is a
piece of its own with a fixed small probability. The fit reads a bounded sample of labelled rows (``max_docs`` a
language), with all their words; whole texts and whole words are scored. Short words share one lattice, with likelihoods scaled by letter; long ones
are worked out one by one in logarithms, so no length is too much.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplylens.llm.columns import EDGES, PLAIN, distinct_words, text_stretches
from supplylens.llm.common import cut, is_training

WORD = re.compile(r"[^\W\d_]+")
MARK = "▁"
#: Longer words are worked out one by one, in logarithms.
LONG = 64
#: Scales likelihoods by letter, so that products stay within a double's range.
PER_LETTER = 16.0
UNKNOWN = 1e-7
#: Words whose likelihoods a Python worker remembers; beyond that it goes on with those of its last stretch of texts.
KNOWN_WORDS = 400_000
#: Bytes of text that are scored at once.
SCORED_AT_ONCE = 8_000_000
UNDETERMINED = "und"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> list[str]:
    """The vocabulary's pieces of letters (with or without the word mark), lower-cased and distinct, in order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p for p in pieces if p.replace(MARK, "", 1).isalpha() or p == MARK})


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class PieceTable:
    """Pieces by a rolling hash of their characters; what it proposes is compared character by character."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: dict[str, int]):
        self.n = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.length = np.zeros(self.n, dtype=np.int64)
        self.letters = np.zeros((self.n, self.longest), dtype=np.uint32)
        hashes = np.zeros(self.n, dtype=np.uint64)
        for text, i in pieces.items():
            cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            self.length[i], self.letters[i, : len(cp)] = len(cp), cp
            h = 0
            for c in cp.tolist():
                h = (h * int(self.BASE) + c) % (1 << 64)
            hashes[i] = h
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.there = np.zeros(1 << 20, dtype=bool)
        self.there[hashes >> np.uint64(44)] = True

    def find(self, letters: np.ndarray, at: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
        """The piece that is ``letters[at : at + size]``, with hash ``h``, or -1."""
        out = np.full(len(at), -1)
        maybe = np.flatnonzero(self.there[h >> np.uint64(44)])
        k = np.searchsorted(self.hashes, h[maybe])
        # Pieces that share a hash stand side by side; one step more is taken as long as any is left.
        while len(maybe):
            same = (k < self.n) & (self.hashes[np.minimum(k, self.n - 1)] == h[maybe])
            maybe, k = maybe[same], k[same]
            piece = self.order[k]
            equal = (self.length[piece] == size) & (self.letters[piece, :size] == letters[at[maybe][:, None] + np.arange(size)]).all(axis=1)
            out[maybe[equal]] = piece[equal]
            maybe, k = maybe[~equal], k[~equal] + 1
        return out


class Lattice:
    """Segmentation lattices of many words at once, as edges (word, start, end, piece) in the order of their ends."""

    def __init__(self, words: list[str], table: PieceTable):
        marked = [MARK + w for w in words]
        self.n = len(words)
        self.length = np.array([len(t) for t in marked], dtype=np.int64)
        letters = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(self.length) - self.length
        row = np.repeat(np.arange(self.n), self.length)
        at = np.arange(len(letters))
        left = np.repeat(first + self.length, self.length) - at
        h = np.zeros(len(at), dtype=np.uint64)
        edges: list[tuple[np.ndarray, ...]] = []
        for size in range(1, table.longest + 1):
            more = left >= size
            at, h, left = at[more], h[more], left[more]
            if not len(at):
                break
            h = h * table.BASE + letters[at + size - 1]
            piece = table.find(letters, at, h, size)
            if size == 1:
                piece[piece < 0] = table.n  # a letter that no piece covers
            own = piece >= 0
            w = row[at[own]]
            edges.append((w, at[own] - first[w], at[own] - first[w] + size, piece[own]))
        word, start, end, piece = (np.concatenate(v) for v in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 4
        order = np.argsort(end * (self.n + 1) + word, kind="stable")
        self.word, self.start, self.end, self.piece = word[order], start[order], end[order], piece[order]

    def _by(self, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(int(at.max()) + 2 if len(at) else 1))
        for p in range(len(cuts) - 1):
            if cuts[p] < cuts[p + 1]:
                yield p, order[cuts[p] : cuts[p + 1]]

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """alpha[word, position, language]: scaled probability of each prefix; ``prob``: [piece, language]."""
        alpha = np.zeros((self.n, int(self.length.max()) + 1 if self.n else 1, prob.shape[1]))
        alpha[:, 0] = 1
        scaled = prob[self.piece] * (PER_LETTER ** (self.end - self.start))[:, None]
        for p, e in self._by(self.end):
            w = self.word[e]
            part = alpha[w, self.start[e]] * scaled[e]
            cuts = np.flatnonzero(np.diff(w, prepend=-1))
            alpha[w[cuts], p] = np.add.reduceat(part, cuts, axis=0)
        return alpha

    def backward(self, prob: np.ndarray) -> np.ndarray:
        """beta[word, position, language]: scaled probability of each suffix."""
        beta = np.zeros((self.n, int(self.length.max()) + 1 if self.n else 1, prob.shape[1]))
        beta[np.arange(self.n), self.length] = 1
        scaled = prob[self.piece] * (PER_LETTER ** (self.end - self.start))[:, None]
        groups = list(self._by(self.start))
        for p, e in reversed(groups):
            e = e[np.argsort(self.word[e], kind="stable")]
            w = self.word[e]
            part = beta[w, self.end[e]] * scaled[e]
            cuts = np.flatnonzero(np.diff(w, prepend=-1))
            beta[w[cuts], p] = np.add.reduceat(part, cuts, axis=0)
        return beta

    def log_likelihood(self, prob: np.ndarray) -> np.ndarray:
        total = self.forward(prob)[np.arange(self.n), self.length]
        return np.log(np.maximum(total, 1e-300)) - (self.length * math.log(PER_LETTER))[:, None]

    def expected(self, prob: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of all words, for one language."""
        alpha, beta = self.forward(prob), self.backward(prob)
        total = np.maximum(alpha[np.arange(self.n), self.length, 0], 1e-300)
        scaled = prob[self.piece, 0] * PER_LETTER ** (self.end - self.start)
        use = alpha[self.word, self.start, 0] * scaled * beta[self.word, self.end, 0] * (count / total)[self.word]
        return np.bincount(self.piece, weights=use, minlength=len(prob))


class LongWord(Lattice):
    """The lattice of one word of any length, in logarithms."""

    def __init__(self, word: str, table: PieceTable):
        super().__init__([word], table)

    def _sums(self, log_prob: np.ndarray, at: np.ndarray, other: np.ndarray, positions: range) -> np.ndarray:
        out = np.full((int(self.length[0]) + 1, log_prob.shape[1]), -np.inf)
        out[positions.start - positions.step] = 0
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(len(out) + 1))
        for p in positions:
            e = order[cuts[p] : cuts[p + 1]]
            out[p] = np.logaddexp.reduce(out[other[e]] + log_prob[self.piece[e]], axis=0)
        return out

    def log_likelihood(self, prob: np.ndarray) -> np.ndarray:
        n = int(self.length[0])
        return self._sums(np.log(prob), self.end, self.start, range(1, n + 1))[n:]

    def expected(self, prob: np.ndarray, count: np.ndarray) -> np.ndarray:
        n, log_prob = int(self.length[0]), np.log(prob)
        alpha, beta = self._sums(log_prob, self.end, self.start, range(1, n + 1)), self._sums(log_prob, self.start, self.end, range(n - 1, -1, -1))
        use = np.exp(alpha[self.start, 0] + log_prob[self.piece, 0] + beta[self.end, 0] - alpha[n, 0]) * count[0]
        return np.bincount(self.piece, weights=use, minlength=len(prob))


def lattices(words: list[str], table: PieceTable, chunk: int) -> Iterator[tuple[Lattice, list[str]]]:
    """Lattices of all words: short ones many at a time, by length, long ones each on its own."""
    short = sorted((w for w in words if len(w) <= LONG), key=lambda w: (len(w), w))
    for i in range(0, len(short), chunk):
        yield Lattice(short[i : i + chunk], table), short[i : i + chunk]
    for w in words:
        if len(w) > LONG:
            yield LongWord(w, table), [w]


def fit_pieces(words: dict[str, float], pieces: dict[str, int], rounds: int, chunk: int = 4000) -> np.ndarray:
    """Piece probabilities of one language by EM, from its words and their counts; the last entry is an unknown letter's."""
    made = [(lattice, np.array([float(words[w]) for w in some])) for lattice, some in lattices(sorted(words), PieceTable(pieces), chunk)]
    prob = np.full((len(pieces) + 1, 1), 1 / (len(pieces) + 1))
    prob[-1] = UNKNOWN
    for _ in range(rounds):
        use = np.full(len(pieces) + 1, 0.01)
        for lattice, count in made:
            use += lattice.expected(prob, count)
        use[-1] = 0
        prob = (use / max(use.sum(), 1e-9))[:, None]
        prob[-1] = UNKNOWN
    return prob[:, 0]


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: dict[str, int]
    prob: np.ndarray  # [piece, language]
    prior: np.ndarray

    def __post_init__(self):
        self.table = PieceTable(self.pieces)
        # Words seen before and their log-likelihoods, one worked out for each.
        self.known, self.rows = pa.array([], pa.string()), np.zeros((0, len(self.languages)))

    def __getstate__(self):
        return {**self.__dict__, "known": self.known.slice(0, 0), "rows": self.rows[:0]}

    def _likelihoods(self, words: pa.Array) -> np.ndarray:
        """Log-likelihoods of different words, [word, language]."""
        at = pc.index_in(words, value_set=self.known)
        if at.null_count:
            new = words.filter(pc.is_null(at))
            order, found = [], []
            for lattice, some in lattices(new.to_pylist(), self.table, 2000):
                order += some
                found.append(lattice.log_likelihood(self.prob))
            if len(self.known) + len(new) > KNOWN_WORDS:
                kept = at.drop_null()
                self.known, self.rows = self.known.take(kept), self.rows[kept.to_numpy()]
            self.known, self.rows = pa.concat_arrays([self.known, pa.array(order, pa.string())]), np.concatenate([self.rows, *found])
            at = pc.index_in(words, value_set=self.known)
        return self.rows[at.to_numpy()]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods [word, language] of different words between white space, and whether each has a letter."""
        core = pc.ascii_trim(words, characters=EDGES)
        plain = pc.match_substring_regex(core, f"^[A-Z{PLAIN}]+$")
        at = np.flatnonzero(np.asarray(plain))
        # Words with anything else in them are looked at one by one.
        other = [(i, r) for i, w in zip(np.flatnonzero(~np.asarray(plain)).tolist(), words.filter(pc.invert(plain)).to_pylist()) for r in words_of(w) if any(map(str.isalpha, r))]
        runs = pa.concat_arrays([pc.utf8_lower(core.filter(plain)), pa.array([r for _, r in other], pa.string())]).dictionary_encode()
        place = np.concatenate([at, np.array([i for i, _ in other], dtype=np.int64)])
        rows = self._likelihoods(runs.dictionary)[np.asarray(runs.indices)] if len(runs) else np.zeros((0, len(self.languages)))
        total = np.stack([np.bincount(place, weights=rows[:, k], minlength=len(words)) for k in range(len(self.languages))], axis=1)
        return total, np.bincount(place, minlength=len(words)) > 0

    def predict(self, texts: pa.Array) -> Iterator[tuple[str, float]]:
        """Language and its posterior probability of each text; ``und`` and 0 without letters or without any language learned."""
        for lo, hi, part in text_stretches(texts, SCORED_AT_ONCE):
            if not self.languages:
                yield from [(UNDETERMINED, 0.0)] * (hi - lo)
                continue
            first, at, words = distinct_words(part)
            rows, letters = self._words(words)
            text = np.repeat(np.arange(hi - lo), np.diff(first))
            log_prob = np.stack([np.bincount(text, weights=rows[at, k], minlength=hi - lo) for k in range(len(self.languages))], axis=1) + self.prior
            some = np.bincount(text, weights=letters[at], minlength=hi - lo) > 0
            best = log_prob.argmax(axis=1)
            score = 1 / np.exp(np.minimum(log_prob - log_prob.max(axis=1, keepdims=True), 0)).sum(axis=1)
            yield from ((self.languages[b], float(x)) if s else (UNDETERMINED, 0.0) for b, x, s in zip(best.tolist(), score.tolist(), some.tolist()))


def fit(docs: DataFrame, vocabulary: str | None = None, max_docs: int = 400, rounds: int = 4, seed: int = 5) -> LanguageModel:
    """Fit on documents that :func:`is_training` admits and whose ``lang`` and ``text`` are not null.

    ``max_docs`` bounds the sample of each language (the first by a seeded hash of the id). A language is known once a document bears it; there is a
    row on the driver, and a column in the model, for each. Without any labelled row the model answers ``und``.
    """
    spark = docs.sparkSession
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & is_training())
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    pieces = {p: i for i, p in enumerate(load_pieces(vocabulary or default_vocabulary()))}
    if not counts:
        return LanguageModel([], pieces, np.zeros((len(pieces) + 1, 1)), np.zeros(1))
    # The share of hash values that gives each language about max_docs documents; more rows never enlarge the sample.
    slots = 1 << 40
    rates = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(slots, slots * max_docs // n))])
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(slots)) < rates[F.col("lang")]).select("lang", "text")

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                total.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, c in total.items() for w, n in c.items()]
        yield pd.DataFrame(rows, columns=["lang", "word", "n"])

    words = cut(sample.mapInPandas(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        prob = fit_pieces(dict(zip(pdf["word"], pdf["n"])), pieces, rounds)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "prob": [prob]})

    # One group a language, of at most max_docs documents' words.
    fitted = {r["lang"]: r["prob"] for r in words.groupBy("lang").applyInPandas(train, "lang string, prob array<double>").collect()}
    languages = sorted(counts)
    missing = np.full(len(pieces) + 1, UNKNOWN)  # a language whose sample has no words
    prob = np.stack([np.array(fitted[x]) if x in fitted else missing for x in languages], axis=1)
    total = sum(counts.values())
    return LanguageModel(languages, pieces, prob, np.log([counts[x] / total for x in languages]))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score.

    Null texts and texts without a letter give ``und`` with score 0; texts of any length are scored whole. Ties go to the language first by code
    point; repeated rows get equal answers. Only ``doc_id`` and ``text`` are read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value  # kept by the worker, with the words it has seen
        for batch in batches:
            lang, score = zip(*m.predict(batch["text"])) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double")
