"""Toxicity from the nearest labelled examples.

Texts are TF-IDF vectors over the words of the examples and their first letters. Every term of an example counts; how much a term says about the
label, a chi-square test on the examples, scales its weight but leaves none out. Examples stand in an inverted index whose
postings are cut into blocks of examples; each term keeps its largest weight in every block. The sum of these
maxima bounds what any example of a block can score. The blocks with the best bounds are scored first; all others whose bound
reaches the k-th best cosine follow, so the neighbours are exact. Their votes, weighted by distance, are
mapped to a probability by a curve fitted on the examples, each left out of its own vote.

Only the fit looks at a bounded sample (``max_examples`` labelled rows, the first by a seeded hash of
the id). Document frequencies are counted over all documents, and every text is scored whole.
"""

from __future__ import annotations

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

from supplylens.llm.columns import EDGES, PLAIN, distinct_words, ranges, release_memory, text_stretches
from supplylens.llm.common import cut, is_training, shared_table

TERM = re.compile(r"[^\W\d_]+")
#: Letters of the beginnings that stand beside the words: they tie together forms that are too rare one by one.
STEM = 4


def terms_of(text: str) -> list[str]:
    """Terms in lower case: words of letters, and ``^`` with the first letters of longer ones."""
    words = TERM.findall(text.lower())
    return words + ["^" + w[:STEM] for w in words if len(w) > STEM]


class Vocabulary:
    """Numbers of terms: words first, then beginnings, each in order."""

    def __init__(self, terms: pa.Array):
        """``terms`` are different from each other."""
        begun = pc.starts_with(terms, "^")
        words, stems = terms.filter(pc.invert(begun)), pc.utf8_slice_codeunits(terms.filter(begun), 1)
        self.words, self.stems = (v.take(pc.array_sort_indices(v)) for v in (words, stems))

    def __len__(self) -> int:
        return len(self.words) + len(self.stems)

    def numbers(self, words: pa.Array, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word and of each beginning, -1 for unknown ones."""
        w, s = (pc.fill_null(pc.index_in(v, value_set=of), -1).to_numpy() for v, of in ((words, self.words), (stems, self.stems)))
        return w.astype(np.int64), np.where(s < 0, -1, s.astype(np.int64) + len(self.words))

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The known terms of each of ``words``, which have no white space, one after another, and how many each has."""
        core = pc.ascii_trim(words, characters=EDGES)
        plain = np.asarray(pc.match_substring_regex(core, f"^[A-Z{PLAIN}]+$"))
        at = np.flatnonzero(plain)
        low = pc.utf8_lower(core.filter(pa.array(plain)))
        w, s = self.numbers(low, pc.utf8_slice_codeunits(low, 0, STEM))
        s[np.asarray(pc.utf8_length(low)) <= STEM] = -1
        # Words with anything else in them are looked at one by one.
        other = [(i, t) for i, word in zip(np.flatnonzero(~plain).tolist(), words.filter(pa.array(~plain)).to_pylist()) for t in terms_of(word)]
        texts = pa.array([t.removeprefix("^") for _, t in other], pa.string())
        begun = np.array([t[0] == "^" for _, t in other], dtype=bool)
        own = np.where(begun, *self.numbers(texts, texts)[::-1])
        place = np.concatenate([at, at, np.array([i for i, _ in other], dtype=np.int64)])
        term = np.concatenate([w, s, own])
        place, term = place[term >= 0], term[term >= 0]
        order = np.argsort(place, kind="stable")
        return term[order], np.bincount(place, minlength=len(words))


def known_counts(texts: pa.Array, known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, known terms in them and their counts, by row, then term. White space never lies inside a term, so each different word is looked at once."""
    first, at, words = distinct_words(texts)
    terms, each = known.of_words(words)
    n = each[at]
    row = np.repeat(np.repeat(np.arange(len(texts)), np.diff(first)), n)
    width = max(1, len(known))
    pair, count = np.unique(row * width + terms[ranges((np.cumsum(each) - each)[at], n)], return_counts=True)
    return pair // width, pair % width, count


class BlockMaxIndex:
    """Exact top-k cosine search over sparse unit vectors, given as their entries (example, term, weight).

    Postings of terms in more than one example of ``COMMON`` are kept as full rows, and what they add to all examples is worked out for many
    texts at once. The postings of other terms are cut into blocks, whose maxima, on top of that, bound what a block can reach.
    """

    COMMON = 16
    #: Blocks scored before the others are held against the k-th best.
    FIRST = 4

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int, block: int = 64):
        self.n, self.block, self.n_blocks = n, block, max(1, -(-n // block))
        often = np.flatnonzero(np.bincount(term, minlength=n_terms) * self.COMMON > n)
        self.row = np.full(n_terms, -1)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), n))
        full = self.row[term] >= 0
        self.rows[self.row[term[full]], example[full]] = weight[full]
        example, term, weight = example[~full], term[~full], weight[~full]
        order = np.lexsort((example, term))
        self.example, self.weight = example[order].astype(np.int32), weight[order].astype(np.float64)
        # A cell is what one term has in one block.
        cell = term[order].astype(np.int64) * self.n_blocks + self.example // block
        new = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cell_start = np.append(new, len(cell))
        self.cell_block = (cell[new] % self.n_blocks).astype(np.int32)
        self.cell_max = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        self.term_start = np.searchsorted(cell[new] // self.n_blocks, np.arange(n_terms + 1))

    def search_all(self, cuts: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, skip: np.ndarray | None = None, at_once: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Examples and cosines of the ``k`` nearest of each text, best first, ties by example; examples of cosine 0 are no neighbours.

        Text i has the entries from ``cuts[i]`` to ``cuts[i + 1]``; ``skip[i]`` is no neighbour of it.
        """
        for lo in range(0, len(cuts) - 1, at_once):
            own = cuts[lo : lo + at_once + 1]
            row = self.row[terms[own[0] : own[-1]]]
            dense = np.zeros((len(own) - 1, len(self.rows)))
            full = row >= 0
            dense[np.repeat(np.arange(len(own) - 1), np.diff(own))[full], row[full]] = weights[own[0] : own[-1]][full]
            score = dense @ self.rows
            for i, (a, b) in enumerate(zip(own, own[1:])):
                rare = self.row[terms[a:b]] < 0
                yield self._search(score[i], terms[a:b][rare], weights[a:b][rare], k, -1 if skip is None else int(skip[lo + i]))

    def _search(self, score: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """``score`` holds what the common terms add; the others' cells are added where they can matter."""
        start, n = self.term_start[terms], self.term_start[terms + 1] - self.term_start[terms]
        cells, w = ranges(start, n), np.repeat(weights, n)
        blocks = self.cell_block[cells]
        bound = np.maximum.reduceat(score, np.arange(0, self.n, self.block)) + np.bincount(blocks, w * self.cell_max[cells], minlength=self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        final, worst = np.zeros(self.n), 0.0
        for part in (order[: self.FIRST], order[self.FIRST :]):
            part = part[(bound[part] > 0) & (bound[part] >= worst - 1e-9)]
            if not len(part):
                break
            wanted = np.zeros(self.n_blocks, dtype=bool)
            wanted[part] = True
            own = wanted[blocks]
            c = cells[own]
            size = self.cell_start[c + 1] - self.cell_start[c]
            at = ranges(self.cell_start[c], size)
            final += np.where(np.repeat(wanted, self.block)[: self.n], score, 0)
            final += np.bincount(self.example[at], self.weight[at] * np.repeat(w[own], size), minlength=self.n)
            if skip >= 0:
                final[skip] = 0
            if np.count_nonzero(final > 0) >= k:
                worst = np.partition(final, self.n - k)[self.n - k]
        found = np.flatnonzero((final > 0) & (final >= worst - 1e-9))
        found = found[np.lexsort((found, -np.round(final[found], 12)))][:k]
        return found, final[found]


def isotonic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing probabilities of ``y`` over distinct values of ``x`` by pooling neighbours that are out of order.

    Each pool counts two extra observations at the prior, so that no estimate is 0 or 1.
    """
    value, where = np.unique(np.round(x, 6), return_inverse=True)
    n, s = np.bincount(where).astype(float), np.bincount(where, weights=y)
    pools: list[list[float]] = []
    for v, c, t in zip(value, n, s):
        pools.append([v, c, t])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            v2, c2, t2 = pools.pop()
            pools[-1][1] += c2
            pools[-1][2] += t2
    p = np.array([(t + 2 * prior) / (c + 2) for _, c, t in pools])
    return np.array([v for v, _, _ in pools]), np.maximum.accumulate(p)


@dataclass
class ToxicityModel:
    terms: Vocabulary
    #: Inverse document frequency times the share of chi-square, by term.
    scale: np.ndarray
    index: BlockMaxIndex
    ids: np.ndarray
    labels: np.ndarray
    k: int
    prior: float
    curve: tuple[np.ndarray, np.ndarray] | None = None

    def units(self, cuts: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights of the texts' terms, of length 1 for each text."""
        w = (1 + np.log(counts)) * self.scale[terms]
        text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        norm = np.sqrt(np.bincount(text, w * w, minlength=len(cuts) - 1))
        return w / np.where(norm > 0, norm, 1.0)[text]

    def votes(self, cuts: np.ndarray, terms: np.ndarray, counts: np.ndarray, skip: np.ndarray | None = None) -> Iterator[tuple[float, list[tuple[int, float]]]]:
        """Share of positive votes, and the neighbours (example id, cosine), of each text; the prior has the weight of one neighbour at cosine 0.5."""
        base = 1 / 1.1
        for ids, cosine in self.index.search_all(cuts, terms, self.units(cuts, terms, counts), self.k, skip):
            # The vote falls with the distance between unit vectors.
            w = 1 / (0.1 + np.sqrt(np.maximum(0, 2 - 2 * cosine)))
            share = (float((w * self.labels[ids]).sum()) + base * self.prior) / (float(w.sum()) + base)
            yield share, list(zip(self.ids[ids].tolist(), cosine.tolist()))

    def score(self, share: float) -> float:
        if self.curve is None or not len(self.curve[0]):
            return min(1.0, max(0.0, share))
        at, p = self.curve
        return float(p[max(0, np.searchsorted(at, round(share, 6), side="right") - 1)])

    def answers(self, texts: pa.Array) -> Iterator[tuple[float, list[tuple[int, float]]]]:
        """Score and neighbours (example id, cosine) of each text of a column."""
        for lo, hi, part in text_stretches(texts):
            row, term, count = known_counts(part, self.terms)
            for share, near in self.votes(np.searchsorted(row, np.arange(hi - lo + 1)), term, count):
                yield self.score(share), near


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 2000, half_chi2: float = 25.0, k: int = 25, seed: int = 11) -> ToxicityModel:
    """Fit on labelled rows that :func:`is_training` admits.

    ``labels`` (doc_id, toxic); rows with a null in either are left out and a document labelled twice counts
    as toxic if one label says so. Equal texts among the examples count once, under their smallest id; an id that repeats with
    other texts gives an example for each, still ``max_examples`` at most. Null and empty texts are examples without terms. Without
    examples, or with one class only, the model gives every text the prior. A term's weight is multiplied by
    c / (c + ``half_chi2``), c being its chi-square against the label.
    """
    sample = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & is_training())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        .limit(max_examples)
    )
    # At most max_examples rows of two numbers.
    texts = docs.select("doc_id", "text").join(F.broadcast(cut(sample)), "doc_id")

    def count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [Counter(terms_of(t or "")) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"] > 0, "terms": [list(c) for c in found], "counts": [list(c.values()) for c in found]})

    same = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = texts.groupBy(same.alias("same"), F.coalesce("text", F.lit("")).alias("text")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    texts = texts.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "same").limit(max_examples)
    examples = texts.mapInPandas(count_terms, "doc_id long, toxic boolean, terms array<string>, counts array<int>").toArrow().combine_chunks()
    ids, y = examples["doc_id"].to_numpy(), examples["toxic"].to_numpy().astype(float)
    n, n1 = len(y), float(y.sum())
    prior = (n1 + 1) / (n + 2) if n else 0.0
    none = np.zeros(0, np.int64)
    empty = ToxicityModel(Vocabulary(pa.array([], pa.string())), np.zeros(0), BlockMaxIndex(none, none, np.zeros(0), 0, 0), none, np.zeros(0), k, prior)
    if not n or n1 in (0.0, float(n)):
        return empty
    lists = examples["terms"].combine_chunks()
    flat = lists.flatten().dictionary_encode()
    terms = Vocabulary(flat.dictionary)
    plain = pc.if_else(pc.starts_with(flat.dictionary, "^"), pc.utf8_slice_codeunits(flat.dictionary, 1), flat.dictionary)
    number = np.where(np.asarray(pc.starts_with(flat.dictionary, "^")), *terms.numbers(plain, plain)[::-1])
    term = number[np.asarray(flat.indices)] if len(flat) else none
    count = np.asarray(examples["counts"].combine_chunks().flatten())
    cuts = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
    row = np.repeat(np.arange(n), np.diff(cuts))
    # Chi-square of term against label from the 2 x 2 table of examples.
    a = np.bincount(term, minlength=len(terms)).astype(float)
    b = np.bincount(term, y[row], minlength=len(terms))
    chi2 = np.where(a < n, n * (b * (n - n1) - (a - b) * n1) ** 2 / np.maximum(a * (n - a) * n1 * (n - n1), 1e-9), 0.0)
    model = ToxicityModel(terms, document_frequencies(docs, terms) * chi2 / (chi2 + half_chi2), empty.index, ids, y, k, prior)
    weight = model.units(cuts, term, count)
    # Similar examples side by side make block maxima tight: order by label and strongest term.
    strongest = [int(term[s + weight[s:e].argmax()]) if e > s else -1 for s, e in zip(cuts, cuts[1:])]
    order = np.lexsort((ids, strongest, y))
    place = np.argsort(order)
    model.ids, model.labels = ids[order], y[order]
    model.index = BlockMaxIndex(place[row], term, weight, n, len(terms))
    shares = np.array([share for share, _ in model.votes(cuts, term, count, skip=place)])
    model.curve = isotonic(shares, y, prior)
    del examples, lists, flat
    release_memory()
    return model


def document_frequencies(docs: DataFrame, terms: Vocabulary) -> np.ndarray:
    """Inverse document frequency of each term over all of ``docs``; map-side sums, so at most one row a term and task is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value) + 1, dtype=np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for _, _, part in text_stretches(batch["text"]):
                total[:-1] += np.bincount(known_counts(part, shared.value)[1], minlength=len(shared.value))
        there = np.flatnonzero(total)
        release_memory()
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["term", "n"])

    sums = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # one row a term
    shared.destroy()
    df = np.zeros(len(terms) + 1)
    df[sums["term"].to_numpy()] = sums["n"].to_numpy()
    return np.log((1 + df[-1]) / (1 + df[:-1])) + 1e-9


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, evidence: int = 3) -> DataFrame:
    """One row per input row: doc_id, score, predicted, evidence (nearest examples as id and cosine).

    * a null or empty text, and one without any known term, has no neighbours and gets the rate that
      such examples have; its evidence is empty;
    * texts of any length are scored whole; equal cosines rank by the index's order of examples;
    * rows are scored each on its own, so repeated rows agree; an empty table gives no rows; only ``doc_id`` and ``text`` are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    near = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, found = zip(*shared.value.answers(batch["text"])) if batch.num_rows else ((), ())
            shown = pa.array([[{"doc_id": i, "cosine": c} for i, c in f[:evidence]] for f in found], near)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), shown], names=["doc_id", "score", "predicted", "evidence"])
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, "doc_id long, score double, predicted int, evidence array<struct<doc_id: long, cosine: double>>")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns, in one pass over the texts.

    The rows are written to the shared folder, so that driver and executors can let the model go. Null and empty texts are scored like any other,
    as :func:`score` says; rows with equal texts stay or go together; names of other columns never matter; an empty table stays empty.
    """
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def keep(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([s < threshold for s, _ in shared.value.answers(texts)], pa.bool_())
        release_memory()

    kept = shared_table(docs.filter(keep(F.col("text"))).select(*[F.col(f"`{c}`") for c in names]), "not-toxic")
    shared.destroy()
    release_memory()
    return kept
