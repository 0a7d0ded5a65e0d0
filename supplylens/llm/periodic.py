"""Periodic runs of words: stretches that repeat with a smallest period q, at least three times and over at least 24 words.

``find_runs`` works on the words of many texts at once, as numbers in one array with a number of its own between two texts, which no run crosses.

* Periods up to ``SHORT`` are scanned directly: all words q apart are compared.
* Longer ones are found scale by scale, for q in (Q, 1.5 Q]. Grams of k <= Q / 4 words get exact numbers by doubling (a gram of 2 k words is a pair
  of grams of k). A gram that begins at most k / 2 after an equal one lies in a run of a shorter period and is passed over; equal
  grams that are left are more than k / 2 apart. Of these the minima (by a mixed order of their numbers) of all windows of 1.5 Q
  grams are kept, all of them where they tie. Inside a run of period q two windows q apart hold the same grams, so their
  minima are equal and q apart: each pair of equal minima at a distance of this scale is a seed.
  A window of q grams in such a run never consists of grams that are passed over, as the run would then have a shorter period; and three periods
  have room for two such windows and what must be known to their left. So no run is missed.
* Seeds of one run form a chain, whose first and last are extended by binary search over the numbers of the grams. What is long enough is a run;
  where it was found with a multiple of its period too, it has the same ends, and the smallest stays.

Texts in which no gram of k words comes twice have no runs at this scale or a larger one and leave the search, so that ordinary prose costs little.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplylens.llm.columns import release_memory, text_stretches

#: Longest period that is scanned directly; the first scale begins behind it.
SHORT = 8
#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 24, 3


class _Texts:
    """Numbers of words, with the numbers of longer grams by the power of two of their length."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes
        self.doc = np.repeat(np.arange(len(sizes)), sizes + 1)
        at = np.arange(len(self.doc))
        ends = np.cumsum(sizes + 1) - 1
        inner = np.ones(len(at), dtype=bool)
        inner[ends] = False
        first = np.empty(len(at), dtype=np.int64)
        first[inner] = words
        top = int(words.max(initial=0)) + 1
        first[ends] = top + np.arange(len(ends))
        #: Where each position was before texts left.
        self.origin = at
        self.grams = [first]
        self.order: np.ndarray | None = None

    def double(self) -> None:
        """Number the grams of twice the length."""
        last = self.grams[-1]
        k = 1 << (len(self.grams) - 1)
        n = len(last)
        top = int(last.max(initial=0)) + 1
        key = last * (top + n)
        key[: max(0, n - k)] += last[k:]
        key[max(0, n - k) :] += top + np.arange(min(k, n))
        self.order = np.argsort(key, kind="stable")
        sorted_key = key[self.order]
        new = np.empty(n, dtype=np.int64)
        new[self.order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])[:n]
        self.grams.append(new)

    def keep(self, docs: np.ndarray) -> None:
        """Let the texts that ``docs`` doesn't mark leave."""
        stay = docs[self.doc]
        if stay.all():
            return
        if self.order is not None:
            place = np.cumsum(stay) - 1
            self.order = place[self.order[stay[self.order]]]
        self.doc, self.origin = self.doc[stay], self.origin[stay]
        self.grams = [g[stay] for g in self.grams]

    def equal(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the grams of 2**level words at ``a`` and ``b`` are there and equal."""
        g = self.grams[level]
        ok = (a >= 0) & (b >= 0) & (a < len(g)) & (b < len(g))
        ok[ok] = g[a[ok]] == g[b[ok]]
        return ok

    def common(self, a: np.ndarray, b: np.ndarray, before: bool) -> np.ndarray:
        """How many words are equal before ``a`` and ``b``, or from them on."""
        top = len(self.grams) - 1
        length = np.zeros(len(a), dtype=np.int64)
        for level in range(top, -1, -1):
            step = 1 << level
            more = np.arange(len(a))
            while len(more):
                by = -length[more] - step if before else length[more]
                more = more[self.equal(level, a[more] + by, b[more] + by)]
                length[more] += step
                # Only the longest step is taken more than once.
                more = more if level == top else more[:0]
        return length


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """Least (or whatever ``least`` picks) of each window of so many values."""
    out, have = values, 1
    while have * 2 <= width:
        out, have = least(out[:-have], out[have:]), have * 2
    rest = width - have
    return least(out[: len(out) - rest], out[rest:]) if rest else out


def _minima(texts: _Texts, k: int, width: int) -> np.ndarray:
    """Positions whose gram is the least of some window, in the order of (gram, position)."""
    gram, order = texts.grams[-1], texts.order
    same = gram[order[1:]] == gram[order[:-1]]
    near = same & (order[1:] - order[:-1] <= k // 2)
    value = gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    value[order[1:][near]] = np.uint64(2**64 - 1)
    least = _sliding(value, width, np.minimum)
    # Windows that reach over the ends of the array don't exist: they must never select.
    none = np.zeros(width - 1, dtype=np.uint64)
    best = _sliding(np.concatenate([none, least, none]), width, np.maximum)
    chosen = best == value
    chosen[order[1:][near]] = False
    return order[chosen[order]]


def _seeds(texts: _Texts, at: np.ndarray, scale: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of equal minima that lie more than ``scale`` and at most ``width`` apart, by distance and position."""
    gram = texts.grams[-1]
    first, period = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for lag in range(1, len(at)):
        a, b = at[:-lag], at[lag:]
        pairs = (gram[a] == gram[b]) & (b - a <= width)
        if not pairs.any():
            break
        pairs &= b - a > scale
        first.append(a[pairs])
        period.append((b - a)[pairs])
    a, q = np.concatenate(first), np.concatenate(period)
    by = np.lexsort((a, q))
    return a[by], q[by]


def _extend(texts: _Texts, a: np.ndarray, q: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches with period ``q`` around the seeds that are at least three periods long: start, end and period.

    A run has a seed for every period, so neighbouring seeds with only equal words between them are joined, and only the first and the last of such
    a chain are extended. What lies before and behind them is a few windows long.
    """
    if not len(a):
        return a, a, q
    gap = np.diff(a)
    joined = (np.diff(q) == 0) & (gap <= width + k)
    top = len(texts.grams) - 1
    for step in range(k, width + k, k):
        check = np.flatnonzero(joined & (step < gap))
        if not len(check):
            break
        joined[check] = texts.equal(top, a[check] + step, a[check] + q[check] + step)
    head = np.flatnonzero(np.concatenate([[True], ~joined]))
    tail = np.concatenate([head[1:], [len(a)]]) - 1
    q = q[head]
    start = a[head] - texts.common(a[head], a[head] + q, before=True)
    end = a[tail] + q + texts.common(a[tail], a[tail] + q, before=False)
    whole = end - start >= TIMES * q
    return start[whole], end[whole], q[whole]


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of many texts: number of the text, first word within it, length and smallest period, by text, start and period.

    ``words`` are the numbers of all texts' words one after another, of which each text has ``sizes``.
    """
    texts = _Texts(words.astype(np.int64), sizes)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    found = [np.empty((0, 3), dtype=np.int64)]

    def note(start, end, period) -> None:
        ok = end - start >= np.maximum(LEAST, TIMES * period)
        found.append(np.stack([start[ok], end[ok], np.broadcast_to(period, start.shape)[ok]], axis=1))

    texts.keep(sizes >= LEAST)
    flat = texts.grams[0]
    for q in range(1, min(SHORT, len(flat) - 1) + 1):
        equal = np.concatenate([[False], flat[q:] == flat[:-q], [False]])
        edge = np.flatnonzero(equal[1:] != equal[:-1])
        start, end = edge[::2], edge[1::2] + q
        long = end - start >= max(LEAST, TIMES * q)
        if long.any():
            start, end = start[long], end[long]
            note(texts.origin[start], texts.origin[end - 1] + 1, np.full(len(start), q))

    scale, longest = SHORT, int(sizes.max(initial=0))
    while TIMES * (scale + 1) <= longest and len(texts.doc):
        width = scale * 3 // 2
        while len(texts.grams) < (scale // 4).bit_length():
            texts.double()
            gram, order = texts.grams[-1], texts.order
            twice = (gram[order[1:]] == gram[order[:-1]]) & (texts.doc[order[1:]] == texts.doc[order[:-1]])
            alive = np.zeros(len(sizes), dtype=bool)
            alive[texts.doc[order[1:][twice]]] = True
            texts.keep(alive)
        texts.keep(sizes >= TIMES * (scale + 1))
        if len(texts.doc) >= width:
            k = 1 << (len(texts.grams) - 1)
            start, end, period = _extend(texts, *_seeds(texts, _minima(texts, k, width), scale, width), k, width)
            note(texts.origin[start], texts.origin[end - 1] + 1, period)
        scale = width
    rows = np.concatenate(found)
    # Of equal ends the smallest period is the run's own.
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    doc = np.searchsorted(begins, rows[:, 0], side="right") - 1
    start, length, period = rows[:, 0] - begins[doc], rows[:, 1] - rows[:, 0], rows[:, 2]
    by = np.lexsort((period, start, doc))
    return doc[by], start[by], length[by], period[by]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """First word and period of the repetition that the tests' contract plants in a text of ``n`` words, if it does."""
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _best(runs: list[tuple[int, int, int]]) -> tuple[int | None, ...]:
    """start, length, period and thousandths of the exponent of the run with the greatest one."""
    if not runs:
        return (None,) * 4
    s, n, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return s, n, q, 1000 * n // q


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64())]
    + [("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())]
)
COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): its runs, the strongest of them, and the text with each run cut to its first period (words joined by one space).

    A null text has no words, like an empty one: no runs, and an empty ``collapsed``. Texts of any length are taken whole; texts are
    handled in stretches of a few megabytes, a longer one alone. Of runs with equal exponent the first is ``start``, then the one with the
    smaller period. Repeated rows each get their row, null ids stay null, other columns are not looked at, an empty table gives
    no rows. ``plant`` first repeats a part of every tenth text, as :func:`planted` says (never where the id is null).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_stretches(batch["text"]):
                yield _rows(batch["doc_id"].slice(lo, hi - lo), texts, plant)
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, COLUMNS)


def _rows(ids: pa.Array, texts: pa.Array, plant: bool) -> pa.RecordBatch:
    split = pc.ascii_split_whitespace(texts)
    ends = np.asarray(split.offsets).astype(np.int64)
    ends -= ends[0]
    flat = split.flatten().dictionary_encode()
    words, at = flat.dictionary, np.asarray(flat.indices).astype(np.int64)
    # White space at the ends of a text makes empty words.
    there = (np.asarray(pc.binary_length(words)) > 0)[at]
    cuts = np.concatenate([[0], np.cumsum(there)])[ends]
    at, sizes, begins = at[there], np.diff(cuts), cuts[:-1]
    if plant:
        source = np.arange(len(at))
        for d, (doc_id, n) in enumerate(zip(ids.to_pylist(), sizes.tolist())):
            repeat = planted(doc_id, n)
            if repeat:
                a, p = repeat
                b = begins[d]
                source[b + a : b + n] = b + a + np.arange(n - a) % p
        at = at[source]
    doc, start, length, period = find_runs(at, sizes)
    gone = np.zeros(len(at) + 1, dtype=np.int64)
    np.add.at(gone, begins[doc] + start + period, 1)
    np.add.at(gone, begins[doc] + start + length, -1)
    kept = np.cumsum(gone)[:-1] == 0
    offsets = np.concatenate([[0], np.cumsum(kept)])[cuts]
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), words.take(pa.array(at[kept]))), " ")
    first = np.searchsorted(doc, np.arange(len(sizes) + 1))
    triples = list(zip(start.tolist(), length.tolist(), period.tolist()))
    best = [_best(triples[a:b]) for a, b in zip(first.tolist(), first[1:].tolist())]
    columns = [pa.array(c, pa.int64()) for c in zip(*best)]
    runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], ["start", "length", "period"])
    listed = pa.ListArray.from_arrays(pa.array(first, pa.int32()), runs)
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first), pa.int64()), *columns, listed, collapsed.cast(pa.string())], schema=SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """The runs and the collapsed text of :func:`periodic_runs` as SHA-256 in hexadecimal; of nothing that of the empty string. Other columns stay as they are."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumns({"runs_sha256": F.sha2(lines, 256), "collapsed_sha256": F.sha2("collapsed", 256)}).drop("runs", "collapsed")
