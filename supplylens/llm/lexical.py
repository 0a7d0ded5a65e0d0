"""Ranked lexical search over posting lists, led by range maxima.

``build_index`` cuts the documents into shards of a few megabytes of text, each within one task, and writes a posting list for each (shard, term):
the places of the documents in the shard, in order, and how often the term occurs in each. Nothing is shuffled for it but the
number of documents of each term.

``search`` sends the lists of the queries' terms to the shards, a block of queries at a time. A shard's lists stand one after
another under one sparse table, which answers where the maximum of any range of a list is. For each query

1. the shard's documents are one interval, bounded by the sum of the terms' maxima in it (weights times impacts, in integers);
2. the intervals of the highest bounds are split at the document where the term that adds most to the bound has its maximum. That
   document is scored, and the parts left and right of it get the sums of their own maxima as bounds. An interval of
   few documents is scored as a whole;
3. the search ends when no bound reaches the k-th best score. Bounds that equal it are followed, as ties go by document id.

Each shard returns at most k documents a query; a window takes the best of all shards.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supplylens.llm.columns import ranges, release_memory, text_stretches
from supplylens.llm.common import cut, shared_dir

#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD = 16_000_000
#: Queries that are searched together in a shard, intervals that are split at once, and documents from which an interval is split.
BLOCK, BATCH, SMALL = 256, 64, 48
#: What the scores of the contract are made of.
SCALE, LENGTH_PART, TF_PART = 1_000_000_000, 75, 8

#: ASCII characters that are neither letters nor digits separate terms; A-Z become lower case; all other bytes stay.
_FOLD = np.array([b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)], dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


def fold(texts: pa.Array) -> pa.Array:
    """Texts with A-Z in lower case and each separator as a space, by one look at each byte."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return texts
    ends = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    folded = _FOLD[np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]]]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(folded))


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Terms of all texts as numbers one after another, how many each text has, and the terms by number, in order of their bytes."""
    split = pc.ascii_split_whitespace(fold(texts))
    ends = np.asarray(split.offsets).astype(np.int64)
    flat = split.flatten().dictionary_encode()
    at = np.asarray(flat.indices).astype(np.int64)
    # Spaces at the ends of a text make empty words.
    there = (np.asarray(pc.binary_length(flat.dictionary)) > 0)[at]
    sizes = np.diff(np.concatenate([[0], np.cumsum(there)])[ends - ends[0]])
    order = np.asarray(pc.sort_indices(flat.dictionary))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return place[at[there]], sizes, flat.dictionary.take(pa.array(order)).to_pylist()


def lists_of(terms: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posting lists one after another: which terms have one, where each begins (and the last ends), documents, and counts."""
    docs = np.repeat(np.arange(len(sizes)), sizes)
    key, count = np.unique(terms * (len(sizes) or 1) + docs, return_counts=True)
    term, doc = np.divmod(key, len(sizes) or 1)
    which, first = np.unique(term, return_index=True)
    return which, np.concatenate([first, [len(term)]]), doc.astype(np.int32), count.astype(np.int32)


@dataclass
class Index:
    """``postings`` (shard, term, df, docs, counts) and ``documents`` (shard, ids, sizes), numbers as bytes; the number of documents with terms, and of all terms."""

    postings: DataFrame
    documents: DataFrame
    n_docs: int
    n_terms: int


POSTING = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("nulls", pa.binary())])


def _shard_rows(shard: int, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    terms, sizes, names = terms_of(texts)
    # By size, so that intervals hold documents of like impact.
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    rank = np.empty(len(sizes), dtype=np.int64)
    rank[order] = np.arange(len(order))
    docs = rank[np.repeat(np.arange(len(sizes)), sizes)]
    by = np.argsort(docs, kind="stable")
    which, first, doc, count = lists_of(terms[by], sizes[order])
    cuts = (first * 4).astype(np.int32)
    lists = [pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(cuts), pa.py_buffer(x)]) for x in (doc, count)]
    none = pa.nulls(len(which), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), shard)), pa.array([names[i] for i in which.tolist()], pa.string()), pa.array(np.diff(first), pa.int32()), *lists, none], schema=POSTING)
    # One row without a term holds the shard's documents: their ids, sizes, and which ids are null.
    ids = ids.take(pa.array(order))
    null = np.asarray(ids.is_null())
    row = [[shard], [None], [len(order)], [np.asarray(pc.fill_null(ids, 0)).astype(np.int64).tobytes()], [sizes[order].astype(np.int64).tobytes()], [null.astype(np.uint8).tobytes()]]
    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, POSTING)], schema=POSTING)


def build_index(docs: DataFrame, shard_bytes: int = SHARD) -> Index:
    """Index all terms of all rows of ``docs`` (doc_id, text) in the shared folder.

    A null text has no terms; documents without terms are not counted and never found. Repeated rows are documents of their own; null ids
    stay null. Other columns are not looked at, and an empty table makes an empty index.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, texts in text_stretches(batch["text"], shard_bytes):
                yield from _shard_rows((part << 32) + n, batch["doc_id"].slice(lo, hi - lo), texts)
                n += 1
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/supplylens-lexical-{uuid.uuid4().hex}"
    made = rows.mapInArrow(work, "shard long, term string, df int, docs binary, counts binary, nulls binary")
    made.withColumn("is_term", F.col("term").isNotNull()).write.partitionBy("is_term").option("compression", "zstd").parquet(path)
    stored = spark.read.schema("shard long, term string, df int, docs binary, counts binary, nulls binary, is_term boolean").parquet(path)
    documents = stored.filter("not is_term").select("shard", F.col("df").alias("n"), F.col("docs").alias("ids"), F.col("counts").alias("sizes"), "nulls")

    def sums(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            yield pa.RecordBatch.from_arrays([b["n"].cast(pa.int64()), pa.array([int(np.frombuffer(s.as_py(), dtype=np.int64).sum()) for s in b["sizes"]], pa.int64())], names=["n", "terms"])

    total = documents.select("n", "sizes").mapInArrow(sums, "n long, terms long").agg(F.sum("n"), F.sum("terms")).first()
    return Index(stored.filter("is_term").select("shard", "term", "df", "docs", "counts"), documents, total[0] or 0, total[1] or 0)


class _Shard:
    """The posting lists of some terms with their impacts, under one sparse table of the places of maxima."""

    def __init__(self, docs: list[bytes], counts: list[bytes], sizes: np.ndarray, n_docs: int, n_terms: int):
        lists = [np.frombuffer(d, dtype=np.int32) for d in docs]
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.docs = np.concatenate([*lists, np.empty(0, dtype=np.int32)]).astype(np.int64)
        tf = np.concatenate([*(np.frombuffer(c, dtype=np.int32) for c in counts), np.empty(0, dtype=np.int32)]).astype(np.int64)
        # Python's integers, as sizes times the number of documents can pass 64 bits on the way.
        part = np.array([(LENGTH_PART * s * n_docs) // n_terms for s in sizes.tolist()], dtype=np.int64)
        m = 100 - LENGTH_PART + part
        self.impact = (SCALE * tf) // (1000 * tf + TF_PART * m[self.docs])
        self.key = np.repeat(np.arange(len(lists)), np.diff(self.first)) * (len(sizes) + 1) + self.docs
        self.n = len(sizes)
        # A range never leaves its list, so tables need not reach further than the longest.
        longest = int(np.diff(self.first).max(initial=1))
        table = [np.arange(len(self.docs), dtype=np.int32)]
        while 2 << (len(table) - 1) <= longest:
            half, last = 1 << (len(table) - 1), table[-1]
            a, b = last[: len(last) - half], last[half:]
            table.append(np.where(self.impact[a] >= self.impact[b], a, b))
        self.table = table
        self.flat = np.concatenate(table)
        self.level = np.concatenate([[0], np.cumsum([len(x) for x in table])])[:-1]

    def place(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Where each document is, or would be, in each term's list."""
        return np.searchsorted(self.key, terms * (self.n + 1) + docs)

    def maxima(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the maximum of each range [lo, hi) within a list, and the maximum; 0 where it is empty."""
        size = hi - lo
        there = size > 0
        j = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        base = self.level[j]
        a = self.flat[np.where(there, base + lo, 0)]
        b = self.flat[np.where(there, base + hi - (1 << j.astype(np.int64)), 0)]
        at = np.where(self.impact[a] >= self.impact[b], a, b).astype(np.int64)
        return at, np.where(there, self.impact[at], 0)


def _intervals(shard: _Shard, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the documents of a shard that can be among the k best of one query (with all ties of the k-th)."""
    lo, hi = shard.first[terms][None, :], shard.first[terms + 1][None, :]
    begin, end = np.array([0]), np.array([shard.n])
    at, best = shard.maxima(lo, hi)
    gain = best * weights
    bound = gain.sum(axis=1)
    found, scores, least = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 1

    while len(bound):
        live = bound >= least
        if not live.any():
            break
        if not live.all():
            lo, hi, begin, end, at, gain, bound = (x[live] for x in (lo, hi, begin, end, at, gain, bound))
        pick = np.argpartition(-bound, BATCH)[:BATCH] if len(bound) > BATCH else np.arange(len(bound))
        rest = np.ones(len(bound), dtype=bool)
        rest[pick] = False
        small = (end[pick] - begin[pick]) <= SMALL
        leaf, split = pick[small], pick[~small]
        new_docs, new_scores, parts = [], [], []
        if len(leaf):
            n = (hi[leaf] - lo[leaf]).ravel()
            where = ranges(lo[leaf].ravel(), n)
            weight = np.repeat(np.broadcast_to(weights, lo[leaf].shape).ravel(), n)
            docs, inverse = np.unique(shard.docs[where], return_inverse=True)
            new_docs.append(docs)
            new_scores.append(np.zeros(len(docs), dtype=np.int64))
            np.add.at(new_scores[-1], inverse, weight * shard.impact[where])
        if len(split):
            lead = gain[split].argmax(axis=1)
            doc = shard.docs[at[split, lead]]
            mid = shard.place(terms[None, :], doc[:, None])
            inside = mid < hi[split]
            hit = inside & (shard.docs[np.where(inside, mid, 0)] == doc[:, None])
            new_docs.append(doc)
            new_scores.append((np.where(hit, shard.impact[np.where(inside, mid, 0)], 0) * weights).sum(axis=1))
            parts = [(lo[split], mid, begin[split], doc), (mid + hit, hi[split], doc + 1, end[split])]
        found, scores = np.concatenate([found, *new_docs]), np.concatenate([scores, *new_scores])
        if len(scores) >= k:
            least = max(1, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            keep = scores >= least
            found, scores = found[keep], scores[keep]
        if parts:
            l, h, b, e = (np.concatenate(x) for x in zip(*parts))
            some = e > b
            l, h, b, e = l[some], h[some], b[some], e[some]
            a, top = shard.maxima(l, h)
            g = top * weights
            lo, hi, begin, end = np.concatenate([lo[rest], l]), np.concatenate([hi[rest], h]), np.concatenate([begin[rest], b]), np.concatenate([end[rest], e])
            at, gain, bound = np.concatenate([at[rest], a]), np.concatenate([gain[rest], g]), np.concatenate([bound[rest], g.sum(axis=1)])
        else:
            lo, hi, begin, end, at, gain, bound = (x[rest] for x in (lo, hi, begin, end, at, gain, bound))
    keep = scores >= least
    return found[keep], scores[keep]


FOUND = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _best_of_shard(rows: pa.Table, k: int, n_docs: int, n_terms: int) -> pa.Table:
    """At most k rows for each query of a block. ``rows``: the shard's lists of the block's terms, and one without term with its documents and the queries."""
    is_list = np.asarray(rows["term"].is_valid())
    own = np.flatnonzero(~is_list)
    none = pa.table([[], [], []], schema=FOUND)
    if not len(own) or not is_list.any():
        return none
    own = rows.slice(int(own[0]), 1).to_pylist()[0]
    ids, sizes = (np.frombuffer(own[c], dtype=np.int64) for c in ("docs", "counts"))
    null = np.frombuffer(own["nulls"], dtype=np.uint8).astype(bool)
    lists = rows.filter(pa.array(is_list))
    shard = _Shard(lists["docs"].to_pylist(), lists["counts"].to_pylist(), sizes, n_docs, n_terms)
    place = {t: i for i, t in enumerate(lists["term"].to_pylist())}
    weight = lists["weight"].to_pylist()
    out: list[list] = [[], [], []]
    for q in own["queries"]:
        held = [(place[t["term"]], t["n"] * weight[place[t["term"]]]) for t in q["terms"] if t["term"] in place]
        if not held:
            continue
        docs, scores = _intervals(shard, *(np.array(x, dtype=np.int64) for x in zip(*held)), k)
        by = np.lexsort((ids[docs], null[docs], -scores))[:k]
        for column, values in zip(out, ([q["query"]] * len(by), [None if null[d] else int(ids[d]) for d in docs[by]], scores[by].tolist())):
            column += values
    return pa.table([pa.array(c, pa.int64()) for c in out], schema=FOUND)


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, query, terms: array of (term, n)) of each different row of ``items`` (item_id, text); those without terms are left out."""
    schema = "item_id long, query long, terms array<struct<term: string, n: long>>"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            numbers, sizes, names = terms_of(pa.array(frame["text"], pa.string()))
            lists = []
            for part in np.split(numbers, np.cumsum(sizes)[:-1]):
                which, n = np.unique(part, return_counts=True)
                lists.append([{"term": names[t], "n": int(c)} for t, c in zip(which, n)])
            yield pd.DataFrame({"item_id": frame["item_id"].astype("Int64"), "query": frame["query"], "terms": lists})

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    # A number that stays the same when a task is run again.
    rows = rows.withColumn("query", F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.lit("\n"), "text"))
    return rows.mapInPandas(work, schema).filter("size(terms) > 0")


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` best documents of each item (item_id, text), equal scores by ascending doc_id, null ids last.

    An item whose terms no document holds, or whose text is null or has no terms, finds nothing; documents with a score of 0 are not
    found. Of repeated rows of an item one is answered; items of one id with other texts are answered each by itself. Texts
    of any length are taken whole.
    """
    queries = cut(query_terms(items).withColumn("block", F.pmod(F.hash("query"), F.lit(-(-items.count() // BLOCK) or 1))))
    # How much the queries hold is known before they are broadcast; only few are.
    few = (queries.agg(F.sum(F.size("terms"))).first()[0] or 0) <= 500_000
    small = F.broadcast if few else lambda df: df
    wanted = queries.select("block", F.explode("terms").alias("t")).select("block", F.col("t.term").alias("term")).distinct()
    # Only the queries' terms are counted and sent.
    totals = index.postings.join(small(wanted.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("total"))
    share = (2.0 * index.n_docs + 2) / (2.0 * F.col("total") + 1)
    weights = totals.select("term", F.floor(1000 * F.log(share)).cast("long").alias("weight")).filter("weight > 0")
    weights = cut(weights.join(small(wanted), "term"), 500_000 if few else None)
    lists = index.postings.join(small(weights), "term").select("shard", "block", "term", "docs", "counts", "weight")
    # Each shard's documents meet the queries, a block of them at a time.
    blocks = queries.groupBy("block").agg(F.collect_list(F.struct("query", "terms")).alias("queries"))
    own = index.documents.crossJoin(small(blocks)).select("shard", "block", F.col("ids").alias("docs"), F.col("sizes").alias("counts"), "nulls", "queries")
    n_docs, n_terms = index.n_docs, index.n_terms

    def work(rows):
        return _best_of_shard(rows, k, n_docs, n_terms)

    found = lists.unionByName(own, allowMissingColumns=True).groupBy("shard", "block").applyInArrow(work, "query long, doc_id long, score long")
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.join(small(queries.select("query", "item_id")), "query").select("item_id", "rank", "doc_id", "score")


#: The same ranking in DuckDB's SQL, from all pairs of an item's terms and documents.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
stats AS (SELECT count(*) AS nn, sum(len(t))::BIGINT AS ll FROM d WHERE len(t) > 0),
tf AS (SELECT r, doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d) GROUP BY r, doc_id, n, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i),
qt AS (SELECT item_id, text, term, count(*) AS c FROM q GROUP BY item_id, text, term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT AS w FROM df, stats),
s AS (
  SELECT qt.item_id, qt.text, tf.r, tf.doc_id, sum(qt.c * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * tf.n * nn) // ll))))::BIGINT AS score
  FROM qt JOIN w USING (term) JOIN tf USING (term), stats GROUP BY qt.item_id, qt.text, tf.r, tf.doc_id
),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
