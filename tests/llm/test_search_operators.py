"""Exact top-k by M-tree, ranked lexical search and periodic runs against brute force, on small and odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from supplylens.llm import lexical, metric_tree, periodic
from supplylens.llm.queries import op13_periodic_runs

# M-tree

VECTORS = "vec_id long, embedding array<float>, label int, v string, root int, query long"


def nearest(rows, k, every):
    """All products of all pairs, ties to the smaller id; equal rows once."""
    whole = {(i, tuple(math.floor(64 * x) for x in e)) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q, v in whole:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return Counter(out)


def found(spark, rows, k=20, every=5):
    table = spark.createDataFrame([(i, e, 0, "x", 1, 2) for i, e in rows], VECTORS)
    v = metric_tree.whole_vectors(table)
    return Counter(tuple(r) for r in metric_tree.search(metric_tree.build(v, k), v.filter(f"vec_id % {every} = 0"), k).collect())


@pytest.mark.parametrize("sizes", [(64, 8192), (4, 40)])
def test_m_tree_equals_all_pairs(spark, monkeypatch, sizes):
    """Clusters, a hot vector, zero vectors, nulls, infinities, a shorter vector, an id with two vectors and repeated rows, with few and with many cells."""
    monkeypatch.setattr(metric_tree, "PAGE", sizes[0])
    monkeypatch.setattr(metric_tree, "CELL", sizes[1])
    rng = random.Random(1)
    centres = [[rng.gauss(0, 0.5) for _ in range(6)] for _ in range(4)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, 0.1))) for c in rng.choice(centres)]) for i in range(220)]
    rows += [(1000 + i, [0.5] * 6) for i in range(90)] + [(2000 + i, [0.0] * 6) for i in range(30)]
    rows += [(3000, None), (3005, [None] * 6), (3010, [float("nan")] + [0.0] * 5), (3015, [float("inf")] + [0.0] * 5), (3020, [0.25, -0.5]), (None, [1.0] * 6)]
    rows += [(5, [0.125] * 6), rows[7], rows[7], rows[10], (3025, [])]
    assert found(spark, rows) == nearest(rows, 20, 5)


def test_m_tree_of_few_and_of_no_rows(spark):
    rows = [(0, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [-1.0, 0.0])]
    assert found(spark, rows, k=3) == nearest(rows, 3, 5) and found(spark, [], k=3) == Counter() and found(spark, rows[:1], k=3) == Counter()


def test_m_tree_passes_over_far_pages(monkeypatch):
    """In well separated clusters most distances are never worked out."""
    monkeypatch.setattr(metric_tree, "PAGE", 32)
    rng = np.random.default_rng(3)
    x = np.floor(64 * (np.repeat(rng.normal(size=(20, 8)) * 4, 100, axis=0) + rng.normal(size=(2000, 8)) * 0.05))
    most = float((x * x).sum(axis=1).max())
    pages = metric_tree._pages_of(x, pa.array([[i] for i in range(len(x))]), 0, 0, x[0], most, 1)
    tree, costs = metric_tree._Tree(pages, 8), []
    for q in x[::97]:
        best, worked = metric_tree._best_first(tree, q, x[0], most, 10, None)
        assert [s for s, _ in best] == sorted((x @ q).astype(int).tolist(), reverse=True)[:10]
        costs.append(worked)
    assert sum(costs) / len(costs) < len(x) / 3


# Lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for doc, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return Counter(out)


@pytest.mark.parametrize("small", [(3, 2), (64, 48)])
def test_lexical_search_equals_scoring_all(spark, monkeypatch, small):
    """Odd texts, nulls, ties by copies, repeated rows and items, a very long text, in several shards and blocks."""
    monkeypatch.setattr(lexical, "BATCH", small[0])
    monkeypatch.setattr(lexical, "SMALL", small[1])
    monkeypatch.setattr(lexical, "BLOCK", 8)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "ЖЖ", "a'b", "C3PO", "İ"]
    text = lambda n: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=n)) + rng.choice(["", ".", "\x00x", " y"])
    docs = [(i, text(rng.choice([1, 5, 30, 200]))) for i in range(150)] + [(200 + i, "w1 w1 w40") for i in range(15)]
    docs += [(300, None), (301, ""), (302, "!?"), (None, "w50 w51"), (303, "w50 w51"), (304, text(20_000)), docs[3], docs[3]]
    items = [(i, text(rng.choice([1, 3, 12]))) for i in range(20)] + [(30, None), (31, "?"), (32, "nowhere"), (33, "w40 w40 W1"), (33, "w50"), (33, "w50"), (None, "w2 w3")]
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, term string, shard string, df int").repartition(3)
    index = lexical.build_index(table, shard_bytes=4000)
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), 10)
    assert Counter(tuple(r) for r in got.collect()) == ranked(docs, items, 10)


def test_lexical_search_of_empty_tables(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    some = spark.createDataFrame([(1, "a b")], docs)
    assert lexical.search(lexical.build_index(some.limit(0)), spark.createDataFrame([(1, "a")], items)).count() == 0
    assert lexical.search(lexical.build_index(some), spark.createDataFrame([], items)).count() == 0
    assert lexical.search(lexical.build_index(spark.createDataFrame([(1, None)], docs)), spark.createDataFrame([(1, "a")], items)).count() == 0


# Periodic runs


def runs_of(x):
    """Every maximal stretch of every period, smallest period first."""
    out = {}
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def some_words(rng):
    n, letters = rng.choice([0, 1, 23, 24, 60, 150, 400]), rng.choice([1, 2, 4, 60])
    x = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(3) if n > 24 else 0):
        at, p = rng.randrange(n), rng.randrange(1, max(2, n // 3))
        base = rng.choice([[rng.randrange(letters) for _ in range(p)], [0] * (p - 1) + [1], ([0, 1] * p)[: p - 1] + [7], ([0, 0, 1] * p)[: p - 1] + [0]])
        x[at : at + rng.randrange(n)] = [base[j % len(base)] for j in range(min(n - at, rng.randrange(n)))]
    return x


def test_runs_equal_all_periods():
    rng = random.Random(6)
    fibonacci = [0]
    for _ in range(12):
        fibonacci = [y for v in fibonacci for y in ((0, 1) if v == 0 else (0,))]
    for _ in range(60):
        docs = [some_words(rng) for _ in range(rng.randrange(8))] + [fibonacci[: rng.randrange(300)]]
        doc, start, length, period = periodic.find_runs(np.array([v for d in docs for v in d]), np.array([len(d) for d in docs]))
        got = [[] for _ in docs]
        for d, *run in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist()):
            got[d].append(tuple(run))
        assert got == [runs_of(x) for x in docs]


def test_long_runs_cost_no_more_than_their_length():
    for x in (np.arange(150_000) % 3, np.arange(150_000) % 40_000, np.zeros(150_000, dtype=int)):
        assert [v.tolist() for v in periodic.find_runs(x, np.array([len(x)]))] == [[0], [0], [150_000], [int(x.max()) + 1]]


def row_of(doc_id, text):
    """What the contract says of one row."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = runs_of(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    s, length, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = 1000 * length // q if runs else None
    return doc_id, len(runs), s, length, q, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_rows_of_odd_texts(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{v}" for v in some_words(rng))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "a b\tc " * 30), (204, "  x" * 24 + "\v"), (None, "q r " * 40), (205, "é z \x85 " * 40), rows[3], rows[3], (206, "w " * 5000 + "v")]
    table = spark.createDataFrame([(i, t, "en", 1, "r") for i, t in rows], "doc_id long, text string, runs string, start int, collapsed string")
    got = periodic.digests(periodic.periodic_runs(table, plant=True)).select(*COLUMNS).collect()
    assert Counter(tuple(r) for r in got) == Counter(row_of(i, t) for i, t in rows)
    assert periodic.periodic_runs(table.limit(0)).count() == 0


def test_query_over_the_whole_table(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in op13_periodic_runs(spark, sf_dir).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        if len((text or "").split()) < 1500:
            assert got[i] == row_of(i, text), i
