"""Exact top-k search by inner product in an M-tree.

A largest inner product is a smallest distance: with M the largest squared norm, each vector x gets the further coordinate sqrt(M - x.x) and each
query q gets 0, and then the squared distance is q.q + M - 2 q.x. Scores are whole numbers and exact; distances only bound them, with a slack
that is far above what doubles round.

``build`` groups equal vectors to one object with its smallest ids (no query needs more than k + 1 of them), routes objects to the
nearest of at most ``ROOTS`` objects drawn from a bounded sample, deals them to cells of about ``CELL`` objects, and builds a tree for each cell:
a node's entries are routed to some of them until they fit a page. Each page holds its routing object, its covering radius and
its distance to the parent, and for each entry the distance to the page's routing object. Cells may overlap, as nodes of an M-tree may, so a hot region is just more cells.

``search`` sends each query to one cell near it first, which gives a score to beat, and then to the cells whose covering
radius lets them beat it. In a cell, pages are taken best bound first; an entry is passed over without working out
its distance where the stored distances and the triangle inequality already show that it is too far.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supplylens.llm.columns import ranges, release_memory
from supplylens.llm.common import cut, join_groups, shared_table

#: Entries of a page, objects of a cell, routing objects of the root, objects of the sample they are drawn from, and queries searched together.
PAGE, CELL, ROOTS, SAMPLE, BLOCK = 256, 8192, 1024, 8192, 1024
#: Components are held within this, so that doubles add products of any vector of up to 2**13 components exactly.
LARGEST = 2**20
#: Far above what rounding can change in a score's bound, relative to the squares that it is made of.
SLACK = 1e-9


def whole_vectors(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v): each component as floor(scale * x), x as double, for the vectors that have only finite ones."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    held = F.transform(x, lambda c: F.greatest(F.least(F.floor(c * scale), F.lit(LARGEST).cast("long")), F.lit(-LARGEST).cast("long")).cast("int"))
    # A forall over null is null; "and" alone would let the planner work on vectors that are none.
    return rows.select(F.col(ident).cast("long").alias("vec_id"), F.when(fine, held).alias("v")).filter("v is not null")


def _matrix(lists, width: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones end in zeros."""
    arrow = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ends = np.asarray(arrow.offsets).astype(np.int64)
    flat = np.asarray(arrow.flatten()).astype(np.float64)
    ends = ends - ends[0]
    n = np.diff(ends)
    out = np.zeros((len(n), width))
    if len(flat):
        out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(ends[:-1], n)] = flat
    return out


def _distances(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Distances of objects, with their further coordinate, from each row of ``a`` to each of ``b``."""
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    height = np.sqrt(np.maximum(most - na, 0))[:, None] * np.sqrt(np.maximum(most - nb, 0))[None, :]
    return np.sqrt(np.maximum(2 * most - 2 * (a @ b.T + height), 0))


@dataclass
class MTree:
    """``pages`` of all cells, the root's entries (at most ``ROOTS``: object, largest covering radius of its cells, number of cells), width and largest squared norm."""

    pages: DataFrame
    roots: np.ndarray
    radii: np.ndarray
    cells: np.ndarray
    width: int
    most: float
    copies: int


PAGES = "root int, cell int, node int, parent int, leaf boolean, distance double, radius double, children array<int>, members binary, from_centre binary, ids array<array<bigint>>"
PAGE_SCHEMA = pa.schema(
    [("root", pa.int32()), ("cell", pa.int32()), ("node", pa.int32()), ("parent", pa.int32()), ("leaf", pa.bool_()), ("distance", pa.float64()), ("radius", pa.float64())]
    + [("children", pa.list_(pa.int32())), ("members", pa.binary()), ("from_centre", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64())))]
)


def _pages_of(x: np.ndarray, ids: pa.Array, root: int, cell: int, centre: np.ndarray, most: float, seed: int) -> pa.Table:
    """The pages of one cell's tree, built from the top: entries of a node are routed to the nearest of some drawn from them until they fit a page.

    ``members`` of a leaf are its objects, of another node the routing objects of its children. The top node is routed by ``centre``.
    """
    rng = np.random.default_rng(seed)
    rows: list[dict] = []
    todo = [(np.arange(len(x)), -1, centre, 0.0)]
    while todo:
        members, parent, middle, distance = todo.pop()
        node = len(rows)
        away = _distances(x[members], middle[None, :], most)[:, 0]
        row = {"root": root, "cell": cell, "node": node, "parent": parent, "distance": distance, "radius": float(away.max(initial=0)), "children": None, "ids": None}
        rows.append(row)
        if parent >= 0:
            rows[parent]["children"].append(node)
        groups = []
        if len(members) > PAGE:
            drawn = members[rng.permutation(len(members))[: min(PAGE, -(-len(members) // (PAGE // 2)))]]
            nearest = _distances(x[members], x[drawn], most).argmin(axis=1)
            groups = [(members[nearest == g], x[drawn[g]]) for g in range(len(drawn)) if (nearest == g).any()]
            if len(groups) < 2:
                # Objects that distances cannot tell apart are dealt evenly.
                groups = [(part, x[part[0]]) for part in np.array_split(members, -(-len(members) // PAGE))]
        if groups:
            centres = np.stack([c for _, c in groups])
            apart = _distances(centres, middle[None, :], most)[:, 0]
            # The last is taken up first, so children are numbered as they are met; their order here must be the same.
            row |= {"leaf": False, "children": [], "members": np.ascontiguousarray(centres[::-1]).astype(np.int32).tobytes(), "from_centre": apart[::-1].tobytes()}
            todo += [(m, node, c, float(d)) for (m, c), d in zip(groups, apart)]
        else:
            row |= {"leaf": True, "members": x[members].astype(np.int32).tobytes(), "from_centre": away.tobytes(), "ids": ids.take(pa.array(members)).to_pylist()}
    return pa.Table.from_pylist(rows, schema=PAGE_SCHEMA)


def build(vectors: DataFrame, k: int = 20) -> MTree:
    """An M-tree over all rows of ``vectors`` (vec_id, v: array<int>) that answers queries for up to ``k`` neighbours.

    Of rows with one vector the ``k + 1`` smallest ids are kept: no query can need more. Repeated rows count once. Null ids are left out. A shorter
    vector counts as one that ends in zeros. The root's routing objects are drawn from a sample of at most ``SAMPLE`` objects; all objects are indexed.
    """
    spark = vectors.sparkSession
    rows = vectors.filter("vec_id is not null").select("vec_id", "v").distinct()
    # Bounded before the shuffle: each task sends at most k + 1 rows of a vector.
    w = Window.partitionBy("v").orderBy("vec_id")
    first = rows.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= k + 1)
    objects = shared_table(first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "mtree-objects")
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c.cast("long") * c.cast("long"))
    n, width, most = objects.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    width, most = width or 0, float(most or 0)
    wanted = min(ROOTS, -(-n // CELL) or 1)
    sample = objects.select("v").orderBy(F.xxhash64("v"), "v").limit(min(SAMPLE, 4 * wanted)).toArrow()["v"]
    roots = _matrix(sample, width)[:wanted]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b["v"], width)
            nearest = np.concatenate([_distances(x[i : i + 4096], roots, most).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([pa.array(nearest, pa.int32()), b["v"], b["ids"]], names=["root", "v", "ids"])

    routed = cut(objects.select("v", "ids").mapInArrow(route, "root int, v array<int>, ids array<bigint>"))
    sizes = {r["root"]: r["n"] for r in routed.groupBy("root").agg(F.count("*").alias("n")).collect()}
    cells = np.array([-(-sizes.get(i, 0) // CELL) for i in range(len(roots))], dtype=np.int64)
    parts = spark.createDataFrame([(i, int(c)) for i, c in enumerate(cells) if c] or [(0, 1)], "root int, cells int")
    dealt = routed.join(F.broadcast(parts), "root").withColumn("cell", F.pmod(F.xxhash64("v"), F.col("cells")).cast("int"))

    def grow(key, table):
        root, cell = (c.as_py() for c in key)
        table = table.combine_chunks()
        return _pages_of(_matrix(table["v"], width), table["ids"].combine_chunks(), root, cell, roots[root], most, root * 1_000_003 + cell)

    pages = shared_table(dealt.select("root", "cell", "v", "ids").groupBy("root", "cell").applyInArrow(grow, PAGES), "mtree-pages")
    radii = np.zeros(len(roots))
    for r in pages.filter("parent = -1").groupBy("root").agg(F.max("radius").alias("r")).collect():
        radii[r["root"]] = r["r"]
    return MTree(pages, roots, radii, cells, width, most, k + 1)


class _Tree:
    """The pages of one cell, ready to be searched."""

    def __init__(self, pages: pa.Table, width: int):
        order = np.argsort(np.asarray(pages["node"]), kind="stable")
        pages = pages.take(pa.array(order))
        self.leaf, self.radius = pages["leaf"].to_pylist(), np.asarray(pages["radius"])
        self.children = [None if c is None else np.array(c) for c in pages["children"].to_pylist()]
        self.members = [np.frombuffer(b, dtype=np.int32).reshape(-1, width).astype(np.float64) if width else np.zeros((len(d) // 8, 0)) for b, d in zip(pages["members"].to_pylist(), pages["from_centre"].to_pylist())]
        self.from_centre = [np.frombuffer(b, dtype=np.float64) for b in pages["from_centre"].to_pylist()]
        self.ids = pages["ids"].to_pylist()


def _best_first(tree: _Tree, q: np.ndarray, centre: np.ndarray, most: float, k: int, least: int | None) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, id) of a cell for one query that reach ``least``, ties to the smaller id, and how many distances were worked out."""
    qq = float(q @ q)
    ground = qq + most
    slack = SLACK * (ground + 1) + 1e-6
    away = lambda score: np.sqrt(np.maximum(ground - 2 * score, 0))
    # How far an object may be to reach the score that must be reached.
    reach = lambda score: np.inf if score is None else float(np.sqrt(max(ground - 2 * score + 2 * slack, 0)))
    within, worked = reach(least), 1
    best: list[tuple[int, int]] = []
    top = float(away(q @ centre))
    heap = [(max(top - tree.radius[0], 0.0), 0, top)]
    while heap:
        near, node, mine = heapq.heappop(heap)
        if near > within:
            break
        stored = tree.from_centre[node]
        if tree.leaf[node]:
            maybe = np.flatnonzero(np.abs(mine - stored) <= within + 1e-6)
        else:
            radii = tree.radius[tree.children[node]]
            maybe = np.flatnonzero(np.abs(mine - stored) - radii <= within + 1e-6)
        if not len(maybe):
            continue
        score = tree.members[node][maybe] @ q
        worked += len(maybe)
        if not tree.leaf[node]:
            d = away(score)
            low = np.maximum(d - radii[maybe], 0)
            for i in np.flatnonzero(low <= within):
                heapq.heappush(heap, (float(low[i]), int(tree.children[node][maybe[i]]), float(d[i])))
            continue
        good = range(len(maybe)) if least is None else np.flatnonzero(score >= least)
        if not len(good):
            continue
        best += [(int(score[i]), ident) for i in good for ident in tree.ids[node][maybe[i]]]
        best.sort(key=lambda b: (-b[0], b[1]))
        del best[k:]
        if len(best) == k:
            least = best[-1][0] if least is None else max(least, best[-1][0])
            within = reach(least)
    return best, worked


FOUND = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("worked", pa.int64())])


def _search_cell(asked: pa.Table, pages: pa.Table, tree: MTree) -> pa.Table:
    out: list[list] = [[], [], [], []]
    if len(asked) and len(pages):
        cell = _Tree(pages, tree.width)
        centre = tree.roots[pages["root"][0].as_py()]
        for query, q, least in zip(asked["query"].to_pylist(), _matrix(asked["v"], tree.width), asked["least"].to_pylist()):
            best, worked = _best_first(cell, q, centre, tree.most, tree.copies, least)
            # A query that finds nothing still says what it cost.
            for i, (score, ident) in enumerate(best or [(None, None)]):
                for column, value in zip(out, (query, ident, score, 0 if i else worked)):
                    column.append(value)
    return pa.table([pa.array(c, pa.int64()) for c in out], schema=FOUND)


def _in_cells(tree: MTree, asked: DataFrame) -> DataFrame:
    """Search ``asked`` (root, cell, query, v, least) in its cells, a block of queries at a time; each block gets the pages of its cell."""
    bare = MTree(None, tree.roots, tree.radii, tree.cells, tree.width, tree.most, tree.copies)  # type: ignore[arg-type]
    counts = asked.groupBy("root", "cell").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = asked.join(counts, ["root", "cell"]).withColumn("block", F.pmod(F.xxhash64("query"), blocks).cast("int")).drop("n")
    pages = tree.pages.join(counts, ["root", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("n")
    keys = ["root", "cell", "block"]

    def work(left, right):
        return _search_cell(left, right, bare)

    return dealt.groupBy(*keys).cogroup(pages.groupBy(*keys)).applyInArrow(work, "query long, vec_id long, score long, worked long")


def _route_queries(tree: MTree, queries: DataFrame, first: bool) -> DataFrame:
    """(root, cell, query, v, least) for the cells to search: one of the nearest root's, or all others that can beat ``least`` (null: all)."""
    roots, radii, cells, width, most = tree.roots, tree.radii, tree.cells, tree.width, tree.most
    schema = pa.schema([("root", pa.int32()), ("cell", pa.int32()), ("query", pa.int64()), ("v", pa.list_(pa.int32())), ("least", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, ids = _matrix(b["v"], width), np.asarray(b["query"])
            score = q @ roots.T
            home = np.where(cells > 0, score, -np.inf).argmax(axis=1)
            own = ids % np.maximum(cells[home], 1)
            if first:
                i, root, cell = np.arange(len(q)), home, own
            else:
                ground = (q * q).sum(axis=1) + most
                away = np.sqrt(np.maximum(ground[:, None] - 2 * score, 0))
                least = np.array([np.nan if x is None else x for x in b["least"].to_pylist()], dtype=np.float64)
                reach = np.where(np.isnan(least), np.inf, np.sqrt(np.maximum(ground - 2 * np.nan_to_num(least) + 1e-6 + SLACK * ground, 0)))
                close = away - radii[None, :] <= reach[:, None] + 1e-6
                i, root = np.nonzero(close & (cells > 0)[None, :])
                n = cells[root]
                i, root, cell = np.repeat(i, n), np.repeat(root, n), ranges(np.zeros_like(n), n)
                new = (root != home[i]) | (cell != own[i])
                i, root, cell = i[new], root[new], cell[new]
            at = pa.array(i)
            yield pa.RecordBatch.from_arrays([pa.array(root, pa.int32()), pa.array(cell, pa.int32()), b["query"].take(at), b["v"].take(at).cast(pa.list_(pa.int32())), b["least"].take(at)], schema=schema)
        release_memory()

    return queries.select("query", "v", "least").mapInArrow(work, "root int, cell int, query long, v array<int>, least long")


def search(tree: MTree, queries: DataFrame, k: int = 20, with_cost: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` highest inner products of each row of ``queries`` (vec_id, v) with the tree's rows of other ids.

    Ties go to the smaller id. Fewer than ``k`` rows are returned where there are no more. Repeated queries are answered once; of an id that comes with
    several vectors each is answered by itself. Null ids ask nothing. ``with_cost`` returns (query, worked), the distances worked out for each different vector, instead.
    """
    if k >= tree.copies:
        raise ValueError(f"the tree was built for at most {tree.copies - 1} neighbours")
    asked = cut(queries.filter("vec_id is not null").select("vec_id", "v").distinct())
    # Equal vectors find the same rows but for their own ids, so each different one is searched once.
    different = asked.groupBy("v").agg(F.count("*").alias("n"))
    different = cut(different.withColumn("query", F.monotonically_increasing_id()))
    none = F.lit(None).cast("long").alias("least")
    near = cut(_in_cells(tree, _route_queries(tree, different.select("query", "v", none), True)))
    # The score to beat is that of the last place, where all places are filled.
    filled = near.filter("vec_id is not null").groupBy("query").agg(F.count("*").alias("found"), F.min("score").alias("low"))
    floor = filled.select("query", F.when(F.col("found") >= tree.copies, F.col("low")).alias("least"))
    far = _in_cells(tree, _route_queries(tree, different.select("query", "v").join(floor, "query", "left"), False))
    both = near.unionByName(far)
    if with_cost:
        return both.groupBy("query").agg(F.sum("worked").alias("worked"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = both.filter("vec_id is not null").withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= tree.copies)
    lists = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))
    groups = cut(different.join(lists, "query").select("v", "n", "found"))
    rows = join_groups(asked, groups, ["v"], "n", asked.count())
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("vec_id")), 1, k)
    out = rows.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("pos", "f"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.s")).alias("score"))


#: The same rows by all pairs of queries and rows in DuckDB's SQL.
ORACLE = """
WITH x AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c::DOUBLE))) = 0
),
s AS (SELECT q.vec_id AS query_id, q.v AS qv, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score FROM x AS q JOIN x ON x.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
