"""Near-duplicate groups by MinHash.

A document's set is its distinct word shingles. ``BANDS * ROWS`` universal hash functions give one minimum each;
the minima of a band hash to a bucket. Documents with equal sets are first reduced to one node, so a node is a set and not an id. Then

1. nodes that share a bucket form families: components of the edges from each bucket's members to its centre, so a
   bucket of m nodes costs m edges. No link leaves its family;
2. in families larger than a few blocks, members are verified against the centres of their buckets (four different orders over
   the bands) and verified links joined to components, since most of such a family is one group;
3. every family that is not one component is searched exactly, block against block, in two steps. The first holds signatures only, and
   keeps of each unit the nodes that may reach the threshold with a node of another component. The second fetches
   the sets of these and compares them. Nodes that are connected already need
   no link of their own, so a block of copies costs one link each and nothing is lost;
4. all links become components by alternating large-star and small-star steps. Sets that share an id are linked as well.

At 32 bands of 5 rows a pair of similarity 0.8 shares no bucket with probability 3e-6.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supplylens.llm.columns import distinct_words, release_memory, text_stretches
from supplylens.llm.common import cut, join_groups

BANDS, ROWS = 32, 5
#: Signature estimates this far below the threshold rule a pair out: 4.7 standard deviations of 160 hashes at 0.8.
MARGIN = 0.15
#: Nodes in a block of the exact search, and blocks from which a family is first thinned out by its centres.
BLOCK, LARGE = 512, 4


def _hashes() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the universal (multiply-shift) family, from a fixed seed."""
    rng = np.random.default_rng(20_240_917)
    n = BANDS * ROWS
    return rng.integers(1, 2**63, n, dtype=np.uint64) * 2 + 1, rng.integers(0, 2**63, n, dtype=np.uint64)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text with the word hashes ``h``."""
    if not len(h):
        return h
    width = min(k, len(h))
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        out = (out ^ h[i : len(h) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The set of each text of a column: words between ASCII white space, A-Z in lower case, each different word hashed once."""
    for _, _, part in text_stretches(texts):
        first, at, words = distinct_words(pc.ascii_lower(part))
        words = words.to_pylist()
        there = np.fromiter(map(bool, words), dtype=bool, count=len(words))[at]
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))[at[there]]
        cuts = np.concatenate([[0], np.cumsum(there)])[first].tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield shingles(h[a:b], k)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One minimum for each hash function, of the upper half of (a * x + b)."""
    best = np.full(len(a), 2**32 - 1, dtype=np.uint64)
    x = hashes >> np.uint64(32)
    for at in range(0, len(x), 2048):
        part = (a[:, None] * x[None, at : at + 2048] + b[:, None]) >> np.uint64(32)
        np.minimum(best, part.min(axis=1), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A signed 64-bit bucket for each band; its lowest five bits are the band's number."""
    m = sig.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(ROWS):
        key = (key ^ m[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return ((key & ~np.uint64(31)) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, set_key, bands and the signature's low bytes for every document (bands and signature are null for empty sets)."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hashes()
        for batch in batches:
            rows = []
            for h in shingle_sets(batch["text"], k):
                if len(h):
                    sig = signature(h, a, b)
                    rows.append((len(h), xxhash.xxh128_digest(h.tobytes()), band_keys(sig), (sig & np.uint64(255)).astype(np.uint8).tobytes()))
                else:
                    rows.append((0, b"", None, None))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:]))], schema=schema)
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(work, "doc_id long, mark long, n_shingles long, set_key binary, bands array<long>, sig binary")


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component) of every node of ``links`` (columns a, b) by alternating large-star and small-star.

    Ends when an iteration leaves the set of edges as it was. Each node's component is its smallest node.
    ``most`` is a bound on the number of links, if one is known.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    edges = cut(edges, most)
    before = None
    while True:
        n, mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if n == 0 or (n, mark) == before:
            break
        before = (n, mark)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).withColumn("m", F.least("m", "u"))
        large = join_groups(both, low, ["u"], "degree", 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.filter("u > v").distinct(), n)
        total = large.count()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        small = join_groups(large, low, ["u"], "degree", total).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").filter("u > v").distinct(), total)
    # Every edge now leads from a node to the smallest of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _salted(pairs: DataFrame, key: str, other: str, side: DataFrame, counted: DataFrame, share: int = 1000) -> DataFrame:
    """Join ``pairs`` with ``side`` (one row for each ``key``), splitting keys with more than 1 / ``share`` of the pairs.

    At most ``share`` keys are split; their numbers of parts are broadcast, and their row of ``side`` is repeated for each part.
    ``counted`` holds the same pairs in a form that is cheap to read twice.
    """
    total = max(1, counted.count())
    counts = counted.groupBy(key).agg(F.count("*").alias("__n"))
    parts = cut(counts.filter(F.col("__n") * share >= total).select(key, F.least("__n", F.floor(F.col("__n") * share / total) + 1).cast("int").alias("__parts")), share)
    left = pairs.join(F.broadcast(parts), key, "left").withColumn("__salt", F.pmod(F.xxhash64(other), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    right = side.join(F.broadcast(parts), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [key, "__salt"]).drop("__salt")


def similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether 100 * |intersection| >= threshold * |union| for two sorted hash sets."""
    common = int((x[np.minimum(x.searchsorted(y), len(x) - 1)] == y).sum()) if len(x) else 0
    return common > 0 and 100 * common >= threshold * (len(x) + len(y) - common)


def _centre_links(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold; b is a centre with possibly very many pairs. ``sets``: node, set."""
    n_pairs = pairs.count()
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    joined = _salted(joined, "b", "a", sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), pairs)

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [similar(np.frombuffer(y, np.uint64), np.frombuffer(x, np.uint64), threshold) for x, y in zip(batch["set_a"], batch["set_b"])]
            yield batch[np.array(keep, dtype=bool)][["a", "b"]]

    return cut(joined.select("a", "b", "set_a", "set_b").mapInPandas(confirm, "a long, b long"), n_pairs, 5_000)


def possible(component: np.ndarray, block: np.ndarray, size: np.ndarray, sigs: np.ndarray, threshold: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a unit the later rows of other components that sizes and signatures leave in question.

    A unit of two blocks only compares across them; each block has a unit of its own.
    """
    least = (threshold / 100 - MARGIN) * BANDS * ROWS
    across = len(np.unique(block)) > 1
    for r in range(len(size)):
        ok = (component[r + 1 :] != component[r]) & (np.minimum(size[r], size[r + 1 :]) * 100 >= np.maximum(size[r], size[r + 1 :]) * threshold)
        if across:
            ok &= block[r + 1 :] != block[r]
        at = np.flatnonzero(ok) + r + 1
        if len(at):
            at = at[(sigs[at] == sigs[r]).sum(axis=1) >= least]
        if len(at):
            yield r, at


def search_unit(node: np.ndarray, component: np.ndarray, block: np.ndarray, sets: list[np.ndarray], sigs: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links between different components of one unit of work, enough to connect all that are connected."""
    root = {c: c for c in component.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    links = []
    for r, at in possible(component, block, np.array([len(s) for s in sets]), sigs, threshold):
        for i in at.tolist():
            x, y = find(component[r].item()), find(component[i].item())
            if x != y and similar(sets[r], sets[i], threshold):
                root[max(x, y)] = min(x, y)
                links.append((int(node[r]), int(node[i])))
    return links


UNIT = ["family", "i", "j"]


def _signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), BANDS * ROWS)


def _each_unit(units: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``work`` to the rows of each unit that hold more than one component. A task holds a few units at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(frames: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if frames:
                rows = pd.concat(frames, ignore_index=True)
                made = [work(g) for _, g in rows.groupby(UNIT, sort=False) if g["component"].iloc[0] != g["component"].iloc[-1] or g["component"].nunique() > 1]
                if made:
                    yield pd.concat(made, ignore_index=True)

        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                last = tuple(part.iloc[-1][UNIT])
                open_ = (part["family"] == last[0]) & (part["i"] == last[1]) & (part["j"] == last[2])
                if open_.all() and held and tuple(held[-1].iloc[-1][UNIT]) == last:
                    held.append(part)
                    continue
                yield from done([*held, part[~open_]])
                held = [part[open_]]
        yield from done(held)

    return units.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInPandas(run, schema)


def _candidates(info: DataFrame, threshold: int) -> DataFrame:
    """family, i, j, block, component, node, sig: in each unit the nodes that may be linked across components. ``info``: node, n, sig, family, component.

    Components of a block or more have blocks of their own, the others of a family share blocks. Each pair of a family's
    blocks is one unit, but for pairs within one component. Rows of units are small: no text or set is among them.
    """
    total = info.count()
    sizes = info.groupBy("family", "component").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("small", F.when(F.col("size") < BLOCK, F.col("size")).otherwise(0)).withColumn("own", F.when(F.col("size") >= BLOCK, F.ceil(F.col("size") / BLOCK)).otherwise(0))
    sizes = cut(sizes, total)
    families = sizes.groupBy("family").agg(F.sum("small").alias("small"), F.sum("own").alias("all_own"), F.count("*").alias("components")).filter("components > 1")
    shared = F.ceil(F.col("small") / BLOCK)
    families = cut(families.select("family", shared.cast("int").alias("shared"), (shared + F.col("all_own")).alias("blocks"), "components"), total)
    # Large components are numbered after the shared blocks; a family of n nodes has n / BLOCK of them at most.
    before = Window.partitionBy("family").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.filter("own > 0").select("family", "component", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("at"))
    placed = join_groups(sizes.select("family", "component", "size", "own"), families, ["family"], "components", max(1, total))
    placed = placed.join(firsts, ["family", "component"], "left").withColumn("first", F.col("shared") + F.coalesce("at", F.lit(0)))
    placed = cut(placed.select("family", "component", "size", "shared", "own", "first", "blocks"), total)
    # A component with a large part of all nodes must not make a task of the join.
    rows = join_groups(info, placed, ["family", "component"], "size", max(1, total))
    block = F.when(F.col("own") > 0, F.col("first") + F.pmod(F.xxhash64("node"), F.col("own"))).otherwise(F.pmod(F.xxhash64("component"), F.greatest("shared", F.lit(1))))
    rows = rows.withColumn("block", block.cast("int"))
    other = F.filter(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1), lambda u: (F.col("own") == 0) | (u < F.col("first")) | (u >= F.col("first") + F.col("own")))
    units = rows.withColumn("unit", F.explode(other))
    units = units.select("family", F.least("block", "unit").alias("i"), F.greatest("block", "unit").alias("j"), "block", "component", "node", "n", "sig")

    def work(g: pd.DataFrame) -> pd.DataFrame:
        keep = np.zeros(len(g), dtype=bool)
        for r, at in possible(g["component"].to_numpy(), g["block"].to_numpy(), g["n"].to_numpy(), _signatures(g["sig"]), threshold):
            keep[r] = True
            keep[at] = True
        return g[keep].drop(columns="n")

    return cut(_each_unit(units, work, "family long, i int, j int, block int, component long, node long, sig binary"))


def _links(candidates: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links between components, from the units' candidates and their sets (node, set)."""

    def work(g: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(x, np.uint64) for x in g["set"]]
        found = search_unit(g["node"].to_numpy(), g["component"].to_numpy(), g["block"].to_numpy(), held, _signatures(g["sig"]), threshold)
        return pd.DataFrame(found or np.zeros((0, 2), dtype=np.int64), columns=["a", "b"])

    return cut(_each_unit(candidates.join(sets, "node"), work, "a long, b long"))


def _sets_of(docs: DataFrame, nodes: DataFrame, k: int, n_nodes: int) -> DataFrame:
    """(node, set) of the given nodes (node, doc_id, set_key): the document is read again and its set held against the key, since ids can repeat with other texts."""
    wanted = docs.join(nodes, "doc_id").select("node", "set_key", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [h.tobytes() for h in shingle_sets(batch["text"], k)]
            own = pa.array([xxhash.xxh128_digest(h) == key for h, key in zip(made, batch["set_key"].to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["node"].filter(own), pa.array(made, pa.binary()).filter(own)], names=["node", "set"])
        release_memory()

    return cut(wanted.mapInArrow(work, "node long, set binary").dropDuplicates(["node"]), n_nodes, 2_000)


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text", apart: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept. With ``apart`` instead (doc_id, mark), the ids and the hashes of the texts that stay, for which an id links nothing.

    ``threshold`` is a Jaccard similarity in percent. Further:

    * null, empty and white-space texts have an empty set, are their own component and linked with nothing;
    * a text of fewer than ``k`` words has its whole word sequence as its one shingle;
    * rows with the same id count as one document, whose sets are all linked: they share a component (but for rows with an empty set);
      rows without id are linked with nothing, have a null component and are kept;
    * texts of any length are shingled whole; an empty table gives an empty result; only the two named
      columns are read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(sketches(docs, k))
    n_rows = rows.count()
    real = rows.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    held = F.first(F.struct("bands", "sig", F.col("n_shingles").alias("n"))).alias("held")  # the same for all rows of a set
    sets = cut(real.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), held), n_rows, 20_000)
    # Numbers of rows are stable over the checkpoint.
    sets = sets.select("set_key", "doc_id", "copies", "held.*", F.monotonically_increasing_id().alias("node"))
    n_nodes = sets.count()
    buckets = sets.select("node", F.explode("bands").alias("key"))
    # The centre of a bucket is its first node in one of four orders, by band.
    mask = F.xxhash64(F.col("key").bitwiseAND(F.lit(3)))
    stars = buckets.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(mask)).alias("first"), F.count("*").alias("members")).filter("members > 1")
    stars = cut(stars.select("key", F.col("first").bitwiseXOR(mask).alias("centre"), "members"), BANDS * n_nodes)
    spokes = cut(join_groups(buckets, stars, ["key"], "members", max(1, n_nodes)).filter("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), BANDS * n_nodes)
    families = components(spokes, BANDS * n_nodes)
    families = cut(families.unionByName(families.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("component", "family"), n_nodes)
    info = sets.select("node", "doc_id", "set_key", "n", "sig").join(families, "node")
    sizes = families.groupBy("family").agg(F.count("*").alias("size"))
    info = cut(join_groups(info, cut(sizes, n_nodes), ["family"], "size", max(1, n_nodes)), n_nodes, 20_000)
    within, small = (info.filter(large).drop("size") for large in (F.col("size") > LARGE * BLOCK, F.col("size") <= LARGE * BLOCK))
    some = not within.isEmpty()
    candidates = _candidates(small.withColumn("component", F.col("node")), threshold)
    wanted = candidates.select("node").distinct()
    nodes = info.select("node", "doc_id", "set_key").join(wanted.unionByName(within.select("node")) if some else wanted, "node", "left_semi")
    full = _sets_of(docs, nodes, k, n_nodes)
    links = []
    if some:
        links.append(_centre_links(cut(spokes.join(within.select(F.col("node").alias("a")), "a", "left_semi"), BANDS * n_nodes), full, threshold))
        known = within.join(components(links[0], BANDS * n_nodes), "node", "left").withColumn("component", F.coalesce("component", "node"))
        candidates = candidates.unionByName(_candidates(known, threshold))
    links += [_links(candidates, full, threshold), *([] if apart else _same_id(real, sets))]
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    found = components(every, BANDS * n_nodes)

    labelled = cut(sets.select("set_key", "doc_id", "copies", "node").join(found, "node", "left").withColumn("root", F.coalesce("component", "node")), n_nodes)
    if apart:
        # Of each group the smallest id stays, and of its texts the one with the smallest hash.
        named = join_groups(real.select("doc_id", "mark", "set_key"), labelled.select("set_key", "copies", "root"), ["set_key"], "copies", max(1, n_rows))
        first = named.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("first")).select("first.*")
        return first.unionByName(rows.filter("n_shingles = 0 and doc_id is not null").select("doc_id", "mark").distinct())
    roots = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size"))
    groups = join_groups(labelled.select("set_key", "copies", "root"), cut(roots, n_nodes), ["root"], "size", max(1, n_nodes)).select("set_key", "copies", "component_id")
    full = join_groups(real.select("doc_id", "n_shingles", "set_key"), groups, ["set_key"], "copies", max(1, n_rows)).select("doc_id", "n_shingles", "component_id")
    alone = rows.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _same_id(real: DataFrame, sets: DataFrame) -> list[DataFrame]:
    """Links (a, b) between the sets of an id that repeats with other texts."""
    mark = F.xxhash64("set_key")
    several = real.groupBy("doc_id").agg(F.min(mark).alias("low"), F.max(mark).alias("high"), F.count("*").alias("rows")).filter("low != high")
    several = cut(several)
    if several.isEmpty():
        return []
    pairs = join_groups(real.select("doc_id", mark.alias("mark")), several, ["doc_id"], "rows", max(1, real.count())).select("low", "mark").filter("low != mark").distinct()
    numbered = sets.select("node", mark.alias("mark"))
    pairs = pairs.join(numbered.withColumnRenamed("node", "a"), "mark").join(numbered.select(F.col("mark").alias("low"), F.col("node").alias("b")), "low")
    return [pairs.select("a", "b")]


def drop_near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each group, and every document without a group.

    Rows are told apart by id and text, so of an id that repeats with other texts each stays unless it is a near copy of another row. Of a group the
    smallest id stays. Rows that repeat the id and text of one that stays are reduced to one; null and empty texts, and rows without
    id, are copies of nothing and stay. Texts of any length are compared whole; an empty table stays empty; rows travel as one struct, so no column name can clash.
    """
    kept = near_duplicates(docs, k, threshold, id_col, text_col, apart=True).select(F.col("doc_id").alias("id"), F.col("mark").alias("hash"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"))
    named = rows.join(kept, ["id", "hash"])
    counts = rows.groupBy("id", "hash").agg(F.count("*").alias("n")).filter("n > 1").select("id", "hash")
    again = named.join(counts, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
    once = named.join(counts, ["id", "hash"], "left_anti")
    return once.select("row.*").unionByName(again.select("row.*")).unionByName(rows.filter("id is null").select("row.*"))


#: op9's contract: all pairs by their common shingles, and what can be reached by links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a
)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, w.doc_id = m AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
"""
