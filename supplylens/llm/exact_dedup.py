"""Exact deduplication with an extendible-hash index on shared files.

The index maps the 64-bit hash of a normalised text to a chain of entries, one
for each different text. A directory over the leading bits of the hash points at
buckets; while a bucket holds more entries than its capacity the directory
doubles and the bucket is split on its next bit. Owner tasks each write a
contiguous range of the key space. Texts that share a hash are told apart by
their bytes: they meet in an aggregation keyed by hash *and* text, which
combines copies before the shuffle, so a text with billions of copies travels once per
input partition.

A document finds its entry through the index: the directory gives the bucket of its hash, the bucket the chain, and where a chain has more than
one entry, its text is compared with theirs byte by byte. Everything here is DataFrame code; no Python runs on executors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplylens.llm.common import WS, cut, join_groups, shared_table


def normalise(text):
    """Null becomes empty and every run of ASCII white space one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS + "+", " ")


@dataclass
class ExtendibleIndex:
    """``entries``: bucket, local_depth, key, chain_pos, chain_length, norm (null in chains of one), text_sha256, n_bytes, keep_id, group_size.

    ``directory``: slot (leading ``start_depth`` bits), buckets (array of local_depth and prefix: one, but for a slot whose bucket was split). Both are
    Parquet tables in the shared folder.
    """

    entries: DataFrame
    directory: DataFrame
    n_documents: int
    start_depth: int
    global_depth: int


def _prefix(depth) -> Column:
    """The leading ``depth`` bits of ``key``; ``depth`` is a number or a column."""
    if isinstance(depth, int):
        return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned("key", 64 - depth)
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.col("key"), (64 - depth).cast("int")))


def split_buckets(keys: DataFrame, capacity: int, start_depth: int, max_depth: int = 60) -> tuple[DataFrame, int]:
    """Buckets (prefix, local_depth, n_entries) of ``keys`` (column ``key``), doubled until none is over capacity.

    Chains of one hash value cannot be split; a bucket that is still
    over capacity at ``max_depth`` stays as it is, with all its entries.
    """
    depth = start_depth
    counts = keys.groupBy(_prefix(depth).alias("prefix")).agg(F.count("*").alias("n_entries"))
    counts = cut(counts.withColumn("local_depth", F.lit(depth)))
    leaves = counts.filter(F.col("n_entries") <= capacity)
    over = counts.filter(F.col("n_entries") > capacity)
    while depth < max_depth and not over.isEmpty():
        parents = over.select(F.col("prefix").alias("parent"))
        depth += 1
        children = (
            keys.withColumn("parent", _prefix(depth - 1))
            .join(parents, "parent", "left_semi")
            .groupBy(_prefix(depth).alias("prefix"))
            .agg(F.count("*").alias("n_entries"))
        )
        children = cut(children.withColumn("local_depth", F.lit(depth)))
        leaves = leaves.unionByName(children.filter(F.col("n_entries") <= capacity))
        over = children.filter(F.col("n_entries") > capacity)
    return leaves.unionByName(over), depth


def _route(keys: DataFrame, index_directory: DataFrame, start_depth: int) -> DataFrame:
    """Add local_depth and bucket to rows with ``key``: its slot's buckets, of which the one fits whose prefix the key has. Rows without one go."""
    total = max(1, keys.count())
    by_slot = keys.withColumn("slot", _prefix(start_depth))
    sizes = cut(by_slot.groupBy("slot").agg(F.count("*").alias("in_slot")))
    slots = index_directory.join(sizes, "slot")
    routed = join_groups(by_slot, slots, ["slot"], "in_slot", total)
    fits = F.filter("buckets", lambda b: _prefix(b["local_depth"]) == b["prefix"])
    return routed.withColumn("at", F.get(fits, F.lit(0))).filter("at is not null").withColumns({"local_depth": F.col("at.local_depth"), "bucket": F.col("at.prefix")}).drop("slot", "in_slot", "buckets", "at")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, hash_of: Callable[[str], Column] = F.xxhash64) -> ExtendibleIndex:
    """Index every row of ``docs`` by its normalised text. ``hash_of`` gives the 64-bit key of a column of texts."""
    base = docs.select(F.col(id_col).alias("doc_id"), normalise(F.col(text_col)).alias("norm")).withColumn("key", hash_of("norm").cast("long"))
    # One row per different text: equal hashes meet here and are compared by bytes.
    texts = base.groupBy("key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    sha = F.unhex(F.sha2("norm", 256)).alias("sha")
    texts = cut(texts.select("key", sha, F.octet_length("norm").cast("long").alias("n_bytes"), "keep_id", "group_size"))
    chains = cut(texts.groupBy("key").agg(F.count("*").alias("chain_length")).filter("chain_length > 1"))
    if chains.isEmpty():
        texts = texts.withColumns({"chain_length": F.lit(1).cast("long"), "norm": F.lit(None).cast("string")})
    else:
        # Only chains of several keep their texts.
        norms = base.join(chains, "key", "left_semi").groupBy("key", "norm").agg(F.lit(1)).select("key", sha, "norm")
        texts = cut(texts.join(norms, ["key", "sha"], "left").join(chains, "key", "left").withColumn("chain_length", F.coalesce("chain_length", F.lit(1).cast("long"))))
    n_texts, n = texts.agg(F.count("*"), F.coalesce(F.sum("group_size"), F.lit(0))).first()
    start = max(0, (max(1, n_texts) // capacity).bit_length())
    buckets, depth = split_buckets(texts.select("key"), capacity, start)
    bucket = F.struct("local_depth", "prefix")
    slot = F.when(F.col("local_depth") == start, F.col("prefix")).otherwise(F.call_function("shiftrightunsigned", F.col("prefix"), (F.col("local_depth") - start).cast("int")))
    # A slot has more than one bucket only where hashes crowd, and never more than the texts of one slot fill.
    directory = shared_table(buckets.groupBy(slot.alias("slot")).agg(F.collect_list(bucket).alias("buckets")), "dedup-directory")
    placed = _route(texts, directory, start)
    # Owner tasks: each has a range of keys and orders the chain of every key.
    chain = Window.partitionBy("key").orderBy("sha")
    entries = shared_table(placed.repartitionByRange("key").withColumn("chain_pos", F.row_number().over(chain)), "dedup-entries")
    return ExtendibleIndex(entries, directory, n, start, depth)


def look_up(docs: DataFrame, index: ExtendibleIndex, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """doc_id and the entry (keep_id, group_size, sha) of every row of ``docs`` that the index knows: texts of colliding keys are compared byte by byte, others by SHA-256.

    Null texts count as empty; rows that the index doesn't know are left out.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), normalise(F.col(text_col)).alias("norm")).withColumn("key", hash_of("norm").cast("long"))
    entry = ["keep_id", "group_size", "sha"]
    keys = cut(base.select("doc_id", "key", F.unhex(F.sha2("norm", 256)).alias("__sha")))
    routed = _route(keys, index.directory, index.start_depth)
    single = index.entries.filter("chain_length = 1").select("bucket", "local_depth", "key", *entry)
    found = join_groups(routed, single, ["bucket", "local_depth", "key"], "group_size", max(1, index.n_documents)).filter("sha = __sha").select("doc_id", *entry)
    chains = index.entries.filter("chain_length > 1")
    if chains.isEmpty():
        return found
    # The texts of colliding keys, each held against the entries of its chain.
    crowded = _route(cut(base.join(chains.select("key").distinct(), "key", "left_semi")), index.directory, index.start_depth)
    ends = chains.select("bucket", "local_depth", "key", "norm", *entry)
    return found.unionByName(join_groups(crowded, ends, ["bucket", "local_depth", "key", "norm"], "group_size", max(1, index.n_documents)).select("doc_id", *entry))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, hash_of: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    * null text counts as empty, and empty texts are copies of one another;
    * of equal texts the smallest id stays; a null id only stays where all ids of
      its group are null; rows that repeat an id and its text are copies that are
      all marked as kept, since the id cannot tell them apart;
    * texts of any length are read whole; an empty table gives an empty result; other columns are never read, so
      their names cannot clash.
    """
    found = look_up(docs, build_index(docs, id_col, text_col, capacity, hash_of), id_col, text_col, hash_of)
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, hash_of: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """The rows of ``docs`` that stay, one for each different text, with all their columns.

    Null counts as empty, and of all empty texts one row stays; of equal texts the smallest id stays, a null id only where its whole group has none;
    rows that repeat the kept id and text are reduced to one; an empty table stays empty. Rows travel as one struct, so no column name can clash.
    """
    index = build_index(docs, id_col, text_col, capacity, hash_of)
    # A key without nulls lets the semi-join and the last step share one shuffle of the rows.
    ident = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    norm = normalise(F.col(text_col))
    rows = docs.select(F.struct("*").alias("row"), ident(id_col).alias("ident"), norm.alias("__norm")).withColumn("key", hash_of("__norm").cast("long"))
    chains = not index.entries.filter("chain_length > 1").isEmpty()
    # Where a key has several texts, those that stay are told apart by their bytes as well.
    exactly = F.when(F.col("chain_length") > 1, F.col("norm")) if chains else F.lit(None).cast("string")
    kept = index.entries.select("key", ident("keep_id").alias("ident"), F.coalesce(exactly, F.lit("")).alias("text"))
    if chains:
        crowded = index.entries.filter("chain_length > 1").select("key", F.lit(True).alias("crowded")).distinct()
        rows = rows.join(crowded, "key", "left").withColumn("text", F.when(F.col("crowded"), F.col("__norm")).otherwise(F.lit("")))
    else:
        rows = rows.withColumn("text", F.lit(""))
    on = ["key", "ident", "text"]
    return rows.drop("__norm").join(kept, on, "left_semi").dropDuplicates(on).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
