"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the mix in proportion to its weight, at most
``max_epochs`` times its own size. What a capped source cannot take is
shared among the others in proportion to their weights, until no
target is above its cap. A target of e times a source's size is then taken as floor(e)
whole repetitions of each of its documents, plus a seeded draw of documents
for the fraction; the document at the edge of the draw gives only
its first words, so that the words taken meet the target.

The draw does not order a source in one task: documents are hashed
into 16 ** SLOT_DIGITS slots, slots are summed per source, and only the slot in which the
target falls is ordered row by row. The hash is an MD5, so any SQL engine can draw the same documents.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supplylens.llm.common import NOT_WS, WS, cut, join_groups

#: Leading hexadecimal digits of the hash that make a slot.
SLOT_DIGITS = 3


def row_hash(seed: int, ident: str, text: str):
    """The seeded hash that orders the rows of a source in its draw."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(ident).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit(""))))


def word_count(text):
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_WS + "+")), F.lit(0)).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, max_epochs: float) -> list[float]:
    """Targets for one list of sources (see the module's text).

    Each round gives every open source its share of what is left; sources whose share reaches
    their cap are closed at the cap. At least one closes in each round but the last.
    """
    targets = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if sizes[i] > 0 and weights[i] > 0]
    left = float(total)
    while open_ and left > 0:
        whole = math.fsum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / whole > max_epochs * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / whole
            break
        for i in full:
            targets[i] = float(max_epochs * sizes[i])
        left = total - math.fsum(targets)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def source_targets(sizes: DataFrame, weights: Sequence[float], total_share: float, max_epochs: float) -> DataFrame:
    """Targets per source from (source, source_size, n_docs).

    Sources are ranked by code point with null last and get ``weights`` in turn. The same rounds
    as in :func:`water_fill` run as aggregations over the table of sources, so the number of sources isn't bounded
    by the driver; the loop only reads two totals a round.
    """
    spark = sizes.sparkSession
    ranked = sizes.withColumn("__null", F.col("source").isNull()).select("*", F.encode("source", "UTF-8").alias("__order"))
    # Rank in two steps, so that no task orders all sources: range partitions, then offsets of partitions.
    ranked = cut(ranked.repartitionByRange("__null", "__order").sortWithinPartitions("__null", "__order").withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = sorted((r[0], r[1]) for r in ranked.groupBy(part).count().collect())  # one row a partition
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    n_weights = len(weights)
    starts = F.create_map(*[F.lit(x) for p, b in offsets for x in (p, b)]) if offsets else None
    pos = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + (starts[part] if offsets else F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (pos % n_weights + 1).cast("int"))
    open_ = cut(ranked.select("source", "source_size", "n_docs", weight.alias("weight")))
    total = (open_.agg(F.sum("source_size")).first()[0] or 0) * total_share
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    state = open_.withColumn("target", F.when((F.col("source_size") <= 0) | (F.col("weight") <= 0), F.lit(0.0)))
    while True:
        row = state.agg(
            F.sum("target").alias("taken"), F.sum(F.when(F.col("target").isNull(), F.col("weight"))).alias("w"), F.count(F.when(F.col("target").isNull(), 1)).alias("n")
        ).first()
        if not row["n"]:
            break
        left = total - (row["taken"] or 0.0)
        share = F.lit(left) * F.col("weight") / F.lit(row["w"])
        waits = F.col("target").isNull()
        if state.filter(waits & (share > cap)).isEmpty():
            state = state.withColumn("target", F.coalesce("target", share))
            break
        state = cut(state.withColumn("target", F.when(waits & (share > cap), cap).otherwise(F.col("target"))))
    return state.select("source", "source_size", "n_docs", "weight", "target")


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    total_share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: __row, doc_id, source, size, source_size, target, whole, part_words, taken.

    ``whole`` is the number of full copies in the mix and ``part_words`` how many of the document's
    first words come once more (its whole size where it was drawn). Rows are told apart by ``__row``,
    a seeded hash of id and text, so reruns agree whatever the partitioning; rows equal in both
    are exchangeable. Null texts and texts of white space have size 0 and
    are never drawn. A null source is a source of its own. ``max_epochs`` must be at least 1
    for whole copies to be possible; below 1 only the draw takes place. An empty table gives an empty plan.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        row_hash(seed, id_col, text_col).alias("__row"),
    )
    rows = cut(rows.withColumn("__key", F.to_json(F.struct("source"))))
    slot = F.substring("__row", 1, SLOT_DIGITS)
    slots = cut(rows.groupBy("__key", slot.alias("slot")).agg(F.sum("size").alias("slot_size"), F.count("*").alias("n"), F.first("source").alias("source")))
    sizes = slots.groupBy("__key").agg(F.first("source").alias("source"), F.sum("slot_size").alias("source_size"), F.sum("n").alias("n_docs")).drop("__key")
    targets = source_targets(sizes, weights, total_share, max_epochs).withColumn("__key", F.to_json(F.struct("source")))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # A target a rounding error below a whole number of epochs counts as that number.
    whole = F.floor(epochs + F.lit(1e-9))
    targets = targets.withColumn("whole", whole.cast("long"))
    targets = cut(targets.withColumn("draw", F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("source_size"))).cast("long")).drop("source"))
    total = rows.count()
    # Where the draw of each source ends: the slot in which the running sum passes it (16 ** SLOT_DIGITS rows a source at most).
    run = F.sum("slot_size").over(Window.partitionBy("__key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    edges = slots.select("__key", "slot", "slot_size", F.coalesce(run, F.lit(0)).alias("before"))
    edges = edges.join(targets.select("__key", "draw"), "__key").filter((F.col("before") < F.col("draw")) & (F.col("before") + F.col("slot_size") >= F.col("draw")))
    edges = edges.select("__key", F.col("slot").alias("edge_slot"), "before")
    per_source = cut(targets.join(edges, "__key", "left"))
    joined = join_groups(rows.withColumn("slot", slot), per_source, ["__key"], "n_docs", total)
    at_edge = F.col("slot") == F.col("edge_slot")
    inner = joined.filter(F.coalesce(~at_edge, F.lit(True))).withColumn(
        "part_words", F.when(F.col("slot") < F.col("edge_slot"), F.col("size")).otherwise(F.lit(0).cast("long"))
    )
    order = Window.partitionBy("__key").orderBy("__row", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = joined.filter(at_edge).withColumn("__left", F.col("draw") - F.col("before") - F.coalesce(F.sum("size").over(order), F.lit(0)))
    edge = edge.withColumn("part_words", F.greatest(F.lit(0).cast("long"), F.least("size", "__left"))).drop("__left")
    return inner.unionByName(edge).select(
        "__row", "doc_id", "source", "size", "source_size", "target", "whole", "part_words", (F.col("whole") * F.col("size") + F.col("part_words")).alias("taken")
    )


def first_words(text, n):
    """The first ``n`` words of ``text`` with the white space between them, and all of it when it has no more."""
    words = F.regexp_extract_all(text, F.lit(f"({WS}*{NOT_WS}+)"), F.lit(1))
    return F.array_join(F.slice(words, F.lit(1), F.greatest(n.cast("int"), F.lit(0))), "")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **options) -> DataFrame:
    """The mixed rows themselves: ``docs``' columns, a row for each repetition, the last one cut where the draw ends.

    Rows with a null or empty text have nothing to take and do not come; a null source is a source of its own, and a null id an id like any other; rows
    that repeat id and text are taken each on its own; an empty table gives no rows. Extra columns are repeated unchanged. A cut copy keeps whole words; an ``n_chars`` column is set to its
    new length.
    """
    # A key without nulls lets the numbering and the join share one shuffle of the rows.
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    plan = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    plan = plan.filter((F.col("whole") > 0) | (F.col("part_words") > 0)).groupBy(F.col("__row").alias("hash"), key("doc_id").alias("ident")).agg(
        F.collect_list(F.struct("whole", "part_words", "size")).alias("plans")
    )
    # Rows travel as one struct, so no column name can clash. Those equal in id and text share a list of plans; each takes one of them.
    rows = docs.select(F.struct("*").alias("row"), row_hash(seed, id_col, text_col).alias("hash"), key(id_col).alias("ident"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("hash", "ident").orderBy(F.lit(1))))
    joined = rows.join(plan, ["hash", "ident"])
    joined = joined.withColumn("plan", F.get("plans", F.col("n") - 1)).filter(F.col("plan").isNotNull())
    all_words = F.lit(-1).cast("long")
    copies = F.concat(
        F.array_repeat(all_words, F.col("plan.whole").cast("int")),
        F.when(F.col("plan.part_words") >= F.col("plan.size"), F.array(all_words))
        .when(F.col("plan.part_words") > 0, F.array(F.col("plan.part_words")))
        .otherwise(F.array().cast("array<bigint>")),
    )
    out = joined.select("row", F.explode(copies).alias("words"))
    short = first_words(F.col(f"row.{text_col}"), F.col("words"))
    out = out.withColumn("short", F.when(F.col("words") >= 0, short))
    fields = []
    for c in docs.columns:
        own = F.col("row").getField(c)
        new = {text_col: F.col("short"), "n_chars": F.char_length("short").cast(docs.schema[c].dataType) if c == "n_chars" else None}.get(c)
        fields.append((own if new is None else F.when(F.col("words") >= 0, new).otherwise(own)).alias(c))
    return out.select(*fields)


#: op4's contract with the production parameters. Sources that reach their cap are those first by size over weight.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(concat_ws(':', '17', coalesce(CAST(doc_id AS VARCHAR), 'null'), coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s
), c AS (
  SELECT *, 2::DOUBLE * source_size AS cap, coalesce(sum(2::DOUBLE * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM r WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST)
), f AS (
  SELECT *, (total - before) * weight / open_weight > cap OR source_size = 0 AS closed FROM c
), t AS (
  SELECT source, source_size, CASE WHEN closed THEN cap ELSE (total - coalesce(sum(cap) FILTER (closed) OVER (), 0)) * weight / sum(weight) FILTER (NOT closed) OVER () END AS target FROM f
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-9) AS BIGINT) ELSE 0 END AS whole FROM t
), n AS (
  SELECT d.doc_id, size, source_size, target, whole, greatest(0, CAST(round(target - whole * source_size) AS BIGINT)) AS draw, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, draw - before)) AS BIGINT) AS taken FROM n
"""
