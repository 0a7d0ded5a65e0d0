"""Table merges as pure functions of target and source: ``merge(target, source) -> new target``.

Applied twice they give what they gave once (but for counters), so a batch that is replayed does no harm; they work
the same inside ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Statuses that a review may set.
REVIEW_STATUSES = ("affected", "not-affected", "fixed", "under-review", "detected")


def _without(rows: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys none of the others has; a null key equals a null key, so that replays find what they added."""
    there = others.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return rows.join(there, on, "left_anti")


def merge_lww(target: DataFrame, source: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The row with the largest ``seq`` of each key wins; the source wins ties, and nulls lose. Of rows of one side that tie, the first by their values wins."""
    both = target.withColumn("__side", F.lit(0)).unionByName(source.select(*target.columns).withColumn("__side", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(seq), F.desc("__side"))
    best = both.withColumn("__rank", F.rank().over(w)).filter("__rank = 1").drop("__rank", "__side")
    # Only rows that tie are compared by their values.
    many = Window.partitionBy(*keys)
    best = best.withColumn("__n", F.count("*").over(many))
    tie = F.when(F.col("__n") > 1, F.to_json(F.struct(*target.columns)))
    return best.withColumn("__rank", F.row_number().over(many.orderBy(tie))).filter("__rank = 1").drop("__rank", "__n")


def replace_by_source(target: DataFrame, source: DataFrame, vuln: str = "vuln_id", src: str = "source") -> DataFrame:
    """All rows of each (vulnerability, source) in the source replace those of the target; other sources stay."""
    return _without(target, source, [vuln, src]).unionByName(source.select(*target.columns))


def merge_coalesce(target: DataFrame, source: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """In ``cols`` new values win unless they are null; rows of the source with a new key come whole, with all their columns."""
    new = source.select(*keys, *[F.col(c).alias(f"__{c}") for c in target.columns if c not in keys], F.lit(True).alias("__new"))
    out = target.withColumn("__old", F.lit(True)).join(new, list(keys), "full_outer")
    # What the source says counts for the columns that are merged, and for rows that only it has.
    value = lambda c: F.coalesce(f"__{c}", c) if c in cols else F.when(F.col("__old").isNull(), F.col(f"__{c}")).otherwise(F.col(c))
    return out.select(*[F.col(c) if c in keys else value(c).alias(c) for c in target.columns])


def merge_unreviewed(target: DataFrame, source: DataFrame, keys: Sequence[str] = ("source_package", "vuln_id"), reviewed: str = "reviewed_at") -> DataFrame:
    """The source replaces rows, except those that bear a review; new rows are added."""
    guarded = target.filter(F.col(reviewed).isNotNull())
    fresh = _without(source.select(*target.columns), guarded, keys)
    return _without(target, fresh, keys).unionByName(fresh)


def insert_ignore(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the source whose key is new, one for each key (of several the first by their values); nothing is ever removed or changed."""
    new = _without(source.select(*target.columns), target, keys)
    rest = [c for c in target.columns if c not in keys]
    if not rest:
        return target.unionByName(new.distinct())
    first = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__first"))
    return target.unionByName(first.select(*keys, "__first.*").select(*target.columns))


insert_absent = insert_ignore


def count_usage(mappings: DataFrame, used: DataFrame, key: str = "rpm_name") -> DataFrame:
    """Add the number of uses in ``used`` to ``usage_count``."""
    n = used.groupBy(key).agg(F.count("*").alias("__n"))
    out = mappings.join(n, key, "left").withColumn("usage_count", F.col("usage_count") + F.coalesce("__n", F.lit(0).cast("long")))
    return out.select(*mappings.columns)


def merge_checkpoint(target: DataFrame, source: DataFrame, key: str = "source") -> DataFrame:
    """Progress adds ``items_synced`` and clears the error; a row with an error only sets that and keeps value and counter."""
    new = source.select(key, *[F.col(c).alias(f"__{c}") for c in ("checkpoint_value", "items_synced", "error_message")], F.lit(True).alias("__new"))
    failed = F.col("__error_message").isNotNull()
    out = target.join(new, key, "full_outer")
    return out.select(
        key,
        F.when(F.col("__new").isNull() | failed, F.col("checkpoint_value")).otherwise(F.col("__checkpoint_value")).alias("checkpoint_value"),
        (F.coalesce("items_synced", F.lit(0)) + F.when(F.coalesce(failed, F.lit(False)), F.lit(0)).otherwise(F.coalesce("__items_synced", F.lit(0)))).alias("items_synced"),
        F.when(F.col("__new").isNull(), F.col("error_message")).otherwise(F.col("__error_message")).alias("error_message"),
    ).select(*target.columns)


def apply_reviews(target: DataFrame, decisions: DataFrame, keys: Sequence[str] = ("source_package", "vuln_id")) -> DataFrame:
    """Set status, ``reviewed_at`` and ``reviewed_by`` from valid decisions (one for each key, the latest); others change nothing and are listed by :func:`invalid_reviews`."""
    w = Window.partitionBy(*keys).orderBy(F.desc("reviewed_at"), "status")
    valid = decisions.filter(F.col("status").isin(*REVIEW_STATUSES) & (F.col("reviewed_by") != "")).withColumn("__rank", F.row_number().over(w)).filter("__rank = 1")
    valid = valid.select(*keys, *[F.col(c).alias(f"__{c}") for c in ("status", "reviewed_at", "reviewed_by")])
    out = target.join(valid, list(keys), "left")
    hit = F.col("__status").isNotNull()
    for c in ("status", "reviewed_at", "reviewed_by"):
        out = out.withColumn(c, F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)))
    return out.select(*target.columns)


def invalid_reviews(decisions: DataFrame) -> DataFrame:
    """The decisions that :func:`apply_reviews` takes nothing from, with a ``reason``."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    reason = F.when(blank("status") | blank("reviewed_by"), "status and reviewer required").when(~F.col("status").isin(*REVIEW_STATUSES), "invalid status")
    return decisions.withColumn("reason", reason).filter("reason is not null")


def review_mappings(mappings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Set ``reviewed`` and ``updated_at`` of the mappings from decisions (rpm_name in any case, reviewed, updated_at), the latest for each name; names without a mapping change nothing."""
    last = decisions.groupBy(F.lower("rpm_name").alias("rpm_name")).agg(F.max(F.struct("updated_at", "reviewed")).alias("__d"))
    out = mappings.join(last, "rpm_name", "left")
    for c in ("reviewed", "updated_at"):
        out = out.withColumn(c, F.when(F.col("__d").isNotNull(), F.col(f"__d.{c}")).otherwise(F.col(c)))
    return out.select(*mappings.columns)


def retain(items: DataFrame, now, days: int = 7, purge_dead: bool = False) -> DataFrame:
    """Drop finished items older than ``days``, and dead letters where asked for."""
    old = F.col("status").isin("succeeded", "failed") & (F.col("updated_at") < F.lit(now) - F.make_dt_interval(F.lit(days)))
    gone = old | (F.col("status") == "dead_letter") if purge_dead else old
    return items.filter(~F.coalesce(gone, F.lit(False)))


def queue_inconsistencies(items: DataFrame, pending: DataFrame, leases: DataFrame) -> DataFrame:
    """(queue, key, problem): pending items missing from the pending set and the reverse; leases of items that aren't in work."""
    keys = ["queue", "key"]
    waiting = items.filter("status = 'pending'").select(*keys)
    working = items.filter("status in ('claimed', 'running')").select(*keys)
    found = lambda df, what: df.select(*keys).distinct().withColumn("problem", F.lit(what))
    return (
        found(waiting.join(pending, keys, "left_anti"), "not in pending set")
        .unionByName(found(pending.join(waiting, keys, "left_anti"), "not pending"))
        .unionByName(found(leases.join(working, keys, "left_anti"), "lease without work"))
    )
