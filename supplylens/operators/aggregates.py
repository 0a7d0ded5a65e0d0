"""Roll-ups, reports and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplylens.functions.text import SEVERITIES

# Upper bounds in seconds of latency buckets.
LATENCY_EDGES = (0.1, 0.5, 1, 5, 10, 30, 60, 300, 600, 1800, 3600)


def severity_rollup(findings: DataFrame, key: str = "scan_id") -> DataFrame:
    """Counts by severity, in any case; unknown ones only count in the total."""
    of = lambda s: F.count_if(F.lower("severity") == s).alias(f"n_{s}")
    return findings.groupBy(key).agg(F.count("*").alias("total"), *[of(s) for s in SEVERITIES])


def count_by_status(items: DataFrame) -> DataFrame:
    return items.groupBy("queue", "status").agg(F.count("*").alias("n"))


def queue_overview(items: DataFrame, queues: DataFrame) -> DataFrame:
    """Every queue with its settings and a map of status to count; empty queues have an empty map."""
    counts = count_by_status(items).groupBy("queue").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("counts"), F.sum("n").alias("total"))
    out = queues.join(counts, "queue", "left")
    return out.withColumn("counts", F.coalesce("counts", F.create_map().cast("map<string,bigint>"))).withColumn("total", F.coalesce("total", F.lit(0).cast("long")))


def accuracy_report(ours: DataFrame, theirs: DataFrame, keys: Sequence[str] = ("vuln_id", "package_name")) -> DataFrame:
    """One row: pairs in both, only ours, only theirs, recall, precision (null without pairs) and pairs of theirs that we call not affected.

    ``ours`` has a boolean ``affected``; only affected pairs count as found.
    """
    a = ours.groupBy(*keys).agg(F.bool_or("affected").alias("yes"))
    b = theirs.select(*keys).distinct().withColumn("__b", F.lit(True))
    both = a.join(b, list(keys), "full_outer")
    yes, told = F.coalesce("yes", F.lit(False)), F.col("__b").isNotNull()
    n = both.agg(
        F.count_if(yes & told).alias("both"),
        F.count_if(yes & ~told).alias("only_ours"),
        F.count_if(~yes & told).alias("only_theirs"),
        F.count_if(told & F.col("yes").isNotNull() & ~yes).alias("we_say_not_affected"),
    )
    part = lambda x: F.when(F.col("both") + F.col(x) > 0, F.col("both") / (F.col("both") + F.col(x)))
    return n.withColumn("recall", part("only_theirs")).withColumn("precision", part("only_ours"))


def miss_reasons(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Why pairs of theirs are missing: the vulnerability is matched on another package, or not at all."""
    keys = ["vuln_id", "package_name"]
    missed = theirs.select(*keys).distinct().join(ours.select(*keys).distinct(), keys, "left_anti")
    seen = ours.select("vuln_id").distinct().withColumn("__seen", F.lit(True))
    reason = F.when(F.col("__seen").isNotNull(), "cve-matched-different-pkg").otherwise("cve-not-found")
    return missed.join(seen, "vuln_id", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def advisory_summary(adv: DataFrame) -> DataFrame:
    """Per package: detected, not affected, total, and counts by confidence."""
    return adv.groupBy("source_package").agg(
        F.count_if(F.col("status") == "detected").alias("detected"),
        F.count_if(F.col("status") == "not-affected").alias("not_affected"),
        F.count("*").alias("total"),
        *[F.count_if(F.col("confidence") == c).alias(f"confidence_{c}") for c in ("high", "medium", "low")],
    )


def latency_histogram(df: DataFrame, keys: Sequence[str], value: str, edges: Sequence[float] = LATENCY_EDGES) -> DataFrame:
    """Cumulative buckets (le, n), with ``+Inf`` as null, and count and sum of each key; nulls aren't observed."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.array(*[F.struct(F.lit(float(e)).alias("le"), F.count_if(F.col(value) <= e).alias("n")) for e in edges], F.struct(F.lit(None).cast("double").alias("le"), F.count("*").alias("n"))).alias("b"),
        F.sum(value).alias("sum"),
    )
    return counts.select(*keys, F.explode("b").alias("b"), "sum").select(*keys, "b.le", "b.n", "sum")


def latency_quantiles(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float] = (0.5, 0.9, 0.99), exact: bool = False) -> DataFrame:
    """Quantiles of each key: sketches of bounded size, or exact ones, which hold all different values of a key."""
    q = F.percentile if exact else F.approx_percentile
    return df.groupBy(*keys).agg(*[q(value, F.lit(p)).alias(f"p{round(p * 100)}") for p in points])


def queue_gauges(items: DataFrame, now) -> DataFrame:
    """Per queue: pending, in work, dead letters and age in seconds of the oldest pending item (0 without any)."""
    age = F.unix_timestamp(F.lit(now)) - F.unix_timestamp(F.min(F.when(F.col("status") == "pending", F.col("created_at"))))
    return items.groupBy("queue").agg(
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status").isin("claimed", "running")).alias("in_progress"),
        F.count_if(F.col("status") == "dead_letter").alias("dead_letters"),
        F.coalesce(age, F.lit(0)).cast("long").alias("oldest_pending_s"),
    )


def probe_metrics(log: DataFrame, edges: Sequence[float] = (1, 5, 10, 30, 60)) -> DataFrame:
    """Per image: successes, failures, last success, size and layers of the latest success, whether it is up, cumulative duration buckets."""
    ok = F.col("success")
    return log.groupBy("image").agg(
        F.count_if(ok).alias("successes"),
        F.count_if(~ok).alias("failures"),
        F.max(F.when(ok, F.col("ts"))).alias("last_success"),
        F.max_by("size", F.when(ok, F.struct("ts", "probe_id"))).alias("last_size"),
        F.max_by("layers", F.when(ok, F.struct("ts", "probe_id"))).alias("last_layers"),
        F.max_by("success", F.struct("ts", "probe_id")).alias("up"),
        *[F.count_if(F.col("duration") <= e).alias(f"le_{e}") for e in edges],
    )


def assessment_accuracy(assessed: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row: cases, right, accuracy; the false negatives: labelled affected, assessed not affected)."""
    rows = labels.select("case_id", F.col("status").alias("expected")).join(assessed.select("case_id", "status"), "case_id")
    right = F.count_if(F.col("status") == F.col("expected"))
    report = rows.agg(F.count("*").alias("cases"), right.alias("right")).withColumn("accuracy", F.when(F.col("cases") > 0, F.col("right") / F.col("cases")))
    return report, rows.filter("expected = 'affected' and status = 'not-affected'").select("case_id")
