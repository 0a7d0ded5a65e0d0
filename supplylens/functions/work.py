"""Functions of the work log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from supplylens.functions.text import col

# States of a work item and the states that may follow.
TRANSITIONS = {
    "pending": ("claimed", "failed"),
    "claimed": ("running", "failed", "pending"),
    "running": ("succeeded", "failed", "pending"),
    "failed": ("pending", "dead_letter"),
    "dead_letter": ("pending",),
}


def is_valid_transition(a, b) -> Column:
    """Whether a work item may go from state ``a`` to state ``b``; unknown states may go nowhere."""
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.array_contains(allowed[col(a)], col(b)), F.lit(False))


def backoff_seconds(attempt, base: float, most: float, jitter: float = 0.0, seed: int | None = None) -> Column:
    """base * 2 ** (attempt - 1), at most ``most``, plus up to ``jitter`` of it where asked for (at most 0.25)."""
    wait = F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(F.greatest(col(attempt), F.lit(1)) - 1, F.lit(60))))
    return wait * (1 + F.rand(seed) * min(jitter, 0.25)) if jitter else wait
