"""Which columns may enter a model: an ordered policy over the registry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes that no view admits (fixed values).
FORBIDDEN = ("TARGET", "POST_RESOLUTION_LEAKAGE", "INDEX_OR_ID")


@dataclass(frozen=True)
class Policy:
    """One view of the columns."""

    hard: tuple[str, ...] = ()
    conditional: tuple[str, ...] = ()
    fairness: tuple[str, ...] = ()
    contextual: tuple[str, ...] = ()
    allow: tuple[str, ...] = ("BEHAVIORAL",)
    families: tuple[str, ...] | None = None
    finalized_only: bool = False
    include_conditional: bool = False
    include_fairness: bool = False
    include_contextual: bool = True


def judge(registry: DataFrame, policy: Policy) -> DataFrame:
    """The registry with reason: the first ground that refuses a column, null if it is admitted.

    registry: (feature, availability, rail, bank_finalized, ...). A null availability is refused as
    outside the view.
    """
    f, cls = F.col("feature"), F.coalesce("availability", F.lit("UNKNOWN_REVIEW"))
    held = f.isin(*policy.conditional) if policy.conditional else F.lit(False)
    grounds = [
        ("HARD_QUARANTINE", f.isin(*policy.hard) if policy.hard else F.lit(False)),
        ("FORBIDDEN_CLASS", cls.isin(*FORBIDDEN)),
        ("CONDITIONAL_QUARANTINE", held & F.lit(not policy.include_conditional)),
        ("FAIRNESS_EXCLUDED", f.isin(*policy.fairness) if policy.fairness and not policy.include_fairness else F.lit(False)),
        ("DEMOGRAPHICS_DISABLED", f.isin(*policy.contextual) if policy.contextual and not policy.include_contextual else F.lit(False)),
        ("CLASS_NOT_IN_VIEW", ~cls.isin(*policy.allow) & ~(held & F.lit(policy.include_conditional))),
        ("NOT_BANK_FINALIZED", F.lit(policy.finalized_only) & ~F.coalesce("bank_finalized", F.lit(False))),
        ("FAMILY_NOT_IN_VIEW", ~F.col("rail").isin(*policy.families) if policy.families is not None else F.lit(False)),
    ]
    reason = F.lit(None).cast("string")
    for name, test in reversed(grounds):
        reason = F.when(test, name).otherwise(reason)
    return registry.withColumn("reason", reason)


def assert_clean(columns: list[str], policy: Policy) -> None:
    """Raises if a column of a frame is on one of the policy's lists."""
    bad = sorted(set(columns) & {*policy.hard, *policy.conditional, *policy.fairness})
    if bad:
        raise ValueError(f"quarantined columns: {', '.join(bad)}")
