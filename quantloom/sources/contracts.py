"""Data contract of the factor-score table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Required columns and the dates that must not pass the decision date.
REQUIRED = (
    "as_of_date", "security_id", "sector_id", "composite_score", "value_score", "growth_score",
    "profitability_score", "momentum_score", "revisions_score", "data_version",
)
AVAILABILITY = ("fundamentals_available_at", "estimates_available_at")


def validate_factor_scores(scores: DataFrame, as_of: str) -> DataFrame:
    """``(check, violations)`` for every rule, zero when it holds. Missing columns are known
    without a job, and then nothing else is checked."""
    missing = [c for c in REQUIRED if c not in scores.columns]
    if missing:
        return scores.sparkSession.createDataFrame(
            [(f"missing columns: {missing}", len(missing))], "check string, violations long"
        )
    day = F.lit(as_of).cast("date")
    rules = {"sector_id is null": F.col("sector_id").isNull()}
    for c in REQUIRED:
        if c.endswith("_score"):
            rules[f"{c} outside [0, 100]"] = (F.col(c) < 0) | (F.col(c) > 100)
    for c in AVAILABILITY:
        if c in scores.columns:
            rules[f"{c} > as_of_date (look-ahead)"] = F.col(c) > day
    rules["as_of_date in the future"] = F.col("as_of_date") > day
    counted = scores.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    one = counted.unpivot([], list(rules), "check", "violations")
    keys = scores.groupBy("as_of_date", "security_id").agg(F.count(F.lit(1)).alias("_n"))
    duplicates = keys.where("_n > 1").agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit("duplicate primary keys (as_of_date, security_id)").alias("check"), "violations"
    )
    return one.unionByName(duplicates)
