"""Rejection inference with its error report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlens.operators import errors as E


def rejection_report(long: DataFrame, targets: DataFrame, ident: str, epsilon: float, strict: bool = True) -> DataFrame:
    """Fenced-median error per metric over the accepted particles."""
    clean = long.where(F.col("value").isNotNull())
    accepted = E.rejection(clean, targets, [ident], epsilon, strict).where("accepted").select(ident)
    return E.fenced_metric_errors(clean.join(accepted, ident, "left_semi"), targets, [])
