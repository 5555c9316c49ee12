"""Scoring of prediction tables as a job that can be carried on: partial sums per batch in a folder, and metrics merged from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from streamloom.columns import col
from streamloom.operators.evaluate import first_batches, loss_sums, merge_metrics, metrics_table, with_losses
from streamloom.operators.select import single_stream_matches

BATCH = "batch"
BY = ("checkpoint", "suffix steps")


@dataclass(frozen=True)
class MetricSums:
    """Sums and counts per batch, group and feature. A batch that is scored again replaces what it had, so a job that is
    repeated after a failure counts nothing twice; metrics come from sums over counts of all batches there are."""

    spark: SparkSession
    folder: str
    by: tuple[str, ...] = BY

    def add(self, sums: DataFrame) -> None:
        writer = sums.select(*[col(c) for c in (BATCH, *self.by, "feature", "ce sum", "se sum", "count")]).write
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(self.folder)

    def sums(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def table(self, features: Sequence[str]) -> DataFrame:
        """A row per group with a loss and an RMSE per feature."""
        return metrics_table(self.sums(), features, self.by)

    def metrics(self) -> tuple[DataFrame, DataFrame]:
        """(overall, per feature) over all groups."""
        return merge_metrics(self.sums())


def check_selectors(index: DataFrame, selectors: DataFrame, keys: Sequence[str]) -> None:
    """Every selector must name exactly one stream; the first that do not are named in the error."""
    wrong = single_stream_matches(index, selectors, keys).limit(20).collect()
    if wrong:
        raise ValueError(f"Selectors that do not match one stream: {[r.asDict() for r in wrong]}")


def run_scoring(
    predictions: DataFrame,
    folder: str,
    ranges: Mapping[str, tuple[float, float]],
    bins: int,
    sigma: float = 0.0,
    batches: int | None = None,
    by: Sequence[str] = BY,
) -> MetricSums:
    """Scores rows of (batch, groups, feature, mask, target, logits) and adds their sums to those in `folder`.

    Rows are summed per batch, group and feature before anything is shuffled; logits never leave their task.
    """
    kept = MetricSums(predictions.sparkSession, folder, tuple(by))
    scored = with_losses(first_batches(predictions, batches, BATCH), ranges, bins, sigma)
    kept.add(loss_sums(scored, [BATCH, *by]))
    return kept
