"""The ham benchmark from scored rows to its tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscreen.operators import benchmark as ops
from mailscreen.sinks.reports import benchmark_markdown


@dataclass(frozen=True)
class HamBenchmark:
    mode: DataFrame
    by_source: DataFrame
    with_total: DataFrame
    sweep: DataFrame
    source_sweep: DataFrame
    decision: DataFrame
    examples: DataFrame

    def report(self, model_name: str) -> DataFrame:
        return benchmark_markdown(
            model_name, self.mode, self.by_source, self.sweep, self.source_sweep, self.decision, self.examples
        )


def run_ham_benchmark(
    test: DataFrame,
    training_counts: DataFrame,
    sources: list[str],
    order: list[str],
    external: DataFrame | None = None,
    thresholds=ops.THRESHOLDS,
) -> HamBenchmark:
    """`test` and `external` are scored rows (label, source, text, spam_probability,
    prediction); score once, write, then hand them in, for every table reads them again.

    Held-out rows of the configured sources are used if the training corpus has any of
    these sources, else the external ham corpora.
    """
    mode = ops.benchmark_mode(training_counts, sources)
    inside = mode.first()["mode"] == "heldout_test_sources"
    if inside:
        ham = ops.heldout_ham(test, sources)
        both = test
        is_test, is_ham = F.lit(True), F.col("source").isin(list(sources)) & (F.col("label") == 0)
    else:
        if external is None:
            raise ValueError("no configured ham source is in the training corpus; external ham rows are needed")
        columns = ["label", "source", "text", "spam_probability", "prediction", *order]
        ham = external.select(*dict.fromkeys(columns))
        both = test.select(*dict.fromkeys(columns)).withColumn("_ham", F.lit(False)).unionByName(ham.withColumn("_ham", F.lit(True)))
        is_test, is_ham = ~F.col("_ham"), F.col("_ham")
    sweep = ops.threshold_sweep(both, is_test, is_ham, thresholds)
    return HamBenchmark(
        mode=mode,
        by_source=ops.ham_by_source(ham),
        with_total=ops.ham_with_total(ham),
        sweep=sweep,
        source_sweep=ops.sweep_by_source(ham, thresholds),
        decision=ops.recommend(sweep),
        examples=ops.top_false_positives(ham, order),
    )
