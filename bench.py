"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from mailscreen.registry import QUERIES
from mailscreen.session import build_session

HEADLINE = (
    "clean_text",
    "email_stats",
    "stats_scaled",
    "dedupe_first",
    "corpus_union",
    "stratified_split",
    "prepare_dataset",
    "dataset_summary",
    "sample_per_source",
    "sample_with_replacement",
    "term_doc_freq",
    "tfidf_word",
    "tfidf_char",
    "top_signals",
    "binary_metrics",
    "roc_auc",
    "threshold_sweep",
    "top_false_positives",
    "ham_benchmark",
    "score_batch",
    "batch_from_lines",
    "decode_files",
    "source_kaggle_shape",
    "score_with_plugin",
    "train_embedding_head",
    "feature_union_counts",
    "batch_from_line_files",
    "stream_score",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g", spark__ui__showConsoleProgress="false", spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["label_totals"](spark, folder).collect()  # starts the JVM side
    seconds = {}
    for name in names:
        start = time.perf_counter()
        # Every row is produced and dropped, as a writer would take it.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_wall", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
