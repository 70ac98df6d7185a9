"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is planned and run in full (results go to the no-op sink).  Work
that queries share within a session (lexicon, vocabulary) is timed as its own
entry first, so no query hides it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from glyphmill.functions import bytelevel as bl  # noqa: E402
from glyphmill.operators import bpe as bp  # noqa: E402
from glyphmill.operators import pairs  # noqa: E402
from glyphmill.plans import inputs  # noqa: E402
from glyphmill.plans.registry import QUERIES  # noqa: E402
from glyphmill.plans.sizing import spread  # noqa: E402
from glyphmill.session import local_session  # noqa: E402
from glyphmill.sources.tables import table  # noqa: E402

HEADLINE = [
    "generate_pairs",
    "pair_mix_report",
    "axis_sets",
    "sample_slots",
    "novel_slots",
    "pretoken_frequencies",
    "bpe_pair_counts",
    "bpe_encode",
    "bpe_decode",
    "split_token_totals",
    "pack_blocks",
    "epoch_batches",
    "instruction_encode",
    "conversation_encode",
    "dynamic_padding",
    "sanitize_diagrams",
    "slot_metrics",
    "axis_costs",
    "shape_match",
    "metric_self_check",
    "stage_audit",
    "early_stop_epoch",
    "stream_pairs",
    "stream_tokenize",
    "synthesize_diagrams",
    "unmatched_prompts",
]
TRAIN_MERGES = 256


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def lineitem_pairs(spark, folder):
    """Pairs keyed by (order, line): the largest key table."""
    line = spread(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"))
    ids = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pair_id"))
    wanted = spark.sparkContext.defaultParallelism
    ids = ids.repartition(wanted, "pair_id").distinct()
    return pairs.generate_pairs(ids, inputs.kit(spark, folder))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    timings: dict[str, float] = {}

    def timed(name, work) -> None:
        start = time.perf_counter()
        work()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name:28s} {timings[name]:8.3f}", file=sys.stderr, flush=True)

    sink(table(spark, folder, "orders"))  # start the executors
    timed("build_lexicon_and_grammar", lambda: inputs.kit(spark, folder))
    timed("build_query_vocabulary", lambda: inputs.vocabulary(spark, folder))
    only = sys.argv[1:]
    for name in HEADLINE:
        if not only or name in only:
            timed(name, lambda: sink(QUERIES[name](spark, folder)))
    if not only:
        timed("lineitem_pairs", lambda: sink(lineitem_pairs(spark, folder)))
        freq = bp.pretoken_frequencies(inputs.documents(spark, folder))
        timed(
            f"bpe_train_{TRAIN_MERGES}_merges",
            lambda: bp.train_bpe(freq, bl.FIRST_MERGE + TRAIN_MERGES),
        )
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
