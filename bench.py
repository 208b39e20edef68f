"""Headline timings: one warm-up, then the median of three runs per query.

Prints one JSON line. Settings: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS, BENCH_MEMORY.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from corpusflow.plans import QUERIES, eval_queries, token_queries
from corpusflow.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = {
    "vocab": QUERIES["tok4_vocab"],
    "pack": token_queries.packed_docs,
    "pack_training": token_queries.training_docs,
    "dedup": QUERIES["ded1_dedup_exact"],
    "chat_format": QUERIES["fmt7_chat_pair"],
    "mask": token_queries.masked_rows,
    "instruction_mix": QUERIES["mix_instruction_tables"],
    "interleave": QUERIES["mix3_interleave"],
    "bigram_counts": eval_queries.doc_bigrams,
    "bigram_score": QUERIES["ngm2_score_tokens"],
    "ppl": QUERIES["ppl2_weighted"],
    "nucleus": QUERIES["ngm5_nucleus"],
    "stream_pack": QUERIES["str3_stream_pack"],
    "bpe_encode": QUERIES["tok6_encode_bpe"],
    "pair_metrics": QUERIES["prf1_pair_metrics"],
    "first_n": QUERIES["smp2_sample_by_blocks"],
}


def run(spark, fn) -> float:
    t = time.perf_counter()
    fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    spark = local_session(CPUS, partitions=int(CPUS) * 2, memory=os.environ.get("BENCH_MEMORY", "16g"),
                          # one small file is read by all cores; at scale files are many
                          **{"spark.sql.files.minPartitionNum": str(2 * int(CPUS)), "spark.sql.files.openCostInBytes": "262144"})
    times = {}
    for label, fn in HEADLINE.items():
        run(spark, fn)
        times[label] = round(statistics.median(run(spark, fn) for _ in range(RUNS)), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": CPUS}))
    spark.stop()


if __name__ == "__main__":
    main()
