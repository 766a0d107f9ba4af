"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from utxolens.plans.catalog import DATASETS, ingest  # noqa: E402
from utxolens.session import build_session  # noqa: E402

# The five refresh jobs first, then the network, its entities and their metrics.
# A metric reads the entities stored by the query before it, as a snapshot does.
HEADLINE = [
    "transaction_network",
    "rewards_by_epoch",
    "rewards_by_pool",
    "distribution_whales",
    "account_balance",
    "script_calls",
    "token_types",
    "tokens_by_day",
    "current_supply",
    "network_with_ids",
    "co_input_pairs",
    "network_table",
    "token_edges",
    "stake_balance_case",
    "top_degree",
    "total_rewards_per_address",
    "change_final",
    "entities",
    "entity_edges",
    "entity_balances",
    "gini",
    "core_size",
    "largest_scc",
    "triangles",
    "pagerank_fixed",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    DATASETS["latest_block"](spark, folder).collect()  # start the executors
    started = time.time()
    ingest(spark, folder)
    seconds = {"ingest": round(time.time() - started, 3)}
    for name in HEADLINE:
        started = time.time()
        DATASETS[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
