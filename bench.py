"""Time the stages of an ingest and the queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1) and BENCH_CPUS the cores. Making
the archives from the tables is set-up and is reported apart. Throughputs
divide uncompressed member bytes by 2^20 and by seconds; `*_xN` stages read the
same archives N times in one job, so that job start-up weighs less.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from catalog.queries import QUERIES  # noqa: E402
from fixtures.lake import DECODERS, lake_of  # noqa: E402
from ledgerlake.operators.filters import SnapshotFilters, accounts  # noqa: E402
from ledgerlake.operators.records import read_accounts  # noqa: E402
from ledgerlake.plans.ingest import publish, publish_archives, read_versions, write_versions  # noqa: E402
from ledgerlake.plans.scratch import new_folder  # noqa: E402
from ledgerlake.schemas import ACCOUNT_VERSIONS, ENTRIES, STORED_VERSIONS, pick  # noqa: E402
from ledgerlake.sources import register  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TIMES_READ = 16
RUNS = 2
#: No training-data query is begun after so many seconds.
SECONDS = int(os.environ.get("BENCH_SECONDS", "480"))


def noop(rows: DataFrame) -> None:
    rows.write.format("noop").mode("overwrite").save()


def best(job: Callable[[], None], runs: int = RUNS) -> float:
    def once() -> float:
        begin = time.perf_counter()
        job()
        return time.perf_counter() - begin

    return min(once() for _ in range(runs))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "10g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    begin = time.perf_counter()
    lake = lake_of(spark, SF_DIR)
    lake.archives
    packed = spark.read.parquet(f"{lake.root}/packed")
    account_mb = packed.agg(F.sum("account_bytes")).first()[0] / 2**20
    known = lake.known
    setup = time.perf_counter() - begin

    register(spark)
    columns = ("pubkey", "lamports", "owner", "data_len", "executable", "rent_epoch")
    account_schema = pick(STORED_VERSIONS, *columns)

    def scan(times: int) -> None:
        entries = spark.read.format("ledger_snapshot").schema(pick(ENTRIES, "is_accounts", "content"))
        entries = entries.option("accountsOnly", "true").option("minPartitions", CPUS)
        noop(entries.load([lake.archives] * times).select(F.octet_length("content")))

    def walk(times: int) -> None:
        rows = spark.read.format("ledger_accounts").schema(account_schema).option("includeDead", "false")
        rows = rows.option("minPartitions", CPUS)
        noop(accounts(rows.load([lake.archives] * times), SnapshotFilters()))

    def count(times: int) -> None:
        schema = pick(ACCOUNT_VERSIONS, "executable")
        rows = spark.read.format("ledger_accounts").schema(schema).option("minPartitions", CPUS)
        rows.load([lake.archives] * times).count()

    versions_folder = new_folder(spark, "bench-versions")
    tables_folder = new_folder(spark, "bench-tables")

    def versions() -> None:
        rows = read_accounts(spark, lake.archives, decoders=DECODERS, schema=STORED_VERSIONS)
        write_versions(rows, versions_folder, DECODERS)

    def place(name: str) -> str:
        return f"{tables_folder}/{name}"

    def tables() -> None:
        publish(read_versions(spark, versions_folder), place, known=known)

    def full_build(times: int) -> None:
        publish_archives(spark, [lake.archives] * times, place, known=known)

    stages = {
        "stage_scan": best(lambda: scan(1)),
        "stage_count": best(lambda: count(1)),
        "stage_walk": best(lambda: walk(1)),
        "stage_versions": best(versions),
        "stage_tables": best(tables),
        "stage_full_build": best(lambda: full_build(1)),
        f"stage_scan_x{TIMES_READ}": best(lambda: scan(TIMES_READ)),
        f"stage_count_x{TIMES_READ}": best(lambda: count(TIMES_READ)),
        f"stage_walk_x{TIMES_READ}": best(lambda: walk(TIMES_READ)),
        f"stage_full_build_x{TIMES_READ}": best(lambda: full_build(TIMES_READ)),
    }
    throughput = {
        name.removeprefix("stage_") + "_mb_s": round(account_mb * (TIMES_READ if "_x" in name else 1) / sec, 1)
        for name, sec in stages.items()
        if name != "stage_tables"
    }
    queries = {name: best(lambda: noop(query(spark, SF_DIR))) for name, query in QUERIES.items()}
    try:
        from ledgerlake.llm.queries import QUERIES as training
    except ImportError:
        training = {}
    # Once each while there is time, and not in the total, which goes on from earlier rounds.
    training_data = {}
    for name, query in training.items():
        if time.perf_counter() - begin < SECONDS:
            training_data[name] = best(lambda: noop(query(spark, SF_DIR)), 1)
    result = {
        "metric": "total seconds over all stages and queries",
        "value": round(sum(stages.values()) + sum(queries.values()), 3),
        "unit": "sec",
        "queries": {name: round(sec, 3) for name, sec in {**stages, **queries}.items()},
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "cpus": int(CPUS),
        "account_mb": round(account_mb, 1),
        "throughput": throughput,
        "setup_sec": round(setup, 2),
        "training_data": {name: round(sec, 3) for name, sec in training_data.items()},
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
