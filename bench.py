"""Times the headline jobs; prints one JSON line."""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from standcarbon import fixtures as X  # noqa: E402
from standcarbon import queries as Q  # noqa: E402
from standcarbon.operators import allocate as A  # noqa: E402
from standcarbon.operators.overlay import overlay  # noqa: E402
from standcarbon.session import tune  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = tune(
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("standcarbon-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='standcarbon-bench-')}")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    notices, stands = X.notices(spark, FOLDER), X.stands(spark, FOLDER)
    elements = X.elements(spark, FOLDER)
    jobs = {
        "overlay_rectangles": lambda: overlay(notices, stands),
        "overlay_polygons": lambda: Q.overlay_polygons(spark, FOLDER),
        "stand_allocation": lambda: A.species_rates(
            A.stand_allocation(stands, A.group_elements(elements))
        ),
        "stands_for_notices": lambda: Q.stands_for_notices(spark, FOLDER),
        "stand_detail_summary": lambda: Q.stand_detail_summary(spark, FOLDER),
        "notice_results": lambda: Q.run(spark, FOLDER).results(),
        "species_breakdown": lambda: Q.run(spark, FOLDER).species_breakdown(),
        "kpi_rollup": lambda: Q.kpi_rollup(spark, FOLDER),
        "species_rollup": lambda: Q.species_rollup(spark, FOLDER),
        "map_layer": lambda: Q.map_layer(spark, FOLDER),
    }
    seconds = {}
    for name, job in jobs.items():
        # Best of two: the first run also compiles the generated code.
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            drain(job())
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline jobs, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(FOLDER).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
