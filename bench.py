"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time


def main() -> None:
    os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.abspath(__file__)))
    from vecspan.operators import model
    from vecspan.plans import catalog
    from vecspan.session import get_spark
    from vecspan.sources import readers

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark("bench", cores=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    names = ["knn_euclidean", "knn_cosine", "knn_manhattan", "neighbor_pairs", "further_pairs", "midnear_pairs", "gradient_step", "adam_step", "loss_objective", "transform_safety", "knn_vote", "classification_report", "fit_embedding", "transform_with_safety"]
    spark.range(1).count()
    timed = {}

    def clock(name: str, f) -> None:
        began = time.time()
        f()
        timed[name] = round(time.time() - began, 3)

    for name in names:
        clock(name, lambda n=name: catalog.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save())
    # full fits of the published benchmark's shapes: rows x features, 10 neighbours, 450 iterations
    for rows, width in ((1000, 50), (5000, 100), (10000, 300)):
        data = readers.pattern(spark, "standard", rows, width).repartition(8).persist()
        data.count()
        fitted = {}
        clock(f"fit_{rows}x{width}", lambda d=data: fitted.update(m=model.EmbeddingEstimator(seed=42).fit(d)))
        clock(f"transform_100_of_{rows}x{width}", lambda d=data: fitted["m"].transform(d.where("id < 100")).collect())
        data.unpersist()
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(timed.values()), 3), "unit": "sec", "queries": timed, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    sys.exit(main())
