"""Times the headline queries: one JSON line with seconds for each.

BENCH_SF_DIR: the tables (default sf0.1).  BENCH_CPUS: threads (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
os.environ.setdefault("OMP_NUM_THREADS", "1")
ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SQL = [
    "tfidf_weight", "bm25_weight", "knn_cosine", "knn_bm25", "knn_recommend", "leave_k_out_test", "ndcg_at_k", "mf_recommend",
    "mf_similar_users", "ivf_search", "als_normal_equations_k2", "als_half_step_k2", "als_explain_k2", "bpr_scores",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from tastegrid.operators.als import AlternatingLeastSquares
    from tastegrid.operators.bpr import BayesianPersonalizedRanking
    from tastegrid.operators.lmf import LogisticMatrixFactorization
    from tastegrid.plans.queries import QUERIES
    from tastegrid.plans.tables import cp
    from tastegrid.sources.checkpoints import stash

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def run(name: str, f) -> None:
        began = time.time()
        f()
        took[name] = round(time.time() - began, 3)

    def drained(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    drained(QUERIES["interactions_cp"](spark, sf_dir))  # starts the executors' threads and compiles the readers
    for name in SQL:
        run(name, lambda: drained(QUERIES[name](spark, sf_dir)))
    x = cp(spark, sf_dir)
    x = x.with_df(stash(x.df, "bench"))
    for k in (64, 128):
        seconds: list[float] = []
        model = AlternatingLeastSquares(factors=k, iterations=3, random_state=1)
        run(f"als_fit_k{k}_3_iterations", lambda: model.fit(x, callback=lambda i, s, loss: seconds.append(s)))
        took[f"als_seconds_per_iteration_k{k}"] = round(took[f"als_fit_k{k}_3_iterations"] / 3, 3)
        if k == 64:
            run("als_recommend_k64", lambda: drained(model.recommend(None, x, 10)))
    run("bpr_fit_k32_3_epochs", lambda: BayesianPersonalizedRanking(factors=32, iterations=3, random_state=1).fit(x))
    run("lmf_fit_k30_1_epoch", lambda: LogisticMatrixFactorization(factors=30, iterations=1, random_state=1).fit(x))
    total = sum(v for k, v in took.items() if "per_iteration" not in k)
    print(json.dumps({"metric": "total_query_seconds", "value": round(total, 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
