"""What the passes of the corpus operators share."""

import pyarrow as pa
from pyspark.sql import types as T

from echolake.llm import common


def test_workers_keep_the_caches_of_one_operator_only(spark):
    def made(owner):
        def run(texts):
            kept = common.worker_cache(f"kept by {owner}")
            kept["x"] = 1
            count = sum(len(common.worker_cache(f"kept by {o}")) for o in "abc")
            return [pa.array([count] * len(texts), pa.int64())]

        run.__module__ = owner
        return run

    df = spark.createDataFrame([("x",)] * 64, "t string").repartition(8)
    for owner in "abca":
        got = common.add_columns(df, "t", [T.StructField("n", T.LongType())], made(owner)).collect()
        assert {r.n for r in got} == {1}
