"""Ratios compute the clip once."""

from pyspark.sql import functions as F

from rooftally.operators import summary as S


def test_a_comparison_is_computed_once_for_both_sides_of_a_ratio(spark):
    clip = spark.createDataFrame([(f"a{k % 3}", "google", 1.0 + k, 2.0) for k in range(9)], "aoi string, bf_source string, area_deg2 double, m2_factor double")
    seen = spark.sparkContext.accumulator(0)

    def watched(v):
        seen.add(1)
        return v

    wide = S.compare_aois(clip).withColumns({"official_km2": F.lit(1.0), "density_official": F.col("total") / 1.0})
    wide = wide.withColumn("total", F.udf(watched, "long").asNondeterministic()("total"))
    pairs = spark.createDataFrame([("a0", "a1"), ("a1", "a2")], "aoi_a string, aoi_b string")
    assert [r.n_ratio for r in S.aoi_ratio(wide, pairs).collect()] == [1.0, 1.0]
    assert seen.value == 3
