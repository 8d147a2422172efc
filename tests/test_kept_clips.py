"""Clips that are kept: as a table, and in a folder that is written again."""

import pytest

from rooftally.sources import writers as K

AREAS = 600


@pytest.fixture
def clip(spark):
    return spark.range(4 * AREAS).selectExpr(f"concat('aoi_', id % {AREAS}) AS aoi", "id AS n").repartition(8)


def test_a_kept_table_has_fewer_files_than_areas(spark, clip, tmp_path):
    spark.sql(f"CREATE DATABASE kept_clips LOCATION '{tmp_path / 'db'}'")
    try:
        kept = spark.table(K.keep_table(clip, "kept_clips.recorte_all"))
        assert len(kept.inputFiles()) <= 8
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, clip.collect()))
    finally:
        spark.sql("DROP DATABASE kept_clips CASCADE")


def test_a_clip_written_again_keeps_the_other_areas_of_its_blocks(spark, clip, tmp_path):
    path = str(tmp_path / "clip")
    K.write_clip(clip, path)
    assert len(list((tmp_path / "clip").glob("*=*"))) <= K.CLIP_BLOCKS < AREAS
    K.write_clip(clip.where("aoi LIKE '%7' AND n >= 1200").selectExpr("aoi", "-n AS n"), path)
    want = sorted((f"aoi_{n % AREAS}", -n if n % 10 == 7 else n) for n in range(4 * AREAS) if n % 10 != 7 or n >= 1200)
    assert sorted(map(tuple, K.read_clip(spark, path).select("aoi", "n").collect())) == want
    some = K.read_clip(spark, path, "aoi_3", "aoi_17").select("aoi", "n").collect()
    assert sorted(map(tuple, some)) == [w for w in want if w[0] in ("aoi_3", "aoi_17")]
