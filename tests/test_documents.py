"""Documents are written and read by tasks."""

from pyspark.sql import functions as F

from rooftally.sources import writers as K
from rooftally.sources.documents import FILE, folder, read_documents, write_documents


def lines(spark, n, text="x"):
    rows = spark.range(n).select(F.format_string("a/%d", "id").alias("aoi"), F.lit("google").alias("bf_source"), F.lit(0).alias("part"),
                                 F.explode(F.array(F.lit("["), F.lit(text), F.lit("]"))).alias("value"))
    return rows.coalesce(2)


def test_documents_come_back_whole_and_are_replaced(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        write_documents(lines(spark, 30, "é"), path)
        write_documents(lines(spark, 20), path)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    back = read_documents(lines(spark, 20), path).collect()
    assert len(back) == 20 and {(r.bf_source, r.part, r.value) for r in back} == {("google", 0, "[\nx\n]\n")}
    assert len(list((tmp_path / "docs").rglob("*.txt"))) == 20
    assert (tmp_path / "docs" / "aoi=a%2F7" / "bf_source=google" / "part=0" / FILE).is_file()
    assert {(r.aoi, r.value) for r in spark.read.text(path, wholetext=True).collect()} == {(r.aoi, r.value) for r in back}


def test_folders_are_named_as_spark_names_them(spark, tmp_path):
    names = ["São, a b", "x=1:2", "50%", "[q]^{'\"#*?\\", "plain"]
    spark.createDataFrame([(n, 1) for n in names], "aoi string, n int").write.partitionBy("aoi").parquet(str(tmp_path / "p"))
    assert {f.name for f in (tmp_path / "p").iterdir() if f.is_dir()} == {folder((n,)) for n in names}


def test_no_file_of_a_layer_passes_through_sparks_text_writer(spark, tmp_path):
    """That writer leaves a checksum file beside each document, made, like the document, at the price of a process."""
    aois = spark.range(40).select(F.format_string("a%d", "id").alias("slug"))
    none = spark.createDataFrame([], "aoi string, bf_source string, mp array<array<array<array<double>>>>, area_m2 double")
    written = K.write_layers(none, aois, str(tmp_path / "out"), ("google", "microsoft"))
    assert written.count() == 80 and not list((tmp_path / "out").rglob("*.crc"))
    assert read_documents(written, str(tmp_path / "out")).count() == 80
