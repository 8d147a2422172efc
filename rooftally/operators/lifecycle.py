"""Looking after the kept tables: list, describe, measure, prune, compact."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rooftally.sources.geoparquet import INDEX, file_index, list_files

# Fixed value: country tables, the only ones that may be pruned.
PRUNABLE = r"^footprints_[a-z]{2,3}$"


def list_tables(spark: SparkSession, database: str) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)


def describe_table(spark: SparkSession, database: str, table: str) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in spark.table(f"{database}.{table}").schema]
    return spark.createDataFrame(rows, "column_name string, column_type string, nullable boolean")


def _location(spark: SparkSession, database: str, table: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED `{database}`.`{table}`").where(F.col("col_name") == "Location")
    return rows.first()["data_type"]


def table_stats(spark: SparkSession, database: str) -> DataFrame:
    """Rows, files and bytes per table, by name; a table that cannot be read is listed with its error.

    One job for all tables: their files are listed together and the footers are read by tasks, so nothing is scanned and one bad file doesn't
    end the listing.
    """
    names = list_tables(spark, database)
    shape = "table_name string, location string, prunable boolean"
    tables = spark.createDataFrame([(n, _location(spark, database, n), bool(re.match(PRUNABLE, n))) for n in names], shape)
    folders = {r.location.rstrip("/") + "/": r.table_name for r in tables.collect()}
    index = _index_of(spark, sorted(folders)).withColumn("table_name", _owner(folders, "file"))
    held = index.groupBy("table_name").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_files"), F.sum("n_bytes").alias("n_bytes"),
                                           F.min_by("error", F.struct(F.col("error").isNull(), "file")).alias("error"))
    return tables.join(held, "table_name", "left").select(
        "table_name", F.when(F.col("error").isNull(), F.coalesce("n_rows", F.lit(0))).alias("n_rows"), F.coalesce("n_files", F.lit(0)).alias("n_files"),
        F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), "error", "prunable").orderBy("table_name")


def _index_of(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Footers of all files below the folders that exist."""
    try:
        return file_index(spark, *folders) if folders else spark.createDataFrame([], INDEX)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    there = []
    for folder in folders:  # names only: a table without its folder holds nothing
        try:
            list_files(spark, folder)
            there.append(folder)
        except AnalysisException:
            pass
    return file_index(spark, *there) if there else spark.createDataFrame([], INDEX)


def _owner(folders: dict[str, str], file: str) -> Column:
    """The table whose folder a file lies in; there are as many as tables."""
    def plain(path: str) -> str:
        return re.sub(r"^file:/+", "/", path)

    known = {plain(f): n for f, n in folders.items()}

    @F.pandas_udf("string")
    def owner(files: pd.Series) -> pd.Series:
        def of(path: str) -> str | None:
            at = plain(path)
            while at.count("/") > 1:
                at = at[:at.rstrip("/").rindex("/") + 1]
                if at in known:
                    return known[at]
            return None
        return files.map(of)

    return owner(file)


def prune_tables(spark: SparkSession, database: str, confirm: bool = False) -> list[str]:
    """Country tables that would be (or, when confirmed, were) dropped; clips and areas are never touched."""
    targets = [t for t in list_tables(spark, database) if re.match(PRUNABLE, t)]
    if confirm:
        for name in targets:
            spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")
    return targets


def compact_table(spark: SparkSession, database: str, table: str, new_path: str, rows_per_file: int = 5_000_000,
                  cluster_by: tuple[str, ...] = (), confirm: bool = False) -> dict[str, int]:
    """Rewrite a table's small files as few large ones at a new place and let the table point there.

    The row counts are compared before the switch; the old files stay readable as ``<table>_bak``, which replaces an older
    backup. A table without partitions is switched by one change of its location, so a crash leaves it readable, before or after. Without ``confirm`` nothing is changed and only the present figures are returned. No file gets more than
    ``rows_per_file`` rows.
    """
    name, backup = f"`{database}`.`{table}`", f"`{database}`.`{table}_bak`"
    df = spark.table(name)
    before = df.count()
    if not confirm:
        return {"rows": before, "files": len(df.inputFiles())}
    parts = [c.name for c in spark.catalog.listColumns(f"{database}.{table}") if c.isPartition]
    keys = [*parts, *cluster_by]
    # by key, adaptive execution sizes the files and splits a key that holds most rows
    spread = df.hint("rebalance", *keys) if keys else df.repartition(max(1, -(-before // rows_per_file)))
    spread.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).partitionBy(*parts).parquet(new_path)
    written = spark.read.parquet(new_path)
    after = written.count()
    if after != before:
        raise RuntimeError(f"compacted copy of {table} has {after} rows instead of {before}; nothing was changed")
    spark.sql(f"DROP TABLE IF EXISTS {backup}")
    if parts:  # the partitions have locations of their own
        spark.sql(f"ALTER TABLE {name} RENAME TO {backup}")
        spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{new_path}'")
        spark.sql(f"MSCK REPAIR TABLE {name}")
    else:
        spark.sql(f"CREATE TABLE {backup} USING parquet LOCATION '{_location(spark, database, table)}'")
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{new_path}'")
        spark.catalog.refreshTable(name)
    return {"rows": after, "files": len(written.inputFiles())}
