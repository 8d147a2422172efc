"""GeoParquet: files with the ``geo`` key, an index of their footers, and reading only the files that areas need.

Spark's own writer has no way to add a key to a footer, so files are written by a Python data source: each task streams its Arrow
batches to files of its own under the target's hidden folder, and the driver moves the finished ones into place when all
tasks have succeeded. Reading stays with Spark's Parquet reader, which prunes row groups; which files it reads comes from the index.

The index is a table: footers are read by tasks, a file each, and one row tells a file's rows, label of its coordinate system and box.
A footer that cannot be read is a row with its error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from rooftally.functions.plan import compute_once, row_hash
from rooftally.functions.wkb import multipolygon_to_wkb
from rooftally.operators.box_join import BOX, meeting_any
from rooftally.operators.grid import z_order
from rooftally.sources.footprints import COVERING, prepare_footprints
from rooftally.workspace import write_and_read

GEOMETRY, COVER = "geometry", "bbox"
# Fixed values of the format: its version, the system of files that name none, and how systems are described.
VERSION = "1.1.0"
CRS84, EPSG4326 = "OGC:CRS84", "EPSG:4326"
_AXES = {CRS84: (("Geodetic longitude", "Lon", "east"), ("Geodetic latitude", "Lat", "north")),
         EPSG4326: (("Geodetic latitude", "Lat", "north"), ("Geodetic longitude", "Lon", "east"))}
ROWS_PER_FILE = 5_000_000
ROW_GROUP = 1 << 17
INDEX = "file string, n_bytes long, n_rows long, crs string, minx double, miny double, maxx double, maxy double, geo string, error string"
#: Labels named in an error.
LABELS = 20


def crs_description(label: str) -> dict:
    """PROJJSON of one of the two labels of the same system."""
    if label not in _AXES:
        raise ValueError(f"only {' and '.join(_AXES)} can be written: {label!r}")
    authority, code = label.split(":")
    axes = [{"name": n, "abbreviation": a, "direction": d, "unit": "degree"} for n, a, d in _AXES[label]]
    ensemble = {"name": "World Geodetic System 1984", "ellipsoid": {"name": "WGS 84", "semi_major_axis": 6378137, "inverse_flattening": 298.257223563}}
    return {"$schema": "https://proj.org/schemas/v0.7/projjson.schema.json", "type": "GeographicCRS", "name": "WGS 84" if code.isdigit() else "WGS 84 (CRS84)",
            "datum": {"type": "GeodeticReferenceFrame", **ensemble}, "coordinate_system": {"subtype": "ellipsoidal", "axis": axes},
            "id": {"authority": authority, "code": int(code) if code.isdigit() else code}}


def crs_label(column: dict) -> str:
    """Label of a geometry column's system: CRS84 where none is named, ``undefined`` where it is null or has no identity."""
    if "crs" not in column:
        return CRS84
    known = (column["crs"] or {}).get("id") or {}
    return f"{known['authority']}:{known['code']}" if {"authority", "code"} <= known.keys() else "undefined"


def geo_key(box: list[float] | None, label: str, kinds: list[str]) -> str:
    """The value of the key for files with a WKB column and a covering box."""
    column = {"encoding": "WKB", "geometry_types": kinds, "crs": crs_description(label),
              "covering": {"bbox": {c: [COVER, c] for c in COVERING}}}
    if box:
        column["bbox"] = box
    return json.dumps({"version": VERSION, "primary_column": GEOMETRY, "columns": {GEOMETRY: column}})


def _filesystem(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])


# --- writing ------------------------------------------------------------------------------------------------------
@dataclass
class _Written(WriterCommitMessage):
    """Files of a task: (name under the hidden folder, name in place, rows)."""

    files: list[tuple[str, str, int]]


class _Target:
    """A file that is being written, with the box of its rows so far."""

    def __init__(self, system, path: str, schema: pa.Schema, label: str):
        self.sink = system.open_output_stream(path)
        self.writer = pq.ParquetWriter(self.sink, schema)
        self.label, self.rows, self.box, self.kinds = label, 0, None, set()

    def add(self, table: pa.Table) -> None:
        self.writer.write_table(table, row_group_size=ROW_GROUP)
        self.rows += table.num_rows
        cover = table.column(COVER).combine_chunks()
        low = [pa.compute.min(cover.field(c)).as_py() for c in COVERING[:2]]
        high = [pa.compute.max(cover.field(c)).as_py() for c in COVERING[2:]]
        if None not in (*low, *high):
            old = self.box or [*low, *high]
            self.box = [*map(min, old[:2], low), *map(max, old[2:], high)]
        codes = pa.compute.unique(pa.compute.binary_slice(table.column(GEOMETRY), 1, 2)).to_pylist()
        self.kinds |= {{3: "Polygon", 6: "MultiPolygon"}[c[0]] for c in codes if c}

    def close(self) -> None:
        self.writer.add_key_value_metadata({"geo": geo_key(self.box, self.label, sorted(self.kinds))})
        self.writer.close()
        self.sink.close()


class GeoParquetWriter(DataSourceArrowWriter):
    """One writer for a job; ``write`` runs in the tasks, ``commit`` and ``abort`` on the driver."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.label = options["path"].rstrip("/"), options.get("crs", EPSG4326)
        self.keys = [k for k in options.get("partitionby", "").split(",") if k]
        self.most, self.overwrite = int(options.get("rowsperfile", ROWS_PER_FILE)), overwrite
        self.hidden = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, root = _filesystem(self.path)
        task = TaskContext.get()
        files: list[tuple[str, str, int]] = []
        target, place = None, None
        for batch in iterator:
            table = pa.Table.from_batches([batch])
            for values, part in self._runs(table):
                at = 0
                while at < part.num_rows:
                    if target is None or place != values or target.rows >= self.most:
                        if target:
                            self._finish(target, files)
                        name = f"part-{task.partitionId():05}-{len(files):03}-{task.taskAttemptId()}.parquet"
                        folder = "".join(f"{k}={_escaped(v)}/" for k, v in zip(self.keys, values))
                        system.create_dir(f"{root}/{self.hidden}", recursive=True)
                        target, place = _Target(system, f"{root}/{self.hidden}/{name}", part.schema, self.label), values
                        files.append((name, folder + name, 0))
                    some = part.slice(at, self.most - target.rows)
                    target.add(some)
                    at += some.num_rows
        if target:
            self._finish(target, files)
        return _Written(files)

    @staticmethod
    def _finish(target: _Target, files: list) -> None:
        target.close()
        files[-1] = (*files[-1][:2], target.rows)

    def _runs(self, table: pa.Table) -> Iterator[tuple[tuple, pa.Table]]:
        """Neighbouring rows of one partition, without the partition columns; the rows come sorted by them."""
        rest = table.select([c for c in table.column_names if c not in self.keys])
        if not self.keys:
            yield (), rest
            return
        rows = list(zip(*[table.column(k).to_pylist() for k in self.keys]))
        cuts = [0, *[k for k in range(1, len(rows)) if rows[k] != rows[k - 1]], len(rows)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield rows[a], rest.slice(a, b - a)

    def commit(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f"/{self.hidden}/" not in f.path]
        for message in messages:
            for name, place, _ in message.files if message else ():
                system.create_dir(f"{root}/{place}".rpartition("/")[0], recursive=True)
                system.move(f"{root}/{self.hidden}/{name}", f"{root}/{place}")
        if self.overwrite:  # after the new files are in place, so that a crash loses nothing
            for path in old:
                system.delete_file(path)
        self._clean(system, root)
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[_Written | None]) -> None:
        self._clean(*_filesystem(self.path))

    def _clean(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/{self.hidden}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.hidden}")


def _escaped(value) -> str:
    from urllib.parse import quote

    return "__HIVE_DEFAULT_PARTITION__" if value is None or value == "" else quote(str(value), safe=" ")


class GeoParquetSource(DataSource):
    """The format ``geoparquet``, for writing. Options: path, crs (a label), partitionby (names, by comma), rowsperfile."""

    @classmethod
    def name(cls) -> str:
        return "geoparquet"

    def writer(self, schema: StructType, overwrite: bool) -> GeoParquetWriter:
        return GeoParquetWriter(self.options, overwrite)


def write_geo(df: DataFrame, path: str, geometry: str = "mp", partition_by: tuple[str, ...] = (), files: int | None = None,
              crs: str = EPSG4326, rows_per_file: int = ROWS_PER_FILE, mode: str = "overwrite") -> str:
    """Write rows as GeoParquet in map order: WKB, a covering box ``bbox``, planar area, and the ``geo`` key in every footer.

    ``mode`` is overwrite or append. Neighbours share files and row groups; a spot or a partition value that holds most
    rows is cut into several files, as are exact copies.
    """
    crs_description(crs)
    spark = df.sparkSession
    spark.dataSource.register(GeoParquetSource)
    measured = prepare_footprints(df, geometry)
    if dict(measured.dtypes)[geometry] != "binary":
        measured = measured.withColumn(geometry, multipolygon_to_wkb(F.col(geometry)))
    named = measured.withColumnRenamed(geometry, GEOMETRY)
    covered = named.withColumn(COVER, F.struct(*[F.col(b).alias(c) for b, c in zip(BOX, COVERING)]))
    ordered = compute_once(covered, _z=F.expr(z_order("minx", "miny")), _tie=row_hash(measured))
    keys = [*partition_by, "_z", "_tie"]
    ranged = ordered.repartitionByRange(files, *keys) if files else ordered.repartitionByRange(*keys)
    rows = ranged.sortWithinPartitions(*keys).drop("_z", "_tie", *BOX)
    (rows.write.format("geoparquet").mode(mode).option("crs", crs).option("partitionby", ",".join(partition_by))
     .option("rowsperfile", str(rows_per_file)).save(path))
    return path


# --- index ---------------------------------------------------------------------------------------------------------
def _box_of(footer: pq.FileMetaData, column: dict) -> list[float | None]:
    """Box of a file: from the statistics of its covering column over all row groups, else as the key has it."""
    paths = column.get("covering", {}).get("bbox", {})
    names = {".".join(paths[c]): k for k, c in enumerate(COVERING) if c in paths} or {f"{COVER}.{c}": k for k, c in enumerate(COVERING)}
    found: list[list[float]] = [[], [], [], []]
    groups = [footer.row_group(g) for g in range(footer.num_row_groups)]
    for group in groups:
        for at in range(group.num_columns):
            chunk = group.column(at)
            k = names.get(chunk.path_in_schema)
            if k is not None and chunk.is_stats_set and chunk.statistics.has_min_max:
                found[k].append(chunk.statistics.min if k < 2 else chunk.statistics.max)
    if groups and all(len(f) == len(groups) for f in found):
        return [min(found[0]), min(found[1]), max(found[2]), max(found[3])]
    box = column.get("bbox") or []
    return list(box) if len(box) == 4 else [box[0], box[1], box[3], box[4]] if len(box) == 6 else [None] * 4


def describe_file(path: str) -> dict:
    """Rows, label, box and key of one file, or why it can't be read."""
    out = dict.fromkeys(("n_rows", "crs", *BOX, "geo", "error"))
    try:
        system, inner = _filesystem(path)
        with system.open_input_file(inner) as file:
            footer = pq.ParquetFile(file).metadata
        out["n_rows"] = footer.num_rows
        key = (footer.metadata or {}).get(b"geo")
        geo = json.loads(key) if key else {}
        column = geo.get("columns", {}).get(geo.get("primary_column"), {})
        out.update(zip(BOX, _box_of(footer, column)), crs=crs_label(column) if column else None, geo=key.decode() if key else None)
    except Exception as e:  # whatever is wrong with a file, the listing goes on and names it
        out["error"] = (str(e) or type(e).__name__).splitlines()[0]
    return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [{"file": r["file"], "n_bytes": r["n_bytes"], **describe_file(r["file"])} for r in batch.to_pylist()]
        names = [c.split()[0] for c in INDEX.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[c.split()[1]]) for n, c in zip(names, INDEX.split(", "))], names)


def list_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, n_bytes) of all Parquet files below some folders, hidden ones left out; contents are not read."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(list(paths)))
    return found.select(F.col("path").alias("file"), F.col("length").alias("n_bytes"))


def file_index(spark: SparkSession, *paths: str) -> DataFrame:
    """One row for each file (``INDEX``): the footers are read by tasks; no file is read further."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return write_and_read(list_files(spark, *paths).repartition(width, "file").mapInArrow(_described, INDEX), "file-index")


@dataclass(frozen=True)
class FileScan:
    """Footprints from the files that were needed."""

    footprints: DataFrame
    crs: tuple[str, ...]
    n_files: int
    n_present: int


def read_near(spark: SparkSession, path: str, areas: DataFrame, index: DataFrame | None = None) -> FileScan:
    """The files whose box meets the box of an area (``areas`` has ``BOX``), and those whose box is not known.

    ``crs`` has the labels of the files that are read; files without the key count as ``undefined``, which ``clip`` refuses, unless the whole folder
    is without it (plain Parquet), then there is no label. A file that can't be read is an error here.
    """
    index = file_index(spark, path) if index is None else index
    bad = index.where("error IS NOT NULL").select("file", "error").head()
    if bad:
        raise ValueError(f"{bad.file} cannot be read: {bad.error}")
    full = index.where("n_rows > 0")
    needed = write_and_read(meeting_any(full.where("minx IS NOT NULL"), areas).unionByName(full.where("minx IS NULL")), "needed-files")
    labels = [r[0] for r in needed.select("crs").distinct().limit(LABELS).collect()]
    named = () if labels in ([], [None]) else tuple(sorted(v or "undefined" for v in labels))
    files = [r.file for r in needed.select("file").orderBy("file").collect()]  # the scan's own list of files
    if files:
        rows = spark.read.option("basePath", path).parquet(*files)
    else:
        try:
            rows = spark.read.parquet(path).where(F.lit(False))
        except AnalysisException:
            rows = spark.createDataFrame([], f"{GEOMETRY} binary")
    return FileScan(rows, named, len(files), index.count())
