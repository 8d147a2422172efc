"""Files that hold one document each, by the thousand: written and read by tasks, without a listing of all of them on the driver.

A file for each area, source and part is what a map page loads. Spark's text writer spends some 20 ms on such a file where permissions
are set by a process of their own, and its reader lists every folder and keeps every file's status on the driver. Here a task streams the
documents that it is dealt, and a reader lists the folder of each area in tasks.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from rooftally.sources.geoparquet import _filesystem

PLACE = ("aoi", "bf_source", "part")
FILE = "document.txt"
DOCUMENTS = "aoi string, bf_source string, part int, value string"
# Bytes of documents that one batch of a read may reach before it is handed on.
BATCH_BYTES = 4 << 20
_NULL = "__HIVE_DEFAULT_PARTITION__"


def folder(values: tuple) -> str:
    """The folder of a document, named as Spark names partitions."""
    def named(v) -> str:
        return _NULL if v is None or v == "" else re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda c: f"%{ord(c.group()):02X}", str(v))

    return "/".join(f"{k}={named(v)}" for k, v in zip(PLACE, values))


class DocumentWriter(DataSourceArrowWriter):
    """Lines come document by document. A finished document is renamed into place; another attempt of its task replaces it by the same."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = _filesystem(self.path)
        place, sink, hidden = None, None, f"_{uuid.uuid4().hex}"

        def finish() -> None:
            if sink is not None:
                sink.close()
                system.move(f"{root}/{folder(place)}/{hidden}", f"{root}/{folder(place)}/{FILE}")

        try:
            for batch in iterator:
                rows = zip(*[batch.column(c).to_pylist() for c in (*PLACE, "value")])
                for values, run in groupby(rows, itemgetter(0, 1, 2)):
                    if values != place:
                        finish()
                        sink = None
                        system.create_dir(f"{root}/{folder(values)}", recursive=True)
                        place, sink = values, system.open_output_stream(f"{root}/{folder(values)}/{hidden}")
                    sink.write("".join(f"{r[3]}\n" for r in run).encode())
            finish()
        except BaseException:
            if sink is not None:
                sink.close()
            raise
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass


class DocumentSource(DataSource):
    """The format ``documents``, for writing rows of ``DOCUMENTS``, a line each. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options)


def write_documents(lines: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write one file per area, source and part; the lines of a document must be neighbours in one partition and in order."""
    from pyarrow import fs

    if mode not in ("overwrite", "append", "errorifexists", "error"):
        raise ValueError(f"unknown mode {mode!r}")
    system, root = _filesystem(path.rstrip("/"))
    if mode.startswith("error") and system.get_file_info(root).type != fs.FileType.NotFound:
        raise ValueError(f"{path} already exists")
    if mode == "overwrite" and system.get_file_info(root).type != fs.FileType.NotFound:
        system.delete_dir_contents(root)
    lines.sparkSession.dataSource.register(DocumentSource)
    lines.select(*PLACE, "value").write.format("documents").mode("append").save(path)
    return path


def read_documents(areas: DataFrame, path: str) -> DataFrame:
    """The documents of some areas (``aoi``), each one whole: every file in the area's folder. An area without a folder is an error."""
    base = path.rstrip("/")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = _filesystem(base)
        rows, held = [], 0

        def handed() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*PLACE, "value"])

        for batch in batches:
            for aoi in batch.column(0).to_pylist():
                for f in system.get_file_info(fs.FileSelector(f"{root}/{folder((aoi,))}", recursive=True)):
                    if not f.is_file or f.base_name.startswith(("_", ".")):
                        continue
                    source, part = (unquote(v.partition("=")[2]) for v in f.path.split("/")[-3:-1])
                    with system.open_input_file(f.path) as file:
                        text = file.read()
                    rows.append((aoi, None if source == _NULL else source, int(part), text.decode()))
                    held += len(text)
                    if held >= BATCH_BYTES:
                        yield handed()
                        rows, held = [], 0
        if rows:
            yield handed()

    width = int(areas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt first: a short list would else be gathered in one task, which then reads all files
    return areas.select("aoi").repartition(width, "aoi").distinct().mapInArrow(read, DOCUMENTS)
