"""Reader and writer of the uncompressed column file, as a Python data source.

Layout, little-endian: int64 size of the footer; batches, each an int64 offset per column and then the columns; the footer: names, type
names, int64 offsets of the batches. Numbers are raw; a string ends in 0x1F, as does a name; a list of names ends in 0x1E.
Parquet is the store to use; this source exists to read and leave files of the old layout. One batch is one Spark partition.
"""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from marlstone.types import make_schema, to_logical_name

#: Fixed values of the layout.
CELL_END, LIST_END = b"\x1f", b"\x1e"
WIDTHS = {"int16": "<i2", "int32": "<i4", "int64": "<i8", "DATE": "<i4", "TIMESTAMP": "<i8", "double": "<f8"}

_EPOCH = dt.datetime(1970, 1, 1)


def _open(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path)
    else:
        system, inner = fs.LocalFileSystem(), path
    return system.open_input_file(inner)


def read_footer(path: str) -> tuple[list[str], list[str], list[int], int]:
    """Names, type names, batch offsets and the place where the footer begins."""
    with _open(path) as f:
        total = f.size()
        (size,) = struct.unpack("<q", f.read_at(8, 0))
        start = total - size
        if size <= 0 or start < 8:
            raise ValueError(f"{path}: no footer")
        footer = f.read_at(size, start)
    names, _, rest = footer.partition(LIST_END)
    kinds, _, offsets = rest.partition(LIST_END)
    split = lambda b: [x.decode() for x in b.split(CELL_END)[:-1]]
    return split(names), split(kinds), np.frombuffer(offsets, "<i8").tolist(), start


def read_batch(path: str, kinds: list[str], wanted: list[int], offset: int, end: int) -> list[pa.Array]:
    with _open(path) as f:
        starts = [*np.frombuffer(f.read_at(8 * len(kinds), offset), "<i8").tolist(), end]
        out = []
        for i in wanted:
            data = f.read_at(starts[i + 1] - starts[i], starts[i])
            if kinds[i] == "string":
                out.append(pa.array([x.decode() for x in data.split(CELL_END)[:-1]], pa.string()))
            else:
                numbers = np.frombuffer(data, WIDTHS[kinds[i]])
                cast = {"DATE": pa.date32(), "TIMESTAMP": pa.timestamp("s")}.get(kinds[i])
                array = pa.array(numbers)
                out.append(array.cast(cast).cast(pa.timestamp("us")) if kinds[i] == "TIMESTAMP" else array.cast(cast) if cast else array)
    return out


class _Part(InputPartition):
    def __init__(self, offset: int, end: int):
        self.offset, self.end = offset, end


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.names = path, schema.names
        self.all_names, self.kinds, self.offsets, self.footer = read_footer(path)

    def partitions(self):
        bounds = [*self.offsets, self.footer]
        return [_Part(a, b) for a, b in zip(bounds, bounds[1:])] or [_Part(-1, -1)]  # noqa: B905

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if partition.offset < 0:
            return
        wanted = [self.all_names.index(n) for n in self.names]
        yield pa.RecordBatch.from_arrays(read_batch(self.path, self.kinds, wanted, partition.offset, partition.end), names=list(self.names))


class ColumnFileSource(DataSource):
    """``spark.read.format("column_file").option("columns", "a,b").load(path)``; columns come in file order."""

    @classmethod
    def name(cls) -> str:
        return "column_file"

    def schema(self) -> T.StructType:
        names, kinds, _, _ = read_footer(self.options["path"])
        whole = make_schema(names, kinds)
        wanted = [c for c in self.options.get("columns", "").split(",") if c]
        if unknown := [c for c in wanted if c not in names]:
            raise ValueError(f"no column {', '.join(unknown)}")
        return T.StructType([f for f in whole.fields if not wanted or f.name in wanted])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)


def read_column_file(spark: SparkSession, path: str, names: list[str] | tuple[str, ...] = ()) -> DataFrame:
    spark.dataSource.register(ColumnFileSource)
    return spark.read.format("column_file").option("columns", ",".join(names)).load(path)


def _payload(values: list, kind: str) -> bytes:
    if any(v is None for v in values):
        raise ValueError("the layout has no NULL")
    if kind == "string":
        encoded = [v.encode() for v in values]
        if any(CELL_END in v for v in encoded):
            raise ValueError("a string holds the byte 0x1F, which ends a cell in this layout")
        return b"".join(v + CELL_END for v in encoded)
    if kind == "DATE":
        values = [(v - _EPOCH.date()).days for v in values]
    elif kind == "TIMESTAMP":
        values = [int((v - _EPOCH).total_seconds() // 1) for v in values]
    return np.array(values, WIDTHS[kind]).tobytes()


def write_column_file(df: DataFrame, path: str, batch_rows: int = 500_000) -> None:
    """A single local file, written by the driver batch by batch as rows stream in. For exports to old readers; the layout is not distributable."""
    kinds = [to_logical_name(f.dataType) for f in df.schema.fields]
    if bad := [k for k in kinds if k != "string" and k not in WIDTHS]:
        raise ValueError(f"the layout cannot hold {', '.join(bad)}")
    offsets: list[int] = []
    with open(path, "wb") as out:
        out.write(struct.pack("<q", 0))

        def flush(rows: list) -> None:
            columns = [_payload([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            begin = out.tell()
            offsets.append(begin)
            at = begin + 8 * len(kinds)
            starts = []
            for c in columns:
                starts.append(at)
                at += len(c)
            out.write(struct.pack(f"<{len(starts)}q", *starts))
            out.writelines(columns)

        rows: list = []
        for row in df.toLocalIterator():
            rows.append(row)
            if len(rows) == batch_rows:
                flush(rows)
                rows = []
        if rows:
            flush(rows)
        footer = b"".join(n.encode() + CELL_END for n in df.columns) + LIST_END + b"".join(k.encode() + CELL_END for k in kinds) + LIST_END + struct.pack(f"<{len(offsets)}q", *offsets)
        out.write(footer)
        out.seek(0)
        out.write(struct.pack("<q", len(footer)))
