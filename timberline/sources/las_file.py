"""Point clouds in uncompressed LAS files (public layout, versions 1.2 to 1.4), read in parallel ranges.

``spark.dataSource.register(LasSource)`` then ``spark.read.format("las").load(path)``, or ``read_las``.
Each task reads one range of records, so a file of any size is never loaded whole. Paths are local to all
workers or URIs of a shared file system.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from glob import glob
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

RECORDS_PER_TASK = 1_000_000
SCHEMA = "point_id bigint, X double, Y double, Z double, Intensity int, ReturnNumber int, Classification int, gps_time double, R int, G int, B int"
# Offset of GPS time and of the colours in each point format; -1 where it has none.
_GPS = {0: -1, 1: 20, 2: -1, 3: 20, 6: 22, 7: 22, 8: 22}
_RGB = {0: -1, 1: -1, 2: 20, 3: 28, 6: -1, 7: 30, 8: 30}


def _open(path: str):
    """A file to seek in: of a local path, or of any URI that Arrow has a file system for."""
    if "://" not in path:
        return open(path, "rb")
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def find_files(path: str) -> list[str]:
    """The .las files of a folder, of a pattern (local only), or the file itself, in order of name."""
    if "://" not in path:
        return sorted(str(p) for p in Path(path).rglob("*.las")) if Path(path).is_dir() else sorted(glob(path))
    system, inner = fs.FileSystem.from_uri(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        found = [f.path for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(".las")]
    else:
        found = [inner] if info.type == fs.FileType.File else []
    # paths inside the file system get back what the URI had in front of them
    head = path[: path.rstrip("/").rindex(inner.rstrip("/"))] if inner.rstrip("/") in path else path.split("://")[0] + "://"
    return sorted(head + f for f in found)


def read_header(path: str) -> dict:
    with _open(path) as f:
        h = f.read(375)
    if h[:4] != b"LASF":
        raise ValueError(f"{path} is no LAS file")
    minor = h[25]
    offset, form, size, legacy = struct.unpack_from("<I", h, 96)[0], h[104], struct.unpack_from("<H", h, 105)[0], struct.unpack_from("<I", h, 107)[0]
    if form & 0x80:
        raise ValueError(f"{path} is compressed; only uncompressed LAS can be read")
    if form not in _GPS:
        raise ValueError(f"{path}: point format {form} isn't supported")
    n = struct.unpack_from("<Q", h, 247)[0] if minor >= 4 else legacy
    return {"offset": offset, "format": form, "size": size, "n": n or legacy, "scale": struct.unpack_from("<3d", h, 131), "shift": struct.unpack_from("<3d", h, 155)}


def decode(data: bytes, head: dict, first: int) -> pa.RecordBatch:
    size, form = head["size"], head["format"]
    raw = np.frombuffer(data, np.uint8).reshape(-1, size)
    n = len(raw)
    field = lambda at, kind: np.ascontiguousarray(raw[:, at : at + np.dtype(kind).itemsize]).view(kind).ravel()
    cols = [pa.array(np.arange(first, first + n, dtype=np.int64))]
    for i in range(3):
        cols.append(pa.array(field(4 * i, "<i4") * head["scale"][i] + head["shift"][i]))
    new = form >= 6
    cols.append(pa.array(field(12, "<u2").astype(np.int32)))
    cols.append(pa.array((raw[:, 14] & (15 if new else 7)).astype(np.int32)))
    cols.append(pa.array((raw[:, 16] if new else raw[:, 15] & 31).astype(np.int32)))
    cols.append(pa.array(field(_GPS[form], "<f8")) if _GPS[form] >= 0 else pa.nulls(n, pa.float64()))
    for i in range(3):
        cols.append(pa.array(field(_RGB[form] + 2 * i, "<u2").astype(np.int32)) if _RGB[form] >= 0 else pa.nulls(n, pa.int32()))
    return pa.RecordBatch.from_arrays(cols, names=[c.strip().split(" ")[0] for c in SCHEMA.split(",")])


class _Range(InputPartition):
    def __init__(self, path: str, first: int, count: int, id_from: int):
        self.path, self.first, self.count, self.id_from = path, first, count, id_from


class _Reader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.files = find_files(path)
        if not self.files:
            raise ValueError(f"no LAS file at {path}")
        self.per_task = per_task

    def partitions(self) -> list[_Range]:
        out, ids = [], 0
        for f in self.files:
            n = read_header(f)["n"]
            out += [_Range(f, a, min(self.per_task, n - a), ids + a) for a in range(0, n, self.per_task)]
            ids += n
        return out or [_Range(self.files[0], 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        head = read_header(partition.path)
        with _open(partition.path) as f:
            f.seek(head["offset"] + partition.first * head["size"])
            left, at = partition.count, partition.id_from
            while left > 0:
                n = min(left, 65_536)
                yield decode(f.read(n * head["size"]), head, at)
                left, at = left - n, at + n


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("recordsPerTask", RECORDS_PER_TASK)))


def read_las(spark: SparkSession, path: str, columns: list[str] | None = None, records_per_task: int = RECORDS_PER_TASK) -> DataFrame:
    """Points of a file, a pattern or a folder; point_id counts records over the files in order of name."""
    spark.dataSource.register(LasSource)
    df = spark.read.format("las").option("recordsPerTask", str(records_per_task)).load(path)
    return df.select(*columns) if columns else df


def write_las(path: str, x: np.ndarray, y: np.ndarray, z: np.ndarray, classification: np.ndarray | None = None, scale: float = 0.001) -> None:
    """A small LAS 1.2 file of format 0 on the driver, for exchange and tests."""
    n = len(x)
    rec = np.zeros(n, np.dtype([("xyz", "<i4", 3), ("i", "<u2"), ("r", "u1"), ("c", "u1"), ("rest", "u1", 4)]))
    for k, v in enumerate((x, y, z)):
        rec["xyz"][:, k] = np.round(np.asarray(v) / scale)
    rec["r"] = 9
    rec["c"] = 0 if classification is None else classification
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<H", head, 94, 227)
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<BHI", head, 104, 0, 20, n)
    struct.pack_into("<6d", head, 131, scale, scale, scale, 0, 0, 0)
    Path(path).write_bytes(bytes(head) + rec.tobytes())
