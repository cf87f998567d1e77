"""Data source for raw interleaved captures: byte ranges of a file are partitions of their own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

PAIR = 8  # bytes of one float32 I/Q pair
SCHEMA = "path string, chunk_no bigint, i array<float>, q array<float>"


class Range(InputPartition):
    """Chunks [first, last) of a file with `pairs` I/Q pairs."""

    def __init__(self, path: str, first: int, last: int, pairs: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last, self.pairs = path, first, last, pairs


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.chunk = int(options.get("chunk", 4096))
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", 64 << 20)))
        self.low, self.high, self.names = 0, 1 << 62, None  # wanted chunks and files

    def pushFilters(self, filters: list[Filter]):
        """Bounds of chunk_no and names of files are used; Spark keeps everything else."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("chunk_no",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            elif column == ("path",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = wanted if self.names is None else self.names & wanted
            else:
                yield f

    def partitions(self) -> list[Range]:
        system, root = fs.FileSystem.from_uri(self.root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        step = max(1, self.bytes // (PAIR * self.chunk))
        out = []
        for info in sorted(found, key=lambda x: x.path):
            if info.type != fs.FileType.File or info.base_name.startswith(("_", ".")):
                continue
            name = info.path[len(root):].lstrip("/") or info.base_name
            if self.names is not None and name not in self.names:
                continue
            if info.size % PAIR:
                raise ValueError(f"{info.path} does not hold whole I/Q pairs")
            pairs = info.size // PAIR
            last = min(-(-pairs // self.chunk), self.high)
            out += [Range(name, k, min(k + step, last), pairs) for k in range(self.low, last, step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range):
        if partition.first >= partition.last:
            return
        system, root = fs.FileSystem.from_uri(self.root)
        at = root if system.get_file_info(root).type == fs.FileType.File else f"{root.rstrip('/')}/{partition.path}"
        with system.open_input_file(at) as f:
            for first in range(partition.first, partition.last, 256):
                start, stop = first * self.chunk, min(min(first + 256, partition.last) * self.chunk, partition.pairs)
                pairs = np.frombuffer(f.read_at((stop - start) * PAIR, start * PAIR), "<f4").reshape(-1, 2)
                edges = pa.array(np.append(np.arange(0, len(pairs), self.chunk), len(pairs)).astype(np.int32))
                rows = len(edges) - 1
                lists = [pa.ListArray.from_arrays(edges, pa.array(np.ascontiguousarray(pairs[:, side]))) for side in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * rows), pa.array(first + np.arange(rows)), *lists], names=["path", "chunk_no", "i", "q"])


class CaptureSource(DataSource):
    """spark.read.format("interleaved_iq").option("chunk", n).load(folder or file) -> (path, chunk_no, i, q).

    `path` is relative to the folder. Files are little-endian float32 pairs; one of any length is read by
    as many tasks as it has stretches of `partitionBytes`. Conditions on chunk_no and path decide which
    stretches are opened. The folder must be visible to driver and executors; any URI pyarrow.fs knows.
    """

    @classmethod
    def name(cls) -> str:
        return "interleaved_iq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(dict(self.options))


def read_captures(spark: SparkSession, path: str, chunk: int = 4096, partition_bytes: int = 64 << 20) -> DataFrame:
    spark.dataSource.register(CaptureSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("interleaved_iq").option("chunk", chunk).option("partitionBytes", partition_bytes).load(path)


def write_capture(folder: str, name: str, i: np.ndarray, q: np.ndarray) -> None:
    """One raw file of interleaved pairs; a repeated task writes the same bytes again."""
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{name}") as out:
        out.write(np.column_stack([i, q]).astype("<f4").tobytes())
