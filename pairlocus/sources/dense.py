"""Arrays of one number a position, as a data source: ``spark.read.format("dense_array")``.

The file is a NumPy array of one dimension (``.npy``): a short header, then numbers of a fixed width, so the
place of a number is its position and a read is cut anywhere. Rows are ``pos, u``, positions that
have no number (NaN) being left out. A write makes one file: tasks write the stretch from their
first to their last position, the commit puts the stretches behind each other with NaN between
them and gives the file its name; until then nothing has it.
"""

import ast
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .blocks import located

MAGIC = b"\x93NUMPY"
SCHEMA = "pos long, u double"
#: Numbers of a partition, of a batch, and of a stretch that is filled at a time.
SPLIT, BATCH, FILL = 1 << 22, 1 << 16, 1 << 20


def header_of(f) -> tuple[int, np.dtype, int]:
    """Where the numbers begin, their type, and how many they are."""
    head = f.read(10)
    if head[:6] != MAGIC:
        raise ValueError("not a NumPy array")
    if head[6] == 1:
        size, at = struct.unpack("<H", head[8:10])[0], 10
    else:
        size, at = struct.unpack("<I", head[8:10] + f.read(2))[0], 12
    about = ast.literal_eval(f.read(size).decode("latin1"))
    kind = np.dtype(about["descr"])
    if len(about["shape"]) != 1 or kind.hasobject or kind.kind not in "fiu":
        raise ValueError(f"not an array of one number a position: {about}")
    return at + size, kind, about["shape"][0]


def header_bytes(length: int) -> bytes:
    text = f"{{'descr': '<f8', 'fortran_order': False, 'shape': ({length},), }}"
    pad = -(len(text) + 11) % 64
    return MAGIC + b"\x01\x00" + struct.pack("<H", len(text) + pad + 1) + text.encode() + b" " * pad + b"\n"


@dataclass
class Stretch(InputPartition):
    start: int
    stop: int


class DenseReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[Stretch]:
        fs, place = located(self.path)
        with fs.open_input_file(place) as f:
            _, _, length = header_of(f)
        return [Stretch(a, min(a + self.split, length)) for a in range(0, length, self.split)] or [Stretch(0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        fs, place = located(self.path)
        with fs.open_input_file(place) as f:
            begin, kind, _ = header_of(f)
            f.seek(begin + partition.start * kind.itemsize)
            for at in range(partition.start, partition.stop, BATCH):
                n = min(BATCH, partition.stop - at)
                values = np.frombuffer(f.read(n * kind.itemsize), kind).astype(float)
                if len(values) < n:
                    raise ValueError(f"{self.path} ends before its numbers do")
                known = np.flatnonzero(~np.isnan(values))
                yield pa.RecordBatch.from_arrays([pa.array(at + known), pa.array(values[known])], ["pos", "u"])


@dataclass
class Written(WriterCommitMessage):
    start: int
    stop: int
    path: str


class DenseWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.length = options["path"], overwrite, int(options.get("length", 0))
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"
        fs, place = located(self.path)
        if not overwrite and fs.get_file_info(place).type != pafs.FileType.NotFound:
            raise ValueError(f"{self.path} is there already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows come in order of position; a position that comes twice fails."""
        context = TaskContext.get()
        fs, folder = located(self.parts)
        fs.create_dir(folder)
        place = f"{folder}/{context.partitionId():08d}-{context.taskAttemptId()}"
        start = stop = None
        with fs.open_output_stream(place) as out:
            for batch in iterator:
                pos, u = batch["pos"].to_numpy(), batch["u"].to_numpy(zero_copy_only=False).astype("<f8")
                if not len(pos):
                    continue
                if start is None:
                    start = stop = int(pos[0])
                if start < 0 or pos[0] < stop or (np.diff(pos) <= 0).any():
                    raise ValueError("a position is there twice, or below 0")
                for low in range(0, len(pos), BATCH):
                    at, values = pos[low : low + BATCH], u[low : low + BATCH]
                    edges = np.flatnonzero(np.diff(at) > 1) + 1
                    for a, b in zip([0, *edges], [*edges, len(at)], strict=True):  # runs of positions
                        filled(out, int(at[a]) - stop)
                        out.write(values[a:b].tobytes())
                        stop = int(at[b - 1]) + 1
        return Written(start or 0, stop or 0, place)

    def commit(self, messages: list[Written | None]) -> None:
        fs, place = located(self.path)
        parts = sorted((m for m in messages if m is not None and m.stop > m.start), key=lambda m: m.start)
        length = max([self.length, *(m.stop for m in parts)])
        whole = f"{located(self.parts)[1]}/whole"
        fs.create_dir(located(self.parts)[1])
        at = 0
        with fs.open_output_stream(whole) as out:
            out.write(header_bytes(length))
            for m in parts:
                if m.start < at:
                    raise ValueError("stretches overlap: write rows that are dealt by range of position")
                filled(out, m.start - at)
                with fs.open_input_stream(m.path) as part:
                    while data := part.read(1 << 22):
                        out.write(data)
                at = m.stop
            filled(out, length - at)
        if self.overwrite and fs.get_file_info(place).type == pafs.FileType.File:
            fs.delete_file(place)
        fs.move(whole, place)
        fs.delete_dir(located(self.parts)[1])

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = located(self.parts)
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


def filled(out, count: int) -> None:
    """Write so many positions without a number."""
    while count > 0:
        n = min(count, FILL)
        out.write(np.full(n, np.nan, "<f8").tobytes())
        count -= n


class DenseArray(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dense_array"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DenseReader:
        return DenseReader(self.options)

    def writer(self, schema, overwrite: bool) -> DenseWriter:
        return DenseWriter(self.options, overwrite)


def read_dense(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """``pos, u`` of an array, for the positions that have a number."""
    spark.dataSource.register(DenseArray)
    return spark.read.format("dense_array").option("split", split).load(path)


def write_dense(rates: DataFrame, path: str, length: int = 0, overwrite: bool = False) -> None:
    """One array of ``rates(pos, u)``, of at least ``length`` positions."""
    rates.sparkSession.dataSource.register(DenseArray)
    ordered = rates.select(rates["pos"].cast("long").alias("pos"), rates["u"].cast("double").alias("u")).repartitionByRange("pos").sortWithinPartitions("pos")
    ordered.write.format("dense_array").option("length", length).mode("overwrite" if overwrite else "append").save(path)
