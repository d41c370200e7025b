"""Block-gzipped text by chromosome and position, as a data source: ``spark.read.format("block_gzip")``.

Such a file is a row of gzip members of at most 64 KB of text, each of which tells its own length,
so it can be read from any member on. A read is cut into partitions by compressed bytes; a
partition looks for the first member that begins in its range, leaves out the line that it finds
begun, and finishes the one that it has begun. Rows are ``chrom, pos, value``: the first two fields
(positions from 0) and the whole line; header lines have neither.

Filters on ``chrom`` and ``pos`` are pushed down: where an index lies beside the file (``.csi`` or
``.tbi``) only members that may hold such positions are read. Spark filters again, so an
index only saves work.

A write makes one file with its header once. Tasks write their rows' members into files of their
own, in the order of the partitions; the commit puts them behind each other, adds the index and
gives the file its name. Until then nothing has that name, and a failed write leaves nothing.
"""

import gzip
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

#: The start of a member: gzip with one extra field, BC, of two bytes. Fixed values.
MAGIC, EXTRA = b"\x1f\x8b\x08\x04", b"\x06\x00BC\x02\x00"
#: The member without text that ends a file. A fixed value.
LAST = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Text in a member at most, and the bytes of a member at most.
TEXT, MEMBER = 65_280, 1 << 16
#: Bytes of a partition, and lines of a batch.
SPLIT, LINES = 32 << 20, 4096
SCHEMA = "chrom string, pos long, value string"
ARROW = pa.schema([("chrom", pa.string()), ("pos", pa.int64()), ("value", pa.string())])


def located(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def member(text: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(text) + deflate.flush()
    size = len(body) + 26
    head = MAGIC + bytes(4) + b"\x00\xff" + EXTRA + struct.pack("<H", size - 1)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


def member_size(head: bytes) -> int:
    """Bytes of the member that begins with ``head``; 0 if none does."""
    if len(head) < 18 or head[:4] != MAGIC or head[10:16] != EXTRA:
        return 0
    return struct.unpack("<H", head[16:18])[0] + 1


def is_blocked(path: str) -> bool:
    """Whether a file (not a folder) begins as a block-gzipped one does."""
    fs, place = located(path)
    if fs.get_file_info(place).type != pafs.FileType.File:
        return False
    with fs.open_input_file(place) as f:
        return member_size(f.read(18)) > 0


def first_member(f, at: int, size: int) -> int:
    """Where the first member from ``at`` on begins: what looks like one, and is followed by one or the end."""
    while at < size:
        f.seek(at)
        window = f.read(2 * MEMBER + 18)
        here = window.find(MAGIC)
        while here >= 0:
            length = member_size(window[here : here + 18])
            after = at + here + length
            if length and (after == size or member_size(window[here + length : here + length + 18])):
                return at + here
            here = window.find(MAGIC, here + 1)
        at += MEMBER
    return size


@dataclass(frozen=True)
class Range:
    """Members that begin from ``start`` to before ``stop``; whether the first line begins with the first of them."""

    start: int
    stop: int
    whole: bool


@dataclass
class Part(InputPartition):
    ranges: tuple[Range, ...]


# Indices


@dataclass(frozen=True)
class Index:
    """By chromosome the bins (number to chunks of virtual offsets) of a binning of given shift and depth."""

    shift: int
    depth: int
    bins: dict[str, dict[int, list[tuple[int, int]]]]

    def chunks(self, chrom: str, low: int, high: int) -> list[tuple[int, int]]:
        """Stretches of the file that may hold positions from ``low`` to before ``high``."""
        own = self.bins.get(chrom, {})
        span = 1 << (self.shift + 3 * self.depth)
        low, last = min(max(low, 0), span - 1), min(max(high, low + 1, 1), span) - 1
        found = []
        for level in range(self.depth + 1):
            first, shift = ((1 << 3 * level) - 1) // 7, self.shift + 3 * (self.depth - level)
            a, b = first + (low >> shift), first + (last >> shift)
            found += [c for k, chunks in own.items() if a <= k <= b for c in chunks]
        return sorted(found)


def bin_of(low: int, last: int, shift: int, depth: int) -> int:
    """The smallest bin that holds positions ``low`` to ``last``."""
    for level in range(depth, 0, -1):
        by = shift + 3 * (depth - level)
        if low >> by == last >> by:
            return ((1 << 3 * level) - 1) // 7 + (low >> by)
    return 0


def read_index(data: bytes) -> Index:
    """A ``.tbi`` or ``.csi`` file."""
    raw, at = gzip.decompress(data), 0

    def take(form: str):
        nonlocal at
        values = struct.unpack_from("<" + form, raw, at)
        at += struct.calcsize("<" + form)
        return values

    kind = raw[:4]
    at = 4
    if kind == b"TBI\x01":
        (count, *_, length) = take("8i")
        names, shift, depth = raw[at : at + length], 14, 5
        at += length
    elif kind == b"CSI\x01":
        shift, depth, extra = take("3i")
        names = raw[at + 28 : at + 28 + struct.unpack_from("<i", raw, at + 24)[0]]
        at += extra
        (count,) = take("i")
    else:
        raise ValueError("neither a .tbi nor a .csi index")
    largest = ((1 << 3 * (depth + 1)) - 1) // 7
    out = {}
    for name in names.decode().split("\0")[:count]:
        own = out.setdefault(name, {})
        (bins,) = take("i")
        for _ in range(bins):
            number, *_, chunks = take("Ii" if kind == b"TBI\x01" else "IQi")
            found = [take("QQ") for _ in range(chunks)]
            if number < largest:  # beyond are counts, not places
                own[number] = found
        if kind == b"TBI\x01":
            (windows,) = take("i")
            at += 8 * windows
    return Index(shift, depth, out)


def index_bytes(spans: Sequence[tuple[str, int, int, int, int]], shift: int = 14) -> bytes:
    """A ``.csi`` index of ``chrom, first and last position, start and end`` of stretches of the file, in order."""
    names = list(dict.fromkeys(s[0] for s in spans))
    top, depth = max((s[2] for s in spans), default=0) + 1, 5
    while top > 1 << (shift + 3 * depth):
        depth += 1
    text = "".join(n + "\0" for n in names).encode()
    aux = struct.pack("<7i", 2, 1, 2, 0, ord("#"), 0, len(text)) + text
    out = b"CSI\x01" + struct.pack("<3i", shift, depth, len(aux)) + aux + struct.pack("<i", len(names))
    for name in names:
        bins: dict[int, list[tuple[int, int]]] = {}
        for chrom, low, last, start, end in spans:
            if chrom == name:
                bins.setdefault(bin_of(low, last, shift, depth), []).append((start << 16, end << 16))
        out += struct.pack("<i", len(bins))
        for number, chunks in sorted(bins.items()):
            out += struct.pack("<IQi", number, chunks[0][0], len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
    return b"".join(member(out[i : i + TEXT]) for i in range(0, len(out), TEXT)) + LAST


# Reading


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.chroms: set[str] | None = None
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("chrom",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.chroms = asked if self.chroms is None else self.chroms & asked
            elif getattr(f, "attribute", None) == ("pos",):
                if isinstance(f, (GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, f.value)
                if isinstance(f, GreaterThan):
                    self.low = max(self.low, f.value + 1)
                if isinstance(f, LessThan):
                    self.high = min(self.high, f.value)
                if isinstance(f, (LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, f.value + 1)
            yield f  # an index only tells where not to look

    def index(self) -> Index | None:
        fs, place = located(self.path)
        for end in (".csi", ".tbi"):
            if fs.get_file_info(place + end).type == pafs.FileType.File:
                with fs.open_input_file(place + end) as f:
                    return read_index(f.read())
        return None

    def partitions(self) -> list[Part]:
        fs, place = located(self.path)
        size = fs.get_file_info(place).size
        index = self.index() if self.chroms is not None else None
        if index is None:
            return [Part((Range(a, min(a + self.split, size), a == 0),)) for a in range(0, size, self.split)] or [Part(())]
        joined: list[list] = []
        for start, end in sorted({c for chrom in self.chroms for c in index.chunks(chrom, self.low, self.high)}):
            # A line begins where a chunk does, in a member or with it; the chunk may end within one.
            stop = (end >> 16) + (1 if end & 0xFFFF else 0)
            if joined and start >> 16 <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], stop)
            else:
                joined.append([start >> 16, stop, start & 0xFFFF == 0])
        ranges = [Range(a, min(a + self.split, stop), whole and a == start) for start, stop, whole in joined for a in range(start, stop, self.split)]
        return [Part((r,)) for r in ranges] or [Part(())]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        for r in partition.ranges:
            lines: list[bytes] = []
            for line in self.lines(r):
                lines.append(line)
                if len(lines) == LINES:
                    yield batch_of(lines)
                    lines = []
            if lines:
                yield batch_of(lines)

    def lines(self, r: Range) -> Iterator[bytes]:
        fs, place = located(self.path)
        with fs.open_input_file(place) as f:
            size = f.size()
            at = first_member(f, r.start, size)
            rest, begun = b"", r.whole
            while at < size:
                f.seek(at)
                head = f.read(18)
                length = member_size(head)
                if not length:
                    raise ValueError(f"no member at byte {at} of {self.path}")
                inside = at < r.stop
                text = zlib.decompress(head + f.read(length - 18), 31)
                at += length
                if not begun:
                    # The line that goes on here is another range's.
                    cut = text.find(b"\n")
                    if not inside and text:
                        return
                    if cut < 0:
                        continue
                    text, begun = text[cut + 1 :], True
                elif not inside:
                    # The line that began in the range, or begins with what follows it, is finished.
                    cut = text.find(b"\n")
                    rest += text if cut < 0 else text[:cut]
                    if cut >= 0:
                        if rest:
                            yield rest.rstrip(b"\r")
                        return
                    continue
                *whole, rest = (rest + text).split(b"\n")
                yield from (line.rstrip(b"\r") for line in whole if line)
            if rest:
                yield rest.rstrip(b"\r")


def batch_of(lines: list[bytes]) -> pa.RecordBatch:
    chroms, places = [], []
    for line in lines:
        fields = line.split(b"\t", 2) if not line.startswith(b"#") else ()
        known = len(fields) > 1
        chroms.append(fields[0].decode() if known else None)
        places.append(int(fields[1]) - 1 if known else None)
    return pa.RecordBatch.from_arrays([pa.array(chroms, pa.string()), pa.array(places, pa.int64()), pa.array([line.decode() for line in lines], pa.string())], schema=ARROW)


# Writing


@dataclass
class Written(WriterCommitMessage):
    """A task's file, and ``chrom, first and last position, start and end`` of its stretches."""

    partition: int
    path: str
    spans: list[tuple[str, int, int, int, int]]


class BlockWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.header, self.overwrite = options["path"], options.get("header", ""), overwrite
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"
        fs, place = located(self.path)
        if not overwrite and fs.get_file_info(place).type != pafs.FileType.NotFound:
            raise ValueError(f"{self.path} is there already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        fs, folder = located(self.parts)
        fs.create_dir(folder)
        place = f"{folder}/{context.partitionId():08d}-{context.taskAttemptId()}"
        spans, at = [], 0
        with fs.open_output_stream(place) as out:

            def close(text: bytes, chrom: str | None, low: int, last: int) -> None:
                nonlocal at
                start = at
                for i in range(0, len(text), TEXT):
                    m = member(text[i : i + TEXT])
                    out.write(m)
                    at += len(m)
                if chrom is not None:
                    spans.append((chrom, low, last, start, at))

            text, chrom, low, last = bytearray(), None, 0, 0
            for batch in iterator:
                for c, p, line in zip(*(batch[n].to_pylist() for n in ("chrom", "pos", "value")), strict=True):
                    data = line.encode() + b"\n"
                    if text and (c != chrom or len(text) + len(data) > TEXT):
                        close(bytes(text), chrom, low, last)
                        text.clear()
                    if not text:
                        chrom, low, last = c, p, p
                    low, last = min(low, p), max(last, p)
                    text += data
            if text:
                close(bytes(text), chrom, low, last)
        return Written(context.partitionId(), place, spans)

    def commit(self, messages: list[Written | None]) -> None:
        fs, place = located(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        spans, whole = [], f"{located(self.parts)[1]}/whole"
        fs.create_dir(located(self.parts)[1])
        with fs.open_output_stream(whole) as out:
            head = self.header.encode()
            head += b"\n" if head and not head.endswith(b"\n") else b""
            first = b"".join(member(head[i : i + TEXT]) for i in range(0, len(head), TEXT))
            out.write(first)
            at = len(first)
            for m in parts:
                spans += [(c, low, last, start + at, end + at) for c, low, last, start, end in m.spans]
                with fs.open_input_stream(m.path) as part:
                    while data := part.read(1 << 22):
                        out.write(data)
                        at += len(data)
            out.write(LAST)
        with fs.open_output_stream(whole + ".csi") as out:
            out.write(index_bytes(spans))
        # The file comes last: what has its name is whole.
        for end in (".csi", ""):
            if self.overwrite and fs.get_file_info(place + end).type == pafs.FileType.File:
                fs.delete_file(place + end)
            fs.move(whole + end, place + end)
        fs.delete_dir(located(self.parts)[1])

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = located(self.parts)
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class BlockGzip(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_gzip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options)

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(self.options, overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session with the source, and with filters pushed to it."""
    spark.dataSource.register(BlockGzip)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_blocks(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """``chrom, pos, value`` of a block-gzipped file."""
    return registered(spark).read.format("block_gzip").option("split", split).load(path)


def write_blocks(rows: DataFrame, path: str, header: str = "", overwrite: bool = False) -> None:
    """One block-gzipped file of ``rows(chrom, pos, value)``, in order of chromosome and position, and its index."""
    ordered = rows.select("chrom", "pos", "value").repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos")
    registered(rows.sparkSession)
    ordered.write.format("block_gzip").option("header", header).mode("overwrite" if overwrite else "append").save(path)
