"""Packing along a space-filling curve: sequences hold documents that are alike.

A document's token ids, log-weighted, are hashed with signs into ``BUCKETS`` dimensions; the vector,
of length one, is projected to ``DIMENSIONS`` numbers by fixed random directions. Each number is
scaled by the mean and deviation over all documents and cut into ``2^BITS`` steps, and the steps'
place on a Hilbert curve is the document's key. Documents are sorted by range of that key, laid end
to end with a separator behind each, and cut every ``capacity`` ids: all sequences are full. What
lies behind the last full one is cut into powers of two, which need no padding, either.

Where a document begins on the line is its task's running sum plus the totals of the ranges before,
so no task holds the line. Ids are made once, kept in two bytes each if that suffices, and move once.

Nulls: a null text counts as empty (one separator); null or repeated document ids are rows like
others, ordered by id within a key and by place in a file within an id. Documents without tokens
have the vector 0. Empty tables give no rows.
"""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packing import CAPACITY, token_ids, tokenizer
from .text import small_batches, written

BUCKETS, DIMENSIONS, BITS = 1024, 4, 15
SEPARATOR = 1
#: For the signs, the buckets and the directions.
SEED = 12


def directions() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((BUCKETS, DIMENSIONS))


def mixed(ids: np.ndarray) -> np.ndarray:
    """A hash of each id."""
    x = (ids.astype(np.uint64) + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def projected(ids: np.ndarray, at: np.ndarray, along: np.ndarray) -> np.ndarray:
    """The projections of the documents whose ids lie between neighbours of ``at``."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    width = int(ids.max(initial=0)) + 1
    pairs, times = np.unique(doc * width + ids, return_counts=True)
    doc, token = np.divmod(pairs, width)
    h = mixed(token)
    signed = np.log1p(times) * np.where(h >> np.uint64(63), -1.0, 1.0)
    cells, inverse = np.unique(doc * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), return_inverse=True)
    values = np.bincount(inverse, signed, len(cells))
    doc, bucket = np.divmod(cells, BUCKETS)
    size = np.sqrt(np.bincount(doc, values * values, n))
    out = np.column_stack([np.bincount(doc, values * along[bucket, k], n) for k in range(DIMENSIONS)])
    return out / np.where(size > 0, size, 1.0)[:, None]


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each row of whole numbers below ``2^bits`` on the Hilbert curve through all of them.

    Axes are turned into the curve's transposed digits, highest first, then the digits are interleaved.
    """
    x = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for k in range(len(x)):
            high = (x[k] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[0]
        bit >>= 1
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    turn, bit = np.zeros(len(cells), np.int64), 1 << (bits - 1)
    while bit > 1:
        turn = np.where((x[-1] & bit) != 0, turn ^ (bit - 1), turn)
        bit >>= 1
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | ((axis ^ turn) >> b & 1)
    return key


def kind_of(tokenizer_path: str) -> str:
    """In how many bytes ids are kept."""
    return "<u2" if tokenizer(tokenizer_path).n_vocab <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, ids, n, c0, c1, ...``: ids with the separator, how many they are, and the projections."""
    along, kind = directions(), kind_of(tokenizer_path)

    def run(batches):
        for batch in small_batches(batches, rows=1000, mb=4):
            ids, at = token_ids(batch["text"], tokenizer_path)
            where = projected(ids.astype(np.int64), at, along)
            whole = np.insert(ids.astype(kind), at[1:], SEPARATOR)
            ends = (at + np.arange(len(at))).astype(np.int64)
            own = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer((ends * whole.itemsize).astype(np.int32).tobytes()), pa.py_buffer(whole.tobytes())])
            columns = [batch["doc_id"], own, pa.array(np.diff(ends)), *[pa.array(c) for c in where.T]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n", *[f"c{k}" for k in range(DIMENSIONS)]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, ids binary, n long, {', '.join(f'c{k} double' for k in range(DIMENSIONS))}")


def steps(scale: list[tuple[float, float]]) -> list[Column]:
    """Each projection as a whole number below ``2^BITS``: four deviations to either side."""
    out = []
    for k, (mean, deviation) in enumerate(scale):
        z = (F.col(f"c{k}") - mean) / (deviation or 1.0)
        out.append(F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), F.floor((z + 4) * (1 << BITS) / 8))).cast("int"))
    return out


def keyed(tokens: DataFrame) -> DataFrame:
    """``tokens`` with its place on the curve as ``curve``."""
    names = [f"c{k}" for k in range(DIMENSIONS)]
    row = tokens.agg(*[f(c).alias(f"{c}_{f.__name__}") for c in names for f in (F.avg, F.stddev_pop)]).first()
    scale = [(row[f"{c}_avg"] or 0.0, row[f"{c}_stddev_pop"] or 0.0) for c in names]

    @F.arrow_udf("long")
    def place(*axes: pa.Array) -> pa.Array:
        return pa.array(hilbert(np.column_stack([a.to_numpy() for a in axes])))

    return tokens.withColumn("curve", place(*steps(scale)))


def laid(tokens: DataFrame) -> DataFrame:
    """``file, row, part, start``: rows in order of the curve; ``start`` counts ids from the first of the range.

    Ids don't move here.
    """
    keys = ["curve", "doc_id", "file", "row"]
    dealt = keyed(tokens).select(*keys, "n").repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches):
        part, begun = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch["n"].to_numpy()
            starts = begun + np.cumsum(sizes) - sizes
            begun += int(sizes.sum())
            columns = [batch["file"], batch["row"], pa.array([part] * len(batch), pa.int32()), pa.array(starts, pa.int64()), batch["n"]]
            yield pa.RecordBatch.from_arrays(columns, ["file", "row", "part", "start", "n"])

    return dealt.mapInArrow(run, "file long, row long, part int, start long, n long")


def rest_of(total: int, capacity: int) -> list[int]:
    """Where the sequences behind the last full one begin, and the line's end: powers of two, falling."""
    edges, left = [total - total % capacity], total % capacity
    while left:
        step = 1 << (left.bit_length() - 1)
        edges.append(edges[-1] + step)
        left -= step
    return edges


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: one row a piece."""
    tokens = written(tokenised(docs, tokenizer_path), "curve-tokens", 1000, 4)
    at = tokens.metadataColumn("_metadata")
    tokens = tokens.select("*", F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("row"))
    line, kind = written(laid(tokens), "curve-line"), kind_of(tokenizer_path)
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = line.groupBy("part").agg(F.sum("n").alias("ids"))
    total = parts.agg(F.sum("ids").alias("n")).first()["n"] or 0
    tail = np.array(rest_of(total, capacity), np.int64)
    # A row a range, whatever the number of documents.
    begins = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("begin"))
    full = total // capacity

    def run(batches):
        for batch in batches:
            out = defaultdict(list)
            for doc_id, ids, at in zip(batch["doc_id"].to_pylist(), batch["ids"], batch["at"].to_pylist(), strict=True):
                own = np.frombuffer(ids.as_buffer(), kind)
                n = len(own)
                begin = at
                while begin < at + n:
                    if begin < tail[0]:
                        sequence, first = begin // capacity, begin - begin % capacity
                        stop = first + capacity
                    else:
                        k = int(np.searchsorted(tail, begin, side="right"))
                        sequence, first, stop = full + k - 1, int(tail[k - 1]), int(tail[k])
                    stop = min(stop, at + n)
                    out["doc_id"].append(doc_id)
                    out["start"].append(begin - at)
                    out["length"].append(stop - begin)
                    out["ids_crc32"].append(zlib.crc32(own[begin - at : stop - at].astype("<u4").tobytes()))
                    out["doc_tokens"].append(n)
                    out["sequence_id"].append(sequence)
                    out["offset"].append(begin - first)
                    begin = stop
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in PIECES], schema=PIECES)

    places = line.join(F.broadcast(begins), F.col("part") == F.col("_part")).select("file", "row", (F.col("start") + F.col("begin")).alias("at"))
    placed = tokens.select("file", "row", "doc_id", "ids").join(places, ["file", "row"]).select("doc_id", "ids", "at")
    return placed.mapInArrow(run, ", ".join(f"{f.name} long" for f in PIECES))


PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def neighbours(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, curve, c0, c1, ...``: where documents lie, for looking at what the curve brings together."""
    tokens = keyed(tokenised(docs, tokenizer_path))
    return tokens.select("doc_id", "curve", *[f"c{k}" for k in range(DIMENSIONS)])
