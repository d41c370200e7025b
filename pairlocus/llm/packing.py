"""Best-fit packing of token sequences with large-item matching.

Documents are tokenised, end with a separator and are cut only where longer than a sequence.
Lengths are whole numbers up to the capacity, so the packing is planned on the histogram of
lengths (at most ``capacity`` rows, whatever the number of documents): bins are kept as kinds
with multiplicities. Pieces above a third of the capacity pair greedily, each length from the
longest down with the longest that still fits, at most two a bin; smaller pieces, longest
first, go to the fullest bins that hold them, and what fits nowhere opens new bins. The plan
is a list of runs of ranks within a length; a piece's rank within its length, which Spark
counts in salted groups, gives its sequence and offset.

Nulls: a null text counts as empty (one separator); null or repeated document ids are rows
like others. Empty tables give no rows.
"""

import bisect
import functools
import json
import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import small_batches, written

CAPACITY = 2048
#: White space before a space, or a space at the start: tokens may reach across the cut there.
SPACED = r"(?:^ |[\s\v\pZ\x{1c}-\x{1f}\x{85}] )"
#: A stretch that is empty or ends in white space.
LOOSE = r"(?:^|[\s\v\pZ\x{1c}-\x{1f}\x{85}])$"


#: How the byte-level model cuts a text before it merges. A fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """The byte-level BPE of a tokenizers file, whose ids are its merge ranks.

    It is run by tiktoken, which gives the same ids and has no per-call records of offsets.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    cut, merges = model["pre_tokenizer"] or {}, model["model"]
    if (
        model["normalizer"] is not None
        or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) != ("ByteLevel", False, True)
        or merges["type"] != "BPE"
        or any(merges.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in model["added_tokens"])
    ):
        raise ValueError(f"not a plain byte-level BPE file: {path}")
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(model, text: str) -> np.ndarray:
    """Ids of a text; special strings in it are special ids, as in the file's library."""
    return model.encode_to_numpy(text, allowed_special="all").astype(np.uint32)


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> np.ndarray:
    """Bytes of each token."""
    model = tokenizer(path)
    sizes = np.zeros(model.n_vocab, np.int64)
    for token in range(model.n_vocab):
        try:
            sizes[token] = len(model.decode_single_token_bytes(token))
        except KeyError:
            continue
    return sizes


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in a row, and where each text begins in them.

    A byte-level model never joins what ends before a single space with what follows, so the
    distinct stretches between spaces are encoded once, in one call, and told apart again by
    their bytes. Stretches that end in white space, and texts with white space before a space,
    are encoded alone.
    """
    model, sizes = tokenizer(path), token_bytes(path)
    words = pc.split_pattern(texts, " ")
    offsets = words.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    coded = words.flatten().dictionary_encode()
    stretches, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    first = np.zeros(len(codes), bool)
    first[offsets[:-1]] = True
    follows = np.zeros(len(stretches), bool)
    follows[codes[~first]] = True
    loose = pc.match_substring_regex(stretches, LOOSE).to_numpy(zero_copy_only=False)
    joined = np.flatnonzero(follows & ~loose)
    together = stretches.take(pa.array(joined))
    ids = [encode(model, " " + " ".join(together.to_pylist()))] if len(joined) else []
    ends = [np.searchsorted(np.cumsum(sizes[ids[0]]), np.cumsum(pc.binary_length(together).to_numpy() + 1)) + 1] if ids else []
    at = np.full(len(stretches), -1)
    at[joined] = np.arange(len(joined))
    at = at[codes]
    alone = [(np.flatnonzero((codes == i) & ~first), " " + stretches[int(i)].as_py()) for i in np.flatnonzero(follows & loose)]
    alone += [(offsets[i : i + 1], stretches[int(codes[offsets[i]])].as_py()) for i in range(len(texts))]
    count = len(joined)
    total = int(ends[0][-1]) if ends else 0
    extra = []
    for where, text in alone:
        own = encode(model, text)
        total += len(own)
        ids.append(own)
        extra.append(total)
        at[where] = count
        count += 1
    spaced = np.flatnonzero(pc.match_substring_regex(texts, SPACED).to_numpy(zero_copy_only=False))
    if len(spaced):
        size = np.diff(offsets)
        keep = np.ones(len(codes), bool)
        for i in spaced:
            own = encode(model, texts[int(i)].as_py())
            total += len(own)
            ids.append(own)
            extra.append(total)
            at[offsets[i]] = count
            count += 1
            keep[offsets[i] + 1 : offsets[i + 1]] = False
            size[i] = 1
        at = at[keep]
        offsets = np.concatenate(([0], np.cumsum(size)))
    stops = np.concatenate([[0], *ends, extra]).astype(np.int64)
    every = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    table = pa.LargeListArray.from_arrays(pa.array(stops, pa.int64()), pa.array(every, pa.uint32()))
    taken = table.take(pa.array(at, pa.int64()))
    starts = taken.offsets.to_numpy() - taken.offsets[0].as_py()
    return taken.flatten().to_numpy(), starts[offsets]


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the pieces of every document.

    Only documents of more than ``capacity`` ids, the separator 0 included, are cut; all
    their pieces but the first are full.
    """

    def run(batches):
        for batch in small_batches(batches, rows=1000, mb=4):
            ids, at = token_ids(batch["text"], tokenizer_path)
            out = defaultdict(list)
            for n, doc_id in enumerate(batch["doc_id"].to_pylist()):
                own = np.append(ids[at[n] : at[n + 1]], np.uint32(0)).astype("<u4")
                stop = (len(own) - 1) % capacity + 1
                start = piece = 0
                while start < len(own):
                    out["doc_id"].append(doc_id)
                    out["piece"].append(piece)
                    out["start"].append(start)
                    out["length"].append(stop - start)
                    out["ids_crc32"].append(zlib.crc32(own[start:stop].tobytes()))
                    start, stop, piece = stop, stop + capacity, piece + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], f.type) for f in PIECES], schema=PIECES
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``length, first rank, rows, first sequence, offset, copies in a row``.

    Row r of a run lies in sequence ``first sequence + r div copies`` at
    ``offset + (r mod copies) * length``.
    """
    third = capacity // 3
    left = {n: c for n, c in histogram.items() if c > 0}
    kinds: list[tuple[int, int, list]] = []  # free, bins, [(length, copies)]
    large = sorted(n for n in left if n > third)
    while large:
        n = large[-1]
        k = bisect.bisect_right(large, capacity - n) - 1
        if k < 0:
            kinds.append((capacity - n, left[n], [(n, 1)]))
            large.pop()
            continue
        m = large[k]
        bins = left[n] // 2 if m == n else min(left[n], left[m])
        if bins:
            kinds.append((capacity - n - m, bins, [(n, 1), (m, 1)] if m != n else [(n, 2)]))
        left[n] -= bins
        left[m] -= bins
        if m == n and left[n]:
            if k:  # one is left over: it takes the next longest
                partner = large[k - 1]
                kinds.append((capacity - n - partner, 1, [(n, 1), (partner, 1)]))
                left[partner] -= 1
            else:
                kinds.append((capacity - n, 1, [(n, 1)]))
            left[n] -= 1
        large = [x for x in large if left[x] > 0]
    by_free: dict[int, list] = defaultdict(list)
    for free, bins, items in kinds:
        by_free[free].append((bins, items))
    gaps = sorted(by_free)
    for n in sorted((x for x in left if x <= third), reverse=True):
        count = left[n]
        while count:
            k = bisect.bisect_left(gaps, n)
            if k == len(gaps):
                fits = capacity // n
                bins, items, free = -(-count // fits), [], capacity
            else:
                free = gaps[k]
                bins, items = by_free[free].pop()
                if not by_free[free]:
                    del by_free[free], gaps[k]
            copies = min(free // n, count)
            use = min(bins, count // copies)
            if use < bins:
                rest = bins - use if items else 0
                if rest:
                    if free not in by_free:
                        bisect.insort(gaps, free)
                    by_free[free].append((rest, items))
            count -= use * copies
            new = free - copies * n
            if new not in by_free:
                bisect.insort(gaps, new)
            by_free[new].append((use, [*items, (n, copies)]))
    runs, rank, sequence = [], defaultdict(int), 0
    for groups in by_free.values():
        for bins, items in groups:
            offset = 0
            for n, copies in items:
                runs.append((n, rank[n], bins * copies, sequence, offset, copies))
                rank[n] += bins * copies
                offset += n * copies
            sequence += bins
    return runs


def salts_of(counts: dict[int, int], least_rows: int = 1000) -> dict[int, int]:
    """In how many groups the pieces of each length are counted: neither groups nor their rows get too many."""
    return {n: -(-c // max(least_rows, 8 * math.isqrt(c))) for n, c in counts.items()}


def ranked(pieces: DataFrame, salts: dict[int, int]) -> DataFrame:
    """Add ``rank``: each piece's number, from 0, among those of its length.

    A length that very many pieces share is counted in so many groups as ``salts`` tells, which
    begin where the ones before end. Groups go by the place of a piece in the written table, so
    that repeated rows are spread too.
    """
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    groups = pieces.sparkSession.createDataFrame(list(salts.items()), "length long, salts long")  # a row a length
    placed = pieces.select("*", F.xxhash64(place).alias("place"))
    salted = placed.join(F.broadcast(groups), "length").withColumn("salt", F.pmod("place", "salts").cast("int")).drop("salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("rows"))
        .withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .drop("rows")
    )
    own = Window.partitionBy("length", "salt").orderBy("place", "doc_id", "piece")
    return (
        salted.withColumn("number", F.row_number().over(own))
        .join(begins, ["length", "salt"])
        .withColumn("rank", F.col("first") + F.col("number") - 1)
        .drop("salt", "first", "place", "number")
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row a piece."""
    spark = docs.sparkSession
    pieces = written(cut(docs, tokenizer_path, capacity), "pack-pieces", 1000, 4)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    by_length: dict[int, list] = defaultdict(list)
    for n, *run in plan(counts, capacity):
        by_length[n].append(run)
    runs = spark.sparkContext.broadcast({n: np.array(sorted(r), np.int64) for n, r in by_length.items()})

    def place(batches):
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                own = runs.value[int(n)]
                r = own[np.searchsorted(own[:, 0], rank[mine], side="right") - 1]
                k = rank[mine] - r[:, 0]
                sequence[mine] = r[:, 2] + k // r[:, 4]
                offset[mine] = r[:, 3] + k % r[:, 4] * n
            yield pa.RecordBatch.from_arrays(
                [batch[f.name] for f in PIECES] + [pa.array(sequence), pa.array(offset)],
                [*PIECES.names, "sequence_id", "offset"],
            )

    return ranked(pieces, salts_of(counts)).mapInArrow(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
