"""Document fingerprints as invertible Bloom lookup sketches of paragraphs.

A text is cut into paragraphs at line and sentence ends; those of more than ``LONGEST``
characters are cut further behind words that their own letters select, and what still is long for
want of spaces behind characters that those before them select, so that in any script an edit
changes the paragraphs it touches and no others. Each paragraph's digest (with its number among equal
ones) is added to three cells of a small table: a count, the xor of the digests and the xor of
their checks. The tables of two versions subtract cell by cell; what both hold cancels, and
peeling cells with a single digest recovers the digests that differ, and on which side. Where
peeling gets stuck the two are sketched again, at least twice as large, until it succeeds.

The likeness of two fingerprints is the share of paragraphs they have in common (Jaccard),
from the numbers of paragraphs and of recovered differences. The string of a fingerprint is a
table that grows with its paragraphs, its size a power of two: tables of two sizes compare at the
smaller one, as cells fold onto each other. ``likeness_of`` compares two strings, texts that differ
by half or less, in general, without the texts.

Nulls: a null text counts as empty, and empty texts are alike (1); a null document id comes
before all others. Rows that repeat an id, or have none, follow each other in the order in which
they are stored; a single row is its own next. Empty tables give no rows. Other columns of
``docs`` may have any name.
"""

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import located, small_batches, whole_text

#: Longer paragraphs are cut behind about one word in CUT.
LONGEST, CUT = 64, 4
#: Cells of each of the three parts of the smallest table.
SMALLEST = 8
FIRST_ID = -(2**63)
_M = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def mixed(x: np.ndarray, n: int) -> np.ndarray:
    """One of four hash functions of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31 - n))) * _M[n]
    x = (x ^ (x >> np.uint64(29))) * _M[(n + 1) % 4]
    return x ^ (x >> np.uint64(32))


def cut_by_words(paragraph: str) -> list[str]:
    """Parts of a long paragraph, behind words whose check sum selects them; only longer words are cut by length."""
    parts, start, end, crc = [], 0, 0, zlib.crc32
    for word in paragraph.split(" "):
        end += len(word) + 1
        if crc(word.encode()) % CUT == 0:
            parts.append(paragraph[start:end])
            start = end
    parts.append(paragraph[start:])
    return [q for p in parts for q in (cut_by_characters(p) if len(p) > 4 * LONGEST else (p,))]


#: Characters that select a cut, the fewest between two cuts, and one place in how many is selected.
WINDOW, FEWEST, SELECTED = 8, LONGEST // 2, 64


def cut_by_characters(run: str) -> list[str]:
    """Parts of a run behind characters that are selected by a hash of the last WINDOW ones; none where it repeats."""
    codes = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - WINDOW + 1
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = (h ^ codes[k : n + k]) * _M[k % 4]
    ends = np.flatnonzero(mixed(h, 1) % np.uint64(SELECTED) == 0) + WINDOW
    parts, start = [], 0
    for end in ends.tolist():
        if end - start >= FEWEST:
            parts.append(run[start:end])
            start = end
    return [*parts, run[start:]]


#: Sentence ends that no space follows. Fixed values.
FULL_STOPS = "。！？"


def paragraphs(text: str) -> list[str]:
    """Parts of a text at line and sentence ends, and of long ones."""
    text = text.replace(". ", ".\n")
    for c in FULL_STOPS:
        text = text.replace(c, c + "\n")
    parts = text.split("\n")
    if max(map(len, parts)) > LONGEST:
        parts = [q for p in parts for q in (cut_by_words(p) if len(p) > LONGEST else (p,))]
    return [p for p in parts if p]


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all paragraphs of the texts, made distinct within each, and their owners."""
    digest = xxhash.xxh3_64_intdigest
    lists = [paragraphs(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in lists])
    h = np.fromiter((digest(p) for x in lists for p in x), np.uint64, len(owner))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    again = (np.arange(len(h)) - start).astype(np.uint64)
    return mixed(h + again * _M[3], 0), owner


class Sketches:
    """Tables of many sets side by side, each of three parts of its own ``size`` in cells."""

    def __init__(self, keys: np.ndarray, owner: np.ndarray, size: np.ndarray):
        self.size = size
        self.ends = np.cumsum(3 * size)
        cells = int(self.ends[-1]) if len(size) else 0
        self.count = np.zeros(cells, np.int64)
        self.key = np.zeros(cells, np.uint64)
        self.check = np.zeros(cells, np.uint64)
        self.add(keys, owner, np.ones(len(keys), np.int64))

    def add(self, keys: np.ndarray, owner: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Add digests to their cells, which are returned."""
        size, check, places = self.size[owner], mixed(keys, 3), []
        first, parts = self.ends[owner] - 3 * size, size.astype(np.uint64)
        for n in range(3):
            at = first + n * size + (mixed(keys, n) % parts).astype(np.int64)
            np.add.at(self.count, at, times)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)
            places.append(at)
        return np.concatenate(places)

    def minus(self, other: "Sketches") -> "Sketches":
        self.count -= other.count
        self.key ^= other.key
        self.check ^= other.check
        return self

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests in the one but not the other, their sets and sides; which sets are done."""
        keys, sets, sides = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            pure = look[(np.abs(self.count[look]) == 1) & (self.check[look] == mixed(self.key[look], 3))]
            if not len(pure):
                break
            owner = np.searchsorted(self.ends, pure, side="right")
            order = np.lexsort((self.key[pure], owner))
            pure, owner = pure[order], owner[order]
            k = self.key[pure]
            new = np.ones(len(pure), bool)
            new[1:] = (k[1:] != k[:-1]) | (owner[1:] != owner[:-1])
            k, owner, side = k[new], owner[new], self.count[pure[new]]
            look = self.add(k, owner, -side)
            keys.append(k), sets.append(owner), sides.append(side)
        full = (self.count != 0) | (self.key != 0)
        begins = self.ends - 3 * self.size
        left = np.add.reduceat(full, begins) if len(begins) else np.zeros(0)
        return np.concatenate(keys), np.concatenate(sets), np.concatenate(sides), left == 0

    def strings(self) -> list[str]:
        cells = np.zeros(len(self.count), CELL)
        cells["count"], cells["key"], cells["check"] = self.count, self.key, self.check
        data, ends = cells.tobytes(), (self.ends * CELL.itemsize).tolist()
        return [base64.b64encode(data[i:j]).decode() for i, j in zip([0, *ends[:-1]], ends, strict=False)]


#: A cell of a published table.
CELL = np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u8")])


def published_sizes(owner: np.ndarray, sets: int) -> np.ndarray:
    """Cells of each part of the published tables: powers of two, three quarters of the paragraphs at least in all parts."""
    n = np.maximum(np.bincount(owner, minlength=sets), 1)
    return np.maximum(SMALLEST, 1 << np.ceil(np.log2(np.maximum(n / 4, 1))).astype(np.int64))


def table_of(string: str, size: int | None = None) -> Sketches:
    """The table of a fingerprint's string, folded to a smaller size if asked."""
    cells = np.frombuffer(base64.b64decode(string), CELL)
    own = len(cells) // 3
    out = Sketches(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.array([size or own]))
    parts = cells.reshape(3, -1, size or own)
    out.count = parts["count"].sum(axis=1).reshape(-1).astype(np.int64)
    out.key, out.check = (np.bitwise_xor.reduce(parts[c], axis=1).reshape(-1) for c in ("key", "check"))
    return out


def likeness_of(a: str, b: str) -> float | None:
    """The likeness of two fingerprints, from their strings alone; None where the tables are too small for the differences."""
    size = min(len(base64.b64decode(x)) // CELL.itemsize // 3 for x in (a, b))
    tables = [table_of(x, size) for x in (a, b)]
    n = [int(t.count.sum()) // 3 for t in tables]
    keys, _, _, done = tables[0].minus(tables[1]).peel()
    if not done.all():
        return None
    common = (sum(n) - len(keys)) / 2
    return common / (sum(n) - common) if sum(n) else 1.0


def only(keys: np.ndarray, owner: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of some sets, which are numbered anew."""
    number = np.full(int(owner.max(initial=-1)) + 2, -1)
    inside = sets[sets < len(number)]
    number[inside] = np.arange(len(sets))[sets < len(number)]
    mine = number[owner] >= 0
    return keys[mine], number[owner[mine]]


def differences(a: tuple, b: tuple, sets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The digests that one of the sets of ``a`` and ``b`` has and the other hasn't: digest, set, side.

    The side is 1 where ``a`` has it, -1 where ``b`` has.
    """
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    most = np.bincount(a[1], minlength=sets) + np.bincount(b[1], minlength=sets)
    todo, size = np.arange(sets), np.full(sets, SMALLEST)
    while len(todo):
        both = Sketches(*only(*a, todo), size).minus(Sketches(*only(*b, todo), size))
        keys, owner, sides, done = both.peel()
        final = done[owner]
        out.append((keys[final], todo[owner[final]], sides[final]))
        todo, size = todo[~done], np.maximum(size[~done] * 2, most[todo[~done]] // 2 + SMALLEST)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def likeness(a: tuple, b: tuple, sets: int) -> np.ndarray:
    n = np.bincount(a[1], minlength=sets), np.bincount(b[1], minlength=sets)
    common = (n[0] + n[1] - np.bincount(differences(a, b, sets)[1], minlength=sets)) / 2
    every = n[0] + n[1] - common
    return np.where(every > 0, common / np.maximum(every, 1), 1.0)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the first as many characters of another."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def compare(texts: list[str], following: list[str]) -> dict[str, list]:
    """Columns of the texts' fingerprints, against their edited texts and the following ones."""
    new = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    n = len(texts)
    # Most following texts are the next of the texts: each is cut and digested once.
    extra = [i for i in range(n) if i + 1 == n or following[i] is not texts[i + 1]]
    keys, owner = digests(texts + [following[i] for i in extra])
    own = keys[owner < n], owner[owner < n]
    after = np.concatenate(([-1], np.arange(n - 1), extra))  # whose following text each one is
    after[[i + 1 for i in extra if i + 1 < n]] = -1
    other = keys[after[owner] >= 0], after[owner][after[owner] >= 0]
    edit = digests(new)
    return {
        "n_chars": list(map(len, texts)),
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new],
        "fingerprint": Sketches(*own, published_sizes(own[1], n)).strings(),
        "edited_fingerprint": Sketches(*edit, published_sizes(edit[1], n)).strings(),
        "near_edited": likeness(own, edit, n),
        "near_next": likeness(own, other, n),
    }


ORDER = ["key", "file", "row"]


def part_of(firsts: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """The part of each row: the last one whose first row isn't behind it, by ORDER.

    ``firsts`` are the columns of the parts' first rows, ascending. Where parts begin with the
    same value the next column decides.
    """
    low = np.searchsorted(firsts[0], columns[0], side="left")
    high = np.searchsorted(firsts[0], columns[0], side="right")
    out = np.maximum(high - 1, 0)
    if len(firsts) > 1:
        for first in np.unique(low[high > low]):
            rows = np.flatnonzero((low == first) & (high > low))
            stop = high[rows[0]]
            own = [c[rows] for c in columns[1:]]
            within = part_of([f[first:stop] for f in firsts[1:]], own)
            # Rows before all of these belong to the part before them.
            before = np.zeros(len(rows), bool)
            tied = np.ones(len(rows), bool)
            for f, c in zip(firsts[1:], own, strict=True):
                before |= tied & (c < f[first])
                tied &= c == f[first]
            out[rows] = np.maximum(first + within - before, 0)
    return out


def neighboured(docs: DataFrame, rows_a_part: int = 50_000, least_parts: int = 64) -> DataFrame:
    """``part, guest, doc_id, text``: documents in parts by ascending id, ordered within; a part a partition.

    The first document of each part also comes, as a guest, at the end of the part before
    (of the last one, for the first), so that each document's next is in its own part. Ids and
    places are dealt by ranges first; of them the first one of each part passes through the
    driver and is broadcast: 24 bytes for ``rows_a_part`` rows. Rows that share an id are dealt
    by their places.
    """
    spark = docs.sparkSession
    rows, at = located(docs)
    rows = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("key"),
        F.col(f"`{at}`.file").alias("file"),
        F.col(f"`{at}`.row").alias("row"),
        whole_text(rows).alias("text"),
    )
    count = rows.count()
    parts = max(1, -(-count // rows_a_part), min(least_parts, -(-count // 500)))
    least = rows.select(*ORDER).repartitionByRange(parts, *ORDER).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*ORDER)).alias("first"))
    firsts = np.array(sorted(tuple(r["first"]) for r in least.collect()), np.int64).reshape(-1, 3)
    shared, parts = spark.sparkContext.broadcast(firsts), max(1, len(firsts))

    @F.arrow_udf("struct<part: int, first: boolean>")
    def dealt(key: pa.Array, file: pa.Array, row: pa.Array) -> pa.Array:
        own, begins = [c.to_numpy() for c in (key, file, row)], shared.value
        part = part_of(list(begins.T), own)
        first = (np.column_stack(own) == begins[part]).all(axis=1)
        return pa.StructArray.from_arrays([pa.array(part.astype(np.int32)), pa.array(first)], ["part", "first"])

    def place(part, guest):
        return F.struct(part.cast("int").alias("part"), F.lit(guest).alias("guest"))

    own = F.col("dealt.part")
    places = F.when(F.col("dealt.first"), F.array(place(own, False), place(F.pmod(own - 1, F.lit(parts)), True))).otherwise(F.array(place(own, False)))
    return (
        rows.withColumn("dealt", dealt(*ORDER))
        .select("doc_id", *ORDER, "text", F.explode(places).alias("place"))
        .select("place.part", "place.guest", "doc_id", *ORDER, "text")
        .repartitionById(parts, F.col("part"))
        .sortWithinPartitions("guest", *ORDER)
        .select("part", "guest", "doc_id", "text")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``, as ``compare`` has it, with ``doc_id``."""

    def run(batches):
        held = None  # the last document so far, whose next hasn't come
        for batch in small_batches(batches):
            pairs = []
            for row in zip(*(batch[c].to_pylist() for c in ("guest", "doc_id", "text")), strict=True):
                if held is not None:
                    pairs.append((held[1], held[2], row[2]))
                held = row
            if pairs:
                ids, texts, following = map(list, zip(*pairs, strict=True))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64())} | compare(texts, following))

    return neighboured(docs).mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    )


def changed_paragraphs(versions: DataFrame) -> DataFrame:
    """``doc_id, digest, side``: the paragraph digests that differ between two versions of a text.

    ``versions`` has ``doc_id, text, new_text``; the side is ``old`` for digests that only the
    text has and ``new`` for those that only the new text has. ``paragraph_digests`` tells which
    paragraphs they are.
    """

    def run(batches):
        for batch in small_batches(batches):
            old, new = (digests(batch[c].to_pylist()) for c in ("text", "new_text"))
            keys, owner, sides = differences(old, new, len(batch))
            names = pa.array(["old", "new"]).take(pa.array((sides < 0).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(owner)), pa.array(keys.view(np.int64)), names], ["doc_id", "digest", "side"])

    texts = [F.coalesce(versions[c].cast("string"), F.lit("")).alias(c) for c in ("text", "new_text")]
    return versions.select(F.col("doc_id").cast("long").alias("doc_id"), *texts).mapInArrow(run, "doc_id long, digest long, side string")


def paragraph_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, paragraph``: every paragraph of ``docs`` by its digest."""

    def run(batches):
        for batch in small_batches(batches):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                parts = numbered_paragraphs(text)
                keys = pa.array(np.array([k for k, _ in parts], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(parts), pa.int64()), keys, pa.array([p for _, p in parts], pa.string())], ["doc_id", "digest", "paragraph"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest long, paragraph string")


def numbered_paragraphs(text: str) -> list[tuple[int, str]]:
    """The paragraphs of one text with the digests that ``digests`` gives them."""
    parts, seen = [], {}
    for p in paragraphs(text):
        seen[p] = seen.get(p, -1) + 1
        h = np.array([xxhash.xxh3_64_intdigest(p)], np.uint64) + np.uint64(seen[p]) * _M[3]
        parts.append((int(mixed(h, 0)[0]), p))
    return parts
