"""Repeated passages from a sparse suffix array.

Word sequences (A-Z lower-cased) keep only the suffixes at minimiser positions: of every
``WINDOW`` consecutive positions the one with the least hash of its next ``GRAM`` words. A
passage of ``SHORTEST`` words that two documents share has such a suffix among its first
``WINDOW`` positions, the same in both, and with ``PREFIX = SHORTEST - WINDOW + 1`` words of it.

The array: suffixes are dealt by ranges and sorted by their leading words, the ``GRAM`` words of
the minimiser first and then those up to PREFIX (each stretch by its hash: 128 bits in all), and
by document. Neighbours are compared in one pass over each range; what begins or ends a range is
handed over as one row a range, so that a run of equal suffixes may reach over many ranges. A
suffix without a neighbour from another document ends here.

Matches are then extended left and right. All SHORTEST words to the right of a suffix, and the
window that begins WINDOW - 1 words to its left, are sorted and compared with their neighbours
in the same way. Where both windows are shared, all between them is covered. Where not, at the
ends of passages, the match is extended word by word: the windows between are sorted and
compared too (of suffixes whose both windows are shared two documents for each surrounding are
enough to be compared with). Windows that overlap or touch make up passages to their true ends.
The result is exactly the union of all windows of SHORTEST words that occur in two documents.

Every row is a document of its own. Nothing pairs the documents of a passage, and no key is
hot: equal keys are dealt by document too.

Nulls: a null text counts as empty and has no passages; rows without an id, or that repeat one,
are rows like others, and equal texts of theirs are passages. Texts of fewer than SHORTEST words
have no passages. Empty tables give no rows. Other columns of ``docs`` may have any name.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import mixed
from .text import located, numbered, removed, small_batches, whole_text, written

SHORTEST, WINDOW, GRAM = 50, 21, 8
PREFIX = SHORTEST - WINDOW + 1
FACTOR = 0x9E3779B97F4A7C15


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's begin."""
    digest = xxhash.xxh3_64_intdigest
    lists = [t.encode().lower().split() for t in texts]
    begin = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
    return np.fromiter((digest(w) for x in lists for w in x), np.uint64, int(begin[-1])), begin


class Runs:
    """Hashes of any run of words in constant time, by sums of powers."""

    def __init__(self, h: np.ndarray):
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(FACTOR, len(h)), out=self.sums[1:])
        self.inverse = powers(pow(FACTOR, -1, 2**64), len(h) + 1)

    def hashes(self, start: np.ndarray, length: int, salt: int) -> np.ndarray:
        """Each sum is divided by the power it begins with, so that only the words count."""
        return mixed((self.sums[start + length] - self.sums[start]) * self.inverse[start], salt)


def anchors(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Minimiser positions in all texts, from those at which ``PREFIX`` words follow in the text."""
    n = len(h) - GRAM + 1
    if n < WINDOW:
        return np.zeros(0, np.int64)
    gram = np.zeros(n, np.uint64)
    for k in range(GRAM):
        gram = (gram ^ h[k : k + n]) * np.uint64(FACTOR)
        gram ^= gram >> np.uint64(29)
    owner = np.searchsorted(begin, np.arange(n), side="right") - 1
    inside = np.arange(n) + PREFIX <= begin[owner + 1]
    # A window of SHORTEST words starts at s: its candidates are s to s + WINDOW - 1.
    view = np.lib.stride_tricks.sliding_window_view(gram, WINDOW)
    found = np.empty(len(view), np.int64)
    for a in range(0, len(view), 1 << 17):
        found[a : a + (1 << 17)] = view[a : a + (1 << 17)].argmin(axis=1)
    found += np.arange(len(view))
    valid = np.arange(len(view)) + SHORTEST <= begin[owner[: len(view)] + 1]
    picked = np.unique(found[valid])
    return picked[inside[picked]]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def suffix_rows(docs: DataFrame) -> DataFrame:
    """``file, row, at, head, tail, right, left``: a row for each retained suffix.

    ``head`` and ``tail`` are the hashes of its first GRAM words and of those up to PREFIX;
    ``right`` and ``left`` of the two extreme windows, null where the text ends before.
    """

    def run(batches):
        for batch in small_batches(batches):
            h, begin = word_hashes(batch["text"].to_pylist())
            at = anchors(h, begin)
            owner = np.searchsorted(begin, at, side="right") - 1
            right, left = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
            right_ok = at + SHORTEST <= begin[owner + 1]
            left_ok = at - (WINDOW - 1) >= begin[owner]
            runs = Runs(h)
            right[right_ok] = runs.hashes(at[right_ok], SHORTEST, 2)
            left[left_ok] = runs.hashes(at[left_ok] - (WINDOW - 1), SHORTEST, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch[c].take(pa.array(owner)) for c in ("file", "row")],
                    pa.array((at - begin[owner]).astype(np.int32)),
                    signed(runs.hashes(at, GRAM, 1)),
                    signed(runs.hashes(at + GRAM, PREFIX - GRAM, 1)),
                    pa.array(right.view(np.int64), mask=~right_ok),
                    pa.array(left.view(np.int64), mask=~left_ok),
                ],
                ["file", "row", "at", "head", "tail", "right", "left"],
            )

    return docs.mapInArrow(run, "file long, row long, at int, head long, tail long, right long, left long")


class Neighbours:
    """One pass over sorted rows: which have a neighbour of the same key from another document.

    Runs of one key are sorted by document, so a run is shared if its first and last row differ
    in it. Held are at most the rows of one document at a time.
    """

    def __init__(self, key: list[str]):
        self.key = key
        self.held: pa.RecordBatch | None = None
        self.shared = False  # whether the run that goes on is known to be shared
        #: [key, first document, last document] of the range's first and of its latest run.
        self.top: list | None = None
        self.end: list | None = None

    def columns(self, batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
        return np.column_stack([batch[c].to_numpy() for c in names])

    def take(self, batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        """Rows, whether each is shared, and whether that is open as its run may begin before the range."""
        if self.held is not None:
            batch = pa.Table.from_batches([self.held, batch]).combine_chunks().to_batches()[0]
        k, doc = self.columns(batch, self.key), self.columns(batch, ["file", "row"])
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]).any(axis=1)
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], len(k))
        shared = (doc[starts] != doc[stops - 1]).any(axis=1)
        goes_on = self.end is not None and (self.end[0] == k[0]).all()
        shared[0] |= goes_on and self.shared
        if self.top is None:
            self.top = [k[0], doc[0], doc[stops[0] - 1]]
        open_ = np.zeros(len(starts), bool)
        if (self.top[0] == k[0]).all():
            self.top[2] = doc[stops[0] - 1]
            open_[0] = not shared[0]
        first = self.end[1] if goes_on and len(starts) == 1 else doc[starts[-1]]
        self.end = [k[-1], first, doc[-1]]
        self.shared = bool(shared[-1])
        stop = len(k) if self.shared else int(starts[-1])
        self.held = None if self.shared else batch.slice(stop)
        sizes = stops - starts
        return batch.slice(0, stop), np.repeat(shared, sizes)[:stop], np.repeat(open_, sizes)[:stop]


def with_neighbours(rows: DataFrame, key: list[str], then: str, name: str) -> DataFrame:
    """Those of ``rows(key, file, row, ...)`` whose key a row of another document has too.

    ``rows`` should be written, as dealing by ranges reads them twice. ``then`` is the last
    column to sort by. Columns of ``key`` are longs that aren't null.
    """
    order = [*key, "file", "row", then]
    columns = rows.columns
    fields = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields]

    def run(batches):
        def out(batch, edge, sure):
            return pa.RecordBatch.from_arrays([batch[c] for c in columns] + [pa.array(edge), pa.array(sure)], [*columns, "edge", "sure"])

        walk, kind = Neighbours(key), None
        for batch in batches:
            if len(batch):
                kind = batch.schema
                found, shared, open_ = walk.take(batch)
                keep = shared | open_
                if keep.any():
                    yield out(found.filter(pa.array(keep)), np.zeros(keep.sum(), bool), shared[keep])
        if walk.held is not None:
            yield out(walk.held, np.zeros(len(walk.held), bool), np.zeros(len(walk.held), bool))
        if kind is not None:
            # What the range begins and ends with, for the ranges beside it.
            edges = [dict(zip([*key, "file", "row"], [*map(int, k), *map(int, doc)], strict=True)) for k, *docs in (walk.top, walk.end) for doc in docs]
            batch = pa.RecordBatch.from_arrays([pa.array([e.get(f.name) for e in edges], f.type) for f in kind], schema=kind)
            yield out(batch, np.ones(len(edges), bool), np.zeros(len(edges), bool))

    schema = ", ".join(f"`{n}` {t}" for n, t in fields) + ", edge boolean, sure boolean"
    walked = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)
    walked = written(walked, name)
    edges = walked.where("edge").groupBy(*key).agg(F.min(F.struct("file", "row")).alias("a"), F.max(F.struct("file", "row")).alias("b"))
    edges = edges.where("a < b").select(*key)  # at most two keys a range
    inner = walked.where("not edge")
    return inner.where("sure").unionByName(inner.where("not sure").join(F.broadcast(edges), key, "left_semi")).select(*columns)


def windows_between(texts: DataFrame) -> DataFrame:
    """``file, row, start, w``: the windows between the extreme ones of suffixes ``ats`` of each text."""

    def run(batches):
        for batch in small_batches(batches):
            h, begin = word_hashes(batch["text"].to_pylist())
            runs = Runs(h)
            ats = batch["ats"]
            owner = np.repeat(np.arange(len(batch)), np.diff(ats.offsets.to_numpy()))
            at = ats.flatten().to_numpy() + begin[owner]
            for k in range(1, WINDOW - 1):
                start = at - k
                fits = (start >= begin[owner]) & (start + SHORTEST <= begin[owner + 1])
                s, o = start[fits], owner[fits]
                yield pa.RecordBatch.from_arrays(
                    [*[batch[c].take(pa.array(o)) for c in ("file", "row")], pa.array((s - begin[o]).astype(np.int32)), signed(runs.hashes(s, SHORTEST, 2))],
                    ["file", "row", "start", "w"],
                )

    return texts.select("file", "row", "text", "ats").mapInArrow(run, "file long, row long, start int, w long")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``doc_id, start_word, end_word``: maximal stretches of words (end exclusive), a row each.

    Every word of a stretch lies in a run of SHORTEST words that another row has too.
    """
    rows, place = located(docs)
    here = [F.col(f"`{place}`.{c}").alias(c) for c in ("file", "row")]
    suffixes = written(suffix_rows(rows.select(*here, whole_text(rows).alias("text"))), "suffixes", 2000, 8)
    near = written(with_neighbours(suffixes, ["head", "tail"], "at", "suffixes-sorted"), "suffixes-near")
    removed(suffixes)

    own = ["file", "row", "at"]
    sides = near.select(*own, F.lit(True).alias("is_right"), F.col("right").alias("w")).unionByName(
        near.select(*own, F.lit(False).alias("is_right"), F.col("left").alias("w"))
    )
    sides = written(sides.where("w is not null"), "suffixes-sides")
    extended = written(with_neighbours(sides, ["w"], "at", "suffixes-extended"), "suffixes-shared")
    both = extended.groupBy(*own).agg(F.count_distinct("is_right").alias("n")).where("n = 2").drop("n")
    flagged = near.join(both.withColumn("closed", F.lit(True)), own, "left").withColumn("closed", F.col("closed").isNotNull())
    flagged = written(flagged, "suffixes-flagged")

    # A window of an open end may lie in a document whose both extreme windows are shared.
    opened = flagged.where("not closed")
    suffix = F.struct(*own)
    witnesses = (
        flagged.where("closed")
        .groupBy("head", "tail", "right", "left")
        .agg(F.min(suffix).alias("a"), F.max(suffix).alias("b"))
        .join(opened.select("head", "tail").distinct(), ["head", "tail"], "left_semi")
        .select(F.explode(F.array("a", "b")).alias("s"))
        .select("s.*")
    )
    asked = opened.select(*own).unionByName(witnesses).groupBy("file", "row").agg(F.collect_set("at").alias("ats"))
    asked = written(asked, "suffixes-asked")
    texts, n = numbered(rows, place, asked.select("file", "row", F.lit(1).alias("n")), 1)
    texts = texts.where(F.col(n) == 1).select(*here, whole_text(rows).alias("text")).join(asked, ["file", "row"])
    between = written(windows_between(texts).distinct(), "suffixes-between", 2000, 8)
    between = with_neighbours(between, ["w"], "start", "suffixes-ends")

    starts = between.select("file", "row", "start").unionByName(
        extended.select("file", "row", F.when(F.col("is_right"), F.col("at")).otherwise(F.col("at") - (WINDOW - 1)).alias("start"))
    )
    ids = rows.select(*[c.alias(f"of_{n}") for c, n in zip(here, ("file", "row"), strict=True)], F.col("doc_id").cast("long").alias("doc_id"))
    found = merged(starts)
    return found.join(ids, (F.col("file") == F.col("of_file")) & (F.col("row") == F.col("of_row"))).select("doc_id", "start_word", "end_word")


def merged(starts: DataFrame) -> DataFrame:
    """``file, row, start_word, end_word``: windows from ``starts(file, row, start)``, merged where they overlap or touch."""
    ordered = starts.groupBy("file", "row").agg(F.sort_array(F.collect_set("start")).alias("s"))
    s = F.col("s")
    firsts = F.filter(s, lambda x, i: (i == 0) | (x > F.get(s, i - 1) + SHORTEST))
    lasts = F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1) > x + SHORTEST))
    return ordered.select("file", "row", F.explode(F.arrays_zip(firsts.alias("a"), lasts.alias("b"))).alias("p")).select(
        "file", "row", F.col("p.a").cast("long").alias("start_word"), (F.col("p.b") + SHORTEST).cast("long").alias("end_word")
    )
