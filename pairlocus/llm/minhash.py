"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document's set holds the distinct word shingles of its text with A-Z lower-cased, as 64-bit
hashes; with fewer words than a shingle the whole sequence is one. Fast similarity sketching
fills the coordinates of a sketch in rounds: round i throws every element into one bin drawn by
the i-th hash function and each bin keeps its least (round, value); from round t on, bin
i - t takes an element of every set, so 2t rounds at most fill every coordinate, and one usually
does for large sets. Two sets agree in a coordinate with probability their Jaccard similarity,
as concentrated as for independent coordinates.

Bands of coordinates give bucket keys. Documents with equal sets are one class from the start
and only one row of a class goes on, so a group of copies costs one row. Classes that meet in
a bucket are a cluster, through bucket hubs. A cluster of very many blocks (by the sizes of its
sets), as of many pages of one template, is parted once more: two linked sets share one of
their rarest shingles, of which as many are looked at as a link can do without, and one more.
Shingles are ordered by how often a bounded sample of the cluster has them; any order is exact, a
good one leaves the template's shingles to the end. Classes that share one of these are a smaller
cluster. The sets of a cluster are made again and verified in whole numbers of common shingles: a
cluster of one block in one piece; of a larger one each class against a hub first, and then only
those that aren't linked with the hub against those of the cluster whose sizes allow a link, in
pieces of two blocks. A group of near copies thus costs a pass, not all its pairs, and no link between classes
of different components is left out. Only links that connect a piece are written. Components
follow from the links.

Nulls: a null or wordless text has the empty set and is linked with nothing. Rows are what is
linked: rows that repeat an id are compared by their own texts. A null id takes part, and is a
component's id only where no row has another. Empty tables give no rows. Other columns of
``docs`` may have any name.
"""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import hot_join, located, numbered, removed, small_batches, whole_text, written

#: A pair at 0.8 misses all bands once in 17,000 times, one at 0.85 once in 4 million.
SIZE, BANDS, ROWS = 192, 32, 6
#: Shingles of a block of classes, each class counting for some more.
BLOCK, CLASS_COST = 1 << 19, 1000
_M = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64((salt * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) % 2**64)) * _M[0]
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text, ascending within each, and where each text's begin."""
    digest = xxhash.xxh3_64_intdigest
    lists = [t.encode().lower().split() for t in texts]
    words = np.array([len(x) for x in lists], np.int64)
    h = np.fromiter((digest(w) for x in lists for w in x), np.uint64, int(words.sum()))
    first = np.concatenate(([0], np.cumsum(words)))
    count = np.where(words >= k, words - k + 1, (words > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), count)
    begin = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(len(owner)) - begin[owner] + first[owner]
    width = np.minimum(words, k)[owner]
    sums = np.zeros(len(owner), np.uint64)
    for n in range(k):
        inside = width > n
        step = mixed(h[at[inside] + n], n + 1)
        sums[inside] = (sums[inside] ^ step) * _M[0] + np.uint64(n + 1)
    sums = mixed(sums ^ width.astype(np.uint64), 0)
    order = np.lexsort((sums, owner))
    sums, owner = sums[order], owner[order]
    new = np.ones(len(sums), bool)
    new[1:] = (sums[1:] != sums[:-1]) | (owner[1:] != owner[:-1])
    return sums[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=len(texts)))))


def sketches(sets: np.ndarray, begin: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The sketch of each non-empty set, a row of ``size`` values; empty sets have zeros."""
    docs = len(begin) - 1
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    cells = np.full((docs, size), full, np.uint64)
    counts = np.diff(begin)
    todo = np.flatnonzero(counts)
    for i in range(2 * size):
        if not len(todo):
            break
        n = counts[todo]
        owner = np.repeat(todo, n)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[todo], n)
        x = mixed(sets[at], 100 + i)
        bins = (x % np.uint64(size)).astype(np.int64) if i < size else np.full(len(x), i - size)
        # The round stands in the highest bits, so that earlier rounds win.
        value = (np.uint64(i) << np.uint64(55)) | (x >> np.uint64(9))
        np.minimum.at(cells.reshape(-1), owner * size + bins, value)
        todo = todo[(cells[todo] == full).any(axis=1)]
    cells[counts == 0] = 0
    return cells


def band_keys(cells: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each sketch, different for different bands."""
    keys = np.zeros((len(cells), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(cells), b, np.uint64)
        for r in range(rows):
            key = mixed(key ^ cells[:, b * rows + r], 7)
        keys[:, b] = key
    return keys.view(np.int64)


def linked_roots(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first one that verified links lead to, by intersections of full sets."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    tokens, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    shared = np.bincount(inverse, minlength=len(tokens)) > 1
    column = (np.cumsum(shared) - 1)[inverse]
    keep = shared[inverse]
    column, owner = column[keep], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((m, m), np.int64)
    width = 4096  # whole numbers up to this are exact in the products of one step
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (start, start + width))
        part = np.zeros((m, width), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        common += (part @ part.T).astype(np.int64)
    near = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    root = np.full(m, -1)
    for i in range(m):
        if root[i] < 0:
            reach = near[i] & (root < 0)
            reach[i] = True
            root[i] = i
            while reach.any():
                root[reach] = i
                reach = near[reach].any(axis=0) & (root < 0)
    return root


def connected(edges: DataFrame) -> DataFrame:
    """``node, label`` of ``edges(a, b)``: the least node each one is connected with.

    Large-star and small-star steps in turn, each round written to the shared folder, until
    the edges stay the same. Edges of a node of high degree stay where they are.
    """

    def summary(df):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return row["n"], row["s"]

    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = summary(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") > F.col("a")).alias("degree"))
        least = written(least.select("a", F.least("a", "m").alias("m"), "degree"), "edges-least")
        large = written(hot_join(both.where("b > a"), least, "a", "degree").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges-large")
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lower, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a != b")
            .distinct()
        )
        new = written(small, "edges")
        for old in (edges, least, large):
            removed(old)
        edges, after = new, summary(new)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def set_bytes(sets: np.ndarray, begin: np.ndarray) -> list[bytes]:
    return [sets[a:b].tobytes() for a, b in zip(begin, begin[1:], strict=False)]


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, file, row, n, class, bands`` for each row of ``docs``; empty sets have no class."""

    def run(batches):
        # Words are objects and several arrays of numbers: some thirty times a batch's bytes.
        for batch in small_batches(batches, rows=500, mb=2):
            sets, begin = shingle_sets(batch["text"].to_pylist(), k)
            n = np.diff(begin)
            keys = band_keys(sketches(sets, begin))
            names = [xxhash.xxh3_128_digest(s) if s else None for s in set_bytes(sets, begin)]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["file"], batch["row"], pa.array(n, pa.int64()), pa.array(names, pa.binary()), bands],
                ["doc_id", "file", "row", "n", "class", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, file long, row long, n long, class binary, bands array<long>")


#: Parts of a bucket that very many classes share.
SALTS = 256


def candidate_clusters(classes: DataFrame, keys: str = "bands") -> DataFrame:
    """``node, cluster``: classes that meet in a bucket, a number of the array ``keys``, directly or by others.

    A node is a 64-bit hash of the class; two classes of one node are candidates like others. A
    bucket is dealt in SALTS parts with a hub each, and the hubs meet in their least one.
    """
    node = F.xxhash64("class").alias("node")
    members = classes.select(node, F.explode(keys).alias("key")).withColumn("salt", F.pmod("node", F.lit(SALTS))).repartition("key", "salt")
    hubs = members.groupBy("key", "salt").agg(F.min("node").alias("hub"))
    tops = hubs.groupBy("key").agg(F.min("hub").alias("top"))
    own = members.join(hubs, ["key", "salt"]).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    edges = own.unionByName(hubs.join(tops, "key").select(F.col("hub").alias("a"), F.col("top").alias("b")))
    labels = connected(edges.where("a != b").distinct())
    heads = labels.select(F.col("label").alias("node"), "label").distinct()
    return labels.unionByName(heads).select("node", F.col("label").alias("cluster"))


def texts_of(rows: DataFrame, at: str, members: DataFrame) -> DataFrame:
    """``file, row, text`` of the rows of ``members(file, row)``; other texts don't move."""
    chosen, n = numbered(rows, at, members.select("file", "row", F.lit(1).alias("n")), 1)
    return chosen.where(F.col(n) == 1).select(
        F.col(f"`{at}`.file").alias("file"), F.col(f"`{at}`.row").alias("row"), whole_text(rows).alias("text")
    )


def sets_of(texts: DataFrame, k: int) -> DataFrame:
    """``class, set``: the shingles of each of ``texts(text)``, and the class that they are."""

    def cut(batches):
        for batch in small_batches(batches, rows=500, mb=2):
            data = set_bytes(*shingle_sets(batch["text"].to_pylist(), k))
            names = [xxhash.xxh3_128_digest(s) for s in data]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(data, pa.binary())], ["class", "set"])

    return texts.select("text").mapInArrow(cut, "class binary, set binary")


def chunks_of(block: int) -> Column:
    """How many blocks a group's classes fill."""
    return F.ceil(F.sum(F.col("n") + CLASS_COST) / block).cast("int")


def rarest(tokens: np.ndarray, known: np.ndarray, times: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set of which a linked set has one at least: its rarest by ``times`` of the ``known`` ones."""
    place = np.minimum(np.searchsorted(known, tokens), max(len(known) - 1, 0))
    often = np.where(known[place] == tokens, times[place], 0) if len(known) else np.zeros(len(tokens))
    needed = -(-len(tokens) * percent // 100)
    return tokens[np.lexsort((tokens, often))[: len(tokens) - needed + 1]]


#: Blocks of a cluster that are verified against each other; larger ones are parted first.
PARTED = 32


def parted(rows: DataFrame, at: str, members: DataFrame, k: int, percent: int, block: int = BLOCK) -> DataFrame:
    """``members(class, cluster, n, file, row)`` with clusters of very many blocks cut into smaller ones, no link being lost."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("classes"), chunks_of(block).alias("chunks"))
    sizes = written(sizes, "near-sizes")
    if sizes.where(F.col("chunks") > PARTED).isEmpty():
        return members
    dealt = written(hot_join(members, sizes, "cluster", "classes"), "near-parted")
    large = dealt.where(F.col("chunks") > PARTED)
    sizes = sizes.where(F.col("chunks") > PARTED)
    sets = sets_of(texts_of(rows, at, large), k)
    held = written(large.select("class", "cluster", "chunks").join(sets, "class"), "near-large", 500, 2)
    # About a block of each cluster, drawn by hash.
    drawn = held.where(F.pmod(F.xxhash64(F.lit(1), "class"), F.col("chunks")) == 0)

    def counted(table: pa.Table) -> pa.Table:
        tokens, times = np.unique(np.concatenate([np.frombuffer(s, np.uint64) for s in table["set"].to_pylist()]), return_counts=True)
        often = times > 1
        columns = [table["cluster"].slice(0, 1), *[pa.array([x.tobytes()], pa.binary()) for x in (tokens[often], times[often].astype(np.int64))]]
        return pa.table(columns, ["cluster", "set", "times"])

    common = written(drawn.groupBy("cluster").applyInArrow(counted, "cluster long, set binary, times binary"), "near-common")
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    of_chunk = common.join(sizes, "cluster").select("cluster", every, "set", "times")
    own = F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int").alias("chunk")
    chunked = held.select("cluster", own, "class", "set").unionByName(of_chunk, allowMissingColumns=True)

    def prefixes(table: pa.Table) -> pa.Table:
        known, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for data, counts in zip(table["set"].to_pylist(), table["times"].to_pylist(), strict=True):
            if counts is not None:
                known, times = np.frombuffer(data, np.uint64), np.frombuffer(counts, np.int64)
        salt = mixed(np.array([table["cluster"][0].as_py()]).astype(np.int64).view(np.uint64), 3)
        names, keys = [], []
        for name, data in zip(table["class"].to_pylist(), table["set"].to_pylist(), strict=True):
            if name is not None:
                names.append(name)
                keys.append((rarest(np.frombuffer(data, np.uint64), known, times, percent) ^ salt).view(np.int64))
        return pa.table({"class": pa.array(names, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64()))})

    keyed = chunked.groupBy("cluster", "chunk").applyInArrow(prefixes, "class binary, keys array<long>")
    smaller = candidate_clusters(keyed, "keys")
    new = large.select("class", "n", "file", "row", F.xxhash64("class").alias("node")).join(smaller, "node").drop("node")
    found = written(dealt.where(F.col("chunks") <= PARTED).select(*members.columns).unionByName(new.select(*members.columns)), "near-smaller")
    removed(held)
    return found


def links_of(names: list[bytes], sets: list[np.ndarray], percent: int) -> pa.Table:
    root = linked_roots(sets, percent)
    found = [(names[i], names[r]) for i, r in enumerate(root.tolist()) if r != i]
    return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})


def cluster_links(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b``: links that connect the classes of each cluster of ``rows(cluster, class, text)``."""

    def verify(table: pa.Table) -> pa.Table:
        sets, begin = shingle_sets(table["text"].to_pylist(), k)
        return links_of(table["class"].to_pylist(), [sets[a:b] for a, b in zip(begin, begin[1:], strict=False)], percent)

    return rows.groupBy("cluster").applyInArrow(verify, "a binary, b binary")


def piece_links(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that connect the classes of each piece of ``rows(cluster, piece, class, set)``."""

    def verify(table: pa.Table) -> pa.Table:
        return links_of(table["class"].to_pylist(), [np.frombuffer(s, np.uint64) for s in table["set"].to_pylist()], percent)

    return rows.groupBy("cluster", "piece").applyInArrow(verify, "a binary, b binary")


def hub_links(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b``: classes of ``rows(cluster, chunk, class, hub, set)`` that are linked with their cluster's hub.

    Every chunk of a cluster has a row of the hub.
    """

    def verify(table: pa.Table) -> pa.Table:
        hub = table["hub"][0].as_py()
        names = table["class"].to_pylist()
        sets = [np.frombuffer(s, np.uint64) for s in table["set"].to_pylist()]
        own = sets[names.index(hub)]
        found = []
        for name, other in zip(names, sets, strict=True):
            common = len(np.intersect1d(own, other, assume_unique=True))
            if name != hub and 100 * common >= percent * (len(own) + len(other) - common):
                found.append(name)
        return pa.table({"a": pa.array(found, pa.binary()), "b": pa.array([hub] * len(found), pa.binary())})

    return rows.groupBy("cluster", "chunk").applyInArrow(verify, "a binary, b binary")


def verified_links(rows: DataFrame, at: str, members: DataFrame, k: int, percent: int, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between classes that connect all that are linked, verified on full sets.

    ``members(class, cluster, n, file, row)`` has one row of ``located`` ``rows`` for each
    class; only those rows' texts move. No piece has more than two blocks, but for a single set
    that is larger.
    """

    clusters = written(
        members.groupBy("cluster").agg(
            F.count("*").alias("classes"), F.min("class").alias("hub"), chunks_of(block).alias("chunks")
        ),
        "near-clusters",
    )
    dealt = written(hot_join(members, clusters, "cluster", "classes"), "near-dealt")
    small = dealt.where("chunks = 1").select("file", "row", "cluster", "class")
    # Always by shuffle, the few columns of the members being what tasks hash.
    links = cluster_links(texts_of(rows, at, small).join(small.hint("shuffle_hash"), ["file", "row"]).select("cluster", "class", "text"), k, percent)
    large = dealt.where("chunks > 1")
    if large.isEmpty():
        return links

    sets = written(sets_of(texts_of(rows, at, large), k), "near-sets", 500, 2)
    large = large.select("class", "cluster", "n", "classes", "hub", "chunks")
    own = F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    chunked = large.withColumn("chunk", F.explode(F.when(F.col("class") == F.col("hub"), every).otherwise(F.array(own))))
    to_hub = written(hub_links(chunked.join(sets, "class").select("cluster", "chunk", "class", "hub", "set"), percent), "near-hubs")
    # Linked sets have sizes in the same or the next band.
    width = math.log(100 / percent) * (1 + 1e-9)
    left = (
        large.join(to_hub.select(F.col("a").alias("class"), F.lit(True).alias("near")), "class", "left")
        .withColumn("near", F.col("near").isNotNull() | (F.col("class") == F.col("hub")))
        .withColumn("band", F.floor(F.log(F.col("n").cast("double")) / width).cast("int"))
        .drop("chunks", "classes", "hub")
    )
    left = written(left, "near-left")
    groups = left.groupBy("cluster", "band", "near").agg(F.count("*").alias("rows"), chunks_of(block).alias("blocks"))
    # At most two rows a band, and bands are logarithms of sizes.
    listed = groups.groupBy("cluster").agg(F.collect_list(F.struct("band", "near", "blocks")).alias("groups"), F.sum("rows").alias("classes"))
    mine = F.filter("groups", lambda g: (g["band"] == F.col("band")) & (g["near"] == F.col("near")))[0]["blocks"]
    partners = F.filter("groups", lambda g: (F.abs(g["band"] - F.col("band")) <= 1) & ~(g["near"] & F.col("near")))
    blocks = F.flatten(
        F.transform(
            partners,
            lambda g: F.transform(
                F.sequence(F.lit(0), g["blocks"] - 1), lambda j: F.struct(g["band"].alias("band"), g["near"].alias("near"), j.alias("block"))
            ),
        )
    )
    paired = (
        hot_join(left, written(listed, "near-groups"), "cluster", "classes")
        .withColumn("own", F.struct("band", "near", F.pmod(F.xxhash64("class"), mine).cast("int").alias("block")))
        .withColumn("other", F.explode(blocks))
        .select("class", "cluster", F.struct(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("piece"))
    )
    rest = piece_links(paired.join(sets, "class").select("cluster", "piece", "class", "set"), percent)
    return links.unionByName(to_hub).unionByName(rest)


def components(rows: DataFrame, at: str, k: int, percent: int, block: int = BLOCK) -> DataFrame:
    """``near_duplicates`` of rows that ``located`` gave."""
    texts = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(f"`{at}`.file").alias("file"),
        F.col(f"`{at}`.row").alias("row"),
        whole_text(rows).alias("text"),
    )
    drawn = written(sketched(texts, k), "near-sketches", 500, 2)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")
    classes = written(
        drawn.where("class is not null")
        .groupBy("class")
        .agg(
            F.min(F.struct("file", "row")).alias("at"),
            F.any_value("bands").alias("bands"),
            F.any_value("n").alias("n"),
            F.min(first).alias("first"),
            F.count("*").alias("rows"),
        ),
        "near-classes",
    )
    clusters = candidate_clusters(classes)
    members = classes.select("class", "n", "at.file", "at.row", F.xxhash64("class").alias("node")).join(clusters, "node")
    members = parted(rows, at, written(members.drop("node"), "near-members"), k, percent, block)
    labels = connected(verified_links(rows, at, members, k, percent, block))
    heads = labels.select(F.col("label").alias("node"), "label").distinct()
    labels = written(labels.unionByName(heads).select(F.col("node").alias("class"), "label"), "near-labels")
    # Only classes go on to components; each row is joined with its class once, at the end.
    linked = written(classes.select("class", "first", "rows").join(labels, "class"), "near-linked")
    tops = written(linked.groupBy("label").agg(F.min("first").alias("top"), F.count("*").alias("classes")), "near-tops")
    linked = hot_join(linked, tops, "label", "classes").select("class", "top")
    by_class = written(
        classes.select("class", "first", "rows").join(linked, "class", "left").select("class", "rows", F.coalesce("top", "first").alias("top")), "near-components"
    )
    here = (F.col("file") == F.col("top.file")) & (F.col("row") == F.col("top.row"))
    return hot_join(drawn.drop("bands"), by_class, "class", "rows").select(
        "doc_id",
        "file",
        "row",
        F.col("n").alias("n_shingles"),
        F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("component_id"),
        (F.col("top").isNull() | here).alias("kept"),
    )


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """``doc_id, file, row, n_shingles, component_id, kept``: one row for each row of ``docs``.

    ``component_id`` is the least id that links lead to; ``kept`` holds for one row of each
    component, one with that id, and for every row without words.
    """
    return components(*located(docs), k, percent, block)


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but for near duplicates: one of each component, with all columns."""
    rows, at = located(docs)
    dropped = written(components(rows, at, k, percent).where(~F.col("kept")).select("file", "row", F.lit(1).alias("n")), "near-dropped")
    found, n = numbered(rows, at, dropped, 1)
    return found.where(F.col(n) == 0).drop(at, n)
