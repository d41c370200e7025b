import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import words

from pairlocus.llm import minhash


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()


def brute(rows, k, percent):
    sets = [shingles(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return Counter((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def families(seed, number=30):
    """Chains of edits, so that some links go over others only."""
    rng = random.Random(seed)
    rows = []
    for _ in range(number):
        text = words(rng, rng.choice([1, 2, 4, 30, 120, 300]))
        for _ in range(rng.randint(1, 12)):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 30))):
                text[rng.randrange(len(text))] = words(rng, 1)[0]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_components(make_docs, odd_rows, seed, k, percent):
    rows = families(seed) + [(None if i is None else 10_000 + i, *r) for i, *r in odd_rows]
    out = minhash.near_duplicates(make_docs(rows), k, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(rows, k, percent)
    kept = Counter((r.component_id, r.n_shingles > 0) for r in out if r.kept and r.n_shingles)
    assert set(kept.values()) == {1}


@pytest.mark.parametrize("block", [1500, 4000])
def test_large_clusters_are_cut_in_blocks(make_docs, block):
    rows = families(5, 12)
    # Many near copies of one text, some of which are linked over others only.
    rng = random.Random(9)
    text = words(rng, 200)
    for n in range(40):
        own = list(text)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(200)] = words(rng, 1)[0]
        rows.append((len(rows), " ".join(own + words(rng, n // 4))))
    out = minhash.near_duplicates(make_docs(rows), 3, 85, block).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(rows, 3, 85)


def test_pages_of_one_template_are_parted(make_docs, monkeypatch):
    """Pages that share half their shingles, some with near copies: what is verified grows with them, not with their square."""
    seen = Counter()
    verified = minhash.verified_links

    def counted(rows, at, members, *options):
        sizes = members.groupBy("cluster").count().collect()
        seen["members"], seen["most"] = sum(r["count"] for r in sizes), max((r["count"] for r in sizes), default=0)
        return verified(rows, at, members, *options)

    monkeypatch.setattr(minhash, "verified_links", counted)
    rng = random.Random(12)
    template = words(rng, 140)
    rows = []
    for n in range(2000):
        own = template + words(rng, 70)
        rows.append((n, " ".join(own)))
        if n % 50 == 0:
            rows += [(10_000 + n, " ".join([*own[:-2], "other", "end"])), (20_000 + n, " ".join([*own, "tail"]))]
    found = minhash.near_duplicates(make_docs(rows), 3, 85, 50_000).collect()
    assert Counter(r.component_id for r in found if r.component_id != r.doc_id) == Counter({n: 2 for n in range(0, 2000, 50)})
    # Families of three, and few pages that share a rare shingle by chance, in small clusters.
    assert seen["members"] <= 500 and seen["most"] <= 20


def test_rarest_shingles_meet_wherever_sets_are_linked():
    rng = np.random.default_rng(8)
    known = np.arange(1, 60, dtype=np.uint64)
    times = rng.integers(2, 9, len(known))
    for _ in range(2000):
        a, b = (np.unique(rng.integers(1, 90, rng.integers(1, 60)).astype(np.uint64)) for _ in "ab")
        if rng.random() < 0.8:
            b = np.unique(np.concatenate((a[: len(a) - len(a) // 12], b[: len(a) // 12])))
        for percent in (80, 85, 100):
            common = len(np.intersect1d(a, b))
            if 100 * common >= percent * (len(a) + len(b) - common):
                assert len(np.intersect1d(*(minhash.rarest(x, known, times, percent) for x in (a, b))))


def test_links_at_the_threshold_are_found():
    """Bands find nearly all pairs at 0.85, and the count of common shingles is exact for large sets."""
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(300):
        common = rng.integers(1, 2**63, 170, np.int64).astype(np.uint64)
        a, b = (np.unique(np.concatenate((common, rng.integers(1, 2**63, 15, np.int64).astype(np.uint64)))) for _ in "ab")
        keys = minhash.band_keys(minhash.sketches(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])))
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0
    n = 1_000_000
    whole = np.arange(1, 2 * n, dtype=np.uint64)
    # 850,001 of 1,000,001 and 849,999 of 1,000,000: one side of the threshold each.
    near, far = whole[:850_001], whole[:849_999]
    assert minhash.linked_roots([whole[:1_000_000], near], 85).tolist() == [0, 0]
    assert minhash.linked_roots([whole[:1_000_000], far], 85).tolist() == [0, 1]


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    whole = np.unique(rng.integers(1, 2**63, 400, np.int64).astype(np.uint64))
    sets = [whole[:300], whole[100:400], whole[:1], whole[:0]]
    begin = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    cells = minhash.sketches(np.concatenate(sets), begin, 2000)
    assert (cells[:3] != np.uint64(2**64 - 1)).all() and (cells[3] == 0).all()
    assert abs((cells[0] == cells[1]).mean() - 0.5) < 0.06


def test_connected(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.label for r in minhash.connected(edges).collect()} == {i: 0 for i in range(1, 41)} | {101: 100}


def test_one_of_each(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    left = minhash.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [1, 3, 4, None, None, 5, 6, 7, 8, 9]))
    assert minhash.one_of_each(make_docs([])).count() == 0


def test_kept_of_the_query_is_by_id(spark, tmp_path):
    """Of rows that repeat an id all are kept or none, as the query's contract has it."""
    rows = [(7, "a b c d"), (7, "a b c d"), (9, "A B C D"), (3, ""), (3, ""), (None, "x y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from pairlocus.llm import queries

    out = sorted(((r.doc_id, r.component_id, r.kept) for r in queries.op1_minhash(spark, str(tmp_path)).collect()), key=str)
    assert out == sorted([(7, 7, True), (7, 7, True), (9, 7, False), (3, 3, True), (3, 3, True), (None, None, True)], key=str)
