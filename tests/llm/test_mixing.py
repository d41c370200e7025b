import random
from fractions import Fraction

import pytest
from conftest import words
from pyspark.sql import functions as F

from pairlocus.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), limit=2):
    """Shares by weight, excess reshared round by round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] >= limit * sizes[s] * total}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = Fraction(limit * sizes[s])
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def highest_quotients(votes, seats):
    out = dict.fromkeys(votes, 0)
    for _ in range(seats):
        out[min((k for k in votes if votes[k]), key=lambda k: (-votes[k] / (out[k] + 0.5), k))] += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_sainte_lague(spark, seed):
    rng = random.Random(seed)
    votes = {f"k{i:02}": rng.choice([0, 1, 3, 7, rng.randint(1, 2000)]) for i in range(rng.randint(1, 14))}
    seats = rng.randint(0, 60) if any(votes.values()) else 0
    df = spark.createDataFrame([(0, k, float(v), seats) for k, v in votes.items()], "g int, k string, v double, s long")
    got = {r.k: r.quota for r in mixing.sainte_lague(df, ["g"], "k", "v", "s").collect()}
    assert got == highest_quotients(votes, seats)


def test_targets_and_taken(make_docs):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, rng.randint(0, 90))), rng.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(600)]
    out = mixing.mix(make_docs(rows), shard_words=3000).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want, got = targets(sizes), {}
    assert len(out) == len(rows)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]))
        assert 0 <= r.taken <= 2 * r["size"]
        got[r.source] = got.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(got[s] - float(t)) <= 64 + 0.01 * float(t)


def test_same_result_whatever_the_partitions(make_docs, odd_rows):
    docs = make_docs(odd_rows * 3)
    a = sorted(map(str, mixing.mix(docs).collect()))
    assert a == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert len(a) == len(odd_rows) * 3


def test_empty_and_wordless(make_docs):
    assert mixing.mix(make_docs([])).count() == 0
    rows = mixing.mix(make_docs([(1, None), (2, " ")])).collect()
    assert [(r["size"], r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_mixed_documents(make_docs):
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, 40)), rng.choice("abcd")) for i in range(400)]
    docs = make_docs(rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t")).collect()
    for r in taken:
        words_out = mixed.where(F.col("source") == r.source).count() * 40
        assert abs(words_out - r.t) <= 80


def test_repeated_rows_keep_to_their_quota(make_docs):
    """Rows without an id or with a repeated one are taken row by row; a source without ids is many shards."""
    rows = [(None, f"w{i % 50} " * 20, "a") for i in range(600)] + [(7, "x y z " * 10, "b")] * 200
    docs = make_docs(rows)
    taken = {r.source: r.t for r in mixing.mix(docs, shard_words=1000).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    mixed = {r.source: r.n for r in mixing.mixed_documents(docs, shard_words=1000).groupBy("source").agg(F.count("*").alias("n")).collect()}
    shards = {"a": 12, "b": 6}
    for source, size in (("a", 20), ("b", 30)):
        assert abs(mixed[source] * size - taken[source]) <= 2 * size * shards[source]
    # Shards of a source are at most so many, and then larger.
    few = mixing.mix(docs, shard_words=1000, most_shards=2).collect()
    assert len(few) == len(rows) and abs(sum(r.taken for r in few) - sum(taken.values())) <= 64 * 4
