import random
from collections import Counter, defaultdict

from conftest import words

from pairlocus.llm import suffixes


def brute(rows, n=suffixes.SHORTEST):
    """Every row is a document of its own, whatever its id."""
    texts = [(r[1] or "").encode().lower().split() for r in rows]
    owners = defaultdict(set)
    for i, w in enumerate(texts):
        for s in range(len(w) - n + 1):
            owners[tuple(w[s : s + n])].add(i)
    out = Counter()
    for i, w in enumerate(texts):
        spans = []
        for s in range(len(w) - n + 1):
            if len(owners[tuple(w[s : s + n])]) > 1:
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + n
                else:
                    spans.append([s, s + n])
        out.update((rows[i][0], a, b) for a, b in spans)
    return out


def test_against_brute_force(make_docs):
    rng = random.Random(7)
    passages = [words(rng, n) for n in (49, 50, 51, 55, 60, 64, 80, 200)]
    rows = []
    for i in range(150):
        text = words(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.choice([0, 0, rng.randint(0, 12)])
            text += p[cut:] + words(rng, rng.randint(0, 30))
        rows.append((i, " ".join(text).capitalize()))
    # Rows without an id, and rows that repeat one with the same and with another text.
    rows += [(None, rows[3][1]), (None, rows[3][1]), (7, rows[7][1]), (7, rows[8][1])]
    got = Counter(tuple(r) for r in suffixes.repeated_passages(make_docs(rows)).collect())
    assert got == brute(rows) and len(got) > 50


def test_runs_over_many_ranges(spark, tmp_path):
    """Equal keys that begin and end in other ranges, of one document and of many."""
    rng = random.Random(8)
    rows = [(k, f, r, n) for k in range(6) for f in range(2) for r in range(rng.choice([1, 1, 9])) for n in range(rng.choice([1, 30]))]
    rows += [(100, 1, 1, n) for n in range(90)] + [(101, 1, r, 0) for r in range(90)]
    table = str(tmp_path / "rows")
    spark.createDataFrame(rows, "key long, file long, row long, at int").write.parquet(table)
    docs = defaultdict(set)
    for k, f, r, _ in rows:
        docs[k].add((f, r))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "13", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = suffixes.with_neighbours(spark.read.parquet(table), ["key"], "at", "test").collect()
            assert Counter(map(tuple, got)) == Counter(r for r in rows if len(docs[r[0]]) > 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_same_words_throughout(make_docs):
    rows = [(1, "la " * 300), (2, "LA " * 120), (3, "x " + "la " * 49)]
    assert {tuple(r) for r in suffixes.repeated_passages(make_docs(rows)).collect()} == {(1, 0, 300), (2, 0, 120)}


def test_odd_rows(make_docs, odd_rows):
    assert suffixes.repeated_passages(make_docs(odd_rows)).count() == 0
    assert suffixes.repeated_passages(make_docs([])).count() == 0
    twice = odd_rows + [(50, odd_rows[7][1])]
    found = {tuple(r) for r in suffixes.repeated_passages(make_docs(twice)).collect()}
    assert found == {(5, 0, 30_000), (50, 0, 30_000)}
