import math
import random
from collections import Counter

import corpus_pipeline
import duckdb
from conftest import words
from tokenizers import Tokenizer

import __spark_entry__
from pairlocus.llm import minhash, mixing, packing, queries
from pairlocus.llm.queries import tokenizer_file


def test_stages_follow_each_other(spark, tmp_path, make_docs):
    rng = random.Random(3)
    vocabulary = words(rng, 500)
    rows, labels = [], []
    for i in range(400):
        text = rng.choices(vocabulary, k=rng.randint(20, 120))
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = "zarkoffblat"
        rows.append((i, " ".join(text), rng.choice("abc")))
        labels.append((i, 1, toxic))
    rows += [(1000 + i, r[1].upper(), r[2]) for i, r in enumerate(rows[1:40:2])]
    near = [(2000 + i, r[1] + " tail", r[2]) for i, r in enumerate(rows[2:60:3]) if len(r[1].split()) > 60]
    rows += near
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = str(tmp_path / name.replace(" ", "_"))
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == columns
        kept.append(docs.count())
        texts = [r.text for r in docs.select("text").collect()]
        if name == "toxicity":
            assert sum("zarkoff" in t.lower() for t in texts) <= 2
            assert kept[1] >= sum("zarkoff" not in r[1].lower() for r in rows) - 4
        if name == "exact dedup":
            assert len({t.lower() for t in texts}) == len(texts)
        if name == "near dedup":
            left = minhash.near_duplicates(docs).collect()
            assert all(r.component_id == r.doc_id for r in left)
            before = docs
        if name == "source mix":
            taken = mixing.mix(before).groupBy().sum("taken").first()[0]
            assert abs(sum(len(t.split()) for t in texts) - taken) < 0.05 * taken
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    plain = packing.cut(docs, tokenizer_file("byte_bpe_50k.json")).collect()
    assert sorted((r.doc_id, r.ids_crc32) for r in packed) == sorted((r.doc_id, r.ids_crc32) for r in plain)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.ids_crc32) for r in packed)
    assert kept[0] > kept[1] > kept[2] > kept[3]


def test_odd_rows_and_empty_tables(spark, tmp_path, make_docs, odd_rows):
    """Every stage takes nulls, empty and repeated rows and clashing columns, and empty tables."""
    rows = odd_rows * 2 + [(50 + i, f"word{i} and others", None if i % 2 else "s") for i in range(20)]
    for name, some in (("some", rows), ("none", [])):
        folder = tmp_path / name
        make_docs(some).write.parquet(str(folder / "documents.parquet"))
        labels = [(i, 1, i % 2) for i in range(60)] + [(None, None, None)] if some else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            stage(spark, docs, str(folder)).write.parquet(str(folder / f"stage{number}"))
            columns, docs = docs.columns, spark.read.parquet(str(folder / f"stage{number}"))
            assert docs.columns == columns
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert bool(out) == bool(some)
        assert len({r.doc_id for r in out}) == docs.select("doc_id").distinct().count()


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}


RUDE = ("zarkoffblat", "quixnagler")


def plain_pipeline(rows, folder):
    """Rows (doc_id, text, source) that the stages keep, by brute force: what packing gets."""
    clean = [r for r in rows if not any(w in r[1].lower() for w in RUDE)]
    latest = {}
    for r in clean:
        key = r[1].lower()
        if key not in latest or r[0] > latest[key][0]:
            latest[key] = r
    single = sorted(latest.values())
    sets = []
    for _, text, _ in single:
        w = text.lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))))
    root = list(range(len(single)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                low, high = sorted((find(i), find(j)))
                root[high] = low  # rows are in order of their ids: the least one stays
    kept = [r for i, r in enumerate(single) if find(i) == i]
    # The mix is the query's SQL on what is kept.
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", kept)
    taken = {r[0]: (r[1], r[2]) for r in con.execute(f"SELECT doc_id, size, taken FROM ({queries.ORACLE_SQL['op7_source_mix']})").fetchall()}
    out = []
    for r in kept:
        size, words_taken = taken[r[0]]
        out += [r] * math.floor(words_taken / size + 0.5)
    return clean, single, kept, out


def test_against_brute_force(spark, tmp_path, make_docs):
    rng = random.Random(8)
    vocabulary = words(rng, 400)
    rows, labels = [], []
    for i in range(500):
        text = rng.choices(vocabulary, k=rng.randint(30, 150))
        if i % 6 == 0:
            for _ in range(len(text) // 8):
                text[rng.randrange(len(text))] = rng.choice(RUDE)
        rows.append((i, " ".join(text), rng.choice("aabcd")))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1000 + i, r[1].upper() if i % 2 else r[1], r[2]) for i, r in enumerate(rows[1:60:2])]
    for n, r in enumerate(rows[7:150:6]):  # chains of edits
        text = r[1].split()
        for k in range(3):
            text = [*text[: len(text) - 3 * (k % 2)], *words(rng, 2)]
            rows.append((2000 + 10 * n + k, " ".join(text), r[2]))
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = plain_pipeline(rows, tmp_path)
    assert len(rows) > len(want[0]) > len(want[1]) > len(want[2])
    for (name, stage), left in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        out = str(tmp_path / name.replace(" ", "_"))
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        assert Counter(r.doc_id for r in docs.collect()) == Counter(r[0] for r in left), name
    own = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    sizes = Counter((r[0], len(e.ids) + 1) for r, e in zip(want[-1], own.encode_batch([r[1] for r in want[-1]], add_special_tokens=False), strict=True))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.length) for r in packed) == sizes  # none is longer than a sequence
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= 1.05 * sum(used.values()) / 2048 + 1
