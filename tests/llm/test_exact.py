import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from pairlocus.llm import exact


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        kept = False
        for i in sorted(ids, key=lambda i: (i is None, -(i or 0))):
            out.append((i, keep, len(ids), not kept, hashlib.sha256(text.encode()).hexdigest()))
            kept = True
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_odd_rows(make_docs, odd_rows):
    assert found(exact.find_duplicates(make_docs(odd_rows))) == brute(odd_rows)


def test_collisions_are_told_apart_by_bytes(make_docs, odd_rows):
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 1))
    docs = make_docs(odd_rows + [(100 + i, f"text {i % 20}") for i in range(60)])
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert found(exact.find_duplicates(docs, digest=weak)) == brute(rows)


def test_empty(make_docs):
    assert exact.find_duplicates(make_docs([])).count() == 0


def test_kept_rows_have_all_columns(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    left = exact.deduplicated(docs)
    assert left.columns == docs.columns
    assert left.count() == len({lower(r[1]) for r in odd_rows})


def test_any_plan_and_any_columns(spark, make_docs, odd_rows):
    """Rows that no place in a file tells apart are written first; own columns keep their names."""
    docs = make_docs(odd_rows)
    texts = len({lower(r[1]) for r in odd_rows})
    odd = docs.withColumn("_at", F.lit("a")).withColumn("_file", F.lit("b")).withColumn("_row", F.lit(1)).withColumn("_n", F.lit(2)).withColumn("_metadata", F.lit("m"))
    for again in (docs.unionByName(docs), docs.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))), docs.limit(100), odd, spark.createDataFrame(docs.collect(), docs.schema)):
        left = exact.deduplicated(again)
        assert left.columns == again.columns
        assert left.count() == texts
    assert {tuple(r) for r in exact.deduplicated(odd).select("_at", "_file", "_row", "_n", "_metadata").distinct().collect()} == {("a", "b", 1, 2, "m")}


def test_state_outlives_a_call(spark, tmp_path):
    def arrive(rows):
        spark.createDataFrame([(i, d.encode(), f, r) for i, d, f, r in rows], exact.ARRIVAL).write.mode("append").parquet(str(tmp_path / "in"))

    def seen():
        state = exact.remember(spark, str(tmp_path / "in"), str(tmp_path / "state"))
        return {(bytes(r.digest), r.stays.doc_id, r.seen) for r in state.collect()}

    arrive([(1, "d", 5, 0), (2, "e", 5, 1)])
    assert seen() == {(b"d", 1, 1), (b"e", 2, 1)}
    arrive([(9, "d", 6, 0)])
    assert seen() == {(b"d", 9, 2), (b"e", 2, 1)}
    # The keyed state lies in the checkpoint.
    stored = spark.read.format("statestore").load(str(tmp_path / "state" / "checkpoint"))
    assert {bytes(r.key.digest) for r in stored.select("key").collect()} == {b"d", b"e"}
