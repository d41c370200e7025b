import functools
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import words
from pyspark.sql import functions as F

from pairlocus.llm import toxicity

RUDE = ["zarkoff", "quixblat", "worfnag", "jyxcrud"]


@pytest.fixture
def labelled(spark, make_docs):
    rng = random.Random(1)
    vocabulary = words(rng, 800)
    rows, labels = [], []
    for i in range(1500):
        text = rng.choices(vocabulary, k=rng.randint(5, 200))
        toxic = int(rng.random() < 0.2)
        for _ in range(toxic * max(1, len(text) // 30)):
            text[rng.randrange(len(text))] = rng.choice(RUDE) + rng.choice(["", "", rng.choice("abcdef")])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    return make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels}


def test_held_out_accuracy(labelled):
    docs, labels, truth = labelled
    out = toxicity.scored(docs, labels, bits=18).collect()
    assert len(out) == len(truth)
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_scores_use_texts_only(labelled, make_docs):
    docs, labels, _ = labelled
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect()]
    model = toxicity.fit(docs, labels, bits=18)
    score = toxicity.scorer(docs.sparkSession, model)
    again = make_docs([(9_000 + i, t, "other") for i, t in enumerate(texts)])
    a = [r.s for r in docs.orderBy("doc_id").limit(40).select("doc_id", score(F.col("text")).alias("s")).orderBy("doc_id").collect()]
    b = [r.s for r in again.select("doc_id", score(F.col("text")).alias("s")).orderBy("doc_id").collect()]
    assert a == b


def test_kneser_ney_probabilities_sum_to_one_at_most(spark):
    grams = spark.createDataFrame([("abcde", 3, 1), ("abcdf", 0, 2), ("xbcde", 1, 1)], "gram string, toxic long, ordinary long")
    p = {r.gram: r.p for r in toxicity.shared_backoff(grams).collect()}
    assert set(p) == {"bcde", "bcdf"} and 0 < sum(p.values()) <= 1
    llr = {r.gram: r.llr for r in toxicity.evidence(grams).collect()}
    assert llr["abcde"] > 0 > llr["abcdf"]


def test_filter_keeps_clean_documents_and_columns(labelled):
    docs, labels, truth = labelled
    left = toxicity.without_toxic(docs, labels, bits=18)
    assert left.columns == docs.columns
    kept = {r.doc_id for r in left.select("doc_id").collect()}
    clean = [i for i, t in truth.items() if not t]
    assert np.mean([i in kept for i in clean]) > 0.98
    assert np.mean([i in kept for i, t in truth.items() if t]) < 0.1


def test_odd_rows_and_labels(spark, make_docs, odd_rows):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 0, None), (None, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.scored(make_docs(odd_rows), labels, bits=12).collect()
    assert len(out) == len(odd_rows) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.scored(make_docs([]), labels.limit(0), bits=12).count() == 0


def test_every_ngram_keeps_its_own_evidence(labelled, make_docs):
    """However few n-grams are broadcast and however many n-grams carry nothing, none are averaged."""
    docs, labels, truth = labelled
    rng = random.Random(3)
    junk = [(10_000 + i, " ".join("".join(rng.choices("0123456789abcdef", k=16)) for _ in range(60))) for i in range(300)]
    out = {}
    for bits in (2, 18):
        model = toxicity.fit(docs.unionByName(make_docs(junk)), labels, bits=bits)
        score = toxicity.scorer(docs.sparkSession, model)
        joined = docs.select("doc_id", "text", toxicity.text_key(docs).alias("key")).join(model.scores(), "key")
        rows = joined.select("doc_id", "score", score(F.col("text")).alias("alone")).collect()
        assert len(rows) == len(truth) and all(abs(r.score - r.alone) < 1e-9 for r in rows)
        out[bits] = {r.doc_id: r.score for r in rows}
    assert max(abs(out[2][i] - out[18][i]) for i in truth) < 1e-9
    assert np.mean([(out[2][i] >= 0.5) == t for i, t in truth.items()]) > 0.97


def plain_evidence(texts):
    """{5-gram: toxic less ordinary log-likelihood} of (text, label) by plain interpolated Kneser-Ney."""
    d = toxicity.DISCOUNT
    grams = {1: Counter(), 0: Counter(), None: Counter()}
    for text, label in texts:
        for word in text.lower().split():
            padded = toxicity.START * 4 + word + toxicity.STOP
            grams[label].update(padded[i : i + 5] for i in range(len(padded) - 4))
    types = set().union(*grams.values())

    @functools.cache
    def continuations(n):
        wider = {g[4 - n :] for g in types}
        found = Counter(w[1:] for w in wider)
        heads, kinds = Counter(), Counter()
        for g, k in found.items():
            heads[g[:-1]] += k
            kinds[g[:-1]] += 1
        return found, heads, kinds

    @functools.cache
    def lower(gram):
        if not gram:
            return 1 / toxicity.ALPHABET
        found, heads, kinds = continuations(len(gram))
        return (max(found[gram] - d, 0) + d * kinds[gram[:-1]] * lower(gram[1:])) / heads[gram[:-1]]

    def top(gram, label):
        same = {g: n for g, n in grams[label].items() if g[:4] == gram[:4]}
        if not same:
            return lower(gram[1:])
        return (max(grams[label][gram] - d, 0) + d * len(same) * lower(gram[1:])) / sum(same.values())

    return {g: math.log(top(g, 1)) - math.log(top(g, 0)) for g in types}


def test_evidence_equals_plain_kneser_ney(spark, make_docs):
    rng = random.Random(6)
    # Characters for private use and the like are characters as others.
    vocabulary = [*words(rng, 60), "\ue000x", "pages\ue001from", "\ue001", "a\x00", "\u0301", "\U0010ffff"]
    texts = [(" ".join(rng.choices(vocabulary + RUDE[: 4 * (i % 3 == 0)], k=rng.randint(0, 30))), [1, 0, 0, None][i % 4]) for i in range(60)]
    want = plain_evidence(texts)
    rows = spark.createDataFrame(texts, "text string, toxic int")
    grams = toxicity.evidence(toxicity.gram_counts(toxicity.word_counts(rows)))
    got = {r.gram: r.llr for r in grams.select("gram", "llr").collect()}
    assert set(got) == set(want) and all(abs(got[g] - want[g]) < 1e-9 for g in want)
    # The features of whole documents, from a model of labelled ones.
    docs = make_docs([(i, t) for i, (t, _) in enumerate(texts)])
    labels = spark.createDataFrame([(i, 1, t) for i, (_, t) in enumerate(texts)], "doc_id long, quality int, toxic int")
    counted = [(t, y if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3) else None) for i, (t, y) in enumerate(texts)]
    llr = plain_evidence(counted)
    found = {bytes(r.key): r for r in toxicity.fit(docs, labels, bits=4).texts.collect()}
    for text, _ in texts:
        by_word = [sum(llr[p[i : i + 5]] for i in range(len(p) - 4)) for w in text.split() if (p := toxicity.START * 4 + w + toxicity.STOP)]
        r = found[hashlib.md5(text.encode()).digest()]
        assert r.mean == pytest.approx(sum(by_word) / max(len(by_word), 1), abs=1e-9)
        assert r.most == pytest.approx(max(by_word, default=0.0), abs=1e-9) and r.words == pytest.approx(math.log1p(len(by_word)))


def test_stretches_make_no_difference():
    rng = random.Random(2)
    words_ = pa.array(["", "é😀" * 9, *("".join(rng.choices("abc", k=rng.randint(1, 30))) for _ in range(50))])
    whole = list(toxicity.word_grams(words_))
    assert len(whole) == 1
    for stretch in (1, 7, 64):
        parts = list(toxicity.word_grams(words_, stretch))
        for k in (1, 2, 3):
            assert np.array_equal(np.concatenate([p[k] for p in parts]), whole[0][k])
    line, ends, _, word = whole[0]
    for n, w in enumerate(words_.to_pylist()):
        padded = toxicity.START * 4 + w + toxicity.STOP
        assert [line[e - 4 : e + 1] for e in ends[word == n]] == [padded[i : i + 5] for i in range(len(padded) - 4)]
