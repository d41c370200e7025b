import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import words
from pyspark.sql import functions as F

from pairlocus.llm import fingerprint as fp
from pairlocus.llm.text import located


def jaccard(a, b):
    a, b = Counter(fp.paragraphs(a)), Counter(fp.paragraphs(b))
    every = sum((a | b).values())
    return sum((a & b).values()) / every if every else 1.0


def test_peeling_recovers_the_differences():
    rng = np.random.default_rng(1)
    shared, left, right = (rng.integers(1, 2**63, n, np.int64).astype(np.uint64) for n in (500, 7, 5))
    zero = lambda x: np.zeros(len(x), np.int64)
    a, b = np.concatenate((shared, left)), np.concatenate((shared, right))
    table = fp.Sketches(a, zero(a), np.array([16])).minus(fp.Sketches(b, zero(b), np.array([16])))
    keys, _, sides, done = table.peel()
    assert done.all()
    assert set(keys[sides == 1]) == set(left) and set(keys[sides == -1]) == set(right)


def test_against_brute_force(make_docs):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        text = ". ".join(" ".join(words(rng, rng.randint(1, 12))) for _ in range(rng.choice([0, 1, 5, 40, 300])))
        rows.append((i * 3, text + "\nAgain.\nAgain." if i % 7 == 0 else text))
    for i in (10, 20):
        rows[i + 1] = (rows[i + 1][0], rows[i][1])
    docs = make_docs(rows)
    out = {r.doc_id: r for r in fp.fingerprints(docs).collect()}
    assert len(out) == len(rows)
    for n, (doc_id, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        new, r = fp.edited(text, after), out[doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.near_edited == pytest.approx(jaccard(text, new)) and r.near_next == pytest.approx(jaccard(text, after))
    assert out[rows[10][0]].fingerprint == out[rows[11][0]].fingerprint


@pytest.mark.parametrize("ids", [list(range(50)), [7] * 50, [None] * 20 + [3] * 20 + [9, 9, 10, 11, 11, 11, 11, 12, 13, 14]])
def test_parts_make_no_difference(make_docs, ids):
    """Each row is followed by the next one by id, then by place, whatever the parts; no part has much more than its share."""
    docs = make_docs([(i, f"text {n}. and more {n % 3}") for n, i in enumerate(ids)])
    placed, at = located(docs)
    order = [(r.doc_id if r.doc_id is not None else fp.FIRST_ID, *r[at], r.text) for r in placed.collect()]
    want = Counter((a[-1], b[-1]) for a, b in zip(sorted(order), sorted(order)[1:] + sorted(order)[:1]))
    for size in (7, 1000):
        parts = {}
        for r in fp.neighboured(docs, size, 1).collect():
            parts.setdefault(r.part, []).append(r)
        assert len(parts) > 3 if size == 7 else len(parts) == 1
        assert max(map(len, parts.values())) <= 3 * size
        assert all([r.guest for r in own] == [False] * (len(own) - 1) + [True] for own in parts.values())
        assert Counter((a.text, b.text) for own in parts.values() for a, b in zip(own, own[1:])) == want


def test_an_edit_changes_what_it_touches():
    """One letter put into a long sentence changes one or two of its paragraphs."""
    rng = random.Random(4)
    text = " ".join(words(rng, 400))
    old, new = Counter(fp.paragraphs(text)), Counter(fp.paragraphs(text[:900] + "x" + text[900:]))
    assert sum((old - new).values()) <= 2 and sum((new - old).values()) <= 2 and len(old) > 50
    assert "".join(fp.paragraphs("y" * 5000 + " z. " + text)).replace(" ", "") == ("y" * 5000 + "z." + text).replace(" ", "")


def test_an_edit_of_text_without_spaces_changes_what_it_touches():
    """One character put before, or into, a long run of Chinese characters, with or without full stops."""
    rng = random.Random(6)
    for stops in ("", "。"):
        text = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) + (stops if rng.random() < 0.02 else "") for _ in range(5000))
        old = Counter(fp.paragraphs(text))
        assert "".join(fp.paragraphs(text)) == text and sum(old.values()) > 40
        for at in (0, 2500):
            new = Counter(fp.paragraphs(text[:at] + "好" + text[at:]))
            assert sum((old - new).values()) <= 2 and sum((new - old).values()) <= 2
    assert fp.paragraphs("一" * 100_000) == ["一" * 100_000]


def test_strings_give_the_likeness():
    """Two strings peel where texts differ by half or less, whatever the sizes of their tables."""
    rng = random.Random(7)
    peeled = asked = 0
    for n in (0, 1, 3, 10, 50, 400):
        for _ in range(20):
            text = ". ".join(" ".join(words(rng, rng.randint(3, 12))) for _ in range(n))
            new = fp.edited(text, ". ".join(" ".join(words(rng, 8)) for _ in range(rng.choice([n, 3 * n]))))
            out = fp.compare([text, new], [new, text])
            got = fp.likeness_of(*out["fingerprint"])
            asked += 1
            if got is not None:
                peeled += 1
                assert got == pytest.approx(out["near_next"][0]) == pytest.approx(jaccard(text, new))
    assert peeled > 0.95 * asked
    many = " ".join(f"{i:x}" for i in range(300_000))
    (string,) = fp.compare([many], [many])["fingerprint"]
    assert int(fp.table_of(string).count.sum()) == 3 * len(fp.paragraphs(many)) and fp.likeness_of(string, string) == 1.0


def test_recovered_paragraphs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(30):
        old = [" ".join(words(rng, rng.randint(1, 30))) for _ in range(rng.randint(0, 40))]
        new = [p for p in old if rng.random() > 0.2] + [" ".join(words(rng, 5)) for _ in range(rng.randint(0, 9))]
        rows.append((i, "\n".join(old + old[:1]), "\n".join(new)))
    rows.append((None, None, "only new"))
    df = spark.createDataFrame(rows, "doc_id long, text string, new_text string")
    paragraph = {(r.doc_id, r.digest): r.paragraph for c in ("text", "new_text") for r in fp.paragraph_digests(df.select("doc_id", F.col(c).alias("text"))).collect()}
    got = Counter((r.doc_id, r.side, paragraph[r.doc_id, r.digest]) for r in fp.changed_paragraphs(df).collect())
    want = Counter()
    for i, old, new in rows:
        a, b = Counter(fp.paragraphs(old or "")), Counter(fp.paragraphs(new or ""))
        want.update({(i, "old", p): n for p, n in (a - b).items()} | {(i, "new", p): n for p, n in (b - a).items()})
    assert got == want


def test_odd_rows(make_docs, odd_rows):
    out = fp.fingerprints(make_docs(odd_rows)).collect()
    assert len(out) == len(odd_rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert [(r.near_edited, r.near_next, r.n_chars) for r in fp.fingerprints(make_docs([(1, None)])).collect()] == [(1.0, 1.0, 0)]
    assert fp.fingerprints(make_docs([])).count() == 0
