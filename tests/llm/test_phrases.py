"""Frequent phrases and their scores against counting every run of words."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pairlocus.llm import phrases


def brute(rows, least, words, top, absorbed=80):
    counts, n = {}, Counter()
    for text, lang in rows:
        f = counts.setdefault(lang if lang is not None else "und", Counter())
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lower):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang if lang is not None else "und"] += len(ws)
            for m in range(1, words + 1):
                f.update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in often.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= absorbed * f[p[i : i + m]]}
        rows = []
        for p, a in often.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def made(spark, rows, tmp_path, **options):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(t, lang, "x", 1) for t, lang in rows], "text string, lang string, words string, n int").repartition(3).write.parquet(path)
    return sorted(map(tuple, phrases.collocations(spark.read.parquet(path), **options).collect()))


@pytest.mark.parametrize(("least", "words", "top", "block"), [(2, 4, 2000, 1 << 20), (3, 3, 10, 1 << 20), (5, 5, 50, 1 << 20)])
def test_equals_brute_force(spark, tmp_path, least, words, top, block):
    rng = np.random.default_rng(least)
    vocabulary = np.array(["a", "B", "the", "cat", "Ä", "日本", "x y", "-", "\x00", "hot", "dog"])
    rows = [("".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", " "]) for w in rng.choice(vocabulary, rng.integers(0, 80))), rng.choice(["en", "fr"])) for _ in range(120)]
    rows += [("the hot dog of the hot dog the the the the", None)] * 40 + [("the hot dog", "und"), (None, "en"), ("", "de"), (" \t.,\n", "nl")]
    assert made(spark, rows, tmp_path, least=least, words=words, top=top, block=block) == brute(rows, least, words, top)


def test_pieces_and_documents_part_phrases(spark, tmp_path):
    rows = [("one two. three", "en"), ("four", "en")] * 40
    assert [r[2] for r in made(spark, rows, tmp_path)] == ["one two"]


def test_no_rows(spark, tmp_path):
    assert made(spark, [], tmp_path) == []


def test_long_text_is_one_block(spark, tmp_path):
    rows = [("a b c " * 200_000, "en")]
    assert made(spark, rows, tmp_path, block=1 << 20) == brute(rows, 30, 4, 2000)


def test_numbers_and_words_pack():
    for values in ([], [0], [0, 255, 256], [2**40, 1]):
        assert phrases.unpacked(phrases.packed(np.array(values, np.int64))).tolist() == values
    words = ["ä", "", "x" * 1000][::2]
    assert phrases.unpacked_words(phrases.packed_words(pa.array(words))) == words


def test_scores_past_64_bits(spark):
    big = 9 * 10**15
    rows = [(1, ["a"], big + 1), (1, ["b"], big + 1), (2, ["a", "b"], big)]
    frequent = spark.createDataFrame([("en", *r) for r in rows], "lang string, length int, words array<string>, times long")
    (row,) = phrases.scored(frequent).collect()
    assert row["score"] == 2_000_000 * big // (2 * big + 2)
