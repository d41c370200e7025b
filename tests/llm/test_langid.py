import math
import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import words

from pairlocus.llm import langid

SOUNDS = {"de": ("schtz", "üäo"), "en": ("thwnd", "eaio"), "fr": ("lqrv", "éèu")}


def prose(rng, lang, n):
    a, b = SOUNDS[lang]
    return " ".join("".join(rng.choice(a) + rng.choice(b) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture
def corpus(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, 60), lang) for i in range(200) for lang in SOUNDS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_evidence_is_fused(spark, corpus):
    rng = random.Random(2)
    rows, truth = [], {}
    for i in range(300):
        lang = rng.choice(list(SOUNDS))
        declared = lang if rng.random() < 0.9 else rng.choice(list(SOUNDS))
        text = prose(rng, lang, rng.choice([0, 40, 200]))
        aside = prose(rng, "en", 80)
        page = f'<!DOCTYPE html><html lang="{declared}"><head><title>{aside}</title></head><body><nav>{aside}</nav><!-- {aside} --><p>{text}</body></html>'
        rows.append((i, f"https://{lang}host.example.{lang if lang != 'en' else 'com'}/x", page))
        truth[i] = lang
    out = {r.page_id: r for r in langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), corpus).collect()}
    assert len(out) == 300
    assert sum(out[i].lang == t for i, t in truth.items()) / 300 > 0.97
    assert all(0 < r.probability <= 1 + 1e-9 for r in out.values())
    # Pages without text are told by address, declaration and their host's other pages.
    bare = [i for i, r in out.items() if r.text_lang is None]
    assert bare and sum(out[i].lang == truth[i] for i in bare) / len(bare) > 0.95


def test_odd_pages(spark, corpus):
    schema = "page_id long, url string, html string, lang string, host string"
    rows = [(1, None, None, "x", "y"), (None, "", "", "x", "y"), (2, "not an address", "<" * 50_000, "x", "y"), (2, "not an address", "<" * 50_000, "x", "y"), (3, "http://h.de/", "<script>" * 5_000 + prose(random.Random(1), "de", 20_000), "x", "y")]
    out = langid.identify(spark.createDataFrame(rows, schema), corpus).collect()
    assert len(out) == len(rows) and all(r.lang in SOUNDS for r in out)
    assert langid.identify(spark.createDataFrame([], schema), corpus).count() == 0
    unknown = langid.identify(spark.createDataFrame(rows, schema), corpus.where("lang = 'none'")).collect()
    assert [r.lang for r in unknown] == [None] * len(rows)


def test_main_text():
    page = "<html><head>no</head><p>yes &amp; <b>so</b><!-- no --><nav>no<ul>no</nav>too<style>no</style></html><script>no"
    assert langid.main_text(page).split() == ["yes", "&", "so", "too"]
    assert words(random.Random(1), 1)


def test_every_language_is_in_the_model(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, "en", 20), "en") for i in range(3000)] + [(5000, prose(rng, "de", 20), "de")]
    languages, _ = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_rows=30)
    assert languages == ["de", "en"]


def test_many_odd_languages(spark, corpus):
    """Thousands of odd values are one language; the real ones stay as they are."""
    rng = random.Random(8)
    odd = [(10_000 + i, prose(rng, "fr", 5), f"x{i}") for i in range(3000)]
    docs = corpus.union(spark.createDataFrame(odd, corpus.schema)).where("lang != 'fr'")
    languages, table = langid.fit(docs, most_languages=2)
    assert languages == ["de", "en", langid.OTHER] and table.shape == (3, 1 << 16) and table.dtype == np.float32
    alone, rows = langid.fit(corpus.where("lang != 'fr'"))
    assert alone == ["de", "en"] and (table[:2] == rows).all()
    pages = [(i, "http://h.example/", f"<p>{prose(rng, lang, 80)}") for i, lang in enumerate(["de", "en", "fr"])]
    found = langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs, most_languages=2)
    assert {r.page_id: r.text_lang for r in found.collect()} == {0: "de", 1: "en", 2: langid.OTHER}


def test_declared_language_after_a_long_comment(spark, corpus):
    pages = [(1, "http://h.example/", "<!--" + " x" * 9000 + "--><html lang='fr'><body>")]
    (row,) = langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), corpus).collect()
    assert row.declared == "fr"


def test_elements_that_are_not_closed():
    page = "<head><meta charset=x><title>no</title><script>if (a<b) no</script><!-- <p>no --><link href=y>"
    assert langid.main_text(page + "<body><p>yes").split() == ["yes"]
    assert langid.main_text(page + "<p>yes<nav>no</nav>too").split() == ["yes", "too"]
    assert langid.main_text("<p>yes<NAV class=no>links<p>stay").split() == ["yes", "links", "stay"]
    assert langid.main_text("\u0130" * 9 + "<p>yes<script>no</script>too").split()[-2:] == ["yes", "too"]


def plain_fusion(rows, languages, strength=4.0):
    """Priors, trust and fusion of ``page_evidence`` rows in plain Python: page to (language, probability)."""
    n = len(languages)
    votes = [int(np.argmax(r.text)) if max(r.text) > min(r.text) else None for r in rows]

    def counted(of):
        out = defaultdict(lambda: [0.0] * n)
        for r, v in zip(rows, votes, strict=True):
            if v is not None:
                out[of(r)][v] += 1
        return out

    def prior(counts, wider):
        return [(c + strength * w) / (sum(counts) + strength) for c, w in zip(counts, wider, strict=True)]

    hosts, suffixes, every = counted(lambda r: r.host), counted(lambda r: r.suffix), counted(lambda r: 0)[0]
    kind = lambda x: x if x in languages else "?"
    trust = {}
    for c in ("declared", "addressed"):
        by = counted(lambda r: kind(r[c]) if r[c] is not None else None)  # noqa: B023
        by.pop(None, None)
        whole = [sum(v[i] for v in by.values()) for i in range(n)]
        trust[c] = lambda x, by=by, whole=whole: [math.log((by[x][i] + 0.5) / (whole[i] + 0.5 * (n + 1))) for i in range(n)]
    out = {}
    for r, v in zip(rows, votes, strict=True):
        others = [c - (i == v) for i, c in enumerate(hosts[r.host])]
        logs = prior(others, prior(suffixes[r.suffix], prior(every, [1 / n] * n)))
        total = [t + math.log(p) for t, p in zip(r.text, logs, strict=True)]
        for c in trust:
            if r[c] is not None:
                total = [a + b for a, b in zip(total, trust[c](kind(r[c])), strict=True)]
        best = max(range(n), key=lambda i: (total[i], -i))
        out[r.page_id] = (languages[best], 1 / sum(math.exp(t - total[best]) for t in total), None if v is None else languages[v])
    return out


def test_fusion_equals_plain_python(spark, corpus):
    rng = random.Random(6)
    rows = []
    for i in range(250):
        lang = rng.choice(list(SOUNDS))
        declared = rng.choice([f'<html lang="{lang}">', f'<html lang="{rng.choice(["en", "xx"])}">', "<html>"])
        url = rng.choice([None, f"https://{rng.choice('ab')}.example.{rng.choice(['de', 'fr', 'com'])}/{rng.choice(['', 'fr/x', 'x'])}", "https://hot.example.org/"])
        rows.append((i, url, f"{declared}<p>{prose(rng, lang, rng.choice([0, 0, 2, 30]))}"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    languages, table = langid.fit(corpus)
    want = plain_fusion(langid.page_evidence(pages, languages, table).collect(), languages)
    got = {r.page_id: r for r in langid.identify(pages, corpus).collect()}
    assert set(got) == set(want)
    for i, (lang, p, text_lang) in want.items():
        assert got[i].text_lang == text_lang
        assert got[i].probability == pytest.approx(p, rel=1e-6)
        assert got[i].lang == lang
