"""Packing along the curve: every id once, no padding, neighbours alike."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from pairlocus.llm import curve
from pairlocus.llm.queries import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_all_cells_by_single_steps(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    key = curve.hilbert(cells, bits)
    assert sorted(key) == list(range(1 << axes * bits))
    steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def checked(docs, capacity):
    """Pieces hold what the library gives, gaplessly, in sequences that need no padding."""
    rows = [r.asDict() for r in curve.pack(docs, PATH, capacity).collect()]
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    own = defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
    library = Tokenizer.from_file(PATH)
    assert own.keys() == texts.keys()
    for doc_id, found in own.items():
        want = []
        for text in texts[doc_id]:
            ids = np.array([*library.encode(text, add_special_tokens=False).ids, curve.SEPARATOR], "<u4")
            want.append(ids)
        if len(want) == 1:
            at = 0
            for r in sorted(found, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(want[0])
                at += r["length"]
                assert r["ids_crc32"] == zlib.crc32(want[0][r["start"] : at].tobytes())
            assert at == len(want[0])
        assert sum(r["length"] for r in found) == sum(map(len, want))
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
    short = 0
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == capacity or at & (at - 1) == 0
        short += at < capacity
    assert short <= capacity.bit_length()
    return rows


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_every_id_once(make_docs, odd_rows, capacity):
    checked(make_docs(odd_rows), capacity)


def test_empty_table(make_docs):
    assert curve.pack(make_docs([]), PATH).collect() == []


def test_reruns_agree(make_docs):
    rows = [(n, f"text {n % 5} " * (n % 9), "s") for n in range(200)]
    a, b = (sorted(map(tuple, curve.pack(make_docs(rows), PATH, 64).collect())) for _ in range(2))
    assert a == b


def test_neighbours_on_the_curve_are_alike(make_docs):
    """Documents of three vocabularies: most neighbours are of one kind, and equal texts lie together."""
    kinds = ["alpha beta gamma delta epsilon", "uno dos tres cuatro cinco seis", "rock paper scissors lizard spock"]
    rng = np.random.default_rng(1)
    rows = [(n, " ".join(rng.choice(kinds[n % 3].split(), 30)), "s") for n in range(300)]
    rows += [(300 + n, rows[n][1], "s") for n in range(30)]
    found = sorted(curve.neighbours(make_docs(rows), PATH).collect(), key=lambda r: (r["curve"], r["doc_id"]))
    key = {r["doc_id"]: r["curve"] for r in found}
    assert all(key[n] == key[300 + n] for n in range(30))
    kind = [r["doc_id"] % 3 for r in found]
    assert sum(a == b for a, b in zip(kind, kind[1:], strict=False)) > 0.9 * len(kind)
