import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from pairlocus.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "the ", " ", "  ", "\n", "é", "日", "😀", "\x00", "\r", "\t", "<|endoftext|>", "'s", "ing", ".", "1", "\xa0", " <|endoftext|> ", "\x1c", "\x85", " "]


def ids_of(texts):
    own = Tokenizer.from_file(PATH)
    return [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_library():
    rng = random.Random(3)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 16))) for _ in range(4000)]
    ids, at = packing.token_ids(pa.array(texts), PATH)
    assert all(np.array_equal(ids[at[i] : at[i + 1]], x) for i, x in enumerate(ids_of(texts)))


@pytest.mark.parametrize("seed", range(60))
def test_plan_places_every_item_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 30, 64, 2048])
    histogram = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 300)))
    bins, placed = defaultdict(list), Counter()
    for n, _, rows, sequence, offset, copies in packing.plan(histogram, capacity):
        for i in range(rows):
            bins[sequence + i // copies].append((offset + i % copies * n, n))
            placed[n] += 1
    assert placed == +histogram
    for items in bins.values():
        end = 0
        for offset, n in sorted(items):
            assert offset == end
            end += n
        assert end <= capacity


def test_packed_documents(make_docs, odd_rows):
    rows = odd_rows + [(1000 + i, "word " * (i % 50)) for i in range(200)]
    out = packing.pack(make_docs(rows), PATH, capacity=64).collect()
    want = Counter()
    for (doc_id, text, *_), ids in zip(rows, ids_of([r[1] or "" for r in rows]), strict=True):
        ids = np.array([*ids, 0], "<u4")
        start, stop, piece = 0, (len(ids) - 1) % 64 + 1, 0
        while start < len(ids):
            want[(doc_id, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes()))] += 1
            start, stop, piece = stop, stop + 64, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for items in places.values():
        end = 0
        for offset, n in sorted(items):
            assert offset == end
            end += n
        assert end <= 64
    assert len(places) <= 1.05 * sum(r.length for r in out) / 64 + 1


def test_other_files_are_refused(tmp_path):
    """The ids come from the file's ranks, which is right only for plain byte-level files."""
    with open(PATH, encoding="utf-8") as f:
        model = json.load(f)
    for n, change in enumerate(({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}})):
        (tmp_path / f"{n}.json").write_text(json.dumps(model | change))
        with pytest.raises(ValueError):
            packing.tokenizer(f"{tmp_path}/{n}.json")


def test_ranks_of_a_length_that_many_share(spark, tmp_path):
    """Groups of a hot length make up one row of ranks, equal rows included."""
    lengths = [5] * 3000 + [7] * 10 + [9]
    path = str(tmp_path / "pieces")
    spark.createDataFrame([(n % 3, 0, 0, x, 1) for n, x in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long").write.parquet(path)
    salts = packing.salts_of(Counter(lengths), 100)
    assert salts == {5: 7, 7: 1, 9: 1} and packing.salts_of({1: 10**10})[1] == 12_500
    ranks = defaultdict(list)
    for r in packing.ranked(spark.read.parquet(path), salts).collect():
        ranks[r.length].append(r["rank"])
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in Counter(lengths).items()}


def test_empty(make_docs):
    assert packing.pack(make_docs([]), PATH).count() == 0
