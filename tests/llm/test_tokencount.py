import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from pairlocus.llm import tokencount

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "the ", " ", "  ", "\n", "▁", "é", "日", "😀", "\x00", "\r", "\t", "   ", ";\r", "<s>", "</s>", "<0x0A>", "ing", ".", "1", "#", "ﬁ", "é", "'s"]


def test_counts_equal_the_library():
    rng = random.Random(3)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 16))) for _ in range(5000)]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = tokencount.count_batch(pa.array(texts), tokencount.PieceModel(PATH))
    assert got.tolist() == [len(x) for x in library.encode(texts)]


def test_rows(make_docs, odd_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    out = tokencount.count_tokens(make_docs(odd_rows), PATH).collect()
    want = []
    for doc_id, text, *_ in odd_rows:
        n = len(library.encode(text or ""))
        want.append((doc_id, len((text or "").encode()), n, n > 4096))
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    assert tokencount.count_tokens(make_docs([]), PATH).count() == 0


def test_a_model_that_counts_otherwise_is_refused(monkeypatch):
    counted = tokencount.count_batch
    monkeypatch.setattr(tokencount, "count_batch", lambda texts, model: counted(texts, model) + 1)
    with pytest.raises(ValueError, match="otherwise"):
        tokencount.PieceModel(PATH)
