"""Token counts by heap-and-linked-list byte-pair merging.

A text's count is its initial symbols minus its merges: symbols stand in a linked list, the
adjacent pairs that are pieces stand in a heap by rank, and the lowest rank is popped again and
again. No identifiers are made. The text is cut first where no piece can reach across (before a
space that follows something else, at line ends), and each distinct stretch of an Arrow batch is
merged once; documents add up the counts of their stretches.

Counts equal the library's for BPE models with byte fallback, the identity normaliser and a
dummy prefix; a model with pieces that span the end of a word is refused, and so is one on whose
``PROBES`` the library's counts are others. Nulls: a null text counts as empty and has no tokens;
null or repeated document ids are rows like others. Empty tables give no rows.
"""

import functools
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import small_batches

#: The sign for a space in the model's pieces.
SPACE = "▁"
#: Stretches whose counts a worker remembers at a time.
REMEMBERED = 800_000
#: Texts whose counts a model must agree on with the library when it is loaded.
PROBES = [
    "", " ", "  ", "plain words, 1234567 and so on.", " leads", "trails ", "two  spaces   three", "\t tab\r\n\nline ends \n",
    "ﬁ ½ Ａ e\u0301 é \u00a0 \u3000 \u200b", "日本語 😀 \u0000 \ue000", "<s> </s> <unk> <pad> <0x41>", "\u2581 \u2581\u2581a", "a" * 70,
]
#: Bits of a symbol's number.
SHIFT = 24


class PieceModel:
    """Ranks of a model's pieces, and the number of tokens of a stretch of text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [
            i
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        ids.sort(key=model.get_score, reverse=True)
        pieces = [model.id_to_piece(i) for i in ids]
        self.number = {p: n for n, p in enumerate(pieces)}
        self.cost = [1] * len(pieces)
        #: (left, right) as one number -> (rank, piece they make); equal scores share a rank.
        self.pairs: dict[int, tuple[int, int]] = {}
        score, rank = None, -1
        for i, piece in zip(ids, pieces, strict=True):
            if model.get_score(i) != score:
                score, rank = model.get_score(i), rank + 1
            for k in range(1, len(piece)):
                left, right = self.symbol(piece[:k]), self.symbol(piece[k:])
                if left is not None and right is not None:
                    self.pairs[left << SHIFT | right] = (rank, self.number[piece])
        # A text is cut before spaces, so no piece may reach over such a cut.
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError(f"a piece spans the end of a word: {path}")
        self.cuts_lines = not any("\n" in p and len(p) > 1 for p in pieces)
        self.known: dict[str, int] = {}
        self.known_lines: dict[str, int] = {}
        # What isn't read from the pieces (normaliser, dummy prefix, special strings) must be as assumed.
        if count_batch(pa.array(PROBES), self).tolist() != [len(x) for x in model.encode(PROBES)]:
            raise ValueError(f"the library counts otherwise than by merges of pieces: {path}")

    def symbol(self, part: str) -> int | None:
        """Number of a piece or of a single character, which costs its bytes if it is no piece."""
        found = self.number.get(part)
        if found is None and len(part) == 1:
            found = self.number[part] = len(self.cost)
            self.cost.append(len(part.encode()))
        return found

    def merged(self, stretch: str) -> int:
        """Tokens of a stretch after all merges."""
        pairs = self.pairs
        parts = [self.symbol(c) for c in stretch]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = []
        for i in range(n - 1):
            pair = pairs.get(parts[i] << SHIFT | parts[i + 1])
            if pair is not None:
                heap.append(pair[0] << 32 | i)
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            j, left = after[i], parts[i]
            if left < 0 or j >= n:
                continue
            pair = pairs.get(left << SHIFT | parts[j])
            if pair is None or pair[0] != top >> 32:
                continue  # one of the two has merged since
            parts[i] = new = pair[1]
            parts[j] = -1
            j = after[i] = after[j]
            before[j] = i
            if j < n:
                pair = pairs.get(new << SHIFT | parts[j])
                if pair is not None:
                    heapq.heappush(heap, pair[0] << 32 | i)
            i = before[i]
            if i >= 0:
                pair = pairs.get(parts[i] << SHIFT | new)
                if pair is not None:
                    heapq.heappush(heap, pair[0] << 32 | i)
        cost = self.cost
        return sum([cost[p] for p in parts if p >= 0])

    def count(self, stretch: str) -> int:
        """Tokens of a stretch that begins a text or follows a space, without that space."""
        known = self.known
        found = known.get(stretch)
        if found is None:
            if len(known) >= REMEMBERED:
                known.clear()
            if self.cuts_lines and "\n" in stretch:
                first, *lines = stretch.split("\n")
                found = self.count(first) + len(lines) * self.cost[self.symbol("\n")]
                found += sum(map(self.count_line, lines))
            else:
                found = self.merged(SPACE + stretch)
            known[stretch] = found
        return found

    def count_line(self, line: str) -> int:
        """Tokens of a stretch that follows a line end."""
        found = self.known_lines.get(line)
        if found is None:
            if len(self.known_lines) >= REMEMBERED // 4:
                self.known_lines.clear()
            found = self.known_lines[line] = self.merged(line)
        return found

    def count_spaced(self, text: str) -> int:
        """Tokens of a text in which spaces may follow each other."""
        total, parts = 0, (SPACE + text.replace(" ", SPACE)).split(SPACE)[1:]
        spaces = 0
        for part in parts:
            spaces += 1
            if part:
                total += self.count(part) if spaces == 1 else self.merged(SPACE * spaces + part)
                spaces = 0
        return total + (self.merged(SPACE * spaces) if spaces else 0)


@functools.lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def count_batch(texts: pa.Array, model: PieceModel) -> np.ndarray:
    """Tokens of each text."""
    texts = pc.replace_substring(texts, SPACE, " ")
    stretches = pc.split_pattern(texts, " ")
    offsets = stretches.offsets.to_numpy()
    coded = stretches.flatten().dictionary_encode()
    counts = np.fromiter(map(model.count, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    sums = np.concatenate(([0], np.cumsum(counts[coded.indices.to_numpy()]))) if len(coded) else np.zeros(1, np.int64)
    tokens = sums[offsets[1:] - offsets[0]] - sums[offsets[:-1] - offsets[0]]
    spaced = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(spaced):
        tokens[i] = model.count_spaced(texts[int(i)].as_py())
    tokens[pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)] = 0
    return tokens


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``: one row for each row of ``docs``."""

    def run(batches):
        model = piece_model(model_path)
        for batch in small_batches(batches, rows=4000, mb=16):
            texts = batch["text"]
            tokens = count_batch(texts, model)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pc.cast(pc.binary_length(texts), pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array(tokens > limit),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
