"""Phrases by vertical inverted lists of positions, and how firmly their words belong together.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and into words at spaces.
Each task numbers the words of a few megabytes of texts of one language, a *block*, leaving a gap
between pieces. A phrase has a list of the positions in a block where it begins, and the sum of its
lists' lengths is its frequency. Lists of phrases of n + 1 words come from merge-joining the
positions of a frequent phrase of n words with the postings of the adjacent word one place on: those
of the frequent phrase of n words that begins there, which ends in that word. Nothing is extended
that isn't frequent, so no phrase is made whose parts aren't.

Positions never leave their block. What is exchanged in a round are a block's distinct phrases with
the lengths of their lists, dealt by a hash over *shards*; a shard adds the lengths up, numbers the
frequent phrases, and answers each block with their numbers, in the order in which it asked. Words
are exchanged as they are, longer phrases as the numbers of their two parts, so counts are exact.
A block is one row, made once; rounds join it with the answers so far and repeat what they imply,
which is less work than storing lists. All of a shard's lists are compressed and small: a phrase
that is everywhere has one entry a block.

The score of a phrase is that of its weakest cut into two parts. Scores are whole numbers, worked out
as decimals of 38 digits.

Nulls: a null text counts as empty, a null language is ``und``; a language without words has no
rows. Repeated rows and equal texts count as often as they are there. Identifiers and other columns
aren't read. Empty tables give no rows.
"""

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import small_batches, whole_text, written

#: Bytes that end a piece, and that end a word within a piece.
PIECE_ENDS, WORD_ENDS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
LEAST, WORDS, TOP = 30, 4, 2000
#: A phrase goes where a longer one with this share of its occurrences has its words.
ABSORBED = 80
#: Bytes of text in a block, about, and for each shard.
BLOCK, SHARD = 4 << 20, 8 << 20

KIND = np.zeros(256, np.uint8)
KIND[list(WORD_ENDS)], KIND[list(PIECE_ENDS)] = 1, 2


# Numbers in few bytes


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 up, in as many byte planes as the largest takes, compressed."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + len(values).to_bytes(8, "big") + pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "big")
    planes = np.frombuffer(pa.decompress(data[9:], width * n, "zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1).astype(np.int64)


def packed_words(words: pa.Array) -> bytes:
    """Words, which hold no space, as one compressed text."""
    text = " ".join(words.to_pylist()).encode()
    return len(text).to_bytes(8, "big") + pa.compress(text, "zstd", asbytes=True)


def unpacked_words(data: bytes) -> list[str]:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "big"), "zstd", asbytes=True).decode().split(" ")


# Blocks


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts, and for each whether a piece ends before it."""
    raw = np.frombuffer("\n".join(texts.to_pylist()).encode(), np.uint8).copy()
    upper = (raw >= 65) & (raw <= 90)
    raw[upper] += 32
    kind = KIND[raw]
    inside = kind == 0
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(~inside & before)
    if len(ends) < len(starts):
        ends = np.append(ends, len(raw))
    breaks = np.cumsum(kind == 2)[starts] if len(starts) else np.zeros(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[inside].tobytes()))
    return words, np.concatenate(([True], breaks[1:] != breaks[:-1]))[: len(starts)]


def gathered(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[str, pa.Array]]:
    """Texts of one language, about ``block`` bytes at a time; at most some blocks wait."""
    waiting: dict[str, list[pa.Array]] = {}
    size = 0

    def flushed():
        for lang, parts in waiting.items():
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays(parts)], ["text"])
            for piece in small_batches([batch], rows=1 << 30, mb=max(block >> 20, 1)):
                yield lang, piece["text"]
        waiting.clear()

    for batch in batches:
        langs = batch["lang"].dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            waiting.setdefault(lang, []).append(batch["text"].filter(pc.equal(langs.indices, k)))
        size += batch["text"].nbytes
        if size >= 4 * block:
            yield from flushed()
            size = 0
    yield from flushed()


#: Rows of a block itself (shard -1: how many words, and their local numbers by position, 0 where a
#: piece ends) and of what it asks of each shard: phrases, by their two parts, and lengths of lists.
ASKED = "block long, shard int, lang string, n long, codes binary, words binary, first binary, second binary, lengths binary"
#: Rows of what a shard answers a block: which phrases are frequent, and the numbers of those; and
#: of the phrases themselves (block -1), words or pairs of numbers.
ANSWER = "block long, shard int, length int, frequent binary, numbers binary, lang string, word string, first long, second long, number long, times long"


def schema_of(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in text.split(", "))])


ASKED_SCHEMA, ANSWER_SCHEMA = schema_of(ASKED), schema_of(ANSWER)


def rows_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def numbered_by_shard(values: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The order that sorts distinct ``values`` by shard, and the slice of each shard."""
    order = np.argsort(shard, kind="stable")
    own = shard[order]
    edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True]))) if len(own) else np.zeros(1, int)
    return order, [(int(own[a]), slice(a, b)) for a, b in zip(edges, edges[1:], strict=False)]


def blocks(docs: DataFrame, shards: int, block: int) -> DataFrame:
    """Blocks with what they ask in the first round: their words."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        for lang, texts in gathered(batches, block):
            words, breaks = words_of(texts)
            if not len(words):
                continue
            coded = words.dictionary_encode()
            codes, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            shard = np.array([zlib.crc32(w.encode()) % shards for w in names.to_pylist()], np.int64)
            order, slices = numbered_by_shard(codes, shard)
            local = np.empty(len(order), np.int64)
            local[order] = np.arange(len(order))
            at = np.arange(len(codes)) + np.cumsum(breaks)  # a gap before each piece
            line = np.zeros(int(at[-1]) + 1, np.int64)
            line[at] = local[codes] + 1
            number = part << 32 | made
            made += 1
            counts, sorted_names = np.bincount(codes, minlength=len(names))[order], names.take(pa.array(order))
            yield rows_of([{"block": number, "shard": -1, "lang": lang, "n": len(codes), "codes": packed(line)}], ASKED_SCHEMA)
            for s, own in slices:
                part_words = sorted_names.slice(own.start, own.stop - own.start)
                yield rows_of([{"block": number, "shard": s, "lang": lang, "words": packed_words(part_words), "lengths": packed(counts[own])}], ASKED_SCHEMA)

    lang = F.coalesce(docs["lang"].cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), whole_text(docs).alias("text")).mapInArrow(run, ASKED)


# Rounds


def answered(asked: DataFrame, length: int, shards: int, least: int) -> DataFrame:
    """A round's answers: lengths of lists are added up within shards."""

    def one(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        lengths = [unpacked(b) for b in table["lengths"].to_pylist()]
        times = np.concatenate(lengths)
        if length == 1:
            langs = np.repeat(np.arange(len(lengths)), [len(x) for x in lengths])
            names = table["lang"].combine_chunks().take(pa.array(langs))
            words = pa.array([w for data in table["words"].to_pylist() for w in unpacked_words(data)], pa.string())
            keys = [names.dictionary_encode().indices.to_numpy().astype(np.int64), words.dictionary_encode().indices.to_numpy().astype(np.int64)]
        else:
            keys = [np.concatenate([unpacked(b) for b in table[c].to_pylist()]) for c in ("first", "second")]
        order = np.lexsort((keys[1], keys[0]))
        new = np.concatenate(([True], (keys[0][order][1:] != keys[0][order][:-1]) | (keys[1][order][1:] != keys[1][order][:-1])))
        group = np.cumsum(new) - 1
        total = np.add.reduceat(times[order], np.flatnonzero(new))
        often = total >= least
        number = np.where(often, (np.cumsum(often) - 1) * shards + shard + 1, 0)
        own = np.empty(len(order), np.int64)
        own[order] = number[group]
        out, at = [], 0
        for block, lens in zip(table["block"].to_pylist(), lengths, strict=True):
            mine = own[at : at + len(lens)]
            at += len(lens)
            out.append({"block": block, "shard": shard, "length": length, "frequent": packed((mine > 0).astype(np.int64)), "numbers": packed(mine[mine > 0])})
        heads = order[np.flatnonzero(new)[often]]
        kept = pa.Table.from_batches([rows_of(out, ANSWER_SCHEMA)])
        if not len(heads):
            return kept
        k = len(heads)
        columns = {
            "block": pa.array([-1] * k, pa.int64()), "shard": pa.array([shard] * k, pa.int32()), "length": pa.array([length] * k, pa.int32()),
            "number": pa.array(number[often]), "times": pa.array(total[often]),
        }
        if length == 1:
            columns |= {"lang": names.take(pa.array(heads)), "word": words.take(pa.array(heads))}
        else:
            columns |= {"first": pa.array(keys[0][heads]), "second": pa.array(keys[1][heads])}
        found = pa.table([columns.get(f.name, pa.nulls(k, f.type)) for f in ANSWER_SCHEMA], schema=ANSWER_SCHEMA)
        return pa.concat_tables([kept, found])

    return asked.groupBy("shard").applyInArrow(one, ANSWER)


def numbers_of(answers: list[tuple[int, int, bytes, bytes]], length: int) -> np.ndarray:
    """The numbers of a block's phrases of a length, in the order in which it asked; 0 for rare ones."""
    out = []
    for _, _, frequent, numbers in sorted(a for a in answers if a[1] == length):
        whole = unpacked(frequent)
        whole[whole > 0] = unpacked(numbers)
        out.append(whole)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def lists_of(at: np.ndarray, first: np.ndarray, second: np.ndarray, shards: int):
    """Inverted lists of the pairs that begin at ``at``: pairs and lengths by shard, and each position's pair."""
    order = np.lexsort((second, first))
    new = np.concatenate(([True], (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])))[: len(order)]
    heads = order[np.flatnonzero(new)]
    lengths = np.diff(np.append(np.flatnonzero(new), len(order)))
    mix = (first[heads].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (second[heads].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    shard = ((mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % shards
    by_shard, slices = numbered_by_shard(heads, shard)
    local = np.empty(len(heads), np.int64)
    local[by_shard] = np.arange(len(heads))
    pair = np.empty(len(order), np.int64)
    pair[order] = local[np.cumsum(new) - 1]
    return first[heads][by_shard], second[heads][by_shard], lengths[by_shard], slices, pair


def asked_next(stored: DataFrame, answers: DataFrame, length: int, shards: int) -> DataFrame:
    """What blocks ask about phrases of ``length`` words, from themselves and all answers before."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        got = list(zip(*(right[c].to_pylist() for c in ("shard", "length", "frequent", "numbers")), strict=True))
        line = unpacked(left["codes"][0].as_py())
        word = np.concatenate(([0], numbers_of(got, 1)))[line]
        # The postings of frequent words: where they stand, in order, and which ones.
        at = np.flatnonzero(word)
        number = word[at]
        for n in range(2, length + 1):
            # Merge-join of positions with the postings one place on.
            follows = np.flatnonzero(at[1:] == at[:-1] + 1)
            at, first, second = at[follows], number[follows], number[follows + 1]
            firsts, seconds, lengths, slices, pair = lists_of(at, first, second, shards)
            if n < length:
                number = numbers_of(got, n)[pair] if len(pair) else pair
                keep = number > 0
                at, number = at[keep], number[keep]
        block = left["block"][0].as_py()
        rows = [{"block": block, "shard": s, "first": packed(firsts[own]), "second": packed(seconds[own]), "lengths": packed(lengths[own])} for s, own in slices]
        return pa.Table.from_batches([rows_of(rows, ASKED_SCHEMA)])

    left = stored.where("shard = -1").select("block", "codes")
    right = answers.where("block >= 0").select("block", "shard", "length", "frequent", "numbers")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(one, ASKED)


def frequent_phrases(docs: DataFrame, least: int = LEAST, words: int = WORDS, block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """``lang, length, words, times`` of each phrase of at most ``words`` words that is there ``least`` times; ``lang, n`` of each language."""
    size = docs.agg(F.sum(F.octet_length(whole_text(docs))).alias("n")).first()["n"] or 0
    shards = max(32, size // shard)
    stored = written(blocks(docs, shards, block), "phrase-blocks", 2000, 8)
    answers = written(answered(stored.where("shard >= 0"), 1, shards, least), "phrase-answers", 2000, 8)
    known = answers.where("block = -1").select("lang", "number", F.array("word").alias("words"), "times")
    found = [known.withColumn("length", F.lit(1))]
    rounds = [answers]
    for length in range(2, words + 1):
        asked = asked_next(stored, reduce(DataFrame.unionByName, rounds), length, shards)
        answers = written(answered(asked, length, shards, least), "phrase-answers", 2000, 8)
        rounds.append(answers)
        pairs = answers.where("block = -1").select("first", "second", "number", "times")
        heads = known.select("lang", F.col("number").alias("first"), F.col("words").alias("head"))
        tails = known.select(F.col("number").alias("second"), F.element_at("words", -1).alias("last"))
        known = pairs.join(heads, "first").join(tails, "second").select("lang", "number", F.concat("head", F.array("last")).alias("words"), "times")
        known = written(known, "phrases")
        found.append(known.withColumn("length", F.lit(length)))
    sizes = stored.where("shard = -1").groupBy("lang").agg(F.sum("n").alias("n"))
    return reduce(DataFrame.unionByName, found).select("lang", "length", "words", "times"), sizes


# Scores


def phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def exactly(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def scored(frequent: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, score`` of all phrases of two words or more: their weakest cuts."""
    times = frequent.select("lang", phrase(F.col("words")).alias("part"), "times")
    n = F.col("length")
    cuts = F.explode(F.sequence(F.lit(1), n - 1)).alias("k")
    cut = frequent.where("length > 1").select("lang", "words", "length", F.col("times").alias("a"), cuts)
    cut = cut.select("*", phrase(F.slice("words", F.lit(1), F.col("k"))).alias("head"), phrase(F.slice("words", F.col("k") + 1, n - F.col("k"))).alias("tail"))
    heads = times.select(F.col("lang").alias("lang1"), F.col("part").alias("head1"), F.col("times").alias("l"))
    tails = times.select(F.col("lang").alias("lang2"), F.col("part").alias("tail2"), F.col("times").alias("r"))
    whole = cut.join(heads, (F.col("lang") == F.col("lang1")) & (F.col("head") == F.col("head1")))
    whole = whole.join(tails, (F.col("lang") == F.col("lang2")) & (F.col("tail") == F.col("tail2")))
    whole = whole.withColumns({"a20": exactly("a"), "b20": exactly("l") + exactly("r")})
    score = F.expr("cast((cast(2000000 as decimal(7,0)) * a20) div b20 as bigint)")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("weakest")
    return whole.groupBy("lang", "words", "a").agg(weakest).select("lang", phrase(F.col("words")).alias("phrase"), "words", "a", "weakest.l", "weakest.r", "weakest.score")


def inner_phrases(frequent: DataFrame) -> DataFrame:
    """``lang, inner, longer``: phrases within longer ones, and the most that such a one occurs."""
    n = F.col("length")
    shorter = F.explode(F.sequence(F.lit(2), n - 1)).alias("m")
    rows = frequent.where("length > 2").select("lang", "words", "length", "times", shorter)
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), n - F.col("m") + 1)).alias("i"))
    inner = phrase(F.slice("words", F.col("i"), F.col("m"))).alias("inner")
    return rows.select("lang", inner, "times").groupBy("lang", "inner").agg(F.max("times").alias("longer"))


def collocations(docs: DataFrame, least: int = LEAST, words: int = WORDS, top: int = TOP, absorbed: int = ABSORBED, **sizes: int) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's firmest phrases."""
    frequent, totals = frequent_phrases(docs, least, words, **sizes)
    frequent = written(frequent, "phrases-frequent")
    inner = inner_phrases(frequent).select(F.col("lang").alias("lang1"), "inner", "longer")
    rows = scored(frequent)
    rows = rows.join(inner, (F.col("lang") == F.col("lang1")) & (F.col("phrase") == F.col("inner")), "left")
    gone = exactly("longer") * 100 >= exactly("a") * absorbed
    rows = rows.where(~F.coalesce(gone, F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # The top rows of a language are the feature; tasks keep no more of theirs before they meet.
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = totals.select(F.col("lang").alias("lang1"), "n")
    return ranked.drop("lang1").join(totals, F.col("lang") == F.col("lang1")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
