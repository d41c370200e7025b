"""Toxicity by class-conditional Kneser-Ney models of the characters of words.

A word is a run of non-space, lower-cased, with signs for its two ends; its n-grams are five
characters long. The toxic and the ordinary model count the n-grams of labelled documents of
their class and discount them; both back off to the same lower orders, whose Kneser-Ney
continuation counts (how many different characters precede an n-gram) come from all documents.
A rare expression hence gets nearly equal probabilities unless one class has shown it.

A document's evidence is the difference of its toxic and ordinary log-likelihood by word, over
all its words and over the word where it is greatest. A logistic curve, fitted on labelled
documents that the models haven't counted, turns the two and the number of words into a score
from 0 to 1.

Labels come from rows whose crc32(doc_id) mod 5 is not 0: remainders 1 to 3 for the counts, 4
for the curve, each about ``fit_rows`` rows at most, drawn by a hash of the identifier. All
other counts are over all documents. The n-gram tables stay distributed and exact, each n-gram
by its whole 64-bit hash. Only the evidence of n-grams that make up 2^-``bits`` of all n-grams,
of the texts or of the distinct words, is broadcast (at most 2 * 2^``bits`` of them). Words that
have another n-gram are joined with it once for each distinct word, and then with the documents
that have the word; as such a word is rare, no key of these joins is hot. Equal texts are scored
once, by their MD5.

Nulls: a null text counts as empty; a text without words has the evidence 0; a null identifier
has no label and counts as held out; a null label is none, and of repeated ones the greatest
holds. Without labels of both classes every score is the share of toxic labels, or 0.
Empty tables give no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import hot_join, located, numbered, small_batches, whole_text, written

ORDER = 5
#: Signs for the ends of a word: white space, which no word holds.
START, STOP = " ", "\n"
DISCOUNT = 0.75
ALPHABET = 256.0
MIX = np.uint64(0x9E3779B97F4A7C15)


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a batch; the words of all texts as numbers; where each text begins."""
    words = pc.utf8_split_whitespace(pc.utf8_lower(pc.utf8_trim_whitespace(texts)))
    offsets = words.offsets.to_numpy().astype(np.int64)
    every = words.flatten()
    real = pc.greater(pc.binary_length(every), 0)  # a text without words is split into an empty one
    counts = np.diff(offsets) - np.add.reduceat(np.append(~real.to_numpy(zero_copy_only=False), 0), offsets[:-1] - offsets[0]) if len(texts) else np.diff(offsets)
    coded = every.filter(real).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.concatenate(([0], np.cumsum(counts)))


#: Characters whose n-grams are made at a time: some seventy bytes each.
STRETCH = 1 << 18


def word_grams(words: pa.Array, stretch: int = STRETCH) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """One string with all words; by stretches the last place of each n-gram, its hash, and its word."""
    pad = START * (ORDER - 1)
    line = pad + (STOP + pad).join(words.to_pylist()) + STOP if len(words) else ""
    codes, before = np.frombuffer(line.encode("utf-32-le"), np.uint32), 0
    for first in range(ORDER - 1, len(codes), stretch):
        own = codes[first - ORDER + 1 : first + stretch].astype(np.uint64)
        n = len(own) - ORDER + 1
        hashes = np.zeros(n, np.uint64)
        for k in range(ORDER):
            hashes = (hashes ^ own[k : n + k]) * MIX
            hashes ^= hashes >> np.uint64(29)
        last = own[ORDER - 1 :]
        real = np.flatnonzero(last != ord(START))
        stops = np.cumsum(last == ord(STOP))
        word = before + np.concatenate(([0], stops[:-1]))
        before += int(stops[-1])
        yield line, first + real, hashes[real], word[real]


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, times, toxic, ordinary`` of ``docs(text, toxic)``: a row for each distinct word.

    Rows without a label still show which words there are.
    """

    def run(batches):
        for batch in small_batches(batches, rows=500, mb=2):
            label = batch["toxic"].fill_null(-1).to_numpy(zero_copy_only=False)
            words, codes, offsets = coded_words(batch["text"])
            by_word = np.repeat(label, np.diff(offsets))
            counts = [np.bincount(x, minlength=len(words)) for x in (codes, codes[by_word == 1], codes[by_word == 0])]
            yield pa.RecordBatch.from_arrays([words, *map(pa.array, counts)], ["word", "times", "toxic", "ordinary"])

    found = docs.select("text", "toxic").mapInArrow(run, "word string, times long, toxic long, ordinary long")
    return found.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("times", "toxic", "ordinary")])


def gram_counts(words: DataFrame) -> DataFrame:
    """``gram, times, kinds, toxic, ordinary`` of ``word_counts``: a row for each distinct n-gram.

    ``times`` counts all words that have it, ``kinds`` distinct ones.
    """

    def run(batches):
        for batch in batches:
            by_word = [batch["times"].to_numpy(), np.ones(len(batch)), batch["toxic"].to_numpy(), batch["ordinary"].to_numpy()]
            for line, ends, hashes, word in word_grams(batch["word"]):
                grams, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                counts = [np.bincount(inverse, c[word], len(grams)) for c in by_word]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([line[e - ORDER + 1 : e + 1] for e in ends[first].tolist()], pa.string()),
                        *[pa.array(c.astype(np.int64)) for c in counts],
                    ],
                    ["gram", "times", "kinds", "toxic", "ordinary"],
                )

    found = words.mapInArrow(run, "gram string, times long, kinds long, toxic long, ordinary long")
    return found.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("times", "kinds", "toxic", "ordinary")])


def shared_backoff(grams: DataFrame) -> DataFrame:
    """``gram, p``: the shared probability of the last of ORDER - 1 characters after the others."""
    lower = None
    for n in range(1, ORDER):
        types = grams.select(F.substring("gram", ORDER - n, n + 1).alias("wider")).distinct()
        counts = types.groupBy(F.substring("wider", 2, n).alias("gram")).agg(F.count("*").alias("k"))
        counts = counts.withColumn("head", F.substring("gram", 1, n - 1))
        heads = counts.groupBy("head").agg(F.sum("k").alias("all"), F.count("*").alias("kinds"))
        joined = counts.join(heads, "head")
        if lower is None:
            below = F.lit(1.0 / ALPHABET)
        else:
            joined = joined.withColumn("tail", F.substring("gram", 2, n - 1)).join(
                lower.select(F.col("gram").alias("tail"), F.col("p").alias("p_below")), "tail"
            )
            below = F.col("p_below")
        lower = joined.select(
            "gram",
            ((F.greatest(F.col("k") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * below) / F.col("all")).alias("p"),
        )
    return lower


def evidence(grams: DataFrame) -> DataFrame:
    """``grams`` with ``llr``: log-likelihood of each n-gram's last character, toxic less ordinary."""
    both = grams.select(
        *grams.columns,
        F.substring("gram", 1, ORDER - 1).alias("head"),
        F.substring("gram", 2, ORDER - 1).alias("tail"),
    ).join(shared_backoff(grams).select(F.col("gram").alias("tail"), "p"), "tail")
    heads = grams.groupBy(F.substring("gram", 1, ORDER - 1).alias("head")).agg(
        *[F.sum(c).alias(f"{c}_all") for c in ("toxic", "ordinary")],
        *[F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds") for c in ("toxic", "ordinary")],
    )
    both = both.join(heads, "head")

    def probability(c: str) -> Column:
        known = (
            F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"{c}_kinds") * F.col("p")
        )
        return F.when(F.col(f"{c}_all") > 0, F.try_divide(known, F.col(f"{c}_all"))).otherwise(F.col("p"))

    kept = [c for c in grams.columns if c not in ("toxic", "ordinary")]
    return both.select(*kept, (F.ln(probability("toxic")) - F.ln(probability("ordinary"))).alias("llr"))


def hashed(grams: DataFrame) -> DataFrame:
    """``hash, times, kinds, llr``: each n-gram by its whole hash."""

    def run(batches):
        for batch in batches:
            line = "".join(batch["gram"].to_pylist())
            codes = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, ORDER)
            hashes = np.zeros(len(codes), np.uint64)
            for k in range(ORDER):
                hashes = (hashes ^ codes[:, k]) * MIX
                hashes ^= hashes >> np.uint64(29)
            columns = [pa.array(hashes.view(np.int64)), batch["times"], batch["kinds"], batch["llr"]]
            yield pa.RecordBatch.from_arrays(columns, ["hash", "times", "kinds", "llr"])

    return grams.select("gram", "times", "kinds", "llr").mapInArrow(run, "hash long, times long, kinds long, llr double")


class Evidence:
    """The evidence of some n-grams by their whole hashes."""

    def __init__(self, grams: pa.Table):
        hashes = grams["hash"].to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        self.hashes = np.append(hashes[order], np.uint64(0))
        self.values = np.append(grams["llr"].to_numpy()[order], 0.0)

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sum for each word; the words and hashes of the n-grams that aren't among these."""
        sums, others, missing = np.zeros(len(words)), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for _, _, hashes, word in word_grams(words):
            if not len(word):
                continue
            place = np.searchsorted(self.hashes[:-1], hashes)
            found = self.hashes[place] == hashes
            found &= place < len(self.hashes) - 1
            low, high = int(word[0]), int(word[-1]) + 1
            sums[low:high] += np.bincount(word - low, np.where(found, self.values[place], 0.0), high - low)
            others.append(word[~found])
            missing.append(hashes[~found])
        return sums, np.concatenate(others), np.concatenate(missing)


def word_evidence(words: DataFrame, common, others: DataFrame) -> DataFrame:
    """``word_id, llr``: the evidence of each distinct word that has n-grams beside the common ones.

    ``common`` is a broadcast Evidence, ``others(hash, llr)`` the rest.
    """

    def run(batches):
        for batch in batches:
            sums, word, hashes = common.value.of_words(batch["word"])
            have = np.unique(word)
            none = np.zeros(len(word))
            ids = batch["word_id"]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(np.concatenate((have, word)))),
                    pa.concat_arrays([ids.take(pa.array(have)), pa.array(hashes.view(np.int64))]),
                    pa.array(np.concatenate((sums[have], none)), mask=np.concatenate((have < 0, none == 0))),
                ],
                ["word_id", "hash", "sum"],
            )

    # One row with the common n-grams of each such word, spread by its own hash, and one for each other n-gram.
    found = words.select(F.xxhash64("word").alias("word_id"), "word").mapInArrow(run, "word_id long, hash long, sum double")
    return found.join(others, "hash", "left").groupBy("word_id").agg(F.sum(F.coalesce("sum", "llr", F.lit(0.0))).alias("llr"))


def text_key(docs: DataFrame) -> Column:
    return F.unhex(F.md5(whole_text(docs)))


def features(docs: DataFrame, common, by_word: DataFrame) -> DataFrame:
    """``key, mean, most, words, texts``, a row for each distinct text.

    ``texts`` is how many rows have it. Evidence by word, of its most toxic word, and log of its words. ``common`` gives the
    evidence of words of common n-grams; all others are joined with ``by_word``.
    """

    def run(batches):
        for batch in small_batches(batches, rows=500, mb=2):
            words, codes, offsets = coded_words(batch["text"])
            sums, other, _ = common.value.of_words(words)
            known = np.ones(len(words), bool)
            known[other] = False
            llr, known = sums[codes], known[codes]
            n = len(offsets) - 1
            doc = np.repeat(np.arange(n), np.diff(offsets))
            total = np.bincount(doc[known], llr[known], n)
            times = np.bincount(doc[known], minlength=n)
            most = np.full(n, -np.inf)
            np.maximum.at(most, doc[known], llr[known])
            pairs, count = np.unique(doc[~known] * max(len(words), 1) + codes[~known], return_counts=True)
            rare, word = np.divmod(pairs, max(len(words), 1))
            none = np.zeros(len(count))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["key"].take(pa.array(np.concatenate((np.arange(n), rare)))),
                    pa.concat_arrays([pa.nulls(n, pa.string()), words.take(pa.array(word))]),
                    pa.array(np.concatenate((times, count))),
                    pa.array(np.concatenate((total, none))),
                    pa.array(np.concatenate((most, none)), mask=np.concatenate((times == 0, none == 0))),
                ],
                ["key", "word", "times", "total", "most"],
            )

    # A row with the common words of each text, and one for each other word.
    rows = docs.select(text_key(docs).alias("key"), whole_text(docs).alias("text")).mapInArrow(
        run, "key binary, word string, times long, total double, most double"
    )
    first = F.col("word").isNull()
    rows = written(rows.select("key", F.xxhash64("word").alias("word_id"), first.alias("first"), "times", "total", "most"), "toxicity-by-text", 500, 2)
    llr = F.coalesce(F.col("llr"), F.lit(0.0))
    rare = rows.where(~F.col("first")).join(by_word, "word_id", "left").withColumns({"total": F.col("times") * llr, "most": llr})
    # Equal texts multiply the rows of their key.
    found = (
        rows.where("first")
        .select("key", "first", "times", "total", "most")
        .unionByName(rare.select("key", "first", "times", "total", "most"))
        .groupBy("key")
        .agg(
            F.sum("total").alias("total"),
            F.max("most").alias("most"),
            F.sum("times").alias("times"),
            F.sum(F.col("first").cast("long")).alias("texts"),
        )
    )
    return found.select(
        "key",
        (F.col("total") / F.greatest("times", F.lit(1))).alias("mean"),
        F.coalesce("most", F.lit(0.0)).alias("most"),
        F.log1p(F.col("times") / F.col("texts")).alias("words"),
        "texts",
    )


class Model:
    """Evidence by n-gram and the features of the texts fitted on, both distributed; the curve."""

    def __init__(self, grams: DataFrame, texts: DataFrame, weights: np.ndarray):
        self.grams, self.texts, self.weights = grams, texts, weights

    def scores(self) -> DataFrame:
        """``key, score, texts``: a row for each distinct text, with the number of rows that have it."""
        w = [float(x) for x in self.weights]
        z = F.lit(w[0]) + w[1] * F.col("mean") + w[2] * F.col("most") + w[3] * F.col("words")
        return self.texts.select("key", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias("score"), "texts")


class Scorer:
    """The evidence of a model whose n-grams fit into one worker, for texts it wasn't fitted on."""

    def __init__(self, model: Model):
        self.grams, self.weights = Evidence(model.grams.where("llr != 0").select("hash", "llr").toArrow()), model.weights

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """For each text: evidence by word, of its most toxic word, and log of its words."""
        words, codes, offsets = coded_words(texts)
        per_word = self.grams.of_words(words)[0][codes]
        n = np.diff(offsets)
        sums = np.bincount(np.repeat(np.arange(len(n)), n), per_word, len(n))
        most = np.zeros(len(n))
        if len(per_word):
            most[n > 0] = np.maximum.reduceat(per_word, offsets[:-1][n > 0])
        return np.column_stack((sums / np.maximum(n, 1), most, np.log1p(n)))

    def score(self, texts: pa.Array) -> np.ndarray:
        w = self.weights
        return 1 / (1 + np.exp(-np.clip(w[0] + self.evidence(texts) @ w[1:], -30, 30)))


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method: the constant, then a weight for each column."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.mean() if len(y) else 0.0) * (1 - 1e-9) + 1e-10
        return np.array([np.log(p / (1 - p)), *[0.0] * x.shape[1]])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    a = np.column_stack((np.ones(len(x)), (x - mean) / scale))
    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += np.clip(step, -3, 3)
        if abs(step).max() < 1e-8:
            break
    slopes = w[1:] / scale
    return np.array([w[0] - slopes @ mean, *slopes])


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def drawn_labels(labels: DataFrame, fit_rows: int) -> DataFrame:
    """``_id, toxic, curve``: the labels to learn from, about ``fit_rows`` for each use."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder(F.col("_id")) != 0))
        .groupBy("_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("curve", remainder(F.col("_id")) == 4)
    )
    known = written(known, "toxicity-labels")
    sizes = {r["curve"]: r["n"] for r in known.groupBy("curve").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("curve"), F.lit(fit_rows / max(fit_rows, sizes.get(True, 0)))).otherwise(
        F.lit(fit_rows / max(fit_rows, sizes.get(False, 0)))
    )
    return known.where(F.pmod(F.xxhash64(F.lit(11), "_id"), F.lit(1 << 20)) < share * (1 << 20))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 30_000, bits: int = 22) -> Model:
    drawn = F.broadcast(drawn_labels(labels, fit_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), whole_text(docs).alias("text"))
    counted = texts.join(drawn.where(~F.col("curve")).drop("curve"), "_id", "left")
    words = written(word_counts(counted), "toxicity-words", 500, 2)
    counts = written(gram_counts(words), "toxicity-grams")
    grams = written(hashed(evidence(counts)), "toxicity-evidence")
    every = grams.agg(F.sum("times").alias("times"), F.sum("kinds").alias("kinds")).first()
    share = [F.col(c) >= (every[c] or 0) / (1 << bits) for c in ("times", "kinds")]
    common = Evidence(grams.where(share[0] | share[1]).select("hash", "llr").toArrow())
    common = docs.sparkSession.sparkContext.broadcast(common)
    others = grams.where(~(share[0] | share[1]) & (F.col("llr") != 0)).select("hash", "llr")
    by_word = written(word_evidence(words, common, others), "toxicity-by-word")
    found = written(features(docs, common, by_word), "toxicity-features")
    common.destroy()
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("_id"), text_key(docs).alias("key"))
        .join(drawn.where("curve").drop("curve"), "_id")
        .join(found, "key")
        .select("mean", "most", "words", "toxic")
        .toArrow()
    )
    x = np.column_stack([rows[c].to_numpy() for c in ("mean", "most", "words")])
    return Model(grams, found, curve(x, rows["toxic"].to_numpy().astype(float)))


def scorer(spark: SparkSession, model: Model):
    """A column function from text to score, over Arrow batches."""
    shared = spark.sparkContext.broadcast(Scorer(model))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(texts))

    return score


def scored(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row for each row of ``docs``."""
    model = fit(docs, labels, **options)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (remainder(F.col("doc_id")) == 0).alias("held_out"),
        text_key(docs).alias("key"),
    )
    found = hot_join(written(rows, "toxicity-keys"), written(model.scores(), "toxicity-scores"), "key", "texts")
    return found.drop("key", "texts").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns."""
    scores = fit(docs, labels, **options).scores()
    toxic = written(scores.where("score >= 0.5").select("key"), "toxicity-toxic")
    rows, at = located(docs)
    # Keys and places are joined, the rows' texts stay where they are.
    places = rows.select(text_key(rows).alias("key"), F.col(f"`{at}`.file").alias("file"), F.col(f"`{at}`.row").alias("row"))
    gone = written(places.join(toxic, "key", "left_semi").select("file", "row", F.lit(1).alias("n")), "toxicity-rows")
    found, n = numbered(rows, at, gone, 1)
    return found.where(F.col(n) == 0).drop(at, n)
