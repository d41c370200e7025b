"""Language identification by Bayesian evidence fusion.

Four kinds of evidence on a page's language are multiplied: the likelihood of its main text
under character trigram models, the language its markup declares, the suffix and path of its
address, and a prior of its host. How far a declaration is to be trusted, P(declared | language),
and the priors are counted over all pages by grouped aggregation, from the languages that the
texts alone suggest. Host priors are smoothed by those of the host's suffix, these by the whole
(a page's own vote doesn't count for itself).

The trigram models are fitted on about ``fit_rows`` documents of known language (a documented
bound), drawn by a hash of the id; they have 2^``bits`` hashed trigrams a language.

Nulls: a page without markup or address has no evidence of that kind, one without text gets the
priors; null or repeated page ids are rows like others. Without documents of known language
there is no language to tell, and lang is null. Empty tables give no rows.
"""

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import hot_join, removed, small_batches, whole_text, written

#: Elements whose content isn't the page's own text.
ASIDE = ("script", "style", "nav", "footer", "head", "aside", "noscript")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
TAG = re.compile(r"<[^<>]*+>")
COMMENT = re.compile(r"<!--")
DECLARED = re.compile(r"<html\b[^<>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", re.IGNORECASE)
#: Languages of country suffixes, where they aren't their own two letters.
SUFFIXES = {"at": "de", "ch": "de", "uk": "en", "us": "en", "au": "en", "ie": "en", "mx": "es", "ar": "es", "co": "es", "be": "fr"}
#: Languages beyond ``most_languages``.
OTHER = "und"
#: A page's trigrams are far from independent: their log-likelihood counts for so much.
TEMPER = 0.1


#: What may stand in <head>; any other element ends one that isn't closed.
IN_HEAD = ("title", "meta", "link", "base", "script", "style", "noscript", "template")
#: Elements of which all that follows is content if they aren't closed.
RAW = ("script", "style", "noscript")
IN_TAG = re.compile(r"<(!--|/head\b|/?body\b|[a-z][a-z0-9]*)")


def head_end(lower: str, at: int) -> int:
    """Where the head ends that begins before ``at``: its end tag, or what can't stand in it."""
    while m := IN_TAG.search(lower, at):
        close = "-->" if m[1] == "!--" else f"</{m[1]}" if m[1] in ("title", "template", *RAW) else None
        if close is None and m[1] not in IN_HEAD:
            return m.start()
        at = m.end() if close is None else lower.find(close, m.end())
        if at < 0:
            break
    return len(lower)


def main_text(page: str) -> str:
    """Text outside of tags, comments and aside elements, in time linear in the page.

    A head that isn't closed ends where HTML ends it; of other elements that aren't closed only
    comments and raw text hide what follows.
    """
    # Lower-case of A-Z only, as other letters may change their number.
    lower, kept, at, open_ended = page.translate(LOWER), [], 0, set()
    opens = re.compile(r"<(?:!--|(" + "|".join(ASIDE) + r")\b)")
    while m := opens.search(lower, at):
        kept.append(page[at : m.start()])
        if m[1] == "head":
            at = head_end(lower, m.end())
            continue
        close = "-->" if m[1] is None else f"</{m[1]}"
        end = -1 if close in open_ended else lower.find(close, m.end())
        at = len(page) if end < 0 else end
        if end < 0 and m[1] is not None and m[1] not in RAW:
            open_ended.add(close)
            at = lower.find(">", m.end()) + 1 or len(page)
        if m[1] is None and end >= 0:
            at = end + 3
    kept.append(page[at:])
    return entities.unescape(TAG.sub(" ", " ".join(kept)))


def trigram_slots(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts in a row, and whose they are."""
    spaced = [f"  {x} " if (x := " ".join(t.lower().split())) else "" for t in texts]
    line = "".join(spaced)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in spaced])
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) ^ codes[2:]
    h = (h * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - bits)
    same = owner[:-2] == owner[2:]
    return h[same].astype(np.int64), owner[2:][same]


def fit(docs: DataFrame, fit_rows: int = 20_000, bits: int = 16, most_languages: int = 200) -> tuple[list[str], np.ndarray]:
    """Languages, and log-probabilities of the hashed trigrams of each, one row a language.

    About ``fit_rows`` documents of each language are drawn, or all that there are. Languages
    beyond the ``most_languages`` with most documents (ties by name) are one language, OTHER.
    """
    known = docs.where(F.col("lang").isNotNull() & (F.col("lang") != ""))
    known = known.select("doc_id", F.lower("lang").alias("lang"), whole_text(known).alias("text"))
    sizes = written(known.groupBy("lang").agg(F.count("*").alias("n")), "lang-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    top = sizes.orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    removed(sizes)

    def share(n: int) -> float:
        return fit_rows / max(n, fit_rows) * (1 << 20)

    # At most ``most_languages`` rows.
    own = known.sparkSession.createDataFrame([(r.lang, r.lang, share(r.n)) for r in top], "of string, class string, share double")
    rest = F.lit(share(total - sum(r.n for r in top)))
    drawn = (
        known.join(F.broadcast(own), F.col("lang") == F.col("of"), "left")
        .where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20)) < F.coalesce("share", rest))
        .select(F.coalesce("class", F.lit(OTHER)).alias("lang"), "text")
    )

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in small_batches(batches):
            langs = batch["lang"].to_pylist()
            slots, owner = trigram_slots(batch["text"].to_pylist(), bits)
            names = np.array(langs, object)
            for lang in set(langs):
                mine = np.flatnonzero(names == lang)
                counted = np.bincount(slots[np.isin(owner, mine)], minlength=1 << bits)
                counts[lang] = counts.get(lang, 0) + counted
        for lang, counted in counts.items():
            seen = np.flatnonzero(counted)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int64()), pa.array(counted[seen], pa.int64())],
                ["lang", "slot", "n"],
            )

    def one_row(group: pa.Table) -> pa.Table:
        n = np.zeros(1 << bits)
        n[group["slot"].to_numpy()] = group["n"].to_numpy()
        row = np.log((n + 0.5) / (n.sum() + 0.5 * (1 << bits))).astype(np.float32)
        return pa.table({"lang": group["lang"].slice(0, 1), "row": pa.array([row.tobytes()], pa.binary())})

    # A group has a row a slot.
    counted = drawn.mapInArrow(run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    rows = sorted(counted.groupBy("lang").applyInArrow(one_row, "lang string, row binary").collect(), key=lambda r: r.lang)
    table = np.array([np.frombuffer(r.row, np.float32) for r in rows], np.float32).reshape(len(rows), 1 << bits)
    return [r.lang for r in rows], table


def page_evidence(pages: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """``page_id, host, suffix, declared, addressed, text`` with log-likelihoods by language."""
    shared = pages.sparkSession.sparkContext.broadcast(table)
    bits = int(table.shape[1]).bit_length() - 1

    def run(batches):
        for batch in small_batches(batches, "html"):
            own = batch["html"].to_pylist()
            slots, owner = trigram_slots([main_text(p) for p in own], bits)
            ll = np.column_stack([np.bincount(owner, row[slots], len(own)) for row in shared.value]) * TEMPER
            declared = [m[1].lower() if (m := DECLARED.search(p)) else None for p in own]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["page_id"],
                    batch["url"],
                    pa.array(declared, pa.string()),
                    pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * len(languages), ll.reshape(-1)),
                ],
                ["page_id", "url", "declared", "text"],
            )

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).mapInArrow(run, "page_id long, url string, declared string, text array<double>")
    host = F.nullif(F.regexp_extract(F.lower("url"), r"^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit(""))
    suffix = F.nullif(F.regexp_extract(host, r"([^.]+)$", 1), F.lit(""))
    of_path = F.nullif(F.regexp_extract(F.lower("url"), r"^[a-z]+://[^/]+/([a-z]{2})(?:[-_/]|$)", 1), F.lit(""))
    country = F.coalesce(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])[suffix], suffix)
    known = F.array(*map(F.lit, languages))
    addressed = F.coalesce(F.when(F.array_contains(known, of_path), of_path), F.when(F.array_contains(known, country), country))
    return rows.select("page_id", host.alias("host"), suffix.alias("suffix"), "declared", addressed.alias("addressed"), "text")


def identify(pages: DataFrame, docs: DataFrame, strength: float = 4.0, **options) -> DataFrame:
    """``page_id, host, declared, addressed, text_lang, lang, probability``: a row for each page.

    ``strength`` is how many pages a wider prior weighs in a narrower one.
    """
    languages, table = fit(docs, **options)
    if not languages:
        none = F.lit(None).cast("string")
        return pages.select(
            F.col("page_id").cast("long").alias("page_id"),
            *[none.alias(c) for c in ("host", "declared", "addressed", "text_lang", "lang")],
            F.lit(None).cast("double").alias("probability"),
        )
    n = len(languages)
    names = F.array(*map(F.lit, languages))
    best = F.when(
        F.array_max("text") > F.array_min("text"), F.array_position("text", F.array_max("text")).cast("int") - 1
    )
    seen = page_evidence(pages, languages, table).withColumn("vote", best).withColumn("site", F.coalesce("host", F.lit("")))
    seen = written(seen, "lang-pages", 2000, 8)

    def by_language(rows: DataFrame, by: list[Column], name: str) -> DataFrame:
        """Votes of each group as an array by language, from a row a group and language that it has."""
        few = rows.groupBy(*by, "vote").agg(F.count("*").alias("n"))
        pairs = F.collect_list(F.when(F.col("vote").isNotNull(), F.struct("vote", "n")))
        groups = few.groupBy(*[c for c in few.columns if c not in ("vote", "n")])
        found = groups.agg(F.map_from_entries(pairs).alias("has"), F.coalesce(F.sum("n"), F.lit(0)).alias(f"{name}_pages"))
        every = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("has", i).cast("double"), F.lit(0.0)))
        return found.withColumn(name, every).drop("has")

    def votes(by: list[str], prefix: str) -> DataFrame:
        return by_language(seen, [F.col(c).alias(f"{prefix}_{c}") for c in by], prefix)

    def prior(counts: Column, wider: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, wider, lambda c, w: (c + w * strength) / (total + strength))

    even = F.array(*[F.lit(1.0 / n)] * n)
    # The suffix is a part of the host: a row a host.
    priors = (
        votes(["site", "suffix"], "of_host")
        .join(votes(["suffix"], "of_suffix"), F.col("of_host_suffix").eqNullSafe(F.col("of_suffix_suffix")))
        .crossJoin(F.broadcast(votes([], "of_all")))
        .select(
            F.col("of_host_site").alias("site"),
            F.col("of_host").alias("votes"),
            prior(F.col("of_suffix"), prior(F.col("of_all"), even)).alias("wider"),
            F.col("of_host_pages").alias("site_pages"),
        )
    )
    trust = {}
    for kind in ("declared", "addressed"):
        given = seen.where(F.col(kind).isNotNull())
        is_ = F.when(F.array_contains(names, F.col(kind)), F.col(kind)).otherwise("?").alias(f"{kind}_is")
        sums = by_language(given, [], f"{kind}_all").drop(f"{kind}_all_pages")
        trust[kind] = by_language(given, [is_], f"{kind}_votes").crossJoin(F.broadcast(sums)).select(
            f"{kind}_is",
            F.zip_with(f"{kind}_votes", f"{kind}_all", lambda v, a: F.ln((v + 0.5) / (a + 0.5 * (n + 1)))).alias(f"{kind}_ll"),
        )
    joined = hot_join(seen, written(priors, "lang-priors"), "site", "site_pages")
    for kind, rows in trust.items():
        key = F.when(F.array_contains(names, F.col(kind)), F.col(kind)).when(F.col(kind).isNotNull(), F.lit("?"))
        # At most one row a language: small whatever the number of pages.
        joined = joined.join(F.broadcast(rows), key == F.col(f"{kind}_is"), "left")
    others = F.transform(F.col("votes"), lambda v, i: v - F.coalesce((F.col("vote") == i).cast("double"), F.lit(0.0)))
    zero = F.array(*[F.lit(0.0)] * n)
    logs = prior(others, F.col("wider"))
    total = F.zip_with("text", logs, lambda t, p: t + F.ln(p))
    for kind in trust:
        total = F.zip_with(total, F.coalesce(f"{kind}_ll", zero), lambda a, b: a + b)
    scored = joined.withColumn("total", total).withColumn("top", F.array_max("total"))
    weight = F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return scored.select(
        "page_id",
        "host",
        "declared",
        "addressed",
        F.get(names, F.col("vote")).alias("text_lang"),
        F.element_at(names, F.array_position("total", F.col("top")).cast("int")).alias("lang"),
        (1 / weight).alias("probability"),
    )
