"""One thin query for each operator, over whole tables, with its SQL where SQL can say it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curve, exact, fingerprint, langid, merkle, minhash, mixing, packing, phrases, pii, suffixes, tokencount, toxicity
from .text import ascii_lower

def tokenizer_file(name: str) -> str:
    """Where the public tokenizer files are; every machine has them at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85).drop("file", "row")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.find_duplicates(table(spark, sf_dir, "documents")).drop("file", "row")

def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")

def op8_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))

def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.Manifest(docs, F.when(tampered, ascii_lower(F.col("text"))).otherwise(F.col("text"))).verified()


def op12_curve_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_fingerprints": op2_fingerprints,
    "op3_repeated_passages": op3_repeated_passages,
    "op4_toxicity": op4_toxicity,
    "op5_pii_spans": op5_pii_spans,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_source_mix": op7_source_mix,
    "op8_best_fit_pack": op8_best_fit_pack,
    "op9_language": op9_language,
    "op10_token_count": op10_token_count,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_curve_pack": op12_curve_pack,
    "op13_collocations": op13_collocations,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _leaf(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in fields) + ")"


def _tree(name: str, leaves: str) -> str:
    """Nodes of all levels over ``leaves(tree, i, n, h)``, and the runs of siblings."""
    return f"""{name}_nodes AS (SELECT tree, 0 AS level, i, h, n FROM {leaves}
          UNION ALL SELECT tree, level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, i // 16, n),
        {name}_runs AS (SELECT tree, level, i // 16 AS run, list(h ORDER BY i) AS hs FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, i // 16)"""


def _climb(name: str, starts: str) -> str:
    """The way of each of ``starts(leaf, tree, i, h, other, siblings)`` to the root: siblings by level, digests of it and its stand-in."""
    before = "coalesce(array_to_string(list_slice(hs, 1, CAST(p.i % 16 AS BIGINT)), ''), '')"
    after = "coalesce(array_to_string(list_slice(hs, CAST(p.i % 16 AS BIGINT) + 2, len(hs)), ''), '')"
    return f"""{name}_paths AS (SELECT leaf, tree, 0 AS level, i, h, other, siblings FROM {starts}
          UNION ALL SELECT p.leaf, p.tree, p.level + 1, p.i // 16, sha256({before} || p.h || {after}), sha256({before} || p.other || {after}), p.siblings || {before} || {after}
            FROM {name}_paths AS p JOIN {name}_runs AS r ON r.tree = p.tree AND r.level = p.level AND r.run = p.i // 16),
        {name}_ends AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY level DESC) AS above FROM {name}_paths) AS x WHERE above = 1)"""


#: CRC-32 of a short text, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x // 2, 3988292384 * (x % 2)))))"
_TAMPERED = f"CASE WHEN {_CRC} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"

ORACLE_SQL = {
    # Level by level, and each row's way up its two trees.
    "op11_merkle_manifest": f"""
        WITH RECURSIVE named AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER () AS sources FROM (SELECT DISTINCT source FROM documents) AS s),
        d AS (SELECT doc_id, source, {_leaf("text")} AS h, {_leaf("shown")} AS other FROM (SELECT *, {_TAMPERED} AS shown FROM documents) AS x),
        leaves AS (SELECT row_number() OVER () AS leaf, doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n, h, other, '' AS siblings
                   FROM d JOIN named ON named.source IS NOT DISTINCT FROM d.source),
        {_tree("low", "leaves")},
        {_climb("low", "leaves")},
        subroots AS (SELECT 0 AS tree, t.tree AS i, sources AS n, t.h FROM (SELECT DISTINCT tree, h FROM low_ends) AS t JOIN named ON named.tree = t.tree),
        {_tree("high", "subroots")},
        starts AS (SELECT leaf, 0 AS tree, tree AS i, h, other, siblings FROM low_ends),
        {_climb("high", "starts")}
        SELECT doc_id, leaves.h AS leaf, low_ends.h AS subroot, high_ends.h AS root, sha256(high_ends.siblings) AS proof_sha256, high_ends.other AS folded_root, high_ends.other = high_ends.h AS verified
        FROM leaves JOIN low_ends ON low_ends.leaf = leaves.leaf JOIN high_ends ON high_ends.leaf = leaves.leaf""",
    # Every run of up to four words of every piece, counted as it is.
    "op13_collocations": """
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
        t AS (SELECT lang, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS k(m) WHERE len(ws) >= m),
        f AS (SELECT lang, m, list_slice(ws, i, i + m - 1) AS ws, count(*) AS a FROM t GROUP BY 1, 2, 3),
        total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
        cut AS (SELECT c.lang, c.ws, c.a, k, l.a AS l, r.a AS r, (CAST(2000000 AS HUGEINT) * c.a) // (CAST(l.a AS HUGEINT) + r.a) AS score
                FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM f WHERE m > 1 AND a >= 30) AS c
                JOIN f AS l ON l.lang = c.lang AND l.ws = list_slice(c.ws, 1, k) JOIN f AS r ON r.lang = c.lang AND r.ws = list_slice(c.ws, k + 1, c.m)),
        weak AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) AS place FROM cut) AS x WHERE place = 1),
        sub AS (SELECT lang, list_slice(ws, i, i + z - 1) AS ws, max(a) AS longer FROM (SELECT *, unnest(generate_series(1, m - z + 1)) AS i FROM f, (VALUES (2), (3)) AS q(z) WHERE m > z AND a >= 30) AS y GROUP BY 1, 2),
        kept AS (SELECT weak.lang, array_to_string(weak.ws, ' ') AS phrase, a, l, r, score FROM weak LEFT JOIN sub ON sub.lang = weak.lang AND sub.ws = weak.ws
                 WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a)
        SELECT z.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) AS z JOIN total ON total.lang = z.lang WHERE rank <= 2000""",
    "op6_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_LOWER} AS t FROM documents),
             r AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id,
                          count(*) OVER (PARTITION BY t) AS group_size,
                          row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS place
                   FROM n)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept,
               sha256(t) AS text_sha256
        FROM r""",
    # Quotients are ranked one by one, documents lie on one line a shard.
    "op7_source_mix": """
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                          CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 8) AS BIGINT) AS drawn FROM documents),
             s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                          CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
                   FROM d GROUP BY source),
             -- Sources fill up by falling need; one level of words a weight holds for those that don't.
             f AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS most, sum(source_size) OVER () * 1.5::DOUBLE AS total,
                          row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place FROM s),
             g AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                             / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
             h AS (SELECT *, CASE WHEN most <= weight * level THEN most
                             ELSE weight * (SELECT level FROM g AS o WHERE o.most > o.weight * o.level ORDER BY place LIMIT 1) END AS target FROM g),
             q AS (SELECT source, target, CAST(round(total / 32) AS BIGINT) AS seats, unnest(generate_series(1, CAST(2 * target / 32 AS BIGINT) + 2)) AS k FROM h WHERE target > 0),
             won AS (SELECT source, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY target / (k - 0.5::DOUBLE) DESC, source NULLS LAST, k) AS n FROM q) AS x
                     WHERE n <= seats GROUP BY source),
             t AS (SELECT h.source, source_size, target, coalesce(quota, 0) AS quota, least(greatest(CAST(ceil(source_size / 1048576) AS BIGINT), 1), 65536) AS shards
                   FROM h LEFT JOIN won ON won.source IS NOT DISTINCT FROM h.source),
             p AS (SELECT d.*, source_size, target, quota, drawn % shards AS shard FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
             w AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS words, max(quota) AS seats FROM p GROUP BY source, shard),
             r AS (SELECT source, shard, seats, CAST(words AS DOUBLE) AS votes, unnest(generate_series(1, CAST(3 * words / 32 AS BIGINT) + 2)) AS k FROM w WHERE words > 0),
             got AS (SELECT source, shard, count(*) AS q FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY votes / (k - 0.5::DOUBLE) DESC, shard, k) AS n FROM r) AS x
                     WHERE n <= seats GROUP BY source, shard),
             b AS (SELECT w.source, w.shard, words, greatest((words + 31) // 32, 1) AS blocks, least(coalesce(q, 0), 2 * greatest((words + 31) // 32, 1)) AS quota
                   FROM w LEFT JOIN got ON got.source IS NOT DISTINCT FROM w.source AND got.shard = w.shard),
             l AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source, shard ORDER BY drawn, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stop FROM p)
        SELECT doc_id, size, source_size, target,
               CAST(size * (b.quota // blocks) + least(stop, least((b.quota % blocks) * 32, words)) - least(stop - size, least((b.quota % blocks) * 32, words)) AS BIGINT) AS taken
        FROM l JOIN b ON b.source IS NOT DISTINCT FROM l.source AND b.shard = l.shard""",
}
