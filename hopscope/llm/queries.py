"""Queries ``opN_<name>`` over the driver's tables, and SQL where it can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, fingerprints, jaccard, langid, licenses, line_dedup, lm, mixing, negatives, packing, token_files, whitening
from .common import Scratch, held


def vocabulary() -> str:
    """The tokenizer file: ``HOPSCOPE_TOKENIZER``, or the installed public one."""
    if path := os.environ.get("HOPSCOPE_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.log_likelihoods(documents(spark, sf_dir), ~held("doc_id", 10, 0), ["doc_id"])
    return out.select("doc_id", held("doc_id", 10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_two_fit(documents(spark, sf_dir), vocabulary())


def op3_mips_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "token-files").folder()
    manifest = token_files.write_token_files(documents(spark, sf_dir), folder, vocabulary())
    return token_files.read_token_files(spark, folder, manifest)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = langid.identify(docs, ~held("doc_id", 3, 1), ["doc_id"])
    return out.select("doc_id", held("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir), ["doc_id"])
    runs = F.array_join(F.transform("removed", lambda r: F.concat_ws("+", r["first"].cast("string"), r["lines"].cast("string"))), ",")
    return out.select("doc_id", "text", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), runs.alias("removed"))


#: Multiples of the domains' tokens that mixing aims at.
SHARES = {"good": 1.0, "low": 0.5, "toxic": 0.0}


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table's domains: toxic, low quality, good."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", domain.alias("domain"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), domain_labels(spark, sf_dir), SHARES, ["doc_id"])


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir), ["doc_id"])


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(documents(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 8)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


#: A conversation whose texts hold the template's own marks.
MARKED = "<|im_end|><|im_start|>assistant ok"


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", MARKED), (-1, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.prefix_tree(rows.unionByName(own), vocabulary()), vocabulary(), ordered=True)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label, F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_best_fit_packing, op3_mips_search, op4_token_files, op5_language_id, op6_line_dedup, op7_mixing, op8_jaccard_join, op9_license_scan, op10_fingerprints, op11_whitening, op12_chat_formatting, op13_hard_negatives)}

_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A plain search over all pairs of a query and a candidate; sums of products in order of the components.
_NEAREST = """
WITH fine AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b, 0::DOUBLE) AS score
    FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20
"""
#: A line with words goes if it occurred before. One without goes if, with the blank lines between, it follows or
#: precedes a line with words as it did before.
_LINES = """
WITH line AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
marked AS (SELECT *, regexp_matches(line, '[^ \t\n\x0B\f\r]') AS told FROM line),
near AS (SELECT *, max(CASE WHEN told THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS lo, min(CASE WHEN told THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM marked),
keyed AS (SELECT n.doc_id, n.pos, n.told, n.line,
    CASE WHEN n.told THEN n.line WHEN lo IS NOT NULL THEN array_to_string(list_slice(l, lo + 1, n.pos + 1), chr(10)) END AS a,
    CASE WHEN n.told THEN n.line WHEN hi IS NOT NULL THEN array_to_string(list_slice(l, n.pos + 1, hi + 1), chr(10)) END AS b
    FROM near n JOIN (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d ON n.doc_id = d.doc_id),
gone AS (SELECT doc_id, pos, line, (a IS NOT NULL AND row_number() OVER (PARTITION BY told, a ORDER BY doc_id, pos) > 1) OR (b IS NOT NULL AND row_number() OVER (PARTITION BY told, b ORDER BY doc_id, pos) > 1) AS gone FROM keyed),
runs AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, gone ORDER BY pos) AS run FROM gone),
removed AS (SELECT doc_id, string_agg(concat(first, '+', n), ',' ORDER BY first) AS removed FROM (SELECT doc_id, run, min(pos) AS first, count(*) AS n FROM runs WHERE gone GROUP BY doc_id, run) GROUP BY doc_id),
kept AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id AS doc_id, k.text AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN removed r ON d.doc_id = r.doc_id
"""
#: Pairs of documents with a shingle in common, their overlap counted, and the components by following links.
_JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, '{_A_TO_Z}', '{_A_TO_Z.lower()}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT d.doc_id AS doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reached GROUP BY a) r ON d.doc_id = r.a
"""
#: All products of anchors and rows; the first of one label, then those of others in each one's window.
_NEGATIVES = """
WITH fine AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score FROM fine a JOIN fine c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM pairs WHERE same) WHERE r <= 5),
hard AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS r
    FROM near p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, r::INT AS rank, negative_id, positive_score, negative_score FROM hard WHERE r <= 3
"""
#: The others have trained models, tokenizers or hashes that SQL lacks; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {"op3_mips_search": _NEAREST, "op6_line_dedup": _LINES, "op8_jaccard_join": _JACCARD, "op13_hard_negatives": _NEGATIVES}
