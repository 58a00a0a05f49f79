"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, hardneg, lm, neardup, packing, paragraphs, quality, repeats, sharding, tokenfiles, toxicity, whitening, wordpieces
from tidemark.llm.common import read


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary; any other file of the tokenizers library will do."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")), 0.3)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), Path(tokenizer_path()).read_bytes(), 4096, 1)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(read(spark, sf_dir, "documents"), 400).drop("spans")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpieces.token_counts(read(spark, sf_dir, "documents"), wordpieces.vocabulary(tokenizer_path()))


def op7_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.without_paragraph_copies(read(spark, sf_dir, "documents"), 80)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), 85)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_plan(read(spark, sf_dir, "documents"), 16)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), 32)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_files(read(spark, sf_dir, "documents"), Path(tokenizer_path("byte_bpe_50k.json")).read_bytes(), 2)


QUERIES = {"op1_toxicity": op1_toxicity, "op10_decontaminate": op10_decontaminate, "op11_whitening": op11_whitening, "op12_hard_negatives": op12_hard_negatives, "op13_token_files": op13_token_files, "op2_quality": op2_quality, "op3_scores": op3_scores, "op4_packing": op4_packing, "op5_repeats": op5_repeats, "op6_token_counts": op6_token_counts, "op7_paragraphs": op7_paragraphs, "op8_near_duplicates": op8_near_duplicates, "op9_sharding": op9_sharding}
#: The others learn, iterate, tokenize, align, hash or count bytes beyond SQL's means. The tests hold them against brute-force versions; of op1 they hold planted
#: cases and held-out figures, of op3 the base score, orders and sums.
ORACLE_SQL: dict[str, str] = {
    "op12_hard_negatives": r"""WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 10""",
    "op8_near_duplicates": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        l AS (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM sh p JOIN sh q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL) x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
        r AS (SELECT DISTINCT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
        m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id, coalesce(m.component_id, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id""",
}
