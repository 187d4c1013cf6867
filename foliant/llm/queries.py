"""The queries of this folder, over the whole tables of ``sf_dir``, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import factorisation, language_model, langid, licences, minhash, mixing, ogg, packing, quality_rules, toxicity
from .common import documents, fold


def _labelled(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    return documents(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2).select("doc_id", label)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out"))
    return toxicity.score(docs, toxicity.learn(docs, _labelled(spark, sf_dir, "toxic")), ["doc_id", "held_out"])


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), shingle=2)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (fold("doc_id", 5) == 0).alias("held_out"))
    model = langid.learn(docs.where("not held_out"))
    return langid.identify(docs, model, ["doc_id", "held_out"])


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (fold("doc_id", 7) == 2).alias("held_out"))
    model = language_model.train(docs.where("not held_out"))
    return language_model.score(docs, model, ["doc_id", "held_out"])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op7_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.digest(documents(spark, sf_dir))


def op8_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out"))
    return factorisation.score(docs, factorisation.learn(docs, _labelled(spark, sf_dir, "quality")), ["doc_id", "held_out"])


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_minhash, op3_quality_rules, op4_language_id, op5_language_model, op6_mixing, op7_ogg, op8_factorisation, op9_licences, op10_packing)
}
#: The others can't be said in SQL: they are learned, random, or made of bytes. tests/llm holds them against plain versions.
ORACLES: dict[str, str] = {
    "op2_minhash": r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
""",
}
