"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import crc_mod, table


def op1_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.linededup import find

    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.lm import scores

    return scores(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.simhash import near_groups

    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.decontaminate import matches, n_hit

    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit() > 0).alias("contaminated"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.substring import remove

    return remove(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm import langid

    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fitted(docs)).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.maxscore import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm import pii

    found = pii.find(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in pii.KINDS])

    def count(kind: int):  # not a lambda with a default, whose second parameter would be an element's place
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *counts, "base_sha256", spans.alias("spans"))


OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, v AS qv FROM v WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, CAST(list_sum(list_transform(list_zip(qv, v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM q JOIN v ON vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

QUERIES = {"op1_linededup": op1_linededup, "op2_lm": op2_lm, "op3_simhash": op3_simhash, "op4_decontaminate": op4_decontaminate, "op5_mixing": op5_mixing, "op6_substring": op6_substring, "op7_langid": op7_langid, "op8_maxscore": op8_maxscore, "op9_pii": op9_pii, "op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {"op8_maxscore": OP8}
