"""A corpus pipeline over ``documents``: language, near-duplicates, benchmark leaks, personal data,
tokens. Each stage takes what its predecessor kept and decides on all of it.

Every stage but the last returns the columns of ``documents``. Extra columns pass through. Null or
empty texts: the first stage rejects them, for they have no language; given to a later stage, they
are one group of copies, leak nothing, hold no personal data and have no tokens. Repeated rows are
copies. An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import bpe, common, decontaminate, langid, pii, simhash
from riskweave.llm.queries import multilingual_vocabulary
from riskweave.session import table

#: A document is rejected if no language is found in it, or none with enough certainty. Enough is what
#: all but LOSS of the labelled documents that the network has not learnt from reach, and at most
#: CERTAINTY of the way from chance (1 / languages, the least that the likeliest can score) to 1.
LOSS, CERTAINTY, STEPS = 0.001, 0.75, 10_000


def least_score(docs: DataFrame, network: langid.Network) -> float:
    known = langid.predict(docs.where(F.col("lang").isNotNull() & langid.held_out()).select("text"), network)
    # counts of scores in steps of 1/STEPS, which is all that comes here: the same whatever the tasks' order
    rows = known.where(F.col("lang_pred") != langid.UNKNOWN).groupBy(F.floor(F.col("score") * STEPS).alias("step")).count().collect()
    counts, seen = sorted((r["step"], r["count"]) for r in rows), 0
    chance = 1 / max(1, len(network.langs))
    least = chance + (1 - chance) * CERTAINTY
    total = sum(n for _, n in counts)
    for step, n in counts:
        seen += n
        if seen > LOSS * total:
            return min(least, step / STEPS)
    return least


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised."""
    network = langid.train(langid.sample(docs))
    least = least_score(docs, network)
    lang, score = common.free(docs, "lang_pred", "score")
    kept = langid.predict(docs, network, outputs=(lang, score))
    return kept.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id, of each group of near-duplicates (fingerprints
    at 3 bits or fewer; the README has what share of edited copies that reaches). Rows stand for
    themselves: a null or repeated id does not make rows of different texts one."""
    name, key = *common.free(docs, "_key"), common.row_key("doc_id", "text")
    # an id that is null is never the least; rows of one id go by their keys
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), key.alias("key"))
    found = simhash.near_duplicates(docs.select(row.alias("row"), "text"), "row")
    first = found.where(F.col("row") == F.col("component_id")).select(F.col("row.key").alias(name)).distinct()
    kept = docs.withColumn(name, key).join(first, name, "left_semi")
    return kept.dropDuplicates([name]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that cover a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts and decodes them again: ids, their number, and the digest of the bytes
    they stand for."""
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), multilingual_vocabulary(spark), with_bytes=True)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("byte_bpe", tokens),
]

#: Trained models, iterated graphs and byte pairs are beyond SQL; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs)
    return docs
