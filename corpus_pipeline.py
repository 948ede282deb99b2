"""A corpus from documents: languages, near duplicates, mixture, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of docs. Defined results: a document without a letter, or whose language is a mere guess, is rejected;
of each group of near duplicates, and of repeated rows of one id and text, one stays, and a document without an id stays; without
labels every document keeps its place in the mixture; null texts count as empty; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomotif.llm import jaccard_join, langid, mixing, packing, queries
from geomotif.llm.common import fresh, small_batches, stage, table, without

#: Domains of the labels table between which the mixture weighs, and their weights by tokens: toxic text has the weight
#: that op1 gives it. High and low quality are one domain here, as documents don't repeat in the packed sequences: a
#: weight between the two could be reached by deleting clean text alone.
DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality is not null THEN 'clean' END"
TARGETS = {"clean": 1 - queries.TARGETS["toxic"], "toxic": queries.TARGETS["toxic"]}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language and those that two languages claim about equally."""
    small_batches(spark)
    lang, score, doubt = fresh(docs, "lang_pred", "score", "ambiguous")
    model = langid.fit(docs)
    judged = langid.predict(docs, model, keep_text=True, names=(lang, score, doubt))
    rejected = (F.col(lang) == langid.UNKNOWN) | (F.col(doubt) & (F.col(score) < 0.5))
    return judged.where(~rejected).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by a similarity of 0.8 on five-word shingles."""
    small_batches(spark)
    if not jaccard_join.repeats(docs, "doc_id"):
        found = stage(jaccard_join.jaccard_components(docs.select("doc_id", "text"), k=5, num=80, den=100), "near")
        return without(docs, found.where("doc_id <> component_id").select("doc_id"), "doc_id").select(*docs.columns)
    # rows of one id: those of equal text are one document, those of different texts are several
    (key,) = fresh(docs, "key")
    keyed = docs.withColumn(key, jaccard_join.row_key("doc_id", "text"))
    found = jaccard_join.jaccard_components(keyed.select(key, "text"), k=5, num=80, den=100, id_col=key).withColumnRenamed(key, "k")
    found = stage(found.join(keyed.where("doc_id is not null").select(F.col(key).alias("k"), "doc_id").distinct(), "k"), "near")
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "k")).alias("first"))
    out = without(keyed, found.join(first, "component_id").where("k <> first.k").select("k"), key)
    again = found.groupBy("k").count().where("count > 1").select(F.col("k").alias(key))
    out = without(out, again, key).unionByName(out.join(again, key, "left_semi").dropDuplicates([key]))
    return out.select(*docs.columns)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are labelled as clean or judged no likelier toxic than clean, and of the others as many as make
    up toxic's weight. Rows of one id stay or go together."""
    labels = table(spark, sf_dir, "labels")
    rated, domains = mixing.mix(docs, labels, TARGETS, max_rate=1.0, domain=DOMAIN)
    clean = F.col("posterior")[domains.index("clean")] if "clean" in domains else F.lit(0.0)
    gone = rated.groupBy("doc_id").agg(F.max((F.col("copies") > 0) | (clean >= 0.5)).alias("kept")).where("not kept")
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).where(F.expr(DOMAIN) == "clean")
    return without(docs, gone.join(known, "doc_id", "left_anti").select("doc_id"), "doc_id")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: a row for each piece of a document."""
    small_batches(spark)
    return packing.pack(packing.token_pieces(docs, capacity=1024), capacity=1024)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mixing", mixing_to_targets),
    ("best_fit_packing", best_fit_packing),
]

#: Classifiers and a tokenizer make these rows: SQL can't.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
