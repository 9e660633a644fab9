"""From documents to packed training sequences, stage by stage.

``STAGES`` holds (name, function) pairs.  Each function takes (spark, docs,
sf_dir) and returns the documents that go on, with the columns of
``documents``; the last returns the packed pieces.  Between stages the rows
are written as Parquet and read again.  A stage decides by small tables of
text digests or ids, against which its documents are filtered; the tables that
led there are deleted as soon as they are decided.

Rows without text or id pass the filters like others: an empty text has a
score of its own in the classifiers, and a row without an id links with
nothing.  Equal texts share a score, so repeated rows go or stay together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerlens.llm import fair_mix, jaccard_join, kn_toxicity, line_crf, packing
from dealerlens.llm.common import global_rank, passing, prepare, stored, without

#: 128 bits of a text, as two columns; null counts as the empty text.
DIGEST = ("_d1", "_d2")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _digested(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({c: F.xxhash64(F.lit(k), text) for k, c in enumerate(DIGEST)})


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney models don't call toxic."""
    prepare(spark)
    with passing(spark):
        model = kn_toxicity.fit(docs, _labels(spark, sf_dir))
        scored = kn_toxicity.score(_digested(docs), model, out="_score", keep=DIGEST)
        toxic = stored(scored.where(F.col("_score") >= kn_toxicity.THRESHOLD).select(*DIGEST).distinct(),
                       "pipeline-toxic", lasting=True)
    return without(_digested(docs), toxic, DIGEST).select(docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field over lines calls good."""
    field = line_crf.fit(docs, _labels(spark, sf_dir))
    scored = line_crf.score(docs, field, out="_score")
    return scored.where(F.col("_score") >= line_crf.THRESHOLD).drop("_score")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near copies (five words, similarity 0.8) the
    document with the smallest id.  An id that several rows bear names none of
    them: its different texts are documents of their own (and come before
    others), its equal ones are one."""
    prepare(spark)
    with passing(spark):
        repeated = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
                          .where("n > 1").select("doc_id"), "pipeline-repeated", lasting=True)
        single = docs.withColumn("_vid", F.col("doc_id").cast("long"))
        named = single
        if not repeated.isEmpty():
            single = without(single, repeated, ("doc_id",))
            same = [F.col("doc_id"), *map(F.col, DIGEST)]
            row = F.min(F.struct(*docs.columns)).alias("row")  # equal ids and texts: one row
            own = _digested(docs.join(repeated, "doc_id", "left_semi")).groupBy(*same).agg(row)
            below = F.lit(min(docs.agg(F.min("doc_id")).first()[0], 0) - 1)
            own = stored(global_rank(own, same, "pipeline-own")
                         .select("row.*", (below - F.col("rank")).alias("_vid")), "pipeline-own", lasting=True)
            named = single.unionByName(own)
        groups = jaccard_join.groups(named.select(F.col("_vid").alias("doc_id"), "text"))
        others = stored(groups.where("component_id <> doc_id").select(F.col("doc_id").alias("_vid")).distinct(),
                        "pipeline-others", lasting=True)
    return without(named, others, ("_vid",)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the weighted fair queue takes it; documents
    without words don't enter, and equal places in the queue (rows alike in
    source, id and size) are taken in any order."""
    prepare(spark)
    rows = stored(docs.withColumn("_rid", F.monotonically_increasing_id()), "pipeline-rows")
    with passing(spark):
        taken = stored(fair_mix.mix(rows, keep=("_rid",)).where("copies > 0").select("_rid", "copies"),
                       "pipeline-taken", lasting=True)
    return (rows.join(taken, "_rid").withColumn("_lap", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select(docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.  A null text
    is packed as an empty one; repeated rows are packed once each, and equal
    lengths may change places."""
    out = packing.pack_documents(docs)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_copies", one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned classifiers and tokenisers can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
