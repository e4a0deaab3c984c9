"""A corpus pipeline out of the operators in ``docscope.llm``.

Each stage takes ``(spark, docs, sf_dir)``; its result is materialised (a checkpoint in ``run``, Parquet where stages are
run one by one) and read as the next one's docs, so no stage is computed twice. All stages but the last return the
columns of documents. In every stage nulls, empty and very long texts, repeated rows and columns of other names are
rows and columns like others, and an empty table gives an empty one; what a stage does with them stands there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscope.llm import decontamination, lsh_forest, piece_codec, quality_classifier, secret_scan
from docscope.llm.common import cut, spread_join, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go. It is fitted on this stage's input.

    Null texts, and texts of too few words to tell, stay. Repeated rows are judged alike.
    """
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the least id; repeated rows stay once.

    A row without id stays only if no row with an id has its set, once for each set; blank texts are in no group. Texts
    that share an id are told apart by ``(doc_id, text)``; of equal ones any row stays. Null, empty and very long texts are rows like others;
    an empty table gives an empty one. Other columns may have any names.
    """
    rows = cut(lsh_forest.groups(docs))
    blank, alone = F.col("n_shingles") == 0, F.col("component").isNull()
    named = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    name = F.when(blank, named(0, F.col("row_key"), F.col("row_key2"))).when(alone, named(1, F.col("ka"), F.col("kb")))
    name = name.otherwise(named(2, F.col("component"), F.lit(0).cast("long")))
    first = rows.groupBy(name.alias("name")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "row_key2")).alias("x"))
    keys = ["row_key", "row_key2"]
    kept = cut(first.select("x.row_key", "x.row_key2").join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("weight")), keys), rows.count(), apart=True)
    row = docs.select(F.struct("*").alias("row"))
    row = row.select("row", F.xxhash64("row.doc_id", "row.text").alias("row_key"), F.xxhash64(F.lit(1), "row.text", "row.doc_id").alias("row_key2"))
    out = spread_join(row, kept, keys, "left_semi")
    again = kept.filter("weight > 1")
    if not again.isEmpty():
        repeated = spread_join(out, again, keys, "left_semi").groupBy(*keys).agg(F.first("row").alias("row")).select("row", *keys)
        out = spread_join(out, again, keys, "left_anti").unionByName(repeated)
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go. Null texts and texts without words stay; an empty benchmark drops nothing."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blanked out of the texts, ``n_chars`` follows. All rows stay; null texts stay null."""
    return secret_scan.redact(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become piece ids; the decoded text's hash stands beside them. Null and empty texts have no ids."""
    return piece_codec.encode_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: The fitted classifier and the vocabulary have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage returns is materialised before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
