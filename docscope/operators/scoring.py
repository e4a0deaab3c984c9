"""Scores of extracted records, documents and grid cells. Null means not applicable; every rate names its denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docscope.functions import text as T
from docscope.functions.numbers import ratio
from docscope.operators.catalog import resolve
from docscope.operators.sizes import small

NO_ANSWER = ("provider_error", "provider_unavailable")
FAILED = ("invalid_after_repair", "length_truncated", "unparseable")


def status(outcome: Column, n_records: Column) -> Column:
    return F.when(outcome.isin(*NO_ANSWER), "no_answer").when(outcome.isin(*FAILED), "failed").when(n_records == 0, "answered_empty").otherwise("answered")


def score_default(r: dict[str, Column], machine: Column) -> tuple[Column, Column]:
    """(kind correct, value correct) of a record with catalog row ``c`` and documentation row ``d``.

    A machine-dependent default must be called so; an empty documented cell means absent; a documented NULL may be
    quoted or called absent; everything else is literal. Values count only where the documentation states one.
    """
    ok = (
        F.when(machine, r["kind"] == "machine_dependent")
        .when(r["d_empty"], r["kind"] == "absent")
        .when(r["d_value"].isNull(), r["kind"].isin("literal", "absent"))
        .otherwise(r["kind"] == "literal")
    )
    known = r["c_type"].isNotNull() & r["d_empty"].isNotNull()
    same = F.coalesce(T.norm_default(r["value"]) == T.norm_default(r["d_value"]), F.lit(False))
    return F.when(known, ok), F.when(known & r["d_value"].isNotNull() & ~machine, same)


def record_scores(records: DataFrame, catalog: DataFrame, index: DataFrame, reference: DataFrame, absent: DataFrame | None = None, machine: tuple[str, ...] = ()) -> DataFrame:
    """Score ``records (keys..., doc_id, name, input_type, scope, default_kind, default_value, grounded)``.

    ``absent (doc_id, key)`` lists names that a document does describe although the catalog lacks them.
    """
    out = resolve(records, catalog, index)
    ref = reference.select(F.col("name").alias("canonical"), F.col("default_value").alias("d_value"), F.col("default_is_empty_cell").alias("d_empty"))
    out = out.join(small(ref), "canonical", "left")
    if absent is not None:
        marks = absent.select("doc_id", F.col("key").alias("absent_key")).distinct().withColumn("listed", F.lit(True))
        out = out.join(marks, (out.doc_id == marks.doc_id) & (T.name_key(out.name) == marks.absent_key), "left").drop(marks.doc_id).drop("absent_key")
    else:
        out = out.withColumn("listed", F.lit(None).cast("boolean"))
    known = F.col("canonical").isNotNull()
    kind, value = score_default(
        {"kind": F.col("default_kind"), "value": F.col("default_value"), "d_value": F.col("d_value"), "d_empty": F.col("d_empty"), "c_type": F.col("c_type")},
        F.coalesce(F.col("canonical").isin(*machine), F.lit(False)),
    )
    doc_only = ~known & F.coalesce("listed", F.lit(False))
    return (
        out.withColumn("documented_not_in_binary", doc_only)
        .withColumn("hallucinated", ~known & ~F.coalesce("listed", F.lit(False)))
        .withColumn("input_type_correct", F.col("input_type") == F.col("c_type"))
        .withColumn("scope_correct", F.col("scope") == F.col("c_scope"))
        .withColumn("default_kind_correct", kind)
        .withColumn("default_value_correct", value)
        .drop("listed", "d_value", "d_empty", "c_type", "c_scope")
    )


def expected_names(docs: DataFrame, reference_rows: DataFrame, hand_labels: DataFrame, mentioned: DataFrame) -> DataFrame:
    """``(doc_id, truth_source, expected)``: a reference row beats a hand label, a hand label the mentions.

    Inputs are keyed by doc_id: ``target`` (one name), ``documents`` (array; null means not judged), ``names`` (array).
    """
    out = docs.select("doc_id").join(reference_rows, "doc_id", "left").join(hand_labels, "doc_id", "left").join(mentioned, "doc_id", "left")
    source = F.when(F.col("target").isNotNull(), "reference-row").when(F.col("documents").isNotNull(), "hand-label").otherwise("mentioned-proxy")
    none = F.array().cast("array<string>")
    names = F.when(F.col("target").isNotNull(), F.array("target")).when(F.col("documents").isNotNull(), F.col("documents")).otherwise(F.coalesce("names", none))
    return out.select("doc_id", source.alias("truth_source"), names.alias("expected"))


def summary(documents: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cell. Records and documents are different grains: each is summed on its own, then they meet."""
    docs = documents.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.count_if(F.col("status") == "no_answer").alias("n_no_answer"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.count_if(F.col("status") == "answered_empty").alias("n_empty"),
        F.count_if("empty_was_correct").alias("n_empty_correct"),
        F.sum(F.size("expected")).alias("n_expected"),
        F.sum(F.size(F.array_intersect("expected", "returned"))).alias("n_found"),
        F.sum(F.when(F.col("status").isin("answered", "answered_empty"), F.size("expected")).otherwise(0)).alias("n_expected_answered"),
    )
    recs = records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if("hallucinated").alias("n_hallucinated"),
        F.count_if("documented_not_in_binary").alias("n_doc_only"),
        F.count_if("grounded").alias("n_grounded"),
        F.count_if("input_type_correct").alias("n_type_correct"),
        F.count_if("scope_correct").alias("n_scope_correct"),
        F.count("default_kind_correct").alias("n_default_kind"),
        F.count_if("default_kind_correct").alias("n_default_kind_correct"),
        F.count("default_value_correct").alias("n_default_value"),
        F.count_if("default_value_correct").alias("n_default_value_correct"),
    )
    out = docs.join(recs, keys, "left").fillna(0)
    out = out.withColumn("n_real", F.col("n_records") - F.col("n_hallucinated") - F.col("n_doc_only"))
    rate = lambda a, b: F.round(ratio(F.col(a), F.col(b)), 4)
    return (
        out.withColumn("availability", F.round(1 - ratio(F.col("n_no_answer"), F.col("n_documents")), 4))
        .withColumn("hallucination_rate", rate("n_hallucinated", "n_records"))
        .withColumn("type_accuracy", rate("n_type_correct", "n_real"))
        .withColumn("scope_accuracy", rate("n_scope_correct", "n_real"))
        .withColumn("grounding_rate", rate("n_grounded", "n_records"))
        .withColumn("recall", rate("n_found", "n_expected"))
        .withColumn("recall_answered", rate("n_found", "n_expected_answered"))
    )
