"""A deterministic stand-in for model output: integer arithmetic over document ids, arms and prompts.

Both engines build it alike. It measures nothing about any model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscope import fixtures
from docscope.functions import text as T
from docscope.operators import catalog as C
from docscope.operators import corpus, grid, scoring

ARMS, PROMPTS = 5, 2
INVENTED = "zz_option"

LABELS_SQL = f"""
catalog AS ({fixtures.values(fixtures.CATALOG, fixtures.CATALOG_COLUMNS)}),
claims AS (SELECT unnest(string_split(aliases, ',')) AS label, name AS canonical FROM catalog WHERE aliases <> ''),
labels_ix AS (SELECT * FROM claims UNION ALL SELECT name, name FROM catalog WHERE name NOT IN (SELECT label FROM claims)),
tok AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS label FROM documents),
mentions AS (SELECT doc_id, canonical AS name, CAST(count(*) AS BIGINT) AS n, canonical IN ('and', 'und') AS distractor
  FROM tok JOIN labels_ix USING (label) GROUP BY doc_id, canonical)"""

GRID_SQL = LABELS_SQL + f""",
cells AS (SELECT d.doc_id, a, p, (7 * d.doc_id + 3 * a + p) % 20 AS o FROM documents d, range(0, {ARMS}) x(a), range(0, {PROMPTS}) y(p)),
outs AS (SELECT *, CASE WHEN o = 0 THEN 'provider_error' WHEN o = 1 THEN 'provider_unavailable' WHEN o = 2 THEN 'unparseable' WHEN o < 6 THEN 'valid_after_repair' ELSE 'valid_first_pass' END AS outcome FROM cells),
names AS (
  SELECT c.doc_id, c.a, c.p, m.name FROM outs c JOIN mentions m USING (doc_id) WHERE o > 2 AND (c.doc_id + 7 * a + 3 * p + length(m.name)) % 5 <> 0
  UNION ALL SELECT doc_id, a, p, '{INVENTED}' FROM outs WHERE o > 2 AND (doc_id + a) % 11 = 0),
records AS (
  SELECT r.doc_id, r.a, r.p, r.name,
    CASE WHEN (r.doc_id + a + length(r.name)) % 4 = 0 OR k.input_type IS NULL THEN 'VARCHAR' ELSE k.input_type END AS input_type,
    CASE WHEN (r.doc_id + p) % 6 = 0 OR k.scope IS NULL THEN 'LOCAL' ELSE k.scope END AS scope,
    CASE (r.doc_id + a + 2 * length(r.name)) % 4 WHEN 1 THEN 'absent' WHEN 2 THEN 'machine_dependent' ELSE 'literal' END AS default_kind,
    CASE WHEN (r.doc_id + a + 2 * length(r.name)) % 4 IN (0, 3) THEN CASE WHEN r.doc_id % 2 = 0 THEN '`Full`' ELSE '8' END END AS default_value,
    CASE WHEN (r.doc_id + p) % 13 = 0 THEN '#!' ELSE '' END || substr(d.text, 1, 40) AS evidence, d.text AS document
  FROM names r JOIN documents d USING (doc_id) LEFT JOIN catalog k ON k.name = r.name)"""

SCORES_SQL = GRID_SQL + f""",
ref AS ({fixtures.values(fixtures.REFERENCE, fixtures.REFERENCE_COLUMNS)}),
ix AS (SELECT lower(label) AS key, min(canonical) AS canonical FROM labels_ix GROUP BY 1),
scored AS (
  SELECT r.*, i.canonical, k.input_type AS c_type, k.scope AS c_scope, f.default_value AS d_value, f.default_is_empty_cell AS d_empty,
    contains(trim(regexp_replace(document, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), trim(regexp_replace(evidence, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS grounded
  FROM records r LEFT JOIN ix i ON i.key = lower(trim(r.name)) LEFT JOIN catalog k ON k.name = i.canonical LEFT JOIN ref f ON f.name = i.canonical),
judged AS (
  SELECT *, canonical IS NULL AND l.doc_id IS NULL AS hallucinated, canonical IS NULL AND l.doc_id IS NOT NULL AS documented_not_in_binary,
    input_type = c_type AS input_type_correct, scope = c_scope AS scope_correct,
    CASE WHEN c_type IS NOT NULL AND d_empty IS NOT NULL THEN
      CASE WHEN canonical IN ('and') THEN default_kind = 'machine_dependent' WHEN d_empty THEN default_kind = 'absent'
        WHEN d_value IS NULL THEN default_kind IN ('literal', 'absent') ELSE default_kind = 'literal' END END AS default_kind_correct,
    CASE WHEN c_type IS NOT NULL AND d_empty IS NOT NULL AND d_value IS NOT NULL AND canonical NOT IN ('and') THEN
      coalesce(lower(trim(default_value, '`"'' ')) = lower(trim(d_value, '`"'' ')), FALSE) END AS default_value_correct
  FROM scored s LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l USING (doc_id))"""

DOCS_SQL = SCORES_SQL + """,
per_doc AS (SELECT doc_id, list(name ORDER BY name) AS names FROM mentions WHERE NOT distractor GROUP BY doc_id),
truth AS (
  SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 0 THEN 'reference-row' WHEN l.doc_id IS NOT NULL THEN 'hand-label' ELSE 'mentioned-proxy' END AS truth_source,
    CASE WHEN d.doc_id % 10 = 0 THEN ['the'] WHEN l.quality = 0 THEN CAST([] AS VARCHAR[]) ELSE coalesce(m.names, CAST([] AS VARCHAR[])) END AS expected
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN per_doc m USING (doc_id)),
back AS (SELECT doc_id, a, p, list(DISTINCT canonical) FILTER (canonical IS NOT NULL) AS returned, count(*) AS n_records FROM scored GROUP BY ALL),
doc_scores AS (
  SELECT o.doc_id, o.a, o.p, o.outcome, t.truth_source, t.expected, coalesce(b.returned, CAST([] AS VARCHAR[])) AS returned,
    CASE WHEN outcome IN ('provider_error', 'provider_unavailable') THEN 'no_answer' WHEN outcome = 'unparseable' THEN 'failed'
      WHEN coalesce(n_records, 0) = 0 THEN 'answered_empty' ELSE 'answered' END AS status
  FROM outs o JOIN truth t USING (doc_id) LEFT JOIN back b USING (doc_id, a, p))"""


def labels(spark: SparkSession) -> DataFrame:
    return C.labels(fixtures.catalog(spark))


def mentions(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return corpus.mentions(docs, labels(spark), distractors=fixtures.DISTRACTORS)


def cells(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``(doc_id, a, p, o, outcome)`` for every document, arm and prompt."""
    out = grid.grid(docs.select("doc_id"), spark.range(ARMS).select(F.col("id").alias("a")), spark.range(PROMPTS).select(F.col("id").alias("p")))
    out = out.withColumn("o", (7 * F.col("doc_id") + 3 * F.col("a") + F.col("p")) % 20)
    name = (
        F.when(F.col("o") == 0, "provider_error").when(F.col("o") == 1, "provider_unavailable").when(F.col("o") == 2, "unparseable")
        .when(F.col("o") < 6, "valid_after_repair").otherwise("valid_first_pass")
    )
    return out.withColumn("outcome", name)


def records(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per returned record, with ``grounded`` computed beside its document (no text is shuffled with records)."""
    answered = cells(spark, docs).filter("o > 2").select("doc_id", "a", "p")
    size = F.length("name")
    kept = answered.join(mentions(spark, docs).select("doc_id", "name"), "doc_id").filter((F.col("doc_id") + 7 * F.col("a") + 3 * F.col("p") + size) % 5 != 0)
    invented = answered.filter("(doc_id + a) % 11 = 0").withColumn("name", F.lit(INVENTED))
    names = kept.unionByName(invented)
    known = fixtures.catalog(spark).select("name", F.col("input_type").alias("k_type"), F.col("scope").alias("k_scope"))
    out = names.join(F.broadcast(known), "name", "left")
    turn = (F.col("doc_id") + F.col("a") + 2 * size) % 4
    out = out.select(
        "doc_id", "a", "p", "name",
        F.when(((F.col("doc_id") + F.col("a") + size) % 4 == 0) | F.col("k_type").isNull(), "VARCHAR").otherwise(F.col("k_type")).alias("input_type"),
        F.when(((F.col("doc_id") + F.col("p")) % 6 == 0) | F.col("k_scope").isNull(), "LOCAL").otherwise(F.col("k_scope")).alias("scope"),
        F.when(turn == 1, "absent").when(turn == 2, "machine_dependent").otherwise("literal").alias("default_kind"),
        F.when(turn.isin(0, 3), F.when(F.col("doc_id") % 2 == 0, "`Full`").otherwise("8")).alias("default_value"),
    )
    # Evidence depends on the document and the prompt alone: its grounding is a projection of the document's own row.
    quote = lambda p: F.concat(F.when((F.col("doc_id") + p) % 13 == 0, "#!").otherwise(""), F.substring("text", 1, 40))
    facts = docs.select("doc_id", *(T.grounded(quote(p), F.col("text")).alias(f"g{p}") for p in range(PROMPTS)))
    facts = facts.select("doc_id", F.posexplode(F.array("g0", "g1")).alias("p", "grounded"))
    return out.join(facts.withColumn("p", F.col("p").cast("long")), ["doc_id", "p"])


def scores(spark: SparkSession, docs: DataFrame, hand: DataFrame) -> DataFrame:
    """Scored records; names in documents marked toxic count as documented but not in the catalog."""
    absent = hand.filter("toxic = 1").select("doc_id", F.lit(INVENTED).alias("key"))
    return scoring.record_scores(records(spark, docs), fixtures.catalog(spark), labels(spark), fixtures.reference(spark), absent, fixtures.MACHINE)


def truth(spark: SparkSession, docs: DataFrame, hand: DataFrame) -> DataFrame:
    found = mentions(spark, docs).filter("NOT distractor").groupBy("doc_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    target = docs.filter("doc_id % 10 = 0").select("doc_id", F.lit("the").alias("target"))
    none = F.array().cast("array<string>")
    judged = hand.select("doc_id", "quality").join(found, "doc_id", "left")
    judged = judged.select("doc_id", F.when(F.col("quality") == 0, none).otherwise(F.coalesce("names", none)).alias("documents"))
    return scoring.expected_names(docs, target, judged, found)


def documents(spark: SparkSession, docs: DataFrame, hand: DataFrame) -> DataFrame:
    """``(doc_id, a, p, outcome, status, truth_source, expected, returned, empty_was_correct)``."""
    back = C.resolve(records(spark, docs), fixtures.catalog(spark), labels(spark)).groupBy("doc_id", "a", "p").agg(F.collect_set("canonical").alias("returned"), F.count(F.lit(1)).alias("n_records"))
    out = cells(spark, docs).join(truth(spark, docs, hand), "doc_id").join(back, ["doc_id", "a", "p"], "left")
    n = F.coalesce("n_records", F.lit(0))
    state = scoring.status(F.col("outcome"), n)
    return out.select(
        "doc_id", "a", "p", "outcome", state.alias("status"), "truth_source", "expected",
        F.coalesce("returned", F.array().cast("array<string>")).alias("returned"),
        F.when(state == "answered_empty", F.size("expected") == 0).alias("empty_was_correct"),
    )
