"""The engine's named queries, and for each the SQL that another engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docscope import fixtures as X
from docscope.functions import numbers as N
from docscope.functions import text as T
from docscope.operators import catalog as C
from docscope.operators import corpus as K
from docscope.operators import grid as G
from docscope.operators import labels as L
from docscope.operators import reports as R
from docscope.operators import scoring as S
from docscope.plans import synthetic as Y
from docscope.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SEED = 20260919
QUOTAS = {"en": 50, "fr": 20, "de": 20, "es": 10}
FOLD = "trim(regexp_replace({}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS length, n_chars, length(text) = n_chars AS same FROM documents")
def q01_text_length(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text").cast("long")
    return table(spark, sf, "documents").select("doc_id", n.alias("length"), "n_chars", (n == F.col("n_chars")).alias("same"))


@query("""SELECT sha256(text) AS sha, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT lang) AS BIGINT) AS strata, count(DISTINCT lang) > 1 AS crosses,
  array_to_string(list_sort(list(doc_id)), ',') AS ids FROM documents GROUP BY sha256(text) HAVING count(*) > 1""")
def q02_duplicate_texts(spark: SparkSession, sf: str) -> DataFrame:
    # Hashes are counted first (combined before the shuffle); only rows of repeated ones are gathered.
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha"))
    repeated = docs.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("strata")).filter("n > 1")
    out = docs.select("doc_id", "sha").join(K.small(repeated.withColumnRenamed("sha", "again")), F.col("sha").eqNullSafe(F.col("again"))).groupBy("sha", "n", "strata").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return out.select("sha", "n", "strata", (F.col("strata") > 1).alias("crosses"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '<(?:div|dl|dt|dd|span|table|tr|td)[ >/]')) AS BIGINT) AS tags,
  round(len(regexp_extract_all(html, '<(?:div|dl|dt|dd|span|table|tr|td)[ >/]')) * 1000.0 / greatest(length(html), 1), 4) AS density,
  len(regexp_extract_all(html, '<(?:div|dl|dt|dd|span|table|tr|td)[ >/]')) * 1000.0 / greatest(length(html), 1) <= 5.0 AS kept FROM pages""")
def q03_html_density(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.regexp_count(html, F.lit(T.BLOCK_TAG)).cast("long").alias("tags"), F.round(T.html_density(html), 4).alias("density"), T.is_prose(html).alias("kept"))


@query(f"WITH {Y.LABELS_SQL} SELECT d.doc_id, lang, n_chars FROM documents d WHERE n_chars BETWEEN 120 AND 8000 AND doc_id IN (SELECT doc_id FROM mentions)")
def q04_eligible(spark: SparkSession, sf: str) -> DataFrame:
    # The window on n_chars reaches the scan of both branches.
    docs = table(spark, sf, "documents").filter("n_chars BETWEEN 120 AND 8000")
    return docs.join(Y.mentions(spark, docs).select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "lang", "n_chars")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (trim(line) <> '') AS BIGINT) AS n_filled, CAST(max(length(line)) AS BIGINT) AS longest FROM l GROUP BY doc_id""")
def q05_lines(spark: SparkSession, sf: str) -> DataFrame:
    # All of it is in the document's own row: no explode, no shuffle.
    split = F.split("text", "\n")
    size = lambda c: F.size(c).cast("long")
    return table(spark, sf, "documents").select(
        "doc_id",
        size(split).alias("n_lines"),
        size(F.filter(split, lambda x: F.trim(x) != "")).alias("n_filled"),
        F.array_max(F.transform(split, lambda x: F.length(x))).cast("long").alias("longest"),
    )


@query(X.values(
    [
        ("docs/a.md", "Memory", "Memory", 1, "narrative"),
        ("docs/a.md", "Limits", "Memory > Limits", 3, "narrative"),
        ("docs/a.md", "Heap", "Memory > Limits > Heap", 5, "narrative"),
        ("docs/a.md", "Deep", "Memory > Limits > Heap > Deep", 7, "narrative"),
        ("docs/a.md", "Disk", "Memory > Limits > Disk", 9, "narrative"),
        ("core_extensions/b.md", "Files", "Files", 1, "extension"),
        ("core_extensions/b.md", "Skipped", "Files > Skipped", 3, "extension"),
        ("core_extensions/b.md", "Back", "Files > Back", 5, "extension"),
        ("core_extensions/b.md", "Empty", "Files > Empty", 7, "extension"),
        ("core_extensions/b.md", "comment", "Files > comment", 10, "extension"),
        ("plain.md", "", "", 1, "narrative"),
        ("plain.md", "One", " > One", 2, "narrative"),
    ],
    "path, heading, heading_path, start_line, stratum",
))
def q05_sections(spark: SparkSession, sf: str) -> DataFrame:
    return K.sections(X.frame(spark, X.MD_PAGES, "path, text")).select("path", "heading", "heading_path", "start_line", "stratum")


@query(f"""WITH {Y.LABELS_SQL}, m AS (SELECT doc_id, count(*) AS k, bool_or(distractor) AS dis FROM mentions GROUP BY doc_id)
  SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(list_sort(list(n_chars))[count(*) // 2 + 1] AS BIGINT) AS upper_median,
  round(avg(coalesce(k, 0)), 4) AS mean_mentions, CAST(count(*) FILTER (coalesce(dis, FALSE)) AS BIGINT) AS with_distractor, CAST(count(DISTINCT sha256(text)) AS BIGINT) AS n_texts
  FROM documents LEFT JOIN m USING (doc_id) GROUP BY lang""")
def q06_corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    m = Y.mentions(spark, docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.bool_or("distractor").alias("dis"))
    # The exact upper median by ranks: a shuffle of (lang, n_chars) counts, no group gathered into an array.
    sizes = docs.groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("lang").orderBy("n_chars"))
    n = F.sum("c").over(Window.partitionBy("lang"))
    median = sizes.select("lang", "n_chars", upto.alias("upto"), n.alias("all_n")).filter(F.col("upto") > F.floor(F.col("all_n") / 2)).groupBy("lang").agg(F.min("n_chars").alias("upper_median"))
    rest = docs.select("doc_id", "lang", F.sha2("text", 256).alias("sha")).join(m, "doc_id", "left").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.coalesce("k", F.lit(0))), 4).alias("mean_mentions"),
        F.count_if(F.coalesce("dis", F.lit(False))).alias("with_distractor"),
        F.count_distinct("sha").alias("n_texts"),
    )
    return rest.join(median, "lang")


@query(f"""WITH {Y.LABELS_SQL} SELECT d.doc_id, name, n, distractor, bool_or(NOT distractor) OVER (PARTITION BY d.doc_id) AS has_signal,
  lang || CASE WHEN bool_or(NOT distractor) OVER (PARTITION BY d.doc_id) THEN '-signal' ELSE '-distractor' END AS bucket FROM mentions JOIN documents d USING (doc_id)""")
def q07_mentions(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = Y.mentions(spark, docs)
    signal = F.bool_or(~F.col("distractor")).over(Window.partitionBy("doc_id"))
    out = found.withColumn("has_signal", signal).join(docs.select("doc_id", "lang"), "doc_id")
    return out.select("doc_id", "name", "n", "distractor", "has_signal", T.bucket_of(F.col("lang"), F.col("has_signal")).alias("bucket"))


@query(f"WITH {Y.LABELS_SQL} SELECT name, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_docs FROM mentions GROUP BY name")
def q08_mention_totals(spark: SparkSession, sf: str) -> DataFrame:
    return Y.mentions(spark, table(spark, sf, "documents")).groupBy("name").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query(f"""WITH {Y.LABELS_SQL}, every AS (SELECT label, canonical FROM claims UNION ALL SELECT name, name FROM catalog)
  SELECT l.label, l.canonical AS alias_wins, min(e.canonical) AS first_wins FROM labels_ix l JOIN every e USING (label) GROUP BY l.label, l.canonical""")
def q09_label_index(spark: SparkSession, sf: str) -> DataFrame:
    catalog = X.catalog(spark)
    return C.labels(catalog).withColumnRenamed("canonical", "alias_wins").join(C.labels_first_wins(catalog).withColumnRenamed("canonical", "first_wins"), "label")


@query("""WITH page AS (""" + X.values(X.REF_PAGE, "ln, line") + """),
  b AS (SELECT min(ln) AS at FROM page WHERE line = '### Settings'), s AS (SELECT min(ln) AS at FROM page, b WHERE starts_with(line, '|') AND ln > b.at),
  e AS (SELECT min(ln) AS at FROM page, s WHERE NOT starts_with(line, '|') AND ln > s.at),
  r AS (SELECT page.* FROM page, s, e WHERE ln >= s.at AND ln < e.at AND ln > s.at AND NOT regexp_full_match(line, '[|](\\s*:?-+:?\\s*[|])+')),
  c AS (SELECT *, CASE WHEN line LIKE '|%|' THEN list_transform(string_split(substr(line, 2, length(line) - 2), '|'), lambda x: trim(x)) END AS cell FROM r),
  n AS (SELECT *, list_transform(string_split(cell[1], ','), lambda x: trim(trim(x), '`')) AS names FROM c),
  p AS (SELECT *, CASE WHEN cell IS NULL THEN 'not a table row' WHEN len(cell) <> 4 THEN 'not four cells'
    WHEN len(list_filter(names, lambda x: NOT regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_]*'))) > 0 THEN 'not an identifier' END AS problem FROM n)
  SELECT ln, problem, CASE WHEN problem IS NULL THEN names[1] END AS name, CASE WHEN problem IS NULL THEN array_to_string(names[2:], ',') END AS aliases,
    CASE WHEN problem IS NULL THEN regexp_replace(cell[2], '\\{%\\s*link\\s+(.+?)\\s*%\\}', '\\1') END AS description,
    CASE WHEN problem IS NULL THEN trim(cell[3], '`') END AS type,
    CASE WHEN problem IS NULL AND trim(cell[4], '`') NOT IN ('', 'NULL') THEN trim(cell[4], '`') END AS default_value,
    CASE WHEN problem IS NULL THEN cell[4] = '' END AS default_is_empty_cell FROM p""")
def q10_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.table_rows(X.frame(spark, X.REF_PAGE, "ln, line"), "### Settings").drop("separator")
    return C.parse_rows(rows).withColumn("aliases", F.array_join("aliases", ","))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (line LIKE '|%|' AND len(string_split(line, '|')) = 6) AS BIGINT) AS n_rows
  FROM l WHERE contains(line, '|') GROUP BY doc_id""")
def q10_pipe_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = K.lines(table(spark, sf, "documents").filter(F.contains("text", F.lit("|"))), "doc_id").filter(F.contains("line", F.lit("|")))
    whole = F.col("line").startswith("|") & F.col("line").endswith("|") & (F.length("line") > 1)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(whole & (F.size(F.split("line", "[|]")) == 6)).alias("n_rows"))


@query(X.values([(1, "home", "home"), (2, "threads", "Name")], "doc_id, target, strict_target"))
def q11_reference_target(spark: SparkSession, sf: str) -> DataFrame:
    docs = X.frame(spark, X.TARGET_DOCS, "doc_id, text")
    return C.reference_target(docs).join(C.reference_target(docs, strict=True).withColumnRenamed("target", "strict_target"), "doc_id")


@query(f"WITH {Y.GRID_SQL} SELECT doc_id, a, p, name, contains({FOLD.format('document')}, {FOLD.format('evidence')}) AS grounded FROM records")
def q12_grounding(spark: SparkSession, sf: str) -> DataFrame:
    return Y.records(spark, table(spark, sf, "documents")).select("doc_id", "a", "p", "name", "grounded")


@query(f"WITH {Y.SCORES_SQL} SELECT doc_id, a, p, name, canonical, hallucinated, input_type_correct, scope_correct, grounded FROM judged")
def q13_record_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = Y.scores(spark, table(spark, sf, "documents"), table(spark, sf, "labels"))
    return out.select("doc_id", "a", "p", "name", "canonical", "hallucinated", "input_type_correct", "scope_correct", "grounded")


@query(f"""WITH {Y.LABELS_SQL}, ref AS ({X.values(X.REFERENCE, X.REFERENCE_COLUMNS)}), canon AS (SELECT * FROM catalog WHERE name NOT IN (SELECT label FROM claims))
  SELECT 'documented but unknown' AS rule, name AS key, '' AS detail FROM ref WHERE name NOT IN (SELECT label FROM labels_ix)
  UNION ALL SELECT CASE WHEN extension = 'core' THEN 'core name omitted' ELSE 'extension name omitted' END, name, CASE WHEN extension = 'core' THEN '' ELSE extension END FROM canon WHERE name NOT IN (SELECT name FROM ref)
  UNION ALL SELECT 'scope differs', r.name, r.scope || ' != ' || c.scope FROM ref r JOIN catalog c USING (name) WHERE r.scope <> c.scope
  UNION ALL SELECT 'type differs', r.name, r.type || ' != ' || c.input_type FROM ref r JOIN catalog c USING (name) WHERE r.type <> c.input_type""")
def q14_audit(spark: SparkSession, sf: str) -> DataFrame:
    catalog = X.catalog(spark)
    return C.audit(catalog, X.reference(spark), C.labels(catalog))


@query(X.values([("alias claimed twice", "el", "bad,los"), ("alias row differs", "el", "bad"), ("alias row differs", "tion", "bad")], "rule, key, detail"))
def q15_alias_problems(spark: SparkSession, sf: str) -> DataFrame:
    return C.alias_problems(X.catalog(spark, X.FAULTY_CATALOG))


@query(f"SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains({FOLD.format('d.text')}, {FOLD.format('b.text')})")
def q16_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Which documents hold which passages, white space aside.

    A passage's longest inner token must be a whole token of the document: an equi-join on it finds the few pairs
    that are then verified. Passages without an inner token meet every document, if few enough to broadcast.
    """
    items = table(spark, sf, "benchmark").select("item_id", T.norm_space(F.col("text")).alias("passage"))
    inner = F.filter(T.tokens(F.regexp_replace("passage", r"^[A-Za-z0-9_]+|[A-Za-z0-9_]+$", "")), lambda x: F.length(x) > 0)
    longest = F.array_sort(F.transform(inner, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    items = items.withColumn("probe", F.try_element_at(longest, F.lit(1))["x"])
    docs = table(spark, sf, "documents").select("doc_id", "text")
    probes = docs.select("doc_id", "text", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("probe"))
    # The probe side carries text only past the join: the small side is broadcast when its size allows.
    near = probes.join(K.small(items.filter("probe IS NOT NULL")), "probe").filter(F.contains(T.norm_space(F.col("text")), F.col("passage")))
    bare = docs.join(K.small(items.filter("probe IS NULL"), 1000), F.contains(T.norm_space(docs.text), F.col("passage")))
    return near.select("doc_id", "item_id").union(bare.select("doc_id", "item_id"))


@query(f"SELECT a, p, CAST(count(*) AS BIGINT) AS n FROM documents, range(0, {Y.ARMS}) x(a), range(0, {Y.PROMPTS}) y(p) GROUP BY a, p")
def q17_grid_size(spark: SparkSession, sf: str) -> DataFrame:
    return Y.cells(spark, table(spark, sf, "documents")).groupBy("a", "p").agg(F.count(F.lit(1)).alias("n"))


_DRAW = f"sha256('{SEED}:' || doc_id)"


@query(f"""WITH o AS (SELECT *, {_DRAW} AS draw FROM documents), t AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY lang, source ORDER BY draw, doc_id) > 1 THEN 1 ELSE 0 END AS extra FROM o),
  r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY extra, draw, doc_id) AS rank FROM t)
  SELECT doc_id, lang, source, lang || '-' || lpad(CAST(rank AS VARCHAR), 4, '0') AS sample_id FROM r WHERE rank <= CASE lang {' '.join(f"WHEN '{k}' THEN {v}" for k, v in QUOTAS.items())} ELSE 0 END""")
def q18_stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    out = K.sample(docs, "lang", "source", "doc_id", QUOTAS, SEED)
    return out.select("doc_id", "lang", "source", F.format_string("%s-%04d", "lang", "rank").alias("sample_id"))


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)
  SELECT doc_id, lang, CAST(rn AS BIGINT) AS rn FROM r ORDER BY rn, lang LIMIT 30""")
def q18_pilot(spark: SparkSession, sf: str) -> DataFrame:
    return K.pilot(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 30).select("doc_id", "lang", F.col("rn").cast("long").alias("rn"))


@query(f"""WITH q AS ({X.values(list(QUOTAS.items()), 'bucket, quota')})
  SELECT bucket, CAST(quota AS BIGINT) AS quota, CAST(count(*) AS BIGINT) AS sections, CAST(count(DISTINCT source) AS BIGINT) AS pages, quota >= count(DISTINCT source) AS census
  FROM documents JOIN q ON lang = bucket GROUP BY bucket, quota""")
def q18_census(spark: SparkSession, sf: str) -> DataFrame:
    return K.census(table(spark, sf, "documents"), "lang", "source", QUOTAS).withColumn("quota", F.col("quota").cast("long"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_in, CAST(0 AS BIGINT) AS tokens_out, event_type = 'error' AS is_error FROM events""")
def q19_body_projection(spark: SparkSession, sf: str) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0).cast("bigint"))
    out = F.coalesce(F.get_json_object("props", "$.out").try_cast("bigint"), F.lit(0).cast("bigint"))
    return table(spark, sf, "events").select("event_id", k.alias("tokens_in"), out.alias("tokens_out"), (F.col("event_type") == "error").alias("is_error"))


_REQUESTS = """h AS (SELECT *, coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM conversations),
  q AS (SELECT conv_id, turn, 'A' || conv_id % 5 AS arm, sha256(role || ':' || history) AS request_key, text FROM h WHERE role = 'assistant'),
  resp AS (SELECT DISTINCT arm, request_key FROM q WHERE conv_id % 3 <> 0), fails AS (SELECT DISTINCT arm, request_key FROM q WHERE conv_id % 6 = 0)"""


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    turns = G.preceding_text(table(spark, sf, "conversations")).filter("role = 'assistant'")
    key = F.sha2(F.concat_ws(":", "role", "history"), 256)
    return turns.select("conv_id", "turn", F.concat(F.lit("A"), (F.col("conv_id") % 5).cast("string")).alias("arm"), key.alias("request_key"), "text")


def _responses(requests: DataFrame) -> DataFrame:
    row = lambda df, failure: df.select("arm", "request_key", F.col("text").alias("body"), F.lit(failure).alias("is_failure"))
    return row(requests.filter("conv_id % 3 <> 0"), False).unionByName(row(requests.filter("conv_id % 6 = 0"), True))


@query(f"""WITH {_REQUESTS} SELECT conv_id, turn, q.arm, q.request_key, CASE WHEN r.arm IS NOT NULL THEN 'hit' WHEN f.arm IS NOT NULL THEN 'failure' ELSE 'miss' END AS replay
  FROM q LEFT JOIN resp r ON r.arm = q.arm AND r.request_key = q.request_key LEFT JOIN fails f ON f.arm = q.arm AND f.request_key = q.request_key""")
def q20_replay(spark: SparkSession, sf: str) -> DataFrame:
    requests = _requests(spark, sf)
    return G.replay(requests.drop("text"), _responses(requests)).select("conv_id", "turn", "arm", "request_key", "replay")


@query(f"""WITH {_REQUESTS} SELECT DISTINCT arm, request_key FROM q WHERE conv_id % 3 = 0 AND (arm, request_key) NOT IN (SELECT (arm, request_key) FROM resp) AND (arm, request_key) NOT IN (SELECT (arm, request_key) FROM fails)""")
def q21_backfill(spark: SparkSession, sf: str) -> DataFrame:
    requests = _requests(spark, sf)
    results = requests.withColumn("error", F.when(F.col("conv_id") % 3 == 0, "lost")).withColumn("latency_s", F.lit(0.0))
    return G.backfill(results, _responses(requests)).select("arm", "request_key")


@query(f"WITH {Y.GRID_SQL} SELECT a, p, outcome, CAST(count(*) AS BIGINT) AS n FROM outs GROUP BY a, p, outcome")
def q22_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return Y.cells(spark, table(spark, sf, "documents")).groupBy("a", "p", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT doc_id, doc_id % 8 AS k FROM documents)
  SELECT doc_id, CASE k WHEN 0 THEN 'valid_first_pass' WHEN 1 THEN 'provider_error' WHEN 2 THEN 'provider_unavailable' WHEN 3 THEN 'valid_after_repair' WHEN 4 THEN 'length_truncated'
    WHEN 5 THEN 'unparseable' WHEN 6 THEN 'invalid_after_repair' ELSE 'provider_error' END AS outcome, k >= 3 AS repair_used,
    CAST(CASE WHEN k >= 3 THEN 30 ELSE 10 END AS BIGINT) AS tokens_in FROM t""")
def q22_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """The whole path: two attempts for each document as JSON, validated against its text and settled."""
    docs = table(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % 8).alias("k"))
    quote = F.concat(T.norm_space(F.substring("text", 1, 30)), F.lit(""))
    record = lambda name, evidence: F.to_json(
        F.struct(F.array(F.struct(name.alias("name"), F.lit("BIGINT").alias("input_type"), F.lit("GLOBAL").alias("scope"), evidence.alias("evidence"), F.lit("absent").alias("default_kind"), F.lit(None).cast("string").alias("default_value"), F.lit(None).cast("string").alias("default_evidence"))).alias("settings")),
        {"ignoreNullFields": "false"},
    )
    # Texts too short to quote are quoted whole by an empty answer.
    good = F.when(F.length(quote) >= G.LEAST_EVIDENCE, record(F.lit("limit"), quote)).otherwise(F.lit('{"settings": []}'))
    bad = record(F.lit("`limit`"), quote)
    null = F.lit(None).cast("string")
    k = F.col("k")
    call = lambda n, error, code, content, reason, cost: F.struct(F.lit(n).alias("attempt"), error.alias("error"), code.alias("unavailable"), content.alias("content"), F.lit(reason).alias("finish_reason") if isinstance(reason, str) else reason.alias("finish_reason"), F.lit(cost).cast("long").alias("tokens_in"))
    one = call(1, F.when(k.isin(1, 2), F.lit("down")), k == 2, F.when(k == 0, good).when(k >= 3, bad), "stop", 10)
    two = call(2, F.when(k == 7, F.lit("down")), F.lit(False), F.when(k == 3, good).when(k.isin(4, 5), F.lit('{"settings": [')).when(k == 6, bad).otherwise(null), F.when(k == 4, F.lit("length")).otherwise(F.lit("stop")), 20)
    rows = docs.select("doc_id", F.col("text").alias("document"), F.explode(F.when(k >= 3, F.array(one, two)).otherwise(F.array(one))).alias("c")).select("doc_id", "document", "c.*")
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("tokens_out", zero).withColumn("cost", F.lit(0.0)).withColumn("latency_s", F.lit(0.0))
    return G.settle(rows, ["doc_id"]).select("doc_id", "outcome", "repair_used", "tokens_in")


@query(f"WITH {Y.DOCS_SQL} SELECT doc_id, a, p, outcome, status, truth_source, CAST(len(expected) AS BIGINT) AS n_expected, CASE WHEN status = 'answered_empty' THEN len(expected) = 0 END AS empty_was_correct FROM doc_scores")
def q23_document_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = Y.documents(spark, table(spark, sf, "documents"), table(spark, sf, "labels"))
    return out.select("doc_id", "a", "p", "outcome", "status", "truth_source", F.size("expected").cast("long").alias("n_expected"), "empty_was_correct")


@query(f"WITH {Y.SCORES_SQL} SELECT doc_id, a, p, name, default_kind_correct, default_value_correct FROM judged")
def q24_default_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = Y.scores(spark, table(spark, sf, "documents"), table(spark, sf, "labels"))
    return out.select("doc_id", "a", "p", "name", "default_kind_correct", "default_value_correct")


@query(f"WITH {Y.DOCS_SQL} SELECT truth_source, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (len(expected) = 0) AS BIGINT) AS n_none FROM truth GROUP BY truth_source")
def q25_truth_source(spark: SparkSession, sf: str) -> DataFrame:
    out = Y.truth(spark, table(spark, sf, "documents"), table(spark, sf, "labels"))
    return out.groupBy("truth_source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("expected") == 0).alias("n_none"))


@query(f"WITH {Y.SCORES_SQL} SELECT doc_id, a, p, name FROM judged WHERE documented_not_in_binary")
def q26_documented_not_in_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return Y.scores(spark, table(spark, sf, "documents"), table(spark, sf, "labels")).filter("documented_not_in_binary").select("doc_id", "a", "p", "name")


_RATE = "round(coalesce({} / nullif(CAST({} AS DOUBLE), 0), 0), 4)"


@query(f"""WITH {Y.DOCS_SQL}, d AS (SELECT a, p, count(*) AS n_documents, count(*) FILTER (status = 'no_answer') AS n_no_answer, count(*) FILTER (status = 'failed') AS n_failed,
    count(*) FILTER (status = 'answered_empty') AS n_empty, count(*) FILTER (status = 'answered_empty' AND len(expected) = 0) AS n_empty_correct, sum(len(expected)) AS n_expected,
    sum(len(list_intersect(expected, returned))) AS n_found FROM doc_scores GROUP BY a, p),
  r AS (SELECT a, p, count(*) AS n_records, count(*) FILTER (hallucinated) AS n_hallucinated, count(*) FILTER (documented_not_in_binary) AS n_doc_only, count(*) FILTER (grounded) AS n_grounded,
    count(*) FILTER (input_type_correct) AS n_type_correct, count(*) FILTER (scope_correct) AS n_scope_correct, count(default_kind_correct) AS n_default_kind,
    count(*) FILTER (default_kind_correct) AS n_default_kind_correct, count(default_value_correct) AS n_default_value, count(*) FILTER (default_value_correct) AS n_default_value_correct FROM judged GROUP BY a, p)
  SELECT a, p, n_documents, n_no_answer, n_failed, n_empty, n_empty_correct, CAST(n_expected AS BIGINT) AS n_expected, CAST(n_found AS BIGINT) AS n_found, n_records, n_hallucinated, n_doc_only,
    n_records - n_hallucinated - n_doc_only AS n_real, n_grounded, n_type_correct, n_scope_correct, n_default_kind, n_default_kind_correct, n_default_value, n_default_value_correct,
    round(1 - n_no_answer / CAST(n_documents AS DOUBLE), 4) AS availability, {_RATE.format('n_hallucinated', 'n_records')} AS hallucination_rate, {_RATE.format('n_grounded', 'n_records')} AS grounding_rate,
    {_RATE.format('n_type_correct', '(n_records - n_hallucinated - n_doc_only)')} AS type_accuracy, {_RATE.format('n_scope_correct', '(n_records - n_hallucinated - n_doc_only)')} AS scope_accuracy,
    {_RATE.format('n_found', 'n_expected')} AS recall FROM d JOIN r USING (a, p)""")
def q27_summary(spark: SparkSession, sf: str) -> DataFrame:
    docs, hand = table(spark, sf, "documents"), table(spark, sf, "labels")
    return S.summary(Y.documents(spark, docs, hand), Y.scores(spark, docs, hand), ["a", "p"]).drop("recall_answered", "n_expected_answered")


@query(f"""WITH {Y.DOCS_SQL} SELECT a, p, truth_source, CAST(sum(len(expected)) AS BIGINT) AS n_expected, CAST(sum(len(list_intersect(expected, returned))) AS BIGINT) AS n_found,
  CAST(coalesce(sum(len(expected)) FILTER (status IN ('answered', 'answered_empty')), 0) AS BIGINT) AS n_expected_answered FROM doc_scores GROUP BY a, p, truth_source""")
def q28_recall(spark: SparkSession, sf: str) -> DataFrame:
    docs = Y.documents(spark, table(spark, sf, "documents"), table(spark, sf, "labels"))
    size = lambda c: F.size(c).cast("long")
    return docs.groupBy("a", "p", "truth_source").agg(
        F.sum(size("expected")).alias("n_expected"),
        F.sum(size(F.array_intersect("expected", "returned"))).alias("n_found"),
        F.sum(F.when(F.col("status").isin("answered", "answered_empty"), size("expected")).otherwise(0)).alias("n_expected_answered"),
    )


@query(f"WITH {Y.SCORES_SQL} SELECT name, CAST(count(*) AS BIGINT) AS n FROM judged WHERE hallucinated GROUP BY name ORDER BY n DESC, name LIMIT 10")
def q29_top_hallucinated(spark: SparkSession, sf: str) -> DataFrame:
    out = Y.scores(spark, table(spark, sf, "documents"), table(spark, sf, "labels")).filter("hallucinated")
    return out.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(10)


def _hand(spark: SparkSession, sf: str) -> DataFrame:
    """Label rows out of quality and toxic: judged with one name, judged empty, or open."""
    hand = table(spark, sf, "labels")
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    return hand.select(
        "doc_id", strings("the", "los").alias("candidates"),
        F.when(F.col("quality") == 0, strings()).when(F.col("toxic") == 1, F.lit(None)).otherwise(strings("the")).alias("documents"),
        F.when(F.col("doc_id") % 50 == 0, strings("the")).otherwise(strings()).alias("cross_referenced"),
        F.when(F.col("doc_id") % 70 == 0, strings("que", "ghost")).otherwise(strings()).alias("absent"),
    )


@query("""SELECT CAST(count(*) AS BIGINT) AS n_labels, CAST(count(*) FILTER (quality = 0 OR toxic <> 1) AS BIGINT) AS n_judged, CAST(count(*) FILTER (quality <> 0 AND toxic = 1) AS BIGINT) AS n_open,
  CAST(count(*) FILTER (quality = 0) AS BIGINT) AS n_empty, CAST(count(*) FILTER (quality <> 0 AND toxic <> 1) AS BIGINT) AS n_documents, CAST(2 * count(*) AS BIGINT) AS n_candidates, CAST(0 AS BIGINT) AS n_beyond_candidates FROM labels""")
def q30_label_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return L.coverage(_hand(spark, sf))


@query("""SELECT doc_id, CASE WHEN quality = 0 THEN '' WHEN toxic = 1 THEN NULL ELSE 'the' END AS documents FROM labels""")
def q30_label_merge(spark: SparkSession, sf: str) -> DataFrame:
    prior = _hand(spark, sf)
    fresh = prior.withColumn("documents", F.lit(None).cast("array<string>"))
    return L.merge(fresh, prior).select("doc_id", F.array_join("documents", ",").alias("documents"))


@query("""SELECT 'documented and cross-referenced' AS rule, CAST(doc_id AS VARCHAR) AS key, 'the' AS detail FROM labels WHERE quality <> 0 AND toxic <> 1 AND doc_id % 50 = 0
  UNION ALL SELECT 'known name in the absent list', CAST(doc_id AS VARCHAR), 'que' FROM labels WHERE doc_id % 70 = 0""")
def q31_label_problems(spark: SparkSession, sf: str) -> DataFrame:
    known = Y.labels(spark).select(F.lower("label").alias("key")).distinct()
    return L.problems(_hand(spark, sf), known)


@query("""SELECT doc_id, '## ' || doc_id || CASE WHEN quality <> 0 AND toxic = 1 THEN ' [ ] open' ELSE ' [x] judged' END || chr(10) || '- [' || CASE WHEN quality <> 0 AND toxic <> 1 THEN 'x' ELSE ' ' END || '] the' || chr(10) || '- [ ] los' AS sheet FROM labels""")
def q31_worksheet(spark: SparkSession, sf: str) -> DataFrame:
    return L.worksheet(_hand(spark, sf))


@query(X.values([("upstream", 2), ('HTTP 500: {"error": {"message": "cut sho', 1), ("connection reset", 1)], "error, n"))
def q32_error_groups(spark: SparkSession, sf: str) -> DataFrame:
    return R.error_groups(X.frame(spark, X.ERRORS, "id, message"), "message").select("error", F.col("n").cast("int").alias("n"))


@query("SELECT CAST(user_id % 5 AS BIGINT) AS arm, props AS error, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def q32_event_errors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").filter("event_type = 'error'")
    return rows.groupBy((F.col("user_id") % 5).alias("arm"), T.error_group(F.col("props")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query(X.values([("A0", "", True), ("A1", "input price", False), ("A2", "input price,seed", False), ("A3", "missing", False), ("A4", "", True)], "arm, problems, ok"))
def q33_arm_checks(spark: SparkSession, sf: str) -> DataFrame:
    arms = X.frame(spark, X.ARMS, "arm, model_id, price_in, price_out, wants_seed")
    return R.check_arms(arms, X.frame(spark, X.LIVE, "model_id, live_in, live_out, has_seed")).withColumn("problems", F.array_join("problems", ","))


@query("""WITH c AS (SELECT user_id % 5 AS arm, value AS billed, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS predicted FROM events)
  SELECT arm, round(sum(billed), 4) AS billed, round(sum(predicted), 4) AS predicted, round(coalesce(sum(billed) / nullif(sum(predicted), 0), 0), 4) AS ratio, abs(sum(billed) - sum(predicted)) > 0.05 * sum(predicted) AS alarm FROM c GROUP BY arm""")
def q34_billed_vs_predicted(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "events").select((F.col("user_id") % 5).alias("arm"), F.col("value").alias("billed"), F.get_json_object("props", "$.k").cast("double").alias("predicted"))
    out = R.billed_vs_predicted(calls, "arm")
    return out.select("arm", *(F.round(c, 4).alias(c) for c in ("billed", "predicted", "ratio")), "alarm")


@query("""SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT (user_id, event_type)) AS BIGINT) AS n_keys,
  CAST(count(*) FILTER ((user_id, event_type) IN (SELECT (user_id, event_type) FROM events WHERE event_id % 97 = 0)) AS BIGINT) AS n_carried FROM events""")
def q35_provenance(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return R.provenance(events, events.filter("event_id % 97 = 0"), ["user_id", "event_type"])


@query("""WITH d AS (SELECT count(*) AS docs, sum(n_chars) AS chars FROM documents), e AS (SELECT sum(value) AS spent, count(*) AS calls FROM events)
  SELECT round(spent / calls * docs, 4) AS by_docs, round(spent / (calls * 1000.0) * chars, 4) AS by_chars, round((chars / 4.0 + 500.0 * docs) * 1.5 / 1e6, 6) AS estimate FROM d, e""")
def q36_extrapolation(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))
    e = table(spark, sf, "events").agg(F.sum("value").alias("spent"), F.count(F.lit(1)).alias("calls"))
    return d.crossJoin(e).select(
        F.round(F.col("spent") / F.col("calls") * F.col("docs"), 4).alias("by_docs"),
        F.round(F.col("spent") / (F.col("calls") * 1000.0) * F.col("chars"), 4).alias("by_chars"),
        F.round(N.cost(F.col("chars") / 4.0 + 500.0 * F.col("docs"), F.lit(0), F.lit(1.5), F.lit(0)), 6).alias("estimate"),
    )


@query("""SELECT user_id % 5 AS arm, CAST(count(value) AS BIGINT) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max_value FROM events GROUP BY 1""")
def q37_latency(spark: SparkSession, sf: str) -> DataFrame:
    out = R.latency(table(spark, sf, "events").withColumn("arm", F.col("user_id") % 5), "arm", "value")
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p95")})


@query("""SELECT user_id % 5 AS arm, event_type, round(sum(value), 4) AS total, CAST(count(*) AS BIGINT) AS n, CAST(grouping(user_id % 5, event_type) AS INTEGER) AS level FROM events GROUP BY ROLLUP (user_id % 5, event_type)""")
def q38_cost_rollup(spark: SparkSession, sf: str) -> DataFrame:
    out = R.cost_rollup(table(spark, sf, "events").withColumn("arm", F.col("user_id") % 5), "arm", "event_type", "value")
    return out.withColumn("total", F.round("total", 4))


@query("""SELECT 'all' AS part, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)
  UNION ALL SELECT 'both', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
  UNION ALL SELECT 'unlabelled', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)""")
def q39_set_operations(spark: SparkSession, sf: str) -> DataFrame:
    docs, hand = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    part = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return part(docs.union(hand).distinct(), "all").unionByName(part(docs.intersect(hand), "both")).unionByName(part(docs.subtract(hand), "unlabelled"))


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT sum(n) AS t FROM c), f AS (SELECT lang, n, (n * 40) // t AS fl, (n * 40) % t AS rest FROM c, t),
  r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, lang DESC) AS k, 40 - sum(fl) OVER () AS spare FROM f)
  SELECT lang, CAST(n AS BIGINT) AS n, CAST(fl + CASE WHEN k <= spare THEN 1 ELSE 0 END AS BIGINT) AS share FROM r""")
def q40_allocation(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return K.allocate(counts, "lang", "n", 40)


@query(f"""WITH o AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW}, doc_id) AS k FROM documents), d AS (SELECT doc_id FROM o WHERE k <= 10), pins AS (SELECT doc_id FROM documents WHERE doc_id IN (1, 2, 3, 5, 8))
  SELECT doc_id, FALSE AS pinned FROM d UNION ALL SELECT doc_id, TRUE FROM pins WHERE doc_id NOT IN (SELECT doc_id FROM d)""")
def q40_pins(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(K.draw_order(SEED, "doc_id"), "doc_id"))
    drawn = docs.withColumn("k", rank).filter("k <= 10").select("doc_id")
    pins = docs.filter(F.col("doc_id").isin(1, 2, 3, 5, 8)).select("doc_id").join(drawn, "doc_id", "left_anti")
    return drawn.withColumn("pinned", F.lit(False)).unionByName(pins.withColumn("pinned", F.lit(True)))


@query("""SELECT lang, source, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY CUBE (lang, source)""")
def q38_document_cube(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS path, CAST(4 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS start_line, 'reference' AS stratum,
  concat('### Nations', chr(10), chr(10), '| name | key |', chr(10), '|---|---|', chr(10), '| ', n_name, ' | ', n_nationkey, ' |') AS text FROM nation""")
def q41_row_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A page for each region with a table of its nations, and each row of those as a document."""
    nation = table(spark, sf, "nation").withColumn("path", F.col("n_regionkey").cast("string"))
    at = F.row_number().over(Window.partitionBy("path").orderBy("n_nationkey")) + 4
    rows = nation.select("path", at.alias("ln"), F.format_string("| %s | %d |", "n_name", "n_nationkey").alias("line"))
    head = F.array(*(F.lit(x) for x in ("### Nations", "", "| name | key |", "|---|---|")))
    top = nation.select("path").distinct().select("path", F.posexplode(head).alias("at", "line")).select("path", (F.col("at") + 1).alias("ln"), "line")
    return C.row_documents(C.table_rows(top.unionByName(rows), "### Nations", "path"), "### Nations", "GLOBAL").select("path", "start_line", "stratum", "text")


@query(f"""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT sum(n) AS t FROM c), f AS (SELECT lang, (n * 40) // t AS fl, (n * 40) % t AS rest FROM c, t),
  r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, lang DESC) AS k, 40 - sum(fl) OVER () AS spare FROM f), s AS (SELECT lang, fl + CASE WHEN k <= spare THEN 1 ELSE 0 END AS share FROM r),
  o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW}, doc_id) AS k FROM documents), d AS (SELECT doc_id FROM o JOIN s ON o.lang IS NOT DISTINCT FROM s.lang WHERE k <= share)
  SELECT doc_id, FALSE AS pinned FROM d UNION ALL SELECT doc_id, TRUE FROM documents WHERE doc_id IN (1, 2, 3, 5, 8) AND doc_id NOT IN (SELECT doc_id FROM d)""")
def q42_label_draw(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return K.proportional(docs, "lang", "doc_id", 40, SEED, (1, 2, 3, 5, 8)).select("doc_id", "pinned")
