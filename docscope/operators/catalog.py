"""The catalog of known names: label indexes, strict table parsing, audits. ``problems`` tables are (rule, key, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docscope.functions import text as T
from docscope.operators.sizes import small


def alias_rows(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.explode("aliases").alias("label"), F.col("name").alias("canonical"))


def labels(catalog: DataFrame) -> DataFrame:
    """``(label, canonical)``: every name and alias; an alias always wins over a catalog row of its own name."""
    aliases = alias_rows(catalog)
    own = catalog.select(F.col("name").alias("label"), F.col("name").alias("canonical"))
    return aliases.unionByName(own.join(aliases, "label", "left_anti"))


def labels_first_wins(catalog: DataFrame) -> DataFrame:
    """The same index when rows, by name, claim their labels first come first served."""
    claims = catalog.select(F.col("name").alias("label"), F.col("name").alias("canonical")).unionByName(alias_rows(catalog))
    return claims.groupBy("label").agg(F.min("canonical").alias("canonical"))


def first_attribution(listings: DataFrame) -> DataFrame:
    """``(name, extension)``: who listed a name first, from ``listings (name, extension, probe)``."""
    return listings.groupBy("name").agg(F.min_by("extension", "probe").alias("extension"))


def resolve(records: DataFrame, catalog: DataFrame, index: DataFrame) -> DataFrame:
    """Add ``canonical`` and the catalog's ``c_type`` and ``c_scope`` to ``records (name, ...)``; null if unknown."""
    keyed = index.select(F.lower("label").alias("key"), "canonical").dropDuplicates(["key"])
    known = catalog.select(F.col("name").alias("canonical"), F.col("input_type").alias("c_type"), F.col("scope").alias("c_scope"))
    out = records.withColumn("key", T.name_key(F.col("name"))).join(small(keyed), "key", "left").drop("key")
    return out.join(small(known), "canonical", "left")


# The column labels of a reference table.
HEADER = ("name", "description", "type", "default value")


def table_rows(page: DataFrame, heading: str, *by: str) -> DataFrame:
    """Lines of the first pipe table behind a heading line: ``(*by, ln, line, header, separator)``, those two left out.

    ``page`` is ``(*by, ln, line)``, ``by`` names the page. The table is the first run of lines that start with a pipe
    behind the heading, even past another heading; its first line is the header, the next one the separator.
    """
    whole = Window.partitionBy(*by)
    marked = page.withColumn("pipe", F.col("line").startswith("|"))
    from_ = F.min(F.when(F.col("line") == heading, F.col("ln"))).over(whole)
    inside = marked.withColumn("from", from_).filter(F.col("ln") > F.col("from"))
    start = F.min(F.when(F.col("pipe"), F.col("ln"))).over(whole)
    inside = inside.withColumn("start", start).filter(F.col("ln") >= F.col("start"))
    stop = F.min(F.when(~F.col("pipe"), F.col("ln"))).over(whole)
    rows = inside.withColumn("stop", stop).filter(F.col("stop").isNull() | (F.col("ln") < F.col("stop")))
    rows = rows.withColumn("header", F.min_by("line", "ln").over(whole)).withColumn("separator", F.max(F.when(F.col("ln") == F.col("start") + 1, F.col("line"))).over(whole))
    return rows.filter((F.col("ln") != F.col("start")) & ~F.col("line").rlike(r"^[|](?:\s*:?-+:?\s*[|])+$")).select(*by, "ln", "line", "header", "separator")


def row_documents(rows: DataFrame, heading: str, scope: str) -> DataFrame:
    """Each of ``rows (path, ln, line, header, separator)`` as a section of its own, its lines as they stand."""
    title = heading.lstrip("# ")
    text = F.concat_ws("\n", F.lit(heading), F.lit(""), "header", "separator", "line")
    name = F.format_string("%s, line %d", F.lit(scope), "ln")
    return rows.select("path", F.lit(title).alias("page_title"), name.alias("heading"), F.lit(title).alias("heading_path"), text.alias("text"), F.col("ln").cast("int").alias("start_line"), F.lit("reference").alias("stratum"))


def header_fits(header: Column) -> Column:
    """Whether a header line carries the expected labels."""
    labels = F.transform(F.split(F.trim(F.regexp_replace(header, "^[|]|[|]$", "")), "[|]"), lambda c: F.lower(F.trim(F.regexp_replace(F.trim(c), "`", ""))))
    return labels == F.lit(list(HEADER))


def cells(line: Column) -> Column:
    return F.transform(F.split(F.expr("substring(line, 2, length(line) - 2)"), "[|]"), lambda c: F.trim(c))


def parse_rows(rows: DataFrame) -> DataFrame:
    """Strictly parse ``rows (ln, line)`` of name, description, type and default.

    ``problem`` is null for accepted rows: other columns are then set. A default cell has three states: empty (null,
    flagged), the word NULL (null, not flagged), or a value.
    """
    whole = F.col("line").startswith("|") & F.col("line").endswith("|")
    out = rows.withColumn("cell", F.when(whole, cells(F.col("line"))))
    names = F.transform(F.split(F.col("cell")[0], ","), lambda x: F.trim(F.regexp_replace(F.trim(x), "^`+|`+$", "")))
    out = out.withColumn("names", names)
    problem = (
        F.when(~whole, "not a table row")
        .when(F.size("cell") != 4, "not four cells")
        .when(F.exists("names", lambda x: ~x.rlike(T.IDENTIFIER)), "not an identifier")
    )
    default = F.regexp_replace(F.col("cell")[3], "^`|`$", "")
    ok = problem.isNull()
    keep = lambda c: F.when(ok, c)
    return out.select(
        "ln",
        problem.alias("problem"),
        keep(F.col("names")[0]).alias("name"),
        keep(F.slice("names", 2, F.greatest(F.lit(0), F.size("names") - 1))).alias("aliases"),
        keep(T.link_target(F.col("cell")[1])).alias("description"),
        keep(F.regexp_replace(F.col("cell")[2], "^`|`$", "")).alias("type"),
        keep(F.when(default.isin("", "NULL"), F.lit(None)).otherwise(default)).alias("default_value"),
        keep(F.col("cell")[3] == "").alias("default_is_empty_cell"),
    )


def reference_target(docs: DataFrame, strict: bool = False, key: str = "doc_id") -> DataFrame:
    """``(key, target)``: the first identifier in the last table row of a one-row document.

    ``strict`` accepts only rows whose first cell is one name, and then falls back to the header.
    """
    rows = docs.select(key, F.posexplode(F.split("text", "\n")).alias("ln", "line")).filter(F.col("line").startswith("|"))
    first = F.trim(F.regexp_extract("line", r"^[|]([^|]*)[|]", 1))
    one = F.regexp_extract(first, r"^`?([A-Za-z_][A-Za-z0-9_]*)`?" + ("$" if strict else r"(?:\s*,.*)?$"), 1)
    hits = rows.select(key, "ln", one.alias("one")).filter(F.col("one") != "")
    if not strict:
        hits = hits.join(rows.groupBy(key).agg(F.min("ln").alias("header")), key).filter("ln > header")
    return hits.groupBy(key).agg(F.max_by("one", "ln").alias("target"))


def _problem(df: DataFrame, rule: str, key: str, detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(key).alias("key"), (F.lit("") if detail is None else detail).alias("detail"))


def audit(catalog: DataFrame, reference: DataFrame, index: DataFrame) -> DataFrame:
    """Set differences and conflicts between the documentation and the catalog."""
    canon = catalog.join(alias_rows(catalog).select(F.col("label").alias("name")), "name", "left_anti")
    unknown = reference.join(index.select(F.col("label").alias("name")), "name", "left_anti")
    absent = canon.join(reference, "name", "left_anti")
    both = reference.join(catalog.select("name", F.col("input_type").alias("c_type"), F.col("scope").alias("c_scope"), "extension"), "name")
    pair = lambda a, b: F.concat_ws(" != ", a, b)
    return (
        _problem(unknown, "documented but unknown", "name")
        .unionByName(_problem(absent.filter("extension = 'core'"), "core name omitted", "name"))
        .unionByName(_problem(absent.filter("extension != 'core'"), "extension name omitted", "name", F.col("extension")))
        .unionByName(_problem(both.filter("scope != c_scope"), "scope differs", "name", pair("scope", "c_scope")))
        .unionByName(_problem(both.filter("type != c_type"), "type differs", "name", pair("type", "c_type")))
    )


def alias_problems(catalog: DataFrame) -> DataFrame:
    """Aliases claimed twice, and catalog rows of an alias's own name that disagree with its canonical row."""
    claims = alias_rows(catalog)
    twice = claims.groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("canonical")), ",").alias("owners"), F.count_distinct("canonical").alias("n")).filter("n > 1")
    row = catalog.select(F.col("name").alias("canonical"), F.col("input_type").alias("type"), "scope")
    twin = catalog.select(F.col("name").alias("label"), F.col("input_type").alias("twin_type"), F.col("scope").alias("twin_scope"))
    apart = claims.join(twin, "label").join(row, "canonical").filter("type != twin_type OR scope != twin_scope")
    return _problem(twice, "alias claimed twice", "label", F.col("owners")).unionByName(_problem(apart, "alias row differs", "label", F.col("canonical")))
