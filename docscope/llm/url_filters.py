"""URL allow and block rules with redirect equivalence.

A page is judged by the longest rule that fits its own url. Pages without a fitting rule take the verdict of their
alias class: the connected component of the url graph whose edges are canonical links and refresh redirects, found in
the html. In a class an explicit allow beats any block; without either the page is allowed.

A url's node is its text up to ``#`` with the host folded, so fragments of one page are one node. Null urls, and urls
without ``://``, have an empty host and path, fit no rule and are in no class: they are allowed. Null html has no
edges. Repeated rows get equal verdicts; an empty table gives an empty result; other columns of ``pages`` are ignored.
The rules are compiled into one expression, so their count is bounded by ``MAX_RULES``.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscope.llm.common import cut, spread_join, table
from docscope.llm.components import connected_components

#: (verdict, rule): a rule is a host and a path prefix.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
MAX_RULES = 1000

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_SCHEME = r"(?s)^(.*?)://"
_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_REFRESH_URL = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """The url without its fragment, scheme and host folded; null if it has no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    scheme = F.translate(F.regexp_extract(url, _SCHEME, 1), ascii_uppercase, ascii_lowercase)
    return F.when(F.contains(url, F.lit("://")), F.concat(scheme, F.lit("://"), host_of(url), rest))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Equally long rules: the first listed."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules[::-1], key=lambda r: len(r[1])):
        at, _, prefix = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{prefix}")
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _resolve(base: Column, target: Column) -> Column:
    """An absolute form of a link found on page ``base``."""
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, _SCHEME, 1), F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(source, target)`` urls of canonical and refresh links, as nodes."""
    found = F.filter(
        F.array(
            F.regexp_extract(F.regexp_extract("html", _CANONICAL, 0), _HREF, 1),
            F.regexp_extract(F.regexp_extract("html", _REFRESH, 0), _REFRESH_URL, 1),
        ),
        lambda x: x != "",
    )
    links = pages.filter(F.col("html").rlike(_CANONICAL) | F.col("html").rlike(_REFRESH)).select("url", F.explode(found).alias("link"))
    ends = links.select(node_of(F.col("url")).alias("source"), node_of(_resolve(F.col("url"), F.col("link"))).alias("target"))
    return ends.filter("source IS NOT NULL AND target IS NOT NULL AND source != target").distinct()


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, via)`` for every row of ``pages (page_id, url, html)``.

    ``via`` says what decided: ``rule``, ``alias`` or ``default``.
    """
    edges = cut(alias_edges(pages))
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.xxhash64(node_of(F.col("url"))).alias("node"), node_of(F.col("url")).isNotNull().alias("named"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = own.withColumn("rule", rule).withColumn("own", verdict)
    members = connected_components(edges.select(F.xxhash64("source").alias("a"), F.xxhash64("target").alias("b")))
    urls = edges.select(F.explode(F.array("source", "target")).alias("url")).distinct()
    stated = urls.select(F.xxhash64("url").alias("node"), rule_for(host_of(F.col("url")), path_of(F.col("url")), rules)[1].alias("stated"))
    classes = members.join(stated, "node", "left")
    verdicts = classes.groupBy("component").agg(
        F.when(F.bool_or(F.col("stated") == "allow"), "allow").when(F.bool_or(F.col("stated") == "block"), "block").alias("shared")
    )
    by_node = members.join(verdicts, "component").filter("shared IS NOT NULL").select("node", "shared")
    # Urls without a node meet nothing and are kept out of the join; a url may be that of most pages.
    named = judged.filter("named")
    pages_of = named.groupBy("node").agg(F.count(F.lit(1)).alias("weight"))
    out = spread_join(named, cut(by_node.join(pages_of, "node")), ["node"])
    out = out.unionByName(judged.filter("NOT named").withColumn("shared", F.lit(None).cast("string")))
    shared = F.col("shared")
    return out.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("own", shared, F.lit("allow")).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(shared.isNotNull(), "alias").otherwise("default").alias("via"),
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
