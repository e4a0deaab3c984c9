"""Sections, mentions, strata and samples."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docscope.functions import text as T
from docscope.operators.sizes import is_small, small

def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, ln, line)``, ln from 1."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).select(key, (F.col("at") + 1).alias("ln"), F.regexp_replace("line", "\r$", "").alias("line"))


def sections(pages: DataFrame) -> DataFrame:
    """Split ``pages (path, text)`` at ATX headings.

    Text before the first heading is a section headed by the title; blank sections go. ``heading_path`` is the title
    and the headings above and at the section, equal neighbours once, joined by `` > ``. A fold over a page's headings
    keeps the trail: a heading of level n replaces what the trail holds from place n on, so skipped levels close up.
    Line numbers start at 1 behind the front matter.
    """
    title = T.title_of(F.col("text"))
    base = pages.select("path", title.alias("page_title"), F.posexplode(F.split(T.body_of(F.col("text")), "\n")).alias("at", "line"))
    base = base.withColumn("level", T.heading_level(F.col("line")))
    by_line = Window.partitionBy("path").orderBy("at")
    base = base.withColumn("sec", F.sum((F.col("level") > 0).cast("int")).over(by_line))
    line = F.struct("at", "line", "level")
    # One row per section; its lines are bounded by the page.
    secs = base.groupBy("path", "page_title", "sec").agg(F.array_sort(F.collect_list(line)).alias("all"))
    head = F.col("all")[0]
    body = F.when(head["level"] > 0, F.slice("all", 2, F.size("all"))).otherwise(F.col("all"))
    secs = secs.select(
        "path",
        "page_title",
        "sec",
        (head["at"] + 1).cast("int").alias("start_line"),
        head["level"].alias("level"),
        F.when(head["level"] > 0, T.heading_text(head["line"])).otherwise(F.col("page_title")).alias("heading"),
        F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("text"),
        F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("content"),
    )
    so_far = F.collect_list(F.when(F.col("level") > 0, F.struct("level", "heading"))).over(Window.partitionBy("path").orderBy("sec"))
    trail = F.aggregate(
        so_far,
        F.array().cast("array<string>"),
        lambda acc, h: F.concat(F.slice(acc, F.lit(1), h["level"] - 1), F.array(h["heading"])),
    )
    named = F.concat(F.array("page_title"), trail)
    once = F.filter(named, lambda x, i: (i == 0) | (x != F.element_at(named, F.greatest(F.lit(1), i))))
    out = secs.withColumn("heading_path", F.array_join(once, " > "))
    return out.filter(F.trim(F.regexp_replace("content", T.SPACE, " ")) != "").select("path", "page_title", "heading", "heading_path", "text", "start_line", T.stratum_of(F.col("path")).alias("stratum"))


def mentions(docs: DataFrame, labels: DataFrame, key: str = "doc_id", distractors: tuple[str, ...] = ()) -> DataFrame:
    """Whole-word, case-sensitive mentions of catalog labels: ``(key, name, n, distractor)``.

    ``labels (label, canonical)`` holds names and aliases. Labels are identifiers, so a bounded search for them is an
    equi-join of tokens. Labels of a checked size are broadcast, so that only tokens that are labels are ever shuffled;
    more of them are joined by a shuffle of tokens that were counted per document first.
    """
    labels = labels.select("label", "canonical")
    found = docs.select(key, F.explode(T.tokens(F.col("text"))).alias("label"))
    if is_small(labels):
        found = found.join(F.broadcast(labels), "label").withColumn("n", F.lit(1).cast("long"))
    else:
        found = found.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n")).join(labels, "label")
    return found.groupBy(key, F.col("canonical").alias("name")).agg(F.sum("n").alias("n")).withColumn("distractor", F.col("name").isin(*distractors))


def backticked(text: Column, name: Column) -> Column:
    """Whether a name occurs more often than outside of back-quoted spans."""
    bare = F.regexp_replace(text, "`[^`]*`", "")
    count = lambda t: F.size(F.filter(T.tokens(t), lambda x: x == name))
    return count(text) > count(bare)


def signals(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, n_names, has_signal)``: whether any mention is not a distractor."""
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("n_names"), F.bool_or(~F.col("distractor")).alias("has_signal"))


def draw_order(seed: int, *key: str) -> Column:
    """A seeded order that every engine computes alike."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)), 256)


def sample(docs: DataFrame, bucket: str, page: str, key: str, quotas: Mapping[str, int], seed: int) -> DataFrame:
    """Draw ``quotas[bucket]`` rows of each bucket: one per page first, then more, in seeded hash order.

    A page's leader is a grouped minimum, so no page is gathered anywhere; ranks within a bucket are cut to the
    greatest quota before they are shuffled.
    """
    pool = docs.filter(F.col(bucket).isin(*quotas)).withColumn("draw", draw_order(seed, key))
    lead = pool.groupBy(F.col(bucket).alias("lead_bucket"), F.col(page).alias("lead_page")).agg(F.min(F.struct("draw", key)).alias("lead"))
    same = F.col(bucket).eqNullSafe(F.col("lead_bucket")) & F.col(page).eqNullSafe(F.col("lead_page"))
    ranked = pool.join(lead, same).withColumn("extra", (F.struct("draw", key) != F.col("lead")).cast("int")).drop("lead_bucket", "lead_page", "lead")
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy("extra", "draw", key))
    quota = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))
    return ranked.withColumn("rank", rank).filter((F.col("rank") <= max(quotas.values())) & (F.col("rank") <= quota[F.col(bucket)])).drop("draw", "extra")


def check_quotas(docs: DataFrame, bucket: str, quotas: Mapping[str, int]) -> DataFrame:
    """Problems ``(rule, key, detail)``: buckets with fewer rows than their quota."""
    spark = docs.sparkSession
    want = spark.createDataFrame([(k, v) for k, v in quotas.items()], "bucket string, quota int")
    have = docs.groupBy(F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    short = want.join(have, "bucket", "left").filter(F.coalesce("n", F.lit(0)) < F.col("quota"))
    return short.select(F.lit("pool smaller than quota").alias("rule"), F.col("bucket").alias("key"), F.format_string("%d < %d", F.coalesce("n", F.lit(0)), "quota").alias("detail"))


def census(docs: DataFrame, bucket: str, page: str, quotas: Mapping[str, int]) -> DataFrame:
    """``(bucket, quota, sections, pages, census)``: a quota of at least the pages is a census, not a sample."""
    want = docs.sparkSession.createDataFrame([(k, v) for k, v in quotas.items()], "bucket string, quota int")
    have = docs.groupBy(F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("sections"), F.count_distinct(page).alias("pages"))
    return have.join(F.broadcast(want), "bucket").withColumn("census", (F.col("bucket") != "reference") & (F.col("quota") >= F.col("pages")))


def pilot(docs: DataFrame, bucket: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows taking one of each bucket in turn."""
    rn = F.row_number().over(Window.partitionBy(bucket).orderBy(order))
    return docs.withColumn("rn", rn).filter(F.col("rn") <= n).orderBy("rn", bucket).limit(n)


def allocate(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Proportional shares ``(key, n, share)`` by largest remainder; ties go to the greater key."""
    whole = counts.agg(F.sum(n).alias("all_n"))
    parts = counts.crossJoin(F.broadcast(whole))
    exact = F.col(n) * total
    parts = parts.withColumn("floor", F.floor(exact / F.col("all_n"))).withColumn("rest", exact % F.col("all_n"))
    left = F.lit(total) - F.sum("floor").over(Window.partitionBy())
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("rest"), F.desc(key)))
    return parts.select(key, n, (F.col("floor") + (rank <= left).cast("long")).alias("share"))


def proportional(docs: DataFrame, bucket: str, key: str, total: int, seed: int, pins: tuple = ()) -> DataFrame:
    """``total`` rows, each bucket its share of them, in seeded hash order; and the pinned rows beside those, ``pinned``."""
    shares = allocate(docs.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")), bucket, "n", total).select(F.col(bucket).alias("of"), "share")
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy(bucket).orderBy(draw_order(seed, key), key))).filter(F.col("rank") <= total)
    drawn = ranked.join(small(shares), F.col(bucket).eqNullSafe(F.col("of"))).filter("rank <= share").drop("rank", "of", "share")
    if not pins:
        return drawn.withColumn("pinned", F.lit(False))
    extra = docs.filter(F.col(key).isin(*pins)).join(drawn.select(key), key, "left_anti").select(*docs.columns)
    return drawn.withColumn("pinned", F.lit(False)).unionByName(extra.withColumn("pinned", F.lit(True)))
