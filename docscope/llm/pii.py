"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers no pattern lists.

The base findings (email, ip, card, phone) are the seeds, each whole span one instance. Candidates are the other
identifiers: words with a digit, ``@`` or ``_``, and such words in a row (``AB 12 34``), of six or more characters. The two
letter words before an instance, with nothing but marks between, are its lexical pattern. Patterns and instances form
a weighted bipartite graph (co-occurrence counts, summed before the shuffle). Spark scores it in rounds: a pattern's
confidence is the share of its occurrences that fall on trusted instances, an instance's score is the best confidence
of its patterns; seeds keep score 1. Candidates behind a pattern that ends above ``CONFIDENCE``, with at least
``SUPPORT`` distinct trusted instances, are reported as ``context`` spans if no base span overlaps them.

Null text is empty. Repeated rows count once in the graph and get equal results. An empty table gives an empty result.
Positions are code points, stop exclusive. Columns other than doc_id and text are ignored. Texts are matched once; the
graph is made of hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscope.llm.common import cut, row_keys, spread_join, table
from docscope.llm.spans import LABELLED, digest, free_of, labelled, let, matches

# Fixed values of the contract, with borders and possessive repeats that keep scans linear on long runs; they match
# the same texts (a match may start where the last one ended, or where its first class begins).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

ROUNDS, CONFIDENCE, SUPPORT = 3, 0.8, 3
#: Context looked at before an instance, in code points; and the least length of a candidate.
CONTEXT_CHARS, LEAST = 48, 6
_WORD = r"[@+]?+[A-Za-z0-9]++(?:[@+._-]++[A-Za-z0-9]++)*+"
#: A word that holds a digit, @ or _, and any words with digits that follow behind single blanks.
CANDIDATE = rf"(?<![A-Za-z0-9@+._-])(?=[A-Za-z+.-]*+[0-9@_]){_WORD}(?:\x20(?=[A-Za-z@+._-]*+[0-9]){_WORD})*+"
_CONTEXT = r"(?s)([\p{L}]+)[^\p{L}\p{N}]+([\p{L}]+)[^\p{L}\p{N}]*$"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    found = lambda pattern: matches(text, pattern, CONTEXT_CHARS)
    part_ok = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)

    def card_ok(x: Column) -> Column:
        d = _digits(x["hit"])
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)

    return {
        "email": found(EMAIL),
        "ip": F.filter(found(IP), lambda x: F.forall(F.split(x["hit"], "[.]"), part_ok)),
        "card": F.filter(found(CARD), card_ok),
        "phone": F.filter(found(PHONE), lambda x: F.length(_digits(x["hit"])).between(10, 15)),
    }


def _small(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))


def _instances(spans: Column, seed: bool) -> Column:
    """``(start, stop, word, pattern, seed)`` of the spans that have a context; the word is a hash, the pattern folded text."""
    pattern = lambda x: F.lower(F.concat_ws(" ", F.regexp_extract(x["before"], _CONTEXT, 1), F.regexp_extract(x["before"], _CONTEXT, 2)))
    one = lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.xxhash64(x["hit"]).alias("word"), pattern(x).alias("pattern"), F.lit(seed).alias("seed"))
    return F.filter(F.transform(spans, one), lambda x: F.length(x["pattern"]) > 1)


def learn_patterns(found: DataFrame) -> DataFrame:
    """Confident patterns ``(pattern, confidence, weight)`` from instances ``(word, pattern, seed)``.

    A pattern or word may hold a large share of the edges, so both ways between them are spread joins.
    """
    edges = cut(found.groupBy("pattern", "word").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")))
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    patterns = None
    for step in range(ROUNDS):
        patterns = cut(
            scored.groupBy("pattern").agg(
                (F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("confidence"),
                F.count_if(F.col("score") >= CONFIDENCE).alias("support"),
                F.count(F.lit(1)).alias("weight"),
            ).filter((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).drop("support")
        )
        if step == ROUNDS - 1:
            break
        best = F.max("confidence").alias("best")
        words = spread_join(edges, patterns, ["pattern"], "inner").groupBy("word").agg(best)
        sizes = edges.groupBy("word").agg(F.count(F.lit(1)).alias("weight"))
        words = cut(words.join(sizes, "word"))
        scored = spread_join(edges, words, ["word"]).withColumn("score", F.greatest(F.col("seed").cast("double"), F.coalesce("best", F.lit(0.0)))).drop("best")
    return patterns


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, email, ip, card, phone, base, spans)`` for every row, the last two as labelled spans."""
    body = F.coalesce(F.col("text"), F.lit(""))
    found = {k: _named(c) for k, c in base_spans(body).items()}
    words = F.filter(matches(body, CANDIDATE, CONTEXT_CHARS), lambda x: F.length(x["hit"]) >= LEAST)

    def read(email: Column, ip: Column, card: Column, phone: Column) -> Column:
        every = F.concat(email, ip, card, phone)
        free = let(words, lambda w: free_of(w, every))
        seen = F.concat(_instances(every, True), _instances(free, False))
        return F.struct(*(_small(c).alias(k) for k, c in zip(KINDS, (email, ip, card, phone), strict=True)), seen.alias("seen"))

    all_ = let(found["email"], lambda e: let(found["ip"], lambda i: let(found["card"], lambda c: let(found["phone"], lambda p: read(e, i, c, p)))))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", *row_keys("doc_id", "text"), all_.alias("x"))
    rows = cut(rows.select("row_id", "doc_id", "ka", "kb", "x.*"))
    seen = rows.filter(F.size("seen") > 0).select("row_id", "ka", "kb", F.explode("seen").alias("x")).select("row_id", "ka", "kb", "x.*")
    patterns = learn_patterns(seen.select("ka", "kb", "start", "stop", "word", "pattern", "seed").distinct())
    new = spread_join(seen.filter("NOT seed"), patterns, ["pattern"], "inner")
    span = F.struct("start", F.lit(len(KINDS)).alias("ord"), F.lit("context").alias("kind"), "stop")
    new = new.groupBy("row_id").agg(F.array_sort(F.collect_list(span)).alias("more"))
    base = F.concat(*(labelled(k, i, F.col(k)) for i, k in enumerate(KINDS)))
    out = rows.join(new, "row_id", "left").withColumn("base", F.array_sort(base))
    out = out.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(LABELLED)))))
    return out.select("doc_id", *KINDS, "base", "spans")


def _named(spans: Column) -> Column:
    """Spans of any kind in one type."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["hit"].alias("hit"), x["before"].alias("before")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(digest(F.col("base")), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
    )
