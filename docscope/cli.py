"""Command line over a workspace folder of Parquet tables.

    python -m docscope.cli WORKSPACE VERB ACTION [options]

Exit codes: 0 fine, 1 problems were found, 2 the input cannot be used.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from docscope.functions import numbers
from docscope.functions import text as T
from docscope.operators import catalog, corpus, grid, labels, reports, scoring
from docscope.operators.sizes import small
from docscope.sources import tables

CATALOG = "name string, description string, input_type string, scope string, aliases array<string>, extension string, version string"
ARMS = "arm string, model_id string, price_in double, price_out double, wants_seed boolean"
LIVE = "model_id string, live_in double, live_out double, has_seed boolean"


class Workspace:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def write(self, name: str, df: DataFrame) -> int:
        tables.write_documents(df, self.path(name))
        return self.read(name).count()

    def labels(self) -> DataFrame:
        return catalog.labels(self.read("catalog"))


def _report(problems: DataFrame) -> int:
    rows = problems.orderBy("rule", "key").collect()
    for r in rows:
        print(f"{r['rule']}: {r['key']} {r['detail']}".rstrip())
    return int(bool(rows))


def _tables(w: Workspace, a: argparse.Namespace) -> list[tuple[str, str, DataFrame]]:
    """Heading line, scope and rows of each table that is asked for of the reference page."""
    page = w.spark.read.text(a.reference, wholetext=True).select(F.lit(a.reference.rsplit("/", 1)[-1]).alias("path"), F.col("value").alias("text"))
    lines = corpus.lines(page, "path")
    named = [(title, scope or "GLOBAL") for title, _, scope in (h.partition("=") for h in a.heading)]
    return [(title, scope, catalog.table_rows(lines, title, "path")) for title, scope in named]


def oracle_build(w: Workspace, a: argparse.Namespace) -> int:
    """Catalog from JSON lines; reference rows from a page's tables, the scope by heading."""
    known = tables.read_jsonl(w.spark, a.catalog, CATALOG)
    if known.select("version").distinct().count() != 1:
        print("the catalog mixes versions")
        return 2
    w.write("catalog", known)
    parts = []
    for title, scope, found in _tables(w, a):
        if found.filter(~catalog.header_fits(F.col("header"))).count():
            print(f"unexpected header below {title}")
            return 2
        parts.append(catalog.parse_rows(found).withColumn("scope", F.lit(scope)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    bad = rows.filter("problem IS NOT NULL").collect()
    twice = rows.groupBy("name").count().filter("name IS NOT NULL AND count > 1").collect()
    for r in bad:
        print(f"line {r['ln']}: {r['problem']}")
    for r in twice:
        print(f"{r['name']}: {r['count']} rows")
    if bad or twice or rows.isEmpty():
        return 2
    print(w.write("docs_reference", rows.drop("problem")))
    return 0


def oracle_verify(w: Workspace, a: argparse.Namespace) -> int:
    known = w.read("catalog")
    found = catalog.audit(known, w.read("docs_reference"), catalog.labels(known)).filter(~F.col("rule").contains("omitted"))
    return _report(found.unionByName(catalog.alias_problems(known)))


def corpus_build(w: Workspace, a: argparse.Namespace) -> int:
    """Sections of a fitting length that mention a name; and, whatever their length and names, rows of the reference page."""
    pages = tables.read_pages(w.spark, a.pages).filter(T.is_prose(F.col("text")))
    secs = corpus.sections(pages).filter(F.length("text").between(a.least, a.most))
    if a.reference:
        for title, scope, rows in _tables(w, a):
            secs = secs.unionByName(catalog.row_documents(rows, title, scope))
    secs = secs.withColumn("doc_key", F.concat_ws(":", "path", "start_line"))
    w.write("sections", secs)
    secs = w.read("sections")
    found = corpus.mentions(secs.select("doc_key", "text"), w.labels(), "doc_key", tuple(a.distractors))
    w.write("mentions", found)
    signal = corpus.signals(w.read("mentions"), "doc_key")
    eligible = secs.join(signal, "doc_key", "left").filter("n_names IS NOT NULL OR stratum = 'reference'").fillna({"n_names": 0, "has_signal": False}).withColumn("bucket", T.bucket_of(F.col("stratum"), F.col("has_signal")))
    quotas = {k: int(v) for k, v in (q.split("=") for q in a.quota)}
    if _report(corpus.check_quotas(eligible, "bucket", quotas)):
        return 2
    drawn = corpus.sample(eligible, "bucket", "path", "doc_key", quotas, a.seed)
    out = drawn.withColumn("doc_id", F.format_string("%s-%04d", "bucket", "rank")).withColumn("n_chars", F.length("text")).withColumn("sha256", F.sha2("text", 256))
    print(w.write("documents", out.drop("rank")))
    return 0


def corpus_verify(w: Workspace, a: argparse.Namespace) -> int:
    docs = w.read("documents")
    rule = lambda df, name, key, detail: df.select(F.lit(name).alias("rule"), F.col(key).alias("key"), detail.cast("string").alias("detail"))
    changed = rule(docs.filter(F.sha2("text", 256) != F.col("sha256")), "hash differs", "doc_id", F.lit(""))
    length = rule(docs.filter(F.length("text") != F.col("n_chars")), "length differs", "doc_id", F.col("n_chars"))
    twice = docs.groupBy("doc_id").count().filter("count > 1")
    return _report(changed.unionByName(length).unionByName(rule(twice, "id repeated", "doc_id", F.col("count"))))


def corpus_stats(w: Workspace, a: argparse.Namespace) -> int:
    w.read("documents").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), numbers.upper_median(F.col("n_chars")).alias("upper_median"), F.avg("n_names").alias("mean_names"), F.count_distinct("sha256").alias("texts")).orderBy("bucket").show(100, False)
    return 0


def arms_verify(w: Workspace, a: argparse.Namespace) -> int:
    out = reports.check_arms(tables.read_jsonl(w.spark, a.arms, ARMS), tables.read_jsonl(w.spark, a.live, LIVE))
    w.write("arms", tables.read_jsonl(w.spark, a.arms, ARMS))
    out.orderBy("arm").show(100, False)
    return int(out.filter("NOT ok").count() > 0)


def arms_cost(w: Workspace, a: argparse.Namespace) -> int:
    """Expected cost of the grid: four characters a token, a fixed overhead, a share of repaired calls."""
    size = w.read("documents").agg(F.sum("n_chars").alias("chars"), F.count(F.lit(1)).alias("docs"))
    tokens_in = (F.col("chars") / 4 + a.overhead * F.col("docs")) * (1 + a.repairs)
    cost = numbers.cost(tokens_in, a.out_tokens * F.col("docs") * (1 + a.repairs), F.col("price_in"), F.col("price_out"))
    w.read("arms").crossJoin(F.broadcast(size)).select("arm", F.round(cost * a.prompts, 4).alias("cost")).orderBy("arm").show(100, False)
    return 0


def _requests(w: Workspace, pilot: int = 0) -> DataFrame:
    prompts, docs = w.read("prompts"), w.read("documents")
    if pilot:
        docs = corpus.pilot(docs, "bucket", "doc_id", pilot)
    cells = grid.grid(docs.select("doc_id", "text"), w.read("arms").select("arm", "model_id"), prompts.select("prompt", F.col("text").alias("instruction")))
    key = grid.request_key(model=F.col("model_id"), payload=F.concat_ws("\n", "instruction", "text"), schema=F.lit(1))
    return cells.withColumn("request_key", key)


def extract_run(w: Workspace, a: argparse.Namespace) -> int:
    """Replay recorded responses; a repair is the response recorded under the key of its first answer."""
    responses = w.read("responses")
    first = grid.replay(_requests(w, a.pilot), responses)
    missing = first.filter("replay = 'miss'").count()
    if missing:
        print(f"{missing} requests have no recorded response")
        return 2
    parsed = lambda df: df.select("*", *(c.alias(n) for n, c in grid.parse_body(F.col("body")).items()))
    keep = ["arm", "prompt", "doc_id"]
    call = ["attempt", "error", "unavailable", "content", "finish_reason", "tokens_in", "tokens_out", "cost", "latency_s", "document"]
    one = parsed(first).withColumn("attempt", F.lit(1)).withColumn("document", F.col("text"))
    again = grid.validate(one.filter("error IS NULL")).filter("NOT valid")
    again = again.select(*keep, "text", F.sha2(F.concat_ws(":", "request_key", "content"), 256).alias("request_key"))
    two = parsed(grid.replay(again, responses).filter("replay <> 'miss'")).withColumn("attempt", F.lit(2)).withColumn("document", F.col("text"))
    settled = grid.settle(one.select(*keep, *call).unionByName(two.select(*keep, *call)), keep)
    print(w.write("extractions", settled))
    settled = w.read("extractions")
    settled.groupBy("arm", "outcome").count().orderBy("arm", "outcome").show(100, False)
    return 0


def extract_cache(w: Workspace, a: argparse.Namespace) -> int:
    """What would be replayed, what is missing, and recorded responses that no request of the grid asks for."""
    requests, responses = _requests(w), w.read("responses")
    out = grid.replay(requests, responses)
    out.groupBy("arm", "replay").count().orderBy("arm", "replay").show(100, False)
    print("orphans:", responses.select("arm", "request_key").distinct().join(requests, ["arm", "request_key"], "left_anti").count())
    return int(out.filter("replay = 'miss'").count() > 0)


def labels_init(w: Workspace, a: argparse.Namespace) -> int:
    """Label rows for documents (with a total, a proportional draw of them and the pinned ones), the finished ones of an earlier sheet kept; and the worksheet."""
    names = w.read("mentions").filter("NOT distractor").groupBy("doc_key").agg(F.array_sort(F.collect_list("name")).alias("candidates"))
    none = F.lit(None).cast("array<string>")
    empty = F.array().cast("array<string>")
    prose = w.read("documents").filter(F.col("stratum") != "reference")
    if a.total:
        prose = corpus.proportional(prose, "bucket", "doc_id", a.total, a.seed, tuple(a.pin))
    fresh = prose.join(names, "doc_key", "left")
    fresh = fresh.select("doc_id", F.coalesce("candidates", empty).alias("candidates"), none.alias("documents"), empty.alias("cross_referenced"), empty.alias("absent"))
    try:
        fresh = labels.merge(fresh, w.read("labels"))
    except AnalysisException:
        pass  # no earlier sheet
    w.write("labels_next", fresh)  # the old sheet is read until this is written
    print(w.write("labels", w.read("labels_next")))
    tables.write_text(labels.worksheet(w.read("labels")).orderBy("doc_id"), "sheet", f"{w.root}/worksheet")
    return 0


def labels_verify(w: Workspace, a: argparse.Namespace) -> int:
    known = w.labels().select(F.lower("label").alias("key")).distinct()
    labels.coverage(w.read("labels")).show(1, False)
    return _report(labels.problems(w.read("labels"), known))


def _stale(w: Workspace) -> list[str]:
    return tables.stale_fields(w.read("extractions"), "arm string, prompt string, doc_id string, outcome string, settings string, tokens_in long, cost double")


def score_run(w: Workspace, a: argparse.Namespace) -> int:
    if lost := _stale(w):
        print("extractions lack", ", ".join(lost))
        return 2
    keys = ["arm", "prompt", "doc_id"]
    known, index = w.read("catalog"), w.labels()
    docs = w.read("documents").select("doc_id", "doc_key", "text", "stratum")
    runs = w.read("extractions")
    records = runs.select(*keys, F.explode("settings").alias("r")).join(docs.select("doc_id", "text"), "doc_id")
    records = records.select(*keys, *(F.col("r")[f].alias(f) for f in grid.FIELDS), T.grounded(F.col("r")["evidence"], F.col("text")).alias("grounded"))
    hand = w.read("labels")
    absent = hand.select("doc_id", F.explode("absent").alias("key")).select("doc_id", F.lower("key").alias("key"))
    w.write("scores", scoring.record_scores(records, known, index, w.read("docs_reference"), absent, tuple(a.machine)))
    scored = w.read("scores")
    found = w.read("mentions").filter("NOT distractor").join(docs.select("doc_id", "doc_key"), "doc_key").groupBy("doc_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    target = catalog.reference_target(docs.filter("stratum = 'reference'"))
    truth = scoring.expected_names(docs, target, hand.select("doc_id", "documents"), found)
    back = scored.groupBy(*keys).agg(F.collect_set("canonical").alias("returned"), F.count(F.lit(1)).alias("n"))
    graded = runs.join(truth, "doc_id").join(back, keys, "left")
    state = scoring.status(F.col("outcome"), F.coalesce("n", F.lit(0)))
    graded = graded.select(*keys, state.alias("status"), "truth_source", "expected", F.coalesce("returned", F.array().cast("array<string>")).alias("returned"), F.when(state == "answered_empty", F.size("expected") == 0).alias("empty_was_correct"))
    w.write("document_scores", graded)
    print(w.write("summary", scoring.summary(w.read("document_scores"), scored, ["arm", "prompt"])))
    return 0


def report(w: Workspace, a: argparse.Namespace) -> int:
    w.read("summary").orderBy("prompt", "arm").show(100, False)
    runs = w.read("extractions")
    reports.latency(runs, "arm", "latency_s").orderBy("arm").show(100, False)
    reports.cost_rollup(runs, "prompt", "arm", "cost").orderBy("level", "prompt", "arm").show(100, False)
    prices = w.read("arms").select("arm", "price_in", "price_out")
    calls = runs.join(small(prices), "arm").select("arm", F.col("cost").alias("billed"), numbers.cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out")).alias("predicted"))
    reports.billed_vs_predicted(calls, "arm").orderBy("arm").show(100, False)
    return 0


VERBS: dict[tuple[str, str], Callable[[Workspace, argparse.Namespace], int]] = {
    ("oracle", "build"): oracle_build, ("oracle", "verify"): oracle_verify,
    ("corpus", "build"): corpus_build, ("corpus", "verify"): corpus_verify, ("corpus", "stats"): corpus_stats,
    ("arms", "verify"): arms_verify, ("arms", "cost"): arms_cost,
    ("extract", "run"): extract_run, ("extract", "cache"): extract_cache,
    ("labels", "init"): labels_init, ("labels", "verify"): labels_verify,
    ("score", "run"): score_run, ("report", "show"): report,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docscope", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("workspace")
    p.add_argument("verb", choices=sorted({v for v, _ in VERBS}))
    p.add_argument("action", nargs="?", default="show")
    for name in ("catalog", "reference", "pages", "arms", "live"):
        p.add_argument(f"--{name}")
    p.add_argument("--heading", action="append", default=[], help="heading line=SCOPE of a reference table")
    p.add_argument("--quota", action="append", default=[], help="bucket=n")
    p.add_argument("--distractors", nargs="*", default=[])
    p.add_argument("--machine", nargs="*", default=[], help="names whose default depends on the machine")
    p.add_argument("--seed", type=int, default=20260919)
    p.add_argument("--pilot", type=int, default=0, help="only so many documents, of each bucket in turn")
    p.add_argument("--total", type=int, default=0, help="documents to label; all without it")
    p.add_argument("--pin", nargs="*", default=[], help="documents to label in any case")
    p.add_argument("--least", type=int, default=120)
    p.add_argument("--most", type=int, default=8000)
    p.add_argument("--overhead", type=float, default=900.0)
    p.add_argument("--out-tokens", type=float, default=400.0)
    p.add_argument("--repairs", type=float, default=0.1)
    p.add_argument("--prompts", type=int, default=2)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    run = VERBS.get((args.verb, args.action))
    if run is None:
        print(f"no such action: {args.verb} {args.action}")
        return 2
    spark = spark or SparkSession.builder.appName("docscope").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(Workspace(spark, args.workspace), args)
    except AnalysisException as e:
        print(str(e).splitlines()[0])
        return 2


if __name__ == "__main__":
    sys.exit(main())
