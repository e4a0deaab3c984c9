"""SQL of the corpus queries that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

from docscope.llm import lsh_forest, quality_rules, repeat_spans, secret_scan, url_filters

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"'[\x20\x09-\x0D]+'"


def _fold(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


def _host(url: str) -> str:
    return _fold(rf"coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '')")


def _path(url: str) -> str:
    return rf"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _node(url: str) -> str:
    rest = rf"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    scheme = _fold(rf"regexp_extract({url}, '(?s)^(.*?)://', 1)")
    return f"CASE WHEN contains({url}, '://') THEN {scheme} || '://' || {_host(url)} || {rest} END"


def _verdict(host: str, path: str, pick: int) -> str:
    """The longest fitting rule (pick 1) or its verdict (pick 0)."""
    whens = []
    for rule in sorted(url_filters.RULES, key=lambda r: -len(r[1])):
        at, _, prefix = rule[1].partition("/")
        whens.append(f"WHEN ({host} = '{at}' OR {host} LIKE '%.{at}') AND starts_with({path}, '/{prefix}') THEN '{rule[pick]}'")
    return f"CASE {' '.join(whens)} END"


_RESOLVED = r"""CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
  WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || link
  WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || link
  ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '(?s)^(.*/)', 1), ''), '/') || link END"""

OP1 = rf"""WITH RECURSIVE found AS (
  SELECT url, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS link FROM pages
  UNION ALL SELECT url, regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM pages),
ends AS (SELECT url, {_RESOLVED} AS target FROM found WHERE link <> ''),
edge AS (SELECT {_node('url')} AS a, {_node('target')} AS b FROM ends),
both_ways AS (SELECT a, b FROM edge WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM edge WHERE a IS NOT NULL AND b IS NOT NULL),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
shared AS (SELECT a AS node, bool_or({_verdict(_host('b'), _path('b'), 0)} = 'allow') AS allowed, bool_or({_verdict(_host('b'), _path('b'), 0)} = 'block') AS blocked FROM reach GROUP BY a),
own AS (SELECT page_id, {_host('url')} AS host, {_path('url')} AS path, {_node('url')} AS node FROM pages),
ruled AS (SELECT *, {_verdict('host', 'path', 1)} AS rule, {_verdict('host', 'path', 0)} AS stated FROM own)
SELECT page_id, host, path, rule, CASE WHEN stated IS NOT NULL THEN stated WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN stated IS NOT NULL THEN 'rule' WHEN allowed OR blocked THEN 'alias' ELSE 'default' END AS via
FROM ruled LEFT JOIN shared USING (node)"""

OP6 = rf"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, {_SPLIT}), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) > 2),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, range(0, 3) x(k) WHERE c > 1 GROUP BY doc_id),
s AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < {quality_rules.LEAST_WORDS} OR 100 * n_repeat_words > {quality_rules.REPEAT_PERCENT} * n_words AS base_failed FROM s),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM f GROUP BY source),
m AS (SELECT sum(failed) / CAST(sum(n) AS DOUBLE) AS m, CAST(sum(n) AS DOUBLE) AS t, count(*) - 1 AS k, sum(n * CAST(n AS DOUBLE)) AS nn, sum(failed * failed / CAST(n AS DOUBLE)) AS sq FROM h),
q AS (SELECT m, ((sq - t * m * m) / nullif(m * (1 - m), 0) - k) / nullif(t - nn / t - k, 0) AS share FROM m),
p AS (SELECT m, CASE WHEN share > 0 THEN least(1000.0, greatest(1.0, 1 / share - 1)) ELSE 1000.0 END AS s FROM q),
v AS (SELECT source, (failed + m * s) / (n + s) <= {quality_rules.HOST_RATE} AS host_kept FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source"""

OP8 = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_fold("coalesce(text, '')")}, {_SPLIT}), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {lsh_forest.PERCENT} * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

# Bytes as pairs of hex digits; strings are grouped by their MD5.
OP5 = f"""WITH w AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {repeat_spans.LENGTH - 1})) AS p FROM w WHERE length(h) >= {2 * repeat_spans.LENGTH}),
k AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, {2 * repeat_spans.LENGTH})) AS m FROM p),
d AS (SELECT doc_id, p FROM k WHERE m IN (SELECT m FROM k GROUP BY m HAVING count(*) > 1)),
e AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {repeat_spans.LENGTH} THEN 0 ELSE 1 END AS fresh FROM d),
f AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM e),
r AS (SELECT doc_id, min(p) AS a, max(p) + {repeat_spans.LENGTH} AS b FROM f GROUP BY doc_id, run),
g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
s AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS n, max(b) AS tail, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM g JOIN w USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)"""



def _quoted(pattern: str) -> str:
    """A pattern as a SQL string, without the possessive marks, which change no match here."""
    return "'" + pattern.replace("}+", "}").replace("'", "''") + "'"


def _spans(kind: str, order: int, pattern: str, value: int = 0, keep: str = "TRUE") -> str:
    return f"""SELECT doc_id, {order} AS ord, '{kind}' AS kind, CAST(coalesce(list_sum(list_transform(g[1:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda y: length(y))), 0) AS BIGINT) AS start, h[i] AS hit, v[i] AS value
  FROM (SELECT doc_id, g, h, v, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, string_split_regex(x, {_quoted(pattern)}) AS g, regexp_extract_all(x, {_quoted(pattern)}) AS h, regexp_extract_all(x, {_quoted(pattern)}, {value}) AS v FROM t)) WHERE {keep}"""


_MIXED = "regexp_matches(h[i], '[0-9]') AND regexp_matches(h[i], '[A-Z]') AND regexp_matches(h[i], '[a-z]')"
_NEAR = "EXISTS (SELECT 1 FROM part y WHERE y.doc_id = x.doc_id AND y.kind IN ({}) AND abs(y.start - x.start) <= " + str(secret_scan.WINDOW) + ")"
_ID, _SECRET = _NEAR.format("'access', 'weak_id'"), _NEAR.format("'assign', 'hex', 'weak_secret'")
OP2 = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
part AS ({_spans('assign', 0, secret_scan.ASSIGN, 2, f'length(v[i]) >= {secret_scan.ASSIGN_LEAST}')}
  UNION ALL {_spans('access', 1, secret_scan.ACCESS)} UNION ALL {_spans('hex', 2, secret_scan.HEX)} UNION ALL {_spans('weak_id', 3, secret_scan.WEAK_ID)}
  UNION ALL {_spans('weak_secret', 4, '[A-Za-z0-9+/]{20,}={0,2}', 0, _MIXED)} UNION ALL {_spans('endpoint', 5, secret_scan.ENDPOINT)}),
said AS (SELECT doc_id, ord, kind, start, kind || ':' || start || ':' || (start + length(hit)) AS span FROM part x
  WHERE ord < 3 OR (kind = 'weak_id' AND {_SECRET}) OR (kind = 'weak_secret' AND {_ID}) OR (kind = 'endpoint' AND {_ID} AND {_SECRET})),
s AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg(span, ',' ORDER BY start, ord) AS spans FROM said GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN s USING (doc_id)"""

ORACLE = {"op2_secret_scan": OP2, "op5_repeat_spans": OP5, "op1_url_filters": OP1, "op6_quality_rules": OP6, "op8_minhash_near_dedup": OP8}
