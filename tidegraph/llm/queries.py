"""Registered queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.bpe import bpe_codes
from tidegraph.llm.common import table
from tidegraph.llm.cover_trees import top_inner_products
from tidegraph.llm.exact_dedup import exact_groups
from tidegraph.llm.filter_audit import audit_filters
from tidegraph.llm.hard_negatives import labelled_vectors, mine
from tidegraph.llm.languages import predict_languages, train_languages
from tidegraph.llm.lm_scoring import score_documents
from tidegraph.llm.mixing import mix
from tidegraph.llm.near_dedup import near_groups
from tidegraph.llm.pseudonyms import KINDS as PRIVATE_KINDS
from tidegraph.llm.pseudonyms import pseudonymise
from tidegraph.llm.quality import score_quality, train_quality
from tidegraph.llm.secrets import ACCESS, ASSIGN, BARE, BREAK, ENDPOINT, HEX, KEY_ID, KINDS, ROLE, STRONG, secret_report, secret_spans
from tidegraph.llm.url_filters import ASIDE, BIN, ORDER, PRIOR, RULES, SHARE, SYMBOLS, UNKNOWN, filter_urls

PSEUDONYM_KEY = "tidegraph demonstration key"
VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def op2_secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    return secret_report(secret_spans(table(spark, folder, "documents")))


def op3_top_inner_products(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return top_inner_products(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op4_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op5_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    found = pseudonymise(table(spark, folder, "documents"), PSEUDONYM_KEY)

    def count(kind: str):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in PRIVATE_KINDS]
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *counts, spans.alias("spans"), "text")


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score_quality(docs, train_quality(docs, table(spark, folder, "labels")))


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(table(spark, folder, "documents"), 3, Fraction(85, 100)).select("doc_id", "n_shingles", "component_id", "kept")


def op8_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"))


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return bpe_codes(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op10_languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return predict_languages(docs, *train_languages(docs))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(labelled_vectors(table(spark, folder, "embeddings"), label), F.col("vec_id") % 100 == 0)


def op13_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(table(spark, folder, "pages"))


_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_secret_spans, op3_top_inner_products, op4_source_mixing, op5_pseudonyms, op6_quality,
        op7_near_duplicates, op8_lm_scores, op9_byte_bpe, op10_languages,
        op11_filter_audit, op12_hard_negatives, op13_url_verdicts,
    )
}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _secrets_sql() -> str:
    """Positions from the pieces between matches; links by joins of intervals."""
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "key_id": KEY_ID, "bare": BARE, "endpoint": ENDPOINT, "break": BREAK}
    cut = "\n  UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS kind, string_split_regex(t, {_quoted(p)}) AS g, regexp_extract_all(t, {_quoted(p)}) AS h FROM d"
        for k, p in patterns.items()
    )
    role = " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in ROLE.items())
    rank = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
    strong = ", ".join(f"'{k}'" for k in STRONG)
    value = _quoted("[:=] *[\"'']?([A-Za-z0-9+/_.=-]+)$".replace("''", "'"))
    near = "EXISTS (SELECT 1 FROM r o WHERE o.doc_id = w.doc_id AND o.scope = w.scope AND o.role = '%s' AND (o.kind, o.s) <> (w.kind, w.s))"
    joined = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank)%s, '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS ({cut}),
p AS (SELECT doc_id, kind, i, length(g[i]) AS gap, h[i] AS m FROM c, unnest(range(1, len(h) + 1)) AS u(i)),
q AS (SELECT *, CAST(sum(gap + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS e FROM p),
x AS (SELECT doc_id, kind, m, e - length(m) AS s, e, CASE kind {role} END AS role, CASE kind {rank} END AS rank FROM q
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m, {value}, 1)) >= 8
    WHEN 'bare' THEN length(m) = 40 AND NOT regexp_matches(m, '[=_-]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')
    ELSE true END),
r AS (SELECT x.*, (SELECT count(*) FROM x b WHERE b.doc_id = x.doc_id AND b.kind = 'break' AND b.s < x.s) AS scope FROM x WHERE kind <> 'break'),
f AS (SELECT * FROM r w WHERE kind IN ({strong}) OR (
    NOT EXISTS (SELECT 1 FROM r o WHERE o.doc_id = w.doc_id AND o.kind IN ({strong}) AND o.s < w.e AND o.e > w.s)
    AND CASE kind WHEN 'key_id' THEN {near % "secret"} WHEN 'bare' THEN {near % "id"} ELSE {near % "id"} AND {near % "secret"} END))
SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in STRONG)},
  sha256({joined % f" FILTER (kind IN ({strong}))"}) AS base_sha256, {joined % ""} AS spans
FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id"""


def _urls_sql() -> str:
    """The same models as relations: one row for each context and symbol."""
    size = len(SYMBOLS) + 2
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)
    aside = ", ".join(f"'{d}'" for d in ASIDE)
    levels = ""
    for k in range(ORDER + 1):
        stays = "" if k < 2 else f"HAVING sum(a + r) >= greatest(2.0, (SELECT sum(a + r) FROM g) * {SHARE})"
        before = f"JOIN p{k - 1} q ON q.context = substr(n.context, 2) AND q.symbol = y.symbol" if k else f"JOIN (SELECT {1 / size!r} AS pa, {1 / size!r} AS pr) q ON true"
        levels += f"""
g{k} AS (SELECT substr(context, {ORDER - k + 1}, {k}) AS context, symbol, sum(a) AS a, sum(r) AS r FROM g GROUP BY ALL),
n{k} AS (SELECT context, CAST(sum(a) AS DOUBLE) AS a, CAST(sum(r) AS DOUBLE) AS r FROM g{k} GROUP BY context {stays}),
p{k} AS (SELECT n.context, y.symbol, (coalesce(g.a, 0) + {PRIOR} * q.pa) / (n.a + {PRIOR}) AS pa, (coalesce(g.r, 0) + {PRIOR} * q.pr) / (n.r + {PRIOR}) AS pr
  FROM n{k} n JOIN (SELECT unnest(range({size})) AS symbol) y ON true {before} LEFT JOIN g{k} g ON g.context = n.context AND g.symbol = y.symbol),
v{k} AS (SELECT context, symbol, CAST(round(1e6 * (ln(pa) - ln(pr))) AS BIGINT) AS v FROM p{k}),"""
    orders = range(ORDER, -1, -1)
    looked = "\n  ".join(f"LEFT JOIN v{k} ON v{k}.context = substr(c.context, {ORDER - k + 1}, {k}) AND v{k}.symbol = c.symbol" for k in orders)
    return f"""
WITH u AS (SELECT row_number() OVER () AS nr, page_id, coalesce(url, '') AS url, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['host', 'path']) AS x FROM pages),
h AS (SELECT nr, page_id, url, translate(x.host, '{_UP}', '{_UP.lower()}') AS host, x.path AS path FROM u),
rules(verdict, rhost, rpath) AS (VALUES {rules}),
j AS (SELECT h.*, verdict AS ruled, rhost || rpath AS rule,
    chr(2) || chr(2) || chr(2) || chr(2) || chr(2) || regexp_replace(translate(url, '{_UP}', '{_UP.lower()}'), {_quoted(UNKNOWN)}, chr(1), 'g') || chr(3) AS s
  FROM h LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY nr ORDER BY length(rhost || rpath) DESC) = 1),
c AS MATERIALIZED (SELECT nr, ruled, left(md5(url), 1) IN ({aside}) AS aside, instr({_quoted(SYMBOLS)} || chr(1) || chr(3), s[i]) - 1 AS symbol, substr(s, i - {ORDER}, {ORDER}) AS context
  FROM j, unnest(range({ORDER + 1}, length(s) + 1)) AS t(i)),
g AS MATERIALIZED (SELECT context, symbol, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS r FROM c WHERE ruled IS NOT NULL AND NOT aside GROUP BY ALL),{levels}
f AS MATERIALIZED (SELECT nr, any_value(ruled) AS ruled, any_value(aside) AS aside, sum(coalesce({", ".join(f"v{k}.v" for k in orders)}, 0)) AS total, count(*) AS length
  FROM c
  {looked}
  GROUP BY nr),
b AS (SELECT CAST(floor(total / length / {BIN}) AS BIGINT) AS step, ruled FROM f WHERE aside AND ruled IS NOT NULL),
e AS (SELECT DISTINCT step FROM (SELECT step FROM b UNION ALL SELECT step + 1 FROM b)),
q AS (SELECT step, (SELECT count(*) FROM b x WHERE x.ruled = 'block' AND x.step < e.step) * (SELECT count(*) FROM b WHERE ruled = 'allow')
    - (SELECT count(*) FROM b x WHERE x.ruled = 'allow' AND x.step < e.step) * (SELECT count(*) FROM b WHERE ruled = 'block') AS quality FROM e),
k AS (SELECT coalesce((SELECT step FROM q WHERE (SELECT count(DISTINCT ruled) FROM b) = 2 ORDER BY quality DESC, abs(step), step LIMIT 1), 0) AS step)
SELECT page_id, host, path, rule, coalesce(j.ruled, CASE WHEN total >= length * step * {BIN} THEN 'allow' ELSE 'block' END) AS verdict,
  CAST(floor(total / length) AS BIGINT) AS score, step AS threshold_step FROM j JOIN f USING (nr), k"""


_SPACE = r"[\x20\x09-\x0D]+"
SQL = {
    "op1_exact_dedup": f"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)""",
    "op2_secret_spans": _secrets_sql(),
    "op3_top_inner_products": """
WITH v AS (SELECT DISTINCT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains([x IS NULL OR NOT isfinite(x) FOR x IN embedding], true)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op7_near_duplicates": f"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_UP.lower()}'), '{_SPACE}') IF x <> ''] AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s),
u AS (SELECT doc_id, unnest(s) AS h FROM s),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n_shingles + y.n_shingles - k)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.other),
c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT n.doc_id, n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c ON c.node = n.doc_id""",
    "op11_filter_audit": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
m AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
  len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t),
  regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS f FROM w LEFT JOIN m USING (doc_id)),
c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, f),
l AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o, chr(64 + a.i::INT) || chr(64 + b.i::INT) || chr(64 + c.i::INT) || chr(64 + d.i::INT) || chr(64 + e.i::INT) AS filter_order
  FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT filter_order, CAST(i AS INT) AS step, o[1 : i - 1] AS before, o[i] AS own FROM o, l),
r AS (SELECT part, filter_order, step, own, n, good, toxic, f, f[own] AS fails, list_bool_or([false] || [f[j] FOR j IN before]) AS earlier FROM c, s),
g AS (SELECT part, filter_order, step, any_value(own) AS own,
  coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0) AS removed,
  coalesce(sum(n) FILTER (fails AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (fails AND len([x FOR x IN f IF x]) = 1), 0) AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT earlier), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g""",
    "op12_hard_negatives": """
WITH v AS (SELECT row_number() OVER () AS nr, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains([x IS NULL OR NOT isfinite(x) FOR x IN embedding], true)),
s AS (SELECT a.nr, a.vec_id AS anchor_id, c.nr AS other, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.nr <> c.nr WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY nr ORDER BY score DESC, vec_id, other) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.nr, p.place ORDER BY n.score DESC, n.vec_id, n.other) AS INTEGER) AS rank
  FROM p JOIN s n ON n.nr = p.nr AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op13_url_verdicts": _urls_sql(),
}
