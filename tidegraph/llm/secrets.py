"""Secrets in texts, with multipart linking, by DataFrame functions only.

Three strong kinds (``assign``, ``access``, ``hex``) are always reported. Three weak kinds say little alone and are
reported only when complementary parts lie in the same scope (a block of lines without an empty line between; on
request also within ``reach`` code points): ``key_id`` (a named account or key id) with a secret, ``bare`` (40 mixed characters) with an
identifier, ``endpoint`` (an address) with both. A weak candidate that overlaps a strong span is dropped.

Every candidate is an interval of its document. The interval join of a candidate with the nearest interval of another
role is a sweep in order of start: the greatest end before it and the least start behind it, as window functions over
the document's own intervals, so no pair is ever formed and work is linear in the number of candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import text_of

#: The patterns of the contract.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

KEY_ID = r"""(?i:access_?key_?id|access_?key|client_?id|account|login|user_?name|user)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,}"""
BARE = r"[A-Za-z0-9/+=_-]{40,}"
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]+|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9-](?::[0-9]+)?"""
BREAK = r"\n[\x20\t\r]*\n"

KINDS = ("assign", "access", "hex", "key_id", "bare", "endpoint")
STRONG = KINDS[:3]
ROLE = {"access": "id", "key_id": "id", "assign": "secret", "hex": "secret", "bare": "secret", "endpoint": "endpoint"}


def _hits(text: Column, kind: str, pattern: str, keep=lambda hit: F.lit(True)) -> Column:
    """Leftmost non-overlapping matches: order, characters since the last match, own length, whether it counts."""
    p = F.lit(pattern)
    pairs = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, p, F.lit(0)),
        lambda g, h: F.struct(F.char_length(g).alias("gap"), F.char_length(h).alias("size"), keep(h).alias("ok")),
    )
    found = F.transform(
        F.filter(pairs, lambda x: x["size"].isNotNull()),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"], x["size"], x["ok"]),
    )
    return F.when(F.rlike(text, p), found)


def _long_value(hit: Column) -> Column:
    return F.char_length(F.regexp_extract(hit, ASSIGN_VALUE, 1)) >= 8


def _mixed(hit: Column) -> Column:
    return (
        (F.char_length(hit) == 40)
        & F.rlike(hit, F.lit("^[A-Za-z0-9/+]+$"))
        & F.rlike(hit, F.lit("[A-Z]"))
        & F.rlike(hit, F.lit("[a-z]"))
        & F.rlike(hit, F.lit("[0-9]"))
    )


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = None) -> DataFrame:
    """All spans: row (a number for each row of ``docs``), doc_id, kind, start, end (code points, end exclusive).

    A row of ``docs`` without spans (also a null or empty text) gives one row whose kind is null. Repeated rows are
    scanned each on its own; other columns are not looked at; an empty table gives an empty result.
    """
    text = F.col("_text")
    base = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text")
    )
    strong = F.array_compact(
        F.flatten(
            F.array_compact(
                F.array(
                    _hits(text, "assign", ASSIGN, _long_value),
                    _hits(text, "access", ACCESS),
                    _hits(text, "hex", HEX),
                )
            )
        )
    )
    weak = F.flatten(
        F.array_compact(
            F.array(
                _hits(text, "key_id", KEY_ID), _hits(text, "bare", BARE, _mixed), _hits(text, "endpoint", ENDPOINT)
            )
        )
    )
    found = base.select("row", "doc_id", "_text", strong.alias("_strong"), weak.alias("_weak"))
    breaks = F.when(F.exists("_weak", lambda w: w["ok"]), _hits(text, "break", BREAK))
    parts = found.select(
        "row", "doc_id", F.explode_outer(F.flatten(F.array_compact(F.array("_strong", "_weak", breaks)))).alias("p")
    ).select("row", "doc_id", "p.*")

    spread = parts.repartition("row")
    own = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(own)
    spans = spread.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    spans = spans.withColumn("kind", F.when(F.col("ok"), F.col("kind")))

    order = (F.col("start"), F.col("end"), F.col("kind"))
    so_far = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("scope", F.sum((F.col("kind") == "break").cast("int")).over(so_far))

    role = F.lit(None).cast("string")
    for kind, name in ROLE.items():
        role = F.when(F.col("kind") == kind, name).otherwise(role)
    spans = spans.withColumn("role", role)

    before = Window.partitionBy("row", "scope").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row", "scope").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)

    def near(name: str) -> Column:
        last = F.max(F.when(F.col("role") == name, F.col("end"))).over(before)
        following = F.min(F.when(F.col("role") == name, F.col("start"))).over(behind)
        if reach is None:
            return last.isNotNull() | following.isNotNull()
        return F.coalesce(F.col("start") - last <= reach, F.lit(False)) | F.coalesce(following - F.col("end") <= reach, F.lit(False))

    is_strong = F.col("kind").isin(*STRONG)
    covered = F.coalesce(F.max(F.when(is_strong, F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(
        F.min(F.when(is_strong, F.col("start"))).over(behind) < F.col("end"), F.lit(False)
    )
    spans = spans.withColumns(
        {"covered": covered, "near_id": near("id"), "near_secret": near("secret"), "strong": is_strong}
    )
    linked = (
        ((F.col("kind") == "key_id") & F.col("near_secret"))
        | ((F.col("kind") == "bare") & F.col("near_id"))
        | ((F.col("kind") == "endpoint") & F.col("near_id") & F.col("near_secret"))
    )
    kept = F.col("strong") | (linked & ~F.col("covered"))
    return spans.select(
        "row", "doc_id", F.when(kept, F.col("kind")).alias("kind"), F.when(kept, F.col("start")).alias("start"), F.when(kept, F.col("end")).alias("end")
    )


def secret_report(spans: DataFrame) -> DataFrame:
    """One row for each document row: counts of the strong kinds, digest of their spans, all spans as text."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    one = F.when(F.col("kind").isNotNull(), F.struct("start", rank.alias("rank"), "end", "kind"))

    def joined(items: Column) -> Column:
        return F.array_join(
            F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    found = spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in STRONG],
        F.sort_array(F.collect_list(one)).alias("all"),
    )
    base = F.filter("all", lambda s: s["rank"] <= len(STRONG))
    return found.select("doc_id", *[f"n_{k}" for k in STRONG], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))
