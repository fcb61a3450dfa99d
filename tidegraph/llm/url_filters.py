"""URL filters: rules first, then the ratio of two character language models, by DataFrame functions only.

Urls that a rule accepts and urls that a rule rejects each train a Markov model of variable order over the characters of
a url. A context stays in the model as long as it makes up at least ``SHARE`` of all training characters, so its order
varies with what was seen and the number of contexts is bounded at any size of the input. A character's probability is
the one after the longest context kept, smoothed by the next shorter one down to even odds. A url's score is the mean
over its characters of the difference of the two log-probabilities; the threshold is fitted on urls that were kept out
of training. Log-ratios are whole numbers of millionths, so sums are the same in every order of adding.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.core import cut
from tidegraph.llm.common import let, lower_ascii

#: Fixed value: the characters of a url that the models tell apart (lower case); "\x02" stands for the beginning, "\x03"
#: for the end, "\x01" for every other character.
SYMBOLS = " !\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`abcdefghijklmnopqrstuvwxyz{|}~"
BEGIN, END, OTHER = "\x02", "\x03", "\x01"
ALPHABET = SYMBOLS + OTHER + END
UNKNOWN = "[^" + "".join("\\" + c if c in "\\]^-[" else c for c in SYMBOLS) + "]"
ORDER = 5
SHARE = 1 / 4096
ASIDE = "012"  # first hexadecimal digits of the md5 of urls that are kept out of training
PRIOR = 4.0  # weight of the shorter context, in characters
BIN = 10_000  # width of a step of the threshold, in millionths


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Number in ``rules`` of the longest rule that fits (of equal length the first), else null."""
    out = F.lit(None).cast("int")
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i].name), -i)):
        rule = rules[i]
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, i).otherwise(out)
    return out


def judged_by_rules(pages: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """at (a number for each row), page_id, url (null as empty), host, path, rule, ruled (allow, block or null)."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.monotonically_increasing_id().alias("at"), F.col(id_col).alias("page_id"), F.coalesce(url, F.lit("")).alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("n", longest_rule(F.col("host"), F.col("path"), rules) + 1)

    def named(values: list[str]) -> Column:
        return F.get(F.array(F.lit(None).cast("string"), *[F.lit(v) for v in values]), F.coalesce("n", F.lit(0)))

    return cut(rows.select("at", "page_id", "url", "host", "path", named([r.name for r in rules]).alias("rule"), named([r.verdict for r in rules]).alias("ruled")))


def _symbols(url: Column) -> Column:
    """The url as the models see it, ``ORDER`` beginnings before it and an end behind it."""
    seen = F.regexp_replace(lower_ascii(url), UNKNOWN, OTHER)
    return F.concat(F.lit(BEGIN * ORDER), seen, F.lit(END))


def characters(rows: DataFrame, *keep: str) -> DataFrame:
    """One row for each character: ``keep``, symbol (its number) and the context before it."""

    def at(b: Column, i: Column) -> Column:
        symbol = F.position(F.substring(b, i, F.lit(1)).cast("string"), F.lit(ALPHABET)) - 1
        return F.struct(symbol.alias("symbol"), F.substring(b, i - ORDER, F.lit(ORDER)).cast("string").alias("context"))

    # every symbol is one byte: a part of the bytes is found without reading the url from its start
    parts = let(_symbols(F.col("url")).cast("binary"), lambda b: F.transform(F.sequence(F.lit(ORDER + 1), F.octet_length(b)), lambda i: at(b, i)))
    return rows.select(*keep, F.explode(parts).alias("p")).select(*keep, "p.symbol", "p.context")


def markov_ratios(training: DataFrame) -> DataFrame:
    """context, ratios: for each context kept and each symbol, millionths of log(P accepted / P rejected).

    ``training``: url, ruled. At most 1/SHARE contexts of each length, so the table may be broadcast.
    """
    accepted = F.count(F.when(F.col("ruled") == "allow", 1))
    rejected = F.count(F.when(F.col("ruled") == "block", 1))
    grams = cut(characters(training, "ruled").groupBy("context", "symbol").agg(accepted.alias("a"), rejected.alias("r")))
    size = len(ALPHABET)

    def counted(order: int) -> DataFrame:
        """Contexts of ``order`` characters that stay: context, rest (one character less), counts of each symbol."""
        n = F.sum(F.col("a") + F.col("r"))
        total = grams.agg(n.alias("total"))
        short = grams.groupBy(F.substring("context", ORDER - order + 1, order).alias("context"), "symbol").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        by_symbol = F.map_from_entries(F.collect_list(F.struct("symbol", F.struct("a", "r"))))  # at most one entry a symbol
        found = short.groupBy("context").agg(n.alias("n"), F.sum("a").alias("na"), F.sum("r").alias("nr"), by_symbol.alias("counts"))
        if order > 1:
            found = found.where(F.col("n") >= F.greatest(F.lit(2.0), total.scalar() * SHARE))
        return found.withColumn("rest", F.substring("context", 2, order - 1) if order else F.lit(None).cast("string"))

    def smoothed(count: str, total: str, prior) -> Column:
        def p(i: Column) -> Column:
            n = F.coalesce(F.try_element_at("counts", i)[count], F.lit(0))
            return (n + PRIOR * prior(i)) / (F.col(total) + PRIOR)

        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), p)

    levels = []
    for order in range(ORDER + 1):
        here = counted(order)
        if order == 0:
            level = here.select("context", smoothed("a", "na", lambda i: F.lit(1 / size)).alias("pa"), smoothed("r", "nr", lambda i: F.lit(1 / size)).alias("pr"))
        else:
            before = levels[-1].select(F.col("context").alias("rest"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
            here = here.join(before, "rest")
            level = here.select("context", smoothed("a", "na", lambda i: F.get("qa", i)).alias("pa"), smoothed("r", "nr", lambda i: F.get("qr", i)).alias("pr"))
        levels.append(cut(level))
    ratios = F.transform(F.arrays_zip("pa", "pr"), lambda p: F.round(1e6 * (F.ln(p["pa"]) - F.ln(p["pr"]))).cast("int"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return cut(out.select("context", ratios.alias("ratios")))


def url_scores(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """at, total (millionths), length of each row of ``rows`` (at, url): the log-ratios after the longest contexts kept."""
    found = characters(rows, "at")
    value = F.lit(None).cast("int")
    base = ratios.where("context = ''").select(F.max("ratios"))
    for order in range(1, ORDER + 1):
        model = F.broadcast(ratios.where(F.char_length("context") == order).select(F.col("context").alias(f"c{order}"), F.col("ratios").alias(f"r{order}")))
        found = found.withColumn(f"c{order}", F.substring("context", ORDER - order + 1, order)).join(model, f"c{order}", "left")
        value = F.coalesce(F.get(f"r{order}", F.col("symbol")), value)
    value = F.coalesce(value, F.get(base.scalar(), F.col("symbol")), F.lit(0))
    return found.select("at", value.cast("long").alias("v")).groupBy("at").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("length"))


def _steps(scored: DataFrame) -> DataFrame:
    return scored.withColumn("step", F.floor(F.col("total") / F.col("length") / BIN).cast("long"))


def threshold_step(scored: DataFrame) -> DataFrame:
    """One row, step: accepted are scores of at least step * BIN millionths. ``scored``: ruled, total, length of urls kept
    out of training. The step with the best sum of accepted shares rightly kept and rejected shares rightly left out; of
    equal ones the one nearest to 0, then the smaller. Without both kinds 0. A mean is bounded, and so is the number of
    steps."""
    bins = _steps(scored).groupBy("step").agg(*[F.count(F.when(F.col("ruled") == v, 1)).alias(n) for v, n in (("allow", "a"), ("block", "r"))])
    edges = bins.select("step", "a", "r").unionByName(bins.select((F.col("step") + 1).alias("step"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("r")))
    edges = edges.groupBy("step").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    below = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy()
    gain = edges.select(
        "step", F.sum("a").over(all_of).alias("na"), F.sum("r").over(all_of).alias("nr"),
        F.coalesce(F.sum("a").over(below), F.lit(0)).alias("lost"), F.coalesce(F.sum("r").over(below), F.lit(0)).alias("out"),
    )
    quality = F.col("out") * F.col("na") - F.col("lost") * F.col("nr")
    best = F.min(F.when((F.col("na") > 0) & (F.col("nr") > 0), F.struct((-quality).alias("q"), F.abs("step").alias("d"), "step")))
    return gain.agg(F.coalesce(best["step"], F.lit(0).cast("long")).alias("step"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (mean log-ratio of a character, in millionths, rounded down) of each row.

    Host: after the first :// up to /, ?, # or the end, A-Z in lower case; path: then up to ?, # or the end. A null url
    counts as empty; without :// host and path are empty. The longest rule that fits gives the verdict. Where none
    fits, the url is accepted if its score is at least the threshold. If no rule fits any url, every ratio and the
    threshold are 0 and all are accepted. Training sees every row that a rule judges, repeated rows as often as they
    occur, three urls of sixteen (by md5) are kept out for the threshold. Very long urls are read to their end.
    An empty table gives an empty result; other columns are not looked at.
    """
    rows = judged_by_rules(pages, rules, id_col, url_col)
    aside = F.substring(F.md5("url"), 1, 1).isin(*ASIDE)
    ratios = markov_ratios(rows.where(F.col("ruled").isNotNull() & ~aside).select("url", "ruled"))
    scored = cut(rows.join(url_scores(rows.select("at", "url"), ratios), "at"))
    step = cut(threshold_step(scored.where(F.col("ruled").isNotNull() & aside)))
    own = F.when(F.col("total") >= F.col("length") * step.scalar() * BIN, "allow").otherwise("block")
    score = F.floor(F.col("total") / F.col("length")).cast("long")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), score.alias("score"), step.scalar().alias("threshold_step"))
