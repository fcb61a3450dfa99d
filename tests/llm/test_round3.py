"""Filter audit, hard negatives and url filters against plain versions."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import filter_audit, hard_negatives, url_filters

DOCS = "doc_id long, text string, lang string, source string, hash long, file string, row long, bits int, part string"


def plain_failures(rows):
    """(part, doc_id, failed letters) of each row; E by comparing with every other row."""
    out = []
    for doc_id, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": doc_id is not None and any(o is not None and o < doc_id and (x or "") == t for o, x, _ in rows),
        }
        out.append((lang or "", doc_id, {k for k, v in failed.items() if v}))
    return out


def plain_audit(rows, labels):
    failed, out = plain_failures(rows), {}
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    for part in {p for p, _, _ in failed}:
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = [(d, f) for p, d, f in failed if p == part]
            gone = []
            for step, letter in enumerate(order, 1):
                hit = [(d, f) for d, f in left if letter in f]
                redundant = sum(letter in f for _, f in gone)
                left = [(d, f) for d, f in left if letter not in f]
                gone += hit
                total[letter] += len(hit)
                unique = sum(f == {letter} for p, _, f in failed if p == part)
                out[part, order, step] = [len(left), len(hit), redundant, unique, sum(d in good for d, _ in hit), sum(d in toxic for d, _ in hit)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audit_rows(rng):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.sample(words, rng.choice([5, 99, 100, 150]))) for _ in range(12)]
    texts += [" ".join(rng.choices(words[:30], k=120)), "A B C d", "price $5", "", None, "x" * 1_000_000, " ".join(rng.choices(words, k=40_000)), "É # Ü" * 40]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(150)]
    rows += [(7, rows[7][1], "en"), (None, rows[3][1], "en"), (None, "only here", None), (300, rows[7][1], "zz")]
    return rows


@pytest.mark.parametrize("collide", [False, True])
def test_audit_equals_plain(spark, collide):
    rng = random.Random(5)
    rows = audit_rows(rng)
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 150, 2)] + [(2, 1, None), (2, 0, 1), (None, 1, 1), (10_000, 1, 1), (4, None, None)]
    docs = spark.createDataFrame([(d, t, lang, "s", 1, "f", 2, 3, "p") for d, t, lang in rows], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    hashed = (lambda text: (F.length(text) % 2).cast("long")) if collide else filter_audit._text_hash
    got = filter_audit.audit_filters(docs, marks, hashed=hashed).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in got} == plain_audit(rows, labels)
    assert len(got) == 600 * 4


def test_audit_empty(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(spark.createDataFrame([], DOCS), marks).count() == 0


def test_copies_in_a_hot_group(spark):
    """A third of all rows with one text: every row but those with the least id is a copy, whichever part it is dealt to."""
    rows = [(i, "the same" if i % 3 == 0 else f"text {i}", "en", "s", 1, "f", 2, 3, "p") for i in range(9000)]
    docs = spark.createDataFrame(rows, DOCS)
    cells = filter_audit.failure_combinations(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert sum(r["n"] for r in cells if r["bits"] & 16) == 2999 and sum(r["n"] for r in cells) == 9000


VECTORS = "vec_id long, embedding array<float>, label int, at long, v string, block int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 5, "c", 3) for i, v, label in rows], VECTORS)


def plain_negatives(rows, every, ratio=(80, 100), k=5):
    fine = [
        (n, i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for n, (i, v, label) in enumerate(rows)
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, i, label, v in fine:
        if i % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j, m, other) for m, j, other, w in fine if m != n)
        for s, positive, _, _ in [x for x in scores if x[3] == label][:k]:
            hard = [x for x in scores if x[3] != label and ratio[0] * -s <= ratio[1] * -x[0] <= ratio[1] * -s][:k]
            out += [(i, positive, r, x[1], -s, -x[0]) for r, x in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, every, block=hard_negatives.BLOCK):
    held = hard_negatives.labelled_vectors(vectors(spark, rows), F.col("label"))
    return sorted(tuple(r) for r in hard_negatives.mine(held, F.col("vec_id") % every == 0, block=block).collect())


def test_hard_negatives_equal_plain(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 24))
    rows = [(i, (base[i % 12] + rng.normal(scale=0.6, size=24)).tolist(), int(i % 4)) for i in range(700)]
    rows += [(i + 700, rows[i][1], rows[i][2]) for i in range(60)]  # ties
    rows += [rows[40], rows[40], rows[50]]  # repeated rows
    rows += [(2000, None, 1), (2001, [None] * 24, 1), (2002, [float("nan")] * 24, 1), (2003, [float("inf")] * 24, 1), (None, rows[0][1], 1), (2010, rows[0][1], None)]
    rows += [(2020, [0.5, 0.25, 4.0], 2), (2030, [], 3), (2040, [0.0] * 24, 1)]
    want = plain_negatives(rows, 10)
    assert len(want) > 150
    assert mined(spark, rows, 10) == want
    assert mined(spark, rows, 10, block=64) == want


def test_hard_negatives_odd_tables(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)], 10) == []  # no anchors
    assert mined(spark, [(10, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)], 10) == []  # no positives
    assert mined(spark, [(10, [1.0], 1), (2, [1.0], 1), (3, [-1.0], 2)], 10) == []  # no negatives in range
    assert mined(spark, [(10, [1.0], 1), (2, [1.0], 1), (3, [0.9], 2)], 10) == [(10, 2, 1, 3, 65536, 256 * 230)]


def test_segment_bounds_hold_and_prune():
    import pandas as pd

    rng = np.random.default_rng(4)
    centres = np.repeat(rng.normal(size=(40, 8)), 8, axis=1)  # vectors whose segments differ in their means
    x = np.floor(256 * (centres[rng.integers(0, 40, 4000)] + rng.normal(scale=0.05, size=(4000, 64)))).astype(np.int64)
    summaries = hard_negatives.Summaries(x)
    true = (x[:20] @ x.T).astype(float)
    for w, m, d in summaries.levels:
        middle, give = w * (m[:20] @ m.T), w * (d[:20] @ d.T)
        assert (np.abs(true - middle) <= give + 0.5 + 1e-6 * np.abs(true)).all()
    rows = pd.DataFrame({"at": np.arange(4000), "vec_id": np.arange(4000), "label": 0, "v": list(x)})
    search = hard_negatives.Search(5, True, True)
    found = search.found(hard_negatives.Block(rows[:32], 64), hard_negatives.Block(rows, 64))
    want = {(a, j) for a in range(32) for j in sorted((j for j in range(4000) if j != a), key=lambda j: (-int(x[a] @ x[j]), j))[:5]}
    assert set(zip(found["at"], found["vec_id"])) == want
    assert search.scored < 0.5 * search.pairs  # most pairs are ruled out by summaries


RULED = [
    ("http://a.org/x", "a.org", "/x", "org/", "allow"), ("http://ORG/x", "org", "/x", "org/", "allow"), ("http://x.example.org/es/7", "x.example.org", "/es/7", "example.org/es/", "block"),
    ("https://example.org/en/12?q=/fr/", "example.org", "/en/12", "example.org/en/1", "block"), ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("https://fakeexample.org/es/1", "fakeexample.org", "/es/1", "org/", "allow"), ("http://m.b.com/fr/", "m.b.com", "/fr/", "com/fr/", "allow"), ("http://b.com/de/#x", "b.com", "/de/", "com/de/", "block"),
    ("http://b.com/en/", "b.com", "/en/", None, None), ("http://b.org", "b.org", "", None, None), ("http://b.org?x=/y", "b.org", "", None, None), ("b.org/x", "", "", None, None),
    ("", "", "", None, None), (None, "", "", None, None), ("x://y://z.org/a", "y:", "//z.org/a", None, None), ("http://\n.org/\n?", "\n.org", "/\n", "org/", "allow"),
]
PAGES = "page_id long, url string, html string, host string, path string, at long, rule string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "x", "y", 3, "z") for i, u in enumerate(urls)], PAGES)


def plain_urls(urls):
    """Verdicts by dictionaries and loops."""
    import hashlib

    rows = []
    for url in urls:
        u = url or ""
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u)
        host, path = (m.group(1), m.group(2)) if m else ("", "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [r for r in url_filters.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fit, key=lambda r: len(r.name), default=None)
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in u)
        s = "\x02" * 5 + "".join(c if c in url_filters.SYMBOLS else "\x01" for c in low) + "\x03"
        aside = hashlib.md5(u.encode()).hexdigest()[0] in url_filters.ASIDE
        rows.append((host, path, rule, s, aside))
    counts = {"allow": Counter(), "block": Counter()}
    for _, _, rule, s, aside in rows:
        if rule and not aside:
            for i in range(5, len(s)):
                for k in range(6):
                    counts[rule.verdict][s[i - k : i], s[i]] += 1
    n = {v: Counter() for v in counts}
    for v, c in counts.items():
        for (ctx, _), m in c.items():
            n[v][ctx] += m
    seen = n["allow"] + n["block"]

    def p(v, ctx, c):
        lower = p(v, ctx[1:], c) if ctx else 1 / 71
        return (counts[v][ctx, c] + 4.0 * lower) / (n[v][ctx] + 4.0)

    def ratio(ctx, c):
        while len(ctx) > 1 and seen[ctx] < max(2.0, seen[""] / 4096) or ctx and not seen[ctx]:
            ctx = ctx[1:]
        return round(1e6 * (math.log(p("allow", ctx, c)) - math.log(p("block", ctx, c)))) if seen[""] else 0

    totals = [(sum(ratio(s[i - 5 : i], s[i]) for i in range(5, len(s))), len(s) - 5) for _, _, _, s, _ in rows]
    held = [(t // (m * url_filters.BIN), r[2].verdict) for (t, m), r in zip(totals, rows) if r[2] and r[4]]
    edges = {e for e, _ in held} | {e + 1 for e, _ in held}
    a, b = [e for e, v in held if v == "allow"], [e for e, v in held if v == "block"]
    quality = {e: sum(x < e for x in b) * len(a) - sum(x < e for x in a) * len(b) for e in edges}
    step = min(edges, key=lambda e: (-quality[e], abs(e), e)) if a and b else 0
    return [
        (host, path, rule and rule.name, rule.verdict if rule else "allow" if t >= m * step * url_filters.BIN else "block", t // m, step)
        for (host, path, rule, _, _), (t, m) in zip(rows, totals)
    ]


def test_rules(spark):
    got = {r["page_id"]: r for r in url_filters.filter_urls(pages(spark, [r[0] for r in RULED])).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(RULED):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), i
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")


def test_urls_equal_plain(spark):
    rng = random.Random(1)
    hosts = ["a.org", "b.example.org", "c.com", "d.net", "E.Net", "ü.com"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randrange(400)}{rng.choice(['', '.html', '?x=1', '#t', '/'])}" for _ in range(600)]
    urls += [r[0] for r in RULED] + urls[:50]
    got = url_filters.filter_urls(pages(spark, urls)).orderBy("page_id").collect()
    want = plain_urls(urls)
    assert [(r["host"], r["path"], r["rule"], r["verdict"], r["score"], r["threshold_step"]) for r in got] == want
    # urls of no rule score like those they look like
    scores = {u: w[4] for u, w in zip(urls, want) if u and "d.net/" in u}
    assert np.median([v for u, v in scores.items() if "/fr/" in u]) > 50_000 + np.median([v for u, v in scores.items() if "/de/" in u])


def test_urls_odd_tables(spark):
    assert url_filters.filter_urls(pages(spark, [])).count() == 0
    got = url_filters.filter_urls(pages(spark, [None, "x", "http://d.net/1"])).collect()  # no rule fits
    assert {(r["verdict"], r["score"], r["threshold_step"]) for r in got} == {("allow", 0, 0)}
    long = ["http://a.org/" + "x" * 1_000_000, "http://" + "a." * 100_000 + "com/de/" + "1" * 300_000, "é" * 500_000]
    got = {r["page_id"]: r["verdict"] for r in url_filters.filter_urls(pages(spark, long)).collect()}
    assert got[0] == "allow" and got[1] == "block"


UNBROKEN = {0: "a" * 1_000_000, 1: "host=a" + ".a" * 100_000, 2: "7" * 1_000_000, 3: "joe1@a" + ".a" * 100_000, 4: "a." * 300_000, 5: "AKIA" + "Z" * 500_000, 6: "%_" * 300_000 + "@x.org", 7: "token=" + "=" * 500_000}


def test_unbroken_runs_take_linear_time(spark):
    """One token of a million characters, a host of 100,000 labels, one long run of digits: seconds, and no overflow."""
    import time

    from tidegraph.llm import pseudonyms, secrets

    docs = spark.createDataFrame([(i, t, "en", "s", 1, "f", 2, 3, "p") for i, t in UNBROKEN.items()], DOCS)
    begin = time.time()
    spans = {r["doc_id"]: r for r in secrets.secret_report(secrets.secret_spans(docs)).collect()}
    assert spans[5]["n_access"] == 1 and spans[0]["n_hex"] == 1 and len(spans) == 8
    texts = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(docs, "key").collect()}
    assert texts[0] == UNBROKEN[0] and texts[2] == UNBROKEN[2] and len(texts[6]) == len(UNBROKEN[6])
    assert time.time() - begin < 120


def test_two_vectors_of_one_id_are_two_candidates(spark):
    from tidegraph.llm import cover_trees

    rng = np.random.default_rng(9)
    x = rng.normal(0, 0.3, (3000, 6)).round(2)
    rows = [(i // 2 * 2 if i % 10 == 1 else i, v.tolist(), 1) for i, v in enumerate(x)]  # ids with two vectors, in several blocks
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, pivot int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in cover_trees.top_inner_products(table, table.where("vec_id % 300 = 5"), 8).collect())
    whole = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v, _ in rows]
    want = []
    for q, v in whole:
        if q % 300 == 5:
            best = sorted((-int(v @ w), i) for i, w in whole if i != q)[:8]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
