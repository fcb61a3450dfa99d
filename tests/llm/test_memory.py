"""What workers and tasks of the pipeline hold stays bounded."""

import random
from fractions import Fraction

import public_tokenizers
import pytest

from tidegraph.llm import bpe, near_dedup, quality
from test_llm import plain_groups

DOCS = "doc_id {}, text string"


def test_token_cache_of_a_worker():
    """Workers live on through later stages, so what the classifier's cache holds is taken from these."""
    texts = [" ".join(f"w{i}" for i in range(k, k + 5000)) for k in range(0, 150_000, 5000)]
    found = [quality.features(t) for t in texts]
    assert len(quality._TOKENS) <= 70_000
    quality._TOKENS.clear()
    for text, (ids, values) in zip(texts[::-1], found[::-1], strict=True):
        again = quality.features(text)
        assert (again[0] == ids).all() and (again[1] == values).all()


def test_word_cache_of_a_worker():
    """One long text or many: the cache never has more words than its limit, and ids are those of single words."""
    tokens = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    codec = bpe.Codec(bpe.sentencepiece_model(tokens), tokens, public_tokenizers.PATTERN)
    long = " ".join(f"w{'abcdefghij'[i % 10]}{i:x}" for i in range(120_000))
    ids = [i for part in codec.encode(long) for i in part]
    assert codec.decode(ids) == long.encode() and len(codec.known) <= 70_000
    cut = long.index(" ", 400_000)
    assert ids == [i for half in (long[:cut], long[cut:]) for part in codec.encode(half) for i in part]


def test_tasks_that_make_bucket_rows(spark, monkeypatch):
    """Nodes of one small file are dealt to tasks by number, and the rows of buckets are summed without a sort."""
    monkeypatch.setattr(near_dedup, "NODES", 50)
    nodes = spark.range(1000).selectExpr("id as node", "array(id % 7, 1000 + id) as bands").coalesce(1)
    buckets = near_dedup._buckets(nodes, 1000)
    sizes = [r["count"] for r in buckets.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 4 * 50
    centres = near_dedup._centres(buckets)
    assert "SortAggregate" not in centres._jdf.queryExecution().toString()
    want = {**{k: (k, len(range(k, 1000, 7))) for k in range(7)}, **{1000 + i: (i, 1) for i in range(1000)}}
    assert {r["key"]: (r["centre"], r["m"]) for r in centres.collect()} == want


@pytest.mark.parametrize("kind", ["long", "string"])
def test_groups_of_dealt_nodes(spark, monkeypatch, kind):
    """Groups as by the plain version, repeated and null ids included, with nodes in many tasks; ids that are text too."""
    monkeypatch.setattr(near_dedup, "NODES", 16)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = rng.sample(words, 60)
        for k in range(6):
            text = list(base)
            for _ in range(k % 4):
                text[rng.randrange(60)] = rng.choice(words)
            rows.append((g * 6 + k + 100, " ".join(text)))
    rng.shuffle(rows)
    turned = [(i if kind == "long" else str(i), t) for i, t in rows]
    docs = spark.createDataFrame([*turned, turned[5], (None, rows[7][1]), (turned[9][0], turned[9][1])], DOCS.format(kind))
    got = near_dedup.near_groups(docs, 3, Fraction(8, 10)).where("doc_id is not null").collect()
    want = plain_groups(turned, 3, 0.8)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: least for i, (_, least) in want.items()}
    assert len(got) == len(rows) + 2
