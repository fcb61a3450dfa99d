"""The pipeline's stages on the smallest tables, each against a plain version on its own input."""

import hashlib
import re

import corpus_pipeline
from pyspark.sql import functions as F

from test_llm import plain_groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    steps = dict(corpus_pipeline.STAGES)
    good = steps["quality"](spark, docs, SF)
    kept = {r["doc_id"] for r in good.collect()}
    marked = [i for i, q in labels.items() if q == 1]
    assert good.columns == docs.columns and sum(i in kept for i in marked) >= 0.98 * len(marked)

    one = steps["exact_dedup"](spark, docs, SF).collect()
    assert len(one) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in docs.collect()})

    near = {r["doc_id"] for r in steps["near_dedup"](spark, docs, SF).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert near == {i for i, (_, least) in plain_groups(rows, 5, 0.8).items() if i == least}

    mixed = steps["mixing"](spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().where("count > 2").isEmpty()

    coded = steps["encoding"](spark, docs, SF).collect()
    texts = dict(rows)
    assert all(r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest() for r in coded)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.where(F.size("ids") != F.col("n_tokens")).isEmpty()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, file string, row long, digest string, _doc string, size long"


def test_stages_on_odd_tables(spark):
    """Nulls in every column, repeated rows, an unbroken long text, columns whose names clash with inner ones; and nothing at all."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    texts = [None, "", " \n ", "x" * 300_000, " ".join(words * 3), " ".join(words * 3), " ".join([*words * 3, "nu"]), "one two"]
    rows = [(i, t, None if i % 2 else "en", None if i % 3 == 0 else f"s{i % 3}", None, "f", 3, None, "d", 1) for i, t in enumerate(texts)]
    rows += [rows[4], (None, "no id", None, None, None, None, None, None, None, None)]
    odd = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        got, nothing = stage(spark, odd, SF), stage(spark, none, SF)
        assert nothing.columns == got.columns and nothing.isEmpty(), name
        if name != "encoding":
            assert got.columns == odd.columns
        found = sorted(str(r["doc_id"]) for r in got.collect())
        if name == "exact_dedup":
            assert found == ["0", "2", "3", "4", "6", "7", "None"]
        if name == "near_dedup":
            assert found == ["0", "1", "2", "3", "4", "4", "7", "None"]
        if name == "encoding":
            assert len(found) == len(rows)
