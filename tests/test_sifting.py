import random

from pyspark.sql import functions as F
from test_packed import jobs_of

from tidegraph.operators import decompose as DC
from tidegraph.operators import sifting
from tidegraph.plans.inputs import user_graph


def odd_series(spark):
    """Series of many lengths with flat stretches, NULLs, a NaN and an infinity; one is constant, one all NULL."""
    draw, rows = random.Random(5), []
    for k in range(20):
        for t in range(draw.choice([1, 2, 3, 30, 200])):
            v = draw.choice([draw.gauss(0, 1), float(draw.randint(0, 3))])
            v = None if k == 14 or (k % 7 == 3 and draw.random() < 0.1) else 1.1 if k == 13 else v
            rows.append((f"s{k}", t, float("nan") if (k, t) == (11, 1) else float("inf") if (k, t) == (12, 0) else v))
    return spark.createDataFrame(rows, "series_id string, t long, x double")


def test_whole_series_are_sifted_in_bounded_tasks(spark, monkeypatch):
    """The same values as by windows, in few jobs and in tasks whose rows do not grow with the table."""
    df = odd_series(spark)
    got, jobs = jobs_of(spark, "sift", lambda: DC.sift(df, 3, 2).collect())
    assert jobs <= 8, jobs
    by_windows = DC.sift(df, 3, 2, block=150).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, by_windows)) and len({r.component for r in got}) == 4
    monkeypatch.setattr(sifting, "SLICE", 20)
    state = df.select("series_id", "t", F.col("x").alias("_r"), F.lit(3).alias("_most"), F.lit(2).alias("_passes"))
    assert sifting.sift_series(state, ["series_id"], "t", 400, DC.FLAT, DC.RESIDUAL).rdd.getNumPartitions() == 20


def test_user_graph_needs_one_order(spark, tmp_path):
    """Edges are found among the nodes themselves: no second sort of all rows, no joins from positions to nodes."""
    draw = random.Random(3)
    rows = [(i, None if i % 31 == 0 else i % 3, draw.choice("ab") if i % 17 else None, i // 2, draw.choice([None, 1.0, 2.0, 3.0, 4.0])) for i in range(200)]
    kinds = "event_id long, user_id long, event_type string, sec long, value double"
    events = spark.createDataFrame(rows, kinds).withColumn("ts", F.timestamp_seconds("sec").cast("timestamp_ntz")).drop("sec")
    events.write.parquet(f"{tmp_path}/events.parquet")
    (nodes, edges), jobs = jobs_of(spark, "user graph", lambda: user_graph(spark, str(tmp_path)))
    assert jobs <= 15, jobs
    want_nodes, want_edges = set(), set()
    for user in range(3):
        own = [r for r in rows if r[1] == user]
        want_nodes |= {(str(user), i) for i, r in enumerate(own) if r[2] is not None}
        for kind in "ab":
            seen = [(i, r[4]) for i, r in enumerate(own) if r[2] == kind and r[4] is not None]
            for a, (i, x) in enumerate(seen):
                for b in range(a + 1, len(seen)):
                    if all(z < min(x, seen[b][1]) for _, z in seen[a + 1 : b]):
                        want_edges.add((str(user), i, seen[b][0]))
    assert {tuple(r) for r in nodes.collect()} == want_nodes
    assert sorted(tuple(r) for r in edges.collect()) == sorted(want_edges)
