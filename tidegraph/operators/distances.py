"""Shortest-path distances of keyed graphs, all pairs or from listed sources.

Two ways, both exact. A search from 64 sources at a time holds one bit a source and writes only the frontier of each
distance; it needs a job for each distance. Graphs on which it has not ended after ``PATIENCE`` distances are long and
thin, and are solved by elimination: nodes with at most two neighbours are taken out in independent sets, an edge between
the two neighbours carries the length of the way through them, so a chain shrinks by a constant share in each round and the
number of rounds grows with the logarithm of the graph. What is left is solved by relaxation; the way back down gives each
node taken out the lesser of its neighbours' distances plus the edge, 64 sources in one array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.core import KEYS, cut, cut_counted
from tidegraph.layout import attach, ordered_position

WIDTH = 64
PATIENCE = 32
THIN = 4  # a graph is thin when at most one node in THIN is left after elimination
CHAIN = 4  # steps without a table in between


def arcs_of(edges: DataFrame, keys, source="src", target="dst") -> DataFrame:
    """Both directions of simple edges."""
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(*keys, F.explode(both).alias("_e")).select(*keys, F.col("_e.src").alias(source), F.col("_e.dst").alias(target))


def numbered(sources: DataFrame, keys) -> DataFrame:
    """(keys, node, batch, bit) of the listed sources."""
    placed = ordered_position(sources.select(*keys, "node"), ["node"], keys=keys, name="_pos")
    return cut(placed.select(*keys, "node", F.floor(F.col("_pos") / WIDTH).alias("batch"), (F.col("_pos") % WIDTH).cast("int").alias("bit")))


def least_arrays(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Least value at each place over the rows of a group; NULL where no row has one."""
    return rows.groupBy(*by).agg(F.array(*[F.min(F.get("d", F.lit(i))) for i in range(WIDTH)]).alias("d"))


def _plus(d: str, w: str) -> Column:
    return F.transform(d, lambda x: x + F.col(w))


class BitSearch:
    """Breadth-first search, one bit a source. A neighbour of distance d lies at distance d - 1, d or d + 1, so the last
    two frontiers tell which bits are new."""

    def __init__(self, arcs: DataFrame, start: DataFrame, keys):
        self.keys, self.arcs, self.by = tuple(keys), arcs, (*keys, "batch", "node")
        self.now = start.select(*self.by, F.expr("shiftleft(1L, bit)").alias("front"))
        self.before, self.levels, self.open = self.now.where(F.lit(False)), [], True

    def step(self) -> None:
        sent = self.now.join(self.arcs, [*self.keys, "node"]).groupBy(*self.keys, "batch", "dst").agg(F.bit_or("front").alias("got"))
        old = self.now.unionByName(self.before).groupBy(*self.by).agg(F.bit_or("front").alias("old"))
        met = sent.withColumnRenamed("dst", "node").join(old, list(self.by), "left")
        fresh = F.col("got").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
        new, rows = cut_counted(met.select(*self.by, fresh.alias("front")).where(F.col("front") != 0))
        self.before, self.now = self.now, new
        self.levels.append(new)
        self.open = rows > 0

    def run(self, most: int | None = None) -> None:
        done = 0
        while self.open and (most is None or done < most):
            self.step()
            done += 1

    def keep(self, chosen: DataFrame, how: str) -> None:
        self.levels = [level.join(chosen, list(self.keys), how) for level in self.levels]
        self.now, self.before = self.now.join(chosen, list(self.keys), how), self.before.join(chosen, list(self.keys), how)

    def found(self) -> DataFrame:
        """(keys, batch, node, front, d) of all distances so far."""
        out = self.now.where(F.lit(False)).withColumn("d", F.lit(0))
        for d, level in enumerate(self.levels, 1):
            out = out.unionByName(level.withColumn("d", F.lit(d)))
        return out


def eliminate(arcs: DataFrame, keys, max_rounds: int = 500) -> tuple[list[DataFrame], DataFrame]:
    """(levels, arcs left). A level is an independent set of nodes with one or two neighbours at its time: (keys, node, a,
    wa, b, wb). ``arcs``: (keys, u, v, w), both directions."""
    keys, levels, set_aside = tuple(keys), [], []
    for turn in range(max_rounds):
        ends = arcs.groupBy(*keys, "u").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("v", "w")).alias("a"), F.max(F.struct("v", "w")).alias("b"))
        second = F.when(F.col("n") == 2, F.col("b"))
        low = ends.where("n <= 2").select(
            *keys, F.col("u").alias("node"), F.col("a.v").alias("a"), F.col("a.w").alias("wa"), second["v"].alias("b"), second["w"].alias("wb"),
            F.struct(F.xxhash64("u", F.lit(turn)).alias("h"), F.col("u").alias("node")).alias("rank"),
        )
        heard = low.select(*keys, F.explode(F.array("a", "b")).alias("node"), "rank").where("node IS NOT NULL").groupBy(*keys, "node").agg(F.min("rank").alias("least"))
        chosen = low.join(heard, [*keys, "node"], "left").where(F.col("least").isNull() | (F.col("rank") < F.col("least")))
        chosen, n = cut_counted(chosen.select(*keys, "node", "a", "wa", "b", "wb"))
        if n == 0:
            break
        levels.append(chosen)

        def arc(u: str, v: str, w: Column, out: Column):
            return F.struct(F.col(u).alias("u"), F.col(v).alias("v"), w.alias("w"), out.alias("out"))

        none, yes, no = F.lit(None).cast("int"), F.lit(True), F.lit(False)
        through = F.col("wa") + F.col("wb")
        changes = F.array(
            arc("node", "a", none, yes), arc("a", "node", none, yes), arc("node", "b", none, yes), arc("b", "node", none, yes),
            arc("a", "b", through, no), arc("b", "a", through, no),
        )
        changes = chosen.select(*keys, F.explode(changes).alias("c")).select(*keys, "c.*").where("u IS NOT NULL AND v IS NOT NULL")
        merged = arcs.withColumn("out", F.lit(False)).unionByName(changes).groupBy(*keys, "u", "v").agg(F.min("w").alias("w"), F.max("out").alias("out"))
        arcs = cut(merged.where(~F.col("out")).drop("out"))
        if turn % 3 == 2:  # graphs that hardly shrink are left as they are
            taken = chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
            busy = arcs.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).join(taken, list(keys)).where(F.col("k") * 24 >= F.col("m"))
            busy = cut(busy.select(*keys))
            set_aside.append(arcs.join(busy, list(keys), "left_anti"))
            arcs = cut(arcs.join(busy, list(keys), "left_semi"))
    for part in set_aside:
        arcs = arcs.unionByName(part)
    return levels, cut(arcs)


class Eliminated:
    """Distances on long, thin graphs. ``nodes``, ``arcs``: all nodes and weighted arcs of the graphs."""

    def __init__(self, nodes: DataFrame, levels: list[DataFrame], core_arcs: DataFrame, keys):
        self.nodes, self.levels, self.core_arcs, self.keys = nodes, levels, core_arcs, tuple(keys)

    def seeds(self, sources: DataFrame) -> DataFrame:
        """(keys, batch, bit, node, d): distances from a source upwards to nodes taken out later."""
        by = (*self.keys, "batch", "bit", "node")
        found = sources.select(*by, F.lit(0).alias("d"))
        for i, level in enumerate(self.levels, 1):
            met = found.join(level, [*self.keys, "node"], "left")
            ways = F.array(F.struct("node", "d"), F.struct(F.col("a").alias("node"), (F.col("d") + F.col("wa")).alias("d")), F.struct(F.col("b").alias("node"), (F.col("d") + F.col("wb")).alias("d")))
            found = met.select(*by[:-1], F.explode(ways).alias("s")).select(*by[:-1], "s.*").where("node IS NOT NULL").groupBy(*by).agg(F.min("d").alias("d"))
            if i % CHAIN == 0:
                found = cut(found)
        return cut(found)

    def vectors(self, sources: DataFrame) -> DataFrame:
        """(keys, batch, node, d): distances of a node to the 64 sources of a batch, NULL where there is no way."""
        keys, by = list(self.keys), (*self.keys, "batch", "node")
        one_hot = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.when(i == F.col("bit"), F.col("d")))
        seeds = self.seeds(sources).select(*by, one_hot.alias("d"))
        spans = sources.groupBy(*keys).agg(F.max("batch").alias("_top"))
        spans = cut(spans.join(self.nodes.groupBy(*keys).agg(F.max("node").alias("_last")), keys))
        taken = self.levels[0].select(*keys, "node")
        for level in self.levels[1:]:
            taken = taken.unionByName(level.select(*keys, "node"))
        core = cut(least_arrays(seeds.join(taken, [*keys, "node"], "left_anti"), by))
        loops = core.select(*keys, F.col("node").alias("u")).unionByName(self.core_arcs.select(*keys, "u")).distinct()
        both = cut(self.core_arcs.unionByName(loops.select(*keys, "u", F.col("u").alias("v"), F.lit(0).alias("w"))))
        mark = None
        while not self.core_arcs.isEmpty():
            for _ in range(CHAIN):
                sent = core.withColumnRenamed("node", "u").join(both, [*keys, "u"])
                core = least_arrays(sent.select(*keys, "batch", F.col("v").alias("node"), _plus("d", "w").alias("d")), by)
            core = cut(core)
            total = F.sum(F.aggregate("d", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0))).cast("decimal(38,0)"))
            now = core.agg(total, F.sum(F.size(F.filter("d", lambda x: x.isNotNull()))), F.count(F.lit(1))).first()
            if now == mark:  # distances only fall, and what has one keeps one
                break
            mark = now
        known = core
        for level in reversed(self.levels):
            to = F.array(F.struct(F.col("a").alias("to"), F.col("wa").alias("w")), F.struct(F.col("b").alias("to"), F.col("wb").alias("w")))
            asks = attach(level, spans, keys=self.keys, t="node").select(*keys, "node", "_top", F.explode(to).alias("s")).where("s.to IS NOT NULL")
            asks = asks.select(*keys, "node", "s.to", "s.w", F.explode(F.sequence(F.lit(0).cast("long"), "_top")).alias("batch"))
            got = asks.join(known.withColumnRenamed("node", "to"), [*keys, "batch", "to"]).select(*by, _plus("d", "w").alias("d"))
            own = seeds.join(level.select(*keys, "node"), [*keys, "node"], "left_semi")
            known = known.unionByName(cut(least_arrays(got.unionByName(own.select(*by, "d")), by)))
        return known


class Distances:
    """Distances from ``sources`` (keys, node) to all nodes of their graphs; by default from all nodes."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, *, keys=KEYS, patience: int = PATIENCE):
        self.keys, self.all = tuple(keys), sources is None
        self.sources = numbered(nodes if sources is None else sources, keys)
        arcs = cut(arcs_of(edges, keys, "node", "dst"))
        self.search = BitSearch(arcs, self.sources, keys)
        self.search.run(patience)
        self.vectors = None
        if self.search.open:
            slow = cut(self.search.now.select(*keys).distinct())
            some = nodes.select(*keys, "node").join(slow, list(keys), "left_semi")
            weighted = arcs.join(slow, list(keys), "left_semi").select(*keys, F.col("node").alias("u"), F.col("dst").alias("v"), F.lit(1).alias("w"))
            levels, left = eliminate(weighted, keys)
            if levels:
                taken = levels[0].select(*keys)
                for level in levels[1:]:
                    taken = taken.unionByName(level.select(*keys))
                sizes = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(taken.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")), list(keys))
                thin = cut(sizes.where(F.col("k") * THIN >= F.col("n") * (THIN - 1)).select(*keys))
                only = lambda df: df.join(thin, list(keys), "left_semi")
                self.vectors = Eliminated(cut(only(some)), [only(level) for level in levels], cut(only(left)), keys).vectors(only(self.sources))
                self.search.keep(thin, "left_anti")
            self.search.run()

    def counts(self) -> DataFrame:
        """(keys, source, d, cnt): how many nodes lie at distance d >= 1 from each source."""
        bits = [F.sum(F.shiftrightunsigned("front", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(WIDTH)]
        sums = self.search.found().groupBy(*self.keys, "batch", "d").agg(*bits)
        per = sums.select(*self.keys, "batch", "d", F.posexplode(F.array(*[f"b{b}" for b in range(WIDTH)])).alias("bit", "cnt")).where("cnt > 0")
        if self.vectors is not None:
            each = self.vectors.select(*self.keys, "batch", F.posexplode("d").alias("bit", "d")).where("d > 0")
            per = per.unionByName(each.groupBy(*self.keys, "batch", "d", "bit").agg(F.count(F.lit(1)).alias("cnt")))
        return per.join(self.sources.withColumnRenamed("node", "source"), [*self.keys, "batch", "bit"]).select(*self.keys, "source", "d", "cnt")

    def sums(self) -> DataFrame:
        """(keys, node, reached, total, far): number, sum and greatest of the distances from each source to other nodes
        it reaches; 0, 0, 0 for a source alone."""
        names = [F.sum("cnt").alias("reached"), F.sum(F.col("d") * F.col("cnt")).alias("total"), F.max("d").alias("far")]
        short = self.search.found()
        bits = [F.sum(F.shiftrightunsigned("front", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(WIDTH)]
        level = short.groupBy(*self.keys, "batch", "d").agg(*bits).select(*self.keys, "batch", "d", F.posexplode(F.array(*[f"b{b}" for b in range(WIDTH)])).alias("bit", "cnt"))
        level = level.where("cnt > 0").groupBy(*self.keys, "batch", "bit").agg(*names)
        out = level.join(self.sources, [*self.keys, "batch", "bit"]).select(*self.keys, "node", "reached", "total", "far")
        if self.vectors is not None and self.all:  # distances are the same both ways: a node's own arrays hold them
            some = F.filter("d", lambda x: x > 0)
            parts = self.vectors.select(
                *self.keys, "node", F.size(some).cast("long").alias("reached"), F.aggregate(some, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.array_max(some).alias("far")
            )
            out = out.unionByName(parts.groupBy(*self.keys, "node").agg(F.sum("reached").alias("reached"), F.sum("total").alias("total"), F.max("far").alias("far")))
        elif self.vectors is not None:
            each = self.vectors.select(*self.keys, "batch", F.posexplode("d").alias("bit", "d")).where("d > 0")
            each = each.groupBy(*self.keys, "batch", "bit").agg(F.count(F.lit(1)).alias("reached"), F.sum("d").alias("total"), F.max("d").alias("far"))
            out = out.unionByName(each.join(self.sources, [*self.keys, "batch", "bit"]).select(*self.keys, "node", "reached", "total", "far"))
        return self.sources.select(*self.keys, "node").join(out, [*self.keys, "node"], "left").select(
            *self.keys, "node", F.coalesce("reached", F.lit(0).cast("long")).alias("reached"), F.coalesce("total", F.lit(0).cast("long")).alias("total"), F.coalesce("far", F.lit(0)).alias("far")
        )

    def pairs(self) -> DataFrame:
        """(keys, source, node, d), the source itself included; for a few sources a graph."""
        places = F.filter(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda b: F.expr("front").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b)) != 0)
        each = self.search.found().select(*self.keys, "batch", "node", "d", F.explode(places).alias("bit"))
        if self.vectors is not None:
            each = each.unionByName(self.vectors.select(*self.keys, "batch", "node", F.posexplode("d").alias("bit", "d")).where("d > 0").select(each.columns))
        own = self.sources.select(*self.keys, F.col("node").alias("source"), "node", F.lit(0).alias("d"))
        named = each.join(self.sources.withColumnRenamed("node", "source"), [*self.keys, "batch", "bit"])
        return named.select(*self.keys, "source", "node", "d").unionByName(own)
