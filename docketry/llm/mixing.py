"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the sorted set of sources that a
document belongs to). Each pattern offers its words once for nothing and again at rising
cost per repetition; each source demands its target. The flow of least cost, solved on the
driver over the patterns (not the documents; 50,000 overlapping ones take seconds), decides how
many words of each pattern the mix takes, and seeded documents of the pattern are then
selected: all of them `full` times, and those that come first by seeded digest once more.

Targets: sources in code-point order, null last, get weights in turn and share all words
in proportion; a target stops at `limit` times its source's words and the excess is
shared again by weight until none is above.

Defined cases: a null source is a source of its own; a null or wordless text has size 0
and takes 0; a text of any length counts whole; rows that share a key are rows of their own (ties fall by key, then size);
no sources, no rows. Only the named columns are read.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.base import materialize, word_count

#: Weights of the sources, in turn.
WEIGHTS = (1, 2, 3)
#: No document is taken more often than this.
LIMIT = 3
#: Cost of a word's first, second and third use: convex.
COSTS = (0, 1, 3)
#: From more sources than this on, a table of single sources is solved without the flow (to
#: the same end), and from more patterns on, the plan is not broadcast.
MAX_PATTERNS = 50_000


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """sizes: source, source_size. Adds rank, weight and target, one row per source.

    The capped sources are those first in order of size / weight, so two running sums
    over the table of sources find them without repeated rounds.
    """
    exact = "decimal(38,0)"
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    least_common = 1
    for w in weights:
        least_common *= w
    order = Window.orderBy((F.col("source_size") * (F.lit(least_common) / F.col("weight")).cast("long")).cast(exact), "rank")
    earlier, onward, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    cap = (F.col("source_size") * limit).cast(exact)
    summed = ranked.select(
        "*",
        F.sum(F.col("source_size")).over(every).alias("total"),
        F.coalesce(F.sum(F.col("source_size") * limit).over(earlier), F.lit(0)).alias("capped_before"),
        F.sum("weight").over(onward).alias("weight_left"),
    )
    rest = (F.col("total") - F.col("capped_before")).cast("decimal(24,0)")
    summed = summed.withColumn("capped", F.col("source_size").cast("decimal(24,0)") * (F.col("weight_left") * limit).cast("decimal(12,0)") <= F.col("weight").cast("decimal(12,0)") * rest)
    open_ = summed.select(
        "source", "source_size", "rank", "weight", "total", "capped",
        F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size") * limit)).over(every), F.lit(0)).alias("capped_size"),
        F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every).alias("open_weight"),
    )
    share = F.col("weight") * (F.col("total") - F.col("capped_size")).cast("double") / F.col("open_weight").cast("double")
    return open_.select("source", "source_size", "rank", "weight", F.when(F.col("capped"), cap.cast("double")).otherwise(share).alias("target"))


class Flow:
    """Maximum flow by blocking flows (Dinic), on arrays; capacities may grow between runs."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.left: list[int] = []  # of arc i; its reverse is i ^ 1

    def arc(self, a: int, b: int, capacity: int) -> int:
        self.arcs[a].append(len(self.head))
        self.arcs[b].append(len(self.head) + 1)
        self.head += (b, a)
        self.left += (capacity, 0)
        return len(self.head) - 2

    def _levels(self, source: int) -> list[int]:
        level, layer, depth = [-1] * len(self.arcs), [source], 0
        level[source] = 0
        while layer:
            depth += 1
            ahead = []
            for node in layer:
                for i in self.arcs[node]:
                    if self.left[i] and level[self.head[i]] < 0:
                        level[self.head[i]] = depth
                        ahead.append(self.head[i])
            layer = ahead
        return level

    def run(self, source: int, sink: int) -> None:
        head, left = self.head, self.left
        while (level := self._levels(source))[sink] >= 0:
            tried, path, node = [0] * len(self.arcs), [], source
            while True:
                if node == sink:
                    pushed = min(left[i] for i in path)
                    for k, i in enumerate(path):
                        left[i] -= pushed
                        left[i ^ 1] += pushed
                    k = next(k for k, i in enumerate(path) if not left[i])  # go on from before the first full arc
                    node = head[path[k] ^ 1]
                    del path[k:]
                    continue
                own, at = self.arcs[node], tried[node]
                while at < len(own) and not (left[own[at]] and level[head[own[at]]] == level[node] + 1):
                    at += 1
                tried[node] = at
                if at < len(own):
                    path.append(own[at])
                    node = head[own[at]]
                elif path:
                    node = head[path.pop() ^ 1]
                    tried[node] += 1
                else:
                    break


def least_cost_flow(patterns: dict, quotas: dict, costs: Sequence[int] = COSTS) -> dict:
    """Words that each pattern sends to each of its sources.

    patterns: {name: (words, [sources])}; each pattern has one arc per use of its words,
    at costs[use] (ascending). quotas: {source: words}. Among flows that fill most of the
    quotas, cost is least. Costs stand only on the arcs that enter patterns, and are the same
    for all, so shortest augmenting paths come in order of the use they enter by: one maximum
    flow for each use, on what the ones before have left, is the whole method. Returns
    {name: {source: words}}.
    """
    if list(costs) != sorted(costs):
        raise ValueError("costs must not fall")
    names, sources = list(patterns), list(quotas)
    place = {s: 2 + len(names) + i for i, s in enumerate(sources)}
    flow = Flow(2 + len(names) + len(sources))
    enter, routes = [], []
    for i, name in enumerate(names):
        words, own = patterns[name]
        enter.append(flow.arc(0, 2 + i, 0))
        routes.append({s: flow.arc(2 + i, place[s], words * len(costs)) for s in own})
    for s, quota in quotas.items():
        flow.arc(place[s], 1, quota)
    for _ in costs:
        for i, name in enumerate(names):
            flow.left[enter[i]] += patterns[name][0]
        flow.run(0, 1)
    return {name: {s: flow.left[x ^ 1] for s, x in by.items() if flow.left[x ^ 1]} for name, by in zip(names, routes, strict=True)}


def bin_digits(rows: int) -> int:
    """Hex digits of a digest that name about as many bins as the root of the rows."""
    return max(1, -(-(rows.bit_length() // 2) // 4))


def seeded(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(f":{seed}")))


def apart_plan(sums: DataFrame, quotas: DataFrame, costs: Sequence[int]) -> DataFrame:
    """The flow where every pattern is one source: as many of its words as the quota asks
    for, at most one use for each cost. sums: _pattern, words. quotas: source, quota."""
    asked = quotas.select(F.to_json(F.array("source")).alias("_p"), "quota")
    words = sums.groupBy(F.col("_pattern").alias("_p")).agg(F.sum("words").alias("_words")).join(asked, "_p", "left")
    taken = F.least(F.coalesce("quota", F.lit(0)), F.col("_words") * len(costs))
    some = F.col("_words") > 0
    full = F.when(some, F.expr("_taken div _words")).otherwise(0).cast("int")
    return words.withColumn("_taken", taken).select("_p", full.alias("_full"), F.when(some, F.col("_taken") % F.col("_words")).otherwise(0).cast("long").alias("_rest"))


def mix(docs: DataFrame, membership: Column, quotas: dict | DataFrame, key: str = "doc_id", size: Column | str = "size", seed: int = 7, costs: Sequence[int] = COSTS) -> DataFrame:
    """`_row` (all columns of docs) and `copies`: how often the mix takes each row.

    membership: an array of the source names that a row belongs to (null: none).
    quotas: {source name: words}; a None name is kept. A table (source, quota) instead is
    for any number of sources, where each row belongs to one at most. docs is read more than once, so
    it should be a table. In each pattern, rows come in the order of a seeded digest; the
    pattern's words are summed by bins of that digest (about as many as the root of the
    number of rows), which finds the bin where the flow runs out, and only that bin's rows
    are summed one by one.
    """
    spark = docs.sparkSession
    digits = bin_digits(docs.count())
    rows = docs.select(
        F.struct("*").alias("_row"),
        F.col(key).alias("_key"),
        (F.col(size) if isinstance(size, str) else size).cast("long").alias("_size"),
        F.coalesce(F.to_json(F.array_sort(F.array_distinct(membership))), F.lit("[]")).alias("_pattern"),
        seeded(key, seed).alias("_digest"),
    ).withColumn("_bin", F.substring("_digest", 1, digits))
    sums = materialize(rows.groupBy("_pattern", "_bin").agg(F.sum("_size").alias("words")), "mix-bins")
    if isinstance(quotas, DataFrame):
        if sums.where(F.size(F.from_json("_pattern", "array<string>")) > 1).limit(1).count():
            raise ValueError("a table of quotas needs rows of one source each")
        wanted, small = materialize(apart_plan(sums, quotas, costs), "mix-plan"), lambda frame: frame
    else:
        listed = sums.groupBy("_pattern").agg(F.sum("words").alias("words")).collect()
        patterns = {r["_pattern"]: (int(r["words"]), [s for s in json.loads(r["_pattern"]) if s in quotas]) for r in listed}
        small = F.broadcast if len(patterns) <= MAX_PATTERNS else lambda frame: frame
        flow = least_cost_flow(patterns, quotas, costs)
        plan = []
        for name, (words, _) in patterns.items():
            taken = sum(flow[name].values())
            full, rest = divmod(taken, words) if words else (0, 0)
            plan.append((name, int(full), int(rest)))
        wanted = small(spark.createDataFrame(plan, "_p string, _full int, _rest long"))  # one row per pattern
    running = Window.partitionBy("_pattern").orderBy("_bin")
    edges = (
        sums.join(wanted, F.col("_pattern") == F.col("_p"))
        .withColumn("_upto", F.sum("words").over(running))
        .where((F.col("_rest") > 0) & (F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("words") < F.col("_rest")))
        .select("_p", F.col("_bin").alias("_edge"), (F.col("_upto") - F.col("words")).alias("_before"))
    )
    plans = wanted.join(edges, "_p", "left")
    planned = rows.join(small(plans), F.col("_pattern") == F.col("_p"))
    at_edge = F.coalesce(F.col("_bin") == F.col("_edge"), F.lit(False))
    clear = planned.where(~at_edge).withColumn("_more", F.coalesce(F.col("_bin") < F.col("_edge"), F.lit(False)))
    one_by_one = Window.partitionBy("_pattern").orderBy("_digest", "_key", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("_before") + F.sum("_size").over(one_by_one) - F.col("_size")
    close = planned.where(at_edge).withColumn("_more", (start < F.col("_rest")) & (start * 2 + F.col("_size") <= F.col("_rest") * 2))
    return clear.unionByName(close).select("_row", (F.col("_full") + F.col("_more").cast("int")).alias("copies"))


def source_targets(rows: DataFrame, source: str, size: Column, weights: Sequence[int], limit: int) -> tuple[DataFrame, dict | DataFrame]:
    """Table of the sources' sizes and targets, and the targets in whole words: a table too
    from more than MAX_PATTERNS sources on."""
    by = materialize(targets(rows.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size")), weights, limit), "mix-targets")
    listed = by.select("source", "target").limit(MAX_PATTERNS + 1).collect()
    if len(listed) > MAX_PATTERNS:
        return by, by.select("source", F.bround("target").cast("long").alias("quota"))
    return by, {r["source"]: round(r["target"]) for r in listed}


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, limit: int = LIMIT, seed: int = 7) -> DataFrame:
    """key, size, source_size, target, taken, copies and source for every row of docs.

    size is the number of words. Each source is a pattern of its own here; `mix` takes
    overlapping ones. Sources' sizes are summed before they are shuffled, so a hot source
    costs no more than another.
    """
    rows = materialize(docs.select(F.col(key).alias("key"), F.col(source).alias("own"), word_count(F.col(text)).alias("size")), "mix-sizes")
    by, quotas = source_targets(rows, "own", F.col("size"), weights, limit)
    mixed = mix(rows, F.array("own"), quotas, "key", "size", seed, COSTS[:limit]).select("_row.*", "copies")
    return mixed.join(F.broadcast(by) if isinstance(quotas, dict) else by, mixed["own"].eqNullSafe(by["source"])).select(
        F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", F.col("own").alias(source)
    )


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, limit: int = LIMIT, seed: int = 7) -> DataFrame:
    """The rows of the mix, all columns of docs: each row as often as the mix takes it."""
    size = word_count(F.col(text))
    quotas = source_targets(docs, source, size, weights, limit)[1]
    mixed = mix(docs, F.array(source), quotas, key, size, seed, COSTS[:limit])
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("_row.*")
