"""Mixing sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_RE, materialize, table

#: Up to so many patterns, their plan is broadcast; more are joined by shuffle.
BROADCAST_PATTERNS = 100_000
#: Slices of the seeded order in which the documents' sizes are summed.
SLICES = 4096


def target_sizes(sizes: list[int], weights: list[float], share: float, most: float, total: int | None = None) -> list[float]:
    """Split share of total (by default of all sizes) by weight; a target stops at most times its size, the excess is shared anew."""
    target = [0.0] * len(sizes)
    left, free = share * (sum(sizes) if total is None else total), list(range(len(sizes)))
    while free and left > 0:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = most * sizes[i]
        left -= sum(target[i] for i in over)
        gone = set(over)
        free = [i for i in free if i not in gone]
    return target


def route(patterns: list[tuple[int, ...]], sizes: list[int], quotas: list[int], repeats: int) -> list[dict[int, int]]:
    """Words that each pattern gives to each of its sources: a maximum flow of least cost.

    A pattern's k-th pass over its documents costs k a word (convex), so that repeats come only where needed.
    Successive shortest paths over source -> pattern passes -> quotas.
    """
    n_p, n_s = len(patterns), len(quotas)
    start, end, first_s = n_p + n_s, n_p + n_s + 1, n_p
    to, cap, cost, of = [], [], [], defaultdict(list)

    def edge(a, b, c, w):
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            of[x].append(len(to))
            to.append(y)
            cap.append(z)
            cost.append(v)

    for p, members in enumerate(patterns):
        for k in range(repeats):
            edge(start, p, sizes[p], k)
        for s in members:
            edge(p, first_s + s, repeats * sizes[p], 0)
    for s, q in enumerate(quotas):
        edge(first_s + s, end, q, 0)
    while True:
        dist, by, queue, queued = {start: 0}, {}, deque([start]), {start}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in of[a]:
                if cap[e] > 0 and dist[a] + cost[e] < dist.get(to[e], 1 << 60):
                    dist[to[e]], by[to[e]] = dist[a] + cost[e], e
                    if to[e] not in queued:
                        queued.add(to[e])
                        queue.append(to[e])
        if end not in dist:
            break
        path, at = [], end
        while at != start:
            path.append(by[at])
            at = to[by[at] ^ 1]
        flow = min(cap[e] for e in path)
        for e in path:
            cap[e] -= flow
            cap[e ^ 1] += flow
    return [{to[e] - first_s: cap[e ^ 1] for e in of[p] if e % 2 == 0 and first_s <= to[e] < start} for p in range(n_p)]


def totals_given(patterns: list[tuple[int, ...]], sizes: list[int], quotas: list[int], repeats: int) -> list[int]:
    """Words that each pattern gives to all its sources. Only patterns linked by shared sources need a flow."""
    root = list(range(len(quotas)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for members in patterns:
        for s in members[1:]:
            root[find(s)] = find(members[0])
    linked = defaultdict(list)
    for p, members in enumerate(patterns):
        linked[find(members[0])].append(p)
    out = [0] * len(patterns)
    for ps in linked.values():
        if len(ps) == 1:
            out[ps[0]] = min(sum(quotas[s] for s in patterns[ps[0]]), repeats * sizes[ps[0]])
            continue
        at = {s: k for k, s in enumerate(sorted({s for p in ps for s in patterns[p]}))}
        flows = route([tuple(at[s] for s in patterns[p]) for p in ps], [sizes[p] for p in ps], [quotas[s] for s in at], repeats)
        for p, f in zip(ps, flows, strict=True):
            out[p] = sum(f.values())
    return out


def mix(rows: DataFrame, weights=(3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 17, spread: tuple[str, ...] = ()) -> DataFrame:
    """Choose how often the mix takes each row.

    rows: doc_id, sources (array of strings; none or null for no source's name), size (long), and others, which stay.
    Sources stand in code point order, the missing name last, and get weights in turn; a row with several sources may
    serve any of them. Adds source_size and target (of the row's source; sums for several), times and taken (size *
    times). A pattern's rows are all taken floor(flow / size) times, then once more in seeded order up to the flow's
    rest, to the nearest row; none more than repeats times. The seeded order hashes doc_id, size and the columns spread
    (so that many rows of one id, or without one, don't stand in one slice); equal rows are interchangeable. An empty
    table gives an empty result. rows is read twice and must read alike.

    One sum a pattern reaches the driver; those of the SLICES slices of the seeded order stay in Spark. A slice that a
    pattern's rest ends in is ordered in one task.
    """
    spark = rows.sparkSession
    key = F.array_sort(F.array_distinct(F.when(F.size("sources") > 0, F.col("sources")).otherwise(F.array(F.lit(None).cast("string")))))
    rows = rows.withColumn("_key", key).withColumn("_u", F.xxhash64("doc_id", "size", *spread, F.lit(seed)))
    rows = rows.withColumns({"_pattern": F.to_json(F.struct("_key"), {"ignoreNullFields": "false"}), "_slice": F.shiftrightunsigned("_u", 64 - (SLICES.bit_length() - 1)).cast("int")})
    sums = materialize(rows.groupBy("_pattern", "_slice").agg(F.first("_key").alias("key"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size")))
    found = {r["_pattern"]: r for r in sums.groupBy("_pattern").agg(F.first("key").alias("key"), F.sum("size").alias("size")).collect()}
    names = sorted(found)
    every = sorted({s for r in found.values() for s in r["key"]}, key=lambda s: (s is None, s or ""))
    index = {s: i for i, s in enumerate(every)}
    members = [tuple(sorted({index[s] for s in found[p]["key"]})) for p in names]
    sizes = [int(found[p]["size"]) for p in names]
    of_source = [0] * len(every)
    for m, z in zip(members, sizes, strict=True):
        for i in m:
            of_source[i] += z
    targets = target_sizes(of_source, [weights[i % len(weights)] for i in range(len(every))], share, repeats, sum(sizes))
    given = totals_given(members, sizes, [round(t) for t in targets], repeats)
    plans = []
    for p, m, z, f in zip(names, members, sizes, given, strict=True):
        full, rest = divmod(f, z) if z else (0, 0)
        plans.append((p, float(sum(targets[i] for i in m)), sum(of_source[i] for i in m), int(full), int(rest)))
    plan = spark.createDataFrame(plans, "_pattern string, target double, source_size long, _full long, _all long")
    small = F.broadcast if len(plans) <= BROADCAST_PATTERNS else lambda df: df
    upto = F.sum("size").over(Window.partitionBy("_pattern").orderBy("_slice"))  # SLICES rows at most
    cuts = sums.select("_pattern", "_slice", upto.alias("_upto")).join(small(plan), "_pattern").groupBy(*plan.columns)
    cuts = cuts.agg(F.coalesce(F.min(F.when(F.col("_upto") > F.col("_all"), F.col("_slice"))), F.lit(SLICES)).alias("_cut"), F.coalesce(F.max(F.when(F.col("_upto") <= F.col("_all"), F.col("_upto"))), F.lit(0)).alias("_before"))
    plan = cuts.withColumn("_rest", F.col("_all") - F.col("_before")).drop("_all", "_before")
    rows = rows.drop("target", "source_size", "times", "taken").join(small(plan), "_pattern")
    whole = rows.where("_slice <> _cut").withColumn("_more", (F.col("_slice") < F.col("_cut")).cast("long"))
    run = Window.partitionBy("_pattern").orderBy("_u", "doc_id", "size", *spread)
    before = F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    part = rows.where("_slice = _cut").withColumn("_more", (before + F.col("size") / 2 <= F.col("_rest")).cast("long"))
    out = whole.unionByName(part).withColumn("times", F.col("_full") + F.col("_more")).withColumn("taken", F.col("size") * F.col("times"))
    return out.drop("_key", "_u", "_pattern", "_slice", "_full", "_cut", "_rest", "_more")


def sized_documents(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, sources (the one source of each), size in words (null text: 0), text_hash, and the columns keep."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long")
    return docs.select("doc_id", *keep, F.array("source").alias("sources"), size.alias("size"), F.xxhash64("text").alias("text_hash"))


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(sized_documents(table(spark, sf_dir, "documents")), spread=("text_hash",)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op3_source_mixing": op3_source_mixing}
ORACLES: dict[str, str] = {}
