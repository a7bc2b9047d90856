"""Mixing sources to target weights as a min-cost flow.

Documents are grouped by their membership pattern, the set of sources that hold them. A flow
routes the patterns' words to the sources' quotas: a pattern's first pass costs nothing, each
repetition more than the one before, so scarce sources repeat and shared documents go where they
spare repetitions. The flow is solved on one aggregate per pattern; documents are then chosen by
seeded hashes until each pattern's share of the flow is met.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, small_batches

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: The hash range has 2**12 slices, whose word sums show where a pattern's last pass ends.
SLICE_SHIFT = 52
#: Rows of a pattern, about so many, that are looked at to close what a seeded choice leaves of its share.
FILLERS = 1024
#: Memory of that choice, in bits a row and word: 32 MB.
SUBSET_BITS = 1 << 28
#: More patterns than that are an error: sources are meant to be few, and their patterns a summary.
MAX_PATTERNS = 20_000


def words(text: Column) -> Column:
    """The number of runs of characters other than space and U+0009 to U+000D; null has none."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, most: int = MAX_REPEATS, total: int | None = None) -> list[float]:
    """Shares of all words by weight, repeating over the sources; none above `most` times its size, the excess reshared by weight."""
    total, share = sum(sizes) if total is None else total, [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        unit = left / sum(share[i] for i in sorted(open_))
        full = [i for i in sorted(open_) if unit * share[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * share[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
            open_.remove(i)
    return out


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], most: int = MAX_REPEATS) -> list[dict[int, int]]:
    """For each (members, words) pattern: words routed to each source. Repetition r of a pattern costs r - 1 a word.

    Successive shortest paths with potentials. Quotas beyond what patterns can give stay unmet.
    """
    n, m = len(patterns), len(quotas)
    source, sink = n + m, n + m + 1
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    leave: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            leave[x].append(len(to))
            to.append(y), room.append(c), cost.append(p)
        return len(to) - 2

    arcs: list[dict[int, int]] = []
    for i, (members, size) in enumerate(patterns):
        for r in range(most):
            arc(source, i, size, r)
        arcs.append({j: arc(i, n + j, most * size, 0) for j in members})
    for j, quota in enumerate(quotas):
        arc(n + j, sink, quota, 0)
    potential = [0] * (n + m + 2)
    while True:
        dist = [None] * (n + m + 2)
        via = [-1] * (n + m + 2)
        dist[source], heap = 0, [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for e in leave[x]:
                if room[e] > 0:
                    y, nd = to[e], d + cost[e] + potential[x] - potential[to[e]]
                    if dist[y] is None or nd < dist[y]:
                        dist[y], via[y] = nd, e
                        heapq.heappush(heap, (nd, y))
        if dist[sink] is None:
            break
        potential = [p + (d if d is not None else dist[sink]) for p, d in zip(potential, dist, strict=True)]
        # Blocking flow over arcs of reduced cost 0, by depth-first search with arc pointers.
        at = [0] * (n + m + 2)
        while True:
            path, x, on = [], source, {source}
            while x != sink:
                while at[x] < len(leave[x]):
                    e = leave[x][at[x]]
                    if room[e] > 0 and to[e] not in on and dist[to[e]] is not None and cost[e] + potential[x] - potential[to[e]] == 0:
                        break
                    at[x] += 1
                if at[x] == len(leave[x]):
                    if x == source:
                        break
                    e = path.pop()
                    on.discard(x)
                    x = to[e ^ 1]
                    at[x] += 1
                    continue
                path.append(leave[x][at[x]])
                x = to[path[-1]]
                on.add(x)
            if x != sink:
                break
            least = min(room[e] for e in path)
            for e in path:
                room[e] -= least
                room[e ^ 1] += least
    return [{j: room[e ^ 1] for j, e in a.items() if room[e ^ 1]} for a in arcs]


def nearest_subset(sizes: list[int], wanted: int) -> list[int]:
    """Positions of sizes whose sum comes nearest to `wanted`, the smaller sum of two equally near; the first SUBSET_BITS // (2 * wanted) sizes are looked at.

    Bit n of a number is set if n is a sum of some of the sizes so far.
    """
    if wanted <= 0:
        return []
    sizes, limit = sizes[: max(1, SUBSET_BITS // (2 * wanted))], (1 << (2 * wanted)) - 1
    reach = [1]
    for size in sizes:
        reach.append(reach[-1] | (reach[-1] << size & limit if size < 2 * wanted else 0))
    low = (reach[-1] & ((1 << (wanted + 1)) - 1)).bit_length() - 1
    above = reach[-1] >> (wanted + 1)
    high = wanted + (above & -above).bit_length() if above else None
    total = high if high is not None and high - wanted < wanted - low else low
    chosen = []
    for n in range(len(sizes), 0, -1):
        if not reach[n - 1] >> total & 1:
            chosen.append(n - 1)
            total -= sizes[n - 1]
    return chosen[::-1]


def _filled(part: pd.DataFrame) -> pd.DataFrame:
    """Of a pattern's rows (key, u, size, missing), those whose sizes add up nearest to what is missing."""
    part = part.sort_values("u")
    chosen = nearest_subset(part["size"].tolist(), int(part["missing"].iloc[0]))
    return pd.DataFrame({"key": [part["key"].iloc[0]], "more": [part["u"].iloc[chosen].tolist()]})


def mix(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", members: Column | None = None, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_REPEATS, size: Column | None = None) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken): a row per row of docs.

    `members` is the array of a row's sources (by default its source alone); sources sort by code
    point, null last; `source` is the first of them, or null. `taken` counts the words that the
    mix takes of the row, whole passes of it and at most `most`. Within a pattern a last partial
    pass takes rows in the order of a seeded hash of id and text as long as they fit, and of the about
    FILLERS rows after these the ones whose sizes add up nearest to what is missing. Rows that repeat id and text go together; null is an id like
    others. Empty documents and empty tables take nothing.
    """
    small_batches(docs.sparkSession)
    members = members if members is not None else F.array("source")
    size = size if size is not None else words(F.col("text"))
    # Null sorts last: each member is a pair of "is null" and the name.
    pattern = F.array_sort(F.array_distinct(F.transform(members, lambda s: F.struct(s.isNull().alias("none"), s.cast("string").alias("name")))))
    # One id may have many rows, null above all: the text tells them apart.
    of_row = [F.col(id_col).cast("long"), *[F.col(c) for c in docs.columns if c.lower() == "text"]]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), pattern.alias("pattern"), F.xxhash64(F.lit(seed), *of_row).alias("u"))
    rows = durable(rows.select("doc_id", "size", "pattern", F.to_json("pattern").alias("key"), "u"))
    found = rows.groupBy("key").agg(F.sum("size").alias("words"), F.first("pattern").alias("pattern"), F.count_if(F.col("size") > 0).alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} membership patterns; pass fewer sources")
    patterns = sorted((tuple((m["none"], m["name"] or "") for m in r["pattern"] or []), int(r["words"] or 0), r["key"]) for r in found)
    counts = {r["key"]: r["n"] for r in found}
    names = sorted({m for p, _, _ in patterns for m in p})
    of = {name: i for i, name in enumerate(names)}
    sizes = [0] * len(names)
    for p, n, _ in patterns:
        for m in p:
            sizes[of[m]] += n
    goal = targets(sizes, weights, most, total=sum(n for p, n, _ in patterns if p))
    flow = min_cost_flow([(tuple(of[m] for m in p), n) for p, n, _ in patterns], [round(t) for t in goal], most)

    plan = []
    for (p, n, key), routed in zip(patterns, flow, strict=True):
        share, first = sum(routed.values()), of[p[0]] if p else None
        name = None if first is None or names[first][0] else names[first][1]
        plan.append((key, name, sizes[first] if p else 0, goal[first] if p else 0.0, share // n if n else 0, share % n if n else 0))
    spark = docs.sparkSession
    # A row per pattern, MAX_PATTERNS at most.
    shares = F.broadcast(spark.createDataFrame(plan, "key string, source string, source_size long, target double, passes long, rest long"))
    dealt = rows.join(shares, "key")
    open_ = dealt.where("rest > 0 AND size > 0").select("key", "u", "size", "rest", F.shiftright("u", SLICE_SHIFT).alias("slice"))
    # Where a pattern's last pass ends: first the slice of the hash range in which the running sum crosses the rest, then the hash in it.
    sums = open_.groupBy("key", "slice").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    through = F.sum("words").over(Window.partitionBy("key").orderBy("slice"))
    cuts = sums.withColumn("before", through - F.col("words")).where("before <= rest AND before + words > rest")
    ends = {r["key"]: (r["slice"], r["before"], r["rest"]) for r in cuts.collect()}  # a row per pattern
    cut = F.broadcast(spark.createDataFrame([(k, c, b) for k, (c, b, _) in ends.items()], "key string, cut long, before long"))
    groups = open_.join(cut, "key").where("slice = cut").groupBy("key", "u").agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    running = F.col("before") + F.sum("words").over(Window.partitionBy("key").orderBy("u"))
    fitting = groups.withColumn("sum", running).where("sum <= rest").groupBy("key").agg(F.max("u").alias("last"), F.max("sum").alias("sum"))
    # The last hash taken; null if the first slice of all is cut and nothing in it fits.
    state = {k: [(c << SLICE_SHIFT) - 1 if before else None, rest - before, []] for k, (c, before, rest) in ends.items()}
    for r in fitting.collect():
        state[r["key"]][:2] = [r["last"], ends[r["key"]][2] - r["sum"]]
    # What is left is filled from a stretch of the hash range that holds about FILLERS of the pattern's rows.
    kept = "key string, last long, missing long, more array<long>"
    filling = []
    for k, (last, missing, _) in state.items():
        after = -(1 << 63) if last is None else last + 1
        filling.append((k, after, min((1 << 63) - 1, after + (FILLERS << 64) // max(1, counts[k])), missing))
    now = F.broadcast(spark.createDataFrame([f for f in filling if f[3] > 0], "key string, after long, until long, missing long"))
    later = open_.join(now, "key").where("u BETWEEN after AND until").groupBy("key", "u").agg(F.sum("size").alias("size"), F.first("missing").alias("missing"))
    for r in later.groupBy("key").applyInPandas(_filled, "key string, more array<long>").collect():
        state[r["key"]][2] = r["more"]
    chosen = F.broadcast(spark.createDataFrame([(k, *v) for k, v in state.items()], kept))
    extra = F.expr("CAST(coalesce(u <= last, false) OR coalesce(array_contains(more, u), false) AS INT)")
    taken = (F.col("size") * F.least(F.col("passes") + extra, F.lit(most))).cast("long").alias("taken")
    return dealt.join(chosen, "key", "left").select("doc_id", "size", "source", "source_size", "target", taken)
