"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document belongs to), so the flow network has a
node per pattern and per source, however many documents there are. An edge pattern -> source carries words; words
leave a pattern in passes, each as large as the pattern, and a pass costs more than the one before (convex repetition
cost), so no document is repeated while another that can serve the source is unused. Each source asks for its target.

Targets: sources in code point order (null last) weigh the given weights in turn and share a budget of `share` times
all words; a source stops at `most` times its own words and what it can't take is dealt out again by weight.

Documents are then selected: whole passes go to every document of a pattern; the last, partial pass goes to documents
in the order of a seeded hash until its words are used, the document on the border giving only a part. The running sum
that this takes is over hash bins first and inside the border's bin after that, so no task gets a whole source.

Cases: a null or empty text has size 0 and takes 0; a null source is a source of its own, last in order; a document
without any source (null or empty array) is not asked for and takes 0; repeated rows are documents of their own;
an empty table gives no rows. The driver gets a row per pattern and source pair, never per document.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.shared import from_rows, stored

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, "7"
BIN_ROWS = 2000  # documents of a pattern that a hash bin holds, about
PATTERNS = 100_000  # patterns that the flow takes; it runs on the driver, and their plan is broadcast
MADE = ("pattern", "size", "source_size", "target", "taken")


def n_words(text: Column) -> Column:
    """The number of runs of characters other than space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Each source's target: the shares by weight, stopped at most times its size, the excess dealt out again.

    sizes is in source order. Sources stop in the order of size per weight, so one pass over them finds the level.
    """
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    left, open_weight, out = share * sum(sizes), sum(weight), [0.0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i] / weight[i], i)):
        out[i] = min(float(most * sizes[i]), left * weight[i] / open_weight)
        left -= out[i]
        open_weight -= weight[i]
    return out


def flow(supply: list[int], members: list[list[int]], demand: list[float], passes: int = MOST) -> list[float]:
    """Words that each pattern gives: the min-cost flow by successive cheapest paths.

    supply: words of each pattern; members: the sources each can serve; demand: each source's target. Pass k of a
    pattern costs k * k a word. A path may take words of one source away from a pattern that another source needs and
    make them up elsewhere, so demand is met whenever any routing meets it.
    """
    n, m = len(supply), len(demand)
    sent: dict[tuple[int, int], float] = defaultdict(float)
    used, got = [0.0] * n, [0.0] * m
    servers = defaultdict(list)
    for i, at in enumerate(members):
        for j in at:
            servers[j].append(i)

    def room(i: int) -> tuple[float, float]:
        """The cost a word of the pattern's next pass and the words left in it."""
        if supply[i] <= 0:
            return 0, 0.0
        k = int(used[i] / supply[i] + 1e-9)
        return ((k + 1) ** 2, supply[i] * (k + 1) - used[i]) if k < passes else (0, 0.0)

    for j in sorted(range(m), key=lambda j: (len(servers[j]), j)):
        while demand[j] - got[j] > 1e-6:
            # Dijkstra from source j: to a pattern costs nothing; from a pattern, on to a source it serves, whose words it hands over.
            best, queue, back, done, end = {("s", j): 0.0}, [(0.0, "s", j)], {}, set(), None
            offers: list[tuple[float, int]] = []
            while queue:
                cost, kind, x = heapq.heappop(queue)
                if (kind, x) in done:
                    continue
                done.add((kind, x))
                if kind == "p":
                    price, words = room(x)
                    if words > 1e-9:
                        offers.append((cost + price, x))
                    step = [("s", y) for y in members[x] if sent[x, y] > 1e-9]
                else:
                    step = [("p", y) for y in servers[x]]
                for key in step:
                    if key not in best:
                        best[key], back[key] = cost, (kind, x)
                        heapq.heappush(queue, (cost, *key))
            if not offers:
                break
            end = min(offers)[1]
            path, key = [("p", end)], ("p", end)
            while key in back:
                path.append(key := back[key])
            amount = min(room(end)[1], demand[j] - got[j], *(sent[b[1], a[1]] for a, b in zip(path, path[1:]) if a[0] == "s" and b[0] == "p"), float("inf"))
            used[end] += amount
            got[j] += amount
            for a, b in zip(path, path[1:]):  # from the end pattern back to j
                if a[0] == "p":
                    sent[a[1], b[1]] += amount
                else:
                    sent[b[1], a[1]] -= amount
    return used


def mix(docs: DataFrame, members: Column, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED, keep: list[str] | None = None) -> DataFrame:
    """keep's columns of docs with pattern, size, source_size, target and taken; members is an array of source names.

    source_size and target are those of the document's first source in order. Columns of keep that are named like one
    of these give way. More than PATTERNS patterns raise ValueError.
    """
    name = F.transform(members, lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("~")))  # null becomes the last name
    kept = [F.col(f"`{c}`") for c in keep or ["doc_id"] if c.lower() not in MADE]
    rows = docs.select(
        F.struct(*kept, F.lit(0).alias("_")).alias("kept"),
        F.array_sort(F.array_distinct(F.coalesce(name, F.array().cast("array<string>")))).alias("pattern"),
        n_words(F.col("text").cast("string")).alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("order"),
        F.xxhash64(F.col("text").cast("string")).alias("tie"),
    )
    rows = stored(rows, "mix")
    spark = docs.sparkSession
    stats = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(PATTERNS + 1).collect()
    if len(stats) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} patterns of membership")
    stats.sort(key=lambda r: r.pattern)
    sources = sorted({s for r in stats for s in r.pattern})
    at = {s: k for k, s in enumerate(sources)}
    size = [0] * len(sources)
    for r in stats:
        for s in r.pattern:
            size[at[s]] += r["size"]
    target = targets(size, weights, share, most)
    used = flow([r["size"] for r in stats], [[at[s] for s in r.pattern] for r in stats], target, most)
    plan = []
    for r, words in zip(stats, used):
        words = round(words)
        passes = min(most, words // r["size"]) if r["size"] else 0
        first = at[r.pattern[0]] if r.pattern else None
        plan.append((list(r.pattern), size[first] if r.pattern else 0, target[first] if r.pattern else 0.0, passes, words - passes * r["size"] if r["size"] else 0, max(1, -(-r["n"] // BIN_ROWS))))
    plan_rows = from_rows(spark, plan, {"pattern": pa.list_(pa.string()), "source_size": pa.int64(), "target": pa.float64(), "passes": pa.int64(), "rest": pa.int64(), "bins": pa.int64()})
    rows = rows.join(F.broadcast(plan_rows), "pattern")
    # The order's first 13 hex digits as a fraction of 1 choose the bin, so bins follow the order.
    rows = rows.withColumn("bin", F.floor(F.conv(F.substring("order", 1, 13), 16, 10).cast("double") / float(16**13) * F.col("bins")))
    bins = rows.groupBy("pattern", "bin").agg(F.sum("size").alias("words"))
    ahead = W.partitionBy("pattern").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    rows = rows.join(bins, ["pattern", "bin"])
    edge = (F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("words") > F.col("rest"))
    full = F.when(F.col("ahead") + F.col("words") <= F.col("rest"), F.col("size")).otherwise(0)
    within = W.partitionBy("pattern", "bin").orderBy("order", "tie", F.to_json("kept")).rowsBetween(W.unboundedPreceding, -1)
    before = F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    out = [*(F.col("kept")[c].alias(c) for c in keep or ["doc_id"] if c.lower() not in MADE), *MADE[:-1]]
    inner = rows.where(edge).withColumn("extra", part)
    return rows.where(~edge).withColumn("extra", full).unionByName(inner).select(*out, (F.col("passes") * F.col("size") + F.col("extra")).cast("long").alias("taken"))
