"""Mixing sources to target shares of all tokens (problem 8).

Texts are aggregated by membership pattern (the set of sources they occur
in); a min-cost flow routes the token capacity of every pattern to source
quotas, each further copy of a pattern costing more than the one before; the
routed amounts then become intervals on the seeded order of each pattern's
texts, which select the documents.  A source that ends up beside its quota,
since texts are taken whole, is brought to it by dropping or adding the texts
that fit best.
"""

from __future__ import annotations

import bisect
import math
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.durable import written

#: Sources that a mix may have: patterns are sets of sources and go to the driver.
MAX_SOURCES = 64
#: Patterns of more than one source that are routed as such; texts of rarer ones count for one of their sources.
MAX_PATTERNS = 4096
#: Size classes an octave, and texts of each class, among which the best fitting ones are looked for.
FIT_CLASSES, FIT_TEXTS = 8, 12
#: Texts of one pattern that share a bucket of the seeded order.
BUCKET_TEXTS = 4096


class FlowNetwork:
    """Min-cost flow by successive cheapest paths, for a few thousand edges."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def send(self, source: int, sink: int) -> int:
        """Send as much as possible as cheaply as possible; returns the amount."""
        total = 0
        while True:
            price = {source: 0}
            via: dict[int, int] = {}
            queue, waiting = deque([source]), {source}
            while queue:
                a = queue.popleft()
                waiting.discard(a)
                for e in self.out[a]:
                    b = self.to[e]
                    if self.room[e] > 0 and price[a] + self.cost[e] < price.get(b, math.inf):
                        price[b] = price[a] + self.cost[e]
                        via[b] = e
                        if b not in waiting:
                            waiting.add(b)
                            queue.append(b)
            if sink not in price:
                return total
            path, node = [], sink
            while node != source:
                path.append(via[node])
                node = self.to[via[node] ^ 1]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount
            total += amount


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: int


def route(patterns: dict[tuple[tuple[str, ...], int], int], quotas: dict[str, int]) -> dict[tuple[tuple[tuple[str, ...], int], int, str], int]:
    """Tokens by (pattern, copy, source) that fill the quotas with least repetition.

    A pattern is a set of sources and how often its texts may be repeated.
    Copy ``c`` of a pattern costs ``c - 1`` a token.
    """
    names = sorted(quotas)
    copies = [(p, c) for p in sorted(patterns) for c in range(1, p[1] + 1)]
    net = FlowNetwork(2 + len(copies) + len(names))
    place = {s: 2 + len(copies) + i for i, s in enumerate(names)}
    edges = {}
    for i, (p, c) in enumerate(copies):
        net.edge(0, 2 + i, patterns[p], c - 1)
        for s in p[0]:
            if s in place:
                edges[p, c, s] = net.edge(2 + i, place[s], patterns[p])
    for s in names:
        net.edge(place[s], 1, quotas[s])
    net.send(0, 1)
    return {k: net.room[e ^ 1] for k, e in edges.items() if net.room[e ^ 1]}


def quotas_for(total: int, targets: list[Target]) -> dict[str, int]:
    return {t.source: int(t.share * total) for t in targets}


def largest_total(patterns: dict[tuple[tuple[str, ...], int], int], targets: list[Target]) -> int:
    """The largest total at which every source that has texts (and may use
    them) can still be given its share; 0 if there is none."""
    present = {s for p, n in patterns.items() if n for s in p[0]}
    usable = [t for t in targets if t.source in present and t.share > 0 and t.max_repeats > 0]
    if not usable:
        return 0

    def fits(total: int) -> bool:
        quotas = quotas_for(total, usable)
        return sum(route(patterns, quotas).values()) == sum(quotas.values())

    low, high = 0, int(sum(patterns.values()) * max(t.max_repeats for t in usable) / sum(t.share for t in usable)) + 1
    while high - low > max(1, low // 100_000):
        middle = (low + high) // 2
        low, high = (middle, high) if fits(middle) else (low, middle)
    return low


@dataclass(frozen=True)
class Mix:
    """``chosen`` has ``(doc_id, source, copies, n_tokens)``, ``shares`` a row per target."""

    chosen: DataFrame
    shares: DataFrame
    total: int


def _targets(mix_targets: DataFrame) -> list[Target]:
    rows = mix_targets.where(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").distinct().limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES or len({r[0] for r in rows}) < len(rows):
        raise ValueError(f"a mix needs at most {MAX_SOURCES} targets, one for each source")
    return [Target(r[0], float(r[1] or 0), int(r[2] or 0)) for r in sorted(rows)]


def best_fit(missing: int, sizes: list[int]) -> list[int]:
    """Indexes of ``sizes`` (ascending) whose sum comes near ``missing`` without
    passing it: the largest that fits, again and again, each once; then one
    more if that comes nearer."""
    free, out = list(range(len(sizes))), []
    while free:
        at = bisect.bisect_right(free, missing, key=lambda i: sizes[i]) - 1
        if at < 0:
            break
        out.append(free.pop(at))
        missing -= sizes[out[-1]]
    if free and abs(missing - sizes[free[0]]) < missing:
        out.append(free[0])
    return out


def best_swap(over: int, drops: list[tuple[int, str]], adds: list[tuple[int, str]]) -> tuple | None:
    """``(dropped, added)`` of ``(size, key)`` lists, ascending, whose difference
    comes nearest to ``over`` (negative: what is missing); None if nothing helps."""
    best, pair = abs(over), None
    for drop in drops:
        at = bisect.bisect_left(adds, (drop[0] - over,))
        for add in adds[max(at - 1, 0) : at + 1]:
            off = abs(over - drop[0] + add[0])
            if off < best and add[1] != drop[1]:
                best, pair = off, (drop, add)
    return pair


def _sample_sizes(slots: DataFrame, sources: list[str]) -> dict[str, list[tuple[int, str]]]:
    """Of ``(source, key, n_tokens)`` up to ``FIT_TEXTS`` texts of each source
    and size class, by size.

    The driver gets at most sources x classes x texts rows: 64 x 40 x 8 x 12.
    """
    size = F.floor(F.log2("n_tokens") * FIT_CLASSES)
    rank = F.row_number().over(Window.partitionBy("source", size).orderBy("key"))
    found: dict[str, list] = {s: [] for s in sources}
    for r in slots.where(F.col("source").isin(sources)).withColumn("_rank", rank).where(F.col("_rank") <= FIT_TEXTS).select("source", "key", "n_tokens").collect():
        found[r["source"]].append((r["n_tokens"], r["key"]))
    return {s: sorted(rows) for s, rows in found.items()}


def _balanced(picked: DataFrame, texts: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """``picked`` ``(key, source, copies, n_tokens)`` with every source as near to
    its quota as whole texts allow.

    A source above its quota drops copies, one below adds copies of texts that
    are still free, both the best fitting ones; one swap of a copy for another
    text then takes up what is left.
    """
    spark = picked.sparkSession
    got = {r["source"]: r["tokens"] for r in picked.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens")).collect()}
    off = {s: got.get(s, 0) - q for s, q in quotas.items() if q and got.get(s, 0) != q}
    if not off:
        return picked
    used = picked.groupBy("key").agg(F.sum("copies").alias("used"))
    free = texts.join(used, "key", "left").where(F.coalesce("used", F.lit(0)) < F.col("repeats"))
    drops = _sample_sizes(picked, sorted(off))
    adds = _sample_sizes(free.select("key", "n_tokens", F.explode("pattern").alias("source")), sorted(off))
    changes, claimed = [], set()  # a text is dropped or gets one more copy at most once, for one source
    for source, over in sorted(off.items()):
        sides = {+1: [r for r in drops[source] if r[1] not in claimed], -1: [r for r in adds[source] if r[1] not in claimed]}
        sign = 1 if over > 0 else -1
        for i in best_fit(abs(over), [n for n, _ in sides[sign]]):
            n, key = sides[sign][i]
            changes.append((key, source, -sign, n))
            claimed.add(key)
            over -= sign * n
        swap = best_swap(over, *([r for r in sides[x] if r[1] not in claimed] for x in (1, -1)))
        for (n, key), change in zip(swap or (), (-1, 1)):
            changes.append((key, source, change, n))
            claimed.add(key)
    if not changes:
        return picked
    moved = spark.createDataFrame(changes, "key string, source string, change int, n_tokens long")
    both = picked.select("key", "source", F.col("copies").alias("change"), "n_tokens").unionByName(moved)
    summed = both.groupBy("key", "source").agg(F.sum("change").cast("int").alias("copies"), F.max("n_tokens").alias("n_tokens"))
    return summed.where(F.col("copies") > 0)


def _patterns(texts: DataFrame, targets: list[Target], most: int) -> tuple[DataFrame, list]:
    """Texts with their pattern and permitted repeats, and tokens and texts of every pattern.

    Of patterns of several sources the ``most`` largest stay; texts of the
    others count for the source that has least for its share.
    """
    limit = F.create_map(*[F.lit(x) for t in targets for x in (t.source, t.max_repeats)])
    texts = texts.withColumn("repeats", F.array_min(F.transform("pattern", lambda s: limit[s])))
    kinds = texts.where(F.size("pattern") > 1).groupBy("pattern").agg(F.sum("n_tokens").alias("t")).orderBy(F.desc("t"), "pattern")
    if kinds.limit(most + 1).count() > most:
        have = {r["s"]: r["t"] for r in texts.select(F.explode("pattern").alias("s"), "n_tokens").groupBy("s").agg(F.sum("n_tokens").alias("t")).collect()}
        need = F.create_map(*[F.lit(x) for t in targets for x in (t.source, have.get(t.source, 0) / max(t.share, 1e-9))])
        stay = F.broadcast(kinds.limit(most).select("pattern", F.lit(True).alias("stays")))  # at most ``most`` rows
        one = F.array(F.array_min(F.transform("pattern", lambda s: F.struct(need[s].alias("need"), s.alias("s"))))["s"])
        texts = texts.join(stay, "pattern", "left").withColumn("pattern", F.when(F.col("stays") | (F.size("pattern") == 1), F.col("pattern")).otherwise(one)).drop("stays")
    texts = written(texts.select("key", "pattern", "repeats", "n_tokens"))
    return texts, texts.groupBy("pattern", "repeats").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()


def mix_sources(sized: DataFrame, mix_targets: DataFrame, seed: int = 1, total: int | str | None = None, most_patterns: int = MAX_PATTERNS) -> Mix:
    """A mix of ``sized`` texts, ``(doc_id, source, key, n_tokens)``.

    ``key`` identifies a text: rows with one key are copies of it, under one
    or several sources, and count as one text.  Rows with a null source, a
    source without target, or no tokens take no part.  ``total`` is the size
    in tokens to aim at, ``"all"`` that of all texts; by default the largest
    at which every source with texts can have its share.  Where a quota cannot
    be met, what there is is used and the share reached is reported; a source
    without texts gets a row of zeros.  Texts are whole, so a share is met up
    to what the best fitting texts leave.  A text of several sources may be
    repeated as often as the strictest of them allows.
    """
    spark = sized.sparkSession
    targets = _targets(mix_targets)
    known = [t.source for t in targets if t.max_repeats > 0]
    part = sized.where(F.col("source").isin(known) & (F.col("n_tokens") > 0) & F.col("key").isNotNull())
    each = part.groupBy("key", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    each = written(each)
    # a pattern has at most MAX_SOURCES members
    texts = each.groupBy("key").agg(F.array_sort(F.collect_set("source")).alias("pattern"), F.max("n_tokens").alias("n_tokens"))
    texts, found = _patterns(texts, targets, most_patterns)
    patterns = {(tuple(r["pattern"]), r["repeats"]): r["tokens"] for r in found}
    if total is None:
        total = largest_total(patterns, targets)
    elif total == "all":
        total = sum(patterns.values())
    quotas = quotas_for(total, targets)
    routed = route(patterns, quotas)

    number = {p: i for i, p in enumerate(sorted(patterns))}
    intervals, reached = [], {}
    for (p, c, s), amount in sorted(routed.items()):
        begin = reached.get((p, c), 0)
        reached[p, c] = begin + amount
        # on the order of texts each interval of a copy takes up where the last ended
        intervals.append((number[p], s, begin, begin + amount))
    # both bounded by the number of patterns, at most MAX_PATTERNS + MAX_SOURCES^2
    interval = F.broadcast(spark.createDataFrame(intervals, "pattern_id int, source string, low long, high long"))
    numbered = F.broadcast(spark.createDataFrame([(list(p), r, i) for (p, r), i in number.items()], "pattern array<string>, repeats int, pattern_id int"))

    # prefix sums in two steps, so that no window holds a whole pattern's texts
    buckets = max(1, max((r["n"] for r in found), default=1) // BUCKET_TEXTS)
    h = F.xxhash64("key", F.lit(seed))
    placed = texts.join(numbered, ["pattern", "repeats"]).withColumns({"h": h, "bucket": F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(buckets))})
    sums = placed.groupBy("pattern_id", "bucket").agg(F.sum("n_tokens").alias("s"))
    before = F.sum("s").over(Window.partitionBy("pattern_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("pattern_id", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    inner = F.sum("n_tokens").over(Window.partitionBy("pattern_id", "bucket").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1))
    ordered = placed.withColumn("within", F.coalesce(inner, F.lit(0))).join(offsets, ["pattern_id", "bucket"])
    ordered = ordered.select("key", "n_tokens", "pattern_id", (F.col("offset") + F.col("within")).alias("start"))

    inside = (F.col("start") >= F.col("low")) & (F.col("start") < F.col("high"))
    picked = ordered.join(interval, "pattern_id").where(inside).groupBy("key", "source").agg(F.count(F.lit(1)).cast("int").alias("copies"), F.max("n_tokens").alias("n_tokens"))
    picked = _balanced(written(picked), texts, quotas)
    chosen = written(picked.select("key", "source", "copies").join(each, ["key", "source"]).select("doc_id", "source", "copies", "n_tokens"))
    got = chosen.groupBy("source").agg(
        F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"),
        F.count(F.lit(1)).alias("n_texts"),
        F.max("copies").alias("most_copies"),
    )
    got = got.join(each.groupBy("source").agg(F.min("n_tokens").alias("least_text")), "source", "full")
    goal = spark.createDataFrame([(t.source, t.share, t.max_repeats, quotas[t.source]) for t in targets], "source string, target_share double, max_repeats int, quota_tokens long")
    whole = chosen.agg(F.coalesce(F.sum(F.col("copies") * F.col("n_tokens")), F.lit(0))).first()[0]
    tokens = F.coalesce("tokens", F.lit(0))
    shares = goal.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "quota_tokens",
        tokens.cast("long").alias("tokens"),
        F.coalesce(F.try_divide(tokens.cast("double"), F.lit(float(whole))), F.lit(0.0)).alias("share"),
        F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
        F.coalesce("most_copies", F.lit(0)).cast("int").alias("most_copies"),
        F.coalesce("least_text", F.lit(0)).cast("long").alias("least_text"),
        (F.abs(tokens - F.col("quota_tokens")) <= F.col("quota_tokens") * 0.02).alias("met"),
    )
    return Mix(chosen, shares, total)
