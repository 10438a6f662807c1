"""Mixing overlapping sources to target weights by a min-cost flow."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import ROW, WORD, running, with_row_id
from estatelens.session import settle

Pattern = tuple  # the sorted sources that a document belongs to


def quotas(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Targets that share ``total`` by weight; none is above ``most`` times its source's size.

    The excess of capped sources is shared by weight among the others until none is above.
    If all are capped, the targets stay below ``total``.
    """
    targets, left, open_ = {}, float(total), set(sizes)
    while open_:
        weight = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / weight > most * sizes[s]}
        if not over:
            return targets | {s: left * weights[s] / weight for s in open_}
        for s in sorted(over, key=repr):
            targets[s] = float(most * sizes[s])
            left -= targets[s]
        open_ -= over
    return targets


def flow(capacities: dict[Pattern, int], quota: dict, copies: int) -> dict[Pattern, dict]:
    """Tokens that each membership pattern sends to each of its sources, at least cost.

    A pattern's tokens may go out ``copies`` times, and each further copy costs more than
    the one before (a convex cost, the same for all patterns). Every way from start to end
    uses one copy level, so the cheapest flow is a largest flow over first copies, then
    enlarged over second ones, and so on: each level's largest flow keeps what the lower
    levels carry. Within a level ways are found by layers (Dinic).
    """
    sent = {p: dict.fromkeys(p, 0) for p in capacities}
    left = {s: int(round(q)) for s, q in quota.items()}
    members: dict = {}
    for p in capacities:
        for s in p:
            members.setdefault(s, []).append(p)
    for _ in range(copies):
        supply = dict(capacities)
        while True:
            # layers: patterns with supply, their sources, patterns that could give way there
            depth: dict = {("p", p): 0 for p, c in supply.items() if c > 0}
            queue, reached = deque(depth), False
            while queue:
                kind, x = node = queue.popleft()
                if kind == "p":
                    nexts = [("s", s) for s in x if s in left]
                else:
                    reached = reached or left[x] > 0
                    nexts = [("p", p) for p in members[x] if sent[p][x] > 0]
                for y in nexts:
                    if y not in depth:
                        depth[y] = depth[node] + 1
                        queue.append(y)
            if not reached:
                break
            moved = _augment(depth, supply, sent, left, members)
            if not moved:
                break
    return sent


def _augment(depth, supply, sent, left, members) -> int:
    """Send as much as fits along ways that go one layer down at each step."""
    total, spent = 0, set()

    def edges(node):
        kind, x = node
        if kind == "p":
            return [("s", s) for s in x if s in left]
        return [("p", p) for p in members[x] if sent[p][x] > 0]

    for p in [p for p, c in supply.items() if c > 0]:
        while supply[p] > 0:
            way, trail = [("p", p)], [iter(edges(("p", p)))]
            while way and not (way[-1][0] == "s" and left[way[-1][1]] > 0):
                for y in trail[-1]:
                    if depth.get(y) == depth[way[-1]] + 1 and y not in spent:
                        way.append(y)
                        trail.append(iter(edges(y)))
                        break
                else:
                    spent.add(way.pop())
                    trail.pop()
            if not way:
                break
            back = [sent[b[1]][a[1]] for a, b in zip(way, way[1:]) if a[0] == "s"]
            amount = min([supply[p], left[way[-1][1]], *back])
            for a, b in zip(way, way[1:]):
                if a[0] == "p":
                    sent[a[1]][b[1]] += amount
                else:
                    sent[b[1]][a[1]] -= amount
            supply[p] -= amount
            left[way[-1][1]] -= amount
            total += amount
    return total


def mixed(df: DataFrame, members: str, size: str, order: list[str], quota, copies: int = 2, seed: int = 42) -> DataFrame:
    """Rows of ``df`` with ``copies`` (0 to ``copies``), ``taken`` (size times copies) and ``routes``.

    ``members`` is an array column with the sources a row belongs to (null or empty: it is
    never taken), ``size`` a long column of tokens. ``quota(sizes)`` is called with each
    pattern's tokens and gives each source's target. ``routes`` lists the source that each
    copy is counted under.

    Documents are summed by membership pattern, and only these sums go to the driver: their
    number is that of the different sets of sources, not of documents. Each pattern's flow
    is then filled with whole documents in a seeded order: with documents laid end to end,
    a copy is taken when its middle lies within the flow, so a pattern misses its flow by
    half a document at most. Running totals are exact and computed by ranges (see
    `running`), also for one pattern with all rows. Rows equal in ``order`` share their
    place in the seeded order and may swap. Empty tables give empty results.
    """
    if clash := {"_pattern", "_draw", "_at", "_p", "_total", "_ends", "_place", "_part", "copies", "taken", "routes"} & set(df.columns):
        raise ValueError(f"rename the columns {sorted(clash)}: the mix uses these names")
    spark = df.sparkSession
    rows = df.withColumn("_pattern", F.array_sort(F.array_distinct(F.coalesce(F.col(members), F.array().cast(df.schema[members].dataType)))))
    rows = rows.withColumn("_draw", F.xxhash64(F.lit(seed).cast("long"), *order))
    # everything but ids and sizes stays out of the running totals
    rows = settle(running(rows, ["_draw", *order], {"_at": size}, within=["_pattern"]))
    sums = rows.groupBy("_pattern").agg(F.sum(size).alias("n"))
    sizes = {tuple(r["_pattern"]): int(r["n"] or 0) for r in sums.collect()}
    capacities = {p: n for p, n in sizes.items() if p and n}
    sent = flow(capacities, quota(sizes), copies)
    schema = f"_p {df.schema[members].dataType.simpleString()}, _total long, _ends array<struct<source:string,until:long>>"
    ends = []
    for p, per_source in sent.items():
        at, marks = 0, []
        for s, amount in per_source.items():
            at += amount
            marks.append((s, at))
        ends.append((list(p), capacities[p], marks))
    plan = spark.createDataFrame(ends, schema)
    joined = rows.join(plan, F.col("_pattern") == F.col("_p"), "left")
    half = F.floor(F.col(size) / 2)
    levels = F.array(*[F.lit(k).cast("long") for k in range(copies)])
    middle = lambda k: k * F.col("_total") + F.col("_at") + half
    route = F.transform(levels, lambda k: F.get(F.filter("_ends", lambda e: middle(k) < e["until"]), F.lit(0))["source"])
    reach = F.element_at("_ends", -1)["until"]
    n = F.size(F.filter(levels, lambda k: middle(k) < reach))
    n = F.when((F.col(size) > 0) & F.col("_ends").isNotNull(), n).otherwise(0)
    return (
        joined.withColumn("copies", n)
        .withColumn("taken", (F.col(size) * F.col("copies")).cast("long"))
        .withColumn("routes", F.slice(route, 1, F.greatest(n, F.lit(0))))
        .select(*df.columns, "copies", "taken", "routes")
    )


def document_mix(documents: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """The mix of documents, each a member of its own source.

    Returns (doc_id, size, source_size, target, taken, copies). Size counts words (null
    text: 0). Sources in the order of their code points, null last (null is a source of its
    own), get ``weights`` in turn and share ``share`` of all words, ``most`` times their own
    at most. Repeated rows are documents of their own.
    """
    return _mixed_documents(documents, weights, share, most, seed).select("doc_id", "size", "source_size", "target", "taken", "copies")


def _mixed_documents(documents: DataFrame, weights, share, most, seed, *also: str) -> DataFrame:
    spark = documents.sparkSession
    # a leading mark keeps the order of code points and puts null last
    source = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = documents.select("doc_id", size.alias("size"), F.array(source).alias("_members"), F.xxhash64("text").alias("_text"), *also)
    targets, sizes = {}, {}

    def quota(patterns: dict[Pattern, int]) -> dict:
        for p, n in patterns.items():
            sizes[p[0]] = n
        by_source = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes))}
        targets.update(quotas(sizes, by_source, share * sum(sizes.values()), most))
        return targets

    out = mixed(rows, "_members", "size", ["doc_id", "_text"], quota, copies=int(most), seed=seed)
    of_source = spark.createDataFrame([(s, int(sizes[s]), float(targets[s])) for s in sizes], "_source string, source_size long, target double")
    return out.join(of_source, F.col("_members")[0] == F.col("_source")).drop("_source", "_members", "_text")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """The documents of the mix with their columns as they are, each as often as it is taken."""
    named = with_row_id(docs)
    plain = named.select("row.doc_id", "row.source", "row.text", *ROW)
    copies = _mixed_documents(plain, weights, share, most, seed, *ROW).where("copies > 0").select(*ROW, "copies")
    out = named.join(copies, list(ROW))
    each = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return out.select("row", each).select("row.*")
