"""Mixing sources to target weights: a min-cost flow over membership patterns, then seeded documents."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.llm.common import Columns, arrow_map, dropped, written

WEIGHTS = (5, 2, 1)
#: No document is taken more often, and no target exceeds so many times its source.
REPEATS = 3
#: What a word costs that is taken for the 1st, 2nd, 3rd time: more each time, so repetition is spread evenly.
REPEAT_COSTS = (0, 1, 3)
#: The flow is solved on the driver over sources and patterns; more are refused.
MAX_PATTERNS = 100_000
#: Documents of a pattern's seeded order that are decided document by document, at most (equal rows aside); parts that a range of the order is cut
#: into to find them; and the range of places.
STRETCH, PARTS, SPACE = 2_000, 4096, 1 << 62
#: A text's size is the number of its words.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], total: int, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> list[float]:
    """Shares of `total` by weight (repeating), none above `repeats` times its size: what is cut off is shared again
    by weight among the rest until none is above."""
    out, left = [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(total)
    while left:
        unit = rest / sum(weights[i % len(weights)] for i in left)
        over = {i for i in left if weights[i % len(weights)] * unit > repeats * sizes[i]}
        if not over:
            for i in left:
                out[i] = weights[i % len(weights)] * unit
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
            rest -= out[i]
        left -= over
    return out


class MinCostFlow:
    """Maximum flow of least cost by shortest paths with potentials; all paths of one length are filled at once."""

    def __init__(self, n: int):
        self.arcs: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.arcs[x].append(len(self.to))
            self.to.append(y), self.room.append(r), self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        n = len(self.arcs)
        potential = [0] * n  # costs are not negative at the start
        while True:
            far = [None] * n
            far[source], heap = 0, [(0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for e in self.arcs[a]:
                    b = self.to[e]
                    if self.room[e] and (far[b] is None or d + self.cost[e] + potential[a] - potential[b] < far[b]):
                        far[b] = d + self.cost[e] + potential[a] - potential[b]
                        heapq.heappush(heap, (far[b], b))
            if far[sink] is None:
                return
            for v in range(n):
                potential[v] += far[v] if far[v] is not None else far[sink]
            while self._fill(source, sink, potential):
                pass

    def _fill(self, source: int, sink: int, potential: list[int]) -> int:
        """One path along arcs of reduced cost 0, filled."""
        came = {source: -1}
        queue = [source]
        for a in queue:
            for e in self.arcs[a]:
                b = self.to[e]
                if self.room[e] and b not in came and self.cost[e] + potential[a] - potential[b] == 0:
                    came[b] = e
                    queue.append(b)
            if sink in came:
                break
        else:
            return 0
        path, at = [], sink
        while came[at] >= 0:
            path.append(came[at])
            at = self.to[came[at] ^ 1]
        n = min(self.room[e] for e in path)
        for e in path:
            self.room[e] -= n
            self.room[e ^ 1] += n
        return n


#: What mix() adds to its rows.
RESULT = ("_size", "_source_size", "_target", "_repeats", "_taken")


class Plan(NamedTuple):
    sources: list[str | None]  # by code point, null last
    sizes: list[int]
    targets: list[float]
    quotas: list[int]  # targets in whole words, of the same sum
    flow: dict[tuple[tuple[int, ...], int], int]  # (pattern, source) -> words

    def of_pattern(self, pattern: tuple[int, ...]) -> int:
        return sum(self.flow.get((pattern, s), 0) for s in pattern)


def solve(patterns: dict[tuple[str | None, ...], int], weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, repeat_costs: Sequence[int] = REPEAT_COSTS) -> Plan:
    """Route the words of each membership pattern to the quotas of its sources: as much as can be, with as little
    repetition as can be. A pattern gives its words `repeats` times, each time at a higher cost."""
    sources = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s or ""))
    index = {s: i for i, s in enumerate(sources)}
    keyed = {tuple(sorted(index[s] for s in p)): n for p, n in patterns.items()}
    sizes = [sum(n for p, n in keyed.items() if i in p) for i in range(len(sources))]
    wanted = targets(sizes, sum(keyed.values()), weights, repeats)
    quotas = [int(t) for t in wanted]
    for i in sorted(range(len(wanted)), key=lambda i: (quotas[i] - wanted[i], i))[: round(sum(wanted)) - sum(quotas)]:
        quotas[i] += 1
    order = sorted(keyed)
    flow = MinCostFlow(2 + len(order) + len(sources))
    routes = {}
    for i, p in enumerate(order):
        for k in range(repeats):
            flow.arc(0, 2 + i, keyed[p], repeat_costs[min(k, len(repeat_costs) - 1)])
        for s in p:
            routes[p, s] = flow.arc(2 + i, 2 + len(order) + s, repeats * keyed[p])
    for s, q in enumerate(quotas):
        flow.arc(2 + len(order) + s, 1, q)
    flow.run(0, 1)
    return Plan(sources, sizes, wanted, quotas, {k: flow.room[e ^ 1] for k, e in routes.items()})


def nearest_fill(sizes: list[int], wanted: int, pool: int = 16) -> list[int]:
    """1 for each size taken: in order, each that still fits, or all but those that fill the excess in the same way from the
    end, whichever comes nearer to `wanted`. Sizes of 0 are never taken."""
    own = [i for i, n in enumerate(sizes) if n > 0]
    total = sum(sizes[i] for i in own)
    taken = _fill(sizes, own, wanted, pool)
    if sum(sizes[i] for i in taken) != wanted:
        other = set(own) - _fill(sizes, own[::-1], total - wanted, pool)
        taken = min(taken, other, key=lambda t: abs(wanted - sum(sizes[i] for i in t)))
    return [int(i in taken) for i in range(len(sizes))]


def _fill(sizes: list[int], own: list[int], wanted: int, pool: int) -> set[int]:
    """In order, each that still fits; then `pool` sizes are decided anew, so that the sum comes nearest to `wanted`: those
    around the first that didn't fit, or the last taken and the smallest left out."""
    taken, left, cut = set(), wanted, None
    for place, i in enumerate(own):
        if sizes[i] <= left:
            taken.add(i)
            left -= sizes[i]
        elif cut is None:
            cut = place
    if cut is None or not left:
        return taken
    first = max(0, min(cut - pool // 2, len(own) - pool))
    last = [i for i in own if i in taken][-pool // 2 :]
    small = sorted((i for i in own if i not in taken), key=lambda i: (sizes[i], i))[: pool - len(last)]
    best, chosen = abs(left), taken
    for near in (own[first : first + pool], [*last, *small]):
        sums = np.zeros(1, np.int64)
        for i in near:
            sums = np.concatenate([sums, sums + sizes[i]])
        off = np.abs(left + sum(sizes[i] for i in near if i in taken) - sums)
        if off.min() < best:
            best, bits = int(off.min()), int(off.argmin())
            chosen = (taken - set(near)) | {i for bit, i in enumerate(near) if bits >> bit & 1}
    return chosen


class _Range(NamedTuple):
    """Where in the seeded order of a pattern the rest ends: places below lo are taken, from hi on not, and of those between so
    many words are left to take."""

    lo: int
    hi: int
    left: int
    docs: int


def _narrowed(light: DataFrame, ranges: dict[int, _Range]) -> dict[int, _Range]:
    """The one of PARTS equal parts of each range in which its rest ends; the sums of the parts are a row each."""
    spark = light.sparkSession
    asked = F.broadcast(spark.createDataFrame([(k, r.lo, r.hi, -(-(r.hi - r.lo) // PARTS), r.left) for k, r in ranges.items()], "_p int, lo long, hi long, width long, left long"))
    inside = light.join(asked, "_p").where("_place >= lo AND _place < hi").withColumn("part", F.floor((F.col("_place") - F.col("lo")) / F.col("width")))
    sums = inside.groupBy("_p", "part", "lo", "hi", "width", "left").agg(F.sum("_size").alias("n"), F.count(F.lit(1)).alias("docs"))
    upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("_p").orderBy("part")))  # at most PARTS rows a pattern
    ends = upto.where("upto - n <= left AND left < upto").collect()  # a row for each pattern
    found = {}
    for r in ends:
        lo = r["lo"] + r["part"] * r["width"]
        found[r["_p"]] = _Range(lo, min(lo + r["width"], r["hi"]), r["left"] - (r["upto"] - r["n"]), r["docs"])
    return found


def mix(docs: DataFrame, members: Column, size: Column, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """docs with the columns RESULT (_target is that of the first of a row's sources); they replace columns of those names.

    members: an array of source names, which may hold null; a document in several sources has each word of it
    counted for one of them at a time. Whole documents are taken, 0 to `repeats` times each.

    Sizes are read once into a small table (pattern, size, place). They are pre-aggregated by membership pattern and the flow is
    solved over the patterns on the driver (at most MAX_PATTERNS). It says how many words each pattern gives: all its documents some
    number of times, and in a seeded order, that of a hash of the row, as many again as fill the rest. Where the rest ends is narrowed
    down by sums over parts of the hash space until STRETCH documents at most are left; these are decided one by one, by sizes and
    places alone. So a source of any size needs no task that sees all of it, and every run agrees.

    A null or empty array counts as one source, null. Null sizes are 0; documents of size 0 are never taken. Rows
    repeated under one id are decided one by one; of rows that are equal in every column it doesn't matter which one is taken. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    names = F.when(members.isNull() | (F.size(members) == 0), F.array(F.lit(None).cast("string"))).otherwise(F.array_sort(F.array_distinct(members)))
    own = F.struct(*(docs[c] for c in docs.columns)).alias("_row")
    words = F.coalesce(size, F.lit(0)).cast("long")
    hashed = [docs[id_col], *(docs[f.name] for f in docs.schema if f.name != id_col and not re.search("map<|variant", f.dataType.simpleString()))]
    place = F.pmod(F.xxhash64(F.lit(seed), *hashed), F.lit(SPACE))
    light = written(docs.select(names.alias("_pattern"), words.alias("_size"), place.alias("_place")), "sizes")
    rows = light.groupBy("_pattern").agg(F.sum("_size").alias("n"), F.count(F.lit(1)).alias("docs")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    plan = solve({tuple(r["_pattern"]): r["n"] for r in rows}, weights, repeats)
    index = {s: i for i, s in enumerate(plan.sources)}
    numbers = F.broadcast(spark.createDataFrame([(r["_pattern"], k) for k, r in enumerate(rows)], "_key array<string>, _p int"))
    numbered = light.join(numbers, F.col("_pattern").eqNullSafe(F.col("_key"))).select("_p", "_size", "_place")
    times, ranges = {}, {}
    for k, r in enumerate(rows):
        wanted = plan.of_pattern(tuple(sorted(index[s] for s in r["_pattern"])))
        times[k], rest = divmod(wanted, r["n"]) if r["n"] else (0, 0)
        ranges[k] = _Range(0, SPACE, rest, r["docs"]) if rest else _Range(0, 0, 0, 0)
    while wide := {k: r for k, r in ranges.items() if r.docs > STRETCH and r.hi - r.lo > 1}:
        ranges |= _narrowed(numbered, wide)
    per_pattern = []
    for k, r in enumerate(rows):
        first = min(index[s] for s in r["_pattern"])
        per_pattern.append((r["_pattern"], k, times[k], ranges[k].lo, ranges[k].hi, ranges[k].left, plan.sizes[first], plan.targets[first]))
    known = F.broadcast(spark.createDataFrame(per_pattern, "_key array<string>, _p int, _times long, _lo long, _hi long, _left long, _source_size long, _target double"))  # a row for each pattern

    def choose(batches: Iterator[Columns]) -> Iterator[Columns]:
        key, left, places, sizes = None, 0, [], []

        def out() -> Columns:
            nth = [0] * len(sizes)
            for i in range(1, len(sizes)):
                nth[i] = nth[i - 1] + 1 if (places[i], sizes[i]) == (places[i - 1], sizes[i - 1]) else 0
            return {"_q": [key] * len(sizes), "_at": places, "_n": sizes, "_nth": nth, "_more": nearest_fill(sizes, left)}

        for b in batches:
            for p, at, n, rest in zip(b["_p"], b["_place"], b["_size"], b["_left"], strict=True):
                if p != key:
                    if sizes:
                        yield out()
                    key, left, places, sizes = p, rest, [], []
                places.append(at), sizes.append(n)
        if sizes:
            yield out()

    ends = F.broadcast(spark.createDataFrame([(k, r.lo, r.hi, r.left) for k, r in ranges.items()], "_p int, _lo long, _hi long, _left long"))
    last = numbered.join(ends, "_p").where("_place >= _lo AND _place < _hi").repartition("_p").sortWithinPartitions("_p", "_place", "_size")
    chosen = written(arrow_map(last.select("_p", "_place", "_size", "_left"), choose, "_q int, _at long, _n long, _nth int, _more int"), "chosen")
    dropped(light)
    sized = docs.select(own, words.alias("_size"), names.alias("_pattern"), place.alias("_place"))
    placed = sized.join(known, F.col("_pattern").eqNullSafe(F.col("_key"))).drop("_key", "_pattern")
    at_end = (F.col("_place") >= F.col("_lo")) & (F.col("_place") < F.col("_hi"))
    whole = placed.where(~at_end).withColumn("_more", (F.col("_place") < F.col("_lo")).cast("int"))
    equal = Window.partitionBy("_p", "_place", "_size").orderBy("_place")
    decided = placed.where(at_end).withColumn("_i", F.row_number().over(equal) - 1)
    same = (F.col("_p") == F.col("_q")) & (F.col("_place") == F.col("_at")) & (F.col("_size") == F.col("_n")) & (F.col("_i") == F.col("_nth"))
    both = whole.unionByName(decided.join(chosen.hint("merge"), same).select(*whole.columns))
    often = F.when(F.col("_size") > 0, F.col("_times") + F.col("_more")).otherwise(0).cast("int")
    both = both.withColumn("_repeats", often).withColumn("_taken", F.col("_repeats") * F.col("_size"))
    return both.select(*(F.col(f"_row.`{c}`") for c in docs.columns if c not in RESULT), *RESULT)


def mixed_documents(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", **options: object) -> DataFrame:
    """The documents of the mix, each row as often as the mix takes it; columns stay as they are."""
    own = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), n_words(docs[text_col]).alias("words"), own)
    taken = mix(rows, F.array("source"), F.col("words"), id_col="id", **options).where("_repeats > 0")
    copies = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_repeats"))))
    return copies.select(*(F.col(f"row.`{c}`") for c in docs.columns))
