"""Substring dedup: shared k-mer seeds, collinear chains by a Fenwick tree, alignment of what lies between seeds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sparkloom.llm.common import Columns, WordHashes, arrow_map, as_bytes, dropped, mix64, shingle_hashes, tune, words_of, written

#: Words of a seed, and seeds of which the one with the smallest hash is kept: an exact repeat of
#: SEED + WINDOW - 1 = 11 words always shares a seed.
SEED, WINDOW = 6, 6
#: A chain may skip so many words in either text between two seeds; each skipped word costs GAP_COST of a matched one.
#: Where every 10th word is changed, seeds that survive are some 20 words apart.
MAX_GAP, GAP_COST = 48, 0.05
#: A chain needs so many words in all; touching chains together make a passage of at least MIN_WORDS.
MIN_CHAIN, MIN_WORDS = 16, 50
#: Share of a chain's words that must match; a chain is cut where of the words between two seeds less than GAP_IDENTITY do.
IDENTITY, GAP_IDENTITY = 0.8, 0.6
#: Passages of one text that lie at most so many words apart are one.
TOUCH = 4
#: Slices of texts are asked for in multiples of so many words, so that many chains ask for the same ones.
GRID = 32
#: Words beyond a chain's ends that are looked at first. Words that are alike further out mostly hold seeds, and these are in a chain of
#: their own, with whatever source has them first; touching chains make one passage. Where they hold none, GROW times as many words
#: are looked at, again and again, as long as the texts stay alike.
REACH, GROW = 21, 4
#: The slices wanted in a round (their texts' ids and two numbers each) are broadcast if they are at most so many, some 6 MB; else they
#: are joined by a shuffle.
FEW = 100_000


def version(text: Column) -> Column:
    """Tells rows with one id and different texts apart."""
    return F.xxhash64(text)


def _extremes(x: np.ndarray, window: int, pick: np.ufunc) -> np.ndarray:
    """The smallest or largest of each `window` neighbours, by doubling."""
    done = 1
    while done < window:
        step = min(done, window - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def minimizers(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest value of each window of values; of equal values side by side the first."""
    if len(hashes) <= window:
        return np.array([int(np.argmin(hashes))]) if len(hashes) else np.zeros(0, np.int64)
    least = _extremes(hashes, window, np.minimum)
    around = np.zeros(window - 1, hashes.dtype)
    chosen = _extremes(np.concatenate([around, least, around]), window, np.maximum) == hashes
    chosen[1:] &= ~(chosen[:-1] & (hashes[1:] == hashes[:-1]))
    return np.flatnonzero(chosen)


def occurrences(h: np.ndarray) -> np.ndarray:
    """For each value, how many equal ones stand before it."""
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(h) else np.zeros(0, np.int64)
    out = np.empty(len(h), np.int32)
    out[order] = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    return out


def seeds(docs: DataFrame, seed: int = SEED, window: int = WINDOW) -> DataFrame:
    """(h, nth, doc, v, pos): the chosen k-mers of every text of docs(doc, v, t); nth counts a k-mer's occurrences in its text
    from 0. Maps partitions."""

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        known = WordHashes()
        for b in batches:
            found = []
            for t in b["t"]:
                words = words_of(t)
                h = mix64(shingle_hashes(known.of(words), seed)) if len(words) >= seed else np.zeros(0, np.uint64)
                at = minimizers(h, window)
                found.append((h[at].astype(np.int64), occurrences(h[at]), at.astype(np.int32)))
            sizes = [len(h) for h, _, _ in found]
            out = {k: np.concatenate([f[i] for f in found]) for i, k in enumerate(("h", "nth", "pos"))}
            yield out | {"doc": np.repeat(np.array(b["doc"], np.int64), sizes), "v": np.repeat(np.array(b["v"], np.int64), sizes)}

    return arrow_map(docs, run, "h long, nth int, doc long, v long, pos int")


_PLACE = ("doc", "v", "pos")


def anchors(seeded: DataFrame) -> DataFrame:
    """(doc, v, pos, src, src_v, src_pos): each seed that an earlier document has, with a place of it there.

    The nth occurrence in a text refers to the nth occurrence in the first document that has as many, so that texts of
    repeated lines are collinear; where no earlier document has as many, to the very first place.

    The seeds are dealt out in ranges of (h, nth, doc, v, pos), so that one very frequent seed is spread over many tasks; in
    each, the first row of a run of equal (h, nth) is the place that the others refer to. A run that goes on from the
    range before begins in another task: the first places of each range's first and last run and of its last seed's
    occurrences 0 (three rows a range) tell where it really began, and are the only thing that goes to the driver and, with the next
    step, back. Repeated rows of one seed, which lie side by side, count once.
    """
    key = ("h", "nth", *_PLACE)
    dealt = seeded.select(*key).repartitionByRange(*key).sortWithinPartitions(*key)
    names = ("kind", *key, "src", "src_v", "src_pos")

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        first = last = zero = before = None  # the range's first run, the latest one, the latest with nth 0, and the latest row
        edges: dict[tuple, tuple] = {}
        for b in batches:
            h, nth, *place = (b[c] for c in key)
            n = len(h)
            new, again = np.empty(n, bool), np.zeros(n, bool)
            new[1:] = (h[1:] != h[:-1]) | (nth[1:] != nth[:-1])
            again[1:] = ~new[1:] & (place[0][1:] == place[0][:-1]) & (place[1][1:] == place[1][:-1]) & (place[2][1:] == place[2][:-1])
            new[0] = last is None or last[:2] != (h[0], nth[0])
            again[0] = before == (h[0], nth[0], *(x[0] for x in place))
            if first is None:
                first = (h[0], nth[0], *(x[0] for x in place))
                edges[first[:2]] = first[2:]
            rows = np.arange(n)
            begin = np.maximum.accumulate(np.where(new, rows, -1))
            src = [np.where(begin < 0, 0 if last is None else last[2 + i], x[begin]) for i, x in enumerate(place)]
            # a first run with nth 0 may have begun in the range before
            nought = np.maximum.accumulate(np.where(new & (nth == 0) & (h != first[0]), rows, -1))
            z_known = np.where(nought < 0, zero is not None and zero[0] == h, h[nought] == h)
            z = [np.where(nought < 0, 0 if zero is None else zero[1 + i], x[nought]) for i, x in enumerate(place)]
            back = (src[0] == place[0]) & (nth > 0)  # no earlier document has as many
            src = [np.where(back & z_known, y, x) for x, y in zip(src, z, strict=True)]
            open_ = (h == first[0]) & ((nth == first[1]) | (back & ~z_known))
            keep = ~again & ((src[0] != place[0]) | open_)
            yield {"kind": open_[keep].astype(np.int32)} | {c: x[keep] for c, x in zip(names[1:], (h, nth, *place, *src), strict=True)}
            if begin[-1] >= 0:
                last = (h[begin[-1]], nth[begin[-1]], *(x[begin[-1]] for x in place))
            if nought[-1] >= 0:
                zero = (h[nought[-1]], *(x[nought[-1]] for x in place))
            before = (h[-1], nth[-1], *(x[-1] for x in place))
        if first is not None:
            edges.setdefault(last[:2], last[2:])
            if zero is not None and zero[0] == last[0]:
                edges.setdefault((zero[0], 0), zero[1:])
            rows = [(2, *k, *x, *x) for k, x in edges.items()]
            yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    seeded.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    found = written(arrow_map(dealt, run, "kind int, h long, nth int, doc long, v long, pos int, src long, src_v long, src_pos int", arrays=True), "anchors")
    tune(seeded.sparkSession)
    ends = found.where("kind = 2").select(*key).distinct().orderBy(*key).collect()  # at most three a range
    begun: dict[tuple, tuple] = {}
    for h, nth, *place in ends:
        begun.setdefault((h, nth), tuple(place))

    def resolve(batches: Iterator[Columns]) -> Iterator[Columns]:
        for b in batches:
            src = [b[c].copy() for c in ("src", "src_v", "src_pos")]
            open_ = np.flatnonzero(b["kind"] == 1)
            h, nth, doc = b["h"][open_], b["nth"][open_], b["doc"][open_]
            cuts = [0, *(np.flatnonzero((h[1:] != h[:-1]) | (nth[1:] != nth[:-1])) + 1), len(h)] if len(h) else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                own = begun.get((h[lo], nth[lo]), begun[h[lo], 0])
                for i, (x, y) in enumerate(zip(own, begun.get((h[lo], 0), own), strict=True)):
                    src[i][open_[lo:hi]] = np.where((doc[lo:hi] == own[0]) & (nth[lo] > 0), y, x)
            keep = (src[0] != b["doc"]) & (b["kind"] < 2)
            yield {c: x[keep] for c, x in zip((*_PLACE, "src", "src_v", "src_pos"), (*(b[c] for c in _PLACE), *src), strict=True)}

    return arrow_map(found, resolve, "doc long, v long, pos int, src long, src_v long, src_pos int", arrays=True)


class Fenwick:
    """The largest (value, item) among keys below a limit."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-np.inf, -1)] * (n + 1)

    def add(self, key: int, value: tuple[float, int]) -> None:
        key += 1
        while key < len(self.best):
            if value > self.best[key]:
                self.best[key] = value
            key += key & -key

    def below(self, key: int) -> tuple[float, int]:
        out = (-np.inf, -1)
        while key > 0:
            if self.best[key] > out:
                out = self.best[key]
            key -= key & -key
        return out


def chains(pos: list[int], src: list[int], seed: int = SEED, max_gap: int = MAX_GAP, gap_cost: float = GAP_COST) -> list[list[int]]:
    """Disjoint chains of anchors (pos ascending), best first, each a list of indexes that ascend in both texts.

    A chain scores `seed` for each anchor and pays gap_cost for each word by which either text goes on to the next
    anchor beyond the seed; the best predecessor of an anchor is the largest score + gap_cost * (pos + src) among the
    anchors with a smaller src, which a Fenwick tree over src gives. A link that skips more than max_gap words in either
    text, or over which the texts drift apart by more, cuts the chain.
    """
    rank = {s: i for i, s in enumerate(sorted(set(src)))}
    tree, score, before = Fenwick(len(rank)), [0.0] * len(pos), [-1] * len(pos)
    i = 0
    while i < len(pos):
        j = i
        while j < len(pos) and pos[j] == pos[i]:  # anchors at one place are no predecessors of each other
            value, best = tree.below(rank[src[j]])
            value -= gap_cost * (pos[j] + src[j] - 2 * seed)
            score[j] = seed
            if best >= 0 and value > 0 and max(pos[j] - pos[best], src[j] - src[best]) - seed <= max_gap and abs((pos[j] - pos[best]) - (src[j] - src[best])) <= max_gap:
                score[j], before[j] = seed + value, best
            j += 1
        for m in range(i, j):
            tree.add(rank[src[m]], (score[m] + gap_cost * (pos[m] + src[m]), m))
        i = j
    out, used = [], [False] * len(pos)
    for i in sorted(range(len(pos)), key=lambda m: (-score[m], pos[m], src[m])):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


#: One row for each piece of a chain, numbered by seq: kind 0 words under seeds, 1 before them, 2 between seeds, 3 behind them.
#: free: how many words beyond an end no chain has a seed in.
_PIECE = "doc long, v long, src long, src_v long, chain int, seq int, kind int, lo int, hi int, src_lo int, src_hi int, matched int, free int"
_ANY = 2**30


def _chain_rows(pos: list[int], src: list[int], seed: int, max_gap: int, reach: int) -> Iterator[list[tuple]]:
    """The pieces (kind, lo, hi, src_lo, src_hi, matched) of each chain, in order."""
    for chain in chains(pos, src, seed, max_gap):
        i = chain[0]
        out = [(1, max(0, pos[i] - reach), pos[i], max(0, src[i] - reach), src[i], 0)]
        lo, s_lo, hi, s_hi = pos[i], src[i], pos[i] + seed, src[i] + seed
        for i in chain[1:]:
            a, b = pos[i], src[i]
            if a - b == lo - s_lo and a <= hi:  # overlapping or touching seeds on one diagonal
                hi, s_hi = a + seed, b + seed
                continue
            shift = max(hi - a, s_hi - b, 0)  # seeds that overlap on another diagonal are cut at the front
            if shift >= seed:
                continue
            out.append((0, lo, hi, s_lo, s_hi, hi - lo))
            out.append((2, hi, a + shift, s_hi, b + shift, 0))
            lo, s_lo, hi, s_hi = a + shift, b + shift, a + seed, b + seed
        out.append((0, lo, hi, s_lo, s_hi, hi - lo))
        out.append((3, hi, hi + reach, s_hi, s_hi + reach, 0))
        yield out


def zones(pos: np.ndarray, seed: int, max_gap: int, reach: int, min_words: int) -> np.ndarray:
    """Of seeds' places (ascending), those that can be in a passage of min_words: seeds that no chain can link and whose reaches
    don't touch part the text into zones, and a zone's seeds and what can be reached from them must be long enough."""
    cut = np.flatnonzero(np.diff(pos) > seed + max(max_gap, 2 * reach + TOUCH)) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(pos)]])
    long = pos[ends - 1] + seed - pos[starts] + 2 * reach >= min_words
    return np.repeat(long, ends - starts)


def chain_pieces(found: DataFrame, seed: int = SEED, max_gap: int = MAX_GAP, reach: int = REACH, min_words: int = MIN_WORDS) -> DataFrame:
    """Chains of each document's anchors. They are grouped by the later document: an anchor for each of its
    seeds at most, so a group is bounded by one text however many copies there are.

    Every chain that can be in a passage goes on to alignment. Where a source lacks a word, the seeds over it have another source;
    those small chains lie within the span of the large one, but only alignment tells whether that one really matches there.
    """
    dealt = found.repartition("doc", "v").sortWithinPartitions("doc", "v", "pos")
    names = [c.split()[0] for c in _PIECE.split(", ")]

    def close(key: tuple, rows: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        own: dict[tuple, list[tuple]] = {}
        for fits, (pos, src, src_v, src_pos) in zip(zones(np.array([r[0] for r in rows]), seed, max_gap, reach, min_words), rows, strict=True):
            if fits:
                own.setdefault((src, src_v), []).append((pos, src_pos))
        found = [(source, c) for source in sorted(own) for c in _chain_rows([p for p, _ in own[source]], [p for _, p in own[source]], seed, max_gap, reach)]
        taken = [(p[1], p[2]) for _, c in found for p in c if p[0] == 0]
        begins, ends = np.sort([a for a, _ in taken]), np.sort([b for _, b in taken])
        for number, (source, pieces) in enumerate(found):
            for i, p in enumerate(pieces):
                free = 0
                if p[0] == 3:  # to the next such words that end behind this end
                    at = np.searchsorted(ends, p[1], "right")
                    free = max(0, int(begins[at]) - p[1]) if at < len(ends) else _ANY
                elif p[0] == 1:  # back to the last ones that begin before this beginning
                    at = np.searchsorted(begins, p[2])
                    free = max(0, p[2] - int(ends[at - 1])) if at else _ANY
                out.append((*key, *source, number, i, *p, free))
        return out

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        key, own = None, []
        for b in batches:
            rows = []
            for doc, v, *row in zip(*(b[c] for c in ("doc", "v", "pos", "src", "src_v", "src_pos")), strict=True):
                if (doc, v) != key:
                    if key:
                        rows += close(key, own)
                    key, own = (doc, v), []
                own.append(row)
            if rows:
                yield dict(zip(names, zip(*rows, strict=True), strict=True))
        if key and (rows := close(key, own)):
            yield dict(zip(names, zip(*rows, strict=True), strict=True))

    return arrow_map(dealt, run, _PIECE)


def common_words(a: np.ndarray, b: np.ndarray, enough: float = 2.0) -> int:
    """The longest common subsequence of two short sequences of words; a smaller one if that is at least the share
    `enough` of the longer: equal words place by place, or at both ends."""
    if not len(a) or not len(b):
        return 0
    n = min(len(a), len(b))
    front, back = a[:n] == b[:n], a[::-1][:n] == b[::-1][:n]
    if len(a) == len(b) and (same := int(front.sum())) >= enough * n:
        return same
    ends = (n if front.all() else int(front.argmin())) + (n if back.all() else int(back.argmin()))
    if min(ends, n) >= enough * max(len(a), len(b)):
        return min(ends, n)
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        new = row.copy()
        new[1:] = np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0))
        row = np.maximum.accumulate(new)
    return int(row[-1])


def extension(a: np.ndarray, b: np.ndarray, slack: int = 3) -> tuple[int, int, int]:
    """How far two sequences that begin at the same place stay alike: (words of a, words of b, matched).

    Equal words are worth 1, a change, an extra or a missing word costs 1. Edit by edit, the words of a that can be reached on
    each diagonal (off by `slack` at most) are carried on over equal words; the best end is taken, and the search
    stops when nothing is within `slack` of it.
    """
    a, b = a.tolist(), b.tolist()
    n, m = len(a), len(b)

    def slide(i: int, d: int) -> int:
        while i < n and i + d < m and a[i] == b[i + d]:
            i += 1
        return i

    i = slide(0, 0)
    best, top, edits, reached = (i, i, i), i, 0, {0: (i, i)}  # of a diagonal: words of a, matched
    while i < max(n, m):
        edits += 1
        new: dict[int, tuple[int, int]] = {}
        for d, (i, matched) in reached.items():
            for to, at in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):  # a changed word, one more in a, one more in b
                if abs(to) <= slack and at <= n and 0 <= at + to <= m:
                    end = slide(at, to)
                    if (got := (end, matched + end - at)) > new.get(to, (-1, -1)):
                        new[to] = got
        for d, (i, matched) in new.items():
            if matched - edits > top:
                top, best = matched - edits, (i, i + d, matched)
        reached = {d: x for d, x in new.items() if x[1] - edits >= top - slack}
        if not reached:
            break
        i = min(x[0] for x in reached.values())
    return best


def align(pieces: DataFrame, docs: DataFrame) -> DataFrame:
    """The pieces with their matched words and with the ends of kinds 1 and 3 where the texts stop being alike. Words between two
    seeds of which too few match become an end (3) and a beginning (1).

    Ends that are alike as far as was looked, where no chain has seeds further out, are looked at again, GROW times as far, until the
    texts differ or one is at its end.
    """
    pieces = pieces.withColumn("seq", (4 * F.col("seq")).cast("int"))
    done, asked = pieces.where("kind = 0"), pieces.where("kind > 0")
    while True:
        aligned = _align(asked, docs)
        done = done.unionByName(aligned.where("more = 0").select(*done.columns))
        asked = aligned.where("more = 1").drop("more")
        if asked.isEmpty():
            return done


def _align(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """The asked pieces, aligned (more: 0), or to be looked at again with the words that then are wanted (more: 1).

    Only the words around the ends and between seeds are fetched, as 32-bit word hashes: distinct slices on a grid of GRID
    words are cut from the texts, joined to the pieces that need them from either side, and aligned.
    """
    grid = lambda c, up: (F.floor((F.col(c) + (GRID - 1 if up else 0)) / GRID) * GRID).cast("int")
    asked = asked.withColumns({"g_lo": grid("lo", False), "g_hi": grid("hi", True), "s_lo": grid("src_lo", False), "s_hi": grid("src_hi", True)})
    own = asked.select("doc", "v", F.col("g_lo").alias("from"), F.col("g_hi").alias("to"))
    other = asked.select(F.col("src").alias("doc"), F.col("src_v").alias("v"), F.col("s_lo").alias("from"), F.col("s_hi").alias("to"))
    # the slices of one text are as many as it has words at most
    wanted = own.union(other).distinct().groupBy("doc", "v").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"))
    wanted = written(wanted, "wanted")
    few = wanted.agg(F.sum(F.size("spans"))).first()[0] or 0
    texts = docs.join(F.broadcast(wanted) if few <= FEW else wanted.hint("merge"), ["doc", "v"]).select("doc", "v", "t", "spans")

    def cut(batches: Iterator[Columns]) -> Iterator[Columns]:
        known, before = WordHashes(), None
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc", "v", "from", "to", "w")}
            for doc, v, t, spans in zip(b["doc"], b["v"], b["t"], b["spans"], strict=True):
                if (doc, v) == before:  # rows repeated under one id lie side by side behind the join
                    continue
                before, words = (doc, v), known.of(words_of(t)).astype(np.uint32)
                for span in spans:
                    for k, x in zip(out, (doc, v, span["from"], span["to"], words[span["from"] : span["to"]].tobytes()), strict=True):
                        out[k].append(x)
            yield out

    slices = written(arrow_map(texts, cut, "doc long, v long, from int, to int, w binary").dropDuplicates(["doc", "v", "from", "to"]), "slices")
    a = slices.select(F.col("doc").alias("a_doc"), F.col("v").alias("a_v"), F.col("from").alias("a_from"), F.col("to").alias("a_to"), F.col("w").alias("a_w"))
    b = slices.select(F.col("doc").alias("b_doc"), F.col("v").alias("b_v"), F.col("from").alias("b_from"), F.col("to").alias("b_to"), F.col("w").alias("b_w"))
    both = asked.join(a, (F.col("doc") == F.col("a_doc")) & (F.col("v") == F.col("a_v")) & (F.col("g_lo") == F.col("a_from")) & (F.col("g_hi") == F.col("a_to")))
    both = both.join(b, (F.col("src") == F.col("b_doc")) & (F.col("src_v") == F.col("b_v")) & (F.col("s_lo") == F.col("b_from")) & (F.col("s_hi") == F.col("b_to")))
    names = ("doc", "v", "src", "src_v", "chain", "seq", "kind", "lo", "hi", "src_lo", "src_hi", "free")
    kinds = _PIECE + ", more int"
    columns = [k.split()[0] for k in kinds.split(", ")]
    slack = 3

    def further(lo: int, hi: int, m: int, n: int, x: np.ndarray, y: np.ndarray, free: int) -> int:
        """How far to look next; 0 if the texts differ before the end of what was looked at, or that was all there is."""
        whole = len(x) == len(y) == hi - lo
        return min(GROW * (hi - lo), free) if whole and free > hi - lo and max(m, n) >= hi - lo - slack else 0

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        for c in batches:
            out = []
            for *chain, seq, kind, lo, hi, s_lo, s_hi, free, g, s, aw, bw in zip(*(c[k] for k in (*names, "g_lo", "s_lo", "a_w", "b_w")), strict=True):
                x, y = np.frombuffer(aw, np.uint32)[lo - g : hi - g], np.frombuffer(bw, np.uint32)[s_lo - s : s_hi - s]
                if kind == 2:
                    matched = common_words(x, y, GAP_IDENTITY)
                    if matched >= GAP_IDENTITY * max(len(x), len(y)) or max(len(x), len(y)) <= TOUCH:
                        out.append((*chain, seq, 2, lo, hi, s_lo, s_hi, matched, 0, 0))
                        continue
                if kind != 1:
                    m, n, matched = extension(x, y, slack)
                    if kind == 3 and (far := further(lo, hi, m, n, x, y, free)):
                        out.append((*chain, seq, 3, lo, lo + far, s_lo, s_lo + far, 0, free, 1))
                    else:
                        out.append((*chain, seq, 3, lo, lo + m, s_lo, s_lo + n, matched, 0, 0))
                if kind != 3:
                    m, n, matched = extension(x[::-1], y[::-1], slack)
                    if kind == 1 and lo and s_lo and (far := further(lo, hi, m, n, x, y, free)):
                        out.append((*chain, seq, 1, max(0, hi - far), hi, max(0, s_hi - far), s_hi, 0, free, 1))
                    else:
                        out.append((*chain, seq + (kind == 2), 1, hi - m, hi, s_hi - n, s_hi, matched, 0, 0))
            yield dict(zip(columns, zip(*out, strict=True), strict=True)) if out else dict.fromkeys(columns, [])

    out = written(arrow_map(both.select(*names, "g_lo", "s_lo", "a_w", "b_w"), run, kinds), "aligned")
    dropped(slices), dropped(wanted)
    return out


def _passages(aligned: DataFrame, min_chain: int, min_words: int, identity: float) -> DataFrame:
    """A row for each run of touching chains with enough equal words that is long enough: its span, its longest chain, and the
    sources of all its chains. A group is the pieces of one document."""
    dealt = aligned.repartition("doc", "v").sortWithinPartitions("doc", "v", "chain", "seq")
    names = ("doc", "v", "lo", "hi", "src", "src_lo", "src_hi", "matched", "run_lo", "run_hi", "sources")

    def whole(chain: list[tuple]) -> list[tuple]:
        """Chains, cut where words don't match, as (lo, hi, src, src_lo, src_hi, matched)."""
        out, now = [], None
        for kind, src, lo, hi, s_lo, s_hi, matched in chain:
            if kind == 1 or now is None:
                now = [lo, hi, src, s_lo, s_hi, 0]
            now[1], now[4], now[5] = hi, s_hi, now[5] + matched
            if kind == 3:
                out.append(tuple(now))
                now = None
        return [c for c in out if c[1] - c[0] >= min_chain and c[5] >= identity * max(c[1] - c[0], c[4] - c[3])]

    def runs(key: tuple, own: list[tuple]) -> list[tuple]:
        out, run, end = [], [], 0
        for c in (*sorted(own), None):
            if run and (c is None or c[0] > end + TOUCH):
                if end - run[0][0] >= min_words:
                    main = max(run, key=lambda r: (r[5], -r[2], -r[0]))
                    out.append((*key, *main, run[0][0], end, sorted({r[2] for r in run})))
                run = []
            if c is not None:
                end = max(end, c[1]) if run else c[1]
                run.append(c)
        return out

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        key, number, chain, own = None, None, [], []
        for b in batches:
            done = []
            for doc, v, n, *piece in zip(*(b[c] for c in ("doc", "v", "chain", "kind", "src", "lo", "hi", "src_lo", "src_hi", "matched")), strict=True):
                if (doc, v) != key or n != number:
                    own += whole(chain)
                    chain = []
                    if (doc, v) != key:
                        if key:
                            done += runs(key, own)
                        own = []
                    key, number = (doc, v), n
                chain.append(tuple(piece))
            yield dict(zip(names, zip(*done, strict=True), strict=True)) if done else dict.fromkeys(names, [])
        if key and (done := runs(key, own + whole(chain))):
            yield dict(zip(names, zip(*done, strict=True), strict=True))

    return arrow_map(dealt, run, "doc long, v long, lo int, hi int, src long, src_lo int, src_hi int, matched int, run_lo int, run_hi int, sources array<long>")


def _found(docs: DataFrame, id_col: str, text_col: str, min_words: int, identity: float) -> DataFrame:
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} is {kind.simpleString()}: ids are whole numbers, as their order tells which document is the earlier one")
    tune(docs.sparkSession)
    text = as_bytes(text_col)
    body = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("doc"), version(text).alias("v"), text.alias("t"))
    seeded = written(seeds(body), "seeds")
    found = anchors(seeded)
    dropped(seeded)
    pieces = written(chain_pieces(found, min_words=min_words), "pieces")
    dropped(found)
    return _passages(align(pieces, body), MIN_CHAIN, min_words, identity)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """Passages that an earlier document (one with a smaller id) has too, exactly or with small changes.

    A row for each passage: id, passage_first, passage_last (words from 0, inclusive; at least min_words of them), source_ids (the
    documents that it is from), and the longest stretch with one source: first_word, last_word, source_id, source_first,
    source_last, words, matched (equal words). Words are lower-cased runs of bytes other than ASCII white space; whole
    texts are read.

    Every seed refers to one earlier place only, so a passage in n documents costs n references and no pair of
    the later ones; each later document has a row for it. Ids are whole numbers; others are a TypeError. Rows without an id and
    texts with fewer words than a seed give nothing; rows repeated under one id are one document and never repeat each other,
    different texts under one id are handled apart; an empty table gives an empty result; other columns are not read.
    """
    p = _found(docs, id_col, text_col, min_words, identity)
    kind = docs.schema[id_col].dataType
    return p.select(
        F.col("doc").cast(kind).alias(id_col), F.col("lo").alias("first_word"), (F.col("hi") - 1).alias("last_word"), F.col("src").cast(kind).alias("source_id"), F.col("src_lo").alias("source_first"),
        (F.col("src_hi") - 1).alias("source_last"), (F.col("hi") - F.col("lo")).alias("words"), "matched", F.col("run_lo").alias("passage_first"), (F.col("run_hi") - 1).alias("passage_last"), F.col("sources").cast(f"array<{kind.simpleString()}>").alias("source_ids"),
    )


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of each [from, to) and the white space behind them."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for lo, hi in sorted(spans):
        lo, hi = min(lo, len(starts) - 1), min(hi, len(starts) - 1)
        out.append(text[at : starts[lo]])
        at = max(at, starts[hi])
    out.append(text[at:])
    return b"".join(out)


def cut_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """docs with the repeated passages cut out of their texts; rows left without a word go. Columns stay as they are.

    The first document that has a passage keeps it. Rows without an id, null texts and texts without repeated passages
    come through unchanged.
    """
    runs = _found(docs, id_col, text_col, min_words, identity).select(F.col("doc").alias("_doc"), F.col("v").alias("_v"), "run_lo", "run_hi")
    cuts = written(runs.groupBy("_doc", "_v").agg(F.sort_array(F.collect_list(F.struct("run_lo", "run_hi"))).alias("_cuts")), "cuts")
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].cast("long").alias("id"), version(as_bytes(text_col)).alias("key"))
    joined = keyed.join(cuts.hint("merge"), (F.col("id") == F.col("_doc")) & (F.col("key") == F.col("_v")), "left")
    tune(docs.sparkSession)

    @F.pandas_udf("string")
    def shortened(text, spans):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([without(t.encode(), [(c["run_lo"], c["run_hi"]) for c in s]).decode() for t, s in zip(text, spans, strict=True)], dtype=object)

    cut = joined.where("_cuts is not null").withColumn("new_text", shortened(F.col(f"row.`{text_col}`"), F.col("_cuts")))
    cut = cut.where(F.col("new_text").rlike(r"[^\x20\x09-\x0D]"))
    new = {text_col: F.col("new_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("new_text").cast(docs.schema["n_chars"].dataType)
    whole = joined.where("_cuts is null").select(*(F.col(f"row.`{c}`") for c in docs.columns))
    return whole.unionByName(cut.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns)))
