"""Near-duplicates by circulant MinHash, banding and an exact check of Jaccard similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Columns, WordHashes, arrow_map, as_bytes, dropped, mix64, shingle_hashes, tune, words_of, written
from sparkloom.llm.components import components

SHINGLE = 5
#: Links have 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: A pair at the threshold shares no band with at most this probability.
MISSED = 1 / 40_000
#: Coordinates of a signature at most.
COORDINATES = 128
#: Members of a bucket in one block (and their shingles), each held in memory, and members that are streamed past them in one task.
BLOCK, BLOCK_SHINGLES, STREAM = 512, 2_000_000, 8192

_CHUNK = 1 << 16


def banding(similarity: int = SIMILARITY) -> tuple[int, int]:
    """(bands, rows a band) of the longest bands with which a pair at the threshold is missed with probability MISSED at
    most, (1 - similarity ** rows) ** bands, in COORDINATES coordinates; 28 bands of 4 for 75."""
    s = min(max(similarity, 1), 99) / 100
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(MISSED) / math.log1p(-(s**rows)))
        if bands * rows <= COORDINATES or rows == 1:
            return bands, rows
    raise AssertionError


def _permuted(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit integers: xor-shifts and odd factors are bijections."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def circulant_signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """MinHash signatures (row per non-empty set of 64-bit elements) from two permutations of the 32-bit universe: the
    first, applied once, takes away any structure; coordinate i is the minimum of the second one, shifted circularly by i
    places."""
    sizes = np.array([len(s) for s in sets])
    out = np.empty((len(sets), k), np.uint32)
    ends = sizes.cumsum()
    first = 0
    while first < len(sets):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _CHUNK, "right")))
        part = np.concatenate(sets[first:last])
        mixed = _permuted((part ^ (part >> np.uint64(32))).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
        starts = np.concatenate([[0], sizes[first:last].cumsum()[:-1]])
        for i in range(k):
            out[first:last, i] = np.minimum.reduceat(_permuted(mixed + np.uint32(i), 0x21F0AAAD, 0xD35A2D97), starts)
        first = last
    return out


def shingle_set(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a sequence of word hashes."""
    return np.unique(shingle_hashes(words, k))


def _fingerprint(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def row_keys(id_: Column, text: Column) -> tuple[Column, Column]:
    """128 bits in two columns that tell rows with different ids or texts apart; never null."""
    return F.xxhash64(id_, text), F.xxhash64(text, id_, F.lit(1))


def _body(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    k1, k2 = row_keys(docs[id_col], as_bytes(text_col))
    return docs.select(docs[id_col].alias("id"), k1.alias("k1"), k2.alias("k2"), as_bytes(text_col).alias("t"))


def signatures(body: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """(id, k1, k2, n, c, bands) of each row of body(id, k1, k2, t): the size of its shingle set, a 128-bit fingerprint of the
    set, and a key for each band. Without words n is 0 and the rest null. Maps partitions; no shuffle."""
    bands, rows = banding(similarity)

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingle_set(hashes.of(words_of(t)), shingle) for t in b["t"]]
            full = [i for i, s in enumerate(sets) if len(s)]
            out = {k: b[k] for k in ("id", "k1", "k2")} | {"n": [len(s) for s in sets], "c": [None] * len(sets), "bands": [None] * len(sets)}
            if full:
                sig = circulant_signatures([sets[i] for i in full], bands * rows)
                keys = np.arange(bands, dtype=np.uint64)[None, :] + np.zeros((len(full), 1), np.uint64)
                for j in range(rows):
                    keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, j::rows])
                keys = keys.astype(np.int64)
                for row, i in enumerate(full):
                    out["c"][i], out["bands"][i] = _fingerprint(sets[i]), keys[row]
            yield out

    tune(body.sparkSession)
    return arrow_map(body, run, f"id {body.schema['id'].dataType.simpleString()}, k1 long, k2 long, n long, c binary, bands array<long>")


def _sets(body: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(c, n, s): the shingle sets, as bytes, of the classes of wanted(c, k1, k2), read from one row of each. Repeated rows
    with one id and text lie side by side behind the join and are read once."""
    # a merge join at every size: wanted grows with the input, so no size should rely on a broadcast
    texts = body.drop("id").join(wanted.hint("merge"), ["k1", "k2"]).select("c", "t")

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        hashes, before = WordHashes(), None
        for b in batches:
            out = {"c": [], "n": [], "s": []}
            for c, t in zip(b["c"], b["t"], strict=True):
                if c != before:
                    s = shingle_set(hashes.of(words_of(t)), shingle)
                    out["c"].append(c), out["n"].append(len(s)), out["s"].append(s.tobytes())
                    before = c
            yield out

    return arrow_map(texts, run, "c binary, n long, s binary")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Of pairs(x, p) of classes, those whose full shingle sets are similar; both sets are joined to a pair, so a task holds two."""
    own = sets.select(F.col("c").alias("x"), F.col("n").alias("n_x"), F.col("s").alias("s_x"))
    other = sets.select(F.col("c").alias("p"), F.col("n").alias("n_p"), F.col("s").alias("s_p"))
    both = pairs.join(own.hint("merge"), "x").join(other.hint("merge"), "p")
    both = both.where(F.least("n_x", "n_p") * 100 >= F.greatest("n_x", "n_p") * similarity)

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        for b in batches:
            good = []
            for i, (x, p) in enumerate(zip(b["s_x"], b["s_p"], strict=True)):
                x, p = np.frombuffer(x, np.uint64), np.frombuffer(p, np.uint64)
                common = len(np.intersect1d(x, p, assume_unique=True))
                if 100 * common >= similarity * (len(x) + len(p) - common):
                    good.append(i)
            yield {k: [b[k][i] for i in good] for k in ("x", "p")}

    return arrow_map(both.select("x", "p", "s_x", "s_p"), run, "x binary, p binary")


class Block:
    """Sets held in memory, with an index from elements to them; add() compares another set with all of them at once and
    returns the links that unite what no link has united so far."""

    def __init__(self, rows: list[tuple[bytes, bytes, bytes]], similarity: int):
        self.similarity, self.classes = similarity, [c for c, _, _ in rows]
        sets = [np.frombuffer(s, np.uint64) for _, _, s in rows]
        self.sizes = np.array([len(s) for s in sets])
        elements, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(elements, kind="stable")
        self.owners = owners[order]
        self.elements, starts = np.unique(elements[order], return_index=True)
        self.starts = np.append(starts, len(elements))
        self.labels: dict[bytes, int] = {}
        self.parents: list[int] = []
        self.own = np.array([self._label(label) for _, label, _ in rows])
        self.roots = self.own.copy()

    def _label(self, label: bytes) -> int:
        if label not in self.labels:
            self.labels[label] = len(self.parents)
            self.parents.append(len(self.parents))
        return self.labels[label]

    def _root(self, x: int) -> int:
        while self.parents[x] != x:
            self.parents[x] = self.parents[self.parents[x]]
            x = self.parents[x]
        return x

    def add(self, c: bytes, label: bytes, s: bytes) -> list[tuple[bytes, bytes]]:
        root = self._root(self._label(label))
        if (self.roots == root).all():
            return []
        s = np.frombuffer(s, np.uint64)
        at = np.searchsorted(self.elements, s)
        at = at[at < len(self.elements)]
        at = at[self.elements[at] == s[: len(at)]]
        lengths = self.starts[at + 1] - self.starts[at]
        flat = np.arange(lengths.sum()) + np.repeat(self.starts[at] - (lengths.cumsum() - lengths), lengths)
        common = np.bincount(self.owners[flat], minlength=len(self.sizes))
        found = []
        for i in np.flatnonzero((100 * common >= self.similarity * (self.sizes + len(s) - common)) & (self.roots != root)):
            other = self._root(int(self.own[i]))
            if other != (root := self._root(root)):
                self.parents[max(other, root)] = min(other, root)
                self.roots[(self.roots == other) | (self.roots == root)] = root = min(other, root)
                found.append((c, self.classes[i]))
        return found


def _crossing(buckets: DataFrame, labels: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (x, p) of full sets between classes that share a bucket and carry different labels: enough of them that what
    all links together unite is united.

    A bucket whose members all have the pivot's label is finished, and so is one of two members: the pair has been checked. In
    others the members with another label (left) are held block by block and all members are streamed past each block;
    no pair leaves it, only the links that unite two labels, so a block returns fewer rows than it has members.
    """
    named = buckets.join(labels, buckets["c"] == labels["node"], "left").select("key", "p", "c", "n", F.coalesce("label", "c").alias("label"))
    pivot = labels.select(F.col("node").alias("p"), F.col("label").alias("p_label"))
    named = written(named.join(pivot, "p", "left").select("key", "c", "n", "label", (F.col("label") != F.coalesce("p_label", "p")).alias("left")), "named")
    sums = named.groupBy("key").agg(F.count_if("left").alias("lefts"), F.sum(F.when(F.col("left"), F.col("n"))).alias("held"), F.count(F.lit(1)).alias("members"))
    blocks = F.greatest(F.ceil(F.col("lefts") / BLOCK), F.ceil(F.col("held") / BLOCK_SHINGLES))
    open_ = sums.where("lefts > 0 AND members > 2").select("key", blocks.alias("left_blocks"), F.ceil(F.col("members") / STREAM).alias("blocks"))
    at_hand = named.join(open_, "key").withColumns({"lb": F.pmod(F.xxhash64("c"), "left_blocks"), "b": F.pmod(F.xxhash64("c", F.lit(1)), "blocks")})
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rights = at_hand.select("key", each("left_blocks").alias("lb"), "b", F.lit(1).alias("role"), "c", "label")
    lefts = at_hand.where("left").select("key", "lb", each("blocks").alias("b"), F.lit(0).alias("role"), "c", "label")
    filled = lefts.union(rights).join(sets.select("c", "s").hint("merge"), "c")
    dealt = filled.repartition(F.col("key"), F.col("lb"), F.col("b")).sortWithinPartitions("key", "lb", "b", "role")

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        key, held, block = None, [], None
        for b in batches:
            links = []
            for k, lb, own, role, *row in zip(*(b[c] for c in ("key", "lb", "b", "role", "c", "label", "s")), strict=True):
                if (k, lb, own) != key:
                    key, held, block = (k, lb, own), [], None
                if role == 0:
                    held.append(row)
                elif held:
                    block = block or Block(held, similarity)
                    links += block.add(*row)
            yield {"x": [x for x, _ in links], "p": [p for _, p in links]}

    out = written(arrow_map(dealt.select("key", "lb", "b", "role", "c", "label", "s"), run, "x binary, p binary"), "crossing")
    dropped(named)
    return out


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: int) -> tuple[DataFrame, DataFrame]:
    """(id, k1, k2, n, c) of each row, and (c, component, k1, k2) of each class that has more than one row or a link: the
    smallest id of its group, and the key of the group's first row."""
    body = _body(docs, id_col, text_col)
    rows = written(signatures(body, shingle, similarity), "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2")).alias("first")
    classes = written(rows.where("n > 0").groupBy("c").agg(first, F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "classes")
    members = classes.select(F.explode("bands").alias("key"), "c", "n")
    pivots = members.groupBy("key").agg(F.min("c").alias("p"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "p")
    buckets = written(members.join(pivots.hint("merge"), "key"), "buckets")
    wanted = buckets.select("c").distinct().join(classes, "c").select("c", "first.k1", "first.k2")
    sets = written(_sets(body, wanted, shingle), "sets")
    # each class with the pivots of all its buckets, then every bucket that these links leave in parts
    links = written(_similar(buckets.where("c != p").select(F.col("c").alias("x"), "p").distinct(), sets, similarity), "verified")
    joined = components(links.select(F.col("x").alias("a"), F.col("p").alias("b"))).withColumnRenamed("root", "label")
    more = _crossing(buckets, joined, sets, similarity)
    # the links that are left to find join labels, not classes; the stars of the first pass stand for its links
    stars = joined.select(F.col("node").alias("a"), F.col("label").alias("b"))
    roots = components(stars.union(more.select("x", "p")))
    linked = classes.join(roots, classes["c"] == roots["node"], "left").where("node is not null or copies > 1").select("c", "first", F.coalesce("root", "c").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("smallest"))
    named = written(linked.join(smallest, "root").select("c", F.col("smallest.id").alias("component"), "smallest.k1", "smallest.k2"), "groups")
    for table in (classes, buckets, sets, links, joined, more, roots):
        dropped(table)
    return rows, named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable by links), kept (id = component_id).

    Rows with equal shingle sets are one class; what follows works on classes, so copies cost a row each. The pivot of
    a band bucket is its smallest member. Every class is compared on full sets with the pivots of all its buckets. A bucket that
    isn't joined by that is compared block by block, so no pair that shares a bucket is left out unless it is joined
    already; what leaves a block are links in proportion to its members. Bands follow from the similarity.

    Rows without words have an empty set, n_shingles 0 and no link: component_id is their own id. Null ids are never the
    smallest; a component of null ids alone has a null component_id, and its rows are kept. Repeated rows are linked
    like any copies and are all kept if their id is the component's. Different texts under one id are rows of their own. An
    empty table gives an empty result; other columns are not read.
    """
    rows, groups = _grouped(docs, id_col, text_col, shingle, similarity)
    # rows without words have no class; a class with a large share of all rows is split by AQE, as the join is an outer one with rows on the left
    named = rows.where("n > 0").select("id", "n", "c").join(groups.select("c", "component").hint("merge"), "c", "left")
    out = named.select("id", "n", F.coalesce("component", "id").alias("component")).union(rows.where("n = 0").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near-duplicates, that with the smallest id (of several, by a hash of the text);
    columns stay as they are.

    Rows are told apart by id and text, so of different texts under one id each stays or goes with its own group. Rows without words
    are in no group and stay, but of rows repeated with one id and text one stays. A group of null ids alone keeps one of them.
    """
    rows, groups = _grouped(docs, id_col, text_col, shingle, similarity)
    alone = rows.join(groups.select("c").hint("merge"), "c", "left_anti").select("k1", "k2")
    kept = written(alone.union(groups.select("k1", "k2")).distinct(), "kept")
    dropped(rows), dropped(groups)
    k1, k2 = row_keys(docs[id_col], as_bytes(text_col))
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    stay = keyed.join(kept.hint("merge"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return stay.select(*(F.col(f"row.`{c}`") for c in docs.columns))
