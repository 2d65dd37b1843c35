"""Best-fit packing into bins of several permitted lengths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Columns, arrow_map, written

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Pieces that are packed together. Every block leaves a few bins that aren't full, far below a thousandth.
BLOCK = 50_000
#: Copies of one piece that go to one block.
LOT = 1_000
#: A bin costs its length, a share that grows with the square of the length (attention), and a constant.
SQUARE, FIXED = 1 / 65_536, 16.0


def bin_cost(length: int) -> float:
    return length + SQUARE * length * length + FIXED


class Bin:
    __slots__ = ("capacity", "items", "used")

    def __init__(self, capacity: int):
        self.capacity, self.used, self.items = capacity, 0, []


def pack_block(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> list[Bin]:
    """Best-fit decreasing over bins of several capacities; items are indexes into sizes (1 to max(lengths) each).

    An item goes to the open bin with the least room that holds it. If there is none, the bin of least cost is opened:
    its own cost less what its room will be worth to smaller items, priced at the cheapest cost a word, as far as there
    are words left to fill it. At the end every bin shrinks to the shortest permitted length that holds its
    contents.
    """
    lengths = sorted(lengths)
    price = min(bin_cost(n) / n for n in lengths)
    waiting = sum(sizes)
    by_room: dict[int, list[Bin]] = {}
    rooms = 0  # bit r: some open bin has room r
    bins = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        waiting -= s
        if fitting := rooms >> s:
            room = s + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b = Bin(min((n for n in lengths if n >= s), key=lambda n: (bin_cost(n) - price * min(n - s, waiting), n)))
            bins.append(b)
        b.items.append(i)
        b.used += s
        if room := b.capacity - b.used:
            by_room.setdefault(room, []).append(b)
            rooms |= 1 << room
    for b in bins:
        b.capacity = next(n for n in lengths if n >= b.used)
    return bins


def pack(docs: DataFrame, size: Column, lengths: Sequence[int] = LENGTHS, id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row a bin: bin (block, number), capacity, used, n_pieces, and doc_ids, starts, sizes of its pieces.

    A document longer than the longest bin is cut into pieces of that length and a rest; starts are offsets in units of
    size. Every unit of every row is in one bin, rows repeated under one id each time. Rows of size 0 or null fill
    nothing and are in no bin; null ids stay null; an empty table gives an empty result; other columns are not read.

    Pieces go to blocks by a hash, as many blocks as BLOCK pieces each make; equal pieces (id, size) are counted first and
    dealt out in lots, so that neither many copies of one document nor one very long document fill a block. Only
    ids and sizes are shuffled; a task holds one block.
    """
    longest = max(lengths)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(size, F.lit(0)).cast("long").alias("size")).where("size > 0")
    counted = written(rows.groupBy("id", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")  # sizes are read from texts once
    total = counted.agg(F.sum(F.col("n") * F.ceil(F.col("size") / longest))).first()[0] or 0
    blocks = max(1, -(-total // block))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / longest)))
    cut = counted.select("id", "size", "n", piece.alias("piece"))
    cut = cut.select("id", "size", "n", "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LOT))).alias("lot"))
    cut = cut.select(
        "id",
        (F.col("piece") * longest).alias("start"),
        F.least(F.lit(longest).cast("long"), F.col("size") - F.col("piece") * longest).alias("words"),
        F.least(F.lit(LOT).cast("long"), F.col("n") - F.col("lot") * LOT).alias("copies"),
        F.pmod(F.xxhash64("id", "size", "piece", "lot"), F.lit(blocks)).alias("block"),
    )
    dealt = cut.repartition("block").sortWithinPartitions("block", F.desc("words"), "id", "start", "copies")

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        def out(block: int, items: list[tuple]) -> Columns:
            bins = pack_block([w for _, _, w in items], lengths)
            own = [[items[i] for i in b.items] for b in bins]
            return {
                "bin": [f"{block}-{i}" for i in range(len(bins))], "capacity": [b.capacity for b in bins], "used": [b.used for b in bins], "n_pieces": [len(b.items) for b in bins],
                "doc_ids": [[x[0] for x in o] for o in own], "starts": [[x[1] for x in o] for o in own], "sizes": [[x[2] for x in o] for o in own],
            }

        now, items = None, []
        for b in batches:
            for own, id_, start, words, copies in zip(b["block"], b["id"], b["start"], b["words"], b["copies"], strict=True):
                if own != now and items:
                    yield out(now, items)
                    items = []
                now = own
                items += [(id_, start, words)] * copies
        if items:
            yield out(now, items)

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    return arrow_map(dealt, run, f"bin string, capacity int, used long, n_pieces int, doc_ids array<{kind}>, starts array<long>, sizes array<long>")
