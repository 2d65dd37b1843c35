"""Field-level deltas, hash chains and Merkle roots."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def changed(before: Column, now: Column) -> Column:
    """The fields of `now` that are new or differ."""
    return F.map_filter(now, lambda k, v: ~F.try_element_at(before, k).eqNullSafe(v))


def removed(before: Column, now: Column) -> Column:
    return F.array_sort(F.array_except(F.map_keys(before), F.map_keys(now)))


def applied(before: Column, changes: Column, gone: Column) -> Column:
    """The inverse of changed() and removed()."""
    kept = F.map_filter(before, lambda k, v: ~F.array_contains(gone, k) & ~F.array_contains(F.map_keys(changes), k))
    return F.map_concat(kept, changes)


def encode(rows: DataFrame, by: str, order: str, fields: str, every: int) -> DataFrame:
    """(by, order, segment, place, key, changes, gone): a whole row (keyframe) for each `every` rows, else its delta."""
    w = Window.partitionBy(by).orderBy(order)
    numbered = rows.withColumn("i", F.row_number().over(w) - 1).withColumn("before", F.lag(fields).over(w))
    key = F.col("i") % every == 0
    return numbered.select(by, order, F.floor(F.col("i") / every).alias("segment"), (F.col("i") % every).alias("place"), F.when(key, F.col(fields)).alias("key"), F.when(~key, changed(F.col("before"), F.col(fields))).alias("changes"), F.when(~key, removed(F.col("before"), F.col(fields))).alias("gone"))


def decode(encoded: DataFrame, by: str, order: str) -> DataFrame:
    """(by, order, fields): each segment, of bounded length, is folded from its keyframe."""
    parts = encoded.groupBy(by, "segment").agg(F.array_sort(F.collect_list(F.struct("place", order, "key", "changes", "gone")), lambda a, b: (a["place"] - b["place"]).cast("int")).alias("parts"))
    empty = F.array().cast("array<string>")
    states = F.aggregate(F.slice(F.col("parts"), 2, F.size("parts")), F.array(F.col("parts")[0]["key"]), lambda s, d: F.concat(s, F.array(applied(F.element_at(s, -1), d["changes"], F.coalesce(d["gone"], empty)))))
    both = F.explode(F.arrays_zip(F.transform("parts", lambda p: p[order]).alias("o"), states.alias("f")))
    return parts.select(by, both.alias("x")).select(by, F.col("x").getField("o").alias(order), F.col("x").getField("f").alias("fields"))


def hash_chain(rows: DataFrame, by: str, order: str, body: str) -> DataFrame:
    """rows (by, order, body) with prev_hash and entry_hash = sha256(prev_hash + body): a fold over sorted rows, of which a task holds
    one hash at a time."""
    from sparkloom.operators import ordered

    def step(last, row):  # noqa: ANN001, ANN202
        import hashlib

        entry = hashlib.sha256((last + row[body]).encode()).hexdigest()
        return entry, (row[by], row[order], row[body], last, entry)

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (by, order, body))
    genesis = GENESIS
    return ordered.folded(rows, [by], [order], lambda: genesis, step, f"{schema}, prev_hash string, entry_hash string", [body])


def first_break(rows: DataFrame, by: str, order: str, body: str) -> DataFrame:
    """(by, broken): the first row whose hash or predecessor doesn't fit; no row for whole chains."""
    before = F.coalesce(F.lag("entry_hash").over(Window.partitionBy(by).orderBy(order)), F.lit(GENESIS))
    checked = rows.withColumn("_before", before)
    bad = (F.col("prev_hash") != F.col("_before")) | (F.col("entry_hash") != F.sha2(F.concat("prev_hash", body).cast("binary"), 256))
    return checked.where(bad).groupBy(by).agg(F.min(order).alias("broken"))


def merkle_root(rows: DataFrame, key: str, value: str, levels: int = 12) -> DataFrame:
    """One row (root): sha256 over key and value, in the order of keys, paired level by level, the last of an odd level
    twice; no row for an empty table. A round takes `levels` levels: a task holds 2 ** levels hashes at a time."""
    import hashlib

    leaves = rows.select(F.sha2(F.concat_ws("=", key, value).cast("binary"), 256).alias("h"), F.col(key).alias("k"))
    placed = leaves.repartitionByRange("k").sortWithinPartitions("k", "h").select("h", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i")).checkpoint()
    sizes = placed.groupBy("p").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    n = sizes.agg(F.sum("n")).first()[0] or 0
    before = sizes.select("p", (F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("p")) - F.col("n")).alias("before"))
    nodes = placed.join(F.broadcast(before), "p").select((F.col("before") + F.col("i")).alias("place"), "h")
    fan = 1 << levels
    while n > 1:
        alone = n <= fan  # the top: as many levels as there are

        def above(batches: Iterator, alone: bool = alone) -> Iterator:
            import pyarrow as pa

            def top(hashes: list[str]) -> str:
                level = 0
                while len(hashes) > 1 or not alone and level < levels:
                    hashes = [hashlib.sha256((hashes[i] + hashes[min(i + 1, len(hashes) - 1)]).encode()).hexdigest() for i in range(0, len(hashes), 2)]
                    level += 1
                return hashes[0]

            group, own, done = None, [], []
            for b in batches:
                for place, h in zip(b.column("place").to_pylist(), b.column("h").to_pylist(), strict=True):
                    if place // fan != group:
                        if own:
                            done.append((group, top(own)))
                        group, own = place // fan, []
                    own.append(h)
            if own:
                done.append((group, top(own)))
            yield pa.RecordBatch.from_pydict({"place": pa.array([g for g, _ in done], pa.int64()), "h": pa.array([h for _, h in done], pa.string())})

        dealt = nodes.repartition(F.floor(F.col("place") / fan)).sortWithinPartitions("place")
        nodes = dealt.mapInArrow(above, "place long, h string").checkpoint()
        n = -(-n // fan)
    return nodes.select(F.col("h").alias("root"))
