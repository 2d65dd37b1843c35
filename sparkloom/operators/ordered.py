"""Folds over the rows of a key in order. Rows are dealt by key and sorted by Spark, tasks stream them: no key's rows are held
in memory. What can be said without a fold is said in closed form over windows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def folded(rows: DataFrame, by: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple[object, tuple | None]], schema: str, columns: list[str]) -> DataFrame:
    """For each row, in order within its key, step(state, row) -> (state, values or None); a row of `schema` for each row that
    has values. `columns` are the ones that step reads."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, state = None, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                own = tuple(row[c] for c in by)
                if own != key:
                    key, state = own, start()
                state, values = step(state, row)
                if values is not None:
                    out.append(values)
            arrays = [pa.array([v[i] for v in out], type=f.type) for i, f in enumerate(target)]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    target = to_arrow_schema(StructType.fromDDL(schema))
    names = list(dict.fromkeys([*by, *order, *columns]))
    return rows.select(*names).repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def weighted(rows: DataFrame, by: list[str], order: list[str], value: str, alpha: float) -> DataFrame:
    """(by, smoothed): the exponentially weighted mean after a key's last row, in closed form: the value k places from the end
    weighs alpha * (1 - alpha) ** k, the first one (1 - alpha) ** k. Weights below 1e-18 are left out, so only the last rows of a
    key count, and each task drops the others before the shuffle."""
    most = math.ceil(math.log(1e-18) / math.log(1 - alpha))
    newest = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order))
    last = rows.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= most)
    n = F.max("_k").over(Window.partitionBy(*by))
    k = F.col("_k") - 1
    weight = F.when(F.col("_k") == n, F.pow(F.lit(1 - alpha), k)).otherwise(alpha * F.pow(F.lit(1 - alpha), k))
    return last.withColumn("_w", weight).groupBy(*by).agg(F.sum(F.col("_w") * F.col(value)).alias("smoothed"))


def values_at_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], buckets: int = 1024) -> DataFrame:
    """(by, n, each name of ranks): the values at 0-based ranks, each a function of the column n, of a key's sorted values, exactly.

    No task sees all values of a key: they are counted by (key, value), equal widths between the key's bounds make `buckets`
    buckets, prefix sums over those tell in which of them a rank lies, and only within these buckets values are ordered.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    bounds = counted.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_c").alias("n"))
    place = F.least(F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0)) * buckets), F.lit(buckets - 1))
    placed = counted.join(bounds, by).withColumn("_b", F.coalesce(place, F.lit(0)))
    sums = placed.groupBy(*by, "_b", "n").agg(F.sum("_c").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_c")
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), f(F.col("n")).cast("long").alias("rank")) for name, f in ranks.items())))
    hit = sums.withColumn("_before", before).withColumn("_w", wanted).where("_w.rank >= _before AND _w.rank < _before + _c").select(*by, "_b", "_before", "_w")
    inside = placed.join(hit.select(*by, "_b", "_before").distinct(), [*by, "_b"])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "_b").orderBy(value))
    ordered = inside.withColumn("_upto", upto).select(*by, "_b", "n", F.col(value).alias("_v"), (F.col("_upto") - F.col("_c")).alias("_from"), "_upto")
    found = ordered.join(hit.select(*by, "_b", "_w"), [*by, "_b"]).where("_w.rank >= _from AND _w.rank < _upto")
    return found.groupBy(*by).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("_w.name") == name, F.col("_v"))).alias(name) for name in ranks))


def numbered(rows: DataFrame, by: list[str], coarse: Column, *order: str) -> DataFrame:
    """rows with `place`, a number from 0 in the order of each key, without one task for a key: `coarse`, a column that rises with
    the order, parts a key's rows; each part is numbered by itself, behind the counts of the parts before it."""
    marked = rows.withColumn("_part", coarse)
    sizes = marked.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    offset = sizes.select(*by, "_part", (F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")).alias("_offset"))
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    return marked.withColumn("_own", own).join(offset, [*by, "_part"]).withColumn("place", F.col("_offset") + F.col("_own")).drop("_part", "_own", "_offset")


def linear_percentiles(rows: DataFrame, by: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """(by, each name): percentiles interpolated between the two nearest ranks, by values_at_ranks()."""
    at = lambda n, p: (n - 1) * F.lit(p / 100)
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in percents.items():
        ranks[f"{name}_lo"] = lambda n, p=p: F.floor(at(n, p))
        ranks[f"{name}_hi"] = lambda n, p=p: F.ceil(at(n, p))
    found = values_at_ranks(rows, by, value, ranks)
    part = lambda p: at(F.col("n"), p) - F.floor(at(F.col("n"), p))
    return found.select(*by, *((F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * part(p)).alias(name) for name, p in percents.items()))


def rolling_chunks(rows: DataFrame, by: list[str], coarse: Column, order: list[str], before: int, chunk: int = 20_000) -> DataFrame:
    """rows with `chunk` and `real`: a key's rows in chunks of so many, each with copies (not real) of the `before` rows ahead of it,
    so that windows over the rows before can be computed by (key, chunk) instead of a whole key in one task."""
    placed = numbered(rows, by, coarse, *order)
    number, rest = F.floor(F.col("place") / chunk), F.col("place") % chunk
    chunks = F.when(rest >= chunk - before, F.array(number, number + 1)).otherwise(F.array(number))
    spread = placed.withColumn("_own", number).withColumn("chunk", F.explode(chunks))
    return spread.withColumn("real", F.col("chunk") == F.col("_own")).drop("_own")
