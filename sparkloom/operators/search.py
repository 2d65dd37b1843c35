"""Inverted index, ranking, and similar vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as t


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, token, tf)."""
    words = docs.select(F.col(id_col).alias("doc_id"), F.explode(t.all_tokens(F.col(text_col))).alias("token"))
    return words.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, token, positions): places of a token among all words of its document."""
    words = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(t.all_tokens(F.col(text_col))).alias("pos", "token"))
    return words.groupBy("doc_id", "token").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def _weights(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    lengths = found.groupBy("doc_id").agg(F.sum("tf").alias("len"))
    frequencies = found.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return lengths, frequencies, lengths.agg(F.count(F.lit(1)).alias("docs"))


def _counted(words: Column) -> Column:
    """(token, tf, len) of one text's words: runs of the sorted words."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        one = lambda b: F.transform(b, lambda p, k: F.struct(F.get(s, p).alias("token"), (F.coalesce(F.get(b, k + 1), F.size(s)) - p).cast("long").alias("tf"), F.size(s).cast("long").alias("len")))
        return F.flatten(F.transform(F.array(starts), one))

    return F.flatten(F.transform(F.array(F.sort_array(words)), runs))


def tf_idf(docs: DataFrame, id_col: str, text_col: str, most: int = 400_000) -> DataFrame:
    """(doc_id, token, score) with score = tf / length * ln(docs / df).

    Words are counted within each row, so only rows that share an id, or have none, are grouped by it. Frequent tokens are
    broadcast with their df: as the df of all add up to the number of postings, at most `most` tokens (and 64 bytes for each) reach
    the bound. Postings of the others go to their token, where they are counted.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    again = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("again")).checkpoint()
    shared, repeats = None, again.count()
    if repeats:
        again = F.broadcast(again) if repeats <= 1_000_000 else again
        shared = postings(rows.join(again, F.col("doc_id").eqNullSafe(F.col("again")), "left_semi"), "doc_id", "text")
        rows = rows.join(again, F.col("doc_id").eqNullSafe(F.col("again")), "left_anti")
    words = t.all_tokens(F.col("text"))  # explode_outer: explode would take the texts apart once more, to leave out empty ones

    seen = F.flatten(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.concat(F.array_distinct(w), F.array(F.lit(""))))))
    seen = rows.select(F.explode_outer(seen).alias("token")).where("token IS NOT NULL")  # "" stands for a document
    if shared is not None:
        seen = seen.union(shared.select("token")).union(shared.select("doc_id").distinct().select(F.lit("")))
    counts = seen.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    bound = counts.agg(F.sum(F.when(F.col("token") != "", F.col("df"))).alias("postings"), F.count(F.lit(1)).alias("tokens"))
    frequent = (F.col("token") == "") | (F.col("df") * most >= F.col("postings") * (1 + F.length("token") / 64))
    top = counts.crossJoin(F.broadcast(bound)).where(frequent).select("token", "df", "tokens").checkpoint()
    n = top.where("token = ''").first()

    found = rows.select("doc_id", F.explode_outer(_counted(words)).alias("t")).where("t IS NOT NULL").select("doc_id", "t.token", "t.tf", "t.len")
    if shared is not None:
        lengths = shared.groupBy(F.col("doc_id").alias("again")).agg(F.sum("tf").alias("len"))
        found = found.union(shared.join(lengths, F.col("doc_id").eqNullSafe(F.col("again"))).select("doc_id", "token", "tf", "len"))
    weighed = found.join(F.broadcast(top.select("token", "df")), "token")
    if n is not None and top.count() < n["tokens"]:
        rare = found.join(F.broadcast(top.select("token")), "token", "left_anti").select("token", "doc_id", "tf", "len")
        weighed = weighed.union(rare.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))))
    score = F.col("tf") / F.col("len") * F.log(F.lit(n["df"] if n is not None else 0) / F.col("df"))
    return weighed.where("doc_id IS NOT NULL").select("doc_id", "token", score.alias("score"))


def ranked(docs: DataFrame, id_col: str, text_col: str, terms: list[str], k: int) -> DataFrame:
    """The k best documents for terms: more different terms first, then the smoothed tf-idf sum, then the smaller id. Only the
    postings of the terms are joined with weights."""
    found = postings(docs, id_col, text_col)
    lengths, _, n = _weights(found)
    hits = found.where(F.col("token").isin(*terms))
    frequencies = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    joined = hits.join(lengths, "doc_id").join(F.broadcast(frequencies), "token").crossJoin(F.broadcast(n))
    score = F.col("tf") / F.col("len") * (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1)
    return joined.groupBy("doc_id").agg(F.sum(score).alias("score"), F.count(F.lit(1)).alias("matched")).orderBy(F.desc("matched"), F.desc("score"), "doc_id").limit(k)


def similar(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, newest: int, k: int) -> DataFrame:
    """For the `newest` rows by id: the k rows of highest cosine among all others, with ranks. The queries are few
    by parameter, so they are broadcast; each task keeps its best before the shuffle."""
    norm = F.sqrt(F.aggregate(F.col(vector_col), F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"), norm.alias("norm"))
    asked = rows.orderBy(F.desc("id")).limit(newest).select(F.col("id").alias("query"), F.col("v").alias("qv"), F.col("norm").alias("qn"), F.col("label").alias("ql"))
    pairs = rows.join(F.broadcast(asked), F.col("id") != F.col("query"))
    dot = F.aggregate(F.zip_with("v", "qv", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select("query", "id", F.round(dot / (F.col("norm") * F.col("qn")), 6).alias("cosine"), (F.col("label") == F.col("ql")).alias("same"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
