"""Parts of compound tokens, stems, synonyms, inverted indexes that are intersected, tokens for secret values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parts_of_url(url: Column) -> Column:
    """The whole host, its labels, and the words of path and query, in order, each once."""
    host = F.regexp_extract(url, r"^https?://([^/?#\s:]+)", 1)
    tail = F.regexp_extract(url, r"^https?://[^/?#\s]+(.*)$", 1)
    words = F.filter(F.split(tail, "[^A-Za-z0-9_]+"), lambda w: w != "")
    return F.array_distinct(F.filter(F.concat(F.array(host), F.split(host, r"\."), words), lambda w: w != ""))


def parts_of_address(address: Column) -> Column:
    """The pieces of the name and the labels of the domain."""
    return F.filter(F.split(address, r"[.+@-]"), lambda w: w != "")


def stem(word: Column) -> Column:
    """A word without its commonest English ending, if three letters or more are left."""
    return F.regexp_replace(word, "^(.{3,}?)(ations?|ings?|ed|es|s|ly)$", "$1")


def expanded(tokens: Column, synonyms: dict[str, list[str]], each: int, total: int) -> Column:
    """tokens, then at most `each` synonyms of each and `total` in all, none twice."""
    table = F.create_map(*(x for k, v in sorted(synonyms.items()) for x in (F.lit(k), F.array(*map(F.lit, v[:each])))))
    more = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    return F.concat(tokens, F.slice(F.array_except(more, tokens), 1, total))


def with_all(postings: DataFrame, terms: list[str], token: str = "token", id_col: str = "doc_id") -> DataFrame:
    """(id) of the documents with all terms: posting lists are intersected from the shortest on, so that each step keeps as few rows as
    the shortest list has. postings(token, id) holds a row for each token of a document; only the terms' lists are read."""
    lists = postings.where(F.col(token).isin(*terms)).select(token, id_col)
    lengths = {r[token]: r["n"] for r in lists.groupBy(token).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each term
    if len(lengths) < len(set(terms)):
        return lists.select(id_col).limit(0)
    ordered = sorted(set(terms), key=lambda t: (lengths[t], t))
    pick = lambda t: lists.where(F.col(token) == t).select(id_col)
    return reduce(lambda found, t: found.join(pick(t), id_col, "left_semi"), ordered[1:], pick(ordered[0]))


def with_any(postings: DataFrame, terms: list[str], token: str = "token", id_col: str = "doc_id") -> DataFrame:
    return postings.where(F.col(token).isin(*terms)).select(id_col).distinct()


def newest_segment(segments: list[DataFrame], id_col: str) -> DataFrame:
    """Rows of several segments, of which later ones replace the rows that earlier ones have under the same id; a segment may hold
    several rows (postings) of an id."""
    rows = reduce(DataFrame.unionByName, (s.withColumn("_segment", F.lit(i)) for i, s in enumerate(segments)))
    last = rows.groupBy(id_col).agg(F.max("_segment").alias("_segment"))
    return rows.join(last, [id_col, "_segment"], "left_semi").drop("_segment")


def token_of(value: Column, key: str) -> Column:
    """A token that stands for a value, the same wherever it occurs; without the key it can't be found from the value."""
    return F.concat(F.lit("tok_"), F.substring(F.sha2(F.concat(F.lit(key), F.lit("\x1f"), value).cast("binary"), 256), 1, 32))


def vault(values: DataFrame, column: str, key: str) -> DataFrame:
    """(token, value): the table that turns tokens back into values, a row for each distinct value."""
    return values.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().select(token_of(F.col("value"), key).alias("token"), "value")


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters two texts have in common at their beginnings."""
    places = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
    same = F.filter(places, lambda i: F.left(a, i) == F.left(b, i))
    return F.when(F.least(F.length(a), F.length(b)) > 0, F.size(same)).otherwise(0)


def text_delta(before: Column, now: Column) -> Column:
    """Struct (prefix, suffix, middle): what `now` shares with `before` at both ends, and what is new between."""
    prefix = common_prefix(before, now)
    rest = lambda c: F.reverse(F.substring(c, prefix + 1, F.length(c)))
    suffix = common_prefix(rest(before), rest(now))
    return F.struct(prefix.alias("prefix"), suffix.alias("suffix"), F.substring(now, prefix + 1, F.length(now) - prefix - suffix).alias("middle"))


def patched(before: Column, delta: Column) -> Column:
    """The inverse of text_delta()."""
    return F.concat(F.left(before, delta["prefix"]), delta["middle"], F.right(before, delta["suffix"]))
