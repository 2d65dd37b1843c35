"""Every operator and stage on awkward and on empty tables: defined results, no crash."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import media, mixing, near_dedup, packing, quality, substring_dedup, token_counts, topk, toxicity, url_filters


def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


OPERATORS = {
    "media": lambda d, l: media.media_table(d),
    "mixing": lambda d, l: mixing.mix(d, F.array("source"), mixing.n_words(F.col("text"))),
    "mixed": lambda d, l: mixing.mixed_documents(d),
    "toxicity": lambda d, l: toxicity.score_toxicity(d, l),
    "near": lambda d, l: near_dedup.near_duplicates(d),
    "quality": lambda d, l: quality.score_quality(d, l),
    "keep": lambda d, l: quality.keep_quality(d, l),
    "passages": lambda d, l: substring_dedup.repeated_passages(d),
    "cut": lambda d, l: substring_dedup.cut_passages(d),
    "packing": lambda d, l: packing.pack(d, mixing.n_words(F.col("text"))),
    "tokens": lambda d, l: token_counts.count_tokens(d, model()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, none, labels, name):
    assert OPERATORS[name](none, labels.limit(0)).collect() == []


ONE_ROW_EACH = ("media", "mixing", "toxicity", "near", "quality", "tokens")


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_a_row_for_each_row(spark, awkward, labels, name):
    assert sorted(OPERATORS[name](awkward, labels).toPandas()["doc_id"].fillna(-1)) == [-1, -1, 1, 1, 2, 3, 4, 5, 6, 7, 7]


def test_near_duplicates_of_awkward_rows(awkward):
    rows = near_dedup.near_duplicates(awkward).collect()
    by = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in rows}
    assert by[1, 3] == (1, True)
    assert by[2, 0] == (2, True) and by[3, 0] == (3, True) and by[4, 0] == (4, True)
    assert by[None, 0] == (None, True) and by[None, 8] == (None, True)
    assert by[5, 29996] == (5, True) and by[6, 29997] == (5, False)
    assert by[7, 1] == (7, True)  # three words and a NUL are four words: one shingle


def test_mixing_of_awkward_rows(awkward):
    rows = OPERATORS["mixing"](awkward, None).collect()
    assert all(0 <= r["_taken"] <= 3 * r["_size"] for r in rows)
    assert {r["_source_size"] for r in rows if r["source"] is None} == {4 + 12}


def test_cut_keeps_rows_without_id_and_columns(awkward):
    out = substring_dedup.cut_passages(awkward)
    assert out.columns == awkward.columns
    rows = out.collect()
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert [len(r["text"].split()) for r in rows if r["doc_id"] == 6] in ([], [1])


def test_packing_has_every_word(awkward):
    bins = OPERATORS["packing"](awkward, None).collect()
    assert sum(b["used"] for b in bins) == 2 * 7 + 12 + 30_000 + 30_001 + 4 + 12
    assert all(b["used"] <= b["capacity"] for b in bins)


@pytest.mark.parametrize("i", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, awkward, none, tmp_path, labels, i):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    _, stage = corpus_pipeline.STAGES[i]
    for docs in (awkward, none):
        out = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{tmp_path}/out{docs is none}")


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.COM/en/71?x"), (None, "x://example.com"), (4, "http://example.org/es/"), (4, "http://notexample.net/de/8"), (5, "http://sub.example.net/de/8#f"), (6, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("id", F.lit(0))
    rules = [url_filters.Rule.parse(*r) for r in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))]
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(pages, rules).collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/71", "example.com/en/7", "allow"), ("example.com", "", None, "allow"),
        ("example.org", "/es/", "org/es/", "block"), ("notexample.net", "/de/8", "net/de/", "allow"), ("sub.example.net", "/de/8", "example.net/de/8", "block"), ("", "", None, "allow"),
    ]
    assert url_filters.filter_urls(pages.limit(0), rules).collect() == []


def test_top_k_takes_no_part_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.5, -0.5]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 2.0, 3.0]), (7, []), (None, [1.0, 1.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (40, [0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1))
    got = [tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 64 * 64 * 5), (0, 2, 1, 64 * 32 - 128 * 32), (20, 1, 0, 64 * 64 * 5), (20, 2, 1, 64 * 32 - 128 * 32), (40, 1, 6, 0)]
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 20 == 0).collect() == []
