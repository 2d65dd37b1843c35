"""Rows repeated under one id, rows without an id, other texts under one id; and the parts of near-dedup and substring dedup against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import common, near_dedup, quality, substring_dedup, toxicity

WORDS = [f"w{i}" for i in range(3000)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def sets_of(texts):
    hashes = common.WordHashes()
    return [near_dedup.shingle_set(hashes.of(common.words_of(t.encode()))) for t in texts]


def jaccard(a, b):
    return len(np.intersect1d(a, b)) / len(np.union1d(a, b))


def test_a_stage_tells_texts_under_one_id_apart(spark):
    rng = random.Random(1)
    a, b, c = (text(rng, 60) for _ in range(3))
    rows = [(3, a), (7, a + " tail"), (7, b), (9, c), (9, c), (9, c + " end"), (None, c + " more"), (None, b), (11, ""), (11, ""), (12, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.minhash_near_dedup(spark, docs, "").collect()}
    assert got in ({(3, a), (7, b), (9, c), (11, ""), (12, None)}, {(3, a), (7, b), (9, c + " end"), (11, ""), (12, None)})
    assert corpus_pipeline.minhash_near_dedup(spark, docs, "").count() == 5


def test_a_group_without_ids_keeps_one_row(spark):
    rng = random.Random(2)
    base = text(rng, 80)
    docs = spark.createDataFrame([(None, base + f" {i}") for i in range(40)] + [(None, text(rng, 30))], "doc_id long, text string")
    out = near_dedup.near_duplicates(docs)
    assert {(r["component_id"], r["kept"]) for r in out.collect()} == {(None, True)}
    assert near_dedup.one_of_each_group(docs).count() == 2


@pytest.mark.parametrize("n", [20, 80])
def test_sets_are_read_once_for_each_class(spark, n):
    rng = random.Random(3)
    base = text(rng, 80)
    docs = spark.createDataFrame([(None, base + f" {i % 10}") for i in range(n)] + [(5, base)] * n, "doc_id long, text string")
    body = near_dedup._body(docs, "doc_id", "text")
    rows = near_dedup.signatures(body)
    wanted = rows.groupBy("c").agg(F.min(F.struct("k1", "k2")).alias("k")).select("c", "k.k1", "k.k2")
    assert near_dedup._sets(body, wanted, 5).count() == 11


def test_the_similarity_counts(spark):
    rng = random.Random(4)
    rows, near = [], 0
    for i in range(0, 120, 2):
        a = text(rng, 90)
        b = " ".join(a.split()[:64]) + " " + text(rng, 26)
        near += jaccard(*sets_of([a, b])) >= 0.5
        rows += [(i, a), (i + 1, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near == 60
    assert near_dedup.near_duplicates(docs, similarity=50).where("not kept").count() == 60
    assert near_dedup.near_duplicates(docs, similarity=75).where("not kept").count() == 0


@pytest.mark.parametrize("similarity", [30, 50, 75, 80, 90, 99, 100])
def test_bands_follow_from_the_similarity(similarity):
    bands, rows = near_dedup.banding(similarity)
    assert (1 - min(similarity, 99) ** rows / 100**rows) ** bands <= near_dedup.MISSED and bands * rows <= near_dedup.COORDINATES
    assert near_dedup.banding(75) == (28, 4)


def test_blocks_unite_what_links_unite():
    rng = random.Random(5)
    base = [text(rng, 40) for _ in range(6)]
    texts = []
    for _ in range(150):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(40)] = rng.choice(WORDS)
        texts.append(" ".join(words))
    sets = sets_of(texts)
    names = [bytes([i // 256, i % 256]) for i in range(150)]

    def groups(links):
        parent = list(range(150))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[root(a)] = root(b)
        return {frozenset(i for i in range(150) if root(i) == r) for r in {root(i) for i in range(150)}}

    want = groups([(i, j) for i in range(150) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.75])
    held = near_dedup.Block([(c, c, s.tobytes()) for c, s in zip(names, sets, strict=True)], 75)
    links = [link for c, s in zip(names, sets, strict=True) for link in held.add(c, c, s.tobytes())]
    assert len(links) < 150
    assert groups([(names.index(a), names.index(b)) for a, b in links]) == want


def test_labels_of_one_id_are_one_label(spark):
    rng = random.Random(6)
    rows = [(i, text(rng, 20)) for i in range(200)] + [(1, text(rng, 20)) for _ in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 5000 + [(i, i % 2) for i in range(200)], "doc_id long, quality int").withColumn("toxic", F.col("quality"))
    sample = common.labelled_sample(docs, labels, 100, "doc_id", "text", "quality")
    assert sample.count() == 100 and sample.select("_id").distinct().count() == 100
    few = common.labelled_sample(docs, labels.where("doc_id = 1"), 100, "doc_id", "text", "quality")
    assert few.count() == 1
    assert quality.score_quality(docs, labels, fit_rows=50).count() == toxicity.score_toxicity(docs, labels, fit_rows=50).count() == 3200


def test_copies_of_one_row_cost_nothing(spark):
    rng = random.Random(7)
    base = text(rng, 300)
    counts = []
    for copies in (1, 50):
        docs = spark.createDataFrame([(1, base)] * copies + [(2, base + " x")] * copies, "doc long, t string").withColumns({"v": F.xxhash64("t"), "t": F.col("t").cast("binary")})
        found = common.written(substring_dedup.anchors(substring_dedup.seeds(docs)))
        pieces = common.written(substring_dedup.chain_pieces(found))
        counts.append((found.count(), pieces.count(), substring_dedup.align(pieces, docs).count()))
    assert counts[0] == counts[1] and counts[0][0] > 60


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError):
        substring_dedup.repeated_passages(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_anchors_against_brute_force(spark):
    rng = random.Random(8)
    line = text(rng, 9)
    rows = [(i, " ".join([line] * rng.randrange(1, 6)) + " " + text(rng, 12) + " " + rng.choice([line, "z"])) for i in range(1, 30)]
    docs = spark.createDataFrame(rows, "doc long, t string").withColumns({"v": F.xxhash64("t"), "t": F.col("t").cast("binary")})
    seeded = common.written(substring_dedup.seeds(docs))
    places: dict = {}
    for r in sorted(seeded.collect()):
        places.setdefault((r["h"], r["nth"]), []).append((r["doc"], r["v"], r["pos"]))
    want = set()
    for (h, nth), rows in places.items():
        for doc, v, pos in rows:
            first = rows[0] if rows[0][0] != doc else places[h, 0][0]
            if first[0] != doc:
                want.add((doc, v, pos, *first))
    for parts in (1, 7, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = [tuple(r) for r in substring_dedup.anchors(seeded.repartition(5)).collect()]
        assert set(got) == want and len(got) == len(want)
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_lines_make_few_chains(spark):
    rng = random.Random(9)
    line = text(rng, 12)
    docs = spark.createDataFrame([(i, " ".join([line] * 40)) for i in range(1, 9)], "doc long, t string").withColumns({"v": F.xxhash64("t"), "t": F.col("t").cast("binary")})
    pieces = substring_dedup.chain_pieces(substring_dedup.anchors(substring_dedup.seeds(docs)))
    assert pieces.where("kind = 1").count() == 7
    passages = substring_dedup.repeated_passages(docs.select(F.col("doc").alias("doc_id"), F.col("t").cast("string").alias("text"))).collect()
    assert sorted((r["doc_id"], r["passage_first"], r["passage_last"]) for r in passages) == [(i, 0, 479) for i in range(2, 9)]


def test_extension_against_all_alignments():
    rng = random.Random(10)
    for _ in range(300):
        a = [rng.randrange(50) for _ in range(rng.randrange(1, 25))]
        b = list(a)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(50) for _ in range(rng.randrange(2))]
        m, n, matched = substring_dedup.extension(np.array(a), np.array(b, dtype=np.int64))
        score = np.full((len(a) + 1, len(b) + 1), -(10.0**9))
        score[0, 0] = 0
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if i and j:
                    score[i, j] = max(score[i, j], score[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1))
                if i:
                    score[i, j] = max(score[i, j], score[i - 1, j] - 1)
                if j:
                    score[i, j] = max(score[i, j], score[i, j - 1] - 1)
        assert m <= len(a) and n <= len(b) and matched <= min(m, n)
        # edits that don't pay off at once can end the search; with three of them and 25 words they rarely do
        assert score.max() - 3 <= score[m, n] <= score.max()


def test_passages_against_all_common_runs(spark):
    """Every run of 50 words or more that an earlier text has too is reported, and nothing that no text has."""
    rng = random.Random(11)
    stock = [text(rng, n) for n in (52, 60, 75, 120, 200)]
    rows = []
    for i in range(1, 26):
        parts = [text(rng, rng.randrange(5, 60))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(stock), text(rng, rng.randrange(0, 40))]
        rows.append((i, " ".join(parts)))
    words = {i: t.split() for i, t in rows}
    want: dict = {i: set() for i in words}
    for i, a in words.items():
        for j in range(1, i):
            b = words[j]
            run = np.zeros((len(a) + 1, len(b) + 1), int)
            for x in range(len(a)):
                for y in range(len(b)):
                    if a[x] == b[y]:
                        run[x + 1, y + 1] = run[x, y] + 1
                        if run[x + 1, y + 1] >= 50:
                            want[i] |= set(range(x + 1 - run[x + 1, y + 1], x + 1))
    got: dict = {i: set() for i in words}
    for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]] |= set(range(r["passage_first"], r["passage_last"] + 1))
    assert sum(map(len, want.values())) > 1500
    for i in words:
        assert want[i] <= got[i] and len(got[i] - want[i]) <= 0.1 * len(want[i]) + 2
