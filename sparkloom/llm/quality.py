"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Columns, arrow_map, as_bytes, labelled_sample, held_out, tune

#: At most this many labelled rows, the first by a hash of the id, are used to fit a model.
FIT_ROWS = 20_000

_CLASSES = {
    "lower": bytes(range(97, 123)),
    "upper": bytes(range(65, 91)),
    "digit": bytes(range(48, 58)),
    "space": b" ",
    "line": b"\n",
    "stop": b".?",
    "comma": b",;:",
    "shout": b"!",
    "symbol": b"#$%&*@^~_=+<>\\|/",
    "pipe": b"|",
    "bracket": b"()[]{}\"'`-",
    "control": bytes([*range(9), *range(11, 32), 127]),
    "high": bytes(range(128, 256)),
}
FEATURES = [*_CLASSES, "log_bytes", "log_words", "word_mean", "word_max", "distinct_words", "top_word", "lines", "line_mean", "distinct_lines", "byte_entropy", "distinct_pairs", "odd_words"]


def _class_matrix() -> np.ndarray:
    m = np.zeros((256, len(_CLASSES)))
    for j, chars in enumerate(_CLASSES.values()):
        m[list(chars), j] = 1
    return m


def text_features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    counts = np.zeros((len(texts), 256))
    rest = np.zeros((len(texts), len(FEATURES) - len(_CLASSES)))
    for i, t in enumerate(texts):
        if not t:
            continue
        counts[i] = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        words, lines = t.split(), t.split(b"\n")
        n = max(len(words), 1)
        seen = Counter(words)
        odd = sum(k for w, k in seen.items() if w[-1] in b"!#$%&*|" or (w.isupper() and len(w) > 3))
        rest[i] = (
            np.log(len(t)), np.log(n), sum(map(len, words)) / n, max(map(len, words), default=0), len(seen) / n, max(seen.values(), default=0) / n,
            np.log(len(lines)), np.log(len(t) / len(lines)), len(set(lines)) / len(lines), 0, len(set(zip(words, words[1:], strict=False))) / n, odd / n,
        )
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    share = counts / total
    rest[:, 9] = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    return np.hstack([share @ _class_matrix(), rest])


class Trees:
    """Gradient-boosted trees for a 0/1 label, grown level by level from histograms of binned features.

    Each tree is complete and lies flat in three arrays (feature, threshold, value), a row for each tree:
    the children of node i are 2 i + 1 and 2 i + 2. A node that isn't split sends all rows left.
    """

    def __init__(self, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: int = 5):
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        inner = 2**self.depth - 1
        self.base = 0.0
        self.feature, self.threshold = np.zeros((0, inner), np.int32), np.zeros((0, inner))
        self.value = np.zeros((0, inner + 1))
        if not len(y):
            return self
        p = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(p / (1 - p)))
        if y.min() == y.max():
            return self
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])  # x <= edge[b] is bin <= b
        raw, feature, threshold, value = np.full(n, self.base), [], [], []
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-raw))
            g, h = prob - y, np.maximum(prob * (1 - prob), 1e-9)
            node = np.zeros(n, np.int64)  # within the level
            f, t = np.zeros(inner, np.int32), np.full(inner, np.inf)
            for level in range(self.depth):
                width = 2**level
                best, best_f, best_b = np.full(width, 1e-6), np.zeros(width, np.int32), np.full(width, -1)
                for j in range(m):
                    if not len(edges[j]):
                        continue
                    cell, size = node * self.bins + binned[j], width * self.bins
                    sums = [np.bincount(cell, w, size).reshape(width, self.bins).cumsum(1) for w in (g, h, None)]
                    (gl, hl, nl), (gt, ht, nt) = sums, (s[:, -1:] for s in sums)
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain = np.where((nl >= self.least) & (nt - nl >= self.least), gain, 0)[:, : len(edges[j])]
                    b = gain.argmax(1)
                    top = gain[np.arange(width), b]
                    won = top > best
                    best[won], best_f[won], best_b[won] = top[won], j, b[won]
                first = width - 1
                f[first : first + width] = best_f
                t[first : first + width] = [edges[j][b] if b >= 0 else np.inf for j, b in zip(best_f, best_b, strict=True)]
                node = 2 * node + (x[np.arange(n), f[first + node]] > t[first + node])
            gs, hs = (np.bincount(node, w, inner + 1) for w in (g, h))
            v = -self.rate * gs / (hs + self.l2)
            raw += v[node]
            feature.append(f), threshold.append(t), value.append(v)
        self.feature, self.threshold, self.value = map(np.stack, (feature, threshold, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; all trees step down one level at a time."""
        raw = np.full(len(x), self.base)
        if len(self.feature) and len(x):
            rows, tree = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
            at = np.zeros((len(x), len(self.feature)), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[tree, at]] > self.threshold[tree, at])
            raw += self.value[tree, at - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-raw))


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, **trees: float) -> Trees:
    """Fit on labelled_sample(): fit_rows texts at most, the same at every run. The driver gets only their statistics. Without
    labels each score is 0.5."""
    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        for b in batches:
            yield {"id": b["_id"], "f": list(text_features(b["_t"]).astype(np.float32)), "y": b["_y"]}

    tune(docs.sparkSession)
    chosen = labelled_sample(docs, labels, fit_rows, id_col, text_col, label_col)
    sample = arrow_map(chosen, run, f"id {chosen.schema['_id'].dataType.simpleString()}, f array<float>, y int").toPandas()
    sample = sample.sort_values("id", kind="stable")  # sums, and so models, don't depend on the order in which tasks end
    x = np.array(sample["f"].tolist(), dtype=np.float64).reshape(len(sample), -1) if len(sample) else np.zeros((0, len(FEATURES)))
    return Trees(**trees).fit(x, sample["y"].to_numpy(np.float64))


def _scores(model: Trees, texts: list[bytes]) -> np.ndarray:
    return model.score(text_features(texts).astype(np.float32).astype(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per row: id, held_out, score in 0..1 (higher: label 1 likelier), predicted (1 if score >= threshold).

    Texts are never shuffled; the model is a fixed number of small arrays, sent with the scoring
    function. Null and empty texts have the statistics of an empty text and get a score; a null id is held out;
    repeated rows get equal scores; an empty table gives an empty result; other columns are not read.
    """
    model = fit_quality(docs, labels, label_col, id_col, text_col, fit_rows)

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        for b in batches:
            s = _scores(model, b["t"])
            yield {id_col: b["id"], "score": s, "predicted": (s >= threshold).astype(np.int32)}

    kind = docs.schema[id_col].dataType.simpleString()
    scored = arrow_map(docs.select(docs[id_col].alias("id"), as_bytes(text_col).alias("t")), run, f"`{id_col}` {kind}, score double, predicted int")
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that score_quality predicts as 1, with their columns as they are; nothing is shuffled."""
    model = fit_quality(docs, labels, label_col, id_col, text_col, fit_rows)

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for b in batches:
            texts = [(t or "").encode() for t in b.column(text_col).to_pylist()]
            if texts:
                yield b.filter(pa.array(_scores(model, texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
