"""Toxicity: a learned lexicon in a trie, matched with Levenshtein automata, weighed by context."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Columns, arrow_map, as_bytes, dropped, held_out, labelled_sample, tune, written

#: At most this many labelled rows, the first by a hash of the id, are used to learn from.
FIT_ROWS = 20_000
#: More significant terms than this are an error: the driver and every executor hold them.
LEXICON = 200_000
#: Words on each side of a hit that decide whether it is quoted or aimed at someone.
WINDOW = 6
# Words that report or discuss speech, and words of address, in four languages.
REPORTING = "said says called word words term quote quoted quotes wrote report reported mention mentioned slur sagte sagt wort begriff zitat dit mot terme citation dijo dice palabra cita".split()
ADDRESS = "you your you're u ur du dich dir ihr euch dein tu te toi vous votre tú usted ustedes eres".split()
QUOTES = '"“”„«»‹›'
_LEET = str.maketrans("@013457$", "aoieasts")


def folded(token: str) -> str:
    """A token as the lexicon has it: lower case, without punctuation around it, look-alike digits replaced
    within words."""
    start, end = 0, len(token)
    while start < end and not (token[start].isalnum() or token[start] in "@$"):
        start += 1
    while end > start and not (token[end - 1].isalnum() or token[end - 1] in "@$"):
        end -= 1
    token = token[start:end].lower()
    return token.translate(_LEET) if any(c.isalpha() for c in token) else token


def stems(word: str, least: int = 4, most: int = 7) -> list[str]:
    """The beginnings of a word that may be a lexicon entry: each stands for all words that begin with it."""
    return [word[:n] + "*" for n in range(least, min(most, len(word) - 1) + 1)]


class FuzzyTrie:
    """A trie of terms, run against words together with the Levenshtein automata of all its paths.

    A position is (node, edits so far). One character takes a position along the equal edge, or for one edit
    more along any edge (substitution) or nowhere (an extra character); a missing character is an edge
    without a character. The sets of positions are the states of an automaton whose transitions are made when
    first needed and kept; most words reach the empty state after a few characters. Terms of fewer than
    `fuzzy_from` letters are matched exactly. A term that ends in * fits every word that begins with it.
    """

    MOST_STATES = 50_000

    def __init__(self, terms: Iterable[str], edits: int = 1, fuzzy_from: int = 5):
        self.terms = sorted(set(terms))
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, bool] | None] = [None]  # (term, open at its end)
        self.fuzzy = [False]  # some term below is long enough for edits
        for number, term in enumerate(self.terms):
            is_open, node = term.endswith("*"), 0
            letters = term[:-1] if is_open else term
            long = len(letters) >= fuzzy_from
            self.fuzzy[0] |= long
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({}), self.ends.append(None), self.fuzzy.append(False)
                node = self.children[node][c]
                self.fuzzy[node] |= long
            if self.ends[node] is None or is_open:  # an open term covers the closed one
                self.ends[node] = (number, is_open)
        self.length = [len(t.rstrip("*")) for t in self.terms]
        self.edits, self.fuzzy_from = edits, fuzzy_from
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.hit: list[tuple[int, int] | None] = []  # best (edits, term) of an open end reached so far
        self.start = self._state({(0, 0)})

    def _closed(self, positions: set) -> frozenset:
        todo = list(positions)
        while todo:  # a missing character
            node, e = todo.pop()
            if e < self.edits and self.fuzzy[node]:
                for child in self.children[node].values():
                    if self.fuzzy[child] and (child, e + 1) not in positions:
                        positions.add((child, e + 1))
                        todo.append((child, e + 1))
        best: dict[int, int] = {}
        for node, e in positions:
            best[node] = min(e, best.get(node, e))
        return frozenset(best.items())

    def _state(self, positions: set) -> int:
        key = self._closed(positions)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key), self.next.append({})
            self.hit.append(min(((e, self.ends[n][0]) for n, e in key if self.ends[n] and self.ends[n][1] and self._allowed(self.ends[n][0], e)), default=None))
        return self.ids[key]

    def _allowed(self, term: int, edits: int) -> bool:
        return not edits or self.length[term] >= self.fuzzy_from

    def _step(self, state: int, c: str) -> int:
        to = set()
        for node, e in self.states[state]:
            if c in self.children[node]:
                to.add((self.children[node][c], e))
            if e < self.edits and self.fuzzy[node]:
                to.add((node, e + 1))
                to.update((child, e + 1) for child in self.children[node].values() if self.fuzzy[child])
        self.next[state][c] = found = self._state(to)
        return found

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, the first in order among equals; None if none is near enough."""
        if len(self.states) > self.MOST_STATES:
            self._reset()
        state, best = self.start, None
        for c in word:
            to = self.next[state].get(c)
            state = self._step(state, c) if to is None else to
            if not self.states[state]:
                break
            if self.hit[state] and (best is None or self.hit[state] < best):
                best = self.hit[state]
        for node, e in self.states[state]:
            if self.ends[node] and not self.ends[node][1] and self._allowed(self.ends[node][0], e) and (best is None or (e, self.ends[node][0]) < best):
                best = (e, self.ends[node][0])
        return best


class Scanner:
    """Finds lexicon terms in texts and measures their contexts."""

    FEATURES = ("log_weight", "log_hits", "fuzzy", "quoted", "addressed", "kinds", "density", "strongest")

    def __init__(self, weights: dict[str, float]):
        self.trie = FuzzyTrie(weights)
        self.weights = [weights[t] for t in self.trie.terms]
        self._known: dict[bytes, tuple[int, int] | None] = {}
        self._reporting, self._address = ({w.encode() for w in ws} for ws in (REPORTING, ADDRESS))

    def _find(self, token: bytes) -> tuple[int, int] | None:
        if len(self._known) > 500_000:
            self._known.clear()
        self._known[token] = hit = self.trie.match(folded(token.decode("utf-8", "replace")))
        return hit

    def features(self, text: bytes) -> list[float]:
        tokens = text.split()
        known, hits = self._known, []
        for i, token in enumerate(tokens):
            hit = known[token] if token in known else self._find(token)
            if hit is not None:
                hits.append((i, hit))
        if not hits:
            return [0.0] * len(self.FEATURES)
        weight = fuzzy = quoted = addressed = strongest = 0.0
        for i, (edits, term) in hits:
            near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
            marks = b" ".join(near).decode("utf-8", "replace")
            is_quoted = sum(c in QUOTES for c in marks) >= 2 or any(w.lower().strip(b".,:;!?") in self._reporting for w in near)
            is_aimed = any(w.lower().strip(b".,:;!?") in self._address for w in near)
            w = self.weights[term] * (0.7 if edits else 1) * (0.5 if is_quoted else 1)
            weight, strongest = weight + w, max(strongest, w)
            fuzzy, quoted, addressed = fuzzy + (edits > 0), quoted + is_quoted, addressed + is_aimed
        n = len(hits)
        return [math.log1p(weight), math.log1p(n), fuzzy / n, quoted / n, addressed / n, math.log1p(len({t for _, (_, t) in hits})), math.log1p(1000 * n / len(tokens)), strongest]


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-3
    for _ in range(steps if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return w


def _terms(text: bytes) -> set[str]:
    words = {folded(t.decode("utf-8", "replace")) for t in set(text.split())}
    out = {w for w in words if 3 <= len(w) <= 24 and not w.isdigit()}
    return out.union(*(stems(w) for w in out)) if out else out


def learn_lexicon(sample: DataFrame, n: tuple[int, int], least: int = 3, significance: float = 20.0, precision: float = 0.9) -> dict[str, float]:
    """Terms and stems that mark label 1, with their log odds, from (_t text, _y label) rows.

    A term is kept if it is in `least` documents of label 1 or more, if `precision` of the documents that have it
    are of label 1, and if the likelihood ratio against independence reaches `significance`. Terms are counted and judged in a
    pre-aggregated groupBy, however rare or frequent they are; only those that are kept reach the driver.
    """

    def count(batches: Iterator[Columns]) -> Iterator[Columns]:
        seen: dict[str, list[int]] = {}

        def out() -> Columns:
            return {"term": list(seen), "a": [x[1] for x in seen.values()], "b": [x[0] for x in seen.values()]}

        for b in batches:
            for t, y in zip(b["_t"], b["_y"], strict=True):
                for term in _terms(t):
                    seen.setdefault(term, [0, 0])[y] += 1
                if len(seen) > 500_000:
                    yield out()
                    seen.clear()
        yield out()

    clean, toxic = n
    if not clean or not toxic:
        return {}
    prior = toxic / (toxic + clean)
    counted = arrow_map(sample.select("_t", "_y"), count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    share = F.col("a") / (F.col("a") + F.col("b"))
    judged = counted.where(F.col("a") >= least).withColumn("share", share).where(F.col("share") >= precision)
    against = F.when(F.col("b") > 0, F.col("b") * F.log((1 - F.col("share")) / (1 - prior))).otherwise(0.0)
    judged = judged.where(2 * (F.col("a") * F.log(F.col("share") / prior) + against) >= significance)
    found = judged.select("term", "a", "b").limit(LEXICON + 1).collect()
    if len(found) > LEXICON:
        raise ValueError(f"more than {LEXICON} terms mark label 1")
    ones = {r["term"]: r["a"] for r in found}
    lexicon = {r["term"]: math.log(((r["a"] + 0.5) / toxic) / ((r["b"] + 0.5) / clean)) for r in sorted(found, key=lambda r: r["term"])}
    # a word or longer stem goes if a stem of it tells as much; a stem goes if it comes from one word alone
    most: dict[str, int] = {}
    for word in (t for t in lexicon if not t.endswith("*")):
        for stem in stems(word + "?"):
            most[stem] = max(ones[word], most.get(stem, 0))
    for term in [t for t in lexicon if t.endswith("*")]:
        if most.get(term, 0) >= 0.9 * ones[term]:
            del lexicon[term]
    kept = {t for t in lexicon if t.endswith("*")}
    return {t: w for t, w in lexicon.items() if not any(s in kept and s != t for s in stems(t.rstrip("*") + "?"))}


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per row: id, held_out, score in 0..1 (higher: label 1 likelier), predicted (1 if score >= threshold).

    Learning: labelled_sample(), fit_rows texts at most, written to the shared folder once. The lexicon (an error beyond
    LEXICON terms) and nine weights go to the executors. Scoring maps every partition: no shuffle of texts.
    Null and empty texts have no hits and get the score of a text without hits; a null id is held out; repeated
    rows get equal scores; without labels each score is 0.5; an empty table gives an empty result.
    """
    tune(docs.sparkSession)
    body = docs.select(docs[id_col].alias("_doc"), as_bytes(text_col).alias("_t"))
    sample = written(labelled_sample(docs, labels, fit_rows, id_col, text_col, label_col).select("_t", "_y"), "toxicity")
    counts = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
    weights = learn_lexicon(sample, (counts.get(0, 0), counts.get(1, 0)))

    def measure(batches: Iterator[Columns]) -> Iterator[Columns]:
        scanner = Scanner(weights)
        for b in batches:
            yield {"f": [scanner.features(t) for t in b["_t"]], "_y": b["_y"]}

    measured = arrow_map(sample, measure, "f array<float>, _y int").toPandas()
    dropped(sample)
    measured = measured.sort_values(["_y", "f"], key=lambda c: c.map(tuple) if c.name == "f" else c)  # the same sums at every run
    x = np.array(measured["f"].tolist(), dtype=np.float64).reshape(len(measured), len(Scanner.FEATURES))
    w = logistic(x, measured["_y"].to_numpy(np.float64))

    def score(batches: Iterator[Columns]) -> Iterator[Columns]:
        scanner = Scanner(weights)
        for b in batches:
            f = np.array([scanner.features(t) for t in b["_t"]])
            s = 1 / (1 + np.exp(-np.clip(f @ w[:-1] + w[-1], -30, 30)))
            yield {id_col: b["_doc"], "score": s, "predicted": (s >= threshold).astype(np.int32)}

    kind = docs.schema[id_col].dataType.simpleString()
    scored = arrow_map(body, score, f"`{id_col}` {kind}, score double, predicted int")
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")
