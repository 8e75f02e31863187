"""Operator 9, toxicity: a lexicon trie met by Levenshtein automata, with
context windows that part quotation from abuse.

Lexicon: words, and stems (prefixes of ``STEM_SIZES`` letters), that are much
likelier in the toxic half of a labelled sample.  Matching: the Levenshtein
automaton of a word's remaining edits is run together with the lexicon trie,
as one automaton whose states are sets of (trie node, edits so far); states
are made when first met and kept, and most words reach the dead state within a
few letters.  A term of 5 or more letters allows one edit, of 9 or more two;
stems must stand as they are.

Context: a match is quoted when a quotation mark opens in the ``WINDOW`` words
before it and one closes in those after it, or when a reporting word stands in
the window.  A document's features are its direct exact, stem and misspelt
matches, its quoted matches, and the density of direct matches; a logistic
model over them gives the score.

The labelled sample is bounded: the ``max_labelled`` rows with the smallest
hash of their id, of those that are not held out (``crc32(id) mod 5 = 0``);
it teaches the lexicon and the model.  Everything else runs over all
documents.

Defined cases: null or empty text has no match, its score is the model's
constant.  A null id is never held out and never labelled.  Without toxic
labels the lexicon is empty and all scores are equal.  Repeated rows are
scored each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGES = ".,;:!?'\"()[]{}<>-_*#$%&|«»“”„‘’…"
QUOTES = "\"«»“”„‘’"
STEM_SIZES = (4, 5, 6)
WINDOW = 8
MAX_KNOWN = 400_000
# Words that report another's speech.
REPORTING = frozenset(["said", "says", "quote", "quoted", "quotes", "called", "wrote", "according", "dit", "sagte", "dijo", "zitat", "cita"])


def allowed_edits(term: str) -> int:
    return 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0


class LexiconAutomaton:
    """Classes of words: 0 no match, 1 exact, 2 stem, 3 misspelt."""

    def __init__(self, words: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.edits, self.ends, self.stem = [0], [-1], [False]
        for term in words:
            node = self._insert(term, allowed_edits(term))
            self.ends[node] = allowed_edits(term)
        for term in stems:
            self.stem[self._insert(term, 0)] = True
        self.ids: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.found: list[int] = []
        self.start = self._state({(0, 0)})

    def _insert(self, term: str, edits: int) -> int:
        node = 0
        for c in term:
            self.edits[node] = max(self.edits[node], edits)
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.edits.append(0)
                self.ends.append(-1)
                self.stem.append(False)
            node = self.children[node][c]
        self.edits[node] = max(self.edits[node], edits)
        return node

    def _state(self, items: set[tuple[int, int]]) -> int:
        """The state of ``items`` and all that missing letters reach; -1 if none."""
        todo, best = list(items), {}
        while todo:
            node, e = todo.pop()
            if e > self.edits[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(k, e + 1) for k in self.children[node].values()]
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            hit = [e for node, e in key if 0 <= e <= self.ends[node]]
            if any(self.stem[node] and e == 0 for node, e in key):
                self.found.append(2)
            else:
                self.found.append((1 if min(hit) == 0 else 3) if hit else 0)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        after = set()
        for node, e in self.sets[state]:
            after.add((node, e + 1))  # a letter too many
            for letter, child in self.children[node].items():
                after.add((child, e + (letter != c)))
        self.steps[state][c] = to = self._state(after)
        return to

    def match(self, word: str) -> int:
        state, stem = self.start, 0
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return stem
            if self.found[state] == 2:
                stem = 2
        return self.found[state] or stem


class Matcher:
    """Word classes with a bounded memory of words met."""

    def __init__(self, words: list[str], stems: list[str]):
        self.automaton = LexiconAutomaton(words, stems)
        self.plain: set[str] = set()
        self.hits: dict[str, int] = {}

    def features(self, text: str) -> list[float]:
        """[direct exact, direct stem, direct misspelt, quoted, density]."""
        words = text.lower().split()
        for w in set(words).difference(self.plain, self.hits):
            kind = self.automaton.match(w.strip(EDGES))
            if kind:
                self.hits[w] = kind
            else:
                self.plain.add(w)
        out = [0, 0, 0, 0]
        if not self.hits.keys().isdisjoint(words):
            for i, w in enumerate(words):
                kind = self.hits.get(w)
                if kind:
                    out[3 if self._quoted(words, i) else kind - 1] += 1
        if len(self.plain) + len(self.hits) > MAX_KNOWN:
            self.plain, self.hits = set(), {}
        return [*map(math.log1p, out), math.log1p(100 * sum(out[:3]) / max(1, len(words)))]

    @staticmethod
    def _quoted(words: list[str], i: int) -> bool:
        before, after = words[max(0, i - WINDOW):i], words[i + 1:i + 1 + WINDOW]
        if any(w.strip(EDGES) in REPORTING for w in (*before, *after)):
            return True
        opens = words[i][0] in QUOTES or any(w[0] in QUOTES and w[-1] not in QUOTES for w in before)
        closes = words[i].rstrip(".,;:!?")[-1:] in tuple(QUOTES) or any(w.rstrip(".,;:!?")[-1:] in tuple(QUOTES) for w in after)
        return opens and closes


def sample_labels(labels: DataFrame, max_labelled: int) -> DataFrame:
    """(label_id, toxic): the labelled rows that may be learned from."""
    key = F.col("doc_id").cast("string")
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.crc32(key) % 5 != 0)
    return (known.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h"))
            .orderBy("h", "label_id", "toxic").limit(max_labelled).select("label_id", "toxic"))


def learn_lexicon(rows: DataFrame, max_words: int = 500, max_stems: int = 200) -> tuple[list[str], list[str]]:
    """Words and stems from (text, toxic): those in three, and in half a percent,
    of the toxic texts at least, and 20 times likelier there."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = {w.strip(EDGES) for w in (text or "").lower().split()}
                words = {w for w in words if 3 <= len(w) <= 30}
                terms = {("w", w) for w in words} | {("s", w[:k]) for w in words for k in STEM_SIZES if len(w) >= k}
                counts[int(toxic > 0)].update([*terms, ("n", "")])
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.string()),
             pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())],
            names=["kind", "term", "yes", "no"])

    terms = rows.select("text", "toxic").mapInArrow(tally, "kind string, term string, yes long, no long").groupBy("kind", "term").agg(
        F.sum("yes").alias("yes"), F.sum("no").alias("no")).persist()
    try:
        total = terms.where("kind = 'n'").first()
        if total is None or not total.yes:
            return [], []
        least = max(3, math.ceil(0.005 * total.yes))
        ratio = f"((yes + 0.5) / {total.yes + 1}) / ((no + 0.5) / {total.no + 1})"
        strong = terms.where(f"yes >= {least} AND {ratio} >= 20").withColumn("ratio", F.expr(ratio))
        words = [r.term for r in strong.where("kind = 'w'").orderBy(F.desc(F.expr("yes * ln(ratio)")), "term").limit(max_words).collect()]
        found = strong.where("kind = 's' AND yes >= 20 * no").orderBy(F.length("term"), F.desc("yes"), "term").limit(10 * max_stems).collect()
    finally:
        terms.unpersist()
    stems: list[str] = []
    for r in found:  # a stem with a shorter stem adds nothing
        if len(stems) < max_stems and not any(r.term[:k] in stems for k in STEM_SIZES if k < len(r.term)):
            stems.append(r.term)
    return words, stems


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Weights (constant last) by Newton's method; the constant is not penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.full(len(w), l2)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", *,
                    max_labelled: int = 20_000) -> DataFrame:
    """``id_col``, held_out, score, predicted, n_matches and n_quoted per document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    sample = F.broadcast(sample_labels(labels, max_labelled))  # max_labelled rows at most
    learnable = rows.join(sample, F.col("id") == F.col("label_id"))
    words, stems = learn_lexicon(learnable)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(words, stems)
        for b in batches:
            got = [m.features(t or "") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64())), b.column(1)], names=["x", "toxic"])

    fitted = learnable.select("text", "toxic").mapInArrow(features, "x array<double>, toxic int").collect()
    x = np.array([r.x for r in fitted], float).reshape(-1, 5)
    weights = fit_logistic(x, np.array([float(r.toxic > 0) for r in fitted]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(words, stems)
        for b in batches:
            got = np.array([m.features(t or "") for t in b.column(1).to_pylist()]).reshape(-1, 5)
            p = 1 / (1 + np.exp(-np.clip(got @ weights[:-1] + weights[-1], -30, 30)))
            counts = np.rint(np.expm1(got[:, :4])).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(counts[:, :3].sum(axis=1)), pa.array(counts[:, 3])],
                names=["id", "score", "predicted", "n_matches", "n_quoted"])

    id_type = docs.schema[id_col].dataType.simpleString()
    scored = rows.mapInArrow(score, f"id {id_type}, score double, predicted int, n_matches long, n_quoted long")
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", "predicted", "n_matches", "n_quoted")
