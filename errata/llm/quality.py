"""Operator 2, quality rules: base counts, and distribution divergence from a
language reference.

References are built from the whole corpus: per language, the counts of the
character classes and of words.  The ``common_words`` most frequent words of a
language (ties by the word) are its common words; words over ``LONG_WORD`` bytes
are counted by a digest.  A document is compared
to its language by the Jensen-Shannon distance (base 2, 0 to 1) of both
histograms; the word histogram has one more cell for all other words.

Defined cases
-------------
* null or empty text: all counts 0, both distances null, ``base_failed``.
* a text with fewer than ``min_letters`` letters and digits, or fewer than
  ``min_words`` words, is too short to compare: distances null, the verdict is
  the base rules' alone.
* a language (null is one of its own) with fewer than ``min_reference_words``
  words has no reference: the same.  The references of the ``sent_languages``
  largest languages go to every task, the others are joined as a table.
* repeated rows are judged each; extra columns and any row order are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from errata.llm import textops as T

# Character classes, in histogram order.
CLASSES = ["lower", "upper", "other_letter", "digit", "space", "newline", "stop", "mark", "symbol", "control"]
STOPS = b".,;:!?'\"()-"
SYMBOLS = b"#*$%&|<>"


def _class_table() -> np.ndarray:
    """Class of every byte; UTF-8 continuation bytes have class 255."""
    t = np.full(256, CLASSES.index("mark"), np.uint8)
    t[:32] = CLASSES.index("control")
    t[127] = CLASSES.index("control")
    t[[9, 32]] = CLASSES.index("space")
    t[[10, 13]] = CLASSES.index("newline")
    t[ord("0"):ord("9") + 1] = CLASSES.index("digit")
    t[ord("a"):ord("z") + 1] = CLASSES.index("lower")
    t[ord("A"):ord("Z") + 1] = CLASSES.index("upper")
    t[list(STOPS)] = CLASSES.index("stop")
    t[list(SYMBOLS)] = CLASSES.index("symbol")
    t[128:192] = 255
    t[192:] = CLASSES.index("other_letter")
    return t


CLASS_OF = _class_table()
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_LETTERS = [CLASSES.index(c) for c in ("lower", "upper", "other_letter", "digit")]
_EDGE = b".,;:!?'\"()-#*$%&|<>"

# Words above so many bytes are counted by a digest; a task sends
# its counts on when it holds so many words.
LONG_WORD = 32
TALLY_WORDS = 200_000

BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def class_counts(s: T.Slice) -> np.ndarray:
    """Rows of character-class counts (code points) of a slice's documents."""
    kinds = CLASS_OF[s.data]
    n = len(CLASSES)
    heads = kinds != 255
    row = np.repeat(np.arange(s.rows), np.diff(s.offsets))[heads]
    return np.bincount(row * n + kinds[heads], minlength=s.rows * n).reshape(s.rows, n)


def dup_lines(text: bytes) -> int:
    """Lines holding a word that equal an earlier line of the text."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def base_counts(s: T.Slice) -> dict[str, np.ndarray]:
    """The base counts of a slice's documents."""
    starts, ends, first = T.word_spans(s)
    windows, at = T.window_hashes(T.span_hashes(s.data, starts, ends), first, 3)
    covered = np.zeros(len(starts), bool)
    for i in range(s.rows):
        w = windows[at[i]:at[i + 1]]
        if len(w) > 1:
            order = np.argsort(w, kind="stable")
            same = w[order][1:] == w[order][:-1]
            if same.any():
                hit = np.zeros(len(w), bool)
                hit[order[1:]] |= same
                hit[order[:-1]] |= same
                k = np.flatnonzero(hit) + first[i]
                covered[k] = covered[k + 1] = covered[k + 2] = True
    points = ((s.data & 0xC0) != 0x80) & ~T.SPACE[s.data]
    return {
        "n_words": np.diff(first),
        "word_chars": T.per_row(points, s.offsets),
        "n_symbols": T.per_row(_IS_SYMBOL[s.data], s.offsets),
        "n_dup_lines": np.array([dup_lines(s.text_bytes(i)) for i in range(s.rows)], np.int64),
        "n_repeat_words": T.per_row(covered, first),
    }


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words without punctuation at their ends; a word of over
    ``LONG_WORD`` bytes as its digest, after a byte that no UTF-8 text has."""
    words = (w.strip(_EDGE) for w in text.lower().split())
    return [w if len(w) <= LONG_WORD else b"\xff" + blake2b(w, digest_size=16).digest() for w in words if w]


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2) of two count vectors with positive sums."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum()
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum()
    return float(np.sqrt(max(0.0, (a + b) / 2)))


def build_references(docs: DataFrame, text: str = "text", lang: str = "lang", *, common_words: int = 200,
                     min_reference_words: int = 1000, sent_languages: int = 500) -> tuple[dict, DataFrame | None]:
    """Language references from all rows of ``docs``: language -> (class
    counts, {word: cell}, word counts) of the ``sent_languages`` largest
    languages, and a table of all others if there are any.  At most
    ``sent_languages`` times (``common_words`` + classes) numbers reach the driver."""

    def sent(words: dict) -> Iterator[pa.RecordBatch]:
        for k in list(words):
            items = iter(words.pop(k).items())
            while part := list(islice(items, 20_000)):
                yield _tally_batch(k, 1, *zip(*part))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict = {}
        classes: dict = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for s in T.slices(b.column(0)):
                counts = class_counts(s)
                for i in range(s.rows):
                    key = langs[s.lo + i]
                    words.setdefault(key, Counter()).update(plain_words(s.text_bytes(i)))
                    classes[key] = classes.get(key, 0) + counts[i]
                if sum(map(len, words.values())) > TALLY_WORDS:
                    yield from sent(words)
        for k, row in classes.items():
            yield _tally_batch(k, 0, [c.encode() for c in CLASSES], row.tolist())
        yield from sent(words)

    spark = docs.sparkSession
    rows = T.bounded(docs).select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null")
    counts = (rows.mapInArrow(tally, "lang string, kind int, item binary, n long")
              .groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")))
    counts = counts.persist()
    try:
        sizes = counts.where("kind = 1").groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= min_reference_words)
        largest = sizes.orderBy(F.desc("total"), F.asc_nulls_first("lang")).limit(sent_languages + 1).collect()
        totals = {r.lang: r.total for r in largest[:sent_languages]}
        place = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
        # one literal for both kinds (classes are fewer), so that every task drops all but its own first ranks before the shuffle
        top = counts.withColumn("place", F.row_number().over(place)).where(
            (F.col("place") <= max(common_words, len(CLASSES))) & ((F.col("kind") == 0) | (F.col("place") <= common_words)))
        kept = F.broadcast(spark.createDataFrame([(k,) for k in totals], "kept string"))  # sent_languages rows at most
        found = top.join(kept, F.col("lang").eqNullSafe(F.col("kept")), "left_semi").collect()
    finally:
        counts.unpersist()
    cells: dict = {k: [] for k in totals}
    for r in found:
        cells[r.lang].append(r.asDict())
    others = None
    if len(largest) > sent_languages:
        rest = sizes.join(kept, F.col("lang").eqNullSafe(F.col("kept")), "left_anti").select(F.col("lang").alias("_reference_lang"), F.col("total").alias("_reference_total"))
        others = (top.join(rest, F.col("lang").eqNullSafe(F.col("_reference_lang"))).groupBy("_reference_lang", "_reference_total")
                  .agg(F.collect_list(F.struct("kind", "place", "item", "n")).alias("_reference_cells")))
    return {k: _reference(totals[k], c) for k, c in cells.items()}, others


def _reference(total: int, found: list[dict]) -> tuple[np.ndarray, dict, np.ndarray]:
    """(class counts, {word: cell}, word counts) of one language."""
    classes, cells, n = np.zeros(len(CLASSES)), {}, []
    for r in sorted(found, key=lambda r: r["place"]):
        if r["kind"] == 0:
            classes[CLASSES.index(bytes(r["item"]).decode())] = r["n"]
        else:
            cells[bytes(r["item"])] = len(cells)
            n.append(r["n"])
    return classes, cells, np.array([*n, max(0, total - sum(n))], float)


def _joined_references(langs: list, total: pa.Array, cells: pa.Array) -> dict:
    """The references that were joined to a batch's rows, by language."""
    first = {k: i for i, k in reversed(list(enumerate(langs)))}
    return {k: _reference(total[i].as_py(), cells[i].as_py()) for k, i in first.items() if total[i].is_valid}


def _with_references(rows: DataFrame, lang: str, references: dict, others: DataFrame | None, run: Callable, schema) -> DataFrame:
    """``run`` over all rows; those of languages whose reference is not in
    ``references`` get the columns of ``others`` joined.  None of these languages
    is among the largest, so no key of the join is hot."""
    if others is None:
        return rows.mapInArrow(run, schema)
    sent = F.coalesce(F.col(lang).isin([k for k in references if k is not None]), F.lit(None in references))
    joined = rows.where(~sent).join(others, F.col(lang).eqNullSafe(F.col("_reference_lang")), "left").drop("_reference_lang")
    return rows.where(sent).mapInArrow(run, schema).unionAll(joined.mapInArrow(run, schema))


def _tally_batch(lang: str | None, kind: int, items, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(n), pa.string()), pa.array([kind] * len(n), pa.int32()), pa.array(items, pa.binary()), pa.array(n, pa.int64())],
        names=["lang", "kind", "item", "n"])


def judge(references: dict, *, min_words: int = 50, min_letters: int = 200,
          max_class_distance: float = 0.3, max_word_distance: float = 0.6) -> Callable:
    """A task over (id, text, lang) batches, with a joined reference's total and
    cells or without: base counts, distances and verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(2).to_pylist()
            known = references if b.num_columns == 3 else _joined_references(langs, b.column(3), b.column(4))
            for s in T.slices(b.column(1)):
                base, classes = base_counts(s), class_counts(s)
                by_class: list = [None] * s.rows
                by_word: list = [None] * s.rows
                for i in range(s.rows):
                    reference = known.get(langs[s.lo + i])
                    if reference is None or base["n_words"][i] < min_words or classes[i][_LETTERS].sum() < min_letters:
                        continue
                    c, cells, n = reference
                    by_class[i] = js_distance(classes[i], c)
                    hist = np.zeros(len(n))
                    for w in plain_words(s.text_bytes(i)):
                        hist[cells.get(w, -1)] += 1
                    if hist.any():
                        by_word[i] = js_distance(hist, n)
                n, r = base["n_words"], base["n_repeat_words"]
                failed = (n < 50) | (100 * r > 50 * n)
                far = np.array([(a is not None and a > max_class_distance) or (w is not None and w > max_word_distance)
                                for a, w in zip(by_class, by_word)], bool)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.lo, s.rows), *(pa.array(base[k], pa.int64()) for k in base),
                     pa.array(failed), pa.array(by_class, pa.float64()), pa.array(by_word, pa.float64()), pa.array(~failed & ~far)],
                    names=["id", *base, "base_failed", "class_distance", "word_distance", "kept"])

    return run


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
                  reference_options: dict | None = None, **limits) -> DataFrame:
    """One row per document: ``id_col``, the base counts, ``base_failed``,
    ``class_distance``, ``word_distance`` and ``kept``."""
    references, others = build_references(docs, text, lang, **(reference_options or {}))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, {BASE_SCHEMA}, base_failed boolean, class_distance double, word_distance double, kept boolean"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"), F.col(lang).alias("l"))
    return _with_references(rows, "l", references, others, judge(references, **limits), schema).withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
                 reference_options: dict | None = None, **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, in one pass and unchanged."""
    references, others = build_references(docs, text, lang, **(reference_options or {}))
    task = judge(references, **limits)
    n = len(docs.columns)
    at_text, at_lang = docs.columns.index(text), docs.columns.index(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [pa.array(range(b.num_rows), pa.int64()), b.column(at_text), b.column(at_lang), *b.columns[n:]]
            numbered = pa.RecordBatch.from_arrays(columns, names=["id", "t", "l", "total", "cells"][:len(columns)])
            kept = [k for r in task([numbered]) for k in r.column("kept").to_pylist()]
            yield b.select(list(range(n))).filter(pa.array(kept, pa.bool_()))

    return _with_references(docs, lang, references, others, run, docs.schema)
