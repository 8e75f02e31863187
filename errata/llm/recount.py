"""Operator 7, token counts under edits: a segment tree per document.

A document's leaves are runs of ``LEAF`` pre-tokens (pieces that never share a
token with their neighbours); a leaf knows its characters and its tokens, an
inner node the sums of its two children.  An edit replaces a range of
characters.  Descending by character sums finds the leaves it touches; their
text, the edit's text and the leaves next to them (the boundary context, whose
last or first piece may grow together with the new text) are encoded anew, and
the new leaves' sums go up the tree.  All other leaves keep their counts, and
are never encoded again.

Defined cases: null or empty text is a tree without leaves, 0 tokens.  Edits
apply in array order, each to the text that the one before left; positions
count code points and are clipped to the text; a null range end means the
text's end, a null replacement is empty.  A null or empty list of edits
changes nothing.  Repeated rows are edited each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errata.llm import textops as T
from errata.llm.tokens import PieceEncoder, default_path, encoder

LEAF = 64
EDITS = "array<struct<start:int,stop:int,text:string>>"


def leaf_counts(enc: PieceEncoder, s: T.Slice, i: int, sizes) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of the leaves of document ``i`` of a slice whose
    pieces are ``sizes`` (starts, ends, tokens, first)."""
    starts, _, tokens, first = sizes
    lo, hi = int(first[i]), int(first[i + 1])
    if lo == hi:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = tokens[lo:hi]
    heads = starts[lo:hi:LEAF].copy()
    heads[0] = s.offsets[i]  # white space before the first piece
    bounds = np.append(heads, s.offsets[i + 1])
    points = np.concatenate([[0], np.cumsum((s.data[s.offsets[i]:s.offsets[i + 1]] & 0xC0) != 0x80)])
    return np.diff(points[bounds - s.offsets[i]]), np.add.reduceat(own, np.arange(0, hi - lo, LEAF))


class CountTree:
    """Sums of characters and tokens over leaves; leaf k is node ``width + k``."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.leaves = len(chars)
        self.width = 1 << max(0, (max(1, self.leaves) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width:self.width + self.leaves, 0] = chars
        self.sums[self.width:self.width + self.leaves, 1] = tokens
        at = self.width
        while at > 1:
            at //= 2
            self.sums[at:2 * at] = self.sums[2 * at:4 * at:2] + self.sums[2 * at + 1:4 * at:2]

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's first character; the
        last leaf for positions beyond the text."""
        node, before = 1, 0
        position = min(position, max(0, self.chars - 1))
        while node < self.width:
            left = int(self.sums[2 * node, 0])
            node, before, position = (2 * node, before, position) if position < left else (2 * node + 1, before + left, position - left)
        return node - self.width, before

    def replace(self, lo: int, hi: int, chars: np.ndarray, tokens: np.ndarray) -> "CountTree":
        """The tree with leaves ``lo:hi`` replaced.  As many new leaves as old
        update sums on their paths only; another number rebuilds the sums
        from the kept leaves' counts."""
        if len(chars) == hi - lo:
            for k in range(lo, hi):
                node = self.width + k
                step = np.array([chars[k - lo], tokens[k - lo]]) - self.sums[node]
                while node:
                    self.sums[node] += step
                    node //= 2
            return self
        kept = self.sums[self.width:self.width + self.leaves]
        return CountTree(np.concatenate([kept[:lo, 0], chars, kept[hi:, 0]]), np.concatenate([kept[:lo, 1], tokens, kept[hi:, 1]]))


def _leaves_of(enc: PieceEncoder, text: str) -> tuple[np.ndarray, np.ndarray]:
    s = next(T.slices(pa.array([text]), 1 << 62))
    chars, tokens = leaf_counts(enc, s, 0, enc.piece_sizes(s))
    if not len(chars) and text:  # white space only
        return np.array([len(text)]), np.zeros(1, np.int64)
    return chars, tokens


def apply_edit(enc: PieceEncoder, tree: CountTree, text: str, start: int, stop: int, new: str) -> tuple[CountTree, str, int]:
    """Tree and text after one edit, and the characters encoded anew."""
    start = min(max(0, start), len(text))
    stop = min(max(start, stop), len(text))
    after = text[:start] + new + text[stop:]
    if not tree.leaves:
        return CountTree(*_leaves_of(enc, after)), after, len(after)
    first, _ = tree.find(max(0, start - 1))
    last, _ = tree.find(stop)
    lo, hi = max(0, first - 1), min(tree.leaves, last + 2)
    kept = tree.sums[tree.width:tree.width + tree.leaves, 0]
    begin = int(kept[:lo].sum())
    end = len(text) - int(kept[hi:].sum())
    region = text[begin:start] + new + text[stop:end]
    tree = tree.replace(lo, hi, *_leaves_of(enc, region))
    return tree, after, len(region)


def count_trees(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id, text, leaf_chars, leaf_tokens, n_tokens): the state kept per document."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for s in T.slices(b.column(1)):
                sizes = enc.piece_sizes(s)
                leaves = [leaf_counts(enc, s, i, sizes) for i in range(s.rows)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.lo, s.rows), b.column(1).slice(s.lo, s.rows), pa.array([c for c, _ in leaves], pa.list_(pa.int64())),
                     pa.array([t for _, t in leaves], pa.list_(pa.int64())), pa.array([int(t.sum()) for _, t in leaves], pa.int64())],
                    names=["id", "text", "leaf_chars", "leaf_tokens", "n_tokens"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return T.bounded(docs).select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInArrow(
        run, f"id {id_type}, text string, leaf_chars array<long>, leaf_tokens array<long>, n_tokens long").withColumnRenamed("id", id_col)


def recount(state: DataFrame, id_col: str = "doc_id", text: str = "text", edits: str = "edits", tokenizer: str | None = None) -> DataFrame:
    """(id, n_before, n_after, n_chars_after, n_encoded): counts after the
    ``edits`` of each row of ``state``, which has the text before them, the
    columns of ``count_trees`` and the edits; ``n_encoded`` is the number of
    characters that were encoded anew."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            out = []
            for body, chars, tokens, todo in zip(*(b.column(k).to_pylist() for k in range(1, 5))):
                body = body or ""
                tree = CountTree(np.array(chars or [], np.int64), np.array(tokens or [], np.int64))
                before, encoded = tree.tokens, 0
                for e in todo or []:
                    stop = len(body) if e["stop"] is None else e["stop"]
                    tree, body, n = apply_edit(enc, tree, body, e["start"] or 0, stop, e["text"] or "")
                    encoded += n
                out.append((before, tree.tokens, len(body), encoded))
            cols = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols)], names=["id", "n_before", "n_after", "n_chars_after", "n_encoded"])

    id_type = state.schema[id_col].dataType.simpleString()
    rows = state.select(F.col(id_col).alias("id"), text, "leaf_chars", "leaf_tokens", F.col(edits).cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, f"id {id_type}, n_before long, n_after long, n_chars_after long, n_encoded long").withColumnRenamed("id", id_col)
