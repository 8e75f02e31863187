"""Operator 11, alignment of two tokenizers over exactly deduplicated texts.

Texts are shuffled whole (``groupBy`` adds up copies before the shuffle), and
each distinct text is tokenised by both tokenizers and aligned once, in one
pass that writes its measures and its linked id pairs with their counts.
Corpus-wide pair counts weigh each text by its multiplicity.  The
``FREQUENT_PAIRS`` most frequent pairs go to the tasks as arrays of fixed size;
links of the other pairs are joined by pair.  Both parts are added up, and the
measures are joined to the documents by the texts' SHA-256.

Inside a text, both tokenizers end a token before a single space that stands
between a character other than white space and one other than a space: the
byte-level one opens a pre-token there, and no piece of the other joins a
character with a space after it (checked when the vocabulary is loaded).  So a
text is cut there into chunks, each distinct chunk of a worker is aligned once,
and a text's measures are sums over its chunks.  Where a chunk's token bytes
differ from its own bytes, the text is tokenised whole and judged as a whole.

Two tokens are linked when their byte ranges overlap; a group of ``n`` and ``m``
tokens without a common end inside has ``n + m - 1`` links.

Defined cases: null or empty texts, and texts whose tokens' bytes differ from
the text with a space before it (those with U+2581, say), have no tokens.
Repeated rows and ids, and null ids, are rows of their own.  Extra columns are
ignored, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errata.llm import textops as T
from errata.llm.tokens import _byte_letters
from errata.session import materialize

FREQUENT_PAIRS = 500_000
#: A worker's chunks start anew beyond these.
MAX_CHUNKS, MAX_LINKS = 1 << 18, 1 << 22
#: Bits of the second tokenizer's ids in a pair's code, and of the code.
B_BITS, CODE_BITS = 17, 34


def default_paths() -> tuple[str, str]:
    """The tokenizer files that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Aligned:
    """Alignments of texts: n_a, n_b, n_groups and 1 by row (zeros where the
    bytes differ), the groups' texts, and all links' codes with their number by row."""

    counts: np.ndarray
    groups: list[bytes]
    sizes: np.ndarray
    links: np.ndarray

    @classmethod
    def none(cls, n: int) -> Aligned:
        return cls(np.zeros((n, 4), np.int64), [b""] * n, np.zeros(n, np.int64), np.zeros(0, np.uint64))

    def spread(self, rows: np.ndarray, n: int) -> Aligned:
        """These as rows ``rows`` of ``n``, the others without tokens."""
        out = Aligned.none(n)
        out.counts[rows], out.sizes[rows], out.links = self.counts, self.sizes, self.links
        for k, text in zip(rows.tolist(), self.groups):
            out.groups[k] = text
        return out


def cuts_before_words(data: np.ndarray) -> np.ndarray:
    """Flags of the bytes before which a text with its leading space is cut."""
    flags = np.zeros(len(data), bool)
    if len(data) < 3:
        return flags
    space = data == 32
    flags[1:-1] = space[1:-1] & ~space[2:] & (data[:-2] > 32)
    at = np.flatnonzero(flags)
    p1, p2, p3 = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    # white space outside ASCII before the space: U+0085, U+00A0, U+1680, U+2000-200A, 2028, 2029, 202F, 205F, 3000
    wide = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))
    wide |= (p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80)
    wide |= (p3 == 0xE2) & (p2 == 0x80) & ((p1 <= 0x8A) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF))
    wide |= (p3 == 0xE2) & (p2 == 0x81) & (p1 == 0x9F)
    wide |= (p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)
    flags[at[wide]] = False
    return flags


class Aligner:
    """Both tokenizers, and the chunks met so far."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {c: b for b, c in _byte_letters().items()} | {chr(b): b for b in range(256) if b not in _byte_letters()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_b, self.cuts = [], True
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
            self.cuts &= all(x == "▁" or y != "▁" for x, y in zip(piece, piece[1:]))
        self.marked = []
        for spelt, mark in ((self.bytes_a, b"|"), (self.bytes_b, b";")):
            marked = np.empty(2 * len(spelt), object)
            for i in range(len(spelt)):
                marked[2 * i], marked[2 * i + 1] = b"%d," % i, b"%d%s" % (i, mark)
            self.marked.append(marked)
        self.clear()

    def align(self, raws: list[bytes]) -> Aligned:
        """Alignments of texts that have their leading space.  All tokens stand
        in a row: every end of one, in either tokenizer, closes one link, and
        every common end a group."""
        texts = [raw.decode("utf-8", "replace") for raw in raws]
        ids, ends, count = [], [], []
        broken = np.zeros(len(raws), bool)
        stops = np.cumsum([len(raw) for raw in raws])
        for lists, spelt in (([e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)], self.bytes_a),
                             (self.b.encode([t[1:] for t in texts], num_threads=1), self.bytes_b)):
            flat = [spelt[i] for i in chain.from_iterable(lists)]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            total = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))
            reached = np.concatenate([[0], total])[np.cumsum(sizes)]
            if b"".join(flat) != b"".join(raws) or (reached != stops).any():  # which texts?
                broken |= np.fromiter((b"".join([spelt[i] for i in x]) != raw for x, raw in zip(lists, raws)), bool, len(raws))
            ids.append(np.fromiter(chain.from_iterable(lists), np.int64, len(flat)))
            ends.append(total)
            count.append(sizes)
        if broken.any():
            kept = np.flatnonzero(~broken)
            return self.align([raws[k] for k in kept.tolist()]).spread(kept, len(raws)) if len(kept) else Aligned.none(len(raws))
        points = np.union1d(*ends)
        at = [np.searchsorted(e, points) for e in ends]
        common = np.intersect1d(*ends, assume_unique=True)
        links, groups = (np.diff(np.searchsorted(x, stops, "right"), prepend=0) for x in (points, common))
        # groups' text: each id with the mark after it, the first tokenizer's of a group before the second's
        pieces, turn = [], []
        for side, (i, e) in enumerate(zip(ids, ends)):
            group = np.searchsorted(common, e)
            last = common[group] == e
            pieces.append(self.marked[side][2 * i + last])
            turn.append(2 * group + side)
        order = np.argsort(np.concatenate(turn), kind="stable")
        pieces = np.concatenate(pieces)[order].tolist()
        text = b"".join(pieces)
        lengths = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        cut = lengths[np.cumsum(count[0] + count[1]) - 1].tolist()
        return Aligned(np.column_stack([*count, groups, np.ones(len(raws), np.int64)]), [text[lo:hi - 1] for lo, hi in zip([0, *cut[:-1]], cut)],
                       links, (ids[0][at[0]] << B_BITS | ids[1][at[1]]).astype(np.uint64))

    def _learn(self, hashes: list[int], raws: list[bytes]) -> None:
        """Give new chunks their slots."""
        found = self.align(raws)
        self.slot.update(zip(hashes, range(len(self.groups), len(self.groups) + len(raws))))
        self.groups += found.groups
        at = len(self.links) + np.cumsum(found.sizes) - found.sizes
        self.chunks = np.concatenate([self.chunks, np.column_stack([found.counts, at, found.sizes])])
        self.links = np.concatenate([self.links, found.links])

    def clear(self) -> None:
        # slot k: its groups' text, then n_a, n_b, n_groups, whole?, place and number of its links
        self.slot: dict[int, int] = {}
        self.groups: list[bytes] = []
        self.chunks, self.links = np.zeros((0, 6), np.int64), np.zeros(0, np.uint64)

    def texts(self, s: T.Slice) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Of a slice's texts: (n_a, n_b, n_groups) by row, their groups, and
        their links' sorted keys (row and pair code) with counts."""
        data = np.insert(s.data, s.offsets[:-1], 32)
        offsets = s.offsets + np.arange(s.rows + 1)
        opens = cuts_before_words(data) if self.cuts else np.zeros(len(data), bool)
        opens[offsets[:-1]] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(data))
        first = np.searchsorted(starts, offsets)
        distinct, where, back = np.unique(T.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.groups) > MAX_CHUNKS or len(self.links) > MAX_LINKS:
            self.clear()
        names = distinct.tolist()
        new = [k for k, h in enumerate(names) if h not in self.slot]
        if new:
            self._learn([names[k] for k in new], [data[starts[i]:ends[i]].tobytes() for i in where[new].tolist()])
        slots = np.array([self.slot[h] for h in names], np.int64)[back]
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.chunks[slots, :4], axis=0)])
        measures = sums[first[1:]] - sums[first[:-1]]
        broken = np.flatnonzero(measures[:, 3] < np.diff(first))
        texts = [self.groups[k] for k in slots.tolist()]
        bounds = first.tolist()
        groups = [b";".join(texts[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:])]
        rows = np.repeat(np.arange(s.rows), np.diff(first))
        kept = ~np.isin(rows, broken) if len(broken) else np.ones(len(rows), bool)
        at, sizes = self.chunks[slots[kept], 4], self.chunks[slots[kept], 5]
        total = np.cumsum(sizes) - sizes
        codes = self.links[np.repeat(at - total, sizes) + np.arange(sizes.sum())]
        keys = [np.repeat(rows[kept].astype(np.uint64), sizes) << T.U64(CODE_BITS) | codes]
        for i in broken.tolist():  # judged whole
            found = self.align([data[offsets[i]:offsets[i + 1]].tobytes()])
            measures[i], groups[i] = found.counts[0], found.groups[0]
            keys.append(found.links | T.U64(i << CODE_BITS))
        return measures[:, :3], groups, *np.unique(np.concatenate(keys), return_counts=True)


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner for one pair of tokenizer files."""
    return Aligner(path_a, path_b)


ALIGNED = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, counts binary"


def _align(path_a: str, path_b: str):
    """Task over distinct texts (key, copies, t): measures and sorted pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for b in batches:
            for s in T.slices(b.column(2)):
                measures, groups, keys, counts = both.texts(s)
                codes = keys & T.U64((1 << CODE_BITS) - 1)
                at = np.searchsorted(keys, np.arange(s.rows + 1, dtype=np.uint64) << T.U64(CODE_BITS))
                counts = counts.astype(np.uint32)
                binary = lambda x: pa.array([x[lo:hi].tobytes() for lo, hi in zip(at[:-1], at[1:])], pa.binary())  # noqa: E731,B023
                n_a, n_b, n_groups = measures.T.copy()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.lo, s.rows), b.column(1).slice(s.lo, s.rows), *map(pa.array, (n_a, n_b, n_groups, n_a + n_b - n_groups)),
                     pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups]), binary(codes), binary(counts)],
                    names=[c.split()[0] for c in ALIGNED.split(", ")])

    return run


def _pair_rows(column_codes: pa.Array, column_counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, counts and row numbers of a batch's pairs."""
    codes = [np.frombuffer(x, np.uint64) for x in column_codes.to_pylist()]
    counts = [np.frombuffer(x, np.uint32) for x in column_counts.to_pylist()]
    rows = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    return np.concatenate(codes).astype(np.int64), np.concatenate(counts).astype(np.int64), rows


def _pair_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over (copies, codes, counts): links by pair, added up per batch."""
    for b in batches:
        codes, counts, rows = _pair_rows(b.column(1), b.column(2))
        distinct, back = np.unique(codes, return_inverse=True)
        weights = counts * b.column(0).to_numpy()[rows]
        totals = np.zeros(len(distinct), np.int64)
        np.add.at(totals, back, weights)
        yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(totals)], names=["code", "n"])


def _measure(frequent):
    """Task over (key, codes, counts): sums over the frequent pairs, and the other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, totals, best = frequent.value
        for b in batches:
            codes, counts, rows = _pair_rows(b.column(1), b.column(2))
            at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
            hit = known[at] == codes if len(known) else np.zeros(len(codes), bool)
            n_best, count_sum = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            np.add.at(n_best, rows[hit], counts[hit] * best[at[hit]])
            np.add.at(count_sum, rows[hit], counts[hit] * totals[at[hit]])
            rest = np.flatnonzero(~hit)
            ends = np.searchsorted(rows[rest], np.arange(len(b) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[rest])) for x in (codes, counts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_best), pa.array(count_sum), *lists],
                                             names=["key", "n_best", "count_sum", "codes", "counts"])

    return run


def alignment_measures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, paths: tuple[str, str] | None = None,
                       frequent_pairs: int = FREQUENT_PAIRS) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256 and ``copies`` (rows with the same text)."""
    spark = docs.sparkSession
    path_a, path_b = paths or default_paths()
    rows = T.bounded(docs).select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    distinct = rows.where("t <> ''").groupBy("t").agg(F.count("*").alias("copies"))
    aligned = materialize(distinct.select(F.expr("unhex(sha2(CAST(t AS binary), 256))").alias("key"), "copies", "t")
                          .mapInArrow(_align(path_a, path_b), ALIGNED), "align-texts", "zstd")

    totals = aligned.where("n_links > 0").select("copies", "codes", "counts").mapInArrow(_pair_totals, "code long, n long")
    pairs = totals.groupBy("code").agg(F.sum("n").alias("n")).withColumn("b", F.expr(f"code & {(1 << B_BITS) - 1}L"))
    pairs = materialize(pairs, "align-pairs")
    top = pairs.groupBy("b").agg(F.max("n").alias("top"))
    graded = materialize(pairs.join(top, "b").select("code", "n", (F.col("n") == F.col("top")).cast("int").alias("best")), "align-graded")
    # of fixed size, whatever the corpus; all other pairs are joined below
    head = graded.orderBy(F.desc("n"), "code").limit(frequent_pairs).toPandas().sort_values("code")
    frequent = spark.sparkContext.broadcast(tuple(head[c].to_numpy(np.int64) for c in ("code", "n", "best")))

    found = materialize(aligned.where("n_links > 0").select("key", "codes", "counts").mapInArrow(
        _measure(frequent), "key binary, n_best long, count_sum long, codes array<long>, counts array<long>"), "align-measures")
    rare = (found.where("size(codes) > 0").select("key", F.explode(F.arrays_zip("codes", "counts")).alias("p"))
            .select("key", F.col("p.codes").alias("code"), F.col("p.counts").alias("k")).join(graded, "code")
            .select("key", (F.col("k") * F.col("best")).alias("n_best"), (F.col("k") * F.col("n")).alias("count_sum")))
    sums = (found.select("key", "n_best", "count_sum").unionByName(rare).groupBy("key")
            .agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    measures = aligned.drop("codes", "counts").join(sums, "key", "left").withColumnRenamed("key", "of")

    keyed = rows.select("id", F.expr("unhex(sha2(CAST(t AS binary), 256))").alias("key"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return keyed.join(measures, F.col("key") == F.col("of"), "left").select(
        F.col("id").alias(id_col), *[zero(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"), zero("copies"))
