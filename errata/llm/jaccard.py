"""Operator 1, n-gram Jaccard join by multiple global orders.

A document's set holds the 64-bit hashes of its distinct word shingles; two
sets link when ``100 * |A & B| >= percent * |A | B|``.  Equal sets form one
class, and all further work is on classes:

1. One pass gives every document its set size and class, and a count of all
   shingles in hashed buckets.  The fuller a bucket is above the mean, the
   later its shingles come in every order.  The buckets only choose the
   orders: any order gives the same links.
2. The first order's prefixes (``n - ceil(t n) + 1`` shingles) are shuffled by
   shingle; lists that hold one class are dropped.
3. Each list of more than ``STAR_ROWS`` rows has a pivot, and a member is
   proposed with the ``STAR_PIVOTS`` pivots it meets most often.  This joins
   large groups of near copies in linear work.  Lists whose
   members are then not in one component propose their pairs across
   components, by shingles that come early enough in both sets to be the
   first that a link of these sizes shares.
4. All pairs within one component of pivots are tried in blocks: a component is
   dealt to blocks of about ``BLOCK_ROWS`` classes, every two blocks meet in
   one task's group, and an index of the one's shingles counts the overlaps with
   each class of the other.  Steps 3 and 4 together try every pair that can link.
5. A pair's prefixes under the other orders must share
   as many shingles as any link of its sizes must; only what all orders leave
   is verified by the exact overlap.

Defined cases: a null or empty text, or one without words, has no shingles
(size 0) and links with nothing: its component is its own id.  A text of fewer
words than a shingle is one shingle of all its words.  Repeated ids are kept
as rows of their own.  A row with a null id proposes no links; it takes its
class's component where a document with an id has the same set.  Extra columns
are ignored.  64-bit digests stand for shingles and for classes: in a billion
documents one accidental match of two classes has odds of about 3 percent.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from errata.llm import textops as T
from errata.session import materialize

#: One salt per global order; the first proposes pairs, all filter them.
ORDER_SALTS = [0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0]
PART_BITS = 14
BROADCAST_ROWS = 1_000_000
STAR_ROWS = 16
STAR_PIVOTS = 4
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 19


def shingle_sets(s: T.Slice, words: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of every document of a slice."""
    data = T.LOWER[s.data]
    starts, ends, first = T.word_spans(s)
    hashes = T.span_hashes(data, starts, ends)
    counts = np.diff(first)
    by_size = {words: T.window_hashes(hashes, first, words)}
    for k in np.unique(counts[(counts > 0) & (counts < words)]):
        by_size[int(k)] = T.window_hashes(hashes, first, int(k))
    for i in range(s.rows):
        if counts[i]:
            w, at = by_size[min(int(counts[i]), words)]
            yield np.unique(w[at[i]:at[i + 1]])
        else:
            yield np.zeros(0, T.U64)


def digest(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n, percent: int):
    """Shingles of a set's prefix: a link shares one of them at least."""
    return n - (percent * n + 99) // 100 + 1


def prefix(shingles: np.ndarray, common: np.ndarray, shift: int, salt: int, percent: int) -> np.ndarray:
    """First shingles under (commonness, salted hash, hash)."""
    key = T.mix(shingles ^ T.U64(salt)) >> T.U64(8)
    key |= common[(shingles >> T.U64(shift)).astype(np.int64)].astype(T.U64) << T.U64(56)
    return shingles[np.argsort(key, kind="stable")[:prefix_length(len(shingles), percent)]]


def sketch_bits(documents: int) -> int:
    """Buckets for about 24 shingles each at 512 a document; 2**24 at most, so
    the bucket classes sent to tasks never exceed 16 MB."""
    return min(24, max(16, round(math.log2(max(1, documents) * 512 / 24))))


def _profile(words: int, bits: int):
    """Task: (id, n, class) of every document, and the task's bucket counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        id_type = None
        for b in batches:
            id_type = b.column(0).type
            for s in T.slices(b.column(1)):
                sets = list(shingle_sets(s, words))
                every = np.concatenate(sets)
                counts += np.bincount((every >> T.U64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
                yield _profile_batch(b.column(0).slice(s.lo, s.rows), [len(x) for x in sets],
                                     [digest(x) if len(x) else None for x in sets], None, None)
        if id_type is not None:
            parts = counts.reshape(-1, 1 << min(bits, PART_BITS)).clip(max=65535).astype(np.uint16)
            for k, row in enumerate(parts):
                yield _profile_batch(pa.nulls(1, id_type), [None], [None], [k], [row.tobytes()])

    return run


def _profile_batch(ids, n, classes, part, counts) -> pa.RecordBatch:
    rows = len(ids)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n, pa.int64()), pa.array(classes, pa.int64()), pa.array(part or [None] * rows, pa.int32()),
         pa.array(counts or [None] * rows, pa.binary())], names=["id", "n", "class", "part", "counts"])


def _common(sums: DataFrame, bits: int) -> np.ndarray:
    """Commonness of every bucket, 0 for most: parts are added up where they
    lie, one part at a time, and only 2**bits bytes reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row = np.frombuffer(raw, np.uint16).astype(np.int64)
                held[k] = held[k] + row if k in held else row
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.int32()), pa.array([int(v.sum()) for v in held.values()], pa.int64()),
                 pa.array([v.astype(np.int64).tobytes() for v in held.values()], pa.binary())], names=["part", "total", "counts"])

    parts = materialize(sums.repartition(max(1, (1 << bits) >> (PART_BITS + 2)), "part")
                        .mapInArrow(add, "part int, total long, counts binary"), "jaccard-buckets")
    mean = (parts.agg(F.sum("total")).first()[0] or 0) / (1 << bits)
    limit = 1.25 * mean + 2

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw in b.column(1).to_pylist():
                over = np.frombuffer(raw, np.int64) / limit
                out.append(np.where(over > 1, 1 + 3 * np.log2(np.maximum(over, 1)), 0).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["part", "grades"])

    grades = np.zeros(1 << bits, np.uint8)
    step = 1 << min(bits, PART_BITS)
    for r in parts.select("part", "counts").mapInArrow(grade, "part int, grades binary").collect():
        grades[r.part * step:(r.part + 1) * step] = np.frombuffer(r.grades, np.uint8)
    return grades


def _postings(words: int, percent: int, shift: int, common):
    """Task: (shingle, class, n, place) for the first order's prefix of every
    document; ``place`` counts from 0 in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades = common.value
        for b in batches:
            for s in T.slices(b.column(0)):
                sets = [x for x in shingle_sets(s, words) if len(x)]
                if not sets:
                    continue
                heads = [prefix(x, grades, shift, ORDER_SALTS[0], percent) for x in sets]
                sizes = [len(h) for h in heads]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(heads).view(np.int64)), pa.array(np.repeat([digest(x) for x in sets], sizes)),
                     pa.array(np.repeat([len(x) for x in sets], sizes).astype(np.int32)),
                     pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in sizes]))], names=["shingle", "class", "n", "place"])

    return run


def least_overlap(n, m, percent: int):
    """The least overlap of a link of sets of ``n`` and ``m`` shingles."""
    return -(-percent * (n + m) // (100 + percent))


def _verify(words: int, percent: int, shift: int, common):
    """Task over rows sorted by (a, salt, member): a pivot's text, then its
    members' texts.  Only the pivot's set is held."""

    def agree(x: np.ndarray, y: np.ndarray) -> bool:
        least = least_overlap(len(x), len(y), percent)
        rest = max(len(z) - prefix_length(len(z), percent) for z in (x, y))
        for salt in ORDER_SALTS[1:]:
            if len(np.intersect1d(prefix(x, common.value, shift, salt, percent),
                                  prefix(y, common.value, shift, salt, percent), assume_unique=True)) < max(1, least - rest):
                return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, pivot_set = None, None
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(4))))  # a, salt, member, class
            found_a, found_b = [], []
            for s in T.slices(b.column(4)):
                for (a, salt, member, own), x in zip(keys[s.lo:s.hi], shingle_sets(s, words)):
                    if digest(x) != own:
                        continue  # another row with the same id
                    if not member:
                        pivot, pivot_set = a, x
                    elif pivot == a and agree(pivot_set, x):
                        found_a.append(a)
                        found_b.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return run


class _Index:
    """Which of some sets hold a shingle."""

    def __init__(self, sets: list[np.ndarray]):
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]
        self.shingles, self.first, self.rows = np.unique(every[order], return_index=True, return_counts=True)
        self.sets = len(sets)

    def overlaps(self, x: np.ndarray) -> np.ndarray:
        """Shingles that each of the sets shares with ``x``."""
        at = np.minimum(np.searchsorted(self.shingles, x), len(self.shingles) - 1)
        at = at[self.shingles[at] == x]
        rows = self.rows[at]
        ends = np.cumsum(rows)
        places = np.arange(ends[-1] if len(at) else 0) + np.repeat(self.first[at] - ends + rows, rows)
        return np.bincount(self.owner[places], minlength=self.sets)


def _count_in_blocks(words: int, percent: int, shift: int, common):
    """Task over rows sorted by (label, i, j, side, class), the texts of block i
    and then those of block j: (class, links) for the links between the blocks.
    The sets of block i are held, with an index of their shingles and of their
    prefixes under each order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, last, index, classes, counts = None, {}, None, None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        out_class, out_links = [], []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (out_class, out_links)]
            out_class.clear()
            out_links.clear()
            return pa.RecordBatch.from_arrays(columns, names=["class", "links"])

        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(5))))  # label, i, j, side, class
            for s in T.slices(b.column(5)):
                for (label, i, j, side, own), x in zip(keys[s.lo:s.hi], shingle_sets(s, words)):
                    if digest(x) != own:
                        continue  # another row with the same id
                    if group != (label, i, j):
                        out_class.append(classes)
                        out_links.append(counts)
                        group, held, last, index, classes, counts = (label, i, j), {}, None, None, classes[:0], counts[:0]
                    if not side:
                        held[own] = x
                        continue
                    if own == last or not held:
                        continue  # the same class by a repeated row
                    last = own
                    if index is None:
                        sets = list(held.values())
                        classes, sizes = np.array(list(held), np.int64), np.array([len(y) for y in sets])
                        counts, tails = np.zeros(len(sets), np.int64), sizes - prefix_length(sizes, percent)
                        heads = [_Index([prefix(y, common.value, shift, salt, percent) for y in sets]) for salt in ORDER_SALTS]
                        index = _Index(sets)
                    least = least_overlap(sizes, len(x), percent)
                    shared = np.maximum(1, least - np.maximum(tails, len(x) - prefix_length(len(x), percent)))
                    left = classes < own if i == j else np.ones(len(classes), bool)
                    for salt, head in zip(ORDER_SALTS, heads):
                        if left.any():
                            left &= head.overlaps(prefix(x, common.value, shift, salt, percent)) >= shared
                    if left.any():
                        left &= index.overlaps(x) >= least
                        counts += left
                        out_class.append(np.array([own], np.int64))
                        out_links.append(np.array([left.sum()], np.int64))
            yield flush()
        out_class.append(classes)
        out_links.append(counts)
        yield flush()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(class, label) of all classes in ``edges`` (a, b): the smallest class
    that links reach, by minimum labels and pointer jumps."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("v", "u"), "jaccard-edges")
    labels = materialize(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("label")), "jaccard-labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("near"))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        step = materialize(step.join(jump, "label").select("v", "old", F.least("label", "far").alias("label")), "jaccard-labels")
        labels = step.select("v", "label")
        if step.where("label <> old").isEmpty():
            return labels.withColumnRenamed("v", "class")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, words: int = 5,
                       percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_shingles``, ``class``
    (null without shingles), ``n_links`` (links of the class with other
    classes, all of them) and ``component_id``."""
    spark = docs.sparkSession
    rows = T.bounded(docs).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    bits = sketch_bits(rows.count())
    id_type = docs.schema[id_col].dataType.simpleString()
    profile = materialize(rows.mapInArrow(_profile(words, bits), f"id {id_type}, n long, class long, part int, counts binary"),
                          "jaccard-profile")
    members = profile.where("part is null").select("id", "n", "class")
    common = spark.sparkContext.broadcast(_common(profile.where("part is not null").select("part", "counts"), bits))
    shift = 64 - bits

    classes = (members.where("class is not null and id is not null").groupBy("class")
               .agg(F.min("id").alias("rep")))
    postings = rows.where("id is not null").select("text").mapInArrow(
        _postings(words, percent, shift, common), "shingle long, class long, n int, place int")
    shared = postings.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("rows")).where("low < high")
    lists = materialize(postings.join(shared.select("shingle", (F.col("rows") > STAR_ROWS).alias("long")), "shingle")
                        .distinct(), "jaccard-lists")

    def with_texts(wanted: DataFrame, step: str) -> DataFrame:
        need = materialize(wanted.select("class").distinct().join(classes, "class"), f"jaccard-need-{step}")
        small = need.count() <= BROADCAST_ROWS  # checked; beyond it both sides are shuffled
        texts = rows.join(F.broadcast(need) if small else need, rows["id"] == need["rep"]).select("class", "text")
        return wanted.join(texts, "class")

    def verified(pairs: DataFrame, step: str) -> tuple[DataFrame, DataFrame]:
        pairs = materialize(pairs, f"jaccard-pairs-{step}")
        load = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(256)).alias("salts"))
        salted = pairs.join(load, "a").select("a", F.pmod(F.hash("b"), F.col("salts")).cast("int").alias("salt"), "b")
        wanted = (salted.select("a", "salt", F.lit(1).alias("member"), F.col("b").alias("class"))
                  .union(salted.select("a", "salt", F.lit(0).alias("member"), F.col("a").alias("class")).distinct()))
        dealt = (with_texts(wanted, step).select("a", "salt", "member", "class", "text")
                 .repartition("a", "salt").sortWithinPartitions("a", "salt", "member"))
        return pairs, materialize(dealt.mapInArrow(_verify(words, percent, shift, common), "a long, b long").distinct(),
                                  f"jaccard-links-{step}")

    def within(labels: DataFrame) -> DataFrame:
        """(class, links) with other classes of its label."""
        sizes = members.where("class is not null").groupBy("class").agg(F.max("n").alias("n"))
        load = labels.join(sizes, "class").groupBy("label").agg(F.ceil(F.greatest(
            F.count("*") / F.lit(BLOCK_ROWS), F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
        dealt = labels.join(load, "label").select("label", "class", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("own"),
                                                  F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
        wanted = dealt.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                              # a block meets itself as both sides
                              F.explode(F.expr("CASE WHEN own = other THEN array(0, 1) WHEN own < other THEN array(0) ELSE array(1) END")).alias("side"), "class")
        dealt = (with_texts(materialize(wanted, "jaccard-blocks"), "within").select("label", "i", "j", "side", "class", "text")
                 .repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "side", "class"))
        return dealt.mapInArrow(_count_in_blocks(words, percent, shift, common), "class long, links long")

    # the member whose first shared shingles come earliest has the fewest of its own
    long_lists = lists.where("long")
    pivots = long_lists.groupBy("shingle").agg(F.min_by("class", "place").alias("a"), F.min_by("n", "place").alias("n_a"))
    strength = Window.partitionBy("b").orderBy(F.desc("shared"), "a")
    star = (long_lists.join(pivots, "shingle").where(F.col("class") != F.col("a"))
            .groupBy("a", F.col("class").alias("b")).agg(F.count("*").alias("shared"), F.min("n").alias("n_b"), F.min("n_a").alias("n_a"))
            .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
            .withColumn("rank", F.row_number().over(strength)).where(F.col("rank") <= STAR_PIVOTS).select("a", "b"))
    tried, links = verified(star, "star")
    labels = components(links)

    labelled = (lists.join(labels, "class", "left")
                .select("shingle", "class", "n", "place", F.coalesce("label", "class").alias("label")))
    open_lists = labelled.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    left = labelled.join(open_lists.select("shingle"), "shingle")
    a, b = (left.select(F.col("shingle").alias(f"shingle_{x}"), F.col("class").alias(x), F.col("n").alias(f"n_{x}"),
                        F.col("place").alias(f"place_{x}"), F.col("label").alias(f"label_{x}")) for x in "ab")
    overlap = f"CAST(ceil({percent} * CAST(n_a + n_b AS long) / {100 + percent}D) AS long)"  # the least of a link
    across = a.join(b, F.expr(f"""shingle_a = shingle_b AND a < b AND label_a <> label_b
        AND place_a <= n_a - {overlap} AND place_b <= n_b - {overlap}"""))
    rest = across.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    _, more = verified(rest, "rest")
    inside = within(labels)
    labels = components(links.union(more))

    degree = (inside.union(more.select(F.explode(F.array("a", "b")), F.lit(1).cast("long"))).groupBy("class")
              .agg(F.sum("links").alias("links")))
    joined = labels.join(classes, "class")
    smallest = joined.groupBy("label").agg(F.min("rep").alias("component"))
    linked = joined.join(smallest, "label").join(degree, "class", "left").select("class", "component", "links")
    known = classes.join(linked, "class", "left").select("class", F.coalesce("component", "rep").alias("component"), "links")
    return members.join(known, "class", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class",
        F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, text: str = "text", *, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that link, directly or over others, to an
    earlier row; rows count as read, so repeated ids are rows of their own.
    Rows travel whole, so columns may have any names.  They are numbered as
    they are read, twice: ``docs`` must read the same way again, as files do."""
    keyed = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("key"))
    found = jaccard_components(keyed, "key", "text", words=words, percent=percent)
    gone = materialize(found.where("component_id <> key").select(F.col("key").alias("gone")), "jaccard-gone")
    small = gone.count() <= BROADCAST_ROWS  # checked; beyond it both sides are shuffled
    rows = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("key"))
    return rows.join(F.broadcast(gone) if small else gone, F.col("key") == F.col("gone"), "left_anti").select("row.*")
