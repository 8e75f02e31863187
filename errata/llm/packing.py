"""Operator 6, packing: deficit round-robin over source queues into windows.

Every source is a queue of documents in id order.  A round is one window: in
each, a queue earns its target share of the window's tokens (its quantum),
sends as many whole tokens as its credit covers, cutting documents where the
credit ends, and carries the fraction on.  After k rounds a queue has sent
floor(k * quantum) tokens, whatever the others did, so rounds need no
sequential pass: one running total per queue gives a document's place in its
queue and with it its pieces and their rounds; one over (round, source, place
in the queue) gives every piece its place in the stream, over all partitions.
The stream is cut every ``window`` tokens.  The last, partial window is cut
into powers of two, so no sequence needs padding.

A queue with a quantum below ``min_piece`` tokens saves its credit for as many
rounds as make up that much, so pieces number at most tokens / ``min_piece`` and
two per document more; such queues take turns in different rounds.  While no
queue has ended, a window holds each source's quantum to the token, but for the
fractions that are carried (less than a token per source, so windows lag rounds
by less than the number of sources) and the turns of those saving queues.

By default a source's target share is its share of all tokens, so all queues
end together; other shares may be given, and queues that end early leave their
turns to the others, in proportion.  A source without a positive share follows
after all others.

Defined cases: a null or empty text is the end token alone.  A null source is
a queue of its own, after all others.  Repeated rows and ids are packed once
each (``row_key`` tells them apart).  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errata.functions.scan import running_totals
from errata.llm import textops as T
from errata.llm.tokens import default_path, encoder
from errata.session import materialize

SLICE = 1 << 20


def tokenize(docs: DataFrame, id_col: str, text: str, source: str, tokenizer: str) -> DataFrame:
    """(row_key, id, source, n, ids): the ids of every text with its end token,
    as little-endian 16-bit numbers (32-bit for vocabularies beyond them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind = "<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for b in batches:
            for s in T.slices(b.column(3), SLICE):
                ids, at = enc.encode(s)
                raw = ids.astype(kind)
                data = pa.Array.from_buffers(pa.large_binary(), s.rows, [
                    None, pa.py_buffer((at * raw.itemsize).astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).slice(s.lo, s.rows) for k in range(3)), pa.array(np.diff(at)), data.cast(pa.binary())],
                    names=["row_key", "id", "source", "n", "ids"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = T.bounded(docs).select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).alias("id"),
                       F.col(source).cast("string").alias("source"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"row_key long, id {id_type}, source string, n long, ids binary")


def schedule(sizes: DataFrame, window: int, shares: DataFrame | None = None, min_piece: int = 64) -> DataFrame:
    """(row_key, id, source, n) -> one row per piece that a queue sends in one
    turn: row_key, round, start (in its document), length and place, its first
    token in the stream.  ``shares`` is (source, share)."""
    queued = running_totals(sizes, ["id", "row_key"], {"queued": "n"}, ["source"])
    if shares is None:
        total = sizes.agg(F.sum("n")).first()[0] or 0
        shares = sizes.groupBy("source").agg((F.sum("n") / F.lit(float(max(total, 1)))).alias("share"))
    quantum = F.col("share") * float(window)
    turns = (shares.where("share > 0")
             .select(F.col("source").alias("queue"), quantum.alias("quantum"), F.greatest(F.lit(1), F.ceil(min_piece / quantum)).alias("every"))
             .select("queue", "every", (F.col("quantum") * F.col("every")).alias("turn"), F.expr("pmod(xxhash64(queue), every)").alias("ahead")))
    # turn k of a queue sends its tokens [floor(k * turn), floor((k + 1) * turn)); the
    # estimated first and last turns of a document are widened by one for rounding
    parts = F.expr("""filter(transform(
        sequence(greatest(0L, floor(queued / turn) - 1), floor((queued + n) / turn) + 1),
        k -> struct((k + 1) * every - ahead AS round, greatest(queued, floor(k * turn)) - queued AS start,
                    least(queued + n, floor((k + 1) * turn)) - queued AS stop)), p -> p.start < p.stop)""")
    whole = F.expr("array(struct(CAST(NULL AS bigint) AS round, 0L AS start, n AS stop))")
    sent = (queued.join(turns, F.col("source").eqNullSafe(F.col("queue")), "left")
            .select("row_key", "id", "source", F.inline(F.when(F.col("turn").isNotNull(), parts).otherwise(whole)))
            .withColumn("length", F.col("stop") - F.col("start")).drop("stop"))
    order = [F.col("round").isNull(), "round", F.col("source").isNull(), "source", "id", "row_key", "start"]
    return running_totals(sent, order, {"place": "length"}).select("row_key", "round", "start", "length", "place")


def tail_cuts(total: int, window: int) -> list[int]:
    """Stream positions within the last, partial window where its powers of
    two begin, its start and end included."""
    at, rest = total - total % window, total % window
    cuts = []
    while rest:
        cuts.append(at)
        at += 1 << (rest.bit_length() - 1)
        rest -= 1 << (rest.bit_length() - 1)
    return [*cuts, total]


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", *, window: int = 4096,
         tokenizer: str | None = None, shares: DataFrame | None = None, min_piece: int = 64) -> DataFrame:
    """One row per piece: ``id_col``, ``row_key``, source, round, start, length, ids
    (binary), ids_crc32, doc_tokens, sequence_id and offset."""
    ids = materialize(tokenize(docs, id_col, text, source, tokenizer or default_path()), "pack-ids", "zstd")
    sent = schedule(ids.select("row_key", "id", "source", "n"), window, shares, min_piece)
    total = ids.agg(F.sum("n")).first()[0] or 0
    tail = tail_cuts(total, window)
    whole = total - total % window
    marks = ", ".join(f"{c}L" for c in tail)
    cuts = F.expr(f"""array_distinct(flatten(array(
        array(place),
        filter(CASE WHEN place div {window} < (place + length - 1) div {window}
            THEN transform(sequence(place div {window} + 1, (place + length - 1) div {window}), k -> k * {window}L) ELSE array() END, c -> c <= {whole}L),
        filter(array({marks}), c -> c > place AND c < place + length),
        array(place + length))))""")
    parts = F.expr("transform(slice(cuts, 1, size(cuts) - 1), (c, k) -> struct(start + c - place AS start, cuts[k + 1] - c AS length, c AS place, round AS round))")
    # a document's pieces meet again in one row, next to its ids: both are as long as the document at most
    cut = sent.withColumn("cuts", cuts).groupBy("row_key").agg(F.array_sort(F.flatten(F.collect_list(parts))).alias("parts"))
    n_whole = whole // window

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.array(tail, np.int64)
        for b in batches:
            n = b.column(3).to_numpy()
            for s in T.slices(b.column(5), SLICE):
                rows, size = b.slice(s.lo, s.rows), n[s.lo:s.hi]
                values = np.frombuffer(s.data, f"<u{len(s.data) // size.sum()}").astype("<u4").tobytes()
                parts, own = rows.column(4).flatten(), pa.compute.list_parent_indices(rows.column(4))
                length, place = (parts.field(k).to_numpy() for k in ("length", "place"))
                # the pieces of a document cover its ids in order, so they cover the slice's
                ends = np.cumsum(length) * 4
                crc = [zlib.crc32(values[hi - 4 * k:hi]) for hi, k in zip(ends.tolist(), length.tolist())]
                k = np.searchsorted(starts, place, "right") - 1
                inside = place < whole
                seq = np.where(inside, place // window, n_whole + k)
                base = np.where(inside, place // window * window, starts[k])
                raw = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64).tobytes()), pa.py_buffer(values)])
                own_columns = rows.select([1, 0, 2]).take(own).columns
                yield pa.RecordBatch.from_arrays(
                    [*own_columns, parts.field("round"), parts.field("start"), parts.field("length"), raw.cast(pa.binary()),
                     pa.array(crc, pa.int64()), pa.array(size[own.to_numpy()], pa.int64()), pa.array(seq, pa.int64()), pa.array(place - base, pa.int64())],
                    names=["id", "row_key", "source", "round", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = cut.join(ids, "row_key").select("row_key", "id", "source", "n", "parts", "ids")
    return rows.mapInArrow(pieces, f"id {id_type}, row_key long, source string, round long, start long, length long, ids binary, "
                           "ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)
