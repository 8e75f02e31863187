"""Operator 5, mixing sources to target weights by a splitting tree.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share 100 percent of all words; a target stops at ``max_epochs`` times its
source, and the excess goes to the others by weight.

Blocks: a source's words, documents in id order, are cut into blocks of ``B``
words.  Epoch e of the source deals its N blocks in a pseudo-random
permutation, so draw ``e * N + rank`` names one block of one epoch, and the
first ``quota`` draws are the source's share of the mix: whole epochs first,
then a random part of the next, no block twice in an epoch.

Splitting tree: the quotas of all sources are split between the two halves of
the output shards by one multivariate hypergeometric draw per node, down to
single shards.  A shard takes its count of each source's draws as one range of
draw numbers; ranges are disjoint and cover the quotas exactly.  Rows of a
shard are shuffled by a hash of (shard, source, draw).

All draws come from hashes of ``seed`` and the node, source or epoch, so
reruns agree.  Defined cases: a null or empty text has size 0 and takes 0; a
null source is one source; repeated rows and ids are mixed each; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errata.functions.scan import running_totals
from errata.llm import textops as T
from errata.session import materialize

WEIGHTS = [5, 2, 1]


def word_sizes(docs: DataFrame, id_col: str, text: str, source: str, key: str | None = None) -> DataFrame:
    """(row_key, id, source, size): words of every text.  ``key`` names a
    column that tells rows apart; without one, rows are numbered as read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b.column(3)):
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).slice(s.lo, s.rows) for k in range(3)), pa.array(np.diff(T.word_spans(s)[2]))],
                    names=["row_key", "id", "source", "size"])

    id_type = docs.schema[id_col].dataType.simpleString()
    row_key = F.col(key) if key else F.monotonically_increasing_id()
    rows = T.bounded(docs).select(row_key.alias("row_key"), F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"row_key long, id {id_type}, source string, size long")


def targets(sizes: DataFrame, weights: list[int] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target): one row per source.

    With a source's level = cap / weight, all sources up to some level are
    capped and the others get ``weight`` times one common value."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_totals(per, [F.col("source").isNull(), "source"], {"rank": "1"})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", max_epochs * F.col("source_size"))
    ranked = ranked.withColumn("level", F.col("cap") / F.col("weight"))
    filled = running_totals(ranked, ["level", F.col("source").isNull(), "source"], {"capped_before": "cap", "weight_before": "weight"})
    filled = materialize(filled, "mix-sources")
    words, weights_all = (x or 0 for x in filled.agg(F.sum("source_size"), F.sum("weight")).first())
    # the value that this source and all above it would share
    value = (words - F.col("capped_before")) / (weights_all - F.col("weight_before"))
    judged = filled.withColumn("capped", F.col("level") < value)
    held, held_weight = (x or 0 for x in judged.where("capped").agg(F.sum("cap"), F.sum("weight")).first())
    share = (words - held) / max(1, weights_all - held_weight)
    open_target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(share)))
    return judged.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(open_target).alias("target"))


def quotas(mix: DataFrame, block_words: int = 512, max_epochs: int = 3) -> DataFrame:
    """``mix`` with the block size (a thousandth of the source's words, 1
    to ``block_words``), the blocks of an epoch, and the quota of draws."""
    size = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("source_size") / 1_000))).cast("long")
    blocks = F.ceil(F.col("source_size") / F.col("block"))
    quota = F.when(F.col("target") >= max_epochs * F.col("source_size"), max_epochs * F.col("blocks")).otherwise(
        F.least(max_epochs * F.col("blocks"), F.round(F.col("target") / F.col("block")).cast("long")))
    return mix.withColumn("block", size).withColumn("blocks", blocks).withColumn("quota", quota)


def _rng(*parts) -> np.random.Generator:
    raw = repr(parts).encode()
    return np.random.default_rng(np.frombuffer(raw.ljust(-(-len(raw) // 4) * 4), np.uint32))


URN_LIMIT = 10**9  # numpy draws from smaller urns only


def draw_from_urn(rng: np.random.Generator, counts: np.ndarray, take: int) -> np.ndarray:
    """How many of ``take`` balls, drawn without replacement, are of each kind.

    From an urn of ``URN_LIMIT`` balls or more, each ball is first taken by a coin
    of odds take / all, a binomial per kind: given their number, the balls taken
    are a uniform subset.  Balls drawn uniformly from those taken then go back, or
    from the others come in, until there are ``take``; their number grows with
    the root of the urn."""
    total = int(counts.sum())
    if total < URN_LIMIT:
        return rng.multivariate_hypergeometric(counts, take, method="marginals")
    taken = rng.binomial(counts, take / total)
    over = int(taken.sum()) - take
    pool = np.cumsum(taken if over > 0 else counts - taken)
    chosen = np.zeros(0, np.int64)
    while len(chosen) < abs(over):  # distinct balls, drawn again where they repeat
        more = rng.integers(0, pool[-1], abs(over) - len(chosen))
        _, first = np.unique(np.concatenate([chosen, more]), return_index=True)
        chosen = np.concatenate([chosen, more])[np.sort(first)]
    moved = np.bincount(np.searchsorted(pool, chosen, "right"), minlength=len(counts))
    return taken - moved if over > 0 else taken + moved


def split_quotas(mix: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, shard, lo, hi): the range of a source's draws that a shard takes.

    One level of the tree is one job; a node's group has a row per source."""

    def split(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(key[0]), int(key[1])
        rows = rows.sort_values("source", na_position="last")
        quota = rows["quota"].to_numpy(np.int64)
        if hi - lo == 1:
            return rows
        mid = (lo + hi) // 2
        left_total = int(quota.sum()) * (mid - lo) // (hi - lo)
        left = draw_from_urn(_rng(seed, "node", lo, hi), quota, left_total)
        halves = [rows.assign(node_lo=lo, node_hi=mid, quota=left, first=rows["first"]),
                  rows.assign(node_lo=mid, node_hi=hi, quota=quota - left, first=rows["first"].to_numpy() + left)]
        return pd.concat(halves)

    schema = "node_lo int, node_hi int, source string, quota long, first long"
    nodes = mix.select(F.lit(0).alias("node_lo"), F.lit(shards).alias("node_hi"), "source", "quota", F.lit(0).cast("long").alias("first"))
    for _ in range(max(0, (shards - 1).bit_length())):
        nodes = nodes.groupBy("node_lo", "node_hi").applyInPandas(split, schema)
    return nodes.select("source", F.col("node_lo").alias("shard"), F.col("first").alias("lo"), (F.col("first") + F.col("quota")).alias("hi"))


def permuted(ranks: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1 applied to ``ranks``: four Feistel rounds
    over the next even power of two, walked until the value is below ``n``."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = T.U64((1 << half) - 1)
    out, todo = ranks.astype(T.U64), np.ones(len(ranks), bool)
    keys = T.mix(np.arange(1, 5, dtype=T.U64) + T.U64(key % (1 << 64)))
    while todo.any():
        x = out[todo]
        left, right = x >> T.U64(half), x & mask
        for k in keys:
            left, right = right, left ^ (T.mix(right + k) & mask)
        out[todo] = (left << T.U64(half)) | right
        todo[todo] = out[todo] >= T.U64(n)
    return out.astype(np.int64)


def _key(seed: int, source: str | None, epoch: int) -> int:
    return int(_rng(seed, "epoch", source, epoch).integers(1 << 62))


def draw(placed: DataFrame, ranges: DataFrame, seed: int, max_epochs: int) -> DataFrame:
    """Segments (row_key, epoch, shard, draw, order_key, start, length) of every
    document: the words of one drawn block that lie in it."""
    # a source's ranges, one row per shard, in shard order
    dealt = ranges.groupBy(F.col("source").alias("queue")).agg(F.array_sort(F.collect_list("hi")).alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict = {}
        for b in batches:
            out = []
            for row_key, source, size, at, block, blocks, quota, ends in zip(*[b.column(k).to_pylist() for k in range(8)]):
                if not size or not quota:
                    continue
                own = np.arange(at // block, (at + size - 1) // block + 1)
                start = np.maximum(own * block - at, 0)
                length = np.minimum((own + 1) * block - at, size) - start
                for epoch in range(min(max_epochs, -(-quota // blocks))):
                    if (source, epoch) not in keys:
                        keys[source, epoch] = _key(seed, source, epoch)
                    draws = epoch * blocks + permuted(own, blocks, keys[source, epoch])
                    hit = draws < quota
                    shard = np.searchsorted(np.asarray(ends), draws[hit], "right")
                    order = T.mix(draws[hit].astype(T.U64) + T.U64(keys[source, epoch])).view(np.int64)
                    out.append((np.full(hit.sum(), row_key), np.full(hit.sum(), epoch), shard, draws[hit], order, start[hit], length[hit]))
                if len(out) > 4096:
                    yield _segments(out)
                    out = []
            if out:
                yield _segments(out)

    rows = placed.join(dealt, F.col("source").eqNullSafe(F.col("queue"))).select(
        "row_key", "source", "size", "at", "block", "blocks", "quota", "ends")
    return rows.mapInArrow(run, "row_key long, epoch int, shard int, draw long, order_key long, start long, length long")


def _segments(parts: list[tuple]) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*parts)]
    types = [np.int64, np.int32, np.int32, np.int64, np.int64, np.int64, np.int64]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, types)],
                                      names=["row_key", "epoch", "shard", "draw", "order_key", "start", "length"])


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", *, shards: int = 64,
                seed: int = 17, block_words: int = 512, weights: list[int] = WEIGHTS, max_epochs: int = 3,
                key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, segments): every row with its size, its source's size and
    target and its ``row_key``; and the drawn segments by shard, to be read in
    ``order_key`` order within a shard."""
    sizes = materialize(word_sizes(docs, id_col, text, source, key), "mix-sizes")
    mix = materialize(quotas(targets(sizes, weights, max_epochs), block_words, max_epochs), "mix-quotas")
    ranges = split_quotas(mix, shards, seed)
    placed = running_totals(sizes, ["id", "row_key"], {"at": "size"}, ["source"])
    known = materialize(placed.join(mix.withColumnRenamed("source", "queue"), F.col("source").eqNullSafe(F.col("queue"))).drop("queue"), "mix-placed")
    return known, draw(known, ranges, seed, max_epochs)


def taken(known: DataFrame, segments: DataFrame) -> DataFrame:
    """(id, row_key, source, size, source_size, target, taken, shards) per document."""
    used = segments.groupBy("row_key").agg(F.sum("length").alias("taken"), F.count_distinct("shard").alias("shards"))
    return known.join(used, "row_key", "left").select(
        "id", "row_key", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"),
        F.coalesce("shards", F.lit(0)).alias("shards"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as documents: one row of ``docs``' columns per document, epoch
    and shard, its text the drawn words (an unbroken run as it stands, runs
    joined by a line end; a whole document unchanged), dealt by shard and
    shuffled within.  ``n_chars``, where there is one, follows the text."""
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text).alias("text"),
                        F.col(source).alias("source"), F.monotonically_increasing_id().alias("key"))
    _, segments = mix_sources(keyed, "id", "text", "source", key="key", **options)
    parts = segments.groupBy("row_key", "epoch", "shard").agg(
        F.array_sort(F.collect_list(F.struct("start", "length"))).alias("runs"), F.min("order_key").alias("order_key"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = b.column(1).to_pylist()
            out: list[str] = []
            for s in T.slices(b.column(0)):
                starts, ends, first = T.word_spans(s)
                for i in range(s.rows):
                    n = int(first[i + 1] - first[i])
                    texts, at = [], None
                    for r in [*runs[s.lo + i], None]:  # joins runs that touch
                        if at is not None and (r is None or r["start"] != at[1]):
                            lo, hi = (int(x) + int(first[i]) for x in at)
                            whole = at[0] == 0 and at[1] == n
                            a, z = (s.offsets[i], s.offsets[i + 1]) if whole else (starts[lo], ends[hi - 1])
                            texts.append(s.data[a:z].tobytes().decode())
                            at = None
                        if r is not None:
                            at = (at[0] if at else r["start"], r["start"] + r["length"])
                    out.append("\n".join(texts))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *(b.column(k) for k in range(2, 5))], names=["text", "shard", "order_key", "row"])

    others = F.struct(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != text])
    joined = parts.join(keyed.withColumn("rest", others).select("key", "text", "rest"), F.col("row_key") == F.col("key"))
    rest_type = joined.schema["rest"].dataType.simpleString()
    cuts = joined.select("text", "runs", "shard", "order_key", F.col("rest").alias("row")).mapInArrow(
        cut, f"text string, shard int, order_key long, row {rest_type}")
    dealt = cuts.repartition("shard").sortWithinPartitions("shard", "order_key")
    return dealt.select(*[F.col("text").alias(c) if c == text else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
                          else F.col(f"row.`{c}`") for c in docs.columns])
