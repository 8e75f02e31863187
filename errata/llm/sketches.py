"""Operator 10, document fingerprints: invertible Bloom lookup sketches of
paragraph digests.  Spark functions only.

Paragraphs: the lines of a text, long lines cut after the word that passes
``PIECE`` characters, by one rule for texts of every length, so texts that
share lines share digests whatever their lengths.  A paragraph's digest is its
64-bit hash; a document's set holds its distinct digests and grows with it.

Sketch: a group has three tables of ``TABLE`` cells; a digest goes into one
cell of each, adding one to its count and XOR-ing digest and check hash.  The
fingerprint is the one-group sketch as text.  To compare two documents their
sketches are subtracted cell by cell, which cancels what they share, and
peeled: a cell that holds one digest gives it up and frees its other cells.
If cells remain, the digests are dealt to groups by other hashes, in a number
that grows with the sets, and each group is peeled on its own; what groups with
remaining cells hold is dealt anew to twice as many.

Likeness is 2 * common / (size + other size) from the sizes and the digests
that peeling recovers; two empty texts are alike (1).

Defined cases: null text is an empty text, whose fingerprint has no cells.
Equal texts have equal fingerprints.  A null id counts as the smallest; rows
with equal ids follow each other in text order.  A single row is its own next
document.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIECE = 256
#: Up to this length lines are the paragraphs; no string is longer.
LARGE = (1 << 31) - 1
TABLE = 8
CELLS = 3 * TABLE
RETRIES = 12
BUCKET_ROWS, BASE, LEVELS = 2000, 64, 3

_CELL = "struct<n:int,k:bigint,x:bigint>"
_NONE = f"CAST(array() AS array<{_CELL}>)"
_EMPTY = "struct(0 AS n, 0L AS k, 0L AS x)"


def paragraphs(text: str) -> str:
    """SQL: the paragraphs of ``text``."""
    return rf"regexp_extract_all({text}, '[^\\n]{{1,{PIECE}}}\\S*+', 0)"


def digests(text: str) -> str:
    """SQL: the distinct paragraph digests of ``text``."""
    return f"array_distinct(transform({paragraphs(text)}, p -> xxhash64(p)))"


def _places(k: str, tier: str) -> str:
    """SQL: the hash of a digest in a tier; its bits place the digest."""
    return f"xxhash64({k}, {tier})"


def _at(h: str, table: int) -> str:
    return f"{table * TABLE} + CAST(shiftright({h}, {20 + 8 * table}) & {TABLE - 1} AS int)"


def _cells(placed: str) -> str:
    """SQL: the cells of one group, from structs of digest ``k``, its place
    hash ``h`` and its count ``s``."""
    table = lambda at: f"""transform(sequence(0, {TABLE - 1}), j -> aggregate(filter(own, e -> e.{at} = j), {_EMPTY},
        (cell, e) -> struct(cell.n + e.s AS n, cell.k ^ e.k AS k, cell.x ^ e.x AS x)))"""  # noqa: E731
    inside = [f"CAST(shiftright(e.h, {20 + 8 * t}) & {TABLE - 1} AS int)" for t in range(3)]
    own = f"transform({placed}, e -> struct(e.k AS k, e.s AS s, xxhash64(e.k) AS x, {inside[0]} AS a, {inside[1]} AS b, {inside[2]} AS c))"
    return f"transform(array({own}), own -> concat({table('a')}, {table('b')}, {table('c')}))[0]"


def sketch(keys: str) -> str:
    """SQL: the cells of the one-group sketch of ``keys``."""
    return _cells(f"transform({keys}, k -> struct(k AS k, 1 AS s, {_places('k', '0')} AS h))")


def minus(a: str, b: str) -> str:
    """SQL: cell-wise difference of two sketches."""
    return f"zip_with({a}, {b}, (p, q) -> struct(p.n - q.n AS n, p.k ^ q.k AS k, p.x ^ q.x AS x))"


def peel(cells: str, tier: str) -> str:
    """SQL: struct(left, right, whole): digests recovered of either side, and
    whether no cell is left.  A cell gives up a digest when its count is one
    and its check matches; a pass without such a cell ends the work."""
    freed = f"""transform(array({_places('f.k', tier)}), h -> transform(acc.cells, (c, j) ->
        CASE WHEN j = {_at('h', 0)} OR j = {_at('h', 1)} OR j = {_at('h', 2)}
             THEN struct(c.n - f.n AS n, c.k ^ f.k AS k, c.x ^ f.x AS x) ELSE c END))[0]"""
    step = f"""CASE WHEN acc.done THEN acc ELSE
        transform(array(filter(acc.cells, c -> abs(c.n) = 1 AND c.x = xxhash64(c.k))), pure ->
            CASE WHEN size(pure) = 0 THEN struct(acc.cells AS cells, acc.l AS l, acc.r AS r, true AS done)
                 ELSE transform(array(pure[0]), f -> struct({freed} AS cells, acc.l + int(f.n = 1) AS l, acc.r + int(f.n = -1) AS r, false AS done))[0] END)[0] END"""
    return f"""aggregate(sequence(1, {CELLS + 1}), struct({cells} AS cells, 0 AS l, 0 AS r, false AS done),
        (acc, i) -> {step},
        acc -> struct(acc.l AS l, acc.r AS r, forall(acc.cells, c -> c.n = 0 AND c.k = 0) AS whole))"""


def difference(keys_a: str, cells_a: str, keys_b: str, cells_b: str) -> str:
    """SQL: struct(l, r, whole): how many digests only either side has.  The
    fingerprints are tried first, then larger tiers, from the least that could
    hold all digests of both sides at half load.  A tier sorts the digests that
    are left by group, those of the second side with count -1, so that a group's
    cells are the difference of both sides' sketches."""
    signed = f"concat(transform({keys_a}, k -> struct(k AS k, 1 AS s)), transform({keys_b}, k -> struct(k AS k, -1 AS s)))"
    none = "CAST(array() AS array<struct<k:bigint,s:int>>)"
    dealt = f"""array_sort(transform(done.rest, e -> transform(array({_places('e.k', 't')}), h ->
        struct(pmod(h, shiftleft(1L, t)) AS g, e.k AS k, e.s AS s, h AS h))[0]))"""
    starts = "filter(transform(dealt, (e, i) -> CASE WHEN i = 0 OR e.g <> get(dealt, i - 1).g THEN i + 1 END), i -> i IS NOT NULL)"
    groups = f"""transform(array({dealt}), dealt -> transform(array({starts}), starts ->
        transform(starts, (i, j) -> slice(dealt, i, coalesce(get(starts, j + 1), size(dealt) + 1) - i)))[0])[0]"""
    peeled = f"transform({groups}, own_group -> struct(own_group AS d, {peel(_cells('own_group'), 't')} AS p))"
    tier = f"""transform(array({peeled}), groups -> aggregate(groups, struct(done.l AS l, done.r AS r),
            (a, g) -> CASE WHEN g.p.whole THEN struct(a.l + g.p.l AS l, a.r + g.p.r AS r) ELSE a END,
            a -> struct(a.l AS l, a.r AS r,
                flatten(transform(filter(groups, g -> NOT g.p.whole), g -> transform(g.d, e -> struct(e.k AS k, e.s AS s)))) AS rest)))[0]"""
    least = f"greatest(1, CAST(ceil(log2((size({keys_a}) + size({keys_b}) + 1) * 2D / {CELLS})) AS int))"
    return f"""aggregate(sequence({least}, {least} + {RETRIES}),
        transform(array({peel(minus(cells_a, cells_b), '0')}), p -> CASE WHEN p.whole THEN struct(p.l AS l, p.r AS r, {none} AS rest)
            ELSE struct(0 AS l, 0 AS r, {signed} AS rest) END)[0],
        (done, t) -> CASE WHEN size(done.rest) = 0 THEN done ELSE {tier} END,
        done -> struct(done.l AS l, done.r AS r, size(done.rest) = 0 AS whole))"""


def fingerprint_text(cells: str) -> str:
    """SQL: the sketch's filled cells as ``cell:count:digest:check`` in hexadecimal."""
    return f"""array_join(filter(transform({cells}, (c, j) -> CASE WHEN c.n <> 0 THEN concat_ws(':', hex(j), c.n, hex(c.k), hex(c.x)) END), s -> s IS NOT NULL), ',')"""


def likeness(size_a: str, size_b: str, diff: str) -> str:
    return f"CASE WHEN {size_a} + {size_b} = 0 THEN 1D ELSE ({size_a} + {size_b} - {diff}.l - {diff}.r) / CAST({size_a} + {size_b} AS double) END"


def _bucket(key: str, splits: list[int]) -> str:
    """SQL: how many split points are at or below ``key``, by a search of
    ``BASE`` branches per level."""
    if not splits:
        return "0"
    points = f"array({', '.join(f'{x}L' for x in splits)})"
    if len(splits) <= BASE:
        return f"size(filter({points}, s -> s <= {key}))"
    coarse = _bucket(key, splits[BASE - 1::BASE])
    return f"transform(array({coarse}), b -> b * {BASE} + size(filter(slice({points}, b * {BASE} + 1, {BASE}), s -> s <= {key})))[0]"


def with_next(rows: DataFrame) -> DataFrame:
    """(key, text, keys, ...) with ``next``: text and digests of the next row
    by (key, text), of the first for the last.

    Rows go into ranges of about ``BUCKET_ROWS`` keys; each range also gets a
    copy of the next range's first rows, so one shuffle of the texts is all."""
    n = rows.count()
    want = min(BASE ** LEVELS, max(1, n // BUCKET_ROWS))
    ids = rows.select("key")
    at = [i / want for i in range(1, want)]
    splits = sorted(set(ids.select(F.percentile_approx("key", at, max(10_000, 8 * want))).first()[0] or [])) if at else []
    dealt = rows.withColumn("bucket", F.expr(_bucket("key", splits)))
    # one key per range reaches the driver, BASE ** LEVELS at most
    firsts = sorted((r.bucket, r.first) for r in dealt.select("bucket", "key").groupBy("bucket").agg(F.min("key").alias("first")).collect())
    if not firsts:
        return rows.withColumn("next", F.struct("text", "keys"))
    first_of = {b: k for b, k in firsts}
    before = {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}
    size = len(splits) + 1
    first_sql = f"array({', '.join(f'{first_of[b]}L' if b in first_of and first_of[b] != -(1 << 63) else '-9223372036854775807L - 1L' if b in first_of else 'NULL' for b in range(size))})"
    before_sql = f"array({', '.join(str(before.get(b, 0)) for b in range(size))})"
    copied = dealt.withColumn("place", F.expr(f"""explode(CASE WHEN key = {first_sql}[bucket]
        THEN array(struct(bucket AS bucket, false AS copy), struct({before_sql}[bucket] AS bucket, true AS copy))
        ELSE array(struct(bucket AS bucket, false AS copy)) END)""")).drop("bucket").select("*", "place.bucket", "place.copy").drop("place")
    order = Window.partitionBy("bucket").orderBy("copy", "key", "text")
    return copied.withColumn("next", F.lead(F.struct("text", "keys")).over(order)).where("NOT copy").drop("bucket", "copy")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next, where the edited text has
    its last quarter replaced by the beginning of the next document."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col), F.expr("-9223372036854775807L - 1L")).cast("long").alias("key"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("keys", F.expr(digests("text"))))
    rows = rows.withColumn("n_chars", F.length("text"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, n_chars - n_chars div 4), left(next.text, CAST(n_chars div 4 AS int)))"))
    rows = rows.withColumn("edited_keys", F.expr(digests("edited"))).withColumn("next_keys", F.col("next.keys"))
    for name in ("", "edited_", "next_"):
        rows = rows.withColumn(f"{name}cells", F.expr(sketch(f"{name}keys")))
    rows = rows.withColumn("edited_diff", F.expr(difference("keys", "cells", "edited_keys", "edited_cells")))
    rows = rows.withColumn("next_diff", F.expr(difference("keys", "cells", "next_keys", "next_cells")))
    return rows.select(
        F.col("id").alias(id_col), F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.expr(fingerprint_text("cells")).alias("fingerprint"), F.expr(fingerprint_text("edited_cells")).alias("edited_fingerprint"),
        F.expr(likeness("size(keys)", "size(edited_keys)", "edited_diff")).alias("near_edited"),
        F.expr(likeness("size(keys)", "size(next_keys)", "next_diff")).alias("near_next"),
        F.col("edited_diff.whole").alias("edited_recovered"), F.col("next_diff.whole").alias("next_recovered"))
