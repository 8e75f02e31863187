"""Operator 12, conversation structure repair by auctions for shortest paths.

A conversation of n rows is a lattice of nodes (row, state): the state is what
has been kept so far - nothing, the system turn, a user's or an assistant's
turn - and arcs are the edits of the next row, with integer costs: Keep 0,
Rerole 1, Delete 2, Insert 5 (which stays at its row), and 5 more for a
truncated row that is not deleted.  A repaired conversation is a shortest path
from (0, nothing) to an end after an assistant's turn, or after nothing.

The path is found by an auction: every node has a price, never above an arc's
cost plus the price at its end.  A path grows from the origin to the neighbour
that sets its last node's price (extension); where that price is too low it
rises and the node leaves the path (contraction).  When the path reaches the
goal, prices along it are exact distances, and the arcs whose cost equals the
price difference (tight arcs) hold all shortest paths; the repair follows the
least letter (D, I, K, R) among those that lead on to the goal.

Prices climb step by step, so a long lattice is auctioned in blocks of
``BLOCK`` rows from the end, each with the prices of the block after it as its
goals: work grows with the rows.  A block is known by its rows' classes and its
goals' prices, so equal blocks of all conversations of a worker are solved once.

Rows are dealt by conversation, sorted, and streamed.  A task holds one byte
per row of the conversation at hand (as many as its ``audit`` has letters) and
texts of up to ``HELD_BYTES``; the texts of longer conversations are streamed a
second time, beside the finished audit, into their hash.  A hash over a whole
conversation is serial by nature; everything before it (faults, repeats) is
dealt by row.

Defined cases: null texts, roles, turns and ids read as one space; null turns
stand first and do not count for gaps.  Rows of the same turn stand in the order
of role and text; equal rows beside each other.  A null conversation id is a
conversation.  Extra columns are ignored, whatever their names.  An empty table
gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errata.llm import textops as T
from errata.session import materialize

BLOCK = 16
HELD_BYTES = 4 << 20
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What a kept row of a role leads to, and the role that may stand next.
MOVES = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT_ROLE = {NOTHING: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
GOAL = -1

Arc = tuple[str, int, int]


def lattice(codes: str, last: bool) -> list[list[Arc]]:
    """Arcs (letter, cost, node) of nodes ``4 * row + state``.  A row's code is its
    role's initial (``x`` for others), a capital where truncated, ``-`` where it
    must go.  The last lattice of a conversation ends in ``GOAL``."""
    arcs: list[list[Arc]] = []
    for k, code in enumerate(codes):
        for state in range(4):
            here = [("D", DELETE, 4 * k + 4 + state)]
            after = MOVES[state, NEXT_ROLE[state]]
            if code != "-":
                extra = TRUNCATED if code.isupper() else 0
                kept = MOVES.get((state, code.lower()))
                if kept is not None:
                    here.append(("K", KEEP + extra, 4 * k + 4 + kept))
                here.append(("R", REROLE + extra, 4 * k + 4 + after))
            here.append(("I", INSERT, 4 * k + after))
            arcs.append(here)
    if last:
        for state in range(4):
            here = [("I", INSERT, 4 * len(codes) + MOVES[state, NEXT_ROLE[state]])]
            if state in (NOTHING, ASSISTANT):
                here.append(("", 0, GOAL))
            arcs.append(here)
    return arcs


def auction(arcs: list[list[Arc]], price: list[int], origin: int) -> None:
    """Raise prices until the path from ``origin`` reaches a goal (a node
    without arcs).  ``price`` may come from earlier auctions for the same goals."""
    path = [origin]
    while 0 <= path[-1] < len(arcs):
        node = path[-1]
        level, to = min((cost + price[j], j) for _, cost, j in arcs[node])
        if price[node] < level:
            price[node] = level
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)


@functools.lru_cache(maxsize=1 << 15)
def solve_block(codes: str, last: bool, goals: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Prices of a block's four first nodes, and for each the least letters of
    a shortest path through the block and the state in which it leaves."""
    arcs = lattice(codes, last)
    exits = [] if last else [4 * len(codes) + state for state in range(4)]
    price = [min(goals)] * len(arcs) + list(goals)  # GOAL is the last entry
    for origin in range(4):
        auction(arcs, price, origin)
    tight = [[(letter, j) for letter, cost, j in here if cost + price[j] == price[i]] for i, here in enumerate(arcs)]
    leads = set(exits) or {GOAL}
    for first in range(len(arcs) - 4, -1, -4):  # a row's nodes after those that they lead to
        for _ in range(3):  # up to two insertions in a row lead on to nodes of the same row
            leads |= {i for i in range(first, first + 4) if any(j in leads for _, j in tight[i])}
    traces = []
    for node in range(4):
        letters = []
        while 0 <= node < len(arcs):
            letter, node = min((letter, j) for letter, j in tight[node] if j in leads)
            letters.append(letter)
        traces.append(("".join(letters), node - 4 * len(codes) if node >= 0 else GOAL))
    return tuple(price[:4]), tuple(traces)


def repair_path(codes: str) -> tuple[int, str]:
    """Cost and letters of a conversation's cheapest repair."""
    cuts = range(0, len(codes), BLOCK)
    base, prices, solved = 0, (0,), []
    for lo in [len(codes), *reversed(cuts)]:
        last = lo == len(codes)
        low = min(prices)
        base += low
        prices, traces = solve_block("" if last else codes[lo:lo + BLOCK], last, tuple(p - low for p in prices))
        solved.append(traces)
    state, letters = NOTHING, []
    for traces in reversed(solved):
        piece, state = traces[state]
        letters.append(piece)
    return base + prices[NOTHING], "".join(letters)


class Repaired:
    """The repaired conversation's hash, from its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING
        self.hash, self.first = hashlib.sha256(), True

    def _put(self, role: str, text: str) -> None:
        self.hash.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False

    def _inserted(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            role = NEXT_ROLE[self.state]
            self._put("user" if role == "u" else "assistant", "")
            self.state, self.at = MOVES[self.state, role], self.at + 1

    def row(self, role: str, text: str) -> None:
        self._inserted()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "D":
            return
        if letter == "R":
            role = "user" if NEXT_ROLE[self.state] == "u" else "assistant"
        self._put(role, text)
        self.state = MOVES[self.state, role[0]]

    def digest(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


class Conversation:
    """Counts, row classes and, while they are few, texts of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.held, self.bytes = conv_id, bytearray(), [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.latest = self.before = None

    def add(self, turn, role, text, fault, repeated) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = (turn if self.low is None else self.low), turn
        if fault != "blank" and (repeated or self.latest == (turn, role, text)):
            fault = "duplicate"
        self.latest = (turn, role, text)
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        code = "-" if fault in ("blank", "duplicate") else initial if initial in ("s", "u", "a") else "x"
        self.codes += (code.upper() if fault == "truncated" else code).encode()
        if self.held is not None:
            self.held.append((role, text))
            self.bytes += len(role) + len(text)
            if self.bytes > HELD_BYTES:
                self.held = None

    def result(self) -> tuple:
        cost, audit = repair_path(self.codes.decode())
        sha = None
        if self.held is not None:
            out = Repaired(audit)
            for role, text in self.held:
                out.row(role, text)
            sha = out.digest()
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, sha


RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _result_batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=RESULT)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over whole conversations in order (conv_id, turn, role, text, fault, repeated, copies)."""
    now, id_type, out = None, None, []
    for b in batches:
        id_type = b.column(0).type
        for conv_id, turn, role, text, fault, repeated, copies in zip(*(c.to_pylist() for c in b.columns)):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    out.append(now.result())
                now = Conversation(conv_id)
            for _ in range(copies):
                now.add(turn, role, text, fault, repeated)
        if len(out) >= T.BATCH_ROWS:
            yield _result_batch(out, id_type)
            out = []
    if now is not None:
        out.append(now.result())
        yield _result_batch(out, id_type)


def _hash_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over (conv_id, audit, role, text, copies): an audit, then its rows."""
    now, conv, id_type, out = None, None, None, []
    for b in batches:
        id_type = b.column(0).type
        for conv_id, audit, role, text, copies in zip(*(c.to_pylist() for c in b.columns)):
            if audit is not None:
                if now is not None:
                    out.append((conv, now.digest()))
                now, conv = Repaired(audit), conv_id
            else:
                for _ in range(copies):
                    now.row(role, text)
    if now is not None:
        out.append((conv, now.digest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], id_type), pa.array([r[1] for r in out])],
                                         names=["conv_id", "repaired_sha256"])


def damage(conversations: DataFrame) -> DataFrame:
    """The damaged rows (conv_id, turn, role, text, copies): a draw by conversation
    and turn drops a row (no copies), empties its text, takes its sentence ends,
    repeats it, or makes it a user's."""
    said = lambda c: f"coalesce(CAST({c} AS string), ' ')"
    drawn = conversations.selectExpr("conv_id", "turn", f"{said('role')} AS role", f"{said('text')} AS text",
                                     f"crc32(CAST(concat({said('conv_id')}, ':', {said('turn')}) AS binary)) % 20 AS draw")
    return drawn.selectExpr(
        "conv_id", "turn", "CASE draw WHEN 4 THEN 'user' ELSE role END AS role",
        "CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text",
        "CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS copies")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, copies), in
    which ``copies`` says how often a row stands there (a conversation of rows
    without copies is empty): gaps, faults, cost, audit and the repaired hash."""
    edge = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
    faulty = T.bounded(rows).select("conv_id", "turn", "role", "text", "copies", F.expr(f"rtrim({edge}, text)").alias("said")).selectExpr(
        "conv_id", "turn", "role", "text", "copies",
        "CASE WHEN said = '' THEN 'blank' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault",
        "md5(CAST(concat(CAST(length(role) AS string), ':', role, text) AS binary)) AS digest")
    # the earliest turn of what a conversation says more than once
    said = faulty.where("copies > 0").groupBy("conv_id", "digest").agg(
        F.min("turn").alias("first"), F.bool_or(F.isnull("turn")).alias("unnumbered"), F.count("*").alias("n")).where("n > 1").select(
        F.col("conv_id").alias("of"), F.col("digest").alias("as"), "first", "unnumbered")
    flagged = faulty.join(said, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("as")), "left").select(
        "conv_id", "turn", "role", "text", "fault",
        F.expr("coalesce(CASE WHEN unnumbered THEN turn IS NOT NULL ELSE turn > first END, false)").alias("repeated"), "copies")
    flagged = materialize(flagged, "repair-rows")
    id_type = rows.schema["conv_id"].dataType.simpleString()
    kinds = f"conv_id {id_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    solved = materialize(flagged.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
                         .mapInArrow(_repair, kinds), "repair-solved")
    long = solved.where("repaired_sha256 IS NULL").select(F.col("conv_id").alias("of"), "audit")
    texts = flagged.where("copies > 0").join(long.select("of"), F.col("conv_id").eqNullSafe(F.col("of")), "left_semi")
    heads = long.selectExpr("of AS conv_id", "0 AS kind", "CAST(NULL AS bigint) AS turn", "CAST(NULL AS string) AS role",
                            "CAST(NULL AS string) AS text", "0 AS copies", "audit")
    stream = heads.unionByName(texts.selectExpr("conv_id", "1 AS kind", "turn", "role", "text", "copies", "CAST(NULL AS string) AS audit"))
    hashed = (stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
              .select("conv_id", "audit", "role", "text", "copies").mapInArrow(_hash_long, f"conv_id {id_type}, repaired_sha256 string"))
    late = hashed.select(F.col("conv_id").alias("of"), F.col("repaired_sha256").alias("late"))
    return solved.join(late, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        *RESULT[:-1], F.coalesce("repaired_sha256", "late").alias("repaired_sha256"))
