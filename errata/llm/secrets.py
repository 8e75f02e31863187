"""Operator 8, secret scan: rules plus sliding-window Shannon entropy.  Spark
functions only.

Rules: assign (a credential name, a colon or equals sign and a value of 6 or
more characters), access (AKIA keys) and hex (24 or more) are always reported.
Candidates are runs of 20 or more of ``A-Za-z0-9+/_-``, judged by parts: the
texts between placeholders, and within these every segment of 20 or more hex
digits of one case.  A part's character class is hex (0-9a-f and dashes), upper
hex (0-9A-F and dashes) or mixed; every window of ``WINDOW`` characters has its
entropy from counts that change by the one character that enters and the one
that leaves.  A candidate is reported as entropy if the highest window entropy
of a part reaches the limit of the part's class, unless the allow-list knows the
form of the candidate or the part, or a rule has reported an overlapping span.

Defined cases: null or empty text has no spans.  Repeated rows are scanned
each; other columns are kept in ``row`` and never clash with results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errata.llm.spans import count_kind, find_spans, masked, span_list

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']? *+[:=] *+["']?([A-Za-z0-9+/_.=-]++)"""
_VALUE = _ASSIGN.replace("\\", "\\\\").replace("'", "\\'")
#: kind -> (pattern, SQL that a match ``m`` must satisfy, cheap gate over ``text``), in report order.
BASE = {
    "assign": (_ASSIGN, f"length(regexp_extract(m, '{_VALUE}', 2)) >= 6", None),
    "access": (r"AKIA[A-Z0-9]{16,}+", "true", "contains(text, 'AKIA')"),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}+", "true", None),
}
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"

#: Entropy limits in bits for a window of WINDOW characters.
WINDOW = 20
LIMITS = {"hex": 3.0, "upper_hex": 3.0, "mixed": 3.7}
ALPHABETS = {"hex": "0123456789abcdef-", "upper_hex": "0123456789ABCDEF-",
             "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"}
CLASS_FORMS = {"hex": "^[0-9a-f-]+$", "upper_hex": "^[0-9A-F-]+$"}
HEX_SEGMENT = "(?<![A-Za-z0-9])(?:[0-9a-f]{20,}+|[0-9A-F]{20,}+)(?![A-Za-z0-9])"
# Forms that are no secrets although they look random.
ALLOWED = [
    "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "^[0-9A-F]{8}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{12}$",
    "^[A-Za-z/_+-]+$",
    "^[0-9/_+-]+$",
]
#: Windows that touch one of these are not judged; the rest of the run is.
PLACEHOLDER = "(?i)example|placeholder|x{4,}|0123456789|abcdefgh"


def _best_entropy(alphabet: str, m: str) -> str:
    """SQL: the highest entropy of a window of ``m``, in one pass.  ``count``
    has the window's count of every character and ``mass`` the sum of
    c * log2(c) over them; the entropy is log2(WINDOW) - mass / WINDOW."""
    weight = lambda c: f"CASE WHEN ({c}) > 1 THEN ({c}) * log2({c}) ELSE 0D END"
    grown = f"acc.mass - ({weight('acc.count[i.enter]')}) + ({weight('acc.count[i.enter] + 1')})"
    shrunk = f"acc.mass - ({weight('acc.count[i.leave]')}) + ({weight('acc.count[i.leave] - 1')})"
    return f"""aggregate(
        transform(sequence(1, length({m})), k -> struct(
            k AS k, instr('{alphabet}', substring({m}, k, 1)) - 1 AS enter,
            CASE WHEN k > {WINDOW} THEN instr('{alphabet}', substring({m}, k - {WINDOW}, 1)) - 1 END AS leave)),
        struct(array_repeat(0, {len(alphabet)}) AS count, 0D AS mass, 0D AS best),
        (before, i) -> aggregate(array(1), before,
            (a, _) -> aggregate(array(1),
                CASE WHEN i.leave IS NULL THEN a ELSE aggregate(array(1), a, (acc, _) -> struct(
                    transform(acc.count, (c, p) -> c - int(p = i.leave)) AS count, {shrunk} AS mass, acc.best AS best)) END,
                (acc, _) -> struct(transform(acc.count, (c, p) -> c + int(p = i.enter)) AS count, {grown} AS mass,
                    CASE WHEN i.k < {WINDOW} THEN acc.best
                         ELSE greatest(acc.best, log2({WINDOW}) - ({grown}) / {WINDOW}) END AS best))),
        acc -> acc.best)"""


def _found(docs: DataFrame, text: str) -> DataFrame:
    df = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    for kind, (pattern, valid, gate) in BASE.items():
        df = find_spans(df, "text", kind, pattern, valid, f"s_{kind}", gate)
    df = find_spans(df, "text", "entropy", CANDIDATE, "true", "candidates")
    order = ", ".join(f"'{k}'" for k in [*BASE, "entropy"])
    by_start = f"""(a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start
        ELSE int(array_position(array({order}), a.kind) - array_position(array({order}), b.kind)) END"""
    df = df.withColumn("base", F.expr(f"array_sort(concat({', '.join(f's_{k}' for k in BASE)}), {by_start})"))
    allowed = lambda m: " OR ".join(f"regexp_like({m}, '{p}')" for p in ALLOWED)
    df = df.withColumn("open", F.expr(f"filter(candidates, s -> NOT ({allowed('s.match')}) AND NOT exists(base, b -> b.start < s.stop AND s.start < b.stop))"))
    forms = [(c, f"regexp_like(m, '{form}')") for c, form in CLASS_FORMS.items()] + [("mixed", "true")]
    scores = " ".join(f"WHEN {when} THEN {_best_entropy(ALPHABETS[c], 'm')} / {LIMITS[c]}D" for c, when in forms)
    parts = f"flatten(transform(split(s.match, '{PLACEHOLDER}', -1), p -> concat(array(p), regexp_extract_all(p, '{HEX_SEGMENT}', 0))))"
    judged = f"exists({parts}, m -> CASE WHEN length(m) < {WINDOW} OR {allowed('m')} THEN false ELSE CASE {scores} END >= 1 END)"
    df = df.withColumn("high", F.expr(f"CASE WHEN size(open) > 0 THEN filter(open, s -> {judged}) ELSE open END"))
    return df.withColumn("spans", F.expr(f"array_sort(concat(base, high), {by_start})"))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), ``base`` spans of the rules and all
    ``spans``, each by start, then kind."""
    return _found(docs, text).select("row", "base", "spans")


def mask_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by its kind in brackets."""
    found = _found(docs, text).withColumn(
        "clean", F.when(F.col(f"row.{text}").isNotNull(), F.when(F.size("spans") > 0, masked("text", "spans")).otherwise(F.col("text"))))
    return found.select(*[(F.col("clean") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts, hash and text of the spans that ``find_secrets`` found."""
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
