"""Operator 4, personal data: regular expressions propose, checksums confirm,
context words adjust the score.  Spark functions only.

Kinds: email, ip, card (Luhn) and phone are always reported.  iban (mod 97)
and national_id (three, two and four digits) are reported when their score
reaches ``min_score``.  A span's score is its kind's prior, plus ``BOOST`` when
a supporting word of the kind stands within ``WINDOW`` characters, less
``BOOST`` when a weakening word does, within 0 to 1.

Patterns end in possessive repeats and start where a run of their characters
starts, so a text of any shape is searched in linear time without recursion.

Defined cases: null or empty text has no spans (an empty list, and the SHA-256
of the empty string).  Repeated rows are searched each; other columns, also
ones with the same names as results, are not touched: results are computed on
the id and the text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errata.llm.spans import count_kind, find_spans, masked, span_list

_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s +
    CASE WHEN i % 2 = 1 THEN int(substring(reverse({_DIGITS}), i, 1))
         WHEN int(substring(reverse({_DIGITS}), i, 1)) > 4 THEN 2 * int(substring(reverse({_DIGITS}), i, 1)) - 9
         ELSE 2 * int(substring(reverse({_DIGITS}), i, 1)) END) % 10 = 0"""
_PLAIN = "replace(m, ' ', '')"
# letters count from A = 10; the first four characters move to the end
_MOD97 = f"""aggregate(split(concat(substring({_PLAIN}, 5), left({_PLAIN}, 4)), ''), 0, (r, c) ->
    CASE WHEN c = '' THEN r WHEN c BETWEEN '0' AND '9' THEN (r * 10 + int(c)) % 97
         ELSE (r * 100 + ascii(c) - 55) % 97 END) = 1"""

#: kind -> (pattern, SQL that a match ``m`` must satisfy, cheap gate over ``text``), in report order.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", "contains(text, '@')"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
           "forall(split(m, '[.]'), x -> length(ltrim('0', x)) <= 3 AND coalesce(try_cast(ltrim('0', x) AS int), 0) <= 255)", None),
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,}+", f"length({_DIGITS}) <= 19 AND {_LUHN}", None),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15", "contains(text, '+')"),
}
ADDED = {
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
             f"length({_PLAIN}) BETWEEN 15 AND 34 AND {_MOD97}", None),
    "national_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "left(m, 3) NOT IN ('000', '666') AND left(m, 1) <> '9'", None),
}
# Prior scores and context words, by kind.
PRIORS = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "national_id": 0.35}
SUPPORT = {
    "email": ["mail", "contact", "write"], "ip": ["address", "host", "server", "login"],
    "card": ["card", "credit", "visa", "payment", "debit"], "phone": ["phone", "call", "tel", "mobile", "fax"],
    "iban": ["iban", "bank", "account", "transfer"], "national_id": ["ssn", "social", "security", "tax", "identity"],
}
WEAKEN = {
    "email": ["noreply"], "ip": ["version", "release"], "card": ["order", "serial", "tracking"], "phone": ["serial", "version"],
    "iban": ["checksum", "serial"], "national_id": ["order", "part", "version"],
}
BOOST, WINDOW = 0.3, 40


def _score() -> str:
    near = f"lower(substring(text, greatest(s.start - {WINDOW}, 0) + 1, s.stop - s.start + {WINDOW} + least(s.start, {WINDOW})))"
    def has(words: dict) -> str:
        arms = " ".join(f"WHEN s.kind = '{k}' THEN regexp_like({near}, '\\\\b({'|'.join(v)})\\\\b')" for k, v in words.items())
        return f"CASE {arms} END"
    prior = "CASE s.kind " + " ".join(f"WHEN '{k}' THEN {v}D" for k, v in PRIORS.items()) + " END"
    return f"least(1D, greatest(0D, {prior} + CASE WHEN {has(SUPPORT)} THEN {BOOST}D ELSE 0D END - CASE WHEN {has(WEAKEN)} THEN {BOOST}D ELSE 0D END))"


def _found(df: DataFrame, text: str, min_score: float) -> DataFrame:
    """``df`` packed as ``row``, with ``text``, ``base`` and ``scored`` spans."""
    df = df.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # every kind but the e-mail address holds a digit
    for kind, (pattern, valid, gate) in (BASE | ADDED).items():
        df = find_spans(df, "text", kind, pattern, valid, f"s_{kind}", gate or "regexp_like(text, '[0-9]')")
    df = df.withColumn("base", F.concat(*[F.col(f"s_{k}") for k in BASE]))
    df = df.withColumn("every", F.concat("base", *[F.col(f"s_{k}") for k in ADDED]))
    df = df.withColumn("scored", F.expr(f"transform(every, s -> struct(s.kind AS kind, s.start AS start, s.stop AS stop, s.match AS match, {_score()} AS score))"))
    kinds = ", ".join(f"'{k}'" for k in BASE)
    return df.withColumn("scored", F.expr(f"filter(scored, s -> s.kind IN ({kinds}) OR s.score >= {min_score}D)"))


def find_pii(docs: DataFrame, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """``row`` (all columns of ``docs``), ``base`` spans (email, ip, card and
    phone, by kind and start) and ``scored``: all spans with their scores."""
    return _found(docs, text, min_score).select("row", "base", "scored")


def redact_pii(docs: DataFrame, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; a
    null text stays null."""
    found = _found(docs, text, min_score).withColumn(
        "clean", F.when(F.col(f"row.{text}").isNotNull(), F.when(F.size("scored") > 0, masked("text", "scored")).otherwise(F.col("text"))))
    return found.select(*[(F.col("clean") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts, hash and text of the spans that ``find_pii`` found."""
    return found.select(
        F.col("row.doc_id").alias("doc_id"), *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("scored")).alias("spans"))
