"""Column expressions for names and text (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java regex of leading/trailing whitespace (Spark's trim strips spaces only).
_EDGE_WS = r"^\s+|\s+$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), _EDGE_WS, "")


def norm(x: Column | str) -> Column:
    """Identifier normalisation: lower case; space and ``-`` become ``_``;
    back-ticks and double quotes vanish; then surrounding whitespace (tabs,
    newlines) is stripped; NULL becomes ''."""
    s = F.translate(F.lower(F.coalesce(_c(x).cast("string"), F.lit(""))), ' -`"', "__")
    return strip_ws(s)


def norm_no_quotes(x: Column | str) -> Column:
    """Variant that keeps quotes (used on catalog snapshots)."""
    s = F.translate(F.lower(F.coalesce(_c(x).cast("string"), F.lit(""))), " -", "__")
    return strip_ws(s)


def stable_column_id(table: Column | str, column: Column | str) -> Column:
    """``table.column`` id.  Table: lower case, spaces -> ``_``.  Column: lower
    case; space and ``/`` -> ``_``; a hyphen between two digits or two letters
    -> ``_`` (the regex consumes both neighbours, so ``a-b-c`` gives ``a_bc``);
    other hyphens dropped; ``()#%`` dropped; runs of ``_`` collapsed; ``_``
    stripped from both ends."""
    c = F.translate(F.lower(_c(column)), " /", "__")
    c = F.regexp_replace(c, r"(\d)-(\d)", "$1_$2")
    c = F.regexp_replace(c, r"([a-z])-([a-z])", "$1_$2")
    c = F.regexp_replace(c, r"[-()#%]", "")
    c = F.regexp_replace(F.regexp_replace(c, "_+", "_"), r"^_+|_+$", "")
    t = F.translate(F.lower(_c(table)), " ", "_")
    return F.concat(t, F.lit("."), c)


def base_type(t: Column | str) -> Column:
    """Text before the first ``(`` of a type name."""
    return F.substring_index(_c(t), "(", 1)


def title_key(x: Column | str) -> Column:
    """``snake_key`` -> ``Snake Key`` (guideline keys in prompts)."""
    return F.initcap(F.regexp_replace(_c(x), "_", " "))
