"""String expressions for prompt writing and answer parsing (Catalyst built-ins only)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---------------------------------------------------------------- fixed values
# These must equal the reference behaviour for answers to parse the same way.
# Answer line: optional "row" / "line" / "#", a 1-based index, one of ":).-", the body.
ROW_PATTERN = r"(?im)^\s*(?:row|line|#)?\s*(\d+)\s*[:).\-]\s*(.+?)\s*$"
# Optional confidence on an answer line, e.g. "p=0.82".
PROB_PATTERN = r"(?i)p\s*=\s*(0*\.\d+|1(?:\.0+)?|0|1)"
# Token estimate: characters per token.
CHARS_PER_TOKEN = 3.0
# Answer budget with reasoning off: a base plus one short line per test row.
OUTPUT_BASE = 128
OUTPUT_PER_ROW = 32
# Ordered reasoning-effort scale.
EFFORT_ORDER = ["none", "low", "medium", "high"]
# ---------------------------------------------------------------- end of fixed values

# Java regex: UNIX_LINES ("(?d)") makes '.', '^' and '$' treat only '\n' as a line end, as
# Python's ``re`` (and RE2) do; without it a lone '\r' or '\u2028' would also end a line.
JVM_ROW_PATTERN = "(?d)" + ROW_PATTERN


@F.pandas_udf(StringType())
def _g4(v: pd.Series) -> pd.Series:
    """``%.4g`` with C / Python rounding (on the exact binary value, ties to even).

    Java's formatter rounds the shortest decimal text half-up (``964.65`` → ``964.7``
    where Python prints ``964.6``), so this one conversion runs in an Arrow-batched
    pandas UDF; only non-integral finite values reach it.
    """
    return pd.Series([None if x is None or x != x else f"{x:.4g}" for x in v.tolist()], dtype=object)


def fmt_value(c: Column, is_float=True) -> Column:
    """NULL/NaN → ``?``; integral float → integer text; else ``%.4g`` as Python
    prints it (trailing zeros dropped). ``is_float="bool"``: ``True`` / ``False`` as Python
    prints booleans. Other non-floats: plain text."""
    if is_float == "bool":
        return F.when(c.isNull(), F.lit("?")).when(c, F.lit("True")).otherwise(F.lit("False"))
    if not is_float:
        return F.coalesce(c.cast("string"), F.lit("?"))
    integral = F.format_string("%.0f", c + F.lit(0.0))
    finite = ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return (F.when(c.isNull() | F.isnan(c), F.lit("?"))
            .when(finite & ((c % F.lit(1.0)) == 0), integral).otherwise(_g4(c.cast("double"))))


def row_to_text(cols: list[tuple[str, bool]]) -> Column:
    """``c=v, c=v`` over (column, is_float) pairs, in column order."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{name}="), fmt_value(F.col(name), fl))
                               for name, fl in cols])


def estimate_tokens(text: Column) -> Column:
    """int(chars / 3) + 1."""
    return (F.floor(F.length(text) / CHARS_PER_TOKEN) + 1).cast("int")


def confidence(body: Column) -> Column:
    """The ``p=`` confidence in [0, 1], else NULL."""
    raw = F.regexp_extract(body, PROB_PATTERN, 1)
    v = F.when(raw != "", raw).try_cast("double") if hasattr(Column, "try_cast") else \
        F.expr("try_cast(nullif(regexp_extract(body, '%s', 1), '') AS double)" % PROB_PATTERN)
    return F.when((v >= 0) & (v <= 1), v)
