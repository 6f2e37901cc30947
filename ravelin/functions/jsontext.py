"""JSON text whose bytes can be signed: sorted keys, HTML-safe escapes, lower-case hex escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters written as unicode escapes.
ESCAPED = {
    "<": "\\u003c",
    ">": "\\u003e",
    "&": "\\u0026",
    "\u2028": "\\u2028",
    "\u2029": "\\u2029",
}


def canonical_json(column: Column) -> Column:
    """``to_json`` plus escapes. The struct's fields must already be in alphabetical order."""
    text = F.to_json(column, {"ignoreNullFields": "false"})
    for raw, escape in ESCAPED.items():
        text = F.replace(text, F.lit(raw), F.lit(escape))
    lowered = text
    for code in [*range(0x0B, 0x10), *range(0x1A, 0x20)]:
        upper = f"{code:04X}"
        lowered = F.regexp_replace(
            lowered, rf"(?<!\\)((?:\\\\)*)\\u{upper}", rf"$1\\u{upper.lower()}"
        )
    return F.when(text.rlike(r"\\u00[01][A-F]"), lowered).otherwise(text)
