"""Label keys: one spelling for the many ways a label is written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label keys that mean "no label".
NO_LABEL = ("", "none", "unknown", "unlabeled", "nan")


def label_key(col: Column | str) -> Column:
    """Trimmed, lower case, each ``-`` and blank replaced by ``_``; null where there is no label."""
    col = F.col(col) if isinstance(col, str) else col
    key = F.regexp_replace(F.lower(F.trim(col.cast("string"))), "[-\\s]", "_")
    return F.when(key.isin(*NO_LABEL), F.lit(None)).otherwise(key)


def label_key_sql(col: str) -> str:
    """The same key as SQL text for an oracle."""
    key = f"regexp_replace(lower(trim({col})), '[-\\s]', '_', 'g')"
    return f"(CASE WHEN {key} IN ({', '.join(repr(x) for x in NO_LABEL)}) THEN NULL ELSE {key} END)"
