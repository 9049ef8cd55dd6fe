"""Size-checked broadcast for owner-keyed join sides.

Per-owner aggregates (gates, maxima, totals, removed-user markers) are joined back to
large tables keyed by ``user_id``, where one owner may hold a third of all rows. A
shuffle join would send that owner's rows to one reducer, so the small side is
broadcast instead, but only behind a measured size check:

1. the side is materialised once (a reliable checkpoint in the shared folder), so its
   size is known and later branches read it instead of recomputing it;
2. its rows and bytes are counted (one partial aggregate);
3. within the bound it is broadcast (the large side is never shuffled); beyond it, it
   is returned as is and Spark plans a shuffle join, where AQE's skew-join rule splits
   the hot owner's partitions.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.session import materialize

# Rows and bytes of a keyed side that may be broadcast.
BROADCAST_MAX_ROWS = int(os.environ.get("TALLYFRAME_BROADCAST_MAX_ROWS", "2000000"))
BROADCAST_MAX_BYTES = int(os.environ.get("TALLYFRAME_BROADCAST_MAX_BYTES", str(128 << 20)))


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``df`` materialised, with a broadcast hint when it has at most ``max_rows`` rows."""
    return measured(df, max_rows)[0]


def _width(df: DataFrame) -> Column:
    """Bytes of a row: texts and nested values by their length, all others by 16."""
    parts = [F.lit(16) if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, (T.StringType, T.BinaryType))
             else F.octet_length(F.col(f"`{f.name}`") if isinstance(f.dataType, (T.StringType, T.BinaryType))
                                 else F.to_json(F.struct(F.col(f"`{f.name}`")))) for f in df.schema.fields]
    return reduce(Column.__add__, [F.coalesce(p, F.lit(0)) for p in parts], F.lit(0)).cast("bigint")


def measured(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> tuple[DataFrame, bool]:
    """Like ``checked_broadcast``, also telling whether the bound held. A side derived
    from a bounded one by aggregation or filtering is bounded too and can be broadcast
    without being measured again."""
    m = materialize(df)
    rows, held = m.agg(F.count("*"), F.coalesce(F.sum(_width(m)), F.lit(0))).first()
    if rows <= max_rows and held <= BROADCAST_MAX_BYTES:
        return F.broadcast(m), True
    return m, False
