"""The threat profile kept from day to day.

The state of an address is bounded and merges, so a new day is read once and
put to what is stored; the days before it are not read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import security
from .arrival import CHUNK_ROWS
from .workspace import stored


def advance_profile(spark: SparkSession, before: str | None, df: DataFrame, target: str, seq: str = "seq",
                    scan_user_agent: bool = True, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Writes the state after ``df`` to the new folder ``target`` and returns it; ``before`` is the folder of the state
    of all records that arrived earlier, None for the first ones.

    ``df`` must come after them in order of ``seq``.  A run that failed is repeated from the same ``before``.
    ``security.profile_of`` of the state is ``security.ip_profile`` of all records.
    """
    known = None if before is None else spark.read.parquet(before)
    part = security.profile_state(df, seq, scan_user_agent, chunk_rows, known)
    if known is not None:
        part = security.merge_states(known, stored(part, "profile-part"))
    part.write.parquet(target)
    return spark.read.parquet(target)
