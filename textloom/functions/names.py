"""Names of helper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no column of the frames has it in any case: so a caller's own columns stay."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
