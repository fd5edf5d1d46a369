"""Names of working columns that no column of the input has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def private(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that differs (whatever the case) from all columns of df and from each other."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name, i = f"__{stem}", 0
        while name.lower() in taken:
            name, i = f"__{stem}_{i}", i + 1
        taken.add(name.lower())
        out.append(name)
    return out
