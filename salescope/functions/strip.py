"""White-space trimming with the set that the import rules take as blank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space at the ends of a text.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       "
               "         　")


def strip(c) -> Column:
    """The text without white space at either end."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE_SPACE))
