"""Characters that the operators of this subpackage treat alike, as native columns."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space.
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else as it is; texts without other scripts take the quick way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def stripped(text: Column) -> Column:
    """``text`` without white space at both ends."""
    return F.trim(text, F.lit(BLANKS))
