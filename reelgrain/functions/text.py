"""Text normalisers shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelgrain.operators.rejects import SPACE

#: Written forms of "missing", compared after trimming and lower-casing.
MISSING_WORDS = ("", "null", "none", "nan", "na", "n/a")


def trimmed_lower(c: Column | str) -> Column:
    return F.lower(F.btrim(c, F.lit(SPACE)))


def present_lower(c: Column | str) -> Column:
    """Trimmed lower case, null where the text says that there is none."""
    x = trimmed_lower(c)
    return F.when(~x.isin(*MISSING_WORDS), x)


def digest_hex(c: Column | str) -> Column:
    """64 lower-case hex digits of a SHA-256 however written (case, blanks, a `sha256:` mark), else null."""
    x = F.regexp_replace(trimmed_lower(c), r"\A(?:sha-?256[:=]\s*|0x)", "")
    return F.when(x.rlike(r"\A[0-9a-f]{64}\z"), x)
