"""Texts whose bytes were decoded wrongly once: the repair of the commonest case."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: What UTF-8 read as Windows-1252 looks like: a lead byte's character before those of continuation bytes.
_MARK = re.compile("[Â-ô][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")


def repaired(text: str) -> str:
    """UTF-8 that was read as Windows-1252 or Latin-1, read rightly; other text as it is. Repeated up to three times."""
    for _ in range(3):
        if not _MARK.search(text):
            return text
        for encoding in ("cp1252", "latin-1"):
            try:
                text = text.encode(encoding).decode("utf-8")
                break
            except UnicodeError:
                continue
        else:
            return _MARK.sub(_piece, text)
    return text


def _piece(m: re.Match) -> str:
    for encoding in ("cp1252", "latin-1"):
        try:
            return m[0].encode(encoding).decode("utf-8")
        except UnicodeError:
            continue
    return m[0]


def fixed(c: Column) -> Column:
    """``repaired`` over a column, in Arrow batches."""

    @pandas_udf("string")
    def fix(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x != x else repaired(x))

    return fix(c)
