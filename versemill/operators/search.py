"""Full-text search by prefixes over several columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _begins(tokens: Column, prefix: str) -> Column:
    return F.exists(tokens, lambda t: t.startswith(prefix))


def prefix_search(units: DataFrame, query: str, columns: list[str], order: list[str], limit: int = 50) -> DataFrame:
    """The first `limit` units, in text order, in which every query word begins some token of any column (FTS1, FN-S13, SO2).

    Words of the query lose all but letters and digits; a query without any gives no rows. Tokens are runs of letters and
    digits, ASCII letters folded. Null columns have no tokens. The predicate stays in the scan's stage, then a top-k.
    """
    wanted = [p.lower() for p in (re.sub(r"[\W_]", "", w) for w in query.split()) if p]
    if not wanted:
        return units.limit(0)
    text = F.lower(F.concat_ws(" ", *columns))
    tokens = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}\p{Nd}]+"), F.lit(0))
    hit = F.lit(True)
    for prefix in wanted:
        hit = hit & _begins(tokens, prefix)
    return units.where(hit).orderBy(*order).limit(limit)
