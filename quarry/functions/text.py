"""Column expressions on packed and delimited text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A private-use character that frames placeholders; occurrences in data are escaped before it is used.
FRAME = ""
_BLANK = r"[\s  -​ 　﻿]"
#: A quoted span counts only where a value may begin and end; a doubled quote inside it is one quote.
QUOTED = r"""(?s)(?<=^|[\s,;|\[{(])(?:"(?:[^"]|"")*"|'(?:[^']|'')*')(?=$|[\s,;|\]})])"""
DELIMITERS = rf"(?:{_BLANK}|[,;|])+"
_EDGE = r"""[\s\[\]{}()"']"""


def trim_all(c: Column) -> Column:
    """c without white space of any kind at its ends (trim() takes blanks only)."""
    return F.regexp_replace(c, rf"^{_BLANK}+|{_BLANK}+$", "")


def packed_values(c: Column) -> Column:
    """The values packed in c, in order, as array<string>; never null.

    Quoted spans become indexed placeholders framed by FRAME (FRAME in the data is escaped first, so no
    value can look like one), what is left is split at blanks, commas, semicolons and bars, and the
    placeholders are then looked up in the array of spans. A quoted value keeps its inside, a doubled quote
    as one; it and unquoted values lose surrounding blanks, quotes and brackets. Empty values are dropped.
    A quote that is never closed is an ordinary character at the edge of an unquoted value.
    """
    text = F.coalesce(c, F.lit(""))
    safe = F.replace(text, F.lit(FRAME), F.lit(FRAME + "x"))
    spans = F.regexp_extract_all(safe, F.lit(QUOTED), F.lit(0))
    pieces = F.split(safe, QUOTED, -1)
    masked = F.array_join(
        F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(FRAME), (i - 1).cast("string"), F.lit(FRAME), p))), ""
    )
    index = rf"^{_EDGE}*{FRAME}(\d+){FRAME}{_EDGE}*$"

    def restore(token: Column) -> Column:
        span = F.element_at(spans, F.regexp_extract(token, index, 1).cast("int") + 1)
        quote = F.substring(span, 1, 1)
        inside = F.replace(span.substr(F.lit(2), F.length(span) - 2), F.concat(quote, quote), quote)
        bare = F.regexp_replace(token, rf"^{_EDGE}+|{_EDGE}+$", "")
        return F.replace(F.when(token.rlike(index), trim_all(inside)).otherwise(bare), F.lit(FRAME + "x"), F.lit(FRAME))

    return F.filter(F.transform(F.split(masked, DELIMITERS, -1), restore), lambda v: v != "")
