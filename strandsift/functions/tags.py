"""The part of a header that names a read in both mate files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def read_tag(header: Column) -> Column:
    """From after the first '.', or else after the leading mark, to before the next space.

    A header without a space there runs to its line end, whose line feed
    belongs to the tag: such a header never matches one with a comment.
    """
    dot = F.instr(header, ".")
    rest = F.when(dot > 0, header.substr(dot + 1, F.length(header))).otherwise(header.substr(F.lit(2), F.length(header)))
    return F.when(F.instr(rest, " ") > 0, F.substring_index(rest, " ", 1)).otherwise(F.concat(rest, F.lit("\n")))
