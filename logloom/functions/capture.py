"""Helpers to run one costly expression once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control bytes; a text that holds one is escaped first.
_SEP, _ESC = "\x01", "\x02"


def capture(text: Column, pattern: str, groups: int) -> Column:
    """All groups of an anchored pattern from a single regex run.

    Gives ``['', g1, .., gn]`` on a match and one element otherwise; a group
    that took no part is ''. One ``regexp_extract`` per group would run the
    regex n times. Read the groups with :func:`group`.
    """
    template = "".join(f"{_SEP}${i}" for i in range(1, groups + 1))
    escaped = F.replace(F.replace(text, F.lit(_ESC), F.lit(_ESC + "b")), F.lit(_SEP), F.lit(_ESC + "a"))
    plain = F.when(F.contains(text, F.lit(_SEP)) | F.contains(text, F.lit(_ESC)), escaped).otherwise(text)
    return F.split(F.regexp_replace(plain, pattern, template), _SEP)


def group(groups: Column, i: int) -> Column:
    """Group ``i`` of a captured pattern."""
    g = F.get(groups, F.lit(i))
    restored = F.replace(F.replace(g, F.lit(_ESC + "a"), F.lit(_SEP)), F.lit(_ESC + "b"), F.lit(_ESC))
    return F.when(F.contains(g, F.lit(_ESC)), restored).otherwise(g)


def evaluate_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and columns cannot make Spark recompute.

    A plain projection may be copied into a filter above it, running its
    regexes twice. The output of a generator is not.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
