"""Masks, tokens and likeness of messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom import fixed_values as fv
from logloom.functions.normalize import SPACES, strip


def mask(message: Column) -> Column:
    """Replace ids, addresses, numbers, URLs and paths by typed names, in order."""
    out = strip(message)
    for pattern, name in fv.MASKS:
        out = F.regexp_replace(out, pattern, name)
    return out


def tokenize(text: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.array_remove(F.split(strip(text), SPACES), "")


def signature(message: Column) -> Column:
    """Masked message with single blanks: equal for equal token lists.

    A word that looks like a wildcard is renamed, so that it is a plain word.
    """
    literal = F.regexp_replace(message, r"(?<=^|\s)<\*>(?=\s|$)", "<LIT>")
    plain = F.when(F.contains(message, F.lit(fv.WILDCARD)), literal).otherwise(message)
    return F.regexp_replace(mask(plain), SPACES, " ")


def n_tokens(sig: Column) -> Column:
    blanks = F.length(sig) - F.length(F.replace(sig, F.lit(" "), F.lit("")))
    return F.when(sig == "", 0).otherwise(blanks + 1)


def tokens_of(sig: Column) -> Column:
    return F.when(sig == "", F.array().cast("array<string>")).otherwise(F.split(sig, " "))


def similarity(a: Column, b: Column) -> Column:
    """Share of positions that agree or hold a wildcard; 0 for unlike lengths."""
    wild = F.lit(fv.WILDCARD)
    agree = F.zip_with(a, b, lambda x, y: ((x == y) | (x == wild) | (y == wild)).cast("int"))
    hits = F.aggregate(agree, F.lit(0), lambda acc, x: acc + x)
    return (
        F.when(F.size(a) != F.size(b), F.lit(0.0))
        .when(F.size(a) == 0, F.lit(1.0))
        .otherwise(hits / F.size(a))
    )


def overlay(tokens: Column, wild: Column) -> Column:
    """Token text with wildcards at the given positions."""
    put = lambda t, i: F.when(F.array_contains(wild, i), fv.WILDCARD).otherwise(t)
    return F.when(F.size(wild) == 0, F.array_join(tokens, " ")).otherwise(F.array_join(F.transform(tokens, put), " "))


def wild_positions(tokens: Column) -> Column:
    """Positions of the wildcards, from 0."""
    at = F.transform(tokens, lambda t, i: F.when(t == fv.WILDCARD, i))
    return F.array_compact(at)


def parameters(tokens: Column, template: Column) -> Column:
    """The tokens that stand where the template has a wildcard."""
    return F.filter(tokens, lambda t, i: F.get(template, i) == fv.WILDCARD)
