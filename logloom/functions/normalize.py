"""Scalar normalisers: Column -> Column, built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom import fixed_values as fv

# White space at either end of a line, ASCII and Unicode.
_SPACE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)
# The same as a regex: Java's \\s is ASCII only.
SPACES = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

_ZONE = r"(?:[Zz]|[+-]\d{2}:?\d{2})"
_ISO = rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}(?:[T\s]\d{{1,2}}:\d{{1,2}}:\d{{1,2}}(?:[.,]\d{{1,9}})?{_ZONE}?)?$"
_MINUTES = rf"^(\d{{4}}-\d{{1,2}}-\d{{1,2}}[T\s]\d{{1,2}}:\d{{1,2}})({_ZONE}?)$"
_COMPACT = rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})((?:[.,]\d{{1,9}})?{_ZONE}?)$"
_CLF = r"^\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}$"
_SYSLOG = r"^[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}$"
_MONTHS = {name: f"{i:02d}" for i, name in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}


def strip(c: Column) -> Column:
    """Drop white space at both ends (not only blanks, as ``trim`` does)."""
    return F.btrim(c, F.lit(_SPACE))


def text_or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _lookup(c: Column, values: dict[str, str]) -> Column:
    """Constant map lookup; ``c`` is computed once, unlike in a chain of tests."""
    pairs = ", ".join(f"'{text}'" for kv in values.items() for text in kv)
    return F.try_element_at(F.expr(f"map({pairs})"), c)


def normalize_level(c: Column, numeric: bool = False) -> Column:
    """Map level spellings to ERROR, WARN, INFO, DEBUG or TRACE; unknown is INFO.

    ``numeric=True`` also reads the numeric levels 10..60 of JSON loggers.
    """
    levels = {word: level for level, words in fv.LEVEL_WORDS.items() for word in words}
    if numeric:
        levels |= fv.NUMERIC_LEVELS
    return F.coalesce(_lookup(F.upper(strip(c)), levels), F.lit("INFO"))


def is_level_word(c: Column) -> Column:
    words = [w for group in fv.LEVEL_WORDS.values() for w in group]
    return F.upper(strip(c)).isin(words)


def is_error(c: Column) -> Column:
    return c.isin(fv.ERROR_LEVELS)


def level_from_status(c: Column) -> Column:
    return F.when(c >= 500, "ERROR").when(c >= 400, "WARN").otherwise("INFO")


def facility_of(pri: Column) -> Column:
    return F.floor(pri / 8).cast("bigint")


def level_from_severity(pri: Column) -> Column:
    """Level of a syslog priority (severity is ``pri % 8``)."""
    levels = F.array(*[F.lit(name) for name in fv.SEVERITY_LEVELS])
    return F.element_at(levels, (F.pmod(pri, F.lit(8)) + 1).cast("int"))


def level_from_keywords(c: Column) -> Column:
    low = F.lower(c)
    return (
        F.when(low.rlike("|".join(fv.ERROR_KEYWORDS)), "ERROR")
        .when(low.rlike("|".join(fv.WARN_KEYWORDS)), "WARN")
        .otherwise("INFO")
    )


def short_logger(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def _iso_timestamp(s: Column) -> Column:
    t = F.translate(s, ", tz\t", ".TTZT")
    sign = F.substring(t, -6, 1).isin("+", "-") | F.substring(t, -5, 1).isin("+", "-")
    zone = F.when(F.instr(t, ":") == 0, "T00:00:00Z").when(F.endswith(t, F.lit("Z")) | sign, "").otherwise("Z")
    return F.concat(t, zone).try_cast("timestamp")


def _month(name: Column) -> Column:
    return _lookup(F.lower(name), _MONTHS)


def _clf_timestamp(s: Column) -> Column:
    """dd/MMM/yyyy:HH:mm:ss +zzzz"""
    sub = lambda at, n: F.substring(s, at, n)
    dash = F.lit("-")
    iso = F.concat(sub(8, 4), dash, _month(sub(4, 3)), dash, sub(1, 2), F.lit("T"), sub(13, 8), sub(22, 5))
    return iso.try_cast("timestamp")


def _syslog_timestamp(s: Column, year: Column | int | None) -> Column:
    """MMM d HH:mm:ss"""
    y = F.year(F.current_date()) if year is None else F.lit(year)
    day = strip(F.substring(s, F.lit(4), F.length(s) - 11))
    dash = F.lit("-")
    month, time = _month(F.substring(s, 1, 3)), F.substring(s, -8, 8)
    return F.concat(y.cast("string"), dash, month, dash, day, F.lit("T"), time, F.lit("Z")).try_cast("timestamp")


def parse_syslog_timestamp(c: Column, year: Column | int | None = None) -> Column:
    """Timestamp of a year-less syslog date; ``year`` defaults to the current one."""
    s = strip(c)
    return F.when(s.rlike(_SYSLOG), _syslog_timestamp(s, year))


def time_text(c: Column) -> Column:
    """A time text without brackets and white space around; null when empty."""
    return text_or_null(F.btrim(c, F.lit(_SPACE + "[]()")))


def read_time(s: Column, year: Column | int | None = None) -> Column:
    """Timestamp of a text from :func:`time_text`, or null."""
    # The commonest form needs no regex: yyyy-MM-ddT..Z.
    dashes = (F.substring(s, 5, 1) == "-") & (F.substring(s, 8, 1) == "-") & (F.substring(s, 11, 1) == "T")
    common = F.when(dashes & F.endswith(s, F.lit("Z")) & (F.instr(s, ":") == 14), s.try_cast("timestamp"))
    return F.coalesce(
        common,
        F.when(s.rlike(_ISO), _iso_timestamp(s))
        .when(s.rlike(_CLF), _clf_timestamp(s))
        .when(s.rlike(_SYSLOG), _syslog_timestamp(s, year))
        .when(s.rlike(_MINUTES), _iso_timestamp(F.regexp_replace(s, _MINUTES, "$1:00$2")))
        .when(s.rlike(_COMPACT), _iso_timestamp(F.regexp_replace(s, _COMPACT, "$1-$2-$3T$4:$5:$6$7"))),
    )


def parse_timestamp(c: Column, year: Column | int | None = None) -> Column:
    """Read a time text into ``struct<ts, epoch, ts_raw>``.

    Takes ISO forms, access-log and syslog dates, with or without brackets
    around. A text without zone is UTC. ``ts_raw`` keeps a text that is no
    time; then ``ts`` and ``epoch`` are null.
    """
    s = time_text(c)
    ts = read_time(s, year)
    return F.struct(ts.alias("ts"), epoch_of(ts).alias("epoch"), F.when(ts.isNull(), s).alias("ts_raw"))


def epoch_of(ts: Column) -> Column:
    """Seconds since 1970 as double, to the microsecond."""
    return F.unix_micros(ts) / F.lit(1e6)


def timestamp_text(ts: Column, ts_raw: Column) -> Column:
    """ISO text of a row's time, or the raw text when it could not be read."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    fraction = F.when(F.unix_micros(ts) % 1_000_000 == 0, "").otherwise(F.date_format(utc, ".SSSSSS"))
    return F.coalesce(F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00")), ts_raw)


def first_present(m: Column, keys: list[str]) -> Column:
    """Value of the first key that has one."""
    return F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in keys])


def residual_metadata(m: Column, reserved: list[str]) -> Column:
    """The entries whose key is in no alias list."""
    return F.map_filter(m, lambda k, _: ~k.isin(reserved))


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)
