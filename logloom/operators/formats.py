"""The log formats.

Each format says how to take a line apart (``extract``, one costly expression
evaluated once), which results count (``accept``), and how to fill the log
columns from the parts. All are column expressions, so one scan of the lines
can hold every format side by side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom import fixed_values as fv
from logloom.functions import normalize as nz
from logloom.functions.capture import capture, group

_FIELDS = "array<string>"
_PAIRS = "map<string,string>"
_OBJECTS = f"array<{_PAIRS}>"


def _parts(fields: Column | None = None, objects: Column | None = None) -> Column:
    return F.struct(
        (F.lit(None).cast(_FIELDS) if fields is None else fields).alias("f"),
        (F.lit(None).cast(_OBJECTS) if objects is None else objects).alias("m"),
    )


def _metadata(**values: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


@dataclass(frozen=True)
class Format:
    """Columns of one format.

    ``fill`` works on the line, its parts, and for formats of key-value
    pairs the map of all pairs and the map of those that hold a value. It
    gives a ``level``, or as ``stated`` the level word of the line.
    """

    name: str
    extract: Callable[[Column], Column]
    accept: Callable[[Column], Column]
    detect: Callable[[Column], Column]
    fill: Callable[[Column, Column, Column, Column], dict[str, Column]]
    keys: Callable[[Column], Column] | None = None
    values: Callable[[Column], Column] | None = None
    # The map when no key occurs twice.
    plain: Callable[[Column, Column, Column], Column] = lambda p, k, v: F.map_from_arrays(k, v)
    usable: Callable[[Column, Column], Column] = lambda line, m: m


def last_wins(keys: Column, values: Column) -> Column:
    """Map of the pairs; the last of equal keys stays."""
    later = lambda i: F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0)))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    return F.map_from_entries(F.filter(pairs, lambda e, i: ~F.array_contains(later(i), e["k"])))


def has_twins(keys: Column) -> Column:
    return F.size(F.array_distinct(keys)) < F.size(keys)


def _matched(groups: int) -> Callable[[Column], Column]:
    return lambda p: F.size(p["f"]) == groups + 1


def _field(p: Column, i: int) -> Column:
    return nz.text_or_null(group(p["f"], i))


# --- JSON ---------------------------------------------------------------------

_FALSY_TEXTS = ["0", "-0", "0.0", "-0.0", "false", "[]", "{}"]
_JSON_RESERVED = fv.JSON_TIME_KEYS + fv.JSON_LEVEL_KEYS + fv.JSON_MESSAGE_KEYS + fv.JSON_SERVICE_KEYS


def _json_objects(line: Column) -> Column:
    # Inside an array with a sentinel, so that text after the object is refused.
    wrapped = F.concat(F.lit("["), line, F.lit(",{}]"))
    parsed = F.from_json(wrapped, _OBJECTS, {"allowSingleQuotes": "false"})
    return F.when(F.startswith(line, F.lit("{")), parsed)


def _is_object(p: Column) -> Column:
    return F.coalesce(F.size(p["m"]) == 2, F.lit(False))


def _json_truthy(line: Column, m: Column) -> Column:
    """The map without empty texts and values such as 0, false or [].

    The JSON type only matters, and is only read, where such a text occurs.
    """
    typed = F.from_json(line, "map<string,variant>")
    doubtful = F.arrays_overlap(F.map_values(m), F.array(*[F.lit(t) for t in ["", *_FALSY_TEXTS]]))
    is_text = lambda k: F.schema_of_variant(F.try_element_at(typed, k)) == "STRING"
    checked = F.map_filter(m, lambda k, v: (v != "") & (~v.isin(_FALSY_TEXTS) | is_text(k)))
    return F.when(doubtful, checked).otherwise(m)


def _json_fill(line: Column, p: Column, m: Column, truthy: Column) -> dict[str, Column]:
    failed = F.arrays_overlap(F.map_keys(m), F.array(*[F.lit(k) for k in fv.JSON_ERROR_KEYS]))
    message = nz.first_present(m, fv.JSON_MESSAGE_KEYS)
    return {
        "time": nz.first_present(truthy, fv.JSON_TIME_KEYS),
        "level": F.when(failed, "ERROR"),
        "stated": nz.first_present(truthy, fv.JSON_LEVEL_KEYS),
        "service": nz.first_present(truthy, fv.JSON_SERVICE_KEYS),
        "message": F.coalesce(nz.text_or_null(message), line),
        "metadata": nz.residual_metadata(m, _JSON_RESERVED),
    }


JSON = Format(
    "json",
    extract=lambda line: _parts(objects=_json_objects(line)),
    accept=_is_object,
    detect=_is_object,
    fill=_json_fill,
    keys=lambda p: F.map_keys(F.get(p["m"], F.lit(0))),
    values=lambda p: F.map_values(F.get(p["m"], F.lit(0))),
    plain=lambda p, k, v: F.get(p["m"], F.lit(0)),
    usable=_json_truthy,
)

# --- logfmt -------------------------------------------------------------------

_LOGFMT_RESERVED = fv.LOGFMT_TIME_KEYS + fv.LOGFMT_LEVEL_KEYS + fv.LOGFMT_MESSAGE_KEYS + fv.LOGFMT_SERVICE_KEYS


def _unquoted(v: Column) -> Column:
    quoted = (F.length(v) >= 2) & F.startswith(v, F.lit('"')) & F.endswith(v, F.lit('"'))
    return F.when(quoted, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)


def _logfmt_keys(p: Column) -> Column:
    return F.transform(p["f"], lambda x: F.lower(F.substring_index(x, "=", 1)))


def _logfmt_values(p: Column) -> Column:
    return F.transform(p["f"], lambda x: _unquoted(F.substring(x, F.instr(x, "=") + 1, F.length(x))))


def _logfmt_fill(line: Column, p: Column, m: Column, u: Column) -> dict[str, Column]:
    message = nz.first_present(m, fv.LOGFMT_MESSAGE_KEYS)
    return {
        "time": nz.first_present(m, fv.LOGFMT_TIME_KEYS),
        "stated": nz.first_present(m, fv.LOGFMT_LEVEL_KEYS),
        "service": nz.first_present(m, fv.LOGFMT_SERVICE_KEYS),
        "message": F.coalesce(nz.text_or_null(message), line),
        "metadata": nz.residual_metadata(m, _LOGFMT_RESERVED),
    }


LOGFMT = Format(
    "logfmt",
    extract=lambda line: _parts(F.regexp_extract_all(line, F.lit(fv.LOGFMT_PAIR_PATTERN), 0)),
    accept=lambda p: F.size(p["f"]) >= fv.LOGFMT_PARSE_PAIRS,
    detect=lambda p: F.size(p["f"]) >= fv.LOGFMT_DETECT_PAIRS,
    fill=_logfmt_fill,
    keys=_logfmt_keys,
    values=_logfmt_values,
)

# --- access log ---------------------------------------------------------------


def _access_fill(line: Column, p: Column, m: Column, u: Column) -> dict[str, Column]:
    ip, user, time, method, path, status, sent = (group(p["f"], i) for i in (1, 3, 4, 5, 6, 7, 8))
    given = lambda i: F.nullif(_field(p, i), F.lit("-"))
    return {
        "time": time,
        "level": nz.level_from_status(status.try_cast("int")),
        "service": F.lit("web-server"),
        "message": F.concat_ws(" ", method, path, F.lit("HTTP"), status),
        "metadata": _metadata(
            client_ip=ip,
            http_method=method,
            http_path=path,
            status_code=status,
            bytes_sent=F.when(sent == "-", "0").otherwise(sent),
            referrer=given(9),
            user_agent=given(10),
            auth_user=F.nullif(user, F.lit("-")),
        ),
    }


ACCESS_LOG = Format(
    "nginx_apache",
    extract=lambda line: _parts(capture(line, fv.ACCESS_LOG_PATTERN, 10)),
    accept=_matched(10),
    detect=_matched(10),
    fill=_access_fill,
)

# --- syslog -------------------------------------------------------------------


def _syslog_5424_fill(line: Column, p: Column, m: Column, u: Column) -> dict[str, Column]:
    pri = group(p["f"], 1).try_cast("bigint")
    host, app = group(p["f"], 4), group(p["f"], 5)
    return {
        "time": group(p["f"], 3),
        "level": nz.level_from_severity(pri),
        "service": F.when(app == "-", host).otherwise(app),
        "message": group(p["f"], 9),
        "metadata": _metadata(
            host=host,
            proc_id=group(p["f"], 6),
            msg_id=group(p["f"], 7),
            facility=nz.facility_of(pri).cast("string"),
        ),
    }


def _syslog_3164_fill(line: Column, p: Column, m: Column, u: Column) -> dict[str, Column]:
    message = group(p["f"], 5)
    return {
        "time": group(p["f"], 1),
        "level": nz.level_from_keywords(message),
        "service": group(p["f"], 3),
        "message": message,
        "metadata": _metadata(host=group(p["f"], 2), pid=_field(p, 4)),
    }


SYSLOG_5424 = Format(
    "syslog_5424",
    extract=lambda line: _parts(capture(line, fv.SYSLOG_5424_PATTERN, 9)),
    accept=_matched(9),
    detect=_matched(9),
    fill=_syslog_5424_fill,
)
SYSLOG_3164 = Format(
    "syslog_3164",
    extract=lambda line: _parts(capture(line, fv.SYSLOG_3164_PATTERN, 5)),
    accept=_matched(5),
    detect=_matched(5),
    fill=_syslog_3164_fill,
)


def _either(new: Callable[..., Column], old: Callable[..., Column]) -> Callable[..., Column]:
    return lambda line: F.when(F.startswith(line, F.lit("<")), new(line)).otherwise(old(line))


def _syslog_fill(line: Column, p: Column, m: Column, u: Column) -> dict[str, Column]:
    new, old = _syslog_5424_fill(line, p, m, u), _syslog_3164_fill(line, p, m, u)
    return {k: F.when(SYSLOG_5424.accept(p), new[k]).otherwise(old[k]) for k in new}


# Only a 5424 line starts with '<', so at most one of the patterns is tried.
SYSLOG = Format(
    "syslog",
    extract=_either(SYSLOG_5424.extract, SYSLOG_3164.extract),
    accept=lambda p: F.size(p["f"]).isin(6, 10),
    detect=lambda p: F.size(p["f"]).isin(6, 10),
    fill=_syslog_fill,
)

# --- Spring Boot --------------------------------------------------------------


def _spring_fill(line: Column, p: Column, m: Column, u: Column) -> dict[str, Column]:
    logger = group(p["f"], 5)
    return {
        "time": group(p["f"], 1),
        "stated": group(p["f"], 2),
        "service": nz.short_logger(logger),
        "message": group(p["f"], 6),
        "metadata": _metadata(pid=group(p["f"], 3), thread=group(p["f"], 4), logger=logger),
    }


SPRING = Format(
    "springboot",
    extract=lambda line: _parts(capture(line, fv.SPRING_HEADER_PATTERN, 6)),
    accept=_matched(6),
    detect=_matched(6),
    fill=_spring_fill,
)

def _folded_fill(line: Column, p: Column, m: Column, u: Column) -> dict[str, Column]:
    header = SPRING.accept(p)
    filled = _spring_fill(line, p, m, u)
    none = {"message": line, "metadata": F.create_map().cast(_PAIRS)}
    return {k: F.when(header, v).otherwise(none.get(k, F.lit(None))) for k, v in filled.items()}


# Folded lines; a first line that is no header is an entry without a level.
SPRING_FOLDED = Format(
    "springboot",
    extract=SPRING.extract,
    accept=lambda p: F.lit(True),
    detect=SPRING.detect,
    fill=_folded_fill,
)

# --- generic ------------------------------------------------------------------


def _generic_fill(compat: bool) -> Callable[..., dict[str, Column]]:
    def fill(line: Column, p: Column, m: Column, u: Column) -> dict[str, Column]:
        tag1, level, tag2 = _field(p, 2), _field(p, 3), _field(p, 4)
        # A lone first tag states the level. ``compat`` reads any word as one.
        states = level.isNull() & tag1.isNotNull() & (F.lit(True) if compat else nz.is_level_word(tag1))
        return {
            "time": group(p["f"], 1),
            "stated": F.when(states, tag1).otherwise(level),
            "service": F.coalesce(F.when(~states, tag1), tag2),
            "message": nz.strip(group(p["f"], 5)),
            "metadata": F.create_map().cast(_PAIRS),
        }

    return fill


def generic(compat: bool = False) -> Format:
    return Format(
        "generic_standard",
        extract=lambda line: _parts(capture(line, fv.GENERIC_PATTERN, 5)),
        accept=_matched(5),
        detect=_matched(5),
            fill=_generic_fill(compat),
    )


GENERIC = generic()

# In the order in which ties are settled.
DETECTABLE = [JSON, SPRING, ACCESS_LOG, SYSLOG, LOGFMT, GENERIC]
