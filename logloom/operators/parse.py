"""Lines -> log table."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import fixed_values as fv
from logloom.functions import normalize as nz
from logloom.functions.capture import evaluate_once
from logloom.operators import formats as fm
from logloom.operators.formats import Format
from logloom.operators.multiline import fold_lines
from logloom.schema import LOG_COLUMNS, row_id
from logloom.sources.workspace import broadcast_if_small, settle, stored


def _choose(formats: list[Format], value, otherwise: str | None = None) -> Column:
    """The column of the only format, or the choice among several by ``parser``.

    Formats for which ``value`` is None have a null of type ``otherwise``.
    """
    values = [(f.name, value(f)) for f in formats]
    values = [(name, F.lit(None).cast(otherwise) if v is None else v) for name, v in values]
    if len(formats) == 1:
        return values[0][1]
    return F.coalesce(*[F.when(F.col("parser") == name, v) for name, v in values])


# Columns of a scan name no frame, so one application builds them once. A stream
# parses each of its micro-batches, and building them takes longer than one.
@lru_cache(64)
def _scan(app: str, formats: tuple[Format, ...], year: int | None, kept: tuple[str, ...]) -> dict:
    """The columns of :func:`_parse`, step by step."""
    body, parts, pairs, usable = (F.col(c) for c in ("_body", "_parts", "_pairs", "_usable"))
    out: dict = {"body": nz.strip(F.col("line")), "full": body != ""}
    out["parts"] = _choose(formats, lambda f: f.extract(body))
    out["accepted"] = _choose(formats, lambda f: f.accept(parts))
    out["sides"] = {}
    if any(f.keys for f in formats):
        sides = {"_keys": lambda f: f.keys, "_values": lambda f: f.values}
        for name, side in sides.items():
            of = _choose(formats, lambda f: side(f)(parts) if side(f) else None, "array<string>")
            out["sides"][name] = of
        keys, values = F.col("_keys"), F.col("_values")
        plain = _choose(formats, lambda f: f.plain(parts, keys, values) if f.keys else None, "map<string,string>")
        out["sides"]["_pairs"] = F.when(fm.has_twins(keys), fm.last_wins(keys, values)).otherwise(plain)
        used = _choose(formats, lambda f: f.usable(body, pairs) if f.keys else None, "map<string,string>")
        out["sides"]["_usable"] = used
    filled = {f.name: f.fill(body, parts, pairs, usable) for f in formats}
    texts = ("time", "level", "stated", "service", "message")
    columns = {c: _choose(formats, lambda f: filled[f.name].get(c), "string") for c in texts}
    columns["metadata"] = _choose(formats, lambda f: filled[f.name]["metadata"])
    columns["_time"] = nz.time_text(columns.pop("time"))
    out["filled"] = [*kept, *[v.alias(c) for c, v in columns.items()]]
    level = F.coalesce("level", nz.normalize_level(F.col("stated")))
    out["last"] = {"level": level, "ts": nz.read_time(F.col("_time"), year)}
    return out


def _parse(lines: DataFrame, formats: list[Format], year: int | None) -> DataFrame:
    """Parse lines by one scan. A line that its format refuses gives no row.

    Each step is a projection of its own that later ones only refer to, so
    that no step is computed more than once.
    """
    kept = tuple(c for c in ("source", "line_number", "parser", "line", "_lines") if c in lines.columns)
    scan = _scan(lines.sparkSession.sparkContext.applicationId, tuple(formats), year, kept)
    cut = evaluate_once(lines, "_body", scan["body"]).where(scan["full"])
    cut = evaluate_once(cut, "_parts", scan["parts"]).where(scan["accepted"])
    for name, side in scan["sides"].items():
        cut = cut.withColumn(name, side)
    return cut.select(*scan["filled"]).withColumns(scan["last"]).drop("stated")


@lru_cache(8)
def _log_columns(app: str, folded: bool) -> list[Column]:
    meta = F.col("metadata")
    trace = F.col("_lines") if folded else F.lit(None).cast("array<string>")
    traced = F.size(trace) > 0
    stripped = F.transform(trace, nz.strip)
    message, raw = F.col("message"), F.col("line")
    if folded:
        message = F.when(traced, F.concat_ws("\n", message, stripped)).otherwise(message)
        raw = F.when(traced, F.concat_ws("\n", raw, trace)).otherwise(raw)
    values = {
        "id": row_id(),
        "epoch": nz.epoch_of(F.col("ts")),
        "ts_raw": F.when(F.col("ts").isNull(), F.col("_time")),
        "message": message,
        "raw": raw,
        "stack_trace": F.when(traced, stripped),
        "status_code": F.try_element_at(meta, F.lit("status_code")).try_cast("int"),
        "client_ip": F.try_element_at(meta, F.lit("client_ip")),
        "host": F.try_element_at(meta, F.lit("host")),
    }
    return [values.get(c, F.col(c)).alias(c) for c in LOG_COLUMNS]


def _finish(cut: DataFrame) -> DataFrame:
    """The log columns from the parsed parts and, for folded rows, their lines."""
    return cut.select(*_log_columns(cut.sparkSession.sparkContext.applicationId, "_lines" in cut.columns))


def _one(lines: DataFrame, fmt: Format, year: int | None = None, parser: str | None = None) -> DataFrame:
    return _finish(_parse(lines, [fmt], year).withColumn("parser", F.lit(parser or fmt.name)))


def parse_json(lines: DataFrame) -> DataFrame:
    return _one(lines, fm.JSON)


def parse_access_log(lines: DataFrame) -> DataFrame:
    return _one(lines, fm.ACCESS_LOG)


def parse_syslog_5424(lines: DataFrame) -> DataFrame:
    return _one(lines, fm.SYSLOG_5424, parser="syslog")


def parse_syslog_3164(lines: DataFrame, year: int | None = None) -> DataFrame:
    return _one(lines, fm.SYSLOG_3164, year, parser="syslog")


def parse_syslog(lines: DataFrame, year: int | None = None) -> DataFrame:
    return _one(lines, fm.SYSLOG, year)


def parse_logfmt(lines: DataFrame) -> DataFrame:
    return _one(lines, fm.LOGFMT)


def parse_generic(lines: DataFrame, compat: bool = False) -> DataFrame:
    return _one(lines, fm.generic(compat))


def parse_springboot(lines: DataFrame) -> DataFrame:
    """Header lines only; see :func:`group_multiline` for stack traces."""
    return _one(lines, fm.SPRING)


# Parse jobs that look at one line at a time.
BY_LINE = frozenset({parse_json, parse_access_log, parse_syslog_5424, parse_syslog_3164, parse_syslog, parse_logfmt, parse_generic, parse_springboot})


def group_multiline(
    lines: DataFrame, header_regex: str = fv.SPRING_HEADER_PATTERN, lines_per_chunk: int = 100_000
) -> DataFrame:
    """Spring Boot rows with the lines that follow each header folded in.

    Lines before the first header of a source become INFO rows of their own.
    """
    return parse_folded(fold_lines(lines, header_regex, lines_per_chunk))


def parse_folded(folded: DataFrame) -> DataFrame:
    """Spring Boot rows from (source, line_number, line, _lines): a header and
    the lines that follow it."""
    return _finish(_parse(folded, [fm.SPRING_FOLDED], None).withColumn("parser", F.lit(fm.SPRING.name)))


# --- detection ------------------------------------------------------------------


def detect_format(lines: DataFrame) -> DataFrame:
    """(source, parser, score): the format that most of a source's first lines fit."""
    body = nz.strip(F.col("line"))
    head = lines.where(F.col("line_number") <= fv.DETECT_LINES).select("source", body.alias("body")).where("body <> ''")
    scores = head.groupBy("source").agg(
        *[F.avg(F.coalesce(f.detect(f.extract(F.col("body"))), F.lit(False)).cast("int")).alias(f.name) for f in fm.DETECTABLE]
    )
    best = F.greatest(*[F.col(f.name) for f in fm.DETECTABLE])
    winner = F.coalesce(*[F.when(F.col(f.name) == F.col("score"), f.name) for f in fm.DETECTABLE])
    low = F.col("score") < fv.DETECT_MIN_SCORE
    return scores.withColumn("score", best).select(
        "source",
        F.when(low, fm.GENERIC.name).otherwise(winner).alias("parser"),
        F.when(low, fv.DETECT_MIN_SCORE).otherwise(F.col("score")).alias("score"),
    )


def _fallback(lines: DataFrame, detected: DataFrame) -> DataFrame | None:
    """Sources whose format gives rows for too few lines, and generic for more.

    Every line is tried with the format of its source only; generic is tried
    in a second scan, and only if some source has too few rows.
    """
    formats = [f for f in fm.DETECTABLE if f is not fm.GENERIC]
    body = nz.strip(F.col("line")).alias("body")
    own = broadcast_if_small(detected.where(F.col("parser") != fm.GENERIC.name).select("source", "parser"))
    tried = lines.join(own, "source").select("source", "parser", "line_number", body)
    fits = _choose(formats, lambda f: f.accept(f.extract(F.col("body"))))
    tried = tried.select("source", "parser", "line_number", F.coalesce(fits, F.lit(False)).alias("fits"))
    counts = tried.groupBy("source").agg(
        F.count("*").alias("n"),
        F.count_if("fits").alias("n_fits"),
        F.bool_or(F.col("parser") == fm.SPRING.name).alias("spring"),
        F.min(F.when(F.col("fits"), F.col("line_number"))).alias("first_header"),
    )
    few = settle(counts.where(F.col("n_fits") < F.col("n") * fv.FALLBACK_SHARE))
    if few.isEmpty():
        return None
    again = lines.join(broadcast_if_small(few), "source").select("*", body).where("body <> ''")
    # Lines before the first Spring header are rows as well.
    early = F.col("spring") & (F.col("line_number") < F.coalesce("first_header", F.lit(2**62)))
    generic = F.coalesce(fm.GENERIC.accept(fm.GENERIC.extract(F.col("body"))), F.lit(False))
    sums = again.groupBy("source").agg(F.count_if(early).alias("n_early"), F.count_if(generic).alias("n_generic"))
    given = F.col("n_fits") + F.col("n_early")
    return (
        few.join(sums, "source")
        .where((given < F.col("n") * fv.FALLBACK_SHARE) & (F.col("n_generic") > given))
        .select("source", F.lit(fm.GENERIC.name).alias("fallback"))
    )


def choose_parsers(lines: DataFrame, fallback: bool = True) -> DataFrame:
    """(source, parser, score) to parse with: as detected, or generic."""
    detected = settle(detect_format(lines))
    swaps = _fallback(lines, detected) if fallback else None
    if swaps is None:
        return detected
    swapped = detected.join(swaps, "source", "left")
    return settle(swapped.select("source", F.coalesce("fallback", "parser").alias("parser"), "score"))


def _parse_as(lines: DataFrame, parsers: DataFrame, year: int | None) -> DataFrame:
    """Each source parsed by the format named for it, in one scan; Spring Boot
    sources, where lines must be brought together, take a second one."""
    found = {r.parser for r in parsers.select("parser").distinct().collect()}  # six values at most
    tagged = lines.join(broadcast_if_small(parsers.select("source", "parser")), "source")
    single = [f for f in fm.DETECTABLE if f.name in found and f is not fm.SPRING]
    out = []
    if single:
        picked = tagged.where(F.col("parser").isin([f.name for f in single]))
        out.append(_finish(_parse(picked, single, year)))
    if fm.SPRING.name in found:
        out.append(group_multiline(tagged.where(F.col("parser") == fm.SPRING.name).drop("parser")))
    if not out:
        return _one(lines, fm.GENERIC)
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _speculative(lines: DataFrame, year: int | None) -> DataFrame:
    """Parse with the detected formats and keep the rows; a source whose format
    gave rows for too few of its lines is parsed again as generic, which stands
    if it gives more."""
    detected = settle(detect_format(lines))
    own = stored(_parse_as(lines, detected, year), "parsed")
    n_lines = lines.groupBy("source").agg(F.count("*").alias("n"))
    given = own.groupBy("source").agg(F.count("*").alias("given"))
    judged = detected.where(F.col("parser") != fm.GENERIC.name).join(n_lines, "source").join(given, "source", "left")
    judged = judged.select("source", "n", F.coalesce("given", F.lit(0)).alias("given"))
    few = settle(judged.where(F.col("given") < F.col("n") * fv.FALLBACK_SHARE))
    if few.isEmpty():
        return own
    again = lines.join(broadcast_if_small(few.select("source")), "source", "left_semi")
    again = stored(_one(again, fm.GENERIC), "parsed_again")
    more = again.groupBy("source").agg(F.count("*").alias("n_generic")).join(few, "source").where("n_generic > given")
    more = broadcast_if_small(settle(more.select("source")))
    return own.join(more, "source", "left_anti").unionByName(again.join(more, "source", "left_semi"))


def parse_logs(
    lines: DataFrame, year: int | None = None, fallback: bool = True, parsers: DataFrame | None = None
) -> DataFrame:
    """Detect the format of each source and parse all sources in one scan.

    With ``fallback`` the rows are stored on the way, so that each line is
    parsed once unless its source falls back. ``parsers`` (from
    :func:`choose_parsers`) skips detection.
    """
    if parsers is None and fallback:
        return _speculative(lines, year)
    return _parse_as(lines, settle(detect_format(lines) if parsers is None else parsers), year)
