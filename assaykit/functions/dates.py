"""Dates kept as text: mixed-format parsing, value shapes, ISO text, run timestamps."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
STAMP_FORMAT = "yyyyMMdd_HHmmss"

# Layouts that are rewritten to ISO text. Month comes first unless it cannot be a month.
MONTH_FIRST = (r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})(?!\d)", "$3-$1-$2")
DAY_FIRST = (r"^(1[3-9]|2\d|3[01])[/-](\d{1,2})[/-](\d{4})(?!\d)", "$3-$2-$1")
YEAR_FIRST = (r"^(\d{4})/(\d{1,2})/(\d{1,2})(?!\d)", "$1-$2-$3")
COMPACT = (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
YEAR_ONLY = (r"^(\d{4})$", "$1-01-01")

# Words that dates are written with, matched in capitals.
MONTH = (r"(?<![A-Z])(JAN(?:UARY)?|FEB(?:RUARY)?|MAR(?:CH)?|APR(?:IL)?|MAY|JUNE?|JULY?|AUG(?:UST)?|SEP(?:T(?:EMBER)?)?"
         r"|OCT(?:OBER)?|NOV(?:EMBER)?|DEC(?:EMBER)?)(?![A-Z])")
MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
WEEKDAY = r"(?<![A-Z])(?:MON|TUE(?:S)?|WED(?:NES)?|THU(?:R(?:S)?)?|FRI|SAT(?:UR)?|SUN)(?:DAY)?(?![A-Z])"
#: A time of day anywhere in the text: with a colon, or an hour with AM or PM.
CLOCK = r"(?<![\d:.])(\d{1,2}):(\d{2})(?::(\d{2})(\.\d{1,6})?\d*)?(?![\d:])(?: ?([AP])(?:\.?M)?(?![A-Z])\.?)?"
HOUR = r"(?<![\d:./-])(\d{1,2}) ?([AP])\.?M(?![A-Z])\.?"
#: Words and marks that say nothing: weekdays, commas, ordinal endings, what joins date and time.
IDLE = WEEKDAY + r"\.?|,|(?<![A-Z])(?:AT|OF)(?![A-Z])|(?<=\d)(?:ST|ND|RD|TH)(?![A-Z])|(?<=\d)T(?= |$)"
RUN_TOGETHER = (r"^(\d{8})[T ]?(\d{2})(\d{2})(\d{2})?$", "$1 $2:$3:$4")
BEGINS_WITH_DAY = r"^(?:1[3-9]|2\d|3[01])[/.-]\d{1,2}[/.-](?:\d{4}|\d{2})(?!\d)"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _by_tokens(text: Column) -> Column:
    """Moment of a date written with month names, AM or PM, two-digit years, dots or any order of its parts; else null.

    A time of day is taken out first. What is left are numbers and at most one month name. A number of four digits or above 31 is a
    year. With a name the other number is the day; numbers alone are month, day, year, or day, month, year if the first can be
    no month, or begin with the year. Two-digit years lie within fifty years of today. Missing days are the first.
    """
    def with_clock(t: Column) -> Column:
        clock = F.when(t.rlike(CLOCK), F.regexp_extract(t, CLOCK, 0)).otherwise(F.regexp_extract(t, HOUR, 0))
        return _let(F.struct(t.alias("t"), clock.alias("clock")), with_rest)

    def with_rest(x: Column) -> Column:
        rest = F.regexp_replace(F.when(x["clock"] != "", F.replace(x["t"], x["clock"], F.lit(" "))).otherwise(x["t"]), IDLE, " ")
        return _let(F.struct(x["clock"].alias("clock"), rest.alias("rest")), with_numbers)

    def with_numbers(x: Column) -> Column:
        name = F.regexp_extract(x["rest"], MONTH, 1)
        plain = F.trim(F.regexp_replace(F.regexp_replace(x["rest"], MONTH, " M "), "[ ./-]+", " "))
        month = F.when(name != "", ((F.position(F.substring(name, 1, 3), F.lit(MONTHS)) + 2) / 3).cast("int"))
        return _let(F.struct(
            x["clock"].alias("clock"), month.alias("month"), F.regexp_replace(plain, r"\d+", "N").alias("shape"),
            F.regexp_extract_all(plain, F.lit(r"\d+"), F.lit(0)).alias("n")), with_date)

    def with_date(x: Column) -> Column:
        texts = [F.get(x["n"], F.lit(i)) for i in range(3)]
        a, b, c = (t.try_cast("int") for t in texts)
        year_at = [(F.length(t) == 4) | (t.try_cast("int") > 31) for t in texts]
        first = F.lit(1)

        def date(year: Column, month: Column, day: Column) -> Column:
            return F.struct(year.alias("year"), month.alias("month"), day.alias("day"))

        is_shape = lambda *shapes: x["shape"].isin(*shapes)
        together = [F.substring(texts[0], at, F.lit(n)) for at, n in ((F.lit(1), 4), (F.lit(5), 2), (F.lit(7), 2))]
        found = (
            F.when(is_shape("M N N", "N M N") & year_at[0], date(texts[0], x["month"], b))
            .when(is_shape("M N N", "N M N"), date(texts[1], x["month"], a))
            .when(is_shape("N N M") & year_at[1], date(texts[1], x["month"], a))
            .when(is_shape("N N M"), date(texts[0], x["month"], b))
            .when(is_shape("N N N") & year_at[0], date(texts[0], b, c))
            .when(is_shape("N N N") & (a > 12), date(texts[2], b, a))
            .when(is_shape("N N N"), date(texts[2], a, b))
            .when(is_shape("M N", "N M") & year_at[0], date(texts[0], x["month"], first))
            .when(is_shape("N N") & year_at[0], date(texts[0], b, first))
            .when(is_shape("N N") & year_at[1], date(texts[1], a, first))
            .when(is_shape("N") & (F.length(texts[0]) == 8),
                  date(together[0], together[1].try_cast("int"), together[2].try_cast("int"))))
        sizes = F.transform(x["n"], F.length)
        sound = F.forall(sizes, lambda size: size.isin(1, 2, 4)) | (x["shape"] == "N")
        return _let(F.struct(x["clock"].alias("clock"), F.when(sound, found).alias("d")), with_year)

    def with_year(x: Column) -> Column:
        near, now = x["d"]["year"].try_cast("int") + 2000, F.year(F.current_date())
        near = F.when(near >= now + 50, near - 100).when(near < now - 50, near + 100).otherwise(near)
        year = F.when(F.length(x["d"]["year"]) == 4, x["d"]["year"].try_cast("int")).otherwise(near)
        clock, hour_only = x["clock"], ~x["clock"].contains(":")

        def part(i: int, only: int | None = None) -> Column:
            whole = F.regexp_extract(clock, CLOCK, i)
            return F.when(hour_only, F.regexp_extract(clock, HOUR, only) if only else F.lit("")).otherwise(whole)

        hour, half = part(1, 1).try_cast("int"), part(5, 2)
        hour = F.when(half == "", hour).when(hour <= 12, hour % 12 + F.when(half == "P", 12).otherwise(0))
        zero = F.lit(0)
        return F.format_string(
            "%04d-%02d-%02d %02d:%02d:%02d%s", year, x["d"]["month"], x["d"]["day"],
            F.when(clock == "", zero).otherwise(hour), F.coalesce(part(2).try_cast("int"), zero),
            F.coalesce(part(3).try_cast("int"), zero), part(4))

    joined = F.regexp_replace(F.regexp_replace(F.upper(text), *RUN_TOGETHER), ":$", "")
    return _let(joined, with_clock).try_cast("timestamp_ntz")


def _iso_cast(text: Column) -> Column:
    """Cast of ISO text. The dash after the year keeps plain numbers from being read as years."""
    return F.when(F.substring(text, 5, 1) == "-", text.try_cast("timestamp_ntz"))


def parse_date(column: Column, dtype: str = "string", extra_formats: Iterable[str] = ()) -> Column:
    """Timestamp without zone, null where the value is no date.

    ISO text is cast as it is. Other layouts are rewritten first, one after the other and only while
    there is no result, because a cast rejects bad text cheaply while each failed pattern of
    ``to_timestamp`` costs an exception per row. What the common layouts do not match is read by its tokens.
    Not taken as dates: a time alone, numbers of six digits, a day and month without a year.
    """
    if dtype in ("timestamp_ntz", "timestamp", "date"):
        return column.cast("timestamp_ntz")
    text = F.trim(column.cast("string"))
    layouts = [
        _iso_cast(F.regexp_replace(text, pattern, iso))
        for pattern, iso in (MONTH_FIRST, DAY_FIRST, YEAR_FIRST, COMPACT, YEAR_ONLY)
    ]
    formats = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in extra_formats]
    return F.coalesce(_iso_cast(text), *layouts, *formats, _by_tokens(text))


def date_shape(column: Column, dtype: str = "string") -> Column:
    """The layout of a date text, for instance ``d/d/y d:d`` or ``b d y``: equal shape, equal format."""
    if dtype in ("timestamp_ntz", "timestamp", "date"):
        return F.when(column.isNotNull(), F.lit(dtype))
    text = F.trim(column.cast("string"))
    layout = F.upper(text)
    for pattern, mark in ((MONTH, "b"), (WEEKDAY, "a"), (r"(?<=[\d ])[AP]\.?M(?![A-Z])", "p")):
        layout = F.regexp_replace(layout, pattern, mark)
    layout = F.when(text.rlike("[A-SU-Za-su-z]"), layout).otherwise(text)  # a T between date and time is no word
    layout = F.regexp_replace(F.regexp_replace(layout, r"\d{4}", "y"), r"\d+", "d")
    return F.when(text.rlike(BEGINS_WITH_DAY), F.concat(F.lit("day first "), layout)).otherwise(layout)


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, ISO_FORMAT)


def parse_instant(text: Column, fallback: Column) -> Column:
    """Timestamp of ISO text with offset or ``Z``; the fallback where there is none."""
    return F.coalesce(F.when(F.length(text) > 0, text.try_cast("timestamp")), fallback)


def elapsed_seconds(started: Column, finished: Column) -> Column:
    """Seconds between two instants, never negative, 4 decimals."""
    micros = F.unix_micros(finished) - F.unix_micros(started)
    return F.round(F.greatest(micros / 1e6, F.lit(0.0)), 4)
