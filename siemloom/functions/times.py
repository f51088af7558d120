"""Timestamp readings: ISO-8601 texts, epoch numbers, digit strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siemloom.fixed_values import MS_ABOVE, TRANSFORM_MS_FROM
from siemloom.functions.values import Value, as_variant, strip

DAY_MS = 86_400_000
DIGITS = r"^-*[0-9]+$"
BAD_DIGITS = r"^--+[0-9]+$"

# Shapes (digits replaced by 0) that Spark's own timestamp cast reads alike.
NAIVE_SHAPES = [
    f"0000-00-00{sep}00:00:00{fraction}" for sep in ("T", " ") for fraction in ("", ".000", ".000000")
]
PLAIN_SHAPES = NAIVE_SHAPES + [shape + "+00:00" for shape in NAIVE_SHAPES]
# hours, then minutes, seconds and their fraction in extended or basic form
CLOCK = r"\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?|\d{2}(?:\d{2}(?:[.,]\d+)?)?)?"
# Any character may stand between date and clock. What follows a week tells whether its next digit is a day: in the extended form if it is
# no clock's first digit, in the basic form by the number of digits in a row, as a clock's come in pairs.
DATE = (
    r"\d{4}-\d{2}-\d{2}|\d{8}"
    r"|\d{4}-W\d{2}-\d(?!\d)|\d{4}-W\d{2}"
    r"|\d{4}W\d{3}(?=(?:\d(?:\d\d)*)?(?!\d))|\d{4}W\d{2}(?=(?:\d{3}(?:\d\d)*)?(?!\d))"
)
ISO_PATTERN = rf"^({DATE})(?:[\s\S]({CLOCK})([+-]{CLOCK})?)?\z"
LAST_DAY = 2_932_896  # 9999-12-31


def _day_of_date(digits: Column) -> Column:
    """Day number of yyyymmdd; NULL when there is no such day."""
    return F.unix_date(F.concat_ws("-", digits.substr(1, 4), digits.substr(5, 2), digits.substr(7, 2)).try_cast("date"))


def _day_of_week_date(digits: Column) -> Column:
    """Day number of year, week and day of the week (Monday, 1, if none); NULL when there is no such day.

    Week 1 holds January 4th; a week belongs to the year of its Thursday.
    """
    fourth = F.concat(digits.substr(1, 4), F.lit("-01-04")).try_cast("date")
    week, day = digits.substr(5, 2).try_cast("int"), F.coalesce(digits.substr(7, 1).try_cast("int"), F.lit(1))
    monday = F.unix_date(fourth) - F.weekday(fourth) + (week - 1) * 7
    found = monday + day - 1
    of_year = F.year(F.date_from_unix_date(monday + 3)) == digits.substr(1, 4).try_cast("int")
    return F.when((week > 0) & of_year & day.between(1, 7) & (found <= LAST_DAY), found)


def _ms_of_parts(parts: Column) -> Column:
    """Milliseconds of the text parts [date, clock, offset]; NULL when out of range."""
    def clock(i: int, sign: int) -> tuple[Column, Column, Column, Column]:
        """Hours, minutes, seconds, microseconds; after the sign, if there is one."""
        text = F.replace(F.get(parts, F.lit(i)), F.lit(":"), F.lit(""))
        whole = [F.coalesce(text.substr(sign + k, 2).try_cast("bigint"), F.lit(0)) for k in (1, 3, 5)]
        return *whole, F.coalesce(F.rpad(text.substr(sign + 8, 6), 6, "0").try_cast("bigint"), F.lit(0))

    def micros(h: Column, m: Column, s: Column, fraction: Column) -> Column:
        return ((h * 60 + m) * 60 + s) * 1_000_000 + fraction

    date = F.get(parts, F.lit(0))
    digits = F.translate(date, "-W", "")
    day = F.when(date.contains("W"), _day_of_week_date(digits)).otherwise(_day_of_date(digits))
    time, offset = clock(1, 0), clock(2, 1)
    # an offset of less than a second is none
    ahead = F.when(micros(*offset) >= 1_000_000, micros(*offset)).otherwise(F.lit(0))
    sign = F.when(F.get(parts, F.lit(2)).startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    in_range = (
        (time[0] < 24) & (time[1] < 60) & (time[2] < 60) & (ahead < DAY_MS * 1000)
        & (digits.substr(1, 4) != "0000")
    )
    total = day.cast("bigint") * (DAY_MS * 1000) + micros(*time) - sign * ahead
    return F.when(in_range, F.call_function("div", total - F.pmod(total, F.lit(1000)), F.lit(1000)))


def _iso_by_parts(s: Column) -> Column:
    """Any accepted ISO form, from its parts.

    The rare path: the parts are bound once by ``transform`` so that they are
    neither computed per use nor repeated in the generated code.
    """
    parts = F.split(F.regexp_replace(s, ISO_PATTERN, "$1|$2|$3"), r"\|")
    bound = F.get(F.transform(F.array(parts), _ms_of_parts), F.lit(0))
    return F.when(s.rlike(ISO_PATTERN), bound)


def iso_ms(s: Column) -> Column:
    """Epoch milliseconds of an ISO-8601 text (naive texts are UTC), NULL when it is none."""
    utc = F.replace(s, F.lit("Z"), F.lit("+00:00"))
    shape = F.translate(utc, "0123456789", "0000000000")
    zoned = F.when(shape.isin(NAIVE_SHAPES), F.concat(utc, F.lit("+00:00"))).otherwise(utc)
    plain = F.unix_millis(F.try_to_timestamp(zoned))
    return F.when(shape.isin(PLAIN_SHAPES) & ~s.startswith("0000"), plain).otherwise(_iso_by_parts(utc))


def scale_whole(n: Column, limit: int = MS_ABOVE) -> Column:
    """Seconds to milliseconds unless the number is already that large."""
    return F.when(n > limit, n).otherwise(F.try_multiply(n, F.lit(1000).cast("bigint")))


def epoch_ms(v: Value, now_ms: Column, digit_strings: Column | bool = True,
             truncate_first: Column | bool = False) -> Column:
    """Epoch milliseconds of a timestamp value.

    ``digit_strings``: texts of digits are epoch numbers and texts are stripped.
    ``truncate_first``: fractional seconds are dropped before scaling.
    ``now_ms`` stands in for absent and unreadable values.  NULL means the text
    is a malformed digit string (see :func:`malformed_digits`).
    """
    digit_strings = digit_strings if isinstance(digit_strings, Column) else F.lit(digit_strings)
    truncate_first = truncate_first if isinstance(truncate_first, Column) else F.lit(truncate_first)
    d = v.number
    from_number = (
        F.when(truncate_first, scale_whole(d.try_cast("bigint")))
        .when(d > MS_ABOVE, d.try_cast("bigint"))
        .otherwise((d * 1000).try_cast("bigint"))
    )
    stripped = strip(v.text)
    return (
        F.when(~v.is_set, now_ms)
        .when(v.is_whole | (v.is_string & digit_strings & stripped.rlike(DIGITS)),
              scale_whole(strip(v.text).try_cast("bigint")))
        .when(v.is_string,
              F.coalesce(iso_ms(F.when(digit_strings, stripped).otherwise(v.text)), now_ms))
        .when(v.is_number, from_number)
        .otherwise(now_ms)
    )


def malformed_digits(v: Value) -> Column:
    """The stripped text when it looks like digits with several leading signs, else NULL."""
    return F.when(v.is_string & v.text.contains("--") & strip(v.text).rlike(BAD_DIGITS), strip(v.text))


def readable_time(v: Value) -> Column:
    """Whether a value passes as a timestamp: any number, digits, or ISO text."""
    s = strip(v.text)
    return F.coalesce(
        v.is_number | (v.is_string & (s.rlike(DIGITS) | iso_ms(s).isNotNull())), F.lit(False))


# Texts that read as a floating-point number.
FLOAT_TEXT = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"


def float_text(s: Column) -> Column:
    """A text as DOUBLE, NULL when it is not a number text."""
    cleaned = strip(s)
    return F.when(cleaned.rlike(FLOAT_TEXT), F.replace(cleaned, F.lit("_"), F.lit("")).try_cast("double"))


def converted_timestamp(v: Column, r: Value | None = None) -> Column:
    """Epoch ms as VARIANT; unreadable values pass through (texts stripped).  ``r``: type and text, where they are read already."""
    r = r or Value.of(v)
    s = strip(r.text)
    f = float_text(r.text)

    def scaled(x: Column) -> Column:
        return F.when(x < TRANSFORM_MS_FROM, (x * 1000).try_cast("bigint")).otherwise(x.try_cast("bigint"))

    return (
        F.when(r.is_whole, as_variant(scaled(r.bigint)))
        .when(r.is_string,
              F.when(f.isNotNull(), as_variant(scaled(f)))
              .otherwise(F.coalesce(as_variant(iso_ms(s)), as_variant(s))))
        .when(r.is_number, as_variant(scaled(r.number)))
        .otherwise(v)
    )


def iso_text(ms: Column) -> Column:
    """ISO-8601 text with a zero offset; fraction only when there is one."""
    ts = F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone())
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.pmod(ms, F.lit(1000))
    return F.when(fraction == 0, F.concat(whole, F.lit("+00:00"))).otherwise(
        F.concat(whole, F.lit("."), F.lpad(fraction.cast("string"), 3, "0"), F.lit("000+00:00")))
