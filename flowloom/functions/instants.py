"""Timestamps as typed by people and clocks, turned into UTC microseconds with built-in expressions only.

One regular expression takes every supported notation apart; everything after it is integer arithmetic inside
whole-stage code generation. Nothing depends on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARK = "\u0001"
_DATE = (
    r"(?:(\d{4})-(\d{1,2})-(\d{1,2})[Tt ]"  # 1-3   2024-05-01T
    r"|(\d{1,2})/(\d{1,2})/(\d{4}) "  # 4-6   01/05/2024
    r"|(\d{1,2})\.(\d{1,2})\.(\d{4}) "  # 7-9   01.05.2024
    r"|(?:[A-Za-z]{3,9}, ?)?(\d{1,2}) ([A-Za-z]{3,9})\.? (\d{4}) "  # 10-12 Wed, 1 May 2024
    r"|(\d{4})(\d{2})(\d{2})[Tt])"  # 13-15 20240501T
)
_TIME = r"(\d{1,2}):?(\d{2})(?::?(\d{2}))?(?:[.,](\d{1,9}))?"  # 16-19
_TAIL = r" ?([AaPp][Mm])?\s*(Z|z|[+-]\d{2}:?\d{2}|[A-Za-z]{2,5})?(?:\[([^\]]*)\])?"  # 20-22
PATTERN = f"^{_DATE}{_TIME}{_TAIL}$"
#: What is kept of the groups: of the alternatives in one field only one can be filled.
_FIELDS = ("$1$6$9$12$13", "$2$8$14", "$11", "$3$7$10$15", "$4", "$5", "$16", "$17", "$18", "$19", "$20", "$21", "$22", "$1", "$9", "$12")
_YEAR, _MONTH, _NAME, _DAY, _SLASH_A, _SLASH_B, _H, _MI, _S, _FRACTION, _HALF, _ZONE, _REGION, _ISO, _DOT, _NAMED = range(1, 17)
_REPLACEMENT = _MARK + _MARK.join(_FIELDS)

#: Interpretations, by bit of a mask.
FORMATS = ("iso", "slash_dmy", "slash_mdy", "dot_dmy", "named", "basic", "epoch_s", "epoch_ms")
BIT = {name: 1 << i for i, name in enumerate(FORMATS)}
_DAY_US = 86_400_000_000
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def once(c: Column) -> Column:
    """The same value, marked as not to be computed again: a pushed-down filter would otherwise repeat all of it."""
    return F.when(F.spark_partition_id() >= 0, c)


#: Blanks in the sense of the reference rules, the no-break and the wide one included.
BLANKS = " \t\n\r\f\v\u00a0\u3000"


def trimmed(text: Column) -> Column:
    """Text without outer blanks, in linear time however many there are."""
    return F.btrim(text, F.lit(BLANKS))


def _taken_apart(df: DataFrame, text: str) -> DataFrame:
    """Adds __t, the trimmed text, and __p, the pattern's groups, one element for digits alone, or null.

    The pattern runs once a row: a text that it does not match comes back as it was.
    """
    t, r = F.col("__t"), F.col("__r")
    df = df.withColumn("__t", once(trimmed(F.col(text))))
    df = df.withColumn("__r", once(F.when(t.rlike(r"^\d{1,15}$"), t).otherwise(F.regexp_replace(t, PATTERN, _REPLACEMENT))))
    matched = r.startswith(_MARK) & ~t.startswith(_MARK)
    digits = F.ascii(t).between(48, 57) & ~r.startswith(_MARK) & t.rlike(r"^\d{1,15}$")
    return df.withColumn("__p", once(F.when(matched, F.split(r, _MARK, -1)).when(digits, F.array(t)))).drop("__r")


def _int(text: Column) -> Column:
    return text.try_cast("int")


def _month_number(name: Column) -> Column:
    at = F.instr(F.lit(_MONTHS), F.lower(F.substring(name, 1, 3)))
    return F.when((at > 0) & (at % 3 == 1), ((at + 2) / 3).cast("int"))


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970, null for an impossible date."""
    return F.unix_date(F.concat_ws("-", y, m, d).try_cast("date"))


def _time_us(p: Column) -> Column:
    """Microseconds since midnight, null for an impossible time."""
    h, mi, s = _int(p[_H]), _int(p[_MI]), F.coalesce(_int(p[_S]), F.lit(0))
    half = F.lower(p[_HALF])
    hour = F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(half == "pm", 12).otherwise(0))
    fraction = F.rpad(F.substring(p[_FRACTION], 1, 6), 6, "0").cast("long")
    return F.when((hour <= 23) & (mi <= 59) & (s <= 59), (hour.cast("long") * 3600 + mi * 60 + s) * 1_000_000 + fraction)


#: Digits alone are a year before 10000, as seconds and as milliseconds; up to this many digits count seconds.
_LAST_SECOND, SECOND_DIGITS = 253_402_300_799, 11


def with_readings(df: DataFrame, text: str) -> DataFrame:
    """Adds what a text can mean: __mask, __a, __b, __zone, __region and __digits.

    __mask has the bits of all FORMATS that give a possible date and time, 0 if none. __a are the wall-clock
    microseconds of the day-first or only reading, for digits alone the instant if they are seconds; __b those of the
    month-first reading, or the instant if they are milliseconds. __digits is the number of digits of text of digits
    alone, else 0. Columns whose names start with two underscores are reserved.
    """
    df = _taken_apart(df, text)
    p, t, n = F.col("__p"), F.col("__t"), F.col("__p")[0].try_cast("long")
    alone, slash = F.size(p) == 1, p[_SLASH_A] != ""
    month = F.when(p[_NAME] != "", _month_number(p[_NAME]).cast("string")).otherwise(p[_MONTH])
    a_days = F.when(slash, _days(p[_YEAR], p[_SLASH_B], p[_SLASH_A])).when(month.isNotNull(), _days(p[_YEAR], month, p[_DAY]))
    b_days = F.when(slash, _days(p[_YEAR], p[_SLASH_A], p[_SLASH_B]))
    df = df.withColumn("__time", once(F.when(F.size(p) > 1, _time_us(p))))
    df = df.withColumn("__a", once(F.when(alone, F.when(n <= _LAST_SECOND, n * 1_000_000)).when(F.size(p) > 1, a_days.cast("long") * _DAY_US + F.col("__time"))))
    df = df.withColumn("__b", once(F.when(alone, F.when(n <= _LAST_SECOND * 1000 + 999, n * 1000)).when(F.size(p) > 1, b_days.cast("long") * _DAY_US + F.col("__time"))))
    first = (
        F.when(alone, BIT["epoch_s"])
        .when(slash, BIT["slash_dmy"])
        .when(p[_ISO] != "", BIT["iso"])
        .when(p[_DOT] != "", BIT["dot_dmy"])
        .when(p[_NAMED] != "", BIT["named"])
        .otherwise(BIT["basic"])
    )
    second = F.when(alone, BIT["epoch_ms"]).otherwise(BIT["slash_mdy"])
    mask = F.when(F.col("__a").isNotNull(), first).otherwise(0).bitwiseOR(F.when(F.col("__b").isNotNull(), second).otherwise(0))
    several = F.size(p) > 1
    df = df.withColumns({"__mask": once(mask), "__zone": F.when(several, F.upper(p[_ZONE])), "__region": F.when(several, p[_REGION]), "__digits": F.when(alone, F.length(t)).otherwise(0)})
    return df.drop("__t", "__p", "__time")


def by_reference(day_first: Column) -> Column:
    """The one local reading of __a and __b under the reference rules: the site's order, seconds up to SECOND_DIGITS."""
    a, b = F.col("__a"), F.col("__b")
    slashed = F.col("__mask").bitwiseAND(BIT["slash_dmy"] + BIT["slash_mdy"]) != 0
    return F.when(F.col("__digits") > 0, F.when(F.col("__digits") <= SECOND_DIGITS, a).otherwise(b)).when(slashed, F.when(day_first, a).when(~day_first, b)).otherwise(a)


def _as_utc(local: Column, tz: Column) -> Column:
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), tz))


def _from_utc(utc: Column, tz: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc), tz))


def _plain_utc(local: Column, tz: Column) -> Column:
    """The earlier instant at which a zone's clock shows ``local``, null where it never does."""
    at = _as_utc(local, tz)
    return F.when(_from_utc(at, tz) == local, at)


def utc_us(local: Column, tz: Column) -> Column:
    """UTC microseconds of one reading, beside the columns of with_readings.

    ``local`` are wall-clock microseconds, or the instant itself for digits alone; ``tz`` is the IANA zone of the row's
    site or null. An offset or Z in the text holds, with or without a region behind it; a region alone holds if it is
    the site's own. A zone abbreviation means the site's zone in standard or summer time as its letters say (UTC and
    GMT need no site). Without a zone the site's local time counts: twice-occurring times are the earlier instant,
    times that a clock change skips give null, and so does a row without a site.
    """
    zone, region = F.col("__zone"), F.col("__region")
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    offset_min = F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")
    year_us = F.unix_date(F.trunc(F.timestamp_micros(local).cast("date"), "year")).cast("long") * _DAY_US
    jan, jul = year_us + 14 * _DAY_US, year_us + 195 * _DAY_US
    off_jan, off_jul = jan - _as_utc(jan, tz), jul - _as_utc(jul, tz)
    summer = zone.rlike("^([A-Z]+DT|[CEW]EST|BST)$")
    named = local - F.when(summer, F.greatest(off_jan, off_jul)).otherwise(F.least(off_jan, off_jul))
    return (
        F.when(F.col("__digits") > 0, local)
        .when(zone.isin("Z", "UTC", "GMT", "UT"), local)
        .when(zone.rlike("^[+-]"), F.when(offset_min <= 18 * 60, local - sign * offset_min * F.lit(60_000_000).cast("long")))
        .when(zone != "", named)
        .when((region != "") & (region != F.coalesce(tz, F.lit(""))), F.lit(None).cast("long"))
        .otherwise(_plain_utc(local, tz))
    )


def clock_note(local: Column, tz: Column) -> Column:
    """What is unclear about a reading without a zone: 'no zone', 'skipped', 'repeated' (the earlier was taken) or null."""
    bare = (F.col("__digits") == 0) & (F.col("__zone") == "") & local.isNotNull()
    at = _plain_utc(local, tz)
    day_later = _as_utc(local, tz) + _DAY_US
    other = local - (_from_utc(day_later, tz) - day_later)
    return F.when(bare, F.when(tz.isNull(), "no zone").when(at.isNull(), "skipped").when((other != at) & (_from_utc(other, tz) == local), "repeated"))
