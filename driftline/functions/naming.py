"""Dates, tags, designations and observation lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.sky import lit

UNIX_EPOCH_JD = 2440587.5
MJD_OFFSET = 2400000.5


def jd_to_timestamp(jd: Column) -> Column:
    """UTC time of a Julian date; the session's time zone should be UTC."""
    return F.timestamp_micros(F.round((jd - lit(UNIX_EPOCH_JD)) * lit(86_400_000_000)).cast("long"))


def jd_to_date(jd: Column) -> Column:
    return F.date_from_unix_date(F.floor(jd - lit(UNIX_EPOCH_JD)).cast("int"))


def mjd_to_jd(mjd: Column) -> Column:
    return mjd + lit(MJD_OFFSET)


def base26(n: Column, letters: int = 7) -> Column:
    """A number as a fixed count of lower-case letters, most significant first."""
    digits = F.transform(
        F.sequence(F.lit(letters - 1), F.lit(0)),
        lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), 1, 26).substr(F.pmod(F.floor(n / F.pow(lit(26), i.cast("double"))), F.lit(26)).cast("int") + 1, F.lit(1)),
    )
    return F.array_join(digits, "")


def object_tag(n: Column, jd: Column, prefix: str = "FF") -> Column:
    """Public tag of an object: prefix, date of its reference epoch, running number in letters."""
    return F.concat(F.lit(prefix), F.date_format(jd_to_date(jd), "yyyyMMdd"), base26(n))


#: Letters of the half-months (I is left out), and of the order within one.
HALF_MONTHS = "ABCDEFGHJKLMNOPQRSTUVWXY"
SECOND_LETTERS = "ABCDEFGHJKLMNOPQRSTUVWXYZ"
CENTURIES = "IJKL"
CYCLE_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _pick(letters: str, at: Column) -> Column:
    return F.lit(letters).substr(at.cast("int") + 1, F.lit(1))


def packed_designation(date: Column, order: Column) -> Column:
    """Packed provisional designation of the ``order``-th object (from 0) of the date's half-month.

    25 objects share a cycle; cycles count in base 62 and 10, all different up to 620 of them. Null beyond.
    """
    century = _pick(CENTURIES, F.floor(F.year(date) / 100) - 18)
    half = _pick(HALF_MONTHS, (F.month(date) - 1) * 2 + F.when(F.dayofmonth(date) > 15, 1).otherwise(0))
    cycle = F.floor(order / 25)
    body = F.concat(
        century,
        F.lpad((F.year(date) % 100).cast("string"), 2, "0"),
        half,
        _pick(CYCLE_DIGITS, F.floor(cycle / 10)),
        (cycle % 10).cast("string"),
        _pick(SECOND_LETTERS, order % 25),
    )
    return F.when(cycle < 620, body)


def band_letter(fid: Column, default: str | None = None) -> Column:
    """Filter letter of a filter number; ``default`` for numbers without one (text sources have 0)."""
    return F.when(fid == 1, "g").when(fid == 2, "r").otherwise(F.lit(default))


def sexagesimal(ra: Column, dec: Column) -> Column:
    """``hh mm ss.ss +dd mm ss.ss``; seconds are rounded before they are split, so 59.995 carries over."""
    a = F.round(F.pmod(ra, lit(360)) / 15 * 360_000).cast("long") % (24 * 360_000)
    d = F.round(F.abs(dec) * 360_000).cast("long")

    def split(x: Column) -> Column:
        whole = F.floor(x / 360_000).cast("int")
        return F.format_string("%02d %02d %02d.%02d", whole, F.floor(x / 6000).cast("int") % 60, F.floor(x / 100).cast("int") % 60, (x % 100).cast("int"))

    sign = F.when(dec < 0, "-").otherwise("+")
    return F.concat(split(a), F.lit(" "), sign, split(d))


def from_sexagesimal(text: Column, hours: bool = False) -> Column:
    """Degrees of ``[+-]dd mm ss.s`` (or hours); the sign is read from the text, so ``-00 30 00`` is negative."""
    part = F.split(F.regexp_replace(F.trim(text), "^[+-]\\s*", ""), "[\\s:]+")
    value = sum((F.try_element_at(part, F.lit(i + 1)).try_cast("double") / 60**i for i in range(1, 3)), F.try_element_at(part, F.lit(1)).try_cast("double"))
    return F.when(F.trim(text).startswith("-"), -value).otherwise(value) * (15 if hours else 1)


def observation_date(jd: Column, mpc_compat: bool = True) -> Column:
    """``yyyy mm dd.ddddd`` of an observation.

    With ``mpc_compat`` the digits after the point are seconds of the day plus the hour, as in the files that
    existing solver inputs pin; without it they are the fraction of the day.
    """
    t = jd_to_timestamp(jd)
    seconds = F.hour(t) * 3600 + F.minute(t) * 60 + F.hour(t)
    days = F.date_format(t, "yyyy MM dd")
    if mpc_compat:
        return F.concat(days, F.lit("."), F.lpad(seconds.cast("string"), 5, "0"))
    fraction = F.floor(F.pmod(jd - lit(UNIX_EPOCH_JD), lit(1)) * 100_000).cast("string")
    return F.concat(days, F.lit("."), F.lpad(fraction, 5, "0"))


def mpc_line(designation: Column, jd: Column, ra: Column, dec: Column, mag: Column, fid: Column, first: Column, station: str = "I41", mpc_compat: bool = True) -> Column:
    """An 80-column observation line; a discovery asterisk marks the first line of an object."""
    line = F.concat(
        F.lit("     "), F.rpad(designation, 7, " "),
        F.when(first, "*").otherwise(" "), F.lit(" C"),
        F.rpad(observation_date(jd, mpc_compat), 17, " "),
        sexagesimal(ra, dec),
        F.lit("        "), F.format_string("%5.1f", mag), F.lit(" "), band_letter(fid, "r"),
    )
    return F.concat(F.rpad(line, 77, " "), F.lit(station))
