"""Time formats in the notation of strptime, ISO 8601 and UNIX times, as columns of timestamps."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.rules import RuleError

_LETTERS = {"Y": "yyyy", "y": "yy", "m": "M", "d": "d", "H": "H", "I": "h", "M": "m", "S": "s", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "z": "z", "Z": "z", "j": "D", "%": "%"}
_ISO = r"^(\d{4})-?(\d\d)-?(\d\d)(?:[T ](\d\d)(?::?(\d\d)(?::?(\d\d)(?:[.,](\d{1,9}))?)?)?)?\s*(Z|z|[+-]\d\d(?::?\d\d)?)?$"


def java_format(pattern: str) -> str:
    """A strptime pattern in the letters of Spark."""
    out, i, text = "", 0, ""

    def flush() -> str:
        return "'" + text.replace("'", "''") + "'" if any(c.isalpha() or c == "'" for c in text) else text

    while i < len(pattern):
        if pattern[i] == "%" and i + 1 < len(pattern):
            letter = _LETTERS.get(pattern[i + 1])
            if letter is None:
                raise RuleError(f"%{pattern[i + 1]} isn't a known part of a time format")
            if letter == "%":
                text += "%"
            else:
                out += flush() + letter
                text = ""
            i += 2
            continue
        text += pattern[i]
        i += 1
    return out + flush()


def iso(value: Column, zone: str) -> Column:
    """ISO 8601 in its extended and basic forms; times without offset are in ``zone``."""
    part = lambda i: F.regexp_extract(value, _ISO, i)
    clock = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), F.when(part(4) != "", part(4)).otherwise(F.lit("00")), F.lit(":"), F.when(part(5) != "", part(5)).otherwise(F.lit("00")), F.lit(":"), F.when(part(6) != "", part(6)).otherwise(F.lit("00")), F.lit("."), F.rpad(F.substring(part(7), 1, 6), 6, "0"))
    offset = F.when(part(8).isin("Z", "z"), F.lit("+00:00")).otherwise(F.when(F.length(part(8)) == 3, F.concat(part(8), F.lit(":00"))).when(F.length(part(8)) == 5, F.concat(F.substring(part(8), 1, 3), F.lit(":"), F.substring(part(8), 4, 2))).otherwise(part(8)))
    naive = F.try_to_timestamp(F.concat(clock, F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSSxxx"))
    aware = F.try_to_timestamp(F.concat(clock, offset), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSSxxx"))
    return F.when(value.rlike(_ISO), F.when(part(8) != "", aware).otherwise(F.to_utc_timestamp(naive, zone) if zone.upper() not in ("UTC", "Z") else naive))


def unix(value: Column) -> Column:
    """Seconds, milli-, micro- or nanoseconds by the number of digits; seconds may have decimals."""
    whole = F.regexp_extract(value, r"^\s*(-?\d+)", 1)
    n = whole.try_cast("long")
    size = F.length(F.regexp_replace(whole, "-", ""))
    micros = F.when(size <= 10, F.round(value.try_cast("decimal(28,9)") * 1000000).cast("long")).when(size <= 13, n * 1000).when(size <= 16, n).otherwise(F.floor(n / 1000).cast("long"))
    return F.when(value.rlike(r"^\s*-?\d{1,19}(\.\d+)?\s*$"), F.timestamp_micros(micros))


def parsed(value: Column, pattern: str, zone: str) -> Column:
    """A timestamp, null where the text doesn't fit the format. A year that is missing is the current one."""
    if pattern == "ISO8601":
        return iso(value, zone)
    if pattern == "UNIX":
        return unix(value)
    java, text = java_format(pattern), value
    if "%Y" not in pattern and "%y" not in pattern:
        java, text = "yyyy " + java, F.concat(F.date_format(F.current_timestamp(), "yyyy"), F.lit(" "), value)
    text = F.regexp_replace(text, r"\s+", " ")
    if "%z" in pattern or "%Z" in pattern:
        # offsets without a colon, with one, and Z; names of zones
        forms = [java.replace("z", x) for x in ("xx", "xxx", "X", "z")]
        return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in forms))
    if "%f" in pattern:
        forms = [java.replace("SSSSSS", "S" * n) for n in (6, 3, 1, 2, 4, 5)]
        naive = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in forms))
    else:
        naive = F.try_to_timestamp(text, F.lit(java))
    return naive if zone.upper() in ("UTC", "Z") else F.to_utc_timestamp(naive, zone)


def shown(moment: Column, zone: str) -> Column:
    """ISO 8601 in a time zone; Z for UTC, and microseconds only where there are any."""
    utc = zone.upper() in ("UTC", "Z")
    local = moment if utc else F.from_utc_timestamp(moment, zone)
    text = F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(moment), F.lit(1000000))
    text = F.concat(text, F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(F.lit("")))
    if utc:
        return F.concat(text, F.lit("Z"))
    minutes = ((F.unix_micros(local) - F.unix_micros(moment)) / 60000000).cast("int")
    sign = F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+"))
    offset = F.concat(sign, F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))
    return F.concat(text, F.when(minutes == 0, F.lit("Z")).otherwise(offset))
