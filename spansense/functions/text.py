"""Small text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that show nothing. White space, separators, controls and format characters, and the fillers of other categories.
INVISIBLE = r"\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}"
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


def has_text(text: Column) -> Column:
    """True if the text holds more than white space and invisible characters; false for null."""
    return F.coalesce(text.rlike(f"[^{INVISIBLE}]"), F.lit(False))


def strip(text: Column) -> Column:
    """The text without white space, of any alphabet, at either end."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def instant(spelling: Column) -> Column:
    """The instant in a spelling of a time, else null.

    Read are milliseconds (13 digits) or seconds (10 digits) of the epoch and ISO 8601 dates with a time, ``T`` or a blank between them, an optional
    fraction and a zone, before which a blank may stand; a spelling without a zone counts as UTC. Impossible dates give null.
    """
    s = strip(spelling)
    iso = r"(?i)^(\d{4}-\d{2}-\d{2})[t ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?) ?(z|[+-]\d{2}:?\d{2})?$"
    zone = F.regexp_replace(F.upper(F.regexp_extract(s, iso, 3)), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    spelled = F.concat(F.regexp_extract(s, iso, 1), F.lit(" "), F.regexp_extract(s, iso, 2), F.when(zone == "", F.lit("Z")).otherwise(zone))
    return (
        F.when(s.rlike(r"^\d{13}$"), F.timestamp_millis(s.try_cast("bigint")))
        .when(s.rlike(r"^\d{10}$"), F.timestamp_seconds(s.try_cast("bigint")))
        .when(s.rlike(iso), spelled.try_cast("timestamp"))
    )
