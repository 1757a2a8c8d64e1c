"""Date, string, lookup and JSON column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.schema import EVENT, ITEM_ID, TS, USER_ID, VALUE

# Results depend on exactly these.
LN2 = 0.693147
YEAR_IN_TITLE = r"\((\d{4})\)"
DAY_FORMAT = "dd/MM/yyyy"


def epoch_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def parse_day(text: Column, fmt: str = DAY_FORMAT) -> Column:
    """Day string to timestamp; null (not an error) when it does not parse."""
    return F.try_to_timestamp(text, F.lit(fmt))


def parse_iso(text: Column) -> Column:
    """ISO-8601 string, with or without fraction and offset, to timestamp; null when malformed."""
    return F.try_to_timestamp(text)


def empty_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def to_double(text: Column) -> Column:
    return empty_to_null(text).try_cast("double")


def title_year(title: Column) -> Column:
    """Year from ``Title (1995)`` as double, null when there is none."""
    return to_double(F.regexp_extract(title, YEAR_IN_TITLE, 1))


def lenient_int(text: Column) -> Column:
    """``"3"``, ``" 3.0"`` and ``"3.9"`` give 3; anything that is no finite number gives null."""
    return F.trim(text).try_cast("double").try_cast("int")


def first_flag(flags: Mapping[str, Column], default: str = "unknown") -> Column:
    """Name of the first flag that equals 1, in mapping order."""
    hits = F.array_compact(F.array(*[F.when(flag == 1, F.lit(name)) for name, flag in flags.items()]))
    return F.coalesce(F.get(hits, 0), F.lit(default))


def lookup(code: Column, names: Mapping) -> Column:
    """Value of a literal map; null for codes it does not hold."""
    pairs = [F.lit(x) for entry in names.items() for x in entry]
    return F.create_map(*pairs)[code]


def age_days(ts: Column, reference: datetime | date) -> Column:
    """Whole calendar days from ``ts`` to ``reference``; negative for later timestamps."""
    return F.datediff(F.lit(reference), ts)


def decay(age: Column, halflife_days: float = 30.0) -> Column:
    return F.exp(F.lit(-(LN2 / halflife_days)) * age)


def interaction_weight(value: Column) -> Column:
    """Missing and NaN values weigh 1."""
    return F.coalesce(F.nanvl(value, F.lit(1.0)), F.lit(1.0))


def contains_all(basket: Column, wanted: Column) -> Column:
    """True when every element of ``wanted`` is in ``basket``; a null on either side gives false."""
    return F.coalesce(F.size(F.array_except(wanted, basket)) == 0, F.lit(False))


def event_json(user: Column, item: Column, value: Column, ts: Column) -> Column:
    """One interaction as its JSON message; a null value is written as null."""
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    body = F.struct(
        user.alias(USER_ID), item.alias(ITEM_ID), value.alias(VALUE), iso.alias(TS)
    )
    return F.to_json(body, {"ignoreNullFields": "false"})


def event_from_json(message: Column) -> Column:
    """Message (string or bytes) to a struct; a malformed message gives a struct of nulls."""
    return F.from_json(message.cast("string"), EVENT)
