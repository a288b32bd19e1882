"""Event dates: written dates, plausibility, and the choice between a recording's date and its file's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Years of plausible dates; days by which a recording's date may be older or newer than its file.
FIRST_YEAR, LAST_YEAR, OLDEST_DAYS, NEWEST_DAYS = 1980, 2200, 730, 7


def parse(text: Column) -> Column:
    """The date that a text writes as year, month, day or day, month, year, parted by slashes or dashes; null if it isn't one.

    The first number is the year if it has four digits or more.
    """
    parts = F.transform(F.split(text, F.when(text.contains("/"), "/").otherwise("-"), -1), lambda x: F.trim(x))
    number = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    whole = (F.size(parts) == 3) & F.forall(parts, lambda x: x.rlike("^[+]?[0-9]{1,9}$"))
    first = number(0) >= 1000
    year, day = F.when(first, number(0)).otherwise(number(2)), F.when(first, number(2)).otherwise(number(0))
    return F.when(whole, F.try_make_timestamp(year, number(1), day, F.lit(0), F.lit(0), F.lit(0)).cast("date"))


def plausible(date: Column) -> Column:
    return F.year(date).between(FIRST_YEAR, LAST_YEAR)


def select(recorded: Column, source: Column, created: Column) -> Column:
    """Struct selected, source, warning: the recording's own date unless the file's rejects it as far older or newer."""
    age = F.datediff(created, recorded)
    told = lambda days, how: F.format_string(f"rejected %s date %s: %d days {how} than file creation", source, F.date_format(recorded, "yyyy-MM-dd"), days)
    warning = F.when(age >= OLDEST_DAYS, told(age, "older")).when(-age > NEWEST_DAYS, told(-age, "newer"))
    own = recorded.isNotNull() & warning.isNull()
    by_file = F.when(created.isNotNull(), F.lit("file_created_at"))
    return F.struct(F.when(own, recorded).otherwise(created).alias("selected"), F.when(own, source).otherwise(by_file).alias("source"), warning.alias("warning"))
