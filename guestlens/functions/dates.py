"""Date parsing and display."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from guestlens.schemas import DISPLAY_DATE_FORMAT, ISO_DATE_FORMAT


def parse_iso(c: Column | str) -> Column:
    """ISO ``2024-08-03T15:53:00Z`` -> timestamp; NULL when missing or malformed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(c, F.lit(ISO_DATE_FORMAT))


def to_iso(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, ISO_DATE_FORMAT)


def display_date(c: Column | str) -> Column:
    """Timestamp -> ``August 03, 2024 at 03:53 PM UTC``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, DISPLAY_DATE_FORMAT)


def minute_key(c: Column | str) -> Column:
    """The sort key of the display string: dates compare at minute resolution."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_trunc("minute", c)
