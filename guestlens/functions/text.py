"""Text helpers: words and star bars."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(c: Column | str) -> Column:
    """Words of a sentence (letters, digits, apostrophes)."""
    c = F.col(c) if isinstance(c, str) else c
    # Found, not split off: a split compiles its pattern anew for every value.
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}']+"), F.lit(0))


def star_bar(rating: Column | str) -> Column:
    """Five-star bar: full stars for the integer part, a half star when the
    fraction is at least .5, empty stars for the rest (rating clamped to 0..5)."""
    r = F.col(rating) if isinstance(rating, str) else rating
    r = F.least(F.greatest(F.coalesce(r.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(5.0))
    full = F.floor(r).cast("int")
    half = F.when(r - F.floor(r) >= 0.5, F.lit("½")).otherwise(F.lit(""))
    empty = F.greatest(F.lit(0), F.lit(5) - F.ceil(r).cast("int"))
    return F.concat(F.repeat(F.lit("★"), full), half, F.repeat(F.lit("☆"), empty))
