"""Text, category and small numeric helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from clicktrail.schemas import CATEGORY_LEVELS

# Texts that stand for a missing brand or category.
UNKNOWN_BRAND = "Unknown brand"
UNKNOWN_CATEGORY = "Unknown category"


def category_levels(code: Column) -> dict:
    """First three dotted parts of a category code, NULL where there are fewer."""
    parts = F.split(code, "[.]")
    return {name: F.get(parts, F.lit(i)) for i, name in enumerate(CATEGORY_LEVELS)}


def session_text_id(user: Column, session: Column) -> Column:
    """``user_session``; the separator keeps (1, 11) and (11, 1) apart."""
    return F.concat_ws("_", user.cast("string"), session.cast("string"))


def copy_suffix(copy_no: Column) -> Column:
    """Suffix of the n-th replica (``D0`` for copy 1), empty for the original."""
    return F.when(copy_no > 0, F.concat(F.lit("D"), (copy_no - 1).cast("string"))).otherwise(F.lit(""))


def strip_copy_suffix(text_id: Column) -> Column:
    return F.regexp_replace(text_id, "D[0-9]+$", "")


def as_int(flag: Column) -> Column:
    return flag.cast("int")


def oversample_rate(ratio: Column, divisor: int = 8) -> Column:
    """How many copies of the minority to add for a minority/majority ratio.

    The inverse ratio is rounded half to even, divided and cut to an integer;
    0 when a class is empty.
    """
    inverse = F.bround(F.try_divide(F.lit(1.0), ratio))
    return F.coalesce(F.greatest((inverse / F.lit(divisor)).cast("int"), F.lit(0)), F.lit(0))


def seeded_digest(seed, *key: Column) -> Column:
    """md5 of seed and key: the same order in every engine and every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.concat_ws("_", *[k.cast("string") for k in key])))
