"""Text and number-in-text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def finite(c: Column) -> Column:
    """The double, or null when it is NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def text_number(c: Column) -> Column:
    """A number written as text; null for anything else."""
    t = F.trim(c)
    return F.when(t.rlike(NUMBER), finite(t.try_cast("double")))


def title_label(text: Column) -> Column:
    """``order_total`` -> ``Order Total``; the rest of each word keeps its case (unlike initcap)."""
    words = F.filter(F.split(F.trim(F.replace(text, F.lit("_"), F.lit(" "))), r"\s+"), lambda w: w != "")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " "
    )


def truncate_middle(text: Column, max_length: int = 50) -> Column:
    """Keep both ends around ``...`` when the text is longer than ``max_length``."""
    left = (max_length - 3) // 2
    right = max_length - 3 - left
    cut = F.concat(F.substring(text, 1, left), F.lit("..."), F.right(text, F.lit(right)))
    return F.when(F.length(text) > max_length, cut).otherwise(text)


def estimate_tokens(text: Column) -> Column:
    """About four characters per token."""
    return F.ceil(F.length(text) / 4.0).cast("long")


def natural_key(text: Column) -> Column:
    """Sort key: case-insensitive, digit runs compared as numbers."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))

    def part(run: Column) -> Column:
        digits = F.regexp_replace(run, r"^0+(?=\d)", "")
        return F.when(
            run.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)
        ).otherwise(run)

    return F.transform(runs, part)


def coerce_boolean(text: Column) -> Column:
    """Booleans in their common spellings, else null."""
    t = F.lower(F.trim(text.cast("string")))
    return F.when(t.isin("true", "t", "yes", "1"), True).when(t.isin("false", "f", "no", "0"), False)
