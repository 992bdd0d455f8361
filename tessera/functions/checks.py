"""Strict parsing and duplicate rules, as column expressions that raise at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LONG_MAX = 2**63 - 1


def checked(condition: Column, value: Column, kind: str, message: Column | str) -> Column:
    """``value`` where the condition holds; elsewhere (null included) the query fails with the message."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(condition, F.lit(False)), value.cast(kind)).otherwise(F.raise_error(text).cast(kind))


def told(what: str, line: Column) -> Column:
    return F.concat(F.lit(f"{what}: "), F.coalesce(line, F.lit("(null)")))


def positive_id(text: Column, what: str, line: Column, loose: bool = False) -> Column:
    """A positive 64-bit id; leading zeros pass only where ``loose``."""
    cleaned = F.trim(text)
    pattern = r"^[0-9]+$" if loose else r"^[1-9][0-9]*$"
    value = F.when(cleaned.rlike(pattern), cleaned).try_cast("long")
    return checked(value > 0, value, "long", told(f"{what} must be a positive 64-bit integer", line))


def star_rating(text: Column, line: Column, plain: bool = False) -> Column:
    """An integer rating from 1 to 5; a sign and leading zeros pass unless ``plain``."""
    cleaned = F.trim(text)
    value = F.when(cleaned.rlike(r"^[1-5]$" if plain else r"^[+-]?[0-9]+$"), cleaned).try_cast("int")
    return checked(value.between(1, 5), value, "int", told("rating must be an integer from 1 to 5", line))


def iso_date(text: Column, line: Column) -> Column:
    """A date that is written exactly YYYY-MM-DD, year 1 at least."""
    cleaned = F.trim(text)
    value = F.when(cleaned.rlike(r"^(?!0000)\d{4}-\d{2}-\d{2}$"), cleaned).try_cast("date")
    return checked(value.isNotNull(), value, "date", told("date must be YYYY-MM-DD", line))


def count_text(text: Column, what: str, line: Column, least: int = 1) -> Column:
    value = F.when(F.trim(text).rlike(r"^[0-9]+$"), F.trim(text)).try_cast("long")
    return checked(value >= least, value, "long", told(f"{what} must be an integer of {least} or more", line))


def unit_text(text: Column, what: str, line: Column, low: float | None, high: float | None, above: bool = False) -> Column:
    """A finite double, within bounds where given; ``above``: the low bound itself is out."""
    value = F.trim(text).try_cast("double")
    fine = ~F.isnan(value) & (F.abs(value) < float("inf"))
    if low is not None:
        fine = fine & ((value > low) if above else (value >= low))
    if high is not None:
        fine = fine & (value <= high)
    return checked(fine, value, "double", told(f"{what} is out of range", line))


def one_per_key(df: DataFrame, key: list[str], identity: list[str], what: str, identical: str = "ignore", conflicting: str = "fail") -> DataFrame:
    """One row per key. Rows with equal ``identity`` are repeated, with another one conflicting.

    ``identical``: ignore or fail. ``conflicting``: fail, or keep (all of them stay). Columns beyond key and
    identity are those of the least identity row. One aggregation with map-side combining; no rows of a key
    are gathered.
    """
    rest = [c for c in df.columns if c not in key]
    payload = F.struct(*[F.col(c) for c in identity], *[F.col(c) for c in rest if c not in identity])
    if conflicting == "keep":
        return df.groupBy(*key, *identity).agg(F.min(payload).alias("__row")).select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest])
    name = F.concat_ws(",", *[F.col(c).cast("string") for c in key])
    if len(identity) == 1 and identity == rest:
        # one plain column: its least and its greatest value, which take less of a shuffle than structs
        one = F.col(identity[0])
        grouped = df.groupBy(*key).agg(F.min(one).alias("__low"), F.max(one).alias("__high"), F.count(one).alias("__set"), F.count("*").alias("__n")).withColumn("__row", F.struct(F.col("__low").alias(identity[0])))
        fine = F.col("__low").eqNullSafe(F.col("__high")) & F.col("__set").isin(F.lit(0), F.col("__n"))
    else:
        same = F.struct(*[F.col(c) for c in identity])
        grouped = df.groupBy(*key).agg(F.min(payload).alias("__row"), F.min(same).alias("__low"), F.max(same).alias("__high"), F.count("*").alias("__n"))
        fine = F.col("__low").eqNullSafe(F.col("__high"))
    if identical == "fail":
        fine = fine & (F.col("__n") == 1)
    first = F.when(fine, F.col(key[0])).otherwise(F.raise_error(F.concat(F.lit(f"{what} for "), name)).cast(df.schema[key[0]].dataType))
    return grouped.select(first.alias(key[0]), *key[1:], *[F.col(f"__row.{c}").alias(c) for c in rest])


def must_be_empty(df: DataFrame, message: str) -> None:
    """Runs ``df`` up to its first row and fails if there is one."""
    found = df.limit(1).collect()
    if found:
        raise ValueError(f"{message}: {found[0].asDict()}")
