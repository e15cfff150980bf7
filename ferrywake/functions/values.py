"""Numbers out of variants, and the arithmetic of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3_600_000
#: The wrappers that extended notation puts around numbers.
_WRAPPERS = ("$numberLong", "$numberInt", "$numberDouble", "$numberDecimal")


def at(variant: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(variant, path, kind)


def kind_of(variant: Column) -> Column:
    return F.schema_of_variant(variant)


def is_number(variant: Column) -> Column:
    return kind_of(variant).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$")


def _number_text(variant: Column) -> Column:
    """The text of a number, bare or wrapped; null for all else."""
    wrapped = F.coalesce(*[at(variant, f'$["{w}"]', "string") for w in _WRAPPERS])
    return F.when(is_number(variant), variant.cast("string")).when(kind_of(variant).startswith("OBJECT"), wrapped)


def _once(x: Column, use) -> Column:
    """use(x), with x computed once however often it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def whole_number(text: Column) -> Column:
    """The whole number that a decimal text (with or without a fraction and an exponent) stands for, exactly; null if it is
    none or leaves a long."""
    form = r"^([+-]?)([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]{1,6}))?$"

    def value(t: Column) -> Column:
        sign, left, right, power = (F.regexp_extract(t, form, i) for i in range(1, 5))
        digits = F.concat(left, right)
        kept = F.regexp_replace(digits, "0+$", "")
        # zeros to put behind the digits that are left; fewer than none: there is a fraction
        zeros = F.coalesce(power.try_cast("int"), F.lit(0)) - F.length(right) + F.length(digits) - F.length(kept)
        number = F.when(zeros.between(0, 19), F.concat(sign, kept, F.repeat(F.lit("0"), zeros)).try_cast("bigint"))
        return F.when(t.rlike(form) & (digits != ""), F.when(kept == "", F.lit(0).cast("bigint")).otherwise(number))

    return _once(text, lambda t: F.coalesce(F.when(t.rlike(r"^[0-9]{1,18}$"), t.try_cast("bigint")), value(t)))


def exact_long(variant: Column) -> Column:
    """A whole number from 0 to the largest long, as a number, a wrapped number or digits in a string; else null."""
    text = F.when(kind_of(variant) == "STRING", variant.cast("string"))
    digits = _once(text, lambda t: F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint")))
    found = F.coalesce(whole_number(F.coalesce(_number_text(variant), F.expr("CAST(NULL AS STRING)"))), digits)
    return _once(found, lambda n: F.when(n >= 0, n))


def count_of(variant: Column) -> Column:
    """A number of at least 0 without its fraction; strings and other values are null."""
    value = _number_text(variant).try_cast("double")
    whole = _number_text(variant).try_cast("bigint")
    long = F.coalesce(whole, F.when(F.isnan(value), F.lit(0)).otherwise(value.try_cast("bigint")))
    return F.when(long >= 0, long)


def floor_to(ms: Column, width: int | Column) -> Column:
    width = F.lit(width) if isinstance(width, int) else width
    return (F.floor(ms / width) * width).cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b)


def average(total: Column, n: Column) -> Column:
    """total / n in double precision from whole sums, so that the order of rows does not matter."""
    return F.when(n > 0, total.cast("double") / n.cast("double"))
