"""Scalar rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsift.operators.states import PRIORITIES


def clamp(value: Column, low: float, high: float) -> Column:
    if low > high:
        raise ValueError("low is above high")
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def backoff(n: Column, delay: float = 1.0, most: float = 60.0, multiplier: float = 2.0) -> Column:
    """The n-th delay (from 0) of growing ones, at most `most`."""
    if most < 0 or multiplier <= 0:
        raise ValueError("bad delays")
    return F.least(F.lit(float(most)), F.lit(float(delay)) * F.pow(F.lit(float(multiplier)), n))


def as_int(text: Column) -> Column:
    """Whole number of a text, decimals cut off; null for anything else."""
    return F.coalesce(text.try_cast("bigint"), F.when(text.rlike(r"^[+-]?[0-9]+[.][0-9]*$"), F.split_part(text, F.lit("."), F.lit(1)).try_cast("bigint")))


def version_string(parts: Column) -> Column:
    return F.array_join(parts, ".")


def millis_to_timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def fill(array: Column, n: int, filler: Column) -> Column:
    """Cut or padded to n items."""
    return F.slice(F.concat(array, F.array_repeat(filler, n)), 1, n)


def event_name(state: Column) -> Column:
    return F.concat(F.lit("on_"), F.lower(state))


def normalize_newlines(text: Column, newline: str = "\n") -> Column:
    """One kind of line end; the last one goes."""
    return F.regexp_replace(F.regexp_replace(text, r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n", newline)


def distance(ax: Column, ay: Column, bx: Column | None = None, by: Column | None = None) -> Column:
    zero = F.lit(0.0)
    dx, dy = F.coalesce(ax, zero) - (F.coalesce(bx, zero) if bx is not None else zero), F.coalesce(ay, zero) - (F.coalesce(by, zero) if by is not None else zero)
    return F.sqrt(dx * dx + dy * dy)


def extract(result: Column, key: str | None) -> Column:
    """Named part of a JSON result; null if it isn't there."""
    return result if key is None else F.get_json_object(result, f"$.{key}")


def failure_text(kind: Column, message: Column) -> Column:
    return F.when(kind.isNull(), F.concat(F.lit("Failure: "), message)).otherwise(F.concat(F.lit("Failure: "), kind, F.lit(": "), message))


def failure_check(types: Column, *names: str) -> Column:
    """The first of the names, in their order, that is among a failure's types; else null."""
    return F.coalesce(*[F.when(F.array_contains(types, n), n) for n in names])


def retry_decision(attempts: Column, most: int, revert_all: bool = False) -> Column:
    """RETRY while fewer than `most` attempts were made, else the way of giving up."""
    return F.when(attempts < most, "RETRY").otherwise("REVERT_ALL" if revert_all else "REVERT")


def map_columns(df, fn, requires: list[str], provides: list[str]):
    """A one-argument Column function on each named column."""
    if not isinstance(requires, (list, tuple)) or len(requires) != len(provides):
        raise ValueError("requires and provides must be lists of one length")
    return df.withColumns({p: fn(F.col(r)) for r, p in zip(requires, provides)})


def reduce_columns(df, fn, requires: list[str], provides: str):
    """Left fold of a two-argument Column function over named columns in order."""
    if len(requires) < 2:
        raise ValueError("a fold needs two columns or more")
    out = F.col(requires[0])
    for r in requires[1:]:
        out = fn(out, F.col(r))
    return df.withColumn(provides, out)


def multiply_table(df, columns: list[str], factor: float):
    """Every listed column times a factor; blanks count as 0.0."""
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) * factor for c in columns})


def extract_indexed(result: Column, index: Column) -> Column:
    """struct(status, value) of a JSON result under a JSON index; value as text.

    A null index takes the whole result, a number an item of a list (from the end if it is
    negative), a string the key of an object. Anything that isn't there is NOT_SUPPLIED;
    an item that is there and null is FOUND.
    """
    v, i = F.try_parse_json(result), F.try_parse_json(index)
    number, key = F.try_variant_get(i, "$", "bigint"), F.try_variant_get(i, "$", "string")
    word = index.startswith('"')
    items, fields = F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$", "map<string,variant>")
    at = F.when(number >= 0, number).otherwise(F.size(items) + number).cast("int")
    inside = F.coalesce(~word & (at >= 0) & (at < F.size(items)), F.lit(False))
    named = F.coalesce(word & F.map_contains_key(fields, key), F.lit(False))
    text = lambda x: F.try_variant_get(x, "$", "string")
    value = F.when(index.isNull(), result).when(inside, text(F.get(items, at))).when(named, text(F.try_element_at(fields, key)))
    return F.struct(F.when(index.isNull() | inside | named, "FOUND").otherwise("NOT_SUPPLIED").alias("status"), value.alias("value"))


def priority_convert(name: Column) -> Column:
    """One of the five priorities, whatever the case; null for another name."""
    return F.when(F.upper(name).isin(PRIORITIES), F.upper(name))


def failure_report(kind: Column, message: Column, traceback: Column) -> Column:
    """failure_text with the traceback below it, without blanks at its end, or the note that there is none."""
    block = F.rtrim(F.regexp_replace(traceback, r"\s+$", ""))
    given = F.concat(F.lit("\nTraceback (most recent call last):\n"), block)
    return F.concat(failure_text(kind, message), F.when(F.length(block) > 0, given).otherwise("\nTraceback not available."))


def failures_match(a: Column, b: Column) -> Column:
    """Same type names, arguments, message, traceback and causes of two failure structs; nulls match nulls."""
    same = F.lit(True)
    for field in ("exc_type_names", "exc_args", "exception_str", "traceback_str", "causes"):
        same = same & a[field].eqNullSafe(b[field])
    return same


def failures_check(failures: Column, *names: str) -> Column:
    """failure_check of the first failure of a list (arrays of type names) that has any of the names; null without one or without names."""
    if not names:
        return F.lit(None).cast("string")
    return F.get(F.filter(F.transform(failures, lambda types: failure_check(types, *names)), lambda found: found.isNotNull()), F.lit(0))


def is_near(value: Column, expected: Column, tolerance: float = 0.001) -> Column:
    """Within the tolerance on either side, the edges included."""
    return (value <= expected + tolerance) & (value >= expected - tolerance)


def times_decision(attempts: Column, most: int, revert_all: bool = False) -> Column:
    """struct(decision, value) of the policy of so many attempts; the value given to the next attempt is its number."""
    return F.struct(retry_decision(attempts, most, revert_all).alias("decision"), F.when(attempts < most, attempts + 1).cast("bigint").alias("value"))


def always_decision(revert_all: bool = False) -> Column:
    """struct(decision, value) of the policies that never try again."""
    return F.struct(F.lit("REVERT_ALL" if revert_all else "REVERT").alias("decision"), F.lit(None).cast("bigint").alias("value"))


def is_subset(a: Column, b: Column) -> Column:
    """Whether every item of a is in b."""
    return F.size(F.array_except(a, b)) == 0


def is_superset(a: Column, b: Column) -> Column:
    return is_subset(b, a)
