"""Scalar expressions: text, parsing, formatting and small numeric helpers, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(text: Column, max_len: int = 60) -> Column:
    """Lower-case dashed name; word characters are Unicode ones; ``match`` if nothing is left."""
    kept = F.lower(F.trim(F.regexp_replace(text, r"(?U)[^\w\s-]", "")))
    dashed = F.regexp_replace(F.substring(F.regexp_replace(kept, r"(?U)[\s_-]+", "-"), 1, max_len), "^-+|-+$", "")
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit("match"))


def frame_key(slug: Column, frame: Column) -> Column:
    return F.format_string("%s_%06d", slug, frame)


def rational(text: Column) -> Column:
    """``30000/1001`` to four digits; zero denominators and other texts are null."""
    parts = F.split(text, "/")
    return F.round(F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("double")), 4)


def minutes_seconds(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


def span_bounds(text: Column) -> Column:
    """``START:END`` as a struct; other texts give null bounds."""
    found = F.split(text, ":")
    fits = F.size(found) == 2
    return F.struct(F.when(fits, F.get(found, F.lit(0)).try_cast("long")).alias("start"), F.when(fits, F.get(found, F.lit(1)).try_cast("long")).alias("end"))


def wrap(text: Column, width: int) -> Column:
    """Greedy word wrap to lines of at most ``width`` characters; longer words stand alone."""
    state = F.aggregate(
        F.filter(F.split(text, " "), lambda w: w != ""),
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line")),
        lambda s, w: F.when(s["line"] == "", F.struct(s["done"].alias("done"), w.alias("line")))
        .when(F.length(s["line"]) + 1 + F.length(w) <= width, F.struct(s["done"].alias("done"), F.concat_ws(" ", s["line"], w).alias("line")))
        .otherwise(F.struct(F.array_append(s["done"], s["line"]).alias("done"), w.alias("line"))),
    )
    return F.when(state["line"] == "", state["done"]).otherwise(F.array_append(state["done"], state["line"]))


def hex_colour(text: Column) -> Column:
    """``#rrggbb`` as red, green and blue."""
    part = lambda at: F.conv(F.substring(text, at, 2), 16, 10).cast("int")
    return F.struct(part(2).alias("red"), part(4).alias("green"), part(6).alias("blue"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def missing_if_nan(x: Column) -> Column:
    """NaN is larger than every number in Spark; measurements treat it as missing."""
    return F.nanvl(x, F.lit(None).cast("double"))


def hellinger(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), 1 - same))


def correlation_distance(a: Column, b: Column) -> Column:
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    mean = lambda xs: total(xs) / F.size(xs)
    da, db = F.transform(a, lambda x: x - mean(a)), F.transform(b, lambda x: x - mean(b))
    top = total(F.zip_with(da, db, lambda x, y: x * y))
    bottom = F.sqrt(total(F.transform(da, lambda x: x * x)) * total(F.transform(db, lambda x: x * x)))
    return 1 - F.coalesce(F.try_divide(top, bottom), F.lit(0.0))
