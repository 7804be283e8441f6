"""Column functions: scores, bandit formulas, cleaning, names, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first number of a text, and words of yes and no; fixed values.
NUMBER = r"[-+]?(?:\d+(?:\.\d+)?|\.\d+)"
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y", "t"), ("false", "0", "no", "n", "f")
#: Units of a second; fixed values.
UNITS = {"s": 1.0, "ms": 1e3, "us": 1e6, "ns": 1e9, "hr": 1 / 3600}


def relu(x: Column) -> Column:
    """x, 0 if it is negative."""
    return F.greatest(F.lit(0.0), x.cast("double"))


def softmax_at(xs: Column, index: int) -> Column:
    """The share of one entry of an array under softmax."""
    ds = F.transform(xs, lambda x: x.cast("double"))
    top = F.array_max(ds)
    total = F.aggregate(ds, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.exp(F.get(ds, F.lit(index)) - top) / total


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def draw_key(element_id: Column, seed: int = 42) -> Column:
    """A random-looking order that any engine can repeat: the MD5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), element_id.cast("string")))


def epsilon(alpha: Column, itr: Column) -> Column:
    """Share of exploring draws after `itr` scored elements."""
    return alpha * F.pow(itr / 25, F.lit(-1.0 / 3.0))


def ucb(mean: Column, parent_count: Column, itr: Column, c: float = 1.0) -> Column:
    """Upper confidence bound of a child; by default the bonus has the parent's count, pass the child's for the other form."""
    return mean + F.lit(c) * F.sqrt(F.log(itr) / parent_count)


def first_number(text: Column) -> Column:
    """The first numeric token, null if there is none."""
    return F.regexp_extract(F.trim(text), NUMBER, 0).try_cast("double")


def boolish(text: Column) -> Column:
    """1.0 or 0.0 for words of yes and no in any case, else null."""
    w = F.lower(F.trim(text))
    return F.when(w.isin(*TRUE_WORDS), 1.0).when(w.isin(*FALSE_WORDS), 0.0)


def uid(name: Column) -> Column:
    """What follows the first underscore of a file name, without extension; the whole name without extension if there is none."""
    base = F.regexp_replace(F.substring_index(name, "/", -1), "[.][^.]*$", "")
    return F.when(base.contains("_"), F.regexp_replace(base, "^[^_]*_", "")).otherwise(base)


def label_prefix(name: Column) -> Column:
    """The number before the first underscore, 0 if it is none."""
    return F.coalesce(F.substring_index(name, "_", 1).try_cast("int"), F.lit(0))


def positive_ints(text: Column) -> Column:
    """The positive numbers of a list such as "25,50 100"."""
    numbers = F.transform(F.split(F.trim(text), "[, ]+"), lambda x: x.try_cast("int"))
    return F.filter(numbers, lambda x: x > 0)


def in_unit(seconds: Column, unit: str) -> Column:
    return seconds * F.lit(UNITS[unit])
