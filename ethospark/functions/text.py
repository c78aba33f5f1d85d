"""Text of labels, names, times and notes, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def alias(name: Column, aliases: dict[str, str]) -> Column:
    """The canonical spelling of a name; names without an alias keep their own, trimmed."""
    clean = F.trim(name)
    return F.coalesce(*[F.when(F.lower(clean) == k.lower(), F.lit(v)) for k, v in aliases.items()], clean) if aliases else clean


def first_of(text: Column, separator: str) -> Column:
    """What stands before the first separator."""
    return F.trim(F.substring_index(text, separator, 1))


def whole_numbers(text: Column) -> Column:
    """A comma list to its distinct whole numbers in ascending order; what isn't a number is left out."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("bigint"))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x.isNotNull())))


def sorted_names(text: Column, separator: str = ",") -> Column:
    """A list of names in order, each once."""
    parts = F.transform(F.split(text, separator), lambda x: F.trim(x))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))), ", ")


def unique_join(values: Column, separator: str = " | ") -> Column:
    """An array's distinct values that aren't empty, joined in order."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (F.trim(x) != "")))), separator)


def found_names(text: Column, names: list[str]) -> Column:
    """Those of a fixed list of names that a note mentions as words, in the list's order."""
    hits = F.array(*[F.when(F.lower(text).rlike(rf"(^|[^\p{{L}}]){n.lower()}([^\p{{L}}]|$)"), F.lit(n)) for n in names])
    return F.filter(hits, lambda x: x.isNotNull())


def room_kind(has: Column, others: Column) -> Column:
    """with, without, both or other, from whether a day's notes name the animal with and without company."""
    return F.when(has & others, "both").when(has, "with").when(others, "without").otherwise("other")


def entropy(probabilities: Column) -> Column:
    """Shannon entropy (natural logarithm) of an array of probabilities."""
    return F.aggregate(probabilities, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log(p)).otherwise(0.0))


def softmax(scores: Column) -> Column:
    return F.transform(scores, lambda x: F.exp(x - F.array_max(scores)) / F.aggregate(F.transform(scores, lambda y: F.exp(y - F.array_max(scores))), F.lit(0.0), lambda s, y: s + y))


def coalesce_labels(columns: list[str], present: list[str]) -> Column:
    """The first of several label columns, in order of precedence, that a file has and that isn't null."""
    return reduce(lambda a, b: F.coalesce(a, b), [F.col(c) for c in columns if c in present], F.lit(None).cast("string"))


def ordered_union(values: Column) -> Column:
    """An array's distinct values that aren't empty, in the order in which they first come."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (F.trim(x) != "")))
