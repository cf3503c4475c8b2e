"""Class algebra on the vector table: combining, dropping and converting classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathe.plans.skew import shuffled

PREFIX = "prob_of_class_"


def _prob(name: str) -> Column:
    return F.col(f"`{PREFIX}{name}`")


def grouping(groups: Sequence[str | Sequence[str]], names: Sequence[str] | None, known: Sequence[str]) -> dict[str, list[str]]:
    """New name -> old classes; names default to the members joined by '+'. Raises for unknown, repeated or unequal input."""
    lists = [[g] if isinstance(g, str) else list(g) for g in groups]
    names = ["+".join(g) for g in lists] if names is None else list(names)
    used = [c for g in lists for c in g]
    if len(names) != len(lists):
        raise ValueError("one name for each group of classes")
    if len(set(names)) != len(names):
        raise ValueError("names of new classes must be distinct")
    if len(set(used)) != len(used):
        raise ValueError("a class can be used once")
    if unknown := set(used) - set(known):
        raise ValueError(f"unknown classes: {sorted(unknown)}")
    return dict(zip(names, lists))


def combine_categorical(vectors: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Rows of the kept classes with their new class in ``type`` and the old one in ``orig_type``."""
    table = F.create_map(*[F.lit(x) for new, olds in groups.items() for old in olds for x in (old, new)])
    rows = vectors.withColumn("orig_type", F.col("type")).withColumn("type", F.try_element_at(table, F.col("type")))
    return rows.where(F.col("type").isNotNull())


def combine_soft(vectors: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Sums the members of each new class and divides by the sum over all kept; rows where that is 0 go.

    ``most_likely_class`` lists the classes of the greatest probability above 0, comma-joined in the order given.
    """
    zero = F.lit(0.0)
    sums = {new: sum((F.coalesce(_prob(c).cast("double"), zero) for c in olds), zero) for new, olds in groups.items()}
    old = [c for c in vectors.columns if c.startswith(PREFIX)]
    rows = vectors.select(*[F.col(f"`{c}`") for c in vectors.columns if c not in old], *[s.alias(f"__sum_{k}") for k, s in enumerate(sums.values())])
    total = sum((F.col(f"__sum_{k}") for k in range(len(sums))), zero)
    rows = rows.withColumn("__all", total).where("__all > 0")
    rows = rows.select("*", *[(F.col(f"__sum_{k}") / F.col("__all")).alias(f"{PREFIX}{new}") for k, new in enumerate(sums)])
    rows = rows.drop("__all", *[f"__sum_{k}" for k in range(len(sums))])
    best = F.greatest(*[_prob(n) for n in sums]) if len(sums) > 1 else _prob(next(iter(sums)))
    top = F.array(*[F.when((_prob(n) == best) & (_prob(n) > 0), F.lit(n)) for n in sums])
    return rows.withColumn("most_likely_class", F.array_join(F.array_compact(top), ","))


def soft_to_categorical(vectors: DataFrame, classes: Sequence[str]) -> DataFrame:
    """``type`` becomes the class of the greatest probability, the first of equals; the probabilities go."""
    best = F.greatest(*[_prob(c) for c in classes]) if len(classes) > 1 else _prob(classes[0])
    kind = F.coalesce(*[F.when(_prob(c) == best, F.lit(c)) for c in classes])
    return vectors.withColumn("type", kind).drop(*[c for c in vectors.columns if c.startswith(PREFIX)])


def combined_attrs(attrs: dict, groups: dict[str, list[str]]) -> dict:
    """Task classes are the new ones but the background; that is kept if a new class has it, and null otherwise."""
    background = attrs.get("background_class")
    kept = next((new for new, olds in groups.items() if background in olds), None) if background is not None else None
    return attrs | {"task_vector_classes": [n for n in groups if n != kept], "background_class": kept}


def rasters_of(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rasters that meet a vector of the table."""
    return edges.join(shuffled(vectors.select("vector_name")), "vector_name", "left_semi").select("raster_name").distinct()
