"""Claim predicate and object relations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy import vocab


def opposite_table() -> dict[str, list[str]]:
    """The opposite list closed under direction: if a opposes b, b opposes a."""
    closed: dict[str, set[str]] = {}
    for left, rights in vocab.PREDICATE_OPPOSITES.items():
        for right in rights:
            closed.setdefault(left, set()).add(right)
            closed.setdefault(right, set()).add(left)
    return {name: sorted(others) for name, others in sorted(closed.items())}


def opposites_of(predicate: Column) -> Column:
    """All opposites of a predicate, an empty array when it has none."""
    entries = []
    for name, others in opposite_table().items():
        entries += [F.lit(name), F.array(*[F.lit(o) for o in others])]
    return F.coalesce(F.create_map(*entries)[predicate], F.array().cast("array<string>"))


def are_opposite(p1: Column, p2: Column) -> Column:
    return F.coalesce(F.array_contains(opposites_of(p1), p2), F.lit(False))


def is_comparative(predicate: Column) -> Column:
    return predicate.isin(vocab.COMPARATIVE_PREDICATES)


def _normal_object(obj: Column) -> Column:
    return F.regexp_replace(F.lower(obj), r"[^a-z0-9\s-]", "")


def negation_classes(obj: Column, positive: bool) -> Column:
    """Numbers of the negation patterns the object matches on the given side.

    An object on the negative side of a pattern never counts as positive for it.
    """
    text = _normal_object(obj)
    picked = []
    for i, (pos, neg) in enumerate(vocab.NEGATION_PATTERNS):
        hit = (text.rlike(pos) & ~text.rlike(neg)) if positive else text.rlike(neg)
        picked.append(F.when(hit, F.lit(i)))
    return F.array_compact(F.array(*picked))


def are_negated(o1: Column, o2: Column) -> Column:
    return F.arrays_overlap(negation_classes(o1, True), negation_classes(o2, False)) | F.arrays_overlap(
        negation_classes(o1, False), negation_classes(o2, True)
    )
