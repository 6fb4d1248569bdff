"""Class probabilities, predicted classes and loss terms as column expressions.

Class scores are ``ARRAY<DOUBLE>`` columns, one entry per class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(powers, lambda x: x / total)


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def argmax(p: Column) -> Column:
    """Index of the first maximal entry (class 0 wins a tie)."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def at_threshold(p: Column, threshold: float = 0.5) -> Column:
    """1 where p >= threshold (class 1 wins a tie)."""
    return (p >= F.lit(float(threshold))).cast("int")


def attack_probability(
    p: Column, classes: Sequence[int] | None = None, strict: bool = False
) -> Column:
    """P(attack) from one or several class probabilities.

    A single entry is P(attack) itself; otherwise it is the entry of class 1, which
    sits at index 1 unless ``classes`` names another position. Values outside [0, 1]
    become null, or an error if strict.
    """
    position = list(classes).index(1) if classes is not None and 1 in list(classes) else 1
    value = F.when(F.size(p) == 1, F.get(p, F.lit(0))).otherwise(F.get(p, F.lit(position)))
    bad = F.raise_error(F.lit("probability outside [0, 1]")).cast("double") if strict else F.lit(None)
    return F.when(value.between(0.0, 1.0), value).otherwise(bad)


def probability_of_class(p: Column, y: Column) -> Column:
    return F.get(p, y)


def cross_entropy(p_true: Column, eps: float = 1e-12) -> Column:
    """-ln of the probability given to the true class."""
    return -F.ln(F.greatest(p_true, F.lit(eps)))


def focal(p_true: Column, gamma: float, weight: Column | None = None, eps: float = 1e-12) -> Column:
    """weight * (1 - p)^gamma * cross entropy."""
    term = F.pow(F.lit(1.0) - p_true, F.lit(float(gamma))) * cross_entropy(p_true, eps)
    return term if weight is None else weight * term


def focal_weight_inside(p_true: Column, gamma: float, weight: Column, eps: float = 1e-12) -> Column:
    """Earlier form: the class weight scales the cross entropy before the modulation.

    With ce = weight * -ln(p), the modulating probability is exp(-ce) = p^weight.
    """
    ce = weight * cross_entropy(p_true, eps)
    return F.pow(F.lit(1.0) - F.exp(-ce), F.lit(float(gamma))) * ce
