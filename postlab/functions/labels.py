"""Label and score column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlab import rules
from postlab.functions.geo import _lookup
from postlab.functions.text import _col, let


def label_score(label) -> Column:
    """1 / 0 / -1; anything else counts as 0."""
    return F.coalesce(_lookup(rules.LABEL_SCORE, _col(label)), F.lit(0))


def label_colour(label, palette: str = "keyword") -> Column:
    """Colour of a label. The keyword palette leaves unknown labels null."""
    if palette == "keyword":
        return _lookup(rules.KEYWORD_COLOURS, _col(label))
    return F.coalesce(_lookup(rules.MAP_COLOURS, _col(label)), F.lit(rules.FALLBACK_COLOUR))


def softmax(logits) -> Column:
    """Class probabilities of an array of logits, shifted by the maximum."""

    def normalised(exps: Column) -> Column:
        total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
        return let(total, lambda t: F.transform(exps, lambda x: x / t))

    def powers(xs: Column) -> Column:
        return let(F.array_max(xs), lambda m: F.transform(xs, lambda x: F.exp(x - m)))

    return let(let(_col(logits), powers), normalised)


def softmax_label(logits) -> Column:
    """Struct (sentiment, neg_score, neu_score, pos_score) of three logits."""
    names = F.array(F.lit("Negative"), F.lit("Neutral"), F.lit("Positive"))

    def pick(p: Column) -> Column:
        best = (F.array_position(p, F.array_max(p)) - 1).cast("int")
        return F.struct(
            F.get(names, best).alias("sentiment"),
            F.get(p, F.lit(0)).alias("neg_score"),
            F.get(p, F.lit(1)).alias("neu_score"),
            F.get(p, F.lit(2)).alias("pos_score"))

    return let(softmax(logits), pick)


def marker_radius(pos_score, neg_score) -> Column:
    return F.lit(5.0) + (_col(pos_score) - _col(neg_score)) * 3
