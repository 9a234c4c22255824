"""Located tweets: standardise, sample, geocode, score, map tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from postlab.functions.labels import label_colour
from postlab.operators.aggregates import map_center, mean_scores, sentiment_distribution
from postlab.operators.filters import drop_blank, valid_coordinates
from postlab.operators.frame import (check_required, init_score_columns, popup_fields,
                                     standardise_columns)
from postlab.operators.joins import geocode_join
from postlab.operators.sampling import sample_n

MAX_MARKERS = 1000


def prepare_located(tweets: DataFrame, gazetteer: DataFrame, key: str,
                    max_rows: int | None = None, seed: int = 42) -> DataFrame:
    """Rows with text and coordinates; all of them unless ``max_rows`` asks for a sample."""
    named = check_required(standardise_columns(tweets))
    rows = drop_blank(named, "text", "location_str")
    if max_rows is not None:
        rows = sample_n(rows, max_rows, key, seed)
    return init_score_columns(valid_coordinates(geocode_join(rows, gazetteer)))


def map_tables(scored: DataFrame, key: str, max_markers: int = MAX_MARKERS) -> dict[str, DataFrame]:
    """Centre and markers of the map, and the summary figures."""
    placed = valid_coordinates(scored)
    markers = popup_fields(sample_n(placed, max_markers, key)).withColumn(
        "colour", label_colour("sentiment", "map"))
    return {
        "center": map_center(placed),
        "markers": markers,
        "sentiment": sentiment_distribution(scored),
        "mean_scores": mean_scores(scored),
    }
