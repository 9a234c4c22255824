"""Column-set operators: projection, renaming, ordering, unions of schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab import rules
from postlab.functions.labels import marker_radius
from postlab.functions.text import _col


def require_columns(df: DataFrame, required: Sequence[str] = rules.REQUIRED_COLUMNS) -> DataFrame:
    """Add missing columns as empty text."""
    missing = {name: F.lit("") for name in required if name not in df.columns}
    return df.withColumns(missing) if missing else df


def reorder_required_first(df: DataFrame, required: Sequence[str] = rules.REQUIRED_COLUMNS) -> DataFrame:
    return df.select(*required, *unlisted_columns(df, required))


def unlisted_columns(df: DataFrame, listed: Sequence[str]) -> list[str]:
    return [name for name in df.columns if name not in listed]


def standardise_columns(df: DataFrame, aliases: Mapping[str, str] = rules.COLUMN_ALIASES) -> DataFrame:
    """Rename known spellings; the first alias found for a target wins."""
    names = list(df.columns)
    renames = {}
    for old, new in aliases.items():
        if old in names and new not in names:
            names[names.index(old)] = new
            renames[old] = new
    return df.withColumnsRenamed(renames)


def check_required(df: DataFrame, required: Sequence[str] = ("text", "location_str")) -> DataFrame:
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}; available: {df.columns}")
    return df


def project_columns(df: DataFrame, wanted: Sequence[str] = rules.STORED_COLUMNS,
                    strict: bool = False) -> DataFrame:
    """Column subset; absent names are skipped unless ``strict``."""
    if strict:
        check_required(df, wanted)
    return df.select(*[name for name in wanted if name in df.columns])


def export_column_order(df: DataFrame, include_original: bool = True) -> DataFrame:
    """Ids first (last one listed leads), preferred order, dates, then the rest."""
    ordered = [name for name in rules.EXPORT_ORDER if name in df.columns]
    if include_original:
        rest = unlisted_columns(df, ordered)
        ids = [name for name in rules.EXPORT_ID_COLUMNS if name in rest]
        dates = [name for name in rules.EXPORT_DATE_COLUMNS if name in rest]
        others = [name for name in rest if name not in ids + dates]
        ordered = ids[::-1] + ordered + dates + others
    return df.select(*ordered)


def post_id(uri) -> Column:
    """Last path part of a post address."""
    return F.substring_index(_col(uri), "/", -1)


def post_link(handle, uri) -> Column:
    head, middle = rules.POST_LINK.replace("{post_id}", "").split("{handle}")
    return F.concat(F.lit(head), _col(handle), F.lit(middle), post_id(uri))


def default_attributes(df: DataFrame,
                       texts: Sequence[str] = ("content", "display_name", "created_at"),
                       counts: Sequence[str] = ("like_count", "reply_count", "repost_count")) -> DataFrame:
    filled = {name: F.coalesce(name, F.lit("")) for name in texts if name in df.columns}
    filled |= {name: F.coalesce(name, F.lit(0).cast("long")) for name in counts if name in df.columns}
    return df.withColumns(filled)


def derive_strength_confidence(df: DataFrame) -> DataFrame:
    """Rounded scores, their difference and their maximum.

    ``bround`` rounds halves to even, like the numeric library this follows.
    """
    scores = ("neg_score", "neu_score", "pos_score")
    out = df.withColumns({name: F.bround(name, 4) for name in scores})
    return out.withColumns({
        "sentiment_strength": F.bround(F.col("pos_score") - F.col("neg_score"), 4),
        "confidence": F.bround(F.greatest(*scores), 4),
    })


def stamp_time(df: DataFrame, column: str = "collected_at") -> DataFrame:
    return df.withColumn(column, F.current_timestamp())


def init_score_columns(df: DataFrame) -> DataFrame:
    """Empty sentiment and zero scores where a frame has none yet."""
    initial = {"sentiment": F.lit(None).cast("string"), "neg_score": F.lit(0.0),
               "neu_score": F.lit(0.0), "pos_score": F.lit(0.0)}
    missing = {name: value for name, value in initial.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def tidy_metrics(metrics: DataFrame) -> DataFrame:
    """One row per (model, metric)."""
    return metrics.unpivot(["model"], list(rules.METRICS), "variable", "value")


def popup_fields(df: DataFrame) -> DataFrame:
    """Short location and text for a map popup, and the marker size."""
    return df.withColumns({
        "popup_location": F.substring("location_str", 1, 50),
        "popup_text": F.translate(F.substring("text", 1, 100), '"\n', "' "),
        "radius": marker_radius("pos_score", "neg_score"),
    })


def union_batches(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; columns a frame lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
