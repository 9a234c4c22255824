"""Lexicon scorer: the published valence formula as one column expression.

A word list of up to ``EXPRESSION_WORDS`` words is compiled into set tests inside the
expression. A post is scored inside its own row: no token is shuffled, no join
back to the post is needed, and the scan reads the text once. A larger list stays a
table that the words of the posts are joined to (``score_with_table`` chooses).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab import rules
from postlab.functions.text import _col, let, tokens


#: Words that are compiled into an expression; a larger list is joined.
EXPRESSION_WORDS = 10_000


@dataclass(frozen=True)
class Lexicon:
    """Word valences plus the words that strengthen, weaken or negate them."""

    valences: Mapping[str, float]
    boosters: Mapping[str, float] = field(default_factory=lambda: dict(rules.BOOSTERS))
    negations: Sequence[str] = rules.NEGATIONS

    @classmethod
    def from_table(cls, table: DataFrame, max_entries: int = EXPRESSION_WORDS, **options) -> Lexicon:
        """Read (token, valence) rows: the word list of a language. One that is too long for an expression is refused, not cut."""
        rows = table.select("token", "valence").limit(max_entries + 1).collect()
        if len(rows) > max_entries:
            raise ValueError(f"more than {max_entries} words: use score_with_table, which joins them")
        return cls({row["token"]: float(row["valence"]) for row in rows}, **options)


def _value_of(table: Mapping[str, float], word: Column) -> Column:
    """Value of a word, 0 when absent: set tests halve the distinct values until one is left."""
    words_of = defaultdict(list)
    for token, value in table.items():
        if value:
            words_of[float(value)].append(token)

    def among(groups: list[tuple[float, list[str]]]) -> Column:
        if len(groups) == 1:
            return F.lit(groups[0][0])
        half = len(groups) // 2
        first = [word_ for _, words in groups[:half] for word_ in words]
        return F.when(word.isin(*first), among(groups[:half])).otherwise(among(groups[half:]))

    known = [word_ for group in words_of.values() for word_ in group]
    return F.when(word.isin(*known), among(sorted(words_of.items()))).otherwise(F.lit(0.0)) if known else F.lit(0.0)


def compound_score(text, lexicon: Lexicon) -> Column:
    """Compound score in [-1, 1] of a whole text, 4 digits; null text gives 0.

    Most words carry no valence and most words before one neither strengthen nor
    negate it, so both cases end at a single set test.
    """
    valued = [word for word, v in lexicon.valences.items() if v]
    # a word of the lexicon does not act on the words after it
    boosters = {w: b for w, b in lexicon.boosters.items() if w not in lexicon.valences}
    negations = [w for w in lexicon.negations if w not in lexicon.valences]
    acting = sorted({*boosters, *negations})

    def adjusted(words: Column, i: Column) -> Column:
        def look_back(value: Column, step: Column) -> Column:
            word = F.get(words, i - step["distance"])
            boost = _value_of(boosters, word) * step["damping"]
            boosted = value + F.when(value < 0, -boost).otherwise(boost)
            turned = F.when(word.isin(*negations), boosted * rules.VADER_NEGATION).otherwise(boosted)
            return F.when(word.isin(*acting), turned).otherwise(value)

        steps = F.array(*[F.struct(F.lit(d).alias("distance"), F.lit(damping).alias("damping"))
                          for d, damping in enumerate(rules.VADER_DAMPING, start=1)])
        return F.aggregate(steps, _value_of(lexicon.valences, F.get(words, i)), look_back)

    def total(words: Column) -> Column:
        places = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(*valued), i)))
        return F.aggregate(places, F.lit(0.0), lambda acc, i: acc + adjusted(words, i))

    return let(let(tokens(F.coalesce(_col(text), F.lit(""))), total),
               lambda s: F.round(s / F.sqrt(s * s + rules.VADER_ALPHA), 4))


def score_with_table(df: DataFrame, table: DataFrame, key: str, text: str = "text", max_entries: int = EXPRESSION_WORDS,
                     **options) -> DataFrame:
    """``df`` with ``compound``, for a (token, valence) table of any length; ``key`` is unique.

    A short table becomes an expression. A long one is joined: each word travels with the three words before it, only words of the
    table survive the join, and their adjusted valences are added up per key. The words that act on others are a short
    list of rules, so what the table says about those is read beforehand.
    """
    words = table.select("token", F.col("valence").cast("double").alias("valence"))
    if words.limit(max_entries + 1).count() <= max_entries:
        return df.withColumn("compound", compound_score(text, Lexicon.from_table(words, max_entries, **options)))
    rules_only = Lexicon({}, **options)
    acting = sorted({*rules_only.boosters, *rules_only.negations})
    valued = {r.token for r in words.where(F.col("token").isin(acting)).select("token").distinct().collect()}
    boosters = {w: b for w, b in rules_only.boosters.items() if w not in valued}
    negations = [w for w in rules_only.negations if w not in valued]
    places = let(tokens(F.coalesce(_col(text), F.lit(""))), lambda ws: F.transform(ws, lambda w, i: F.struct(
        w.alias("token"), *(F.get(ws, i - d).alias(f"before_{d}") for d in range(1, len(rules.VADER_DAMPING) + 1)))))
    found = df.select(F.col(key).alias("_key"), F.explode(places).alias("w")).select("_key", "w.*").join(words.where("valence <> 0"), "token")
    value = F.col("valence")
    for d, damping in enumerate(rules.VADER_DAMPING, start=1):
        word = F.col(f"before_{d}")
        boost = F.coalesce(_value_of(boosters, word), F.lit(0.0)) * F.lit(damping)
        boosted = value + F.when(value < 0, -boost).otherwise(boost)
        value = F.when(word.isin(*negations), boosted * rules.VADER_NEGATION).otherwise(boosted) if negations else boosted
    sums = found.groupBy("_key").agg(F.sum(value).alias("_sum"))
    total = F.coalesce("_sum", F.lit(0.0))
    return df.join(sums, df[key] == sums["_key"], "left").withColumn(
        "compound", F.round(total / F.sqrt(total * total + rules.VADER_ALPHA), 4)).select(*df.columns, "compound")


def label_of(compound: Column, threshold: float = rules.VADER_THRESHOLD) -> Column:
    return (F.when(compound >= threshold, "positive")
            .when(compound <= -threshold, "negative").otherwise("neutral"))


def lexicon_label(text, lexicon: Lexicon) -> Column:
    return let(compound_score(text, lexicon), label_of)
