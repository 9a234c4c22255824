"""Rule layer of the lexicon scorer: clauses, emphasis, idioms.

On top of valence, boosters and negation (``lexicon``) it knows

* idioms: a phrase of the list counts as one word with a valence of its own;
* capitals: in a text that isn't all capitals, a word in capitals is stronger, and so is a booster in capitals;
* "but": words before the first "but" of a text count half, words after it one and a half times;
* "least" before a word turns it, "at least" and "very least" don't;
* "never so" and "never this" strengthen where "never" alone would turn; "without doubt" turns nothing;
* exclamation and question marks strengthen the sum.

What a rule needs of its surroundings (three words back, their capitals, the side of "but") is gathered inside the row,
once for each word. So the same rules apply to a short word list, which is an expression and shuffles nothing, and to one
of any length, whose table is joined to these small records; Spark picks the join by the table's size.

Defined cases: null, empty and wordless texts give 0. Words are compared in lower case. Of overlapping idioms the one with
more words counts, then the first by name. A word that carries a valence never acts on the words after it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab import rules
from postlab.functions.text import WORD_CHARS, _col, let
from postlab.sentiment.lexicon import EXPRESSION_WORDS, Lexicon, _value_of

_BACK = range(1, len(rules.VADER_DAMPING) + 1)


def joined_idioms(idioms: Mapping[str, float]) -> dict[str, float]:
    """Idioms as the single words they become: '-' is in no word of a text."""
    return {"-".join(phrase.lower().split()): value for phrase, value in idioms.items()}


def _words(text: Column, idioms: Mapping[str, float]) -> Column:
    """Words in text order, idioms as one word: ``words`` as written and ``low`` in lower case."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[{WORD_CHARS}']+"), F.lit(0))
    phrases = sorted((p.lower().split() for p in idioms), key=lambda ws: (-len(ws), ws))

    def joined(s: Column) -> Column:
        line = s["line"]
        for phrase in phrases:
            # the space behind an idiom stays, so neighbouring idioms don't compete for one; most lines lack most idioms
            pattern = "(?i) " + " ".join(f"({word})" for word in phrase) + "(?= )"
            put = " " + "-".join(f"${i}" for i in range(1, len(phrase) + 1))
            line = let(line, lambda x, pattern=pattern, put=put, phrase=phrase: F.when(
                F.contains(s["low"], F.lit(f" {' '.join(phrase)} ")), F.regexp_replace(x, pattern, put)).otherwise(x))
        return let(F.btrim(line, F.lit(" ")), lambda x: F.struct(
            F.split(x, " ").alias("words"), F.split(F.lower(x), " ").alias("low")))

    line = F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))
    return let(let(line, lambda x: F.struct(x.alias("line"), F.lower(x).alias("low"))), joined)


def _capital(word: Column, low: Column) -> Column:
    """Whether a word, given with its lower case, is in capitals; most words are in lower case, which ends the test."""
    return (word != low) & (word == F.upper(word))


def _places(text: Column, idioms: Mapping[str, float], wanted=None) -> Column:
    """A record per (wanted) word: itself, the words before it, which are emphasised, and the factor of its clause."""

    def of(s: Column) -> Column:
        capitals = F.size(F.filter(s["words"], lambda w, i: _capital(w, F.get(s["low"], i))))
        state = F.struct(s["words"].alias("words"), s["low"].alias("low"),
                         let(capitals, lambda n: (n > 0) & (n < F.size(s["words"]))).alias("mixed"),
                         F.array_position(s["low"], "but").alias("but"))
        return let(state, records)

    def records(s: Column) -> Column:
        def strong(i: Column) -> Column:
            return s["mixed"] & _capital(F.get(s["words"], i), F.get(s["low"], i))

        def record(low: Column, i: Column) -> Column:
            place = i + 1
            clause = F.when((s["but"] == 0) | (place == s["but"]), 1.0).when(
                place < s["but"], rules.VADER_BEFORE_BUT).otherwise(rules.VADER_AFTER_BUT)
            made = F.struct(
                low.alias("token"), strong(i).alias("strong"), clause.alias("clause"),
                *(F.get(s["low"], i - d).alias(f"before_{d}") for d in _BACK),
                *(F.coalesce(strong(i - d), F.lit(False)).alias(f"strong_{d}") for d in _BACK))
            return made if wanted is None else F.when(wanted(low), made)

        return F.array_compact(F.transform(s["low"], record))

    return let(_words(text, idioms), of)


def _along(value: Column, amount) -> Column:
    """``amount`` in the direction of ``value``."""
    return F.when(value < 0, -amount).otherwise(amount)


def _adjusted(value: Column, at, boosters: Mapping[str, float], negations: list[str], valued) -> Column:
    """Valence of a word after all rules of its surroundings; ``at`` gives the fields of its record."""
    capitals = F.lit(rules.VADER_CAPITALS)
    value = let(value, lambda v: F.when(at("strong"), v + _along(v, capitals)).otherwise(v))
    so, acting = ("so", "this"), sorted({*boosters, *negations})
    for d, damping in zip(_BACK, rules.VADER_DAMPING):
        word, between = at(f"before_{d}"), [at(f"before_{e}") for e in range(1, d)]

        def boosted(v: Column, d=d, damping=damping, word=word) -> Column:
            def of(b: Column) -> Column:
                strong = b + F.when(at(f"strong_{d}"), _along(b, capitals)).otherwise(F.lit(0.0))
                return v + F.when(b == 0, 0.0).otherwise(_along(v, strong * damping))
            return let(_value_of(boosters, word), of)

        def turned(v: Column, word=word, between=between) -> Column:
            plain = F.when(word.isin(*negations), v * rules.VADER_NEGATION).otherwise(v)
            if not between:
                return plain
            near_so, near_doubt = F.lit(False), F.lit(False)
            for b in between:
                near_so, near_doubt = near_so | b.isin(*so), near_doubt | (b == "doubt")
            return (F.when(word.isin(*negations) & (word == "never") & near_so, v * rules.VADER_NEVER_SO)
                    .when(word.isin(*negations) & (word == "without") & near_doubt, v).otherwise(plain))

        def acted(v: Column, boosted=boosted, turned=turned, word=word) -> Column:
            after = let(boosted(v), turned) if negations else boosted(v)
            return F.when(word.isin(*acting), after).otherwise(v)       # most words don't act

        value = let(value, acted) if acting else value
    if "least" not in valued:
        kept = F.coalesce(at("before_2").isin("at", "very"), F.lit(False))
        value = let(value, lambda v: F.when((at("before_1") == "least") & ~kept, v * rules.VADER_NEGATION).otherwise(v))
    return value * at("clause")


def _compound(total: Column, text: Column) -> Column:
    """Punctuation strengthens the sum, then it is brought to [-1, 1]."""
    text = F.coalesce(text, F.lit(""))
    marks = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    asked = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    emphasis = (F.least(marks, F.lit(4)) * F.lit(rules.VADER_EXCLAMATION)
                + F.when(asked < 2, 0.0).when(asked < 4, asked * F.lit(rules.VADER_QUESTION)).otherwise(rules.VADER_QUESTIONS))
    whole = let(total, lambda t: F.when(t == 0, t).otherwise(t + _along(t, emphasis)))
    return let(whole, lambda t: F.round(t / F.sqrt(t * t + rules.VADER_ALPHA), 4))


def _acting(lexicon: Lexicon, valued) -> tuple[dict[str, float], list[str]]:
    return ({w: b for w, b in lexicon.boosters.items() if w not in valued},
            [w for w in lexicon.negations if w not in valued])


def rule_score(text, lexicon: Lexicon, idioms: Mapping[str, float] = rules.IDIOMS) -> Column:
    """Compound score in [-1, 1] of a whole text, 4 digits, for a short word list: one expression inside the row."""
    text = _col(text)
    valences = {**lexicon.valences, **joined_idioms(idioms)}
    boosters, negations = _acting(lexicon, valences)
    valued = [word for word, value in valences.items() if value]
    if not valued:
        return F.lit(0.0)
    found = _places(text, idioms, lambda word: word.isin(*valued))
    total = F.aggregate(found, F.lit(0.0), lambda acc, x: acc + _adjusted(
        _value_of(valences, x["token"]), lambda name: x[name], boosters, negations, valences))
    return _compound(total, text)


def rule_score_with_table(df: DataFrame, table: DataFrame, key: str, text: str = "text", idioms: Mapping[str, float] = rules.IDIOMS,
                          max_entries: int = EXPRESSION_WORDS, **options) -> DataFrame:
    """``df`` with ``compound``, for a (token, valence) table of any length; ``key`` is unique, tokens are in lower case.

    Up to ``max_entries`` words become an expression. A longer table is joined to the records of the words; what it says about the
    few words that act on others is read beforehand. Only words of the table survive the join, with one number each.
    """
    words = table.select("token", F.col("valence").cast("double").alias("valence"))
    if words.limit(max_entries + 1).count() <= max_entries:
        return df.withColumn("compound", rule_score(text, Lexicon.from_table(words, max_entries, **options), idioms))
    own = Lexicon({}, **options)
    asked = sorted({*own.boosters, *own.negations, "least"})
    valued = {row.token for row in words.where(F.col("token").isin(asked)).select("token").distinct().collect()}
    boosters, negations = _acting(own, valued)
    phrases = joined_idioms(idioms)
    # an outer explode: the inner one would have the optimizer build all records once more to test for empty texts
    records = df.select(F.col(key).alias("_key"), F.explode_outer(_places(_col(text), idioms)).alias("x")).select("_key", "x.*")
    listed = df.sparkSession.createDataFrame(list(phrases.items()), "token string, valence double")
    known = words.where(~F.col("token").isin(*phrases)).unionByName(listed) if phrases else words
    found = records.join(known.where("valence <> 0"), "token")
    sums = found.groupBy("_key").agg(F.sum(_adjusted(F.col("valence"), F.col, boosters, negations, valued)).alias("_sum"))
    scored = df.join(sums, df[key] == sums["_key"], "left")
    return scored.withColumn("compound", _compound(F.coalesce("_sum", F.lit(0.0)), _col(text))).select(*df.columns, "compound")
