import math
import random
import re

import pytest
from pyspark.sql import functions as F

from postlab import rules
from postlab.sentiment import rule_layer
from postlab.sentiment.lexicon import Lexicon
from postlab.sentiment.rule_layer import rule_score, rule_score_with_table

IDIOMS = {"the bomb": 3.0, "kiss of death": -1.5, "of death": -3.0}
LEX = Lexicon({"good": 1.9, "bad": -2.5, "great": 3.1, "faint": 0.2, "so": 0.0, "death": -2.0},
              boosters={"very": 0.293, "hardly": -0.293}, negations=("not", "never", "without", "don't"))


def restated(text, lex, idioms):
    """The rules as plain loops over a list of words."""
    text = text or ""
    words = re.findall(r"[\w']+", text)
    for phrase in sorted((p.split() for p in idioms), key=lambda ws: (-len(ws), ws)):
        i, out = 0, []
        while i < len(words):
            if [w.lower() for w in words[i:i + len(phrase)]] == phrase:
                out.append("-".join(words[i:i + len(phrase)]))
                i += len(phrase)
            else:
                out.append(words[i])
                i += 1
        words = out
    valences = dict(lex.valences) | {"-".join(p.split()): v for p, v in idioms.items()}
    low = [w.lower() for w in words]
    loud = [w.isupper() for w in words]
    if all(loud):
        loud = [False] * len(words)
    but = low.index("but") if "but" in low else None
    sign = lambda v: -1 if v < 0 else 1
    total = 0.0
    for i, word in enumerate(low):
        v = valences.get(word, 0.0)
        if not v:
            continue
        v += sign(v) * 0.733 * loud[i]
        for d in (1, 2, 3):
            if i < d or low[i - d] in valences:
                continue
            before = low[i - d]
            if before in lex.boosters:
                b = lex.boosters[before]
                b += sign(b) * 0.733 * loud[i - d]
                v += sign(v) * b * (1, 0.95, 0.9)[d - 1]
            if before in lex.negations:
                between = low[i - d + 1:i]
                if before == "never" and {"so", "this"} & set(between):
                    v *= 1.25
                elif not (before == "without" and "doubt" in between):
                    v *= -0.74
        if i and low[i - 1] == "least" and "least" not in valences and not (i > 1 and low[i - 2] in ("at", "very")):
            v *= -0.74
        if but is not None and i != but:
            v *= 0.5 if i < but else 1.5
        total += v
    asked = text.count("?")
    emphasis = min(text.count("!"), 4) * 0.292 + (0 if asked < 2 else asked * 0.18 if asked < 4 else 0.96)
    total += emphasis * (total > 0) - emphasis * (total < 0)
    return round(total / math.sqrt(total * total + rules.VADER_ALPHA), 4)


def texts(n):
    rnd = random.Random(31)
    vocab = ["good", "bad", "great", "GREAT", "faint", "so", "this", "very", "VERY", "hardly", "not", "never", "without", "doubt", "don't",
             "but", "least", "at", "the", "The", "bomb", "BOMB", "kiss", "of", "death", "cat", "I", "É", "!", "??", "kiss of death", "yeah-right"]
    return [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 14))) for _ in range(n)] + [
        None, "", " ", "!!!", "the bomb the bomb", "GOOD", "GOOD cat", "but", "good but bad", "least good", "at least good", "good " * 3000,
        "kiss of death of death", "good!!!!!!", "bad????"]


def test_rules_match_loop(one):
    given = texts(500)
    assert one(lambda c: rule_score(c, LEX, IDIOMS), given) == pytest.approx([restated(t, LEX, IDIOMS) for t in given], abs=1.01e-4)


def test_each_rule_shows(one):
    plain, caps, but, least, at_least, so, idiom, loud = one(lambda c: rule_score(c, LEX, IDIOMS), [
        "a good cat", "a GOOD cat", "good but dull", "least good", "at least good", "never so good", "the bomb", "a good cat!!"])
    assert but < plain < caps and least < 0 < at_least == plain < so and idiom == 0.6124 and plain < loud


@pytest.mark.parametrize("bound", [2, 10_000])
def test_long_list_is_joined(spark, bound):
    given = texts(150)
    for extra in ({}, {"very": 1.5, "least": -0.5, "never": 0.0}):
        lex = Lexicon({**LEX.valences, **extra}, LEX.boosters, LEX.negations)
        table = spark.createDataFrame(list(lex.valences.items()), "token string, valence double")
        df = spark.createDataFrame(list(enumerate(given)), "post_id int, text string").withColumn("token", F.lit("x"))
        scored = rule_score_with_table(df, table, "post_id", idioms=IDIOMS, max_entries=bound, boosters=LEX.boosters, negations=LEX.negations)
        assert scored.columns == ["post_id", "text", "token", "compound"]
        got = {r.post_id: r.compound for r in scored.collect()}
        assert [got[i] for i in range(len(given))] == pytest.approx([restated(t, lex, IDIOMS) for t in given], abs=1.01e-4)


def test_empty_list_and_empty_table(spark):
    df = spark.createDataFrame([(1, "good")], "post_id int, text string")
    none = spark.createDataFrame([], "token string, valence double")
    assert rule_score_with_table(df, none, "post_id", idioms={}).first().compound == 0.0
    assert rule_score_with_table(df.limit(0), none, "post_id").count() == 0


def test_only_idioms_that_occur_are_searched(one):
    idioms = {"of the": 1.0, "not bad at": 2.0, "bad at": -1.0, "tres bien": 0.5}
    texts = ["Of the OF THE of", "not bad at bad at", "TRES bien, tres  bien's", "of the-of the", "", "of, the!", None]
    got = one(lambda c: rule_layer._words(c, idioms)["words"], texts)
    assert got == [["Of-the", "OF-THE", "of"], ["not-bad-at", "bad-at"], ["TRES-bien", "tres", "bien's"], ["of-the", "of-the"], [""], ["of-the"], [""]]
    assert one(lambda c: rule_layer._words(c, idioms)["low"], texts) == [[w.lower() for w in ws] for ws in got]
    assert str(rule_layer._words(F.col("t"), idioms)).count("contains(") == len(idioms)
