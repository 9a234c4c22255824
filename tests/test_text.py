"""Hand cases of the text functions, with Python's own behaviour as the yardstick."""

import random
import re

from pyspark.sql import functions as F

from postlab.functions import text
from postlab.operators.terms import skip_similar_terms, term_array
from postlab import rules

NASTY = ["", " ", "\t x \n", " pad　", "\x1cseparated\x1f", "keep  inner ", "Ünï   ", None]


def test_strip_matches_python(one):
    assert one(text.strip, NASTY) == [None if v is None else v.strip() for v in NASTY]


def test_is_blank(one):
    assert one(text.is_blank, NASTY) == [v is None or v.strip() == "" for v in NASTY]


def test_title_case_matches_python(one):
    names = ["GUINEA-BISSAU", "COTE D'IVOIRE", "united states of america", "são tomé", "o'neil_mc2x", "élan 3d"]
    assert one(text.title_case, names) == [n.title() for n in names]


def test_clean_text_matches_python_steps(one):
    def restated(value):
        for pattern, by in ((r"http\S+", ""), (r"@\w+", ""), ("#", ""), (r"[^\w\s]", ""), (r"\s+", " ")):
            value = re.sub(pattern, by, value)
        return value.strip()

    rnd = random.Random(5)
    alphabet = ["http://a.b/c ", "@user_1", "@é ", "#tag", " ", "\n", "\x1d", " ", "für", "!", "…", "日本", "a-b", "_", "9"]
    values = ["".join(rnd.choice(alphabet) for _ in range(12)) for _ in range(200)]
    assert one(text.clean_text, values) == [restated(v) for v in values]


def test_detect_language_matches_restatement(one):
    def restated(value):
        if not value or len(value) < 20:
            return "unknown"
        low = f" {value.lower()} "
        scores = {name: sum(i in low for i in words) for name, words in rules.LANGUAGE_INDICATORS.items()}
        for name, (letters, bonus) in rules.LANGUAGE_LETTERS.items():
            scores[name] += bonus * any(ch in low for ch in letters)
        best = max(scores, key=scores.get)
        return best if scores[best] > rules.LANGUAGE_MIN_SCORE else "english"

    rnd = random.Random(7)
    words = ["the", "bathe", "and", "el", "la", "y", "de", "und", "für", "à", "les", "che", "ñ", "ß", "é", "di",
             "that", "x", "zebra", "der", "die", "von", "il", "lo", "e", "¿que", "with\n", "\tthis"]
    values = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 14))) for _ in range(400)]
    values += [None, "", "the  double  space and the rest", "for", " for with the and that this"]
    assert one(text.detect_language, values) == [restated(v) for v in values]


def test_repair_mojibake(one):
    good = ["안녕하세요 세계", "日本語テスト", "naïve café", "plain", "“quotes” — dash", "ÃÃ", "Â", None, "Ü"]
    latin = [g.encode().decode("latin-1") if g else g for g in good]
    assert one(text.repair_mojibake, latin)[:5] == good[:5]
    windows = ["naïve café", "Grüße", "über"]
    assert one(text.repair_mojibake, [w.encode().decode("cp1252") for w in windows]) == windows
    assert one(text.repair_mojibake, good) == good, "clean text stays, and nothing fails"


def _garble(value, reading):
    """UTF-8 bytes read one by one; bytes that Windows-1252 leaves undefined are control characters."""
    table = rules.CP1252_HIGH if reading == "windows" else {}
    return "".join(table.get(byte, chr(byte)) for byte in value.encode())


CLEAN = ["CAFÉ» et «\xa0à\xa0»", "café”… fin", "groß“ und Fuß…", "É… talvez", "«IRMÃ»", "ÄÖÜ…", "naïve ©", "5 × 3", "Â", "ÃÃ", "", None, "100 € – “ja”", "日本語"]


def test_repair_mojibake_runs_keeps_clean_text(one):
    assert one(text.repair_mojibake_runs, CLEAN) == CLEAN


def test_repair_mojibake_runs_hand_cases(one):
    cases = {"clean é, then donâ€™t and cafÃ©": "clean é, then don’t and café", "ÃƒÂ©tÃƒÂ©": "été", "Ã¢â‚¬â„¢": "’",
             "SEÃ‘OR, CAFÃ‰ and über": "SEÑOR, CAFÉ and über", "wÅ‚aÅ›nie": "właśnie", "Ð¿Ñ€Ð¸Ð²ÐµÑ‚ привет": "привет привет"}
    assert one(text.repair_mojibake_runs, list(cases)) == list(cases.values())


def test_repair_mojibake_runs_restores_mixed_parts(one):
    rnd = random.Random(3)
    words = ["señor", "café", "über", "Größe", "naïve", "plain", "“quoted”", "don’t", "日本語", "안녕하세요", "Élan", "мир", "10 €", "Là", "Né", "ÉCOLE", "ARÑ!", "właśnie", "😀"]
    good, bad = [], []
    for _ in range(300):
        parts = [rnd.choice(words) for _ in range(rnd.randint(1, 12))]
        good.append(" ".join(parts))
        for i, part in enumerate(parts):
            for _ in range(rnd.choice((0, 0, 1, 1, 2, 3))):
                parts[i] = _garble(parts[i], rnd.choice(("latin", "windows")))
        bad.append(" ".join(parts))
    got = one(text.repair_mojibake_runs, bad)
    assert [(b, g) for b, g, w in zip(bad, got, good) if g != w] == []


def test_bytes(one, spark):
    raw = ["é".encode(), "é".encode("latin-1"), b"\xc3\x28", b"ok"]
    assert one(text.decode_with_fallback, raw, "binary") == ["é", "é", "Ã(", "ok"]
    assert one(text.valid_utf8, raw, "binary") == ["é", "�", "�(", "ok"]


def test_small_functions(one):
    assert one(text.flatten_newlines, [" a\nb \n"]) == ["a b"]
    assert one(text.normalise_handle, [" @me.bsky "]) == ["me.bsky"]
    assert one(text.normalise_hashtag, [" #AI "]) == ["#AI"]
    assert one(text.truncate, ["😀" * 600]) == ["😀" * 512], "counts code points"
    assert one(text.na_to_null, ["NA", "", "None", "Nan", "x"]) == [None, None, None, "Nan", "x"]


def test_parse_timestamp_accepts_each_format(one):
    got = one(text.parse_timestamp, ["2024-01-01T00:00:00Z", "2024-01-01 02:00:00+02:00", "soon", None])
    assert got[0] == got[1] is not None and got[2] is None and got[3] is None


def test_skip_similar_terms(spark):
    def restated(terms):
        kept = []
        for term in terms:
            words = term.split()
            if len(words) > 1 and any(words[0] in t for t in kept):
                continue
            kept.append(term)
        return kept

    rnd = random.Random(3)
    pool = ["AI", "AI assistant", "deep learning", "deep", "learning deep", "GPT", "ai x", "art", "artificial y", "art z"]
    cases = [[rnd.choice(pool) for _ in range(rnd.randint(1, 8))] for _ in range(40)] + [["OpenAI", "AI", "open ai tools", "GPT", "AI assistant", "deep learning", "deep learning"]]
    for terms in cases:
        assert spark.range(1).select(skip_similar_terms(term_array(terms)).alias("k")).first()["k"] == restated(terms)


def test_clean_text_searches_patterns_only_where_they_occur(one):
    values = ["a http b", "x http://y z@w", "@a@b c", "a\x1cb\x1f c", "httpx @", "", None]
    assert one(text.clean_text, values) == ["a http b", "x z", "c", "a b c", "", "", None]
    # four separators, the start of a link, the start of a mention
    assert str(text.clean_text(F.col("v"))).count("contains(") >= 6
