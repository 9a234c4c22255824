"""Text column functions: each takes and returns a Column, no Python workers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlab import rules

# Every character Python's str.strip() removes (FIXED VALUE: Unicode whitespace
# and the four ASCII separators).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000")
# Java's \s is ASCII unless (?U), and never includes the separators.
_SPACE = r"\s\x{1c}-\x{1f}"
# Python's \w. Java's is ASCII, or with (?U) holds combining marks as well.
WORD_CHARS = r"\p{L}\p{N}_"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    # the wrapper keeps a body with a second (default) parameter from being
    # called with the element index
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def strip(value) -> Column:
    """Remove all Unicode whitespace at both ends (plain ``trim`` removes spaces only)."""
    return F.btrim(_col(value), F.lit(WHITESPACE))


def is_blank(value) -> Column:
    """True for null, empty or whitespace-only text."""
    value = _col(value)
    return value.isNull() | ~value.rlike(f"(?U)[^{_SPACE}]")


def title_case(value) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the others.

    ``initcap`` only looks at spaces: it gives ``Guinea-bissau``.
    """
    start = F.struct(F.lit("").alias("out"), F.lit(True).alias("upper"))

    def step(acc, ch):
        return F.struct(
            F.concat(acc["out"], F.when(acc["upper"], F.upper(ch)).otherwise(ch)).alias("out"),
            (~ch.rlike(r"[\p{Lu}\p{Ll}\p{Lt}]")).alias("upper"),
        )

    chars = F.split(F.lower(_col(value)), "")
    return F.aggregate(chars, start, step, lambda acc: acc["out"])


def contains_any(value, needles: Sequence[str]) -> Column:
    """Case-insensitive substring test against a fixed list; short needles are found soonest and stand for those that hold them."""
    fewest: list[str] = []
    for needle in sorted((n.lower() for n in needles), key=len):
        if not any(short in needle for short in fewest):
            fewest.append(needle)
    return let(
        F.lower(_col(value)),
        lambda low: _any_of([F.contains(low, F.lit(n)) for n in fewest]),
    )


def _any_of(tests: Sequence[Column]) -> Column:
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return found


def truncate(value, length: int = rules.MODEL_TEXT_LIMIT) -> Column:
    """First ``length`` code points."""
    return F.substring(_col(value), 1, length)


def flatten_newlines(value) -> Column:
    return strip(F.replace(_col(value), F.lit("\n"), F.lit(" ")))


def normalise_handle(value) -> Column:
    return strip(F.replace(_col(value), F.lit("@"), F.lit("")))


def normalise_hashtag(value) -> Column:
    """Strip; a leading ``#`` stays as it is."""
    return strip(value)


def clean_text(value) -> Column:
    """Drop links, mentions, ``#`` and punctuation; collapse whitespace.

    ``#`` needs no step of its own: the punctuation class covers it.
    """
    text = _col(value)

    def where(found: Column, value: Column, change: Callable[[Column], Column]) -> Column:
        # most texts lack most of what is dropped: a search for fixed characters spares them the pattern
        return F.when(found, change(value)).otherwise(value)

    # the separators become spaces up front, so that plain \s (faster than a
    # class with extra members) covers all whitespace below
    separators = "\x1c\x1d\x1e\x1f"
    out = where(_any_of([F.contains(text, F.lit(c)) for c in separators]), text, lambda t: F.translate(t, separators, "    "))
    out = let(out, lambda t: where(F.contains(t, F.lit("http")), t, lambda t: F.regexp_replace(t, r"(?U)http\S+", "")))
    out = let(out, lambda t: where(F.contains(t, F.lit("@")), t, lambda t: F.regexp_replace(t, f"@[{WORD_CHARS}]+", "")))
    out = F.regexp_replace(out, rf"(?U)[^{WORD_CHARS}\s]", "")
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    return F.trim(out)      # only plain spaces are left


def na_to_null(value, markers: Sequence[str] = rules.NA_MARKERS) -> Column:
    """Map the CSV spellings of a missing value to null."""
    value = _col(value)
    return F.when(~value.isin(*markers), value)


def detect_language(value) -> Column:
    """Rule-based language guess over the whole text.

    The padded text holds an indicator " word " exactly when "word" is one of
    its parts between single spaces, so one split and one set test per part
    replace a text scan per indicator. The few indicators without a leading
    space are looked for at the end of the parts.
    """
    text = _col(value)
    languages = list(rules.LANGUAGE_INDICATORS)
    words = {name: [i.strip() for i in found if i.startswith(" ")]
             for name, found in rules.LANGUAGE_INDICATORS.items()}
    endings = {name: [i.strip() for i in found if not i.startswith(" ")]
               for name, found in rules.LANGUAGE_INDICATORS.items()}
    every_word = sorted({w for found in words.values() for w in found})

    def scored(low: Column) -> Column:
        def of_found(found: Column) -> Column:
            scores = []
            for language in languages:
                listed = F.array(*[F.lit(w) for w in words[language]])
                score = F.size(F.array_intersect(found, listed))
                for ending in endings[language]:
                    score = score + F.contains(low, F.lit(ending + " ")).cast("int")
                letters, bonus = rules.LANGUAGE_LETTERS.get(language, ("", 0))
                if letters:
                    score = score + F.when(low.rlike(f"[{letters}]"), bonus).otherwise(0)
                scores.append(score)
            return F.array(*scores)

        return let(F.filter(F.split(low, " "), lambda part: part.isin(*every_word)), of_found)

    def pick(scores: Column) -> Column:
        best = F.array_max(scores)
        names = F.array(*[F.lit(name) for name in languages])
        # array_position finds the first maximum, which is the tie rule
        winner = F.get(names, (F.array_position(scores, best) - 1).cast("int"))
        return F.when(best > rules.LANGUAGE_MIN_SCORE, winner).otherwise("english")

    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    guess = let(let(padded, scored), pick)
    short = text.isNull() | (F.length(text) < rules.LANGUAGE_MIN_CHARS)
    return F.when(short, "unknown").otherwise(guess)


def repair_mojibake(value) -> Column:
    """Undo UTF-8 text that was once decoded as Latin-1 or Windows-1252.

    One pass over whole strings; text that is not garbled comes back unchanged
    and no input makes the expression fail.
    """
    text = _col(value)
    high = "".join(rules.CP1252_HIGH.values())
    low = "".join(chr(code) for code in rules.CP1252_HIGH)

    # a lead byte followed by a continuation byte, in either reading
    suspect = text.rlike(rf"[\x{{C2}}-\x{{F4}}][\x{{80}}-\x{{BF}}{high}]")

    def undo(latin: Column) -> Column:
        # encode() raises on characters it cannot map: none is left to it
        one_byte = F.regexp_replace(latin, r"[^\x{00}-\x{FF}]", "?")
        decoded = F.try_validate_utf8(F.encode(one_byte, "ISO-8859-1").cast("string"))
        return F.when(latin.rlike(r"^[\x{00}-\x{FF}]*$"), decoded)

    return F.coalesce(F.when(suspect, let(F.translate(text, high, low), undo)), text)


def _suspect() -> str:
    """Pattern of a lead byte followed by a continuation byte, in either reading."""
    return rf"[\x{{C2}}-\x{{F4}}][\x{{80}}-\x{{BF}}{''.join(rules.CP1252_HIGH.values())}]"


def _garbled_run() -> str:
    """Pattern of a run of characters that is plausibly UTF-8 read as Latin-1 or Windows-1252.

    Only well-formed sequences match. Two sequences in a row, or a longer one whose continuation is not all
    punctuation, are plausible anywhere. A lone two-byte one could be a capital letter before a closing mark ("CAFÉ»"), so
    it needs letters around it that such a capital would not have. Every match starts with a lead byte, which is tested first.
    """
    read = rules.CP1252_HIGH

    def tail(first: int, last: int) -> str:
        high = "".join(ch for code, ch in read.items() if first <= code <= last)
        return rf"[\x{{{first:X}}}-\x{{{last:X}}}{high}]"

    any_, marks, after_capital = tail(0x80, 0xBF), f"[{rules.CLOSING_MARKS}]", f"[{rules.MARKS_AFTER_CAPITAL_A}]"
    two = rf"[\x{{C2}}-\x{{DF}}]{any_}"
    long = "|".join((
        rf"\x{{E0}}{tail(0xA0, 0xBF)}{any_}", rf"[\x{{E1}}-\x{{EC}}\x{{EE}}\x{{EF}}]{any_}{any_}", rf"\x{{ED}}{tail(0x80, 0x9F)}{any_}",
        rf"\x{{F0}}{tail(0x90, 0xBF)}{any_}{any_}", rf"[\x{{F1}}-\x{{F3}}]{any_}{any_}{any_}", rf"\x{{F4}}{tail(0x80, 0x8F)}{any_}{any_}"))
    # the letters of Western Europe; those of the other two-byte alphabets; both without the sign × and the small ß
    west, other = r"[\x{C2}\x{C3}]", r"[\x{C4}-\x{D6}\x{D8}-\x{DE}]"
    alone = "|".join((
        rf"(?<!\p{{Lu}}\p{{Lu}}){west}{any_}", rf"{west}(?!{after_capital}(?!\p{{L}})){any_}",
        rf"(?<=\p{{Ll}}){other}{any_}", rf"[\x{{C4}}\x{{C5}}]{any_}(?=\p{{Ll}})"))
    return rf"(?={_suspect()})(?:(?:{two}|{long})(?:{two}|{long})+|(?!.{marks}{{2}})(?:{long})|{alone})"


def repair_mojibake_runs(value) -> Column:
    """Undo UTF-8 that was decoded as Latin-1 or Windows-1252, in parts of a text and more than once.

    Each garbled run is found and decoded by itself, so clean words around it (any letters) stay, and the two readings may be
    mixed. Rounds go on until nothing is left: decoding at least halves a run, so the logarithm of the length is enough. Text
    without a garbled run comes back unchanged after one test; null stays null.
    """
    high = "".join(rules.CP1252_HIGH.values())
    low = "".join(chr(code) for code in rules.CP1252_HIGH)
    run = _garbled_run()

    def decoded(found: Column) -> Column:
        data = F.encode(F.translate(found, high, low), "ISO-8859-1")
        return F.coalesce(F.try_validate_utf8(data.cast("string")), found)

    def repaired(text: Column) -> Column:
        runs = F.transform(F.regexp_extract_all(text, F.lit(run), F.lit(0)), decoded)
        # a text has one gap more than runs
        return F.array_join(F.flatten(F.zip_with(F.split(text, run, -1), runs, lambda gap, fixed: F.array(gap, fixed))), "")

    def state(text: Column, going: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(going).alias("going"))

    def again(acc: Column, _round: Column) -> Column:
        now = acc["text"]
        return F.when(acc["going"] & now.rlike(run), state(repaired(now), True)).otherwise(state(now, False))

    text = _col(value)
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.length(text) + 1)).cast("int") + 1)
    return F.when(text.rlike(_suspect()), F.aggregate(rounds, state(text, True), again, lambda acc: acc["text"])).otherwise(text)


def valid_utf8(value) -> Column:
    """Replace invalid byte sequences by U+FFFD."""
    return F.make_valid_utf8(_col(value).cast("string"))


def decode_with_fallback(data) -> Column:
    """Bytes to text: UTF-8 when valid, Latin-1 otherwise (any byte decodes)."""
    data = _col(data)
    return (F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))
            .otherwise(F.decode(data, "ISO-8859-1")))


def parse_timestamp(value) -> Column:
    """UTC timestamp, null when the text is not one. Each row stands alone."""
    return F.try_to_timestamp(_col(value))


def label_title(value) -> Column:
    return title_case(value)


def tokens(value, pattern: str = f"[{WORD_CHARS}']+") -> Column:
    """Lower-case word tokens in text order."""
    return F.regexp_extract_all(F.lower(_col(value)), F.lit(pattern), F.lit(0))
