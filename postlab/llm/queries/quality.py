"""op10: line-first cleaning of all documents."""

from __future__ import annotations

from postlab.llm.quality import BOILERPLATE, ENDINGS, SEPARATORS, clean_lines
from postlab.llm.store import table

NAME = "op10_line_first_quality"


def query(spark, sf_dir):
    judged = clean_lines(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "n_lines", "n_removed_lines", "kept_chars")


_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_CHARS = r"length(regexp_replace({}, '[\x20\x09-\x0D]+', '', 'g'))"
_ENDS = ENDINGS.replace("'", "''")
for _mark in ("2026", "3002", "FF01", "FF1F", "061F", "06D4", "0964", "2019", "201D", "00BB"):
    _ENDS = _ENDS.replace(f"\\u{_mark}", f"\\x{{{_mark}}}")

SQL = rf"""
with d as (select doc_id, coalesce(text, '') as body from documents),
w as (select doc_id, body, {_WORDS.format('body')} as words from d),
win as (select doc_id, i, array_to_string(words[i:i + 7], ' ') as win
        from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8)),
rep as (select doc_id, i from win qualify count(*) over (partition by doc_id, win) >= 2),
rw as (select doc_id, count(distinct i + k) as n from rep, (select unnest(range(0, 8)) as k) group by doc_id),
l as (select doc_id, pos, line,
             regexp_matches(line, '[^\x20\x09-\x0D]') as worded
      from (select doc_id, unnest(string_split(body, chr(10))) as line,
                   unnest(range(0, len(string_split(body, chr(10))))) as pos from d)),
j as (select *, {_WORDS.format('line')} as lw, {_CHARS.format('line')} as chars,
             {_CHARS.format('line')} - length(regexp_replace(line, '[\x20\x09-\x0D]+|[#*$%&|<>]', '', 'g')) as symbols from l),
f as (select *, worded and (
        (len(list_filter(lw, lambda x: x in ({', '.join(repr(s) for s in SEPARATORS)}))) >= 3
         and len(list_filter(lw, lambda x: x in ({', '.join(repr(s) for s in SEPARATORS)}))) * 4 >= len(lw))
        or symbols * 10 > chars
        or (len(lw) <= 20 and regexp_matches(lower(array_to_string(lw, ' ')), '{"|".join(BOILERPLATE)}'))
        or (len(lw) < 10 and not regexp_matches(lw[-1], '{_ENDS}'))) as fails from j),
s as (select doc_id, count(*) filter (worded) as n_lines, count(distinct line) filter (worded) as n_distinct,
             count(*) filter (fails) as n_removed_lines,
             coalesce(sum(chars) filter (not fails), 0)::bigint as kept_chars from f group by doc_id),
a as (select w.doc_id, len(words)::bigint as n_words, {_CHARS.format('body')}::bigint as word_chars,
             (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             s.n_lines - s.n_distinct as n_dup_lines, coalesce(rw.n, 0)::bigint as n_repeat_words,
             s.n_lines, s.n_removed_lines, s.kept_chars
      from w join s using (doc_id) left join rw using (doc_id)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and 100 * (word_chars - kept_chars) <= 50 * word_chars as kept,
       n_lines, n_removed_lines, kept_chars from b
"""
