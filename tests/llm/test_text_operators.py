import random

import pytest

from postlab.llm.main_text import blocks, main_text
from postlab.llm.private import Feistel, luhn, pseudonymise, pseudonymise_column
from postlab.llm.quality import clean_lines


def judged(spark, text):
    return clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


def test_quality_odd_rows(odd, none):
    rows = clean_lines(odd).collect()
    assert len(rows) == 9 and clean_lines(none).count() == 0
    by = {r.doc_id: r for r in rows}
    assert not by[2].kept and by[2].n_words == 0 and not by[3].kept
    assert by[4].kept and by[4].n_words == 30_000 and by[1].kept
    assert by[1].position == 1 and by[1].n_words == 21      # the input's own n_words is replaced


def test_quality_rules(spark):
    good = "This line has quite a few words and it ends as sentences usually do."
    other = "Another one follows with different words, so nothing here is found twice at all."
    r = judged(spark, f"{good}\nHome | About | News | Contact\n{other}\nAll rights reserved.\nno end")
    assert r.kept and r.n_removed_lines == 3 and r.clean_text == f"{good}\n{other}"
    assert not judged(spark, "one | two | three | four | five | six " * 10).kept
    assert not judged(spark, " ".join(f"a{i}###" for i in range(40))).kept
    assert judged(spark, f"{good}\n{other}\n{good}").n_dup_lines == 1


def test_quality_repeated_windows(spark):
    rng = random.Random(5)
    for _ in range(15):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        seen, covered = {}, set()
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i:i + 8]), []).append(i)
        for starts in seen.values():
            if len(starts) > 1:
                covered |= {i + k for i in starts for k in range(8)}
        assert judged(spark, " ".join(words)).n_repeat_words == len(covered)


def test_quality_filter_stays_above(spark, odd):
    plan = clean_lines(odd).filter("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and plan.index("Filter") < plan.index("Generate")


@pytest.mark.parametrize("text, kinds", [
    ("pay 4111 1111 1111 1111 or 4111111111111111", {"card": 2}), ("id 4111111111111112", {}),
    ("a.b-9@mail.example.com", {"email": 1}), ("+1 (599) 555-3756", {"phone": 1}), ("10.0.0.1 300.1.1.1", {"ip": 1}),
    ("1980-02-29 1981-02-29 03/04/1999 31.12.1970", {"date": 3}), ("123-45-6789 000-12-3456", {"ssn": 1}),
    ("GB82 WEST 1234 5698 7654 32", {"iban": 1}), ('token = "f3ef4d6b2755a36d7d9c25bd72c4d5f6"', {"secret": 1}),
    ("Version 2.0 of 3,000 items", {}), ("", {})])
def test_private_kinds(text, kinds):
    made, counts = pseudonymise(text, Feistel(b"key"))
    assert counts == kinds and (made == text) == (not kinds) and len(made.split()) == len(text.split())
    assert pseudonymise(made, Feistel(b"key", undo=True))[0] == text
    if kinds:
        assert pseudonymise(text, Feistel(b"other"))[0] != made


def test_private_links_and_is_a_permutation():
    f = Feistel(b"key")
    a, b = (pseudonymise(t, f)[0] for t in ("x 4111 1111 1111 1111", "4111111111111111 y"))
    assert a[2:].replace(" ", "") == b[:16] and luhn([int(c) for c in b[:15]]) == int(b[15])
    assert len({f.below(i, 1000, "t") for i in range(1000)}) == 1000
    assert len({tuple(f.digits([i // 10, i % 10], [10, 10], "t")) for i in range(100)}) == 100


@pytest.mark.parametrize("text, kinds, stays", [
    ("4111 1111 1111 1111 123", {"card": 1}, " 123"), ("4111111111111111 12 items", {"card": 1}, " 12 items"),
    ("no 5 4111 1111 1111 1111", {"card": 1}, "no 5 "), ("4111-1111-1111-1111-123", {"card": 1}, "-123"),
    ("12345 4111 1111 1111 1111", {"card": 1}, "12345 "), ("5-4111-1111-1111-1111", {"card": 1}, "5-"),
    ("1234567 123-45-6789", {"ssn": 1}, "1234567 "), ("4111 1111 1111 1111 4111 1111 1111 1111", {"card": 2}, " "),
    ("4111 1111 1111 1111 10.0.0.1", {"card": 1, "ip": 1}, " "), ("+1 4111 1111 1111 1111", {"card": 1}, "+1 "),
    ("1234 5678 9012 3456 78", {}, "1234 5678 9012 3456 78"),
    ("at 2021-03-04T10:11:12Z", {"date": 1}, "T10:11:12Z"), ("2021-03-04/2021-03-09", {"date": 2}, "/"),
    ("2021-03-04T10:11:12Z/2021-03-05T10:11:12Z", {"date": 2}, "T10:11:12Z/"), ("2021-13-04T10:11:12", {}, "2021-13-04T10:11:12")])
def test_private_values_beside_other_numbers(text, kinds, stays):
    for key in range(100):
        made, counts = pseudonymise(text, Feistel(b"%d" % key))
        assert counts == kinds and stays in made and (made == text) == (not kinds)
        assert pseudonymise(made, Feistel(b"%d" % key, undo=True)) == (text, kinds)


def test_private_odd_rows(odd, none):
    rows = pseudonymise_column(odd, b"k").collect()
    assert len(rows) == 9 and sum(r.n_private for r in rows) == 0 and pseudonymise_column(none, b"k").count() == 0
    assert {r.doc_id: r.text for r in rows}[3] is None


PAGE = ("<html><head><title>T</title></head><body><nav>Home <a>About</a></nav><div class='cookie-notice'>Accept</div>"
        "<article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>\n  text<p>Second &lt;x&gt;<br>line"
        "<aside>Related</aside><form><label>Mail</label></form></article><section id='comments'>Nice!</section>"
        "<script>var a='</p>';</script><footer>&copy; me</footer></body></html>")


def test_main_text_page(spark, none):
    pages = spark.createDataFrame([(1, "http://h.example/1", PAGE), (2, None, None), (3, "x", ""), (4, "http://h.example/2", "plain & simple"),
                                   (5, "http://[bad", "<p>open <!-- no end"), (1, "http://h.example/1", PAGE)],
                                  "page_id long, url string, html string")
    rows = main_text(pages).collect()
    assert len(rows) == 6 and main_text(pages.limit(0)).count() == 0
    by = {r.page_id: r.text for r in rows}
    assert by == {1: "Title & more First bold text Second <x> line", 2: "", 3: "", 4: "plain & simple", 5: "open"}


def test_style_tree_drops_what_repeats_on_a_host(spark):
    page = "<body><div class='top'>Welcome to our site</div><div class='body'><p>Story {0} begins.</p><p>It ends with {0}.</p></div></body>"
    pages = spark.createDataFrame([(i, f"http://one.example/{i}", page.format(i)) for i in range(8)]
                                  + [(100, "http://two.example/", page.format(100))], "page_id long, url string, html string")
    by = {r.page_id: r.text for r in main_text(pages).collect()}
    assert by[3] == "Story 3 begins. It ends with 3."
    assert by[100] == "Welcome to our site Story 100 begins. It ends with 100."        # one page tells nothing about its host


@pytest.mark.parametrize("tag", ["article", "div"])
def test_style_tree_counts_copies_of_a_page_once(spark, tag):
    page = f"<body><div class='top'>Welcome</div><{tag} class='body'><h1>Head {{0}}</h1><p>Story {{0}} begins.</p></{tag}></body>"
    numbers = [*range(6), *[50] * 30]
    pages = spark.createDataFrame([(k, f"http://one.example/{k}", page.format(i)) for k, i in enumerate(numbers)],
                                  "page_id long, url string, html string")
    by = {r.page_id: r.text for r in main_text(pages).collect()}
    assert by == {k: f"Head {i} Story {i} begins." for k, i in enumerate(numbers)}


@pytest.mark.parametrize("page, kept", [
    ("<div style='overflow:hidden'>a</div>", "a"), ("<div aria-hidden='false'>a</div>", "a"), ("<p title='the hidden lake'>a</p>", "a"),
    ("<div data-role='navigation' data-id='footer'>a</div>", "a"), ("<div hidden>a</div><p hidden=''>b</p>c", "c"),
    ("<div role='navigation'>a</div>b", "b"), ("<div class=menu>a</div>b", "b"),
    ("<div class='site-content has-sidebar'><article>a</article></div>", "a"), ("<div class='layout no-sidebar'><main>a</main></div>", "a"),
    ("<article class='post-12 category-legal'>a</article>", "a"), ("<article class='legal'>a</article>", "a"),
    ("<div class='search-page'><article>a<div class='share'>b</div></article></div><div class='comments'>c</div>", "a"),
    ("<div class='related'><article>b</article></div><article>a</article>", "a"),
    ("<div class='widget'><article>a</article><div class='comments'><article>b</article></div></div>", "a"),
    ("<article>a<article class='comment'>b</article></article>", "a"), ("<aside class='x'><article>b</article></aside>a", "a"),
    ("<p>a <span hidden>b</span> c</p><p>d</p>", "a c d"), ("<p>a <span hidden>b<span>c</span>d</span> e</p>", "a e"),
    ("<p>a <span hidden>b <b>c</b></span> d</p>", "a d"), ("<p>a <span title='hidden'>b</span> c</p>", "a b c")])
def test_blocks_judge_attributes_by_name(page, kept):
    assert " ".join(t for _, w, t in blocks(page) if w) == kept


def test_blocks_never_fail():
    rng = random.Random(2)
    parts = ["<p>", "</p>", "<div", ">", "<!--", "-->", "&amp", "&#x41;", "text", "<b>", "</x>", "<script>", "<td>", "'", '"', "<![CDATA[", "]]>", "</"]
    for _ in range(300):
        blocks("".join(rng.choices(parts, k=30)))
