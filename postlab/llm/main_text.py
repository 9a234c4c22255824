"""Main text of web pages by a site style tree.

Every page is parsed once into blocks of text; the path of open tags with their classes and ids is a block's place.
The pages of a host are merged: an element node of the tree is a place, its presentation is the list of child tags it holds on a page,
and its content is the text of its blocks there. Per place the style tree keeps how often each form occurred.

- Presentation importance of a node: entropy of its child lists over the pages that have it, in units of the
  logarithm of that number of pages. Markup that varies belongs to content, a template repeats.
- Content importance: the same entropy over its texts.
- Importance of a node: 1 - (1 - presentation) (1 - content), times a weight for what the tag itself says (navigation,
  footer, aside, form and the like have 0, by tag, role, class or id). A branch hangs on its ancestors, so one of
  weight 0 takes its whole subtree with it.

Blocks of low importance are removed. A host with fewer than ``min_pages`` pages has no statistics; there weights alone decide.
An article (or main) element is trusted over statistics inside it, as its places have texts that differ; only if its
text stands on most pages of a host with several (a notice inside the article) is it removed.

Counting is pre-aggregated: each task sums forms of a place before the shuffle, by hash, so a host with a third of all pages is
split over tasks; a place is grouped over at most its distinct forms, in two steps.

Text rules: character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined by one space in page order. Inline tags do not end a block.

Defined cases: null or empty html, and html without text, give an empty text; an unparsable url is a host of its own name; pages of a host
with equal blocks count as one page in all statistics, and each gets its text; an empty table gives an empty table; other columns are not kept.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from postlab.llm.store import stored

#: Tags that don't end a block, tags without content, and tags whose content isn't text.
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span "
                    "strike strong sub sup time tt u var wbr").split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea title select option".split())
#: Tags and roles of page furniture.
FURNITURE = frozenset("nav header footer aside form menu dialog button fieldset head script style noscript template iframe "
                      "object svg math canvas audio video textarea title select option datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
#: Words of class or id names that mark page furniture, matched as whole words of the name.
NAMES = re.compile(
    r"(?:^|[\s_\-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|nav|navbar|navigation|menu|"
    r"menubar|breadcrumb|breadcrumbs|header|masthead|footer|sidebar|aside|widget|related|recommended|share|sharing|social|"
    r"cookie|cookies|consent|notice|notices|gdpr|newsletter|subscribe|signup|login|popup|modal|overlay|comment|comments|"
    r"commentlist|discussion|disqus|respond|reply|replies|pagination|pager|toolbar|copyright|legal|disclaimer|skip|search|form)(?:$|[\s_\-\d])", re.I)
#: Starts of names that tell how a page or post is laid out or filed, not what the element is.
STATE = re.compile(r"(?:has|no|with|without|is|not|category|cat|tag|type|format|status)[\-_]", re.I)
#: Elements that hold the article.
CONTENT = frozenset(("article", "main"))
CLOSED_BY = {"p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                            "header hr main menu nav ol p pre section table ul".split()),
             "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
             "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
             "option": frozenset(["option"]), "head": frozenset(["body"])}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACES = re.compile(r"\s+")


@dataclass(eq=False)
class Element:
    """``hard``: furniture by tag, role or hidden; ``named``: by a class or id name; ``nested``: inline tags of its name open in it."""

    tag: str
    place: str
    parent: Element | None
    hard: bool = False
    named: bool = False
    content: bool = False
    nested: int = 0

    def line(self) -> Iterator[Element]:
        at: Element | None = self
        while at is not None:
            yield at
            at = at.parent

    def weight(self, spared: frozenset[Element] = frozenset()) -> int:
        line = list(self.line())
        if any(e.hard or (e.named and e not in spared) for e in line):
            return 0
        return 2 if any(e.content for e in line) else 1


def blocks(page: str) -> list[tuple[str, int, str]]:
    """(place, weight, text) of the blocks of a page in order. Weight: 0 furniture, 1 neutral, 2 inside an article.

    An unclosed block ends where HTML says it does; a closing tag without an open one is ignored; an unclosed comment or raw
    element takes the rest of the page. A class or id name doesn't make furniture of an article outside other articles, nor,
    if all articles of the page would go by names, of what holds the first of them or a main element.
    """
    out: list[tuple[Element, str]] = []
    text: list[str] = []
    stack = [Element("", "", None)]
    holders: list[Element] = []                                 # the elements of CONTENT

    def flush() -> None:
        joined = _SPACES.sub(" ", entities.unescape("".join(text))).strip()
        if joined:
            out.append((stack[-1], joined))
        text.clear()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        text.append(page[at:m.start()])
        token, at = m[0], m.end()
        if token[1] == "!" or token[1] == "?":
            if token.startswith("<![CDATA["):
                text.append(entities.escape(token[9:].removesuffix("]]>")))
            continue
        tag = _NAME.match(token)[1].lower()
        if token[1] == "/":
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if tag in INLINE and not depth:
                continue
            if tag in INLINE and stack[depth].nested:
                stack[depth].nested -= 1
                continue
            flush()
            if depth:
                del stack[depth:]
            continue
        if tag in INLINE and tag not in RAW:
            if tag in VOID:
                continue
            if "hidden" not in _attributes(token):
                # only hidden inline elements are on the stack; one inside another of its name closes first
                outer = next((e for e in reversed(stack) if e.tag == tag), None)
                if outer:
                    outer.nested += 1
                continue
        flush()
        if tag in VOID:
            continue
        while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1].tag, ()):
            stack.pop()
        if tag in RAW and not token.endswith("/>"):
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if token.endswith("/>") and tag in RAW:
            continue
        stack.append(_looks(tag, token, stack[-1]))
        if stack[-1].content:
            holders.append(stack[-1])
    flush()
    weights = {e: e.weight() for e, _ in out}
    if holders and 2 not in weights.values():
        shown = [e for e in holders if not any(x.hard for x in e.line())]
        first = [e for e in shown if e.tag != "article"] or shown
        spared = frozenset(x for e in first[:1] for x in e.line())
        weights = {e: e.weight(spared) for e in weights}
    return [(e.place, weights[e], t) for e, t in out]


def _attributes(token: str) -> dict[str, str]:
    """Attributes of a tag by their exact names; of repeated ones the first counts."""
    found: dict[str, str] = {}
    name = _NAME.match(token)
    for m in _ATTRIBUTE.finditer(token, name.end()):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _looks(tag: str, token: str, parent: Element) -> Element:
    found = _attributes(token)
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    role = found.get("role", "").strip().lower()
    above = list(parent.line())
    content = tag in CONTENT or role == "main"
    # an article has a header of its own: its title
    hard = (tag in FURNITURE and not (tag == "header" and any(e.content for e in above))) or role in ROLES or "hidden" in found
    named = any(NAMES.search(n) and not STATE.match(n) for n in names) and tag not in ("body", "html")
    # an article inside another may be a comment or a related one; any other isn't judged by names
    named = named and not (content and not any(e.tag == "article" for e in above))
    place = ".".join([tag, *re.sub(r"\d+", "#", " ".join(names)).split()])
    return Element(tag, f"{parent.place}/{place}", parent, hard, named, content)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_pages: int = 5,
              least: float = 0.3, repeated: float = 0.5) -> DataFrame:
    """``key``, ``url`` and ``text`` of each page.

    ``least``: a neutral branch of less importance is removed on hosts with ``min_pages`` pages or more.
    ``repeated``: a text found at one place on more than this share of such a host's pages is removed, article or not.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [blocks(h) if h else [] for h in batch["html"]]
            yield pd.DataFrame({
                "key": batch["key"], "url": batch["url"],
                "blocks": [[{"place": p, "weight": w, "text": t} for p, w, t in b if w] for b in found]})

    source = pages.select(pages[f"`{key}`"].alias("key"), pages[f"`{url}`"].alias("url"), pages[f"`{html}`"].alias("html"))
    kind = dict(source.dtypes)["key"]
    host = F.coalesce(F.lower(F.expr("try_parse_url(url, 'HOST')")), F.col("url"), F.lit(""))
    parsed = stored(
        source.mapInPandas(parse, f"key {kind}, url string, blocks array<struct<place:string,weight:int,text:string>>")
        .withColumn("host", host).withColumn("page", F.xxhash64("blocks")), "main-text-pages")

    # copies of a page have one vote: below, a page is a hash of all its blocks
    n_pages = stored(parsed.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("pages")),
                     "main-text-hosts")
    # one row per page and place: its child list (presentation) and its text (content), as hashes
    shown = parsed.select("host", "page", F.explode("blocks").alias("b")).select("host", "page", "b.place", "b.text")
    nodes = parsed.select("host", "page", F.explode(F.array_distinct(F.transform("blocks", lambda b: b.place))).alias("place"), "blocks")
    nodes = nodes.select("host", "page", "place", F.filter("blocks", lambda b: b.place == F.col("place")).alias("own")).select(
        "host", "page", "place", F.size("own").alias("form"), F.xxhash64(F.transform("own", lambda b: b.text)).alias("content"))
    nodes = nodes.groupBy("host", "page", "place").agg(F.first("form").alias("form"), F.first("content").alias("content"))

    def entropy(form: str) -> DataFrame:
        counts = nodes.groupBy("host", "place", form).agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("host", "place").agg(F.sum("n").alias("seen"), F.sum(F.col("n") * F.log("n")).alias("weighted")).select(
            "host", "place", "seen", F.when(F.col("seen") > 1, 1 - F.col("weighted") / F.col("seen") / F.log("seen")).otherwise(1.0).alias(f"by_{form}"))

    tree = stored(entropy("form").join(entropy("content").drop("seen"), ["host", "place"]).withColumn(
        "importance", 1 - (1 - F.col("by_form")) * (1 - F.col("by_content"))), "main-text-tree")
    # texts that stand at one place on most pages of their host
    common = (shown.groupBy("host", "place", F.xxhash64("text").alias("hash"), "page").agg(F.lit(1).alias("one"))
              .groupBy("host", "place", "hash").agg(F.count(F.lit(1)).alias("n"))
              .join(n_pages, "host").filter((F.col("pages") >= min_pages) & (F.col("n") > F.col("pages") * repeated)))
    low = (tree.join(n_pages, "host").filter((F.col("pages") >= min_pages) & (F.col("seen") >= min_pages) & (F.col("importance") < least)))
    # the rejects of a host: few, as a text on most pages can only be among a page's own blocks
    rejects = low.groupBy("host").agg(F.collect_set("place").alias("low")).join(
        common.groupBy("host").agg(F.collect_set(F.xxhash64("place", "hash")).alias("common")), "host", "full_outer")
    judged = parsed.join(stored(rejects, "main-text-rejects"), "host", "left")
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(f"array<{t}>"))
    kept = F.filter("blocks", lambda b: (
        ~F.array_contains(empty("common", "bigint"), F.xxhash64(b.place, F.xxhash64(b.text)))
        & ((b.weight == 2) | ~F.array_contains(empty("low", "string"), b.place))))
    # where a page has an article, what lies outside it is no main text
    has_article = F.exists("blocks", lambda b: b.weight == 2)
    chosen = F.when(has_article, F.filter(kept, lambda b: b.weight == 2)).otherwise(kept)
    return judged.select(
        F.col("key").alias(key), F.col("url").alias(url), F.array_join(F.transform(chosen, lambda b: b.text), " ").alias("text"))
