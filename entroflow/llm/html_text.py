"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. Words score positive, less so or negative in links; tags score negative. An element
that is boilerplate scores negative once as a whole, whatever it holds, so that the region goes on past boilerplate in the
middle of an article. One linear scan finds the contiguous region whose scores sum to most; its text blocks, without
those of boilerplate elements inside it, are the main text.

All weights are smoothed log-odds counted on labelled pages (labelled_pages: many layouts put together by rule, each part
marked as article or not). Whether an element is boilerplate is a sum of such evidence, no single word decides it: its tag,
the words of its class, id and role (a name that was seen as a whole counts as itself, another by the mean of its words,
and a word that no page has speaks for text), whether it stands in an article, holds one, and how much of the page's
text it holds (outside an article).
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

# Element names of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title noscript template textarea iframe svg math object canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html", "head"}
ARTICLES = frozenset(("article", "main"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*>|</?[a-zA-Z][^<>]*\Z",
    re.DOTALL,
)
TAIL = re.compile(r"<!--|<!\[CDATA\[|</?[a-zA-Z][^<>]*\Z")
NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
PARTS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: What a word of a name says that no labelled page has: boilerplate goes by few names, text by any.
UNSEEN = 5.0
#: Shares of a page's words outside links that an element holds, as evidence.
SHARES = (0.02, 0.1, 0.3, 0.6)


@dataclass
class Element:
    name: str
    parent: int
    tokens: list[str] = field(default_factory=list)
    words: int = 0
    holds: bool = False
    inside: bool = False
    link: bool = False
    noise: bool = False


@dataclass
class Event:
    """A tag such as "p" or "/p" with no text, or "" with a run of text; owner: the innermost element around it or itself; at: its place."""

    tag: str
    text: str
    owner: int
    at: int


def endless(token: str) -> bool:
    """Whether a token is a comment or a CDATA section without its end."""
    return any(token.startswith(begin) and not (len(token) >= len(begin + end) and token.endswith(end)) for begin, end in (("<!--", "-->"), ("<![CDATA[", "]]>")))


def names_of(rest: str) -> list[str]:
    return [CAMEL.sub("-", t).lower() for m in NAMES.findall(rest) for t in "".join(m).split()] if rest else []


def parse(page: str) -> tuple[list[Event], list[Element]]:
    """The page's events and elements; elements are numbered from 0, which stands for the page."""
    events: list[Event] = []
    elements = [Element("", -1)]
    stack = [0]

    def text(begin: int, end: int) -> None:
        run, owner = page[begin:end], stack[-1]
        events.append(Event("", run, owner, begin))
        if not elements[owner].link:
            elements[owner].words += len(run.split())

    def close(i: int) -> None:
        """Close the elements from place i of the stack on."""
        for e in stack[i:]:
            opened[elements[e].name] -= 1
        del stack[i:]
        while blocks and blocks[-1] >= i:
            blocks.pop()

    # How many elements of a name are open, and the places in the stack of those that are blocks.
    opened: Counter = Counter()
    blocks: list[int] = []
    # Behind the last > there is no tag; only what is open there to the end is dropped.
    at, last = 0, page.rfind(">") + 1
    while at < len(page):
        m = TOKEN.search(page, at, last) if at < last else None
        if not m or (m.end() == last and endless(m.group())):
            m = m or TAIL.search(page, max(at, last))
            if not m or m.start() > at:
                text(at, m.start() if m else len(page))
            break
        if m.start() > at:
            text(at, m.start())
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            if opened[name]:
                i = len(stack) - 1
                while elements[stack[i]].name != name:
                    i -= 1
                events.append(Event("/" + name, "", stack[i], m.start()))
                close(i)
            elif name in BLOCKS or name == "br":
                events.append(Event("/" + name, "", stack[-1], m.start()))
            continue
        if name in RAW:
            if not (m["rest"] or "").rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(page, at)
                at = page.find(">", end.start()) + 1 or len(page) if end else len(page)
            continue
        if name in CLOSES_P or name == "p":
            # An open paragraph, with what is open inside it, ends where a block begins; so does an open item at the next one.
            for own in ("p", *([name] if name in ("li", "option", "dt", "dd", "tr", "td", "th") else [])):
                if blocks and elements[stack[blocks[-1]]].name == own:
                    close(blocks[-1])
        if name in VOID:
            events.append(Event(name, "", stack[-1], m.start()))
            continue
        up = elements[stack[-1]]
        elements.append(Element(name, stack[-1], names_of(m["rest"] or ""), inside=up.inside or up.name in ARTICLES, link=up.link or name == "a"))
        stack.append(len(elements) - 1)
        opened[name] += 1
        if name in BLOCKS:
            blocks.append(len(stack) - 1)
        events.append(Event(name, "", stack[-1], m.start()))
    for e in reversed(elements[1:]):
        up = elements[e.parent]
        up.words += e.words
        up.holds |= e.holds or e.name in ARTICLES
    return events, elements


def evidence(e: Element, whole: int) -> list[str]:
    """Features of an element apart from its names; whole: words of the page."""
    share = sum(e.words > s * whole for s in SHARES)
    found = [f"tag {e.name}{' with a name' if e.tokens else ''}", "holds an article" if e.holds else "holds none", f"{'inside' if e.inside else 'outside'} {e.name if e.name in ('header', 'footer') else ''}"]
    return found if e.inside else [*found, f"share {share}"]


def features(events: list[Event], elements: list[Element]) -> Iterator[tuple[str, int]]:
    """For each event the feature whose weight it takes, and how often: a run of boilerplate once, at its first event."""
    before = False
    for v in events:
        e = elements[v.owner]
        if e.noise:
            yield "boilerplate", 0 if before else 1
        else:
            yield (v.tag.lstrip("/"), 1) if v.tag else ("link word" if e.link else "word", len(v.text.split()))
        before = e.noise


# Labelled pages ------------------------------------------------------------------------------------------------------

# Invented prose, names that pages give to parts, and elements that hold them.
_WORDS = (
    "the rain came over hills and a river rose by noon while farmers moved their herds to higher ground before night fell again in april nobody "
    "had asked why old bridge still stood after so many winters of ice people said it was luck or skill of those who built with stone from quarry"
).split()
_FURNITURE = "ad ads advert advertisement sponsored promo sidebar menu nav navbar breadcrumbs header masthead footer comments comment-list disqus replies cookie-notice cookies consent gdpr notice banner popup modal newsletter subscribe signup login search share sharing social related recommended widget toolbar pagination pager copyright legal contentinfo complementary navigation alert topbar trending teaser".split()
_AFFIXES = "site- page- top- main- left- right- global- article- post- -box -block -area -list -bar -section -container -wrapper -widget -links -panel -top -bottom -inner -menu".split()
_ARTICLE = "post entry content article story text body main-content entry-content article-body post-body story-text prose page-content single content-main".split()
_WRAPPERS = "page wrapper container layout site row grid page-wrapper site-container main-wrapper page-header-wrapper has-sidebar with-sidebar two-column content-and-sidebar layout-sidebar page-layout outer inner".split()
_INSIDE = "side-effects related-work header-image ad-hoc comment-on-method social-history share-price legal-analysis banner-headline notice-of-meeting search-strategy menu-of-the-day alert-level cookie-recipe lead intro dropcap caption figure-text quote summary footnote-free table-of-results".split()


def _prose(rng: random.Random, low: int, high: int) -> str:
    return " ".join(rng.choice(_WORDS) for _ in range(rng.randint(low, high))) + "."


def _thread(rng: random.Random) -> str:
    """Reader comments, which may be longer than the article."""
    name, own = rng.choice(["comments", "comment-list", "replies", "disqus", "post-comments", "comment-section"]), rng.choice(["comment", "reply", "message"])
    return f"<{(tag := rng.choice(['div', 'section']))} {rng.choice(['class', 'id'])}='{name}'>" + "".join(f"<div class='{own}'><p>{_prose(rng, 20, 90)}</p></div>" for _ in range(rng.randint(8, 40))) + f"</{tag}>"


def _furniture(rng: random.Random) -> str:
    """One boilerplate element."""
    kind = rng.choice(_FURNITURE)
    affix = rng.choice([*_AFFIXES, *[""] * 25])
    name = affix + kind if affix.endswith("-") else kind + affix
    inner = rng.choice([
        lambda: "<ul>" + "".join(f"<li><a href='/{i}'>{_prose(rng, 1, 6)}</a></li>" for i in range(rng.randint(2, 9))) + "</ul>",
        lambda: f"<p>{_prose(rng, 5, 40)}</p>",
        lambda: _prose(rng, 4, 25),
        lambda: f"<h3>{_prose(rng, 1, 4)}</h3>" + "".join(f"<div><p>{_prose(rng, 10, 60)}</p></div>" for _ in range(rng.randint(1, 6))),
        lambda: f"<form><input><button>{_prose(rng, 1, 2)}</button></form>",
        lambda: f"<a href='/'>{_prose(rng, 1, 3)}</a> | <a href='/x'>{_prose(rng, 1, 3)}</a>",
    ])()
    plain = rng.choice(["nav", "footer", "aside", "header", "form", "menu"])
    attribute = rng.choice(["class", "id", "role"])
    return rng.choice([f"<{plain}>{inner}</{plain}>", f"<div {attribute}='{name}'>{inner}</div>", f"<section {attribute}='{name}'>{inner}</section>", f"<{plain} class='{name}'>{inner}</{plain}>", f"<ul class='{name}'><li>{inner}</li></ul>"])


def _article(rng: random.Random) -> list[tuple[str, bool]]:
    """The parts of an article: its blocks, and now and then boilerplate between them."""
    title = f"<h1>{_prose(rng, 3, 12)}</h1>"
    if rng.random() < 0.2:
        title = f"<header>{title}</header>"
    parts = [(title, True)]
    for _ in range(rng.randint(2, 9)):
        named = f" class='{rng.choice(_INSIDE)}'" if rng.random() < 0.3 else ""
        block = rng.choice(["p", "p", "p", "p", "div", "blockquote", "section", "list", "heading", "break"])
        body = _prose(rng, 20, 90) + (f" <a href='/y'>{_prose(rng, 1, 4)}</a> {_prose(rng, 3, 20)}" if rng.random() < 0.3 else "")
        if block == "list":
            parts.append((f"<ul{named}>" + "".join(f"<li>{_prose(rng, 4, 14)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>", True))
        elif block == "heading":
            parts.append((f"<h2{named}>{_prose(rng, 2, 8)}</h2><p>{body}</p>", True))
        elif block == "break":
            parts.append((f"<p><b>{body}<br>{_prose(rng, 10, 40)}", True))
        elif block == "p":
            parts.append((f"<p{named}>{body}</p>", True))
        else:
            parts.append((f"<{block}{named}><p>{body}</p></{block}>", True))
        if rng.random() < 0.15:
            parts.append((_furniture(rng), False))
    while not parts[-1][1]:
        parts.pop()
    return parts


@lru_cache(maxsize=1)
def labelled_pages(n: int = 600, seed: int = 3) -> list[list[tuple[str, bool]]]:
    """Invented pages as their parts in order, each with whether it belongs to the article."""
    rng = random.Random(seed)
    pages = []
    for _ in range(n):
        before = "".join(_furniture(rng) for _ in range(rng.randint(0, 4)))
        after = "".join(_furniture(rng) for _ in range(rng.randint(1, 5))) + (_thread(rng) if rng.random() < 0.25 else "")
        around = rng.choice([f"<article class='{rng.choice(_ARTICLE)}'>|</article>", "<article>|</article>", "<main>|</main>", "<main><article>|</article></main>", f"<div class='{rng.choice(_ARTICLE)}'>|</div>", f"<div id='{rng.choice(_ARTICLE)}'>|</div>", "<div>|</div>", f"<td class='{rng.choice(_ARTICLE)}'>|</td>"])
        outer = rng.choice([f"<div class='{rng.choice(_WRAPPERS)}'>|</div>", f"<div id='{rng.choice(_WRAPPERS)}'><div class='{rng.choice(_WRAPPERS)}'>|</div></div>", "|"])
        (open_a, close_a), (open_o, close_o) = around.split("|"), outer.split("|")
        pages.append([(f"<html><head><title>x</title></head><body>{open_o}{before}{open_a}", False), *_article(rng), (f"{close_a}{after}{close_o}</body></html>", False)])
    return pages


@lru_cache(maxsize=1)
def element_weights() -> dict[str, float]:
    """Log-odds of each piece of evidence that an element isn't boilerplate; "name ..." and "word ..." for names and their words."""
    counts: dict[bool, dict[str, float]] = {True: {}, False: {}}
    total = {True: 0, False: 0}
    named = {True: 0, False: 0}
    for parts in labelled_pages():
        page, marks = "", []
        for part, good in parts:
            page += part
            marks += [good] * len(part)
        events, elements = parse(page)
        begin, end = {}, {}
        for v in events:
            begin.setdefault(v.owner, v.at)
            at = v.owner
            while at > 0:
                end[at] = v.at
                at = elements[at].parent
        article = [i for i, good in enumerate(marks) if good]
        furniture: set[int] = set()
        for i, e in enumerate(elements[1:], 1):
            if i not in begin or e.parent in furniture:
                furniture.add(i) if e.parent in furniture else None
                continue
            good = marks[begin[i]] or (begin[i] < article[0] and end[i] >= article[-1])
            if not good:
                furniture.add(i)
            total[good] += 1
            named[good] += bool(e.tokens)
            seen = set(evidence(e, elements[0].words)) | {f"name {t}" for t in e.tokens} | {f"word {w}" for t in e.tokens for w in PARTS.findall(t)}
            for f in seen:
                counts[good][f] = counts[good].get(f, 0) + 1

    def odds(f: str) -> float:
        # Names are compared among the elements that have one.
        of = named if f.startswith(("name ", "word ")) else total
        return float(np.log((counts[True].get(f, 0) + 0.5) / (of[True] + 1)) - np.log((counts[False].get(f, 0) + 0.5) / (of[False] + 1)))

    return {f: odds(f) for f in {*counts[True], *counts[False]}}


def judge(elements: list[Element], weight: dict[str, float]) -> None:
    """Set noise for each element that is boilerplate or stands in one."""
    for e in elements[1:]:
        e.noise = elements[e.parent].noise
        if e.noise or e.name in ("html", "body"):
            continue
        logit = sum(weight.get(f, 0.0) for f in evidence(e, elements[0].words))
        for t in e.tokens:
            parts = PARTS.findall(t)
            if f"name {t}" in weight:
                logit += weight[f"name {t}"]
            elif parts:
                logit += sum(weight.get(f"word {w}", UNSEEN) for w in parts) / len(parts)
        e.noise = logit < 0


@lru_cache(maxsize=1)
def weights() -> dict[str, float]:
    """Weight of each feature by log-odds on the labelled pages; words outside links weigh at least 1, tags and boilerplate at most -0.25."""
    inside: dict[str, float] = {}
    outside: dict[str, float] = {}
    of_elements = element_weights()
    for parts in labelled_pages():
        page = "".join(p for p, _ in parts)
        sizes = np.cumsum([0, *(len(p) for p, _ in parts)])
        good = [i for i, (_, g) in enumerate(parts) if g]
        first, last = sizes[good[0]], sizes[good[-1] + 1]
        events, elements = parse(page)
        judge(elements, of_elements)
        for v, (f, n) in zip(events, features(events, elements)):
            into = inside if first <= v.at < last else outside
            into[f] = into.get(f, 0) + n
            # Shares are of all words and tags, those of boilerplate elements too.
            into["all"] = into.get("all", 0) + (1 if v.tag else len(v.text.split()))
    total_in, total_out = inside.pop("all"), outside.pop("all")
    out = {}
    for f in {*inside, *outside}:
        odds = float(np.log((inside.get(f, 0) + 0.5) / (total_in + 1)) - np.log((outside.get(f, 0) + 0.5) / (total_out + 1)))
        out[f] = max(odds, 1.0) if f == "word" else min(odds, 0.5) if f.endswith("word") else min(odds, -0.25)
    return out


Model = tuple[dict[str, float], dict[str, float]]


def train() -> Model:
    """Weights of elements and of events."""
    return element_weights(), weights()


def main_text(page: str | None, model: Model | None = None) -> str:
    """The article of a page as blocks joined by a blank line; empty if there is none."""
    if not page:
        return ""
    of_elements, weight = model or train()
    events, elements = parse(page)
    judge(elements, of_elements)
    best, best_at, total, begin = 0.0, (0, 0), 0.0, 0
    for i, (f, n) in enumerate(features(events, elements)):
        if n:
            total += n * weight.get(f, -1.0)
            if total <= 0:
                total, begin = 0.0, i + 1
            elif total > best:
                best, best_at = total, (begin, i + 1)
    blocks: list[list[str]] = [[]]
    for v in events[slice(*best_at)]:
        name = v.tag.lstrip("/")
        if name in BLOCKS:
            blocks.append([])
        elif name == "br":
            blocks[-1].append(" ")
        elif not elements[v.owner].noise:
            blocks[-1].append(v.text)
    texts = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def extract_text(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, html) as page_id, url, text, n_chars, one row a page.

    Null and empty html give empty text; a page without tags is text as it stands. Equal scores go to the region that
    ends first. Pages of any length are scanned once; rows map one to one, other columns are ignored.
    """

    model = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            text = [main_text(h, model) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
