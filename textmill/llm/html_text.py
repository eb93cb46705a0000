"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block of the page, in page order. A line's weight is
the length of its text outside links; lines of menus, headers, footers, sidebars, notices,
adverts, forms and comments, known by their element, role or class, weigh nothing, and
neither do lines that are mostly links. Words of a class or id say nothing about an element
that encloses the article or the larger part of the text around it. Weights are summed over
sliding windows of ``WINDOW`` lines. Text begins where the sums surge from zero and ends
where they dive back to it; what stands between a surge and its dive is a run. If the page
marks its article (``article``, ``main``) and no more text stands outside, runs are sought
inside it and all count; otherwise runs count whose highest window holds ``ENOUGH``
characters or ``SHARE`` of the page's highest, or in which a line reads as a sentence. The
weighing lines of these runs are the text.

One pass over a page in a Python task; pages are independent and nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.shared import ship

WINDOW = 3
SHARE = 0.2
ENOUGH = 100
LINK_SHARE = 0.6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_ITSELF = frozenset("li dt dd tr td th option".split())
NOISE = frozenset(
    "nav aside footer form head script style noscript template iframe object svg canvas button select textarea dialog "
    "menu fieldset noembed noframes audio video datalist".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising alert alerts banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices pager "
    "pagination popup promo promoted promotion related reply replies search share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget widgets".split()
)
COMMENT_NAMES = ("comment", "disqus", "replies", "reply")
NOT_COMMENTS = ("commentar", "commentat")
#: Names that say how a part of the page stands, mostly of an element around all of it.
STATUS = re.compile(r"^(?:has|no|with)[-_]|[-_](?:open|closed|enabled|disabled|allowed)$")
SENTENCE = re.compile(r"\S+\s+\S+\s+\S.*[.!?…:;][\"'”’»)\]]*$", re.S)
RIGHTS = re.compile(r"©|\(c\) ?[0-9]|copyright|all rights|alle rechte|tous droits|derechos reservados", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
PARTS = re.compile(r"[^a-z0-9]+")


def _tag_end(page: str, at: int) -> int:
    """Position of the ``>`` that ends the tag begun before ``at``, quotes respected; -1 if it never ends."""
    while True:
        end = page.find(">", at)
        if end < 0:
            return -1
        single, double = page.find("'", at, end), page.find('"', at, end)
        if single < 0 and double < 0:
            return end
        quote = single if double < 0 or 0 <= single < double else double
        if page[at:quote].rstrip()[-1:] != "=":  # a stray quote, not a value
            at = quote + 1
            continue
        close = page.find(page[quote], quote + 1)
        if close < 0:
            return end
        at = close + 1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name, rest)``: text, start and end tags; comments and raw contents are left out."""
    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            yield "text", "", page[at:]
            return
        if mark > at:
            yield "text", "", page[at:mark]
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = size if end < 0 else end + 3
            continue
        ahead = page[mark + 1 : mark + 2]
        if ahead in ("!", "?"):
            end = page.find(">", mark)
            at = size if end < 0 else end + 1
            continue
        closing = ahead == "/"
        name = NAME.match(page, mark + 1 + closing)
        if not name:
            yield "text", "", "<"
            at = mark + 1
            continue
        end = _tag_end(page, name.end())
        if end < 0:
            return  # a tag cut off by the end of the page
        tag, rest = name.group().lower(), page[name.end() : end]
        at = end + 1
        yield ("end" if closing else "start"), tag, rest
        if not closing and tag in RAW and not rest.endswith("/"):
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else size


def _noisy(tag: str, rest: str, in_article: bool) -> bool:
    if tag in NOISE or (tag == "header" and not in_article):
        return True
    if not rest.strip(" /"):
        return False
    for key, value in ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key == "role" and value in NOISE_ROLES:
            return True
        if key in ("class", "id") and tag == "article" and any(_comments(v) for v in value.split()):
            return True
    return False


def _comments(name: str) -> bool:
    """Whether a class or id is one of reader comments: a part of it begins with a word for them."""
    return not STATUS.search(name) and any(p.startswith(COMMENT_NAMES) and not p.startswith(NOT_COMMENTS) for p in PARTS.split(name))


def _named(tag: str, rest: str) -> tuple[bool, bool, bool]:
    """Whether class and id of an element hold a noise word, whether one stands alone, and whether it is one of comments."""
    if tag in ("html", "body", "article", "main") or not rest.strip(" /"):
        return False, False, False
    values = [v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(rest) if k.lower() in ("class", "id")]
    names = [name for v in values for name in v.split()]
    talk = any(map(_comments, names))
    found = talk or any(not STATUS.search(name) and not NOISE_NAMES.isdisjoint(PARTS.split(name)) for name in names)
    return found, any(name in NOISE_NAMES or (talk and _comments(name)) for name in names), talk


class _Named:
    """Elements with noise words, and the articles, of a page; parents come before what they enclose."""

    def __init__(self) -> None:
        self.parent: list[int] = []  # enclosing named element, or -1
        self.scope: list[int] = []  # enclosing article, or -1
        self.comment: list[bool] = []
        self.whole: list[bool] = []  # named by a word that stands alone, not by a part such as menu-open
        self.articles: list[tuple[str, int, int]] = []  # element, enclosing article, enclosing named element

    def noise(self, found: list[tuple[int, int, int]]) -> list[bool]:
        """Whether each named element is noise, from ``(weight, named element, article)`` of the lines."""
        count = len(self.parent)
        talk: list[bool] = []
        for i in range(count):
            talk.append(self.comment[i] or (self.parent[i] >= 0 and talk[self.parent[i]]))
        if not any(w for w, i, _ in found if i < 0 or not talk[i]):  # all of the page is named so
            talk = [False] * count
        held, scope, single = [0] * count, [0] * len(self.articles), [0] * count
        page = 0
        for weight, i, a in found:
            if i >= 0 and talk[i]:
                continue
            page += weight
            if i >= 0:
                held[i] += weight
            if a >= 0:
                scope[a] += weight
        for a in range(len(self.articles) - 1, -1, -1):
            if self.articles[a][1] >= 0:
                scope[self.articles[a][1]] += scope[a]
        spared = [False] * count
        inside: list[bool] = []  # another article, not only main
        for tag, outer, _ in self.articles:
            inside.append(outer >= 0 and (inside[outer] or self.articles[outer][0] == "article"))
        tops = [a for a, x in enumerate(self.articles) if x[0] == "article" and not inside[a]]
        for a in tops:
            if self.articles[a][2] >= 0:
                single[self.articles[a][2]] += 1
        for i in range(count - 1, -1, -1):
            if self.parent[i] >= 0:
                held[self.parent[i]] += held[i]
                single[self.parent[i]] += single[i]
        for a in [*[a for a, x in enumerate(self.articles) if x[0] == "main" and not inside[a]], *sorted(tops, key=lambda a: -scope[a])[:1]]:
            i = self.articles[a][2]
            while i >= 0:
                spared[i] |= scope[a] > 0 and (self.articles[a][0] == "main" or single[i] == 1)
                i = self.parent[i]
        clear: list[bool] = []
        for i in range(count):
            clear.append(spared[i] and (self.parent[i] < 0 or clear[self.parent[i]]))
        beside = any(w and a >= 0 and (i < 0 or clear[i]) for w, i, a in found)  # an article outside
        out: list[bool] = []
        for i in range(count):
            around = scope[self.scope[i]] if self.scope[i] >= 0 else page
            may = not talk[i] and (self.scope[i] >= 0 or not beside or not self.whole[i])
            plain = spared[i] or (may and 2 * held[i] > around)
            out.append(not plain or (self.parent[i] >= 0 and out[self.parent[i]]))
        if not any(w and (i < 0 or not out[i]) for w, i, _ in found):
            return talk  # nothing else is left: layouts that name every part of the page
        return out


def lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """``(text, linked characters, noise, marked)`` of every block of the page in order."""
    return _blocks(page)[0]


def _blocks(page: str) -> tuple[list[tuple[str, int, bool, bool]], int]:
    """The lines of the page, and the weight of its heaviest article."""
    out: list[tuple[str, int, bool, bool]] = []
    places: list[tuple[int, int]] = []  # innermost named element and article of each line
    named, open_named, open_articles = _Named(), [-1], [-1]
    opened: Counter[str] = Counter()
    stack: list[tuple[str, bool, bool]] = []  # open elements, whether they are noise, whether named
    text: list[str] = []
    linked: list[str] = []
    state = [0, 0, 0, 0]  # open: noise, article or main, links, headers of an article

    def count(tag: str, noise: bool, by: int) -> None:
        state[0] += by * noise
        state[1] += by * (tag in ("article", "main") and not noise)
        state[2] += by * (tag == "a")
        state[3] += by * (tag == "header" and not noise)

    def flush() -> None:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                in_links = len(" ".join(html.unescape("".join(linked)).split()))
                heading = any(t in HEADINGS for t, _, _ in stack[-6:])
                noise = state[0] > 0 or (state[3] > 0 and not heading)
                out.append((whole, in_links, noise, state[1] > 0))
                places.append((open_named[-1], open_articles[-1]))
            text.clear()
            linked.clear()

    def pop(upto: int) -> None:
        while len(stack) > upto:
            tag, noise, has_name = stack.pop()
            opened[tag] -= 1
            count(tag, noise, -1)
            if has_name:
                open_named.pop()
            if tag in ("article", "main") and not noise:
                open_articles.pop()

    for kind, tag, rest in tokens(page):
        if kind == "text":
            text.append(rest)
            if state[2]:
                linked.append(rest)
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            text.append(" ")
        if kind == "start":
            if tag in BLOCKS:  # an open paragraph, or item before the next, ends here
                for depth in range(len(stack) - 1, max(-1, len(stack) - 12), -1):
                    open_tag = stack[depth][0]
                    if open_tag == "p" or (open_tag == tag and tag in CLOSES_ITSELF):
                        pop(depth)
                        break
                    if open_tag in BLOCKS and open_tag not in HEADINGS:
                        break
            if tag not in VOID and not rest.endswith("/"):
                noise = _noisy(tag, rest, state[1] > 0)
                has_name, whole, talk = _named(tag, rest)
                if has_name:
                    named.parent.append(open_named[-1])
                    named.scope.append(open_articles[-1])
                    named.comment.append(talk)
                    named.whole.append(whole)
                    open_named.append(len(named.parent) - 1)
                if tag in ("article", "main") and not noise:
                    named.articles.append((tag, open_articles[-1], open_named[-1]))
                    open_articles.append(len(named.articles) - 1)
                stack.append((tag, noise, has_name))
                opened[tag] += 1
                count(tag, noise, 1)
        elif opened[tag]:  # an end tag of nothing open is passed over at once
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    pop(depth)
                    break
    flush()
    clean = [0 if noise or in_links > LINK_SHARE * len(whole) else len(whole) for whole, in_links, noise, _ in out]
    drop = named.noise([(w, *at) for w, at in zip(clean, places, strict=True)])
    out = [(*x[:2], x[2] or (i >= 0 and drop[i]), x[3]) for x, (i, _) in zip(out, places, strict=True)]
    weight = [0] * len(named.articles)
    for (whole, _, noise, _), (_, a) in zip(out, places, strict=True):
        if a >= 0 and not noise:
            weight[a] += len(whole)
    for a in range(len(weight) - 1, -1, -1):
        if named.articles[a][1] >= 0:
            weight[named.articles[a][1]] += weight[a]
    return out, max(weight, default=0)


def runs(weights: list[int], width: int = WINDOW) -> list[tuple[int, int, int]]:
    """``(surge, dive, peak)``: first line, line after the last and highest window of each run."""
    found = []
    total, begin, peak = 0, -1, 0
    for i in range(len(weights) + width - 1):
        total += weights[i] if i < len(weights) else 0
        if i >= width:
            total -= weights[i - width]
        if total > 0:
            begin = i if begin < 0 else begin
            peak = max(peak, total)
        elif begin >= 0:
            found.append((begin, min(i, len(weights)), peak))
            begin, peak = -1, 0
    if begin >= 0:
        found.append((begin, len(weights), peak))
    return found


def _reads(text: str) -> bool:
    """Whether a line reads as a sentence and not as a label or a notice of rights."""
    return bool(SENTENCE.match(text)) and not RIGHTS.search(text)


def _weights(use: list[tuple[str, int, bool, bool]]) -> list[int]:
    """Weights of the lines of a page without a marked article.

    A line that is mostly links weighs nothing, but for a sentence that stands alone beside
    other text: a paragraph that is one link.
    """
    links = [in_links > LINK_SHARE * len(text) for text, in_links, _, _ in use]
    own = [0 if noise or link else len(text) for (text, _, noise, _), link in zip(use, links, strict=True)]
    out = list(own)
    for i, (text, _, noise, _) in enumerate(use):
        beside = [j for j in (i - 1, i + 1) if 0 <= j < len(use)]
        if links[i] and not noise and _reads(text) and any(own[j] for j in beside) and not any(links[j] for j in beside):
            out[i] = len(text)
    return out


def main_text(page: str | None) -> str:
    """The text of the page's article, blocks joined by line feeds; empty if there is none."""
    if not page:
        return ""
    every, heaviest = _blocks(page)
    outside = sum(len(t) for t, in_links, n, m in every if not m and not n and in_links <= LINK_SHARE * len(t))
    marked = heaviest > 0 and heaviest >= outside
    use = [x for x in every if x[3]] if marked else every
    # Inside a marked article links are part of the text.
    weights = [0 if noise else len(text) for text, _, noise, _ in use] if marked else _weights(use)
    found = runs(weights)
    if not found:
        return ""
    edge = 0 if marked else min(ENOUGH, SHARE * max(peak for _, _, peak in found))
    kept = []
    for begin, end, peak in found:
        if peak >= edge or any(weights[i] and _reads(use[i][0]) for i in range(begin, end)):
            kept += [use[i][0] for i in range(begin, end) if weights[i]]
    return "\n".join(kept)


def _extract(batches):
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        text = [main_text(column[i].as_py()) for i in range(len(batch))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.string())], batch.schema.names)


def extract_text(pages: DataFrame, html_col: str, text_col: str = "text") -> DataFrame:
    """``pages`` with its HTML replaced by the main text in ``text_col``.

    Null or empty HTML, and a page of noise alone, give the empty text; pages of any size
    are read whole; other columns pass through, rows are independent, an empty table gives
    an empty one.
    """
    ship()
    others = [c for c in pages.columns if c not in (html_col, text_col)]
    own = pages.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{html_col}`").cast("string").alias(text_col))
    return own.mapInArrow(_extract, own.schema)


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    """All pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages, "html").withColumn("n_chars", F.length("text").cast("bigint"))


QUERIES = {"op6_html_text": op6_html_text}
