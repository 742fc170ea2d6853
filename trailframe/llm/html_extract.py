"""Main text of HTML pages from flat text blocks and a decision tree.

A page becomes a flat list of text blocks. A block's features are its word count and link density, those of the
blocks before and after it, and what its tags say: inside a main element that is not in furniture, inside furniture
(menus, headers, footers, forms, adverts, comments and the like), a heading. An element that is named like furniture
but holds most of the page's words and its main heading is a wrapper and says nothing; names that parts of a text may
have, too, say something inside a main element only where much of what it holds is links. A decision tree, grown on the
small labelled table below, keeps or drops the block.

Edge cases: null and empty pages have an empty text; pages without tags are one block; unclosed and stray tags
close as browsers do, comments and raw text elements run to the end if unclosed; a null id or url stays null;
repeated rows are read each; an empty table gives no rows; other columns are ignored; nothing is cut off.
"""

from __future__ import annotations

import html as html_entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm.common import map_texts, table

_TAG = re.compile(r"""<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=|["'])*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([\w:-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

RAW = {"script", "style", "template", "textarea", "noscript", "iframe", "svg", "math", "object", "noembed", "noframes", "xmp", "select", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
#: Opening one of these closes an open one of the same group.
IMPLIED = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
FURNITURE_TAGS = {"nav", "aside", "form", "footer", "menu", "dialog", "button", "fieldset", "header"}
MAIN_TAGS = {"article", "main"}
#: Words of class, id and role attributes that name furniture.
FURNITURE_WORDS = set("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu
    header masthead topbar footer bottombar sidebar aside rail cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe
    subscription signup login search share sharing social follow comment comments commentlist disqus reply replies respond discussion related recommended
    recommendations trending popular breadcrumb breadcrumbs crumbs pagination pager paging toolbar widget widgets copyright legal disclaimer complementary
    contentinfo form tags taglist skip cta cmt cmts optin""".split())
#: Of those, words that also name parts of a text: inside a main element they count only where so many per cent of an element's words are links.
DOUBTFUL_WORDS, DOUBTFUL_LINKS = set("related recommended recommendations popular trending legal rail search skip banner alert discussion tags form reply respond".split()), 40
#: Of those, the words that count on a paragraph or heading itself, too, and those of reader comments, which are never wrappers.
TEXT_WORDS = set("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted cookie cookies consent gdpr
    notice notices newsletter breadcrumb breadcrumbs copyright disclaimer comment comments reply replies cta cmt cmts optin""".split())
COMMENT_WORDS = set("comment comments commentlist cmt cmts disqus reply replies respond discussion".split())
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption", "caption"}
#: A class with one of these before `header` names the head of a text; one that starts with one of those tells of others.
TEXT_HEADS, MODIFIERS = {"post", "entry", "article", "story", "content", "section", "chapter", "page"}, {"has", "no", "with", "without", "is", "js"}

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "main", "heading")
#: The labelled table: the features of a block, then whether it belongs to the article.
LABELLED = """
1 100 0 0 1 100 1 0 0 0
1 100 1 100 1 100 1 0 0 0
1 100 1 100 12 0 1 0 0 0
2 100 3 100 8 0 1 0 0 0
8 0 1 100 9 0 1 0 0 0
25 0 2 100 40 0 1 0 0 0
60 0 40 0 12 10 1 0 0 0
12 20 80 0 0 0 1 0 0 0
30 0 90 0 25 0 1 0 0 0
9 0 60 0 0 0 1 1 0 0
20 5 70 0 45 0 1 1 0 0
3 0 50 0 30 0 1 1 1 0
1 100 2 100 60 0 1 1 0 0
45 2 30 0 5 0 1 1 0 0
2 0 9 0 80 0 1 0 1 0
120 0 5 0 60 0 1 0 0 0
9 0 10 0 30 0 0 1 1 1
5 0 12 0 80 0 0 1 1 1
1 0 8 0 1 0 0 1 0 1
1 0 1 0 60 0 0 1 0 1
1 0 70 0 9 0 0 1 0 1
2 0 0 0 0 0 0 1 0 1
30 0 9 0 80 0 0 1 0 1
80 5 30 0 120 0 0 1 0 1
150 0 80 0 1 0 0 1 0 1
14 30 60 0 70 0 0 1 0 1
5 100 60 0 40 0 0 1 0 1
1 100 20 0 20 0 0 1 0 1
6 0 90 0 12 20 0 1 0 1
9 0 1 100 60 0 0 0 1 1
6 0 30 0 90 0 0 0 1 1
12 0 4 50 45 0 0 0 1 1
80 0 9 0 60 0 0 0 0 1
120 3 80 0 15 0 0 0 0 1
25 5 60 0 40 0 0 0 0 1
20 0 12 0 70 0 0 0 0 1
40 10 5 60 35 0 0 0 0 1
17 0 40 0 4 100 0 0 0 1
11 0 60 0 90 0 0 0 0 1
8 0 45 0 50 5 0 0 0 1
30 0 0 0 0 0 0 0 0 1
5 0 0 0 0 0 0 0 0 1
1 0 0 0 0 0 0 0 0 1
6 100 1 100 6 100 0 0 0 0
3 100 0 0 4 100 0 0 0 0
12 80 9 90 14 75 0 0 0 0
20 70 12 80 15 60 0 0 0 0
4 0 3 100 5 100 0 0 0 0
3 0 2 100 2 100 0 0 1 0
2 50 4 100 3 100 0 0 0 0
5 0 4 0 3 100 0 0 0 0
6 30 5 20 4 60 0 0 0 0
300 0 2 0 1 100 0 1 0 1
300 0 2 0 1 100 0 0 0 1
150 0 0 0 6 100 0 0 0 1
90 0 5 0 12 90 0 0 0 1
60 0 3 0 3 100 0 0 0 1
60 0 3 100 3 100 0 0 0 1
60 3 3 0 2 100 0 1 0 1
40 5 8 0 2 100 0 0 0 1
35 0 6 0 5 100 0 1 0 1
30 0 12 0 20 80 0 0 0 1
25 0 4 0 4 100 0 0 0 1
25 10 1 100 2 100 0 1 0 1
25 0 1 100 4 100 0 0 0 1
200 12 1 100 1 100 0 0 0 1
45 20 6 80 9 80 0 0 0 1
30 30 9 0 4 100 0 0 0 1
100 35 60 0 3 100 0 0 0 1
18 0 5 100 3 100 0 1 0 1
12 0 3 0 6 100 0 1 0 1
5 0 3 0 3 100 0 1 0 1
4 0 3 100 5 100 0 1 0 1
3 0 40 0 8 100 0 1 1 1
2 0 0 0 2 100 0 1 1 1
6 30 5 20 4 60 0 1 0 1
12 0 70 0 6 100 0 0 0 1
4 0 3 100 60 0 0 0 1 1
4 0 60 0 3 100 0 0 0 1
40 90 30 0 60 0 0 1 0 1
3 100 50 0 70 0 0 1 0 1
8 70 40 0 30 0 0 1 0 1
2 100 0 0 60 0 0 0 0 0
1 100 0 0 300 0 0 0 0 0
6 100 2 0 80 0 0 0 0 0
4 90 8 0 120 0 0 0 0 0
3 100 80 0 40 0 0 0 0 0
3 100 80 0 4 100 0 0 0 0
9 80 4 0 60 0 0 0 0 0
12 100 60 0 0 0 0 0 0 0
30 95 5 0 90 0 0 0 0 0
60 90 40 0 40 0 0 0 0 0
40 80 200 0 1 100 0 0 0 0
25 70 60 0 60 0 0 0 0 0
15 60 100 0 100 0 0 0 0 0
5 60 12 0 12 0 0 0 0 0
5 100 30 0 30 0 0 0 1 0
3 100 4 100 60 0 0 0 0 0
3 100 4 100 5 100 0 1 0 0
2 100 3 100 3 100 0 1 0 0
1 100 300 0 1 100 0 1 0 0
1 100 1 100 0 0 0 1 0 0
1 100 1 100 1 100 0 1 0 0
2 100 60 0 3 100 0 1 0 1
3 100 2 100 50 0 0 1 0 1
3 100 2 100 25 0 0 1 0 1
3 100 2 100 15 0 0 1 0 1
3 100 300 0 3 100 0 1 0 1
30 80 300 0 3 100 0 1 0 1
60 70 9 0 4 0 0 1 0 1
9 90 60 0 1 0 0 1 0 1
15 85 40 0 1 0 0 1 0 1
3 100 40 0 30 0 0 1 0 1
12 80 30 0 2 0 0 1 0 1
40 60 90 0 3 0 0 1 0 1
6 100 6 100 5 100 0 1 0 0
20 90 12 100 15 80 0 1 0 0
2 0 2 100 2 100 0 0 0 0
7 0 3 100 4 100 0 0 0 0
8 20 6 100 3 100 0 0 0 0
3 0 1 100 1 100 0 0 0 0
2 0 0 0 3 100 0 0 0 0
1 100 60 0 3 100 1 1 0 0
4 100 80 0 40 0 1 1 0 0
20 90 60 0 30 0 1 1 0 0
5 100 40 0 0 0 1 1 0 0
300 0 60 0 60 0 1 1 0 0
300 0 9 0 9 0 1 0 0 0
40 100 60 0 1 100 1 1 0 0
12 100 40 0 9 0 1 1 0 0
2 100 60 0 3 100 1 1 0 0
8 100 9 0 9 0 1 1 0 0
40 60 90 0 3 0 1 1 0 0
300 100 60 0 60 0 1 1 0 0
"""


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    rows = np.array([[float(x) for x in line.split()] for line in LABELLED.strip().splitlines()])
    return rows[:, :-1], rows[:, -1].astype(int)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple | int:
    """A tree of (feature, cut, below, above) with 0 or 1 at its leaves, by the Gini index; ties go to the first feature and cut."""
    if depth == 0 or len(set(y)) == 1:
        return int(2 * y.sum() > len(y))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] < cut
            cost = sum(len(s) * (p := s.mean()) * (1 - p) for s in (y[left], y[~left]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(cut), left)
    if best is None:
        return int(2 * y.sum() > len(y))
    _, f, cut, left = best
    return f, cut, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def verdict(tree: tuple | int, row: tuple) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


def _name_words(attributes: str) -> set[str]:
    """The words of class, id and role; `hidden` for an element that isn't shown."""
    if not attributes or not re.search(r"(?i)class|id|role|hidden|style", attributes):
        return set()
    found: set[str] = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or name == "style" and re.search(r"(?i)display\s*:\s*none", value) or name == "aria-hidden" and "true" in value:
            found.add("hidden")
        elif name in ("class", "id", "role"):
            for each in re.sub(r"([a-z])([A-Z])", r"\1 \2", value.strip("\"'")).replace("_", "-").lower().split():
                words = re.findall(r"[a-z]+", each)
                if words and words[0] not in MODIFIERS:
                    found.update(w for w in words if w != "header" or not TEXT_HEADS & set(words))
    return found


class _Element:
    """An open element: `named` says that its class, id or role is furniture, `tagged` that its tag is; what it holds is added up."""

    def __init__(self, tag: str, attributes: str, in_main: bool):
        words = _name_words(attributes)
        self.tag, self.main = tag, tag in MAIN_TAGS
        self.hidden, self.comment = "hidden" in words, bool(COMMENT_WORDS & words)
        whole = tag in ("html", "body", "head")
        self.named = not whole and not self.main and bool(words & (TEXT_WORDS if tag in TEXT_TAGS else FURNITURE_WORDS))
        self.named = self.named or self.main and self.comment
        self.tagged = tag in FURNITURE_TAGS and not (tag == "header" and in_main)
        self.doubtful = in_main and self.named and not self.comment and (words & FURNITURE_WORDS) <= DOUBTFUL_WORDS
        self.words, self.linked, self.top = 0, 0, False

    def is_furniture(self, words: int, has_top: bool) -> bool:
        if self.hidden or not (self.named or self.tagged):
            return self.hidden
        if self.doubtful and not self.tagged:
            return 100 * self.linked >= DOUBTFUL_LINKS * self.words
        wrapper = not self.comment and (self.top and 2 * self.words >= words or not has_top and 5 * self.words >= 4 * words)
        return not wrapper


def blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """(text, words, link density in percent, in furniture, in main, is heading) of the text blocks in page order."""
    out: list = []
    stack: list[_Element] = []
    parts: list[str] = []
    linked: list[str] = []
    in_link, at, n = 0, 0, len(page)
    heading = ""

    def flush() -> None:
        if parts:
            text = " ".join(html_entities.unescape("".join(parts)).split())
            if text:
                words = text.count(" ") + 1
                links = len(html_entities.unescape("".join(linked)).split()) if linked else 0
                out.append((text, words, round(100 * min(links, words) / words), tuple(stack), int(heading != "")))
                for e in stack:
                    e.words += words
                    e.linked += min(links, words)
                    e.top = e.top or heading == "h1" or any(x.tag == "main" for x in stack)
            parts.clear()
            linked.clear()

    def text_run(run: str) -> None:
        if run:
            parts.append(run)
            if in_link:
                linked.append(run)

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            text_run(page[at:])
            break
        text_run(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            if m[0].startswith("<![CDATA["):
                text_run(html_entities.escape(m[0][9:-3], quote=False))
            continue
        name, closing = name.lower(), bool(m[1])
        if name == "br" or name == "wbr":
            text_run(" " if name == "br" else "")
        elif name == "a":
            in_link = 0 if closing else 1
            text_run("")
        elif name in RAW and not closing:
            if not m[3].endswith("/") or name in ("script", "style"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
        elif name in VOID or name in RAW:
            if name == "hr":
                flush()
        elif name in INLINE and not (m[3] and _name_words(m[3]) & (TEXT_WORDS | {"hidden"})):
            if closing and any(s.tag == name for s in stack):  # one that was pushed as furniture
                flush()
                while stack.pop().tag != name:
                    pass
        elif closing:
            flush()
            in_link = 0
            heading = "" if re.fullmatch(r"h[1-6]", name) else heading
            if any(s.tag == name for s in stack):
                while stack.pop().tag != name:
                    pass
        else:
            flush()
            heading = name if re.fullmatch(r"h[1-6]", name) else ""
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag not in IMPLIED.get(name, ()) and not (stack[k].tag == "p" and name not in INLINE):
                    break
                stack.pop()
            stack.append(_Element(name, m[3], any(s.main for s in stack)))
    flush()
    words, has_top = sum(b[1] for b in out if not any(e.comment for e in b[3])), any(e.top for b in out for e in b[3][:1])
    verdicts: dict[int, bool] = {}
    found = []
    for text, size, links, around, is_heading in out:
        furniture = main = False
        for e in around:
            main = main or e.main and not furniture  # a teaser or a comment may be an article, too
            if id(e) not in verdicts:
                verdicts[id(e)] = e.is_furniture(words, has_top)
            furniture = furniture or verdicts[id(e)]
        found.append((text, size, links, int(furniture), int(main), is_heading))
    return found


def main_text(page: str | None, tree: tuple | int) -> str:
    found = blocks(page) if page else []
    kept = []
    for i, (text, words, links, furniture, main, heading) in enumerate(found):
        before = found[i - 1][1:3] if i else (0, 0)
        after = found[i + 1][1:3] if i + 1 < len(found) else (0, 0)
        if verdict(tree, (words, links, *before, *after, furniture, main, heading)):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    def make():
        tree = grow(*labelled_table())

        def each(batch: pa.RecordBatch) -> dict:
            texts = [main_text(x, tree) for x in batch.column("html").to_pylist()]
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

        return each

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_texts(rows, make, "page_id long, url string, text string, n_chars long")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
