"""HTML extraction: flat text blocks, their word counts and link densities and those of their neighbours, classified by a decision tree.

The page is cut at block-level tags into flat blocks of text. Each block has its number of words, its link density (words inside
links over words), the same of the block before and after it, and what encloses it (an article; navigation or other matter
that a page wraps around its text). Words in class, id or role say nothing of an element that holds the page's chief text. A decision tree, grown from
the blocks of a few labelled pages, tells main text from the rest.

Defined results
- A null or empty page has an empty text. Repeated rows are extracted one by one. Very long pages are read whole. An empty
  table gives an empty result. Unclosed tags, comments and quotes end with the page. Other columns pass through;
  one with the name of the output column (whatever the case) is an error.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import refuse

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WHITE = re.compile(r"[\s ]+")

#: Elements whose content is not text of the page.
UNSEEN = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "textarea", "select", "option", "button", "object"}
#: Of these, the ones in which markup means nothing until their end tag.
RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "template", "svg"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that stand around a page's text, and words in class, id or role that say the same of any element.
AROUND = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
HINT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav\w*|newsletter|notice|popup|promo\w*|related|repl(?:y|ies)|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget|contentinfo|complementary|search|alert)(?:$|[\s_-])", re.I)
#: Elements that a head may hold; any other ends it, as its end tag may be left out.
IN_HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "title", "style", "script", "noscript", "template"}
#: Elements that end with a parent or with the next of their kind, as browsers close them.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

FEATURES = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "in_article", "around", "heading", "listed"]

#: Labelled pages: [+40] stands for 40 words of main text, [-3] for 3 words of anything else; a after the number: all inside a link;
#: /2: two of them. Some layouts name what stands around the text, in others sizes and links alone tell.
LABELLED = [
    # an article with marked surroundings, a sidebar and comments inside it
    "<header><p>[-2a]<p>[-5]</header><nav><ul><li>[-1a]<li>[-1a]<li>[-2a]</ul></nav><article><h1>[+8]</h1><p>[+70]<p>[+35/3]<p>[+1]<aside><p>[-24]<p>[-3a]</aside><h2>[+2]</h2><p>[+4]<ul><li>[+12]<li>[+3]<li>[+5/2]</ul><p>[+120]<section class=comments><h3>[-1]</h3><p>[-45]<p>[-8]</section></article><footer><p>[-9]<p>[-12/3]</footer>",
    "<div class=cookie-notice>[-25/2]</div><div class=menu><div>[-1a]</div><div>[-1a]</div></div><main><h1>[+5]</h1><div>[+50]</div><div>[+1]</div><div>[+1]</div><div>[+80]</div><div class=advert><p>[-40]<p>[-2a]</div><div>[+30]</div><form><p>[-6]<p>[-3]</form></main><div class=sidebar><h3>[-2]</h3><p>[-60]</div>",
    "<nav>[-2a]</nav><article><p>[+1]<p>[+3a]<p>[+18]</article><aside><p>[-70]<p>[-80]</aside>",
    "<div class=banner><p>[-30]</div><article><h2>[+3]</h2><blockquote>[+22]</blockquote><pre>[+9]</pre><p>[+2]</article><div class=related><ul><li>[-6a]<li>[-8a]</ul></div><div class=newsletter><p>[-14]</div>",
    # articles of short lines, lists of links and single words; pages whose surroundings are long texts
    "<nav>[-1a] [-1a]</nav><article><h1>[+4]</h1><p>[+1]<p>[+1]<p>[+2]<p>[+1]<p>[+6]<p>[+1]</article><footer>[-3]</footer>",
    "<article><p>[+2a]<p>[+1a]<p>[+5/4]<p>[+40]<p>[+3a]<p>[+1]</article><div class=sharing><p>[-2a]<p>[-1a]</div>",
    "<main><h2>[+2]</h2><ul><li>[+4a]<li>[+6a]<li>[+2]<li>[+1]</ul><p>[+9/8]<p>[+2]</main><aside><p>[-50]<p>[-4]<p>[-35/2]</aside>",
    "<article><p>[+5]<p>[+2]<p>[+7]<p>[+3]<p>[+1a]<p>[+2]</article><section class=comments><p>[-60]<p>[-2]<p>[-33]<p>[-1]</section>",
    "<header><h1>[-3]</h1><p>[-18]</header><article><h1>[+6]</h1><p>[+2]<p>[+55]<p>[+1]<p>[+1a]</article><form><p>[-9]<p>[-30]</form>",
    # names that tell nothing
    "<div class=a1><div>[-1a]</div><div>[-1a]</div><div>[-2a]</div></div><div class=b2><h1>[+7]</h1><div>[+64]</div><div>[+45/2]</div><div>[+8]</div><div>[+51]</div></div><div class=c3><div>[-5a]</div><div>[-6a]</div><div>[-4a]</div></div><div>[-6]</div>",
    "<div>[-3a]</div><div>[-2a]</div><div>[-4/3]</div><div>[+28]</div><div>[+33]</div><div>[+19/2]</div><div>[+40]</div><div>[-3a]</div><div>[-4]</div><div>[-2a]</div>",
    "<table><tr><td>[-2a]<td>[-1a]<td>[-3a]</tr></table><p>[+60]<p>[+14]<p>[+36]<p>[+25]<table><tr><td>[-1a]<td>[-2]<td>[-1a]</tr></table>",
    "<ul><li>[-1a]<li>[-3a]<li>[-2a]</ul><h2>[+4]</h2><p>[+90]<ul><li>[+25]<li>[+30]<li>[+28]</ul><p>[+55]<ul><li>[-5a]<li>[-6/5]<li>[-2a]</ul><p>[-3]",
    "<div>[-12/10]</div><div>[-9/7]</div><div>[-14/12]</div><h3>[+6]</h3><div>[+47]</div><div>[+22/3]</div><div>[+72]</div><div>[-5/4]</div><div>[-2/1]</div><div>[-3a]</div><div>[-4]</div>",
    "<p>[+20]", "<p>[+12]<p>[+12]<p>[+14]", "<p>[+5]<p>[+45]<p>[+6]<p>[+60]<p>[+3]<p>[+40]",
    "<div>[-2]</div><div>[-2a]</div><div>[-3]</div><div>[-1a]</div><div>[+44]</div><div>[+16]</div><div>[+38]</div><div>[-1]</div><div>[-2a]</div><div>[-1]</div>",
    "<h1>[+5]</h1><p>[+30]<p>[+2]<p>[+41]<h2>[+3]</h2><p>[+26]<h4>[-2]</h4><p>[-4a]<p>[-5a]<h4>[-1]</h4><p>[-2a]",
]
BLANKS = re.compile(r"\[([+-])(\d+)(a|/\d+)?\]")


def labelled_page(outline: str) -> str:
    """A page of LABELLED with words for its blanks; main text begins with +, the rest with -."""

    def words(m: re.Match) -> str:
        n = int(m[2])
        linked = n if m[3] == "a" else int((m[3] or "/0")[1:])
        of = [f"w{k}" for k in range(n)]
        of[0] = m[1] + of[0]
        return " ".join(of[: n - linked]) + (f" <a href=x>{' '.join(of[n - linked :])}</a>" if linked else "")

    return BLANKS.sub(words, outline)


def learned_tree(outlines: list[str]) -> tuple:
    """The decision tree grown from the blocks of labelled pages."""
    found = [blocks(labelled_page(x)) for x in outlines]
    labels = [b.text.startswith("+") for page in found for b in page]
    return grow(np.vstack([features(page) for page in found]), np.array(labels, float))


@dataclass
class Block:
    """hint and article: the innermost hinted element, and article or main, around the block, by number."""

    text: str
    words: int
    linked: int
    in_article: bool
    around: bool
    heading: bool
    listed: bool
    hint: int | None = None
    article: int | None = None


@dataclass
class _Article:
    """An article or main: the innermost hinted element and article around it, and whether its own class, id or role has a hint."""

    name: str
    hint: int | None
    article: int | None
    hinted: bool
    words: int = 0


#: What an open element makes of the text inside it.
ROLES = {**dict.fromkeys(UNSEEN, "unseen"), "a": "link", **dict.fromkeys(("article", "main"), "article"), **dict.fromkeys(AROUND, "around"), **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading"), **dict.fromkeys(("li", "dt", "dd"), "listed")}


@dataclass
class _Reader:
    """The stack of open elements (name, innermost hint, innermost article), how many of each name and role are open, and the block being gathered."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[tuple[str, int | None, int | None]] = field(default_factory=list)
    names: Counter = field(default_factory=Counter)
    roles: Counter = field(default_factory=Counter)
    parts: list[tuple[str, bool]] = field(default_factory=list)
    articles: list[_Article] = field(default_factory=list)
    parents: list[int | None] = field(default_factory=list)  # of each hinted element, the one around it

    def push(self, name: str, hint: int | None, article: int | None) -> None:
        self.stack.append((name, hint, article))
        self.names[name] += 1
        self.roles[ROLES.get(name)] += 1

    def cut(self, depth: int) -> None:
        """Closes all elements but the first depth."""
        while len(self.stack) > depth:
            name = self.stack.pop()[0]
            self.names[name] -= 1
            self.roles[ROLES.get(name)] -= 1

    def inner(self) -> tuple[int | None, int | None]:
        return self.stack[-1][1:] if self.stack else (None, None)

    def end_head(self) -> None:
        if self.names["head"]:
            self.cut(max(k for k, x in enumerate(self.stack) if x[0] == "head"))

    def add(self, raw: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and raw.strip():
            self.end_head()
        if raw and not self.roles["unseen"]:
            self.parts.append((raw, self.roles["link"] > 0))

    def flush(self) -> None:
        parts, self.parts = self.parts, []
        text = WHITE.sub(" ", entities.unescape("".join(p for p, _ in parts))).strip()
        if text:
            linked = sum(len(entities.unescape(p).split()) for p, a in parts if a)
            open_ = [self.roles[x] > 0 for x in ("article", "around", "heading", "listed")]
            self.blocks.append(Block(text, len(text.split()), linked, *open_, *self.inner()))

    def open(self, name: str, attributes: str, closed: bool) -> None:
        if name in BLOCK:
            self.flush()
        elif name == "br":
            self.parts.append((" ", False))
        if name in VOID or (closed and name not in BLOCK):
            return
        if name in BLOCK and self.stack:
            ends = CLOSES.get(name) or ({"p"} if name not in {"td", "th", "li"} else set())
            # An open p ends where a block begins; other items end at the next of their kind in the same parent.
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in ends:
                    self.cut(k)
                    break
                if self.stack[k][0] in BLOCK and self.stack[k][0] != "p":
                    break
        hinted = any(HINT.search(a or b or c) for _, a, b, c in ATTRIBUTE.findall(attributes))
        hint, article = self.inner()
        if name in {"article", "main"}:
            self.articles.append(_Article(name, hint, article, hinted))
            article = len(self.articles) - 1
        if hinted and name not in {"html", "body", "article", "main"} | AROUND:
            self.parents.append(hint)
            hint = len(self.parents) - 1
        self.push(name, hint, article)

    def close(self, name: str) -> None:
        if name in BLOCK:
            self.flush()
        if not self.names[name]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                self.cut(k)
                return
            if name not in BLOCK and self.stack[k][0] in BLOCK - {"p"}:
                return


def blocks(page: str) -> list[Block]:
    """The page's flat blocks of text, in order."""
    reader, at = _Reader(), 0
    while True:
        m = TOKEN.search(page, at)
        reader.add(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            reader.close(name)
            continue
        if name not in IN_HEAD:
            reader.end_head()
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
        else:
            reader.open(name, m[3], m[3].endswith("/"))
    reader.flush()
    wrappers = _wrappers(reader)
    # Whether an element or one around it has a hint and wraps no chief text; elements come after those around them.
    around: list[bool] = []
    for k, parent in enumerate(reader.parents):
        around.append(k not in wrappers or (parent is not None and around[parent]))
    for b in reader.blocks:
        b.around = b.around or (b.hint is not None and around[b.hint])
    return reader.blocks


def _wrappers(reader: _Reader) -> set[int]:
    """The hinted elements that hold the page's chief text: its longest main, and its longest article without a hint of its own (with a main, one
    of over half of its words). On a page without either, the elements with over half of all words."""
    held = [0] * len(reader.parents)
    for b in reader.blocks:
        if b.hint is not None:
            held[b.hint] += b.words
        if b.article is not None:
            reader.articles[b.article].words += b.words
    for k in range(len(held) - 1, -1, -1):
        if reader.parents[k] is not None:
            held[reader.parents[k]] += held[k]
    for a in reversed(reader.articles):
        if a.article is not None:
            reader.articles[a.article].words += a.words
    longest = lambda name: max((a for a in reversed(reader.articles) if a.name == name and not (a.hinted and name == "article")), key=lambda a: a.words, default=None)
    main, article = longest("main"), longest("article")
    if main is not None and article is not None and 2 * article.words <= main.words:
        article = None
    if main is None and article is None:
        total = sum(b.words for b in reader.blocks)
        return {k for k, n in enumerate(held) if 2 * n > total} if not reader.articles else set()
    found = set()
    for a in (main, article):
        k = a.hint if a is not None else None
        while k is not None and k not in found:
            found.add(k)
            k = reader.parents[k]
    return found


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    own = np.array([[b.words, min(1.0, b.linked / max(b.words, 1))] for b in found], float).reshape(-1, 2)
    around = np.vstack([np.zeros((1, 2)), own, np.zeros((1, 2))])
    kind = np.array([[b.in_article, b.around, b.heading, b.listed] for b in found], float).reshape(-1, 4)
    return np.hstack([own, around[:-2], around[2:], kind])


def grow(x: np.ndarray, y: np.ndarray, least: int = 1, depth: int = 8) -> tuple:
    """A decision tree by Gini impurity: (feature, threshold, tree up to it, tree above it), or (share of ones,)."""
    share = float(y.mean()) if len(y) else 0.0
    best = None
    if depth and share not in (0.0, 1.0):
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for threshold in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= threshold
                n = int(low.sum())
                if min(n, len(y) - n) < least:
                    continue
                p, q = y[low].mean(), y[~low].mean()
                impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
                if best is None or impurity < best[0] - 1e-12:
                    best = impurity, f, float(threshold), low
    if best is None:
        return (share,)
    _, f, threshold, low = best
    return (f, threshold, grow(x[low], y[low], least, depth - 1), grow(x[~low], y[~low], least, depth - 1))


def classify(tree: tuple, row: np.ndarray) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0] >= 0.5


def main_text(page: str, tree: tuple) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if classify(tree, row))


def extract_text(df: DataFrame, html: str = "html", out: str = "text", labelled: list[str] | None = None) -> DataFrame:
    """df with the main text of each page. labelled: pages as in LABELLED, from whose blocks the tree is grown."""
    refuse(df, out)
    tree = learned_tree(LABELLED if labelled is None else labelled)

    @F.pandas_udf("string")
    def extract(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series(["" if page is None else main_text(page, tree) for page in batch], dtype=object)

    return df.withColumn(out, extract(F.col(html)))
