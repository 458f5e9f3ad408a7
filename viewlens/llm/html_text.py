"""HTML extraction by tree scoring.

Paragraphs give points for their length and commas to the elements above
them, discounted by link density; the best container and those of its
siblings that score alike are kept.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by what they mean for the extraction.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("""head script style noscript template nav footer aside form button select textarea option datalist
iframe object embed svg canvas video audio map menu dialog fieldset applet math""".split())
BLOCKS = frozenset("""address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2
h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul""".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
CLOSES_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr li dd dt summary figcaption".split())
#: An open element of the value ends where the key starts.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody"), "tfoot": ("tbody",)}
SCOPES = frozenset("ul ol dl table div article section body html main td th blockquote".split())

#: Words of a class, id or role that mark other than the article.
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adbox|adslot|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|"
    r"comments?|commentlist|disqus|replies|reply|respond|sidebar|side|aside|widgets?|menu|menubar|nav|navbar|navigation|"
    r"breadcrumbs?|pagination|pager|footer|foot|header|masthead|topbar|toolbar|share|sharing|social|related|recommend\w*|"
    r"newsletter|subscribe|signup|login|popup|modal|overlay|search|form|tags|taglist|skip|contentinfo|complementary|hidden)"
    r"(?:$|[\s_-])", re.I)
#: Of these, words that a paragraph of the article may well carry itself.
SOFT = re.compile(
    r"(?:^|(?<=[\s_-]))(?:social|related|recommend\w*|search|side|aside|form|tags|foot|head|header|footer|menu|nav|widgets?|"
    r"banner|alerts?|modal|skip|hidden|reply|respond)(?=$|[\s_-])", re.I)
#: Such a word after one of these only describes the page's layout.
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|with|without|no)[_-][\w-]+", re.I)
#: ... unless the element says that it is the article.
WANTED = re.compile(r"(?:^|[\s_-])(?:article|post-?body|post-?content|entry-?content|main-?content|story)(?:$|[\s_-])", re.I)

#: Points: for a paragraph, for each 100 characters (three at most), for a
#: comma; the share of the best score that a sibling needs.
BASE, EVERY, MOST, SIBLING = 1.0, 100, 3, 0.2
#: Elements nested deeper lie beside each other at this depth (no text is lost).
DEEPEST = 512
_SPACE = re.compile(r"\s+")
#: A "<" that can open a tag; any other is text.
_OPENS = re.compile(r"<[A-Za-z/!?]|<$")


class Node:
    __slots__ = ("tag", "parent", "kids", "score", "drop", "depth")

    def __init__(self, tag: str, parent: "Node | None", drop: bool):
        self.tag, self.parent, self.kids, self.score, self.drop = tag, parent, [], 0.0, drop
        self.depth = parent.depth + 1 if parent else 0


class Tree(HTMLParser):
    """A tolerant tree: unclosed and misnested elements end where their
    parents do."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, False)

    def _up_to(self, tags, scope) -> None:
        node = self.at
        while node.parent is not None and node.tag not in scope:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def _in_article(self) -> bool:
        node = self.at
        while node is not None and node.tag not in ("article", "main"):
            node = node.parent
        return node is not None

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        if tag in CLOSES_P:
            self._up_to(("p",), SCOPES - {"p"})
        if tag in ENDS:
            self._up_to(ENDS[tag], SCOPES - {"td", "th"} if tag in ("tr", "td", "th") else SCOPES)
        if tag == "br":
            self.at.kids.append(" ")
            return
        if tag in VOID:
            return
        drop = tag in DROPPED
        if not drop and tag not in ("article", "main"):
            named = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
            named = LAYOUT.sub("", named)
            if tag in ("p", "pre", "blockquote") and self._in_article():
                named = SOFT.sub("", named)
            drop = bool(named and UNWANTED.search(named) and not WANTED.search(named))
            hidden = {k: v for k, v in attrs}
            drop = drop or "hidden" in hidden or hidden.get("aria-hidden") == "true" or bool(
                re.search(r"display\s*:\s*none", hidden.get("style") or ""))
        if tag == "header":  # a page's, but not an article's own heading
            drop = not self._in_article()
        kid = Node(tag, self.at, drop)
        self.at.kids.append(kid)
        if drop or kid.depth < DEEPEST:
            self.at = kid

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            # an inline end tag never closes a block
            if node.tag in BLOCKS and tag not in BLOCKS and tag not in DROPPED:
                return
            node = node.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(html: str) -> Node:
    # a tag that never ends is cut off: the parser would look for its end
    # again from every "<" that follows
    cut = _OPENS.search(html, html.rfind(">") + 1)
    tree = Tree()
    tree.feed(html[:cut.start()] if cut else html)
    tree.close()
    return tree.root


def _walk(root: Node):
    """Elements outside dropped ones, parents first."""
    todo = [root]
    while todo:
        node = todo.pop()
        if node.drop:
            continue
        yield node
        todo.extend(k for k in reversed(node.kids) if type(k) is Node)


def _measure(order: list[Node]) -> dict[Node, tuple[int, int, int]]:
    """Characters, characters in links and commas below each element."""
    sums: dict[Node, list[int]] = {}
    for node in reversed(order):  # children first
        size = links = commas = 0
        for k in node.kids:
            if type(k) is str:
                t = _SPACE.sub(" ", k)
                if t != " ":
                    size += len(t)
                    commas += t.count(",")
            elif k in sums:
                s, l, c = sums[k]
                size, links, commas = size + s, links + l, commas + c
        sums[node] = (size, size if node.tag == "a" else links, commas)
    return sums


def blocks(root: Node) -> list[str]:
    """Texts of the blocks below ``root`` in page order, white space folded."""
    out, run = [], []

    def close():
        text = _SPACE.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    todo: list = [root]
    while todo:
        item = todo.pop()
        if item is None:
            close()
        elif type(item) is str:
            run.append(item)
        elif not item.drop:
            if item.tag in BLOCKS:
                close()
                todo.append(None)
            todo.extend(reversed(item.kids))
    close()
    return out


def main_text(html: str) -> str:
    """The article of a page; empty if there is no text."""
    root = parse(html)
    order = list(_walk(root))
    sums = _measure(order)

    def points(node: Node) -> float:
        size, links, commas = sums[node]
        return (BASE + min(size / EVERY, MOST) + commas) * (1 - links / size) if size else 0.0

    scored: dict[Node, None] = {}
    for node in order:
        direct = any(type(k) is str and k.strip() for k in node.kids)
        if node.tag not in PARAGRAPHS and not (node.tag in ("div", "section", "article", "main") and direct):
            continue
        if not sums[node][0]:
            continue
        above, share = node.parent, 1.0
        if node.tag not in PARAGRAPHS:  # text right in a container scores there
            above = node
        for _ in range(2):
            if above is None:
                break
            above.score += points(node) * share
            scored[above] = None
            above, share = above.parent, 0.5
    if not scored:
        return "\n".join(blocks(root))
    density = lambda n: sums[n][1] / sums[n][0] if sums[n][0] else 0.0
    best = max(scored, key=lambda n: n.score * (1 - density(n)))  # ties: the first in the page
    for node in order:  # an element that says it is the article holds its whole text
        if node.tag == "article" and (node in _above(best) or best in _above(node)) and sums[node][0] >= sums[best][0] * 0.5:
            best = node if sums[node][0] >= sums[best][0] or node.score else best
    need = best.score * (1 - density(best)) * SIBLING
    if best.parent is None or best.tag in ("article", "main"):
        near = [k for k in best.parent.kids if type(k) is Node and k.tag == "article" and not k.drop] if (
            best.tag == "article" and best.parent is not None) else []
        kept = near or [best]
    else:
        kept = []
        for k in best.parent.kids:
            if type(k) is not Node or k.drop:
                continue
            size = sums[k][0]
            heading = k.tag in ("h1", "h2", "h3")
            prose = k.tag == "p" and size and (size > 80 and density(k) < 0.25 or density(k) == 0)
            alone = k.tag in ("pre", "blockquote", "h4", "h5", "h6") and points(k) >= need  # its points went to the parent
            if k is best or heading or prose or alone or k.score * (1 - density(k)) >= need:
                kept.append(k)
    if best.tag not in ("article", "main"):  # what says it is the article is kept whole, its lists of links too
        own = set(kept)
        for node in (x for k in kept for x in _walk(k)):
            if node not in own and node.tag in ("ul", "ol", "div", "table", "section") and density(node) > 0.6:
                node.drop = True
    return "\n".join(t for k in kept for t in blocks(k))


def _above(node: Node) -> set:
    out = set()
    while node.parent is not None:
        node = node.parent
        out.add(node)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``(page_id, *keep, text, n_chars)`` for each row of ``pages``.

    A null or empty page, and one without text, has an empty text. Markup
    that is broken or cut off is read as far as it goes. Ids and kept
    columns pass as they are, null or repeated; among containers of equal
    score the first counts. Other columns are not read.
    """
    kept = [id_col, *keep]

    def run(batches):
        for b in batches:
            texts = [main_text(h) if h else "" for h in b.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in kept), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    rows = pages.select(*kept, F.col(html))
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", text string, n_chars long"
    return rows.mapInArrow(run, schema)
