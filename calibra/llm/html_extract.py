"""Main text of web pages by scoring the element tree.

Paragraphs give points for their length and commas to their parent,
grandparent and further ancestors (less with each step); an element's points
are discounted by the share of its text that lies in links, and raised or
lowered by words of its class names.  The best element, and those of its
siblings that look like more of the same, are the article.

Page furniture is left out before and inside it: elements of certain kinds and
roles, and those with a class name that names nothing else ("comment-list",
"site-footer", but not "has-sidebar").  Where that leaves no text, only kinds
and roles count.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from calibra.llm.common import ddl, map_arrow, others, table, with_text

#: Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object textarea select button canvas audio video title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split())
FURNITURE = frozenset("nav footer aside form menu dialog head fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar alert form".split())
#: Words of class and id names that mark furniture, or the article.
NEGATIVE = frozenset(
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner breadcrumb breadcrumbs "
    "comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices alert alerts "
    "footer footnav header masthead topbar menu nav navbar navigation pager pagination popup modal overlay newsletter "
    "subscribe subscription signup login related recommended share sharing social sidebar widget widgets skip toolbar "
    "hidden disclaimer copyright".split())
POSITIVE = frozenset("article articlebody body content entry hentry main post story text blog page".split())
#: Words that leave the meaning of the others in a class name as it is, those
#: that turn it round, and furniture whatever it stands beside.
NEUTRAL = frozenset(
    "area aside bar big block bottom box button card cell center col column container desktop element first fixed full global group "
    "header holder id inner item items js large last left level line link links list local main message mobile module nested new "
    "outer panel page post posts primary region right root row secondary section set site slot small stack sticky sub tab thread top "
    "unit web wrap wrapper".split())
TURNS = frozenset("has no not with without is hide show overflow visually can".split())
ALWAYS = frozenset({"comment", "comments", "ad", "ads", "advert", "cookie", "sidebar"})
#: Elements open inside each other at most; deeper ones add their text to the
#: element around them.
DEPTH = 512
#: An open element of the key's kind ends where one of the value's kinds begins.
CLOSED_BY = {
    "p": BLOCK - {"body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup"},
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
#: An end tag, or an implied end, does not reach across these.
SCOPE = frozenset("table td th article section div body html".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?])[^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?"
                    r"|<([a-zA-Z][^\s/>]*)((?:[^\s\"'>]+|\"[^\"]*\"|'[^']*'|\s+|[\"'])*)>?", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")
_PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "parent", "kids", "names", "out", "named", "score", "chars", "linked", "own", "commas")

    def __init__(self, tag: str, parent: Node | None, names: frozenset[str] = frozenset(), out: bool = False, named: bool = False):
        self.tag, self.parent, self.names, self.out, self.named = tag, parent, names, out, named
        self.kids: list[Node | str] = []
        self.score = 0.0
        self.chars = self.linked = self.own = self.commas = 0


def _furniture(name: str) -> tuple[set[str], bool]:
    """The words of one class name, and whether it names furniture and nothing
    else.  A name that says what an element has or lacks says nothing."""
    words = [w.lower() for w in _NAME.findall(name)]
    if not words or (words[0] in TURNS and len(words) > 1):
        return set(), False
    found = {*words, name.lower()}
    bad = name.lower() in NEGATIVE or (any(w in NEGATIVE for w in words) and all(w in NEGATIVE or w in NEUTRAL for w in words))
    return found, bad or bool(found & ALWAYS and found & (POSITIVE | NEUTRAL))


def _attributes(tag: str, raw: str) -> tuple[frozenset[str], bool, bool]:
    """The words of an element's class and id, whether it is furniture by kind
    or role, and whether by name."""
    names: set[str] = set()
    out, named, good = tag in FURNITURE, False, False
    for m in _ATTR.finditer(raw):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id"):
            for name in unescape(value).split():
                words, bad = _furniture(name)
                names |= words
                named |= bad
                good |= name.lower() in POSITIVE
        elif key == "role":
            out |= value.lower() in FURNITURE_ROLES
        elif key == "hidden" and m.start() and raw[m.start() - 1].isspace():
            out |= tag not in ("body", "html")
        elif key == "aria-hidden":
            out |= value.lower() == "true"
    # a whole name of the article outweighs others, but for comments, adverts and the like
    named &= tag not in ("html", "body", "article", "main") and (not good or bool(names & ALWAYS))
    return frozenset(names), out, named


def parse(html: str) -> Node:
    """The element tree, mended where tags are missing or cross."""
    root = Node("html", None)
    stack = [root]
    end = len(html)
    at = 0

    def text(upto: int) -> None:
        if at < upto:
            piece = html[at:upto]
            stack[-1].kids.append(unescape(piece) if "&" in piece else piece)

    for m in _TOKEN.finditer(html):
        if m.start() < at:  # inside a raw element
            continue
        text(m.start())
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE and tag not in SCOPE:
                    break
        elif m[2]:
            tag = m[2].lower()
            if tag in RAW:
                if not m[0].endswith("/>"):
                    close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
                    at = close.end() if close else end
                continue
            if tag in ("html", "body") and any(x.tag == tag for x in stack[1:]):
                continue
            if tag in BLOCK:
                for i in range(len(stack) - 1, 0, -1):
                    if tag in CLOSED_BY.get(stack[i].tag, ()):
                        del stack[i:]
                        break
                    if stack[i].tag in SCOPE:
                        break
            names, out, named = _attributes(tag, m[3]) if m[3] else (frozenset(), tag in FURNITURE, False)
            node = Node(tag, stack[-1], names, out, named)
            stack[-1].kids.append(node)
            if tag not in VOID and not m[0].endswith("/>") and len(stack) < DEPTH:
                stack.append(node)
    text(end)
    return root


def _walk(root: Node):
    """Elements in page order; furniture is passed over."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(k for k in reversed(node.kids) if isinstance(k, Node) and not k.out)


def _mark_furniture(root: Node, by_name: bool) -> None:
    """Decide what is furniture: by kind or role, by name if asked for, and
    header elements unless they head an article."""
    if by_name:
        for node in list(_walk(root)):
            node.out |= node.named
    for node in list(_walk(root)):
        if node.tag == "header":
            up, kids = node.parent, [x.tag for x in _walk(node)]
            while up is not None and up.tag not in ("article", "main"):
                up = up.parent
            node.out = up is None or not any(t in ("h1", "h2") for t in kids)


def score(root: Node) -> list[Node]:
    """Give points; the elements that have some, in page order."""
    nodes = list(_walk(root))
    scored: dict[int, Node] = {}
    for node in reversed(nodes):  # children come before their parents
        words = " ".join(" ".join(k for k in node.kids if isinstance(k, str)).split())
        node.own += len(words)
        node.commas += words.count(",") + words.count("，") + words.count("、")
        node.chars += len(words)
        if node.tag == "a":
            node.linked = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            if node.tag not in BLOCK:  # the text of a block: its own and that of inline elements in it
                node.parent.own += node.own
                node.parent.commas += node.commas
    for node in nodes:
        if node.tag not in BLOCK:
            continue
        chars = node.own
        if not chars or (node.tag not in _PARAGRAPH and chars < 25):
            continue
        points = 1.0 + node.commas + min(chars / 100, 3.0)
        if chars < 25:
            points = 0.5
        up = node.parent if node.tag in _PARAGRAPH else node
        level = 0
        while up is not None and level < 5:
            if id(up) not in scored:
                scored[id(up)] = up
                up.score = {"article": 25.0, "main": 15.0, "div": 5.0, "section": 3.0, "body": -5.0, "html": -25.0, "ul": -3.0,
                            "ol": -3.0, "dl": -3.0, "table": -3.0}.get(up.tag, 0.0)
                up.score += 25.0 * bool(up.names & POSITIVE) * (up.tag not in ("body", "html")) - 25.0 * bool(up.names & NEGATIVE)
            up.score += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            up, level = up.parent, level + 1
    for node in scored.values():
        node.score *= 1 - (node.linked / node.chars if node.chars else 0)
    return [n for n in nodes if id(n) in scored]


def article(root: Node, by_name: bool = True) -> list[Node]:
    """The best container and the siblings that go with it, in page order."""
    _mark_furniture(root, by_name)
    scored = score(root)
    if not scored:
        return [root] if root.chars else []
    best = max(scored, key=lambda n: n.score)
    up = best
    while up is not None and up.tag != "article":
        up = up.parent
    if up is not None:
        # an article stands for itself; of its siblings only other articles go with it
        limit = max(10.0, 0.2 * max(up.score, best.score))
        kids = up.parent.kids if up.parent is not None else [up]
        return [k for k in kids if k is up or (isinstance(k, Node) and not k.out and k.tag == "article" and k.score >= limit)]
    if best.parent is None:
        return [best]
    keep = []
    limit = max(10.0, 0.2 * best.score)
    for kid in best.parent.kids:
        if not isinstance(kid, Node) or kid.out:
            continue
        density = kid.linked / kid.chars if kid.chars else 1.0
        like = kid is best or kid.score >= limit or (kid.tag in ("h1", "h2", "h3") and density < 0.25)
        if like or (kid.tag in ("p", "pre", "blockquote") and kid.chars and density < 0.25):
            keep.append(kid)
    return keep


def blocks(nodes: list[Node]) -> list[str]:
    """The text of each block, white space made one space."""
    out: list[str] = []
    line: list[str] = []

    def close() -> None:
        words = " ".join("".join(line).split())
        if words:
            out.append(words)
        line.clear()

    todo: list[Node | str | None] = [None, *reversed(nodes)]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif not x.out:
            if x.tag in BLOCK:
                close()
                todo.append(None)
            todo.extend(reversed(x.kids))
    close()
    return out


def main_text(html: str | None) -> str:
    """The article of a page; empty if the page is null, empty or has none."""
    if not html or html.isspace():
        return ""
    out = blocks(article(parse(html)))
    return "\n".join(out or blocks(article(parse(html), by_name=False)))


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns if None) of ``pages`` with ``text`` and ``n_chars``.

    Null, empty and text-less pages have an empty text.  Pages are read one by
    one and whole; repeated rows give equal texts.  Columns called ``text`` and
    ``n_chars`` are replaced.
    """
    rest = others(pages.columns if keep is None else keep, "text", "n_chars")
    src, at = with_text(pages, rest, html)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x.as_py()) for x in batch.column(at)]
        return pa.RecordBatch.from_arrays([*batch.columns[:len(rest)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                          names=[*batch.schema.names[:len(rest)], "text", "n_chars"])

    return map_arrow(src, run, ddl(src, len(rest)) + "text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
