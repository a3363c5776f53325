"""A small tolerant HTML reader: a page as a tree of blocks with their texts, and which of them is its article.

Only what changes the blocks is followed: block elements with the end tags that HTML implies, elements whose content
is never text (scripts, styles, drawings), and marks of parts beside the article (tags, roles, names in class or id).
Inline markup is no boundary. Elements deeper than ``DEEPEST`` hang on the last block above.
"""

from __future__ import annotations

import re
from html import unescape

DEEPEST = 200
# The element categories of the HTML standard, as far as they matter here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Their start tags end an open paragraph.
ENDS_P = BLOCKS - frozenset("body caption dd dt html li tbody td tfoot th thead tr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: Content that isn't text, or that belongs to a form.
SILENT = frozenset("template svg math canvas object audio video noscript button select datalist label option optgroup legend output progress meter".split())
#: What a start tag ends: open elements of the first kind, up to one of the second.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
}
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: A paragraph outside of these isn't ended by what is inside.
_SCOPES = frozenset(["html", "table", "td", "th", "caption"])

BESIDE_TAGS = frozenset("nav footer aside form dialog menu search fieldset".split())
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of names in class and id.
BESIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus disclaimer footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination "
    "popup promo promoted promotion recommendations recommended related respond share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription toolbar topbar".split()
)
_UNLESS = frozenset("has with no not without".split())
MAIN_NAMES = frozenset(
    "content maincontent main-content main_content article articlebody article-body article_body article-content article-text post post-body "
    "post-content entry entry-content story story-body page-content main".split()
)

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")


class Block:
    __slots__ = ("tag", "label", "kids", "runs", "parent", "beside", "mains", "depth")

    def __init__(self, tag: str, parent: Block | None, label: str = "", beside: bool = False, mains: int = 0):
        self.tag, self.parent, self.label, self.beside, self.mains = tag, parent, label or tag, beside, mains
        self.kids: list[Block] = []
        #: (place in the page, text, share of it in links)
        self.runs: list[tuple[int, str, float]] = []
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.kids.append(self)


def marks(tag: str, attributes: str) -> tuple[str, bool, int]:
    """A block's label for matching, whether it is marked as standing beside the article, and how surely as the article (0 to 3)."""
    label, beside, mains = tag, tag in BESIDE_TAGS, 3 if tag == "article" else 2 if tag == "main" else 0
    if "=" in attributes:
        for m in _NAMED.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "role":
                beside |= value.lower() in BESIDE_ROLES
                mains = max(mains, 2 if value.lower() == "main" else 3 if value.lower() == "article" else 0)
                continue
            if key == "class":
                label += "." + ".".join(sorted(value.split()))
            for name in value.split():
                parts = [p.lower() for p in _PARTS.split(name)]
                if parts[0] not in _UNLESS and not BESIDE_NAMES.isdisjoint(parts):
                    beside = True
                elif name.lower() in MAIN_NAMES:
                    mains = max(mains, 1)
    return label, beside, mains


def read(html: str) -> Block:
    """The tree of a page's blocks; its root stands for the page."""
    root = Block("#page", None)
    stack: list[tuple[str, Block | None]] = [("#page", root)]  # None: an element whose text is left out
    block, silent = root, 0
    buffer: list[str] = []
    linked, in_link, place = 0, 0, 0

    def flush() -> None:
        nonlocal linked, place
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                block.runs.append((place, text, min(1.0, linked / len(text))))
                place += 1
            buffer.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal block, silent
        flush()
        for tag, b in stack[to:]:
            silent -= b is None
        del stack[to:]
        block = next(b for _, b in reversed(stack) if b is not None)

    def say(text: str) -> None:
        nonlocal linked
        if text and not silent:
            text = unescape(text) if "&" in text else text
            buffer.append(text)
            if in_link:
                linked += len(text.strip())

    at, size, last_end = 0, len(html), html.rfind(">")
    while at < size:
        begin = html.find("<", at)
        if begin < 0 or begin > last_end:
            say(html[at:])
            break
        mark = html[begin + 1 : begin + 2]
        if mark == "!" or mark == "?":
            say(html[at:begin])
            if html.startswith("<!--", begin):
                end = html.find("-->", begin + 2)  # "<!-->" ends itself
                at = end + 3 if end >= 0 else size
            elif html.startswith("<![CDATA[", begin):
                end = html.find("]]>", begin)
                at = end + 3 if end >= 0 else size
            else:
                at = html.find(">", begin) + 1
            continue
        m = _TAG.match(html, begin)
        if not m:
            if mark == "/" or not mark.isascii() or not mark.isalpha():
                if mark == "/" and not html[begin + 2 : begin + 3].isalpha():  # a comment to HTML
                    say(html[at:begin])
                    at = html.find(">", begin) + 1
                else:  # a sign, not a tag
                    say(html[at : begin + 1])
                    at = begin + 1
                continue
            say(html[at:begin])  # quotes that don't end
            at = html.find(">", begin) + 1
            continue
        say(html[at:begin])
        at, closing, tag, attributes = m.end(), m[1], m[2].lower(), m[3]
        if closing:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag == "br":
                buffer.append(" ")
            if silent or tag in BLOCKS:
                for k in range(len(stack) - 1, 0, -1):
                    name, b = stack[k]
                    if name == tag or tag in _HEADINGS and name in _HEADINGS:
                        if b is None and tag not in BLOCKS:
                            silent -= sum(x is None for _, x in stack[k:])
                            del stack[k:]
                        else:
                            pop(k)
                        break
                    if b is not None and tag not in BLOCKS or name in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html", "article", "main", "section", "div"):
                        break
                else:
                    if tag in BLOCKS:
                        flush()
            continue
        if tag in RAW:
            if not attributes.endswith("/") or tag in ("script", "style", "title", "textarea"):
                end = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(html, at)
                at = (html.find(">", end.end()) + 1 or size) if end else size
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCKS:
            if tag in ("html", "body"):
                continue
            flush()
            if tag in ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        pop(k)
                        break
                    if stack[k][0] in _SCOPES:
                        break
            if tag in _HEADINGS and stack[-1][0] in _HEADINGS:
                pop(len(stack) - 1)
            if tag in IMPLIED:
                ends, until = IMPLIED[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        pop(k)
                        break
                    if stack[k][0] in until:
                        break
            if silent:
                stack.append((tag, None))
                silent += 1
            elif block.depth < DEEPEST:
                block = Block(tag, block, *marks(tag, attributes))
                stack.append((tag, block))
            else:
                stack.append((tag, block))
            continue
        if tag == "a":
            in_link = 1
        if silent or tag in SILENT or "=" in attributes and marks(tag, attributes)[1]:
            if not attributes.endswith("/"):
                stack.append((tag, None))
                silent += 1
    flush()
    return root


def article(root: Block) -> tuple[list[Block], bool]:
    """The blocks that are the page's article, and whether marks say so; else the whole page stands for it."""
    sure: dict[int, list[Block]] = {1: [], 2: [], 3: []}
    hidden: dict[int, list[Block]] = {1: [], 2: [], 3: []}

    todo = [(root, False, 0)]
    while todo:
        b, beside, above = todo.pop()
        beside |= b.beside
        if b.mains and not above >= b.mains:
            (hidden if beside else sure)[b.mains].append(b)
        todo += [(kid, beside, max(above, b.mains)) for kid in reversed(b.kids)]
    for level in (3, 2):
        for found in (sure[level], [b for b in hidden[level] if not b.beside]):
            if found:
                return found, True
    if sure[1]:
        return [max(sure[1], key=text_size)], True  # the first of the longest
    return [root], False


def text_size(b: Block) -> int:
    size, todo = 0, [b]
    while todo:
        x = todo.pop()
        size += sum(len(r[1]) for r in x.runs)
        todo += x.kids
    return size


def cleaned(root: Block) -> Block:
    """The article as a tree of its own: without what stands beside it. Of a page without marks, lists of links go too."""
    found, marked = article(root)
    top = Block("#article", None)
    todo = [(b, top) for b in reversed(found)]
    while todo:
        b, parent = todo.pop()
        if b.beside and b not in found or not marked and b.tag == "header":
            continue
        own = Block(b.tag, parent, b.label)
        own.runs = b.runs if marked else [r for r in b.runs if r[2] < 0.9]
        todo += [(kid, own) for kid in reversed(b.kids)]
    return top
