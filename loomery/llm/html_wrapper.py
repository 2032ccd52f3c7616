"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is a stream of tags and text, read as the tree of its block elements with a text slot for each block. Repeats in a
row are folded into repeated groups, and the streams of a host's pages are aligned, element by element: what only some have becomes
an optional part, a slot whose text differs a variable slot. Wrappers align with wrappers just as pages do, so tasks infer those
of their own pages, and these meet in groups of a bounded number. Reading aligns a page with its host's wrapper: the
element that has the host's variable text is its article, and of that go the slots that show one text on all articles.
No page is left out of a wrapper: what would make it too large is described more coarsely instead.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.llm.shared import written

#: Distinct articles whose pages show the same text in a slot, at least, before it counts as the template's.
SUPPORT = 5
#: Distinct articles of a host, those of the least hashes, nearly all of which must show it, and how many are nearly all.
SAMPLE, SHARE = 20, 0.9
#: Of the variable text that is no chrome, the part that an element must have to be the article; less where its name says that it is.
MASS, NAMED_MASS = 0.7, 0.3
#: Bytes of all wrappers up to which they are broadcast; beyond it they are joined by host.
BROADCAST_BYTES = 32 << 20
#: Parts that the pages of a host are dealt to in that join.
SALTS = 16
#: Children of an element beyond which their order is given up: they become one repeated group of optional parts, a part for each name.
KIDS = 100
#: Nodes of a wrapper beyond which the rarest and deepest elements are described by one slot each.
NODES = 4000
#: Levels of elements; what is deeper belongs to the last of them.
DEPTH = 60

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:\-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)>|<[!?][^>]*>|([^<]+|<)", re.S | re.I)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img label".split())
#: Elements that are no part of an article's text, whatever a host has in them.
_CHROME = frozenset("nav footer aside form button head menu dialog input option label fieldset script style".split())
_IN_HEAD = frozenset("head title meta link base script style noscript template object".split())
_HEADINGS = frozenset(("h1", "h2", "h3"))
#: Elements that hold running text or rows, and so aren't an article's own element.
_LEAVES = frozenset("p li td th tr dt dd h1 h2 h3 h4 h5 h6 ul ol dl table tbody blockquote pre a hr".split())
_BOXES = frozenset("div section ul ol table iframe ins center".split())
#: Whole names (a class or an id) of parts that are no article's. Words within other names say nothing.
_PARTS = re.compile(
    r"(?:ads?|adverts?|advertisements?|adsbygoogle|sponsored|promo)(?:[-_](?:slot|box|banner|container|unit|wrapper|block|label|content))?"
    r"|(?:cookies?|consent|gdpr)(?:[-_](?:bar|notice|banner|popup|message|box|consent))?|notice"
    r"|(?:user[-_]?|reader[-_]?)?comments?(?:[-_]?(?:list|section|area|form|thread|box|wrap|container|respond))?|disqus(?:[-_]thread)?|respond"
    r"|(?:site[-_]|page[-_]|left[-_]|right[-_])?(?:sidebar|footer|navbar|navigation|nav|menu|masthead|breadcrumbs?|pagination|pager)"
    r"|(?:social|share)[-_](?:bar|buttons|links|icons|box)|related[-_](?:posts|articles|stories|links)|newsletter(?:[-_](?:box|form|signup))?|subscribe[-_](?:box|form)|popup|modal",
    re.I,
)
#: Names of elements that have an article and little else, and of those that have one among other things.
_ARTICLE, _MAIN = re.compile(r"^article\b|[.#](article|post|story)(?![\w-])", re.I), re.compile(r"^main\b|[.#](content|entry|main|body)(?![\w-])", re.I)


def _label(tag: str, attributes: str) -> str:
    """The tag with its classes and id. Numbers in names tell pages apart, not templates."""
    out = tag
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "class":
            out += "".join("." + re.sub(r"\d+", "9", n) for n in value.split())
        elif m[1].lower() == "id":
            out += "#" + re.sub(r"\d+", "9", value.strip())
    return out


def tokens(html: str | None) -> Iterator[tuple[str, str]]:
    """(what, value): what is '<', '>' or 'x'; a closing tag without an open one and an end tag that HTML lets go are left to walk()."""
    for m in _TOKEN.finditer(html or ""):
        if m[5]:
            yield "x", m[5]
        elif m[3]:
            tag = m[3].lower()
            yield (">", tag) if m[2] else ("<", _label(tag, m[4]))


_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "body": {"head"}}
_BLOCK_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_BARRIERS = frozenset("ul ol table dl article section div body main".split())


@lru_cache(100_000)
def _tag(label: str) -> str:
    return re.split(r"[.#]", label, maxsplit=1)[0]


def walk(html: str | None) -> Iterator[tuple[str, list, str]]:
    """(event, open elements, value) of each tag and text; the open elements (label, tag) are as HTML nests them, end tags left out included.

    Events: '<' and '>' with a label, 'x' with a text.
    """
    stack: list[tuple[str, str]] = []

    def close_to(k: int) -> Iterator:
        while len(stack) > k:
            yield ">", stack, stack.pop()[0]

    for what, value in tokens(html):
        if what == "x":
            yield "x", stack, value
            continue
        if what == ">":
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][1] == value), None)
            if k is not None:
                yield from close_to(k)
            continue
        tag = _tag(value)
        gone = _CLOSES.get(tag, set()) | ({"p"} if tag in _BLOCK_CLOSES_P else set())
        if gone:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][1] in gone:
                    yield from close_to(k)
                    break
                if stack[k][1] in _BARRIERS:
                    break
        stack.append((value, tag))
        yield "<", stack, value
        if tag in _VOID:
            stack.pop()
            yield ">", stack, value
    yield from close_to(0)


class Node:
    """An element (kids) or a text slot (label ''; kids None) of a page or wrapper.

    many: repeated. pages: on which it occurs. of: characters of these pages. A slot has the hash of its text (None: it
    differs), its characters, those in links, and the least SAMPLE hashes of the distinct articles on its pages; a page's slot has the places of its
    blocks. loose: the kids of an element come in any order and number. closed: its kids are one slot for all that is in it.
    """

    __slots__ = ("label", "kids", "many", "pages", "of", "text", "chars", "links", "articles", "blocks", "loose", "closed", "sig", "weak")

    def __init__(self, label: str, kids: list[Node] | None, pages: int = 1, of: int = 0) -> None:
        self.label, self.kids, self.pages, self.of = label, kids, pages, of
        self.many = self.loose = self.closed = False
        self.text: int | None = None
        self.chars = self.links = 0
        self.articles: list[int] = []
        self.blocks: list[int] = []
        self.sig = self.weak = None

    def signed(self) -> None:
        """The shape: names and repeats of all within; and a weaker one, the name, of an element without a class or id with its kids' tags."""
        kids = self.kids
        if kids is None:
            self.sig, self.weak = 1 + self.many, ""
        else:
            self.sig = hash((self.label, self.many, self.loose, self.closed, *[k.sig for k in kids]))
            bare = "." not in self.label and "#" not in self.label
            self.weak = self.label + ("/" + " ".join(sorted({_tag(k.label) for k in kids})) if bare and _tag(self.label) not in _LEAVES and _tag(self.label) not in _ROOTS else "")

    def packed(self) -> list:
        if self.kids is None:
            return [self.text, self.chars, self.links, self.pages, self.of, int(self.many), self.articles]
        return [self.label, [k.packed() for k in self.kids], self.pages, self.of, self.many + 2 * self.loose + 4 * self.closed]


_ROOTS = frozenset(("", "html", "body", "article", "main"))


def unpacked(x: list) -> Node:
    if len(x) == 7:
        node = Node("", None, x[3], x[4])
        node.text, node.chars, node.links, node.many, node.articles = x[0], x[1], x[2], bool(x[5]), x[6]
    else:
        node = Node(x[0], [unpacked(k) for k in x[1]], x[2], x[3])
        node.many, node.loose, node.closed = bool(x[4] & 1), bool(x[4] & 2), bool(x[4] & 4)
    node.signed()
    return node


def _hash(text: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(text)


def _least(a: list[int], b: list[int]) -> list[int]:
    if a == b or len(a) == SAMPLE and b and b[0] >= a[-1] and (len(b) > 1 or b[0] not in a):
        return a
    return sorted({*a, *b})[:SAMPLE]


def page(html: str | None) -> tuple[Node, list[str], int]:
    """A page's folded tree, its blocks in order, and the hash of its text outside of links and named chrome: copies of an article have the same one."""
    blocks: list[str] = []
    root = Node("", [])
    open_nodes, levels = [root], [0]  # levels: how many elements are open with each node
    parts: list[str] = []
    linked = 0
    plain: list[int] = []
    slots: list[Node] = []
    in_head = False

    def flush() -> None:
        nonlocal linked
        if not parts:
            return
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            slot = Node("", None)
            slot.text, slot.chars, slot.links, slot.blocks = _hash(text), len(text), min(linked, len(text)), [len(blocks)]
            blocks.append(text)
            slots.append(slot)
            open_nodes[-1].kids.append(slot)
            if slot.links < slot.chars and not any(_tag(n.label) in _CHROME or _named_part(n.label) for n in open_nodes):
                plain.append(slot.text)
        linked = 0

    for what, stack, value in walk(html):
        if what == "<" and in_head and _tag(value) not in _IN_HEAD:
            in_head = False  # whatever can't be in a head ends it
        if what == "x":
            if not in_head:
                parts.append(value)
                if any(x[1] == "a" for x in stack):
                    linked += len(value.strip())
            continue
        tag = _tag(value)
        if tag == "head":
            in_head = what == "<"
        elif in_head:
            continue
        elif tag in _INLINE:
            if tag == "br" and what == "<":
                parts.append(" ")
        elif what == "<":
            flush()
            if len(open_nodes) <= DEPTH:
                node = Node(value, [])
                open_nodes[-1].kids.append(node)
                open_nodes.append(node)
                levels.append(len(stack))
        else:
            flush()
            if len(stack) < levels[-1] and len(open_nodes) > 1:
                _fold(open_nodes.pop())
                levels.pop()
    flush()
    while len(open_nodes) > 1:
        _fold(open_nodes.pop())
    _fold(root)
    total = sum(s.chars for s in slots)
    mark = _hash(",".join(map(str, plain)))
    own = [mark]

    def stamp(node: Node) -> None:
        node.of = total
        if node.kids is None:
            node.articles = own
        for kid in node.kids or ():
            stamp(kid)

    stamp(root)
    return root, blocks, mark


def _joined(a: Node, b: Node) -> None:
    """b, of a's shape on the same page, becomes one more of a."""
    if a.kids is None:
        a.text = _hash(f"{a.text} {b.text}")  # the texts of all, in order
        a.chars, a.links = a.chars + b.chars, a.links + b.links
        a.blocks += b.blocks
    else:
        for x, y in zip(a.kids, b.kids, strict=True):
            _joined(x, y)


def _fold(node: Node) -> None:
    """Equal neighbours among the kids of a page's element, one, two or three at a time, become repeated ones. Its kids are folded."""
    out: list[Node] = []
    for kid in node.kids:
        kid.signed()
        out.append(kid)
        n = len(out)
        if kid.kids is None:
            continue
        if n > 1 and _single(out[-2]) == _single(kid):
            _joined(out[-2], kid)
            out[-2].many = True
            out.pop()
            continue
        for k in (2, 3):
            if n > k and out[-k - 1].label == "+" and [x.sig for x in out[-k - 1].kids] == [x.sig for x in out[-k:]]:
                for x, y in zip(out[-k - 1].kids, out[-k:], strict=True):
                    _joined(x, y)
                del out[-k:]
                break
            if n >= 2 * k and [x.sig for x in out[-2 * k : -k]] == [x.sig for x in out[-k:]]:
                for x, y in zip(out[-2 * k : -k], out[-k:], strict=True):
                    _joined(x, y)
                group = Node("+", out[-2 * k : -k])
                group.many = True
                group.signed()
                out[-2 * k :] = [group]
                break
    for kid in out:
        kid.signed()
    node.kids = out
    node.signed()


def _single(node: Node) -> int:
    """The shape of one of a repeated element."""
    return node.sig if not node.many else hash((node.label, False, node.loose, node.closed, *[k.sig for k in node.kids or ()]))


def _close(node: Node) -> None:
    """One slot in place of an element's kids."""
    slot = Node("", None, node.pages, node.of)

    def add(x: Node) -> None:
        slot.chars, slot.links = slot.chars + x.chars, slot.links + x.links
        for kid in x.kids or ():
            add(kid)

    add(node)
    slot.many = True
    slot.signed()
    node.kids, node.closed, node.loose = [slot], True, False
    node.signed()


def _part(kids: list[Node], name: str) -> Node | None:
    """The part of a loose element that has the name: else its tag, else any."""
    for wanted in (name, _tag(name.partition("/")[0]), "*"):
        for kid in kids:
            if kid.weak == wanted or kid.label == wanted and wanted:
                return kid
    return None


def _loosen(node: Node) -> None:
    """The kids in any order: one for each name; if there are too many names one for each tag, and in the end one for any element."""
    kids, node.kids, node.loose = node.kids, [], True
    flat = [x for k in kids for x in (k.kids if k.label == "+" else [k])]
    for kid in flat:
        _loose_add(node, kid)
    node.signed()


def _loose_add(node: Node, kid: Node) -> None:
    found = next((x for x in node.kids if x.weak == kid.weak), None)
    if found is None and len(node.kids) >= KIDS:
        found = _part(node.kids, kid.weak)
        if found is None:
            found = Node("*" if len(node.kids) >= 2 * KIDS else _tag(kid.label) or "*", [], 0, 0)
            found.kids = [Node("", None, 0, 0)]
            found.kids[0].signed()
            found.many = found.closed = True
            found.signed()
            node.kids.append(found)
    if found is None:
        kid.many = True
        if kid.kids is None:
            kid.text, kid.articles = None, []
        kid.signed()
        node.kids.append(kid)
    else:
        _meet(found, kid, True)


def _meet(a: Node, b: Node, repeated: bool = False) -> None:
    """a becomes the wrapper of what both describe. repeated: b may be of a page that a has already."""
    same = a.sig == b.sig and not a.closed and not a.loose
    a.many = a.many or b.many or repeated
    a.pages, a.of = (max(a.pages, b.pages), max(a.of, b.of)) if repeated else (a.pages + b.pages, a.of + b.of)
    if a.kids is None:
        if b.kids is None:
            a.chars, a.links = a.chars + b.chars, a.links + b.links
            if a.text is None or a.text != b.text or repeated:
                a.text, a.articles = None, []
            else:
                a.articles = _least(a.articles, b.articles)
        a.signed()
        return
    if a.closed or b.closed or b.kids is None:
        for x in (a, b):
            if not x.closed and x.kids is not None:
                _close(x)
        slot, other = a.kids[0], b if b.kids is None else b.kids[0]
        slot.chars, slot.links, slot.pages, slot.of = slot.chars + other.chars, slot.links + other.links, a.pages, a.of
        slot.text, slot.articles = None, []
    elif same:
        for x, y in zip(a.kids, b.kids, strict=True):
            _meet(x, y, repeated)
    elif a.loose or b.loose:
        for x in (a, b):
            if not x.loose:
                _loosen(x)
        for kid in b.kids:
            found = next((x for x in a.kids if x.weak == kid.weak), None)
            if found is not None:
                _meet(found, kid, repeated)
                found.many = True
            else:
                _loose_add(a, kid)
    else:
        out: list[Node] = []
        for x, y in _pairs(a.kids, b.kids):
            if x is None or y is None:
                out.append(x or y)
            else:
                _meet(x, y, repeated)
                out.append(x)
        a.kids = _tidied(out)
        if len(a.kids) > KIDS:
            _loosen(a)
    a.signed()


def _tidied(kids: list[Node]) -> list[Node]:
    """A repeated element beside another one of its shape takes it in."""
    out: list[Node] = []
    for kid in kids:
        if out and kid.kids is not None and kid.label != "+" and out[-1].kids is not None and (out[-1].many or kid.many) and _single(out[-1]) == _single(kid):
            out[-1].many = kid.many = True
            out[-1].signed()
            kid.signed()
            _meet(out[-1], kid, True)
        else:
            out.append(kid)
    return out


def _pairs(a: list[Node], b: list[Node]) -> list[tuple[Node | None, Node | None]]:
    """Both sequences as one: by equal shapes, and between these by names."""
    out: list[tuple[Node | None, Node | None]] = []

    def align(xs: list[Node], ys: list[Node], keys: tuple[str, ...]) -> None:
        if not keys or not xs or not ys:
            out.extend((x, None) for x in xs)
            out.extend((None, y) for y in ys)
            return
        left, right = [getattr(x, keys[0]) for x in xs], [getattr(y, keys[0]) for y in ys]
        if left == right:
            out.extend(zip(xs, ys, strict=True))
            return
        for what, i, j, k, m in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
            if what == "equal":
                out.extend(zip(xs[i:j], ys[k:m], strict=True))
            else:
                align(xs[i:j], ys[k:m], keys[1:])

    if len(a) <= KIDS and len(b) <= KIDS:
        align(a, b, ("sig", "weak", "label"))
    else:
        names = {x.weak: x for x in a}
        seen: set[str] = set()
        for y in b:  # too long for an order: the first of each name
            fits = names.get(y.weak) if y.weak not in seen else None
            seen.add(y.weak)
            out.append((fits, y))
        out.extend((x, None) for x in a if x.weak not in seen or names[x.weak] is not x)
    return out


def meet(a: Node, b: Node) -> Node:
    """The wrapper of both, which are used up."""
    _meet(a, b)
    return trimmed(a)


def trimmed(root: Node) -> Node:
    """Up to NODES nodes: beyond it, the rarest and deepest elements become one slot each."""
    found: list[tuple[int, int, Node]] = []
    size = 0

    def visit(node: Node, depth: int) -> int:
        own = 1 + sum(visit(k, depth + 1) for k in node.kids or ())
        if node.kids and not node.closed and depth:
            found.append((node.pages, -depth, node))
        return own

    size = visit(root, 0)
    if size > NODES:
        count = lambda n: 1 + sum(map(count, n.kids or ()))
        for _, _, node in sorted(found, key=lambda x: x[:2]):
            size -= count(node) - 2
            _close(node)
            if size <= NODES // 2:
                break

        def again(node: Node) -> None:
            for kid in node.kids or ():
                again(kid)
            node.signed()

        again(root)
    return root


@lru_cache(100_000)
def _named_part(label: str) -> bool:
    return any(_PARTS.fullmatch(x) for x in re.split(r"[.#]", label)[1:])


@lru_cache(100_000)
def _named_main(label: str) -> int:
    return 2 if _ARTICLE.search(label) else 1 if _MAIN.search(label) else 0


class Judge:
    """What a wrapper (or a page's own tree) says of its nodes: which are chrome, which slots are the template's, and which elements are the article.

    A text is the template's if nearly all distinct articles of the host have it in the same slot; known: the least hashes of these.
    Every one of them that a slot's pages have is among the slot's own least ones, so their share is exact for them.
    The article is the innermost element with MASS of the variable text of the pages on which it occurs, or an element with a
    telling name that has NAMED_MASS. Other than that names decide one thing: a box whose whole name is a part's (comments, an
    advert) isn't the article's, unless there is hardly any text outside of these.
    """

    def __init__(self, root: Node, known: list[int] | None = None) -> None:
        self.known = frozenset(known or ())
        self.mass: dict[int, int] = {}
        self.main: set[int] = set()
        self.root = root
        plain = self._weigh(root, False)
        named = list(self._named(root))
        alone = sum(self.mass[id(n)] for n in named) > 0.9 * plain  # there is hardly any other text
        self.named_chrome = set() if alone else {id(n) for n in named}
        self.whole = self._weigh(root, True)
        self._find(root, None, 0)
        # pages of near copies have most of their text in common: that is no template
        fixed = sum(self._fixed(x, id(x) in self.main) for x in root.kids or ())
        self.cuts = fixed < sum(self.mass[k] for k in self.main)

    def template(self, slot: Node) -> bool:
        return slot.text is not None and len(slot.articles) >= SUPPORT and len(self.known.intersection(slot.articles)) >= SHARE * len(self.known)

    def _fixed(self, node: Node, inside: bool) -> int:
        """Characters of the template's texts in the article."""
        if node.kids is None:
            return node.chars if inside and self.template(node) else 0
        return 0 if self.chrome(node) else sum(self._fixed(k, inside or id(k) in self.main) for k in node.kids)

    def _named(self, node: Node) -> Iterator[Node]:
        for kid in node.kids or ():
            if kid.kids is not None:
                if _named_part(kid.label) and (_tag(kid.label) in _BOXES or kid.pages > 1) and not _named_main(kid.label):
                    yield kid
                yield from self._named(kid)

    def chrome(self, node: Node) -> bool:
        return _tag(node.label) in _CHROME or id(node) in self.named_chrome

    def _weigh(self, node: Node, names: bool) -> int:
        """Characters of variable text outside links and chrome."""
        if node.kids is None:
            n = 0 if self.template(node) else node.chars - node.links
        elif _tag(node.label) in _CHROME or names and id(node) in self.named_chrome:
            n = 0
        else:
            n = sum(self._weigh(k, names) for k in node.kids)
        if names or id(node) not in self.mass:
            self.mass[id(node)] = n
        return n

    def share(self, node: Node) -> float:
        """Of the variable text of the pages on which it occurs."""
        return self.mass[id(node)] / (self.whole * node.of / self.root.of) if self.whole and node.of else 0.0

    def _find(self, node: Node, best: Node | None, level: int) -> None:
        """Marks the innermost elements with the mass, or the outer ones with a telling name and some of it, and the titles beside them."""
        inner = False
        for kid in node.kids or () if level < 2 else ():
            if kid.kids is None or kid.many or kid.label == "+" or _tag(kid.label) in _LEAVES or self.chrome(kid):
                continue
            share, own = self.share(kid), _named_main(kid.label)
            before = len(self.main)
            if share >= NAMED_MASS and own > level:
                self._find(kid, kid, own)
            elif share >= NAMED_MASS:
                self._find(kid, kid if not own and not level and share >= MASS else None, level)
            inner = inner or len(self.main) > before
        if inner:
            self.main.update(id(h) for h in node.kids if self._title(h))
        elif best is not None:
            self.main.add(id(best))

    def _title(self, node: Node) -> bool:
        """A heading of the highest rank whose text isn't the template's; one in a header only if the host's articles tell that."""
        if _tag(node.label) == "h1":
            return any(k.kids is None and not self.template(k) for k in node.kids)
        return _tag(node.label) == "header" and len(self.known) >= SUPPORT and any(k.kids is not None and self._title(k) for k in node.kids)


def extract(html: str | None, wrapper: Judge | None) -> str:
    """The main text of a page by its host's wrapper; without one, or where its article's element is missing, by the page's own tree."""
    if not html:
        return ""
    root, blocks, _ = page(html)
    if not blocks:
        return ""
    own: Judge | None = None
    partner: dict[int, Node] = {}
    mains: list[Node] = []
    if wrapper is not None:
        _match(wrapper.root, root, partner)
        mains = _outermost(root, lambda n: id(n) in partner and id(partner[id(n)]) in wrapper.main)
    if not mains:
        own = Judge(root)
        mains = _outermost(root, lambda n: id(n) in own.main) or [root]
    own = own or (Judge(root) if any(_named_part(x.label) for x in _elements(root)) else None)
    for by_template in (True, False):  # where all is the template's, nothing is left out
        kept: list[int] = []

        def read(node: Node, tag: str, header: bool, kept=kept, by_template=by_template) -> None:
            match = partner.get(id(node))
            if node.kids is None:
                if header and tag not in _HEADINGS:
                    return
                if by_template and wrapper is not None and wrapper.cuts and match is not None and tag not in _HEADINGS and match.text == node.text and wrapper.template(match):
                    return
                kept.extend(node.blocks)
                return
            for kid in node.kids:
                if kid.kids is None:
                    read(kid, tag, header)
                    continue
                name, twin = _tag(kid.label), partner.get(id(kid))
                chrome = name in _CHROME or (wrapper.chrome(twin) if twin is not None else own is not None and own.chrome(kid))
                if not chrome:
                    read(kid, tag if kid.label == "+" else name, header or name == "header")

        for main in mains:
            read(main, _tag(main.label), _tag(main.label) == "header")
        if kept:
            return "\n".join(blocks[k] for k in sorted(kept))
    return ""


def _elements(node: Node) -> Iterator[Node]:
    for kid in node.kids or ():
        if kid.kids is not None:
            yield kid
            yield from _elements(kid)


def _outermost(node: Node, test) -> list[Node]:
    out = []
    for kid in node.kids or ():
        if kid.kids is not None:
            out += [kid] if test(kid) else _outermost(kid, test)
    return out


def _match(a: Node, b: Node, partner: dict[int, Node]) -> None:
    """The wrapper's node of each of the page's, where there is one."""
    partner[id(b)] = a
    if a.kids is None or b.kids is None or a.closed:
        return
    if a.loose:
        flat = [x for k in b.kids for x in (k.kids if k.label == "+" else [k])]
        for y in flat:
            x = _part(a.kids, y.weak)
            if x is not None and (x.kids is None) == (y.kids is None):
                _match(x, y, partner)
    elif a.sig == b.sig:
        for x, y in zip(a.kids, b.kids, strict=True):
            _match(x, y, partner)
    else:
        for x, y in _pairs(a.kids, b.kids):
            if x is not None and y is not None and (x.kids is None) == (y.kids is None):
                _match(x, y, partner)


def _host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


_SCHEMA = T.StructType([T.StructField("host", T.StringType()), T.StructField("part", T.LongType()), T.StructField("wrapper", T.StringType())])


def _emit(found: dict[str, tuple[Node, list]], part: int) -> pa.RecordBatch:
    hosts = list(found)
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([part] * len(hosts), pa.int64()), pa.array([json.dumps([found[h][0].packed(), found[h][1]]) for h in hosts], pa.string())], _SCHEMA.names)


def judge(wrapper: str) -> Judge:
    nodes, articles = json.loads(wrapper)
    return Judge(unpacked(nodes), articles)


def infer(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """host, part, wrapper: one wrapper for each host, its nodes and articles, from all its pages. Pages of null html belong to no wrapper, those of a null url to host ''."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[Node, list]] = {}
        for batch in batches:
            for host, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root, blocks, mark = page(x)
                if not blocks:
                    continue
                before = found.get(host)
                found[host] = (trimmed(root), [mark]) if before is None else (meet(before[0], root), _least(before[1], [mark]))
            if len(found) > 5000:  # many hosts: what is known goes on, and the task begins anew
                yield _emit(found, TaskContext.get().partitionId())
                found = {}
        if found:
            yield _emit(found, TaskContext.get().partitionId())

    def joined(key, table):
        made, articles = None, []
        for x in sorted(table.column("wrapper").to_pylist()):
            nodes, more = json.loads(x)
            made = unpacked(nodes) if made is None else meet(made, unpacked(nodes))
            articles = _least(articles, more)
        return pa.Table.from_batches([_emit({key[0].as_py(): (made, articles)}, key[1].as_py() if len(key) > 1 else 0)])

    rows = pages.select(_host(url).alias("host"), F.col(f"`{html}`").alias("html")).where("html is not null")
    partial = written(rows.mapInArrow(own, _SCHEMA), "partial")
    # no group is larger than about the root of the most wrappers that a host has, however many its tasks made
    most = partial.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    first = partial.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(math.isqrt(most) + 1))).groupBy("host", "part").applyInArrow(joined, _SCHEMA)
    return first.groupBy("host").applyInArrow(joined, _SCHEMA)


def main_text(pages: DataFrame, html: str = "html", url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """pages (the columns in keep) with text, the article of each page, and n_chars.

    A null or empty html, or a page without an article, has the empty text. A null url is a host of its own. Rows repeat as they
    are; columns text and n_chars of pages are replaced. An empty table gives an empty one. Very long or deep pages are read whole.
    """
    spark = pages.sparkSession
    wrappers = written(infer(pages, html, url).select("host", "wrapper"), "wrappers")
    kept = [c for c in (pages.columns if keep is None else keep) if c.lower() not in ("text", "n_chars")]
    fields = [pages.schema[c] for c in kept] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    names = [f.name for f in fields]
    plain = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{html}`").alias("html"), _host(url).alias("host"))
    n = len(kept)
    size = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0

    def read(batches: Iterator[pa.RecordBatch], known: dict | None) -> Iterator[pa.RecordBatch]:
        made: dict[str, Judge | None] = {}
        for batch in batches:
            texts = []
            own = batch.column(n + 2).to_pylist() if known is None else None
            for i, (x, host) in enumerate(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)):
                if host not in made:
                    raw = known.get(host) if known is not None else own[i]
                    if len(made) > 2000:
                        made.clear()
                    made[host] = judge(raw) if raw else None
                texts.append(extract(x, made[host]))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names)

    if size <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.collect()})
        return plain.mapInArrow(lambda batches: read(batches, shared.value), T.StructType(fields))
    salted = plain.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)))
    copies = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    joined = salted.join(copies, ["host", "salt"], "left").select(*[f"c{i}" for i in range(n)], "html", "host", "wrapper")
    return joined.mapInArrow(lambda batches: read(batches, None), T.StructType(fields))
