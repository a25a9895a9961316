"""A small DOM for main-text extraction: tolerant parsing, blocks of text, and simple tree matching (STM)."""

from __future__ import annotations

import re
from html import unescape

#: A tag; quotes count after an equals sign only, and nothing that was read is given back.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
TAG_HEAD = re.compile(r"</?[a-zA-Z]")
HINT = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption option select".split()
)
CLOSES_P = BLOCK - {"html", "body", "head", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPE = frozenset("article aside blockquote body div footer form header main nav ol section table td th ul dl menu".split())
NOISE_TAGS = frozenset("nav aside form script style noscript template iframe svg button select textarea title head dialog menu object canvas audio video map search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Names by which pages mark what is no text of theirs, as whole words of a class or id.
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar masthead footer comment comments reply replies disqus respond share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toolbar hidden".split()
)
#: What such a name may be joined to and still be one: parts of a layout, not matters that a text may be about.
NAME_PARTS = frozenset(
    "area aside bar block body bottom box btn button buttons center col column container content desktop entry fixed form global group inner item items js large left link links list main mobile outer page panel placeholder post posts right row section site skip slot small sticky tag text thread title top unit user wrap wrapper widget widgets zone".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class Node:
    __slots__ = ("tag", "key", "noise", "children", "parent")

    def __init__(self, tag: str, key: str, noise: bool, parent: Node | None):
        self.tag, self.key, self.noise, self.children, self.parent = tag, key, noise, [], parent


def is_noise_name(token: str) -> bool:
    """Whether a word of a class or id is a noise name: comment-list is one, with-sidebar and comments-on-method aren't."""
    parts = [w.lower() for w in WORDS.findall(token)]
    named = [w for w in parts if w in NOISE_NAMES]
    return bool(named) and all(w in NOISE_NAMES or w in NAME_PARTS for w in parts)


def hints(tag: str, attributes: str) -> tuple[str, bool]:
    """The node's key (tag and first class) and whether its attributes mark it as noise."""
    key, noise = tag, False
    if "=" in attributes or "hidden" in attributes:
        for name, a, b, c in HINT.findall(attributes):
            value, name = a or b or c, name.lower()
            if name == "class" and value:
                key = f"{tag}.{value.split()[0]}" if value.split() else tag
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                noise = True
            elif name == "role":
                noise = noise or value.lower() in NOISE_ROLES
                key = f"{key}@main" if value.lower() == "main" else key
            elif tag not in ("html", "body", "main") and tag not in HEADINGS and name in ("class", "id"):
                noise = noise or any(map(is_noise_name, value.split()))
    return key, noise


def parse(html: str) -> Node:
    """The tree of a page; broken markup is closed as browsers do in the common cases.  Children are nodes and texts."""
    root = Node("#root", "#root", False, None)
    at, here, end = 0, root, len(html)
    last, pattern = html.rfind(">"), TAG  # no tag ends after `last`
    opened: dict[str, int] = {}  # how many nodes of a tag are open

    def up(to: Node) -> Node:
        """Closes what is open below `to`."""
        x = here
        while x is not to:
            opened[x.tag] -= 1
            x = x.parent
        return to

    while at < end:
        begin = html.find("<", at)
        if begin < 0 or begin > last:
            here.children.append(html[at:].partition("<!--")[0])
            break
        mark = html[begin + 1 : begin + 2]
        if mark in ("!", "?"):
            comment = html.startswith("<!--", begin)
            stop = html.find("-->", begin + 4) if comment else html.find(">", begin)
            if begin > at:
                here.children.append(html[at:begin])
            at = end if stop < 0 else stop + (3 if comment else 1)
            continue
        found = pattern.match(html, begin)
        if not found and pattern is TAG and TAG_HEAD.match(html, begin):
            pattern = PLAIN_TAG  # a quote never ends: none counts from here
            found = pattern.match(html, begin)
        if not found:
            here.children.append(html[at : begin + 1])
            at = begin + 1
            continue
        if begin > at:
            here.children.append(html[at:begin])
        at = found.end()
        tag = found[2].lower()
        if found[1]:
            if opened.get(tag):
                x = here
                while x.tag != tag:
                    x = x.parent
                here = up(x.parent)
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}\\b", re.IGNORECASE).search(html, at)
            stop = html.find(">", close.end()) if close else -1
            at = end if stop < 0 else stop + 1
            continue
        ends = [t for t in ENDS.get(tag, ()) if opened.get(t)]
        if ends or tag in CLOSES_P and opened.get("p"):
            x = here
            while x is not root:
                if x.tag in ends or x.tag == "p" and tag in CLOSES_P:
                    here = up(x.parent)
                    break
                if x.tag in SCOPE:
                    break
                x = x.parent
        if tag in VOID:
            here.children.append(Node(tag, tag, False, here))
            continue
        key, noise = hints(tag, found[3])
        node = Node(tag, key, noise or tag in NOISE_TAGS, here)
        here.children.append(node)
        if not found[3].rstrip().endswith("/") or tag in BLOCK:
            here = node
            opened[tag] = opened.get(tag, 0) + 1
    return root


#: Kinds of blocks.
ARTICLE, MAIN = 1, 2


def blocks(node: Node, path: str = "") -> list[tuple[str, str, int]]:
    """(path, text, kind) of the blocks below node in page order, without noise; white space is folded.  The kind tells
    whether a block lies in an article or in main.  A header counts inside these only, a footer nowhere."""
    out: list[tuple[str, str, int]] = []
    text: list[str] = []
    own = [(path + "/" + node.key, kind_of(node, 0))]

    def flush() -> None:
        folded = " ".join(unescape("".join(text)).split())
        text.clear()
        if folded:
            out.append((own[0][0], folded, own[0][1]))

    todo: list[tuple] = [(x, *own[0]) for x in reversed(node.children)]
    while todo:
        x, here, kind = todo.pop()
        if x is None:
            flush()
            own[0] = (here, kind)
        elif isinstance(x, str):
            text.append(x)
        elif x.noise or x.tag == "footer" or x.tag == "header" and not kind:
            text.append(" ")
        elif x.tag in ("br", "td", "th", "img", "wbr", "hr"):
            if x.tag == "hr":
                flush()
            text.append("" if x.tag == "wbr" else " ")
            todo += [(y, here, kind) for y in reversed(x.children)]
        elif x.tag in BLOCK:
            flush()
            back, own[0] = own[0], (f"{here}/{x.key}", kind_of(x, kind))
            todo.append((None, *back))
            todo += [(y, *own[0]) for y in reversed(x.children)]
        else:
            todo += [(y, here, kind) for y in reversed(x.children)]
    flush()
    return out


def kind_of(x: Node, kind: int) -> int:
    """The kind of blocks in x, which lies in one of `kind`: what is in main is main's, whatever is between."""
    return MAIN if kind == MAIN or x.tag == "main" or x.key.endswith("@main") else ARTICLE if kind or x.tag == "article" else 0


def totals(one: list, two: list, score) -> list:
    """The greatest total score of all of `one` with each beginning of `two`."""
    row = [0] * (len(two) + 1)
    for x in one:
        before, last = row, 0
        row = [0]
        for j, y in enumerate(two):
            last = max(last, before[j + 1], before[j] + (score(x, y) or 0))
            row.append(last)
    return row


def matched(one: list, two: list, score) -> list[tuple[int, int]]:
    """Pairs (i, j) in order with the greatest total score (of pairs above 0), for lists of any length: Hirschberg's
    alignment, which holds two rows of the table at a time."""
    pairs, todo = [], [(0, len(one), 0, len(two))]
    while todo:
        i, k, j, m = todo.pop()
        if i == k or j == m:
            continue
        if k - i == 1:
            best = max(range(j, m), key=lambda y: score(one[i], two[y]) or 0)
            if score(one[i], two[best]):
                pairs.append((i, best))
            continue
        mid = (i + k) // 2
        ahead = totals(one[i:mid], two[j:m], score)
        back = totals(one[mid:k][::-1], two[j:m][::-1], score)
        cut = j + max(range(m - j + 1), key=lambda c: ahead[c] + back[m - j - c])
        todo += [(i, mid, j, cut), (mid, k, cut, m)]
    return sorted(pairs)


def tree_match(one: tuple, two: tuple) -> int:
    """Simple tree matching of trees (key, children): the most nodes that can be paired so that roots, parents and the
    order of siblings agree.  Children are scored by the match of their subtrees."""
    if one[0] != two[0]:
        return 0
    pairs, size = [(one, two)], {}
    for x, y in pairs:
        pairs += [(u, v) for u in x[1] for v in y[1] if u[0] == v[0]]

    def score(u: tuple, v: tuple) -> int:
        return size.get((id(u), id(v)), 0)

    for x, y in reversed(pairs):
        size[id(x), id(y)] = 1 + sum(score(x[1][i], y[1][j]) for i, j in matched(x[1], y[1], score))
    return size[id(one), id(two)]
