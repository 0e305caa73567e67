"""Main text of pages by wrappers that are inferred for each host.

A wrapper is a union-free regular expression over a host's token streams: elements, text slots ``#``, groups, and the
marks ``?`` (optional), ``+`` (repeated) and ``*`` (both). It is found by alignment:

1. Each page becomes a token stream of elements with their class, id and role words, and text slots; plain inline
   elements belong to the text. Neighbours that repeat, alone or up to ``SPAN`` in a row, fold into repeated groups.
   Equal streams of a host combine before the shuffle; so do numbers about each slot (pages, characters, linked
   characters, least and greatest hash of its text).
2. Streams of one host are aligned pair by pair, in a tree of lots (``LOTS``), in the order of the streams: at a
   mismatch the nearer element on which both go on is sought, what lies before it becomes optional, and what then
   repeats folds again. A text that differs is a slot anyway.
3. The wrapper's elements get their parts: what is left out (menus, headers, footers, sidebars, notices, adverts,
   forms, reader comments, by element or by words of its class, id or role), and the article, by its element, or else
   the main element, or else a content element with enough of the host's text, or else the deepest element that holds
   most of the unlinked text that isn't the same on all pages. Slots with the same text on all pages and lists of links
   count as menus there.
4. Each page is parsed again, its elements take the parts of those of the wrapper that they match, in order, and the
   texts of the article come out block by block.

Pages don't move if the wrappers together are small (``AT_HAND`` bytes, measured); else they meet them in a join by
host and one of ``SALTS`` salts, so that a host with a third of all pages has many tasks.

Defined results: a null html or address counts as empty, pages without a host have a wrapper together; a page without
article text has an empty text; a line break inside a block is white space; white space is what Unicode says it is; an
unfinished tag at the end is left out, as are unfinished comments and scripts; elements nested beyond ``DEEP`` count
as children of the last one; repeated rows each have their row; a text may be of any length (Python works on slices
of some MB, or one page); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as markup
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import pieces, saved, spread

#: Neighbours that may repeat together; lots of a host's streams that merge on each of two levels; most children of an
#: element before their labels are taken for plain ones; nesting.
SPAN, LOTS, WIDE, DEEP = 4, 64, 400, 150
#: Bytes of all wrappers that may be sent to every task; parts of a host's pages in the join beyond.
AT_HAND, SALTS = 16 << 20, 16
#: Pages of a host from which a text that is always the same counts as part of the template.
SAME = 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
#: Start tags that end an open element of the first kinds, looked for up to one of the second.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}
#: Elements that are never part of an article.
OUT = frozenset("head nav footer aside form button select textarea noscript template object svg math canvas audio video dialog menu datalist map applet".split())
#: Words of class, id or role that say the same of any element but those that hold the article.
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot adsbygoogle sponsor sponsored promo promos promotion promotions "
    "menu menus nav navbar navigation breadcrumb breadcrumbs masthead header topbar toolbar footer sidebar sidebars aside complementary contentinfo widget widgets "
    "notice notices cookie cookies consent gdpr alert popup modal overlay banner newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond responses "
    "search pagination pager hidden".split()
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
AD_WORDS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo related comment comments hidden".split())
CONTENT_WORDS = frozenset("content article articlebody post entry story bodytext main".split())
#: Elements that are blocks besides those that end paragraphs.
BLOCKS = ENDS_P | frozenset("body html tr td th caption thead tbody tfoot table option".split())

TOKEN = re.compile(
    r"""<(?:!--.*?(?:--!?>|\Z)|(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)>|[!?/][^>]*(?:>|\Z)|[A-Za-z][^>]*\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?![\w-])""", re.I)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*|\d+")


class Node:
    """An element: its tag, its label (tag and words of class, id and role) and its elements and texts."""

    __slots__ = ("tag", "label", "kids")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.kids = tag, label, []


_labels: dict[tuple[str, str], str] = {}


def label_of(tag: str, attrs: str) -> str:
    """The tag, then words of class, id, role and itemprop in order, each once, without digits."""
    if not attrs or attrs.isspace():
        return tag
    known = _labels.get((tag, attrs))
    if known is None:
        found = set()
        for name, value in ATTRIBUTE.findall(attrs):
            if name.lower() == "hidden":
                found.add("hidden")
            found |= {w.lower() for w in PART.findall(value) if not w.isdigit()}
        known = ".".join([tag, *sorted(found)])
        if len(_labels) > 20_000:
            _labels.clear()
        _labels[tag, attrs] = known
    return known


def parse(text: str) -> Node:
    """The tree of a page. Scripts, styles, comments and titles leave no trace; plain inline elements only their text."""
    root = Node("", "")
    stack, kids, at = [root], root.kids, 0
    beyond: dict[str, int] = {}
    end = len(text)
    while at < end:
        m = TOKEN.search(text, at)
        if m is None:
            break
        if m.start() > at:
            kids.append(text[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if beyond.get(tag):
                beyond[tag] -= 1
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    kids = stack[-1].kids
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(text, at)
            at = close.end() if close else end
            continue
        if tag in VOID:
            if tag == "br":
                kids.append(" ")
            elif tag == "hr":
                kids.append(Node("hr", "hr"))
            continue
        label = label_of(tag, attrs)
        if tag in INLINE and label == tag and tag != "a":
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in ENDS:
            kinds, border = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in border:
                    break
                if stack[i].tag in kinds:
                    del stack[i:]
                    break
        node = Node(tag, label)
        kids = stack[-1].kids
        kids.append(node)
        if len(stack) < DEEP:
            stack.append(node)
            kids = node.kids
        else:
            beyond[tag] = beyond.get(tag, 0) + 1
    if at < end:
        kids.append(text[at:])
    return root


# Expressions are lists: ["#"] for a text slot, and [label, mark, kids] for an element ("" as label: a group).

SLOT = ["#"]
#: Elements whose repeats need not look alike to fold.
PLAIN = frozenset(("div", "section", "span"))


def key(x: list) -> str:
    if len(x) == 1:
        return "#"
    return x[0] or "(" + " ".join(map(key, x[2])) + ")"


def _joined_mark(a: str, b: str) -> str:
    """The mark of one element that stands for two in a row."""
    return "*" if a in "?*" and b in "?*" and a and b else "+"


def _either_mark(a: str, b: str) -> str:
    """The mark of one element that stands for one of each side."""
    optional, many = (a != "" and a in "?*") or (b != "" and b in "?*"), (a != "" and a in "+*") or (b != "" and b in "+*")
    return ("*" if optional else "+") if many else ("?" if optional else "")


def _optional(x: list) -> list:
    return x if len(x) == 1 else [x[0], {"": "?", "+": "*"}.get(x[1], x[1]), x[2]]


def _alike(a: list, b: list) -> bool:
    if len(a) == 1 or a[0].split(".")[0] not in PLAIN:
        return True
    x, y = {key(k) for k in a[2]}, {key(k) for k in b[2]}
    return x <= y or y <= x or 2 * len(x & y) >= len(x | y)


def _merged(a: list, b: list, mark) -> list:
    if len(a) == 1:
        return SLOT
    kids = a[2] if a[2] == b[2] else ([_merged(x, y, _either_mark) for x, y in zip(a[2], b[2])] if not a[0] else align(a[2], b[2]))
    return [a[0], mark(a[1], b[1]), kids]


def fold(items: list[list]) -> list[list]:
    """The items with repeats, alone or some in a row, as repeated elements and groups."""
    out: list[list] = []
    keys: list[str] = []
    for item in items:
        out.append(item)
        keys.append(key(item))
        again = True
        while again:
            again = False
            for w in range(1, min(SPAN, len(out) - 1) + 1):
                tail = keys[-w:]
                before = out[-w - 1]
                if w > 1 and len(before) > 1 and not before[0] and before[1] in ("+", "*") and [key(x) for x in before[2]] == tail:
                    whole = ["", "", out[-w:]]
                    out[-w - 1 :] = [_merged(before, whole, _joined_mark)]
                elif len(out) >= 2 * w and keys[-2 * w : -w] == tail and all(map(_alike, out[-2 * w : -w], out[-w:])):
                    if w == 1:
                        out[-2:] = [_merged(out[-2], out[-1], _joined_mark)]
                    else:
                        out[-2 * w :] = [["", "+", [_merged(x, y, _either_mark) for x, y in zip(out[-2 * w : -w], out[-w:])]]]
                else:
                    continue
                del keys[len(out) - 1 :]
                keys.append(key(out[-1]))
                again = len(out) > 1
                break
    return out


def align(a: list[list], b: list[list]) -> list[list]:
    """One sequence that both match: at a mismatch the nearer element on which they go on is sought."""
    i = j = 0
    out: list[list] = []
    ka, kb = [key(x) for x in a], [key(x) for x in b]
    at_a: dict[str, list[int]] = {}
    at_b: dict[str, list[int]] = {}
    for places, keys in ((at_a, ka), (at_b, kb)):
        for n in range(len(keys) - 1, -1, -1):
            places.setdefault(keys[n], []).append(n)

    def later(places: dict[str, list[int]], k: str, n: int) -> int:
        found = places.get(k, [])
        while found and found[-1] < n:
            found.pop()
        return found[-1] - n if found else 1 << 30

    while i < len(a) and j < len(b):
        if ka[i] == kb[j]:
            out.append(_merged(a[i], b[j], _either_mark))
            i, j = i + 1, j + 1
            continue
        in_b, in_a = later(at_b, ka[i], j), later(at_a, kb[j], i)
        if in_b == in_a == 1 << 30:
            out += [_optional(a[i]), _optional(b[j])]
            i, j = i + 1, j + 1
        elif in_b <= in_a:
            out += map(_optional, b[j : j + in_b])
            j += in_b
        else:
            out += map(_optional, a[i : i + in_a])
            i += in_a
    out += map(_optional, a[i:])
    out += map(_optional, b[j:])
    out = fold(out)
    if len(out) > WIDE:
        out = fold([_bare(x) for x in out])
    return out


def _bare(x: list) -> list:
    """An element without its words, unless they leave it out."""
    return x if len(x) == 1 or not x[0] or left_out(x[0]) else [x[0].split(".")[0], x[1], x[2]]


def expression(node: Node) -> list[list]:
    """The folded token stream of an element's inside."""
    items: list[list] = []
    for kid in node.kids:
        if isinstance(kid, str):
            if not (items and items[-1] is SLOT) and not kid.isspace():
                items.append(SLOT)
        else:
            items.append([kid.label, "", expression(kid)])
    out = fold(items)
    return fold([_bare(x) for x in out]) if len(out) > WIDE else out


def pattern(items: list[list]) -> str:
    """A wrapper as users read it."""
    said = []
    for x in items:
        if len(x) == 1:
            said.append("#")
        else:
            inner = pattern(x[2])
            body = f"<{x[0]}>{inner}</{x[0].split('.')[0]}>" if x[0] else inner
            said.append(f"({body}){x[1]}" if x[1] else body)
    return "".join(said)


# What is left out, and where the article is.


def _words(label: str) -> set[str]:
    return set(label.split(".")[1:])


def left_out(label: str) -> bool:
    """An element that by its tag or words is no part of an article."""
    tag, words = label.split(".")[0], _words(label)
    if tag in ("html", "body", "main") or (tag in ("article", *HEADINGS) and (tag != "article" or words & CONTENT_WORDS)):
        return tag in HEADINGS and not AD_WORDS.isdisjoint(words)
    return tag in OUT or not OUT_WORDS.isdisjoint(words)


def rank(label: str) -> int:
    """1 for an article, 2 for the main element, 3 for an element whose words say content, 0 for others."""
    tag, words = label.split(".")[0], _words(label)
    if tag == "article":
        return 1
    if tag == "main" or (words and "main" in words and tag in ("div", "section") and len(words) == 1):
        return 2
    return 3 if tag in ("div", "section", "td") and words & CONTENT_WORDS else 0


def _holds(items: list[list], tags: tuple[str, ...]) -> bool:
    return any(len(x) > 1 and (x[0].split(".")[0] in tags or _holds(x[2], tags)) for x in items)


def numbers(node: Node) -> dict[str, list[int]]:
    """For each path of labels with text right below: characters, linked characters, and a hash of the text."""
    found: dict[str, list[int]] = {}

    def walk(n: Node, path: str, linked: bool) -> None:
        said = [k for k in n.kids if isinstance(k, str) and not k.isspace()]
        if said:
            text = " ".join("".join(said).split())
            at = found.setdefault(path, [0, 0, 0])
            at[0] += len(text)
            at[1] += len(text) if linked else 0
            at[2] = zlib.crc32(text.encode("utf-8", "surrogatepass"), at[2])
        for k in n.kids:
            if not isinstance(k, str):
                walk(k, f"{path}/{k.label}", linked or k.tag == "a")

    walk(node, "", False)
    return found


def parts(items: list[list], about: dict[str, tuple[int, int, int, int, int]], n_pages: int) -> list[list]:
    """The wrapper with the part of each element: [label, mark, kids, part, rank].

    about: for each path its pages, characters, linked characters, least and greatest hash. Part "-" is left out,
    "=" is the same on all pages or a list of links (left out where the article has no element of its own).
    """

    def walk(x: list, path: str, inside: bool, spare: bool) -> tuple[list, int, int]:
        """The element, and the unlinked and linked characters below that may belong to an article.

        spare: an element around an article stays, whatever its words (no other one has an article).
        """
        if len(x) == 1:
            return x, 0, 0
        label = x[0]
        here = f"{path}/{label}" if label else path
        tag = label.split(".")[0]
        out = bool(label) and left_out(label) and not (spare and tag not in ("nav", "aside", "footer", "head") and _holds(x[2], ("article", "main")))
        if tag == "header" or (out and tag == "div" and _words(label) & OUT_WORDS == {"header"}):
            # the head of an article holds its title
            out = not (inside and _holds(x[2], HEADINGS))
        if out:
            return [label, x[1], x[2], "-", 0], 0, 0
        inside = inside or tag == "article"
        kids, free, links = [], 0, 0
        for k in x[2]:
            k, f, linked = walk(k, here, inside, spare)
            kids.append(k)
            free, links = free + f, links + linked
        part = ""
        if label and here in about:
            pages, chars, linked, low, high = about[here]
            if pages >= max(SAME, n_pages) and low == high:
                part = "="
            else:
                free, links = free + chars - linked, links + linked
        if tag in ("ul", "ol", "div", "section", "dl", "table") and links > 1.5 * free:
            part = "="
        return [label, x[1], kids, part, rank(label) if label else 0, free], free, links

    done = [walk(x, "", False, False) for x in items]
    if not _ranked([d[0] for d in done], (1, 2)) and _holds(items, ("article", "main")):
        done = [walk(x, "", False, True) for x in items]
    tree, total = [d[0] for d in done], sum(d[1] for d in done)

    def settle(xs: list[list], seen: bool) -> None:
        """Content elements need two fifths of the text."""
        for x in xs:
            if len(x) > 5:
                if x[4] == 3 and (seen or x[5] < 0.4 * total):
                    x[4] = 0
                settle(x[2], seen or x[4] == 3)

    settle(tree, False)
    if total and not _ranked(tree):
        level, region = tree, None
        while True:
            best = max((x for x in _flat(level) if len(x) > 5), key=lambda x: x[5], default=None)
            if best is None or best[5] < 0.7 * total or best[0].split(".")[0] in ("p", "li", "td", "h1", "h2", "pre", "blockquote", "a"):
                break
            region, level = best, best[2]
        if region is not None:
            region[4] = 4
    return [_slim(x) for x in tree]


def _slim(x: list) -> list:
    return x if len(x) == 1 else [x[0], x[1], [_slim(k) for k in x[2]], *(x[3:5] if len(x) > 3 else ("", 0))]


def _flat(items: list[list]) -> Iterator[list]:
    """Elements and slots, groups opened."""
    for x in items:
        if len(x) > 1 and not x[0]:
            yield from _flat(x[2])
        else:
            yield x


def _ranked(items: list[list], ranks: tuple[int, ...] = (1, 2, 3)) -> bool:
    return any(len(x) > 3 and x[3] != "-" and (x[4] in ranks or _ranked(x[2], ranks)) for x in _flat(items))


class Wrapper:
    """A host's wrapper, ready to match pages: for each element, where its kids' labels may be matched."""

    __slots__ = ("part", "rank", "kids")

    def __init__(self, items: list[list], part: str = "", rank_: int = 0):
        self.part, self.rank = part, rank_
        self.kids: dict[str, list[tuple[int, Wrapper]]] = {}
        for i, x in enumerate(_flat(items)):
            if len(x) > 1:
                self.kids.setdefault(x[0], []).append((i, Wrapper(x[2], x[3], x[4])))

    def match(self, nodes: list[Node]) -> list[Wrapper | None]:
        """The element that each node matches, in order: the next one, or where a group repeats one before."""
        out, at = [], 0
        for node in nodes:
            found = self.kids.get(node.label) or self.kids.get(node.tag)
            if found is None:
                out.append(None)
                continue
            i, w = next((f for f in found if f[0] >= at), found[0])
            at = i
            out.append(w)
        return out


NONE = Wrapper([])


def article(page: Node, wrapper: Wrapper) -> str:
    """The main text of a page that the wrapper matches."""
    found: list[tuple[int, Node, Wrapper]] = []

    def seek(node: Node, w: Wrapper, ranks: frozenset[int]) -> None:
        nodes = [k for k in node.kids if not isinstance(k, str)]
        for k, x in zip(nodes, w.match(nodes)):
            if x.part == "-" if x else left_out(k.label):
                continue
            r = x.rank if x else (1 if k.tag == "article" else 2 if k.tag == "main" else 0)
            if r and r not in ranks:
                found.append((r, k, x or NONE))
                if r == 1:
                    continue
            seek(k, x or NONE, ranks | {r})

    seek(page, wrapper, frozenset())
    for r in (1, 2, 3):
        blocks = [b for at, node, w in found if at == r for b in _blocks(node, w, False)]
        if blocks:
            return "\n".join(blocks)
    if any(at < 4 for at, _, _ in found):
        return ""
    most = [(node, w) for at, node, w in found if at == 4] or [(page, wrapper)]
    return "\n".join(b for node, w in most for b in _blocks(node, w, True))


def _blocks(top: Node, wrapper: Wrapper, strict: bool) -> list[str]:
    """Texts of the blocks in order; strict: also without what is the same on all pages, and lists of links."""
    out: list[str] = []
    said: list[str] = []

    def close() -> None:
        if said:
            text = " ".join("".join(said).split())
            said.clear()
            if text:
                out.append(text)

    def walk(node: Node, w: Wrapper) -> None:
        nodes = [k for k in node.kids if not isinstance(k, str)]
        matches = iter(w.match(nodes)) if nodes else None
        for k in node.kids:
            if isinstance(k, str):
                said.append(markup.unescape(k) if "&" in k else k)
                continue
            x = next(matches)
            block = k.tag in BLOCKS
            if block:
                close()
            if not (x.part == "-" or (strict and x.part == "=") if x else left_out(k.label)):
                walk(k, x or NONE)
            if block:
                close()

    walk(top, wrapper)
    close()
    return out


# The jobs.

FOUND = "host string, kind string, key string, n long, chars long, linked long, low long, high long"
LOT = "host string, lot int, key string, n long"


def _host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _text(value: str | None) -> str:
    return value or ""


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token streams and slots of pages; equal ones of a slice are one row."""
    for batch in pieces(batches):
        found: dict[tuple[str, str, str], list[int]] = {}
        for host, text in zip(*(c.to_pylist() for c in batch.columns)):
            page = parse(_text(text))
            found.setdefault((host, "e", json.dumps(expression(page), separators=(",", ":"), ensure_ascii=False)), [0, 0, 0, 0, 0])[0] += 1
            for path, (chars, linked, h) in numbers(page).items():
                at = found.get((host, "s", path))
                if at is None:
                    found[host, "s", path] = [1, chars, linked, h, h]
                else:
                    found[host, "s", path] = [at[0] + 1, at[1] + chars, at[2] + linked, min(at[3], h), max(at[4], h)]
        if found:
            keys = list(zip(*found))
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in keys), *(pa.array(v, pa.int64()) for v in zip(*found.values()))], names=[c.split()[0] for c in FOUND.split(", ")])


def _lots(rows: pd.DataFrame) -> pd.DataFrame:
    """The streams of a lot, aligned in their order."""
    rows = rows.sort_values("key")
    state = None
    for k in rows["key"]:
        items = json.loads(k)
        state = items if state is None else align(state, items)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "lot": [int(rows["lot"].iloc[0]) // LOTS], "key": [json.dumps(state, separators=(",", ":"), ensure_ascii=False)], "n": [int(rows["n"].sum())]})


def _wrap(rows: pd.DataFrame) -> pd.DataFrame:
    """The wrapper of a host from its last lots, and what its slots hold."""
    streams = rows[rows["kind"] == "e"].sort_values("key")
    state = None
    for k in streams["key"]:
        items = json.loads(k)
        state = items if state is None else align(state, items)
    n = int(streams["n"].sum())
    slots = rows[rows["kind"] == "s"]
    about = {r.key: (r.n, r.chars, r.linked, r.low, r.high) for r in slots.itertuples()}
    tree = parts(state or [], about, n)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "n_pages": [n], "pattern": [pattern(state or [])], "wrapper": [json.dumps(tree, separators=(",", ":"), ensure_ascii=False)]})


def infer(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, n_pages, pattern (the expression as text) and wrapper (with the part of each element) of each host."""
    rows = spread(pages.select(_host(url).alias("host"), F.col(html).alias("html")))
    found = rows.mapInArrow(_streams, FOUND).groupBy("host", "kind", "key")
    found = saved(found.agg(*(F.sum(c).alias(c) for c in ("n", "chars", "linked")), F.min("low").alias("low"), F.max("high").alias("high")), "streams")
    lots = found.where("kind = 'e'").select("host", F.pmod(F.xxhash64("key"), F.lit(LOTS * LOTS)).cast("int").alias("lot"), "key", "n")
    for _ in range(2):
        lots = lots.groupBy("host", "lot").applyInPandas(_lots, LOT)
    zero = F.lit(0).cast("long")
    last = lots.select("host", F.lit("e").alias("kind"), "key", "n", *(zero.alias(c) for c in ("chars", "linked", "low", "high")))
    return last.unionByName(found.where("kind = 's'")).groupBy("host").applyInPandas(_wrap, "host string, n_pages long, pattern string, wrapper string")


_ready: dict[str, Wrapper] = {}


def _wrapper(text: str) -> Wrapper:
    known = _ready.get(text)
    if known is None:
        if len(_ready) >= 200:
            _ready.clear()
        known = _ready[text] = Wrapper(json.loads(text))
    return known


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        ids, urls, texts, wrappers = batch.columns
        out = [article(parse(_text(t)), _wrapper(w)) for t, w in zip(texts.to_pylist(), wrappers.to_pylist())]
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, wrappers: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each page, by the wrappers given (of :func:`infer`) or else those inferred from the pages."""
    kind = pages.schema[page_id].dataType.simpleString()
    known = saved((wrappers if wrappers is not None else infer(pages, url, html)).select("host", "wrapper"), "wrappers")
    size = known.agg(F.sum(F.octet_length("wrapper") + 64)).first()[0] or 0
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), _host(url).alias("host"))
    if size <= AT_HAND:
        rows = spread(rows).join(F.broadcast(known), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt")
        copies = known.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        rows = rows.select("*", salt).join(copies, ["host", "salt"], "left")
    rows = rows.select("page_id", "url", "html", F.coalesce("wrapper", F.lit("[]")).alias("wrapper"))
    return rows.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
