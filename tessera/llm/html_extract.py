"""Main text of web pages by tree scoring.

Each page becomes a light tree (implied end tags, void elements, character references
decoded). Elements that are no article text are cut: by tag, by ARIA role, by hidden
attributes, and by the words of class and id. A form, or an element with such a word, may as
well be the wrapper of the article: it is cut only if enough paragraphs are left without it
(``_settle``; all elements with the same word are judged together), and stays if it holds
the page's article or main element. Every paragraph then gives points for its
length and commas to its parent, half to the grandparent and a third less to each ancestor
beyond; containers lose points in proportion to the share of their text that is inside
links. The best container is kept, or the ``article`` or ``main`` around it; siblings join
it if they score alike or hold a paragraph with few links. Blocks of the kept elements are
given in page order, white space inside a block as one space, blocks joined by one newline.
Articles side by side are parts of one text if they have half the length of the one with the
best container and few links. Points reach five ancestors of a paragraph, no further.

A page is one row and is worked on alone; walks over the tree use no recursion, and the time
is in proportion to the length of the page however it is nested or broken.

Defined cases: null and empty html, and pages without text, give the empty text; markup
that is wrongly nested is read as far as it goes; a comment that is not closed, and a tag that
is not finished, end the page; a page whose text is all
boilerplate by tag or role gives the empty text, one whose text is all in elements with a
drop word gives that text if it has paragraphs enough; repeated rows are returned again; an empty table gives an
empty result; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th "
                  "thead tr ul caption option".split())
CLOSES_P = BLOCK - frozenset("body html option td th tr tbody thead tfoot caption legend summary".split())
#: What a start tag may end: kind -> (open tags it ends, tags beyond which it does not look).
KINDS = {"p": ({"p"}, {"td", "th", "table", "button", "object", "blockquote", "li", "div", "section", "article", "main"}),
         "li": ({"li"}, {"ul", "ol", "menu"}), "term": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
         "row": ({"tr", "td", "th"}, {"table"}), "cell": ({"td", "th"}, {"tr", "table"}),
         "rows": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "head": ({"head"}, set())}
ENDS = {"li": "li", "dt": "term", "dd": "term", "option": "option", "tr": "row", "td": "cell", "th": "cell", "tbody": "rows", "body": "head"}
_PLACE = {kind: i for i, kind in enumerate(KINDS)}
_MARKS = frozenset().union(*(a | b for a, b in KINDS.values()))
DROP_TAGS = frozenset("script style noscript template nav footer aside button select textarea input iframe object svg canvas "
                      "math dialog menu head title audio video map datalist".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist "
                       "status tooltip".split())
DROP_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted "
                       "sidebar aside rail comment comments commentlist discussion disqus replies reply respond cookie cookies consent "
                       "gdpr notice notices notification alert popup modal overlay lightbox newsletter subscribe subscription signup "
                       "login share sharing social related recommend recommended recommendations breadcrumb breadcrumbs menu menus nav "
                       "navbar navigation footer masthead pagination pager toolbar widget widgets search skip hidden offscreen "
                       "outbrain taboola paywall trending popular toc".split())
#: Words that rarely name a wrapper of the article.
STRICT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted "
                         "comment comments commentlist discussion disqus replies reply respond cookie cookies consent gdpr notice notices "
                         "notification alert popup modal overlay lightbox newsletter subscribe subscription signup login related recommend "
                         "recommended recommendations outbrain taboola trending popular".split())
ARTICLE_DROP = frozenset("comment comments ad ads advert related promo sponsored".split())
KEEP_TAGS = frozenset("html body article main".split())
GOOD_WORDS = frozenset("article body content entry main page post text blog story".split())
START_SCORE = {"article": 10, "main": 8, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3,
               "address": -3, "th": -5}
#: Points of the elements with a drop word over those left without them, and least points, from which they stay.
GOOD, DOUBTFUL, STRICT = (1, 1.0), (4, 1.0), (20, 10.0)
_WRAPS = 0.8  # share of the points of all elements with a word from which one is their wrapper
_TAG_START = re.compile(r"<[a-zA-Z/!?]")
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article main body".split())


def _names(text: str) -> list[frozenset]:
    """The words of every class and id name."""
    return [frozenset(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower())) for x in text.split()]


class Node:
    __slots__ = ("tag", "words", "drop", "doubt", "parent", "kids", "near", "own", "score", "chars", "link_chars")

    def __init__(self, tag: str, words: frozenset, drop: bool, doubt: tuple | None, parent: Node | None):
        self.tag, self.words, self.drop, self.doubt, self.parent = tag, words, drop, doubt, parent
        self.kids: list = []
        self.own: list | str = []  # text that no block inside the element holds
        self.score, self.chars, self.link_chars = 0.0, 0, 0
        #: per kind the nearest open element that a start tag of it ends
        self.near = (None,) * len(KINDS) if parent is None else parent.near
        if tag in _MARKS:
            self.near = tuple(self if tag in ends else None if tag in limit else x for x, (ends, limit) in zip(self.near, KINDS.values(), strict=True))


class _Tree(HTMLParser):
    """Builds the tree. Open tags are counted, in all and since the innermost open block, so that
    a tag that ends nothing costs nothing however deep it stands."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", frozenset(), False, None, None)
        self.at = self.root
        self.open: Counter = Counter()
        self.inline: list[Counter] = [Counter()]

    def _enter(self, n: Node) -> None:
        self.at = n
        self.open[n.tag] += 1
        if n.tag in BLOCK:
            self.inline.append(Counter())
        else:
            self.inline[-1][n.tag] += 1

    def _leave(self, upto: Node) -> None:
        """Close the open elements up to and with ``upto``."""
        while True:
            n = self.at
            self.open[n.tag] -= 1
            if n.tag in BLOCK:
                self.inline.pop()
            else:
                self.inline[-1][n.tag] -= 1
            self.at = n.parent
            if n is upto:
                return

    def _close(self, kind: str) -> None:
        while (n := self.at.near[_PLACE[kind]]) is not None:
            self._leave(n)

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in CLOSES_P:
            self._close("p")
        if tag in ENDS:
            self._close(ENDS[tag])
        a = dict(attrs)
        names = _names(f"{a.get('class') or ''} {a.get('id') or ''}") if "class" in a or "id" in a else []
        words = frozenset().union(*names)
        drop = self._dropped(tag, a)
        n = Node(tag, words, drop, None if drop else self._doubt(tag, names, words, a), self.at)
        self.at.kids.append(n)
        if tag not in VOID:
            self._enter(n)

    def _dropped(self, tag: str, a: dict) -> bool:
        if tag in DROP_TAGS:
            return True
        if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style") or ""):
            return True
        if tag in KEEP_TAGS:
            return False
        return (a.get("role") or "").lower() in DROP_ROLES or tag == "header" and not self._inside()

    def _doubt(self, tag: str, names: list[frozenset], words: frozenset, a: dict) -> tuple | None:
        """What is judged together with the element: (ratio and least points to stay, word)."""
        if tag in KEEP_TAGS:
            bad = words & ARTICLE_DROP if tag == "article" else frozenset()
        else:
            bad = words & DROP_WORDS
            if "header" in words and not self._inside():  # of the site; an article's own heading stays
                bad |= {"header"}
            if tag == "form" or (a.get("role") or "").lower() == "form":
                bad |= {"form"}
        if not bad:
            return None
        if any(w & GOOD_WORDS and not w & bad for w in names):
            return GOOD, min(bad)
        return (STRICT if bad & STRICT_WORDS else DOUBTFUL), min(bad)

    def _inside(self) -> bool:
        return self.open["article"] + self.open["main"] > 0

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and self.at.parent is not None:
            self._leave(self.at)

    def handle_endtag(self, tag):
        # an inline end tag doesn't close a block
        if not (self.open if tag in BLOCK or tag in DROP_TAGS else self.inline[-1])[tag]:
            return
        n = self.at
        while n.tag != tag:
            n = n.parent
        self._leave(n)

    def handle_data(self, data):
        self.at.kids.append(data)


def _walk(node: Node) -> Iterator[tuple[Node | str, bool]]:
    """(node or text, leaving) in page order, without dropped elements."""
    stack: list = [(node, False)]
    while stack:
        x, leaving = stack.pop()
        yield x, leaving
        if isinstance(x, Node) and not leaving and not x.drop:
            stack.append((x, True))
            stack.extend((k, False) for k in reversed(x.kids) if not (isinstance(k, Node) and k.drop))


def _measure(root: Node) -> list[Node]:
    """Sets chars, link_chars and own of every element; the elements in page order."""
    order, links, open_, blocks = [], 0, [], []
    for x, leaving in _walk(root):
        if isinstance(x, str):
            n = len(" ".join(x.split()))
            open_[-1].chars += n
            open_[-1].link_chars += n if links else 0
            blocks[-1].own.append(x)
        elif leaving:
            links -= x.tag == "a"
            open_.pop()
            if x.tag in BLOCK:
                blocks.pop().own = " ".join("".join(x.own).split())
            if open_:
                open_[-1].chars += x.chars
                open_[-1].link_chars += x.link_chars
        else:
            links += x.tag == "a"
            open_.append(x)
            order.append(x)
            if x.tag in BLOCK:
                blocks.append(x)
    return order


def _points(length: int, commas: int) -> float:
    return min(1.0, length / 25) + commas + min(length / 100, 3.0)


class _Doubt:
    """An element that may be cut, with the points of the paragraphs that are in no other
    such element inside it: all, those below an article or main inside it, and those below
    any article or main."""
    __slots__ = ("node", "up", "article_up", "points", "below", "anywhere", "stays", "cut")

    def __init__(self, node: Node, up: int, article_up: bool):
        self.node, self.up, self.article_up = node, up, article_up
        self.points = self.below = self.anywhere = 0.0
        self.stays = self.cut = False


def _doubts(root: Node) -> list[_Doubt]:
    """The elements in doubt, in page order; first one for all that is outside of them."""
    out = [_Doubt(root, -1, False)]
    out[0].stays = True
    at, links, texts = [0], 0, []
    articles, all_articles = [0], 0  # open article and main elements: inside each open element in doubt, and all
    for x, leaving in _walk(root):
        if isinstance(x, str):
            t = " ".join(x.split())
            if t:
                p = texts[-1]
                p[0] += len(t)
                p[1] += t.count(",")
                p[2] += len(t) if links else 0
            continue
        if not leaving:
            if x.doubt:
                out.append(_Doubt(x, at[-1], articles[-1] > 0))
                at.append(len(out) - 1)
                articles.append(0)
            elif x.tag in ("article", "main"):
                articles[-1] += 1
                all_articles += 1
            if x.doubt or x.tag in BLOCK:
                texts.append([0, 0, 0])
            links += x.tag == "a"
            continue
        links -= x.tag == "a"
        if x.doubt or x.tag in BLOCK:
            n, commas, linked = texts.pop()
            if n:
                p, d = _points(n, commas) * (1 - linked / n), out[at[-1]]
                d.points += p
                if articles[-1]:
                    d.below += p
                d.anywhere += p if all_articles else 0
        if x.doubt:
            at.pop()
            articles.pop()
        elif x.tag in ("article", "main"):
            articles[-1] -= 1
            all_articles -= 1
    return out


def _stay(doubts: list[_Doubt], group: list[int], ratio: float, least: float) -> list[int]:
    """Those of the group that stay: none, its wrappers, or all."""
    own = set(group)
    REST, IN, OUT, CUT = range(4)  # OUT: not judged yet
    kind, article = [REST] * len(doubts), [False] * len(doubts)
    total = below = rest = rest_article = 0.0
    for i, d in enumerate(doubts):
        up = kind[d.up] if i else REST
        if d.cut or up == CUT:
            kind[i] = CUT
        elif i in own or up == IN:
            kind[i] = IN
            article[i] = up == IN and (article[d.up] or d.article_up)
            total += d.points
            below += d.points if article[i] else d.below
        elif d.stays and up == REST:
            rest += d.points
            rest_article += d.anywhere
        else:
            kind[i] = OUT
    if not (below > rest_article and 2 * total >= rest or total >= least and total > ratio * rest):
        return []
    inside = [d.points if kind[i] == IN else 0.0 for i, d in enumerate(doubts)]
    for i in range(len(doubts) - 1, 0, -1):
        inside[doubts[i].up] += inside[i]
    return [i for i in group if inside[i] >= _WRAPS * total] or group


def _settle(root: Node) -> None:
    """Cuts the elements in doubt whose paragraphs the page can spare, by word, those with
    the most points first: an outer element comes before those inside it."""
    doubts = _doubts(root)
    if len(doubts) == 1:
        return
    inside = [d.points for d in doubts]
    for i in range(len(doubts) - 1, 0, -1):
        inside[doubts[i].up] += inside[i]
    groups: dict[tuple, list[int]] = {}
    for i, d in enumerate(doubts[1:], 1):
        groups.setdefault(d.node.doubt, []).append(i)
    for key in sorted(groups, key=lambda k: -max(inside[i] for i in groups[k])):
        group = groups[key]
        while group:
            stay = _stay(doubts, group, *key[0])
            for i in stay or group:
                doubts[i].stays, doubts[i].cut = bool(stay), not stay
            kept = set(stay or group)
            group = [i for i in group if i not in kept]
    for d in doubts[1:]:
        d.node.drop = d.cut


def _density(n: Node) -> float:
    return n.link_chars / n.chars if n.chars else 0.0


def _best(order: list[Node]) -> Node | None:
    seen: set[int] = set()
    scored: list[Node] = []
    for n in order:
        if n.tag not in PARAGRAPHS or n.parent is None:
            continue
        direct = n.own  # all PARAGRAPHS are blocks
        if not direct:
            continue
        points = _points(len(direct), direct.count(","))
        a, share, level = n.parent, 1.0, 0
        while a is not None and level < 5:
            if id(a) not in seen:
                seen.add(id(a))
                a.score += START_SCORE.get(a.tag, 0) + (25 if a.words & GOOD_WORDS else 0)
                scored.append(a)
            a.score += points * share
            level += 1
            share = 0.5 if level == 1 else 1 / (level * 3)
            a = a.parent
    for n in scored:
        n.score *= 1 - _density(n)
    return max(scored, key=lambda n: n.score, default=None)


def _kept(best: Node) -> list[Node]:
    around = best
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    if around is not None:
        near = [k for k in around.parent.kids if isinstance(k, Node) and not k.drop and k.tag == around.tag] if around.tag == "article" else []
        return [k for k in near if k is around or 2 * k.chars >= around.chars and _density(k) < 0.25] or [around]
    if best.parent is None or best.tag in ("body", "html"):
        return [best]
    least = max(10.0, best.score * 0.2)
    out = []
    for k in best.parent.kids:
        if isinstance(k, str) or k.drop:
            continue
        alike = k is best or k.score + (best.score * 0.2 if k.words and k.words == best.words else 0) >= least
        if not alike and k.tag in ("p", "h1", "h2", "h3", "pre", "blockquote"):
            alike = _density(k) < 0.25 and (k.chars > 80 or k.tag != "p" or k.own[-1:] in (".", "!", "?"))
        if alike:
            out.append(k)
    return out


def _blocks(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def end():
        t = " ".join("".join(run).split())
        run.clear()
        if t:
            out.append(t)

    for n in nodes:
        for x, _ in _walk(n):
            if isinstance(x, str):
                run.append(x)
            elif x.tag in BLOCK:
                end()
            elif x.tag == "br":
                run.append(" ")
        end()
    return out


def _finished(html: str) -> str:
    """The page without what never ends: a comment that is not closed, and a tag after the
    last ``>``. Each is cut once, from its first character on."""
    at = html.find("<!--", html.rfind("-->") + 3 if "-->" in html else 0)
    low = html.lower() if at >= 0 else ""
    while at >= 0:
        script = low.rfind("<script", 0, at)
        if script < 0 or low.find("</script", script) < at:  # else it is the script's text
            html = html[:at]
            break
        at = html.find("<!--", low.find("</script", script))
    tag = _TAG_START.search(html, html.rfind(">") + 1)
    return html[:tag.start()] if tag else html


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = _Tree()
    tree.feed(_finished(html))
    tree.close()
    _settle(tree.root)
    best = _best(_measure(tree.root)) or tree.root
    return "\n".join(_blocks(_kept(best)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text)`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            text = [main_text(h).encode("utf-8", "replace") for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.binary()).cast(pa.string())],
                                             names=["page_id", "url", "text"])
    rows = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"), col(html_col).alias("html"))
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string")


def with_length(extracted: DataFrame) -> DataFrame:
    return extracted.withColumn("n_chars", F.char_length("text").cast("long"))
