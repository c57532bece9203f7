"""Main text of a page by a tree-structured graphical model.

The page becomes a tree: block elements, and a leaf for each run of text between two block borders. Each node is
content (it is, or holds, main text) or not. Its own potential is a weighted sum of features (tag, class and id
tokens, role, length, link share); each parent-child edge has a potential of the two states. Sum-product messages
go upward and downward once, which gives exact marginals on a tree, without recursion and in time linear in the
page. Leaves with a marginal of one half or more are the text.

The weights are the maximum-likelihood fit on labelled pages: pages_labelled() writes them from a small grammar of
page layouts, with the answer known; none of the input is used. The gradient is observed minus expected features,
the expectation from the same messages.

Defined results. Null or empty html, and pages without main text: empty text, 0. Unclosed, stray and misnested tags
are read as browsers do in the common cases (implied ends of p, li, table parts; stray ends are ignored). Scripts and
the like end at their own end tag alone; excluded elements (button, svg, ...) at theirs or their parent's. Character
references are decoded, white space inside a block becomes one space, blocks are joined by one line end. A leaf with a
marginal of exactly one half is text. Repeated rows and null ids or urls: each row by itself. A long page costs time in
proportion to its length, unclosed tags and quotes included. Extra columns, of any name, are left aside. Empty table:
no rows.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame

#: Text, comments, declarations, and tags without angle brackets in them; a failing match stops at the next bracket, so a page takes time in proportion to its length.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/><\"']*+)(?=[\s/>])([^<>\"']*+(?:(?:\"[^\"<>]*+\"|'[^'<>]*+')[^<>\"']*+)*+)>|[^<]++|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
SPECIAL = re.compile("[>\"']")
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|\b(hidden)\b")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is characters up to their own end tag, so nothing inside is read as a tag.
RAW = frozenset("script style textarea noscript iframe title".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in RAW}
#: Excluded elements with content of tags; they end with their own end tag or with their parent.
EXCLUDED = frozenset("template svg math object canvas select button".split())
FOREIGN = frozenset(("svg", "math"))
#: Start tags that end svg and math, as in browsers, but inside POINTS.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr ol p pre s small span strong strike sub sup table tt u ul var".split())
POINTS = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var ins del br wbr img nobr center input".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
IMPLIED = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tbody": ("tr td th thead tbody tfoot", ("table",)), "option": ("option", ("select",))}
GOOD = frozenset("article articlebody articletext body content contents copy entry main maincontent mainbody post postbody postcontent prose story storybody text txt richtext news read reader page".split())
BAD = frozenset(
    "ad ads adv advert advertisement adbox adslot banner promo promotion sponsor sponsored sponsors nav navigation navbar menu menubar breadcrumb breadcrumbs header masthead topbar footer foot bottom sidebar side aside rail widget widgets "
    "cookie cookies consent gdpr notice notices alert notification warning disclaimer comment comments commentlist discussion discuss disqus reply replies respond feedback share sharing social follow related recommended recommendations more popular trending "
    "form login signin signup subscribe subscription newsletter search searchbox popup modal overlay dialog toolbar tools pager pagination tags tag taglist meta byline author copyright legal links skip logo print hidden outbrain taboola".split()
)
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
#: Roles that say what an element is.
ROLES_BAD = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())


class Node:
    __slots__ = ("features", "parent", "text", "y")

    def __init__(self, parent: int, features: list, text: str | None = None, y: int | None = None):
        self.parent, self.features, self.text, self.y = parent, features, text, y


def element_features(tag: str, attrs: str) -> tuple[list[str], int | None]:
    out, mark = ["t:" + tag], None
    good = bad = False
    for name, value, hidden in ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for token in SPLIT.split(value):
                token = token.lower()
                if token in BAD or token.rstrip("s") in BAD:
                    bad = True
                elif token in GOOD:
                    good = True
            if {"articlebody", "maincontent", "postcontent"} & {value.lower().replace("-", "").replace("_", "")}:
                good = True
        elif name == "role":
            bad |= value.lower() in ROLES_BAD
            good |= value.lower() in ("main", "article")
        elif name == "itemprop":
            good |= value.lower() == "articlebody"
        elif hidden or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)) or (name == "aria-hidden" and value.lower() == "true"):
            out.append("hidden")
        elif name == "data-y":
            mark = int(value)
    if bad:
        out.append("bad")
    elif good:
        out.append("good")
    return out, mark


def leaf_features(text: str, linked: int) -> list[str]:
    n = len(text)
    out = ["leaf", f"n:{min(5, int(math.log2(1 + n / 12)))}"]
    if linked:
        out.append(f"link:{min(2, int(3 * linked / (n + 1)))}")
    return out


class OddTags:
    """Ends of the tags that TOKEN doesn't take: with angle brackets inside quotes, quotes that don't end, or no end at all.

    What a search has found is kept for the rest of the page: where the next quote or bracket is, and from which quotes
    on no end is reached. So no part of a page is searched again and again.
    """

    def __init__(self, html: str):
        self.html, self.last, self.failed = html, html.rfind(">"), set()
        self.special, self.bracket = (0, -1), (0, -1)  # (from, to): the next one after any place between lies at `to`

    def next_special(self, at: int) -> int:
        if not self.special[0] <= at <= self.special[1]:
            m = SPECIAL.search(self.html, at)
            self.special = (at, m.start() if m else len(self.html))
        return self.special[1]

    def end(self, at: int) -> int:
        """The place of the `>` that ends a tag whose name ends at `at`: outside quotes, or the very next where quotes don't end; -1: none."""
        trail, begun = [], at
        while (p := self.next_special(at)) < len(self.html):
            if self.html[p] == ">":
                return p
            if p in self.failed or (close := self.html.find(self.html[p], p + 1)) < 0:
                break
            trail.append(p)
            at = close + 1
        if p < len(self.html):
            trail.append(p)
        self.failed.update(trail)
        if not self.bracket[0] <= begun <= self.bracket[1]:
            self.bracket = (begun, self.html.find(">", begun))
        return self.bracket[1]

    def tag(self, at: int) -> tuple[str, str, str, int] | None:
        """("/" or nothing, name, attributes, end) of the tag at `at`."""
        if at > self.last or not (m := NAME.match(self.html, at)) or (stop := self.end(m.end())) < 0:
            return None
        return "/" if self.html[at + 1] == "/" else "", m[1], self.html[m.end() : stop], stop + 1


def parse(html: str) -> list[Node]:
    """Nodes in page order, each after its parent; the first is the root."""
    nodes = [Node(-1, ["t:root"])]
    stack: list[tuple[str, int, int | None]] = [("", 0, None)]
    run: list[str] = []
    linked, in_link = 0, False
    inline: Counter = Counter()  # open since the last block border
    inner: list[str] = []  # open from an excluded element on
    within: Counter = Counter()  # how often each of them is
    open_count: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(unescape("".join(run)).split())
            run.clear()
            if text:
                _, parent, y = stack[-1]
                nodes.append(Node(parent, leaf_features(text, linked), text, y))
        linked = 0
        inline.clear()

    def pop() -> None:
        open_count[stack.pop()[0]] -= 1

    def leave(depth: int) -> None:
        """Close inner elements down to that depth."""
        while len(inner) > depth:
            within[inner.pop()] -= 1

    at, odd = 0, None
    while at < len(html):
        m = TOKEN.match(html, at)
        end, tag, attrs = m[1], m[2], m[3]
        if not tag and m[0] == "<":
            odd = odd or OddTags(html)
            if found := odd.tag(at):
                end, tag, attrs, at = found
            else:
                at = m.end()
        else:
            at = m.end()
        if not tag:
            s = m[0]
            if inner or (s[0] == "<" and len(s) > 1):
                continue
            run.append(s)
            if in_link:
                linked += len(s)
            continue
        tag = tag.lower()
        if inner:
            if end:
                if within[tag]:
                    while inner[-1] != tag:
                        leave(len(inner) - 1)
                    leave(len(inner) - 1)
                    continue
                if not open_count.get(tag) and not inline[tag]:
                    continue
                leave(0)  # the end of a parent
            elif tag in BREAKOUT and any(within[x] for x in FOREIGN) and not any(within[x] for x in POINTS):
                leave(min(inner.index(x) for x in FOREIGN if within[x]))
            elif tag in ("select", "input", "textarea") and within["select"]:
                leave(inner.index("select"))
                if tag == "select":
                    continue
            elif tag == "button" and within[tag]:
                leave(inner.index(tag))
        if tag in RAW and not (inner and tag == "title" and any(within[x] for x in FOREIGN)):
            if not end and not attrs.endswith("/"):
                close = RAW_END[tag].search(html, at)
                at = close.end() if close else len(html)
            continue
        if inner or tag in EXCLUDED:
            if not end and not attrs.endswith("/") and tag not in VOID:
                inner.append(tag)
                within[tag] += 1
            continue
        if tag in INLINE:
            if not end and tag not in VOID:
                inline[tag] += 1
            elif end and inline[tag]:
                inline[tag] -= 1
            if tag == "a":
                in_link = not end
            elif tag in ("br", "img", "wbr", "input"):
                run.append(" ")
            continue
        flush()
        if end:
            if tag == "p" and not open_count.get("p"):
                continue
            if open_count.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            in_link = False
            continue
        if tag in CLOSES_P and open_count.get("p"):
            while stack[-1][0] != "p":
                pop()
            pop()
        if tag in IMPLIED:
            closes, scope = IMPLIED[tag]
            closes = closes.split()
            for depth in range(len(stack) - 1 if any(open_count.get(x) for x in closes) else 0, 0, -1):
                if stack[depth][0] in scope:
                    break
                if stack[depth][0] in closes:
                    while len(stack) > depth:
                        pop()
        if tag in VOID:
            continue
        features, mark = element_features(tag, attrs)
        y = mark if mark is not None else stack[-1][2]
        nodes.append(Node(stack[-1][1], features, None, y))
        stack.append((tag, len(nodes) - 1, y))
        open_count[tag] = open_count.get(tag, 0) + 1
    flush()
    return nodes


def log_add(a: float, b: float) -> float:
    return (a + math.log1p(math.exp(b - a))) if a >= b else (b + math.log1p(math.exp(a - b)))


def marginals(nodes: list[Node], model: dict) -> tuple[list[float], list[tuple]]:
    """P(content) of each node, and for each edge the log-potential messages needed for pair marginals."""
    w, edge = model["w"], model["edge"]
    n = len(nodes)
    own = [sum([w.get(f, 0.0) for f in x.features]) for x in nodes]  # log-potential of content; of the rest: 0
    up0, up1 = [0.0] * n, own[:]  # own potential and the messages of all children
    to0, to1 = [0.0] * n, [0.0] * n
    e00, e01, e10, e11 = edge[0][0], edge[0][1], edge[1][0], edge[1][1]
    for i in range(n - 1, 0, -1):
        a, b = up0[i], up1[i]
        to0[i], to1[i] = log_add(e00 + a, e01 + b), log_add(e10 + a, e11 + b)
        p = nodes[i].parent
        up0[p] += to0[i]
        up1[p] += to1[i]
    down0, down1 = [0.0] * n, [0.0] * n
    out = [0.0] * n
    rest = []
    for i in range(n):
        if i:
            p = nodes[i].parent
            r0, r1 = up0[p] + down0[p] - to0[i], up1[p] + down1[p] - to1[i]
            rest.append((r0, r1, up0[i], up1[i]))
            down0[i], down1[i] = log_add(e00 + r0, e10 + r1), log_add(e01 + r0, e11 + r1)
            shift = max(down0[i], down1[i])
            down0[i] -= shift
            down1[i] -= shift
        d = up1[i] + down1[i] - up0[i] - down0[i]
        out[i] = 1 / (1 + math.exp(-d)) if d > -700 else 0.0
    return out, rest


def text_of(html: str | None, model: dict) -> str:
    if not html:
        return ""
    nodes = parse(html)
    p, _ = marginals(nodes, model)
    return "\n".join(x.text for x, q in zip(nodes, p, strict=True) if x.text is not None and q >= 0.5)


def pages_labelled(count: int = 240, seed: int = 13) -> list[str]:
    """Pages of varied layouts; data-y tells whether the text inside an element is main text."""
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice("aeiourstnlmdk") for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, b))).capitalize() + r.choice([".", ".", "", "!"])

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{j}">{words(1, 3)}</a></li>' for j in range(k))

    def named(kind: str, inner: str) -> str:
        tag = r.choice(["div", "div", "section", "aside"])
        return f'<{tag} {r.choice(["class", "id"])}="{kind}" data-y="0">{inner}</{tag}>'

    def noise(inside: bool) -> str:
        kind = r.randrange(10)
        if kind == 0:
            return named(r.choice(["ad", "ads", "advert", "ad-slot", "banner", "sponsored", "promo"]), r.choice([words(3, 25), f"<p>{words(5, 40)}</p>"]))
        if kind == 1:
            return f'<nav data-y="0"><ul>{links(r.randint(2, 7))}</ul></nav>' if r.random() < 0.6 else named(r.choice(["menu", "navbar", "breadcrumbs", "topnav"]), f"<ul>{links(r.randint(2, 6))}</ul>")
        if kind == 2:
            return f'<aside data-y="0"><h3>{words(1, 4)}</h3><ul>{links(3)}</ul><p>{words(6, 40)}</p></aside>' if r.random() < 0.5 else named(r.choice(["sidebar", "side-bar", "rail", "widget"]), f"<h3>{words(1, 3)}</h3><p>{words(6, 40)}</p>")
        if kind == 3:
            one = lambda: f'<{r.choice(["div", "li", "article"])} class="{r.choice(["comment", "reply", "comment-body"])}"><p>{words(4, 60)}</p>'
            return f'<{(t := r.choice(["section", "div"]))} {r.choice(["id", "class"])}="{r.choice(["comments", "comment-list", "discussion"])}" data-y="0"><h2>{words(1, 3)}</h2>' + "".join(f'<div class="comment"><p>{words(4, 60)}</p></div>' for _ in range(r.randint(1, 4))) + f"</{t}>" if r.random() < 0.9 else named("comments", one() + "</div>")
        if kind == 4:
            return f'<form data-y="0"><p>{words(3, 15)}</p><label>{words(1, 3)}</label><input name="q"></form>' if r.random() < 0.7 else named("newsletter", f"<p>{words(5, 25)}</p>")
        if kind == 5:
            return named(r.choice(["cookie-notice", "notice", "consent", "gdpr", "alert"]), r.choice([words(6, 40), f"<p>{words(6, 40)}</p>"])) if r.random() < 0.8 else f'<div role="alert" data-y="0"><p>{words(6, 30)}</p></div>'
        if kind == 6:
            return named(r.choice(["share", "social", "related", "tags", "pagination"]), f"<ul>{links(r.randint(2, 5))}</ul>")
        if kind == 7:
            return f'<div data-y="0"><ul>{links(r.randint(3, 8))}</ul></div>'
        if kind == 8:
            return f'<div style="display:none" data-y="0"><p>{words(5, 30)}</p></div>'
        return f'<dialog data-y="0"><p>{words(5, 20)}</p></dialog>' if inside else f'<header data-y="0">{r.choice(["<div>", "<h1>", "<h2>", "<p>", "<a href=/>"])}{words(1, 5)}{r.choice(["", f"<p>{words(3, 8)}</p>", f"<ul>{links(3)}</ul>"])}</header>'

    def block() -> str:
        kind = r.randrange(16)
        if kind == 0:
            return f'<ul data-y="1">' + "".join(f"<li>{words(2, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind == 1:
            return f'<blockquote data-y="1"><p>{words(5, 30)}</p></blockquote>'
        if kind == 2:
            return f'<h{(k := r.randint(2, 4))} data-y="1">{words(1, 6)}</h{k}>'
        if kind == 3:
            return f'<table data-y="1"><tr><th>{words(1, 2)}</th><td>{words(1, 6)}</td></tr></table>'
        if kind == 4:
            return f'<p data-y="1">{words(1, 4)}</p>'
        if kind == 5:
            return f'<pre data-y="1">{words(3, 30)}</pre>'
        if kind == 6:
            return f'<figure data-y="1"><img src="x.png"><figcaption>{words(2, 12)}</figcaption></figure>'
        if kind == 7:
            return f'<div data-y="1">{words(8, 60)}</div>'
        if kind == 8:
            return f'<p data-y="1">{words(3, 30)} <a href="/x">{words(1, 5)}</a> {words(1, 20)}</p>'
        if kind == 9:
            return f'<ol data-y="1">' + "".join(f'<li><p>{words(2, 20)}</p></li>' for _ in range(r.randint(2, 5))) + "</ol>"
        return f'<p data-y="1">{words(6, 90)}</p>'

    out = []
    for _ in range(count):
        inside = r.random()
        body = [f'<h1 data-y="1">{words(2, 9)}</h1>'] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 9)):
            body.append(block())
            if inside < 0.5 and r.random() < 0.15:
                body.append(noise(True))
        article = "".join(body)
        if r.random() < 0.25:
            article = "<section>" + article + "</section>"
        shape = r.randrange(8)
        if shape < 4:
            article = f"<article>{article}</article>"
        elif shape == 4:
            article = f"<main>{article}</main>"
        elif shape == 5:
            article = f'<div class="{r.choice(["content", "post", "entry-content", "article-body", "story"])}">{article}</div>'
        elif shape == 6:
            article = f'<div id="{r.choice(["main", "content", "article"])}"><div>{article}</div></div>'
        else:
            article = f"<div><div>{article}</div></div>"
        if shape < 3 and r.random() < 0.4:
            article = f"<main>{article}</main>"
        before = "".join(noise(False) for _ in range(r.randint(0, 4)))
        after = "".join(noise(False) for _ in range(r.randint(0, 4))) + (f'<footer data-y="0"><p>&copy; {words(2, 8)}</p>{words(0, 6) if r.random() < 0.5 else ""}</footer>' if r.random() < 0.8 else f'<div class="footer" data-y="0">&copy; {words(2, 14)}</div>')
        page = f"<html><body>{before}{article}{after}</body></html>"
        out.append(f"<html><body><div class=\"{r.choice(['wrapper', 'page', 'container'])}\">{before}{article}{after}</div></body></html>" if r.random() < 0.4 else page)
    return out


def train(pages: list[str], rounds: int = 60, rate: float = 0.5, l2: float = 0.002) -> dict:
    """Weights by gradient ascent on the likelihood of the labelled trees (AdaGrad)."""
    trees = []
    for html in pages:
        nodes = parse(html)
        y = [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):  # an element is content if something in it is
            if nodes[i].text is not None:
                y[i] = int(nodes[i].y == 1)
            if y[i] and i:
                y[nodes[i].parent] = 1
        trees.append((nodes, y))
    model: dict = {"w": {}, "edge": [[0.0, 0.0], [0.0, 0.0]]}
    square: dict = {}
    for _ in range(rounds):
        grad: dict = {}
        for nodes, y in trees:
            p, rest = marginals(nodes, model)
            for x, q, t in zip(nodes, p, y, strict=True):
                for f in x.features:
                    grad[f] = grad.get(f, 0.0) + t - q
            for i, (r0, r1, u0, u1) in enumerate(rest, 1):
                e = model["edge"]
                joint = [[r0 + e[0][0] + u0, r0 + e[0][1] + u1], [r1 + e[1][0] + u0, r1 + e[1][1] + u1]]
                top = max(map(max, joint))
                joint = [[math.exp(v - top) for v in row] for row in joint]
                total = sum(map(sum, joint))
                for a in (0, 1):
                    for b in (0, 1):
                        grad[a, b] = grad.get((a, b), 0.0) + (y[nodes[i].parent] == a and y[i] == b) - joint[a][b] / total
        for f, g in grad.items():
            old = model["edge"][f[0]][f[1]] if isinstance(f, tuple) else model["w"].get(f, 0.0)
            g = g / len(trees) - l2 * old
            square[f] = square.get(f, 1e-6) + g * g
            new = old + rate * g / math.sqrt(square[f])
            if isinstance(f, tuple):
                model["edge"][f[0]][f[1]] = new
            else:
                model["w"][f] = new
    return model


def model_of_labelled_pages() -> tuple[dict]:
    """What train(pages_labelled()) gives, to six digits; kept with the package, as the pages never change."""
    from gleaner.llm.extract_weights import MODEL

    return (MODEL,)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model_of_labelled_pages()[0])  # a few hundred weights

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [text_of(h.as_py(), shared.value) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", "html").mapInArrow(run, f"{kinds}, text string, n_chars long")
