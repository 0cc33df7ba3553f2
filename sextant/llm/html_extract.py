"""Main text of web pages by a tree-structured graphical model.

The page is parsed to a tree of block elements and text runs (what stands between two
block boundaries). Each node is content or not. Observed features of a node (tag, words of
class, id and role, length, share of linked text, punctuation) depend on its state, and
potentials couple each child's state with its parent's. Messages are passed upward and
downward (sum-product, exact on a tree), and runs whose content marginal exceeds one half
are the main text. All parameters are counts over labelled pages; the default ones are
the TRAINING_PAGES pages that ``labelled_pages`` writes by rule.

Defined results: null html counts as empty and gives an empty text; truncated pages are read as far
as they go, and a tag cut off at the end is dropped; text of any length is kept whole; equal
pages give equal texts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Classes of HTML elements, as the standard has them.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins del kbd mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}

_TAG = re.compile(r"""<(?:!--(.*?)(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|/?[a-zA-Z][^>]*+(?:(>)|\Z))""", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|itemprop|aria-label|data-content)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]{2,}")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "names", "parent", "text", "label", "length", "linked", "stops", "runs", "on")

    def __init__(self, tag, names, parent, label=None):
        self.tag, self.names, self.parent, self.label = tag, names, parent, label
        self.text, self.length, self.linked, self.stops, self.runs = None, 0, 0, 0, 0


def parse(html: str) -> list[Node]:
    """The page's nodes in document order, parents first; text runs have text."""
    root = Node("#page", (), -1, False)
    nodes, stack = [root], [(0, "#page")]
    parts: list[tuple[str, bool]] = []
    links, at, size = 0, 0, len(html)

    def run():
        if parts:
            text = " ".join(unescape("".join(p for p, _ in parts)).split())
            if text:
                up = stack[-1][0]
                n = Node("#text", (), up, nodes[up].label)
                n.text, n.length, n.runs = text, len(text), 1
                n.linked = min(len(text), sum(len(p) for p, linked in parts if linked))
                n.stops = sum(map(text.count, ".,;:!?"))
                nodes.append(n)
            parts.clear()

    while at < size:
        m = _TAG.search(html, at)
        if m is None:
            parts.append((html[at:], links > 0))
            break
        if m.start() > at:
            parts.append((html[at : m.start()], links > 0))
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE:
                if any(t == tag for _, t in stack):
                    run()
                    links = 0
                    while stack[-1][1] != tag:
                        stack.pop()
                    stack.pop()
                elif tag == "p":
                    run()
            continue
        if tag in RAW:
            if not m[4].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
                at = end.end() if end else size
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append((" ", False))
            elif tag == "a":
                links += 1
            continue
        run()
        links = 0
        if tag == "hr" or tag in VOID:
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] == "p":
                    del stack[k:]
                    break
                if stack[k][1] in ("td", "th", "table", "button"):
                    break
        if tag in ENDED_BY or any(tag in v for v in ENDED_BY.values()):
            for k in range(len(stack) - 1, 0, -1):
                if tag in ENDED_BY.get(stack[k][1], ()):
                    del stack[k:]
                    break
                if stack[k][1] in ("ul", "ol", "dl", "table", "select"):
                    break
        up = stack[-1][0]
        names, label = [], nodes[up].label
        for key, value in _ATTR.findall(m[4]):
            value = value.strip("\"'")
            if key.lower() == "data-content":
                label = value == "1"
            else:
                names += _WORD.findall(_CAMEL.sub(" ", value).lower())
        nodes.append(Node(tag, tuple(dict.fromkeys(names)), up, label))
        stack.append((len(nodes) - 1, tag))
    run()
    for i in range(len(nodes) - 1, 0, -1):
        n, up = nodes[i], nodes[nodes[i].parent]
        up.length += n.length
        up.linked += n.linked
        up.stops += n.stops
        up.runs += n.runs
    return nodes


def features(n: Node, nodes: list[Node]) -> list[str]:
    """What is observed at a node."""
    found = [f"tag {n.tag}"] + [f"name {w}" for w in n.names]
    if n.text is not None:
        found.append(f"in {nodes[n.parent].tag}")
    kind = "run" if n.text is not None else "box"
    if n.length:
        found.append(f"{kind} linked {min(4, int(5 * n.linked / n.length))}")
        found.append(f"{kind} size {min(9, n.length.bit_length())}")
        found.append(f"{kind} stops {min(4, int(100 * n.stops / n.length))}")
    else:
        found.append(f"{kind} bare")
    return found


class Model:
    """Edge potentials of (parent state, child state, child's features), from counts over labelled pages.

    lean[a] holds for each feature the log odds of the child being content under a parent
    in state a, and shift the log ratio of a child without content under a content parent
    to one under another parent. Sizes and densities repeat each other and what stands
    below, so they weigh less (measured) than tags and names (named).
    """

    def __init__(self, pages: list[str], measured: float = 0.25, named: float = 1.0):
        seen, total = [[Counter(), Counter()], [Counter(), Counter()]], [[1.0, 1.0], [1.0, 1.0]]
        for page in pages:
            nodes = parse(page)
            for n in nodes[1:]:
                a, s = int(bool(nodes[n.parent].label)), int(bool(n.label))
                total[a][s] += 1
                seen[a][s].update(features(n, nodes))
        log = math.log
        share = lambda f, a, s: log((seen[a][s][f] + 0.3) / (total[a][s] + 1))
        known = {f for row in seen for c in row for f in c}
        weight = lambda f: measured if f.startswith(("run ", "box ")) else named
        self.lean = [{f: weight(f) * (share(f, a, 1) - share(f, a, 0)) for f in known} for a in (0, 1)]
        self.shift = {f: weight(f) * (share(f, 1, 0) - share(f, 0, 0)) for f in known}
        self.prior = [log(total[a][1] / total[a][0]) for a in (0, 1)]
        self.base = log(total[1][0] / sum(total[1])) - log(total[0][0] / sum(total[0]))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The content marginal of each node."""
        held = lambda x: max(-60.0, min(60.0, x))
        exp, log, n = math.exp, math.log, len(nodes)
        d0, d1, c, message, up = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
        for i in range(1, n):
            seen = [f for f in features(nodes[i], nodes) if f in self.shift]
            d0[i] = held(self.prior[0] + sum(self.lean[0][f] for f in seen))
            d1[i] = held(self.prior[1] + sum(self.lean[1][f] for f in seen))
            c[i] = held(self.base + sum(self.shift[f] for f in seen))
        for i in range(n - 1, 0, -1):  # upward: up is the log odds of all evidence below
            o = held(up[i])
            message[i] = c[i] + log((1 + exp(d1[i] + o)) / (1 + exp(d0[i] + o)))
            up[nodes[i].parent] += message[i]
        belief = up[:]
        belief[0] = -60.0  # the page as a whole is more than its content
        for i in range(1, n):  # downward
            rest = held(belief[nodes[i].parent] - message[i]) if nodes[i].parent else -60.0
            belief[i] += log((exp(d0[i]) + exp(c[i] + d1[i] + rest)) / (1 + exp(c[i] + rest)))
        return [1 / (1 + exp(-held(b))) for b in belief]

    def text(self, html: str | None) -> str:
        nodes = parse(html or "")
        return "\n\n".join(n.text for n, p in zip(nodes, self.marginals(nodes)) if n.text is not None and p > 0.5)


TRAINING_PAGES = 400


def labelled_pages(count: int = TRAINING_PAGES, seed: int = 11) -> list[str]:
    """Pages written by rule in the usual layouts; data-content marks content (1) and what is not (0)."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioubdlmnrst") for _ in range(r.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    link = lambda a=1, b=3: f'<a href="/{word()}">{words(a, b)}</a>'
    pick = r.choice

    def sentence():
        return words(1, 16).capitalize() + pick([".", ".", ".", ", " + words(2, 8) + ".", "!", "?"])

    def prose(a=1, b=6):
        text = " ".join(sentence() for _ in range(r.randint(a, b)))
        if r.random() < 0.2:
            text += " " + link(1, 4) + " " + sentence()
        if r.random() < 0.15:
            text = "<b>" + text + pick(["</b>", "", "<br>"])
        return text

    def links(n):
        return "<ul>" + "".join(f"<li>{link()}" + pick(["</li>", "</li>", ""]) for _ in range(n)) + "</ul>"

    def attr(*names):
        return f'{pick(["class", "class", "id"])}="{pick(names)}"'

    def off(tag, names, inner):
        return f'<{tag} data-content="0" {attr(*names) if names and r.random() < 0.8 else ""}>{inner}</{tag}>'

    def menu():
        return off(pick(["nav", "nav", "div", "ul"]), ["nav", "navbar", "menu", "main-menu", "breadcrumb", "top-nav"], links(r.randint(2, 9)) if r.random() < 0.8 else " ".join(link() for _ in range(5)))

    def advert():
        return off(pick(["div", "div", "aside", "section"]), ["ad", "ads", "advert", "ad-banner", "sponsored", "promo"], pick([sentence(), prose(1, 2), link(2, 6)]))

    def notice():
        return off("div", ["cookie-notice", "notice", "gdpr-consent", "banner alert", "popup"], pick([sentence(), f"<p>{prose(1, 3)}</p>"]) + pick(["", "<button>" + words(1, 2) + "</button>"]))

    def form():
        return off("form", ["search", "newsletter", "login-form", "subscribe"], f"<label>{words(1, 3)}</label><input><select><option>{word()}<option>{word()}</select><button>{words(1, 2)}</button>")

    def side():
        return off(pick(["aside", "div"]), ["sidebar", "side", "related", "widget", "share social", "recommended"], f"<h3>{words(1, 3)}</h3>" + pick([links(r.randint(2, 6)), f"<p>{prose(1, 2)}</p>", links(3)]))

    def comments():
        return off(pick(["section", "div", "ol"]), ["comments", "comment-list", "reader-comments", "discussion", "replies"], f"<h3>{words(1, 2)}</h3>" + "".join(f'<div class="comment"><span>{word()}</span><p>{prose(1, 3)}</p></div>' for _ in range(r.randint(1, 4))))

    def head():
        return off(pick(["header", "div"]), ["header", "site-header", "masthead", "logo"], pick([f"<h2>{words(1, 3)}</h2>", link(), f"<p>{words(2, 6)}</p>"]) + pick(["", menu()]))

    def foot():
        return off(pick(["footer", "footer", "div"]), ["footer", "site-footer", "copyright", "bottom"], pick([f"&copy; {word()}.com &middot; {prose(1, 3)}", links(4), f"<p>{sentence()}</p>" + links(3)]))

    def body():
        out = [f"<h1>{words(2, 10)}</h1>"] if r.random() < 0.85 else []
        for _ in range(pick([1, 1, 2, 4, 8, 15])):
            out.append(pick([f"<p>{prose(1, 9)}</p>"] * 9 + [f"<p>{prose()}", f"<p>{words(1, 2)}.</p>", f"<h2>{words(1, 5)}</h2>", "<ul>" + "".join(f"<li>{pick([words(1, 5), sentence()])}</li>" for _ in range(3)) + "</ul>", f"<blockquote><p>{prose()}</p></blockquote>", f"<pre>{words(5, 20)}</pre>", f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>", f"<figure><img src=x><figcaption>{words(2, 8)}</figcaption></figure>"]))
            if r.random() < 0.06:
                out.append(pick([advert, side])())
        if r.random() < 0.1:
            out.append(pick([comments, side])())
        return "".join(out)

    pages = []
    for _ in range(count):
        top = [f() for f in (head, menu, notice, advert, form) if r.random() < 0.55]
        end = [f() for f in (side, comments, advert, form, notice) if r.random() < 0.35] + ([foot()] if r.random() < 0.85 else [])
        tag, names = pick([("article", []), ("article", []), ("article", ["post", "article", "story"]), ("main", []), ("main", ["content", "main"]), ("div", ["content", "article-body", "post-content", "entry-content", "main-content", "story text"]), ("section", ["content", "article", "story"])])
        inner = f'<{tag} data-content="1" {attr(*names) if names else ""}>{body()}</{tag}>'
        if r.random() < 0.3:
            inner = f'<div {attr("container", "wrapper", "page", "row")}>{inner}{"".join(end[:1])}</div>'
        page = f'<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{"".join(top)}{inner}{"".join(end)}</body></html>'
        pages.append(page if r.random() < 0.9 else page[: int(len(page) * r.uniform(0.4, 1))])
    return pages


def extract(pages: DataFrame, keep: list[str], html_col: str = "html", training: list[str] | None = None) -> DataFrame:
    """The columns of keep, and text. training: labelled pages as in labelled_pages, a few thousand at most."""
    model = Model(training if training is not None else labelled_pages())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            html = batch.column(batch.num_columns - 1)
            text = [model.text(h.as_py()) for h in html]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.string())], names=[*(f"c{i}" for i in range(batch.num_columns - 1)), "text"])

    from pyspark.sql import types as T

    narrow = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{html_col}`").cast("string").alias("html"))
    out = narrow.mapInArrow(run, T.StructType([*narrow.schema.fields[:-1], T.StructField("text", T.StringType())]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "text")


def op4_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, ["page_id", "url"]).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
