"""One pass over a page's markup: anchors, headings, metas and content candidates as nested columns.

The tree is built by a small tolerant parser (implied end tags for p, li, table
cells and rows, dt, dd and option; void and raw-text elements; entities). All
operators read its columns; none parses the page again.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of tags.
CANDIDATES = frozenset(("div", "article", "main", "section"))
SKIPPED = frozenset(("script", "style", "noscript", "template", "iframe", "svg", "head"))
BLOCKS = frozenset("p div section article main li ul ol table tr blockquote pre h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title"))
# A start tag in the key closes an open element of the value, up to the nearest holder.
CLOSES = {"li": ("li",), "p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
P_ENDERS = BLOCKS | {"footer", "aside", "nav", "header", "form", "hr", "dl"} - {"li", "tr"}
HOLDERS = frozenset(("ul", "ol", "table", "div", "body", "article", "section", "main", "nav", "aside", "footer", "td"))
PUNCT = re.compile(r"[，。！？；：、（）《》“”‘’…—,.!?;:'\"()\[\]]")
CJK = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
_TOKEN = re.compile(r"<!--(.*?)(?:-->|\Z)|<![^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][\w:.\-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_CRUMB = re.compile(r"[>»›/→|]")

STRING, INT = pa.string(), pa.int32()
ANCHOR = pa.struct([("idx", INT), ("text", STRING), ("href", STRING), ("onclick", STRING), ("p1", INT), ("p2", INT), ("p3", INT), ("p4", INT), ("nav", pa.bool_())])
HEADING = pa.struct([("idx", INT), ("level", INT), ("text", STRING)])
META = pa.struct([("idx", INT), ("name", STRING), ("content", STRING)])
NODE = pa.struct([
    ("node_id", INT), ("parent_id", INT), ("tag", STRING), ("depth", INT), ("text_len", INT), ("punct", INT), ("cjk", INT), ("paragraphs", pa.float64()),
    ("link_len", INT), ("children", INT), ("breaks", INT), ("head_from", INT), ("n_heads", INT), ("line_from", INT), ("n_lines", INT), ("sibling_len", INT), ("near_h1", pa.bool_()),
])
SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("title", STRING), ("page_text", STRING), ("link_len", INT), ("anchors", pa.list_(ANCHOR)), ("headings", pa.list_(HEADING)),
    ("metas", pa.list_(META)), ("json_ld", pa.list_(STRING)), ("nodes", pa.list_(NODE)), ("lines", pa.list_(STRING)), ("tags", pa.map_(STRING, INT)), ("breadcrumb", pa.list_(STRING)),
])
DDL = (
    "page_id bigint, title string, page_text string, link_len int, "
    "anchors array<struct<idx:int,text:string,href:string,onclick:string,p1:int,p2:int,p3:int,p4:int,nav:boolean>>, "
    "headings array<struct<idx:int,level:int,text:string>>, metas array<struct<idx:int,name:string,content:string>>, json_ld array<string>, "
    "nodes array<struct<node_id:int,parent_id:int,tag:string,depth:int,text_len:int,punct:int,cjk:int,paragraphs:double,link_len:int,children:int,breaks:int,head_from:int,n_heads:int,line_from:int,n_lines:int,sibling_len:int,near_h1:boolean>>, "
    "lines array<string>, tags map<string,int>, breadcrumb array<string>"
)


class Comment(str):
    """Text of a comment: part of a node's lines, not of the page's text."""


class Node:
    __slots__ = ("id", "tag", "attrs", "parent", "kids", "depth")

    def __init__(self, i: int, tag: str, attrs: dict, parent: Node | None):
        self.id, self.tag, self.attrs, self.parent = i, tag, attrs, parent
        self.kids: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0


def _attrs(s: str) -> dict[str, str]:
    return {m.group(1).lower(): _html.unescape(m.group(2) or m.group(3) or m.group(4) or "") for m in _ATTR.finditer(s)} if s and not s.isspace() else {}


def parse(html: str) -> list[Node]:
    """All elements in document order; the first is the root."""
    root = Node(0, "#root", {}, None)
    nodes, cur, pos = [root], root, 0
    while m := _TOKEN.match(html, pos):
        pos = m.end()
        if m.group(5) is not None:
            cur.kids.append(_html.unescape(m.group(5)))
            continue
        if m.group(1) is not None:
            cur.kids.append(Comment(m.group(1)))
            continue
        if m.group(3) is None:
            continue
        tag = m.group(3).lower()
        if m.group(2):
            n: Node | None = cur
            while n is not None and n.tag != tag:
                n = n.parent
            if n is not None and n.parent is not None:
                cur = n.parent
            continue
        closes = CLOSES.get(tag, ("p",) if tag in P_ENDERS else ())
        n = cur
        while closes and n is not None and n.parent is not None and n.tag not in (HOLDERS - set(closes)):
            if n.tag in closes:
                cur = n.parent
                if tag not in ("tr",):
                    break
            n = n.parent
        x = Node(len(nodes), tag, _attrs(m.group(4).rstrip("/")), cur)
        nodes.append(x)
        cur.kids.append(x)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, pos)
            stop = end.start() if end else len(html)
            body = html[pos:stop]
            x.kids.append(_html.unescape(body) if tag in ("title", "textarea") else body)
            pos = end.end() if end else len(html)
        elif tag not in VOID and not (m.group(4) or "").endswith("/"):
            cur = x
    return nodes


def _body(nodes: list[Node]) -> Node | None:
    """A page has one body: tags of further ones are elements as any."""
    return next((n for n in nodes if n.tag == "body"), None)


def page_lines(nodes: list[Node]) -> tuple[list[str], dict[int, tuple[int, int]]]:
    """A page's text as lines, and of each candidate which of them are its own: (from, to).

    Breaks end a line, block tags stand on lines of their own, blank lines drop
    out. What is skipped is in no other node's lines; candidates inside it have
    lines of their own behind those of the page. One walk over the tree.
    """
    out: list[str] = []
    buf: list[str] = []
    at: dict[int, tuple[int, int]] = {}

    def flush() -> None:
        t = "".join(buf).strip()
        buf.clear()
        if t:
            out.append(t)

    body = _body(nodes)
    later: deque[Node] = deque()
    roots: deque[Node] = deque([nodes[0]])
    while roots:
        stack: list[Node | str | tuple[Node, int]] = [roots.popleft()]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                flush()
                at[x[0].id] = (x[1], len(out))
            elif isinstance(x, str):
                buf.append(x)
            elif x.tag in SKIPPED:
                later.extend(k for k in x.kids if isinstance(k, Node))
            elif x.tag == "br":
                flush()
            else:
                if x.tag in BLOCKS or x is body:
                    flush()
                    stack.append((x, len(out)))
                stack.extend(reversed(x.kids))
        flush()
        # the candidates nearest to what was skipped
        while later:
            k = later.popleft()
            if k.tag in CANDIDATES or k is body:
                roots.append(k)
            else:
                later.extend(y for y in k.kids if isinstance(y, Node))
    at[nodes[0].id] = (0, len(out))
    return out, at


def _strings(node: Node) -> Iterator[str]:
    stack: list[Node | str] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if not isinstance(x, Comment) and (t := x.strip()):
                yield t
        elif x.tag not in SKIPPED:
            stack.extend(reversed(x.kids))


def record(page_id: int, html: str) -> dict:
    nodes = parse(html)
    anchors, headings, metas, json_ld = [], [], [], []
    under: dict[int, bool] = {}
    tags: Counter[str] = Counter()
    title, crumb = None, []
    for n in nodes[1:]:
        under[n.id] = n.tag in ("nav", "header", "footer") or under.get(n.parent.id if n.parent else 0, False)
        tags[n.tag] += 1
        if n.tag == "a":
            up, a = [], n.parent
            for _ in range(4):
                up.append(a.id if a else 0)
                a = a.parent if a else None
            anchors.append({"idx": len(anchors), "text": "".join(_strings(n)), "href": n.attrs.get("href"), "onclick": n.attrs.get("onclick"), "p1": up[0], "p2": up[1], "p3": up[2], "p4": up[3], "nav": under[n.id]})
        elif n.tag in ("h1", "h2", "h3"):
            headings.append({"idx": len(headings), "level": int(n.tag[1]), "text": "".join(_strings(n))})
        elif n.tag == "meta":
            key = n.attrs.get("property") or n.attrs.get("name")
            if key and "content" in n.attrs:
                metas.append({"idx": len(metas), "name": key.lower(), "content": n.attrs["content"]})
        elif n.tag == "link" and n.attrs.get("rel", "").lower() == "image_src":
            metas.append({"idx": len(metas), "name": "image_src", "content": n.attrs.get("href", "")})
        elif n.tag == "title" and title is None:
            title = "".join(n.kids if all(isinstance(k, str) for k in n.kids) else _strings(n)).strip()
        elif n.tag == "script" and n.attrs.get("type", "").lower() == "application/ld+json":
            json_ld.append("".join(k for k in n.kids if isinstance(k, str)))
        links = [k for k in n.kids if isinstance(k, Node) and k.tag == "a"]
        if len(links) >= 2 and len(links) > len(crumb) and _CRUMB.search("".join(k for k in n.kids if isinstance(k, str))):
            crumb = ["".join(_strings(k)) for k in links]
    ls, at = page_lines(nodes)
    # sums over lines, and over elements in document order, where an element's descendants follow it
    sums = lambda values: list(accumulate(values, initial=0))
    chars, puncts, cjks = sums(len(x) + 1 for x in ls), sums(len(PUNCT.findall(x)) for x in ls), sums(len(CJK.findall(x)) for x in ls)
    paras, brs = sums(n.tag == "p" for n in nodes), sums(n.tag == "br" for n in nodes)
    texts = iter(anchors)
    links = sums(len(next(texts)["text"]) if n.tag == "a" else 0 for n in nodes)
    heads, h1s = [n.id for n in nodes if n.tag in ("h1", "h2", "h3")], [n.id for n in nodes if n.tag == "h1"]
    last = list(range(len(nodes)))
    for n in reversed(nodes[1:]):
        if n.parent is not None:
            last[n.parent.id] = max(last[n.parent.id], last[n.id])
    made = []
    top: dict[int, list[int]] = {}
    body = _body(nodes)
    for n in [n for n in nodes if n.tag in CANDIDATES or n is body] or nodes[:1]:
        lo, hi = at[n.id]
        i, j = n.id + 1, last[n.id] + 1
        h = bisect_left(heads, i)
        size, up = max(0, chars[hi] - chars[lo] - 1), n.parent.id if n.parent else -1
        b = brs[j] - brs[i]
        made.append({"node_id": n.id, "parent_id": up, "tag": n.tag, "depth": n.depth, "text_len": size, "punct": puncts[hi] - puncts[lo], "cjk": cjks[hi] - cjks[lo], "paragraphs": paras[j] - paras[i] + b / 2.0, "link_len": links[j] - links[i], "children": len(n.kids), "breaks": b, "head_from": h, "n_heads": bisect_left(heads, j) - h, "line_from": lo, "n_lines": hi - lo, "near_h1": bisect_left(h1s, n.id) > bisect_left(h1s, n.id - 4)})
        top[up] = sorted([*top.get(up, []), size])[-2:]
    for x in made:
        two = top[x["parent_id"]]
        x["sibling_len"] = 0 if len(two) < 2 else two[0] if two[1] == x["text_len"] else two[1]
    return {
        "page_id": page_id, "title": title, "page_text": " ".join(_strings(nodes[0])), "link_len": sum(len(a["text"]) for a in anchors), "anchors": anchors, "headings": headings,
        "metas": metas, "json_ld": json_ld, "nodes": made, "lines": ls, "tags": list(tags.items()), "breadcrumb": crumb,
    }


def dom(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """One row per page with html; see DDL. Columns ``keep`` of the pages pass through as they are. Null html or id: no row."""
    keep = keep or []
    src = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(html_col).alias("html"), *[F.col(c).alias(f"__{c}") for c in keep]).where("page_id IS NOT NULL AND html IS NOT NULL")
    kinds = "".join(f", `{f.name.removeprefix('__')}` {f.dataType.simpleString()}" for f in src.schema.fields[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                made = pa.RecordBatch.from_pylist([record(i, h) for i, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], schema=SCHEMA)
                yield pa.RecordBatch.from_arrays([*made.columns, *part.columns[2:]], names=[*SCHEMA.names, *keep])

    return src.mapInArrow(run, DDL + kinds)


def lines(d: DataFrame) -> DataFrame:
    """(page_id, node_id, line_no, line) of every content candidate."""
    n = d.select("page_id", "lines", F.explode("nodes").alias("n"))
    own = F.slice("lines", F.col("n.line_from") + 1, F.col("n.n_lines"))
    return n.select("page_id", F.col("n.node_id").alias("node_id"), F.posexplode(own).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def anchors(d: DataFrame) -> DataFrame:
    """(page_id, idx, text, href, ...): one row per anchor in document order."""
    return d.select("page_id", F.explode("anchors").alias("a")).select("page_id", "a.*")
