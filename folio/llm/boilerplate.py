"""Page boilerplate mixed with main content (problem 2).

Minimum-cut labelling: each line of a page's text is a node; a classifier's
costs are its terminal capacities, adjacency of lines and proximity in the page's
DOM are smoothness edges, and the minimum cut parts content from boilerplate.
The classifier is a logistic regression on hashed n-grams and layout features.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import linear, quickfix
from folio.llm.pagetext import blocks
from folio.llm.patterns import FILLER, MESSAGE, mask
from folio.util import materialize

#: Bound on the pages, drawn by hash of their id, the classifier is fitted on ...
SAMPLE_PAGES = 3000
#: ... on the labelled lines of each class, and on their characters: what reaches the driver is bounded by both.
SAMPLE_LINES, LINE_LENGTH = 9000, 2000
#: Capacities of smoothness edges: consecutive lines of one holder, of different ones, next lines of a holder that others part.
SAME_HOLDER, OTHER_HOLDER, NEXT_IN_HOLDER = 0.35, 0.1, 0.15
#: Log odds that a telling tag (nav, aside, footer) adds.
TOLD = 3.0
#: A page with less text than this, links and headings left out, may hold a message in place of the content.
LITTLE = 250
#: Weight of a line like a message, which is rare, when the classifier is fitted.
ODD_WEIGHT = 4.0

# Phrases of a byline, which belongs to the main body. A weak label only.
BYLINE = re.compile(r"posted by|written by|publié par|publicad[oa] p|опубликован|整理发布|发布者|投稿者", re.I)
SEPARATORS = re.compile(r"\s[|/·>┃]\s|[|｜┃←→、]")
_JUNK = re.compile(r"[\W_]+")
DENSE = 22
_HIGH = re.compile(r"[^\x00-\x7f]")
_CJK = re.compile("[\u3040-\u9fff]")


def stands_in(s: str) -> bool:
    """Whether a line looks like a message in place of the content, which is no boilerplate. A weak label only."""
    return bool("\x02" in s or FILLER.search(s) or MESSAGE.search(s))


def _key(s: str) -> str:
    return _JUNK.sub("", s).lower()


class Line:
    __slots__ = ("no", "text", "link", "told", "heading", "holder", "share", "dense")


def page_lines(html: str | None, text: str, host: str | None) -> list[Line]:
    """The text's lines that are not blank, each with the block of the page it comes from, if one has the same letters and figures."""
    bs = blocks(html) if html else []
    total = sum(len(b.text) for b in bs) or 1
    mass: Counter[int] = Counter()
    by_key: dict[str, list] = {}
    for b in bs:
        mass[b.holder] += len(b.text) - b.links
        by_key.setdefault(_key(b.text), []).append(b)
    fix = quickfix.damaged(text)
    out: list[Line] = []
    host_l = (host or "").lower()
    after_heading = False
    for no, raw in enumerate(text.split("\n"), 1):
        if not raw.strip():
            continue
        s = raw.strip(" \t\r\u3000")
        if fix:
            s = quickfix.fix(s)
        s = " ".join(s.split()).lower()
        x = Line()
        x.no = no
        own = by_key.get(_key(raw))
        b = None
        if own:
            b = own.pop(0) if len(own) > 1 else own[0]
        x.told = b.told if b else 0
        x.link = b.links / max(len(b.text.strip()), 1) if b else 0.0
        x.heading = bool(b) and len(b.tag) == 2 and b.tag[0] == "h" and b.tag != "hr"
        x.holder = b.holder if b else -1
        x.share = mass[b.holder] / total if b else 0.0
        has_host = bool(host_l) and host_l in s
        if has_host:
            s = s.replace(host_l, "\x01")
        x.text = s = mask(s)
        n = len(s)
        d = [0.0] * DENSE
        d[0] = b is None
        d[1] = x.link >= 0.5
        d[2] = x.link >= 0.9
        d[3] = x.heading
        d[4] = x.share >= 0.5
        d[5] = b is not None and x.share < 0.1
        d[6] = not out
        d[7] = after_heading
        d[8 + min(5, n.bit_length() - 1 - 2 if n > 7 else 0)] = 1.0
        d[14] = has_host
        seps = len(SEPARATORS.findall(s))
        d[15] = seps >= 1
        d[16] = seps >= 3
        d[17] = s[-1] in ".。！？!?”»」…"
        d[18] = raw[0] in "　 "
        x.dense = d
        out.append(x)
        after_heading = x.heading
    little = sum(len(x.text) for x in out if x.link < 0.5 and x.told != 1 and not x.heading) < LITTLE
    for i, x in enumerate(reversed(out)):
        x.dense[19] = i == 0
        x.dense[20] = i < 3
        x.dense[21] = little
    return out


# -- classifier -----------------------------------------------------------------------------------


LINE = "page_id bigint, host string, no int, text string, told int, link double, heading boolean, share double, byline boolean, stands boolean, dense array<double>"


def sampled_lines(content: DataFrame, pages: DataFrame) -> DataFrame:
    """The lines of at most about SAMPLE_PAGES pages as rows of LINE; pages are read and parsed by the tasks."""
    every = max(1, -(-pages.count() // SAMPLE_PAGES))
    pick = F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0
    c = content.where(pick).where("page_id IS NOT NULL").groupBy("page_id").agg(F.max("text").alias("text"))
    p = pages.where(pick).where("page_id IS NOT NULL").groupBy("page_id").agg(F.max_by(F.struct("host", "html"), F.struct(F.length("html"), "host")).alias("p"))
    j = c.where("text IS NOT NULL").join(p, "page_id", "left").select("page_id", "p.host", "p.html", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(11)]
            for pid, host, html, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                for x in page_lines(html, text, host):
                    row = (pid, host, x.no, x.text, x.told, x.link, x.heading, x.share, bool(BYLINE.search(x.text)), stands_in(x.text), [float(v) for v in x.dense])
                    for col, v in zip(cols, row, strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.bool_(), pa.float64(), pa.bool_(), pa.bool_(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in LINE.split(", ")])

    # a set number of tasks: the sample is small in rows but parsing it is not
    return j.repartition(16, "page_id").mapInArrow(run, LINE)


def weak_labels(lines: DataFrame) -> DataFrame:
    """Labelled lines (page_id, no, text, dense, kind).

    Boilerplate ("pos"): told so by a tag, link text, or repeated within its
    host. Content: headings and bylines ("head"), lines like messages in place of
    the content ("odd"), and lines in the main holder that are unlike others ("rest").
    """
    n = lines.groupBy("host").agg(F.countDistinct("page_id").alias("n"))
    k = lines.select("host", "text", "page_id").distinct().groupBy("host", "text").agg(F.count("*").alias("k"))
    j = lines.join(k.select(F.col("host").alias("h1"), F.col("text").alias("t1"), "k"), F.col("host").eqNullSafe(F.col("h1")) & (F.col("text") == F.col("t1")))
    j = j.join(F.broadcast(n.select(F.col("host").alias("h2"), "n")), F.col("host").eqNullSafe(F.col("h2")))  # hosts of the sample: at most SAMPLE_PAGES
    often = (F.col("k") >= 4) & (12 * F.col("k") >= F.col("n")) & (F.length("text") > 4)
    kind = (
        F.when(F.col("stands") & (F.col("told") != 1) & (F.col("link") < 0.5), "odd").when(F.col("heading") | F.col("byline"), "head")
        .when((F.col("told") == 1) | (F.col("link") >= 0.9) | often, "pos").when(((F.col("told") == 2) | (F.col("share") >= 0.4)) & (F.col("link") < 0.3) & (F.col("k") <= 2), "rest")
    )
    return j.select("page_id", "no", "text", "dense", kind.alias("kind")).where("kind IS NOT NULL")


def fit(lines: DataFrame) -> linear.Logistic:
    """The classifier of labelled lines; of each kind a bounded hash sample reaches the driver."""
    bound = F.when(F.col("kind").isin("odd", "head"), SAMPLE_LINES // 4).otherwise(SAMPLE_LINES)
    draw = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("page_id", "no"), "page_id", "no"))
    rows = lines.where(F.length("text") <= LINE_LENGTH).withColumn("r", draw).where(F.col("r") <= SAMPLE_LINES).where(F.col("r") <= bound).select("kind", "text", "dense").toArrow()
    kinds, texts = rows.column("kind").to_pylist(), rows.column("text").to_pylist()
    if len(set(kinds)) < 2 or "pos" not in kinds:
        return linear.Logistic(np.zeros(linear.DIM), np.zeros(DENSE), -1.0)
    order = sorted(range(len(kinds)), key=lambda i: (kinds[i], texts[i]))
    d = rows.column("dense").to_pylist()
    kinds, texts, dense = [kinds[i] for i in order], [texts[i] for i in order], np.array([d[i] for i in order])
    y = np.array([k == "pos" for k in kinds], float)
    # every other line loses what its block tells, so that the text must do without
    hide = np.arange(len(kinds)) % 2 == 1
    dense[hide, 0] = 1
    dense[np.ix_(hide, [1, 2, 3, 4, 5])] = 0
    # lines whose letters beyond ASCII were lost count as what they were: a copy of some shows how they look
    lost = [i for i, t in enumerate(texts) if i % 3 == 0 and len(t) < 200 and not t.isascii() and not _CJK.search(t)]
    weight = np.array([ODD_WEIGHT if k == "odd" else 1.0 for k in kinds])
    texts += [_HIGH.sub("�", texts[i]) for i in lost]
    return linear.fit(texts, np.concatenate([dense, dense[lost]]), np.concatenate([y, y[lost]]), np.concatenate([weight, weight[lost]]))


# -- minimum cut ------------------------------------------------------------------------------------


def edges(lines: list[Line]) -> list[tuple[int, int, float]]:
    out, last = [], {}
    for i, x in enumerate(lines):
        if i:
            same = x.holder >= 0 and x.holder == lines[i - 1].holder
            out.append((i - 1, i, SAME_HOLDER if same else OTHER_HOLDER))
        if x.holder >= 0:
            j = last.get(x.holder)
            if j is not None and j < i - 1:
                out.append((j, i, NEXT_IN_HOLDER))
            last[x.holder] = i
    return out


def min_cut(z: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source (boilerplate) side of a minimum cut.

    Node i is tied to the source by max(0, z) and to the sink by max(0, -z).
    A node whose terminal outweighs all its edges is on that terminal's side in
    every minimum cut: such nodes are contracted first, and their edges become
    terminal capacity of their neighbours. What is left goes to the max-flow.
    """
    n = len(z)
    z = list(z)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    weight = [0.0] * n
    for a, b, w in links:
        near[a].append((b, w))
        near[b].append((a, w))
        weight[a] += w
        weight[b] += w
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is not None or abs(z[i]) <= weight[i]:
            continue
        side[i] = z[i] > 0
        for j, w in near[i]:
            if side[j] is None:
                z[j] += w if side[i] else -w
                weight[j] -= w
                todo.append(j)
    free = [i for i in range(n) if side[i] is None]
    if free:
        for i, s in zip(free, _max_flow(free, z, near, side), strict=True):
            side[i] = s
    return [bool(s) for s in side]


def _max_flow(free: list[int], z: list[float], near: list, side: list) -> list[bool]:
    """Blocking flows over levels; the source side is what the residual graph reaches from the source."""
    number = {i: k for k, i in enumerate(free)}
    s, t = len(free), len(free) + 1
    head: list[list[int]] = [[] for _ in range(t + 1)]
    to: list[int] = []
    cap: list[float] = []

    def arc(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(forth)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for k, i in enumerate(free):
        if z[i] > 0:
            arc(s, k, z[i], 0.0)
        elif z[i] < 0:
            arc(k, t, -z[i], 0.0)
        for j, w in near[i]:
            if side[j] is None and j > i:
                arc(k, number[j], w, w)
    eps = 1e-9
    while True:
        level = [-1] * (t + 1)
        level[t], q = 0, deque([t])
        while q:  # distances to the sink over arcs with room
            v = q.popleft()
            for e in head[v]:
                if level[to[e]] < 0 and cap[e ^ 1] > eps:
                    level[to[e]] = level[v] + 1
                    q.append(to[e])
        if level[s] < 0:
            break
        nxt = [0] * (t + 1)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                f = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= f
                    cap[e ^ 1] += f
                at = next(k for k, e in enumerate(path) if cap[e] <= eps)
                v = to[path[at] ^ 1]
                del path[at:]
                continue
            arcs = head[v]
            while nxt[v] < len(arcs):
                e = arcs[nxt[v]]
                if cap[e] > eps and level[to[e]] == level[v] - 1:
                    break
                nxt[v] += 1
            if nxt[v] < len(arcs):
                path.append(arcs[nxt[v]])
                v = to[path[-1]]
            elif path:
                v = to[path.pop() ^ 1]
                nxt[v] += 1
            else:
                break
    reached, todo = {s}, [s]
    while todo:
        v = todo.pop()
        for e in head[v]:
            if cap[e] > eps and to[e] not in reached:
                reached.add(to[e])
                todo.append(to[e])
    return [k in reached for k in range(len(free))]


# -- the operator -----------------------------------------------------------------------------------


def label(model: linear.Logistic, pages: list[list[Line]]) -> list[list[bool]]:
    flat = [x for p in pages for x in p]
    if not flat:
        return [[] for _ in pages]
    z = model.logits([x.text for x in flat], np.array([x.dense for x in flat], dtype=float))
    z = z + TOLD * np.array([x.told == 1 for x in flat])
    out, at = [], 0
    for p in pages:
        out.append(min_cut(z[at: at + len(p)].tolist(), edges(p)))
        at += len(p)
    return out


def _joined(content: DataFrame, pages: DataFrame) -> DataFrame:
    c = content.select("page_id", "text").where("page_id IS NOT NULL AND text IS NOT NULL")
    p = pages.select("page_id", "host", "html").where("page_id IS NOT NULL")
    return c.join(p, "page_id", "left")


def train(content: DataFrame, pages: DataFrame) -> linear.Logistic:
    return fit(weak_labels(materialize(sampled_lines(content, pages))))


def _labelled(content: DataFrame, pages: DataFrame, schema: str, make) -> DataFrame:  # noqa: ANN001
    bc = content.sparkSession.sparkContext.broadcast(train(content, pages))  # bound: DIM + DENSE numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bc.value
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                ids, texts, hosts, htmls = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("page_id", "text", "host", "html"))
                lines = [page_lines(h, t, o) for h, t, o in zip(htmls, texts, hosts, strict=True)]
                yield make(ids, texts, lines, label(model, lines))

    return _joined(content, pages).mapInArrow(run, schema)


def found(content: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, line_no): lines that are not part of the main body.

    Null texts have no lines; blank lines are never rows; a page without html is
    judged by its text alone. An extraction delivered twice counts once.
    """

    def make(ids, texts, lines, sides):  # noqa: ANN001, ANN202
        pid, no = [], []
        for i, p, s in zip(ids, lines, sides, strict=True):
            for x, cut in zip(p, s, strict=True):
                if cut:
                    pid.append(i)
                    no.append(x.no)
        return pa.RecordBatch.from_arrays([pa.array(pid, pa.int64()), pa.array(no, pa.int32())], names=["page_id", "line_no"])

    return _labelled(content, pages, "page_id bigint, line_no int", make).distinct()


def main_text(content: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, text): each distinct extraction's heading, byline and story only, lines in order; pages left without any have empty text."""

    def make(ids, texts, lines, sides):  # noqa: ANN001, ANN202
        out = []
        for t, p, s in zip(texts, lines, sides, strict=True):
            cut = {x.no for x, c in zip(p, s, strict=True) if c}
            out.append("\n".join(line for no, line in enumerate(t.split("\n"), 1) if no not in cut))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["page_id", "text"])

    return _labelled(content, pages, "page_id bigint, text string", make).distinct()
