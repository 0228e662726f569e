"""Template residue, filler, error messages and requests for scripts (problem 5).

A regularized linear classifier on hashed n-grams of the visible lines and on
length and title features, fitted on weak labels from response status and
phrases; its threshold is validated on hosts it has not seen. A page is as bad as
its worst line: the length of the page's other text is a feature of each line.
Labels, weights and threshold come from the lines of all pages.
"""

from __future__ import annotations

import gc
import re
import warnings
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import linear, quickfix
from folio.llm.pagetext import blocks, title
from folio.llm.patterns import FILLER, MESSAGE, mask, may_hold, may_tell
from folio.util import discard, materialize

#: Steps of the fit, and about so many lines (and characters) a step: a step takes all lines if they are no more, else those of
#: a share of the pages, each share in its turn. There are no more shares than steps, so every line counts.
STEPS, STEP_LINES, STEP_CHARACTERS = 80, 24_000, 48_000_000
#: A class of labelled lines (residue, hard and easy others) with more lines than this weighs as much as so many.
CLASS_LINES = 8000
#: The driver holds the n-grams of all lines if these have no more characters, else the tasks of each step make them anew.
DRIVER_CHARACTERS = 1_500_000
#: A step is at most so many tasks, of about so many characters if they are fewer; each sends the driver a sum of at most 3 * (DIM + DENSE + 1) numbers.
SUMS, TASK_CHARACTERS = 16, 600_000
#: Pages with less text than the first, headings left out, have little; with at least the second they tell a story.
LITTLE, STORY = 250, 300
DENSE = 16
_WIDE = re.compile("[\u3040-\u9fff]")
_SENTENCE = frozenset(".。!?！？”»」…")
#: Titles of pages that are no chapter.
_NO_TITLE = re.compile(r"^\W*(?:error|untitled|\d{3}|erro|erreur|ошибка|エラー|错误|出错了?|无标题)?\W*\d*\W*$", re.I)


_DIGITS, _PART = re.compile(r"\d+"), re.compile(r"[.!?…。！？：:\[\]（(]+")


def page_lines(html: str, host: str | None) -> tuple[list[str], str, list[int], list[list[int]], int]:
    """Of the page's visible lines outside links and telling tags the texts, what follows each for the classifier, the bits, and hashes of sentences; and how much text they are."""
    fix = quickfix.damaged(html)
    raw: list[str] = []
    heads: list[bool] = []
    for b in blocks(html):
        whole = b.text
        if (b.told == 1 or b.links and 2 * b.links >= len(whole.strip())) and "\x02" not in mask(whole):
            continue
        head = len(b.tag) == 2 and b.tag[0] == "h" and b.tag != "hr"
        for part in whole.split("\n"):
            if fix and not part.isascii():
                part = quickfix.fix(part.strip(" \t\r　"))
            x = " ".join(part.split())
            if x:
                raw.append(x)
                heads.append(head)
    if not raw:
        return [], "", [], [], 0
    text = "\n".join(raw).lower()
    lines = text.split("\n")
    host = (host or "").lower()
    if host and host in text:
        hosted = [host in s for s in lines]
        lines = [s.replace(host, "\x01") for s in lines]
        text = "\n".join(lines)
    else:
        hosted = [False] * len(lines)
    t = title(html).lower()
    no_title = bool(_NO_TITLE.match(t))
    own = [0 if h or has else len(s) for s, h, has in zip(lines, heads, hosted, strict=True)]
    story = sum(own)
    sentences = sum(1 for s, n in zip(lines, own, strict=True) if n > 24 and s[-1] in _SENTENCE)
    page = no_title << 10 | (sentences >= 3) << 13 | (sentences >= 8) << 14
    often = Counter(lines) if len(set(lines)) < len(lines) else None
    masks, told = may_hold(text), may_tell(text)  # else no line holds a placeholder, or a phrase
    bits = []
    for s, h, has, n in zip(lines, heads, hosted, own, strict=True):
        same = n if often is None else n * often[s]
        rest = story - same
        k = (len(s) < 12) << 7 | h << 11 | has << 12
        if same > n and 2 * same > story:
            k |= 1 << 9
        if masks and "\x02" in (masked := mask(s)):  # a placeholder is residue amid any text
            k |= _PLACEHOLDER | (masked.strip() == "\x02") << 1 | no_title << 10
        else:
            k |= page | 4 << (0 if rest < 40 else 1 if rest < 120 else 2 if rest < 300 else 3 if rest < 800 else 4) | (len(s) > 160) << 8
        if told and may_tell(s):
            k |= (_FILLER if FILLER.search(s) else 0) | (_MESSAGE if MESSAGE.search(s) else 0)
        bits.append(k)
    parts = [[] if h else _sentences(s) if len(s) > 200 else _sentences_kept(s) for s, h in zip(_DIGITS.sub("0", text).split("\n"), heads, strict=True)]
    return lines, "\x03" + t.replace("\n", " ") if no_title else "", bits, parts, story


def _sentences(s: str) -> list[int]:
    """Hashes of the sentences of a line whose figures are masked; those too short to tell anything are left out."""
    if len(s) < 6:
        return []
    wide = not s.isascii()
    told = {p for x in _PART.split(s) if len(p := x.strip()) >= 6 and (len(p) >= 14 or wide and _WIDE.search(x))}
    return [_hash(p) for p in told]


_sentences_kept = lru_cache(20_000)(_sentences)


def _unwatched() -> None:
    """Spark's Python workers collect garbage after every task, and look through all objects of all modules for it unless these are frozen."""
    if not gc.get_freeze_count():
        gc.freeze()


PAGE = "page_id bigint, host string, half int, status int, size int, content bigint, bare array<string>, tail string, bits array<int>, parts array<array<bigint>>, story int"
#: Bits of a line beyond its dense features, which are all 0 or 1.
_FILLER, _MESSAGE = 1 << DENSE, 2 << DENSE
_PLACEHOLDER, _HEADING, _HOSTED = 1, 1 << 11, 1 << 12


def page_rows(pages: DataFrame) -> DataFrame:
    """Every page with html as a row of PAGE: its visible lines, their bits, hashes of their sentences, and how much text it has."""
    host = F.coalesce("host", F.lit(""))
    src = pages.where("page_id IS NOT NULL AND html IS NOT NULL").select(
        "page_id", host.alias("host"), F.pmod(F.xxhash64(host), F.lit(2)).cast("int").alias("half"), F.col("status_code").cast("int").alias("status"), F.length("html").alias("size"), F.xxhash64("html").alias("content"), "html"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _unwatched()
        kinds = (pa.list_(pa.string()), pa.string(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64())), pa.int32())
        names = [x.split()[0] for x in PAGE.split(", ")]
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = [page_lines(html, host_) for host_, html in zip(part.column(1).to_pylist(), part.column(6).to_pylist(), strict=True)]
                cols = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(6)), *cols], names=names)

    return src.mapInArrow(run, PAGE)


def _hash(s: str) -> int:
    return int.from_bytes(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _dense(bits: np.ndarray) -> np.ndarray:
    return ((bits[:, None] >> np.arange(DENSE)) & 1).astype(float)


def _texts(bare: list[str], tail: str, bits: list[int]) -> list[str]:
    """The lines as the classifier reads them: one with a placeholder is nothing else, the title follows where it is none."""
    return [("\x02" if k & _PLACEHOLDER else s) + tail for s, k in zip(bare, bits, strict=True)]


def learned(rows: DataFrame) -> DataFrame:
    """(part, sets): hashes of sentences of pages with little text and an error status that stand on several hosts, and hardly ever on pages with a story.

    ``sets``: 1 if that holds over all hosts, 2 if over those of half 0, 4 if over those of half 1.
    """
    x = rows.select("host", "half", "status", "story", F.explode(F.flatten("parts")).alias("part"))
    hosts = x.where((F.col("status") >= 400) & (F.col("story") < LITTLE)).select("part", "host", "half").distinct()
    some = materialize(hosts.groupBy("part").agg(F.count_if(F.expr("half = 0")).alias("h0"), F.count_if(F.expr("half = 1")).alias("h1")).where("h0 + h1 >= 2"))
    good = x.where(F.col("story") >= STORY).join(some.select("part"), "part", "left_semi").groupBy("part").agg(F.count_if(F.expr("half = 0")).alias("g0"), F.count_if(F.expr("half = 1")).alias("g1"))
    sets = " + ".join(f"IF({h} >= 2 AND 3 * {g} < {h}, {v}, 0)" for h, g, v in (("(h0 + h1)", "(g0 + g1)", 1), ("h0", "g0", 2), ("h1", "g1", 4)))
    return some.join(good, "part", "left").na.fill(0).selectExpr("part", f"{sets} AS sets").where("sets > 0")


def furniture(rows: DataFrame) -> DataFrame:
    """(a, b): both hashes of host and line for lines on at least 4 pages, and a twelfth, of a host."""
    n = rows.groupBy("host").agg(F.count("*").alias("n"))
    k = rows.select("host", F.explode(F.array_distinct("bare")).alias("bare")).groupBy("host", *_line_hashes()).agg(F.count("*").alias("k"))
    return k.where("k >= 4").join(n, "host").where("12 * k >= n").select("a", "b")


def _line_hashes() -> tuple:
    return F.xxhash64("host", "bare").alias("a"), F.xxhash64("bare", "host").alias("b")


#: Labels of lines by their number: (1 for residue, weight); 0 is none.
LABELS = ((0, 0.0), (1, 2.0), (1, 6.0), (0, 1.0), (0, 4.0), (0, 0.5))
_Y, _W = np.array([y for y, _ in LABELS], float), np.array([w for _, w in LABELS])


def _kinds(label: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Classes of labelled lines: 0 residue, 1 hard others (weighty, or with little text around), 2 easy others."""
    return np.where(_Y[label] == 1, 0, np.where((_W[label] > 1) | ((bits >> 2) & 7 > 0), 1, 2))


_RESIDUE = frozenset(i for i, (y, _) in enumerate(LABELS) if y)
#: The class of lines with a label where those with little text around are another: of these, and of the others.
_KIND = [[int(_kinds(np.array([y]), np.array([k]))[0]) for k in (4, 32)] for y in range(len(LABELS))]


def _counts(label: list[int], bits: list[int]) -> list[int]:
    """A page's lines by label and class."""
    n = [0] * (3 * len(LABELS))
    for y, k in zip(label, bits, strict=True):
        n[3 * y + _KIND[y][not k >> 2 & 7]] += 1
    return n


TAUGHT = "rid bigint, half int, share int, bare array<string>, tail string, bits array<int>, own array<int>, unseen array<int>, residue boolean, counts array<int>"


def weak_labels(rows: DataFrame, shares: int) -> DataFrame:
    """Every page with labels of its lines by phrases, given ones and messages, and by the text of their page: rows of TAUGHT.

    ``own``: labels with messages of all hosts; ``unseen``: with those of the hosts of the page's half;
    ``residue``: whether a line is, with messages of the other half; ``counts``: lines by labels, label and class.
    """
    said = materialize(learned(rows))
    fixed = materialize(furniture(rows))
    f = rows.select("rid", "host", F.posexplode("bare").alias("no", "bare")).select("rid", "no", *_line_hashes()).join(fixed, ["a", "b"], "left_semi").groupBy("rid").agg(F.collect_list("no").alias("fixed"))
    s = rows.select("rid", F.posexplode("parts").alias("no", "p")).select("rid", "no", F.explode("p").alias("part")).join(said, "part").groupBy("rid").agg(F.collect_list("no").alias("said"), F.collect_list("sets").alias("sets"))
    share = F.pmod(F.xxhash64("page_id"), F.lit(shares)).cast("int")
    j = rows.select("rid", "half", share.alias("share"), "status", "bare", "tail", "bits").join(f, "rid", "left").join(s, "rid", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _unwatched()
        ints = pa.list_(pa.int32())
        for b in batches:
            cols: list[list] = [[] for _ in range(4)]
            sizes, at = pc.utf8_length(b.column(4).flatten()).to_pylist(), 0
            for half, status, bits, fixed_, said_, sets in zip(*(b.column(i).to_pylist() for i in (1, 3, 6, 7, 8, 9)), strict=True):
                own, at = sizes[at: at + len(bits)], at + len(bits)
                stands = {i for i in fixed_ or () if not bits[i] & (_FILLER | _PLACEHOLDER)}
                said = dict.fromkeys(said_ or (), 0)
                for i, v in zip(said_ or (), sets or (), strict=True):
                    said[i] |= v
                story = sum(n for i, (n, k) in enumerate(zip(own, bits, strict=True)) if not (k & (_HEADING | _HOSTED) or i in stands))
                rest = 3 if story >= STORY else 5 if status is None or status == 200 else 0
                message = 1 if story < LITTLE else 4 if story >= STORY else rest
                # by phrases, whatever the hosts
                y = [
                    1 if k & _PLACEHOLDER else 2 if k & _FILLER else 3 if k & _HEADING or i in stands else message if k & _MESSAGE else rest
                    for i, k in enumerate(bits)
                ]
                open_ = {i: v for i, v in said.items() if not (bits[i] & (_PLACEHOLDER | _FILLER | _HEADING | _MESSAGE) or i in stands)}

                def label(which: int) -> list[int]:
                    out = y[:]  # noqa: B023
                    for i, v in open_.items():  # noqa: B023
                        if v & which:
                            out[i] = message  # noqa: B023
                    return out

                three = (label(1), label(2 << half), label(4 >> half)) if open_ else (y, y, y)
                n = _counts(three[0], bits)
                n = n + (_counts(three[1], bits) if open_ else n)
                for col, v in zip(cols, (*three[:2], not _RESIDUE.isdisjoint(three[2]), n), strict=True):
                    col.append(v)
            made = [pa.array(v, t) for v, t in zip(cols, (ints, ints, pa.bool_(), ints), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 1, 2, 4, 5, 6)), *made], names=[x.split()[0] for x in TAUGHT.split(", ")])

    return j.mapInArrow(run, TAUGHT)


def _packed(g: np.ndarray) -> tuple[bytes, bytes]:
    """Which numbers are not 0, a bit each, and these: a task's lines hold a part of all n-grams."""
    some = g != 0
    return np.packbits(some).tobytes(), g[some].tobytes()


def _add_packed(g: np.ndarray, some: bytes, values: bytes) -> None:
    g[np.unpackbits(np.frombuffer(some, np.uint8), count=g.size).view(bool).reshape(g.shape)] += np.frombuffer(values)


def fit(taught: DataFrame, shares: int, characters: int) -> list[linear.Logistic]:
    """The classifiers of the lines of all hosts, of half 0 and of half 1, from all their labelled lines; only gradients reach the driver unless all lines are one step's and have few characters."""
    width = len(LABELS) * 3
    got = taught.groupBy("half").agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(2 * width)]).alias("n")).collect()
    own = sum((np.array(r["n"][:width]) for r in got), np.zeros(width, int))
    halves = {r["half"]: np.array(r["n"][width:]) for r in got}
    n = np.array([own, *(halves.get(h, np.zeros(width, int)) for h in (0, 1))]).reshape(3, len(LABELS), 3)
    n[:, 0] = 0
    lines = n.sum(axis=1)  # by classifier and class
    factor = np.minimum(1, CLASS_LINES / np.maximum(lines, 1))
    weight = _W[None, :, None] * factor[:, None, :]  # of a line by classifier, label and class
    fits = [lines[m, 0] > 0 and lines[m, 1:].sum() > 0 for m in range(3)]
    plain = linear.Logistic(np.zeros(linear.DIM), np.array([8.0] + [0.0] * (DENSE - 1)), -4.0)
    if shares == 1 and characters <= DRIVER_CHARACTERS:
        rows = taught.select("rid", "half", "bare", "tail", "bits", "own", "unseen").toArrow().sort_by([("rid", "ascending")]).to_pylist()
        out = []
        for m in range(3):
            some = [r for r in rows if m == 0 or r["half"] == m - 1] if fits[m] else []
            text = [t for r in some for t in _texts(r["bare"], r["tail"], r["bits"])]
            bits, label = (np.array([v for r in some for v in r[c]], dtype=np.int64) for c in ("bits", "unseen" if m else "own"))
            use = np.flatnonzero(label)
            y, k = label[use], bits[use]
            out.append(linear.fit([text[i] for i in use], _dense(k), _Y[y], weight[m, y, _kinds(y, k)], l2=3e-3, steps=STEPS) if fits[m] else plain)
        return out
    sc = taught.sparkSession.sparkContext
    tasks = min(SUMS, max(1, sc.defaultParallelism), max(1, -(-characters // (shares * TASK_CHARACTERS))))
    weight *= shares / np.maximum((weight * n).sum(axis=(1, 2), keepdims=True), 1e-9)
    size = linear.DIM + DENSE + 1

    def gradient(t: int, theta: np.ndarray) -> np.ndarray:
        bc = sc.broadcast(theta)  # bound: 3 * (DIM + DENSE + 1) numbers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _unwatched()
            g, theta = np.zeros((3, size)), bc.value
            w = _weights(theta)
            for b in batches:
                for at in range(0, b.num_rows, 500):
                    _add_gradient(g, w, theta, weight, b.slice(at, 500))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in _packed(g)], names=["some", "g"])

        own = taught.where(F.col("share") == (t - 1) % shares).select("half", "bare", "tail", "bits", "own", "unseen")
        # Arrow batches pass the driver's JVM as they are; rows would be held there several times over
        sums = own.coalesce(tasks).mapInArrow(run, "some binary, g binary").toArrow()
        bc.destroy()
        total = np.zeros((3, size))
        for some, g in zip(sums.column("some"), sums.column("g"), strict=True):
            _add_packed(total, some.as_py(), g.as_py())
        return total

    theta = linear.adam(np.zeros((3, size)), gradient, np.maximum(lines.sum(axis=1, keepdims=True), 1), 3e-3, STEPS)
    return [linear.Logistic(v[: linear.DIM], v[linear.DIM: -1], v[-1]) if ok else plain for v, ok in zip(theta, fits, strict=True)]


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy().astype(np.int64)


def _halves(part: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The pages of hosts of either half, if there are any: a line goes through the classifiers that count for its host alone."""
    of = part.column("half").to_numpy()
    for half in (0, 1):
        if len(at := np.flatnonzero(of == half)):
            yield half, part.take(pa.array(at))


def _indexed(part: pa.RecordBatch, bits: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The different texts of the pages' lines, and which of them each line has: the n-grams of a text are hashed once."""
    texts = part.column("bare").flatten().to_pylist()
    for i in np.flatnonzero(bits & _PLACEHOLDER):
        texts[i] = "\x02"
    end = np.cumsum(part.column("bare").value_lengths().to_numpy())
    for k, t in enumerate(part.column("tail").to_pylist()):
        if t:
            for i in range(end[k - 1] if k else 0, end[k]):
                texts[i] += t
    index = {t: i for i, t in enumerate(dict.fromkeys(texts))}
    return list(index), np.array([index[t] for t in texts], dtype=np.int64)


def _add_gradient(g: np.ndarray, w: np.ndarray, theta: np.ndarray, weight: np.ndarray, part: pa.RecordBatch) -> None:
    """Add the gradient of the pages' labelled lines, for the classifier of all hosts and that of their half. ``w``: _weights() of theta."""
    for half, some in _halves(part):
        bits, own, unseen = (_flat(some.column(c)) for c in ("bits", "own", "unseen"))
        if not len(bits):
            continue
        index, u = _indexed(some, bits)
        order = np.argsort(u, kind="stable")
        u, bits = u[order], bits[order]
        by = [(m, label, weight[m, label, _kinds(label, bits)]) for m, label in ((0, own[order]), (1 + half, unseen[order]))]
        d = _dense(bits)
        for i, j in linear.pieces(index):
            x = linear.Hashed(index[i:j])
            its = slice(*np.searchsorted(u, (i, j)))
            for m, label, c in by:
                if not c[its].any():
                    continue
                z = x.logits(w[m])[u[its] - i] + d[its] @ theta[m, linear.DIM: -1] + theta[m, -1]
                e = c[its] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - _Y[label[its]])
                g[m, : linear.DIM] += x.gradient(np.bincount(u[its] - i, weights=e, minlength=j - i))
                g[m, linear.DIM: -1] += d[its].T @ e
                g[m, -1] += e.sum()


def _weights(v: np.ndarray) -> np.ndarray:
    """Weights of n-grams as Hashed takes them: of none 0."""
    return np.concatenate([v[..., : linear.DIM], np.zeros((*v.shape[:-1], 1))], axis=-1)


def judged(rows: DataFrame, models: list[linear.Logistic]) -> DataFrame:
    """(rid, page_id, z, unseen): log odds of each page's worst line, by the classifier of all hosts and by that of the half its host is not in; without visible lines -9."""
    bc = rows.sparkSession.sparkContext.broadcast(models)  # bound: 3 * (DIM + DENSE + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _unwatched()
        models = bc.value
        w = [_weights(m.w.astype(float)) for m in models]
        for b in batches:
            for at in range(0, b.num_rows, 500):
                for half, part in _halves(b.slice(at, 500)):
                    bits = _flat(part.column("bits"))
                    index, u = _indexed(part, bits)
                    two = (0, 2 - half)
                    of_text = np.zeros((2, len(index)))
                    for i, j in linear.pieces(index):
                        x = linear.Hashed(index[i:j])
                        for k, m in enumerate(two):
                            of_text[k, i:j] = x.logits(w[m])
                    d = _dense(bits)
                    z = np.array([of_text[k][u] + d @ models[m].d + models[m].b for k, m in enumerate(two)])
                    n = part.column("bits").value_lengths().to_numpy()
                    worst = np.full((2, len(n)), -9.0)
                    if len(u):
                        worst[:, n > 0] = np.maximum.reduceat(z, (np.cumsum(n) - n)[n > 0], axis=1)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(worst[0]), pa.array(worst[1])], names=["rid", "page_id", "z", "unseen"])

    return rows.select("rid", "page_id", "half", "bare", "tail", "bits").mapInArrow(run, "rid bigint, page_id bigint, z double, unseen double")


def threshold(taught: DataFrame, z: DataFrame) -> float:
    """The log odds that part weakly labelled pages of unseen hosts best (F1).

    The hosts are parted in two by hash; each half is labelled with messages
    learned from the other half, and scored by a classifier fitted on it. Without
    pages in both halves there is no unseen host: 0, and a warning.
    """
    grid = np.arange(-1.0, 1.51, 0.25)
    below = sum((F.col("unseen") > float(t)).cast("int") for t in grid)  # how many of the grid a page lies beyond
    got = taught.where(F.size("bare") > 0).select("rid", "half", "residue").join(z, "rid").groupBy("half", "residue", below.alias("k")).agg(F.count("*").alias("n")).collect()
    if len({r["half"] for r in got}) < 2:
        warnings.warn("residue: too few hosts to validate the threshold on unseen ones; log odds of 0 are taken", stacklevel=2)
        return 0.0
    best, at = 0.0, 0.0
    for i, t in enumerate(grid):
        hits, both, true = (sum(r["n"] for r in got if ok(r)) for ok in (lambda r: r["k"] > i, lambda r: r["k"] > i and r["residue"], lambda r: r["residue"]))  # noqa: B023
        f1 = 2 * both / max(1, hits + true)
        if f1 > best + 1e-9 or (abs(f1 - best) < 1e-9 and abs(t) < abs(at)):
            best, at = f1, float(t)
    return at


def once(rows: DataFrame) -> DataFrame:
    """Of several rows of a page the one with the longest html."""
    best = F.max_by("rid", F.struct("size", "host", "status", "content", "rid"))
    some = materialize(rows.groupBy("page_id").agg(best.alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return rows.join(some, "page_id", "left").where("kept IS NULL OR kept = rid").drop("kept")


def scored(pages: DataFrame) -> DataFrame:
    """(page_id, score, residue): log odds and verdict for every page with html; null html and null ids have no rows."""
    rows = materialize(page_rows(pages).withColumn("rid", F.monotonically_increasing_id()))
    characters = F.expr("aggregate(bare, 0L, (n, x) -> n + length(x))") + F.size("bare") * F.length("tail")
    n = rows.agg(F.sum(F.size("bare")).alias("lines"), F.sum("size").alias("size"), F.sum(characters).alias("characters")).first()
    shares = min(STEPS, max(1, -(-(n["lines"] or 0) // STEP_LINES), -(-(n["size"] or 0) // STEP_CHARACTERS)))
    labelled = weak_labels(once(rows), shares)
    # the rows of a share lie in a few files of its own
    spread = labelled.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "share", F.pmod("rid", F.lit(8)))
    taught = materialize(spread, "share") if shares > 1 else materialize(labelled)
    models = fit(taught, shares, n["characters"] or 0)
    z = materialize(judged(rows, models))
    at_least = threshold(taught, z)
    discard(rows)
    discard(taught)
    return z.select("page_id", F.col("z").alias("score"), (F.col("z") > at_least).alias("residue"))


def found(pages: DataFrame) -> DataFrame:
    """(page_id): pages with residue in place of a chapter, or a placeholder anywhere in their visible text."""
    return scored(pages).where("residue").select("page_id").distinct()


def kept(pages: DataFrame) -> DataFrame:
    """(page_id): the pages that are left, those without html among them."""
    return pages.select("page_id").where("page_id IS NOT NULL").distinct().join(found(pages), "page_id", "left_anti")
