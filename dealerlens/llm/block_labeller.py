"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks, the runs of text between block-level
tags.  Each block is a vector: its tag path (hashed names, classes and ids,
and four marks for article-like and page-furniture elements), its hashed words,
its length and its share of link text.  A bidirectional LSTM in numpy reads
the whole page both ways and labels every block content or furniture; content
blocks joined in page order are the text.

Learning uses a bounded sample of pages (``sample_pages``, first in hash order
of the id), labelled by their own semantic markup: inside an article or main
element and outside navigation, headers of the page, footers, sidebars, forms,
adverts, notices and comments; pages without such an element are labelled by
text length and link share.  Part of the paths is masked in training, so that
words and neighbours carry weight of their own.  Feature vectors are made in
tasks; only the sample's reach the driver.

Defined results: null and empty pages, and pages without content blocks, have
empty text; repeated rows extract alike; malformed markup is read leniently;
other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh32_intdigest

from .common import prepare, spare, unlike

SAMPLE_PAGES = 250
PATH_DIMS, WORD_DIMS, EXTRA = 24, 24, 8
INPUT = PATH_DIMS + WORD_DIMS + EXTRA
HIDDEN = 16
EPOCHS = 50
#: Training reads pages in windows of so many blocks; labelling reads them whole.
WINDOW = 32

#: Elements (HTML standard): raw text, which an open tag extends to the end of
#: the page; others whose content isn't read; void; those that break a line.
RAW = ("script", "style", "textarea")
UNREAD = frozenset("noscript template iframe svg select object".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section
summary table tbody td tfoot th thead title tr ul""".split())
FURNITURE_TAGS = frozenset("nav header footer aside form head title menu button fieldset dialog".split())
FURNITURE_NAME = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|sidebar|"
                            r"footer|header|masthead|cookie\w*|consent|notice|alert|popup|modal|newsletter|subscribe|"
                            r"share|social|related|recommend\w*|comments?|replies|disqus|login|search)(?:$|[-_ ])")
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_NAME = re.compile(r"(?:^|[-_ ])(?:article|content|post|entry|story|body|text)(?:$|[-_ ])")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>", re.S | re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _unread(tokens: list[re.Match]) -> dict[int, int]:
    """The place of the end tag of every element of ``UNREAD``, by the place
    of its start tag.  Nested ones pair inside out; one that closes itself, or
    that nothing closes, is its tag alone."""
    ends: dict[int, int] = {}
    begun: dict[str, list[int]] = {}
    for k, m in enumerate(tokens):
        tag = m[3].lower() if m[3] else ""
        if tag not in UNREAD:
            continue
        if not m[2]:
            if not m[4].endswith("/"):
                begun.setdefault(tag, []).append(k)
        elif begun.get(tag):
            ends[begun[tag].pop()] = k
    return ends


@dataclass
class Block:
    path: tuple[str, ...]   # element names, outermost first
    names: str              # classes, ids and roles on the path
    text: str
    linked: int             # code points inside links


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order, with character references decoded and white
    space folded; blank ones are left out."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, str]] = []
    run: list[str] = []
    link: list[str] = []

    def flush():
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                in_links = len(" ".join(entities.unescape("".join(link)).split()))
                out.append(Block(tuple(t for t, _ in stack), " ".join(n for _, n in stack if n).lower(), text,
                                 min(in_links, len(text))))
            run.clear()
            link.clear()

    def keep(text: str):
        run.append(text)
        if any(t == "a" for t, _ in stack):
            link.append(text)

    tokens = list(TOKEN.finditer(page))
    ends = _unread(tokens)
    at, skipped = 0, -1
    for k, m in enumerate(tokens):
        if k <= skipped:
            continue
        if m.start() > at:
            keep(page[at:m.start()])
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag in UNREAD:
            if k in ends:
                skipped = ends[k]
                at = tokens[skipped].end()
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if m[2]:
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == tag:
                    del stack[d:]
                    break
        elif tag not in VOID and not m[4].endswith("/"):
            if tag in BLOCK:  # an open paragraph ends, with what was left open in it
                for d in range(len(stack) - 1, -1, -1):
                    if stack[d][0] == "p" or (tag == "li" and stack[d][0] == "li"):
                        del stack[d:]
                        break
                    if stack[d][0] in BLOCK:
                        break
            names = " ".join(a or b or c for a, b, c in NAMES.findall(m[4])) if m[4] else ""
            stack.append((tag, names))
    if at < len(page):
        keep(page[at:])
    flush()
    return out


def _marks(b: Block) -> tuple[bool, bool, bool, bool]:
    """(content element, content name, furniture element, furniture name).
    A header inside an article is its headline, not the page's."""
    content = [k for k, t in enumerate(b.path) if t in CONTENT_TAGS]
    inside = b.path[content[0]:] if content else b.path
    furniture = any(t in FURNITURE_TAGS and not (content and t == "header") for t in inside)
    return (bool(content), bool(CONTENT_NAME.search(b.names)), furniture or "head" in b.path,
            bool(FURNITURE_NAME.search(b.names)))


def teach(page: list[Block]) -> np.ndarray:
    """Labels from the page's own markup."""
    marks = [_marks(b) for b in page]
    if any(m[0] for m in marks):
        return np.array([m[0] and not (m[2] or m[3]) for m in marks], float)
    return np.array([not (m[2] or m[3]) and len(b.text.split()) >= 12 and b.linked * 2 < len(b.text)
                     for m, b in zip(marks, page, strict=True)], float)


_HASHED: dict[str, tuple[int, float]] = {}


def _slot(word: str, dims: int) -> tuple[int, float]:
    got = _HASHED.get(word)
    if got is None:
        if len(_HASHED) > 300_000:
            _HASHED.clear()
        h = xxh32_intdigest(word)
        got = _HASHED[word] = (h >> 1, 1.0 if h & 1 else -1.0)
    return got[0] % dims, got[1]


def features(page: list[Block]) -> np.ndarray:
    """One row of INPUT numbers per block."""
    x = np.zeros((len(page), INPUT), np.float32)
    for k, b in enumerate(page):
        for name in (*b.path, *b.names.split()):
            i, s = _slot("\x01" + name, PATH_DIMS)
            x[k, i] += s
        words = b.text.lower().split()
        scale = 1 / np.sqrt(len(words))
        row = [0.0] * WORD_DIMS
        for w in words:
            i, s = _slot(w, WORD_DIMS)
            row[i] += s
        x[k, PATH_DIMS:PATH_DIMS + WORD_DIMS] = np.array(row) * scale
        x[k, PATH_DIMS + WORD_DIMS:] = (*_marks(b), np.log1p(len(words)) / 4, b.linked / len(b.text),
                                        k / len(page), 1.0)
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Lstm:
    """One direction.  Gates in the order input, forget, output, candidate."""

    def __init__(self, w: np.ndarray):
        self.w = w  # (INPUT + HIDDEN, 4 * HIDDEN)

    def run(self, x: np.ndarray, live: np.ndarray, tape: list | None = None) -> np.ndarray:
        """Hidden states for x (steps, pages, INPUT); page p lives while
        live[step, p]."""
        steps, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out = np.zeros((steps, n, HIDDEN))
        for t in range(steps):
            z = np.hstack((x[t], h))
            g = z @ self.w
            i, f, o = (_sigmoid(g[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            a = np.tanh(g[:, 3 * HIDDEN:])
            new_c = f * c + i * a
            tc = np.tanh(new_c)
            on = live[t][:, None]
            if tape is not None:
                tape.append((z, i, f, o, a, c, tc, on))
            c = np.where(on, new_c, c)
            h = np.where(on, o * tc, h)
            out[t] = h
        return out

    def back(self, dout: np.ndarray, tape: list) -> np.ndarray:
        """Gradient of the weights from that of the hidden states."""
        dw = np.zeros_like(self.w)
        dh = np.zeros(dout.shape[1:])
        dc = np.zeros_like(dh)
        for t in range(len(tape) - 1, -1, -1):
            z, i, f, o, a, c, tc, on = tape[t]
            dh = dh + dout[t]
            do = np.where(on, dh * tc, 0)
            dn = np.where(on, dh * o * (1 - tc * tc) + dc, 0)
            g = np.hstack((dn * a * i * (1 - i), dn * c * f * (1 - f), do * o * (1 - o), dn * i * (1 - a * a)))
            dw += z.T @ g
            dz = g @ self.w.T
            dh = np.where(on, dz[:, -HIDDEN:], dh)
            dc = np.where(on, dn * f, dc)
        return dw


@dataclass
class Labeller:
    forward: np.ndarray
    backward: np.ndarray
    out: np.ndarray  # (2 * HIDDEN + 1,)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """P(content) of every block of every page; pages of like length are
        read together."""
        result: list = [None] * len(pages)
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            size = len(pages[order[at]])
            to = at
            while to < len(order) and to - at < 512 and len(pages[order[to]]) <= max(8, 2 * size):
                to += 1
            part = order[at:to]
            at = to
            x, live = _pad([pages[k] for k in part])
            if not len(x):
                for k in part:
                    result[k] = np.zeros(0)
                continue
            p = self._probabilities(x, live)[0]
            for j, k in enumerate(part):
                result[k] = p[:len(pages[k]), j]
        return result

    def _probabilities(self, x, live, tapes=(None, None)):
        # a page's blocks come first in its column, so that the backward pass
        # idles over the padding and starts at the page's last block
        f = Lstm(self.forward).run(x, live, tapes[0])
        b = Lstm(self.backward).run(x[::-1], live[::-1], tapes[1])[::-1]
        h = np.concatenate((f, b, np.ones((*f.shape[:2], 1))), 2)
        return _sigmoid(h @ self.out), h


def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages), default=0)
    x = np.zeros((steps, len(pages), INPUT))
    live = np.zeros((steps, len(pages)), bool)
    for j, p in enumerate(pages):
        x[:len(p), j] = p
        live[:len(p), j] = True
    return x, live


def train(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 5) -> Labeller:
    """Cross-entropy by Adam on all windows at once, with paths masked anew in
    each epoch."""
    rng = np.random.default_rng(seed)
    cut = [(p[k:k + WINDOW], y[k:k + WINDOW]) for p, y in zip(pages, labels, strict=True)
           for k in range(0, len(p), WINDOW)]
    x, live = _pad([p for p, _ in cut])
    y = np.zeros(live.shape)
    for j, (_, v) in enumerate(cut):
        y[:len(v), j] = v
    shape = (INPUT + HIDDEN, 4 * HIDDEN)
    params = [rng.normal(0, 0.15, shape), rng.normal(0, 0.15, shape), rng.normal(0, 0.15, 2 * HIDDEN + 1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    path = [*range(PATH_DIMS), *range(PATH_DIMS + WORD_DIMS, PATH_DIMS + WORD_DIMS + 2)]
    n = max(1, live.sum())
    for step in range(1, epochs + 1):
        masked = x.copy()
        hide = np.flatnonzero(rng.random(x.shape[1]) < 0.15)
        masked[np.ix_(range(len(x)), hide, path)] = 0
        model = Labeller(*params)
        tapes: tuple[list, list] = ([], [])
        p, h = model._probabilities(masked, live, tapes)
        d = np.where(live, p - y, 0) / n
        dh = d[..., None] * model.out
        grads = [Lstm(params[0]).back(dh[..., :HIDDEN], tapes[0]),
                 Lstm(params[1]).back(dh[::-1, :, HIDDEN:2 * HIDDEN], tapes[1]), np.einsum("tp,tph->h", d, h)]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] = params[k] - 0.03 * (first[k] / (1 - 0.9 ** step)) / (
                np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
    return Labeller(*params)


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Labeller | None:
    """Labeller from a bounded sample of ``pages`` (page_id, html)."""
    prepare(pages.sparkSession)
    known = pages.where("page_id IS NOT NULL AND html IS NOT NULL").select("page_id")
    picked = known.distinct().orderBy(F.xxhash64(F.lit(3), "page_id"), "page_id").limit(sample_pages)
    rows = pages.select("page_id", "html").join(F.broadcast(picked), "page_id")

    def vectors(batches):
        for b in batches:
            found = [blocks(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "x": [features(p).ravel().tolist() for p in found],
                                "y": [teach(p).tolist() for p in found]})

    t = rows.mapInPandas(vectors, "page_id long, x array<float>, y array<double>").orderBy("page_id").toPandas()
    x = [np.array(v, np.float32).reshape(-1, INPUT) for v in t["x"]]
    y = [np.array(v) for v in t["y"]]
    if not any(v.any() for v in y):
        return None
    return train(x, y)


def extract(pages: DataFrame, labeller: Labeller | None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``pages`` (or its ``keep`` columns) with the main ``text``, to which a
    column of that name gives way."""
    prepare(pages.sparkSession)
    keep = unlike([c for c in pages.columns if c != "html"] if keep is None else keep, "text")
    inner = pages.select(*keep, F.col("html").alias(spare(keep, "__html")))
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType())])
    box = pages.sparkSession.sparkContext.broadcast(labeller)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            texts = []
            for at in range(0, b.num_rows, 250):
                found = [blocks(h) for h in b.column(len(keep)).slice(at, 250).to_pylist()]
                if box.value is None:
                    texts += [""] * len(found)
                    continue
                chances = box.value.label([features(p) for p in found])
                texts += [" ".join(x.text for x, p in zip(page, c, strict=True) if p >= 0.5)
                          for page, c in zip(found, chances, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(texts, pa.string())],
                                             names=[*keep, "text"])

    return inner.mapInArrow(run, schema)
