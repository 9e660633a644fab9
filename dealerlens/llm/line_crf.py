"""Quality by a linear-chain conditional random field over lines.

Every line of a document is good or bad.  A line's evidence is its own
features and those of the lines before and after; a transition weight links
neighbouring labels.  Forward-backward gives each line's probability of being
good; their mean, weighted by line length, passed through a logistic, is the
document's score.

Only documents are labelled, so lines are learnt in rounds: all lines of a
good document are good; of a bad one those that the field of the round before
finds bad, and the worst line always.  Learning uses a bounded sample of
labelled rows (``per_class`` documents of either class): three quarters train
the field, one quarter sets the logistic.  Line features are made in tasks;
only the sample's numbers reach the driver.

Defined results: a null or empty text is one empty line; without labelled
rows of both classes every score is 1; repeated rows score alike; other
columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, spare
from .labels import fit_logistic, held_out, sample

PER_CLASS = 1500
THRESHOLD = 0.3
CALIBRATION = 4
ROUNDS = 3
STEPS = 120
#: Character classes of Latin-1: space, lower, upper, digit, sentence marks,
#: and three kinds of symbols.  Other scripts count as neutral letters.
SPACE, LOWER, UPPER, DIGIT, MARK, BAR, BANG, SYMBOL = range(8)


def _classes() -> np.ndarray:
    t = np.full(256, SYMBOL, np.uint8)
    for b in range(256):
        ch = chr(b)
        if ch.isspace():
            t[b] = SPACE
        elif ch.isupper():
            t[b] = UPPER
        elif ch.isalpha():
            t[b] = LOWER
        elif ch.isdigit():
            t[b] = DIGIT
        elif ch in ".,;:'\"()-?":
            t[b] = MARK
        elif ch in "|<>{}[]\\/_=~^":
            t[b] = BAR
        elif ch == "!":
            t[b] = BANG
    return t


CLASSES = _classes()
FEATURES = 12


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, length of each line in code points)."""
    lines = (text or "").split("\n")
    out = np.zeros((len(lines), FEATURES), np.float32)
    seen: set[str] = set()
    for k, line in enumerate(lines):
        words = line.split()
        n, w = len(line), len(words)
        if not w:
            out[k, 11] = 1
            continue
        kinds = np.bincount(CLASSES[np.frombuffer(line.encode("latin-1", "ignore"), np.uint8)], minlength=8)
        letters = max(1, n - kinds[SPACE] - kinds[DIGIT] - kinds[MARK] - kinds[BAR] - kinds[BANG] - kinds[SYMBOL])
        distinct = len(set(words))
        out[k] = (min(n, 2000) / 1000, kinds[UPPER] / letters, min(2.0, kinds[SYMBOL] / w), min(2.0, kinds[BAR] / w),
                  min(2.0, kinds[BANG] / w), min(2.0, kinds[MARK] / w), kinds[DIGIT] / n, 1 - distinct / w,
                  1.0 if w >= 8 and distinct * 3 < w else 0.0, min(3.0, letters / w / 8), 1.0 if line in seen else 0.0, 0)
        seen.add(line)
    return out, np.fromiter(map(len, lines), np.int64, len(lines))


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Own, previous and next features, end marks and a constant."""
    zero = np.zeros((1, x.shape[1]), x.dtype)
    ends = np.zeros((len(x), 3), x.dtype)
    ends[0, 0] = ends[-1, 1] = 1
    ends[:, 2] = 1
    return np.hstack((x, np.vstack((zero, x[:-1])), np.vstack((x[1:], zero)), ends))


@dataclass
class Field:
    """Weights of label 1 (good) against 0, and the 2 x 2 transitions."""
    node: np.ndarray
    edge: np.ndarray
    logistic: tuple[float, float] = (1.0, 0.0)

    def documents(self, texts) -> np.ndarray:
        """Length-weighted mean probability of a good line."""
        feats = [line_features(t) for t in texts]
        if not feats:
            return np.zeros(0)
        size = np.array([len(n) for _, n in feats])
        x = np.vstack([with_neighbours(f) for f, _ in feats])
        good = marginals(x @ self.node, size, self.edge)[0]
        weight = np.concatenate([n for _, n in feats]) + 1.0
        at = np.cumsum(size) - size
        return np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at)

    def scores(self, texts) -> np.ndarray:
        """Rounded, so that a text's place in its batch does not show."""
        a, b = self.logistic
        return np.round(1 / (1 + np.exp(-np.clip(a * stretch(self.documents(texts)) + b, -30, 30))), 9)


def stretch(q: np.ndarray) -> np.ndarray:
    """Opens up the scale near 1, where a few bad lines show."""
    return -np.log(1.005 - q)


def marginals(score: np.ndarray, size: np.ndarray, edge: np.ndarray):
    """(P(good) of every line, expected edge counts (2, 2) in total, log
    partition in total).  ``score`` runs over the lines of all sequences, of
    the given sizes; all sequences advance together, longest first."""
    n = len(score)
    start = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), side="left")  # sequences longer than t
    node = np.stack((np.zeros(n), score), 1)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    for t in range(steps):
        i = start[:active[t]] + t
        if t == 0:
            alpha[i] = node[i]
        else:
            a = alpha[i - 1]
            alpha[i] = node[i] + np.logaddexp(a[:, :1] + edge[0], a[:, 1:] + edge[1])
    last = start + size - 1
    z = np.logaddexp(alpha[last, 0], alpha[last, 1])
    pairs = np.zeros((2, 2))
    log_z = np.empty(n)
    log_z[np.concatenate([np.arange(s, s + m) for s, m in zip(start, size, strict=True)])] = np.repeat(z, size)
    for t in range(steps - 2, -1, -1):
        i = start[:active[t + 1]] + t
        b = node[i + 1] + beta[i + 1]
        beta[i] = np.stack([np.logaddexp(edge[u, 0] + b[:, 0], edge[u, 1] + b[:, 1]) for u in (0, 1)], 1)
        pairs += np.exp(alpha[i][:, :, None] + edge + b[:, None, :] - log_z[i][:, None, None]).sum(0)
    return np.exp(alpha[:, 1] + beta[:, 1] - log_z), pairs, z.sum()


def train(x: np.ndarray, size: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = STEPS) -> Field:
    """Maximum conditional likelihood of line labels ``y`` by Adam."""
    within = np.ones(len(y), bool)
    within[np.cumsum(size) - size] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][within[1:]], y[1:][within[1:]]), 1)
    w = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        p, pairs, _ = marginals(x @ w[:-4], size, w[-4:].reshape(2, 2))
        g = np.concatenate((x.T @ (y - p), (seen - pairs).ravel())) - ridge * w
        g /= len(size)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.15 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return Field(w[:-4], w[-4:].reshape(2, 2))


def learn(feats: list[np.ndarray], good: np.ndarray, rounds: int = ROUNDS) -> Field:
    """The field from documents' line features and document labels."""
    size = np.array([len(f) for f in feats])
    x = np.vstack([with_neighbours(f) for f in feats]).astype(float)
    doc = np.repeat(np.arange(len(feats)), size)
    y = good[doc].astype(int)
    for _ in range(rounds):
        field = train(x, size, y)
        p = marginals(x @ field.node, size, field.edge)[0]
        y = np.where(good[doc] == 1, 1, p >= 0.5).astype(int)
        worst = np.full(len(feats), np.inf)
        np.minimum.at(worst, doc, p)
        y[(good[doc] == 0) & (p == worst[doc])] = 0
    return field


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Field | None:
    """Field of ``label`` for the texts of ``docs``."""
    prepare(docs.sparkSession)
    picked = sample(labels, label, per_class, balanced=False)
    picked = picked.withColumn("cal", F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(CALIBRATION)) == 0)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "y", "cal", "text")

    def features(batches):
        for b in batches:
            f = [line_features(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "cal": b["cal"],
                                "x": [a.ravel().tolist() for a, _ in f], "n": [n.tolist() for _, n in f]})

    t = (rows.mapInPandas(features, "doc_id long, y int, cal boolean, x array<float>, n array<long>")
         .orderBy("doc_id").toPandas())
    if t["y"].nunique() < 2:
        return None
    feats = [np.array(x, np.float32).reshape(-1, FEATURES) for x in t["x"]]
    y, cal = t["y"].to_numpy(), t["cal"].to_numpy(bool)
    if len(set(y[~cal])) < 2 or len(set(y[cal])) < 2:
        cal = np.zeros(len(y), bool)
    field = learn([f for f, c in zip(feats, cal, strict=True) if not c], y[~cal])
    use = cal if cal.any() else ~cal
    q = []
    for f, n, u in zip(feats, t["n"], use, strict=True):
        if u:
            p = marginals(with_neighbours(f) @ field.node, np.array([len(f)]), field.edge)[0]
            q.append(np.average(p, weights=np.array(n) + 1.0))
    w = fit_logistic(stretch(np.array(q))[:, None], y[use])
    all_rows = (labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
                .agg(F.sum(label).alias("t"), F.count(F.lit(1)).alias("n")).first())
    ones = y.sum()
    shift = (np.log((all_rows["t"] + 1) / (all_rows["n"] - all_rows["t"] + 1))
             - np.log((ones + 1) / (len(y) - ones + 1)))
    field.logistic = (float(w[0]), float(w[1] + shift))
    return field


def score(docs: DataFrame, field: Field | None, text: str = "text", out: str = "score",
          keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with column ``out``; one named alike
    gives way to it."""
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower())
    if field is None:
        return docs.select(*keep, F.lit(1.0).alias(out))
    box = prepare(docs.sparkSession).sparkContext.broadcast(field)
    inner = docs.select(*keep, F.col(text).alias(spare(keep, "__text")))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])

    def run(batches):
        import pyarrow as pa
        for b in batches:
            s = box.value.scores(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(keep)], pa.array(s, pa.float64())], names=[*keep, out])

    return inner.mapInArrow(run, schema)
