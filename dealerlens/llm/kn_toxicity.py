"""Toxicity by class-conditional Kneser-Ney models.

Two models of how words are spelt, toxic and ordinary: the probability of each
character after up to ``ORDER - 1`` earlier ones of its word.  Insults are
inflected and compounded, so an expression is often new as a word though its
stem is not; spelling models see the stem.  Counts are discounted (Kneser-Ney:
raw counts at the longest history, continuation counts below) and back off
down to one shared model, a Kneser-Ney model of the same longest order counted
over every document, so that what neither class has shown costs both the same.
A word's evidence is what its log-likelihood ratio exceeds ``FLOOR`` by: one
insult must not drown in the many words that differ a little by chance.  A
document's score is the logistic of the logarithm of its words' evidence over
the square root of their number (the noise of a sum grows with that root).

The class models learn from a bounded sample of labelled rows (at most
``per_class`` documents of each class): three quarters give the counts, one
quarter sets the logistic, which is then moved to the classes' shares among all
learning rows and to ``MISS_COST``.  Their tables are bounded by the sample and are
broadcast.  The shared model has a row for every n-gram of the corpus: Spark
counts them order by order into stored tables, and each longest n-gram's log
ratio is one row of a stored table.  The ``KNOWN`` most frequent rows are
broadcast for scoring; words with other n-grams are joined to the table, each
distinct word once.
Ratios are whole multiples of 1 / ``UNIT``, so sums don't depend on the order.

Defined results: a null or empty text scores what no evidence scores; without
labelled rows of both classes every score is 0; repeated rows score alike;
other columns pass through, but one named like the score gives way to it.  Texts with n-grams that the corpus of
``fit`` lacks get their ratios from the shorter ones.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let_go, prepare, stored
from .labels import fit_logistic, held_out, sample
from .words import TERM, scramble

PER_CLASS = 2000
THRESHOLD = 0.5
#: Log ratio that a word's must exceed to count.
FLOOR = 2
#: A score of a half is where a missed document costs so many times a clean
#: one that is rejected, times its odds.
MISS_COST = 3
#: Documents of the sample per calibration document.
CALIBRATION = 4
#: Longest and shortest n-grams of the class models; the shared one has all.
ORDER, LOWEST = 6, 3
#: Log ratios are whole multiples of 1 / UNIT.
UNIT = 1 << 32
#: Rows of the n-grams' ratios that scoring broadcasts; others are joined.
KNOWN = 250_000
#: Words whose ratio a worker remembers before it starts afresh.
CACHE_WORDS = 500_000
#: Words that the driver and that a worker splits into n-grams at a time.
WORDS_AT_ONCE, WORKER_WORDS = 50_000, 25_000
BEGIN, END = "\x02" * (ORDER - 1), "\x03"


def places(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words with their marks, the place of each character
    (end mark included) among them, and the word number of each."""
    text = "".join(BEGIN + w + END for w in words)
    cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    return cp, np.arange(len(owner), dtype=np.int32) + (ORDER - 1) * (owner + 1), owner


def _gram_hashes(cp: np.ndarray, at: np.ndarray, orders) -> dict[int, np.ndarray]:
    cp = cp.astype(np.uint64)
    out, h = {}, np.zeros(len(at), np.uint64)
    for k in range(1, ORDER + 1):  # from the last character backwards
        h = scramble(h + cp[at - k + 1] + np.uint64(k << 40))
        if k in orders:
            out[k] = h
    return out


def _context_hashes(cp: np.ndarray, at: np.ndarray, orders) -> dict[int, np.ndarray]:
    cp = cp.astype(np.uint64)
    out, h = {}, np.full(len(at), 7, np.uint64)
    for k in range(2, ORDER + 1):
        h = scramble(h + cp[at - k + 1] + np.uint64(k << 40))
        if k in orders:
            out[k] = h
    return out


def grams(words: list[str], orders=range(LOWEST, ORDER + 1)) -> tuple[dict, np.ndarray]:
    """For each order the hashes of the n-grams that end at each character
    (end mark included) of each word, and the word number of each."""
    cp, at, owner = places(words)
    return _gram_hashes(cp, at, orders), owner


def contexts(words: list[str], orders=range(LOWEST, ORDER + 1)) -> dict[int, np.ndarray]:
    """For each order the hashes of the histories of the same n-grams."""
    cp, at, _ = places(words)
    return _context_hashes(cp, at, orders)


def _spelt(cp: np.ndarray, at: np.ndarray) -> list[str]:
    """The longest n-grams that end at the places ``at``."""
    if not len(at):
        return []
    return np.ascontiguousarray(cp[at[:, None] + np.arange(1 - ORDER, 1)]).view(f"<U{ORDER}").ravel().tolist()


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class Order:
    """One order of both class models (0 ordinary, 1 toxic)."""
    grams: np.ndarray       # sorted hashes
    mass: np.ndarray        # (2, grams): discounted probability
    histories: np.ndarray   # sorted hashes
    backoff: np.ndarray     # (2, histories): weight left for the lower order


def gram_ratios(orders: dict[int, Order], spelt: list[str], low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of longest n-grams and their toxic minus ordinary log
    probabilities in UNITs, ``low`` being the shared model's probabilities."""
    cp = np.frombuffer("".join(spelt).encode("utf-32-le"), "<u4")
    at = np.arange(len(spelt)) * ORDER + ORDER - 1
    g, h = (f(cp, at, range(LOWEST, ORDER + 1)) for f in (_gram_hashes, _context_hashes))
    p = [low, low]
    for k in range(LOWEST, ORDER + 1):
        o = orders[k]
        gi, g_known = _find(o.grams, g[k])
        hi, h_known = _find(o.histories, h[k])
        p = [np.where(g_known, o.mass[c][gi], 0.0) + np.where(h_known, o.backoff[c][hi], 1.0) * p[c]
             for c in (0, 1)]
    return g[ORDER], np.rint((np.log(p[1]) - np.log(p[0])) * UNIT).astype(np.int64)


@dataclass
class Shared:
    """The model over all documents, every order a stored table."""
    grams: dict[int, DataFrame]      # (g, n, p): n-gram, occurrences, probability
    histories: dict[int, DataFrame]  # (h, back): history, weight left for the lower order
    unknown: float                   # probability of a character that no document has

    def probabilities(self, spelt: DataFrame) -> DataFrame:
        """(g, p) of the distinct longest n-grams ``spelt(g)``, in the corpus
        or not: an n-gram that it lacks has what its history leaves."""
        need = {ORDER: spelt.select("g").distinct()}
        for k in range(ORDER - 1, 0, -1):
            need[k] = need[k + 1].select(F.substring("g", 2, k).alias("g")).distinct()
        p = (need[1].join(self.grams[1].select("g", "p"), "g", "left")
             .select("g", F.coalesce("p", F.lit(self.unknown)).alias("p")))
        for k in range(2, ORDER + 1):
            low = p.select(F.col("g").alias("s"), F.col("p").alias("low"))
            p = (need[k].select("g", F.substring("g", 1, k - 1).alias("h"), F.substring("g", 2, k - 1).alias("s"))
                 .join(self.grams[k].select("g", "p"), "g", "left").join(self.histories[k], "h", "left")
                 .join(low, "s").select("g", F.coalesce("p", F.coalesce("back", F.lit(1.0)) * F.col("low")).alias("p")))
        return p


@dataclass
class Model:
    orders: dict[int, Order]
    shared: Shared
    ratios: DataFrame | None = None  # (g, n, key, r) of the corpus's longest n-grams
    known: tuple[np.ndarray, np.ndarray] | None = None  # sorted keys of the frequent ones, and their r
    logistic: tuple[float, float] = (0.0, 0.0)

    def word_ratios(self, words: list[str]) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each of a few words."""
        cp, at, owner = places(words)
        spelt = _spelt(cp, at)
        frame = self.shared.grams[ORDER].sparkSession.createDataFrame([(g,) for g in set(spelt)], "g string")
        p = {r["g"]: r["p"] for r in self.shared.probabilities(frame).collect()}
        r = gram_ratios(self.orders, spelt, np.array([p[g] for g in spelt]))[1]
        return np.bincount(owner, weights=r / UNIT, minlength=len(words))


def _cut(count: np.ndarray) -> np.ndarray:
    """What each of one class's counts leaves to the lower orders."""
    d = discounts([np.count_nonzero(count == i) for i in (1, 2, 3, 4)])
    return np.array([0.0, *d])[np.minimum(count, 3).astype(int)]


def _longest(words: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points (n-grams, ORDER) of the distinct longest n-grams of the
    words and their occurrences (2, n-grams) by class."""
    hashes, spelt, seen = [np.empty(0, np.uint64)], [np.empty((0, ORDER), np.uint32)], [np.empty((2, 0))]

    def distinct(h, occurrences):
        _, first, inv = np.unique(h, return_index=True, return_inverse=True)
        return first, np.stack([np.bincount(inv, weights=o, minlength=len(first)) for o in occurrences])

    for k in range(0, len(words), WORDS_AT_ONCE):
        cp, at, owner = places(words[k:k + WORDS_AT_ONCE])
        h = _gram_hashes(cp, at, (ORDER,))[ORDER]
        first, occurrences = distinct(h, n[:, k:k + WORDS_AT_ONCE][:, owner])
        hashes.append(h[first])
        spelt.append(cp[at[first][:, None] + np.arange(1 - ORDER, 1)])
        seen.append(occurrences)
    first, occurrences = distinct(np.concatenate(hashes), np.concatenate(seen, axis=1))
    return np.concatenate(spelt)[first], occurrences


def _class_orders(words: list[str], n: np.ndarray) -> dict[int, Order]:
    """The class models' tables from the sample's words and their counts
    (2, words) by class, each order's n-grams from those of the next longer."""
    cp, occurrences = _longest(words, n)
    count, out = occurrences, {}
    for k in range(ORDER, LOWEST - 1, -1):
        last = np.arange(1, len(cp) + 1) * ORDER - 1
        table, first, inv = np.unique(_gram_hashes(cp.ravel(), last, [k])[k], return_index=True, return_inverse=True)
        kinds, occurrences = (np.stack([np.bincount(inv, weights=v, minlength=len(table)) for v in values])
                              for values in (count > 0, occurrences))
        cp = cp[first]
        # distinct left extensions; an n-gram that holds a begin mark has one left neighbour only
        whole = (cp[:, ORDER - k] == ord(BEGIN[0])) | (k == ORDER)
        count = np.where(whole, occurrences, kinds)
        hist, hist_inv = np.unique(_context_hashes(cp.ravel(), last[:len(cp)], [k])[k], return_inverse=True)
        cut = np.stack([_cut(c) for c in count])
        total = np.stack([np.bincount(hist_inv, weights=count[c], minlength=len(hist)) for c in (0, 1)])
        left = np.stack([np.bincount(hist_inv, weights=cut[c], minlength=len(hist)) for c in (0, 1)])
        mass = (count - cut) / np.maximum(total[:, hist_inv], 1)
        back = np.where(total > 0, left / np.maximum(total, 1), 1.0)
        out[k] = Order(table, mass.astype(np.float32), hist, back.astype(np.float32))
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model | None:
    """Model of ``label`` for the texts of ``docs``."""
    spark = prepare(docs.sparkSession)
    picked = sample(labels, label, per_class, balanced=False)
    picked = picked.withColumn("_cal", F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(CALIBRATION)) == 0)
    learn = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def count(batches):
        import pyarrow as pa
        let_go()
        for b in batches:
            rows = list(zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True))
            for y in (0, 1):
                c = Counter(w for t, u in rows if u == y and t for w in TERM.findall(t.lower()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), pa.string()), pa.array([y] * len(c), pa.int32()),
                     pa.array(list(c.values()), pa.int64())], names=["w", "y", "n"])

    t = (learn.where(~F.col("_cal")).select("text", "y").mapInArrow(count, "w string, y int, n long")
         .groupBy("w").agg(*[F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)])
         .orderBy("w").toPandas())
    if not (len(t) and t["n0"].sum() and t["n1"].sum()):
        return None
    model = Model(_class_orders(t["w"].tolist(), t[["n0", "n1"]].to_numpy(float).T), shared_model(docs))
    whole = model.shared.grams[ORDER]
    model.ratios = stored(_with_ratios(whole, model.orders), "toxicity-ratios")
    model.known = _frequent(model.ratios, KNOWN)
    cal = learn.where("_cal").select("text", F.col("y").cast("double"))
    c = evidence(cal, model, "text", "x", ("y",)).toPandas()
    if c["y"].nunique() < 2:
        model.logistic = (2.0, -2.0)
    else:
        w = fit_logistic(c[["x"]].to_numpy(), c["y"].to_numpy())
        toxic = c["y"].sum()
        here = np.log(toxic / (len(c) - toxic))
        model.logistic = (float(w[0]), float(w[1] - here + _prior(labels, label) + np.log(MISS_COST)))
    return model


def _prior(labels: DataFrame, label: str) -> float:
    """Log odds of the label over all learning rows, which the sample's may
    differ from."""
    r = (labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
         .agg(F.sum(label).alias("t"), F.count(F.lit(1)).alias("n")).first())
    return float(np.log((r["t"] + 1) / (r["n"] - r["t"] + 1)))


def discounts(seen) -> list[float]:
    """Modified Kneser-Ney discounts of counts of one, two and more, from how
    many n-grams have counts of one to four; each below its count."""
    y = seen[0] / (seen[0] + 2 * seen[1]) if seen[0] else 0.0
    return [min(max(i - (i + 1) * y * seen[i] / seen[i - 1], 0.05), i - 0.05) if seen[i - 1] and seen[i] else i / 2
            for i in (1, 2, 3)]


def count_grams(docs: DataFrame) -> DataFrame:
    """(g, n): the longest n-grams of the words of ``docs``, by occurrence."""

    def count(batches):
        import pyarrow as pa
        let_go()
        words: Counter = Counter()

        def flush():
            names = sorted(words)  # neighbours share n-grams, so few come in two parts
            for k in range(0, len(names), WORKER_WORDS):
                part = names[k:k + WORKER_WORDS]
                n = np.fromiter(map(words.__getitem__, part), np.int64, len(part))
                cp, at, owner = places(part)
                _, first, inv = np.unique(_gram_hashes(cp, at, (ORDER,))[ORDER], return_index=True, return_inverse=True)
                total = np.bincount(inv, weights=n[owner], minlength=len(first)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(_spelt(cp, at[first]), pa.string()), pa.array(total)],
                                                 names=["g", "n"])
            words.clear()

        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    words.update(TERM.findall(t.lower()))
            if len(words) > CACHE_WORDS:
                yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))


def shared_model(docs: DataFrame) -> Shared:
    """Kneser-Ney model of all words of ``docs``."""
    counts = {ORDER: stored(count_grams(docs).withColumn("c", F.col("n")), "toxicity-grams")}
    for k in range(ORDER - 1, 0, -1):
        # distinct left extensions; an n-gram that holds a begin mark has one left neighbour only
        counts[k] = stored(counts[k + 1].select(F.substring("g", 2, k).alias("g"), "n").groupBy("g")
                           .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
                           .select("g", "n", F.when(F.substring("g", 1, 1) == BEGIN[0], F.col("n"))
                                   .otherwise(F.col("k")).alias("c")), f"toxicity-grams-{k}")
    out_grams, out_histories, unknown = {}, {}, 0.0
    low = None
    for k in range(1, ORDER + 1):
        seen = counts[k].agg(*[F.count(F.when(F.col("c") == i, 1)) for i in (1, 2, 3, 4)]).first()
        d = discounts(list(seen))
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = counts[k].select("g", "n", "c", cut.alias("cut"), F.substring("g", 1, k - 1).alias("h"))
        per = rows.groupBy("h").agg(F.sum("c").alias("total"), (F.sum("cut") / F.sum("c")).alias("back"))
        per = stored(per, f"toxicity-histories-{k}")
        out_histories[k] = per.select("h", "back")
        if k == 1:
            chars = counts[1].count()
            first = per.first()
            unknown = first["back"] / (chars + 1) if first else 1.0
            p = rows.select("g", "n", ((F.col("c") - F.col("cut")) / (first["total"] if first else 1) + unknown).alias("p"))
        else:
            p = (rows.withColumn("s", F.substring("g", 2, k - 1)).join(per, "h").join(low, "s")
                 .select("g", "n", ((F.col("c") - F.col("cut")) / F.col("total") + F.col("back") * F.col("low")).alias("p")))
        out_grams[k] = stored(p, f"toxicity-shared-{k}")
        low = out_grams[k].select(F.col("g").alias("s"), F.col("p").alias("low"))
    return Shared(out_grams, out_histories, unknown)


def _with_ratios(probabilities: DataFrame, orders: dict[int, Order]) -> DataFrame:
    """(g, n, key, r) of ``probabilities(g, n, p)``."""
    box = probabilities.sparkSession.sparkContext.broadcast(orders)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            if b.num_rows:
                key, r = gram_ratios(box.value, b.column("g").to_pylist(), b.column("p").to_numpy())
                yield pa.RecordBatch.from_arrays([b.column("g"), b.column("n"), pa.array(key.view(np.int64)), pa.array(r)],
                                                 names=["g", "n", "key", "r"])

    return probabilities.select("g", "n", "p").mapInArrow(run, "g string, n long, key long, r long")


def _frequent(table: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, ratios) of the rows with the largest ``n``, at most
    ``most``: all from some power of two on."""
    per = {r["e"]: r["m"] for r in table.groupBy(F.floor(F.log2("n")).cast("int").alias("e"))
           .agg(F.count(F.lit(1)).alias("m")).collect()}
    least, have = 64, 0
    for e in sorted(per, reverse=True):
        have += per[e]
        if have > most:
            break
        least = e
    t = table.where(F.floor(F.log2("n")) >= least).select("key", "r").toPandas()
    key, r = t["key"].to_numpy(np.int64).view(np.uint64), t["r"].to_numpy(np.int64)
    order = np.argsort(key)
    return key[order], r[order]


def _known_part(words: list[str], known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Sum of the known n-grams' ratios of each word, and the other n-grams:
    their word numbers and themselves."""
    cp, at, owner = places(words)
    i, found = _find(known[0], _gram_hashes(cp, at, (ORDER,))[ORDER])
    part = np.zeros(len(words), np.int64)
    if len(known[0]):
        np.add.at(part, owner[found], known[1][i[found]])
    lost = np.flatnonzero(~found)
    return part, owner[lost], _spelt(cp, at[lost])


def _weighed(known: tuple[np.ndarray, np.ndarray]):
    """Function of a batch's texts to (evidence of the words whose n-grams are
    all known, number of words, how often each other word) of each."""
    weight: dict[str, int | None] = {}

    def run(texts):
        if len(weight) > CACHE_WORDS:
            weight.clear()
        found = [TERM.findall(t.lower()) if t else [] for t in texts]
        new = sorted({w for ws in found for w in ws if w not in weight})
        for k in range(0, len(new), 20_000):
            words = new[k:k + 20_000]
            part, lost, _ = _known_part(words, known)
            weight.update(zip(words, np.maximum(part - FLOOR * UNIT, 0).tolist(), strict=True))
            weight.update((words[j], None) for j in np.unique(lost).tolist())
        sums, rest = [], []
        for ws in found:
            of_words = list(map(weight.__getitem__, ws))
            sums.append(sum(filter(None, of_words)))
            rest.append(list(Counter(w for w, e in zip(ws, of_words, strict=True) if e is None).items()))
        return sums, [len(ws) for ws in found], rest

    return run


def _resolved(words: DataFrame, model: Model, box) -> DataFrame:
    """(w, e): those of the distinct ``words(w)`` that have evidence."""

    def run(batches):
        import pyarrow as pa
        for b in batches:
            names = b.column("w").to_pylist()
            part, lost, spelt = _known_part(names, box.value) if names else (np.empty(0, np.int64), np.empty(0, int), [])
            ends = np.cumsum(np.bincount(lost, minlength=len(names)))
            grams = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(spelt, pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("w"), pa.array(part), grams], names=["w", "part", "gs"])

    rows = stored(words.mapInArrow(run, "w string, part long, gs array<string>"), "toxicity-words")
    spelt = rows.select("w", "part", F.explode("gs").alias("g"))
    table = model.ratios.select("g", "r")
    strange = stored(spelt.select("g").distinct().join(table, "g", "left_anti"), "toxicity-strange")
    if not strange.isEmpty():
        p = model.shared.probabilities(strange).withColumn("n", F.lit(0).cast("long"))
        table = table.unionByName(_with_ratios(p, model.orders).select("g", "r"))
    whole = spelt.join(table, "g").groupBy("w").agg((F.first("part") + F.sum("r") - F.lit(FLOOR * UNIT)).alias("e"))
    return whole.where("e > 0")


def evidence(docs: DataFrame, model: Model, text: str, out: str, keep: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns of ``docs`` and the evidence in each text, on a
    logarithmic scale from 0, as column ``out``."""
    spark = prepare(docs.sparkSession)
    box = spark.sparkContext.broadcast(model.known)
    inner = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)], F.col(text).alias("text"))
    columns = [f"c{k}" for k in range(len(keep))]
    schema = T.StructType([*[inner.schema[c] for c in columns], T.StructField("part", T.LongType()),
                           T.StructField("words", T.LongType()),
                           T.StructField("rest", T.MapType(T.StringType(), T.LongType()))])

    def run(batches):
        import pyarrow as pa
        let_go()
        weighed = _weighed(box.value)
        for b in batches:
            part, words, rest = weighed(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in columns], pa.array(part, pa.int64()), pa.array(words, pa.int64()),
                 pa.array(rest, pa.map_(pa.string(), pa.int64()))], names=[*columns, "part", "words", "rest"])

    rows = stored(inner.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "toxicity-rows")
    rest = rows.where(F.size("rest") > 0).select("row", F.explode("rest").alias("w", "n"))
    whole = F.col("part")
    if not rest.isEmpty():
        weights = stored(_resolved(rest.select("w").distinct(), model, box), "toxicity-weights")
        more = rest.join(weights, "w").groupBy("row").agg(F.sum(F.col("n") * F.col("e")).alias("more"))
        rows = rows.drop("rest").join(more, "row", "left")
        whole = whole + F.coalesce("more", F.lit(0))
    x = F.log1p(whole / F.lit(float(UNIT)) / F.sqrt(F.greatest("words", F.lit(1))))
    return rows.select(*[F.col(c).alias(k) for c, k in zip(columns, keep, strict=True)], x.alias(out))


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score",
          keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with column ``out``."""
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower())
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias(out))
    a, b = model.logistic
    z = F.least(F.greatest(F.lit(a) * F.col(out) + F.lit(b), F.lit(-30.0)), F.lit(30.0))
    return evidence(docs, model, text, out, keep).withColumn(out, 1 / (1 + F.exp(-z)))
