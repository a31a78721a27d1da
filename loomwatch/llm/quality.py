"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are training documents labelled 1; the unlabelled set is a sample of all training documents, whatever
their label. Labels 0 are not used at all. The class prior is estimated from positives and unlabelled documents alone: a
logistic model that tells one set from the other is fitted on one half of each, and on the other half the prior is the least
ratio of unlabelled to positive documents above a score (best bin, with a confidence margin). A small network f is then
fitted to minimise  prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])  with l the log loss (full-batch Adam, fixed seed); where the
part in brackets falls below zero, the step goes the other way. The log loss makes sigmoid(f) the probability of label 1, so that no
calibration on negatives is needed.

What is learnt comes from a sample of at most ``max_positive`` positive and ``max_unlabelled`` unlabelled documents, taken by
hash; the two parameters bound what reaches the driver. Every document is scored, in whole. Inputs are numbers of the text alone:
lengths, classes of characters, each mark, repetition. (Hashed counts of trigrams and words beside them were tried and ranked
held-out documents worse.)

Defined results: null counts as empty; an empty text has all features zero and is scored like any other; repeated rows get
equal scores; without positive labels every score is 0.5; a very long text is counted in
parts of ``PART`` bytes that end at white space, so that memory follows the part and its distinct words (and its longest word); an empty table
gives no rows; rows are judged by their own text, whatever their ids; extra columns are ignored (``score_documents``) or passed through (``keep_good``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from loomwatch.llm.common import text_slices
from loomwatch.llm.words import Words, text_bytes

_CLASS = np.zeros(256, np.int64)  # 0 other
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 4
_CLASS[[ord(c) for c in ".,;:?!"]] = 5
_CLASS[[ord(c) for c in "*$%&#|<>{}[]\\^~=+_@/`"]] = 6
_CLASS[[ord(c) for c in "-'\"()"]] = 7
_CLASS[128:] = 8
_MARKS = [10, *(c for c in range(33, 127) if not chr(c).isalnum())]  # line feed and every ASCII mark
FEATURES = 2 + 8 + len(_MARKS) + 12
AGAIN = 12 + len(_MARKS)  # where the sums of a text count words like the one before
PART = 1 << 18  # bytes of text whose numbers are held at a time


def sums_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Words, np.ndarray]:
    """What adds up over the parts of a text, a row for each text (bytes, classes, marks, words, sums over words), with its words and their hashes."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    text = np.repeat(np.arange(n), size)
    kinds = np.bincount(text * 9 + _CLASS[data], minlength=9 * n).reshape(n, 9)
    number = np.full(256, -1)
    number[_MARKS] = np.arange(len(_MARKS))
    which = number[data]
    marked = which >= 0
    marks = np.bincount(text[marked] * len(_MARKS) + which[marked], minlength=n * len(_MARKS)).reshape(n, len(_MARKS))
    w = Words(data, offsets)
    h = w.hashes()
    length = (w.ends - w.starts).astype(float)
    first, last = (data[w.starts], data[w.ends - 1]) if len(h) else (data[:0], data[:0])
    second = data[np.minimum(w.starts + 1, len(data) - 1)] if len(h) else data[:0]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    of_words = [
        length, length**2, again, _CLASS[last] == 5, _CLASS[last] == 6, length == 1, np.isin(_CLASS[first], (2, 8)),
        (_CLASS[second] == 2) & (length > 1), length > 20,
    ]
    added = [np.bincount(w.doc, x, n) for x in of_words]
    return np.column_stack([size, kinds[:, 1:], marks, np.diff(w.bounds), *added]).astype(float), w, h


def pairs_of(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A hash of each word and the one before it (0: none)."""
    return h * np.uint64(31) + before


def ratios(sums: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Features from a text's sums and its numbers of distinct words and pairs of words."""
    size, shares, count, by_word = sums[:, 0], sums[:, 1 : 9 + len(_MARKS)], sums[:, 9 + len(_MARKS)], sums[:, 10 + len(_MARKS) :]
    words = np.maximum(count, 1)
    mean, square, again, *rest = (by_word / words[:, None]).T
    cols = [
        np.log1p(size) / 10, np.log1p(count) / 10, *(shares / np.maximum(size, 1)[:, None]).T,
        mean / 10, np.sqrt(np.maximum(square - mean**2, 0)) / 10, again, *(distinct / words[:, None]).T, *rest, (size == 0).astype(float),
    ]
    return np.stack(cols, axis=1)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers for each text, from vector operations over the bytes of ``PART`` bytes of texts at a time."""
    out, i, n = [np.zeros((0, FEATURES))], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PART, "right")) - 1)
        part, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        out.append(_of_long(part) if len(part) > PART else _of_short(part, cuts))
        i = j
    return np.concatenate(out)


def _of_short(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums, w, h = sums_of(data, offsets)
    before = np.zeros(len(h), np.uint64)
    before[1:] = np.where(w.doc[1:] == w.doc[:-1], h[:-1], np.uint64(0))

    def distinct(key: np.ndarray) -> np.ndarray:
        order = np.lexsort((key, w.doc))
        d, k = w.doc[order], key[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
        return np.bincount(d[new], minlength=len(sums))

    return ratios(sums, np.column_stack([distinct(h), distinct(pairs_of(h, before))]))


class Distinct:
    """Distinct keys of many parts; new ones are merged when they are as many as those known, so that each is sorted a few times only."""

    def __init__(self):
        self.known, self.new = np.zeros(0, np.uint64), []

    def add(self, keys: np.ndarray) -> None:
        self.new.append(np.unique(keys))
        if sum(map(len, self.new)) > len(self.known):
            self.count()

    def count(self) -> int:
        self.known, self.new = np.unique(np.concatenate([self.known, *self.new])), []
        return len(self.known)


def _of_long(data: np.ndarray) -> np.ndarray:
    """The row of one text, cut behind white space into parts whose sums are added up; what lies across a seam is carried over."""
    total, last = 0.0, np.uint64(0)
    words, pairs = Distinct(), Distinct()
    s = 0
    while s < len(data):
        e = s + PART
        while e < len(data) and _CLASS[data[e - 1]] != 4:  # to the end of a word
            space = np.flatnonzero(_CLASS[data[e : e + PART]] == 4)
            e += int(space[0]) + 1 if len(space) else PART
        e = min(e, len(data))
        sums, _, h = sums_of(data[s:e], np.array([0, e - s]))
        if len(h):
            sums[0, AGAIN] += h[0] == last  # no word's hash is 0 but by accident
            words.add(h)
            pairs.add(pairs_of(h, np.append(last, h[:-1])))
            last = h[-1]
        total = total + sums
        s = e
    return ratios(total, np.array([[words.count(), pairs.count()]]))


def feature_rows(docs: DataFrame) -> DataFrame:
    """Every column but text, with the text's features as x (bytes of float32)."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1 << 20):
            x = features(*text_bytes(b.column("text"))).astype("<f4")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array([r.tobytes() for r in x], pa.binary())], [*rest, "x"])

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in rest]
    return docs.mapInArrow(run, ", ".join([*kinds, "x binary"]))


class Model:
    """Standardised inputs and one hidden layer; the score is the sigmoid of the output."""

    def __init__(self, x: np.ndarray, hidden: int, rng: np.random.Generator):
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-6
        d = x.shape[1]
        self.p = [rng.standard_normal((d, hidden)) / np.sqrt(d), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -6, 6)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3][0]

    def gradients(self, z: np.ndarray, h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        back = g[:, None] * self.p[2] * (1 - h * h)
        return [z.T @ back, back.sum(axis=0), h.T @ g, np.array([g.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(self.inputs(x))[1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _log_loss(x: np.ndarray) -> np.ndarray:
    """Of an output x where the label is positive."""
    return np.logaddexp(0, -x)


def pu_risk(m: Model, zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float, list[np.ndarray]]:
    """(positive part, negative part, gradients to step along). The risk is the first and the second if that is not below
    zero; else the step undoes the negative part."""
    (hp, fp), (hu, fu) = m.forward(zp), m.forward(zu)
    positive = prior * _log_loss(fp).mean()
    negative = _log_loss(-fu).mean() - prior * _log_loss(-fp).mean()
    sp, su = _sigmoid(fp), _sigmoid(fu)
    gp, gu = -prior * sp / len(sp), su / len(su)  # of the negative part
    if negative >= 0:
        gp = gp - prior * (1 - sp) / len(sp)
    else:
        gp, gu = -gp, -gu
    return positive, negative, [a + b for a, b in zip(m.gradients(zp, hp, gp), m.gradients(zu, hu, gu))]


def fit_pu(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, steps: int = 300, rate: float = 0.02, decay: float = 3e-4, seed: int = 3
) -> Model:
    """The non-negative PU risk, minimised by Adam."""
    m = Model(unlabelled, hidden, np.random.default_rng(seed))
    zp, zu = m.inputs(positive), m.inputs(unlabelled)
    first, second = [np.zeros_like(p) for p in m.p], [np.zeros_like(p) for p in m.p]
    for t in range(1, steps + 1):
        for k, g in enumerate(pu_risk(m, zp, zu, prior)[2]):
            g = g + decay * m.p[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            m.p[k] = m.p[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return m


def told_apart(a: np.ndarray, b: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights (the last for 1) of a logistic model that gives rows of a high, of b low outputs, by Newton steps; both sets weigh alike."""
    x = np.concatenate((a, b))
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    y = np.repeat((1.0, 0.0), (len(a), len(b)))
    weight = np.repeat((0.5 / len(a), 0.5 / len(b)), (len(a), len(b))) * len(x)
    u = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ u)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(u))
        step = np.linalg.solve(hess, x.T @ (weight * (y - p)) - ridge * u)
        u = u + step
        if np.abs(step).max() < 1e-6:
            break
    return u


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """The share of positives among the unlabelled, from these two sets alone. Above any score there are at least prior times as
    many unlabelled as positive documents, and about as many where no negative scores as high: the least ratio, with a margin
    for the size of the sample, is the estimate; the halves change places and the mean is taken."""
    mean, std = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    p, u = (np.clip((x - mean) / std, -6, 6) for x in (positive, unlabelled))
    found = []
    for k in (0, 1):
        if not len(p[k::2]) or not len(u[k::2]) or not len(p[1 - k :: 2]) or not len(u[1 - k :: 2]):
            continue
        w = told_apart(p[k::2], u[k::2])
        sp, su = (np.sort(x[1 - k :: 2] @ w[:-1]) for x in (p, u))
        tail = 1 - np.arange(len(sp)) / len(sp)  # of the positives at or above each of their scores
        above = 1 - np.searchsorted(su, sp) / len(su)
        margin = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(su)) + 1 / np.sqrt(len(sp)))
        at = int(((above + margin) / tail).argmin())
        found.append(above[at] / tail[at])
    return float(min(max(np.mean(found), 0.01), 0.99)) if found else 0.5


def train(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, max_positive: int = 8000, max_unlabelled: int = 8000, seed: int = 3
) -> Model | None:
    """The fitted model, from rows whose crc32(doc_id as text) mod ``folds`` is not ``held``; None without a positive."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).filter(F.coalesce(fold != held, F.lit(False)))
    y = labels.filter("quality = 1").select("doc_id").distinct().filter(F.coalesce(fold != held, F.lit(False)))
    total, known = d.count(), y.count()
    if not total or not known:
        return None

    def share(n: int, most: int, salt: int):
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, most / n) * (1 << 30))

    lab = d.join(y.filter(share(known, max_positive, 1)), "doc_id", "left_semi").withColumn("trusted", F.lit(True))
    unl = d.filter(share(total, max_unlabelled, 2)).withColumn("trusted", F.lit(False))
    rows = feature_rows(lab.unionByName(unl)).select("doc_id", "trusted", "x").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["trusted"], bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), "<f4").reshape(-1, FEATURES).astype(float)
    q = np.array([r["trusted"] for r in rows], bool)
    if not q.any() or q.all():
        return None
    return fit_pu(x[q], x[~q], estimate_prior(x[q], x[~q]), seed=seed)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held: int = 0, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = train(docs, labels, folds, held, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1 << 20):
            x = features(*text_bytes(b.column("text")))
            s = model.score(x) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == held, F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows that the classifier accepts, with all their columns, in one pass."""
    model = train(docs, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1 << 20):
            s = model.score(features(*text_bytes(pc.fill_null(b.column("text"), "")))) if model else np.full(b.num_rows, 0.5)
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
