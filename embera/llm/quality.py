"""Quality classification by co-training of two views.

The text view sees what a text is made of: hashed byte trigrams, how concentrated they
are, kinds of characters, and how often words come again. The metadata view sees the page
around it and none of its words: language, source, and the figures that a crawler keeps of
a page (characters, lines and their lengths, characters a word, bytes a character), each
as steps. Each view is a logistic regression.

Labelled documents, at most LABELLED of them chosen by hash, are held by the driver; a
third of each class is only used to calibrate. All other documents are the unlabelled pool,
and all of it takes part: its features are computed once and kept, and in every round each
view is calibrated, scores the whole pool, and hands the surest of the documents that it
hasn't labelled yet to the other view (the cuts come from counts of their scores, in the
proportions of the labels; a view that isn't sure of any hands none). So each round adds
documents. Then both views take steps on labelled and handed documents, whose
gradients and curvatures are summed over partitions. A document keeps the first label that
a view gives it. Handed documents of a class weigh as much as the labelled ones of it, at
most.

Both views are then calibrated on the labelled documents held apart, and the calibrated
log-odds are combined by a last logistic regression on the same documents. A document is
rejected if its combined probability is under the cut: the largest cut up to 0.5 that
loses at most LOSS of the n good documents held apart, with log-odds lowered by DOUBT / n, so
that little evidence rejects little. Scoring covers every document in one pass without a shuffle.

Defined results: a null text counts as empty, and null metadata is a value of its own; an
unknown number of characters is the text's. Without labelled documents of both classes
there is nothing to learn: every document is kept with score 1. With few labels the penalty
decides; with fewer than three of a class none is held apart, and nothing is rejected. Labels
that contradict each other are averaged, half counts as good. Of a labelled doc_id with
several rows, the one of the smallest feature hash is taken. Extra columns pass through,
whatever their names (those named like the scores are replaced). An empty table gives an
empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, small_batches
from .sketch import word_hashes

LABELLED, ROUNDS, STEPS, FIRST, LOSS = 6000, 3, 3, 40, 0.002
TRIGRAMS = 256
#: Columns of the metadata view: languages, sources, characters, lines, mean, spread and longest of their lengths, characters a word, bytes a character.
PAGE = (16, 48, 40, 24, 32, 20, 24, 40, 12)
#: Trigrams that a text is taken to have besides its own, so that a short one isn't extreme; kinds of bytes.
PRIOR, _KINDS = 64, 6
TEXT, META = TRIGRAMS + 3 + 4 + _KINDS + 2, sum(PAGE)
_FIRST = np.r_[0, np.cumsum(PAGE)[:-1]]
#: Calibrated log-odds, beyond those of the classes, from which on a view is sure; bins of a log-odd in the counts of scores; how strongly weights are held back;
#: by how much the cut's log-odds are lowered if one good document is held apart, by 1 / n of it if n are.
SURE, BINS, PENALTY, DOUBT = 2.0, 50, 2e-3, 30
_SPAN = 30


def text_view(text: str | None) -> np.ndarray:
    """Square roots of trigram shares, how concentrated they are, repetition of words, kinds of bytes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(data, dtype=np.uint8)
    out = np.zeros(TEXT, dtype=np.float32)
    if len(b) >= 3:
        x = b.astype(np.uint32)
        x = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
        share = np.bincount((x * np.uint32(0x27D4EB2F)) >> np.uint32(24), minlength=TRIGRAMS) / (len(b) - 2 + PRIOR)
        out[:TRIGRAMS] = np.sqrt(share) * 4
        out[TRIGRAMS : TRIGRAMS + 3] = share.max() * 5, (share**2).sum() * 10, np.log2(1 / (share**2).sum()) / 4
    out[TRIGRAMS + 3 : TRIGRAMS + 7] = word_repetition(data)
    kinds = np.bincount(_CLASS[b], minlength=_KINDS) / max(1, len(b))
    out[TRIGRAMS + 7 : TRIGRAMS + 7 + _KINDS] = np.sqrt(kinds) * 3
    out[-2:] = kinds[5] / (kinds[0] + 0.01) / 3, float(len(b) < 3)
    return out


def word_repetition(data: bytes) -> tuple[float, float, float, float]:
    """Of a text's words: the share equal to the word before, the root of that share, the share of
    pairs of neighbours that have come before, and the largest share of one word beyond its first place."""
    h = word_hashes(data.lower())
    n = len(h)
    if n < 2:
        return 0.0, 0.0, 0.0, 0.0
    same = float((h[1:] == h[:-1]).mean())
    pairs = len(np.unique(h[1:] * np.uint64(0x9E3779B97F4A7C15) ^ h[:-1]))
    most = int(np.unique(h, return_counts=True)[1].max())
    return same, same**0.5, 1 - pairs / (n - 1), (most - 1) / n


def meta_places(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Which of the metadata view's columns are 1: one for each figure of the page."""
    data = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(data, dtype=np.uint8)
    chars = len(text or "") if n_chars is None else max(0, n_chars)
    lines = np.diff(np.r_[-1, np.flatnonzero(b == 10), len(b)]) - 1
    white = _CLASS[b] == 1
    words = int((~white & np.r_[True, white[:-1]]).sum()) if len(b) else 0
    hashed = [0 if v is None else 1 + zlib.crc32(v.encode("utf-8", "surrogatepass")) % (size - 1) for v, size in zip((lang, source), PAGE, strict=False)]
    steps = np.log2(np.array([chars, len(lines), lines.mean(), lines.std(), lines.max()]) + 1) * (2, 1.5, 2, 1.5, 1.5)
    shares = 3 * chars / max(1, words), 6 * (len(b) / max(1, chars) - 1)
    return _FIRST + np.minimum(np.maximum(np.r_[hashed, steps, shares], 0), np.array(PAGE) - 1).astype(np.int64)


def meta_view(places: np.ndarray) -> np.ndarray:
    """Rows of places as rows of zeros and ones."""
    at = np.asarray(places, dtype=np.int64).reshape(-1, len(PAGE))
    out = np.zeros((len(at), META), dtype=np.float32)
    np.put_along_axis(out, at, 1, axis=1)
    return out


def held_apart(y: np.ndarray) -> np.ndarray:
    """Every third labelled document of each class."""
    out = np.zeros(len(y), dtype=bool)
    for c in (0, 1):
        out[np.flatnonzero((y > 0.5) == c)[2::3]] = True
    return out


#: Byte classes: 0 letters, 1 white space, 2 digits, 3 sentence marks, 4 other marks, 5 upper case.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[48:58] = 2
_CLASS[[x for x in range(33, 127) if not chr(x).isalnum()]] = 4
_CLASS[[ord(x) for x in ".,;:?'\"-()"]] = 3
_CLASS[65:91] = 5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Logistic:
    """Logistic regression on standardised columns, fitted by steps on sums.

    A step goes to the lowest point of a parabola that lies on the loss at the present weights
    and nowhere under it (Jaakkola and Jordan's bound), so that no step makes the loss larger,
    also where labels contradict a view that was sure.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(axis=0).astype(np.float64), x.std(axis=0).astype(np.float64) + 0.05
        self.x, self.y = x, y
        self.each = np.where(y > 0.5, 0.5 * len(y) / max(1, (y > 0.5).sum()), 0.5 * len(y) / max(1, (y <= 0.5).sum()))
        self.w = np.zeros(x.shape[1] + 1)
        for _ in range(FIRST):
            self.step([])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("x", "y", "each")}  # tasks need no labelled rows

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.scale, np.ones(len(x))].astype(np.float32)

    def sums(self, x: np.ndarray, y: np.ndarray, each: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the loss and curvature of its bound, summed over rows."""
        z = self.inputs(x)
        odds = np.maximum(np.abs(z @ self.w), 1e-6)
        curve = each * np.tanh(odds / 2) / (2 * odds)
        return z.T.astype(np.float64) @ (each * (_sigmoid(z @ self.w) - y)), (z.T @ (z * curve.astype(np.float32)[:, None])).astype(np.float64)

    def step(self, more: list[tuple[np.ndarray, np.ndarray, float]]) -> None:
        """A step on the labelled rows and on ``more``: (gradient, curvature, weight) of other rows."""
        grad, curve = self.sums(self.x, self.y, self.each)
        total = float(len(self.y))
        for g, c, (weight, count) in more:
            grad, curve, total = grad + weight * g, curve + weight * c, total + weight * count
        hold = np.full(len(self.w), PENALTY * total)
        hold[-1] = 1e-6
        self.w -= np.linalg.solve(curve + np.diag(hold + 1e-3), grad + hold * self.w)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.w


def _platt(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of log-odds that fit the labels (short Newton steps, held back to slope 1 and shift 0)."""
    a = np.array([1.0, 0.0])
    x = np.stack([np.clip(odds, -_SPAN, _SPAN), np.ones(len(odds))], axis=1)
    for _ in range(60):
        p = _sigmoid(x @ a)
        move = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag([1.0, 0.1]), x.T @ (p - y) + [a[0] - 1, 0.1 * a[1]])
        a -= move * min(1.0, 0.5 / max(1e-9, float(np.abs(move).max())))
    return max(0.0, float(a[0])), float(a[1])


class Rounds:
    """What tasks need to know which documents have been handed over: per round, weights and cuts of both views."""

    def __init__(self, models: list[Logistic]):
        self.fixed = [(m.mean, m.scale) for m in models]
        self.done: list[tuple[list[np.ndarray], list[tuple[float, float]]]] = []

    def odds(self, view: int, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        mean, scale = self.fixed[view]
        return np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -_SPAN, _SPAN)

    def labels(self, views: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """The first label (1, 0, or -1 for none) that each view has given each row."""
        out = [np.full(len(views[0]), -1), np.full(len(views[0]), -1)]
        for weights, cuts in self.done:
            for v in (0, 1):
                odds = self.odds(v, weights[v], views[v])
                bad, good = cuts[v]
                now = np.where(odds >= good, 1, np.where(odds <= bad, 0, -1))
                out[v] = np.where(out[v] < 0, now, out[v])
        return out


def cuts_of(counts: np.ndarray, share: float, rounds: int) -> tuple[float, float]:
    """(highest log-odds for bad, lowest for good) that hand over a 1 / (4 * rounds) of the counted rows.

    ``counts`` are rows by bins of log-odds; the bin in which a quota ends goes over as a whole.
    """
    quota = counts.sum() / (4 * rounds)
    edges = np.arange(len(counts)) / BINS - _SPAN
    upto = np.cumsum(counts)
    bad = edges[min(len(counts) - 1, int(np.searchsorted(upto, quota * (1 - share))))] + 1 / BINS
    down = np.cumsum(counts[::-1])
    good = edges[::-1][min(len(counts) - 1, int(np.searchsorted(down, quota * share)))]
    return float(min(bad, -SURE)), float(max(good, SURE))


def counted(odds: np.ndarray) -> np.ndarray:
    return np.bincount(np.floor((odds + _SPAN) * BINS).astype(np.int64), minlength=2 * _SPAN * BINS + 1)


#: sums(arrays of the pool's rows, function of both views' rows giving arrays) -> the arrays' sums
Pool = Callable[[Callable[[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]], "list[np.ndarray] | None"]


class CoTrained:
    """Two calibrated views and how they are combined; a few kilobytes."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: Pool, rounds: int = ROUNDS):
        """``views``: rows of labelled documents by view; ``pool`` sums over the unlabelled ones."""
        held = held_apart(y)
        models = [Logistic(v[~held], y[~held]) for v in views]
        known, share = Rounds(models), float(y[~held].mean())
        judged = len(set(y[held] > 0.5)) == 2
        if not judged:  # too few to hold any of both classes apart: calibrated on all of them, and nothing is rejected
            held = np.ones(len(y), dtype=bool)
        #: By round, how many documents each view has labelled bad and good so far.
        self.handed: list[list[list[int]]] = []
        base = np.log(max(0.5, (y[held] > 0.5).sum()) / max(0.5, (y[held] <= 0.5).sum()))
        for _ in range(rounds):
            weights = []
            for m, v in zip(models, views, strict=True):  # a view is as sure as it is right on documents held apart
                slope, shift = _platt(m.odds(v[held]), y[held])
                weights.append(m.w * slope)
                weights[-1][-1] += shift - base
            counts = pool(lambda x: _counts(x, known, weights))  # noqa: B023
            if counts is None:
                break
            known.done.append((weights, [cuts_of(c, share, rounds) for c in counts]))
            for _ in range(STEPS):
                sums = pool(lambda x: _handed(x, known, models))
                many = [[int(sums[6 * v + 3 * c][0]) for c in (0, 1)] for v in (0, 1)]
                for v in (0, 1):  # each view learns from the other
                    mine = models[v]
                    most = [(mine.each * (mine.y == c)).sum() for c in (0, 1)]
                    mine.step([(sums[6 * v + 3 * c + 1], _square(sums[6 * v + 3 * c + 2], len(mine.w)), (min(1.0, most[c] / max(1, many[v][c])), many[v][c])) for c in (0, 1)])
            self.handed.append([many[1], many[0]])
        self.models = models
        odds = [m.odds(v[held]) for m, v in zip(self.models, views, strict=True)]
        self.scales = [_platt(o, y[held]) for o in odds]
        calibrated = np.stack([a * np.clip(o, -_SPAN, _SPAN) + b for o, (a, b) in zip(odds, self.scales, strict=True)], axis=1)
        self.both = Logistic(calibrated, y[held])
        self.last = _platt(self.both.odds(calibrated), y[held])
        good = np.sort(_sigmoid(self.last[0] * self.both.odds(calibrated) + self.last[1])[y[held] > 0.5])
        # few good documents held apart say little of how low others may score
        self.cut = 0.0
        if judged:
            cut = min(0.5, float(good[int(LOSS * len(good))]) * 0.999)
            self.cut = float(_sigmoid(np.log(cut / (1 - cut)) - DOUBT / len(good)))

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: text view, metadata view, both."""
        c = np.stack([a * np.clip(m.odds(v), -_SPAN, _SPAN) + b for m, v, (a, b) in zip(self.models, (text, meta), self.scales, strict=True)], axis=1)
        return _sigmoid(c[:, 0]), _sigmoid(c[:, 1]), _sigmoid(self.last[0] * self.both.odds(c) + self.last[1])


def _counts(views: tuple[np.ndarray, np.ndarray], known: Rounds, weights: list[np.ndarray]) -> list[np.ndarray]:
    """Counts of each view's log-odds over the rows that this view hasn't labelled."""
    labels = known.labels(views)
    return [counted(known.odds(v, weights[v], views[v][labels[v] < 0])) for v in (0, 1)]


def _handed(views: tuple[np.ndarray, np.ndarray], known: Rounds, models: list[Logistic]) -> list[np.ndarray]:
    """For each view and class: number, gradient and curvature of the rows that the other view has labelled so."""
    out: list[np.ndarray] = []
    labels = known.labels(views)
    for v in (0, 1):
        for c in (0, 1):
            x = views[v][labels[1 - v] == c]
            g, h = models[v].sums(x, np.full(len(x), float(c)))
            out += [np.array([float(len(x))]), g, h[np.triu_indices(len(h))]]  # it is symmetric
    return out


def _square(half: np.ndarray, n: int) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    out = np.zeros((n, n))
    out[np.triu_indices(n)] = half
    return out + np.triu(out, 1).T


def _columns(docs: DataFrame) -> list[Column]:
    """text, lang, source and n_chars, null where there is none."""
    has = lambda c, kind: F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)
    return [has("text", "string"), has("lang", "string"), has("source", "string"), F.coalesce(has("n_chars", "long"), F.length(has("text", "string")).cast("long"))]


def _places(texts, langs, sources, lengths) -> np.ndarray:
    return np.array([meta_places(*x) for x in zip(texts, langs, sources, lengths, strict=True)], dtype=np.int64).reshape(-1, len(PAGE))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, y, text view, places of the metadata view), as bytes."""
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            text = [text_view(t.as_py()).astype("<f2").tobytes() for t in part.column(2)]
            meta = _places((t.as_py() for t in part.column(2)), *(part.column(c).to_pylist() for c in (3, 4, 5))).astype("<i2")
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.binary()), pa.array([m.tobytes() for m in meta], pa.binary())], names=["id", "y", "text", "meta"])


def _rows(text: list[bytes], meta: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(text), dtype="<f2").reshape(-1, TEXT).astype(np.float32), meta_view(np.frombuffer(b"".join(meta), dtype="<i2"))


def _packed(arrays: list[np.ndarray]) -> list[bytes]:
    """Sums as bytes: curvatures as single, all else as double precision."""
    return [a.astype("<f4" if a.size > _WIDE else "<f8").tobytes() for a in arrays]


def _added(total: list[np.ndarray] | None, row: list[bytes]) -> list[np.ndarray]:
    own = [np.frombuffer(a, dtype="<f4" if len(a) > 8 * _WIDE else "<f8").astype(np.float64) for a in row]
    return own if total is None else [a + b for a, b in zip(total, own, strict=True)]


#: Longer arrays are sent in single precision.
_WIDE = 2 * _SPAN * BINS + 1
_SUMS = "part long, sums array<binary>"


def _sums_row(part: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([_packed(arrays)], pa.list_(pa.binary()))], names=["part", "sums"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, first = None, 0
    for batch in batches:
        for part, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            first = part if total is None else first
            total = _added(total, row)
    if total is not None:
        yield _sums_row(first, total)


def _pool(rest: DataFrame) -> Pool:
    """Sums over the kept features of the unlabelled rows: per partition, then over some of these together, then here."""
    n = rest.rdd.getNumPartitions()

    def sums(of):
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for i in range(0, batch.num_rows, 1000):
                    own = of(_rows(*(batch.slice(i, 1000).column(c).to_pylist() for c in (0, 1))))
                    total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
            if total is not None:
                yield _sums_row(TaskContext.get().partitionId(), total)

        got, groups = rest.select("text", "meta").mapInArrow(part, _SUMS), n
        while groups > 8:  # in order, so that sums are the same in every run
            groups = -(-groups // 16)
            got = got.repartition(groups).sortWithinPartitions("part").mapInArrow(_together, _SUMS)
        total = None
        for r in sorted(got.collect(), key=lambda r: r["part"]):  # 8 rows at most
            total = _added(total, [bytes(a) for a in r["sums"]])
        return total

    return sums


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> CoTrained | None:
    """A classifier from a bounded sample of labelled and from all unlabelled documents; None without both classes."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    mark = F.xxhash64("id", F.lit(5))
    n = known.count()
    if n > LABELLED:  # twice as many ids are looked for, since some may have no document
        known = known.where(F.pmod(mark, F.lit(1 << 30)) < int(2 * LABELLED / n * (1 << 30))).orderBy(mark, "id").limit(2 * LABELLED)
    some = F.broadcast(known)  # 2 * LABELLED rows at most
    text, lang, source, n_chars = _columns(docs)
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), lang.alias("lang"), source.alias("source"), n_chars.alias("n_chars"))
    rows = rows.join(some, "id", "left").select("id", "y", "text", "lang", "source", "n_chars")
    featured = checkpointed(rows.mapInArrow(_featured, "id long, y double, text binary, meta binary"))
    found = featured.where("y is not null").groupBy("id", "y").agg(F.min_by(F.struct("text", "meta"), F.xxhash64("text", "meta")).alias("f")).collect()
    got = sorted(found, key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"]))[:LABELLED]
    y = np.array([r["y"] for r in got])
    if not len(y) or y.min() == y.max():
        return None
    return CoTrained(_rows([bytes(r["f"]["text"]) for r in got], [bytes(r["f"]["meta"]) for r in got]), y, _pool(featured.where("y is null")))


def score_documents(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """``docs`` with ``text_score``, ``meta_score``, ``quality_score`` (probabilities) and ``keep``."""
    scores = ("text_score", "meta_score", "quality_score", "keep")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in scores]
    if model is None:
        return docs.select(*own, *(F.lit(1.0).alias(c) for c in scores[:3]), F.lit(True).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, langs, sources, lengths in parts:
            out = [pd.DataFrame({c: pd.Series(dtype=float) for c in "tmq"})]
            for i in range(0, len(texts), 2000):
                at = slice(i, i + 2000)
                text = np.stack([text_view(t) for t in texts.iloc[at]])
                meta = meta_view(_places(texts.iloc[at], langs.iloc[at], sources.iloc[at], (None if pd.isna(x) else int(x) for x in lengths.iloc[at])))
                out.append(pd.DataFrame(dict(zip("tmq", shared.value.score(text, meta), strict=True))))
            yield pd.concat(out[1:] or out, ignore_index=True)

    scored = F.pandas_udf(run, "t double, m double, q double").asNondeterministic()  # a filter on it must not run it twice
    # a caller's columns travel as one, so that no name of theirs meets one of ours
    out = small_batches(docs).select(F.struct(*own).alias("row"), scored(*_columns(docs)).alias("s"))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in scores), F.col("s.t").alias("text_score"), F.col("s.m").alias("meta_score"), F.col("s.q").alias("quality_score"), (F.col("s.q") >= model.cut).alias("keep"))
