"""Toxic passages: maximal scoring segments over log-odds with Dirichlet priors, calibrated by extreme values."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import blocks, bounds, coded, cut, in_arrow, mapped, words

#: Labelled rows that the model is fitted on, at most: those with the smallest hashes of their id.
LABELLED = 30_000
#: Word beginnings of these lengths are features besides the words, so an unseen form of a known stem counts.
STEMS = (4, 5, 6, 7)
#: Standard errors that a log-odds ratio is drawn to 0 by; mass of the prior; most a token may score; what each token costs.
ERRORS, PRIOR, MOST, DRIFT = 2.0, 10.0, 6.0, 0.02
#: Fewer standard errors, tried in turn where labels are so few that after ERRORS nothing scores above 0.
LESS = (1.5, 1.0, 0.5)
#: The least slope of the calibration: evidence is -log of a chance, so a score rises with it even where few labels, out of fold, don't say so.
RISING = 0.1
#: Parts of the labelled rows: each part's evidence, for the calibration, comes from the counts of the others.
FOLDS = 4
#: Segments that are, alone and together, likelier than this in a clean document of the length aren't significant.
CHANCE = 0.1
RESULTS = {"evidence": "double", "segments": "array<struct<first_word:int,words:int,score:double,expect:double>>"}
_SEGMENTS = pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("score", pa.float64()), ("expect", pa.float64())]))


def _features(uniq: list[str]) -> list[tuple[list[str], np.ndarray]]:
    """The words, then the stems of each length: distinct features and each word's index among them (-1: none)."""
    out = [(uniq, np.arange(len(uniq)))]
    for n in STEMS:
        at: dict[str, int] = {}
        index = np.fromiter((at.setdefault(x[:n] + "*", len(at)) if len(x) > n else -1 for x in uniq), dtype=np.int64, count=len(uniq))
        out.append((list(at), index))
    return out


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each feature and fold in how many documents of label 1 and 0 it stands; the empty feature counts documents."""
    for block in blocks(batches):
        toxic, fold = (np.asarray(block.column(x)).astype(np.int64) for x in ("toxic", "fold"))
        items, rows = words(block.column("text"))
        uniq, index = coded(items)
        names, folds, ones, zeros = [], [], [], []
        for found, place in [([""], None), *_features(uniq)]:
            width = max(1, len(found))
            if place is None:
                row, feature = np.arange(block.num_rows), np.zeros(block.num_rows, np.int64)
            else:
                at = place[index] if len(index) else index
                row, feature = np.divmod(np.unique(rows[at >= 0] * width + at[at >= 0]), width)
            cell, inverse = np.unique(feature * FOLDS + fold[row], return_inverse=True)
            one = np.bincount(inverse, weights=toxic[row], minlength=len(cell)).astype(np.int64)
            names.append(pa.array(found, pa.string()).take(pa.array(cell // FOLDS)))
            folds.append(cell % FOLDS)
            ones.append(one)
            zeros.append(np.bincount(inverse, minlength=len(cell)) - one)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(names), *(pa.array(np.concatenate(x), t) for x, t in ((folds, pa.int32()), (ones, pa.int64()), (zeros, pa.int64())))], names=["feature", "fold", "ones", "zeros"])


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), by the linear-time scan over candidates with left and right sums."""
    held: list[tuple[int, int, float, float]] = []  # begin, end, sum before, sum through
    total = 0.0
    for i, s in enumerate(scores.tolist()):
        before, total = total, total + s
        if s <= 0:
            continue
        begin, left, right = i, before, total
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j -= 1
            if j < 0 or held[j][3] >= right:
                break
            begin, left = held[j][0], held[j][2]
            del held[j:]
        held.append((begin, i + 1, left, right))
    return [(a, b, right - left) for a, b, left, right in held]


@dataclass
class ToxicModel:
    """Scores of features, the extreme-value parameters (lambda, K) and the calibration (intercept, slope)."""

    scores: dict[str, float]
    rate: float = 1.0
    scale: float = 0.1
    line: tuple[float, float] = (0.0, 1.0)
    drift: float = DRIFT

    def token_scores(self, uniq: list[str]) -> np.ndarray:
        """Of each word the score of itself, or else of its longest beginning that has one, or else 0; each costs ``drift``."""
        get, out = self.scores.get, np.full(len(uniq), -self.drift)
        for i, x in enumerate(uniq):
            score = get(x)
            if score is None:
                for n in reversed(STEMS):
                    if len(x) > n and (score := get(x[:n] + "*")) is not None:
                        break
            if score is not None:
                out[i] += score
        return out


def log_odds(a: Column, b: Column, one: float, zero: float, errors: float = ERRORS) -> Column:
    """The log-odds ratio with an informative Dirichlet prior of a feature that stands in ``a`` of ``one`` toxic documents
    and ``b`` of ``zero`` others, drawn to 0 by ``errors`` standard errors, within MOST; 0 where it may as well be 0.

    The prior has mass PRIOR, shared as the features are in both classes together.
    """
    prior = F.lit(PRIOR / max(1.0, one + zero)) * (a + b)
    ratio = F.log((a + prior) / (F.lit(one + PRIOR) - a - prior)) - F.log((b + prior) / (F.lit(zero + PRIOR) - b - prior))
    sure = F.abs(ratio) - F.lit(errors) * F.sqrt(1 / (a + prior) + 1 / (b + prior))
    return F.when(a + b > 0, F.signum(ratio) * F.least(F.greatest(sure, F.lit(0.0)), F.lit(MOST))).otherwise(F.lit(0.0))


def _occurrence(key: np.ndarray) -> np.ndarray:
    """For each item the how many-th of its kind it is, from 1."""
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(key) else np.empty(0, int)
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key)))) + 1
    return out


def joint_evidence(normal: list[float]) -> tuple[float, int]:
    """-log of the chance of the best r segments together, by the sum of their normalised scores, and that r.

    ``normal`` are lambda S - log(K n), falling. One segment of x has chance 1 - exp(-exp(-x)); r of sum T have
    exp(-T) T**(r-1) / (r! (r-1)!), doubled for each segment after the first, as r was chosen.
    """
    best, chosen, total = 0.0, 0, 0.0
    for r, x in enumerate(normal, 1):
        total += x
        if x <= 0:
            break
        if r == 1:
            now = -math.log(-math.expm1(-math.exp(-x))) if x < 30 else x
        else:
            now = total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2)
        if now > best:
            best, chosen = now, r
    return best, chosen


def significant(normal: list[float], joint: list[float]) -> tuple[float, list[int]]:
    """The evidence of a text's segments and which of them are significant, by themselves or together.

    ``normal`` are their normalised scores, ``joint`` the same with words discounted across the text: together, repeats
    of a passage are no independent evidence.
    """
    order = sorted(range(len(joint)), key=lambda k: -joint[k])
    evidence, r = joint_evidence([joint[k] for k in order])
    single = [joint_evidence([x])[0] for x in normal]
    least = -math.log(CHANCE)
    chosen = {k for k, x in enumerate(single) if x >= least} | set(order[:r] if evidence >= least else ())
    return max([evidence, *single]), sorted(chosen)


def _scored(model: ToxicModel, texts: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
    """The evidence of each text and its significant segments."""
    n = len(texts)
    items, rows = words(texts)
    evidence, out = np.zeros(n), [[] for _ in range(n)]
    uniq, code = coded(items)
    if not uniq:
        return evidence, out
    score = model.token_scores(uniq)[code]
    begins = bounds(rows, n)
    offset = np.log(np.maximum(model.scale * np.diff(begins), 1e-300))
    up = np.maximum(score, 0.0)
    # Only a segment whose normalised score is above 0 is evidence; a text without so much can't hold one.
    may = np.flatnonzero(model.rate * np.bincount(rows, weights=up, minlength=n) > offset)
    # Tokens alike in sign and text stay together in every maximal segment.
    turn = np.flatnonzero(np.concatenate(([True], (np.diff(score > 0) != 0) | (np.diff(rows) != 0))))
    run = np.add.reduceat(score, turn)
    turns = np.append(turn, len(score))
    found: list[tuple[int, int, int]] = []
    first, last = np.searchsorted(turn, begins[may]), np.searchsorted(turn, begins[may + 1])
    for row, a, b in zip(may.tolist(), first.tolist(), last.tolist(), strict=True):
        found += [(row, int(turns[a + x]), int(turns[a + y])) for x, y, s in segments(run[a:b]) if model.rate * s > offset[row]]
    if not found:
        return evidence, out
    row, a, b = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
    size = b - a
    at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    own = np.repeat(np.arange(len(a)), size)
    width = len(uniq) + 1

    ends = np.cumsum(size)

    def highest(group: np.ndarray) -> np.ndarray:
        """The highest sum within each segment where the k-th token of a word that scores above 0 counts 1/k in its group."""
        less = np.where(score[at] > 0, score[at] / _occurrence(group * width + code[at]), score[at])
        out = np.empty(len(a))
        for k, (i, j) in enumerate(zip((ends - size).tolist(), ends.tolist(), strict=True)):
            through = np.cumsum(np.append(0.0, less[i:j]))
            out[k] = (through - np.minimum.accumulate(through)).max()
        return out

    alone = highest(own)
    normal, joint = (model.rate * x - offset[row] for x in (alone, highest(row[own])))
    edges = np.flatnonzero(np.concatenate(([True], np.diff(row) != 0)))
    for i, j in zip(edges, np.append(edges[1:], len(row)), strict=True):
        r = int(row[i])
        evidence[r], chosen = significant(normal[i:j].tolist(), joint[i:j].tolist())
        out[r] = [{"first_word": int(a[i + k] - begins[r]), "words": int(size[i + k]), "score": float(alone[i + k]), "expect": math.exp(min(-normal[i + k], 700.0))} for k in chosen]
    return evidence, out


def extreme_values(counts: np.ndarray, score: np.ndarray) -> tuple[float, float]:
    """Lambda: the root of sum p exp(lambda s) = 1 for the tokens of clean documents, seen ``counts`` times with ``score``.

    K is the least at which K exp(-lambda s) is no less than the share of tokens that score s or more, for each s > 0: no
    segment is called rarer than the single tokens of its score are in clean text.
    """
    every = counts.sum()
    p = counts / every
    low, high = 1e-3, 1e-3
    excess = lambda x: float((p * np.exp(np.minimum(x * score, 700.0))).sum() - 1.0)
    while excess(high) < 0 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    rate = max(low, 0.05)
    order = np.argsort(-score)
    reached = np.where(score[order] > 0, np.cumsum(p[order]) * np.exp(np.minimum(rate * score[order], 700.0)), 0.0)
    return rate, max(float(reached.max(initial=0.0)), 1 / every)


def _folded(block: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """The folds of a block's rows, with their texts and labels."""
    fold, toxic = np.asarray(block.column("fold")), np.asarray(block.column("toxic"))
    for k in np.unique(fold):
        at = np.flatnonzero(fold == k)
        yield int(k), block.column("text").take(pa.array(at)), toxic[at]


def _tokens(sent):
    """For each rounded score how many tokens of clean documents have it, by the model that hasn't seen the document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [ToxicModel(x) for x in sent.value]
        for block in blocks(batches):
            for k, texts, toxic in _folded(block):
                uniq, code = coded(words(texts.filter(pa.array(toxic == 0)))[0])
                score = np.round(models[k].token_scores(uniq), 2)[code] if uniq else np.empty(0)
                value, n = np.unique(score, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value, pa.float64()), pa.array(n, pa.int64())], names=["score", "n"])

    return run


def _evidence(sent, rate: float, scale: float, drift: float):
    """The evidence of each document, by the model that hasn't seen it, with its label."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [ToxicModel(x, rate, scale, drift=drift) for x in sent.value]
        for block in blocks(batches):
            for k, texts, toxic in _folded(block):
                yield pa.RecordBatch.from_arrays([pa.array(_scored(models[k], texts)[0]), pa.array(toxic, pa.int32())], names=["evidence", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, labelled: int = LABELLED) -> ToxicModel:
    """Learn from at most ``labelled`` rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) labels 0 or 1.

    ``usable`` is a rule on doc_id that both have to meet. They are the rows with the smallest hashes of their id, the
    same each time; being so few (16 bytes each), they are sent to all tasks, and no text is shuffled. Rows with a null
    id, text or label teach nothing; a document with several labels counts once for each; an empty table, and one without
    label 1, gives a model that finds nothing toxic. Other columns are ignored.

    Extreme-value parameters and calibration come from documents that the counts in use don't hold: the labelled rows
    are dealt to FOLDS parts by their id, and each part is scored by the counts of the others. Where labels are so few that
    nothing scores above 0 after ERRORS standard errors, those of LESS are tried.
    """
    usable = F.lit(True) if usable is None else usable
    known = labels.where(F.col("toxic").isin(0, 1) & usable).select("doc_id", F.col("toxic").cast("int"))
    known = cut(known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "toxic").limit(labelled))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(FOLDS)).cast("int").alias("fold")
    joined = cut(docs.where(F.col("text").isNotNull() & usable).select("doc_id", F.col("text").cast("string")).join(F.broadcast(known), "doc_id").select("text", "toxic", fold))
    counted = joined.transform(in_arrow, _count, "feature string, fold int, ones bigint, zeros bigint")
    of = lambda x, k: F.sum(F.when(F.col("fold") == k, F.col(x)).otherwise(0))
    counted = cut(counted.groupBy("feature").agg(*(of(x, k).alias(f"{x}{k}") for x in ("ones", "zeros") for k in range(FOLDS))))
    docs_of = counted.where("feature = ''").first()
    if docs_of is None:
        return ToxicModel({})
    if not sum(docs_of[f"ones{k}"] for k in range(FOLDS)):
        return ToxicModel({})
    for errors in (ERRORS, *LESS):
        model = _fitted(joined, counted, docs_of, errors)
        if max(model.scores.values(), default=0.0) > 0:
            break
    return model


def _fitted(joined: DataFrame, counted: DataFrame, docs_of, errors: float) -> ToxicModel:
    """The model whose features are drawn to 0 by ``errors`` standard errors."""
    # Model k is of all folds but k, the last one of all.
    scores = []
    for k in range(FOLDS + 1):
        used = [j for j in range(FOLDS) if j != k]
        a, b = (sum((F.col(f"{x}{j}") for j in used[1:]), F.col(f"{x}{used[0]}")).cast("double") for x in ("ones", "zeros"))
        scores.append(log_odds(a, b, *(float(sum(docs_of[f"{x}{j}"] for j in used)) for x in ("ones", "zeros")), errors).alias(f"s{k}"))
    frame = counted.where("feature <> ''").select("feature", *scores).where(" OR ".join(f"s{k} <> 0" for k in range(FOLDS + 1))).toPandas()
    *parts, whole = ({f: float(v) for f, v in zip(frame["feature"], frame[f"s{k}"], strict=True) if v} for k in range(FOLDS + 1))
    model, sent = ToxicModel(whole), joined.sparkSession.sparkContext.broadcast(parts)
    if max(whole.values(), default=0.0) <= 0:
        return model
    clean = joined.where("toxic = 0").transform(in_arrow, _tokens(sent), "score double, n bigint").groupBy("score").agg(F.sum("n").alias("n")).toPandas()
    if len(clean):
        n, score = clean["n"].to_numpy(float), clean["score"].to_numpy(float)
        mean = float((n * score).sum() / n.sum())
        if mean >= 0:  # segments of clean text would have no end: each token costs so much more that they have
            model.drift += mean + DRIFT
        model.rate, model.scale = extreme_values(n, score - (model.drift - DRIFT))
    # Platt scaling of the evidence, from its histogram: at most a few thousand rows come to the driver.
    scored = joined.transform(in_arrow, _evidence(sent, model.rate, model.scale, model.drift), "evidence double, toxic int")
    bins = scored.groupBy(F.round(F.least(F.col("evidence"), F.lit(200.0)), 1).alias("x"), "toxic").count().toPandas()
    model.line = _platt(bins["x"].to_numpy(float), bins["toxic"].to_numpy(float), bins["count"].to_numpy(float))
    return model


def _platt(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on ln(1 + x), with a small ridge on the slope, which is RISING at least, and smoothed targets."""
    z = np.log1p(x)
    one, zero = n[y == 1].sum(), n[y == 0].sum()
    target = np.where(y == 1, (one + 1) / (one + 2), 1 / (zero + 2))
    design = np.stack([np.ones_like(z), z], axis=1)

    def solved(w: np.ndarray, free: np.ndarray) -> np.ndarray:
        """By Newton's steps; only the ``free`` ones of intercept and slope move."""
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            grad = design.T @ (n * (target - p)) - np.array([0.0, 1e-3]) * w
            hess = (design * (n * p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag([1e-9, 1e-3])
            step = np.zeros(2)
            step[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
            w = w + step
            if np.abs(step).max() < 1e-9:
                break
        return w

    w = solved(np.zeros(2), np.array([0, 1]))
    if w[1] < RISING:
        w = solved(np.array([0.0, RISING]), np.array([0]))
    return float(w[0]), float(w[1])


def score_texts(docs: DataFrame, model: ToxicModel, keys: list[str]) -> DataFrame:
    """``keys`` of each row of ``docs`` with its evidence and the significant segments of its whole text.

    A text that is null, empty or without a word has evidence 0 and no segment. Repeated rows give repeated results, an
    empty table none; a key that has the name of a result gives way to it.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.scores, model.rate, model.scale, model.line, model.drift))

    def start():
        model = ToxicModel(*sent.value)

        def run(block: pa.RecordBatch) -> list[pa.Array]:
            evidence, found = _scored(model, block.column("text"))
            return [pa.array(evidence, pa.float64()), pa.array(found, _SEGMENTS)]

        return run

    return mapped(docs, keys, {"text": F.col("text").cast("string")}, start, RESULTS)


def detect(docs: DataFrame, model: ToxicModel, keys: list[str]) -> DataFrame:
    """As ``score_texts``, with ``score``: the calibrated probability of label 1."""
    a, b = model.line
    return score_texts(docs, model, [x for x in keys if x.lower() != "score"]).withColumn("score", 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.log1p("evidence")))))
