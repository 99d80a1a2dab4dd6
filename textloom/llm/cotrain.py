"""Quality classifier by co-training: a text view and a metadata view teach each other over rounds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import blocks, bounds, coded, cut, fields, in_arrow, mapped

#: Labelled rows that the classifiers are fitted on, at most: those with the smallest hashes of their id.
LABELLED = 20_000
#: Rounds, and the share of all unlabelled rows that each view labels for the other in a round.
ROUNDS, CONFIDENT = 5, 0.05
#: The weight of a pseudo-label; bins of a logit; tasks whose sums (0.3 MB each) come to the driver as they are, at most,
#: and rows that a task sums up at least.
HALF, BINS, SUMS, SUM_ROWS = 0.5, 100, 64, 16_384
#: Rows of the pool that a task handles at a time.
POOL_ROWS = 2_000
#: Hash buckets of the text view's word shapes, of its words and of its pairs of words, and of the metadata view's categories.
SHAPES, WORDS, PAIRS, CATEGORIES = 256, 96, 32, 64
#: Dense measures of a text, in order.
MEASURES = (
    "log words", "distinct share", "repeat share", "mean length", "upper share", "digit share", "symbol share", "end marks",
    "bare symbols", "line repeat", "long words", "short words",
)
_META = 4
#: Columns of style come first; those of words and pairs are scaled down by SHY, which is to say that they are penalised by
#: its square more: there are many, and few rows say much about one.
STYLE, SHY = len(MEASURES) + SHAPES, 5.0


def _classes() -> np.ndarray:
    """For each code point 1 for an upper-case letter, 2 for another letter, 3 for a digit, else 0."""
    points = map(chr, range(0x110000))
    return np.fromiter((1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 0 for c in points), dtype=np.uint8, count=0x110000)


def _word_measures(uniq: list[str], classes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each word: length, letters, upper-case letters, digits, whether it ends in a mark, and its shape's bucket.

    A shape is the word's kinds of characters (letters of two cases, digits, the others as they are), with runs cut to
    two and the whole to twelve.
    """
    points = np.frombuffer("".join(uniq).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    length = np.fromiter(map(len, uniq), dtype=np.int64, count=len(uniq))
    begins = np.concatenate(([0], np.cumsum(length)[:-1]))
    kind = classes[points]
    count = lambda x: np.add.reduceat(x.astype(np.float64), begins)
    ends = np.isin(points[begins + length - 1], [ord(x) for x in ".,;:!?"]).astype(float)
    drawn = np.where(kind == 0, points, kind).astype(np.uint64)
    place = np.arange(len(points)) - np.repeat(begins, length)
    third = np.zeros(len(points), bool)
    third[2:] = (drawn[2:] == drawn[1:-1]) & (drawn[2:] == drawn[:-2]) & (place[2:] >= 2)
    kept = np.cumsum(~third)
    rank = kept - np.repeat(kept[begins], length)
    weight = np.cumprod(np.full(13, 0x9E3779B97F4A7C15, dtype=np.uint64))
    mixed = np.where(third | (rank >= 12), np.uint64(0), (drawn + np.uint64(1)) * weight[np.minimum(rank, 12)])
    shape = np.add.reduceat(mixed, begins)
    shape ^= shape >> np.uint64(31)
    bucket = ((shape * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) % np.uint64(SHAPES)
    return length.astype(float), count((kind == 1) | (kind == 2)), count(kind == 1), count(kind == 3), ends, bucket.astype(np.int64)


def text_view(texts: pa.Array, classes: np.ndarray) -> np.ndarray:
    """Rows x (measures + shapes + words + pairs of words): how a text is written and what it says, from its whole.

    Words are hashed in lower case without marks at their ends; each bucket's share of the words has the sign that most of
    its hashes give, so that words in one bucket don't add up.
    """
    texts = pc.fill_null(texts.cast("large_string"), "")
    n = len(texts)
    items, rows = fields(texts)
    uniq, index = coded(items)
    at = bounds(rows, n)
    count = np.diff(at)
    some = np.maximum(count, 1)
    if uniq:
        length, letters, upper, digits, ends, bucket = _word_measures(uniq, classes)
    else:
        length = letters = upper = digits = ends = np.empty(0)
        bucket = np.empty(0, np.int64)
    total = lambda w: np.bincount(rows, weights=w[index], minlength=n) if len(uniq) else np.zeros(n)
    chars = np.maximum(total(length), 1)
    pair = np.unique(rows * max(1, len(uniq)) + index) if len(uniq) else np.empty(0, int)
    distinct = np.bincount(pair // max(1, len(uniq)), minlength=n)
    again = np.zeros(n)
    if len(index):
        same = (index[1:] == index[:-1]) & (rows[1:] == rows[:-1])
        again = np.bincount(rows[1:][same], minlength=n)
    lines = [x.split("\n") for x in texts.to_pylist()]
    line_repeat = np.array([1 - len(set(x)) / len(x) for x in lines])
    dense = np.stack([
        np.log1p(count) / 10, distinct / some, again / some, total(length) / some / 20, total(upper) / chars, total(digits) / chars,
        1 - (total(letters) + total(digits)) / chars, total(ends) / some, total((letters == 0).astype(float)) / some, line_repeat,
        total((length > 20).astype(float)) / some, total((length < 3).astype(float)) / some,
    ], axis=1)
    shapes = np.bincount(rows * SHAPES + bucket[index], minlength=n * SHAPES).reshape(n, SHAPES) / some[:, None] if len(uniq) else np.zeros((n, SHAPES))
    said = np.fromiter((xxhash.xxh3_64_intdigest(x.strip(_MARKS).lower()) for x in uniq), dtype=np.uint64, count=len(uniq))[index] if len(uniq) else np.empty(0, np.uint64)
    inside = rows[1:] == rows[:-1]
    pairs = ((said[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ said[1:])[inside] * np.uint64(0xD6E8FEB86659FD93)
    content = [_signed(said, rows, n, WORDS), _signed(pairs, rows[1:][inside], n, PAIRS)]
    return np.concatenate((dense, np.sqrt(shapes), *(np.sign(x) * np.sqrt(np.abs(x) / some[:, None]) for x in content)), axis=1).astype(np.float32)


_MARKS = ".,;:!?()[]{}\"'"


def _signed(hashes: np.ndarray, rows: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Rows x buckets: the sums of the hashes' signs."""
    place = (hashes >> np.uint64(20)) % np.uint64(buckets)
    sign = np.where((hashes >> np.uint64(63)) == 1, 1.0, -1.0)
    return np.bincount(rows * buckets + place.astype(np.int64), weights=sign, minlength=n * buckets).reshape(n, buckets)


def meta_view(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Rows x (length curve + categories): what is known about a document beside its text; a null is a category."""
    n = len(lang)
    size = np.log1p(np.array([max(0, x or 0) for x in n_chars], float)) / 10
    out = np.zeros((n, _META + CATEGORIES), dtype=np.float32)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = size, size**2, size**3, [x is None for x in n_chars]
    for name, values in (("lang", lang), ("source", source), ("both", list(zip(lang, source, strict=True)))):
        at = np.array([xxhash.xxh32_intdigest(f"{name}={x}") % CATEGORIES for x in values], dtype=np.int64)
        out[np.arange(n), _META + at] = 1
    return out


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features, by Newton's method, with Platt's recalibration."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    line: tuple[float, float] = (0.0, 1.0)

    @staticmethod
    def _newton(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
        beta = np.zeros(x.shape[1])
        penalty = np.full(x.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            grad = x.T @ (w * (y - p)) - penalty * beta
            step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
            beta += step
            if np.abs(step).max() < 1e-6:
                break
        return beta

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -8, 8)), axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.line[0] + self.line[1] * (self._design(x) @ self.weights)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt's line on rows that weren't fitted on, with smoothed targets."""
        z = np.stack((np.ones(len(x)), self._design(x) @ self.weights), axis=1)
        one = y.sum()
        target = np.where(y == 1, (one + 1) / (one + 2), 1 / (len(y) - one + 2))
        a, b = self._newton(z, target, np.ones(len(y)), 1e-3)
        self.line = (float(a), float(max(b, 0.0)))


Rules = list[list[tuple[np.ndarray, float, float]]]


class Pool:
    """Unlabelled rows, of both views; what is learnt from them are counts and sums, so they may stand anywhere.

    ``rules`` hold, for each view, what the other one taught it in each round: the teacher's weights and the logits from
    which and up to which it names a row 1 and 0. A row keeps its first pseudo-label.
    """

    def __init__(self, views: tuple[np.ndarray, np.ndarray]):
        self.views, self.size = views, len(views[0])

    def taught(self, bases: list[Logistic], rules: Rules) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The views' designs, and the pseudo-labels of each (-1: none)."""
        designs = [b._design(x) for b, x in zip(bases, self.views, strict=True)]
        labels = [np.full(self.size, -1) for _ in rules]
        for v in (0, 1):
            for weights, high, low in rules[v]:
                z = designs[1 - v] @ weights
                labels[v] = np.where(labels[v] >= 0, labels[v], np.where(z >= high, 1, np.where(z <= low, 0, -1)))
        return designs, labels

    def counts(self, bases: list[Logistic], rules: Rules, weights: list[np.ndarray]) -> dict[tuple[int, int], int]:
        """How many rows that view 1 - v has no label for have which logit (in bins) by view v: (v, bin) to count."""
        designs, labels = self.taught(bases, rules)
        out = {}
        for v in (0, 1):
            z = np.floor(np.clip(designs[v] @ weights[v], -30, 30) * BINS).astype(int)[labels[1 - v] < 0]
            out |= {(v, int(x)): int(n) for x, n in zip(*np.unique(z, return_counts=True), strict=True)}
        return out

    def sums(self, bases: list[Logistic], rules: Rules, weights: list[np.ndarray]) -> np.ndarray:
        """Gradient and curvature (its upper triangle) of the pseudo-labels' likelihood, of both views in a row."""
        designs, labels = self.taught(bases, rules)
        return self.likelihood([x[y >= 0] for x, y in zip(designs, labels, strict=True)], [y[y >= 0] for y in labels], weights)

    @staticmethod
    def likelihood(designs: list[np.ndarray], labels: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
        out = []
        for v in (0, 1):
            x, y = designs[v], labels[v]
            p = 1 / (1 + np.exp(-np.clip(x @ weights[v], -30, 30)))
            out += [x.T @ (HALF * (y - p)), ((x * (HALF * p * (1 - p))[:, None]).T @ x)[np.triu_indices(x.shape[1])]]
        return np.concatenate(out)


class TablePool:
    """The same over a table of features (text, meta: float16 as bytes); each task sends its counts or sums.

    The rows that a round's rules label are written once, so that each step of the fit reads those alone.
    """

    def __init__(self, table: DataFrame, widths: tuple[int, int]):
        self.widths, self.size = widths, table.count()
        self.tasks = max(table.sparkSession.sparkContext.defaultParallelism, -(-self.size // SUM_ROWS))
        self.table = table.coalesce(self.tasks)
        self.rounds, self.labelled = None, table

    def _mapped(self, table: DataFrame, of_views, rows_of, schema: str) -> DataFrame:
        """What ``rows_of`` makes of each task's total (if there is any); ``of_views`` adds a slice's views and labels to it."""
        widths = self.widths

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for start in range(0, batch.num_rows, POOL_ROWS):
                    some = batch.slice(start, POOL_ROWS)
                    views = [np.frombuffer(b"".join(some.column(c).to_pylist()), dtype=np.float16).reshape(-1, w).astype(np.float64) for c, w in zip(("text", "meta"), widths, strict=True)]
                    total = of_views(total, views, some)
            if total is not None:
                yield rows_of(total)

        return table.transform(in_arrow, run, schema)

    def counts(self, bases, rules, weights) -> dict[tuple[int, int], int]:
        def of_views(total, views, _):
            more = Pool(tuple(views)).counts(bases, rules, weights)
            return {k: (total or {}).get(k, 0) + more.get(k, 0) for k in {*(total or {}), *more}}

        def rows_of(total):
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["v", "z", "n"])

        got = self._mapped(self.table, of_views, rows_of, "v int, z int, n bigint").groupBy("v", "z").agg(F.sum("n").alias("n"))
        return {(x.v, x.z): x.n for x in got.collect()}

    def _taught(self, bases, rules) -> DataFrame:
        """The rows that the rules label for either view, with both labels (-1: none)."""
        if self.rounds != [len(x) for x in rules]:
            widths = self.widths

            def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for start in range(0, batch.num_rows, POOL_ROWS):
                        some = batch.slice(start, POOL_ROWS)
                        views = [np.frombuffer(b"".join(some.column(c).to_pylist()), dtype=np.float16).reshape(-1, w).astype(np.float64) for c, w in zip(("text", "meta"), widths, strict=True)]
                        labels = Pool(tuple(views)).taught(bases, rules)[1]
                        keep = pa.array((labels[0] >= 0) | (labels[1] >= 0))
                        yield pa.RecordBatch.from_arrays([*(x.filter(keep) for x in (some.column("text"), some.column("meta"), *(pa.array(y, pa.int32()) for y in labels)))], names=["text", "meta", "y0", "y1"])

            self.rounds, self.labelled = [len(x) for x in rules], cut(self.table.transform(in_arrow, run, "text binary, meta binary, y0 int, y1 int"))
        return self.labelled

    def sums(self, bases, rules, weights) -> np.ndarray:
        def of_views(total, views, some):
            labels = [np.asarray(some.column(x)) for x in ("y0", "y1")]
            more = Pool.likelihood([b._design(x[y >= 0]) for b, x, y in zip(bases, views, labels, strict=True)], [y[y >= 0] for y in labels], weights)
            return more if total is None else total + more

        def rows_of(total):
            from pyspark import TaskContext

            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

        def added(group: pa.Table) -> pa.Table:
            return pa.table({"sums": pa.array([sum(np.frombuffer(x) for x in group.column("sums").to_pylist()).tobytes()], pa.binary())})

        got = self._mapped(self._taught(bases, rules), of_views, rows_of, "part int, sums binary")
        if self.tasks > SUMS:
            got = got.groupBy("part").applyInArrow(added, "sums binary")
        size = sum((w + 1) * (w + 4) // 2 for w in self.widths)
        return sum((np.frombuffer(bytes(x.sums)) for x in got.collect()), np.zeros(size))


def _fit_both(views, y: np.ndarray, models: list[Logistic], pool, rules: Rules, ridge: float = 5.0) -> None:
    """Newton's method for both views at once, from 0 in steps of 1 at most: labelled rows here, pseudo-labels by the pool's sums."""
    for m in models:
        m.weights = np.zeros_like(m.weights)
    designs = [m._design(x) for m, x in zip(models, views, strict=True)]
    for _ in range(25):
        weights, most = [m.weights for m in models], 0.0
        more = pool.sums(models, rules, weights) if any(rules) else None
        at = 0
        for v in (0, 1):
            x, beta = designs[v], weights[v]
            d = len(beta)
            penalty = np.full(d, ridge)
            penalty[0] = 1e-6
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            grad, curve = x.T @ (y - p) - penalty * beta, (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
            if more is not None:
                half, upper = np.zeros((d, d)), d * (d + 1) // 2
                half[np.triu_indices(d)] = more[at + d : at + d + upper]
                grad, curve = grad + more[at : at + d], curve + half + np.triu(half, 1).T
                at += d + upper
            step = np.linalg.solve(curve, grad)
            models[v].weights = beta + step / max(1.0, float(np.abs(step).max()))
            most = max(most, float(np.abs(step).max()))
        if most < 1e-4:
            break


def _surest(counts: dict[int, int], ones: int, zeros: int) -> tuple[float, float]:
    """The logits from which and up to which the surest ``ones`` and ``zeros`` rows lie (whole bins, above 1 and below -1)."""
    high, low = float("inf"), float("-inf")
    for z in sorted((z for z in counts if z >= BINS), reverse=True):
        if ones <= 0:
            break
        high, ones = z / BINS, ones - counts[z]
    for z in sorted(z for z in counts if z < -BINS):
        if zeros <= 0:
            break
        low, zeros = np.nextafter((z + 1) / BINS, -np.inf), zeros - counts[z]
    return high, float(low)


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, confident: float = CONFIDENT, pool=None) -> tuple[Logistic, Logistic, np.ndarray]:
    """Both views' classifiers and the weights (intercept, text, metadata) that combine their calibrated logits.

    ``label`` is 1, 0 or -1 (unlabelled); ``pool`` holds the unlabelled rows if they aren't here. Every fifth labelled
    row is held back for calibration. In a round each view is fitted and names its surest rows of either class among all
    unlabelled ones, in the classes' proportion; they join the other view's training rows with half the weight. Features
    are standardised by the labelled training rows, and those of words count less.
    """
    known = np.flatnonzero(label >= 0)
    held, train = known[::5], np.setdiff1d(known, known[::5])
    if len(np.unique(label[held])) < 2 or len(np.unique(label[train])) < 2:
        held = train = known
    pool = Pool((text[label < 0], meta[label < 0])) if pool is None else pool
    base = float(label[train].mean())
    views = (text[train].astype(float), meta[train].astype(float))
    models = [Logistic(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3) * np.where(np.arange(x.shape[1]) < STYLE, 1.0, SHY), np.zeros(x.shape[1] + 1)) for x in views]
    rules: Rules = [[], []]
    for r in range(rounds + 1):
        _fit_both(views, label[train].astype(float), models, pool, rules)
        if r == rounds or not pool.size:
            break
        counts, n = pool.counts(models, rules, [m.weights for m in models]), int(confident * pool.size)
        for v in (0, 1):
            rules[1 - v].append((models[v].weights, *_surest({z: c for (w, z), c in counts.items() if w == v}, round(n * base), round(n * (1 - base)))))
    y = label[held].astype(float)
    for v in (0, 1):
        models[v].calibrate((text, meta)[v][held], y)
    both = np.stack((np.ones(len(held)), models[0].logit(text[held]), models[1].logit(meta[held])), axis=1)
    return *models, Logistic._newton(both, y, np.ones(len(held)), 1.0)


def _views(kept: str, width=np.float32):
    """Each row's column ``kept`` and its views, as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _classes()
        for block in blocks(batches):
            text = text_view(block.column("text"), classes)
            meta = meta_view(*(block.column(x).to_pylist() for x in ("lang", "source", "n_chars")))
            plain = lambda x: pa.array([r.tobytes() for r in x.astype(width)], pa.binary())
            yield pa.RecordBatch.from_arrays([block.column(kept), plain(text), plain(meta)], names=[kept, "text", "meta"])

    return run


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[Logistic, Logistic, np.ndarray] | None:
    """Fit on at most ``labelled`` rows that ``labels`` (doc_id, quality) labels, and all others; None if one class is missing.

    The labelled rows are those with the smallest hashes of their id, so the sample is bounded and the same each time.
    All rows without a label may be pseudo-labelled; their views (about a kilobyte a row) are kept for the rounds. Rows
    with a null id, or labelled but not in the sample, teach nothing; a document with labels that contradict each other
    counts as one without. Other columns are ignored; with an empty table there is no model.
    """
    said = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"), F.max("quality").cast("int").alias("other"))
    known = said.where("label = other").drop("other")
    sample = cut(known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(labelled))
    # The sample is bounded (20,000 ids of 12 bytes by default), so it may be sent to every task.
    used = docs.select("doc_id", *(F.col(x).cast("string") for x in ("text", "lang", "source")), F.col("n_chars").cast("bigint")).where("doc_id IS NOT NULL")
    rows = used.join(F.broadcast(sample), "doc_id").select("label", "text", "lang", "source", "n_chars")
    got = cut(rows.transform(in_arrow, _views("label"), "label int, text binary, meta binary")).toArrow()
    label = np.asarray(got.column("label").combine_chunks())
    if len(set(label.tolist())) < 2:
        return None
    text, meta = (np.frombuffer(b"".join(got.column(x).to_pylist()), dtype=np.float32).reshape(len(label), -1) for x in ("text", "meta"))
    # The rows come in no fixed order: sort them, so that the same table gives the same classifiers.
    turn = np.lexsort((*text[:, :4].T, label))
    kind = dict(docs.dtypes)["doc_id"]
    viewed = used.transform(in_arrow, _views("doc_id", np.float16), f"doc_id {kind}, text binary, meta binary")
    # Labels grow with the corpus: the same join at every size.
    others = cut(viewed.join(known.select("doc_id").hint("merge"), "doc_id", "left_anti").select("text", "meta"))
    return co_train(text[turn], meta[turn], label[turn], pool=TablePool(others, (text.shape[1], meta.shape[1])))


def classify(docs: DataFrame, models: tuple[Logistic, Logistic, np.ndarray] | None, keys: list[str]) -> DataFrame:
    """``keys`` of each row with text_score, meta_score and their combination ``score``: the probability of quality 1.

    Null and empty texts are scored by their (empty) views, nulls of the metadata as a category of their own. Without
    a model every score is 0.5. Repeated rows are scored alike, an empty table gives none; texts are read whole. A key that
    has the name of a result gives way to it.
    """
    plain = None if models is None else ([(m.mean, m.scale, m.weights, m.line) for m in models[:2]], models[2])
    sent = docs.sparkSession.sparkContext.broadcast(plain)

    def start():
        classes = _classes()
        parts, mix = sent.value or (None, None)
        models = [Logistic(*x) for x in parts or ()]

        def run(block: pa.RecordBatch) -> list[pa.Array]:
            n = block.num_rows
            scores = [np.full(n, 0.5)] * 3
            if models:
                meta = meta_view(*(block.column(x).to_pylist() for x in ("lang", "source", "n_chars")))
                z = np.stack((np.ones(n), models[0].logit(text_view(block.column("text"), classes)), models[1].logit(meta)), axis=1)
                scores = [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (z[:, 1], z[:, 2], z @ mix)]
            return [pa.array(x, pa.float64()) for x in scores]

        return run

    inputs = {x: F.col(x).cast("string") for x in ("text", "lang", "source")} | {"n_chars": F.col("n_chars").cast("bigint")}
    return mapped(docs, keys, inputs, start, {"text_score": "double", "meta_score": "double", "score": "double"})
