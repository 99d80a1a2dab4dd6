"""Language identification: script ranges narrow the candidates, Viterbi over word scores labels the spans."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import blocks, bounds, coded, cut, in_arrow, mapped, tidied, words

UNKNOWN = "und"
#: Character n-grams (within ``^word$``) are counted in this many hash buckets, or in fewer, so that the model of all
#: languages holds CELLS numbers at most (16 MB); LANGS languages at most can be told apart.
BUCKETS, CELLS, LANGS = 1 << 18, 1 << 22, 4096
#: Languages whose counts (2 MB each) a task holds before it sends them.
HELD = 32
ORDERS = (1, 2, 3, 4)
#: What a change of language costs, in nats, and the most that one word can say for one language against another.
SWITCH, MOST = 12.0, 8.0
#: First code points of groups of Unicode blocks and their scripts (fixed values of the Unicode standard).
SCRIPTS = (
    (0x0000, "other"), (0x0041, "latin"), (0x0250, "latin"), (0x02B0, "other"), (0x0370, "greek"), (0x0400, "cyrillic"),
    (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"),
    (0x07C0, "nko"), (0x0800, "samaritan"), (0x0840, "mandaic"), (0x0860, "syriac"), (0x0870, "arabic"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"), (0x1400, "canadian"),
    (0x1680, "ogham"), (0x16A0, "runic"), (0x1700, "tagalog"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "canadian"),
    (0x1900, "limbu"), (0x1950, "tai le"), (0x1980, "new tai lue"), (0x19E0, "khmer"), (0x1A00, "buginese"), (0x1A20, "tai tham"),
    (0x1AB0, "other"), (0x1B00, "balinese"), (0x1B80, "sundanese"), (0x1BC0, "batak"), (0x1C00, "lepcha"), (0x1C50, "ol chiki"),
    (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "sundanese"), (0x1CD0, "other"), (0x1D00, "latin"), (0x1DC0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C00, "glagolitic"), (0x2C60, "latin"), (0x2C80, "coptic"),
    (0x2D00, "georgian"), (0x2D30, "tifinagh"), (0x2D80, "ethiopic"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x2E80, "han"),
    (0x3000, "other"), (0x3005, "han"), (0x3008, "other"), (0x3040, "kana"), (0x3100, "bopomofo"), (0x3130, "hangul"),
    (0x3190, "other"), (0x31A0, "bopomofo"), (0x31C0, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"),
    (0x4DC0, "other"), (0x4E00, "han"), (0xA000, "yi"), (0xA4D0, "lisu"), (0xA500, "vai"), (0xA640, "cyrillic"),
    (0xA6A0, "bamum"), (0xA700, "other"), (0xA720, "latin"), (0xA800, "syloti"), (0xA830, "other"), (0xA840, "phags-pa"),
    (0xA880, "saurashtra"), (0xA8E0, "devanagari"), (0xA900, "kayah li"), (0xA930, "rejang"), (0xA960, "hangul"), (0xA980, "javanese"),
    (0xA9E0, "myanmar"), (0xAA00, "cham"), (0xAA60, "myanmar"), (0xAA80, "tai viet"), (0xAAE0, "meetei"), (0xAB00, "ethiopic"),
    (0xAB30, "latin"), (0xAB70, "cherokee"), (0xABC0, "meetei"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"),
    (0xFEFF, "other"), (0xFF21, "latin"), (0xFF5B, "other"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"),
    (0x10000, "linear b"), (0x10100, "other"), (0x10280, "lycian"), (0x10300, "old italic"), (0x10330, "gothic"), (0x10350, "old permic"),
    (0x10380, "cuneiform"), (0x10400, "deseret"), (0x10450, "shavian"), (0x10480, "osmanya"), (0x104B0, "osage"), (0x10500, "other"),
    (0x10780, "latin"), (0x107C0, "other"), (0x10D00, "hanifi"), (0x10D40, "other"), (0x11000, "brahmi"), (0x11080, "kaithi"),
    (0x110D0, "sora"), (0x11100, "chakma"), (0x11180, "sharada"), (0x11200, "other"), (0x11400, "newa"), (0x11480, "tirhuta"),
    (0x11580, "other"), (0x12000, "cuneiform"), (0x13000, "hieroglyphs"), (0x14400, "other"), (0x16800, "bamum"), (0x16A40, "other"),
    (0x16F00, "miao"), (0x16FA0, "other"), (0x17000, "tangut"), (0x18D80, "other"), (0x1AFF0, "kana"), (0x1B170, "nushu"),
    (0x1B300, "other"), (0x1D400, "latin"), (0x1D6A8, "greek"), (0x1D7CC, "other"), (0x1E900, "adlam"), (0x1E960, "other"),
    (0x1EE00, "arabic"), (0x1EF00, "other"), (0x20000, "han"), (0x323B0, "other"),
)
_STARTS = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({b for _, b in SCRIPTS})
_CODES = np.array([_NAMES.index(b) for _, b in SCRIPTS])
RESULTS = {"lang_pred": "string", "score": "double", "spans": "array<struct<lang:string,first_word:int,words:int>>"}
_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32())]))
_COUNTS = "lang string, kind int, item bigint, n bigint"


def _points(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``^word$`` for each item, and where each begins (and the last one ends)."""
    text = f"^{'$^'.join(items)}$" if items else ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return points, np.cumsum(np.fromiter(map(len, ["", *items]), dtype=np.int64, count=len(items) + 1) + 2) - 2


def _grams(points: np.ndarray, begins: np.ndarray, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of the n-grams, word by word, and how many each word has."""
    size = np.diff(begins)
    owner = np.repeat(np.arange(len(size)), size)
    for n in ORDERS:
        last = len(points) - n + 1
        if last <= 0:
            continue
        h = np.full(last, n, dtype=np.uint64)
        for k in range(n):
            h ^= points[k : k + last]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = owner[:last] == owner[n - 1 :]
        if n == 1:  # the two word marks say nothing alone
            inside[begins[:-1]] = inside[begins[1:] - 1] = False
        yield (h & np.uint64(buckets - 1)).astype(np.int32)[inside], size - 2 if n == 1 else np.maximum(size - n + 1, 0)


def _scripts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The script of each word: that of its last letter outside ``other``, as a code."""
    if len(begins) < 2:
        return np.empty(0, dtype=np.int64)
    code = _CODES[np.searchsorted(_STARTS, points, side="right") - 1]
    other = _NAMES.index("other")
    at = np.where((code != other) & (points != ord("^")), np.arange(len(points)), -1)
    last = np.maximum.reduceat(at, begins[:-1])
    return np.where(last >= begins[:-1], code[np.maximum(last, 0)], other)


def _letters(items: list[str]) -> np.ndarray:
    """Letters in each word."""
    return np.fromiter((len(x) if x.isalpha() else sum(unicodedata.category(c)[0] == "L" for c in x) for x in items), dtype=np.int64, count=len(items))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each language what one task has read: n-gram buckets (kind 0), words by script (1), all n-grams (2)."""
    counts: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, count in counts.items():
            for kind, values in ((0, count), (1, scripts[lang])):
                at = np.flatnonzero(values)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([kind] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(values[at].astype(np.int64))], names=["lang", "kind", "item", "n"])
        counts.clear()
        scripts.clear()

    for block in blocks(batches):
        items, rows = words(block.column("text"))
        langs = np.array(block.column("lang").to_pylist(), dtype=object)[rows]
        uniq, index = coded(items)
        if not uniq:
            continue
        points, begins = _points(uniq)
        found, script = list(_grams(points, begins)), _scripts(points, begins)
        for lang in set(langs.tolist()):
            seen = np.bincount(index[langs == lang], minlength=len(uniq))
            if lang not in counts:
                counts[lang], scripts[lang] = np.zeros(BUCKETS), np.zeros(len(_NAMES))
            for bucket, size in found:
                counts[lang] += np.bincount(bucket, weights=np.repeat(seen, size), minlength=BUCKETS)
            scripts[lang] += np.bincount(script, weights=seen, minlength=len(_NAMES))
        if len(counts) > HELD:
            yield from counted()
    yield from counted()


@dataclass
class LanguageModel:
    """Log shares of n-gram buckets by language, and which languages use which script."""

    langs: list[str]
    table: np.ndarray  # buckets x languages, log shares
    allowed: np.ndarray  # scripts x languages

    def word_scores(self, items: list[str], letters: np.ndarray) -> np.ndarray:
        """Words x languages: log-likelihoods, the best at 0, none below -MOST; a script's languages alone compete."""
        score = np.zeros((len(items), len(self.langs)), dtype=np.float32)
        if not score.size:
            return score
        points, begins = _points(items)
        for bucket, size in _grams(points, begins, len(self.table)):
            some = np.flatnonzero(size)
            if len(some):
                score[some] += np.add.reduceat(self.table[bucket], np.cumsum(size[some]) - size[some], axis=0)
        score /= len(ORDERS) / 2  # n-grams of several orders tell the same letters again
        allowed = self.allowed[_scripts(points, begins)]
        allowed |= ~allowed.any(axis=1, keepdims=True)
        score[~allowed] = -np.inf
        score -= score.max(axis=1, keepdims=True)
        np.maximum(score, -MOST, out=score)
        score[letters == 0] = 0.0  # digits say nothing
        return score


def train(docs: DataFrame, share: float = 1e-4) -> LanguageModel:
    """Count n-grams over all of ``docs`` (text, lang) and keep one bounded table: buckets x languages.

    The more languages, the fewer buckets, so that the table's size is the same for 16 languages and for all of LANGS;
    with more than those, ``lang`` isn't a language and a ValueError says so. Rows with a null text or lang teach nothing;
    from an empty table no language is learnt. A language may use a script that writes at least ``share`` of its words.
    Other columns are ignored.
    """
    counted = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    sums = cut(counted.transform(in_arrow, tidied(_count), _COUNTS).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")))
    langs = [x.lang for x in sums.select("lang").distinct().orderBy("lang").limit(LANGS + 1).collect()]
    if len(langs) > LANGS:
        raise ValueError(f"more than {LANGS} languages")
    buckets = BUCKETS
    while buckets * len(langs) > CELLS:
        buckets //= 2
    item = F.when(F.col("kind") == 0, F.col("item").bitwiseAND(F.lit(buckets - 1))).otherwise(F.col("item")).alias("item")
    got = sums.groupBy("lang", "kind", item).agg(F.sum("n").alias("n")).toPandas()
    table, scripts = np.zeros((buckets, len(langs))), np.zeros((len(_NAMES), len(langs)))
    column = got["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(np.int64)
    for kind, to in ((0, table), (1, scripts)):
        at = got["kind"].to_numpy() == kind
        to[got["item"].to_numpy(np.int64)[at], column[at]] = got["n"].to_numpy(float)[at]
    used = (table.sum(axis=1) > 0).sum()
    table = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * max(1, used)))
    allowed = scripts >= share * np.maximum(1, scripts.sum(axis=0))
    return LanguageModel(langs, table.astype(np.float32), allowed & (scripts > 0))


def viterbi(score: np.ndarray, begins: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language for each word, document by document; ties go to the earlier language and to staying.

    A document keeps one language throughout where no stretch of words gains more than one switch by another: that is
    tested at once for all documents. The others are decoded word by word, in step with each other.
    """
    n, (total, langs) = len(begins) - 1, score.shape
    out = np.zeros(total, dtype=np.int64)
    if not total or langs < 2:
        return out
    size = np.diff(begins)
    some = np.flatnonzero(size)
    sums = np.add.reduceat(score, begins[some], axis=0, dtype=np.float64)
    best = np.zeros(n, dtype=np.int64)
    best[some] = sums.argmax(axis=1)
    doc = np.repeat(np.arange(n), size)
    out[:] = best[doc]
    open_ = np.zeros(n, dtype=bool)
    own = score[np.arange(total), best[doc]]
    for k in range(langs):
        run = np.cumsum(score[:, k] - own, dtype=np.float64)
        base = np.concatenate(([0.0], run))[begins[some]]
        # Largest rise within a document: a running minimum that starts anew, by an offset that falls with each document.
        far = (np.ptp(run) + 1.0) * np.arange(len(some))
        inner = run - np.repeat(base + far, size[some])
        low = np.minimum.accumulate(np.minimum(np.concatenate(([0.0], inner[:-1])), -np.repeat(far, size[some])))
        open_[some[np.maximum.reduceat(inner - low, begins[some]) > switch]] = True
    todo = np.flatnonzero(open_)
    todo = todo[np.argsort(-size[todo], kind="stable")]
    if not len(todo):
        return out
    length, start = size[todo], begins[todo]
    value = score[start].astype(np.float64)
    back = [None]
    for t in range(1, int(length[0])):
        m = int(np.searchsorted(-length, -t, side="left"))
        v = value[:m]
        top = v.argmax(axis=1)
        jump = v[np.arange(m), top] - switch
        stay = v >= jump[:, None]
        back.append(np.where(stay, np.arange(langs), top[:, None]).astype(np.int16))
        value[:m] = np.where(stay, v, jump[:, None]) + score[start[:m] + t]
    now = value.argmax(axis=1)
    for t in range(int(length[0]) - 1, -1, -1):
        m = int(np.searchsorted(-length, -t, side="left"))
        out[start[:m] + t] = now[:m]
        if t:
            now[:m] = back[t][np.arange(m), now[:m]]
    return out


def _label(model: LanguageModel, texts: pa.Array, switch: float, spans: bool) -> list[pa.Array]:
    """The results for some texts."""
    items, rows = words(texts)
    uniq, index = coded(items)
    n, langs = len(texts), len(model.langs)
    begins = bounds(rows, n)
    length = _letters(uniq)
    weights = length[index] if uniq else np.empty(0, np.int64)
    score = model.word_scores(uniq, length)[index] if uniq else np.zeros((0, langs), np.float32)
    path = viterbi(score, begins, switch)
    letters = np.bincount(rows, weights=weights, minlength=n)
    names, sure, found = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
    if langs:
        share = np.bincount(rows * langs + path, weights=weights, minlength=n * langs).reshape(n, langs)
        top = share.argmax(axis=1)
        total = np.zeros((n, langs))
        for k in range(langs):
            total[:, k] = np.bincount(rows, weights=score[:, k], minlength=n)
        main = share.max(axis=1) / np.maximum(letters, 1)
        posterior = 1 / np.exp(np.clip(total - total[np.arange(n), top][:, None], -60, 60)).sum(axis=1)
        sure = np.where(main == 1, posterior, main)
        names = [model.langs[k] if a else UNKNOWN for k, a in zip(top, letters > 0, strict=True)]
    if spans:
        turn = np.flatnonzero(np.concatenate(([True], (np.diff(path) != 0) | (np.diff(rows) != 0)))) if len(path) else np.empty(0, int)
        for a, b in zip(turn, np.append(turn[1:], len(path))[: len(turn)], strict=True):
            found[rows[a]].append({"lang": model.langs[path[a]] if langs else UNKNOWN, "first_word": int(a - begins[rows[a]]), "words": int(b - a)})
    return [pa.array(names, pa.string()), pa.array(sure, pa.float64()), pa.array(found if spans else [None] * n, _SPANS)]


def identify(docs: DataFrame, model: LanguageModel, keys: list[str], switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """``keys`` of each row of ``docs`` with lang_pred, score (0 to 1) and the spans of one language.

    Words are runs of letters, marks and digits. lang_pred is the language with most letters on the best path; score
    is its share of the letters, times its posterior where the whole text is one language. A text that is null, empty
    or without a letter gives ``und`` and 0, as does every text if the model has seen no language. Repeated rows give
    repeated results, an empty table none; texts are read whole. A key that has the name of a result gives way to it.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.allowed))

    def start():
        model = LanguageModel(*sent.value)
        return lambda block: _label(model, block.column("text"), switch, spans)

    return mapped(docs, keys, {"text": F.col("text").cast("string")}, start, RESULTS, tidy=True)


def learnable(docs: DataFrame, rule: Column) -> DataFrame:
    """Rows to learn from: ``rule`` has to hold; where it is null (no id) it doesn't."""
    return docs.where(F.coalesce(rule, F.lit(False)))
