"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's features are its words' letter n-grams with word borders, hashed to
buckets. Each bucket has an embedding; a text is the mean of its embeddings and
a linear layer with softmax gives the languages. The model is trained in numpy
by stochastic gradient descent on a bounded sample of labelled texts. For
prediction the linear layer is folded into the embeddings, so a whole text is
one gather and one sum.

Calibration: on labelled texts kept from training, a temperature is fitted by
likelihood, and the score below which a text is rejected is set so that at most
``reject_rate`` of those that are labelled rightly would go, and at most a fifth
of the way from chance to certainty, so that texts in two languages stay. A text
with less than half the share of known n-grams that such texts have at the
same rate is in no language that was learnt, and is rejected as well.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .store import map_batches

NONE = "und"
_U = np.uint64
#: Bytes of words for this purpose: ASCII letters and everything beyond ASCII.
_LETTER = B.ALNUM.copy()
_LETTER[0x30:0x3A] = False
_SIZES = (2, 3, 4)
_MULT = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x27D4EB2F165667C5))


def features(buf: np.ndarray, at: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, text of each): byte n-grams within ``_word_``, A-Z lower-cased; ``dims`` is a power of two."""
    low = B.LOWER[buf]
    low = np.where(_LETTER[low], low, np.uint8(95))  # every other byte is a border
    wide = low.astype(_U)
    inner = _LETTER[low]
    shift = _U(64 - (dims.bit_length() - 1))
    owner = np.zeros(len(buf), np.int32)
    owner[at[1:]] = 1
    owner = np.cumsum(owner, dtype=np.int32)
    hashed, owners = [], []
    for n in _SIZES:
        h = np.full(max(0, len(buf) - n + 1), n, _U)
        good = np.ones(len(h), bool)
        for k in range(n):
            h = h * _MULT[0] + wide[k : k + len(h)]
            if 0 < k < n - 1:
                good &= inner[k : k + len(h)]  # a border is only first or last
        good &= inner[: len(h)] | inner[n - 1 : n - 1 + len(h)]
        pick = np.flatnonzero(good)
        h = h[pick]
        h ^= h >> _U(29)
        hashed.append((h * _MULT[1]) >> shift)
        owners.append(owner[pick + (n > 1)])  # the second byte: the border before a text is the last text's
    return np.concatenate(hashed).astype(np.int64), np.concatenate(owners)


#: Bytes of texts that are judged at once; numbers of each byte's n-grams are held meanwhile.
_BLOCK = 1 << 18


@dataclass(frozen=True)
class Model:
    langs: list[str]
    table: np.ndarray  # dims x languages: embeddings times the linear layer, over the temperature
    bias: np.ndarray
    threshold: float
    seen: np.ndarray  # buckets that training met
    least_known: float  # share of n-grams in such buckets below which a text is rejected

    def logits(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages, share of n-grams of each that training met)."""
        h, owner = features(buf, at, len(self.table))
        n = np.bincount(owner, minlength=len(at))
        sums = np.stack([np.bincount(owner, self.table[h, k], len(at)) for k in range(len(self.langs))], axis=1)
        return sums / np.maximum(n, 1)[:, None] + self.bias, np.bincount(owner, self.seen[h], len(at)) / np.maximum(n, 1)

    def predict(self, buf: np.ndarray, at: np.ndarray, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, whether rejected) of each text."""
        z, known = self.logits(buf, at)
        p = _softmax(z)
        best = p.argmax(axis=1)
        score = p[np.arange(len(p)), best]
        named = [self.langs[k] if has_letter(t) else NONE for k, t in zip(best.tolist(), texts, strict=True)]
        none = np.array([x == NONE for x in named], bool)
        return named, np.where(none, 0.0, score), none | (score < self.threshold) | (known < self.least_known)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _bags(texts: list[str], dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares."""
    out = []
    for a in range(0, len(texts), 256):
        batch = pa.record_batch({"text": pa.array(texts[a : a + 256], pa.string())})
        for _, buf, at in B.blocks(batch, "text"):
            h, owner = features(buf, at, dims)
            order = np.argsort(owner, kind="stable")
            for own in np.split(h[order], np.searchsorted(owner[order], np.arange(1, len(at)))):
                k, n = np.unique(own, return_counts=True)
                out.append((k, n / max(1, n.sum())))
    return out


def fit(texts: list[str], labels: list[str], dims: int = 1 << 16, width: int = 16, epochs: int = 8, rate: float = 4.0, reject_rate: float = 0.001, seed: int = 7) -> Model:
    """Train on (text, label) pairs, a fifth of which is kept for calibration."""
    langs = sorted(set(labels))
    if not langs:
        return Model([NONE], np.zeros((dims, 1)), np.zeros(1), 0.0, np.zeros(dims, bool), 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(x) for x in labels])
    bags = _bags(texts, dims)
    order = rng.permutation(len(bags))
    held, own = order[: len(order) // 5], order[len(order) // 5 :]
    embed = rng.normal(0, 1 / width, (dims, width))
    layer, bias = rng.normal(0, 1 / np.sqrt(width), (width, len(langs))), np.zeros(len(langs))
    step = 0
    for _ in range(epochs):
        for i in rng.permutation(own):
            k, share = bags[i]
            lr = rate * (1 - step / (epochs * len(own)))
            step += 1
            mean = share @ embed[k]
            err = _softmax((mean @ layer + bias)[None])[0]
            err[y[i]] -= 1
            back = layer @ err
            layer -= lr * 0.1 * np.outer(mean, err)
            bias -= lr * 0.01 * err
            embed[k] -= lr * share[:, None] * back
    seen = np.zeros(dims, bool)
    for i in own:
        seen[bags[i][0]] = True
    table = (embed @ layer) * seen[:, None]  # an n-gram that training never met says nothing
    check = held if len(held) else own
    z = np.stack([s @ table[k] + bias for k, s in (bags[i] for i in check)])
    temperature = min(np.geomspace(0.05, 20, 61), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(check)), y[check]] + 1e-300).mean())
    p = _softmax(z / temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[check]])
    chance = 1 / len(langs)
    threshold = min(chance + 0.2 * (1 - chance), float(right[int(reject_rate * len(right))])) if len(right) else 0.0
    known = np.sort([float(share[seen[k]].sum()) for k, share in (bags[i] for i in check)])
    least_known = float(known[int(reject_rate * len(known))]) / 2 if len(known) else 0.0
    return Model(langs, table / temperature, bias / temperature, threshold, seen, least_known)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, a_language: int) -> list:
    """The ``a_language`` labelled rows of each language that come first by a hash of the id, then by text; fewer if it has fewer.

    Rows past a threshold on the hash, set from the counts, go before any sort,
    and each task keeps its first rows of a language before they meet. Only the
    chosen rows come to the driver, with their whole texts.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 40)).alias("at"))
    # one number a language, as the model has
    counts = sorted((r.lang, r.n) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())
    if not counts:
        return []
    # twice as many rows as are wanted lie below the cut, or all; where ids repeat and too few do, all are taken
    cuts = [1 << 40 if n < 20 * a_language else int((1 << 40) * 2 * a_language / n) for _, n in counts]
    langs = F.array(*(F.lit(lang) for lang, _ in counts))
    cut = F.get(F.split(F.lit(" ".join(map(str, cuts))), " ").cast("array<long>"), F.array_position(langs, F.col("lang")).cast("int") - 1)
    best = Window.partitionBy("lang").orderBy("at", "text")

    def first(some: DataFrame) -> list:
        return some.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= a_language).drop("k").collect()

    got = first(rows.filter(F.col("at") < cut))
    have = Counter(r.lang for r in got)
    short = [lang for lang, n in counts if have[lang] < min(n, a_language)]
    if short:
        got = [r for r in got if r.lang not in short] + first(rows.filter(F.col("lang").isin(short)))
    return sorted(got, key=lambda r: (r.lang, r.at, r.text))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", a_language: int = 500, **named) -> Model:
    """Fit on the labelled rows of ``docs``; the sample's bound is ``a_language`` rows a language.

    Every language with a labelled row is learnt, from whole texts. The model has
    ``dims`` numbers for each. Rows that repeat count as often as they stand.
    """
    got = sample(docs, id_col, text_col, lang_col, a_language)
    return fit([r.text for r in got], [r.lang for r in got], **named)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Model, text_col: str = "text", column: str = "language") -> DataFrame:
    """``docs`` with a struct ``column``: lang, score (0 to 1), rejected.

    Only the text is read for it, to its end. A null text, or one without a
    letter, is ``und`` with score 0 and rejected; so is a text whose score or
    share of known n-grams is below the model's, which keeps its likeliest language. All
    columns of ``docs`` are kept; one that is called ``column`` is replaced. Rows
    that repeat are judged alike; an empty table gives no rows.
    """
    docs = docs.drop(column)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for rows, buf, at in B.blocks(batch, text_col, _BLOCK):
                langs, score, rejected = m.predict(buf, at, rows.column(text_col).to_pylist())
                out = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*rows.columns, out], names=[*rows.schema.names, column])
        B.release()

    return map_batches(docs, judge, T.StructType([*docs.schema.fields, T.StructField(column, T.StructType.fromDDL("lang string, score double, rejected boolean"))]))
