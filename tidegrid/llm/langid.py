"""Language identification by averaged hashed subword embeddings.

A text's letters, lower-cased and with everything else as a word boundary, give
character n-grams that are hashed into buckets. The mean of the buckets'
embeddings goes through a linear softmax. Embeddings and weights are trained by
stochastic gradient descent in numpy, on whole texts and on stretches drawn from
them. Part of the labelled sample is set aside, whole and in stretches, to fit a
temperature of at least one, so that scores are probabilities, and a rejection
threshold. The threshold parts right predictions from negatives: texts with
shuffled letters, and texts of languages that a second model did not learn, each
group of languages left out in turn. Of all thresholds that reject few of the
right predictions it is the one that also rejects the most negatives; it stays
lower where there are few predictions to judge by.

Training sees a bounded sample of labelled rows (``PER_LANG`` for each language,
lowest hash first; of a text over ``CHARS`` characters a stretch of so many from
a hashed place). Every row's whole text is predicted. For prediction the
embeddings are multiplied into the weights, leaving one row of logits a bucket.

Defined results: a null text, or one without letters, is ``und`` with score 0
and rejected; without any labelled rows all texts are ``und``; repeated rows are
predicted alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.chunks import column_slices

#: Bounds of the labelled sample: rows a language, characters a row; every language is learnt.
PER_LANG, CHARS = 400, 20_000
#: Rows that the cut by hash lets through, as a multiple of those wanted.
SPARE = 4
BUCKETS, DIM, ORDERS = 1 << 16, 16, (2, 3, 4)
EPOCHS, RATE, STRETCHES = 4, 0.5, 4
#: Share of the sample set aside, and of its right predictions that may be rejected.
ASIDE, LOST = 0.2, 0.002
#: The highest threshold, and the number of right predictions at which it is halfway there: few tell little.
CEILING, FEW = 0.7, 25
#: Groups of languages that are left out in turn, epochs of these models, and words of a stretch that counts for the threshold.
LEFT_OUT, FEW_EPOCHS, WORDS = 4, 2, 8
UNKNOWN = "und"
#: Bytes of text predicted at a time: a worker takes about 100 times as much.
SLICE = 250_000


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point -> is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, text of every n-gram), texts in order."""
    joined = "\n\n".join([t.lower().replace("\n", " ") for t in texts])  # a boundary at the end of each text, one at the start of the next
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    line = points == 10
    points = np.where(letters()[points], points, 32)
    space = points == 32
    keep = ~space | line
    keep[1:] |= ~space[:-1]  # one boundary after each word
    text = np.cumsum(line)[keep] // 2
    c = points[keep].astype(np.uint32)
    c, text = np.concatenate([[32], c, [32]]).astype(np.uint32), np.concatenate([text[:1], text, text[-1:]])
    found, whose = [], []
    h = c.copy()
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint32(0x01000193) ^ c[n - 1 :]
        if n in ORDERS:
            own = text[: len(h)] == text[n - 1 :]
            found.append(((h * np.uint32(2654435761)) >> np.uint32(16))[own])
            whose.append(text[: len(h)][own])
    return np.concatenate(found), np.concatenate(whose)


def has_letters(text: str | None) -> bool:
    return bool(text) and (text.isalpha() or any(map(str.isalpha, text)))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[str]) -> np.ndarray:
        b, whose = buckets(texts)
        out = np.zeros((len(texts), len(self.langs)))
        n = np.bincount(whose, minlength=len(texts))[:, None]
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(whose, self.table[:, k][b], len(texts))
        return out / np.maximum(n, 1) + self.bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t in texts:
        found, counts = np.unique(buckets([t])[0], return_counts=True)
        out.append((found, (counts / max(1, counts.sum())).astype(np.float64)))
    return out


def _stretches(text: str, rng: np.random.Generator) -> list[str]:
    words = text.split()
    out = [text]
    for _ in range(STRETCHES):
        n = int(rng.integers(2, 25))
        if len(words) > n:
            at = int(rng.integers(0, len(words) - n))
            out.append(" ".join(words[at : at + n]))
    return out


def _fit(learn: list[tuple[str, str]], rng: np.random.Generator, epochs: int) -> Model:
    """Embeddings and weights by stochastic gradient descent on (text, language)."""
    langs = sorted({y for _, y in learn})
    code = {y: k for k, y in enumerate(langs)}
    bags, ys = _bags([s for s, _ in learn]), [code[y] for _, y in learn]
    share = np.bincount(ys, minlength=len(langs)) / len(ys)
    weight = 1 / np.maximum(share, 1e-9) / np.count_nonzero(share)  # every language weighs the same
    e, w, b = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    steps, step = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            rate = RATE * (1 - step / steps)
            step += 1
            (at, x), y = bags[i], ys[i]
            h = x @ e[at]
            g = softmax((h @ w + b)[None])[0]
            g[y] -= 1
            g *= rate * min(weight[y], 10.0)
            back = w @ g
            w -= np.outer(h, g)
            b -= g
            e[at] -= (x * len(at) ** 0.5)[:, None] * back
    return Model(langs, (e @ w).astype(np.float32), b, 1.0, 0.0)


def _temper(model: Model, held: list[tuple[str, str]]) -> None:
    """The temperature of at least one at which the held texts' languages are likeliest."""
    code = {y: k for k, y in enumerate(model.langs)}
    z, y = model.logits([s for s, _ in held]), np.array([code[y] for _, y in held])
    losses = {t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in np.geomspace(1, 8, 41)}
    model.temperature = float(min(losses, key=losses.get))


def _shuffled(text: str, rng: np.random.Generator) -> str:
    """The text with its letters in another order."""
    points = np.array(list(text))
    own = np.flatnonzero([c.isalpha() for c in text])
    points[own] = points[rng.permutation(own)]
    return "".join(points)


def threshold(right: np.ndarray, negative: np.ndarray, lost: float = LOST) -> float:
    """Of the scores up to the ``lost`` quantile of right ones, that with the fewest errors of both kinds."""
    if not len(right):
        return 0.0
    most = min(CEILING, float(np.quantile(right, lost))) * len(right) / (len(right) + FEW)
    if not len(negative):
        return most
    places = np.unique(np.concatenate([right[right <= most], negative[negative <= most] + 1e-9, [0.0, most]]))
    errors = [(right < t).mean() + (negative >= t).mean() for t in places]
    return float(places[int(np.argmin(errors))])


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model | None:
    """Fit on labelled texts; None where no text has letters."""
    rows = [(t, y) for t, y in zip(texts, labels, strict=True) if has_letters(t)]
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    n = int(len(rows) * ASIDE)
    first = set({y: i for i, (_, y) in reversed(list(enumerate(rows)))}.values())  # every language is learnt
    aside = [r for i, r in enumerate(rows[:n]) if i not in first]
    learn = [(s, y) for i, (t, y) in enumerate(rows) if i >= n or i in first for s in _stretches(t, rng) if has_letters(s)]
    model = _fit(learn, rng, EPOCHS)
    if not aside:
        return model
    held = [(s, y) for t, y in aside for s in _stretches(t, rng) if has_letters(s)]
    _temper(model, held)
    enough = [(s, y) for s, y in held if len(s.split()) >= WORDS]
    if not enough:
        return model
    p = model.probabilities([s for s, _ in enough])
    right = p.max(axis=1)[np.array(model.langs)[p.argmax(axis=1)] == np.array([y for _, y in enough])]
    negative = [model.probabilities([_shuffled(s, rng) for s, _ in enough[:: max(1, len(enough) // 500)]]).max(axis=1)]
    groups = [set(model.langs[k::LEFT_OUT]) for k in range(min(LEFT_OUT, len(model.langs)))] if len(model.langs) > 2 else []
    for out in groups:
        other = _fit([(s, y) for s, y in learn if y not in out], rng, FEW_EPOCHS)
        if strange := [s for s, y in enough if y in out]:
            _temper(other, [(s, y) for s, y in held if y not in out] or held[:0] or [(learn[0][0], other.langs[0])])
            negative.append(other.probabilities(strange).max(axis=1))
    model.threshold = threshold(right, np.concatenate(negative))
    return model


def sample(labelled: DataFrame, per_lang: int = PER_LANG, chars: int = CHARS) -> DataFrame:
    """The bounded training sample of (key, text, lang): lowest hashes of each language.

    Hashes alone are cut, at a share that its language's distinct ones give, and
    ranked; the chosen ones, at most ``per_lang`` times the languages, are broadcast
    to fetch their rows.
    """
    rows = labelled.withColumn("h", F.xxhash64("key", "text"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("m"))
    low = rows.select("lang", "h").join(sizes, "lang").filter(F.col("h") / 2.0**64 + 0.5 < F.lit(float(SPARE * per_lang)) / F.col("m"))
    first = Window.partitionBy("lang").orderBy("h")
    chosen = low.select("lang", "h").distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_lang)
    long = F.length("text") > chars
    part = F.when(long, F.substring(F.col("text"), F.pmod("h", F.length("text") - chars).cast("int") + 1, F.lit(chars))).otherwise(F.col("text"))
    return rows.join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"]).select("key", part.alias("text"), "lang", "h").distinct()


def fit(labelled: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """Train on a bounded sample of (key, text, lang), all not null."""
    chosen = labelled.filter("text IS NOT NULL AND lang IS NOT NULL")
    rows = sorted(sample(chosen, per_lang).collect(), key=lambda r: (r.h, r.text, r.lang))
    if not rows:
        return None
    return train([r.text for r in rows], [r.lang for r in rows])


def predicted(batches: Iterator[pa.RecordBatch], place: int, model: Model | None, names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    """The batches, cut by SLICE, with language, score and rejection of the texts in column ``place``."""
    for batch in batches:
        for lo, hi in column_slices(batch.column(place), SLICE):
            some = batch.column(place).slice(lo, hi - lo).to_pylist()
            lettered = [i for i, t in enumerate(some) if model is not None and has_letters(t)]
            langs, scores, rejected = [UNKNOWN] * len(some), [0.0] * len(some), [True] * len(some)
            if lettered:
                p = model.probabilities([some[i] for i in lettered])
                for i, k, s in zip(lettered, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                    langs[i], scores[i], rejected[i] = model.langs[k], s, s < model.threshold
            own = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(langs), pa.array(scores, pa.float64()), pa.array(rejected)], [*batch.schema.names, *names])


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with the columns ``names``, which replace any of these names; others pass unchanged."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)  # buckets x languages floats
    docs = docs.drop(*names)
    place = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return predicted(batches, place, shipped.value, names)

    kinds = zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)
    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in kinds)]))


def held_out(id_col: str, folds: int = 5, fold: int = 0):
    """crc32 of the id as text modulo ``folds`` is ``fold``; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
