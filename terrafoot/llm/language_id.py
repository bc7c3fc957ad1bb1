"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

The model is sparse: it is trained with follow-the-regularised-leader under elastic-net penalties on
a bounded sample of labelled rows, and its probabilities are calibrated by one temperature fitted on
labelled rows that training leaves out. Prediction reads every whole text, with the model (of fixed
size) sent to each task.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafoot.llm.common import buffers, cut, local, pieces

#: Bounds of the fit: labelled rows in the sample (about) and the least for each language,
#: which counts where there are very many languages; buckets of n-grams.
SAMPLE_ROWS, LEAST_ROWS, BITS = 4096, 8, 16
ORDERS = (1, 2, 3)
#: Bytes of texts that are predicted together, characters of a text in hand at a time, weights in hand at a time.
CHUNK, SLICE, WEIGHTS = 1 << 18, 1 << 18, 1 << 20
SCALE = 30.0


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The text and the bucket of each n-gram, in slices of a fixed number of characters.

    Texts are lower-cased; what is no letter separates words, and each word has one blank on either
    side. A text without letters has no n-grams. A long text is cut anywhere: what n-grams need of the
    slice before goes over to the next one.
    """
    texts = [" " + (t or "").lower() + " " for t in texts]
    joined = "".join(texts)
    edges = np.cumsum([0, *(len(t) for t in texts)])
    del texts
    before, owners, codes = False, np.zeros(0, np.int64), np.zeros(0, np.uint64)  # the last characters kept, for the next slice
    for at in range(0, len(joined), SLICE):
        part = joined[at : at + SLICE]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        own = edges.clip(at, at + len(points)) - at
        owner = np.repeat(np.arange(len(edges) - 1), np.diff(own))
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the one blank behind a word
        keep[0] |= before
        keep[own[(edges >= at) & (edges < at + len(points))]] = True  # the blank before a text
        before = bool(letter[-1])
        old = len(codes)
        owners = np.concatenate([owners, owner[keep]])
        codes = np.concatenate([codes, np.where(letter, points, 32)[keep].astype(np.uint64)])
        gram = np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, max(ORDERS) + 1):
                gram = gram[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] if n > 1 else codes
                if n in ORDERS and len(gram):
                    fresh = max(0, old - n + 1)  # those that end in this slice
                    h = (gram[fresh:] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                    inside = owners[fresh : len(gram)] == owners[fresh + n - 1 :]
                    yield owners[fresh : len(gram)][inside], (h >> np.uint64(64 - BITS)).astype(np.int64)[inside]
        owners, codes = owners[-(max(ORDERS) - 1) :], codes[-(max(ORDERS) - 1) :]


def lettered(texts: list[str | None]) -> np.ndarray:
    """Whether each text has a letter."""
    return np.array([any(map(str.isalpha, t)) for t in (t or "" for t in texts)], bool)


def _rows(column: pa.Array):
    at, _ = buffers(column)
    for s, e in pieces(at, CHUNK):
        yield s, e, column[s:e].to_pylist()


@dataclass
class Model:
    """A language's name, and its whole-numbered weights (``unit`` each): sums don't depend on their order."""

    languages: list[str]
    weights: np.ndarray  # (buckets, languages), inverse document frequency and scale included
    unit: float
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        kinds = len(self.languages)
        if not kinds or not texts:
            return ["und"] * len(texts), [0.0] * len(texts)
        total = np.zeros(len(texts), np.int64)
        sums = np.zeros((len(texts), kinds), np.int64)
        step = max(1, WEIGHTS // kinds)
        for owner, bucket in ngrams(texts):
            total += np.bincount(owner, minlength=len(texts))
            for i in range(0, len(owner), step):
                own = owner[i : i + step]  # in the order of the texts
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                sums[own[first]] += np.add.reduceat(self.weights[bucket[i : i + step]], first, axis=0, dtype=np.int64)
        some = lettered(texts)
        p = _softmax((sums * self.unit / np.maximum(total, 1)[:, None] + self.bias) / self.temperature)
        best = p.argmax(1)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, some, strict=True)], np.where(some, p[np.arange(len(p)), best], 0.0).tolist()


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per labelled text its distinct buckets and their shares of all its n-grams."""
    for batch in batches:
        for s, e, texts in _rows(batch.column("text")):
            index, share = [], []
            for text, some in zip(texts, lettered(texts), strict=True):
                counts = np.zeros(1 << BITS, np.int64)
                for _, bucket in ngrams([text]) if some else ():
                    counts += np.bincount(bucket, minlength=1 << BITS)
                at = np.flatnonzero(counts)
                index.append(at.astype(np.int32).tobytes())  # packed: the driver gets bytes, not numbers one by one
                share.append((counts[at] / max(1, counts.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang")[s:e], batch.column("order")[s:e], pa.array(index, pa.binary()), pa.array(share, pa.binary())], ["lang", "order", "index", "share"])


def held_back(langs: list[str], hold: int = 8) -> list[bool]:
    """Marks every ``hold``-th row, but for the last row that a language has left; none where there are few rows."""
    left = collections.Counter(langs)
    out = []
    for i, lang in enumerate(langs):
        out.append(len(langs) >= 4 * hold and i % hold == 0 and left[lang] > 1)
        left[lang] -= out[-1]
    return out


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, hold: int = 8) -> Model:
    """FTRL-proximal on rows (language, buckets, shares); :func:`held_back` rows calibrate the temperature, all languages are trained.

    State is kept for the buckets that occur, in single precision.
    """
    names = sorted({lang for lang, _, _ in rows})
    code = {x: k for k, x in enumerate(names)}
    kinds = len(names)
    back = held_back([lang for lang, _, _ in rows], hold)
    held, own = ([r for r, b in zip(rows, back, strict=True) if b is side] for side in (True, False))
    df = np.zeros(1 << BITS)
    for _, at, _ in own:
        df[at] += 1
    idf = np.log((1 + len(own)) / (1 + df)) + 1
    seen = np.flatnonzero(df)
    place = np.zeros(1 << BITS, np.int64)
    place[seen] = np.arange(len(seen))
    size = len(seen)
    z, n = np.zeros((size + 1, kinds), np.float32), np.zeros((size + 1, kinds), np.float32)  # the last row is the bias, which no penalty shrinks

    def solved(z, n, l1=l1, l2=l2):
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(own)):
            lang, at, share = own[i]
            x, at = share * idf[at] * SCALE, place[at]
            w, b = solved(z[at], n[at]), solved(z[size], n[size], 0, 0)
            error = _softmax(x @ w + b)
            error[code[lang]] -= 1
            for rows_at, g, old in ((at, x[:, None] * error, w), (size, error, b)):
                sigma = (np.sqrt(n[rows_at] + g * g) - np.sqrt(n[rows_at])) / alpha
                z[rows_at] += g - sigma * old
                n[rows_at] += g * g
    bias = solved(z[size], n[size], 0, 0).astype(float)
    step = max(1, WEIGHTS // max(1, kinds))

    def weighed(s: int) -> np.ndarray:
        return solved(z[s : min(s + step, size)], n[s : min(s + step, size)]) * idf[seen[s : s + step], None] * SCALE

    unit = max([float(np.abs(weighed(s)).max(initial=0.0)) for s in range(0, size, step)], default=0.0)
    unit = max(unit, 1e-9) / (1 << 30)
    weights = np.zeros((1 << BITS, kinds), np.int32)
    for s in range(0, size, step):
        weights[seen[s : s + step]] = np.rint(weighed(s) / unit)
    logits = np.array([share @ (weights[at] * unit) + bias for _, at, share in held]).reshape(-1, kinds)
    truth = np.array([code[lang] for lang, _, _ in held], int)

    def loss(t):
        return -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(truth)), truth], 1e-12)).sum() + t * t  # a weak pull to 1, for separable rows

    lo, hi = -3.0, 3.0
    for _ in range(60 if len(held) else 0):  # golden section over log temperature
        a, b = hi - (hi - lo) * 0.618, lo + (hi - lo) * 0.618
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return Model(names, weights, unit, bias, float(np.exp((lo + hi) / 2)) if len(held) else 1.0)


def _smallest(places: DataFrame, counts: dict[str, int], each: int) -> DataFrame:
    """(lang, limit): the hash up to which a language has ``each`` rows, or all that it has.

    Only hashes below a share of their range that holds several times as many rows are ranked, so that
    no task ranks a language's rows; a language in which that share held too few tries a larger one.
    """
    spark, schema = places.sparkSession, pa.schema({"lang": pa.string(), "below": pa.int64()})
    share = {lang: (4 * each + 64) / n for lang, n in counts.items()}
    while True:
        bounds = local(spark, schema, [(lang, min(1 << 32, int(x * (1 << 32)) + 1)) for lang, x in share.items()])
        near = cut(places.join(F.broadcast(bounds), "lang").where("order < below").select("lang", "order"), "language-near")
        found = dict(near.groupBy("lang").count().collect())
        few = [lang for lang, n in counts.items() if found.get(lang, 0) < min(each, n)]
        if not few:
            break
        share |= {lang: 8 * share[lang] for lang in few}
    first = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).where(F.col("place") <= each)
    limits = first.groupBy("lang").agg(F.max("order").alias("limit")).collect()  # one row for each language
    return local(spark, pa.schema({"lang": pa.string(), "limit": pa.int64()}), [tuple(r) for r in limits])


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, least_rows: int = LEAST_ROWS) -> Model:
    """A model of the rows where ``learn`` holds, the language is not null and the text has a letter, for all languages that have such a row.

    The sample takes an equal share of each language: the rows of smallest hash of the id, about
    ``sample_rows`` in all, or ``least_rows`` a language where that is more; all of a language that has
    fewer. Rows of a language that share an id count as one, the text of smallest hash. The driver
    holds the sample and about 1 MB of state a language; the model takes 256 KB a language. Without
    any row, as of an empty table, the model knows no language.
    """
    spark = docs.sparkSession
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 32)).alias("order"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    places = cut(rows.select("lang", "order").distinct(), "language-places")
    counts = {r["lang"]: r["count"] for r in places.groupBy("lang").count().collect()}  # one row for each language
    if not counts:
        return Model([], np.zeros((1 << BITS, 0), np.int32), 1.0, np.zeros(0), 1.0)
    each = max(least_rows, -(-sample_rows // len(counts)))
    limits = _smallest(places, counts, each)
    sample = rows.join(F.broadcast(limits), "lang").where("order <= limit")
    sample = sample.groupBy("lang", "order").agg(F.min_by("text", F.xxhash64("text")).alias("text")).mapInArrow(_features, "lang string, order long, index binary, share binary")
    found = sample.where(F.octet_length("index") > 0).orderBy("order", "lang").collect()
    return train([(r["lang"], np.frombuffer(r["index"], np.int32), np.frombuffer(r["share"], np.float32).astype(float)) for r in found])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row; ``und`` and 0 for null texts and texts without letters.

    Only the text takes part. Equal texts get equal results; an empty table gives no rows. Long texts
    are read whole, in slices.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e, texts in _rows(batch.column("text")):
                lang, score = sent.value.predict(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[s:e], pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text has no recognised language: ``und``, or a score below ``least``.

    Repeated rows are judged one by one; an empty table stays empty. Only texts go to Python.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(text: pa.Array) -> pa.Array:
        found = []
        for _, _, texts in _rows(text):
            lang, p = sent.value.predict(texts)
            found += [k != "und" and x >= least for k, x in zip(lang, p, strict=True)]
        return pa.array(found, pa.bool_())

    return docs.where(known(text_col))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of the ids that is never learned from; a null id is not in it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
