"""Language identification by error-correcting output codes over binary n-gram classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import appended

DIMS = 4096
UNKNOWN = "und"
# Bytes that are no letters in ASCII become spaces; other bytes stay, so that every alphabet is seen.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def features(text: str) -> np.ndarray:
    """Hashed counts of the byte 1- to 4-grams of a whole text's words, damped and of unit length."""
    data = b" ".join((b" " + text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS) + b" ").split())
    x = np.frombuffer(b" " + data + b" ", dtype=np.uint8).astype(np.uint32)
    counts = np.zeros(DIMS, dtype=np.float32)
    grams = x
    for n in range(1, 5):
        if n > 1:
            grams = grams[:-1] * np.uint32(257) + x[n - 1 :]
        mixed = (grams + np.uint32(n)) * np.uint32(2654435761)
        counts += np.bincount(mixed >> np.uint32(20), minlength=DIMS)
    counts = np.log1p(counts)
    return counts / max(float(np.sqrt(counts @ counts)), 1e-9)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """One row of +1 and -1 per class: all splits up to 5 classes, else the best of many random codes by least distance."""
    if k <= 5:
        splits = range(1, max(2, 1 << (k - 1)))
        return np.array([[1 if c == k - 1 or s >> c & 1 == 0 else -1 for s in splits] for c in range(k)], dtype=np.float32)
    rng, width, best, gap = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k))), None, -1.0
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], dtype=np.float32), (k, width))
        apart = (width - code @ code.T) / 2 + np.eye(k) * width
        mixed = np.abs(code.sum(axis=0)) < k
        if mixed.all() and apart.min() > gap:
            best, gap = code, apart.min()
    return best if best is not None else code


@dataclass
class Codebook:
    """Classes, their codewords, the bit classifiers, and how far each classifier is trusted on each class."""

    classes: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each row's bit outputs from each codeword: trust * log(1 + exp(-bit * output))."""
        out = np.clip(x @ self.weights + self.bias, -30, 30)
        return np.stack([(np.log1p(np.exp(-out * c)) * t).sum(axis=1) for c, t in zip(self.code, self.trust)], axis=1)


def fit(x: np.ndarray, labels: list[str], steps: int = 250, ridge: float = 1e-4) -> Codebook:
    """Logistic regression for every bit, classes weighed alike; trust is each bit's share of right answers per class."""
    classes = sorted(set(labels))
    y = np.array([classes.index(v) for v in labels])
    code = codewords(len(classes))
    target = code[y]
    share = 1.0 / np.bincount(y, minlength=len(classes))[y]
    share = (share / share.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1]), dtype=np.float32), np.zeros(code.shape[1], dtype=np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        slope = -target * share / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30)))
        vw = 0.9 * vw - 8.0 * (x.T @ slope + ridge * w)
        vb = 0.9 * vb - 1.0 * slope.sum(axis=0)
        w, b = w + vw, b + vb
    right = (np.sign(x @ w + b) == target).astype(np.float64)
    trust = np.stack([right[y == c].mean(axis=0) for c in range(len(classes))])
    trust = np.maximum(trust, 1e-3)
    return Codebook(classes, code, w, b, (trust / trust.sum(axis=1, keepdims=True)).astype(np.float32))


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"label": pdf["lang"], "x": [features(t).tobytes() for t in pdf["text"]]})


def train(docs: DataFrame, *, per_class: int = 400, most: int = 4000, key: str = "doc_id") -> Codebook | None:
    """Fits a codebook on a bounded sample of labelled rows: at most ``per_class`` rows of each language and about ``most`` in all.

    The sample is chosen by a hash of the key without reading texts, n-grams are counted on the executors, and only
    the sample's feature vectors (16 KB each) reach the driver. Languages beyond the ``most`` largest are not learned. No labelled row with a text: None.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("_rows")).orderBy(F.desc("_rows"), "lang").limit(most).collect()
    if not sizes:
        return None
    n = max(1, min(per_class, most // len(sizes)))
    # a hash below 4n of the language's rows leaves about 4n of them; the shares are ``most`` rows at the most, so the scan itself drops the others before any shuffle
    shares = docs.sparkSession.createDataFrame([(r.lang, 4.0 * n / r._rows) for r in sizes], "lang string, _share double")
    chance = F.xxhash64(F.lit("sample"), key).cast("double") / 2.0**64 + 0.5
    few = labelled.select("lang", key).join(F.broadcast(shares), "lang").where(chance <= F.col("_share")).select("lang", key).distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("sample"), key), key)
    chosen = few.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
    # most + classes rows of two short columns at the most
    sample = labelled.select("lang", key, "text").join(F.broadcast(chosen), ["lang", key]).dropDuplicates(["lang", key])
    rows = sample.select("lang", "text").mapInPandas(_featured, "label string, x binary").collect()
    rows.sort(key=lambda r: (r.label, r.x))
    return fit(np.stack([np.frombuffer(r.x, dtype=np.float32) for r in rows]), [r.label for r in rows])


def identify(docs: DataFrame, book: Codebook | None, *, ambiguity: float = 0.02, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Predicts the language of every whole text: key, ``keep`` columns, lang_pred, score, ambiguous.

    ``score`` is the nearest codeword's weight among all by loss (0 to 1). ``ambiguous`` says that the second codeword
    is less than ``ambiguity`` farther. Null text, or one without a letter: ``und``, score 0, ambiguous. Without a
    codebook: ``und`` for all. Repeated rows are predicted alike, null keys are kept, other columns are ignored. No rows: no rows.
    """
    rows = docs.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_keep_{c}") for c in keep), F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(book)

    def predict(texts: list) -> dict[str, list]:
        model = shared.value
        lang, score, ambiguous = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        which = [i for i, t in enumerate(texts) if t is not None] if model is not None else []
        for at in range(0, len(which), 512):
            part = which[at : at + 512]
            loss = model.losses(np.stack([features(texts[i]) for i in part]))
            near = np.sort(loss, axis=1)
            lang[part] = np.array(model.classes, dtype=object)[loss.argmin(axis=1)]
            score[part] = 1 / np.exp(-4 * (loss - near[:, :1])).sum(axis=1)
            ambiguous[part] = near[:, 1] - near[:, 0] < ambiguity if loss.shape[1] > 1 else False
        return {"lang_pred": lang.tolist(), "score": score.tolist(), "ambiguous": ambiguous.tolist()}

    out = appended(rows, "_text", predict, "lang_pred string, score double, ambiguous boolean")
    return out.select(F.col("_key").alias(key), *(F.col(f"_keep_{c}").alias(c) for c in keep), "lang_pred", "score", "ambiguous")
