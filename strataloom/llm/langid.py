"""Language identification with string kernels.

The kernel is the blended-spectrum presence kernel: the number of byte n-grams
of 1 to ``NGRAM`` bytes that two lower-cased texts both hold, divided by the
root of the product of their counts. N-grams are numbered by a hash into
``BITS`` bits; the ``FEATURES`` of them whose presence differs most between
languages are kept. Kernel values against Nystroem landmarks are mapped by the
inverse root of the landmarks' own kernel matrix, and one-versus-rest kernel
ridge regression is solved on that map. Texts are scored in batches by two
matrix products.

The model is fitted on a bounded sample of labelled rows: at most
``PER_LANGUAGE`` per language, those of least hash of key and text. Choosing them
gathers ``SALTS`` x ``PER_LANGUAGE`` hashes of a language in one task at most,
however many rows it has. Only packed
presence bits of the sample reach the driver.

Edge cases: a text that is null or has no letter is ``und`` with score 0; rows
of null language are never learned from; with no labelled row every text is
``und``; of languages whose scores are equal the first by name is told;
repeated rows get the same prediction and count once in the sample; a row for
which ``learn`` is null is not learned from; further columns are unread unless
kept; all grams of a text of any length count; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import mapped, slices

NGRAM = 4
BITS = 15
FEATURES = 2048
LANDMARKS = 256
PER_LANGUAGE = 500
RIDGE = 1e-3
#: Parts that a language is dealt to before its sample is chosen.
SALTS = 64
#: Bytes of text whose n-grams are numbered at a time.
CHUNK = 1 << 20

_LETTER = regex.compile(r"\p{L}")
_ODD = np.uint32(2654435761)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def codes(data: np.ndarray, bits: int = BITS) -> Iterator[tuple[int, np.ndarray]]:
    """For each n, the hashed n-gram starting at every byte."""
    wide = data.astype(np.uint32)
    whole = np.zeros(len(data), np.uint32)
    for n in range(1, NGRAM + 1):
        whole = (whole[: len(data) - n + 1] << np.uint32(8)) | wide[n - 1 :]
        yield n, ((whole + np.uint32(n)) * _ODD) >> np.uint32(32 - bits)


def presence(text: str, bits: int = BITS) -> np.ndarray:
    """Which n-gram numbers a whole text holds."""
    held = np.zeros(1 << bits, bool)
    data = np.frombuffer(text.lower().encode(), np.uint8)
    for at in range(0, len(data), CHUNK):
        for _, c in codes(data[at : at + CHUNK + NGRAM - 1], bits):
            held[c] = True
    return held


class Model:
    def __init__(self, columns: np.ndarray, landmarks: np.ndarray, weights: np.ndarray, languages: list[str]):
        self.columns, self.landmarks, self.weights, self.languages = columns, landmarks, weights, languages

    @classmethod
    def fit(cls, held: np.ndarray, languages: list[str]) -> Model | None:
        """``held``: presence of all n-gram numbers in each sampled text."""
        if not len(languages):
            return None
        names = sorted(set(languages))
        which = np.array([names.index(x) for x in languages])
        shares = np.stack([held[which == i].mean(0) for i in range(len(names))])
        spread = shares.max(0) - shares.min(0) if len(names) > 1 else shares[0] * (1 - shares[0])
        columns = np.sort(np.argsort(-spread, kind="stable")[:FEATURES])
        x = unit(held[:, columns])
        each = max(1, LANDMARKS // len(names))
        chosen = np.concatenate([np.flatnonzero(which == i)[:each] for i in range(len(names))])
        marks = x[chosen]
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-8))) @ vectors.T
        mapped = (x @ marks.T).astype(np.float64) @ root
        # Languages weigh alike however many rows of each were sampled.
        weight = 1 / np.bincount(which)[which]
        target = np.where(which[:, None] == np.arange(len(names)), 1.0, -1.0)
        gram = (mapped * weight[:, None]).T @ mapped + RIDGE * np.eye(mapped.shape[1])
        ridge = np.linalg.solve(gram, (mapped * weight[:, None]).T @ target)
        return cls(columns, marks.astype(np.float32), (root @ ridge).astype(np.float32), names)

    def score(self, texts: list[str]) -> np.ndarray:
        """One-versus-rest scores of each text."""
        held = np.stack([presence(t)[self.columns] for t in texts])
        return (unit(held) @ self.landmarks.T) @ self.weights


def unit(held: np.ndarray) -> np.ndarray:
    x = held.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def _order(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit("sample"))


def sample_rows(docs: DataFrame, key: str, text: str, language: str, per_language: int) -> DataFrame:
    """At most ``per_language`` rows ``(language, hash)`` of each language, of
    least hash of key and text, chosen in salted parts first."""
    rows = docs.select(F.col(language).alias("__lang"), _order(key, text).alias("__order"))
    rows = rows.filter(F.col("__lang").isNotNull()).withColumn("__salt", F.pmod("__order", F.lit(SALTS)))
    for by in (("__lang", "__salt"), ("__lang",)):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("__order"))
        rows = rows.withColumn("__rank", rank).filter(F.col("__rank") <= per_language).drop("__rank")
    return rows


def fit(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", language: str = "lang",
        per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on a bounded sample of the rows where ``learn`` holds."""
    rows = docs.filter(learn & F.col(text).isNotNull())
    chosen = sample_rows(rows, key, text, language, per_language)
    texts = rows.select(F.col(language).alias("__lang"), _order(key, text).alias("__order"), F.col(text).alias("__text"))
    # The sample is bounded by per_language x languages, so its hashes may be sent to every
    # task; of repeated rows one is taken, so no more texts than that come back.
    sample = texts.join(F.broadcast(chosen.distinct()), ["__lang", "__order"])
    sample = sample.groupBy("__lang", "__order").agg(F.first("__text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held = [np.packbits(presence(t)).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.binary())], names=["lang", "at", "held"])

    found = mapped(sample.select("__lang", "__order", "__text"), run, "lang string, at long, held binary").collect()
    found.sort(key=lambda r: (r["lang"], r["at"]))
    if not found:
        return None
    held = np.stack([np.unpackbits(np.frombuffer(bytes(r["held"]), np.uint8)) for r in found]).astype(bool)
    return Model.fit(held, [r["lang"] for r in found])


def predict(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` of each whole text."""
    source = docs.select(*keep, docs[text].alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: FEATURES x LANDMARKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            known = [i for i, t in enumerate(texts) if m and has_letter(t)]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            if known:
                raw = m.score([texts[i] for i in known])
                share = np.exp(4 * (raw - raw.max(1, keepdims=True)).astype(np.float64))
                best = raw.argmax(1)
                for i, b, s in zip(known, best, share.max(1) / share.sum(1), strict=True):
                    names[i], scores[i] = m.languages[b], float(s)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return mapped(source, run, f"{kept}, lang_pred string, score double")
