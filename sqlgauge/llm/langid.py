"""Operator 2: language identification by nearest centroid.

A text becomes a vector of its lower-case letter 1- to 3-grams (other characters
are one blank), hashed into DIMS places, with damped counts, inverse document
frequencies and unit length. Each language has several centroids (spherical
k-means of its training vectors). A text gets the language of the centroid with
the highest cosine; it is rejected when that cosine is below the one that all but
a share LOW of the language's training texts reach, times SLACK. Clusters of less
than a share FEW of a language's texts are left out, so a few wrong labels neither
lower that cosine nor have centroids.

The model is fitted on at most TRAIN_DOCS labelled documents per language (those
with the smallest id hashes, up to sampling), for every language; it predicts every
whole text. Each language is fitted in a task of its own.

Defined results: null texts and texts without a letter are ``und`` with score 0
and rejected; with no labelled document at all every text is ``und``; ties go to
the language that sorts first; repeated rows and null ids keep their rows; a null
id is never held out nor trained on; columns other than id, text and (for
training) language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlgauge.llm import textvec as V
from sqlgauge.llm.graph import fresh, written

DIMS = 4096
GRAMS = 3
TRAIN_DOCS = 1500
CLUSTERS = 3
SLACK = 0.5
FEW, LOW = 0.02, 0.03
ROWS = 512  # vectors held at once
_FITTED = pa.schema([("lang", pa.string()), ("centroids", pa.binary()), ("least", pa.float64())])

_PLACE = (V.place_keys(2 * GRAMS) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SPREAD = np.uint32(0x9E3779B1)
_SHIFT = np.uint32(32 - (DIMS - 1).bit_length())
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, hashed n-gram counts) of blocks of texts."""
    raw, off = V.text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    for a, b in V.blocks(off):
        for lo in range(a, b, ROWS):
            hi = min(b, lo + ROWS)
            data, o = raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
            yield lo, hi, _block_counts(data, o)


def _block_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    rows = len(off) - 1
    out = np.zeros((rows, DIMS), dtype=np.float32)
    if len(data) == 0:
        return out
    cp, at = V.code_points(data)
    row = np.repeat(np.arange(rows, dtype=np.int64) * DIMS, np.diff(np.searchsorted(at, off)))
    letter = _letter_table()[cp]
    keep = letter.copy()  # letters, and the first of other characters after one
    keep[1:] |= letter[:-1] & (row[1:] == row[:-1])
    cp, row = np.where(letter, cp, np.uint32(32))[keep], row[keep]
    if len(cp) == 0:
        return out
    # A blank stands before each row's first letter as well.
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    cp, row = np.insert(cp, start, 32), np.insert(row, start, row[start])
    places, total = [], np.zeros(len(cp), dtype=np.uint32)
    for n in range(1, GRAMS + 1):
        m = len(cp) - n + 1
        if m <= 0:
            break
        total = total[:m] + cp[n - 1:] * _PLACE[n - 1]
        same = row[:m] == row[n - 1:]
        if n == 1:
            same &= cp != 32
        places.append((row[:m] + (((total + _PLACE[GRAMS + n - 1]) * _SPREAD) >> _SHIFT))[same])
    return np.bincount(np.concatenate(places), minlength=rows * DIMS).reshape(rows, DIMS).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


@dataclass
class Model:
    """Centroids of all languages, with the inverse frequencies of the n-grams."""

    languages: list[str]      # of each centroid
    centroids: np.ndarray     # (centroids, DIMS), unit length
    idf: np.ndarray
    least: np.ndarray         # rejection cosine of each centroid's language

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(tf) * self.idf)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, rejected) of each text."""
        n = len(column)
        lang, score, rejected = ["und"] * n, np.zeros(n), np.ones(n, dtype=bool)
        if not self.languages:
            return lang, score, rejected
        for lo, hi, tf in counts(column):
            cosine = self.vectors(tf) @ self.centroids.T
            best = cosine.argmax(axis=1)
            top = np.clip(cosine[np.arange(hi - lo), best], 0, 1)
            has = tf.any(axis=1)
            for k in np.flatnonzero(has).tolist():
                lang[lo + k] = self.languages[best[k]]
            score[lo:hi] = np.where(has, top, 0)
            rejected[lo:hi] = ~has | (top < self.least[best])
        return lang, score, rejected


def _k_means(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means; starts from the mean's nearest vector and then the farthest ones
    but a share FEW, which may be odd."""
    first = int((x @ x.mean(axis=0)).argmax())
    picks = [first]
    near, odd = x @ x[first], int(FEW * len(x))
    while len(picks) < min(k, len(x)):
        picks.append(int(np.argsort(near, kind="stable")[odd]))
        near = np.maximum(near, x @ x[picks[-1]])
    centres = x[picks].copy()
    for _ in range(rounds):
        owner = (x @ centres.T).argmax(axis=1)
        member = (owner[None, :] == np.arange(len(centres))[:, None]).astype(x.dtype)
        sums = member @ x
        moved = _unit(np.where(member.any(axis=1)[:, None], sums, centres))
        if np.allclose(moved, centres, atol=1e-6):
            break
        centres = moved
    return centres


def _centroids(x: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """The centroids of a language, and the cosine that all but a share LOW of its texts reach."""
    centres = _k_means(x, k)
    size = np.bincount((x @ centres.T).argmax(axis=1), minlength=len(centres))
    centres = centres[size >= min(FEW * len(x), size.max())]
    reached = np.sort((x @ centres.T).max(axis=1))
    return centres, float(reached[int(LOW * len(reached))])


def model(rows: list[tuple[str, bytes, float]], idf: np.ndarray) -> Model:
    """The model of (language, float32 centroids, rejection cosine) rows."""
    names, centres, least = [], [np.zeros((0, DIMS), np.float32)], []
    for name, raw, cosine in sorted(rows, key=lambda r: r[0]):
        c = np.frombuffer(raw, dtype=np.float32).reshape(-1, DIMS)
        names += [name] * len(c)
        centres.append(c)
        least += [cosine] * len(c)
    return Model(names, np.concatenate(centres), idf, np.array(least))


def held_out(id_col: Column) -> Column:
    """Every fifth document by the CRC-32 of its decimal id; a null id is not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def damped_vectors(text: Column) -> Column:
    """binary: the damped hashed n-gram counts of each text, float16."""
    def run(column: pa.Array) -> pa.Array:
        return pa.array([row.tobytes() for _, _, tf in counts(column)
                         for row in np.log1p(tf).astype(np.float16)], pa.binary())
    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(text)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train_docs: int) -> DataFrame:
    """lang, at, v: the damped vectors of the training texts of all languages, by place in their language."""
    ids = F.col(id_col).cast("string")
    key = F.pmod(F.xxhash64(ids), F.lit(1 << 30))
    rows = (docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
                       & ~held_out(F.col(id_col)))
            .select(F.col(lang_col).alias("lang"), key.alias("key"), ids.alias("id"), F.col(text_col).alias("text")))
    # The smallest id hashes of each language. Of the large ones, a hash range that holds
    # about twice as many keeps the sort small; there is one such row per 2 * train_docs texts at most.
    large = (rows.groupBy("lang").count().where(F.col("count") > 2 * train_docs)
             .select("lang", (((2 * train_docs + 100) / F.col("count")) * (1 << 30)).alias("below")))
    rows = (rows.join(F.broadcast(large), "lang", "left")
            .where(F.col("below").isNull() | (F.col("key") < F.col("below"))))
    at = F.row_number().over(Window.partitionBy("lang").orderBy("key", "id"))
    return (rows.withColumn("at", at).where(F.col("at") <= train_docs)
            .select("lang", "at", damped_vectors(F.col("text")).alias("v")))


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, texts with it) of a task's vectors; place -1 counts the vectors that are not zero."""
    seen, total = np.zeros(DIMS, dtype=np.int64), 0
    for batch in batches:
        for v in batch.column(0):
            row = np.frombuffer(v.as_py(), dtype=np.float16) > 0
            seen += row
            total += bool(row.any())
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()),
                                      pa.array(np.append(seen[at], total), pa.int64())], ["place", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          train_docs: int = TRAIN_DOCS, clusters: int = CLUSTERS, slack: float = SLACK) -> Model:
    """Fit on the labelled documents that are not held out (``train_docs`` per language at most).

    Each language is fitted in a task of its own; the driver gets the centroids."""
    rows = written(sample(docs, id_col, text_col, lang_col, train_docs), "language-sample")
    seen, total = np.zeros(DIMS, dtype=np.int64), 0
    for r in rows.select("v").mapInArrow(_seen, "place bigint, n bigint").groupBy("place").sum("n").collect():
        if r["place"] < 0:
            total = r["sum(n)"]
        else:
            seen[r["place"]] = r["sum(n)"]
    if not total:
        return model([], np.ones(DIMS, np.float32))
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        own = np.empty((len(group), DIMS), dtype=np.float32)
        for k, v in enumerate(group.column("v")):
            own[k] = np.frombuffer(v.as_py(), dtype=np.float16)
        own = own[own.any(axis=1)]
        if not len(own):
            return pa.table({"lang": [], "centroids": [], "least": []}, schema=_FITTED)
        own *= idf
        own /= np.sqrt(np.einsum("ij,ij->i", own, own))[:, None]
        c, reached = _centroids(own, clusters)
        return pa.table({"lang": group.column("lang")[:1], "centroids": [c.astype(np.float32).tobytes()],
                         "least": [slack * reached]}, schema=_FITTED)

    fitted = rows.groupBy("lang").applyInArrow(fit, "lang string, centroids binary, least double").collect()
    return model([(r["lang"], r["centroids"], r["least"]) for r in fitted], idf)


def predict(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with a struct column of lang, score and rejected."""
    # CLUSTERS centroids (48 KB) per language, whatever the corpus.
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> pa.Array:
        lang, score, rejected = sent.value.predict(column)
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(score.astype(np.float64)), pa.array(rejected)],
            ["lang", "score", "rejected"])
    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    kind = "struct<lang: string, score: double, rejected: boolean>"
    return docs.withColumn(out_col, F.arrow_udf(run, kind)(F.col(text_col)))


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the texts that the model rejects."""
    name = fresh(docs, "_language")
    return predict(docs, model, text_col, name).where(~F.col(name)["rejected"]).drop(name)
