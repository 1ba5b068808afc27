"""Language ID by a string kernel: blended-spectrum presence, Nystroem landmarks, ridge regression.

A text is the set of byte n-grams (n from 1 to 3) of its lower-cased letters and spaces.  The kernel of
two texts is the number of grams they share over the geometric mean of their numbers of grams, all
counted within the grams of the landmarks (others match no landmark).  Landmarks are a few training
texts of each language; Nystroem's map on them feeds one ridge regressor per language against the rest.

The fit reads a bounded sample: of each language the FIT_PER_LANG labelled rows with the smallest hash of
doc_id, LANDMARKS_PER_LANG of them as landmarks.  Scoring reads every whole text: presence rows of a
batch times the landmarks' presence matrix folded with the regressors (both products are linear, so
they are multiplied once, after the fit).

Defined cases: null text or a text without a letter is ``und`` with score 0; a table without labelled
rows makes every text ``und``; rows with null lang are scored and never learned from; ties go to the
language first in code points; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiberloom.llm.batches import bounded, tidy

FIT_PER_LANG = 300
LANDMARKS_PER_LANG = 40
RIDGE = 0.1
#: Buckets that share out the choice of the sample of a frequent language.
CHOICE_BUCKETS = 8
NOT_LETTER = regex.compile(r"[^\p{L}\p{M}]+")
BLOCK_ROWS, BLOCK_BYTES = 64, 1 << 20
GRAMS = 256 + (1 << 16) + (1 << 24)


def gram_codes(text: str) -> np.ndarray:
    """Codes of the 1-, 2- and 3-grams of the text's letters, with repeats; empty if it has no letter."""
    cleaned = NOT_LETTER.sub(" ", text.lower()).strip()
    if not cleaned:
        return np.zeros(0, dtype=np.int32)
    x = np.frombuffer(f" {cleaned} ".encode(), dtype=np.uint8).astype(np.int32)
    pair = (x[:-1] << 8) | x[1:]
    return np.concatenate([x, pair + 256, ((pair[:-1] << 8) | x[2:]) + (256 + (1 << 16))])


@dataclass
class Model:
    """``column``: gram code to presence column or -1; ``weights``: columns by languages."""

    langs: list[str]
    grams: np.ndarray
    weights: np.ndarray

    def scores(self, blocks: list[np.ndarray], column: np.ndarray) -> np.ndarray:
        """One row for each text: its presence vector over its norm, times the folded weights."""
        present = np.zeros((len(blocks), len(self.grams) + 1), dtype=np.float32)
        for i, codes in enumerate(blocks):
            present[i, column[codes]] = 1
        present = present[:, :-1]
        norm = np.sqrt(np.maximum(present.sum(axis=1, keepdims=True), 1))
        return (present @ self.weights) / norm


def kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shared grams over the root of the product of their numbers, for presence rows."""
    norms = np.sqrt(np.maximum(np.outer(left.sum(axis=1), right.sum(axis=1)), 1))
    return left @ right.T / norms


def fit(sets: list[np.ndarray], langs: list[str], landmark: list[bool], ridge: float = RIDGE) -> Model:
    """Fit on gram sets; the rows marked landmark give the columns and the Nystroem map."""
    names = sorted(set(langs))
    marks = [s for s, m in zip(sets, landmark, strict=True) if m]
    grams = np.unique(np.concatenate(marks)) if marks else np.zeros(0, dtype=np.int32)
    if not len(grams):
        return Model([], grams, np.zeros((0, 0), dtype=np.float32))
    present = np.zeros((len(sets), len(grams)), dtype=np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(grams, s)
        at[at == len(grams)] = 0
        present[i, at[grams[at] == s]] = 1
    own = present[np.array(landmark)]
    values, vectors = np.linalg.eigh(kernel(own, own).astype(np.float64))
    keep = values > 1e-6 * values.max()
    to_map = vectors[:, keep] / np.sqrt(values[keep])  # landmarks by dimensions: K(x, landmarks) @ to_map is the feature row
    features = kernel(present, own) @ to_map
    target = (np.array(langs)[:, None] == np.array(names)[None, :]).astype(np.float64)
    weight = 1 / np.maximum(target.sum(axis=0), 1)
    row = (target * weight).sum(axis=1, keepdims=True)  # languages count alike, however many rows they have
    solved = np.linalg.solve(features.T @ (features * row) + ridge / len(names) * np.eye(features.shape[1]) * row.mean(), features.T @ (target * row))
    folded = (own / np.sqrt(np.maximum(own.sum(axis=1, keepdims=True), 1))).T @ (to_map @ solved)
    return Model(names, grams, folded.astype(np.float32))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(documents: DataFrame, per_lang: int = FIT_PER_LANG, landmarks: int = LANDMARKS_PER_LANG, ridge: float = RIDGE) -> Model:
    """Choose the sample on (doc_id, lang) alone, then turn only its texts into gram sets on the executors."""
    mark = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = documents.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", mark.alias("_mark")).distinct()
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("lang", F.pmod("_mark", F.lit(CHOICE_BUCKETS))).orderBy("_mark", "doc_id"))).where(F.col("_n") <= per_lang)
    chosen = first.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_mark", "doc_id"))).where(F.col("_n") <= per_lang)
    ranks = {(r["doc_id"], r["lang"]): r["_n"] for r in chosen.select("doc_id", "lang", "_n").collect()}  # per_lang rows a language
    sample = documents.where(F.col("doc_id").isin([k[0] for k in ranks])).select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.unique(gram_codes(x.as_py())).tobytes() for x in b.column(2)], pa.binary())], names=["doc_id", "lang", "grams"])

    found = bounded(sample).mapInArrow(tidy(run), "doc_id long, lang string, grams binary").collect()
    found = sorted({(r["lang"], ranks[r["doc_id"], r["lang"]], bytes(r["grams"])) for r in found if r["grams"] and (r["doc_id"], r["lang"]) in ranks})
    sets = [np.frombuffer(g, dtype=np.int32) for _, _, g in found]
    return fit(sets, [x[0] for x in found], [x[1] <= landmarks for x in found], ridge)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every whole text."""
    spread = documents.sparkSession.sparkContext.broadcast(model)  # bounded: landmarks' grams by languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spread.value
        column = np.full(GRAMS, len(own.grams), dtype=np.int32)
        column[own.grams] = np.arange(len(own.grams), dtype=np.int32)
        for batch in batches:
            names: list[str] = ["und"] * batch.num_rows
            scores = np.zeros(batch.num_rows)
            at: list[int] = []
            blocks: list[np.ndarray] = []

            def flush() -> None:
                if at and own.langs:
                    got = own.scores(blocks, column)
                    best = got.argmax(axis=1)
                    for i, k, value in zip(at, best, got[np.arange(len(at)), best], strict=True):
                        names[i], scores[i] = own.langs[k], min(1.0, max(0.0, float(value)))
                at.clear()
                blocks.clear()

            for i, text in enumerate(batch.column(1)):
                codes = gram_codes(text.as_py() or "")
                if len(codes):
                    at.append(i)
                    blocks.append(codes)
                if len(at) >= BLOCK_ROWS or sum(map(len, blocks)) >= BLOCK_BYTES:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return bounded(documents).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def identify(documents: DataFrame) -> DataFrame:
    """Learn on the documents that are not held out and predict all: doc_id, held_out, lang_pred, score."""
    return predict(documents, train(documents)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
