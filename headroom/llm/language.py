"""Language identification by a string kernel.

Texts are compared by the n-grams of one to three bytes they contain (presence, not counts, hashed
to a fixed number of places): the kernel is the share of common n-grams. A bounded sample of
labelled texts is projected on landmarks (Nyström), and one ridge regression per
language is solved on that. As the kernel is linear in the presence vector, landmarks and
coefficients multiply out to one matrix of places x languages, and a batch of texts is scored by a
product of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headroom.llm.common import batches_of, is_held_out, schema_of, with_row
from headroom.session import settle

BITS = 15
ROWS_PER_LANGUAGE = 500  # labelled texts that are learned from
LANDMARKS_PER_LANGUAGE = 64
MOST_TEXTS = 250_000  # of all languages together, which the driver holds as bits
RIDGE = 1e-2
SHARPNESS = 6.0
UNKNOWN = "und"
_TEXT_BYTES = 1 << 20
_BLOCK = 1 << 20
_TEXTS = 64


def presence(text: str | None) -> np.ndarray:
    """Which hashed n-grams the lower-cased text has, words set off by blanks; over the whole text."""
    found = np.zeros(1 << BITS, bool)
    data = np.frombuffer((" " + " ".join((text or "").lower().split()) + " ").encode("utf-8", "replace"), np.uint8)
    if len(data) < 3:
        return found
    for begin in range(0, len(data), _BLOCK):
        part = data[begin : begin + _BLOCK + 2].astype(np.uint32)
        gram = np.zeros(len(part), np.uint32)
        for n in (1, 2, 3):
            gram = (gram[: len(part) - n + 1] << np.uint32(8)) | part[n - 1 :]
            found[((gram + np.uint32(n << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)] = True
    return found


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Model:
    """Languages and the matrix that turns normalised presence vectors into one score per language."""

    def __init__(self, languages: list[str], matrix: np.ndarray):
        self.languages, self.matrix = languages, matrix

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for begin in range(0, len(at), _TEXTS):
            some = at[begin : begin + _TEXTS]
            found = _normalised(np.stack([presence(texts[i]) for i in some])) @ self.matrix
            odds = np.exp(SHARPNESS * (found - found.max(axis=1, keepdims=True)))
            odds /= odds.sum(axis=1, keepdims=True)
            for i, row in zip(some, odds):
                best = int(row.argmax())
                names[i], scores[i] = self.languages[best], float(row[best])
        return names, scores


def _normalised(found: np.ndarray) -> np.ndarray:
    return found.astype(np.float32) / np.sqrt(np.maximum(found.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def train(rows: list[tuple[str, bytes]]) -> Model:
    """Kernel ridge regression on landmarks: the first texts of each language.

    ``rows`` has a language and the packed bits of a presence vector; a block of them is unpacked at a time.
    Languages weigh the same, however many texts they have. Equal scores go to the language
    that sorts first.
    """
    languages = sorted({name for name, _ in rows})
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    labels = np.array([languages.index(name) for name, _ in rows])

    def vectors(at: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(b"".join(rows[i][1] for i in at), np.uint8).reshape(len(at), -1)
        return _normalised(np.unpackbits(bits, axis=1))

    marks = np.concatenate([np.flatnonzero(labels == i)[:LANDMARKS_PER_LANGUAGE] for i in range(len(languages))])
    landmarks = np.empty((len(marks), 1 << BITS), np.float32)
    for begin in range(0, len(marks), _TEXTS):
        landmarks[begin : begin + _TEXTS] = vectors(marks[begin : begin + _TEXTS])
    blocks = np.array_split(np.arange(len(rows)), -(-len(rows) // _TEXTS))
    kernel = np.concatenate([vectors(part) @ landmarks.T for part in blocks]).astype(np.float64)
    among = (landmarks @ landmarks.T).astype(np.float64)
    weight = 1 / np.bincount(labels)[labels]
    target = 2.0 * (labels[:, None] == np.arange(len(languages))) - 1
    left = kernel.T @ (weight[:, None] * kernel) + RIDGE * among + 1e-6 * np.eye(len(marks))
    coefficients = np.linalg.solve(left, kernel.T @ (weight[:, None] * target))
    return Model(languages, landmarks.T @ coefficients.astype(np.float32))


def fit(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Model from a sample of documents with a known language that are not held out.

    The sample is the ``per_language`` ids of least hash of each language, fewer where there are over ``MOST_TEXTS``
    in all, as presence vectors of fixed size (bounds of the fit alone), written side by side before any are read. Of rows that
    repeat an id one text is learned from, the one of least hash. Texts without a letter are not learned from.
    """
    known = docs.where("lang IS NOT NULL").where(~is_held_out(F.col("doc_id")))
    known = known.select("lang", F.xxhash64(F.col("doc_id").cast("string")).alias("place"), "text")
    languages = settle(known.select("lang").distinct()).count()
    most = max(1, min(per_language, MOST_TEXTS // max(1, languages)))
    # only ``most`` places per language and task are shuffled
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    places = known.select("lang", "place").distinct().withColumn("nth", nth).where(F.col("nth") <= most)
    bounds = settle(places.groupBy("lang").agg(F.max("place").alias("bound")))
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    rows = known.join(bounds, "lang").where("place <= bound").groupBy("lang", "place").agg(one.alias("one")).select("lang", "place", "one.text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text", _TEXT_BYTES):
                texts = part.column("text").to_pylist()
                found = [np.packbits(presence(t)).tobytes() if has_letter(t) else None for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("place"), pa.array(found, pa.binary())], ["lang", "place", "found"])

    sample = settle(rows.mapInArrow(extract, "lang string, place bigint, found binary").where("found IS NOT NULL"))
    return train([(row["lang"], bytes(row["found"])) for row in sample.orderBy("lang", "place").toLocalIterator()])


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """``row, lang_pred, score``; null texts and texts without a letter are ``und`` with score 0.

    So is everything if no language was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers per language
    rows = with_row(docs, "text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text", _TEXT_BYTES):
                names, scores = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    return rows.mapInArrow(predict, schema_of(rows, ["row"], "lang_pred string, score double"))


def with_letters(docs: DataFrame) -> DataFrame:
    """The documents whose text has a letter, as they came."""
    rows = with_row(docs, "text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([bool(has_letter(t)) for t in batch.column("text").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("row").filter(found)], ["row"])

    return rows.mapInArrow(keep, T.StructType([rows.schema["row"]])).select("row.*")
