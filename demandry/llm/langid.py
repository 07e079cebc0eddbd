"""Language identification with string kernels: n-gram presence, Nystrom landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, texts

UND = "und"
#: n-gram lengths of the blended spectrum, and the hashed presence features of all lengths together.
SPECTRUM, FEATURES = (1, 2, 3), 1 << 13
#: Bounds of what is fitted: labelled rows in all and landmarks among them, or rows and landmarks of each language if
#: that is more; and the ridge.
ROWS, LANDMARKS, EACH, MARKS, RIDGE = 3000, 192, 16, 2, 1e-3
#: Rows scored in one matrix product.
BLOCK = 512

LETTER = regex.compile(r"\p{L}")
MIX = np.uint32(2654435761)


def presence(part: list[bytes | None]) -> np.ndarray:
    """Rows of 0 and 1: which hashed n-grams of characters each whole text has, in lower case."""
    out = np.zeros((len(part), FEATURES), dtype=np.uint8)
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    for row, text in enumerate(part):
        chars = np.frombuffer((text or b"").decode("utf-8", "replace").lower().encode("utf-32-le"), dtype=np.uint32)
        gram = np.zeros(len(chars), dtype=np.uint32)
        for n in range(1, max(SPECTRUM) + 1):
            if len(chars) < n:
                break
            gram = (gram[: len(chars) - n + 1] if n > 1 else gram) * MIX + chars[n - 1 :] + np.uint32(n)
            if n in SPECTRUM:
                mixed = (gram ^ (gram >> np.uint32(15))) * MIX
                out[row, mixed >> shift] = 1
    return out


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Shared n-grams over the geometric mean of the numbers of n-grams."""
    x, landmarks = x.astype(np.float32), landmarks.astype(np.float32)
    norm = np.sqrt(np.maximum(x.sum(1), 1))[:, None] * np.sqrt(np.maximum(landmarks.sum(1), 1))[None, :]
    return (x @ landmarks.T) / norm


@dataclass
class Model:
    """Landmark rows, and the weights from kernel values to a regression for each language."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    #: Slope and offset of the logistic curve from a margin to the probability that the language is right.
    sure: tuple[float, float] = (0.0, 0.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.languages):
            return np.zeros((len(x), 0))
        out = np.empty((len(x), len(self.languages)))
        for k in range(0, len(x), BLOCK):
            out[k : k + BLOCK] = kernel(x[k : k + BLOCK], self.landmarks) @ self.weights + self.offset
        return out


def fit(x: np.ndarray, languages: list[str], seed: int = 42) -> Model:
    """Kernel ridge regression of each language against the rest in the span of the landmarks."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((0, FEATURES), dtype=np.uint8), np.zeros((0, 0)), np.zeros(0))
    y = np.array([[1.0 if lang == n else -1.0 for n in names] for lang in languages])
    share = np.array([(y[:, k] > 0).sum() for k in range(len(names))])
    rng, picked = np.random.default_rng(seed), []
    for k in range(len(names)):
        rows = np.flatnonzero(y[:, k] > 0)
        picked += rng.choice(rows, min(len(rows), max(MARKS, LANDMARKS // len(names))), replace=False).tolist()
    marks = x[sorted(picked)]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # Nystrom: K(x, L) @ root has inner products near the kernel
    phi = kernel(x, marks) @ root
    weight = (1.0 / (len(names) * share))[np.argmax(y, axis=1)]  # each language weighs the same
    mean, offset = weight @ phi, weight @ y
    centred = phi - mean
    w = np.linalg.solve((centred * weight[:, None]).T @ centred + RIDGE * np.eye(phi.shape[1]), (centred * weight[:, None]).T @ (y - offset))
    return Model(names, marks, root @ w, offset - mean @ w)


def margins(values: np.ndarray) -> np.ndarray:
    """How far each row's best regression is above its second best (above the least value, -1, if there is one only)."""
    if values.shape[1] < 2:
        return values.max(axis=1, initial=-1.0) + 1
    top = np.partition(values, -2, axis=1)[:, -2:]
    return top.max(axis=1) - top.min(axis=1)


def calibrated(margin: np.ndarray, right: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, offset) of a logistic regression of right on margin by Newton's steps; a slope is never below 0.

    Targets are drawn in by one row each way, so that rows told without an error still give a finite curve; margins are
    of two regressions only, so the curve means the same for few and for many languages.
    """
    if not len(margin):
        return 0.0, 0.0
    good, bad = int(right.sum()), int((~right).sum())
    target = np.where(right, (good + 1) / (good + 2), 1 / (bad + 2))
    x, w = np.c_[margin, np.ones(len(margin))], np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    if w[0] < 0:
        return 0.0, float(np.log((good + 1) / (bad + 1)))
    return float(w[0]), float(w[1])


def trained(x: np.ndarray, languages: list[str], seed: int = 42) -> Model:
    """A model of all rows, whose probabilities come from every fifth row of each language told by a model of the others."""
    model, at, seen = fit(x, languages, seed), np.zeros(len(languages), dtype=bool), {}
    for k, name in enumerate(languages):
        seen[name] = seen.get(name, 0) + 1
        at[k] = seen[name] % 5 == 0
    if at.any():
        rest = fit(x[~at], [n for n, held in zip(languages, at, strict=True) if not held], seed)
        values = rest.score(x[at])
        right = np.array([rest.languages[k] for k in values.argmax(axis=1)]) == np.array(languages, dtype=object)[at]
        model.sure = calibrated(margins(values), right)
    return model


def training_rows(docs: DataFrame, learn: Column, lang_col: str, id_col: str, text_col: str, rows: int) -> tuple[np.ndarray, list[str]]:
    """Presence rows and languages of about `rows` labelled documents, or EACH of each language if that is more: an equal
    number of each language where it has them.

    The languages are counted over all rows, and all are learned: the lang column is taken to name languages, of which
    there are some thousands at most. Documents are drawn by a hash of their id and their n-grams taken on the
    executors, so that the driver gets bit rows of a fixed size.
    """
    usable = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = usable.groupBy("lang").count().collect()
    if not counts:
        return np.zeros((0, FEATURES), dtype=np.uint8), []
    each = max(EACH, rows / len(counts))
    limits = docs.sparkSession.createDataFrame([(r[0], int(min(1.0, each / r[1]) * (1 << 30))) for r in counts], "of string, upto long")
    drawn = usable.join(F.broadcast(limits), F.col("lang") == F.col("of")).where(F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1 << 30)) < F.col("upto"))

    def take(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(0, part.num_rows, BLOCK):
                bits = np.packbits(presence(texts(part.column(1).slice(k, BLOCK))), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(k, BLOCK), pa.array([b.tobytes() for b in bits], type=pa.binary())], ["lang", "bits"])

    got = sorted((r[0], bytes(r[1])) for r in drawn.select("lang", "text").mapInArrow(take, "lang string, bits binary").collect())
    if not got:
        return np.zeros((0, FEATURES), dtype=np.uint8), []
    return np.unpackbits(np.frombuffer(b"".join(b for _, b in got), dtype=np.uint8).reshape(len(got), -1), axis=1), [lang for lang, _ in got]


def identify(docs: DataFrame, learn: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS) -> DataFrame:
    """docs with lang_pred (a learned language, or `und` for a null text or one without a letter) and score (0 to 1).

    Fitted on a bounded sample (`rows`) of the rows where `learn` holds and text and language are not null; every whole
    text is scored, in batched matrix products. The score is the probability that the language is right: a logistic curve
    of the margin between the two best regressions, calibrated on rows held back from a first fit (a half where there
    are none); 0 for `und`. Without labelled rows every text is `und`. Repeated rows stay, columns pass through (lang_pred and
    score are replaced), an empty table gives no rows. Prediction reads the text alone.
    """
    model = trained(*training_rows(docs, learn, lang_col, id_col, text_col, rows))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            column = part.column(part.schema.get_field_index(text_col))
            names, scores = [], []
            for k in range(0, part.num_rows, BLOCK):
                block = texts(column.slice(k, BLOCK))
                values = model.score(presence(block))
                sure = 1 / (1 + np.exp(-np.clip(model.sure[0] * margins(values) + model.sure[1], -30, 30)))
                for text, v, p in zip(block, values, sure.tolist(), strict=True):
                    if text is None or not len(v) or not LETTER.search(text.decode("utf-8", "replace")):
                        names.append(UND)
                        scores.append(0.0)
                    else:
                        names.append(model.languages[int(np.argmax(v))])
                        scores.append(p)
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(kept))], pa.array(names, type=pa.string()), pa.array(scores, type=pa.float64())], [*kept, "lang_pred", "score"])

    inner = docs.select(*kept)
    schema = T.StructType([*inner.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return inner.mapInArrow(run, schema)


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(by))


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = remainder("doc_id", 4) == 2
    # A null id has no remainder: it is neither learned from nor held out.
    found = identify(docs, F.coalesce(~held, F.lit(False)))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
