"""Language identification by blended-spectrum string kernels.

The kernel of two texts counts the character n-grams of one to three letters that both contain (presence, not
frequency), each order scaled by the lengths of its two presence vectors and the orders blended with equal weights.
N-grams are hashed into a bounded number of places. A Nyström map approximates the kernel by its values against
landmark texts, and one kernel ridge regression for each language against the rest is solved in that map. A batch of
texts is scored by matrix products: presence matrix, landmarks, regression weights (the last two are multiplied once).

The model learns from at most `per_class` labelled rows of each language, drawn by hash of the id; that bound is the
only one, and texts are always read whole. Every language with a labelled row is learned.

Rows: a text that is null or has no letter gets `und` with score 0; a language that is null is never learned from; of
equal shares the language that sorts first is taken; very long texts are a presence vector like others, in a batch of
their own; repeated rows get repeated results; an empty table gives an empty table; extra columns are ignored; without
any labelled row every text gets `und`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import carried, fields_of, short_batches, slices, unpack

#: Places for the hashed n-grams of each order.
PLACES = (1 << 10, 1 << 12, 1 << 13)
LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"


def presence(texts: list[str]) -> np.ndarray:
    """A row of 0 and 1 for each text: which hashed n-grams it contains. Runs of other signs count as one blank."""
    width = sum(PLACES)
    joined = "\0".join(t.lower() for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    stop = codes == 0
    sign = (codes < 0xC0) & ~((codes >= 97) & (codes <= 122)) | (codes >= 0x2000) & (codes < 0x2070)
    codes = np.where(sign & ~stop, np.uint32(32), codes)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes, stop = codes[keep], stop[keep]
    row = np.cumsum(stop) * width
    out = np.zeros(len(texts) * width, np.uint8)
    h, place = codes.copy(), 0
    for order, places in enumerate(PLACES):
        if order:
            h = h[:-1] * np.uint32(0x9E3779B1) + codes[order:] * np.uint32(0x85EBCA77)
            stop = stop[:-1] | (codes[order:] == 0)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        at = row[: len(h)] + (place + ((mixed >> np.uint32(12)) & np.uint32(places - 1)))
        out[at[~stop]] = 1
        place += places
    return out.reshape(len(texts), width)


def features(present: np.ndarray) -> np.ndarray:
    """Presence vectors whose inner products are the blended kernel."""
    out = present.astype(np.float32)
    at = 0
    for places in PLACES:
        part = out[:, at : at + places]
        part /= np.sqrt(np.maximum(1, part.sum(1, keepdims=True)) * len(PLACES))
        at += places
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # hashed n-grams x languages: landmarks, Nyström map and ridge weights in one
    bias: np.ndarray

    def scores(self, present: np.ndarray) -> np.ndarray:
        """One-versus-rest values as shares of 1."""
        z = 6 * (features(present) @ self.weights + self.bias)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit(present: np.ndarray, labels: list[str], landmarks: int = 192, ridge: float = 1e-2, seed: int = 0) -> LanguageModel:
    """Nyström features of labelled rows and one ridge regression for each language."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    share = max(1, landmarks // max(1, len(languages)))
    chosen = np.concatenate([rng.permutation(np.flatnonzero(y == i))[:share] for i in range(len(languages))])
    x = features(present)
    marks = x[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    good = values > 1e-6 * values.max()
    to_map = vectors[:, good] / np.sqrt(values[good])
    z = (x @ marks.T) @ to_map
    targets = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weigh = 1 / np.bincount(y)[y]
    weigh = weigh / weigh.mean()
    centre, middle = np.average(z, 0, weigh), np.average(targets, 0, weigh)
    zc, tc = z - centre, targets - middle
    solved = np.linalg.solve((zc * weigh[:, None]).T @ zc + ridge * len(z) * np.eye(z.shape[1]), (zc * weigh[:, None]).T @ tc)
    return LanguageModel(languages, (marks.T @ (to_map @ solved)).astype(np.float32), (middle - centre @ solved).astype(np.float32))


def learn(labelled: DataFrame, per_class: int = 600) -> LanguageModel | None:
    """Fits to rows (id, text, lang) by at most per_class rows of each language; the driver gets their presence bits."""
    usable = labelled.filter("lang is not null and text is not null")
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    if not counts:
        return None
    sizes = F.broadcast(labelled.sparkSession.createDataFrame(counts, "lang string, n bigint"))
    draw = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    chosen = usable.join(sizes, "lang").filter(draw < 1.5 * per_class / F.col("n"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256, 4 << 20):
            rows = np.packbits(presence(batch["text"].to_pylist()), axis=1)
            yield pa.record_batch([batch["draw"], batch["lang"], pa.array([r.tobytes() for r in rows], pa.binary())], ["draw", "lang", "bits"])

    drawn = chosen.select(draw.alias("draw"), "lang", "text").mapInArrow(bits, "draw double, lang string, bits binary")
    rows = drawn.orderBy("draw", "lang", "bits").limit(2 * per_class * len(counts)).collect()
    held: dict[str, list[bytes]] = {}
    for _, lang, packed in rows:
        held.setdefault(lang, []).append(packed)
    pairs = [(lang, x) for lang in sorted(held) for x in held[lang][:per_class]]
    return fit(np.unpackbits(np.frombuffer(b"".join(x for _, x in pairs), np.uint8).reshape(len(pairs), -1), axis=1), [lang for lang, _ in pairs])


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id column, lang_pred, score of every document; with keep, those columns, lang_pred and score."""
    short_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), carried(docs, [c for c in keep or [] if c != text_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in slices(batches, 256, 2 << 20):
            texts = [t or "" for t in batch["text"].to_pylist()]
            known = [i for i, t in enumerate(texts) if model is not None and LETTER.search(t)]
            names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if known:
                shares = model.scores(presence([texts[i].replace("\0", " ") for i in known]))
                for i, best, share in zip(known, shares.argmax(1).tolist(), shares.max(1).tolist()):
                    names[i], scores[i] = model.languages[best], min(1.0, share)
            found = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.record_batch([batch["id"], batch["carried"], batch["text"], *found], ["id", "carried", "text", "lang_pred", "score"]) if keep else pa.record_batch([batch["id"], *found], ["id", "lang_pred", "score"])

    handed = ["id", "carried", "text"] if keep else ["id"]
    out = rows.mapInArrow(run, fields_of(rows, handed, "lang_pred string, score double"))
    return unpack(out.drop("id").withColumnRenamed("text", text_col), keep, text_col) if keep else out.withColumnRenamed("id", id_col)
