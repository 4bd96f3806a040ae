"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is its letters' vectors, each rotated by its place, multiplied
element by element (bound); a text is the sum of its n-grams (bundled); a language is the sum of its texts. A document
takes the language whose prototype has the largest cosine with the document's vector.

Bundling is linear, so training only needs each language's n-gram counts: summed in each task, then by n-gram. Their
number is bounded by ALPHABET^3 for each language, whatever the corpus; a language's counts are bundled on one executor,
and the driver gets a vector for each language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table, texts
from .words import parts

DIM, ALPHABET, SEED, FOLDS = 2048, 64, 7, 5
#: languages whose counts a task holds at once (2 MB each)
HELD_LANGUAGES = 32


def letter_codes() -> np.ndarray:
    """Code point to symbol: 0 for what is no letter, a to z, the rest of the letters spread over what is left."""
    codes = np.zeros(0x110000, np.int16)
    points = np.arange(0x110000)
    alpha = np.zeros(0x110000, bool)
    alpha[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    codes[alpha] = 27 + points[alpha] * 7919 % (ALPHABET - 27)
    codes[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return codes


class Space:
    """Vectors of letters, rotated for each of the three places of an n-gram."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        base = np.random.default_rng(seed).integers(0, 2, (ALPHABET, dim)).astype(np.int8) * 2 - 1
        self.places = [np.roll(base, k, axis=1) for k in (2, 1, 0)]
        self.codes = letter_codes()

    def grams(self, text: str) -> np.ndarray:
        """Codes of the letter trigrams of the lower-cased text, with one blank between words; empty if it has no letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        c = self.codes[np.minimum(points, 0x10FFFF)].astype(np.int64)
        c = np.concatenate([[0], c, [0]])
        keep = (c[1:] != 0) | (c[:-1] != 0)  # runs of what is no letter count as one blank
        c = np.concatenate([[0], c[1:][keep]])
        if len(c) < 3 or not c.any():
            return np.zeros(0, np.int64)
        g = (c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:]
        return g

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        a, b, c = grams // ALPHABET**2, grams // ALPHABET % ALPHABET, grams % ALPHABET
        return self.places[0][a] * self.places[1][b] * self.places[2][c]


_SPACES: dict = {}


def space(dim: int, seed: int) -> Space:
    if (dim, seed) not in _SPACES:
        _SPACES[dim, seed] = Space(dim, seed)
    return _SPACES[dim, seed]


def learned(labelled: DataFrame, dim: int = DIM, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, of unit length, from (text, lang); each text counts once, whatever its length."""

    def run(it):
        s, sums = space(dim, seed), {}

        def flush():
            for lang, n in sums.items():
                u = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u), pa.array(np.round(n[u] * 2**32).astype(np.int64))], ["lang", "gram", "n"])
            sums.clear()

        for b in it:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = s.grams(text or "")
                if len(g):
                    if lang not in sums:
                        if len(sums) >= HELD_LANGUAGES:
                            yield from flush()
                        sums[lang] = np.zeros(ALPHABET**3)
                    u, n = np.unique(g, return_counts=True)
                    sums[lang][u] += n / len(g)
        yield from flush()

    def bundled(counts):
        part = counts.to_pandas().sort_values("gram")
        s, total, n, grams = space(dim, seed), np.zeros(dim), part.n.to_numpy(float), part.gram.to_numpy()
        for lo in range(0, len(grams), 4096):
            total += n[lo : lo + 4096] @ s.vectors(grams[lo : lo + 4096])
        total /= max(np.linalg.norm(total), 1e-300)
        return pa.table({"lang": pa.array([part.lang.iloc[0]], pa.string()), "v": pa.array([total.astype(np.float32)], pa.list_(pa.float32()))})

    bounded(labelled.sparkSession)
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))  # whole numbers: sums in any order agree
    got = sorted((r.lang, r.v) for r in counts.groupBy("lang").applyInArrow(bundled, "lang string, v array<float>").collect())
    return [lang for lang, _ in got], np.array([v for _, v in got], np.float32).reshape(len(got), dim)


def predicted(docs: DataFrame, langs: list[str], protos: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, lang_pred and score: the best cosine, at least 0.

    `und` with score 0 for null texts, texts without a letter, and where no language was learned. Ties go to the first
    language by name. Only the text is looked at.
    """
    dim = protos.shape[1]

    def run(it):
        s = space(dim, seed)
        for b in it:
            for some in parts(b, most_bytes=250_000):
                grams = [s.grams(t or "") for t in some.column(1).to_pylist()]
                sizes = np.array([len(g) for g in grams])
                pred, score = np.array(["und"] * len(grams), object), np.zeros(len(grams))
                if sizes.sum() and langs:
                    u, at = np.unique(np.concatenate(grams), return_inverse=True)
                    doc = np.repeat(np.arange(len(grams)), sizes)
                    v = np.zeros((len(grams), dim), np.float32)
                    n = np.bincount(doc * len(u) + at, minlength=len(grams) * len(u)).reshape(len(grams), len(u)).astype(np.float32)
                    for k in range(0, len(u), 4096):
                        v += n[:, k : k + 4096] @ s.vectors(u[k : k + 4096]).astype(np.float32)
                    length = np.maximum(np.linalg.norm(v, axis=1), 1e-30)
                    cos = (v @ protos.T) / length[:, None]
                    best = cos.argmax(1)
                    has = sizes > 0
                    pred[has] = np.array(langs, object)[best[has]]
                    score[has] = np.clip(cos[np.arange(len(best)), best], 0, 1)[has]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0
    langs, protos = learned(docs.where(~held & F.col("lang").isNotNull()))
    return predicted(docs, langs, protos).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
