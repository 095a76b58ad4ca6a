"""Language identification by error-correcting output codes.

Every learned language has a codeword of bits. One binary classifier per bit, a logistic
model on hashed byte n-grams, predicts that bit from a text; the language whose codeword
is nearest to all the answers is chosen. Nearness is a sum of losses, each bit weighted
by how well its classifier tells the language in training (loss-weighted decoding). Texts
whose two best languages are almost equally near are flagged as ambiguous.

Classifiers are fitted on a bounded sample: about TRAIN_PER_LANGUAGE rows of each
language, drawn by a hash of doc_id. Their features are made in Spark tasks; the driver
gets one vector of DIMENSIONS floats for each of them. Prediction reads whole texts.

Defined results for odd input: null texts and texts without a letter are `und` with score
0 and count as ambiguous; without any labelled row every text is; with a single learned
language every text with a letter has that one; null doc_ids are neither held out nor
learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan
from .common import digest_column, releasing, small_batches, table

TRAIN_PER_LANGUAGE = 400
DIMENSIONS = 4096
GRAMS = (1, 2, 3)
MAX_BITS = 31
STEPS = 150
RATE = 4.0
DECAY = 1e-4
#: Two languages are told apart if the nearer one has at least this much more of the score.
AMBIGUOUS = 0.1
UNKNOWN = "und"
ROWS = 256

# ASCII letters in lower case and all bytes beyond ASCII stay; the rest is a blank.
_CLASS = np.full(256, 0x20, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams, one row per text, in pieces of bounded size."""
    rows = len(offsets) - 1
    counts = np.zeros(rows * DIMENSIONS)
    reach = max(GRAMS) - 1
    for c in range(0, len(data), bytescan.SLICE):
        piece = _CLASS[data[c : c + bytescan.SLICE + reach]].astype(np.uint32)
        owner = np.repeat(np.arange(rows), np.diff(np.clip(offsets, c, c + len(piece))))
        code = np.zeros(len(piece), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            k = min(bytescan.SLICE, len(piece) - n + 1)
            if k <= 0:
                break
            code = code[:k] * np.uint32(257) + piece[n - 1 : n - 1 + k] + np.uint32(1)
            if n in GRAMS:
                inside = owner[:k] == owner[n - 1 : n - 1 + k]
                bins = ((code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(7)) % np.uint32(DIMENSIONS)
                counts += np.bincount((owner[:k] * DIMENSIONS + bins)[inside], minlength=rows * DIMENSIONS)
    x = np.sqrt(counts.reshape(rows, DIMENSIONS))
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def vectors(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row, features) for runs of at most ROWS texts."""
    for i, j, data, offsets in bytescan.text_slices(texts):
        for k in range(0, j - i, ROWS):
            m = min(k + ROWS, j - i)
            yield i + k, i + m, _grams(data[offsets[k] : offsets[m]], offsets[k : m + 1] - offsets[k])


def codewords(count: int) -> np.ndarray:
    """One row of -1 and 1 per language; no two columns alike or opposite.

    All possible splits where they are few, else the ones that a fixed draw gives, the
    best of several by its least distance.
    """
    if count < 2:
        return np.ones((count, 0))
    if 2 ** (count - 1) - 1 <= MAX_BITS:
        splits = [s for k in range(1, count) for s in combinations(range(count), k) if 0 in s]
        code = np.full((count, len(splits)), -1.0)
        for b, s in enumerate(splits):
            code[list(s), b] = 1.0
        return code
    rng, best, most = np.random.default_rng(count), None, -1.0
    for _ in range(64):
        code = np.where(rng.random((count, MAX_BITS)) < 0.5, -1.0, 1.0)
        apart = min((code[a] != code[b]).sum() for a, b in combinations(range(count), 2))
        if apart > most and (np.abs(code.sum(axis=0)) < count).all():
            best, most = code, apart
    return best


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray) -> None:
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the nearest codeword, score, ambiguous)."""
        if len(self.languages) == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool)
        margins = x @ self.weights + self.bias
        losses = np.einsum("nkb,kb->nk", np.logaddexp(0, -margins[:, None, :] * self.code[None]), self.trust)
        near = np.exp(-(losses - losses.min(axis=1, keepdims=True)) * self.code.shape[1])
        near /= near.sum(axis=1, keepdims=True)
        ranked = np.sort(near, axis=1)
        return near.argmax(axis=1), ranked[:, -1], ranked[:, -1] - ranked[:, -2] < AMBIGUOUS


def _fit(x: np.ndarray, y: np.ndarray, languages: list[str]) -> Model:
    code = codewords(len(languages))
    bits = code.shape[1]
    weights, bias = np.zeros((DIMENSIONS, bits), np.float32), np.zeros(bits, np.float32)
    if not bits:
        return Model(languages, code, weights, bias, code)
    want = code[y].astype(np.float32)
    share = (1.0 / np.bincount(y, minlength=len(languages))[y] / len(languages)).astype(np.float32)[:, None]
    pull_w, pull_b = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(STEPS):
        wrong = share * want / (1.0 + np.exp(want * (x @ weights + bias)))
        pull_w = 0.9 * pull_w + x.T @ wrong - DECAY * weights
        pull_b = 0.9 * pull_b + wrong.sum(axis=0)
        weights, bias = weights + RATE * pull_w, bias + RATE * pull_b
    right = (np.sign(x @ weights + bias) == want).astype(float)
    trust = np.array([right[y == k].mean(axis=0) for k in range(len(languages))]) + 1e-6
    return Model(languages, code, weights, bias, trust / trust.sum(axis=1, keepdims=True))


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, x in vectors(batch.column(1)):
            packed = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), packed], ["lang", "draw", "x"])


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    """A model from rows that are not held out and have a language and a letter."""
    usable = docs.filter(F.col(key).isNotNull() & ~held_out(key) & F.col(lang).isNotNull())
    counts = dict(usable.groupBy(F.col(lang).cast("string")).count().collect())
    languages = sorted(counts)
    if not languages:
        return Model([], np.ones((0, 0)), np.zeros((DIMENSIONS, 0)), np.zeros(0), np.ones((0, 0)))
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1_000_000))
    chance = F.create_map(*(F.lit(v) for k in languages for v in (k, min(1_000_000, -(-per_language * 1_000_000 // counts[k])))))
    sample = usable.filter(draw < F.try_element_at(chance, F.col(lang).cast("string"))).filter(F.col(text).rlike(r"\p{L}"))
    made = sample.select(F.col(lang).cast("string").alias("lang"), text, F.xxhash64(key).alias("draw"))
    rows = sorted(made.mapInArrow(releasing(_features), "lang string, draw long, x binary").collect(), key=lambda r: (r.lang, r.draw, r.x))
    languages = sorted({r.lang for r in rows})
    if not languages:
        return Model([], np.ones((0, 0)), np.zeros((DIMENSIONS, 0)), np.zeros(0), np.ones((0, 0)))
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(len(rows), DIMENSIONS)
    return _fit(x, np.array([languages.index(r.lang) for r in rows]), languages)


def _predictor(model: Model, text: str, keep: int):
    """The first `keep` columns stay; the last tells whether the text has a letter. The text is the
    last but one, or a field of the first column if that is a struct of everything."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            texts = batch.column(keep) if batch.num_columns > keep + 1 else batch.column(0).field(text)
            letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, x in vectors(texts):
                known = letters[i:j] & bool(model.languages)
                best, score, unsure = np.full(j - i, len(model.languages)), np.zeros(j - i), np.ones(j - i, bool)
                if known.any():
                    best[known], score[known], unsure[known] = model.decode(x[known])
                made = [pa.array(names[best], pa.string()), pa.array(score.astype(float)), pa.array(unsure)]
                rest = [batch.column(c).slice(i, j - i) for c in range(keep)]
                yield pa.RecordBatch.from_arrays([*rest, *made], [*batch.schema.names[:keep], "lang_pred", "score", "ambiguous"])

    return predict


def predicted(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` with lang_pred, score and ambiguous; without `keep` one column `row`, the whole row."""
    small_batches(docs.sparkSession)
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(digest_column("_letter", docs.columns))
    if keep is None:
        source, count = docs.select(F.struct(*docs.columns).alias("row"), letter), 1
    else:
        source, count = docs.select(*keep, F.col(text).alias(digest_column("_text", docs.columns)), letter), len(keep)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:count])
    return source.mapInArrow(releasing(_predictor(model, text, count)), f"{kinds}lang_pred string, score double, ambiguous boolean")


def op6_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predicted(docs, train(docs), keep=["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")
