"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

FEATURES = 4096
# texts whose n-grams are counted at once
TOGETHER = 512
ROUNDS, RATE, PENALTY = 200, 8.0, 1e-5
# a decision is ambiguous if the nearest two codewords' losses differ by less than this part of the bits
AMBIGUOUS = 0.1
UNDETERMINED = "und"
LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
FOLD[~LETTER & ~np.array([65 <= b <= 90 for b in range(256)])] = 32


def ngram_shares(texts: pa.Array) -> np.ndarray:
    """(texts, FEATURES): square roots of the shares of hashed byte 2- and 3-grams; everything but letters is a
    blank, and repeated blanks are one."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    raw = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    counts = np.zeros((len(texts), FEATURES))
    # long texts on their own, in pieces
    for begin, stop, first, last in pieces(offsets, 4 << 20):
        folded = FOLD[raw[begin:stop]].astype(np.uint32)
        owner = np.repeat(np.arange(first, last), np.diff(np.clip(offsets[first : last + 1], begin, stop)))
        doubled = np.zeros(len(folded), bool)
        doubled[1:] = (folded[1:] == 32) & (folded[:-1] == 32)
        folded, owner = folded[~doubled], owner[~doubled]
        for size in (2, 3):
            if len(folded) < size:
                continue
            value = folded[: len(folded) - size + 1] * np.uint32(0x9E3779B1)
            for step in range(1, size):
                value = (value ^ folded[step : len(folded) - size + 1 + step]) * np.uint32(0x85EBCA77)
            value ^= value >> np.uint32(15)
            inside = owner[: len(value)] == owner[size - 1 :]
            place = (value % np.uint32(FEATURES // 2)).astype(np.int64) + (size - 2) * (FEATURES // 2)
            flat = (owner[: len(value)] - first) * FEATURES + place
            found = np.bincount(flat[inside], minlength=(last - first) * FEATURES)
            counts[first:last] += found.reshape(last - first, FEATURES)
    return np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True))).astype(np.float32)


def pieces(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(begin, stop, first text, last text + 1): whole texts together up to ``size`` bytes, longer ones cut."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        last = min(last, len(offsets) - 1)
        for begin in range(int(offsets[first]), int(offsets[last]), max(size, 1)):
            yield begin, min(begin + size, int(offsets[last])), first, last
        first = last


def codewords(classes: int, seed: int) -> np.ndarray:
    """(classes, bits) of -1 and 1. Up to five classes: all splits. More: the best of some random codes by the
    smallest distance between codewords."""
    if classes <= 5:
        bits = max(1, 2 ** (classes - 1) - 1)
        numbers = np.arange(bits)
        rows = [np.ones(bits, int)] + [np.where(numbers >> k & 1, 1, -1) for k in range(classes - 1)]
        return np.array(rows[:classes])
    bits = 15 + 6 * math.ceil(math.log2(classes))
    random, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(20):
        code = random.choice([-1, 1], (classes, bits))
        distances = (bits - code @ code.T) // 2 + bits * np.eye(classes, dtype=int)
        if distances.min() > apart:
            best, apart = code, distances.min()
    return best


class Codes:
    """Language names, their codewords, one linear classifier per bit and how far each bit can be trusted."""

    def __init__(self, names: list[str], code: np.ndarray, weight: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.names, self.code, self.weight, self.bias, self.trust = names, code, weight, bias, trust

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, names=np.array(self.names), code=self.code, weight=self.weight, bias=self.bias, trust=self.trust)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> "Codes":
        with np.load(io.BytesIO(data)) as arrays:
            rest = [arrays[n] for n in ("code", "weight", "bias", "trust")]
            return cls(arrays["names"].tolist(), *rest)

    def losses(self, shares: np.ndarray) -> np.ndarray:
        """(texts, languages): the weighted logistic loss of every codeword."""
        margins = shares @ self.weight + self.bias
        agree = np.logaddexp(0, -margins) * self.trust
        differ = np.logaddexp(0, margins) * self.trust
        return agree @ (self.code.T == 1) + differ @ (self.code.T == -1)


def fitted(texts: list[str], names: list[str], seed: int) -> Codes:
    languages = sorted(set(names))
    code = codewords(len(languages), seed)
    shares = np.concatenate([ngram_shares(pa.array(texts[at : at + TOGETHER])) for at in range(0, len(texts), TOGETHER)])
    label = code[[languages.index(n) for n in names]].astype(np.float32)
    # every language weighs the same
    sizes = {n: names.count(n) for n in languages}
    weights = np.array([1 / (len(languages) * sizes[n]) for n in names], np.float32)[:, None]
    weight = np.zeros((FEATURES, code.shape[1]), np.float32)
    bias = np.zeros(code.shape[1], np.float32)
    squares, shift = np.zeros_like(weight), np.zeros_like(bias)
    for _ in range(ROUNDS):
        margins = shares @ weight + bias
        slope = weights * label / (1 + np.exp(np.clip(label * margins, -30, 30)))
        gradient = shares.T @ slope - PENALTY * weight
        squares += gradient**2
        weight += RATE * gradient / (np.sqrt(squares) + 1e-6) / 8
        level = slope.sum(axis=0)
        shift += level**2
        bias += level / (np.sqrt(shift) + 1e-6) / 8
    wrong = (weights * (label * (shares @ weight + bias) <= 0)).sum(axis=0)
    trust = np.maximum(0.05, np.log((1 - wrong + 0.01) / (wrong + 0.01)))
    return Codes(languages, code, weight, bias, trust / trust.mean())


def train_language(
    alerts: DataFrame,
    *,
    key: str = "alert_id",
    text: str = "alert_type",
    language: str = "language",
    where: Column | None = None,
    per_language: int = 600,
    sample: int = 8000,
    seed: int = 42,
) -> bytes:
    """Fits on at most ``per_language`` texts of each language and about ``sample`` in all, those with the smallest
    digests of their keys. Rows with a NULL text or language are left out. Without any, every text is undetermined.

    The project's records carry no language, so this works on any table with a key, a text and a language."""
    known = alerts.where(where if where is not None else F.lit(True))
    known = known.where(F.col(text).isNotNull() & F.col(language).isNotNull())
    languages = known.select(language).distinct().count()
    most = max(1, min(per_language, sample // max(1, languages)))
    # ranked by key alone: the rank filter runs before the exchange too, so a language sends few keys per task
    slim = known.select(F.col(key).alias("_key"), F.col(language).cast("string").alias("_language"))
    digest = F.md5(F.coalesce(F.col("_key").cast("string"), F.lit("null")))
    rank = F.row_number().over(W.partitionBy("_language").orderBy(digest, "_key"))
    chosen = slim.withColumn("_rank", rank).where(F.col("_rank") <= most).select("_key", "_language").distinct()
    rows = known.select(F.col(key).alias("_key"), F.col(language).cast("string").alias("_language"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), ["_key", "_language"])  # about ``sample`` rows

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_order", "_language", "text"])
        return pd.DataFrame({"model": [fitted(group["text"].tolist(), group["_language"].tolist(), seed).packed()]})

    grouped = rows.select(F.col("_key").cast("string").alias("_order"), "_language", "text", F.lit(1).alias("_all")).groupBy("_all")
    models = grouped.applyInPandas(fit, "model binary").collect()
    return bytes(models[0]["model"]) if models else b""


def predict_language(alerts: DataFrame, model: bytes, *, key: str = "alert_id", text: str = "alert_type") -> DataFrame:
    """All input columns plus ``lang_pred``, ``score`` (0 to 1, the share of the nearest codeword), ``runner_up`` and
    ``ambiguous``.

    Whole texts count. A text that is NULL or has no letter is ``und`` with score 0 and not ambiguous; so is every
    text if nothing was learnt. Ties go to the smaller name. Repeated rows are predicted alike; input columns named
    like the added ones are replaced. Only ``text`` is an input.
    """
    added = ("lang_pred", "score", "runner_up", "ambiguous")
    if {key, text} & set(added):
        raise ValueError("rename the key or text column: the result adds columns of these names")
    kept = alerts.select(*[c for c in alerts.columns if c not in added])
    shared = alerts.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes.unpacked(shared.value) if shared.value else None
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                texts = part.column(text)
                lettered = [t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()]
                best, second, score, near = [UNDETERMINED] * len(lettered), [None] * len(lettered), np.zeros(len(lettered)), [False] * len(lettered)
                if codes is not None:
                    losses = codes.losses(ngram_shares(texts))
                    chance = np.exp(losses.min(axis=1, keepdims=True) - losses)
                    chance /= chance.sum(axis=1, keepdims=True)
                    order = np.argsort(losses, axis=1, kind="stable")
                    for row in np.flatnonzero(lettered):
                        first = order[row, 0]
                        best[row], score[row] = codes.names[first], chance[row, first]
                        if len(codes.names) > 1:
                            other = order[row, 1]
                            second[row] = codes.names[other]
                            near[row] = bool(losses[row, other] - losses[row, first] < AMBIGUOUS * codes.code.shape[1])
                columns = [*part.columns, pa.array(best), pa.array(score), pa.array(second, pa.string()), pa.array(near)]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, *added])

    schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes)
    return kept.mapInArrow(predict, f"{schema}, lang_pred string, score double, runner_up string, ambiguous boolean")
