"""Toxic spans by a linear-chain conditional random field."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm.words import FOLDED, Words, slices, words_of

FEATURE_BITS = 21
# first and last bytes of a word that are features beside the word itself
AFFIXES = (3, 4, 5, 6, 8, -3, -5)
# cells of a padded block of chains
CELLS = 1 << 20
# a word form is evidence if so many times as many texts of label 1 hold it
MIN_RATIO = 8.0
ROUNDS, RATE, PENALTY = 40, 0.5, 1e-5
# a word is toxic from this marginal on; the surest so many forms decide about their text
SPAN, FORMS = 0.5, 3
# of the labelled texts, every so-manieth calibrates the document score and takes no part in the fit of the words
CALIBRATION = 4
# weights of the document score before calibration: constant, log-odds of the surest forms, which count up to SUREST
DOCUMENT, SUREST = np.array([-1.5, 0.8, 0.4, 0.2]), 8.0
# one form of these log-odds is enough for a text
ENOUGH = 4.0
# how clear a form's evidence must be, in logarithms of the forms that are looked at; the calibrating texts choose
CLEAR = (0.5, 1.2)
# bytes of text that are scored at once
SLICE = 3 << 20


def features(found: Words) -> np.ndarray:
    """(words, features): places in the weight table."""
    shift = np.uint64(64 - FEATURE_BITS)
    places = np.empty((len(found.hashed), 1 + len(AFFIXES)), np.int32, order="F")
    for column, hashes in enumerate([found.hashed, *(found.affix[k] for k in AFFIXES)]):
        places[:, column] = hashes >> shift
    return places


def places_of(found: Words) -> np.ndarray:
    """The features of the words, whose affix hashes are given up: nothing needs them any more."""
    places = features(found)
    found.affix.clear()
    return places


def compact(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places that occur, in order, and ``places`` as numbers in that list."""
    occurs = np.zeros(1 << FEATURE_BITS, bool)
    for column in range(places.shape[1]):
        occurs[places[:, column]] = True
    number, numbered = (np.cumsum(occurs) - 1).astype(np.int32), np.empty_like(places)
    for column in range(places.shape[1]):
        numbered[:, column] = number[places[:, column]]
    return np.flatnonzero(occurs), numbered


class Chains:
    """Chains of words (one per text) in blocks of similar length, time first, padded at the end."""

    def __init__(self, first: np.ndarray):
        lengths = np.diff(first)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(order):
            longest = int(lengths[order[at]])
            texts = order[at : at + max(1, CELLS // longest)]
            steps = np.arange(longest)[:, None]
            inside = steps < lengths[texts][None, :]
            self.blocks.append((np.where(inside, first[texts][None, :] + steps, 0), inside))
            at += len(texts)


def forward_backward(odds: np.ndarray, inside: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ratios state 1 : state 0, per place: of the forward sums, of the backward sums, and the product, the odds of
    the marginal. ``odds`` are the emission ratios, ``move[a, b]`` the weight of state b after state a."""
    steps, width = odds.shape
    ahead, behind = np.empty((steps, width)), np.ones((steps, width))
    ahead[0] = odds[0] * (move[0, 1] + move[1, 1]) / (move[0, 0] + move[1, 0])
    for t in range(1, steps):
        ahead[t] = odds[t] * (move[0, 1] + ahead[t - 1] * move[1, 1]) / (move[0, 0] + ahead[t - 1] * move[1, 0])
    for t in range(steps - 2, -1, -1):
        onward = odds[t + 1] * behind[t + 1]
        ratio = (move[1, 0] + move[1, 1] * onward) / (move[0, 0] + move[0, 1] * onward)
        behind[t] = np.where(inside[t + 1], ratio, 1.0)
    return ahead, behind, ahead * behind


class Field:
    """Weights of the features, the log weights of the moves between states, and the document calibration."""

    def __init__(self):
        self.weight = np.zeros(1 << FEATURE_BITS, np.float32)
        self.bias = np.array([-5.0])
        self.move = np.zeros((2, 2))
        self.document = DOCUMENT.copy()
        # whether words were learnt, and the score of every text if not
        self.evidence = np.zeros(2)

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, weight=self.weight, bias=self.bias, move=self.move, document=self.document, evidence=self.evidence)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> "Field":
        field = cls()
        with np.load(io.BytesIO(data)) as arrays:
            field.__dict__.update({name: arrays[name] for name in arrays.files})
        return field

    def odds(self, places: np.ndarray) -> np.ndarray:
        total = np.full(len(places), self.bias[0])
        for column in range(places.shape[1]):
            total += self.weight[places[:, column]]
        return np.exp(np.clip(total, -30, 30))

    def marginals(self, places: np.ndarray, chains: Chains, moved: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) per word, and the expected number of each move (zeros unless ``moved``)."""
        odds, out = self.odds(places), np.zeros(len(places))
        move, moves = np.exp(self.move), np.zeros((2, 2))
        for words, inside in chains.blocks:
            here = np.where(inside, odds[words], 1.0)
            ahead, behind, both = forward_backward(here, inside, move)
            both = both[inside]
            out[words[inside]] = both / (1 + both)
            if moved and len(here) > 1:
                linked = inside[1:]
                before, after = ahead[:-1][linked], (here[1:] * behind[1:])[linked]
                joint = np.empty((len(before), 4))
                joint[:, 0], joint[:, 1] = move[0, 0], move[0, 1] * after
                joint[:, 2], joint[:, 3] = before * move[1, 0], before * move[1, 1] * after
                joint /= (joint[:, 0] + joint[:, 1] + joint[:, 2] + joint[:, 3])[:, None]
                moves += joint.sum(axis=0).reshape(2, 2)
        return out, moves

    def document_inputs(self, marginals: np.ndarray, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """(inputs, surest marginal) per text. The inputs: 1, the log-odds of its surest distinct forms that are
        toxic words. Words that are not toxic, and repeats of a form, add nothing."""
        lengths = np.diff(found.first)
        surest = np.zeros(len(lengths))
        full = np.flatnonzero(lengths)
        if len(full):
            surest[full] = np.maximum.reduceat(marginals, found.first[:-1][full])
        inputs = np.zeros((len(lengths), len(DOCUMENT)))
        inputs[:, 0] = 1
        hot = np.flatnonzero(marginals >= SPAN)
        owner = np.searchsorted(found.first, hot, side="right") - 1
        # each form at its surest place
        order = np.lexsort((-marginals[hot], found.hashed[hot], owner))
        hot, owner = hot[order], owner[order]
        new = np.ones(len(hot), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (found.hashed[hot[1:]] != found.hashed[hot[:-1]])
        hot, owner = hot[new], owner[new]
        order = np.lexsort((-marginals[hot], owner))
        hot, owner = hot[order], owner[order]
        rank = np.arange(len(hot)) - np.searchsorted(owner, owner)
        used = rank < FORMS
        chance = np.minimum(marginals[hot[used]], 1 - 1e-12)
        inputs[owner[used], 1 + rank[used]] = np.minimum(np.log(chance / (1 - chance)), SUREST)
        return inputs, surest

    def document_scores(self, marginals: np.ndarray, found: Words) -> np.ndarray:
        """A text without a toxic word scores below one half, the higher the surer its surest word."""
        if not self.evidence[0]:
            return np.full(len(found.first) - 1, self.evidence[1])
        inputs, surest = self.document_inputs(marginals, found)
        scores = 1 / (1 + np.exp(-np.clip(inputs @ self.document, -30, 30)))
        return np.where(surest >= SPAN, scores, 0.98 * np.minimum(surest, 0.5))


def word_labels(found: Words, places: np.ndarray, label: np.ndarray, clear: float) -> np.ndarray:
    """Labels of the words from those of their texts: in a text of label 1, the words with a form that MIN_RATIO times
    as many such texts hold, and so many more than chance gives that the log-likelihood ratio reaches ``clear`` logarithms of the forms looked at."""
    text = found.text_of()
    toxic = label[text] == 1
    looked_at, places = compact(places)
    size = len(looked_at)
    both = np.array([(label == 0).sum(), (label == 1).sum()], np.float64)
    share = both[1] / max(1.0, both.sum())
    evident = np.zeros(len(places), bool)
    for column in range(places.shape[1]):
        place = places[:, column]
        pairs = place.astype(np.int64)
        pairs *= len(label)
        pairs += text
        pairs = np.unique(pairs)
        form, owner = pairs // max(1, len(label)), pairs % max(1, len(label))
        clean, bad = (np.bincount(form[label[owner] == k], minlength=size).astype(np.float64) for k in (0, 1))
        total = np.maximum(clean + bad, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(bad > 0, bad * np.log(bad / (total * share)), 0) + np.where(clean > 0, clean * np.log(clean / (total * (1 - share))), 0)
        frequent = bad / max(1, both[1]) >= MIN_RATIO * (clean + 0.5) / max(1, both[0])
        evident |= (frequent & (gain >= clear * np.log(max(2, size))))[place]
    return (toxic & evident).astype(np.float64)


def calibrated(inputs: np.ndarray, label: np.ndarray, share: float) -> np.ndarray:
    """Logistic regression near DOCUMENT, weighted to ``share``; log-odds never count against label 1, and one
    form of ENOUGH is enough for it."""
    positive = label == 1
    weight = DOCUMENT.copy()
    if not len(label):
        return weight
    rows = np.where(positive, share / max(1, positive.sum()), (1 - share) / max(1, (~positive).sum()))
    for _ in range(50):
        score = 1 / (1 + np.exp(-np.clip(inputs @ weight, -30, 30)))
        gradient = inputs.T @ (rows * (positive - score)) - 1e-2 * (weight - DOCUMENT)
        curve = (inputs * (rows * score * (1 - score))[:, None]).T @ inputs + 1e-2 * np.eye(len(weight))
        weight += np.clip(np.linalg.solve(curve, gradient), -1, 1)
        weight[1:] = np.maximum(weight[1:], 0)
    weight[1] = max(weight[1], -weight[0] / ENOUGH)
    return weight


def fitted(texts: list[str | None], label: np.ndarray, share: float) -> Field:
    """Words by maximum likelihood (adaptive gradient steps over all texts but every CALIBRATION-th), then the
    document score on the texts left out, weighted to ``share``, the part of label 1 among all labelled texts; of the
    levels in CLEAR, the one that the texts left out find likelier."""
    field = Field()
    field.evidence = np.array([0.0, share])
    if len(set(label.tolist())) < 2:
        return field
    # counted by label, so that both parts have both
    number = np.zeros(len(label), np.int64)
    for value in (0, 1):
        number[label == value] = np.arange((label == value).sum())
    aside = number % CALIBRATION == CALIBRATION - 1
    found = words_of(pa.array([t for t, a in zip(texts, aside) if a], pa.string()), FOLDED, AFFIXES)
    places, chains = places_of(found), Chains(found.first)
    rows = np.where(label[aside] == 1, share / max(1, (label[aside] == 1).sum()), (1 - share) / max(1, (label[aside] == 0).sum()))
    tried = []
    for clear in CLEAR:
        field = Field()
        field.evidence = np.array([1.0, share])
        fit_words(field, [t for t, a in zip(texts, aside) if not a], label[~aside], clear)
        marginals, _ = field.marginals(places, chains, moved=False)
        field.document = calibrated(field.document_inputs(marginals, found)[0], label[aside], share)
        scores = np.clip(field.document_scores(marginals, found), 1e-6, 1 - 1e-6)
        loss = -(rows * np.log(np.where(label[aside] == 1, scores, 1 - scores))).sum()
        tried.append((loss, -clear, field))
    return min(tried, key=lambda t: t[:2])[2]


def fit_words(field: Field, texts: list[str | None], label: np.ndarray, clear: float) -> None:
    """The weights are fitted as a list of those places only that the texts have: the others stay zero."""
    found = words_of(pa.array(texts, pa.string()), FOLDED, AFFIXES)
    places, chains = places_of(found), Chains(found.first)
    target = word_labels(found, places, label, clear)
    pairs = found.text_of()
    same = pairs[1:] == pairs[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (target[:-1][same].astype(int), target[1:][same].astype(int)), 1)
    del found, pairs, same
    used, places = compact(places)
    field.weight = np.zeros(len(used), np.float32)
    squares = {"weight": np.zeros(len(used)), "bias": np.zeros(1), "move": np.zeros((2, 2))}
    positives = max(1.0, target.sum())
    for _ in range(ROUNDS):
        marginals, moves = field.marginals(places, chains)
        error = (target - marginals) / positives
        slope = {"weight": np.zeros(len(used)), "bias": np.array([error.sum()]), "move": (seen - moves) / positives}
        for column in range(places.shape[1]):
            slope["weight"] += np.bincount(places[:, column], weights=error, minlength=len(used))
        slope["weight"] -= PENALTY * field.weight
        for name, gradient in slope.items():
            squares[name] += gradient**2
            step = RATE * gradient / (np.sqrt(squares[name]) + 1e-8)
            setattr(field, name, (getattr(field, name) + step).astype(getattr(field, name).dtype))
        field.move -= field.move[0, 0]
    weight = np.zeros(1 << FEATURE_BITS, np.float32)
    weight[used] = field.weight
    field.weight = weight


def train_toxicity(
    alerts: DataFrame,
    labels: DataFrame,
    *,
    key: str = "alert_id",
    text: str = "alert_type",
    label: str = "is_sar",
    where: Column | None = None,
    per_label: int = 1500,
) -> bytes:
    """Fits the field on at most ``per_label`` labelled texts of each label, those with the smallest digests of
    their keys; ``where`` says which rows of ``labels`` may be learnt from. Rows with a NULL key or label are left
    out. Every fourth text of a label takes no part in the fit of the words and calibrates the document score. Without
    texts of both labels the model gives every text the part of label 1, or 0 without any.

    The bound is what makes one task enough; nothing else of the corpus enters the model."""
    flag = F.col(label).cast("int")
    known = labels.where(where if where is not None else F.lit(True)).where(flag.isin(0, 1) & F.col(key).isNotNull())
    known = known.select(F.col(key).alias("_key"), flag.alias("_label"))
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    order = [F.md5(F.col("_key").cast("string")), F.col("_key"), F.col("_label")]
    sample = known.where("_label = 0").orderBy(*order).limit(per_label)
    sample = sample.union(known.where("_label = 1").orderBy(*order).limit(per_label))
    # 2 * per_label rows
    rows = alerts.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "_key")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_order", "text"], na_position="first")
        return pd.DataFrame({"model": [fitted(group["text"].tolist(), group["_label"].to_numpy(), share).packed()]})

    grouped = rows.select(F.col("_key").cast("string").alias("_order"), "text", "_label", F.lit(1).alias("_all")).groupBy("_all")
    models = grouped.applyInPandas(fit, "model binary").collect()
    if not models:
        field = Field()
        field.evidence = np.array([0.0, share])
        return field.packed()
    return bytes(models[0]["model"])


def score_toxicity(
    alerts: DataFrame, model: bytes, *, key: str = "alert_id", text: str = "alert_type", threshold: float = 0.5
) -> DataFrame:
    """All input columns plus ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) and ``spans``: array of (begin, stop,
    probability), the character ranges of words whose marginal reaches ``threshold``, neighbours joined.

    A whole text is one chain. The score follows from the surest distinct forms among the words whose marginal reaches
    one half; other words, however many, add nothing, and without such a word the score is below one half. NULL and
    wordless texts score 0 and have no spans; a marginal equal to ``threshold`` counts as reached; repeated rows score alike; input columns named like the added ones are replaced. Only ``text`` is an input.
    """
    spark = alerts.sparkSession
    shared = spark.sparkContext.broadcast(model)
    added = ("score", "predicted", "spans")
    kept = alerts.select(*[c for c in alerts.columns if c not in added or c in (key, text)])
    if {key, text} & set(added):
        raise ValueError("rename the key or text column: the result adds score, predicted and spans")
    span = pa.struct([("begin", pa.int32()), ("stop", pa.int32()), ("probability", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field.unpacked(shared.value)
        for batch in batches:
            for at, stop in slices(batch.column(text), SLICE):
                part = batch.slice(at, stop - at)
                found = words_of(part.column(text), FOLDED, AFFIXES)
                marginals, _ = field.marginals(places_of(found), Chains(found.first), moved=False)
                scores = field.document_scores(marginals, found)
                spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
                hot = np.flatnonzero(marginals >= threshold)
                owners = np.searchsorted(found.first, hot, side="right") - 1
                for owner in np.unique(owners):
                    offset = found.offset[owner]
                    raw = found.data[offset : found.offset[owner + 1]]
                    characters = np.cumsum((raw & 0xC0) != 0x80)
                    last = None
                    for word in hot[owners == owner]:
                        begin = int(characters[found.start[word] - offset]) - 1
                        stop = int(characters[found.end[word] - 1 - offset])
                        if last == word - 1:
                            spans[owner][-1].update(stop=stop, probability=max(spans[owner][-1]["probability"], float(marginals[word])))
                        else:
                            spans[owner].append({"begin": begin, "stop": stop, "probability": float(marginals[word])})
                        last = word
                columns = [*part.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(span))]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, *added])

    schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes)
    kinds = "array<struct<begin: int, stop: int, probability: double>>"
    return kept.mapInArrow(score, f"{schema}, score double, predicted int, spans {kinds}")
