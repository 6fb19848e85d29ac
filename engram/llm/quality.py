"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation over the counts of
vote patterns estimates how often each labeller says what on good and on bad texts, without any true label; each
pattern gets a posterior. Those posteriors train a linear scorer over hashed byte trigrams on a sample of about TRAIN_ROWS texts,
which then scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import words as w
from engram.llm.store import save

#: Texts that the linear scorer is trained on, about; all of them where there are fewer.
TRAIN_ROWS = 4000
#: Hash slots of the trigrams.
SLOTS = 2048
EM_ROUNDS = 100
#: Share of the good texts that one labeller may call bad; what keeps the two labels apart.
MOST_WRONG = 0.005

#: labeller: (measure, bad below, good from, good up to, bad above)
LABELLERS = (
    ("odd_symbols_per_byte", -1.0, -1.0, 0.01, 0.03),
    ("bars_per_word", -1.0, -1.0, 0.02, 0.10),
    ("capitals_per_letter", -1.0, -1.0, 0.12, 0.30),
    ("exclamations_per_word", -1.0, -1.0, 0.03, 0.15),
    ("short_words_per_word", 0.08, 0.15, 0.80, 0.95),
    ("bytes_per_word", 2.0, 3.0, 9.0, 14.0),
    ("digits_per_byte", -1.0, -1.0, 0.06, 0.20),
    ("ends_per_word", 0.005, 0.015, 0.30, 0.60),
    ("distinct_words_per_root_of_words", 0.10, 0.20, 99.0, 99.0),
    ("words_as_the_one_before_per_word", -1.0, -1.0, 0.05, 0.25),
    ("tied_symbols_per_word", -1.0, -1.0, 0.03, 0.15),
)
WIDTH = SLOTS + 3 * len(LABELLERS)
#: Value of a vote's slot; the trigrams of a text share 1000.
VOTE_WEIGHT = 30.0
#: Texts of fewer words get no votes.
LEAST_WORDS = 10
GOOD, NOTHING, BAD = 2, 1, 0

_ODD = w.byte_class((0x23, 0x26), (0x2A, 0x2B), (0x3C, 0x3E), (0x5B, 0x60), (0x7B, 0x7B), (0x7D, 0x7E))
_UPPER = w.byte_class((0x41, 0x5A))
_LETTER = w.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_DIGIT = w.byte_class((0x30, 0x39))
_END = w.byte_class((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))


def measures(words: w.Words) -> np.ndarray:
    """One row of the labellers' measures for each text."""
    data = words.data

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[words.offsets]).astype(float)

    count = words.counts()
    filled, size = np.maximum(count, 1), np.maximum(np.diff(words.offsets), 1)
    length = words.end - words.start
    h = words.hashes()
    order = np.lexsort((h, words.doc))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(h[order]) != 0) | (np.diff(words.doc[order]) != 0)
    distinct = np.bincount(words.doc[order][new], minlength=words.n)
    same = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    after = np.append(_ODD[data], False)
    tied = after[words.end] & (words.end < words.offsets[words.doc + 1])
    letters = np.maximum(per_text(_LETTER[data]), 1)
    return np.column_stack(
        [
            per_text(_ODD[data]) / size,
            per_text(data == ord("|")) / filled,
            per_text(_UPPER[data]) / letters,
            per_text(data == ord("!")) / filled,
            np.bincount(words.doc[length <= 3], minlength=words.n) / filled,
            np.bincount(words.doc, length, minlength=words.n) / filled,
            per_text(_DIGIT[data]) / size,
            per_text(_END[data]) / filled,
            # long texts repeat words more, as the square root of their length
            distinct / np.sqrt(filled),
            np.bincount(words.doc[1:][same], minlength=words.n) / filled,
            np.bincount(words.doc[tied], minlength=words.n) / filled,
        ]
    )


def votes(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """GOOD, NOTHING or BAD of each labeller for each text; others than the ``filled`` ones get NOTHING everywhere."""
    low, good_from, good_to, high = np.array([x[1:] for x in LABELLERS]).T
    out = np.full(values.shape, NOTHING, np.int8)
    out[(values >= good_from) & (values <= good_to)] = GOOD
    out[(values < low) | (values > high)] = BAD
    out[~filled] = NOTHING
    return out


def pattern(said: np.ndarray) -> np.ndarray:
    """The votes of a text as one number to base three."""
    return said.astype(np.int64) @ (3 ** np.arange(said.shape[1]))


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(chance of each pattern to be good, chance of votes by label and labeller, share of good texts) by EM.

    Starts from the majority of the votes; no labeller calls more than MOST_WRONG of the good texts bad.
    """
    said = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    bad, good = (said == BAD).sum(axis=1), (said == GOOD).sum(axis=1)
    # one bad vote says more than one good one: good is what most texts look like in most ways
    chance = (good + 1.0) / (good + 4.0 * bad + 2.0)
    voted = np.stack([said == v for v in (BAD, NOTHING, GOOD)], axis=2).astype(float)
    tables, share = np.zeros((2, len(LABELLERS), 3)), 0.5
    for _ in range(EM_ROUNDS):
        weight = np.stack([counts * (1 - chance), counts * chance])
        tables = np.einsum("yp,pjv->yjv", weight, voted) + 0.1
        tables /= tables.sum(axis=2, keepdims=True)
        tables[1, :, BAD] = np.minimum(tables[1, :, BAD], MOST_WRONG)
        tables /= tables.sum(axis=2, keepdims=True)
        share = min(max(weight[1].sum() / max(weight.sum(), 1), 1e-3), 1 - 1e-3)
        logs = np.einsum("pjv,yjv->py", voted, np.log(tables)) + np.log([1 - share, share])
        moved = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        if np.abs(moved - chance).max(initial=0) < 1e-7:
            break
        chance = moved
    return chance, tables, share


def _trigrams(words: w.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of each byte trigram inside one text."""
    d = words.data.astype(np.uint32)
    slot = (d[:-2] * np.uint32(0x9E3779B1) + d[1:-1] * np.uint32(0x85EBCA77) + d[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(21)
    text = np.repeat(np.arange(words.n), np.diff(words.offsets))
    inside = text[2:] == text[: max(0, len(text) - 2)]
    return text[2:][inside], slot[inside].astype(np.int64)


def _said(said: np.ndarray) -> np.ndarray:
    """Slots of the votes, behind those of the trigrams: one for each labeller and vote."""
    return SLOTS + np.arange(said.shape[1]) * 3 + said


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, words in w.chunks(batch.column(0), w.ALNUM):
            found, counts = np.unique(pattern(votes(measures(words), words.counts() >= LEAST_WORDS)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], ["pattern", "n"])


def _training(chance: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in w.chunks(batch.column(0), w.ALNUM):
                text, slot = _trigrams(words)
                said = votes(measures(words), words.counts() >= LEAST_WORDS)
                share = np.bincount(text * SLOTS + slot, minlength=words.n * SLOTS).reshape(words.n, SLOTS).astype(float)
                share *= 1000 / np.maximum(share.sum(axis=1, keepdims=True), 1)
                full = np.zeros((words.n, WIDTH))
                full[:, :SLOTS] = share
                np.put_along_axis(full, _said(said), VOTE_WEIGHT, axis=1)
                p = [chance[int(x)] for x in pattern(said)]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), WIDTH).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.float64()), lists], ["chance", "features"])

    return run


def _score(weights: np.ndarray, bias: float, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, words in w.chunks(batch.column("text"), w.ALNUM):
                text, slot = _trigrams(words)
                total = np.bincount(text, weights[slot], minlength=words.n) * 1000
                margin = bias + total / np.maximum(np.bincount(text, minlength=words.n), 1)
                margin += VOTE_WEIGHT * weights[_said(votes(measures(words), words.counts() >= LEAST_WORDS))].sum(axis=1)
                score = np.where(words.counts() > 0, 1 / (1 + np.exp(-np.clip(margin, -50, 50))), 0.0)
                kept = [batch.column(c).slice(low, words.n) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], [*columns, "score"])

    return run


def quality(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, score (chance that the text is good) and kept (score at least 0.5) of every row.

    A text without words, null included, scores 0. If all texts look alike to the labellers, every text gets their common posterior.
    """
    texts = docs.select("text")
    # at most three to the number of labellers rows
    counted = texts.mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    patterns, counts = (np.array([r[k] for r in counted], np.int64) for k in (0, 1))
    chance, _, share = estimate(patterns, counts)
    posterior = dict(zip(patterns.tolist(), chance.tolist()))
    weights, bias = np.zeros(WIDTH), float(np.log(share / (1 - share)))
    if len(chance) and chance.min() < 0.5 < chance.max():
        part = min(1.0, TRAIN_ROWS / max(1, int(counts.sum())))
        sample = texts.filter(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000)) < int(part * 1_000_000))
        rows = save(sample.mapInArrow(_training(posterior), "chance double, features array<double>"))
        # a soft label is two rows, weighed by the chance of either
        sides = [
            rows.select(array_to_vector("features").alias("features"), F.lit(float(y)).alias("label"), weight.alias("weight"))
            for y, weight in ((1, F.col("chance")), (0, 1 - F.col("chance")))
        ]
        fitted = LogisticRegression(weightCol="weight", maxIter=50, regParam=0.001).fit(sides[0].union(sides[1]).coalesce(4))
        weights, bias = fitted.coefficients.toArray(), float(fitted.intercept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    scored = docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_score(weights, bias, list(keep)), f"{schema}, score double")
    return scored.withColumn("kept", F.col("score") >= 0.5)
