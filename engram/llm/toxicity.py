"""Toxicity by gradient-boosted trees over dense features of the text, with isotonic calibration.

Features: densities of a lexicon, its words near second-person words, capitals, punctuation, obfuscation. The lexicon is learned from
the labelled training rows: words, and word beginnings of a few bytes, whose share of toxic texts is significant. It holds
hashes, so one binary search tells whether a word is in it. Trees and lexicon are fitted on a sample of SAMPLE_ROWS
labelled rows; everything else runs over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm import words as w
from engram.llm.boosting import fit
from engram.llm.store import save

#: Labelled rows that lexicon and trees are fitted on, about; all of them where there are fewer.
SAMPLE_ROWS = 10_000
#: Terms of the lexicon at most, the most significant first.
LEXICON_TERMS = 4096
#: Least deviation of a term's toxic texts from its share, in standard deviations, and least log odds ratio.
LEAST_DEVIATION, LEAST_ODDS = 5.2, 2.0
#: Bytes of the word beginnings that count as terms besides whole words.
BEGINNINGS = (4, 5, 6)
#: Words between a lexicon word and a second-person word at most.
NEAR_WORDS = 5

SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros vuestro"
).split()
FEATURES = (
    "weight_per_word",
    "hits_per_word",
    "hits",
    "largest_weight",
    "hits_near_second_person",
    "second_person_per_word",
    "capitals_per_byte",
    "capital_words_per_word",
    "exclamations_per_word",
    "questions_per_word",
    "punctuation_per_byte",
    "digits_per_byte",
    "masked_letters_per_word",
    "stretched_letters_per_word",
    "log_words",
)

_WORD = w.ALNUM | w.byte_class((0x24, 0x24), (0x2A, 0x2A), (0x40, 0x40))  # $ * @ stand for letters in masked words
_UPPER = w.byte_class((0x41, 0x5A))
_LETTER = w.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_DIGIT = w.byte_class((0x30, 0x39))
_MASK = w.byte_class((0x24, 0x24), (0x2A, 0x2A), (0x40, 0x40), (0x30, 0x39))
_PUNCT = w.byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


def _terms(words: w.Words) -> list[np.ndarray]:
    """Hash of each whole word, and of its beginnings (0 where the word is not longer)."""
    sums = words.sums()
    out = [words.hashes(sums)]
    for size in BEGINNINGS:
        h = w.mix(words.hashes(sums, size) + np.uint64(size))
        h[words.end - words.start <= size] = 0
        out.append(h)
    return out


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, texts, toxic texts) of each chunk of (text, label)."""
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for low, words in w.chunks(batch.column(0), _WORD):
            pairs = np.concatenate([np.stack([h, words.doc.astype(np.uint64)]) for h in _terms(words)], axis=1)
            pairs = pairs[:, pairs[0] != 0]
            order = np.lexsort(pairs)
            pairs = pairs[:, order]
            new = np.ones(pairs.shape[1], bool)
            new[1:] = (np.diff(pairs[0]) != 0) | (np.diff(pairs[1]) != 0)
            term, doc = pairs[:, new]
            terms, at, count = np.unique(term, return_inverse=True, return_counts=True)
            toxic = np.bincount(at, labels[low + doc.astype(np.int64)], minlength=len(terms)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms.view(np.int64)), pa.array(count), pa.array(toxic)], ["term", "texts", "toxic"]
            )


def learn_lexicon(labelled: DataFrame) -> dict[int, float]:
    """Log odds ratio of each significant term. ``labelled``: text, label; LEXICON_TERMS terms reach the driver at most."""
    rows, bad = labelled.agg(F.count("*"), F.sum("label")).first()
    if not bad or bad == rows:
        return {}
    share = bad / rows
    counts = labelled.select("text", F.col("label").cast("int")).mapInArrow(_term_counts, "term long, texts long, toxic long")
    counts = counts.groupBy("term").agg(F.sum("texts").alias("n"), F.sum("toxic").alias("t"))
    deviation = (F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    odds = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (rows - bad + 1))
    best = counts.select("term", deviation.alias("z"), odds.alias("odds"))
    best = best.filter((F.col("z") >= LEAST_DEVIATION) & (F.col("odds") >= LEAST_ODDS))
    return {r["term"]: r["odds"] for r in best.orderBy(F.desc("z"), "term").limit(LEXICON_TERMS).collect()}


class Features:
    def __init__(self, lexicon: dict[int, float]):
        keys = np.array(sorted(lexicon), np.int64)
        self.weights = np.array([lexicon[int(k)] for k in keys], float)
        order = np.argsort(keys.view(np.uint64))
        self.keys, self.weights = keys.view(np.uint64)[order], self.weights[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        (_, second), *_ = w.chunks(pa.array([" ".join(SECOND_PERSON)]), _WORD)
        self.second = np.unique(second.hashes())

    def weigh(self, terms: list[np.ndarray]) -> np.ndarray:
        """Largest weight among the terms of each word, 0 for none."""
        out = np.zeros(len(terms[0]))
        if len(self.keys):
            for h in terms:
                near = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.keys, h[near]), len(self.keys) - 1)
                same = self.keys[at] == h[near]
                out[near[same]] = np.maximum(out[near[same]], self.weights[at[same]])
        return out

    def rows(self, words: w.Words) -> np.ndarray:
        """One row of FEATURES for each text."""
        n, data = words.n, words.data

        def per_text(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
            return np.diff(total[words.offsets]).astype(float)

        of_words = lambda values: np.bincount(words.doc, values, minlength=n)
        terms = _terms(words)
        weight = self.weigh(terms)
        hit = weight > 0
        second = np.isin(terms[0], self.second)
        before = np.concatenate([[0], np.cumsum(second)])
        bounds, k = words.bounds(), np.arange(len(words.doc))
        low = np.maximum(k - NEAR_WORDS, bounds[words.doc])
        high = np.minimum(k + NEAR_WORDS + 1, bounds[words.doc + 1])
        close = hit & (before[high] > before[low])
        upper, letter, mask = _UPPER[data], _LETTER[data], _MASK[data]
        capital = np.concatenate([[0], np.cumsum(upper, dtype=np.int64)])
        length = words.end - words.start
        shouted = (capital[words.end] - capital[words.start] == length) & (length >= 3)
        masked, stretched = np.zeros(len(data), bool), np.zeros(len(data), bool)
        masked[1:-1] = letter[:-2] & mask[1:-1] & letter[2:]
        stretched[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (data[2:] < 0x80)
        largest = np.zeros(n)
        np.maximum.at(largest, words.doc[hit], weight[hit])
        count = np.maximum(words.counts(), 1).astype(float)
        size = np.maximum(np.diff(words.offsets), 1).astype(float)
        hits = of_words(hit.astype(float))
        return np.column_stack(
            [
                of_words(weight) / count,
                hits / count,
                hits,
                largest,
                of_words(close.astype(float)),
                of_words(second.astype(float)) / count,
                per_text(upper) / size,
                of_words(shouted.astype(float)) / count,
                per_text(data == ord("!")) / count,
                per_text(data == ord("?")) / count,
                per_text(_PUNCT[data]) / size,
                per_text(_DIGIT[data]) / size,
                per_text(masked) / count,
                per_text(stretched) / count,
                np.log1p(words.counts()),
            ]
        )


def _with_features(features: Features, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, words in w.chunks(batch.column("text"), _WORD):
                rows = features.rows(words)
                offsets = pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1)))
                kept = [batch.column(c).slice(low, words.n) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, lists], [*columns, "features"])

    return run


def add_features(docs: DataFrame, lexicon: dict[int, float], keep: list[str]) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    docs = docs.select(*dict.fromkeys([*keep, "text"]))
    return docs.mapInArrow(_with_features(Features(lexicon), keep), f"{schema}, features array<double>")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame):
    """(lexicon, function that adds ``score`` to rows with features), from labelled rows outside fold 0."""
    known = labels.filter((fold(F.col("doc_id")) != 0) & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    part = min(1.0, SAMPLE_ROWS / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(part * 1_000_000))
    # about SAMPLE_ROWS small rows, whatever the number of labels
    labelled = save(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))
    lexicon = learn_lexicon(labelled)
    rows = save(add_features(labelled, lexicon, ["doc_id", "label"]))
    return lexicon, fit(rows, F.col("doc_id"), calibrate=True)


def toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, held_out, score, predicted for every row of docs; the text alone makes the score.

    A null text counts as empty and is scored too. A null doc_id is not held out. Null labels are left out; of several labels
    of one document the highest counts. Without labels of both kinds the score is their mean, 0 without any.
    """
    lexicon, score = train(docs, labels)
    rows = score(add_features(docs, lexicon, list(keep)))
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return rows.select(*keep, held_out.alias("held_out"), "score", predicted.cast("int").alias("predicted"))
