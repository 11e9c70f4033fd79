"""Toxicity by a support vector machine on a gapped subsequence kernel with Nystrom landmarks."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, release_memory, pieces_array, stored, text_buffer, text_or_empty, text_slices
from .lang_id import fold

#: Letters are mapped to this many symbols: a-z, and the rest dealt over what is left.
SYMBOLS = 32
LENGTH = 3
SPAN = 6
DECAY = 0.6
#: Bounds of what the model is fitted on: documents by label, witness words, other words, landmarks.
SAMPLE_DOCS = {1: 1500, 0: 6000}
WITNESSES = 1024
OTHERS = 4000
MINED = 2000
LANDMARKS = (128, 160)
ROUNDS = 3
RIDGE = 0.01
THRESHOLD = 0.3

_GAPS = [(a, b, DECAY ** (b - 2)) for b in range(2, SPAN) for a in range(1, b)]
_BLANK, _DROP = 254, 255


@functools.lru_cache(1)
def _symbol_table() -> np.ndarray:
    """Code point to symbol, to a word break, or to nothing at all."""
    table = np.full(0x110000, _DROP, np.uint8)
    for code in range(0x110000):
        char = chr(code)
        if char.isspace():
            table[code] = _BLANK
        elif unicodedata.category(char)[0] == "L":
            low = char.lower()
            k = ord(low[0]) - ord("a")
            table[code] = k if 0 <= k < 26 else 26 + ord(low[0]) % (SYMBOLS - 26)
    return table


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words one after another, where each word starts (and the last ends), and each word's text.

    A word is the letters between two white spaces, whatever stands between
    them ("i.d.i.o.t"); three or more lone letters in a row are one word
    ("i d i o t"); a letter repeated more than twice counts twice; words of less
    than three letters are left out.
    """
    symbols = _symbol_table()[np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    text_starts = np.searchsorted(np.flatnonzero((raw & 0xC0) != 0x80), at)
    text = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(text_starts))
    kept = symbols < SYMBOLS
    breaks = np.cumsum(symbols == _BLANK) + text  # a new number for each white space and each text
    letters, word, text = symbols[kept], breaks[kept], text[kept]
    if not len(letters):
        return letters, np.zeros(1, np.int64), np.zeros(0, np.int64)
    new = np.append(True, word[1:] != word[:-1])
    starts = np.flatnonzero(new)
    lengths, texts = np.diff(np.append(starts, len(letters))), text[starts]
    lone = lengths == 1
    joins = np.append(False, lone[1:] & lone[:-1] & (texts[1:] == texts[:-1]))
    run = np.cumsum(~joins)
    long_run = np.bincount(run)[run] >= 3
    starts = starts[~(joins & long_run)]
    first = np.zeros(len(letters), bool)
    first[starts] = True
    word = np.cumsum(first) - 1
    same = np.zeros(len(letters), bool)
    same[2:] = (letters[2:] == letters[1:-1]) & (letters[2:] == letters[:-2]) & (word[2:] == word[:-2])
    letters, word, text = letters[~same], word[~same], text[~same]
    lengths = np.bincount(word)
    enough = lengths >= LENGTH
    letters, text = letters[enough[word]], text[np.cumsum(lengths) - lengths][enough]
    return letters, np.concatenate([[0], np.cumsum(lengths[enough])]), text


def _coded(letters: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Words as strings of one ASCII character for each symbol."""
    return pieces_array(letters + np.uint8(64), starts)


def _letters(words) -> tuple[np.ndarray, np.ndarray]:
    joined = "".join(words).encode()
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
    return np.frombuffer(joined, np.uint8) - np.uint8(64), starts


def _subsequences(letters: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each way to place the gaps: places where a subsequence begins, its number, and its weight."""
    s = letters.astype(np.int64)
    end = np.repeat(starts[1:], np.diff(starts))
    place = np.arange(len(s))
    for a, b, weight in _GAPS:
        at = place[place + b < end]
        yield at, (s[at] * SYMBOLS + s[at + a]) * SYMBOLS + s[at + b], weight


def kernel_features(words) -> np.ndarray:
    """Weights of all subsequences of each word; two rows' product is the kernel of their words."""
    letters, starts = _letters(words)
    row = np.repeat(np.arange(len(words)), np.diff(starts))
    out = np.zeros((len(words), SYMBOLS**LENGTH))
    for at, number, weight in _subsequences(letters, starts):
        np.add.at(out, (row[at], number), weight)
    return out


def decision(letters: np.ndarray, starts: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Decision value of each word: its kernel with the whole expansion, folded into one weight per subsequence."""
    value = np.zeros(len(letters))
    for at, number, weight in _subsequences(letters, starts):
        value[at] += weights[number] * weight
    total = np.concatenate([[0.0], np.cumsum(value)])
    return total[starts[1:]] - total[starts[:-1]] + bias


def _against(words, landmarks: np.ndarray) -> np.ndarray:
    letters, starts = _letters(words)
    row = np.repeat(np.arange(len(words)), np.diff(starts))
    out = np.zeros((len(words), len(landmarks)))
    for at, number, weight in _subsequences(letters, starts):
        for k, landmark in enumerate(landmarks):
            out[:, k] += np.bincount(row[at], landmark[number] * weight, len(words))
    return out


@dataclass(frozen=True)
class Model:
    """Weight per subsequence and bias of the word machine; intercept and slopes of the document's probability."""

    weights: np.ndarray
    bias: float
    slopes: tuple[float, float, float]


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            letters, starts, text = words_of(*text_buffer(part.column("text")))
            rows = pa.table({"bag": part.column("bag").take(pa.array(text)), "toxic": part.column("toxic").take(pa.array(text)),
                             "word": _coded(letters, starts).cast(pa.string())})
            yield from rows.group_by(["bag", "toxic", "word"]).aggregate([]).select(["bag", "toxic", "word"]).to_batches()


def document_features(model, column: str = "text"):
    """Largest decision value and number of words above zero of each document; other columns than ``text`` stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            for part in text_slices(batch, column):
                letters, starts, text = words_of(*text_buffer(part.column(column)))
                most, hits = np.full(part.num_rows, -10.0), np.zeros(part.num_rows, np.int64)
                if len(text):
                    words = _coded(letters, starts).dictionary_encode()
                    f = decision(*_arrays(words.dictionary), weights, bias)[words.indices.to_numpy()]
                    some, first = np.unique(text, return_index=True)
                    most[some] = np.maximum.reduceat(f, first)
                    hits = np.bincount(text, f > 0, part.num_rows).astype(np.int64)
                rest = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in rest), pa.array(most), pa.array(hits)], names=[*rest, "most", "hits"]
                )

    return run


def _arrays(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, at = text_buffer(words)
    return raw - np.uint8(64), at


def _word_values(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            f = decision(*_arrays(batch.column("word")), weights, bias)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(f)], names=["word", "f"])

    return run


def _machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Squared-hinge support vector machine by Newton steps on its active set; the last column of ``z`` is 1."""
    w = np.zeros(z.shape[1])
    ridge = RIDGE * weight.sum() / 100 * np.eye(z.shape[1])
    for _ in range(50):
        active = y * (z @ w) < 1
        scaled = z[active] * weight[active, None]
        new = np.linalg.solve(ridge + z[active].T @ scaled, scaled.T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    b = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1e-3] * (x.shape[1] - 1)]) * weight.sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(b)), x.T @ (weight * (y - p)) - ridge @ b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def _inputs(most, hits) -> np.ndarray:
    most, hits = np.asarray(most, float), np.asarray(hits, float)
    return np.stack([np.ones(len(most)), np.clip(most, -2, 3), np.log1p(hits)], 1)


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Model | None:
    """The machine learned from labelled documents; None where either label is missing.

    Labels mark documents, the machine judges words: each toxic document of the
    sample names up to three witnesses, the words most frequent in toxic
    documents among those that are rare in others. Words of clean documents are
    the other side, first at random, then those that the last machine found
    most toxic (``ROUNDS`` times over all words of the sample). Sample sizes
    are the constants above; documents are chosen by the hash of their id, equal
    texts once. Subsequence weights come from the Nystrom expansion over the
    landmarks, so scoring a word needs no kernel with each of them.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col(doc_id).alias("bag"), F.col(label).cast("int").alias("toxic")).filter("bag is not null and toxic in (0, 1)")
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("bag"), "bag")
    most = F.when(F.col("toxic") == 1, SAMPLE_DOCS[1]).otherwise(SAMPLE_DOCS[0])
    chosen = marks.distinct().withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max(SAMPLE_DOCS.values()))
    chosen = chosen.filter(F.col("_n") <= most).select("bag", "toxic")
    texts = docs.select(F.col(doc_id).alias("_id"), text_or_empty(text).alias("text"))
    # at most the sample's ids
    sample = stored(
        texts.join(F.broadcast(chosen), F.col("_id") == F.col("bag")).drop("_id").dropDuplicates(["text"]).repartition("bag"), "toxic-sample"
    )
    kind = sample.schema["bag"].dataType.simpleString()
    bags = stored(sample.mapInArrow(giving_back(_document_words), f"bag {kind}, toxic int, word string"), "toxic-words")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    odds = F.log((F.col("d1") + 0.5) / sizes[1]) - F.log((F.col("d0") + 0.5) / sizes[0])
    words = bags.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("d1"), F.count_if(F.col("toxic") == 0).alias("d0"))
    words = stored(words.withColumn("telling", (F.col("d1") >= 3) & (odds > 2)), "toxic-counts")
    rank = Window.partitionBy("bag").orderBy(F.desc("d1"), "word")
    told = bags.filter("toxic = 1").join(words.filter("telling"), "word").withColumn("_r", F.row_number().over(rank)).filter("_r <= 3")
    told = told.groupBy("word").count().orderBy(F.desc("count"), "word").limit(WITNESSES).toPandas()
    if not len(told):
        return None
    others = words.filter("d0 > 0").join(F.broadcast(spark.createDataFrame(told[["word"]])), "word", "left_anti").select("word")
    negative = [r["word"] for r in others.orderBy(F.xxhash64("word"), "word").limit(OTHERS).collect()]

    positive = told["word"].tolist()
    landmarks = kernel_features(positive[: LANDMARKS[0]] + negative[: LANDMARKS[1]])
    size, turn = np.linalg.eigh(landmarks @ landmarks.T)
    usable = size > 1e-6 * size.max()
    whiten = turn[:, usable] / np.sqrt(size[usable])
    support = np.sqrt(told["count"].to_numpy(float))
    mined = sorted(negative)
    for step in range(ROUNDS + 1):
        z = _against(positive + mined, landmarks) @ whiten
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(mined))])
        weight = np.concatenate([support / support.sum() * len(mined), np.ones(len(mined))])
        w = _machine(np.column_stack([z, np.ones(len(z))]), y, weight)
        weights, bias = (whiten @ w[:-1]) @ landmarks, float(w[-1])
        del z
        release_memory()
        if step < ROUNDS:
            machine = spark.sparkContext.broadcast((weights, bias))
            hard = others.mapInArrow(giving_back(_word_values(machine)), "word string, f double").orderBy(F.desc("f"), "word").limit(MINED)
            mined = sorted({*mined, *(r["word"] for r in hard.collect())})

    machine = spark.sparkContext.broadcast((weights, bias))
    seen = sample.mapInArrow(giving_back(document_features(machine)), f"bag {kind}, toxic int, most double, hits long").toPandas()
    y = seen["toxic"].to_numpy(float)
    total = sum(counts.values())
    share = np.where(y == 1, counts[1] / total / max(y.sum(), 1), counts[0] / total / max((1 - y).sum(), 1)) * len(y)
    return Model(weights, bias, tuple(_logistic(_inputs(seen["most"], seen["hits"]), y, share).tolist()))


def _score(model: Model):
    intercept, slope, hits = model.slopes
    clipped = F.greatest(F.lit(-2.0), F.least(F.lit(3.0), F.col("most")))
    return 1 / (1 + F.exp(-(intercept + slope * clipped + hits * F.log1p(F.col("hits").cast("double")))))


def score_toxicity(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns with score and predicted, one row per row of ``docs``.

    The score is the probability that a document with such words is labelled
    toxic, from its most toxic word and the number of toxic ones, over the whole
    text. A null or empty text scores as a text without words; without a model
    every score is 0.
    """
    # a text that is kept anyway goes to the workers once
    column = text if text in keep else "text"
    rows = docs.select(*keep) if text in keep else docs.select(*keep, text_or_empty(text).alias("text"))
    if model is None:
        return rows.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    machine = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    found = rows.mapInArrow(giving_back(document_features(machine, column)), f"{kinds}, most double, hits long")
    found = found.withColumn("score", _score(model))
    return found.select(*keep, "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted; learned outside fold ``held`` only."""
    outside = lambda df: df.filter(fold(F.col("doc_id"), folds) != held)
    model = fit_toxicity(outside(docs), outside(labels))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted")


def clean_documents(docs: DataFrame, known: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, text: str = "text") -> DataFrame:
    """``docs`` without the documents predicted toxic, all columns kept; learned from ``known`` and ``labels`` outside a fold."""
    outside = lambda df: df.filter(fold(F.col("doc_id"), folds) != held)
    model = fit_toxicity(outside(known), outside(labels))
    whole = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)])
    kept = score_toxicity(whole, model, f"_{docs.columns.index(text)}", tuple(whole.columns)).filter("predicted = 0")
    return kept.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
