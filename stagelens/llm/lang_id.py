"""Language identification by compression with one raw-content dictionary per language."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, text_buffer, text_or_empty, text_slices

UNKNOWN = "und"
#: The model is fitted on this many documents a language, so many characters of each; with more languages than these, all
#: of them share the characters that these would have, and no dictionary has fewer than the last number.
SAMPLE_DOCS = 64
SAMPLE_CHARS = 2000
FULL_LANGUAGES = 64
FEWEST_CHARS = 1024
CHUNK = 1024
#: Texts up to this many bytes are compressed in a finer way.
SHORT = 600
#: The documents of a language meet in so many tasks, before the sample of each of these meets in one.
SPREAD = 64
SHARPNESS = 30.0
#: The second language must cost this part more than the best; of held-out labelled documents nearly all have such a
#: margin, and hardly any have it among the other languages (figures in the README).
LEAST_MARGIN = 0.05


@functools.lru_cache(1)
def _letter_table() -> np.ndarray:
    """Code point to its lower-case letter, or to a space."""
    table = np.full(0x110000, 0x20, np.uint32)
    for code in range(0x110000):
        if unicodedata.category(chr(code))[0] == "L":
            low = chr(code).lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def letters_only(raw: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Texts in lower case, each run of anything but letters as one space; and where each text starts."""
    codes = _letter_table()[np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    starts = np.searchsorted(lead, at)
    space = codes == 0x20
    keep = ~space
    keep[1:] |= ~space[:-1]
    edges = starts[(starts > 0) & (starts < len(codes))]
    keep[edges] = ~space[edges]
    kept = codes[keep]
    width = 1 + (kept >= 0x80) + (kept >= 0x800) + (kept >= 0x10000)
    before = np.concatenate([[0], np.cumsum(keep)])[starts]
    return kept.tobytes().decode("utf-32-le").encode("utf-8"), np.concatenate([[0], np.cumsum(width)])[before]


@functools.lru_cache(4)
def _compressors(dictionaries: tuple[bytes, ...]):
    import zstandard as zstd

    def one(content: bytes, shortest: int):
        setting = zstd.ZstdCompressionParameters.from_level(
            5, source_size=CHUNK, dict_size=len(content), min_match=shortest,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        known = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=setting)
        return zstd.ZstdCompressor(compression_params=setting, dict_data=known).compress

    return [(one(content, 4), one(content, 3)) for content in dictionaries]


def _costs(text: memoryview, compressors) -> list[int]:
    if len(text) <= SHORT:
        # repeated, as a frame that saves too few bytes would hold the text itself
        again = (text.tobytes() + b" ") * 4
        return [len(usual(again)) + len(fine(again)) for usual, fine in compressors]
    parts = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
    return [sum(len(usual(p)) for p in parts) for usual, _ in compressors]


def _predict(model, column: str = "text"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, contents = model.value
        compressors = _compressors(contents)
        for batch in batches:
            for part in text_slices(batch, column):
                letters, at = letters_only(*text_buffer(part.column(column)))
                view, said, scores, margins = memoryview(letters), [], [], []
                for i in range(part.num_rows):
                    text = view[at[i] : at[i + 1]]
                    if not names or not text.tobytes().strip():
                        said.append(UNKNOWN)
                        scores.append(0.0)
                        margins.append(0.0)
                        continue
                    costs = np.array(_costs(text, compressors), float)
                    best = int(costs.argmin())
                    said.append(names[best])
                    scores.append(float(1 / ((costs[best] / costs) ** SHARPNESS).sum()))
                    second = np.partition(costs, 1)[1] if len(costs) > 1 else np.inf
                    margins.append(float(second / costs[best] - 1))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in part.schema.names if c != "text"), pa.array(said, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())],
                    names=[*(c for c in part.schema.names if c != "text"), "lang_pred", "score", "margin"],
                )

    return run


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text, which is in fold 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fit_languages(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
    sample: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, full: int = FULL_LANGUAGES,
) -> tuple[tuple[str, ...], tuple[bytes, ...]]:
    """Languages, the most frequent first, and a dictionary of text for each.

    A dictionary is the first ``chars`` characters of the ``sample`` documents of
    that language with the smallest hashes; fewer where there are more than
    ``full`` languages that have enough documents for their smaller shares, so the model has a fixed bound whatever the
    corpus. Rows without language or letters teach nothing. Raises ValueError with
    so many languages that their dictionaries would be too small to tell them.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}"))
    keys = rows.select(F.col(lang).alias("lang"), F.xxhash64(doc_id, text).alias("key"))
    most = full * max(sample * chars // FEWEST_CHARS, 1)
    names = [r["lang"] for r in keys.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} languages")
    share = sample * chars * full // max(len(names), full)
    # the smallest hashes of each part of a language first, so that no task gets all of a frequent language
    chosen = keys.distinct()
    for cell in (["lang", F.pmod(F.col("key"), F.lit(SPREAD))], ["lang"]):
        order = Window.partitionBy(*cell).orderBy("key")
        chosen = chosen.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= sample).drop("_n")
    each = F.floor(F.lit(share) / F.count("key").over(Window.partitionBy("lang")))
    chosen = chosen.withColumn("_chars", F.least(F.lit(chars), F.greatest(F.lit(1), each)).cast("int"))
    texts = rows.withColumns({"_lang": F.col(lang), "_key": F.xxhash64(doc_id, text)}).select(
        "_lang", "_key", F.substring(text, 1, chars).alias("_text")
    )
    # at most ``sample`` keys a language
    same = (F.col("_lang") == F.col("lang")) & (F.col("_key") == F.col("key"))
    found = texts.join(F.broadcast(chosen.select("lang", "key", "_chars")), same).dropDuplicates(["_lang", "_key"])
    content: dict[str, list[str]] = {name: [] for name in names}
    cut = F.col("_text").substr(F.lit(1), F.col("_chars")).alias("_text")
    for row in found.select("_lang", "_key", cut).orderBy("_lang", "_key").collect():
        content[row["_lang"]].append(row["_text"])
    names = tuple(name for name in names if content[name])
    return names, tuple(_dictionary(content[name]) for name in names)


def _dictionary(texts: list[str]) -> bytes:
    joined = " ".join(texts).encode()
    return letters_only(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))[0]


def identify_languages(docs: DataFrame, model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with lang_pred, score and margin, one row per row of ``docs``.

    Each whole text, in lower case and without anything but letters, is
    compressed in chunks with every language's dictionary; the smallest total
    names the language, ties go to the language more frequent in training. The
    score is that language's share when a language weighs its total to the
    power ``-SHARPNESS``: near 1 with a clear margin, one over the number of
    languages without. The margin is the part by which the second smallest total
    exceeds the smallest, whatever the number of languages, and infinite where
    only one is learned. A null text, a text without letters, or a model without
    languages gives ``und`` and 0 for both.
    """
    bound = docs.sparkSession.sparkContext.broadcast(model)
    # a text that is kept anyway goes to the workers once
    column = text if text in keep else "text"
    rows = docs.select(*keep) if text in keep else docs.select(*keep, text_or_empty(text).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(giving_back(_predict(bound, column)), f"{kinds}, lang_pred string, score double, margin double")


def predicted_languages(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned outside fold 0 only. Rows with a null id are held out.

    One row per row of ``docs``, repeated ones too; equal texts get equal
    predictions. No rows give no rows; without a learned language all are ``und``.
    Other columns are ignored.
    """
    model = fit_languages(docs.filter(fold(F.col("doc_id"), folds) != 0))
    found = identify_languages(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "lang_pred", "score")


def documents_in_a_language(docs: DataFrame, least: float = LEAST_MARGIN, folds: int = 5, text: str = "text") -> DataFrame:
    """``docs`` without the documents in no language: no letters, or a margin below ``least``, too narrow to tell.

    A null or empty text goes, equal texts share their fate, repeated rows stay
    repeated, all columns stay as they are whatever their names. No rows give no
    rows, and so does a corpus in which no document outside fold 0 has a language.
    """
    model = fit_languages(docs.filter(fold(F.col("doc_id"), folds) != 0), text)
    whole = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)])
    found = identify_languages(whole, model, f"_{docs.columns.index(text)}", tuple(whole.columns))
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("margin") >= least))
    return kept.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
