"""Lines that many documents share, found with levelled sorted runs of line hashes, in DataFrame operations only."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import skew_join
from ..session import scratch_path
from .common import stored, text_or_empty

LEAST_LENGTH = 20
LEAST_DOCUMENTS = 3
BATCHES = 8
#: As many runs of a level are merged into one run of the next level.
FANOUT = 4
#: Lines a bucket of the runs is meant for.
ROWS_A_BUCKET = 1 << 19
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
DOCUMENT = ["id", "text_hash"]


def line_key(line: Column) -> Column:
    """What two equal lines have in common: no white space at the ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def keyed_lines(docs: DataFrame, text: str, doc_id: str, least_length: int) -> DataFrame:
    """(id, text_hash, place, h1, h2), one row for every line whose key has ``least_length`` code points."""
    whole = text_or_empty(text)
    lines = docs.select(F.col(doc_id).alias("id"), F.xxhash64(whole).alias("text_hash"), F.posexplode(F.split(whole, "\n")).alias("place", "line"))
    long = lines.filter(F.char_length(F.btrim("line", F.lit(SPACE))) >= least_length)
    key = line_key(F.col("line"))
    return long.select(*DOCUMENT, "place", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(13), key).alias("h2"))


class LineRuns:
    """Line keys seen so far: sorted runs in levels, all dealt over the same buckets.

    ``first`` runs hold every key once: with the number of documents and the
    largest id of the batch that brought it. ``again`` runs hold what later
    batches add for keys that were known. A batch is merge-joined with the runs
    bucket by bucket: only the batch itself is shuffled. ``FANOUT`` runs of a
    level become one run of the next level, so a batch meets few runs and a key
    is rewritten once a level. Runs are tables below ``spark.checkpoint.dir``.
    """

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, max(buckets, 1), max(fanout, 2)
        self.levels: dict[str, list[list[str]]] = {"first": [], "again": []}
        self._names: list[str] = []

    def _written(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        write = df.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet")
        write.option("path", scratch_path(self.spark, "line-run")).saveAsTable(name)
        self._names.append(name)
        return name

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.buckets, *KEY)

    def runs(self, kind: str) -> Iterator[DataFrame]:
        """All runs of a kind, the largest first."""
        return (self.spark.table(name) for level in reversed(self.levels[kind]) for name in level)

    def _without(self, keys: DataFrame, runs: Iterator[DataFrame]) -> DataFrame:
        for run in runs:
            keys = keys.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        return keys

    def _joined(self, kind: str, names: list[str]) -> DataFrame:
        both = self.spark.table(names[0])
        for name in names[1:]:
            both = both.unionByName(self.spark.table(name))
        if kind == "again":
            both = both.groupBy(*KEY).agg(F.sum("n_documents").alias("n_documents"), F.max("top").alias("top"))
        return both

    def _add_run(self, kind: str, name: str, level: int = 0) -> None:
        levels = self.levels[kind]
        while len(levels) <= level:
            levels.append([])
        levels[level].append(name)
        if len(levels[level]) >= self.fanout:
            merged = self._written(self._dealt(self._joined(kind, levels[level])))
            levels[level] = []
            self._add_run(kind, merged, level + 1)

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds a batch of keyed lines; returns its keys that no earlier batch had."""
        documents = lines.select(*KEY, *DOCUMENT).distinct()
        per_key = documents.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_documents"), F.max("id").alias("top"))
        own = self._written(self._dealt(per_key))
        first = self._written(self._without(self.spark.table(own), self.runs("first")))
        again = self._written(self._without(self.spark.table(own), iter([self.spark.table(first)])))
        self._add_run("first", first)
        self._add_run("again", again)
        return self.spark.table(first)

    def totals(self) -> DataFrame:
        """(h1, h2, n_documents, top) of every key over all batches."""
        whole = {}
        for kind in ("first", "again"):
            names = [name for level in self.levels[kind] for name in level]
            whole[kind] = self._joined(kind, names)
        more = whole["again"].select(*KEY, F.col("n_documents").alias("_n"), F.col("top").alias("_top"))
        return whole["first"].join(more, KEY, "left").select(
            *KEY, (F.col("n_documents") + F.coalesce("_n", F.lit(0))).alias("n_documents"), F.greatest("top", "_top").alias("top")
        )

    def close(self) -> None:
        """Takes the runs' names out of the catalog; their files stay as long as the shared folder."""
        for name in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def repeated_lines(lines: DataFrame, batches: int = BATCHES, least_documents: int = LEAST_DOCUMENTS, fanout: int = FANOUT) -> DataFrame:
    """(h1, h2, n_documents, top) of the keys that ``least_documents`` documents hold; ``lines`` are a stored table with ``batch``."""
    runs = LineRuns(lines.sparkSession, -(-lines.count() // ROWS_A_BUCKET) * 4, fanout)
    for batch in range(batches):
        runs.add(lines.filter(F.col("batch") == batch))
    found = stored(runs.totals().filter(F.col("n_documents") >= least_documents), "repeated-lines")
    runs.close()
    return found


def _kept(text: Column, dropped: Column) -> Column:
    """struct(n_lines, text): the lines of ``text`` whose places are not in ``dropped``; both are linear in the lines."""

    def of(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(dropped, F.array().cast("array<int>")))
        return F.struct(F.size(lines).alias("n_lines"), F.array_join(F.transform(places, lambda p: F.get(lines, p)), "\n").alias("text"))

    # the array of one binds the split text, which is then not split anew for each line
    return F.get(F.transform(F.array(F.split(text, "\n")), of), F.lit(0))


def _with_drops(
    docs: DataFrame, text: str, doc_id: str, least_length: int, least_documents: int, batches: int, fanout: int
) -> DataFrame:
    """(_row, _kept, _n_dropped) for every row of ``docs``."""
    lines = keyed_lines(docs, text, doc_id, least_length).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
    path = scratch_path(docs.sparkSession, "keyed-lines")
    lines.write.partitionBy("batch").parquet(path)
    lines = docs.sparkSession.read.schema(lines.schema).parquet(path)
    repeated = repeated_lines(lines, batches, least_documents, fanout)
    drops = skew_join(lines.drop("batch"), repeated, KEY, counts=repeated.select(*KEY, F.col("n_documents").alias("n")))
    drops = drops.filter(~F.col("id").eqNullSafe(F.col("top"))).groupBy(*DOCUMENT).agg(F.array_distinct(F.collect_list("place")).alias("_places"))

    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    whole = F.coalesce(F.col("_row")[text].cast("string"), F.lit(""))
    same = F.col("_row")[doc_id].eqNullSafe(F.col("id")) & (F.xxhash64(whole) == F.col("text_hash"))
    return rows.join(drops, same, "left").select(
        "_row", _kept(whole, F.col("_places")).alias("_kept"), F.greatest(F.size("_places"), F.lit(0)).cast("long").alias("_n_dropped")
    )


def kept_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS,
    batches: int = BATCHES, fanout: int = FANOUT,
) -> DataFrame:
    """doc_id, text without the lines that larger ids hold too, n_lines, n_dropped: one row per row of ``docs``.

    Texts are split at ``\\n``. Lines are equal when their keys are (white space
    stripped at both ends, A-Z lower-cased). A key of at least ``least_length``
    code points that at least ``least_documents`` documents hold loses all its
    lines except in the document of the largest id; other lines stay.

    1. Lines go to a narrow stored table: ids, place and two 64-bit hashes.
    2. Documents come in ``batches`` by a hash of their id. Each batch is
       merge-anti-joined with the runs of earlier ones (see ``LineRuns``).
    3. Keys with enough documents meet the lines again, hot keys salted; each
       document gets the places it loses, and texts are cut once.

    A null or empty text is one empty line. Rows with the same id and text are
    one document; rows with the same id and other texts count each, and all rows
    of the largest id keep the line. A null id is below all others; where only
    null ids hold a line, they all keep it. No rows give no rows. ``docs`` is
    read twice, so hand a table.
    """
    found = _with_drops(docs.select(doc_id, text), text, doc_id, least_length, least_documents, batches, fanout)
    return found.select(
        F.col("_row")[doc_id].alias("doc_id"), F.col("_kept.text").alias("text"), F.col("_kept.n_lines").cast("long").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
    )


def without_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with all columns, texts cut as ``kept_lines`` does; an emptied text is empty, a null text stays null."""
    settings = {"least_length": LEAST_LENGTH, "least_documents": LEAST_DOCUMENTS, "batches": BATCHES, "fanout": FANOUT} | options
    found = _with_drops(docs, text, doc_id, **settings)
    cut = F.when(F.col("_row")[text].isNotNull(), F.col("_kept.text"))
    return found.select(*[(cut if c == text else F.col("_row")[c]).alias(c) for c in docs.columns])
