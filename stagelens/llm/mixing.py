"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from ..operators.ordering import with_position
from .common import stored

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sized: DataFrame, source: str = "source", size: str = "size", weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES
) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``.

    Sources in code point order, null last, take ``weights`` in turn and share
    the sum of all sizes. A target stops at ``most`` times its source's size and
    the excess goes to the others by weight, again until no target is above.
    All decisions are made on whole numbers.
    """
    totals = stored(sized.groupBy(source).agg(F.sum(size).alias("source_size")), "mix-sources")
    ranked = with_position(totals, [F.col(source).asc_nulls_last()], out="_rank")
    turn = F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int") + 1
    rated = stored(
        ranked.select(source, "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), turn).cast("long").alias("_w")),
        "mix-weights",
    )
    big = lambda c: F.col(c).cast("decimal(38,0)")
    # over: this target would be above its ceiling when the part of the mix
    # that capped sources leave (_rest) goes to the open ones (_open) by weight
    rest, share = rated.agg(F.sum("source_size"), F.sum("_w")).first()
    while rest is not None:
        over = F.coalesce(F.lit(rest).cast("decimal(38,0)") * big("_w") > F.lit(most * share).cast("decimal(38,0)") * big("source_size"), F.lit(False))
        capped = rated.filter(over).agg(F.sum("source_size"), F.sum("_w")).first()
        total = rated.agg(F.sum("source_size"), F.sum("_w")).first()
        new = (total[0] - most * (capped[0] or 0), total[1] - (capped[1] or 0))
        if new == (rest, share):
            break
        rest, share = new
    if rest is None:
        return rated.select(source, "source_size", F.lit(0.0).alias("target"))
    target = F.when(over, (F.lit(most) * F.col("source_size")).cast("double")).otherwise(
        (F.col("_w") * F.lit(rest).cast("long")).cast("double") / F.lit(max(share, 1)).cast("double")
    )
    return rated.select(source, "source_size", target.alias("target"))


def mix_plan(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
    weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix",
) -> DataFrame:
    """How many times the mix takes each document.

    Returns doc_id, source, size, source_size, target, copies and taken
    (= copies * size), one row per row of ``docs``. Within a source documents
    stand in order of size, then id; every document expects
    target / source_size copies; their running sum plus one offset per source
    gives a document one copy for each whole number it crosses. The taken words
    of a source so stay within about one large document of its target.

    No source is gathered: the order is cut into ranges, and a source's first
    position comes from a combined minimum. Sizes are counted once, into a
    narrow stored table.

    A null text has size 0, a null source is a source of its own, documents of
    size 0 are copied like others and take no words; repeated rows count each;
    no rows give no rows. Other columns are ignored.
    """
    sized = stored(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "mix-sizes"
    )
    targets = stored(source_targets(sized, weights=weights, most=most), "mix-targets")
    placed = with_position(sized, [F.col("source").asc_nulls_last(), "size", "doc_id"], out="_at")
    first = placed.groupBy("source").agg(F.min("_at").alias("_first"))
    per_source = targets.join(first, targets.source.eqNullSafe(first.source)).select(
        targets.source.alias("_source"), "source_size", "target", "_first"
    )
    offset = uniform(F.coalesce(F.col("source"), F.lit("")), seed)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    k = (F.col("_at") - F.col("_first")).cast("double")
    crossed = F.floor((k + 1) * F.col("_rate") + F.col("_u")) - F.floor(k * F.col("_rate") + F.col("_u"))
    return (
        placed.join(per_source, placed.source.eqNullSafe(per_source._source))
        .withColumns({"_rate": rate, "_u": offset})
        .withColumn("copies", F.least(crossed, F.ceil("_rate")).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed_documents(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options
) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it; all columns are kept.

    Rows that share an id share its copies evenly, rounded up, so the mix is
    exact where ids are unique. A null id is an id like any other.
    """
    plan = mix_plan(docs, text, source, doc_id, **options)
    copies = plan.groupBy("doc_id").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).filter("copies > 0")
    taken = copies.select(F.col("doc_id").alias("_id"), F.ceil(F.col("copies") / F.col("rows")).cast("int").alias("_times"))
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    joined = whole.join(taken, F.col("_row")[doc_id].eqNullSafe(F.col("_id")))
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
