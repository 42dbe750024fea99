"""Mixing sources to target weights by weighted fair queueing.

Every source queues its documents in a shuffled order.  A document leaves its
queue at a virtual time: the words of its source up to and including it, over
the source's target.  All queues are served by that time, in one global order,
until the budget of words is used up.  A source that is given more words than it
has goes round its queue again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartfold.functions.keys import all_of, same
from chartfold.llm.textbatch import fresh
from chartfold.plans.running import running_total
from chartfold.sources.scratch import stored

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int], rounds: int, share: float = 1.0) -> DataFrame:
    """Adds ``target`` to one row (``source``, ``source_size``) per source.

    Sources by code point, null last, take ``weights`` in turn.  They divide
    ``share`` of all words by weight, none getting more than ``rounds`` times
    what it has; what is over is divided again.  So sources are filled up in the
    order of their limit per weight, until one keeps below its limit.
    """
    ranked = running_total(
        sizes.withColumns({"__null": F.col("source").isNull(), "__one": F.lit(1)}),
        [("__null", True), ("source", True)], ["__one", "source_size"], out=["__place", "__upto"],
        total=["__n", "__words"],
    )
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("__place") - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(rounds)
    weighed = ranked.select(
        "source", "source_size", "__words", turn.cast("bigint").alias("__weight"), limit.alias("__limit"),
        F.col("source").isNull().alias("__null"),
    ).withColumn("__ratio", F.col("__limit") / F.col("__weight"))
    filled = running_total(
        weighed, [("__ratio", True), ("__null", True), ("source", True)], ["__limit", "__weight"],
        out=["__limits", "__weights"], total=["__all_limits", "__all_weights"],
    )
    budget = F.col("__words") * F.lit(float(share))
    # words for a unit of weight, once the sources before this one are full
    left = budget - (F.col("__limits") - F.col("__limit"))
    level = left / (F.col("__all_weights") - (F.col("__weights") - F.col("__weight")))
    full = F.col("__ratio") <= level
    # the level that the others share: what full sources leave, over the weights of the others
    marked = filled.withColumns({"__level": level, "__full": full})
    shared = marked.agg(
        F.sum(F.when(F.col("__full"), F.col("__limit")).otherwise(0)).alias("f"),
        F.sum(F.when(~F.col("__full"), F.col("__weight")).otherwise(0)).alias("w"),
    ).select((F.lit(0) + F.col("f")).alias("f"), F.col("w"))
    at = shared.select(F.struct("f", "w")).scalar()
    rest = (budget - at.getField("f")) / F.nullif(at.getField("w"), F.lit(0))
    target = F.when(F.col("__full"), F.col("__limit").cast("double")).otherwise(F.col("__weight") * rest)
    return marked.select("source", "source_size", target.alias("target"), budget.alias("__budget"))


def mix(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    rounds: int = 3,
    share: float = 1.0,
    seed: int = 0,
) -> DataFrame:
    """One row per different (id, text, source): ``id``, ``text_hash``, ``source``, ``rows``,
    ``size`` (words of one row), ``source_size``, ``target``, ``copies`` (how often each row is taken).

    Rows that are repeated, their id included, are one entry of the queue with
    all their words, so they are taken together; ``rows`` is their number.  A
    null source is a source; null and empty texts have no words and are never
    taken.  The order within a source is a hash of id, text and ``seed``, so
    reruns agree.  A hot source is cut into chunks like any long series.  Other
    columns of ``docs`` are not looked at, whatever their names, and an empty
    table gives an empty one.
    """
    entries = stored(
        docs.select(F.col(id).alias("id"), F.md5(text).alias("text_hash"), F.col(source).alias("source"),
                    word_count(text).alias("size"))
        .groupBy("id", "text_hash", "source")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("size").alias("size")),
        "mix",
    )
    sizes = entries.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    aims = stored(targets(sizes, weights, rounds, share), "mix-targets")
    aimed = entries.join(
        aims.withColumnRenamed("source", "__source"), same(F.col("source"), F.col("__source"))
    ).drop("__source")

    shuffled = aimed.filter("size > 0").withColumns({
        "__size": F.col("size") * F.col("rows"), "__order": F.md5(F.concat_ws("/", F.col("id").cast("string"), "text_hash", F.lit(str(seed)))),
    })
    queued = running_total(
        shuffled, [("__order", True), ("id", True), ("text_hash", True)], "__size", "source", out="__upto"
    )
    # every round of the queue in which an entry may begin before time 1
    rounds_of = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("__round")
    served = queued.select("*", rounds_of).withColumn(
        "__words", F.col("__round") * F.col("source_size") + F.col("__upto")
    ).filter(F.col("__words") - F.col("__size") < F.col("target")).withColumn(
        "__time", F.col("__words") / F.col("target")
    ).select("id", "text_hash", "source", "__order", "__size", "__round", "__time", "__budget")
    taken = running_total(
        served, [(c, True) for c in ("__time", "source", "__order", "id", "text_hash", "__round")], "__size", out="__spent"
    ).filter(F.col("__spent") <= F.col("__budget"))
    copies = taken.groupBy("id", "text_hash", "source").agg(F.count(F.lit(1)).alias("copies"))
    keys = ("id", "text_hash", "source")
    copies = copies.select(*[F.col(c).alias(f"__{c}") for c in keys], "copies")
    return aimed.join(copies, all_of([same(F.col(c), F.col(f"__{c}")) for c in keys]), "left").select(
        *keys, "rows", "size", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies")
    )


def report(mixed: DataFrame, id: str = "doc_id") -> DataFrame:
    """One row per document of a :func:`mix`: how many of its words are taken, repeats counted."""
    return mixed.select(
        F.col("id").alias(id), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
        F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("__row"),
    ).drop("__row")


def take(docs: DataFrame, mixed: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns of ``docs``."""
    names = [fresh(c, docs.columns) for c in ("__id", "__text_hash", "__source", "__copies", "__copy")]
    taken = mixed.filter("copies > 0").select(
        *[F.col(c).alias(n) for c, n in zip(("id", "text_hash", "source", "copies"), names)]
    )
    key, text_hash, of, copies, copy = names
    on = all_of([
        same(F.col(id), F.col(key)), same(F.md5(F.col(text)), F.col(text_hash)), same(F.col(source), F.col(of)),
    ])
    repeated = docs.join(taken, on).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return repeated.select(docs.columns)
