"""Mixing sources to target weights: weighted fair queueing on virtual finish times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rehome.llm.shared import WORD, cut, parts_for, running_sums


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_level(sources: DataFrame) -> float:
    """The level at which min(cap, level * weight) over all sources adds up to all sizes.

    A source whose share is above its cap stays at the cap and the excess is shared among the others
    by weight, until none is above. Every round is one aggregate row.
    """
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        total, held, weight, n = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)), F.count_if(full)).first()
        if not weight or n == capped:
            return level
        level, capped = (total - held) / weight, n


def fair_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), passes: int = 3, seed: str = "mix",
             id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
             part_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes
    by weight; no target is above ``passes`` times the source's size. A source's documents are shuffled
    by md5 of seed and id and stand in line ``passes`` times; a place in line finishes at the words of its
    source up to and with it, divided by the source's target. All places are range-sorted by finish time
    (then source, pass, words) and taken as long as their running total is within the budget, the sum of
    all sizes. ``taken`` counts a document's words once for every place taken.

    A source that holds most rows is spread over the range sort, which orders by source and shuffle key.
    Null or blank texts have size 0 and are never taken. Repeated rows stand in line each for itself. Only the
    three columns are read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    named = F.col(source_column)
    sized = cut(docs.select(F.col(id_column).alias("doc_id"), named.cast("string").alias("source"),
                            words_of(F.col(text_column)).alias("size")))
    n = sized.count()
    parts = parts_for(spark, n, part_rows)
    sizes = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    spread = min(parts, parts_for(spark, sizes.count(), part_rows, 1))
    ordered = running_sums(sizes.withColumn("one", F.lit(1)), [F.col("source").isNull(), F.col("source")],
                           {"place": "one", "through": "source_size"}, spread)
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = cut(ordered.select("source", "place", "source_size", turn.alias("weight"), (F.col("source_size") * passes).alias("cap"),
                                 (F.col("through") - F.col("source_size")).alias("before")))
    level = fill_level(sources)
    sources = sources.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    line = running_sums(sized, [F.col("source").isNull(), F.col("source"), key, F.col("size")], {"through": "size"}, parts)
    same = F.col("l.source").eqNullSafe(F.col("s.source"))
    line = line.alias("l").join(sources.alias("s"), same).select(
        "l.doc_id", "l.source", "l.size", "s.source_size", "s.target", "s.place",
        (F.col("l.through") - F.col("s.before")).alias("words"))
    line = cut(line)

    def finish(turn: Column) -> Column:
        return (turn * F.col("source_size") + F.col("words")) / F.col("target")

    standing = (line.filter("size > 0 AND target > 0")
                .select("size", "place", "source_size", "target", "words", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("turn"))
                .filter(F.col("turn") * F.col("source_size") <= F.col("target"))
                .select("size", "place", "words", "turn", finish(F.col("turn")).alias("finish")))
    budget = sizes.agg(F.sum("source_size")).first()[0] or 0
    order = ["finish", "place", "turn", "words"]
    queue = running_sums(standing, [F.col(c) for c in order], {"total": "size"}, parts)
    last = queue.filter(F.col("total") <= budget).agg(F.max(F.struct(*order)).alias("last")).first()["last"]
    if last is None:
        return line.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))

    def served(turn: int) -> Column:
        at = F.struct(finish(F.lit(turn)), F.col("place"), F.lit(turn), F.col("words"))
        end = F.struct(F.lit(last["finish"]), F.lit(last["place"]).cast("long"), F.lit(last["turn"]), F.lit(last["words"]).cast("long"))
        stands = (F.col("size") > 0) & (F.col("target") > 0) & (F.lit(turn) * F.col("source_size") <= F.col("target"))
        return F.when(stands, F.when(at <= end, 1).otherwise(0)).otherwise(0)

    times = served(0)
    for turn in range(1, passes):
        times = times + served(turn)
    return line.select("doc_id", "source", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"))
