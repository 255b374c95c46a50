"""Mixing sources to target weights by entropy balancing.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countloom.llm.common import WORD, discard, stored, table

#: Rows of one (source, size, bucket) cell at most, about: larger ones are split by a hash of the id.
CELL = 8192
REPAIRS = 5
#: Newton steps of one job: more make fewer jobs but larger plans, which the driver has to hold.
STEPS = 1


def sized(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """docs with _size (words), _key (source in code point order, null last) and _hash (of the id)."""
    return docs.withColumns({
        "_size": F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long"),
        "_key": F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string"))),
        "_hash": F.xxhash64(F.lit("mix"), F.col(id_column)),
    })


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Per source (_key, source_size): target.  One row a source goes in.

    The level c solves sum(min(most * size, weight * c)) = share * sum(size): with sources ordered by
    the level at which they fill up, it is the first that leaves all later ones below their stop.
    """
    place = F.row_number().over(W.orderBy("_key"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("stop", F.col("source_size") * most).withColumn("fills", F.col("stop") / F.col("weight"))
    order = W.orderBy("fills", "_key")
    whole = W.partitionBy()
    rows = rows.withColumns({
        "full": F.coalesce(F.sum("stop").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)),
        "wanted": F.sum("source_size").over(whole) * share,
    }).withColumn("level", (F.col("wanted") - F.col("full")) / F.col("rest"))
    level = F.min(F.when(F.col("fills") >= F.col("level"), F.struct("fills", "_key", "level"))).over(whole)["level"]
    return rows.select("_key", "source_size", F.least("stop", F.coalesce(F.col("weight") * level, F.col("stop"))).alias("target"))


def tilts(cells: DataFrame, goals: DataFrame, most: float, rounds: int = 60, close: float = 1e-10) -> DataFrame:
    """Per source: lam, the dual variable of its token constraint; a stored table, the one table left of the steps.

    Rates minimise the entropy distance to 1 between 0 and most under sum(rate * size) = target, so
    rate = most / (1 + (most - 1) * exp(-lam * size / mean size)).  Every step is one aggregation of the
    (source, size) counts, STEPS of them a job; one that leaves the known bracket is replaced by its middle.
    """
    def step(state: DataFrame) -> DataFrame:
        joined = cells.join(state.select("_key", "lam", "mean_size"), "_key").withColumn("z", F.col("_size") / F.col("mean_size"))
        rate = tilted(F.col("lam"), F.col("z"), most)
        words = F.col("n") * F.col("_size")
        sums = joined.groupBy("_key").agg(
            F.sum(words * rate).alias("got"), F.sum(words * rate * (1 - rate / most) * F.col("z")).alias("slope"))
        newton = F.col("lam") - (F.col("got") - F.col("target")) / F.col("slope")
        low = F.when(F.col("got") < F.col("target"), F.col("lam")).otherwise(F.col("low"))
        high = F.when(F.col("got") < F.col("target"), F.col("high")).otherwise(F.col("lam"))
        moved = (
            state.drop("gap").join(sums, "_key")
            .withColumns({"low": low, "high": high, "step": newton})
            .withColumn("gap", F.abs(F.col("got") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0)))
            .withColumn("lam", F.when(F.col("gap") <= close, F.col("lam"))
                        .when((F.col("slope") > 0) & (F.col("step") > F.col("low")) & (F.col("step") < F.col("high")), F.col("step"))
                        .otherwise((F.col("low") + F.col("high")) / 2))
        )
        return moved.select("_key", "source_size", "target", "mean_size", "lam", "low", "high", "gap")

    state = goals.withColumns({"lam": F.lit(0.0), "low": F.lit(-64.0), "high": F.lit(64.0), "gap": F.lit(1e300)})
    for number in range(rounds // STEPS):
        before = state
        for _ in range(STEPS):
            state = step(state)
        state = stored(state, "tilt")
        if number:
            discard(before)
        worst = state.agg(F.max(F.when(F.col("high") - F.col("low") > 1e-9, F.col("gap"))).alias("g")).first()["g"]
        if worst is None or worst <= close:
            break
    return state


def tilted(lam, z, most: float):
    return F.lit(float(most)) / (1 + (most - 1) * F.exp(-F.least(F.greatest(lam * z, F.lit(-700.0)), F.lit(700.0))))


def plan_copies(rows: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """Per (_key, _size, _bucket): copies of every row (low) and the largest _hash of a row that gets one more (upto).

    rows holds _key, _size and _hash of every document.  In cells of falling size the running sum of
    expected copies is rounded, so that only the remainder is carried on; what a source is then off its target is repaired
    by single copies of the largest documents that fit.
    """
    counts = rows.groupBy("_key", "_size").agg(F.count("*").alias("n"))
    counts = stored(counts, "sizes")
    sources = counts.groupBy("_key").agg(F.sum(F.col("n") * F.col("_size")).alias("source_size"), F.sum(F.when(F.col("_size") > 0, F.col("n"))).alias("filled"))
    goals = targets(sources, weights, share, most).join(
        sources.select("_key", F.coalesce(F.col("source_size") / F.col("filled"), F.lit(1.0)).alias("mean_size")), "_key")
    goals = stored(goals, "goals")
    state = tilts(counts.filter("_size > 0"), goals.filter("source_size > 0 and target < source_size * %r" % float(most)), most)
    made = [counts, goals, state]
    # rounded, so that the last bits of sums taken in another order change nothing
    goals = goals.join(state.select("_key", F.round("lam", 9).alias("lam")), "_key", "left")
    # target 0 only where the size is 0; target at its stop means all copies
    rated = counts.join(goals, "_key").withColumn(
        "rate", F.when(F.col("lam").isNull(), F.lit(float(most))).otherwise(tilted(F.col("lam"), F.col("_size") / F.col("mean_size"), most)))
    rated = rated.withColumn("buckets", F.ceil(F.col("n") / CELL).cast("long"))
    hot = rated.filter("buckets > 1").select("_key", "_size", "buckets")
    dealt = with_bucket(rows, hot)
    split = dealt.groupBy("_key", "_size", "_bucket").agg(F.count("*").alias("m"))
    cells = split.join(rated.drop("n", "buckets"), ["_key", "_size"])
    order = W.partitionBy("_key").orderBy(F.desc("_size"), "_bucket")
    upto = F.floor(F.sum(F.col("m") * F.col("rate")).over(order.rowsBetween(W.unboundedPreceding, 0)) + 0.5)
    cells = cells.withColumn("upto", upto).withColumn("k", F.col("upto") - F.coalesce(F.lag("upto").over(order), F.lit(0)))
    cells = cells.withColumn("k", F.least(F.greatest("k", F.lit(0)), F.col("m") * most)).drop("upto")
    before = None
    for _ in range(REPAIRS):
        cells = stored(cells, "cells")
        if before is not None:
            discard(before)
        before = cells
        off = cells.groupBy("_key").agg(F.first("target").alias("t"), F.sum(F.col("k") * F.col("_size")).alias("got")).withColumn("off", F.col("t") - F.col("got")).select("_key", "off")
        fits = cells.join(off, "_key").filter(
            "_size > 0 and ((off >= _size and k < m * %d) or (off <= -_size and k > 0))" % most)
        chosen = fits.groupBy("_key").agg(F.max(F.struct("_size", "_bucket")).alias("c"), F.first(F.signum("off")).alias("change"))
        chosen = chosen.select("_key", "c._size", "c._bucket", F.col("change").cast("long").alias("change"))
        cells = cells.join(chosen, ["_key", "_size", "_bucket"], "left").withColumn("k", F.col("k") + F.coalesce("change", F.lit(0))).drop("change")
    cells = cells.withColumn("low", F.floor(F.col("k") / F.col("m"))).withColumn("extra", F.col("k") - F.col("low") * F.col("m"))
    cells = stored(cells, "cells")
    made += [before, cells]
    ranked = dealt.join(cells.filter("extra > 0").select("_key", "_size", "_bucket", "extra"), ["_key", "_size", "_bucket"])
    ranked = ranked.withColumn("r", F.row_number().over(W.partitionBy("_key", "_size", "_bucket").orderBy("_hash")))
    last = ranked.filter("r = extra").select("_key", "_size", "_bucket", F.col("_hash").alias("upto"))
    plan = cells.join(last, ["_key", "_size", "_bucket"], "left").select("_key", "_size", "_bucket", "source_size", "target", "rate", "low", "upto")
    out = stored(plan, "plan"), stored(hot, "hot")
    discard(*made)
    return out


def with_bucket(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """_bucket: 0, or for the sizes of a source that many documents share, a part of them by hash."""
    return rows.join(hot, ["_key", "_size"], "left").withColumn(
        "_bucket", F.coalesce(F.pmod(F.xxhash64("_hash"), F.col("buckets")), F.lit(0)).cast("long")).drop("buckets")


def planned(docs: DataFrame, weights: tuple[float, ...], share: float, most: int, id_column: str) -> DataFrame:
    """_doc (the whole row of docs, so that no column's name can clash), _size, _copies, source_size, target and rate."""
    rows = sized(docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text"), F.col("source"), F.col(id_column).alias("_id")), "_id").drop("text", "source", "_id")
    narrow = stored(rows.select("_key", "_size", "_hash"), "rows")
    plan, hot = plan_copies(narrow, weights, share, most)
    discard(narrow)
    out = with_bucket(rows, hot).join(plan, ["_key", "_size", "_bucket"])
    copies = F.col("low") + F.when(F.col("_hash") <= F.col("upto"), 1).otherwise(0)
    return out.select("_doc", "_size", copies.cast("long").alias("_copies"), "source_size", "target", "rate")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, id_column: str = "doc_id") -> DataFrame:
    """The rows of docs, each as often as the mix takes it, at most `most` times.

    Sources take the weights in code point order, repeating, null last, and share `share` times all words; a source's
    target stops at `most` times its words.  Null texts have size 0.  Rows that repeat an id, source and size share their
    number of copies.  Reruns agree, as copies depend on ids, sources and sizes only.  An empty table stays empty.
    """
    out = planned(docs, weights, share, most, id_column).filter("_copies > 0")
    return out.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_doc.*")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; sources, ties and edge cases as mix and planned state.

    Null texts have size 0 and take nothing; a null source is one of its own, last; documents that share source, size and id (or have none)
    share their number of copies; an empty table gives no rows.
    """
    # the text is read once: sizes go to a narrow table
    docs = sized(table(spark, sf_dir, "documents")).select("doc_id", "_key", "_size", "_hash")
    rows = stored(docs, "rows")
    plan, hot = plan_copies(rows.select("_key", "_size", "_hash"), (3, 1, 2), 1.5, 2)
    out = with_bucket(rows, hot).join(plan, ["_key", "_size", "_bucket"])
    copies = F.col("low") + F.when(F.col("_hash") <= F.col("upto"), 1).otherwise(0)
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (copies * F.col("_size")).cast("long").alias("taken"), "rate")
