"""Mixing sources to target weights by entropy balancing.

Document rates stay as close to 1 in entropy as the sources' word totals allow: within a source the rate of a document
of x mean sizes is exp(lambda * x), cut at ``MOST``. The dual is convex; its gradient and curvature are sums over the
table of (source, size, documents), so each Newton iteration is one aggregation. Rates are then rounded into whole
copies: by a hash of id and text for most documents, and for about ``SETTLED`` documents of each source so that the
source's total meets its target. Rows alike in id, source and text are numbered, and the number goes into the hash, so that
they are rounded apart like other rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.rows import packed, unpacked
from lodestone.llm.scratch import materialize, release

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SETTLED = 4096
ITERATIONS = 60
#: Rows alike that one task numbers.
ALIKE_ROWS = 4096
#: Newton steps end when a source's total is this close to its target, relatively; far below what a copy more or less does.
TOLERANCE = 1e-10


def _key(source: Column) -> Column:
    """Sorts as the source does by code point, null last; never null."""
    return F.when(source.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), source.cast("string")))


def _own() -> dict[str, Column]:
    """A row's doc_id, source key, size in words and text's digest."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return {"text_": F.md5(text.cast("binary")), "doc_id": F.col("doc_id").cast("long"), "key_": _key(F.col("source")), "size_": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")}


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with ``rank``, their place from 0 in order of key_: a sort over all tasks, then counts of its partitions."""
    placed = materialize(sources.orderBy("key_").withColumn("place", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("place", 33)
    # a row for each partition of the sort
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", before.alias("before"))
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "place", "before")


def targets(histogram: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(key_, source_size, n, target) of each source.

    Shares are by weight, but no more than ``most`` times a source's size; what exceeds that is shared again. With level
    m the target is min(most * size, m * weight); m rises until no more sources reach their bound, each step one sum over
    the sources.
    """
    sizes = histogram.groupBy("key_").agg(F.sum(F.col("size_") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = materialize(_ranked(sizes).withColumn("w", weight).withColumn("bound", F.col("source_size") * float(most)).drop("rank"), "shares")
    level, before = 0.0, None
    while level != before:
        full = F.col("bound") < level * F.col("w")
        total, bounds, free = s.agg(F.sum("source_size"), F.sum(F.when(full, F.col("bound"))), F.sum(F.when(~full, F.col("w")))).first()
        before, level = level, ((total or 0) * share - (bounds or 0.0)) / free if free else level
    return s.select("key_", "source_size", "n", F.least("bound", level * F.col("w")).alias("target"))


def rates(histogram: DataFrame, goals: DataFrame, most: float = MOST, iterations: int = ITERATIONS) -> DataFrame:
    """(key_, tilt, mean) of each source by Newton's method within brackets; tilt is null where every rate is ``most``."""
    full = F.col("target") >= F.col("source_size") * most * (1 - 1e-12)
    goals = goals.withColumn("mean", F.col("source_size") / F.col("n"))
    state = materialize(goals.select("key_", "target", "mean", F.when(~full, F.lit(0.0)).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("error")), "tilts")
    x = F.col("size_") / F.col("mean")
    mass = F.col("size_") * F.col("n")
    for _ in range(iterations):
        power = F.col("tilt") * x
        rate = F.exp(F.least(power, F.lit(math.log(most))))
        at = histogram.join(state.where("tilt is not null and mean > 0"), "key_").groupBy("key_").agg(F.sum(mass * rate).alias("g"), F.sum(F.when(power < math.log(most), mass * rate * x).otherwise(0.0)).alias("d"))
        s = state.drop("error").join(at, "key_", "left")
        low, high = F.when(F.col("g") <= F.col("target"), F.col("tilt")).otherwise(F.col("low")), F.when(F.col("g") >= F.col("target"), F.col("tilt")).otherwise(F.col("high"))
        s = s.withColumn("low", low).withColumn("high", high).withColumn("step", F.when(F.col("d") > 0, F.col("tilt") + (F.col("target") - F.col("g")) / F.col("d")))
        inside = F.col("step").isNotNull() & (F.col("low").isNull() | (F.col("step") > F.col("low"))) & (F.col("high").isNull() | (F.col("step") < F.col("high")))
        outside = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), (F.col("low") + F.col("high")) / 2).when(F.col("high").isNull(), F.greatest(2 * F.col("tilt"), F.col("tilt") + 1)).otherwise(F.least(2 * F.col("tilt"), F.col("tilt") - 1))
        error = F.abs(F.col("g") - F.col("target"))
        done = F.col("g").isNull() | (error <= F.greatest(F.lit(1e-6), F.col("target") * TOLERANCE))
        s = s.withColumn("error", F.when(~done, error)).withColumn("tilt", F.when(done, F.col("tilt")).when(inside, F.col("step")).otherwise(outside))
        before, state = state, materialize(s.select(*state.columns), "tilts")
        release(before)
        if not state.where("error is not null").limit(1).collect():
            break
    return state.select("key_", "tilt", "mean")


def _unit(salt: int) -> Column:
    """A figure from 0 up to 1 that a row's id, text and number among its equals decide: the first 48 bits of a digest."""
    text = F.concat_ws(":", F.lit(str(salt)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_"), F.col("number").cast("string"))
    return F.conv(F.left(F.md5(text), F.lit(12)), 16, 10).cast("double") * 2.0**-48


def _settle(group: pd.DataFrame) -> Iterator[int]:
    """Copies of the settled documents, the largest first, so that what is left over is a matter of the smallest."""
    due, planned = float(group["due"].iloc[0]), float((group["rate"] * group["size_"]).sum())
    scale = due / planned if planned > 0 else 0.0
    goal = taken = 0.0
    for rate, size in zip(group["rate"], group["size_"], strict=True):
        goal += min(MOST, max(0.0, rate * scale)) * size
        copies = min(MOST, max(0, math.floor((goal - taken) / size + 0.5))) if size else 0
        taken += copies * size
        yield copies


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with number, from 0 among rows alike. Rows alike are counted and made again, many of them by many tasks, so that no task orders them."""
    own = rows.columns
    alike = rows.groupBy(*own).agg(F.count("*").alias("alike"))
    once = alike.where(F.col("alike") <= ALIKE_ROWS).select(*own, F.explode(F.sequence(F.lit(0).cast("long"), F.col("alike") - 1)).alias("number"))
    blocks = alike.where(F.col("alike") > ALIKE_ROWS).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("alike") - 1) / ALIKE_ROWS)))).repartition("block")
    first = F.col("block") * ALIKE_ROWS
    return once.unionByName(blocks.select(*own, F.explode(F.sequence(first, F.least(first + ALIKE_ROWS, F.col("alike")) - 1)).alias("number")))


def mix(docs: DataFrame, settled: int = SETTLED) -> DataFrame:
    """(doc_id, key_, text_, number, size, source_size, target, copies, taken) for each row of (doc_id, text, source, ...).

    Reruns agree: copies depend on the rows alone. Null and wordless texts have size 0 and take nothing; a null source is
    the last of the sources. Repeated rows are separate documents of equal rates, also those without an id: so many of
    them are taken as their source's target asks for. Very long texts count whole. No rows give no rows.
    """
    rows = materialize(_numbered(docs.select(*[c.alias(name) for name, c in _own().items()])), "sizes")
    histogram = materialize(rows.groupBy("key_", "size_").agg(F.count("*").alias("n")), "histogram")
    goals = materialize(targets(histogram), "targets")
    tilts = rates(histogram, goals)
    rate = F.when(F.col("size_") == 0, 0.0).when(F.col("tilt").isNull(), float(MOST)).otherwise(F.exp(F.least(F.col("tilt") * F.col("size_") / F.col("mean"), F.lit(math.log(MOST)))))
    rated = rows.join(goals.join(tilts, "key_"), "key_").withColumn("rate", rate).withColumn("settles", _unit(2) * F.col("n") < settled)
    # written here, so that only the settled documents, few of any source, are dealt by source below
    rated = materialize(rated.select("doc_id", "key_", "text_", "number", "size_", "source_size", "target", "rate", "settles"), "rated")
    plain = F.floor("rate") + (_unit(1) < F.col("rate") - F.floor("rate")).cast("long")
    most = rated.where("not settles").withColumn("copies", F.when(F.col("size_") == 0, F.lit(0)).otherwise(plain).cast("long"))
    used = most.groupBy("key_").agg(F.sum(F.col("copies") * F.col("size_")).alias("used"))
    rest = rated.where("settles").join(used, "key_", "left").withColumn("due", F.col("target") - F.coalesce("used", F.lit(0)))

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(order=np.arange(len(group))).sort_values(["size_", "unit", "doc_id"], ascending=[False, True, True], kind="stable")
        return group.assign(copies=list(_settle(group)))[columns]

    columns = ["doc_id", "key_", "text_", "number", "size_", "source_size", "target", "copies"]
    few = rest.withColumn("unit", _unit(3)).select(*columns[:-1], "rate", "due", "unit").groupBy("key_").applyInPandas(settle, "doc_id long, key_ string, text_ string, number long, size_ long, source_size long, target double, copies long")
    mixed = most.select(*columns).unionByName(few)
    return mixed.select("doc_id", "key_", "text_", "number", F.col("size_").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("size_")).alias("taken"))


def mixed_documents(docs: DataFrame, settled: int = SETTLED) -> DataFrame:
    """``docs`` with each row as often as the mix takes it. Of rows alike in doc_id, source and text one stands for all of them, as often as they are taken together. Null and wordless texts aren't taken."""
    own = ["doc_id", "key_", "text_"]
    taken = mix(docs, settled).groupBy(*own).agg(F.sum("copies").alias("copies"), F.max("number").alias("last")).where("copies > 0")
    taken = materialize(taken.select(*[F.col(c).alias(f"taken_{c}") for c in own], "copies", "last"), "taken")
    match = F.col("doc_id").eqNullSafe(F.col("taken_doc_id")) & (F.col("key_") == F.col("taken_key_")) & (F.col("text_") == F.col("taken_text_"))
    found = packed(docs, **_own()).join(taken, match)
    several = found.where("last > 0").groupBy(*own).agg(F.first("row").alias("row"), F.first("copies").alias("copies"))
    chosen = found.where("last = 0").select("row", "copies").unionByName(several.select("row", "copies"))
    return unpacked(chosen.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), docs.columns)
