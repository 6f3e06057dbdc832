"""Tables from OCR word boxes: rows, gutters that rows vote for, a grid, and whether to accept it.

Word boxes are (table_id, word_ord, text, conf, left, top, width, height). Everything is grouped by table_id, and a table
is one raster, so groups are small however many tables there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions.keys import table_id
from lodestone.operators.images import is_thin_rule


def skip_reason(label: Column, width: Column, height: Column) -> Column:
    """Why an inventory row is no OCR candidate; null for one that is."""
    w, h = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    return (
        F.when(~label.eqNullSafe(F.lit("table_image")), "not_table_image").when(is_thin_rule(w, h), "thin_table_rule")
        .when((w < C.OCR_MIN_WIDTH) | (h < C.OCR_MIN_HEIGHT), "not_table_like")
    )


def words_from_columns(data: DataFrame) -> DataFrame:
    """Word boxes from an OCR engine's parallel arrays (table_id, level, conf, text, left, top, width, height), given as strings."""
    names = ("level", "conf", "text", "left", "top", "width", "height")
    rows = data.select("table_id", F.posexplode(F.arrays_zip(*[F.col(n) for n in names])).alias("word_ord", "w"))
    cast = rows.select("table_id", "word_ord", F.btrim(F.coalesce(F.col("w.text"), F.lit("")), F.lit(" \t\n\r")).alias("text"), F.col("w.level").try_cast("int").alias("level"), F.col("w.conf").try_cast("double").alias("conf"), *[F.col(f"w.{n}").try_cast("int").alias(n) for n in names[3:]])
    return cast.where((F.col("level") == C.OCR_WORD_LEVEL) & (F.col("conf") >= 0) & (F.col("text") != "")).drop("level")


def clusters(rows: DataFrame, keys: list[str], coordinate: str, gap: Column, name: str) -> DataFrame:
    """rows with a 0-based number of their cluster on a line: a step wider than ``gap`` begins another."""
    order = Window.partitionBy(*keys).orderBy(coordinate)
    opens = F.coalesce(F.col(coordinate) - F.lag(coordinate).over(order) > gap, F.lit(False)).cast("int")
    return rows.withColumn("_opens", opens).withColumn(name, F.sum("_opens").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("_opens")


def text_rows(words: DataFrame) -> DataFrame:
    """Word boxes with ``line_height`` (the median) and ``row``, by single linkage of vertical centres."""
    measured = words.join(words.groupBy("table_id").agg(F.median("height").alias("line_height")), "table_id").withColumn("centre", F.col("top") + F.col("height") / 2.0)
    return clusters(measured, ["table_id"], "centre", F.greatest(F.lit(C.ROW_FLOOR), C.ROW_SCALE * F.col("line_height")), "row").drop("centre")


def raw_text(words: DataFrame) -> DataFrame:
    """(table_id, raw_text): rows as lines, words from left to right."""
    lines = text_rows(words).groupBy("table_id", "row").agg(F.sort_array(F.collect_list(F.struct("left", "word_ord", "text"))).alias("w"))
    lines = lines.select("table_id", "row", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("line"))
    return lines.groupBy("table_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("raw_text"))


def gutters(rows: DataFrame) -> DataFrame:
    """(table_id, row, line_height, x): middles of gaps inside rows that are wide enough to part columns."""
    order = Window.partitionBy("table_id", "row").orderBy("left", "word_ord")
    before = F.max(F.col("left") + F.col("width")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    wide = F.greatest(F.lit(C.GUTTER_FLOOR), C.GUTTER_SCALE * F.col("line_height"))
    return rows.withColumn("right", before).where(F.col("left") - F.col("right") >= wide).select("table_id", "row", "line_height", ((F.col("right") + F.col("left")) / 2.0).alias("x"))


def column_edges(rows: DataFrame) -> DataFrame:
    """(table_id, edges): ascending places that enough rows vote for; tables without any aren't listed."""
    n_rows = rows.groupBy("table_id").agg((F.max("row") + 1).alias("n_rows"))
    votes = clusters(gutters(rows), ["table_id"], "x", F.greatest(F.lit(C.MERGE_FLOOR), C.MERGE_SCALE * F.col("line_height")), "edge")
    counted = votes.groupBy("table_id", "edge").agg(F.countDistinct("row").alias("support"), F.median("x").alias("x")).join(n_rows, "table_id")
    enough = counted.where(F.col("support") >= F.greatest(F.lit(C.SUPPORT_FLOOR), F.ceil(F.col("n_rows") * C.SUPPORT_SHARE)))
    return enough.groupBy("table_id").agg(F.sort_array(F.collect_list("x")).alias("edges"))


WORD = ("word_ord", "text", "conf", "left", "top", "width", "height")
READ = "table_id string, mean_confidence double, raw_text string, n_rows int, n_cols int, cells array<array<string>>, spanning_rows array<int>, used long, tabular long, edges array<double>"
#: Words that are read at once, at least those of one table.
READ_WORDS = 200_000


def by_table(words: DataFrame) -> DataFrame:
    """(table_id, words): a row for each raster, as an OCR engine gives them; rows of single words are gathered."""
    if "words" in words.columns:
        return words.select("table_id", "words")
    return words.where("table_id is not null").groupBy("table_id").agg(F.collect_list(F.struct(*WORD)).alias("words"))


def _numbers(values: pa.Array) -> np.ndarray:
    return pc.cast(values, pa.float64()).to_numpy(zero_copy_only=False)


def _starts(group: np.ndarray, n: int) -> np.ndarray:
    """Where each of n groups of a sorted column begins, and its end."""
    return np.searchsorted(group, np.arange(n + 1))


def _medians(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    group, value = group[~np.isnan(value)], value[~np.isnan(value)]
    order = np.lexsort((value, group))
    at = _starts(group[order], n)
    size = np.diff(at)
    out = np.full(n, np.nan)
    low, high = at[:-1] + (size - 1) // 2, at[:-1] + size // 2
    some = size > 0
    out[some] = (value[order][low[some]] + value[order][high[some]]) / 2
    return out


def _opened(group: np.ndarray, value: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, cluster): rows by group and value, nulls first, and the number of each one's cluster over all groups; a step wider than the gap begins another, as a group does."""
    order = np.lexsort((np.where(np.isnan(value), -np.inf, value), group))
    g, v = group[order], value[order]
    opens = np.ones(len(g), dtype=bool)
    opens[1:] = (g[1:] != g[:-1]) | (v[1:] - v[:-1] > gap[g[1:]])
    return order, np.cumsum(opens) - 1


def _joined(texts: pa.Array, group: np.ndarray, n: int, by: str) -> pa.Array:
    """The texts of each group, which are in order, joined; nulls are left out."""
    known = np.flatnonzero(pc.is_valid(texts).to_numpy(zero_copy_only=False))
    lists = pa.ListArray.from_arrays(pa.array(_starts(group[known], n).astype(np.int32)), texts.take(pa.array(known)))
    return pc.binary_join(lists, by)


def _read(batch: pa.RecordBatch, min_rows: int, min_cols: int) -> pa.RecordBatch:
    """The rows, columns and cells of a slice of tables, by the rules of ``text_rows``, ``gutters`` and ``column_edges``."""
    lists = batch.column("words")
    n = batch.num_rows
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    field = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
    table = np.repeat(np.arange(n), sizes)
    left, top, width, height, conf, word_ord = (_numbers(field[c]) for c in ("left", "top", "width", "height", "conf", "word_ord"))
    text = field["text"].cast(pa.string())
    line_height = _medians(table, height, n)

    order, cluster = _opened(table, top + height / 2.0, np.fmax(C.ROW_FLOOR, C.ROW_SCALE * line_height))
    line = np.empty(len(table), dtype=np.int64)
    line[order] = cluster
    n_lines = int(cluster[-1]) + 1 if len(cluster) else 0
    table_of = np.zeros(n_lines, dtype=np.int64)
    table_of[line] = table
    first = _starts(table_of, n)
    n_rows = np.diff(first)

    coded = text.dictionary_encode()
    rank = pc.rank(coded.dictionary, "ascending").to_numpy() if len(coded.dictionary) else np.zeros(0)
    by_text = np.append(rank, 0)[pc.fill_null(coded.indices, len(rank)).to_numpy(zero_copy_only=False)]
    order = np.lexsort((by_text, word_ord, np.where(np.isnan(left), -np.inf, left), line))
    table, line, left, right, text = table[order], line[order], left[order], (left + width)[order], text.take(pa.array(order))
    middle = left + width[order] / 2.0
    # a running maximum inside each line: lines stand far apart
    apart = line * 2.0**34
    reached = np.maximum.accumulate(np.where(np.isnan(right), -(2.0**33), right) + apart) if len(line) else apart
    before = np.full(len(line), np.nan)
    same = line[1:] == line[:-1]
    before[1:][same] = (reached[:-1] - apart[1:])[same]
    before[before <= -(2.0**33)] = np.nan
    gutter = left - before >= np.fmax(C.GUTTER_FLOOR, C.GUTTER_SCALE * line_height)[table]

    voter, x = line[gutter], (before[gutter] + left[gutter]) / 2.0
    order, cluster = _opened(table[gutter], x, np.fmax(C.MERGE_FLOOR, C.MERGE_SCALE * line_height))
    voter, x = voter[order], x[order]
    n_edges = int(cluster[-1]) + 1 if len(cluster) else 0
    owner = np.zeros(n_edges, dtype=np.int64)
    owner[cluster] = table[gutter][order]
    support = np.bincount(np.unique(cluster * max(n_lines, 1) + voter) // max(n_lines, 1), minlength=n_edges)
    kept = support >= np.maximum(C.SUPPORT_FLOOR, np.ceil(n_rows[owner] * C.SUPPORT_SHARE))
    edge, owner = _medians(cluster, x, n_edges)[kept], owner[kept]
    edges = _starts(owner, n)
    n_cols = np.diff(edges) + 1
    grid = (n_rows >= min_rows) & (n_cols >= max(min_cols, 2))

    parted = np.zeros(n_lines, dtype=bool)
    parted[line[gutter]] = True
    low, high = np.full(n_lines, np.nan), np.full(n_lines, np.nan)
    np.fmin.at(low, line, left)
    np.fmax.at(high, line, right)
    placed = edge + owner * 2.0**34

    def edges_up_to(t: np.ndarray, value: np.ndarray, side: str) -> np.ndarray:
        return np.searchsorted(placed, np.where(np.isnan(value), -(2.0**33), value) + t * 2.0**34, side)

    after = edges_up_to(table_of, low, "right")
    inside = after < edges[table_of + 1]
    crosses = np.zeros(n_lines, dtype=bool)
    crosses[inside] = edge[after[inside]] < high[inside]
    spans = ~parted & crosses & ~np.isnan(low)
    unknown = ~parted & inside & (np.isnan(low) | np.isnan(high))
    column = np.where(spans[line] | np.isnan(middle), 0, edges_up_to(table, middle, "left") - edges[table])

    width_of = np.where(grid, n_cols, 0)
    base = np.cumsum(n_rows * width_of) - n_rows * width_of
    cell = base[table] + (line - first[table]) * width_of[table] + column
    mine = np.flatnonzero(grid[table])
    mine = mine[np.argsort(cell[mine], kind="stable")]
    n_cells = int((n_rows * width_of).sum())
    cells = _joined(text.take(pa.array(mine)), cell[mine], n_cells, " ")
    in_grid = np.flatnonzero(grid[table_of])
    tabular = in_grid[~spans[in_grid] & ~unknown[in_grid]]
    cell_line = np.repeat(in_grid, width_of[table_of[in_grid]])
    filled = pc.not_equal(pc.utf8_trim(cells, " "), "").to_numpy(zero_copy_only=False)
    counted = filled & ~spans[cell_line] & ~unknown[cell_line]
    lines = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width_of[table_of[in_grid]])]).astype(np.int32)), cells)
    spanning = in_grid[spans[in_grid]]

    def of_grids(values: np.ndarray) -> pa.Array:
        return pa.array(values, mask=~grid)

    def lists_of(offsets: np.ndarray, values: pa.Array) -> pa.Array:
        return pc.if_else(pa.array(grid), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values), pa.nulls(n, pa.list_(values.type)))

    known = ~np.isnan(conf)
    whose = np.repeat(np.arange(n), sizes)[known]
    count = np.bincount(whose, minlength=n)
    mean = np.bincount(whose, weights=conf[known], minlength=n) / np.maximum(count, 1)
    raw = _joined(_joined(text, line, n_lines, " "), table_of, n, "\n")
    return pa.RecordBatch.from_arrays(
        [
            batch.column("table_id").cast(pa.string()), pa.array(mean, mask=count == 0), pc.if_else(pa.array(sizes > 0), raw, pa.nulls(n, pa.string())), of_grids(n_rows.astype(np.int32)), of_grids(n_cols.astype(np.int32)),
            lists_of(_starts(table_of[in_grid], n), lines), lists_of(_starts(table_of[spanning], n), pa.array((spanning - first[table_of[spanning]]).astype(np.int32))),
            of_grids(np.bincount(table_of[cell_line[counted]], minlength=n).astype(np.int64)), of_grids(np.bincount(table_of[tabular], minlength=n).astype(np.int64)), lists_of(edges, pa.array(edge)),
        ],
        [c.split()[0] for c in READ.split(", ")],
    )


def read_tables(words: DataFrame, min_rows: int = C.OCR_MIN_ROWS, min_cols: int = C.OCR_MIN_COLS) -> DataFrame:
    """``READ`` of each table with words: its text, and its grid, null where it has none. A raster is one row (``by_table``), so nothing but its result is moved."""

    def run(batches):
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at, before = 0, 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, before + READ_WORDS, "right")))
                yield _read(batch.slice(at, stop - at), min_rows, min_cols)
                at, before = stop, int(ends[stop - 1])

    return by_table(words).where(F.size("words") > 0).mapInArrow(run, READ)


def recover_grids(words: DataFrame, min_rows: int = C.OCR_MIN_ROWS, min_cols: int = C.OCR_MIN_COLS) -> DataFrame:
    """(table_id, n_rows, n_cols, cells, spanning_rows, fill_fraction, spanning_fraction, column_boundaries) of tables with a grid.

    Cells without words stay empty strings. A row without a gutter of its own that crosses an edge is kept whole in its
    first cell, and doesn't count towards the fill.
    """
    table = read_tables(words, min_rows, min_cols).where("cells is not null")
    return _shares(table).drop("read_")


def _shares(table: DataFrame) -> DataFrame:
    """The columns of ``recover_grids`` from those of ``read_tables``, null where there is no grid, and ``read_`` with the others."""
    fill = F.when(F.col("tabular") > 0, F.col("used") / (F.col("tabular") * F.col("n_cols"))).when(F.col("tabular") == 0, 0.0)
    return table.select(F.struct("mean_confidence", "raw_text").alias("read_"), "table_id", "n_rows", "n_cols", "cells", "spanning_rows", fill.alias("fill_fraction"), (F.size("spanning_rows") / F.col("n_rows")).alias("spanning_fraction"), F.transform("edges", lambda e: F.round(e, 1)).alias("column_boundaries"))


def decide(tables: DataFrame, words: DataFrame, threshold: float = C.OCR_CONFIDENCE) -> DataFrame:
    """tables (table_id, ...) with status and reason, mean_confidence, raw_text, and the grid's columns, which are null unless it is accepted."""
    read = words if "raw_text" in words.columns else read_tables(words)
    grids = _shares(read)
    joined = tables.join(grids.withColumns({c: F.col(f"read_.{c}") for c in ("mean_confidence", "raw_text")}).drop("read_"), "table_id", "left")
    grids = grids.drop("read_")
    # asked of the number of rows, so that records without their cells carry none
    reason = (
        F.when(F.col("mean_confidence").isNull(), "no_text").when(F.col("mean_confidence") < threshold, "low_confidence")
        .when(F.col("n_rows").isNull(), "grid_not_recovered").when(F.col("fill_fraction") < C.OCR_MIN_FILL, "sparse_grid")
    )
    rows = joined.withColumn("reason", reason).withColumn("raw_text", F.coalesce("raw_text", F.lit("")))
    for name in grids.columns[1:]:
        rows = rows.withColumn(name, F.when(F.col("reason").isNull(), F.col(name)))
    return rows.withColumn("status", F.when(F.col("reason").isNull(), "accepted").otherwise("refused"))


def table_records(inventory: DataFrame, words: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Inventory rows of table images, each skipped, refused or accepted; failures is (table_id, error) of rasters that couldn't be read."""
    rows = inventory.where(F.col("label") == "table_image").withColumn("table_id", table_id(F.col("filename"), F.col("page"), F.col("image_index"))).withColumn("skipped", skip_reason(F.col("label"), F.col("width"), F.col("height")))
    decided = decide(rows, words)
    if failures is not None:
        failed = decided.join(failures.select("table_id", "error"), "table_id", "left")
        decided = failed.withColumn("reason", F.when(F.col("error").isNotNull(), F.col("error")).otherwise(F.col("reason"))).withColumn("status", F.when(F.col("error").isNotNull(), "refused").otherwise(F.col("status"))).drop("error")
    status = F.when(F.col("skipped").isNotNull(), "skipped").otherwise(F.col("status"))
    return decided.withColumn("status", status).withColumn("reason", F.coalesce("skipped", "reason")).drop("skipped")


def table_summary(records: DataFrame) -> DataFrame:
    """(status, reason, n_tables) with subtotals of each status, whose level is 1, and of all, whose level is 2."""
    sets = records.groupingSets([["status", "reason"], ["status"], []], "status", "reason")
    levels = (F.grouping("status") + F.grouping("reason")).cast("int").alias("level")
    return sets.agg(levels, F.count("*").alias("n_tables"))


def table_text(cells: Column, spanning_rows: Column) -> Column:
    """Searchable text of a grid: a line for each row, blanks keep their place, a spanning row is its first cell."""
    lines = F.transform(cells, lambda row, i: F.when(F.array_contains(F.coalesce(spanning_rows, F.array().cast("array<int>")), i), F.get(row, F.lit(0))).otherwise(F.array_join(row, " | ")))
    return F.btrim(F.array_join(lines, "\n"), F.lit(" \t\n\r"))
