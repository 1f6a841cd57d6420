"""Pipe tables inside bulletin text (T-A, T-B, T-C; W5-W8, A11, A12).

Everything about one text is done inside its row with array functions: one
scan, no shuffle, no window, and rows that share an id never mix. Texts without
a pipe skip the line work. Intermediate arrays are real columns
(``with_computed``), so each is built once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import cells_kept, cells_nonempty, has_alnum
from ..functions.computed import with_computed
from ..functions.numbers import number_mean
from ..functions.text import WS, py_strip

# Header words that mark a weather measure column.
MEASURE_WORDS = ("기온", "강수", "온도", "습도")
MAX_COLS = 5
# Line boundaries of Python's str.splitlines().
_SPLITLINES = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _any_word(col, words) -> Column:
    cond = None
    for w in words:
        c = F.instr(col, w) > 0
        cond = c if cond is None else (cond | c)
    return cond


# --- T-A -------------------------------------------------------------------------------

def weather_table(df: DataFrame, id_col: str, text_col: str,
                  measure_words: Sequence[str] = MEASURE_WORDS,
                  number_mode: str = "reference") -> DataFrame:
    """T-A: the first table of a text as long rows.

    Pipe lines (stripped) are the table; there must be at least 3; the first
    line containing ``---`` is the separator and may not be the first pipe
    line; the line before it is the header, which must name a measure word.
    Data rows are the later pipe lines with at least 2 non-empty cells, cut to
    the header width. For every measure column but the first column, each
    row yields (row_no, col_no, header, cell, value) where value is the mean
    of the numbers in the cell (F20); ``row_valid`` is true when every
    measure value of the row parsed (the rule keeps only those rows).
    """
    tl = F.filter(F.transform(F.split(F.col("_t"), "\n", -1), py_strip),
                  lambda l: F.instr(l, "|") > 0)
    staged = with_computed(df.select(F.col(id_col).alias("_id"), _c(text_col).alias("_t")),
                           _tl=tl).drop("_t")
    sep = F.array_position(F.transform("_tl", lambda l: F.instr(l, "---") > 0), True).cast("int")
    staged = with_computed(staged, _sep=sep)
    staged = with_computed(staged, _hdr=cells_nonempty(F.get("_tl", F.col("_sep") - 2)))
    rows = F.filter(F.transform(F.slice("_tl", F.col("_sep") + 1, F.size("_tl")),
                                lambda l: cells_nonempty(l)),
                    lambda c: F.size(c) >= 2)
    # Measure columns: header index >= 1 (0-based) naming a measure word.
    measures = F.filter(F.transform("_hdr", lambda h, i: F.struct(i.alias("i"), h.alias("h"))),
                        lambda s: (s["i"] >= 1) & _any_word(s["h"], measure_words))
    staged = with_computed(
        staged.filter((F.size("_tl") >= 3) & (F.col("_sep") >= 2)
                      & _any_word(F.array_join("_hdr", ""), measure_words)),
        _rows=F.transform(rows, lambda c: F.slice(c, 1, F.size(F.col("_hdr")))), _m=measures)
    staged = staged.filter((F.size("_rows") > 0) & (F.size("_m") > 0))
    per_row = staged.select("_id", "_m", F.posexplode("_rows").alias("_r", "_cells"))
    vals = F.transform("_m", lambda s: F.struct(
        s["i"].alias("col_no"), s["h"].alias("header"),
        F.get(F.col("_cells"), s["i"]).alias("cell"),
        number_mean(F.get(F.col("_cells"), s["i"]), number_mode).alias("value")))
    per_row = with_computed(per_row, _vals=vals)
    return per_row.select(
        F.col("_id").alias(id_col), (F.col("_r") + 1).alias("row_no"),
        F.forall("_vals", lambda v: v["value"].isNotNull()).alias("row_valid"),
        F.explode("_vals").alias("_x")).select(
        id_col, "row_no", "_x.col_no", "_x.header", "_x.cell", "_x.value", "row_valid")


# --- T-B -----------------------------------------------------------------------------

def splitlines_text(text) -> Column:
    """``'\\n'.join(text.splitlines())``: every line boundary becomes ``\\n``
    and one final line break disappears."""
    t = F.regexp_replace(_c(text), _SPLITLINES, "\n")
    return F.regexp_replace(t, r"\n\z", "")


def _strings(*items) -> Column:
    return F.array(*items).cast("array<string>")


def _runs(flags: Column) -> Column:
    """(first, last) positions, from 0, of the runs of true in an array of flags."""
    def edges(step):
        return F.filter(F.transform(flags, lambda p, i: F.when(
            p & ~F.coalesce(F.get(flags, i + step), F.lit(False)), i)), lambda i: i.isNotNull())
    return F.zip_with(edges(-1), edges(1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _table_row(cells: Column, width: Column, first: Column) -> Column:
    """One table line: padded or cut to the width, the separator after the first."""
    cut = F.when(F.size(cells) > width, F.concat(
        F.slice(cells, 1, width - 1),
        F.array(F.array_join(F.slice(cells, width, F.size(cells)), " ")))).otherwise(cells)
    padded = F.concat(cut, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))
    row = F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))
    sep = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), width))
    return F.when(width < 2, F.array_join(cells, " ")).when(first, F.concat(row, sep)).otherwise(row)


def repair_tables(df: DataFrame, id_col: str, text_col: str, out_col: str = "repaired",
                  max_cols: int = MAX_COLS) -> DataFrame:
    """T-B: rebuild broken tables.

    Consecutive pipe lines form an island; the table starts at the island's
    first line with a letter or digit (earlier pipe lines pass through).
    Cells keep inner empties (F22); width = widest row, capped at
    ``max_cols``, overflow joined into the last cell; rows are padded; a
    separator follows the first row. A table one cell wide becomes lines of
    space-joined cells. Returns (id, repaired) for every input row.
    """
    base = df.select(F.col(id_col).alias("_id"), F.coalesce(_c(text_col), F.lit("")).alias("_t"))
    piped = F.instr("_t", "|") > 0
    rows = with_computed(base, _l=F.when(piped, F.split(splitlines_text("_t"), "\n", -1)))
    rows = with_computed(rows, _p=F.transform("_l", lambda x: F.instr(x, "|") > 0))
    rows = with_computed(rows, _runs=_runs(F.col("_p")))
    # Of each island: its lines before the table, and the cells of the table's lines.
    island = F.transform("_runs", lambda r: F.slice("_l", r["a"] + 1, r["b"] - r["a"] + 1))
    rows = with_computed(rows, _isl=island)
    start = F.transform("_isl", lambda x: F.array_position(F.transform(x, has_alnum), True).cast("int"))
    rows = with_computed(rows, _from=start)
    rows = with_computed(rows, _tab=F.zip_with("_isl", "_from", lambda x, f: F.struct(
        F.when(f > 0, F.slice(x, 1, f - 1)).otherwise(x).alias("head"),
        F.when(f > 0, F.filter(F.transform(F.slice(x, f, F.size(x)), cells_kept), lambda c: F.size(c) > 0))
        .otherwise(F.array().cast("array<array<string>>")).alias("cells"))))
    rows = with_computed(rows, _w=F.transform("_tab", lambda t: F.least(
        F.array_max(F.transform(t["cells"], lambda c: F.size(c))), F.lit(max_cols))))
    shown = F.zip_with("_tab", "_w", lambda t, w: F.concat(t["head"], F.transform(
        t["cells"], lambda c, i: _table_row(c, w, i == 0))))
    rows = with_computed(rows, _shown=shown)
    # The lines between islands go in front of each, the rest behind the last.
    after = F.transform("_runs", lambda r, k: F.coalesce(F.get(F.col("_runs"), k - 1)["b"] + 1, F.lit(0)))
    rows = with_computed(rows, _after=after)
    between = F.transform("_runs", lambda r, k: F.concat(
        F.slice("_l", F.get("_after", k) + 1, r["a"] - F.get("_after", k)), F.get("_shown", k)))
    last = F.coalesce(F.element_at("_runs", -1)["b"] + 1, F.lit(0))
    tail = F.slice("_l", last + 1, F.size("_l"))
    rows = with_computed(rows, _out=F.concat(F.flatten(between), tail))
    return rows.select(F.col("_id").alias(id_col), F.when(
        piped, F.array_join("_out", "\n")).otherwise(splitlines_text("_t")).alias(out_col))


# --- T-C -----------------------------------------------------------------------------

def repair_tables_light(df: DataFrame, id_col: str, text_col: str,
                        out_col: str = "repaired") -> DataFrame:
    """T-C: normalise pipe spacing and outer pipes of every pipe line, and
    after the first line of each run add ``|---|..`` unless the next line
    starts with a pipe and contains ``-``. Returns (id, repaired)."""
    base = df.select(F.col(id_col).alias("_id"), F.coalesce(_c(text_col), F.lit("")).alias("_t"))
    piped = F.instr("_t", "|") > 0
    rows = with_computed(base, _l=F.when(piped, F.split("_t", "\n", -1)))
    rows = with_computed(rows, _clean=F.transform("_l", py_strip))
    has_pipe = F.transform("_clean", lambda c: (F.instr(c, "|") > 0)
                           & (py_strip(F.replace(c, F.lit("|"), F.lit(""))) != ""))
    spaced = F.transform("_clean", lambda c: py_strip(F.regexp_replace(c, rf"{WS}*\|{WS}*", " | ")))
    rows = with_computed(rows, _hp=has_pipe, _p0=spaced)
    opened = F.transform("_p0", lambda c: F.when(c.startswith("|"), c).otherwise(F.concat(F.lit("| "), c)))
    rows = with_computed(rows, _p1=opened)
    closed = F.transform("_p1", lambda c: F.when(c.endswith("|"), c).otherwise(F.concat(c, F.lit(" |"))))
    rows = with_computed(rows, _proc=closed)

    def line(raw, i):
        proc, following = F.get("_proc", i), F.get("_clean", i + 1)
        next_is_sep = following.isNotNull() & following.startswith("|") & (F.instr(following, "-") > 0)
        n_cols = F.length(proc) - F.length(F.replace(proc, F.lit("|"), F.lit(""))) - 1
        sep = F.concat(F.lit("\n|"), F.repeat(F.lit("---|"), n_cols))
        first = F.when(~next_is_sep & (n_cols > 0), F.concat(proc, sep)).otherwise(proc)
        before = F.coalesce(F.get("_hp", i - 1), F.lit(False))
        return F.when(F.get("_hp", i), F.when(before, proc).otherwise(first)).otherwise(raw)

    rows = with_computed(rows, _out=F.transform("_l", line))
    return rows.select(F.col("_id").alias(id_col), F.when(
        piped, F.array_join("_out", "\n")).otherwise(F.col("_t")).alias(out_col))
