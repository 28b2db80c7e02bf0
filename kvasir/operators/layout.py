"""The geometry of a page: words to text, rows and columns, grids of lines to tables. A page's items are few and are taken together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 2.0


def positioned_text(words: DataFrame, page: list[str], *, line: float = 5.0, gap: float = 1.5, wide: float = 24.0) -> DataFrame:
    """``page, text``: words (``id, text, x, y, width, height``) of each page as lines of text.

    Words within ``line`` of one height are a line. Between two of a line there is nothing if they are closer than
    ``gap``, two spaces if farther than ``wide``, else one. A lower-case figure half as high as its neighbour and above it
    is a superscript and is set after a caret.
    """
    rows = words.where("x is not null and y is not null and text is not null").dropDuplicates([*page, "id"])
    down = Window.partitionBy(*page).orderBy("y", "x", "id")
    new = F.when(F.col("y") - F.lag("y").over(down) > line, 1).otherwise(0)
    rows = rows.withColumn("_new", new).withColumn("line_no", F.sum("_new").over(down))
    across = Window.partitionBy(*page, "line_no").orderBy("x", "id")
    before = F.lag(F.struct("x", "y", "width", "height")).over(across)
    rows = rows.withColumn("_b", before).withColumn("_gap", F.col("x") - F.col("_b.x") - F.col("_b.width"))
    raised = (F.col("height") <= F.col("_b.height") * 0.6) & (F.col("y") < F.col("_b.y")) & F.col("text").rlike(r"^[0-9]+$")
    lead = F.when(F.col("_b").isNull(), "").when(raised, "^").when(F.col("_gap") < gap, "").when(F.col("_gap") > wide, "  ").otherwise(" ")
    rows = rows.withColumn("_t", F.concat(lead, F.col("text")))
    lines = rows.groupBy(*page, "line_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "id", "_t"))), lambda s: s["_t"]), "").alias("t"))
    return lines.groupBy(*page).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "t"))), lambda s: s["t"]), "\n").alias("text"))


def column_anchors(items: DataFrame, page: list[str], near: float = 12.0) -> DataFrame:
    """``page, id, col``: items by the column they stand in.

    From left to right an item joins the last column if it is within ``near`` of that column's mean place, else it opens
    one; the mean runs with the items.
    """
    rows = items.where("x is not null").select(*page, "id", F.col("x").cast("double").alias("x")).dropDuplicates([*page, "id"])
    types = dict(rows.dtypes)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p, code in _whole_pages(parts, page):
            cols, mean, n, at, last = [], 0.0, 0, -1, -1
            for x, c in zip(p["x"].to_numpy(), code):
                if c != last:
                    last, at = c, -1
                if at < 0 or abs(x - mean) > near:
                    at, mean, n = at + 1, x, 1
                else:
                    n += 1
                    mean += (x - mean) / n
                cols.append(at)
            yield p.assign(col=cols)[[*page, "id", "col"]]

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in page), f"id {types['id']}", "col bigint"])
    return rows.repartition(*page).sortWithinPartitions(*page, "x", "id").mapInPandas(place, schema)


def _whole_pages(parts: Iterator[pd.DataFrame], page: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows that come sorted by page, in parts that don't cut a page, with a number for each page."""
    rest = None
    for p in parts:
        p = p if rest is None or not len(rest) else pd.concat([rest, p])
        if not len(p):
            continue
        code = p.groupby(page, sort=False, dropna=False).ngroup().to_numpy()
        cut = int(np.searchsorted(code, code[-1]))  # the last page may go on
        rest = p.iloc[cut:]
        if cut:
            yield p.iloc[:cut], code[:cut]
    if rest is not None and len(rest):
        yield rest, np.zeros(len(rest), np.int64)


def touching_groups(boxes: DataFrame, page: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """``page, id, grid``: boxes (``id, x, y, width, height``) that touch one another, directly or through others; ``grid`` is the least id.

    Lines are boxes of no width or height. Boxes are swept from left to right, so that only those that overlap in x are
    compared.
    """
    rows = boxes.where("x is not null and y is not null and width is not null and height is not null").select(*page, "id", "x", "y", "width", "height").dropDuplicates([*page, "id"])
    types = dict(rows.dtypes)

    def heads(x: np.ndarray, y: np.ndarray, r: np.ndarray, b: np.ndarray) -> list[int]:
        head = list(range(len(x)))

        def top(i: int) -> int:
            while head[i] != i:
                head[i] = head[head[i]]
                i = head[i]
            return i

        open_: list[int] = []
        for i in range(len(x)):
            open_ = [j for j in open_ if r[j] + tolerance >= x[i]]
            for j in open_:
                if y[j] <= b[i] + tolerance and y[i] <= b[j] + tolerance:
                    head[top(i)] = top(j)
            open_.append(i)
        return [top(i) for i in range(len(x))]

    def group(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p, code in _whole_pages(parts, page):
            x, y = p["x"].to_numpy(float), p["y"].to_numpy(float)
            r, b, ids = x + p["width"].to_numpy(float), y + p["height"].to_numpy(float), p["id"].to_numpy()
            begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            least = []
            for lo, hi in zip(begin, [*begin[1:], len(p)]):
                root = heads(x[lo:hi], y[lo:hi], r[lo:hi], b[lo:hi])
                first: dict[int, int] = {}
                for t, i in zip(root, ids[lo:hi]):
                    first[t] = min(i, first.get(t, i))
                least += [first[t] for t in root]
            yield p.assign(grid=least)[[*page, "id", "grid"]]

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in page), f"id {types['id']}", f"grid {types['id']}"])
    return rows.repartition(*page).sortWithinPartitions(*page, "x", "id").mapInPandas(group, schema)


def grid_tables(lines: DataFrame, words: DataFrame, page: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """``page, grid, markdown``: the tables of a page whose cells are drawn by lines (``id, x, y, width, height``).

    Each group of touching lines is a grid; its distinct places across and down are its columns and rows. A word belongs
    to the cell in which its middle lies; cells without a line between them are one, and its words stand in the first.
    """
    grids = touching_groups(lines, page, tolerance).join(lines.select(*page, "id", "x", "y", "width", "height").dropDuplicates([*page, "id"]), [*page, "id"])
    types = dict(grids.dtypes)

    def cut(values: list[float]) -> list[float]:
        out: list[float] = []
        for v in sorted(values):
            if not out or v - out[-1] > tolerance:
                out.append(v)
        return out

    def build(g: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        found = []
        for grid, own in g.groupby("grid"):
            flat, steep = own[own["height"] <= tolerance], own[own["width"] <= tolerance]
            ys, xs = cut(flat["y"].tolist()), cut(steep["x"].tolist())
            if len(ys) < 2 or len(xs) < 2:
                continue
            cells: dict[tuple[int, int], list[tuple[float, float, str]]] = {}
            for t, x, y, wide, high in zip(w["text"], w["x"], w["y"], w["width"], w["height"]):
                cx, cy = x + wide / 2, y + high / 2
                if t is None or not (xs[0] <= cx <= xs[-1] and ys[0] <= cy <= ys[-1]):
                    continue
                c, r = max(i for i, v in enumerate(xs[:-1]) if v <= cx), max(i for i, v in enumerate(ys[:-1]) if v <= cy)
                while c > 0 and not ((abs(steep["x"] - xs[c]) <= tolerance) & (steep["y"] <= cy) & (steep["y"] + steep["height"] >= cy)).any():
                    c -= 1
                while r > 0 and not ((abs(flat["y"] - ys[r]) <= tolerance) & (flat["x"] <= cx) & (flat["x"] + flat["width"] >= cx)).any():
                    r -= 1
                cells.setdefault((r, c), []).append((y, x, t))
            text = lambda r, c: " ".join(t for _, _, t in sorted(cells.get((r, c), []))).replace("|", "\\|")
            body = ["| " + " | ".join(text(r, c) for c in range(len(xs) - 1)) + " |" for r in range(len(ys) - 1)]
            body.insert(1, "|" + " --- |" * (len(xs) - 1))
            found.append({**{k: own[k].iloc[0] for k in page}, "grid": grid, "markdown": "\n".join(body)})
        return pd.DataFrame(found, columns=[*page, "grid", "markdown"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in page), f"grid {types['id']}", "markdown string"])
    placed = words.select(*page, "id", "text", "x", "y", "width", "height").dropDuplicates([*page, "id"])
    return grids.groupBy(*page).cogroup(placed.groupBy(*page)).applyInPandas(build, schema)


def region_of(tables: DataFrame, regions: DataFrame, page: list[str], least: float = 0.2) -> DataFrame:
    """``table_id, region_id, score``: the region of its page that a table belongs to best, by the share of its area within and of its words.

    Both have ``id, x, y, width, height, words`` (an array). The score is the mean of both shares; none below ``least``.
    """
    t, r = (df.select(*page, *(F.col(c).alias(f"{n}_{c}") for c in ("id", "x", "y", "width", "height", "words"))) for df, n in ((tables, "t"), (regions, "r")))
    both = t.join(r, page)
    wide = F.greatest(F.lit(0.0), F.least(F.expr("t_x + t_width"), F.expr("r_x + r_width")) - F.greatest("t_x", "r_x"))
    high = F.greatest(F.lit(0.0), F.least(F.expr("t_y + t_height"), F.expr("r_y + r_height")) - F.greatest("t_y", "r_y"))
    area = F.col("t_width") * F.col("t_height")
    inside = F.when(area > 0, wide * high / area).otherwise(0.0)
    shared = F.size(F.array_intersect("t_words", "r_words")) / F.greatest(F.size(F.array_distinct("t_words")), F.lit(1))
    scored = both.select(F.col("t_id").alias("table_id"), F.col("r_id").alias("region_id"), F.round((inside + shared) / 2, 6).alias("score")).where(F.col("score") >= least)
    w = Window.partitionBy("table_id").orderBy(F.desc("score"), "region_id")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
