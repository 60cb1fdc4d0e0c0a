"""Ordering, cursors and pagination.

``position_within`` numbers the rows of every group in a total order
without sending a whole group to one task: bounds computed from the row
itself cut a group into slices, each slice is numbered by itself, and a
small table of counts a slice supplies the offsets.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .topk import _cols


#: Places of one document in a slice: a group of n rows becomes about n / SLICE slices (or more) for each value before.
SLICE = 8192


def slice_of(place) -> Column:
    """The slice of a whole-number place within its page, for ``position_within``."""
    return F.floor((F.col(place) if isinstance(place, str) else place) / SLICE)


def position_within(df: DataFrame, key: str, order: Sequence, bounds: Sequence, out: str = "pos") -> DataFrame:
    """1-based position of each row inside its ``key`` group by ``order``
    (``order`` must be a total order within the group).

    ``bounds`` are columns that rise with ``order`` (a row before another
    never has greater ones): they cut each group into slices that follow one
    another. Being functions of the row alone, they are the same in every
    run of the plan, so numbering and counting may each compute them, nothing
    is written, and no job starts before the result is asked for. A row's
    position is its place in its slice plus the rows of the slices before,
    from one count a slice; a slice, not a group, is what one task sorts.
    Null keys are one group; null bounds come first, as Spark's ascending
    order has them.
    """
    cuts = [f"_cut{i}" for i in range(len(bounds))]
    # a struct is never null itself and compares with nulls inside as equal, so null keys meet in the join, too
    sliced = df.withColumn("_slice", F.struct(F.col(key).alias("_key"), *[b.alias(c) for b, c in zip(_cols(bounds), cuts)]))
    local = sliced.withColumn("_lpos", F.row_number().over(Window.partitionBy("_slice").orderBy(*_cols(order))))
    counts = sliced.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = (Window.partitionBy(F.col("_slice._key")).orderBy(*[F.col(f"_slice.{c}") for c in cuts])
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (local.join(offsets, "_slice")
            .withColumn(out, (F.col("_lpos") + F.col("_off")).cast("int"))
            .drop("_slice", "_lpos", "_off"))


# -------------------------------------------------------------------- cursors
def encode_text_cursor(offset) -> Column:
    """base64("media:N")."""
    return F.base64(F.encode(F.concat(F.lit("media:"), F.col(offset) if isinstance(offset, str) else offset), "UTF-8"))


def decode_text_cursor(cursor) -> Column:
    """W7/W10 split: "media:N" inside base64 -> N; anything invalid -> 0;
    negative offsets clamp to 0 (Q11)."""
    c = F.col(cursor) if isinstance(cursor, str) else cursor
    txt = F.try_to_binary(c, F.lit("base64")).cast("string")
    n = F.trim(F.element_at(F.split(txt, ":"), 2)).try_cast("int")
    return F.greatest(F.coalesce(n, F.lit(0)), F.lit(0))


def decode_text_cursor_value(cursor: str | None) -> int:
    """The same rule for a cursor given as a job parameter."""
    import base64
    import binascii
    if not cursor:
        return 0
    try:
        n = int(base64.b64decode(cursor).decode().split(":")[1])
    except (binascii.Error, UnicodeDecodeError, IndexError, ValueError):
        return 0
    return max(n, 0)


def encode_json_cursor(offset) -> Column:
    """base64('{"offset": N}') (json.dumps spacing)."""
    o = F.col(offset) if isinstance(offset, str) else offset
    return F.base64(F.encode(F.format_string('{"offset": %d}', o), "UTF-8"))


def decode_json_cursor(cursor) -> tuple[Column, Column]:
    """W6/W10 root: (offset, is_valid). NULL/empty cursor -> (0, true);
    undecodable -> (0, false); missing key -> offset 0."""
    c = F.col(cursor) if isinstance(cursor, str) else cursor
    txt = F.try_to_binary(c, F.lit("base64")).cast("string")
    parsed = F.try_parse_json(txt)
    is_obj = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    off = F.try_variant_get(parsed, "$.offset", "int")
    empty = F.coalesce(c, F.lit("")) == ""
    valid = empty | is_obj
    offset = F.when(empty | ~is_obj, 0).otherwise(F.coalesce(off, F.lit(0)))
    return offset, valid


def decode_json_cursor_strict(cursor) -> Column:
    """W9s/W10 service policy: a cursor that does not decode to a JSON object
    fails the job with "Invalid cursor" (NULL cursor -> offset 0)."""
    offset, valid = decode_json_cursor(cursor)
    return F.when(valid, offset).otherwise(F.raise_error(F.lit("Invalid cursor")).cast("int"))


def page_meta_service(total, start, limit: int) -> dict[str, Column]:
    """W9s: the service page meta — has_more and the next cursor only."""
    t = F.col(total) if isinstance(total, str) else total
    s = F.col(start) if isinstance(start, str) else start
    end = s + limit
    return {"has_more": end < t, "next_cursor": F.when(end < t, encode_json_cursor(end))}


def decode_json_cursor_value(cursor: str | None) -> tuple[int, bool]:
    """The same rule for a cursor given as a job parameter."""
    import base64
    import json
    if not cursor:
        return 0, True
    try:
        data = json.loads(base64.b64decode(cursor).decode("utf-8"))
        return int(data.get("offset", 0)), True
    except (ValueError, AttributeError, TypeError):
        return 0, False


# ---------------------------------------------------------------- split pages
def split_page(media: DataFrame, cursor: str | None, limit: int, media_type: str | None = None,
               pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """W3+W5+W9+F10: one page of the priority-sorted media list per page_id
    for a cursor. Returns (items, meta). The slice is a first-k
    (start+limit) per page, so the map-side WindowGroupLimit bounds what
    each task ships; totals come from a separate partial count, kept apart
    so the first-k rewrite survives. The media_type filter applies AFTER
    the slice and leaves counts and cursors untouched. With ``pages``
    (``page_id`` of every page) a page without media has its meta row too."""
    start = decode_text_cursor_value(cursor)
    m = media.withColumn("_pdesc", -F.col("priority"))
    w = Window.partitionBy("page_id").orderBy("_pdesc", "class_rank", "node_id")
    items = (m.withColumn("pos", F.row_number().over(w))
             .filter((F.col("pos") > start) & (F.col("pos") <= start + limit)).drop("_pdesc"))
    if media_type:
        items = items.filter(F.col("type") == media_type)
    totals = media.groupBy("page_id").agg(F.count("*").alias("total_count"))
    if pages is not None:
        totals = pages.join(totals, "page_id", "left").fillna(0, ["total_count"])
    return items, page_meta_split(totals, start, limit)


def page_meta_split(totals: DataFrame, start: int, limit: int) -> DataFrame:
    """total_count, current_page_start/end, has_more, next_cursor."""
    end = F.least(F.lit(start + limit), F.col("total_count"))
    return totals.select(
        "page_id", "total_count", F.lit(start).alias("current_page_start"),
        end.alias("current_page_end"), (end < F.col("total_count")).alias("has_more"),
        F.when(end < F.col("total_count"), encode_text_cursor(end)).alias("next_cursor"))


def all_pages(media: DataFrame, limit: int) -> DataFrame:
    """Every result page of every page_id at once. Adds ``pos``
    (1-based rank in priority order), ``page_no`` and per-row page bounds."""
    m = media.withColumn("priority_desc", -F.col("priority"))
    ranked = position_within(m, "page_id", ["priority_desc", "class_rank", "node_id"],
                             ["priority_desc", "class_rank", slice_of("node_id")]).drop("priority_desc")
    return ranked.withColumn("page_no", F.floor((F.col("pos") - 1) / limit).cast("int"))


def page_meta_root(total, start, limit: int) -> dict[str, Column]:
    """Remaining, has_more, next and previous JSON cursors."""
    t = F.col(total) if isinstance(total, str) else total
    s = F.col(start) if isinstance(start, str) else start
    remaining = F.greatest(F.lit(0), t - (s + limit))
    return {
        "total_count": t,
        "remaining_count": remaining,
        "has_more": remaining > 0,
        "next_cursor": F.when(remaining > 0, encode_json_cursor(s + limit)),
        "previous_cursor": F.when(s > 0, encode_json_cursor(F.greatest(F.lit(0), s - limit))),
    }
