"""Location labels and source records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evispan.constants import PAGE_LABEL, ROW_LABEL, ROWS_LABEL
from evispan.functions.text import excerpt


def _row_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit(ROW_LABEL), start.cast("string"))).otherwise(
        F.concat(F.lit(ROWS_LABEL), start.cast("string"), F.lit("-"), end.cast("string"))
    )


def document_location(page: Column, row_start: Column, row_end: Column) -> Column:
    """Label of a chunk: rows if it has any, else its page (stored from 0, shown from 1)."""
    return F.when(row_start.isNotNull(), _row_label(row_start, F.coalesce(row_end, row_start))).otherwise(
        F.concat(F.lit(PAGE_LABEL), (page + 1).cast("string"))
    )


def source_location(page: Column, row_start: Column, row_end: Column) -> Column:
    """Label of a source record, in lower case: its page already counts from 1, a row end of 0 counts as
    missing, and a source with neither rows nor page shows ``None``."""
    label = F.when(
        row_start.isNotNull(), _row_label(row_start, F.coalesce(F.nullif(row_end, F.lit(0)), row_start))
    ).otherwise(F.concat(F.lit(PAGE_LABEL), F.coalesce(page.cast("string"), F.lit("None"))))
    return F.lower(label)


def source_struct(page: Column, row_start: Column, row_end: Column, text: Column) -> Column:
    """Source record of a chunk."""
    return excerpt_struct(page, row_start, row_end, excerpt(text))


def excerpt_struct(page: Column, row_start: Column, row_end: Column, cut: Column) -> Column:
    """Source record of a chunk whose excerpt is taken already."""
    return F.struct((page + 1).alias("page"), row_start.alias("row_start"), row_end.alias("row_end"), cut.alias("excerpt"))


def source_labels(sources: Column) -> Column:
    """Labels of an array of source records, joined by a comma."""
    return F.array_join(
        F.transform(sources, lambda s: source_location(s["page"], s["row_start"], s["row_end"])), ", "
    )
