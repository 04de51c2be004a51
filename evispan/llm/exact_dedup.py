"""Exact dedup by content-defined chunk recipes; DataFrame functions only.

A text without white space is cut where its own characters say so. Chunks get short ids, ids are verified
against a strong digest of the chunk, and a document becomes a recipe: the ordered list of its chunk ids. Equal
recipes are equal texts. The text is read once; what moves between tasks is ids and digests, never a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evispan.llm.common import SPACES
from evispan.session import materialize_plain as materialize

MIN_CHUNK, MAX_CHUNK = 512, 4096
# Chunk ids in doubt that are listed one by one; with more of them, digests replace all short ids.
MAX_DOUBTFUL = 1000


def chunk_pattern(shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> str:
    """A chunk ends after two characters of which the first has code 1 mod 4 and the second 4 mod 8 (ASCII), at
    least ``shortest`` and at most ``longest`` characters after its start, or with the text. Cuts follow content: an
    insertion moves the cuts near it and leaves the later ones."""
    first = "".join(chr(c) for c in range(0x30, 0x7B) if c % 4 == 1 and chr(c).isalnum())
    second = "".join(chr(c) for c in range(0x30, 0x7B) if c % 8 == 4 and chr(c).isalnum())
    return f"(?s).{{{shortest},{longest - 2}}}?[{first}][{second}]|.{{{longest}}}|.+"


def squeezed(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACES}+", "")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_id, id, points, text_sha256, chunks array<struct<id, digest>>`` of every row; one pass, no shuffle."""
    plain = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("points"),
        squeezed(F.col(f"`{text_col}`")).alias("plain"),
    )
    return plain.select(
        "row_id",
        "id",
        "points",
        F.sha2("plain", 256).alias("text_sha256"),
        F.transform(
            F.regexp_extract_all("plain", F.lit(chunk_pattern()), F.lit(0)),
            lambda c: F.struct(F.xxhash64(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("digest")),
        ).alias("chunks"),
    )


def ambiguous_ids(cut: DataFrame) -> DataFrame:
    """Chunk ids that stand for more than one digest (none are expected); every chunk of the corpus is compared."""
    pairs = cut.select(F.explode("chunks").alias("c")).select("c.id", "c.digest")
    return (
        pairs.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after their white space is deleted. Of equal texts the row with the most code
    points in the original text stays, then the smallest id (null last). Null counts as empty text; all empty texts
    form one group. Rows that repeat an id and text are members of one group, and each of them that equals the
    choice in id and length is ``kept``. An empty table gives an empty result. Columns besides the two are ignored.
    """
    cut = materialize(recipes(docs, id_col, text_col), "recipes")
    doubtful = [row[0] for row in ambiguous_ids(cut).limit(MAX_DOUBTFUL + 1).collect()]
    recipe = F.col("chunks").getField("id")
    if len(doubtful) > MAX_DOUBTFUL:  # short ids are no use here: the full digests are the identifiers
        recipe = F.col("chunks").getField("digest")
    elif doubtful:  # an id in doubt gives way to its digest, so that recipes stay exact
        recipe = F.transform("chunks", lambda c: F.when(c["id"].isin(doubtful), F.hex(c["digest"])).otherwise(c["id"].cast("string")))
    listed = cut.select("id", "points", "text_sha256", recipe.alias("recipe"))
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    groups = listed.groupBy("recipe").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    # Only recipes that occur twice need the join; all others are their own group.
    shared = materialize(groups.where("group_size > 1"), "shared-recipes")
    joined = listed.join(shared, "recipe", "left")
    keep = F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("best").isNull() | (F.col("id").eqNullSafe(F.col("best.id")) & (-F.col("points") == F.col("best.p")))).alias("kept"),
        "text_sha256",
    )
