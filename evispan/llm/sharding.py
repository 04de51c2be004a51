"""Sharding by sampled splitters; DataFrame functions only.

A size-weighted sample of keys gives splitters at equal shares of bytes, and records are range-partitioned by them.
Ranges that hold too much are subdivided: a key that alone is heavy, by bytes or by rows, leaves its range, and
cells of a range are cut by a hash until none holds more than a bounded number of rows. Cells are then laid out over the shards by their exact bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evispan.session import materialize_plain as materialize

# Ranges: FAN x FAN. Sampled keys: SAMPLE on average. A heavy key holds more than 1/HEAVY of a shard's bytes.
FAN, SAMPLE, HEAVY = 32, 32_768, 64
MAX_CELL_ROWS = 1_000_000


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, key, size, text_crc32``; equal texts have equal keys. Null text: no bytes."""
    raw = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(F.col(f"`{text_col}`").isNull(), raw).alias("key"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )


def splitters(records: DataFrame, total: int, ranges: int, sample: int = SAMPLE) -> list[int]:
    """``ranges - 1`` keys at equal shares of the sampled bytes. A record is drawn with a chance in proportion to its
    size (by a hash, so always the same ones); those large enough to be drawn for sure weigh their size."""
    chance = F.least(F.lit(1.0), F.col("size") * (sample / max(total, 1)))
    draw = F.pmod(F.xxhash64(F.lit(7), "id", "key"), F.lit(1 << 40)) / float(1 << 40)
    drawn = records.where(draw < chance).select("key", (F.col("size") / chance).alias("weight")).collect()
    keys = sorted((row.key, row.weight) for row in drawn)
    whole, gone, found = sum(w for _, w in keys), 0.0, []
    for key, weight in keys:
        gone += weight
        while len(found) < ranges - 1 and gone >= whole * (len(found) + 1) / ranges:
            found.append(key)
    return found + [(1 << 63) - 1] * (ranges - 1 - len(found))


def range_of(key: Column, found: list[int], fan: int = FAN) -> Column:
    """Number of splitters below the key, in two steps of ``fan`` comparisons each."""
    tops = found[fan - 1 :: fan]
    groups = F.array(*(F.array(*(F.lit(s) for s in found[fan * i : fan * i + fan - 1])) for i in range(fan)))
    top = F.size(F.filter(F.array(*map(F.lit, tops)), lambda s: s < key))
    below = F.size(F.filter(F.element_at(groups, top + 1), lambda s: s < key))
    return (top * fan + below).cast("int")


def layout(cells: list, shards: int) -> list[tuple[int, int, int, int]]:
    """``(range, part, shard, first slot)`` of each cell ``(range, part, heavy, rows, bytes)``.

    Heavy keys go, largest first, to the shard with the least bytes; the cells of ordinary ranges then fill what each shard
    lacks, in key order. A heavy key stays whole unless it exceeds a shard's share; its cells are then laid out singly.
    """
    total = sum(c.bytes for c in cells)
    share = total / shards
    heavy: dict[int, list] = {}
    for c in cells:
        if c.heavy:
            heavy.setdefault(c.range, []).append(c)
    load, placed = [0.0] * shards, {}
    units = []
    for group in heavy.values():
        units += [group] if sum(c.bytes for c in group) <= share else [[c] for c in group]
    for unit in sorted(units, key=lambda u: (-sum(c.bytes for c in u), u[0].range, u[0].part)):
        s = min(range(shards), key=lambda i: (load[i], i))
        for c in unit:
            placed[c.range, c.part] = s
            load[s] += c.bytes
    light = sorted((c for c in cells if not c.heavy), key=lambda c: (c.range, c.part))
    level = fill_level(load, sum(c.bytes for c in light))
    room = [max(0.0, level - x) for x in load]
    s, used = 0, 0.0
    for c in light:
        # A cell goes to the shard in which its middle lies.
        while s < shards - 1 and used + c.bytes / 2 > room[s]:
            used -= room[s]
            s += 1
        placed[c.range, c.part] = s
        used += c.bytes
    slot, out = [0] * shards, []
    for c in sorted(cells, key=lambda c: (c.range, c.part)):
        s = placed[c.range, c.part]
        out.append((c.range, c.part, s, slot[s]))
        slot[s] += c.rows
    return out


def fill_level(load: list[float], rest: float) -> float:
    """The level up to which ``rest`` fills all loads that are lower."""
    level, n = 0.0, 0
    for i, x in enumerate(sorted(load)):
        if i and (x - level) * n >= rest:
            break
        rest -= (x - level) * n if i else 0.0
        level, n = x, n + 1
    return level + rest / max(n, 1)


def shard(
    docs: DataFrame,
    shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
    max_cell_rows: int = MAX_CELL_ROWS,
) -> DataFrame:
    """One row per input row: ``id, size, text_crc32, shard, slot``; shards have nearly equal bytes.

    Size is the text's UTF-8 bytes and 1; null text has none, and its own key. Equal texts share a shard unless they
    exceed a shard's share of the bytes together. Slots of a shard count from 0 without gap, ordered by key, id
    and size; rows that are equal in all of these take neighbouring slots. Null ids are allowed; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    records = materialize(keyed(docs, id_col, text_col), "records")
    total, count = records.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    found = splitters(records, total, FAN * FAN, sample)
    most = max(1, min(max_cell_rows, 4 * count // (FAN * FAN)))
    # Heavy by bytes are shards * HEAVY keys at most, by rows as many as cells of the bound fit into the table.
    sums = records.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    heavy = sums.where((F.col("bytes") > total / (shards * HEAVY)) | (F.col("rows") > most)).select("key")
    heavy = [row.key for row in heavy.orderBy("key").collect()]
    number = F.array_position(F.array(*map(F.lit, heavy)), F.col("key")) if heavy else F.lit(0)
    ranged = records.withColumn("heavy", number.cast("int")).withColumn(
        "range", F.when(F.col("heavy") > 0, F.lit(FAN * FAN - 1) + F.col("heavy")).otherwise(range_of(F.col("key"), found))
    )
    # Overfull ranges are cut by a hash: of the key in ordinary ones (equal texts stay together), of the id in a heavy one.
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most)
    cuts = {r.range: -(-r.rows // most) for r in sizes.collect()}
    cut = spark.createDataFrame([(r, n) for r, n in cuts.items()], "range int, parts int")
    hashed = F.when(F.col("heavy") > 0, F.xxhash64(F.lit(11), "id")).otherwise(F.xxhash64(F.lit(11), "key"))
    celled = (
        ranged.join(F.broadcast(cut), "range", "left")  # one row per cut range
        .withColumn("part", F.pmod(hashed, F.coalesce("parts", F.lit(1))).cast("int"))
        .drop("parts")
    )
    stats = celled.groupBy("range", "part").agg(
        F.max("heavy").alias("heavy"), F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")
    )
    placed = spark.createDataFrame(layout(stats.collect(), shards), "range int, part int, shard int, first bigint")
    order = F.row_number().over(Window.partitionBy("range", "part").orderBy("key", "id", "size"))
    return celled.join(F.broadcast(placed), ["range", "part"]).select(  # one row per cell
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("first") + order - 1).alias("slot")
    )

