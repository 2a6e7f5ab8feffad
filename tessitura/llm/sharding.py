"""Sharding by proportional stratified interleaving (operator 9).

Rows are shuffled within each source by a seeded hash and ranked; a row's fractional
rank (rank - 0.5) / (rows of its source) spreads each source evenly over (0, 1).  All
rows in the order of that fraction are cut into shards of equal row counts (law
``rows``), so that every shard has the mixture of the whole, up to one row of each
source and shard.

No window sees a whole source: hashes and fractions are evenly spread numbers, so
equal intervals of them (*cells*) hold about equally many rows, whatever the source.
A row's rank is the number of rows in earlier cells, from a small table of counts,
plus its rank in its cell.  Text is turned into its size and crc32 before any shuffle.
The hash is of doc_id, size and crc32, so that rows without an id, or of one id, are
spread like others.  Counts of cells are summed in blocks of BLOCK, and only the sums of blocks
of one source in one window.

Defined results: a null text has size 1 and crc32 0, a text of any length one row; null is a
source of its own; rows that repeat another get slots of their own, one after the other, in any
order, being equal; ties of the hash are ordered by the columns; shards of an empty
table are empty.  Of docs only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.blocks import checkpointed
from tessitura.llm.mixing import hash_unit

ROWS_PER_CELL, LEAST_CELLS = 20_000, 512
BLOCK = 1024  # cells


def _cells(rows: int) -> int:
    return max(LEAST_CELLS, -(-rows // ROWS_PER_CELL))


def _offsets(df: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """For each key and cell the rows of that key in earlier cells, and of the key at all."""
    counts = df.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("_c")).withColumn("_block", F.floor(F.col(cell) / BLOCK))
    sums = counts.groupBy(*keys, "_block").agg(F.sum("_c").alias("_s"))
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    blocks = sums.select(*keys, "_block", (F.sum("_s").over(w.orderBy("_block")) - F.col("_s")).alias("_earlier"), F.sum("_s").over(w).alias("_all"))
    within = Window.partitionBy(*keys, "_block").orderBy(cell)
    return counts.join(blocks, [*keys, "_block"]).select(*keys, cell, (F.col("_earlier") + F.sum("_c").over(within) - F.col("_c")).alias("_before"), "_all")


def interleave(keyed: DataFrame, shards: int = 16, seed: str = "shard") -> DataFrame:
    """keyed(row_key, source, ...) with shard and slot.

    The seeded shuffle hashes ``row_key`` and the columns besides; of rows with one hash those
    are ordered, and what is then equal stands in any order.
    """
    n = keyed.count()
    cells = _cells(n)
    rest = [c for c in keyed.columns if c not in ("row_key", "source")]
    u = keyed.withColumn("_u", hash_unit(seed, F.col("row_key"), *(F.col(c) for c in rest))).withColumn("_src", F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name")))
    u = u.withColumn("_cell", F.floor(F.col("_u") * cells).cast("int"))
    tie = [F.col(c) for c in ("row_key", *rest)]
    local = Window.partitionBy("_src", "_cell").orderBy("_u", *tie)
    ranked = (
        u.join(_offsets(u, ["_src"], "_cell"), ["_src", "_cell"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(local))
        .withColumn("_f", (F.col("_rank") - 0.5) / F.col("_all"))
        .drop("_before", "_all", "_cell", "_u")
        .withColumn("_cell", F.floor(F.col("_f") * cells).cast("int"))
    )
    # what follows reads the ranks twice; ties make a second reckoning another one
    ranked = checkpointed(ranked)
    spot = Window.partitionBy("_cell").orderBy("_f", "_src", "_rank")
    placed = ranked.join(_offsets(ranked, [], "_cell"), ["_cell"]).withColumn("_at", F.col("_before") + F.row_number().over(spot) - 1)
    # shard k holds the places from ceil(k * n / shards) on
    return (
        placed.withColumn("shard", F.expr(f"cast(_at * {shards}L div {max(n, 1)}L as int)"))
        .withColumn("slot", F.expr(f"cast(_at - (shard * {n}L + {shards - 1}L) div {shards}L as long)"))
        .drop("_cell", "_before", "_all", "_f", "_src", "_rank", "_at")
    )


def shard_documents(docs: DataFrame, shards: int = 16, seed: str = "shard") -> DataFrame:
    """The place of every row of docs(doc_id, text, source): doc_id, source, size, text_crc32, law, shard, slot, grown_shard.

    grown_shard is null: under the law ``rows`` another number of shards is another cut.
    """
    keyed = docs.select(
        F.col("doc_id").alias("row_key"),
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    placed = interleave(keyed, shards, seed)
    return placed.select(F.col("row_key").alias("doc_id"), "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_shard(spark, sf_dir: str) -> DataFrame:
    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "source")


OP9_SQL = r"""
WITH t AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384::BIGINT)) ORDER BY n) AS t FROM range(256) t(n)),
h AS (SELECT doc_id, source, encode(coalesce(text, '')) AS raw FROM documents),
b AS (SELECT doc_id, source, octet_length(raw) + 1 AS size,
             xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(raw), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]))) AS crc FROM h, t),
u AS (SELECT *, ('0x' || substr(md5(concat_ws('|', 'shard', coalesce(doc_id::VARCHAR, ''), size, crc)), 1, 13))::BIGINT AS u FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY u, doc_id, size, crc) AS r, count(*) OVER (PARTITION BY source) AS m, count(*) OVER () AS n FROM u),
p AS (SELECT *, row_number() OVER (ORDER BY (r - 0.5::DOUBLE) / m, source IS NULL, encode(coalesce(source, '')), r) - 1 AS place FROM r),
q AS (SELECT *, place * 16 // n AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard, (place - (shard * n + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard, source FROM q
"""
