"""Sharding by proportional stratified interleaving; DataFrame functions only.

Rows of each source are ranked in a seeded random order; row r of n has the fraction (r - u) / n,
where u in (0, 1) is seeded by the source, so that sources of few rows don't meet at one fraction.
All rows are sorted by that fraction and cut into shards of equal count, so every shard holds each
source in its share of the whole.  Law ``rows``: counts of two shards differ by one at most.

Texts don't move: only ids, sizes and checksums are shuffled.  Rows that are equal in all of this are
counted before any shuffle, ranked as one, and dealt out again in chunks: no id or copy makes a hot
bucket.  Null text has size 1 and checksum 0; null source counts as a source ''.  Equal rows may trade
places.  An empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm import ranks

SHARDS = 16
SEED = "shards-1"
#: Equal rows that are dealt out together.
CHUNK = 4096


def interleave(rows: DataFrame, total: int, *, shards: int = SHARDS, stratum: str = "source", seed: str = SEED) -> DataFrame:
    """Adds shard (int) and slot (long) to rows with doc_id, size, text_crc32 and ``stratum``, which
    must be all their columns."""
    k, ties = ranks.digits(total), ["doc_id", "text_crc32", "size"]
    cuts, run = 16**k, 16 ** (k // 2)
    same = rows.groupBy(stratum, *ties).agg(F.count("*").alias("_n"))
    same = same.withColumn("_h", ranks.shuffled(seed, F.col("doc_id"))).withColumn("_b", F.substring("_h", 1, k))

    counts = same.groupBy(stratum, "_b").agg(F.sum("_n").alias("_n"))
    offsets = ranks.offsets(counts, "_b", F.substring("_b", 1, k - k // 2), "_n", "_off", (stratum,)).drop("_n")
    size = counts.groupBy(stratum).agg(F.sum("_n").alias("_all"))
    below = Window.partitionBy(stratum, "_b").orderBy("_h", *ties).rowsBetween(Window.unboundedPreceding, -1)
    first = same.withColumn("_r", F.coalesce(F.sum("_n").over(below), F.lit(0))).join(offsets, [stratum, "_b"]).join(size, stratum)
    chunks = first.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {CHUNK}"))))
    chunks = chunks.repartition(stratum, "_h", "_k")  # one row may stand for a third of all
    last = F.least(F.col("_n"), (F.col("_k") + 1) * CHUNK)
    ranked = chunks.withColumn("_i", F.explode(F.sequence(F.col("_k") * CHUNK + 1, last)))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(stratum))), 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**32))
    ranked = ranked.withColumn("_f", (F.col("_off") + F.col("_r") + F.col("_i") - u) / F.col("_all")).drop("_n", "_b", "_k", "_r", "_i", "_off", "_all")

    ranked = ranked.withColumn("_c", F.floor(F.col("_f") * cuts))
    sizes = ranked.groupBy("_c").agg(F.count("*").alias("_m"))
    starts = ranks.offsets(sizes, "_c", F.floor(F.col("_c") / run), "_m", "_first").drop("_m")
    at = F.row_number().over(Window.partitionBy("_c").orderBy("_f", stratum, "_h", *ties)) - 1
    placed = ranked.withColumn("_at", at).join(starts, "_c").withColumn("_p", F.col("_first") + F.col("_at"))
    shard = F.expr(f"(_p * {shards}) div {max(1, total)}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_p") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}"))


def shard(docs: DataFrame, *, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law moves rows when shards are added), source."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    out = interleave(rows, docs.count(), shards=shards, seed=seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


SQL = f"""
WITH tbl AS (
  SELECT list(c ORDER BY i) t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) c
    FROM (SELECT unnest(range(256)) i))),
raw AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(source, '') AS source,
    CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295,
      list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) END AS text_crc32,
    md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')) AS h, (('0x' || substr(md5('{SEED}|' || coalesce(source, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE AS u
  FROM documents, tbl),
frac AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size) - u) / count(*) OVER (PARTITION BY source) AS f FROM raw),
pos AS (SELECT *, row_number() OVER (ORDER BY f, source, h, doc_id, text_crc32, size) - 1 AS p, count(*) OVER () AS n FROM frac)
SELECT doc_id, size, text_crc32, 'rows' AS law, ((p * {SHARDS}) // n)::INT AS shard,
  (p - (((p * {SHARDS}) // n) * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, source
FROM pos
"""
