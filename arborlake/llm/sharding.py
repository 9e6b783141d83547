"""Sharding by extendible hashing, in DataFrame operations only.

A directory is indexed by the leading bits of a hash of the row. A bucket whose rows hold
more than the byte limit is split on the next bit, and only such a bucket, until every
shard fits. The shard of a row is the shortest prefix of its hash whose bucket fits.

The bytes of prefixes of ``ROUND_BITS`` bits are added up before the shuffle; the bytes of
shorter prefixes follow from these sums, never from the rows. Buckets that do not fit even
then are split by another round of bits, which reads only their rows. The hash has
``HASH_BITS`` bits and covers id and text, so it parts any two rows but exact repeats.
Repeats that are too many for one shard go to overflow pages of that bucket, as many rows
to a page as fit; a single row larger than the limit has a shard of its own.

The assignment joins narrow rows (id, bytes, hash) on hashed prefixes, which spreads any
source or group of copies evenly; texts are not shuffled.

Defined results: a NULL text has 0 bytes; NULL ids are hashed as the empty string; an
empty table gives no shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm.store import drop, keep

#: Bytes of text that a shard may hold.
LIMIT_BYTES = 64 << 20
HASH_BITS = 60
ROUND_BITS = 20
#: Repeated rows that one task numbers at a time.
REPEATS = 10_000


def row_hash(doc_id: Column, text: Column) -> Column:
    """The leading bits of a digest of id and text, as a number."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def prefix(value: Column, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", value, (F.lit(HASH_BITS) - depth).cast("int"))


def split_buckets(rows: DataFrame, limit: int) -> DataFrame:
    """The directory: ``prefix, depth`` of every shard, ``fits`` if it is within the limit."""
    rows = rows.groupBy("hash").agg(F.sum("bytes").alias("bytes"))
    found, low, left = [], 0, None
    while True:
        high = min(low + ROUND_BITS, HASH_BITS)
        own = rows if left is None else rows.join(left, prefix(F.col("hash"), low) == F.col("over"), "left_semi")
        fine = keep(own.groupBy(prefix(F.col("hash"), high).alias("prefix")).agg(F.sum("bytes").alias("bytes")), "fine")
        # one row for every prefix of every length of this round, from the sums
        deep = fine.select(
            F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), F.col("prefix").alias("deepest"), "bytes"
        )
        shift = (F.lit(high) - F.col("depth")).cast("int")
        sums = deep.groupBy("depth", F.call_function("shiftright", "deepest", shift).alias("prefix")).agg(F.sum("bytes").alias("bytes"))
        buckets = keep(sums, "buckets")
        over = buckets.where(F.col("bytes") > limit)
        # a bucket is split if it and so all shorter prefixes are over the limit
        up = over.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        child = buckets.withColumn("parent", F.call_function("shiftright", "prefix", F.lit(1)))
        below = child.where((F.col("bytes") <= limit) & (F.col("depth") > low)).join(up, ["depth", "parent"], "left_semi")
        top = buckets.where((F.col("bytes") <= limit) & (F.col("depth") == low)) if low == 0 else None
        leaves = below.select("prefix", "depth", F.lit(True).alias("fits"))
        if top is not None:
            leaves = leaves.unionByName(top.select("prefix", "depth", F.lit(True).alias("fits")))
        still = over.where(F.col("depth") == high)
        more = not still.isEmpty()
        if more and high == HASH_BITS:
            leaves = leaves.unionByName(still.select("prefix", "depth", F.lit(False).alias("fits")))
        found.append(keep(leaves, "leaves"))
        drop(fine)
        if not more or high == HASH_BITS:
            break
        left = keep(still.select(F.col("prefix").alias("over")), "over")
        low = high
    leaves = found[0]
    for part in found[1:]:
        leaves = leaves.unionByName(part)
    return leaves


def assigned(documents: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """``doc_id, size_bytes, shard_depth, shard_prefix, page, shard_bytes`` of every row.

    ``shard_prefix`` are the ``shard_depth`` leading bits of the hash, as a number.
    """
    narrow = documents.select(
        "doc_id",
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("bytes"),
        row_hash(F.col("doc_id"), F.col("text")).alias("hash"),
    )
    rows = keep(narrow.groupBy("doc_id", "bytes", "hash").agg(F.count(F.lit(1)).alias("copies")), "rows")
    total = rows.select("hash", (F.col("bytes") * F.col("copies")).alias("bytes"))
    leaves = keep(split_buckets(total, limit), "directory")
    depths = [r["depth"] for r in leaves.select("depth").distinct().orderBy("depth").collect()]
    if not depths:
        depths = [0]
    # a row meets its shard among the few lengths that the directory has
    lengths = F.array(*(F.lit(d) for d in depths))
    joined = (
        rows.withColumn("depth", F.explode(lengths))
        .withColumn("prefix", prefix(F.col("hash"), F.col("depth")))
        .join(leaves, ["depth", "prefix"])
    )
    # exact repeats are numbered from their count, in chunks, to fill the overflow pages
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / REPEATS))
    spread = joined.withColumn("chunk", F.explode(chunks)).withColumn(
        "copy",
        F.explode(F.sequence(F.col("chunk") * REPEATS, F.least(F.col("copies"), (F.col("chunk") + 1) * REPEATS) - 1)),
    )
    to_a_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1))))
    page = F.when(F.col("fits"), F.lit(0)).otherwise(F.floor(F.col("copy") / to_a_page)).cast("bigint")
    rows_out = keep(
        spread.select("doc_id", F.col("bytes").alias("size_bytes"), F.col("depth").alias("shard_depth"), F.col("prefix").alias("shard_prefix"), page.alias("page")),
        "assigned",
    )
    shard = ["shard_depth", "shard_prefix", "page"]
    held = keep(rows_out.groupBy(*shard).agg(F.sum("size_bytes").alias("shard_bytes")), "shards")
    return rows_out.join(held, shard).select("doc_id", "size_bytes", *shard, "shard_bytes")
