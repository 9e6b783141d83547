"""N-gram Jaccard join over size-banded tiles with bitmap signatures.

A document is the set of its word shingles (64-bit codes, so two sets are equal or
intersect as their texts do but for a chance of about 2 ** -64 per pair of shingles).
Documents with equal sets form a class and are joined once. Two classes link when
``100 * |A & B| >= percent * |A | B|``.

Tiles. Sizes fall into bands that grow by ``BAND_GROWTH``. A tile joins a band with the
sizes above it that may still link; a document belongs to the tile of its own band and, if
its size is close enough, to the one below. Within a tile two linked sets differ in at
most ``H`` shingles, which follows from the largest size of the band. The shingles are
dealt into ``H + 1 + S`` parts by their code, so at least ``1 + S`` parts of linked sets are
equal. A part's digest is a key; documents of a tile meet only where they share a key. Parts
of few shingles say little: a passage that many documents share makes the same part of one
shingle in all of them. So each set leaves out the ``S`` parts that come first by number of
shingles and digest, an order that depends on the parts alone. Of the equal parts of two linked
sets the last one in that order has ``S`` others before it in both, so both list it.

Verification. Pairs that meet are first bounded by sizes and by parity bitmaps: every bit
in which two bitmaps differ stands for a shingle that only one set has, so the bit count of
their difference bounds the overlap from above. A bitmap has at least as many bits as its
set has shingles, so it does not fill up in the bands of long texts; a wider one is folded
to the width of the other. Only for pairs that remain are the texts read again, and those
pairs are decided on the exact arrays of shingles.

Hot keys. Documents of a group of copies share most of their keys. A batch lists a key
once, for its least class, and links its other classes to that one; the same is done for
the batches of a key range. So each member is compared with the leader of its key, not
with each other member, and verified links grow with the members. A link names its key, so
the links are also the list of all keys that several classes share; a key of one class, as
nearly all are, is seen once and never again. Then keys whose classes are still in different
components are looked at again, in blocks of at most ``TILE_ROWS`` rows of a key, and only
pairs of different components are compared: first the pairs that would connect a block's
classes if they link, then whatever these have left apart. So no link between different
texts is lost and pairs within a found group are not formed.

Defined results: texts without words have an empty set, link with nothing and are their own
component; a text with fewer words than a shingle is one shingle; repeated rows are in the
same class; rows without an id take part, and their component is the least id in reach,
NULL if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from arborlake.llm import words as W
from arborlake.llm.components import components
from arborlake.llm.store import BROADCAST_ROWS, dealt, drop, few, fresh_name, in_tasks, keep

BAND_GROWTH = 1.4
#: Parts that a set leaves out, as a share of the parts that may differ.
SPARE = 0.2
#: Bits of the narrowest bitmap, and of the widest in the tiles of open keys.
BITS = 1024
SHORT_BITS = 4096
#: Rows of one key that are compared with each other in one block.
TILE_ROWS = 2048
#: Ids that are broadcast to the scan of the texts; with more of them the texts are shuffled.
BROADCAST_IDS = 500_000
#: Keys that a batch gathers before it hands them on; bounds the memory of a task.
BATCH_KEYS = 1 << 20

_SALT = np.uint64(0xA24BAED4963EE407)
_PART = np.uint64(0x9FB21C651E98DF25)
_BITMAP = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Similarity:
    """Size of a shingle in words and least Jaccard similarity in percent."""

    size: int = 5
    percent: int = 80

    def differing(self, smaller: int) -> int:
        """Most shingles in which a set of this size and a larger linked one differ."""
        larger = smaller * 100 // self.percent
        return (smaller + larger) * (100 - self.percent) // (100 + self.percent)


def band_starts(largest: int) -> np.ndarray:
    starts = [1]
    while starts[-1] <= largest:
        starts.append(int(starts[-1] * BAND_GROWTH) + 1)
    return np.array(starts, np.int64)


def reaching(starts: np.ndarray, size: int) -> np.ndarray:
    """The same bands, continued as far as a set of this size needs."""
    return starts if size < starts[-1] else band_starts(2 * size)


def tile_keys(codes: np.ndarray, tile: int, differing: int) -> np.ndarray:
    """Keys of a set in a tile whose linked sets differ in at most so many shingles."""
    spare = int(differing * SPARE) + 2
    width = differing + 1 + spare
    parts = (W.mix(codes ^ _SALT) % np.uint64(width)).astype(np.int64)
    digests = np.zeros(width, np.uint64)
    np.add.at(digests, parts, W.mix(codes + _PART))
    at = np.lexsort((digests, np.bincount(parts, minlength=width)))[spare:]
    place = (np.uint64(tile) << np.uint64(32)) + at.astype(np.uint64)
    return W.mix(digests[at] + W.mix(place + _SALT))


def keys_of(codes: np.ndarray, starts: np.ndarray, rule: Similarity) -> np.ndarray:
    """All keys of a set; none where only an equal set could link."""
    size = len(codes)
    if not size:
        return np.empty(0, np.uint64)
    band = int(np.searchsorted(starts, size, side="right")) - 1
    keys = []
    for tile in (band, band - 1):
        if tile < 0:
            continue
        largest = int(starts[tile + 1]) - 1
        if tile < band and size * rule.percent > largest * 100:
            continue
        differing = rule.differing(largest)
        if differing:
            keys.append(tile_keys(codes, tile, differing))
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def bitmap(codes: np.ndarray) -> bytes:
    """Parity bitmap: a bit is the number of shingles that fall on it, modulo two."""
    width = max(BITS, 1 << max(len(codes) - 1, 0).bit_length())
    at = (W.mix(codes ^ _BITMAP) % np.uint64(width)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=width).astype(np.uint8) & 1).tobytes()


def folded(bits: bytes, width: int) -> bytes:
    """The parity bitmap of the same set in ``width`` bytes."""
    if len(bits) == width:
        return bits
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, width), axis=0).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits that differ, at the width of the narrower bitmap."""
    width = min(len(a), len(b))
    return (int.from_bytes(folded(a, width)) ^ int.from_bytes(folded(b, width))).bit_count()


def set_of(text: bytes | None, size: int, codes: W.WordCodes) -> np.ndarray:
    return W.shingles(codes.of((text or b"").lower().split()), size)


#: Rows of texts have the first columns, rows of key lists the last; see :func:`signatures`.
SIGNED = "n bigint, class bigint, bits binary, short binary, place bigint, leaders array<bigint>, classes array<bigint>, keys array<bigint>"


def signatures(documents: DataFrame, rule: Similarity, ranges: int) -> DataFrame:
    """Signatures of the texts and lists of their keys, from one pass.

    A row of a text is ``doc_id, n, class, bits, short``; the class is a digest of the set,
    ``short`` the bitmap in at most ``SHORT_BITS``. A row with a ``place`` is a list: for a range of
    keys the least class of each key in a batch, or, at the place -1, the keys that classes
    of the batch share with their leaders.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = W.WordCodes()
        starts = band_starts(1 << 20)
        owners, lists, held = [], [], 0
        for batch in batches:
            sizes, classes, bits = [], [], []
            for text in W.as_bytes(batch.column(1)):
                own = set_of(text, rule.size, codes)
                starts = reaching(starts, len(own))
                sizes.append(len(own))
                classes.append(class_of(own))
                bits.append(bitmap(own) if len(own) else None)
                keys = keys_of(own, starts, rule).view(np.int64)
                if len(keys):
                    owners.append(classes[-1])
                    lists.append(keys)
                    held += len(keys)
                if held >= BATCH_KEYS:
                    yield _listed(owners, lists, ranges, batch.schema.field(0).type)
                    owners, lists, held = [], [], 0
            yield _signed(
                batch.column(0),
                n=pa.array(sizes, pa.int64()),
                **{"class": pa.array(classes, pa.int64())},
                bits=pa.array(bits, pa.binary()),
                short=pa.array([x and folded(x, min(len(x), SHORT_BITS // 8)) for x in bits], pa.binary()),
            )
            kind = batch.schema.field(0).type
        if lists:
            yield _listed(owners, lists, ranges, kind)

    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(made, f"doc_id {kind}, {SIGNED}")


def _signed(ids: pa.Array, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of the columns of :func:`signatures`; those not given are NULL."""
    kinds = {"n": pa.int64(), "class": pa.int64(), "bits": pa.binary(), "short": pa.binary(), "place": pa.int64()}
    kinds |= dict.fromkeys(("leaders", "classes", "keys"), pa.list_(pa.int64()))
    parts = [columns.get(name, pa.nulls(len(ids), kind)) for name, kind in kinds.items()]
    return pa.RecordBatch.from_arrays([ids, *parts], names=["doc_id", *kinds])


def _listed(owners: list, lists: list, ranges: int, kind: pa.DataType) -> pa.RecordBatch:
    """The key lists of some classes: shared keys with leader and class, others by range."""
    owner = np.repeat(np.array(owners, np.int64), [len(k) for k in lists])
    keys = np.concatenate(lists)
    order, leaders, first = led(keys, owner)
    keys, owner = keys[order], owner[order]
    apart = leaders != owner
    shared = np.unique(np.stack([leaders[apart], owner[apart], keys[apart]]), axis=1)
    keys, owner = keys[first], owner[first]
    place = (W.mix(keys.view(np.uint64) ^ _SALT) % np.uint64(ranges)).astype(np.int64)
    by = np.lexsort((owner, place))
    keys, owner, place = keys[by], owner[by], place[by]
    cuts = np.flatnonzero(np.diff(place, prepend=-1))
    ids = pa.nulls(len(cuts) + 1, kind)
    return _signed(
        ids,
        place=pa.array([-1, *place[cuts].tolist()], pa.int64()),
        leaders=W.list_array([shared[0], *[shared[0][:0]] * len(cuts)], pa.int64()),
        classes=W.list_array([shared[1], *np.split(owner, cuts[1:])], pa.int64()),
        keys=W.list_array([shared[2], *np.split(keys, cuts[1:])], pa.int64()),
    )


def class_of(codes: np.ndarray) -> np.int64 | None:
    return np.int64(np.uint64(xxh3_64_intdigest(codes.tobytes()))) if len(codes) else None


def class_column(text: Column, rule: Similarity) -> Column:
    """The class of each text."""

    @F.arrow_udf("bigint")
    def classed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codes = W.WordCodes()
        for batch in batches:
            yield pa.array([class_of(set_of(t, rule.size, codes)) for t in W.as_bytes(batch)], pa.int64())

    return classed(text)


def led(keys: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its class, the least class of its key, and whether it is the first."""
    order = np.lexsort((classes, keys))
    keys, classes = keys[order], classes[order]
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
    leaders = classes[np.flatnonzero(first)][np.cumsum(first) - 1] if len(keys) else classes
    return order, leaders, first


def shared_keys(signed: DataFrame) -> DataFrame:
    """``a, b, key``: each class ``b`` with the leader ``a`` of each key that it shares."""

    def joined(table: pa.Table) -> pa.Table:
        classes = table["classes"].combine_chunks().flatten().to_numpy()
        keys = table["keys"].combine_chunks().flatten().to_numpy()
        order, leaders, _ = led(keys, classes)
        keys, classes = keys[order], classes[order]
        apart = leaders != classes
        found = np.unique(np.stack([leaders[apart], classes[apart], keys[apart]]), axis=1)
        return pa.table({"a": pa.array(found[0]), "b": pa.array(found[1]), "key": pa.array(found[2])})

    lists = signed.where("place >= 0").select("place", "classes", "keys")
    across = lists.groupBy("place").applyInArrow(joined, "a bigint, b bigint, key bigint")
    within = signed.where("place < 0").select(F.inline(F.arrays_zip("leaders", "classes", "keys")))
    return within.toDF("a", "b", "key").unionByName(across)


def _bounded(rule: Similarity, n_a: str, n_b: str, differ: str):
    """Whether sizes and the bits that differ allow the pair to link."""
    both = F.col(n_a) + F.col(n_b)
    return (F.col(differ) * (100 + rule.percent) <= both * (100 - rule.percent)) & (
        100 * F.least(n_a, n_b) >= rule.percent * F.greatest(n_a, n_b)
    )


def differing_bits(a: str, b: str) -> Column:
    """Set bits of the exclusive or of two bitmaps."""

    @F.arrow_udf("bigint")
    def counted(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(map(differing, a.to_pylist(), b.to_pylist()), pa.int64())

    return counted(a, b)


def _side(table: DataFrame, side: str, *columns: str) -> DataFrame:
    return table.select(F.col("class").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))


def near_pairs(pairs: DataFrame, about: DataFrame, rule: Similarity) -> DataFrame:
    """The pairs ``a, b`` that sizes and bitmaps allow to link."""
    met = pairs.join(_side(about, "b", "n", "bits"), "b").join(_side(about, "a", "n", "bits"), "a")
    near = met.where(100 * F.least("n_a", "n_b") >= rule.percent * F.greatest("n_a", "n_b"))
    near = near.withColumn("differ", differing_bits("bits_a", "bits_b")).where(_bounded(rule, "n_a", "n_b", "differ"))
    return dealt(near.select("a", "b"), pairs.count())


def shared_shingles(a: str, b: str) -> Column:
    """Size of the intersection of two sorted arrays."""

    @F.arrow_udf("bigint")
    def counted(a: pa.Array, b: pa.Array) -> pa.Array:
        found = []
        for one, two in zip(a, b, strict=True):
            one, two = one.values.to_numpy().view(np.uint64), two.values.to_numpy().view(np.uint64)
            if len(one) > len(two):
                one, two = two, one
            at = np.searchsorted(two, one)
            at[at == len(two)] = 0
            found.append(int((two[at] == one).sum()) if len(two) else 0)
        return pa.array(found, pa.int64())

    return counted(a, b)


def linked(near: DataFrame, documents: DataFrame, members: DataFrame, rule: Similarity) -> DataFrame:
    """The pairs ``a, b`` that link by the exact arrays of their shingles."""
    rows = near.count()
    ends = near.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    ends = keep(in_tasks(ends, 2 * rows), "linked")
    named = keep(members.join(few(ends), "class", "left_semi"), "ends")
    sets = keep(member_sets(documents, named, rule), "sets")
    full = near.join(_side(sets, "b", "codes"), "b").join(_side(sets, "a", "codes"), "a")
    shared = full.select("a", "b", F.size("codes_a").alias("n_a"), F.size("codes_b").alias("n_b"), shared_shingles("codes_a", "codes_b").alias("both"))
    similar = shared.where(100 * F.col("both") >= rule.percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")
    links = keep(dealt(similar, rows), "links")
    drop(sets)
    drop(named)
    return links


def once_each(rows: DataFrame, members: DataFrame) -> DataFrame:
    """One row a class: a class comes once unless its member's row is repeated."""
    return rows if members.where(F.col("repeated")).isEmpty() else rows.dropDuplicates(["class"])


def member_sets(documents: DataFrame, members: DataFrame, rule: Similarity) -> DataFrame:
    """``class, codes`` for the classes listed with the id of one member."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = W.WordCodes()
        for batch in batches:
            owners, sets = [], []
            for own, text in zip(batch.column(0).to_pylist(), W.as_bytes(batch.column(1)), strict=True):
                found = set_of(text, rule.size, codes)
                # rows that repeat an id with another text are not this member
                if np.int64(np.uint64(xxh3_64_intdigest(found.tobytes()))) == own:
                    owners.append(own)
                    sets.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), W.list_array(sets, pa.int64())], names=["class", "codes"])

    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    # the ids grow with the documents: they are broadcast only where they are few, as counted
    few = members.count() <= BROADCAST_IDS
    named = members.select("class", F.col("member").alias("doc_id")).hint("broadcast" if few else "merge")
    met = texts.join(named, texts["doc_id"].eqNullSafe(named["doc_id"])).select("class", "text")
    return once_each(met.mapInArrow(made, "class bigint, codes array<bigint>"), members)


def member_rows(signed: DataFrame, members: DataFrame) -> DataFrame:
    """``class, n, bits, short`` for the listed classes."""
    named = few(members).select(F.col("class").alias("owner"), "member")
    texts = signed.where("place IS NULL").select("doc_id", "class", "n", "bits", "short")
    met = texts.join(named, (F.col("class") == F.col("owner")) & F.col("doc_id").eqNullSafe(F.col("member")))
    return once_each(met.select("class", "n", "bits", "short"), members)


def cross_pairs(shared: DataFrame, about: DataFrame, roots: DataFrame, rule: Similarity, ranges: int, spanning: bool) -> DataFrame:
    """Pairs that share a key and are in different components so far, within the bounds.

    ``shared`` has a row for each class and leader of a key. With ``spanning`` a tile gives a
    pair only where the pairs that it has given before would not connect the two if they link.
    """
    root = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    lead = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    if roots.count() <= BROADCAST_ROWS:
        root, lead = root.hint("broadcast"), lead.hint("broadcast")
    named = shared.join(root, "b").join(lead, "a")
    low, high = F.min(F.least("root_a", "root_b")), F.max(F.greatest("root_a", "root_b"))
    mixed = named.groupBy("key").agg(low.alias("low"), high.alias("high"), F.count(F.lit(1)).alias("rows"))
    # a key has one class more than it has rows, at most
    blocks = F.ceil((F.col("rows") + 1) / TILE_ROWS)
    keys = shared.count()
    open_keys = keep(in_tasks(mixed.where(F.col("low") != F.col("high")).select("key", blocks.alias("blocks")), keys), "open")
    if open_keys.isEmpty():
        return about.sparkSession.createDataFrame([], "a bigint, b bigint")
    held = keep(named.join(few(open_keys), "key"), "held")
    ends = [held.select("key", "blocks", F.col(x).alias("class"), F.col(f"root_{x}").alias("root")) for x in "ab"]
    rows = ends[0].unionByName(ends[1]).distinct()
    # a key's rows are cut into blocks; each pair of blocks is a tile of bounded size
    block = F.pmod(F.xxhash64("class"), F.col("blocks"))
    cut = rows.withColumn("block", block)
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    tile = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    tiles = dealt.select(
        "class", "root", tile.alias("tile"), F.when(F.col("block") == F.col("other"), -1).otherwise(F.col("block")).alias("side")
    )
    tiles = tiles.withColumn("range", F.pmod(F.col("tile"), F.lit(16 * ranges))).join(about.select("class", "n", "short"), "class")

    def compared(table: pa.Table) -> pa.Table:
        tile, side, root, own, n = (table[c].to_numpy() for c in ("tile", "side", "root", "class", "n"))
        short = table["short"].to_pylist()
        order = np.argsort(tile, kind="stable")
        cuts = np.flatnonzero(np.diff(tile[order], prepend=tile[order][0] - 1 if len(tile) else 0))
        found = []
        for rows in np.split(order, cuts[1:]):
            # the sizes of a key's sets are in one tile, so their bitmaps are about as wide
            width = min(len(short[r]) for r in rows)
            bits = np.frombuffer(b"".join(folded(short[r], width) for r in rows), np.uint64).reshape(len(rows), -1)
            part, size, block = root[rows], n[rows], side[rows]
            for k in range(len(rows) - 1):
                # rows of one block meet in the tile of that block alone
                rest = np.flatnonzero((part != part[k]) & ((block != block[k]) | (block[k] < 0)))
                rest = rest[rest > k]
                rest = rest[100 * np.minimum(size[rest], size[k]) >= rule.percent * np.maximum(size[rest], size[k])]
                if not len(rest):
                    continue
                differ = np.bitwise_count(bits[rest] ^ bits[k]).sum(axis=1).astype(np.int64)
                rest = rest[differ * (100 + rule.percent) <= (size[rest] + size[k]) * (100 - rule.percent)]
                if spanning and len(rest):
                    joined, first = np.unique(part[rest], return_index=True)
                    rest = rest[first]
                    part[np.isin(part, joined)] = part[k]
                if len(rest):
                    one, other = own[rows[k]], own[rows[rest]]
                    found.append(np.stack([np.minimum(other, one), np.maximum(other, one)], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    pairs = tiles.groupBy("range").applyInArrow(compared, "a bigint, b bigint").distinct()
    return in_tasks(pairs, keys)


def similar_groups(documents: DataFrame, rule: Similarity = Similarity()) -> DataFrame:
    """``doc_id, n_shingles, class, component_id`` of every row.

    ``class`` is equal for equal sets; ``component_id`` is the least id that is reachable
    by links, the row's own included.
    """
    return rooted_groups(documents, rule).drop("root")


def rooted_groups(documents: DataFrame, rule: Similarity) -> DataFrame:
    """:func:`similar_groups` with ``root``, which tells groups with the same least id apart."""
    ranges = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    signed = keep(signatures(documents, rule, ranges), "signatures")
    rows = keep(signed.where("place IS NULL").select("doc_id", "n", "class"), "rows")
    shared = keep(shared_keys(signed), "shared")
    stars = keep(in_tasks(shared.select("a", "b").distinct(), shared.count()), "stars")
    ends = keep(in_tasks(stars.select(F.explode(F.array("a", "b")).alias("class")).distinct(), 2 * stars.count()), "ends")
    ids = rows.where(F.col("class").isNotNull()).groupBy("class", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    classes = ids.groupBy("class").agg(
        F.min("doc_id").alias("member"), F.sum("rows").alias("rows"), F.max(F.col("rows") > 1).alias("repeated")
    )
    classes = keep(in_tasks(classes, rows.count()), "classes")
    members = keep(classes.join(few(ends), "class", "left_semi"), "members")
    about = keep(member_rows(signed, members), "about")
    drop(signed)
    near = keep(near_pairs(stars, about, rule), "near")
    drop(stars)
    links = linked(near, documents, members, rule)
    roots = keep(components(links), "roots")
    # first pairs that would connect the classes of a key, then what these have not connected
    for spanning in (True, False):
        alone = ends.join(few(roots), F.col("class") == F.col("node"), "left_anti")
        every = keep(roots.unionByName(alone.select(F.col("class").alias("node"), F.col("class").alias("root"))), "nodes")
        met = keep(cross_pairs(shared, about, every, rule, ranges, spanning), "met")
        near = keep(near_pairs(met, about, rule), "near")
        if not near.isEmpty():
            links = links.unionByName(linked(near, documents, members, rule))
            roots = keep(components(links), "roots")
    drop(shared)
    drop(about)
    # the least id of each component, found on classes; only classes of several rows or
    # with links have an id to look up
    rooted = classes.join(few(roots), F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
    several = rooted.where((F.col("rows") > 1) | F.col("node").isNotNull()).select("class", "root", "member")
    least = several.groupBy("root").agg(F.min("member").alias("least"))
    named = keep(several.join(least, "root").select("class", "least", "root"), "least")
    return rows.join(few(named), "class", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "class",
        F.coalesce("least", "doc_id").alias("component_id"),
        F.coalesce("root", "class").alias("root"),
    )


def one_of_each_group(documents: DataFrame, rule: Similarity = Similarity()) -> DataFrame:
    """The row whose id is the least of its group, with all its columns.

    An id may occur with several texts: each is decided by its own group, and of the texts of
    one id in one group one stays. Texts without shingles are known by the text; rows without
    an id cannot be told apart and stay.
    """
    groups = keep(rooted_groups(documents, rule), "groups")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    counted = groups.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    again = keep(counted.where(F.col("rows") > 1).select("doc_id"), "again")
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    if again.isEmpty():
        return documents.join(gone, "doc_id", "left_anti").select(*columns)
    # an id that repeats is decided by the classes of its texts
    gone = gone.unionByName(again).distinct()
    rest = documents.join(gone, "doc_id", "left_anti").select(*columns)
    own = groups.join(again, "doc_id", "left_semi").where((F.col("doc_id") == F.col("component_id")) & F.col("class").isNotNull())
    chosen = own.groupBy("doc_id", "root").agg(F.min("class").alias("class"))
    key, other = fresh_name(documents, stem="class"), fresh_name(documents, stem="text_key")
    text = F.col("text").cast("string")
    keyed = documents.join(again, "doc_id", "left_semi").select(*columns, class_column(text, rule).alias(key))
    known = keyed.join(chosen.select("doc_id", F.col("class").alias(key)), ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    bare = keyed.where(F.col(key).isNull()).withColumn(other, F.sha2(F.coalesce(text, F.lit("")), 256)).dropDuplicates(["doc_id", other])
    return rest.unionByName(known.select(*columns)).unionByName(bare.select(*columns))
