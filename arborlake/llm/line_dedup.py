"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line is the set of its lower-case words. A line is removed if an earlier line, by id and
then by place, is similar: ``100 * |A & B| >= percent * |A | B|``. Lines are judged on the
input, not on what is left.

Lines with equal sets form a class, which joins once; copies combine before the shuffle. The
words of a class are ordered by rarity. Similar sets of sizes ``m <= n`` share a word within
the first ``n - ceil(n * p) + 1`` words of the larger and the first ``m - ceil(m * 2p / (1 +
p)) + 1`` words of the smaller one (``p`` is the least similarity), so only these prefixes
are joined, under the length filter (``100 * m >= percent * n``), the positional filter
(what may still follow a shared word bounds the overlap; it holds the smaller set to its
prefix, whose words alone are joined with those of its kind and with the later ones of larger
sets) and a parity bitmap of 64 bits (every bit that differs stands for a word that only
one set has). Large sets fill the bitmap, so their prefixes are some words longer and must
share as many words more. Pairs that pass are decided on their whole sets. The join meets on
32 bits of a word and a band of sizes, which adds pairs to be decided and loses none.

Groups of near copies. Each class is first compared with the earliest class that has its least
or its greatest code, which most near copies share, where many classes have that code. A class that is similar to an earlier one
is decided; the prefixes then bring together only pairs with a class that is still open, so
a large group of near copies does not form its pairs, and no line that has an earlier match
is missed.

Rarity only has to be one order for all lines. It is taken from a table of fixed size: the
words of all lines are counted by a hash of ``SKETCH_BITS`` bits, and the logarithm of
the count orders the words, ties by their hash. The table does not grow with the data.
Words are 64-bit codes, so sets are compared exactly but for a chance of about 2 ** -56 per
pair of words.

Texts are split into words once. The sorted codes of all lines are written; words are counted,
classes formed and sets compared from there. Sides of joins
with few rows, as counted, are broadcast, and with more both sides are shuffled.

Defined results: every row has one result row; NULL and empty texts have no lines; lines
without words are never removed and match nothing; rows that repeat an id are told apart by
their texts, equal lines of theirs at the same place stay, and a row repeated whole is judged
as one; rows without an id come last, and their lines are removed if similar to one of a row
with an id. Ids must be numbers. Very long texts have more lines, each judged alone; a text's
removed places are gathered in one row. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm.store import drop, keep

PERCENT = 80
SKETCH_BITS = 17
#: Greatest rank, of seven bits.
_TOP = 127
_BLANKS = ("\t", "\v", "\f", "\r")
_CODE_BITS = 56
_KEY = (1 << 31) - 1
#: Where ids are NULL: after all others.
_LAST = (1 << 63) - 1
#: Rows of a side that is broadcast, as counted; with more of them both sides of the join are shuffled.
BROADCAST_PLACES = 500_000
#: One more shared word is asked for with each so many words of a set beyond the first 32.
SPARE_OF = 64
#: A code leads the classes that have it if there are more of them.
LED_FROM = 64
#: How codes are written: compression finds most words that come again, for less time than a dictionary takes,
#: and nothing looks for codes by their least and greatest.
CODES_FILE = {
    "parquet.enable.dictionary": "false",
    "parquet.column.statistics.enabled": "false",
    "parquet.size.statistics.enabled": "false",
    "compression": "zstd",
}


def split_words(text: Column) -> Column:
    """Lower-case words, repeated as they are, and empty ones between blanks."""
    low = F.lower(text)
    blank = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), _BLANKS, low)
    # a search is cheaper than a replacement, and most lines have no other blanks
    other = reduce(Column.__or__, (F.contains(text, F.lit(c)) for c in _BLANKS))
    return F.split(F.when(other, blank).otherwise(low), " ")


def line_words(line: Column) -> Column:
    """Sorted codes of the distinct words of a line."""
    codes = F.transform(split_words(line), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_except(codes, F.array(F.xxhash64(F.lit("")))))


def texts_of(documents: DataFrame) -> DataFrame:
    """``doc_id, source, text``; ``source`` tells the texts of an id apart."""
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("source"), text.alias("text"))


def split_lines(documents: DataFrame) -> DataFrame:
    """``doc_id, source, place, line`` of every line with a word."""
    split = texts_of(documents).select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return split.where(F.ltrim("line", F.lit(" " + "".join(_BLANKS))) != "")


def coded_lines(documents: DataFrame) -> DataFrame:
    """``doc_id, source, place, class, words`` of every line with words: its sorted codes and their code."""
    coded = split_lines(documents).select("doc_id", "source", "place", line_words(F.col("line")).alias("words"))
    return coded.select("doc_id", "source", "place", F.xxhash64("words").alias("class"), "words")


def keyed_lines(coded: DataFrame, ranks: Column, percent: int) -> DataFrame:
    """``doc_id, place, class, n, bits, low, high, prefix`` of coded lines: number of words, bitmap, keys of
    the least and the greatest code, which are equal in most pairs of near copies, and of the rarest words."""
    n = F.size("ordered")
    rarest = F.slice("ordered", F.lit(1), prefix_length(n, percent))
    # sorted and cut in steps of their own, as below a lambda function Spark would handle boxed numbers; a column named twice stays one
    return (
        coded.select("doc_id", "place", "class", "words", ranks.alias("ranks"))
        # a column of its own, as a subquery may not be written below a lambda function; Spark puts it in its place
        .select("doc_id", "place", "class", "words", ordered(F.col("words"), F.col("ranks")).alias("ordered"))
        .select(
            "doc_id",
            "place",
            "class",
            n.alias("n"),
            parity(F.col("words")).alias("bits"),
            key(F.get("words", F.lit(0))).alias("low"),
            key(F.element_at("words", -1)).alias("high"),
            rarest.alias("rarest"),
        )
        .select("doc_id", "place", "class", "n", "bits", "low", "high", F.when(F.size("rarest") > 0, F.transform("rarest", key)).alias("prefix"))
    )


def key(word: Column) -> Column:
    """The part of a code on which words meet."""
    return word.bitwiseAND(F.lit(_KEY)).cast("int")


def few(table: DataFrame) -> DataFrame:
    """A side of a join, broadcast where it has few rows, as counted; it must be cheap to read again."""
    return table.hint("broadcast" if table.count() <= BROADCAST_PLACES else "merge")


def placed() -> Column:
    """Id and place of a line; orders lines."""
    return F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), F.col("place"))


def rarity(coded: DataFrame) -> Column:
    """Ranks of word codes by their last ``SKETCH_BITS`` bits, at the top of a 64-bit number: 0 is rarest."""
    size = 1 << SKETCH_BITS
    entry = F.col("word").bitwiseAND(F.lit(size - 1)).cast("int")
    counted = coded.select(F.explode("words").alias("word")).groupBy(entry.alias("entry")).agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.select("entry", F.shiftleft(F.least(F.lit(_TOP), F.floor(F.log2("n") * 4)), _CODE_BITS).alias("rank"))
    unused = coded.sparkSession.range(size).select(F.col("id").cast("int").alias("entry"), F.lit(0).cast("bigint").alias("rank"))
    # at most ``size`` numbers, in rows of 1024
    every = ranked.unionByName(unused).groupBy("entry").agg(F.max("rank").alias("rank"))
    block = F.sort_array(F.collect_list(F.struct("entry", "rank"))).alias("held")
    rows = every.groupBy(F.shiftright("entry", 10).alias("block")).agg(block).select("block", F.col("held.rank").alias("ranks"))
    whole = F.sort_array(F.collect_list(F.struct("block", "ranks")))
    # a subquery of one row: as a literal the table would be part of every text of the plan that the driver holds
    return keep(rows.agg(F.flatten(whole["ranks"]).alias("ranks")), "line_ranks").scalar()


def ordered(words: Column, ranks: Column) -> Column:
    """Word codes that sort by rarity."""
    low = (1 << _CODE_BITS) - 1
    ranked = lambda w: ranks[w.bitwiseAND(F.lit((1 << SKETCH_BITS) - 1))].bitwiseOR(w.bitwiseAND(F.lit(low)))
    # known not to be NULL, or Spark would sort boxed numbers
    return F.sort_array(F.transform(words, lambda w: F.coalesce(ranked(w), F.lit(0).cast("bigint"))))


def parity(words: Column) -> Column:
    """Parity bitmap: a bit is the number of words that fall on it, modulo two."""
    bits = F.split(F.lit(" ".join(str(1 << k if k < 63 else -(1 << 63)) for k in range(64))), " ").cast("array<bigint>")
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda held, w: held.bitwiseXOR(bits[w.bitwiseAND(F.lit(63))]))


def spare(n: Column) -> Column:
    """Shared words of the prefixes that are asked for beyond the first one; bitmaps tell little of large sets."""
    return F.greatest(F.lit(0), F.floor((n - 32) / SPARE_OF).cast("int"))


def prefix_length(n: Column, percent: int) -> Column:
    """Leading words of a set among which ``1 + spare(n)`` are shared with any similar set of at most its size."""
    return n - F.floor((n * percent + 99) / 100).cast("int") + 1 + spare(n)


def classes_of(lines: DataFrame) -> DataFrame:
    """``class, at, rows, n, bits, low, high, prefix``: earliest place, lines, and words of each class."""
    same = ("n", "bits", "low", "high", "prefix")
    first = F.min(F.struct(placed().alias("at"), *same)).alias("first")
    grouped = lines.groupBy("class").agg(first, F.count(F.lit(1)).alias("rows"))
    return grouped.select("class", "first.at", "rows", *(F.col(f"first.{c}").alias(c) for c in same))


def _bounded(percent: int, n_a: Column | str = "n_a", n_b: Column | str = "n_b") -> Column:
    """Whether sizes and bitmaps allow the sets of ``a`` and ``b`` to be similar."""
    n_a, n_b = (F.col(n) if isinstance(n, str) else n for n in (n_a, n_b))
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (
        F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) * (100 + percent) <= (n_a + n_b) * (100 - percent)
    )


def led_classes(classes: DataFrame, percent: int) -> DataFrame:
    """``a, b, other``: pairs that the filters let pass of a class ``a`` with the earliest class ``b``
    that has its least or its greatest code, and the place of ``b``; as many as classes at most, and
    twice. Codes of at most ``LED_FROM`` classes are left out: these form few pairs anyway."""
    coded = classes.select("class", "at", "n", "bits", F.explode(F.array("low", "high")).alias("code"))
    first = coded.groupBy("code").agg(F.min(F.struct("at", "class", "n", "bits")).alias("first"), F.count(F.lit(1)).alias("rows"))
    first = first.where(F.col("rows") > LED_FROM).select("code", *(F.col(f"first.{c}").alias(f"{c}_b") for c in ("class", "at", "n", "bits")))
    member = coded.select("code", *(F.col(c).alias(f"{c}_a") for c in ("class", "at", "n", "bits")))
    met = member.join(few(keep(first, "line_leads")), "code")
    met = met.where((F.col("at_b") < F.col("at_a")) & (F.col("class_a") != F.col("class_b")) & _bounded(percent))
    return met.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"), F.col("at_b").alias("other")).distinct()


def band(n: Column, percent: int) -> Column:
    """Bands of sizes, so wide that similar sets are in one band or in two next to each other."""
    return F.floor(F.log(n) / F.log(F.lit(200 / percent))).cast("int")


def near_classes(classes: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of classes that the filters let pass, ``a`` the smaller, and of which
    one at least is ``open``.

    Sets meet on a word and a band of sizes. A set whose similar sets may be in the next band is
    a guest there, with its leading words: those that the smaller one of two sets may share first."""
    n = F.col("n")
    own = band(n, percent)
    near_end = band(F.floor(n * 100 / percent), percent) > own
    banded = classes.select("class", "n", "bits", "open", "prefix", own.alias("band"), near_end.alias("near_end"))
    worded = banded.select("class", "n", "bits", "open", "band", "near_end", F.posexplode("prefix").alias("place", "word"))
    rest = n - F.col("place")
    lead = (rest + spare(n)) * (100 + percent) >= 2 * percent * n
    guest = F.col("near_end") & lead
    bands = F.when(guest, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    worded = worded.withColumn("guest", F.explode(bands))
    # one number for size, what follows with the word, guest and open
    whole = lambda c: F.col(c).cast("bigint")
    packed = F.shiftleft(whole("n"), 34) + F.shiftleft(rest.cast("bigint"), 2) + F.shiftleft(whole("guest"), 1) + whole("open")
    # only leading words are those of a smaller set, so later words meet these and not each other; either kind is shuffled once
    kind = lambda leading: worded.where(lead if leading else ~lead).select(
        F.hash("word", F.col("band") + F.col("guest")).alias("met"), "class", "bits", packed.alias("size")
    )
    side = lambda rows, of: rows.select("met", *(F.col(c).alias(f"{c}_{of}") for c in rows.columns[1:]))
    leads = side(kind(True), "a")
    sides = leads.join(side(kind(True), "b"), "met").unionByName(leads.join(side(kind(False), "b"), "met"))
    size = lambda of: F.shiftright(f"size_{of}", 34).cast("int")
    after = lambda of: F.shiftright(F.col(f"size_{of}").bitwiseAND(F.lit((1 << 34) - 1)), 2).cast("int")
    asked = spare(size("a"))
    n_a, n_b = size("a"), size("b")
    met = sides.where(
        ((n_a < n_b) | ((n_a == n_b) & (F.col("class_a") < F.col("class_b"))))
        & (F.col("size_a").bitwiseOR(F.col("size_b")).bitwiseAND(F.lit(1)) == 1)
        & (F.col("size_a").bitwiseAND(F.col("size_b")).bitwiseAND(F.lit(2)) == 0)
        & _bounded(percent, n_a, n_b)
        # the k-th shared word is followed by all but k - 1 of the others
        & ((F.least(after("a"), after("b")) + asked) * (100 + percent) >= (n_a + n_b) * percent)
    )
    shared = met.groupBy(F.col("class_a").alias("a"), F.col("class_b").alias("b"), asked.alias("asked")).agg(F.count(F.lit(1)).alias("shared"))
    return shared.where(F.col("shared") > F.col("asked")).select("a", "b")


def sets_of(coded: DataFrame, firsts: DataFrame) -> DataFrame:
    """``class, words`` of the classes whose places ``first_id, first_place`` are given, from coded lines."""
    firsts = few(firsts).withColumnRenamed("class", "of")
    at = placed()
    # rows that repeat an id have several lines at a place; that of the class has its code,
    # compared such that the code is no key of the join
    met = (at["doc_id"] == F.col("first_id")) & (F.col("place") == F.col("first_place")) & (F.col("class").bitwiseXOR(F.col("of")) == 0)
    return coded.join(firsts, met).select("class", "words")


def sets_at(documents: DataFrame, firsts: DataFrame) -> DataFrame:
    """The same from documents."""
    return sets_of(coded_lines(documents), firsts)


def similar_classes(coded: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose whole sets are similar."""
    pairs = keep(pairs, "line_pairs")
    ends = keep(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "line_ends")
    firsts = classes.join(few(ends), "class", "left_semi").select("class", F.col("at.doc_id").alias("first_id"), F.col("at.place").alias("first_place"))
    firsts = keep(firsts, "line_firsts")
    # shuffled by class once, for both joins
    sets = sets_of(coded, firsts).dropDuplicates(["class"])
    of = lambda s: sets.select(F.col("class").alias(s), F.col("words").alias(f"words_{s}"))
    full = pairs.join(of("b"), "b").join(of("a"), "a")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    # shared words are named once, as a filter would find them each time
    similar = (100 + percent) * shared >= percent * (F.size("words_a") + F.size("words_b"))
    links = keep(full.where(similar).select(*pairs.columns), "line_links")
    drop(firsts)
    drop(ends)
    drop(pairs)
    return links


def earliest_matches(coded: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``class, least``: a line that is similar to a class or in it, earlier than the class if
    any such line is; classes without another line are left out."""
    # classes that are similar to an earlier one are decided, whatever else they resemble
    led = similar_classes(coded, classes, led_classes(classes, percent), percent)
    led = keep(led.groupBy(F.col("a").alias("class")).agg(F.min("other").alias("other")), "line_led")
    decided = few(led).select("class", F.lit(False).alias("led"))
    marked = classes.join(decided, "class", "left").withColumn("open", F.col("led").isNull())
    links = similar_classes(coded, classes, near_classes(marked, percent), percent)
    place = classes.select(F.col("class").alias("b"), F.col("at").alias("at_b"))
    both = links.unionByName(links.select(F.col("a").alias("b"), F.col("b").alias("a")))
    met = place.join(few(both), "b").select(F.col("a").alias("class"), F.col("at_b").alias("other")).unionByName(led)
    others = keep(met.groupBy("class").agg(F.min("other").alias("other")), "line_others")
    least = classes.select("class", "at", "rows").join(few(others), "class", "left").where((F.col("rows") > 1) | F.col("other").isNotNull())
    return keep(least.select("class", F.least("at", F.coalesce("other", "at")).alias("least")), "line_least")


def judged_texts(documents: DataFrame, percent: int) -> DataFrame:
    """``doc_id, source, n_lines, n_removed, removed`` of every text of an id with lines of words."""
    coded = keep(coded_lines(documents), "lines", **CODES_FILE)
    classes = keep(classes_of(keyed_lines(coded, rarity(coded), percent)), "line_classes", **CODES_FILE)
    least = earliest_matches(coded, classes, percent)
    drop(classes)
    lines = coded.select("doc_id", "source", "place", "class")
    gone = F.coalesce(placed() > F.col("least"), F.lit(False))
    judged = lines.join(few(least), "class", "left").select("doc_id", "source", "place", gone.alias("gone"))
    # copies of a row give each of their lines as often; a place counts once. Lines of a text stand together,
    # so that their places are gathered before they are shuffled
    removed = F.sort_array(F.collect_set(F.when(F.col("gone"), F.col("place"))))
    texts = judged.groupBy("doc_id", "source").agg(F.collect_set("place").alias("all"), removed.alias("removed"))
    size = lambda c: F.size(c).cast("bigint")
    return texts.select("doc_id", "source", size("all").alias("n_lines"), size("removed").alias("n_removed"), "removed")


def removed_lines(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed`` (places) of every row, one for each row."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("source"))
    judged = judged_texts(documents, percent).select(F.col("doc_id").alias("id"), F.col("source").alias("of"), "n_lines", "n_removed", "removed")
    met = rows.join(judged, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("source") == F.col("of")), "left")
    zero = F.lit(0).cast("bigint")
    return met.select(
        "doc_id",
        F.coalesce("n_lines", zero).alias("n_lines"),
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def deduplicated(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text`` of every row without its removed lines; lines without words stay."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    judged = judged_texts(documents, percent).where(F.col("n_removed") > 0)
    judged = judged.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), "removed")
    met = rows.join(judged, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("of")), "left")
    left = F.filter(F.split("text", "\n"), lambda line, place: ~F.array_contains("removed", place))
    return met.select("doc_id", F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"))
