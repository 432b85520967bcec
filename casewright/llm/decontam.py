"""Benchmark passages in documents, by SimHash windows and exact shingle similarity.

Every benchmark item has windows of a length that follows its own: the largest power of two
of which a whole tile lies in every occurrence that is similar enough. Documents are cut into
tiles of those lengths. Windows and tiles have 64-bit SimHash fingerprints; four 16-bit blocks
of them are looked up, which finds every pair within three bits, since three changed bits leave
one block alone. Around a hit, every item-sized stretch that covers the tile is compared with the
item by the multiset of its 5-word shingles, so blocks of the item may stand in any order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import narrowed, stored, text_or_empty

SHINGLE, PERCENT = 5, 80
BLOCKS, BLOCK_BITS = 4, 16
#: Fingerprints differ in so many bits at most: one less than there are blocks.
RADIUS = BLOCKS - 1
#: Largest window. Longer windows would find nothing that two of these do not.
WIDEST = 64
#: Index rows up to which the index is sent to every task (24 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 400_000


def word_hashes(text: str) -> Column:
    """64-bit hashes of the words of a text: runs of letters and digits in lower case."""
    words = F.split(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _bad(shingles: int) -> int:
    """Shingles of a stretch that similarity 0.8 lets be none of the item's: one in nine."""
    return shingles * (100 - PERCENT) // (100 + PERCENT)


def clean_run(length: int, breaks: int | None = None) -> int:
    """Words in a row that every occurrence of an item of ``length`` words has in common with it.

    Of its shingles at least eight in ten stand in the stretch, in ``breaks + 1`` runs at most: a change or
    the seam of two moved blocks costs at least four shingles where the item repeats no word.
    """
    shingles = max(length - SHINGLE + 1, 1)
    parts = (_bad(shingles) // (SHINGLE - 1) if breaks is None else breaks) + 1
    return -(--(-shingles * PERCENT // 100) // parts) + min(length, SHINGLE) - 1


def window(length: int, breaks: int | None = None) -> int:
    """The largest power of two ``w`` for which any run of ``clean_run`` words holds a whole tile."""
    w = 1
    while 2 * w <= WIDEST and 4 * w - 1 <= clean_run(length, breaks):
        w *= 2
    return w


def tiles(length: int, breaks: int | None, width: int) -> int:
    """Whole tiles of ``width`` words that every occurrence of an item has in common with it, within the item's length.

    Its good shingles cover words in one to ``breaks + 1`` runs; of a run of L words at least (L - 2 * width + 2) / width whole
    tiles are inside.
    """
    shingles, own = max(length - SHINGLE + 1, 1), min(length, SHINGLE) - 1
    most = (_bad(shingles) // (SHINGLE - 1) if breaks is None else breaks) + 1
    good = -(-shingles * PERCENT // 100)
    return max(1, min(-(-(good + parts * own - parts * (2 * width - 2)) // width) for parts in (1, most)))


def _kind(items: DataFrame) -> DataFrame:
    """Add ``width`` and ``needed``: ``window`` and ``tiles`` of every item, as expressions."""
    own, most = F.least("length", F.lit(SHINGLE)) - 1, F.col("breaks") + 1
    good = F.ceil(F.size("shingles") * PERCENT / 100)
    run = F.ceil(good / most) + own
    width = F.lit(1)
    for w in (2**k for k in range(1, WIDEST.bit_length())):
        width = F.when(run >= 2 * w - 1, w).otherwise(width)
    items = items.withColumn("width", width.cast("int"))
    least = [F.ceil((good + parts * own - parts * (2 * F.col("width") - 2)) / F.col("width")) for parts in (F.lit(1), most)]
    return items.withColumn("needed", F.greatest(F.lit(1), F.least(*least)).cast("int"))


def _crowded(at: Column) -> Column:
    """Of sorted tile places those that lie with ``needed`` or more within the item's length."""
    def fits(k: Column) -> Column:
        last = F.get(at, k + F.col("needed") - 1)
        return F.coalesce(last + F.col("width") - F.get(at, k) <= F.col("length"), F.lit(False))

    def begins(i: Column) -> Column:
        return F.sequence(F.greatest(i - F.col("needed") + 1, F.lit(0)), i)

    return F.filter(at, lambda p, i: F.exists(begins(i), fits))


def _repeated(runs: Column) -> Column:
    """How many of sorted values are not alone."""
    return F.size(F.filter(runs, lambda v, i: F.coalesce(v == F.get(runs, i - 1), F.lit(False)) | F.coalesce(v == F.get(runs, i + 1), F.lit(False))))


def _breaks(shingles: Column, repeated: list[Column]) -> Column:
    """How many seams an occurrence of an item can have.

    Where the item repeats a run of ``r`` words a seam costs ``4 - r`` shingles that are not the item's, and
    no more seams cost so little than there are places of such runs: ``repeated`` is their number for r = 4, 3, 2, 1.
    The cheapest are taken first.
    """
    left = F.floor(F.size(shingles) * (100 - PERCENT) / (100 + PERCENT)).cast("int")
    total, before = F.lit(0), F.lit(0)
    for cost, places in enumerate(repeated):
        taken = F.least(places - before, F.floor(left / cost).cast("int")) if cost else places
        total, left, before = total + taken, left - taken * cost, places
    return F.least(total + F.floor(left / (SHINGLE - 1)).cast("int"), F.size(shingles))


def simhash(hashes: Column, width: int) -> Column:
    """Bitwise majority of ``width`` hashes (ties give 0), counted for all 64 bits at once.

    The counts stand upright: long ``k`` holds bit ``k`` of all 64 counts.
    """
    levels = range(width.bit_length())

    def add(state: Column, value: Column) -> Column:
        out, carry = [], value
        for k in levels:
            count = state[f"c{k}"]
            out.append(count.bitwiseXOR(carry).alias(f"c{k}"))
            carry = count.bitwiseAND(carry)
        return F.struct(*out)

    def majority(state: Column) -> Column:
        above, equal = F.lit(0).cast("long"), F.lit(-1).cast("long")
        for k in reversed(levels):
            count = state[f"c{k}"]
            if width // 2 >> k & 1:
                equal = equal.bitwiseAND(count)
            else:
                above = above.bitwiseOR(equal.bitwiseAND(count))
                equal = equal.bitwiseAND(F.bitwise_not(count))
        return above

    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in levels])
    return F.aggregate(hashes, zero, add, majority)


def _prints(hashes: Column, width: int, step: int) -> Column:
    """(width, place, print) of every window of ``width`` words that begins ``step`` after the last."""
    count = F.floor((F.size(hashes) - width) / step).cast("int") + 1
    places = F.when(F.size(hashes) >= width, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        places,
        lambda i: F.struct(
            F.lit(width).alias("width"), (i * step).alias("place"), simhash(F.slice(hashes, i * step + 1, width), width).alias("print")
        ),
    )


def _by_block(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Four rows for each: the block's number and value as one integer, beside ``print``."""
    spread = rows.select(*columns, "print", F.explode(F.array(*[F.lit(b) for b in range(BLOCKS)])).alias("_b"))
    value = F.expr(f"shiftrightunsigned(print, {BLOCK_BITS} * _b)").bitwiseAND((1 << BLOCK_BITS) - 1)
    return spread.select(*columns, "print", (value + F.col("_b") * (1 << BLOCK_BITS)).cast("int").alias("block"))


def _runs(hashes: Column, size: Column | int) -> Column:
    """Hashes of all runs of ``size`` words, repeats included."""
    n = F.size(hashes)
    runs = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.slice(hashes, i, size)))
    return F.when(n >= size, runs).otherwise(F.array().cast("array<bigint>"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value made once.

    Spark copies a column's expression to the place that names it, into lambdas too, where it is made for each element.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _stretches(known: DataFrame) -> DataFrame:
    """(doc_id, item_id, n, start, end, shared, own) of the item-sized stretches that begin from ``first`` to ``last``.

    ``part`` holds the words that they cover, ``size`` is the document's length, ``n`` the number of the item's shingles. A shingle
    at a place counts in all stretches that hold it and hold fewer of its kind before it than the item has.
    """
    run, base = F.least("length", F.lit(SHINGLE)), F.greatest("first", F.lit(0))
    numbered = F.transform(_runs(F.col("part"), run), lambda h, i: F.struct(h.alias("h"), (i + base).alias("at")))
    good = F.filter(numbered, lambda g: F.array_contains("shingles", g["h"]))

    def back(good: Column, g: Column) -> Column:
        same = F.filter(good, lambda y: (y["h"] == g["h"]) & (y["at"] < g["at"]))
        most = F.size(F.filter("shingles", lambda s: s == g["h"]))
        return F.coalesce(_let(same, lambda y: F.get(y, F.size(y) - most)["at"]), F.lit(-1))

    def marks(good: Column) -> Column:
        single = F.size(F.array_distinct(F.transform(good, lambda g: g["h"]))) == F.size(good)
        return F.when(single, F.transform(good, lambda g: F.struct(g["at"].alias("at"), F.lit(-1).alias("back")))).otherwise(
            F.transform(good, lambda g: F.struct(g["at"].alias("at"), back(good, g).alias("back")))
        )

    def stretch(marks: Column, start: Column, end: Column) -> Column:
        def counted(bounds: Column) -> Column:
            held = F.filter(marks, lambda m: (m["at"] >= bounds["start"]) & (m["at"] <= bounds["upto"]) & (m["back"] < bounds["start"]))
            own = bounds["upto"] - bounds["start"] + 1
            return F.struct(bounds["start"].alias("start"), (bounds["upto"] + run).alias("end"), F.size(held).alias("shared"), own.alias("own"))

        return _let(F.struct(start.alias("start"), (end - run).alias("upto")), counted)

    def found(marks: Column) -> Column:
        begins = F.sequence("first", "last")
        return F.transform(begins, lambda f: stretch(marks, F.greatest(f, F.lit(0)), F.least(f + F.col("length"), F.col("size"))))

    def compared(good: Column) -> Column:
        return F.when(100 * F.size(good) >= PERCENT * F.size("shingles"), _let(marks(good), found))

    # the list stands in the explode itself: a filter on a column of it would make it once more
    spread = known.select("doc_id", "item_id", F.size("shingles").alias("n"), F.explode(_let(good, compared)).alias("f"))
    return spread.select("doc_id", "item_id", "n", "f.*")


def find(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, similarity) of every document and item that it holds.

    ``start`` and ``end`` (exclusive) are word numbers of the best stretch as long as the item (shorter only
    at an end of the document), the first of equal ones. Two texts match when the weighted Jaccard similarity of their 5-word shingles, a
    shingle's weight being how often it stands, is at least 0.8. Case and punctuation do not
    count. Null or wordless texts hold nothing and wordless items are in nothing; items with
    one text are reported each; rows with one doc_id are reported as one document; a null doc_id
    is a document of its own. Empty tables give an empty result; other columns are not read.
    """
    repeats = [f"_run{r}" for r in range(SHINGLE - 1, 0, -1)]
    items = benchmark.select("item_id", word_hashes("text").alias("words")).filter(F.size("words") > 0).withColumn("length", F.size("words"))
    items = items.withColumn("shingles", _runs(F.col("words"), F.least("length", F.lit(SHINGLE))))
    items = items.withColumns({name: F.sort_array(_runs(F.col("words"), int(name[-1]))) for name in repeats})
    items = items.withColumns({name: _repeated(F.col(name)) for name in repeats})
    items = items.withColumn("breaks", _breaks(F.col("shingles"), [F.col(name) for name in repeats])).drop(*repeats)
    items = stored(_kind(items))
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # powers of two: seven at most
    if not widths:
        empty = "doc_id long, item_id long, start int, end int, similarity double"
        return documents.sparkSession.createDataFrame([], empty)
    index = None
    for width in widths:
        own = items.filter(F.col("width") == width)
        rows = own.select("item_id", "length", "needed", F.explode(_prints(F.col("words"), width, 1)).alias("w"))
        rows = rows.select("item_id", "length", "needed", "w.width", "w.print")
        index = rows if index is None else index.union(rows)
    index = stored(_by_block(index.distinct(), ["item_id", "length", "needed", "width"]))
    index = index.withColumnRenamed("print", "item_print")
    if index.count() <= BROADCAST_ROWS:
        index = F.broadcast(index)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("content", F.xxhash64(text_or_empty()))
    base = texts.select("doc_id", "content", word_hashes("text").alias("words"))
    tiles = reduce(lambda a, b: F.concat(a, b), [_prints(F.col("words"), w, w) for w in widths])
    tiled = base.select("doc_id", "content", F.explode(tiles).alias("t")).select("doc_id", "content", "t.width", "t.place", "t.print")
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS
    probes = _by_block(tiled, ["doc_id", "content", "width", "place"]).withColumnsRenamed({"width": "_width", "block": "_block"})
    hits = probes.join(index, (F.col("_width") == F.col("width")) & (F.col("_block") == F.col("block")) & near)
    hit_tiles = hits.groupBy("doc_id", "content", "item_id", "length", "needed", "width").agg(F.sort_array(F.collect_set("place")).alias("at"))
    # a text is read again only where as many tiles meet within an item's length as every occurrence leaves unchanged
    # stored, or the list would be made anew for each of its places below
    hit_tiles = stored(hit_tiles.withColumn("at", _crowded(F.col("at"))).filter(F.size("at") > 0))
    # the starts of all stretches that cover a tile, but of none that the tile before has had
    starts = F.transform(
        "at",
        lambda p, i: F.struct(
            "item_id", "length", F.greatest(p + F.col("width") - F.col("length"), F.get("at", i - 1) + 1).alias("first"), p.alias("last")
        ),
    )
    # one row per document with hits; their number is bounded by the document's own tiles
    held = stored(hit_tiles.select("doc_id", "content", starts.alias("places")).groupBy("doc_id", "content").agg(F.flatten(F.collect_list("places")).alias("places")))

    held = held.withColumnsRenamed({"doc_id": "_id", "content": "_content"})
    near_texts = narrowed(texts, held.withColumnRenamed("_content", "content"), "content")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content"))
    placed = near_texts.select("doc_id", "content", word_hashes("text").alias("words")).join(held, same)

    def around(p: Column) -> Column:
        begin = F.greatest(p["first"], F.lit(0))
        part = F.slice("words", begin + 1, F.least(F.size("words"), p["last"] + p["length"]) - begin)
        return F.struct(p["item_id"].alias("item_id"), p["length"].alias("length"), p["first"].alias("first"), p["last"].alias("last"), part.alias("part"))

    near_hits = placed.select("doc_id", F.size("words").alias("size"), F.explode(F.transform("places", around)).alias("p")).select("doc_id", "size", "p.*")
    known = items.select(F.col("item_id").alias("_item"), F.col("length").alias("_length"), "shingles")
    known = near_hits.join(known, F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("length") == F.col("_length")))
    compared = _stretches(known)
    total = F.col("n") + F.col("own") - F.col("shared")
    similar = compared.filter("own > 0").filter(100 * F.col("shared") >= PERCENT * total).withColumn("similarity", F.col("shared") / total)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("_first"), F.col("end"))).alias("best")
    return similar.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best._first")).alias("start"), F.col("best.end").alias("end"), F.col("best.similarity").alias("similarity")
    )
