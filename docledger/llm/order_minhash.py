"""Order MinHash fingerprints, in DataFrame functions only.

A text's words (runs of anything but ASCII white space) give k-word grams; equal grams are
numbered by occurrence, so that all of a text's numbered grams differ. A signature has
``slots`` entries. Entry j orders the numbered grams by hash XOR j, j standing in the hash's
leading bits, selects the ``take`` least, puts them back in text order and hashes that
tuple. Two texts agree in an entry if they have the same least grams in the same order, so
the share of equal entries falls with edit distance, moved passages included.

One sort by hash serves all entries: entry j's least grams open the run of hashes that
begin with j. Only where such a run has fewer than ``take`` grams (texts of few words) are the
grams sorted for that entry.

Nulls and blanks: a null text is an empty one. A text without words has a signature of its
own and is fully like other such texts; one of fewer words than k is one gram, and one of
fewer grams than ``take`` gives a shorter tuple. Equal texts have equal signatures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import let

#: A text has less than 2^30 words (strings are below 2 GB): the low bits of a sort value
#: hold a place, the others the leading bits of a hash.
_PLACE = 30
_MASK = (1 << _PLACE) - 1


def _packed(h: Column, place: Column) -> Column:
    return h.bitwiseAND(F.lit(~_MASK)).bitwiseOR(place.cast("long"))


def signature(text: Column, k: int = 2, slots: int = 32, take: int = 2) -> Column:
    """array<long> of ``slots`` entries. ``slots`` is a power of two."""
    bits = slots.bit_length() - 1
    if 1 << bits != slots or not 1 <= bits <= 16:
        raise ValueError("slots must be a power of two, from 2 to 65536")
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x09-\x0D\x20]+", "")
    split = F.split(trimmed, r"[\x09-\x0D\x20]+")
    words = F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w))

    def gram(words: Column, i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + F.lit(d)) for d in range(k)])

    def grams(words: Column) -> Column:
        n = F.greatest(F.size(words) - F.lit(k - 1), F.least(F.size(words), F.lit(1)))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: gram(words, i))

    def numbered(h: Column) -> Column:
        """Hash of (gram, occurrence) with its place, sorted."""
        place = lambda s, p: F.get(s, p).bitwiseAND(F.lit(_MASK)).cast("int")
        at = lambda s, p: F.get(h, place(s, p))

        def opens(s: Column) -> Column:
            return F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda p: (p == 0) | (at(s, p) != at(s, p - 1)))

        def number(s: Column, opens: Column) -> Column:
            def run(begin: Column, j: Column) -> Column:
                end = F.coalesce(F.get(opens, j + 1), F.size(s)) - 1
                return F.transform(F.sequence(begin, end), lambda p: _packed(F.xxhash64(at(s, p), p - begin), place(s, p)))

            return F.sort_array(F.flatten(F.transform(opens, run)))

        def from_sorted(s: Column, opens_: Column) -> Column:
            # different grams with equal leading bits stand by place, one among the other: those texts are
            # sorted by the whole hash
            mixed = F.exists(opens_, lambda p: F.shiftright(F.get(s, p), _PLACE) == F.shiftright(F.get(s, p - 1), _PLACE))
            whole = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("p"))))
            places = F.transform(whole, lambda x: x["p"])
            return F.when(F.coalesce(mixed, F.lit(False)), let(places, lambda s: let(opens(s), lambda o: number(s, o)))).otherwise(number(s, opens_))

        order = F.sort_array(F.transform(h, lambda x, i: _packed(x, i)))
        return let(order, lambda s: let(opens(s), lambda o: from_sorted(s, o)))

    def slot(y: Column) -> Column:
        return F.shiftrightunsigned(y, 64 - bits).cast("int")

    def entry(chosen: Column) -> Column:
        """Put chosen values in text order and hash the tuple of their hashes."""
        by_place = F.array_sort(F.transform(chosen, lambda y: F.struct(y.bitwiseAND(F.lit(_MASK)).alias("p"), F.shiftright(y, _PLACE).alias("h"))))
        return F.xxhash64(F.transform(by_place, lambda x: x["h"]))

    def entries(sorted_: Column) -> Column:
        n = F.size(sorted_)
        # signed order puts the runs of the upper half of the leading bits first
        lead = F.filter(sorted_, lambda y, p: (p < take) | (slot(y) != slot(F.get(sorted_, p - take))))

        def all_slots(lead: Column) -> Column:
            def one(j: Column) -> Column:
                full = let(
                    F.filter(lead, lambda y: slot(y) == j),
                    lambda own: F.when(F.size(own) >= take, own).otherwise(nearest(j)),
                )
                return let(full, entry)

            def nearest(j: Column) -> Column:
                sign = F.lit(-(1 << 63))  # unsigned order as signed order
                moved = F.transform(sorted_, lambda y: F.struct(y.bitwiseXOR(F.shiftleft(j.cast("long"), 64 - bits)).bitwiseXOR(sign).alias("d"), y.alias("y")))
                return F.transform(F.slice(F.array_sort(moved), 1, take), lambda x: x["y"])

            return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), one)

        return F.when(n == 0, F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda j: F.lit(0).cast("long"))).otherwise(
            let(lead, all_slots)
        )

    hashes = let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(grams(w)))
    order = let(hashes, lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(numbered(h)))
    return let(order, entries)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries of two signatures, 0 to 1."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(a).cast("double")


def as_text(sig: Column) -> Column:
    """The entries as hexadecimal digits, eight for each."""
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(F.shiftrightunsigned(x, 32)), 8, "0"))), "")


def with_next(docs: DataFrame, columns: list[str], rows_per_block: int = 4096) -> DataFrame:
    """``docs`` with ``next_<column>`` of the next row by descending ``doc_id`` (after the last: the
    first). Rows with equal ids stand in the order of their texts' hash; a null id is last.

    Rows are dealt to consecutive blocks of ids; the highest row of a block also goes to the
    block above, whose last row it follows. Bounds of the blocks are all that the driver holds."""
    n = docs.count()
    blocks = min(max(1, -(-n // rows_per_block)), 1 << 16)
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull())
    bounds = (
        ids.repartitionByRange(blocks, "doc_id").groupBy(F.spark_partition_id().alias("p"))
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("low").collect()
    )
    lows, highs = [b.low for b in bounds], [b.high for b in bounds]
    side = max(1, int(len(lows) ** 0.5))
    groups = [lows[i : i + side] for i in range(0, len(lows), side)]
    count = lambda values: F.size(F.filter(values, lambda b: b <= F.col("doc_id")))
    if lows:
        coarse = F.greatest(count(F.array(*[F.lit(g[0]) for g in groups])), F.lit(1)) - 1
        table = F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups])
        block = F.coalesce(F.greatest(coarse * side + count(F.get(table, coarse)) - 1, F.lit(0)), F.lit(0))
        block = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(block)
        top = F.get(F.array(*[F.lit(h) for h in highs]), F.col("__block")) == F.col("doc_id")
        last = len(lows) - 1
    else:
        block, top, last = F.lit(0), F.lit(True), 0
    above = F.when(F.col("__block") == last, F.lit(0)).otherwise(F.col("__block") + 1)
    copies = F.when(F.coalesce(top, F.lit(False)), F.array(F.struct(F.lit(0).alias("copy"), F.col("__block").alias("b")), F.struct(F.lit(1).alias("copy"), above.alias("b"))))
    own = F.array(F.struct(F.lit(0).alias("copy"), F.col("__block").alias("b")))
    order = [F.col("__copy"), F.col("doc_id").desc_nulls_last(), F.col("__tie")]
    window = W.partitionBy("__b").orderBy(*order)
    dealt = (
        docs.withColumn("__block", block).withColumn("__tie", F.xxhash64("text"))
        .withColumn("__c", F.explode(F.coalesce(copies, own)))
        .select(*docs.columns, "__tie", F.col("__c.copy").alias("__copy"), F.col("__c.b").alias("__b"))
    )
    return (
        dealt.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns})
        .filter("__copy = 0").drop("__copy", "__b", "__tie")
    )


def compare_edits(docs: DataFrame, k: int = 2, slots: int = 32, take: int = 2) -> DataFrame:
    """Signatures of all texts and of their edited texts (the last third of the characters
    replaced by the next text's first), and how alike they are."""
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = read.withColumn("sig", signature(F.col("text"), k, slots, take))
    pairs = with_next(signed, ["text", "sig"])
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next_text"), F.lit(1), third))
    pairs = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "sig", "next_sig", edited.alias("edited"))
    pairs = pairs.withColumn("edited_sig", signature(F.col("edited"), k, slots, take))
    return pairs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
