"""SimHash fingerprints by DataFrame functions alone, and Hamming search through permuted block tables."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from noticelake.llm.common import cut

BITS = 128
#: Each sum counts two bits of a hash, 32 bits apart: a text's term weights may sum to 2**32 - 1.
LANE = 0x0000000100000001


def terms(text: Column) -> Column:
    """Neighbouring word pairs of a lower-cased text, repeats included; a single word is paired with an empty one."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, 2**31 - 1).alias("b"))


def weight(a: Column, b: Column) -> Column:
    """How much a pair counts: the letters of both words, 16 at most, as long words are rare ones."""
    return F.least(F.octet_length(a) + F.octet_length(b), F.lit(16)).cast("long")


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, hi, lo)`` with a 128-bit fingerprint of ``text`` for each distinct ``keys``.

    Every word pair votes with its weight for or against each bit of its two 64-bit hashes; a bit
    is set if the votes for it are over half. Equal texts have equal fingerprints; null, empty and
    wordless texts have fingerprint 0. Rows of equal keys must have equal texts and give one row.
    """
    each = texts.select(*keys, F.explode_outer(terms(F.coalesce("text", F.lit("")))).alias("t"))
    a, b = F.coalesce("t.a", F.lit("")), F.coalesce("t.b", F.lit(""))
    voted = each.select(
        *keys, F.xxhash64(a, b).alias("h"), F.xxhash64(b, F.lit(7), a).alias("g"),
        F.when(F.col("t").isNull(), F.lit(0).cast("long")).otherwise(weight(a, b)).alias("w"),
    )
    lane = lambda c, k: F.sum(F.shiftrightunsigned(c, k).bitwiseAND(F.lit(LANE)) * F.col("w"))
    sums = voted.groupBy(*keys).agg(
        F.sum("w").alias("n"), *[lane(F.col(c), k).alias(f"{c}{k}") for c in ("h", "g") for k in range(32)]
    )

    def packed(c: str) -> Column:
        out = F.lit(0).cast("long")
        for k in range(32):
            low, high = F.col(f"{c}{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"{c}{k}", 32)
            out = out.bitwiseOR(F.when(low * 2 > F.col("n"), F.lit(1 << k)).otherwise(F.lit(0).cast("long")))
            out = out.bitwiseOR(F.when(high * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), 32 + k)).otherwise(F.lit(0).cast("long")))
        return out

    return sums.select(*keys, packed("h").alias("hi"), packed("g").alias("lo"))


def hex_of(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(hi: Column, lo: Column, other_hi: Column, other_lo: Column) -> Column:
    return F.bit_count(hi.bitwiseXOR(other_hi)) + F.bit_count(lo.bitwiseXOR(other_lo))


def likeness(hi: Column, lo: Column, other_hi: Column, other_lo: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1.0 - distance(hi, lo, other_hi, other_lo) / float(BITS)


def block_keys(hi: Column, lo: Column, radius: int, blocks: int) -> Column:
    """The keys of a fingerprint in the permuted tables: the bits of each way to choose ``blocks - radius`` blocks.

    Fingerprints within ``radius`` bits differ in at most ``radius`` blocks, so they share a key.
    """
    width = BITS // blocks
    masks = [((1 << width) - 1) << (width * k) for k in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = []
    for n, chosen in enumerate(itertools.combinations(masks, blocks - radius)):
        mask = sum(chosen)
        keys.append(F.struct(
            F.lit(n).alias("table"), hi.bitwiseAND(F.lit(signed(mask >> 64))).alias("khi"), lo.bitwiseAND(F.lit(signed(mask & (2**64 - 1)))).alias("klo")
        ))
    return F.array(*keys)


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """``(q_hi, q_lo, hi, lo)``: every distinct fingerprint of ``fps`` within ``radius`` bits of a distinct one of ``queries``.

    Exact. Both sides are reduced to distinct fingerprints first, so copies make no pairs. Equal
    fingerprints are pairs too; nulls are none.
    """
    table = lambda df: df.select("hi", "lo").distinct().select("hi", "lo", F.explode(block_keys(F.col("hi"), F.col("lo"), radius, blocks)).alias("k"))
    mine = table(queries).select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"), "k.*")
    theirs = table(fps).select("hi", "lo", "k.*")
    near = distance(F.col("q_hi"), F.col("q_lo"), F.col("hi"), F.col("lo")) <= radius
    return mine.join(theirs, ["table", "khi", "klo"]).where(near).select("q_hi", "q_lo", "hi", "lo").distinct()


def successors(docs: DataFrame) -> DataFrame:
    """``(doc_id, print, n_chars, copies, next_id, next_print)`` for each distinct (doc_id, text) of ``docs``.

    ``print`` is a hash of the text. Rows are ordered by doc_id, nulls first, then by print; the last
    one meets the first, a single one itself. Only ids, prints and lengths are sorted: by range over
    many tasks, each of which hands its first row to the range before it.
    """
    keys = docs.select("doc_id", F.xxhash64("text").alias("print"), F.char_length("text").cast("long").alias("n_chars"))
    counted = keys.groupBy("doc_id", "print", "n_chars").agg(F.count("*").alias("copies"))
    ranged = cut(counted.repartitionByRange("doc_id", "print").withColumn("block", F.spark_partition_id()))
    firsts = ranged.groupBy("block").agg(F.min(F.struct("doc_id", "print")).alias("first"))
    over = Window.orderBy("block")
    everywhere = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("block", F.coalesce(F.lead("first").over(over), F.first("first").over(everywhere)).alias("after"))
    follows = F.lead(F.struct("doc_id", "print")).over(Window.partitionBy("block").orderBy(F.asc_nulls_first("doc_id"), "print"))
    return ranged.withColumn("follows", follows).join(after, "block").withColumn("follows", F.coalesce("follows", "after")).select(
        "doc_id", "print", "n_chars", "copies", F.col("follows.doc_id").alias("next_id"), F.col("follows.print").alias("next_print")
    )


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of an edited text, and the key of the next document.

    The edited text has the last ``floor(n_chars / 2)`` code points replaced by the first as many
    (or all) of the next document. Rows equal in doc_id and text follow each other: all but the last
    are edited by their own copy. Rows equal in edited text too come as one, with their number in
    ``copies``. Null texts are empty; null doc_ids come first and are kept.
    """
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    links = cut(successors(given))
    # Joins and sums share these keys without nulls, so whole texts are shuffled once and their first halves once more.
    key = lambda c: [F.col(c).isNull().alias("none"), F.coalesce(c, F.lit(0)).alias("id")]
    by = ["none", "id", "print"]
    texts = given.groupBy(*key("doc_id"), F.xxhash64("text").alias("print")).agg(F.first("text").alias("text"))
    asked = links.select(
        *key("next_id"), F.col("next_print").alias("print"), F.struct(*key("doc_id"), "print").alias("to"), F.floor(F.col("n_chars") / 2).cast("int").alias("half")
    )
    lent = texts.join(asked, by).select("to.*", F.substring("text", F.lit(1), F.col("half")).alias("lent"))
    met = texts.join(links.select(*key("doc_id"), "*"), by).join(lent, by)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    last = F.struct(F.lit(1).cast("long").alias("copies"), "next_id", "next_print", "lent")
    others = F.struct(
        (F.col("copies") - 1).alias("copies"), F.col("doc_id").alias("next_id"), F.col("print").alias("next_print"),
        F.substring("text", F.lit(1), half).alias("lent"),
    )
    pairs = met.select(
        *by, "doc_id", "n_chars", "text", F.explode(F.when(F.col("copies") > 1, F.array(last, others)).otherwise(F.array(last))).alias("k")
    ).select(
        *by, "doc_id", "n_chars", "k.copies", "k.next_id", "k.next_print", "text",
        F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), "k.lent").alias("edited"),
    ).withColumn("edited_sha256", F.sha2("edited", 256))
    keys = [*by, "doc_id", "n_chars", "copies", "next_id", "next_print", "edited_sha256"]
    both = fingerprints(pairs.select(*keys, F.posexplode(F.array("text", "edited")).alias("kind", "text")), [*keys, "kind"])
    side = lambda c, k: F.max(F.when(F.col("kind") == k, F.col(c)))
    return both.groupBy(*keys).agg(
        side("hi", 0).alias("hi"), side("lo", 0).alias("lo"), side("hi", 1).alias("e_hi"), side("lo", 1).alias("e_lo")
    ).drop("none", "id")
