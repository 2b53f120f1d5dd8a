"""Document fingerprints after SpotSigs, in DataFrame expressions only.

A common word is an anchor; the content words that follow it form a chain, and anchor and chain are one signature.
Chains sit in running prose, so headings, lists and boilerplate leave few of them. The set of a text's signatures is
its fingerprint; two fingerprints are compared by their Jaccard similarity.

`near_duplicates` compares all documents: sets are partitioned by length, so that only sets whose lengths allow the
similarity meet, and inside a partition only sets that share one of their rarest signatures are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortspark.session import stable

#: Very common words of English, French, German and Spanish.
ANCHORS = (
    "a an the this that is was are were be and or of to in on at by for with as from it he she they not have "
    "le la les un une des du et est que qui dans pour par sur pas avec "
    "der die das ein eine und ist nicht von zu mit den dem auf sich für "
    "el los las una y en es por con para su al del se no lo").split()
#: Content words of a chain, and how many anchors may stand between two of them.
CHAIN, GAP = 2, 3
#: Documents of one range of ids, and the largest number of ranges.
RANGE_ROWS, RANGES = 64, 1024


def checksum(text: Column) -> Column:
    """crc32 as a signed 32-bit number."""
    return (F.crc32(text.cast("binary")) - F.lit(1 << 31)).cast("int")


def signatures(text: Column) -> Column:
    """The distinct signatures of a text as 32-bit numbers, sorted; never empty.

    Words are runs of letters and digits, without regard to case. An anchor that a content word follows directly begins
    a chain of that word and the next content word (at most GAP anchors between). A text without any chain has one
    signature, its own checksum.
    """
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")

    def chains(all_words: Column) -> Column:
        def chain(word: Column, i: Column) -> Column:
            second = F.coalesce(*[
                F.when(~F.get(all_words, i + k).isin(ANCHORS), F.get(all_words, i + k)) for k in range(2, 3 + GAP)], F.lit(""))
            return F.when(
                word.isin(ANCHORS) & ~F.get(all_words, i + 1).isin(ANCHORS),
                checksum(F.concat_ws(" ", word, F.get(all_words, i + 1), second)))

        return F.transform(all_words, chain)

    # one evaluation of the words for all lookups in them: a lambda's variable, not a repeated expression
    found = F.get(F.transform(F.array(words), lambda w: F.array_sort(F.array_distinct(F.array_compact(chains(w))))), F.lit(0))
    return F.get(F.transform(F.array(found), lambda s: F.when(F.size(s) > 0, s).otherwise(
        F.array(checksum(text)))), F.lit(0))


def as_text(signature: Column) -> Column:
    """A fingerprint as a string: its signatures in hexadecimal."""
    return F.array_join(F.transform(signature, lambda s: F.hex(s + F.lit(1 << 31))), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of signatures."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def followed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with `signature`, and with `next_text` and `next_signature`, of the next document by doc_id.

    Null ids come last, equal ids in the order of their texts, and the first document follows the last. Documents
    are dealt to ranges of ids between quantiles; the first one of a range also visits the range before, so no range
    needs another one's rows and no task sees more than its ranges. Only ids and texts are shuffled; signatures are
    worked out on the other side.
    """
    n, low = docs.agg(F.count("*"), F.min("doc_id")).first()
    ranges = min(RANGES, max(1, n // RANGE_ROWS))
    cuts: list[int] = []
    if ranges > 1 and low is not None:
        cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]) - {low})
    edges = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    place = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.size(F.filter(edges, lambda e: e <= F.col("doc_id"))))
    opens = F.array_contains(edges, F.col("doc_id"))
    closes = F.col("doc_id") == F.lit(low) if low is not None else F.lit(True)
    stay = lambda at, guest: F.struct(at.cast("int").alias("range"), F.lit(guest).alias("guest"))
    dealt = docs.withColumn("_range", place).select("doc_id", "text", F.explode(F.array_compact(F.array(
        stay(F.col("_range"), 0), F.when(opens, stay(F.col("_range") - 1, 1)),
        F.when(closes, stay(F.lit(len(cuts)), 2))))).alias("_at")).select(
        "doc_id", "text", F.col("_at.range").alias("_range"), F.col("_at.guest").alias("_guest")).repartition("_range").withColumn(
        "signature", signatures(F.col("text")))
    order = W.partitionBy("_range").orderBy("_guest", F.col("doc_id").asc_nulls_last(), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).withColumn(
        "next_signature", F.lead("signature").over(order)).where("_guest = 0").drop("_range", "_guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text has the last floor(n_chars / 2) characters replaced by the first as many (or all) of the next
    document's, by ascending doc_id; the first follows the last. near_edited and near_next: similarity of the
    fingerprint to the edited text's and to the next document's.

    One row for each input row. Null or empty text: empty. Repeated ids follow each other in the order of their texts; a
    null doc_id comes last; a single document is its own next. An empty table gives no rows. Other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pairs = followed(own)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    return pairs.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).withColumn(
        "edited_signature", signatures(F.col("edited"))).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("signature")).alias("fingerprint"), as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        jaccard(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        jaccard(F.col("signature"), F.col("next_signature")).alias("near_next"))


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, similarity): all pairs of different fingerprints that are similar by `least` or more.

    Documents of equal fingerprints are one class, called by its smallest doc_id; a and b are such ids, a < b. The
    class of each document is in fingerprint_classes(). Lengths are partitioned at powers of 1 / least, so similar
    sets lie in the same or in neighbouring partitions. A set of n signatures is entered under its n - ceil(least * n) + 1
    rarest ones: similar sets share one of those.
    """
    sets = stable(fingerprint_classes(docs).where("doc_id = class_id").select("class_id", "signature"))
    size = F.size("signature")
    width = -math.log(least)
    each = sets.select("class_id", F.explode("signature").alias("s"))
    rare = each.groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    ranked = each.join(rare, "s").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("shared"))
    first = size - F.ceil(F.lit(least) * size - 1e-9) + 1
    # signatures that only one class has are the rarest of all, and no pair shares them
    alone = size - F.size("shared")
    entry = sets.join(ranked, "class_id").withColumn("_m", F.greatest((first - alone).cast("int"), F.lit(0))).where("_m > 0").select(
        "class_id", size.alias("size"), F.floor(F.log(size.cast("double")) / width).cast("int").alias("part"),
        F.explode(F.slice("shared", F.lit(1), F.col("_m"))).alias("e")).select("class_id", "size", "part", "e.s")
    right = entry.withColumn("part", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)))
    met = entry.alias("x").join(right.alias("y"), F.expr(
        f"x.s = y.s and x.part = y.part and x.class_id < y.class_id and least(x.size, y.size) >= {least} * greatest(x.size, y.size) - 1e-9"))
    met = met.select(F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b")).distinct()
    left, other = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    return met.join(left, "a").join(other, "b").select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("similarity")).where(
        F.col("similarity") >= least)


def fingerprint_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, signature): class_id is the smallest doc_id with the same fingerprint; null ids are left out."""
    own = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), signatures(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("signature"))
    least = own.groupBy("signature").agg(F.min("doc_id").alias("class_id"))
    return own.join(least, "signature").select("doc_id", "class_id", "signature").distinct()
