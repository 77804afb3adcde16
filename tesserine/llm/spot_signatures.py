"""SpotSigs fingerprints with DataFrame functions only.

A spot is an occurrence of a common word; its signature is the hash of the next two content words (words that
are not common ones). A text's signature set is held whole, as hashes of 32 bits. Likeness is the Jaccard
coefficient of two sets.
Texts without any spot are represented by their pairs of adjacent words, and by their one word if there is
one only. The fingerprint is the set's hashes in ascending order, eight hexadecimal digits each.

`near_pairs` compares fingerprints of a whole table: only sets whose lengths permit the threshold meet
(partitions by the logarithm of the set's length and the one above), by the signatures of their prefixes.

Edges: null text is empty; empty or sign-only texts have an empty fingerprint, alike (1.0) to another empty
one and unlike (0.0) to any other; equal doc_ids are ordered by their text; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common words of English, French, German and Spanish that open a spot.
COMMON = (
    "the of and to in is it that for with as was on be by this are or an at from he not but have had which you his her they "
    "le la les de des du un une et est que qui dans pour par sur au aux ne pas plus avec ce se son sa il elle "
    "der die das und ist den dem des von zu mit auf für ein eine einer im nicht sich es als auch an wie "
    "el los las y en una por con para del al lo su no más como"
).split()
ROWS = 4096
_ANCHOR = "\u0001"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def spots(text: Column) -> Column:
    """A text's signature set, sorted."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " ")
    common = "|".join(sorted(set(COMMON)))
    marked = F.regexp_replace(F.concat(F.lit(" "), F.trim(words), F.lit(" ")), f" (?:{common})(?= )", " " + _ANCHOR)

    def chains(parts: Column) -> Column:
        after = F.sequence(F.lit(2), F.size(parts))
        ahead = lambda i: F.substring_index(F.trim(F.array_join(F.slice(parts, i, 2), "")), " ", 2)
        return F.when(F.size(parts) > 1, F.transform(after, ahead)).otherwise(_pairs(parts[0]))

    # Common words in a row open the same chain, whatever their number: one of them stands for all.
    single = F.regexp_replace(marked, f"(?: {_ANCHOR})++", " " + _ANCHOR)
    found = _let(F.split(single, " " + _ANCHOR), chains)
    hashed = F.transform(F.filter(found, lambda c: c != ""), lambda c: F.xxhash64(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.array_sort(F.array_distinct(hashed))


def _pairs(text: Column) -> Column:
    def adjacent(w: Column) -> Column:
        return F.when(F.size(w) < 2, w).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.array_join(F.slice(w, i, 2), " ")))

    return _let(F.split(F.trim(text), " "), adjacent)


def fingerprint(signatures: Column) -> Column:
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two sets."""
    shared = _let(F.size(F.array_intersect(a, b)), lambda n: n.cast("double") / (F.size(a) + F.size(b) - n))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shared)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are below key, by binary search."""
    n = len(bounds)
    if not n:
        return F.lit(0)
    array = F.array(*map(F.lit, bounds))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(n.bit_length()))))

    def step(lo: Column, p: Column) -> Column:
        return F.when((lo + p <= n) & (F.get(array, lo + p - 1) < key), lo + p).otherwise(lo)

    return F.coalesce(F.aggregate(steps, F.lit(0), step), F.lit(0))


def with_next(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text) with next_text of the following doc_id, the first after the last.

    Rows are dealt to ranges of doc_id of about `rows` rows; the head of each range is also sent, as a guest,
    to the end of the range before it, so one shuffle by range serves the window.
    """
    stats = docs.agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).head()
    parts = min(4096, -(-stats["n"] // rows))
    bounds: list[int] = []
    if parts > 1:
        cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts).alias("c")).head()["c"]
        bounds = [x for x in sorted(set(cuts or [])) if x < stats["top"]]
    n = len(bounds) + 1
    ranged = docs.withColumn("bucket", _bucket(F.col("doc_id"), bounds)).withColumn("guest", F.lit(0))
    row = F.struct("doc_id", "text")
    rank = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), F.xxhash64("text"))
    heads = ranged.groupBy("bucket").agg(F.min_by(row, rank).alias("r"))
    guests = heads.select("r.doc_id", "r.text", F.pmod(F.col("bucket") - 1, F.lit(n)).alias("bucket"), F.lit(1).alias("guest"))
    from pyspark.sql import Window

    w = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ahead = ranged.unionByName(guests).withColumn("ahead", F.lead(F.struct("text")).over(w))
    return ahead.where("guest = 0").select("doc_id", "text", F.col("ahead.text").alias("next_text"))


def fingerprints(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """Fingerprints of texts and of edited texts, whose last quarter is the beginning of the next document."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(docs, rows)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    near = near.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    near = near.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *(spots(F.col(c)).alias(f"{c}_set") for c in ("text", "next_text", "edited")))
    return near.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("text_set")).alias("fingerprint"),
        fingerprint(F.col("edited_set")).alias("edited_fingerprint"),
        likeness(F.col("text_set"), F.col("edited_set")).alias("near_edited"),
        likeness(F.col("text_set"), F.col("next_text_set")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, near) of different fingerprints with likeness at the threshold or above.

    Equal fingerprints are one class under their least doc_id. A set goes to the partition of its length and, as
    a guest, to the next longer one; only signatures in the set's prefix, the part that a set similar enough
    cannot miss entirely, are joined. Signatures are hashes, so their order is as good as random.
    """
    sets = docs.select("doc_id", spots(F.col("text")).alias("s")).groupBy("s").agg(F.min("doc_id").alias("doc_id")).where("size(s) > 0")
    size = F.size("s")
    part = F.floor(-F.log(size.cast("double")) / math.log(threshold)).cast("int")
    prefix = F.slice("s", F.lit(1), size - F.ceil(size * threshold - 1e-9).cast("int") + 1)
    rows = sets.select("doc_id", size.alias("n"), part.alias("part"), F.explode(prefix).alias("token"))
    a = rows.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.explode(F.array("part", F.col("part") + 1)).alias("part"), "token")
    b = rows.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "part", "token")
    fits = (F.col("na") <= F.col("nb")) & (F.col("na") >= threshold * F.col("nb") - 1e-9) & ((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b")))
    pairs = a.join(b, ["part", "token"]).where(fits).select("a", "b").distinct()
    x, y = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("s").alias("y"))
    both = pairs.join(x, "a").join(y, "b")
    common = F.size(F.array_intersect("x", "y"))
    near = common / (F.size("x") + F.size("y") - common)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), near.alias("near")).where(F.col("near") >= threshold)
