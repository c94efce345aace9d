"""Merkle-tree fingerprints of documents over sections, paragraphs and sentences.

A document's sections begin after empty lines and at headings, its paragraphs are lines,
and the leaves are the sentences of a paragraph, cut every ``LEAF_CHARS`` characters if
they are longer.  A leaf's hash is SHA-256 of its text; the hash of a paragraph, section
or document is SHA-256 of its children's hashes, in order, under the name of its level.
The leaves hold every character, line ends included, so equal roots mean equal texts.
Where two trees differ, :func:`differing` compares them from the root down, place by
place, and goes only into branches with unequal hashes.

A fingerprint is the root and, in order, the short hashes of its branches:

    root/section|paragraph:leaf,leaf|paragraph:leaf/section|...

Likeness of two fingerprints is 1 where the roots are equal, and otherwise the Dice
coefficient of their sets of leaves, at most 0.999999.

Everything is DataFrame expressions; no Python runs on the executors.

Defined results
* null texts are empty; the empty text is one section of one empty leaf;
* a document's next one is the next smaller doc_id, null counting as the least, then by a
  hash of the text, then by text; after the last comes the first, and a single document is
  its own next one;
* repeated rows stay repeated rows; an empty table gives no rows; only the id and text
  are read, so other columns can't clash.

Scale: one pass counts bytes and takes quantiles of the ids; one shuffle deals the texts
into blocks, ranges of ids of about ``BLOCK_BYTES``, where the next document is a neighbour.
A range that is one id, null or repeated in many rows, is dealt further by the hash of the
text.  The heads of blocks are joined by block; only the blocks' numbers are ordered as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents

#: Bytes of text per block, and blocks at most, which bounds the quantiles held by the driver.
BLOCK_BYTES = 4 << 20
MOST_BLOCKS = 1 << 16
#: Hex digits of a branch or leaf in a fingerprint.
LEAF = 16
LEAF_CHARS = 160

_SECTIONS = r"(?<=\n)(?=\n|#)"
_PARAGRAPHS = r"(?<=\n)"
#: As far as the next end of a sentence, but at most so many code points.
_LEAVES = rf"(?s:.){{1,{LEAF_CHARS}}}?(?:(?<=[.!?])(?= )|\z)|(?s:.){{{LEAF_CHARS}}}"


def _short(h: Column) -> Column:
    return F.substring(h, 1, LEAF)


def _node(level: str, hashes: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{level} "), F.concat_ws(",", hashes)), 256)


def _let(value: Column, body) -> Column:
    """Use a value more than once and compute it once."""
    return F.transform(F.array(value), body)[0]


def _paragraph(text: Column) -> Column:
    cut = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(_LEAVES), F.lit(0)))
    leaves = F.transform(cut, lambda x: F.sha2(x, 256))
    return _let(
        leaves,
        lambda hashes: _let(
            _node("paragraph", hashes),
            lambda own: F.struct(own.alias("hash"), F.concat(_short(own), F.lit(":"), F.concat_ws(",", F.transform(hashes, _short))).alias("print")),
        ),
    )


def _section(text: Column) -> Column:
    return _let(
        F.transform(F.split(text, _PARAGRAPHS), _paragraph),
        lambda parts: _let(
            _node("section", parts["hash"]),
            lambda own: F.struct(own.alias("hash"), F.concat(_short(own), F.lit("|"), F.concat_ws("|", parts["print"])).alias("print")),
        ),
    )


def fingerprint(text: Column) -> Column:
    """The fingerprint string of a text column."""
    return _let(
        F.transform(F.split(text, _SECTIONS), _section),
        lambda parts: F.concat(_node("document", parts["hash"]), F.lit("/"), F.concat_ws("/", parts["print"])),
    )


def _branches(print_: Column, level: str) -> Column:
    """The distinct sections, paragraphs or leaves of a fingerprint, in order."""
    sections = F.slice(F.split(print_, "/"), 2, 1 << 30)
    if level == "section":
        return F.transform(sections, lambda s: F.substring_index(s, "|", 1))
    paragraphs = F.filter(F.split(F.array_join(sections, "|"), r"\|"), lambda x: F.contains(x, F.lit(":")))
    if level == "paragraph":
        return F.transform(paragraphs, lambda x: F.substring_index(x, ":", 1))
    return F.split(F.array_join(F.transform(paragraphs, lambda x: F.substring_index(x, ":", -1)), ","), ",")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: how much of two fingerprints' leaves they share."""
    shared = _let(
        F.struct(F.array_distinct(_branches(a, "leaf")).alias("x"), F.array_distinct(_branches(b, "leaf")).alias("y")),
        lambda p: 2 * F.size(F.array_intersect(p["x"], p["y"])) / (F.size(p["x"]) + F.size(p["y"])),
    )
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.lit(1.0)).otherwise(F.least(shared, F.lit(0.999999)))


def differing(a: Column, b: Column) -> Column:
    """section.paragraph (from 0) of each place where two fingerprints' trees differ.

    Sections are compared place by place, and only in those of unequal hashes the
    paragraphs; one that the other tree doesn't have differs.  Equal roots have none.
    """
    sections = F.arrays_zip(F.slice(F.split(a, "/"), 2, 1 << 30).alias("x"), F.slice(F.split(b, "/"), 2, 1 << 30).alias("y"))

    def paragraphs(s: Column, i: Column) -> Column:
        parts = F.arrays_zip(F.slice(F.split(F.coalesce(s["x"], F.lit("")), r"\|"), 2, 1 << 30).alias("x"), F.slice(F.split(F.coalesce(s["y"], F.lit("")), r"\|"), 2, 1 << 30).alias("y"))
        own = lambda p: F.substring_index(p, ":", 1)
        unequal = F.transform(parts, lambda p, j: F.when(own(p["x"]).eqNullSafe(own(p["y"])), F.lit("")).otherwise(F.concat_ws(".", i.cast("string"), j.cast("string"))))
        return F.filter(unequal, lambda p: p != "")

    own = lambda x: F.substring_index(x, "|", 1)
    places = F.flatten(F.transform(sections, lambda s, i: F.when(own(s["x"]).eqNullSafe(own(s["y"])), F.array().cast("array<string>")).otherwise(paragraphs(s, i))))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.array().cast("array<string>")).otherwise(places)


def _bounds(docs: DataFrame, block_bytes: int, most: int) -> list[int]:
    """Quantiles of the order of ids that cut the texts' bytes into blocks; a frequent id occurs more than once."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = min(most, -(-size // block_bytes))
    if blocks < 2:
        return []
    shares = ",".join(f"{i / blocks!r}D" for i in range(1, blocks))
    return sorted(docs.agg(F.expr(f"percentile_approx(place, array({shares}), {20 * blocks})")).first()[0])


def _count(bounds: list[int], test) -> Column:
    """How many of the bounds pass a test that holds for the first ones only: of groups, then within one."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    longs = lambda xs: F.expr("array(" + ",".join(f"{x}L" if x > -(1 << 63) else f"(-{(1 << 63) - 1}L - 1L)" for x in xs) + ")")
    lasts = longs([g[-1] for g in groups])
    return _let(
        F.size(F.filter(lasts, test)),
        lambda whole: whole * width + F.size(F.filter(F.coalesce(F.get(F.array(*map(longs, groups)), whole), F.array().cast("array<bigint>")), test)),
    )


def with_next(docs: DataFrame, block_bytes: int = BLOCK_BYTES, most: int = MOST_BLOCKS) -> DataFrame:
    """doc_id, text, next_text: each document beside the next in descending order of doc_id.

    Neighbours are found within blocks; the last document of a block is followed by the
    head of the next block that has any, and the last block by the first.
    """
    # The complement of an id descends without overflow; null follows every other.
    ordered = docs.withColumn("place", F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1))).withColumn("turn", F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1)))
    bounds = _bounds(ordered.select("place", "text"), block_bytes, most)
    place = F.col("place")
    below, upto = _count(bounds, lambda x: x < place), _count(bounds, lambda x: x <= place)
    # Rows of an id that fills several blocks are dealt among them in the order of their hashes.
    numbered = ordered.withColumn("below", below).withColumn("upto", upto)
    within = F.floor(F.col("turn") / float(1 << 63) * (F.col("upto") - F.col("below"))).cast("int")
    last = F.greatest(F.col("upto") - F.col("below") - 1, F.lit(0))
    blocked = numbered.withColumn("block", F.col("below") + F.least(within, last)).select("doc_id", "text", "place", "turn", "block")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (len(bounds) + 1) // 4)
    by_block = Window.partitionBy("block").orderBy("place", "turn", "text")
    inside = blocked.repartition(parts, "block").withColumn("after", F.lead(F.struct("text")).over(by_block))
    heads = blocked.groupBy("block").agg(F.min(F.struct("place", "turn", "text")).alias("head")).select("block", F.col("head.text").alias("head"))
    # One row per block, without texts.
    around = Window.orderBy("block")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    followed = blocked.select("block").distinct().select(F.col("block").alias("at"), F.coalesce(F.lead("block").over(around), F.min("block").over(whole)).alias("block"))
    after = followed.join(heads, "block").select(F.col("at").alias("block"), "head")
    joined = inside.join(after, "block", "left")
    return joined.select("doc_id", "text", F.when(F.col("after").isNull(), F.col("head")).otherwise(F.col("after.text")).alias("next_text"))


def edited_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Fingerprints of each text, of its edited text, their likeness and the next document's, and where they differ.

    The edited text has the last floor(n / 2) code points replaced by as many, or all, of
    the next document's first.
    """
    half = "cast(floor(char_length(text) / 2) as int)"
    rows = with_next(documents(docs, id_col, text_col), block_bytes).withColumn(
        "edited", F.concat(F.expr(f"substring(text, 1, char_length(text) - {half})"), F.expr(f"substring(next_text, 1, {half})"))
    )
    prints = rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        fingerprint(F.col("next_text")).alias("next_fingerprint"),
    )
    return prints.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.array_join(differing(F.col("fingerprint"), F.col("edited_fingerprint")), ",").alias("edited_places"),
    )
