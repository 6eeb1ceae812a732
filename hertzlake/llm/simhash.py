"""SimHash fingerprints of texts, in DataFrame operations alone.

The words of a text are its terms. Each occurrence votes with its weight, which grows with the word's length, for the bits
that are set in the word's hash, and a fingerprint has the bits that more than half of all weight votes for. The angle between the term vectors
of two texts is about the share of bits in which their fingerprints differ, times pi (Charikar).

Votes are sums by text over exploded words, four bits to a sum. Documents are dealt by ranges of doc_id, so that the
next document is in the same range, and the first one of the range after it visits: texts are shuffled once, and what follows
is worked on in that partition.

Fingerprints within a Hamming radius are found by permuted block tables (Manku et al.): the fingerprint is cut into blocks, of which
BLOCKS - radius must be equal in two that are so near. There is a table for each choice of that many blocks, which come first
in it as the key; rows that meet are compared, and a pair counts in the first of the tables where it meets.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, Scratch

#: Bits of a fingerprint, two halves of 64.
BITS = 128
HALVES = ("hi", "lo")
#: Four sums of 16 bits in one of 64, and two of 32, of which 30 count: a text has under a gigabyte, and its words no more weight than bytes.
LANES = 0x0001_0001_0001_0001
WIDE = 0x0000_FFFF_0000_FFFF
#: Words of a chunk are 1 << CHUNK; their weights, 17 at most, don't reach the sign of 16 bits.
CHUNK = 10
#: Letters that count for a word's weight.
LONG = 16
#: Bytes of text of a range, about, and ranges at most, whose first ids the driver lists.
RANGE_BYTES = 4 << 20
MOST_RANGES = 1 << 16
#: Bits in which fingerprints that count as near differ at most, and blocks of 16 bits.
RADIUS = 6
BLOCKS = 8


def weight(word: Column) -> Column:
    """One, and the square of a word's letters, up to LONG, over 16; none for an empty word."""
    letters = F.least(F.length(word), F.lit(LONG))
    return F.when(letters > 0, F.lit(1) + F.shiftright(letters * letters, 4)).otherwise(F.lit(0)).cast("long")


def words_of(text: Column) -> Column:
    r"""The runs of `[^\x20\x09-\x0D]`, and maybe empty ones between; texts with blanks other than spaces and line feeds need a pattern."""
    rare = reduce(Column.__or__, (F.contains(text, F.lit(c)) for c in BLANKS if c not in " \n"))
    return F.when(rare, F.split(text, f"[{BLANKS}]+", -1)).otherwise(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ", -1))


def _decided(half: str) -> Column:
    """64 bits as a long: those with more than half of the weight.

    A sum has two of 32 bits, for bits p and p + 32: one of them over half of the weight reaches its bit 30 when what lacks to that is added.
    """
    over = "(shiftright({c} + ((1L << 30) - 1 - shiftright(weight, 1)) * {ones}, 30) & {ones})"
    bits = [f"shiftleft({over.format(c=f'{half}{k}_{odd}', ones=f'{(1 << 32) + 1}L')}, {k + 16 * odd})" for k in range(16) for odd in (0, 1)]
    return F.expr(" | ".join(bits))


def fingerprinted(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side, hi, lo: the fingerprints of the texts that pieces (keys, sides, text) add up to.

    sides is an array of the sides whose texts a piece, of whole words, belongs to; there is a row at most for each keys and sides. A text without words has
    no bits. Votes are summed by chunks of words in 16 bits each, then by text in 32. No shuffle where pieces are partitioned by some of the keys.
    """
    own = [*keys, "sides", "chunk"]
    words = pieces.select(*keys, "sides", F.posexplode(words_of(F.col("text"))).alias("place", "word"))
    hashed = words.select(
        *keys, "sides", F.shiftright("place", CHUNK).alias("chunk"), weight(F.col("word")).alias("weight"), F.xxhash64("word").alias("hi"), F.xxhash64(F.lit(7), "word").alias("lo")
    )
    lanes = [(half, k) for half in HALVES for k in range(16)]
    votes = [F.expr(f"sum((shiftrightunsigned({half}, {k}) & {LANES}L) * weight) AS {half}{k}") for half, k in lanes]
    chunks = hashed.groupBy(*own).agg(F.sum("weight").alias("weight"), *votes).withColumn("side", F.explode("sides"))
    wide = [F.expr(f"sum(shiftrightunsigned({half}{k}, {16 * odd}) & {WIDE}L) AS {half}{k}_{odd}") for half, k in lanes for odd in (0, 1)]
    whole = chunks.groupBy(*keys, "side").agg(F.sum("weight").alias("weight"), *wide)
    return whole.select(*keys, "side", *(_decided(half).alias(half) for half in HALVES))


def fingerprint_text(hi: Column, lo: Column) -> Column:
    """32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def differing(a: str, b: str) -> Column:
    """Bits in which the fingerprints with these prefixes differ."""
    return sum((F.bit_count(F.col(f"{a}{half}").bitwiseXOR(F.col(f"{b}{half}"))) for half in HALVES), F.lit(0))


def likeness(bits: Column) -> Column:
    """The cosine of the angle that so many differing bits stand for, 0 from a right angle on."""
    return F.greatest(F.lit(0.0), F.cos(bits * F.lit(math.pi / BITS)))


def _first_ids(docs: DataFrame) -> list[int]:
    """The first doc_id of each range, ascending: ids of documents, of about equal ranges."""
    ids = docs.filter("doc_id is not null")
    size = ids.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, 1 + size // RANGE_BYTES)
    at = [k / ranges for k in range(1, ranges)]
    edges = sorted(set(ids.agg(F.percentile_approx("doc_id", at, 20 * ranges)).first()[0] or [])) if at else []
    found = ids.groupBy(_range_of(F.col("doc_id"), edges).alias("k")).agg(F.min("doc_id").alias("first"))
    return sorted(row.first for row in found.select("first").collect())


def _listed(ids: list[int]) -> Column:
    """ids as one constant."""
    return F.split(F.lit(",".join(map(str, ids))), ",").cast("array<bigint>")


def _range_of(doc_id: Column, edges: list[int]) -> Column:
    """How many of the ascending edges are not beyond doc_id, by bisection."""
    if not edges:
        return F.lit(0)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(_listed(edges), at + step - 1) <= doc_id, at + step).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, range, at, next: the rows of docs by ranges of doc_id, numbered, with the text of the next document.

    Order is by doc_id, then text; after the last comes the first. A row without a doc_id is its own next one, in a range of its text's hash. The first
    document of the following range comes last in each range, with visits, and has no next there. A null text is empty.
    """
    picked = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    first = _first_ids(picked)
    if not first:
        first = [0]
    own = F.when(F.col("doc_id").isNull(), -F.lit(1) - F.pmod(F.xxhash64("text"), F.lit(MOST_RANGES))).otherwise(_range_of(F.col("doc_id"), first) - 1)
    placed = picked.withColumn("own", own.cast("long"))
    begins = F.get(_listed(first), F.col("own").cast("int")) == F.col("doc_id")
    both = F.when(begins, F.array(F.col("own"), F.pmod(F.col("own") - 1, F.lit(len(first))))).otherwise(F.array("own"))
    visited = placed.select("doc_id", "text", F.posexplode(both).alias("visits", "range")).withColumn("visits", F.col("visits") == 1)
    order = Window.partitionBy("range").orderBy("visits", "doc_id", "text")
    following = F.when(F.col("doc_id").isNull(), F.col("text")).otherwise(F.lead("text").over(order))
    return visited.select("doc_id", "text", "range", "visits", F.row_number().over(order).alias("at"), following.alias("next"))


#: The sides of a document.
TEXT, EDITED = 0, 1


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs (doc_id, text).

    The edited text is the text with the first floor(n_chars / 4) code points of the next document (all, if it has fewer) in place of
    as many at its end. near_edited and near_next are the likeness of the fingerprint to the edited text's and to the next document's. Order, nulls and
    repeats as in with_next; equal texts have equal fingerprints, and texts without words have no bit set; an empty table gives an empty result; other columns are ignored.
    """
    keys = ["range", "at", "visits", "doc_id", "n_chars", "edited_sha256"]
    size = F.col("n_chars").cast("int")
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    placed = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    placed = placed.withColumns({"before": F.substring("text", F.lit(1), size - cut), "after": F.substring("next", F.lit(1), cut)})
    placed = placed.withColumn("edited_sha256", F.when(~F.col("visits"), F.sha2(F.concat("before", "after"), 256)))
    # the words before the last blank that both texts share vote for both
    placed = placed.withColumn("shared", F.regexp_extract("before", rf"(?s)\A(.*[{BLANKS}])?", 1))
    rest = F.substring("before", F.length("shared") + 1, F.length("before"))
    piece = lambda text, *sides: F.struct(F.array(*map(F.lit, sides)).alias("sides"), text.alias("text"))
    own, edited = piece(F.concat(rest, F.substring("text", size - cut + 1, cut)), TEXT), piece(F.concat(rest, F.col("after")), EDITED)
    # of a visitor's only the own text counts
    pieces = F.when(F.col("visits"), F.array(piece(F.col("text"), TEXT))).otherwise(F.array(piece(F.col("shared"), TEXT, EDITED), own, edited))
    found = fingerprinted(placed.select(*keys, F.inline(pieces)), keys)
    sides = [F.max(F.when(F.col("side") == side, F.col(half))).alias(f"{name}{half}") for side, name in ((TEXT, "a_"), (EDITED, "e_")) for half in HALVES]
    rows = found.groupBy(*keys).agg(*sides)
    order = Window.partitionBy("range").orderBy("at")
    follows = lambda half: F.when(F.col("doc_id").isNull(), F.col(f"a_{half}")).otherwise(F.lead(f"a_{half}").over(order))
    rows = rows.withColumns({f"n_{half}": follows(half) for half in HALVES}).filter("not visits")
    text = lambda p: fingerprint_text(F.col(f"{p}hi"), F.col(f"{p}lo"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", text("a_").alias("fingerprint"), text("e_").alias("edited_fingerprint"),
        likeness(differing("a_", "e_")).alias("near_edited"), likeness(differing("a_", "n_")).alias("near_next"),
    )


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, hi, lo of each different row of docs (doc_id, text): texts are fingerprinted where they are."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    return fingerprinted(rows.withColumn("sides", F.array(F.lit(TEXT))), ["doc_id", "row"]).drop("row", "side")


def _block(half: str, k: int) -> Column:
    return F.shiftrightunsigned(half, 16 * k).bitwiseAND(F.lit(0xFFFF))


def _tables(prints: DataFrame, radius: int) -> DataFrame:
    """prints with chosen, upto and key: a row for each choice of BLOCKS - radius blocks, as bits, and the bits up to the last of them."""
    blocks, rows = [_block(half, k) for half in HALVES for k in range(BLOCKS // 2)], []
    for choice in combinations(range(BLOCKS), BLOCKS - radius):
        key = reduce(lambda a, b: F.shiftleft(a, 16).bitwiseOR(b), [blocks[k] for k in choice])
        rows.append(F.struct(F.lit(sum(1 << k for k in choice)).alias("chosen"), F.lit((2 << choice[-1]) - 1).alias("upto"), key.alias("key")))
    return prints.select("*", F.inline(F.array(*rows)))


def near_fingerprints(prints: DataFrame, asked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """hi, lo, n_near of each different row of asked (hi, lo): how many rows of prints (hi, lo, n: so many documents) lie within the radius.

    Equal fingerprints are one row with their number before they meet, so that copies make no pairs. radius is from BLOCKS - 3 to BLOCKS - 1. Empty tables give empty results.
    """
    if not BLOCKS - 3 <= radius < BLOCKS:
        raise ValueError(f"radius must be from {BLOCKS - 3} to {BLOCKS - 1}")
    every = _tables(prints.groupBy("hi", "lo").agg(F.sum("n").alias("n")), radius)
    mine = _tables(asked.select("hi", "lo").distinct(), radius).withColumnsRenamed({half: f"q_{half}" for half in HALVES})
    equal = [_block(f"q_{half}", k) == _block(half, k) for half in HALVES for k in range(BLOCKS // 2)]
    equal = reduce(lambda a, b: a.bitwiseOR(b), (F.when(x, F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(equal)))
    near = mine.join(every, ["chosen", "upto", "key"]).filter(differing("q_", "") <= radius)
    # the first table in which the two meet is that of the first blocks in which they are equal
    near = near.filter(equal.bitwiseAND(F.col("upto")) == F.col("chosen"))
    return near.groupBy(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo")).agg(F.sum("n").alias("n_near"))


def near_documents(docs: DataFrame, asked: Column, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, n_near of the rows of docs (doc_id, text) that asked holds for: how many rows, itself among them, have a fingerprint within the radius."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.stored(document_fingerprints(docs).select("doc_id", *HALVES, asked.alias("asked")), "fingerprints")
    mine = prints.filter("asked")
    near = near_fingerprints(prints.select(*HALVES, F.lit(1).alias("n")), mine, radius)
    found = mine.join(near, [*HALVES]).select("doc_id", fingerprint_text(F.col("hi"), F.col("lo")).alias("fingerprint"), "n_near")
    found = scratch.stored(found, "near")
    scratch.clear(found)
    return found
