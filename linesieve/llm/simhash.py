"""SimHash near-duplicates by covering locality-sensitive hashing.

A mask for every non-zero vector of radius + 1 bits: bit i of a fingerprint belongs to the mask
of v if v and the vector dealt to bit i have an odd product. The bits in which two fingerprints
within the radius differ leave a vector orthogonal to all of them, so the pair agrees under that
vector's mask: no pair is missed. A bucket is one mask and the fingerprint's bits under it.
"""

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesieve.llm.common import fresh, map_texts, saved

SHINGLE = 3
RADIUS = 2
SEED = 42
BITS = 64
#: Hashes whose bits are counted at once.
COUNTED = 1 << 13


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of one text, unsigned: A-Z lowered, word shingles with repeats, a bit set in over half the hashes."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        hashes = digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-shingle].tolist()]
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(rows), COUNTED):
        counts += np.unpackbits(rows[at:at + COUNTED], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(rows)).tobytes(), "big")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius + 1) - 1 masks, one of which any ``radius`` bits miss entirely.

    Bits get the non-zero vectors in turn, so every mask keeps more than half of the bits.
    """
    vectors = range(1, 1 << (radius + 1))
    dealt = [1 + i % len(vectors) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(dealt) if (m & v).bit_count() % 2) for v in vectors]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` and ``fp``, the fingerprint as a signed long, of every row; null and empty texts have 0."""
    return map_texts(docs, lambda texts: [[signed(fingerprint(t, shingle)) for t in texts]], "fp long", text, keep)


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b), a < b, that connect all distinct fingerprints ``fp`` within ``radius`` bits, directly or by steps.

    Rows share a bucket if they agree under a mask. What differs then lies outside the mask. Two
    members within the radius have a midpoint, at most half the radius from either;
    each member of a shared bucket therefore names the points that it reaches by flipping so many
    bits outside the mask, and members that name one point are linked to the smallest of them. A
    named point has few members, however many share the bucket, and no pairs are listed. The
    radius must be even: all members of a point are then within it.
    """
    if radius % 2:
        raise ValueError("the radius must be even: a midpoint is then equally far from both ends")
    masks = covering_masks(radius)
    tables = F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.lit(signed(m)).alias("bits")) for k, m in enumerate(masks)]))
    spread = fps.select("fp", tables.alias("t")).select("fp", "t.mask", F.col("fp").bitwiseAND(F.col("t.bits")).alias("bucket"))
    counts = spread.groupBy("mask", "bucket").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high")
    shared = spread.join(counts.select("mask", "bucket"), ["mask", "bucket"])
    flips = [[signed(sum(1 << i for i in some)) for k in range(radius // 2 + 1)
              for some in combinations([i for i in range(BITS) if not m >> i & 1], k)] for m in masks]
    by_mask = F.array(*[F.array(*[F.lit(x) for x in own]) for own in flips])
    points = shared.select("fp", F.explode(F.transform(F.element_at(by_mask, F.col("mask") + 1),
                                                       lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    stars = points.groupBy("point").agg(F.collect_set("fp").alias("near")).filter(F.size("near") > 1)
    return (stars.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).filter("a < b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for the nodes of ``edges`` (a, b).

    Alternates large-star and small-star steps, which end in stars around the smallest nodes after
    few rounds. Each round is written to the shared folder; hubs are joined on a partial minimum.
    """
    state, before = saved(edges.select("a", "b").distinct()), None
    while True:
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("low").alias("a"), "b").filter("a < b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))  # u > v
        small = down.groupBy("u").agg(F.min("v").alias("low"))
        joined = down.join(small, "u")
        state = saved(joined.select(F.col("low").alias("a"), F.col("v").alias("b")).filter("a < b")
                      .union(small.select(F.col("low").alias("a"), F.col("u").alias("b"))).distinct())
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return state.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        state.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """doc_id, ``fp`` and ``component_id``, the smallest doc_id that links reach, for every row of ``docs``.

    Texts link at ``radius`` differing bits or fewer; equal texts have equal fingerprints, which
    are compared once. Null and empty texts have fingerprint 0 and link like others. Rows without
    a doc_id keep their place in a component; its id is the smallest that is not null, or null.
    Repeated rows stay. An empty table gives an empty result; other columns take no part.
    """
    prints = saved(fingerprints(docs, shingle, text, [doc_id]).withColumnRenamed(doc_id, "doc_id"))
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    label = rooted.join(names, "root").select("fp", "component_id")
    return prints.join(label, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id, and one of its rows without a doc_id.

    Rows are told apart by doc_id and hashes of the text and of all columns, so rows that share a
    doc_id stand for their own components each. Of rows equal in all columns one stays.
    """
    own = [f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    row, chosen = fresh(docs, "row"), fresh(docs, "chosen")
    keyed = docs.withColumn(row, F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.crc32(F.col("text").cast("binary")).alias("sum"),
                                          F.xxhash64(*own).alias("hash")))
    prints = saved(fingerprints(keyed.select(F.col(row).alias("key"), "text"), shingle, "text", ["key"]))
    found = components(links(saved(prints.select("fp").distinct()), radius)).withColumnRenamed("node", "fp")
    rooted = prints.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = rooted.groupBy("root", "key.unnamed").agg(F.min("key").alias(chosen)).select(chosen)
    kept = keyed.join(best, F.col(row).eqNullSafe(F.col(chosen)), "left_semi")
    return kept.dropDuplicates([row]).select(*[f"`{c}`" for c in docs.columns])
