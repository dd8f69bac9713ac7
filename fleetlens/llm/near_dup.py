"""Near-duplicate groups: circulant MinHash, banding and exact Jaccard similarity."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.texts import (
    byte_words,
    in_pieces,
    joined_by_size,
    mixed,
    small,
    stage_counted,
    word_hashes,
)
from fleetlens.sources.sinks import stage

# Slots of the two permutations. Shingles of one text that share a slot only blur
# the search; links are confirmed on the shingles.
SLOT_BITS = 20
_PERMUTATION_SEED = 20_240_501
_BLOCK = 2048


@dataclass(frozen=True)
class NearDupRules:
    """Shingle width, similarity, and the bands of the signature.

    A pair at similarity ``s`` shares a band with probability
    ``1 - (1 - s^rows)^bands``: at 0.8 all but one pair in eight million with the
    defaults. ``few`` is how many members of a star may have a shingle that is looked up
    rather than counted; it moves work, not results.
    """

    width: int = 2
    min_percent: int = 80
    bands: int = 40
    rows: int = 5
    few: int = 16


def shingles(text: str, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; A-Z count as a-z.

    A text with fewer words than a shingle is one shingle, one without words none.
    """
    words = word_hashes(byte_words(text.encode().lower()))
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    hashed = np.full(n, width, np.uint64)
    for shift in range(width):
        hashed = mixed(hashed + words[shift : shift + n])
    return np.unique(hashed)


@cache
def _shifted(size: int) -> np.ndarray:
    """Row i holds the second permutation's values at slots i, i+1, ... i+size-1, circularly."""
    values = np.random.default_rng(_PERMUTATION_SEED).permutation(1 << SLOT_BITS).astype(np.uint32)
    around = np.concatenate([values, values[: size - 1]])
    return np.lib.stride_tricks.sliding_window_view(around, size)


def signature(hashed: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least second-permutation value, shifted by k.

    The first permutation sends a shingle to a slot: the hash is a bijection of
    64-bit values, of which the top bits are the slot.
    """
    slots = (hashed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    least = np.full(size, np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(slots), _BLOCK):
        np.minimum(least, _shifted(size)[slots[start : start + _BLOCK]].min(axis=0), out=least)
    return least


def band_hashes(hashed: np.ndarray, rules: NearDupRules) -> np.ndarray:
    """One value per band; equal only if all rows of the band are equal."""
    rows = signature(hashed, rules.bands * rules.rows).reshape(rules.bands, rules.rows)
    value = np.arange(1, rules.bands + 1, dtype=np.uint64)
    for column in rows.T:
        value = mixed(value + column)
    return value.view(np.int64)


def _signed(docs: DataFrame, rules: NearDupRules) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) of every text."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, keys, bands = [], [], []
        for text in batch.column("text").to_pylist():
            hashed = shingles(text or "", rules.width)
            sizes.append(len(hashed))
            keys.append(xxhash.xxh3_128_digest(hashed.tobytes()) if len(hashed) else None)
            bands.append(band_hashes(hashed, rules) if len(hashed) else None)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_shingles", "set_key", "bands"],
        )

    schema = "doc_id BIGINT, n_shingles BIGINT, set_key BINARY, bands ARRAY<BIGINT>"
    columns = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return in_pieces(columns, sign, schema)


def _sets(docs: DataFrame, classes: DataFrame, n_classes: int, rules: NearDupRules) -> DataFrame:
    """(id, shingles) of the given classes (node, id, set_key), with the node as id."""

    def gather(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(text or "", rules.width) for text in batch.column("text").to_pylist()]
        keys = [xxhash.xxh3_128_digest(hashed.tobytes()) for hashed in sets]
        lists = pa.array([hashed.view(np.int64) for hashed in sets], pa.list_(pa.int64()))
        columns = [batch.column("id"), pa.array(keys, pa.binary()), lists]
        return pa.RecordBatch.from_arrays(columns, names=["id", "set_key", "shingles"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string"))
    wanted = texts.join(small(classes.select("id").distinct(), n_classes), "id", "left_semi")
    # An id may name several texts; the key tells the one that stands for the class.
    found = in_pieces(wanted, gather, "id BIGINT, set_key BINARY, shingles ARRAY<BIGINT>")
    once = found.dropDuplicates(["id", "set_key"])
    return once.join(classes, ["id", "set_key"]).select(F.col("node").alias("id"), "shingles")


def _compared(pairs: DataFrame, sets: DataFrame, rules: NearDupRules) -> DataFrame:
    """The pairs (a, b) with sizes, shared shingles, those of b outside a, and the verdict."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("t"))
    shared = F.size(F.array_intersect("s", "t"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", F.size("s").alias("n_a"), F.size("t").alias("n_b"), shared.alias("shared"), "s", "t")
        .select(
            "a",
            "b",
            "n_b",
            "shared",
            F.array_except("t", "s").alias("outside"),
            F.expr(f"100 * shared >= {rules.min_percent} * (n_a + n_b - shared)").alias("linked"),
        )
    )


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b), for linked ids.

    Each round links every id to the least of its neighbours, first for its larger
    neighbours, then for its smaller ones. Rounds grow with the logarithm of the
    longest path. Each is staged; only its number of changes reaches the driver.
    """

    def both_ways(edges: DataFrame) -> DataFrame:
        return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def least(edges: DataFrame) -> DataFrame:
        return edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))

    edges, n = stage_counted(links.filter("a <> b").distinct(), name)
    total = None
    while n:
        around = both_ways(edges)
        large = (
            around.join(least(around), "a")
            .filter("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        down = large.filter("a <> b").distinct()
        near = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(near, "a")
        small_star = (
            joined.select("a", F.col("m").alias("b"))
            .union(joined.select(F.col("b").alias("a"), F.col("m").alias("b")))
            .filter("a <> b")
            .distinct()
        )
        edges, n = stage_counted(small_star, name)
        state = edges.agg(F.bit_xor(F.xxhash64("a", "b")), F.count("*")).first()
        if state == total:
            break
        total = state
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _own_shingles(sets: DataFrame) -> DataFrame:
    """(id, own): how many shingles of a set no other set has."""
    single = (
        sets.select("id", F.explode("shingles").alias("shingle"))
        .groupBy("shingle")
        .agg(F.count("*").alias("n"), F.min("id").alias("id"))
        .filter("n = 1")
    )
    return single.groupBy("id").agg(F.count("*").alias("own"))


def _open_pairs(stars: DataFrame, labels: DataFrame, rules: NearDupRules) -> DataFrame:
    """Pairs (a, b) of a star that may be linked and are not in one component.

    ``stars`` holds every member b of a star with its comparison with the centre a. Two
    members share at most what both share with the centre, plus what both have outside
    it. Of that, shingles that few members have are looked up: pairs that share one
    are taken. For other pairs only shingles of many members count. A pair is left out
    only if it shares too little even so; none that is similar enough is.
    """
    of_centre = labels.select(F.col("id").alias("a"), F.col("component").alias("of_centre"))
    of_member = labels.select(F.col("id").alias("b"), F.col("component").alias("of_member"))
    members = (
        stars.join(of_centre, "a", "left")
        .join(of_member, "b", "left")
        .withColumn("component", F.coalesce("of_member", "b"))
        .withColumn("is_open", F.col("component") != F.coalesce("of_centre", "a"))
    )
    mixed_stars = members.filter("is_open").select("a").distinct()
    rest = members.join(mixed_stars, "a", "left_semi").select(
        "a", "b", "component", "is_open", "n_b", "shared", "outside"
    )
    outside = rest.select("a", "b", "component", "is_open", F.explode("outside").alias("shingle"))
    seen = outside.groupBy("a", "shingle").agg(F.count("*").alias("n_seen")).filter("n_seen > 1")
    known = outside.join(seen, ["a", "shingle"])
    frequent = (
        known.filter(F.col("n_seen") > rules.few)
        .groupBy("a", "b")
        .agg(F.count("*").alias("n_frequent"))
    )
    sized = rest.drop("outside").join(frequent, ["a", "b"], "left").na.fill(0, ["n_frequent"])

    def both(frame: DataFrame, on: list[str], condition: str) -> DataFrame:
        other = frame.select(*on, *(F.col(c).alias(f"y_{c}") for c in frame.columns if c not in on))
        apart = "is_open AND (NOT y_is_open OR b < y_b) AND component <> y_component"
        return (
            frame.filter("is_open")
            .join(other, on)
            .filter(f"{apart} AND {condition}")
            .select(F.least("b", "y_b").alias("a"), F.greatest("b", "y_b").alias("b"))
        )

    enough = (
        f"{100 + rules.min_percent} * (least(shared, y_shared) + least(n_frequent, y_n_frequent)) "
        f">= {rules.min_percent} * (n_b + y_n_b)"
    )
    rare = known.filter(F.col("n_seen") <= rules.few).drop("n_seen")
    return both(sized, ["a"], enough).union(both(rare, ["a", "shingle"], "true")).distinct()


def near_duplicates(docs: DataFrame, rules: NearDupRules = NearDupRules()) -> DataFrame:
    """The near-duplicate group of every document.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable over
    links, itself included) and kept (doc_id = component_id).

    1. Texts with equal shingle sets form a class, whose smallest id stands for it.
    2. Classes that share a band meet in its bucket. The class with the smallest share of
       shingles of its own becomes the centre, and all others are compared with it.
       A bucket of thousands of near copies thus costs a comparison per member.
    3. Pairs of a bucket that this leaves in different components are compared too, but
       for those that share too little by what both share with the centre. So no link
       that joins two components is lost.

    A null or empty text has no shingles and is linked with nothing. Repeated rows stay
    and share their group. An id may name several texts: each is linked on its own. A null id only
    joins the class of its text. Building it stages signatures, classes, buckets and links.
    """
    signed, n_rows = stage_counted(_signed(docs, rules), "near-dup-signatures")
    named = signed.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = named.groupBy("set_key").agg(
        F.min("doc_id").alias("id"), F.count("*").alias("n"), F.first("bands").alias("bands")
    )
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "near-dup-classes")
    members = classes.select(F.col("node").alias("id"), F.explode("bands").alias("bucket"))
    shared = (
        members.groupBy("bucket")
        .agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
        .filter("lo < hi")
        .select("bucket")
    )
    buckets = stage(members.join(shared, "bucket").select("bucket", "id"), "near-dup-buckets")
    nodes = buckets.select(F.col("id").alias("node")).distinct()
    alike, n_alike = stage_counted(
        classes.select("node", "id", "set_key").join(nodes, "node"), "near-dup-alike"
    )
    sets = stage(_sets(docs, alike, n_alike, rules), "near-dup-sets")

    sizes = sets.select("id", F.size("shingles").alias("n")).join(_own_shingles(sets), "id", "left")
    share = sizes.select("id", (F.coalesce("own", F.lit(0)) / F.col("n")).alias("share"))
    ranked = stage(buckets.join(share, "id"), "near-dup-ranked")
    centres = ranked.groupBy("bucket").agg(F.min(F.struct("share", "id")).alias("centre"))
    spokes = (
        ranked.join(centres, "bucket")
        .select(F.col("centre.id").alias("a"), F.col("id").alias("b"))
        .filter("a <> b")
        .distinct()
    )
    stars = stage(_compared(spokes, sets, rules), "near-dup-stars")
    links = stars.filter("linked").select("a", "b")
    open_pairs, n_open = stage_counted(
        _open_pairs(stars, components(links), rules), "near-dup-open"
    )
    if n_open:
        more = _compared(open_pairs, sets, rules).filter("linked").select("a", "b")
        links = links.union(stage(more, "near-dup-links"))

    labelled = stage(_labelled(classes, components(links)), "near-dup-labels")
    keyed = signed.select("doc_id", "n_shingles", "set_key")
    classed = joined_by_size(
        keyed.filter("set_key IS NOT NULL"), labelled, ["set_key"], "n", n_rows, "left"
    ).unionByName(keyed.filter("set_key IS NULL"), allowMissingColumns=True)
    component = F.coalesce("label", "doc_id")
    return classed.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), component.isNull()).alias("kept"),
    )


def _labelled(classes: DataFrame, reached: DataFrame) -> DataFrame:
    """(set_key, n, label): the smallest doc_id that each class reaches over links.

    ``reached`` holds (id, component), nodes both, of every linked node but the smallest.
    """
    ids = classes.select("node", "id")
    linked = reached.select(F.col("id").alias("node"), "component").union(
        reached.select(F.col("component").alias("node"), "component").distinct()
    )
    linked, n_linked = stage_counted(linked.join(ids, "node"), "near-dup-linked")
    labels = linked.groupBy("component").agg(F.min("id").alias("label"), F.count("*").alias("size"))
    of_nodes = joined_by_size(
        linked.select("node", "component"), labels, ["component"], "size", n_linked
    ).select("node", "label")
    return classes.join(of_nodes, "node", "left").select(
        "set_key", "n", F.coalesce("label", "id").alias("label")
    )


def deduplicated(docs: DataFrame, rules: NearDupRules = NearDupRules()) -> DataFrame:
    """One row of each group, with all its columns: of the row whose id is the group's smallest.

    Rows without words are kept, as are rows with a null id. Repeated rows with the kept
    id all stay: an id names one document.
    """
    found = near_duplicates(docs, rules).filter("NOT kept")
    gone, n = stage_counted(found.select(F.col("doc_id").alias("gone_id")).distinct(), "near-dup-gone")
    return docs.join(small(gone, n), F.col("doc_id") == F.col("gone_id"), "left_anti")
