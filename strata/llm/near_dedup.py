"""Near-duplicate documents by b-bit MinHash.

1. One pass gives each document its shingle-set size, a 128-bit key of the
   whole set, 32 band keys (4 minima each) and a signature of the low 4 bits
   of 128 minima, packed into 8 longs.
2. Documents with equal sets collapse to one class, so copies never meet.
3. Band buckets propose pairs; XOR and bit counts of two signatures estimate
   their similarity, corrected for chance equality of low bits; pairs whose
   estimate lies more than four standard errors below the threshold go.
4. Surviving pairs are confirmed on the full sets, and components follow.

A bucket is never expanded into all its pairs. First each class meets only
the bucket pivot (least or greatest member) it resembles most. After that, a
bucket whose members all carry one component is finished. In the others,
members outside the bucket's main component meet four pivots of that
component, twice with new components; only what is still outside then meets
every member of another component that the estimate leaves and that an exact
bound allows: of n shingles, u occur in no other open document, so two sets
share at most min(n - u, m - v). A document with many edits of its own is
so ruled out against a whole group of near copies at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm import caches
from strata.llm.components import connected_components
from strata.llm.store import keep_keys, materialize, ship
from strata.llm.text import mix, shingle_set

BANDS, ROWS, LOW_BITS = 32, 4, 4
MINIMA = BANDS * ROWS
WORDS64 = MINIMA * LOW_BITS // 64
PERCENT = 75
# Four standard errors of the estimate at similarity 0.75 over 128 minima are 0.16.
ESTIMATE_SLACK = 0.17

_rng = np.random.default_rng(20240601)
_MUL = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)
_BAND_MUL = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SIGNATURE_SCHEMA = "doc_id long, n_shingles long, set_key binary, bands array<long>, sig array<long>"


def minima(s: np.ndarray) -> np.ndarray:
    """The 128 minima of a non-empty shingle set, in blocks of bounded memory."""
    low = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 512):
        np.minimum(low, (s[i : i + 512, None] * _MUL + _ADD).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    per_band = (low.reshape(BANDS, ROWS) * _BAND_MUL).sum(axis=1, dtype=np.uint64)
    return mix(per_band + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def pack(low: np.ndarray) -> np.ndarray:
    """Low 4 bits of each minimum (taken from its high half, the mixed one), 16 to a long."""
    nibbles = ((low >> np.uint64(40)) & np.uint64(15)).reshape(WORDS64, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    caches.enter("near_dedup")
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            sizes, keys, bands, sigs = [], [], [], []
            for text in part.column(1).cast(pa.binary()).to_pylist():
                s = shingle_set(text)
                sizes.append(len(s))
                if len(s):
                    low = minima(s)
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    bands.append(band_keys(low).view(np.int64))
                    sigs.append(pack(low).view(np.int64))
                else:
                    keys.append(None)
                    bands.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sigs, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_key", "bands", "sig"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            sets = [shingle_set(t).view(np.int64) for t in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("sa"), batch.column("sb")
            keep = []
            for i in range(batch.num_rows):
                x, y = (c[i].values.to_numpy().view(np.uint64) for c in (a, b))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _floor(percent: int) -> float:
    return percent / 100.0 - ESTIMATE_SLACK


def estimate(a: str, b: str) -> Column:
    """Similarity of two packed signatures: equal nibbles, less chance equality."""
    differing = F.lit(0)
    for i in range(WORDS64):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        differing = differing + F.bit_count(x)
    chance = 1.0 / (1 << LOW_BITS)
    return (F.lit(1.0) - differing / F.lit(float(MINIMA)) - F.lit(chance)) / F.lit(1.0 - chance)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.select("a", "b").distinct().join(left, "a").join(right, "b").mapInArrow(_confirm(percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| on their
    sets of distinct 5-word shingles (fewer words: the whole sequence).
    Null or wordless texts have an empty set and link with nothing. Rows that
    share an id are one document, linked by each of their texts. A row with a null id is never linked: its
    component is null and it is kept. Other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    floor = _floor(percent)
    signed = materialize(docs.mapInArrow(_sign, SIGNATURE_SCHEMA), "signatures")
    usable = signed.filter("set_key is not null and doc_id is not null")
    # One node per distinct set, named by its least document.
    classes = materialize(
        usable.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes"
    )
    rows = classes.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot != last")
    members = materialize(rows.join(shared, "key"), "members")
    sigs = classes.select("node", "sig", "bands")

    def with_sig(df: DataFrame, node: str, name: str) -> DataFrame:
        return df.join(sigs.select(F.col("node").alias(node), F.col("sig").alias(name)), node)

    candidates = members.select(F.col("node").alias("a"), F.explode(F.array("pivot", "last")).alias("b")).filter("a != b").distinct()
    scored = with_sig(with_sig(candidates, "a", "ga"), "b", "gb").select("a", "b", estimate("ga", "gb").alias("e")).filter(F.col("e") >= floor)
    first = scored.groupBy("a").agg(F.max_by("b", F.struct("e", "b")).alias("b"))
    sets = materialize(keep_keys(docs, members.select(F.col("node").alias("doc_id")), "doc_id").mapInArrow(_sets, "node long, shingles array<long>"), "sets")
    links = materialize(_verified(first, sets, percent).unionByName(_own_texts(signed, classes)), "links")
    found = connected_components(links)
    for every in (False, False, True):
        new = materialize(_across(members, found, sigs, sets, percent, every), "links")
        if new.isEmpty():
            continue
        links = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new)
        found = connected_components(links)
    of_class = classes.select("set_key", "node").join(found, "node", "left").select(
        "set_key", F.coalesce("component", "node").alias("c0")
    )
    full = signed.filter("set_key is not null").select("doc_id", "n_shingles", "set_key").join(of_class, "set_key").select("doc_id", "n_shingles", "c0")
    # A row without words goes with its document's other texts, if there are any.
    empty = signed.filter("set_key is null").select("doc_id", "n_shingles")
    empty = empty.join(found.select(F.col("node").alias("doc_id"), F.col("component").alias("c0")), "doc_id", "left")
    joined = full.unionByName(empty)
    return joined.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("c0", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("c0", "doc_id"), F.lit(True)).alias("kept"),
    )


def _own_texts(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): documents with rows of different sets, linked with the class of each.

    The document itself is the node between them; it is no less than the least
    document of any of its classes.
    """
    key = F.col("set_key")
    several = signed.filter("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(key).alias("n"), F.count("*").alias("rows"))
    several = several.filter((F.col("lo") != F.col("hi")) | ((F.col("n") > 0) & (F.col("n") < F.col("rows")))).select("doc_id")
    rows = signed.filter("set_key is not null").select("doc_id", "set_key").join(several, "doc_id", "left_semi").distinct()
    return rows.join(classes.select("set_key", "node"), "set_key").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))


def _across(members: DataFrame, found: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int, every: bool) -> DataFrame:
    """Confirmed links (a, b) between two components that meet in a bucket.

    ``a`` is outside the bucket's main (largest) component. Without ``every``,
    it meets four pivots of that component in each bucket, and the one most
    like it in each component is confirmed. With ``every``, it meets all
    members of other components, and the join itself holds the estimate and
    the full sets against each other, so that only links leave it.
    """
    at = members.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    at = materialize(at, "labelled")
    parts = at.groupBy("key", "c").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    rest = materialize(at.join(main.select("key", "main"), "key").join(sigs, "node").select("key", "node", "c", "main", "sig", "bands"), "open")
    floor = _floor(percent)
    if every:
        full = rest.join(_able(rest, sets, percent), "node")
        outside = full.filter("c != main").select("key", F.col("node").alias("a"), F.col("c").alias("ca"), F.col("sig").alias("ga"), F.col("bands").alias("ba"), F.col("shingles").alias("sa"), F.col("common").alias("xa"))
        others = full.select(F.col("key").alias("kb"), F.col("node").alias("b"), F.col("c").alias("cb"), F.col("main").alias("mb"), F.col("sig").alias("gb"), F.col("bands").alias("bb"), F.col("shingles").alias("sb"), F.col("common").alias("xb"))
        # Two outsiders would meet twice: the larger id asks.
        asks = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("mb")) | (F.col("a") > F.col("b")))

        def enough(both: Column) -> Column:
            return 100 * both >= percent * (F.size("sa") + F.size("sb") - both)

        # A pair that shares several buckets is looked at in one of them.
        once = F.array_min(F.array_intersect("ba", "bb")) == F.col("key")
        linked = enough(F.least("xa", "xb")) & (estimate("ga", "gb") >= floor) & once & enough(F.size(F.array_intersect("sa", "sb")))
        return outside.join(others, (F.col("key") == F.col("kb")) & asks & linked).select("a", "b").distinct()
    outside = rest.filter("c != main").select("key", F.col("node").alias("a"), F.col("sig").alias("ga"))
    order = F.xxhash64("key", "node")
    pivots = rest.filter("c = main").groupBy("key", F.col("main").alias("cb")).agg(
        F.array_distinct(F.array(F.min("node"), F.max("node"), F.min_by("node", order), F.max_by("node", order))).alias("pivots")
    )
    pairs = outside.join(pivots, "key").select("a", "ga", "cb", F.explode("pivots").alias("b")).distinct()
    scored = pairs.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("gb")), "b").select("a", "b", "cb", estimate("ga", "gb").alias("e"))
    best = scored.filter(F.col("e") >= floor).groupBy("a", "cb").agg(F.max_by("b", F.struct("e", "b")).alias("b"))
    return _verified(best, sets, percent)


def _able(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, shingles, common) of the open nodes that can still link with another one.

    ``common``: how many of its shingles some other open node has too.
    """
    own = materialize(sets.join(rest.select("node").distinct(), "node", "left_semi").withColumn("set", F.xxhash64("shingles")).dropDuplicates(["node", "set"]), "opensets")
    holders = own.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    alone = holders.filter("node = last").groupBy("node").agg(F.count("*").alias("alone"))
    # What a document with several sets has for itself is not counted off any of them.
    single = own.groupBy("node").count().filter(F.col("count") == 1).select("node")
    alone = alone.join(single, "node", "left_semi")
    common = (F.size("shingles") - F.coalesce("alone", F.lit(0))).alias("common")
    return own.join(alone, "node", "left").select("node", "shingles", common).filter(100 * F.col("common") >= percent * F.size("shingles"))
