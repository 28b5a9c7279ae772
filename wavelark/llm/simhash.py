"""SimHash near-dedup by multi-index hashing.

Fingerprints link when they differ in at most two of 64 bits.  Each is indexed
twice, by its upper and by its lower half.  If two differ in at most two bits,
their upper halves differ in at most one bit or their lower halves are equal;
so the search enumerates the ball of radius one around the upper half and of
radius zero around the lower, fetches what the tables hold there and verifies
the complete distance.  Of a pair whose upper halves differ in one bit, the one
that has the bit set finds the other, so only set bits are flipped.

Only distinct fingerprints are searched; copies share one.  A table entry with
more than ``HOT`` fingerprints is not fetched.  Its fingerprints agree in one
half, so they are keyed again by the other half with every two bits (for
probes from a flipped bit: every bit) masked.  At most four fingerprints share
such a key, at most 66 with their probes, and all of them link.  The result is
the same on either way, and no way makes pairs of a whole group.

Defined results: null or blank texts have fingerprint zero, which links like
any other; fewer words than a shingle are one shingle; repeated rows are rows
of the same component; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.llm.components import components
from wavelark.llm.tables import map_text, text_of, word_runs, written

#: Words in a shingle, seed of its hash, bits that may differ.
WORDS, SEED, RADIUS = 3, 42, 2
#: Fingerprints in a table entry that are compared one by one.
HOT = 64
HALF = (1 << 32) - 1


def fingerprint(text: str, words: int = WORDS) -> int:
    """SimHash of a text as a signed 64-bit integer."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    ones, total, tail = np.zeros(64, dtype=np.int64), 0, []
    for run in word_runs(text.encode("utf-8", "replace").translate(lower)):
        run = tail + run
        shingles = zip(*(run[i:] for i in range(words)), strict=False)
        codes = np.fromiter(map(hashed, map(b" ".join, shingles), repeat(SEED)), dtype="<u8")
        ones += np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(codes)
        tail = run[max(0, len(run) - words + 1) :]
    if not total:
        if not tail:
            return 0
        return int(np.uint64(hashed(b" ".join(tail), SEED)).view(np.int64))
    bits = np.packbits((2 * ones > total).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp) per row."""
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return map_text(source, lambda: lambda texts: [[fingerprint(t, words) for t in texts]], "fp long")


def _upper(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def _lower(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(HALF))


def _one(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def _edge(x: Column, y: Column) -> tuple[Column, Column]:
    return F.greatest(x, y).alias("a"), F.least(x, y).alias("b")


def _clear(value: Column, bits: Column) -> Column:
    return value.bitwiseAND(F.bitwise_not(bits))


def _hot_pairs(matched: DataFrame) -> DataFrame:
    """Links inside entries that hold more than ``HOT`` fingerprints."""
    rest = F.when(F.col("seg") == 0, _lower(F.col("fp"))).otherwise(_upper(F.col("fp")))
    hot = matched.filter("member is null").select("seg", "value", "flip", "fp", rest.alias("rest"))
    two = [(1 << i) | (1 << j) for i in range(32) for j in range(i)]
    inside = (
        hot.filter("not flip")
        .select("seg", "value", "fp", "rest", F.explode(F.array(*map(F.lit, two))).alias("mask"))
        .groupBy("seg", "value", "mask", _clear(F.col("rest"), F.col("mask")).alias("key"))
        .agg(F.sort_array(F.collect_list("fp")).alias("near"))
        .filter("size(near) > 1")
        .select(F.col("near")[0].alias("x"), F.explode("near").alias("y"))
    )
    across = (
        hot.filter("seg = 0")
        .select("value", "flip", "fp", "rest", F.explode(F.array(*(F.lit(1 << i) for i in range(32)))).alias("mask"))
        .groupBy("value", "mask", _clear(F.col("rest"), F.col("mask")).alias("key"))
        .agg(
            F.collect_list(F.when(~F.col("flip"), F.col("fp"))).alias("members"),
            F.collect_list(F.when(F.col("flip"), F.col("fp"))).alias("probes"),
        )
        .filter("size(members) > 0 and size(probes) > 0")
        .select(F.explode("members").alias("x"), "probes")
        .select("x", F.explode("probes").alias("y"))
    )
    pairs = inside.union(across).filter("x <> y and bit_count(x ^ y) <= 2")
    return pairs.select(*_edge(F.col("x"), F.col("y")))


def links(distinct: DataFrame) -> DataFrame:
    """Edges ``a > b`` between distinct fingerprints ``fp`` that connect whatever links.

    Copies of pairs that other edges connect may be missing; components are whole.
    """
    fp = F.col("fp")
    plain = distinct.select("fp", F.lit(0).alias("seg"), _upper(fp).alias("value")).union(
        distinct.select("fp", F.lit(1), _lower(fp))
    )
    flipped = (
        distinct.select("fp", _upper(fp).alias("upper"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
        .select("fp", "upper", _one(F.col("bit")).alias("one"))
        .filter("upper & one <> 0")
        .select("fp", F.lit(0).alias("seg"), (F.col("upper") - F.col("one")).alias("value"))
    )
    counts = plain.groupBy("seg", "value").agg(F.count("*").alias("n"))
    few = plain.join(counts.filter(F.col("n") <= HOT), ["seg", "value"]).select("seg", "value", F.col("fp").alias("member"))
    many = counts.filter(F.col("n") > HOT).select("seg", "value", F.lit(None).cast("long").alias("member"))
    probes = plain.withColumn("flip", F.lit(False)).union(flipped.withColumn("flip", F.lit(True)))
    found = probes.join(few.union(many), ["seg", "value"]).filter(
        f"member is null or (bit_count(fp ^ member) <= {RADIUS} and (flip or fp > member))"
    )
    matched = written(found.select("seg", "value", "flip", "fp", "member"))
    compared = matched.filter("member is not null").select(*_edge(F.col("fp"), F.col("member")))
    return compared.union(_hot_pairs(matched))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id).

    ``component_id`` is the smallest id reachable over links, the row's own
    included; it is null only where all ids of a component are.
    """
    marked = written(fingerprints(docs, id_col, text_col, words))
    distinct = written(marked.groupBy("fp").agg(F.min("id").alias("least")))
    labels = components(links(distinct)).withColumnRenamed("node", "fp")
    named = distinct.join(labels, "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(first, "component").select("fp", "component_id")
    return marked.join(ids, "fp").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
