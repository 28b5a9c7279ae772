"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

A word is removed if a window of ``WINDOW`` words around it also starts in a
document with a smaller id.

**Blocks.**  A document is cut at anchors: in each stretch of ``HALF`` words the
word with the least hash is one (the first on ties).  Two documents that share a
window share the anchors between the least words of the window's halves, so
they share the block that holds the window's last word of the first half, and
the words that all windows of this block have in common, its *core* (26 words
or more).  Every document is indexed by the cores of its blocks.

**Factors.**  No factors with source and length are formed; grouping blocks
stands for the greedy parse.  A document is read block by block.  A block whose core no smaller
document has is a literal.  One whose core and whole context (all words that its
windows cover) some smaller document has is wholly repeated: its windows are all
duplicates.  Where only the core matches, the text is shared in part, and the
block's windows are checked one by one against the windows of all documents
with that core.  Equal contexts stand for each other there, so copies are
looked at once.

Words are compared by 64-bit hashes of their own; cores, contexts and windows by
pairs of 64-bit polynomial hashes of these.  Hot groups are only ever aggregated
or joined to a row per key.

Defined results: null counts as no words; a document with fewer words than a
window keeps all; rows with the same id don't remove each other's words; a
null id is not smaller than any other and removes or loses nothing; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.llm.tables import kept_in_worker, map_text, text_of, word_runs, written

WINDOW = 50
#: Words of which one is an anchor: half a window.
HALF = WINDOW // 2
#: Odd multipliers of the two polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Powers:
    """Powers of a base and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            n = 2 * n
            one = np.ones(1, dtype=np.uint64)
            self.up = np.concatenate([one, np.cumprod(np.full(n, self.base))])
            self.down = np.concatenate([one, np.cumprod(np.full(n, self.inverse))])
        return self.up, self.down


def _powers() -> list[Powers]:
    return kept_in_worker("polynomial powers", lambda: [Powers(b) for b in BASES])


def word_codes(text: str) -> np.ndarray:
    import xxhash

    code = xxhash.xxh64_intdigest
    parts = [np.fromiter(map(code, run), dtype=np.uint64) for run in word_runs(text.encode("utf-8", "replace"))]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


class Ranges:
    """Hashes of word ranges of a document."""

    def __init__(self, codes: np.ndarray, powers: Powers):
        up, self.down = powers.upto(len(codes))
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(codes * up[: len(codes)])])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return ((self.sums[end] - self.sums[start]) * self.down[start]).view(np.int64)


def anchors(codes: np.ndarray) -> np.ndarray:
    """Places of the first least word of every stretch of ``HALF`` words."""
    stretches = np.lib.stride_tricks.sliding_window_view(codes, HALF)
    return np.unique(stretches.argmin(axis=1) + np.arange(len(stretches)))


def blocks(codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first window, last window, core, context) of each block that has windows."""
    n = len(codes)
    if n < WINDOW:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    at = anchors(codes)
    starts = np.arange(n - WINDOW + 1)
    block = np.searchsorted(at, starts + HALF - 1, side="right") - 1
    first = np.flatnonzero(np.diff(block, prepend=-1))
    last = np.append(first[1:], len(starts)) - 1
    block = block[first]
    one, other = (Ranges(codes, p) for p in _powers())
    core = one.hashes(at[block + 1] - HALF, at[block] + WINDOW - HALF + 1)
    return first, last, core, other.hashes(first, last + WINDOW)


def _blocks_of(docs: DataFrame) -> DataFrame:
    """(id, mark, lo, hi, core, context) of every block."""

    def make():
        import pyarrow as pa

        def work(texts: list[str]):
            found = [blocks(word_codes(t)) for t in texts]
            lo, hi, core, context = (np.concatenate(column) if found else [] for column in zip(*found, strict=True))
            ends = np.cumsum([0, *(len(f[0]) for f in found)])
            fields = [pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(core), pa.array(context)]
            rows = pa.StructArray.from_arrays(fields, names=["lo", "hi", "core", "context"])
            return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rows)]

        return work

    listed = map_text(docs.filter("id is not null"), make, "blocks array<struct<lo:int,hi:int,core:long,context:long>>")
    return listed.select("id", "mark", F.inline("blocks"))


def _bounds(spans) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lo, hi) of each row of a column of span lists; none where it is null."""
    lo, hi = (np.asarray(spans.values.field(f)) for f in ("lo", "hi"))
    at, empty = np.asarray(spans.offsets), np.asarray(spans.is_null())
    for i, null in enumerate(empty):
        start, end = (0, 0) if null else (at[i], at[i + 1])
        yield lo[start:end], hi[start:end]


def _window_hashes(wanted: DataFrame) -> DataFrame:
    """(id, mark, start, h1, h2) of the windows in ``spans`` of each text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            picked, starts, h1, h2 = [], [], [], []
            for row, (lo, hi) in enumerate(_bounds(columns["spans"])):
                codes = word_codes(columns["text"][row].as_py())
                at = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)]))
                one, other = (Ranges(codes, p).hashes(at, at + WINDOW) for p in _powers())
                picked.append(np.full(len(at), row))
                starts.append(at)
                h1.append(one)
                h2.append(other)
            if picked:
                take = pa.array(np.concatenate(picked))
                out = {"id": columns["id"].take(take), "mark": columns["mark"].take(take)}
                out["start"] = pa.array(np.concatenate(starts).astype(np.int32))
                out |= {"h1": pa.array(np.concatenate(h1)), "h2": pa.array(np.concatenate(h2))}
                yield pa.RecordBatch.from_pydict(out)

    kind = wanted.schema["id"].dataType.simpleString()
    return wanted.mapInArrow(run, f"id {kind}, mark long, start int, h1 long, h2 long")


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """(id, mark, lo, hi): word ranges to remove of documents (id, mark, text).

    ``mark`` tells texts of the same id apart.
    """
    parsed = written(_blocks_of(docs))
    shared = (
        parsed.groupBy("core").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    )
    rows = written(parsed.join(shared.drop("last"), "core"))
    # Equal cores and contexts: a 128-bit key of all words the block's windows cover.
    least = rows.groupBy("core", "context").agg(F.min("id").alias("least"))
    rows = written(rows.join(least, ["core", "context"]))
    inside = rows.filter("least < id")
    ends = rows.filter("least = id")
    open_cores = ends.filter("first < id").select("core").distinct()
    checked = ends.join(open_cores, "core", "left_semi").groupBy("id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    windows = written(_window_hashes(docs.join(checked, ["id", "mark"]).select("id", "mark", "text", "spans")))
    smallest = windows.groupBy("h1", "h2").agg(F.min("id").alias("least"))
    crossing = windows.join(smallest, ["h1", "h2"]).filter("least < id")
    return inside.select("id", "mark", "lo", (F.col("hi") + WINDOW).alias("hi")).union(
        crossing.select("id", "mark", "start", F.col("start") + WINDOW)
    )


def _removed(docs: DataFrame, keep_text: bool) -> DataFrame:
    """``docs`` (doc_id, text, spans) with the words in ``spans`` taken out."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, bounds = batch.column(1), _bounds(batch.column(2))
            rows = [_without(t.as_py(), lo, hi, keep_text) for t, (lo, hi) in zip(texts, bounds, strict=True)]
            n, removed, digest, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
            out = {"doc_id": batch.column(0), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
            out["kept_sha256"] = pa.array(digest, pa.string())
            if keep_text:
                out["kept_text"] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return docs.mapInArrow(run, schema)


def _without(text: str, lo: np.ndarray, hi: np.ndarray, keep_text: bool) -> tuple[int, int, str, str]:
    digest, total, kept, first, parts = hashlib.sha256(), 0, 0, True, []
    steps = np.zeros(int(hi.max(initial=0)) + 1, dtype=np.int32)
    np.add.at(steps, lo, 1)
    np.add.at(steps, hi, -1)
    gone = np.cumsum(steps) > 0
    for run in word_runs(text.encode("utf-8", "replace")):
        drop = gone[total : total + len(run)]
        total += len(run)
        if drop.any():
            marks = drop.tolist() + [False] * (len(run) - len(drop))
            run = [w for w, g in zip(run, marks, strict=True) if not g]
        if run:
            line = b" ".join(run)
            digest.update(line if first else b" " + line)
            first = False
            kept += len(run)
            if keep_text:
                parts.append(line)
    return total, total - kept, digest.hexdigest(), b" ".join(parts).decode() if keep_text else ""


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per document: (doc_id, n_words, n_removed, kept_sha256) and, if asked for, kept_text."""
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    spans = duplicate_spans(source).groupBy("id", "mark").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    joined = source.join(spans, ["id", "mark"], "left")
    return _removed(joined.select(F.col("id").alias("doc_id"), "text", "spans"), keep_text)
