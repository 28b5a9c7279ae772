"""Token counts by overlap resynchronisation.

A document of more than ``CHUNK`` characters is cut into chunks that overlap.
The chunks are dealt to all tasks and encoded with offsets; where two overlap,
the counts are spliced at a common stable boundary: a place where something
other than white space meets white space, where both encodings start a token
and from which both hold the same tokens up to the next such place.  Every
match of a byte-level pattern ends where white space begins, and no match looks
back, so from there on both encodings are the document's own.  An overlap is
widened until it holds such places, to the end of the document if need be; if
a pair of chunks still doesn't align, long documents are cut again with overlaps
four times as wide.

Shorter documents are one chunk.  Their stretches between stable boundaries
repeat, so the library encodes each once and its count is kept, in bounded room.

Defined results: null counts as empty, an empty text has no tokens, repeated
rows are rows, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.llm.tables import Memo, kept_in_worker, map_text, shuffle_parts, slices, text_of, written

#: Characters of a chunk, and of the overlap before widening.
CHUNK, OVERLAP = 1 << 16, 1 << 9
#: Counts a worker keeps, twice as many at most.
KEPT = 250_000
#: Stable boundaries an overlap should hold.
BORDERS = 4

#: White space and what follows up to the next white space; 1C-1F are white space to Python only.
STRETCH = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
BORDER = re.compile(r"[\S\x1c-\x1f](?=[^\S\x1c-\x1f])")

_PLACES = "array<struct<place:long,before:long,mark:long>>"


def _tokenizer(path: str):
    """The library's tokenizer on one thread: Spark's tasks are the parallel part."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return kept_in_worker(("tokenizer", path), lambda: Tokenizer.from_file(path))


def _short(docs: DataFrame, path: str) -> DataFrame:
    def make():
        tokenizer = _tokenizer(path)

        def encode(stretches: list[str]) -> list[int]:
            return list(map(len, tokenizer.encode_batch_fast(stretches, add_special_tokens=False)))

        memo = kept_in_worker(("counts", path), lambda: Memo(KEPT, encode))

        def count(text: str) -> int:
            return sum(sum(memo.values(STRETCH.findall(text, *s))) for s in slices(text, BORDER))

        return lambda texts: [list(map(count, texts))]

    return map_text(docs.select("doc_id", "n_bytes", "text"), make, "n_tokens long")


def cuts(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of chunks; each overlap is widened until it holds enough stable boundaries."""
    start, n = 0, len(text)
    while True:
        nxt, width = start + chunk, overlap
        while nxt + width < n and sum(1 for _ in BORDER.finditer(text, nxt, nxt + width)) < BORDERS:
            width *= 2
        if nxt + width >= n:
            yield start, n
            return
        yield start, nxt + width
        start = nxt


def _boundaries(text: str, start: int, found, low: int, high: int) -> list[dict]:
    """Stable boundaries in text[low:high]: place, tokens before it and a mark of those up to the next.

    The boundary that ends the last mark is not listed itself.
    """
    begins = {}
    for number, (at, _) in enumerate(found.offsets):
        begins.setdefault(at, number)
    places = [m.end() for m in BORDER.finditer(text, low, high)]
    places = [p for p in places if p in begins]
    return [
        {
            "place": start + p,
            "before": begins[p],
            "mark": crc32(",".join(map(str, found.ids[begins[p] : begins[q]])).encode()),
        }
        for p, q in zip(places, places[1:], strict=False)
    ]


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks as rows; ``head`` and ``tail`` are the lengths of their overlaps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d in batch.itertuples(index=False):
                spans = list(cuts(d.text, chunk, overlap))
                for i, (start, end) in enumerate(spans):
                    head = spans[i - 1][1] - start if i else 0
                    tail = end - spans[i + 1][0] if i + 1 < len(spans) else 0
                    piece = (d.row, d.doc_id, d.n_bytes, start, d.text[start:end], head, tail)
                    yield pd.DataFrame([piece], columns=["row", "doc_id", "n_bytes", "at", "piece", "head", "tail"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("row", "doc_id", "n_bytes", "text").mapInPandas(
        run, f"row long, doc_id {kind}, n_bytes long, at long, piece string, head long, tail long"
    )
    return pieces.repartition(shuffle_parts(docs.sparkSession), "row", "at")


def _encode(chunks: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            for r in batch.itertuples(index=False):
                found = tokenizer.encode(r.piece, add_special_tokens=False)
                n = len(r.piece)
                # The first place of a chunk is no boundary: what comes before it is not seen.
                head = _boundaries(r.piece, r.at, found, 0, r.head) if r.head else []
                tail = _boundaries(r.piece, r.at, found, n - r.tail, n) if r.tail else []
                out = (r.row, r.doc_id, r.n_bytes, r.at, not r.head, not r.tail, len(found.ids), head, tail)
                yield pd.DataFrame([out], columns=names)

    kind = chunks.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_bytes long, at long, first boolean, last boolean, n_tokens long, head {_PLACES}, tail {_PLACES}"
    names = [part.split()[0] for part in schema.split(", ")]
    return chunks.mapInPandas(run, schema)


def _spliced(encoded: DataFrame, chunk: int) -> DataFrame:
    """(row, n_tokens, odd, doc) per document; odd where two chunks don't align."""
    left = encoded.filter("not last").select("row", (F.col("at") + chunk).alias("at"), "tail")
    right = encoded.filter("not first").select("row", "at", "head")
    same = F.filter(
        "tail", lambda t: F.exists("head", lambda h: (h.place == t.place) & (h.mark == t.mark))
    )[0]
    joined = left.join(right, ["row", "at"]).select("row", "at", "head", same.alias("cut"))
    # The left chunk counts up to the cut, the right one from it.
    before = F.filter("head", lambda h: h.place == F.col("cut.place"))[0].before
    gained = joined.select("row", (F.col("cut.before") - before).alias("n"), F.col("cut").isNull().alias("odd"))
    ends = encoded.select(
        "row", F.when(F.col("last"), F.col("n_tokens")).alias("n"), F.lit(False).alias("odd"),
        F.when(F.col("first"), F.struct("doc_id", "n_bytes")).alias("doc"),
    )
    rows = gained.withColumn("doc", F.lit(None).cast(ends.schema["doc"].dataType)).unionByName(ends)
    return rows.groupBy("row").agg(F.sum("n").alias("n_tokens"), F.max("odd").alias("odd"), F.max("doc").alias("doc"))


def _long(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    while True:
        # Rows are numbered and written in one job: numbers of another may differ.
        spliced = written(_spliced(written(_encode(_chunks(docs, chunk, overlap), path)), chunk))
        if spliced.filter("odd").isEmpty():
            return spliced.select("doc.doc_id", "doc.n_bytes", "n_tokens")
        overlap *= 4


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024,
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_tokens, over_limit).

    ``path`` is the file of a byte-level BPE tokenizer whose pattern splits
    before white space; added special tokens must hold none.
    """
    text = text_of(text_col)
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.char_length(text).alias("n_chars"),
    )
    short = _short(source.filter(F.col("n_chars") <= chunk), path)
    long = _long(source.filter(F.col("n_chars") > chunk), path, chunk, overlap)
    return short.unionByName(long).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
