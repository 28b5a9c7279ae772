"""Best-fit packing by minimum bin slack.

Documents become token ids and an end id; longer ones are cut into pieces of
``CAPACITY`` ids.  Only lengths matter for packing, and there are at most
``CAPACITY`` of them, so the plan is made from the number of pieces of each
length, a summary whose size does not grow with the corpus.  For each sequence
the longest length left is taken and a subset-sum table, held as the bits of one
integer, finds the fullest combination of the lengths left beside it; the
combination is removed as often as the counts allow.  Each piece is then ranked
within its length, in groups of bounded size, and finds its sequence and place
in the plan.

Words between white space are tokenized apart, as no token of this kind of
tokenizer spans white space; ids of words are kept in bounded room.  If the file
splits words as ``SPLIT`` does, a new word of plain Latin-1 characters is lowered
and split here, and only pieces not seen before go through the library's model;
all other words go through the whole library.

Defined results: null counts as empty, an empty text is the end id alone,
repeated rows are packed one by one, an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wavelark.llm.tables import Memo, kept_in_worker, map_text, slices, text_of, written

#: Ids in a sequence, id that ends a document.
CAPACITY, END = 2048, 0
#: Words a worker keeps (twice as many at most), as many pieces of them; rows ranked in one group.
KEPT, RANKED = 250_000, 20_000

#: What the tokenizer doesn't take for white space; Python also counts 1C-1F as such.
WORD = re.compile(r"[\S\x1c-\x1f]+")
ODD = re.compile(r"[\x1c-\x1f]")
BLANK = re.compile(r"[^\S\x1c-\x1f]")

#: How the tokenizer's file normalises and splits a word, for ``_pieces`` to apply.
SPLIT = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [
        {
            "type": "Split", "behavior": "Removed", "invert": True,
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Words without the "<" of added tokens that NFC leaves alone and whose capitals have one small letter each.
PLAIN = re.compile("[!-;=-~À-ÖØ-öø-ÿ]+")
#: ``SPLIT``'s pattern on such words, lowered.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _words(text: str, start: int, end: int, odd: bool) -> list[str]:
    return WORD.findall(text, start, end) if odd else text[start:end].split()


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _splits_plainly(path: str) -> bool:
    """Whether ``PLAIN`` words of the file's tokenizer split into ``PIECE`` matches, each with its own ids."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    steps = {
        name: (made.get(name) or {}).get(part) for name, part in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))
    }
    model = made["model"]
    plain = model["type"] == "BPE" and not model["dropout"] and not made.get("post_processor")
    return plain and steps == SPLIT and all("<" in token["content"] for token in made["added_tokens"])


def _pieces(tokenizer) -> Callable[[str], bytes]:
    """Ids of a ``PLAIN`` word by the library's model, piece by piece; pieces are kept in bounded room."""
    from tokenizers import pre_tokenizers

    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
    tokenize = tokenizer.model.tokenize

    class Ids(dict):
        def __missing__(self, piece: str) -> bytes:
            if len(self) >= KEPT:
                self.clear()
            ids = _packed([t.id for t in tokenize(piece if piece.isascii() else piece.translate(letters))])
            if len(piece) <= 64:
                self[piece] = ids
            return ids

    ids, found = Ids(), PIECE.findall
    return lambda word: b"".join(map(ids.__getitem__, found(word.lower())))


def _encoder(path: str) -> Memo:
    """Ids of words as little-endian unsigned 32-bit integers."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    def make() -> Memo:
        tokenizer = Tokenizer.from_file(path)
        plain = PLAIN.fullmatch if _splits_plainly(path) else lambda word: None
        joined = _pieces(tokenizer)

        def encode(words: list[str]) -> list[bytes]:
            odd = [w for w in words if not plain(w)]
            others = iter(tokenizer.encode_batch_fast(odd, add_special_tokens=False) if odd else ())
            return [joined(w) if plain(w) else _packed(next(others).ids) for w in words]

        return Memo(KEPT, encode)

    return kept_in_worker(("ids", path), make)


def _cut(encoder: Memo, text: str, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a text, read a stretch at a time."""
    size, held, piece = 4 * capacity, b"", 0
    odd = ODD.search(text) is not None
    parts = (b"".join(encoder.values(_words(text, *s, odd))) for s in slices(text, BLANK))
    for part in chain(parts, [np.array([END], dtype="<u4").tobytes()]):
        held += part
        at = 0
        while len(held) - at >= size:
            yield piece, piece * capacity, capacity, crc32(held[at : at + size])
            piece, at = piece + 1, at + size
        held = held[at:]
    if held:
        yield piece, piece * capacity, len(held) // 4, crc32(held)


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece."""
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def make():
        encoder = _encoder(path)
        names = ("piece", "start", "length", "ids_crc32")
        return lambda texts: [[[dict(zip(names, p, strict=True)) for p in _cut(encoder, t, capacity)] for t in texts]]

    pieces = map_text(source, make, "pieces array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    return pieces.select("doc_id", F.inline("pieces"))


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths whose sum is the largest that fits ``room``, each used at most as often as counted."""
    reach, mask, made = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            new = (reach << length) & mask & ~reach
            if not new:
                break
            made.append((length, new))
            reach |= new
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, []
    for length, new in reversed(made):
        if total and new >> total & 1:
            used.append(length)
            total -= length
    return used


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths) of combinations that use up the counts."""
    left, plan = {k: n for k, n in counts.items() if n}, []
    while left:
        first = max(left)
        left[first] -= 1
        used = [first, *fullest({k: n for k, n in left.items() if n}, capacity - first)]
        left[first] += 1
        wanted = {k: used.count(k) for k in used}
        times = min(left[k] // n for k, n in wanted.items())
        for k, n in wanted.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        plan.append((times, used))
    return plan


#: Ranks within a length stay below this.
_RANKS = 1 << 44


def _places(plan: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length * _RANKS + first rank, times, first sequence, offset), sorted: one per length of a combination."""
    rows, ranked, sequence = [], {}, 0
    for times, used in plan:
        offset = 0
        for length in used:
            rank = ranked.get(length, 0)
            rows.append((length * _RANKS + rank, times, sequence, offset))
            ranked[length] = rank + times
            offset += length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity``) with sequence_id and offset.

    Sequence ids count from 0; offsets within a sequence have no gaps.
    """
    numbered = written(pieces.withColumn("_at", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(packing_plan(counts, capacity))
    groups = max(counts.values(), default=0) // RANKED + 1
    dealt = numbered.withColumn("_group", F.pmod(F.xxhash64("_at"), F.lit(groups)))
    sizes = dealt.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    order = Window.partitionBy("length", "_group").orderBy("_at")
    ranked = dealt.withColumn("_rank", F.row_number().over(order) - 1).join(firsts, ["length", "_group"])
    source = ranked.select(*pieces.columns, (F.col("_first") + F.col("_rank")).alias("_rank"))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            ranks = columns.pop("_rank").to_numpy()
            key = columns["length"].to_numpy() * _RANKS + ranks
            row = np.searchsorted(places[:, 0], key, side="right") - 1
            columns["sequence_id"] = pa.array(places[row, 2] + key - places[row, 0])
            columns["offset"] = pa.array(places[row, 3])
            yield pa.RecordBatch.from_pydict(columns)

    schema = StructType([*pieces.schema, *StructType.fromDDL("sequence_id long, offset long")])
    return source.mapInArrow(place, schema)


def best_fit_packing(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(token_pieces(docs, path, id_col, text_col, capacity), capacity)
