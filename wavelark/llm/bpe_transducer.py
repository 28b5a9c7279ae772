"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

**Encoding.**  A split of a piece into tokens is its BPE encoding exactly when
each token encodes to itself and each neighbouring pair encodes to that pair.
So each prefix of the piece has one encoding, which ends in one token.  A path
automaton reads a byte at a time; its determinised state is the set of places
where a token may have begun, each with the bytes read since and the token
before.  A step gives the token that the prefix ends in.  A place dies when no
token continues its bytes, so the lookahead is at most the longest token: what
all live places agree on is settled and written.  States and their steps are
made when first reached and kept.

Which pairs are compatible follows from the merges alone.  While a token is
merged from bytes, lowest rank first, its outermost part grows; each such part
touches the border from its own rank to the next one's.  Two tokens are
compatible when no two parts that touch at one time merge first.

**Decoding** reads ids one by one: ids of whole characters come from a table;
the others carry a byte-wise UTF-8 state machine across tokens, so characters
split between tokens come out whole and invalid bytes come out as U+FFFD.

Segments and pieces repeat; what they encode to is kept, at most ``KEPT`` of
each in two halves.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.llm.tables import Memo, kept_in_worker, map_text, slices, text_of

#: Kept segments (twice as many at most), states and pairs of a worker; beyond
#: these they are made again.  Bytes read before settled tokens are written.
KEPT = 200_000
STATES = 200_000
FLUSH = 1 << 16
#: Later than any merge.
LAST = 1 << 60

#: A segment is white space and what follows up to the next white space.  Where
#: something else meets white space every pattern match ends, so segments can be
#: encoded apart.  The characters 1C-1F are white space to Python only.
SEGMENT = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
BORDER = re.compile(r"[\S\x1c-\x1f](?=[^\S\x1c-\x1f])")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def parts_of(piece: bytes, ranks: dict[bytes, int], least: int = 1) -> list[bytes]:
    """BPE of a short piece by its definition, until ``least`` parts: the lowest rank merges first, leftmost on ties."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks) + 1
    while len(parts) > least:
        found = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        lowest = min(found)
        if lowest == none:
            break
        best = found.index(lowest)
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def merged(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    return tuple(ranks[p] for p in parts_of(piece, ranks))


class Transducer:
    """Encodes pieces; ``ranks`` maps token bytes to ids and merge order at once.

    A state is a dictionary from a byte to (next state, token that the bytes
    read so far end in); under ``PLACES`` it holds the places it stands for, each
    as (node of the trie of tokens for the bytes read since, token before it).
    """

    PLACES = -1

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Trie of tokens: (node, byte) as node * 256 + byte -> node; bytes of each node.
        self.child: dict[int, int] = {}
        self.read = [b""]
        for token in ranks:
            node = 0
            for n, byte in enumerate(token, 1):
                key = node << 8 | byte
                node = self.child.get(key)
                if node is None:
                    node = self.child[key] = len(self.read)
                    self.read.append(token[:n])
        self.sound: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.spines: dict[tuple[bytes, bool], list[tuple[bytes, int]] | None] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1),)
        self.start = {self.PLACES: start}
        self.states = {start: self.start}

    def _token(self, node: int) -> int:
        """Id of a node's token, if it encodes to itself, or -1."""
        data = self.read[node]
        found = self.ranks.get(data, -1)
        if found >= 0 and merged(data, self.ranks) != (found,):
            found = -1
        self.sound[node] = found
        return found

    def _compatible(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        pair = (left, right)
        if pair not in self.pairs:
            if len(self.pairs) >= STATES:
                self.pairs.clear()
            self.pairs[pair] = self._side_by_side(self.bytes_of[left], self.bytes_of[right])
        return self.pairs[pair]

    def _spine(self, token: bytes, right: bool) -> list[tuple[bytes, int]] | None:
        """Outermost parts of a token on one side as it is merged, each with the rank that ends it.

        None where a part doesn't rank below what it is merged into; time is then no rank.
        """
        key = token, right
        if key not in self.spines:
            if len(token) == 1:
                self.spines[key] = [(token, LAST)]
            else:
                if token not in self.halves:
                    self.halves[token] = tuple(parts_of(token, self.ranks, 2))
                rank, halves = self.ranks[token], self.halves[token]
                inner = self._spine(halves[right], right)
                rising = all(len(h) == 1 or self.ranks[h] < rank for h in halves)
                usable = inner is not None and rising
                self.spines[key] = [*inner[:-1], (inner[-1][0], rank), (token, LAST)] if usable else None
        return self.spines[key]

    def _side_by_side(self, left: bytes, right: bytes) -> bool:
        """Whether the border between two tokens survives when both are merged together."""
        ranks = self.ranks
        one, other = self._spine(left, True), self._spine(right, False)
        if one is None or other is None:
            return merged(left + right, ranks) == (ranks[left], ranks[right])
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = one[i], other[j]
            rank = ranks.get(a + b)
            # On equal ranks the leftmost merges first: the left token's own before the border's.
            if rank is not None and rank < a_ends and rank <= b_ends:
                return False
            if a_ends == b_ends == LAST:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def _step(self, state: dict, byte: int) -> tuple[dict, int]:
        """What ``byte`` does in a state, made once."""
        child, sound, places, ends = self.child, self.sound, [], -1
        for begun, before in state[self.PLACES]:
            node = child.get(begun << 8 | byte)
            if node is not None:
                places.append((node, before))
                if ends < 0:
                    token = sound[node] if node in sound else self._token(node)
                    if token >= 0 and self._compatible(before, token):
                        ends = token
        if ends < 0:
            raise ValueError("a byte that is no token")
        places.append((0, ends))
        key = tuple(places)
        after = self.states.get(key)
        if after is None:
            if len(self.states) >= STATES:
                self._reset()
            after = self.states[key] = {self.PLACES: key}
        state[byte] = after, ends
        return state[byte]

    def _path(self, ends: list[int], upto: int) -> list[int]:
        """Tokens of the first ``upto`` bytes, from the token each prefix ends in."""
        path = []
        while upto > 0:
            token = ends[upto - 1]
            path.append(token)
            upto -= len(self.bytes_of[token])
        path.reverse()
        return path

    def _settled(self, ends: list[int], state: dict) -> tuple[list[int], int]:
        """Tokens on which all live places agree, and the bytes they cover."""
        here = len(ends)
        paths = [self._path(ends, here - len(self.read[begun])) for begun, _ in state[self.PLACES]]
        agreed = []
        for tokens in zip(*paths, strict=False):
            if len(set(tokens)) > 1:
                break
            agreed.append(tokens[0])
        agreed = agreed[:-1]  # the last one stays: paths walk back to where it ends
        return agreed, sum(len(self.bytes_of[t]) for t in agreed)

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:  # a whole piece that is a token is that token
            return [whole]
        out: list[int] = []
        ends: list[int] = []
        state, step = self.start, self._step
        for at in range(0, len(piece), FLUSH):
            if at:
                written, covered = self._settled(ends, state)
                out += written
                del ends[:covered]
            for byte in piece[at : at + FLUSH]:
                state, token = state.get(byte) or step(state, byte)
                ends.append(token)
        return out + self._path(ends, len(ends))


#: First byte -> (bytes that follow, least and greatest second byte); fixed by UTF-8.
def _lead(byte: int) -> tuple[int, int, int] | None:
    if byte < 0x80:
        return 0, 0, 0
    if 0xC2 <= byte <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= byte <= 0xEF:
        return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte <= 0xF4:
        return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    return None


class Utf8Stream:
    """Text from token ids as they come.

    A state is the bytes of a character begun, at most three.  What an id does
    in a state is worked out once, byte by byte, and kept.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.whole: dict[int, str] = {}
        for i, data in bytes_of.items():
            try:
                self.whole[i] = data.decode("utf-8")
            except UnicodeDecodeError:
                continue
        self.table: dict[tuple[bytes, int], tuple[bytes, str]] = {}

    @staticmethod
    def advance(pending: bytes, data: bytes) -> tuple[bytes, str]:
        text = []
        for byte in data:
            while True:
                if not pending:
                    lead = _lead(byte)
                    if lead is None:
                        text.append("�")
                    elif lead[0] == 0:
                        text.append(chr(byte))
                    else:
                        pending = bytes((byte,))
                    break
                need, low, high = _lead(pending[0])
                if len(pending) > 1:
                    low, high = 0x80, 0xBF
                if not low <= byte <= high:  # the character broke off; this byte starts anew
                    text.append("�")
                    pending = b""
                    continue
                pending += bytes((byte,))
                if len(pending) == need + 1:
                    text.append(pending.decode("utf-8"))
                    pending = b""
                break
        return pending, "".join(text)

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        pending, whole, table = b"", self.whole, self.table
        for i in ids:
            text = None if pending else whole.get(i)
            if text is None:
                key = pending, i
                if key not in table:
                    if len(table) >= STATES:
                        table.clear()
                    table[key] = self.advance(pending, self.bytes_of[i])
                pending, text = table[key]
            yield text
        if pending:
            yield "\N{REPLACEMENT CHARACTER}"

    def text(self, ids: list[int]) -> str:
        """Text of all ids at once."""
        try:
            return "".join(map(self.whole.__getitem__, ids))
        except KeyError:
            return "".join(self.decode(ids))


class Codec:
    """Splits, encodes and decodes texts; keeps what segments encode to."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.transducer = Transducer(read_ranks(path))
        self.stream = Utf8Stream(self.transducer.bytes_of)
        # The library's white space has no 1C-1F; this module's may.
        own = pattern.replace(r"[^\s\p{L}", r"[^\p{White_Space}\p{L}")
        self.pieces = regex.compile(own.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.encoded = Memo(KEPT, lambda missing: [self.transducer.encode(p.encode("utf-8", "replace")) for p in missing])
        self.kept = Memo(KEPT, self.digested)
        self.decimal = [str(i) for i in range(max(self.stream.bytes_of) + 1)]

    def all_ids(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment."""
        pieces = list(map(self.pieces.findall, segments))
        found = iter(self.encoded.values([p for part in pieces for p in part]))
        return [[i for _ in part for i in next(found)] for part in pieces]

    def ids(self, segment: str) -> list[int]:
        return self.all_ids([segment])[0]

    def digested(self, segments: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids in decimal, their decoded text) of each segment."""
        decimal, out = self.decimal, []
        for segment, ids in zip(segments, self.all_ids(segments), strict=True):
            text = self.stream.text(ids)
            out.append((len(ids), " ".join([decimal[i] for i in ids]), segment if text == segment else text))
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        return self.stream.decode(ids)


def encoded_and_decoded(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: (doc_id, ids, decoded).  Null counts as empty."""
    return _mapped(docs, path, pattern, id_col, text_col, "ids array<int>, decoded string", _whole)


def codec_digest(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    Ids and decoded text are digested as they are made, so that neither is held
    whole.  Null counts as empty; an empty text has no ids; repeated rows are
    rows; an empty table gives an empty result.
    """
    return _mapped(
        docs, path, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digest
    )


def _whole(codec: Codec, text: str) -> tuple:
    ids = [i for s in slices(text, BORDER) for own in codec.all_ids(SEGMENT.findall(text, *s)) for i in own]
    return ids, "".join(codec.decode(ids))


def _digest(codec: Codec, text: str) -> tuple:
    """Segments hold whole characters, so decoding is at its start state after each."""
    written, decoded, total = hashlib.sha256(), hashlib.sha256(), 0
    for s in slices(text, BORDER):
        rows = codec.kept.values(SEGMENT.findall(text, *s))
        line = " ".join([row[1] for row in rows])
        written.update((" " + line if total else line).encode())
        decoded.update("".join([row[2] for row in rows]).encode())
        total += sum([row[0] for row in rows])
    return total, written.hexdigest(), decoded.hexdigest()


def _mapped(docs, path, pattern, id_col, text_col, added, work) -> DataFrame:
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    width = added.count(", ") + 1

    def make():
        import gc

        codec = kept_in_worker(("codec", path, pattern), lambda: Codec(path, pattern))
        # States are many small objects that stay: looking through them for cycles costs more than it frees.
        gc.set_threshold(100_000, 50, 100)
        return lambda texts: list(zip(*(work(codec, text) for text in texts), strict=True)) or [()] * width

    return map_text(source, make, added)
