"""Personal data by candidate gradient boosting.

**Base.**  E-mail addresses, IPv4 addresses, card and phone numbers by fixed
patterns and checks.  These spans always stay.

**Candidates.**  Generators with wide patterns propose more spans, which may
overlap: disguised addresses, numbers with other separators or without a
country code, long or spaced digit groups, IPv6.  Boosted regression trees score
each by its format and the words around it.  Scores are calibrated per kind by
isotonic regression on texts held out of the fit; the lowest score with a
calibrated share of ``PRECISION`` selects spans (``quality`` measures precision
and recall on further texts).  Of
overlapping ones the best stays; none may overlap a base span.

**Fit.**  Every text is read, equal ones once.  Base spans and
rewritings of them in other formats (the disguises above) are positive; base
matches that fail their check, implausible candidates beside base spans, and
base spans damaged beyond their check, cut short or run into neighbours are
negative.  All of them count.  Features become bins with fixed edges, rows with
the same bins are one row with their weight, and each level of a tree is grown
from sums per bin over all rows, which Spark adds up; the driver sees only these
sums.  A text's rows of one kind and label weigh at most ``PER_TEXT`` together
and all rows of one kind and label at most ``ROWS``, so that neither long texts
nor common kinds crowd others out.  A kind with base spans in fewer than two
texts adds none.

Defined results: null counts as empty, an empty text has no spans, repeated rows
are rows, an empty table gives an empty result.  Offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import batched

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.llm.tables import map_text, text_of, written

KINDS = ("email", "ip", "card", "phone")
#: Weight of the rows of a kind and label, of one text and in all; wanted precision; characters of context.
PER_TEXT, ROWS, PRECISION, AROUND = 32, 3000, 0.99, 40
#: Parts of the texts: one calibrates, another may measure.  Kinds in no more texts than this have them dealt out one by one.
PARTS, HELD, UNSEEN, DOCUMENTS = 5, 1, 3, 3000
#: Trees, their depth and step; edges of the value bins: features are counts, told apart up to 19.
TREES, DEPTH, STEP = 40, 3, 0.3
EDGES = np.array([*range(20), 21, 23, 25, 28, 32, 40, 48, 64, 96, 128, 256], dtype=float)
BINS = len(EDGES) + 1
#: Summed rows of a task.
SUMMED = 20_000
#: A value of each bin; the unit of summed weights and of summed slopes, whole numbers that add up exactly; steps of scores.
VALUES, UNIT, FINE, STEPS = np.append(EDGES, np.inf), 1 << 20, 2.0**36, 256

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can't begin inside a run of digits unless it could at its start.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

GROUP, LETTER = re.compile("[0-9]+"), re.compile("[A-Za-z0-9]")
CHAIN = re.compile(r"(?<![A-Za-z0-9])[+(]{0,2}[0-9]++(?:[ ().\-/]{1,2}[0-9]++)*+")
V6 = re.compile(r"(?<![A-Za-z0-9:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![A-Za-z0-9:])")
AT = re.compile(r"[\[({](?i:at)[\])}]|(?<= )(?i:at)(?= )|@")
HEAD = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:[\[({](?i:at)[\])}]| (?i:at) |@) ?[A-Za-z0-9-]{1,63}(?![A-Za-z0-9])"
)
LABEL = re.compile(r" ?(?:[\[({](?i:dot)[\])}]| (?i:dot) |\.) ?[A-Za-z0-9-]{1,63}(?![A-Za-z0-9])")
#: Shorter domains proposed beside the longest; candidates scored at a time.
LABELS, BLOCK = 8, 1 << 13

#: Words whose presence before a span is a feature; one group each.
CUES = tuple(
    re.compile(p, re.IGNORECASE)
    for p in (
        r"\b(?:tel|phone|call|mobile|cell|fax|whatsapp|sms)\b", r"\b(?:e-?mail|mail|contact|write|reach)\b",
        r"\b(?:card|visa|master|credit|debit|payment|iban|account)\b", r"\b(?:ip|host|server|address|login|from)\b",
        r"\b(?:version|v|license|isbn|issn|rfc|section|page|chapter|figure)\b", r"\b(?:order|invoice|id|ref|no|number|serial)\b",
        r"\b(?:date|born|year|on|since|in)\b|[$€£%]",
    )
)

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def checked(kind: int, span: str) -> bool:
    """Whether a base match counts."""
    if kind == 1:
        return all(map(_small, span.split(".")))
    digits = _digits(span) if kind else ""
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != 3 or 8 <= len(digits) <= 15


def base_matches(text: str) -> list[Span]:
    """Every match of the base patterns, checked or not, by kind and start."""
    found = [(0, *s) for s in _emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    return found


def base_spans(text: str) -> list[Span]:
    return [s for s in base_matches(text) if checked(s[0], text[s[1] : s[2]])]


def _disguised(text: str) -> Iterator[Span]:
    """At every at sign or word: the longest domain and the shorter ones it begins with."""
    for at in AT.finditer(text):
        start = at.start()
        while start and text[start - 1] == " " and at.start() - start < 2:
            start -= 1
        end = start
        while start and end - start <= 64 and text[start - 1] in LOCAL:
            start -= 1
        found = HEAD.match(text, start)
        if start == end or not found:
            continue
        n = 0
        while label := LABEL.match(text, found.end()):
            if 0 < n < LABELS:
                yield 0, start, found.end()
            n, found = n + 1, label
        if n:
            yield 0, start, found.end()


def _numbers(text: str) -> Iterator[Span]:
    """Every stretch of whole groups of a run of digits that has as many digits as a card or phone number."""
    for chain in CHAIN.finditer(text):
        groups = [m.span() for m in GROUP.finditer(text, chain.start(), chain.end())]
        if LETTER.match(text, chain.end()):
            groups.pop()  # "2nd" is no group
        brackets = "(" in text[chain.start() : chain.end()]
        for i, (first, _) in enumerate(groups):
            n = 0
            for begin, end in groups[i : i + 19]:
                n += end - begin
                if n > 19:
                    break
                if n < 7:
                    continue
                # A bracket belongs to a span that closes it; what leads the run is tried with it too.
                start = first - (brackets and text[first - 1 : first] == "(" and text.find(")", first, end) >= 0)
                for a in (start,) if i or start == chain.start() else (start, chain.start()):
                    if n >= 13:
                        yield 2, a, end
                    if n <= 15:
                        yield 3, a, end


def candidates(text: str) -> Iterator[Span]:
    """Proposals of the generators; they may overlap."""
    yield from _disguised(text)
    if ":" in text:
        yield from ((1, *m.span()) for m in V6.finditer(text))
    yield from _numbers(text)


def _form(kind: int, span: str) -> list[float]:
    digits = _digits(span)
    groups = re.findall("[0-9]+", span)
    letters = sum(c.isalpha() for c in span)
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        len(span), len(digits), letters, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        len({*span} - {*"0123456789"}), float(span[:1] == "+"), float("(" in span), span.count("-"), span.count("."),
        span.count(" "), span.count("/"), span.count(":"), float("@" in span), float("at" in span.lower()),
        float("dot" in span.lower()), float(luhn(digits)) if digits else 0.0, float(digits[:1] in "3456") if digits else 0.0,
        float(len(set(digits))), float(all(_small(g) for g in groups)), span.count(". "),
        float("dot dot" in span.lower()),
    ]


def _left(before: str) -> list[float]:
    end = before.rstrip(" ().-/")  # digits of the group beside it
    beside = len(end) - len(end.rstrip("0123456789")) if len(before) - len(end) < 3 else 0
    return [beside, float(before[-1:].isalnum()), *(float(bool(cue.search(before))) for cue in CUES)]


def _right(after: str) -> list[float]:
    end = after.lstrip(" ().-/")
    beside = len(end) - len(end.lstrip("0123456789")) if len(after) - len(end) < 3 else 0
    return [beside, float(after[:1].isalnum())]


def features(kind: int, span: str, before: str, after: str) -> list[float]:
    return [*_form(kind, span), *_left(before), *_right(after)]


def _read(words: Sequence[tuple[int, str, str, str]]) -> np.ndarray:
    """``features`` of each (kind, span, before, after); equal forms and surroundings are read once."""
    forms, lefts, rights = {}, {}, {}
    form = [forms.setdefault((kind, span), len(forms)) for kind, span, _, _ in words]
    left = [lefts.setdefault(before, len(lefts)) for _, _, before, _ in words]
    right = [rights.setdefault(after, len(rights)) for *_, after in words]
    made = np.array([_form(*f) for f in forms], dtype=float)[form]
    begun = np.array([_left(before) for before in lefts], dtype=float)[left]
    return np.hstack([made, begun, np.array([_right(after) for after in rights], dtype=float)[right]])


def _table(text: str, spans: list[Span]) -> np.ndarray:
    """``features`` of spans of a text."""
    return _read([(k, text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND]) for k, a, b in spans])


def _rewritten(kind: int, span: str) -> list[tuple[int, float, str, str, str]]:
    """A base span in other formats (label 1), and damaged, cut or run into its neighbours (label 0).

    Rows are (kind, label, new span, what is put before it, what after it).
    """
    d = _digits(span)
    if kind == 0:
        out = []
        for address in {span, re.sub("[0-9]", "", span)}:
            local, _, host = address.partition("@")
            name = host.split(".")[0]
            for dot in (".", " dot ", " [dot] ", "(dot)"):
                for at in (" at ", " [at] ", "(at)"):
                    out.append((f"{local}{at}{host.replace('.', dot)}", 1.0))
                    if at != " at ":  # with the bare word, two parts are as well a sentence
                        out.append((f"{local}{at}{dot.join(host.split('.')[-2:])}", 1.0))
            out += [(f"{local} at {name}", 0.0), (f"{local}. at {name}. {local}", 0.0), (f"{local} at {name} {name}", 0.0)]
            out += [(f"{local} at {name}. {name}", 0.0), (f"{local} at {host}. {name}", 0.0), (f"{local}(at){host}. {name}", 0.0)]
            out += [(f"{local} at {'. '.join([name] * n)}", 0.0) for n in (3, 4, 5)]
            out += [(f"{local}{at}{name} dot dot", 0.0) for at in (" at ", "(at)")]
        return [(0, label, s, "", "") for s, label in sorted({*out})]
    if kind == 1:
        parts = [int(p.lstrip("0") or 0) for p in span.split(".")]
        full = [f"{257 * p + i:x}" for i, p in enumerate(parts * 2)]
        brief = [*full[:2], *(f"{p % 16:x}" for p in [*parts, *parts[:2]])]
        clock = [f"{p % 60:02d}" for p in parts]
        out = [(":".join(full), 1.0), (":".join(brief), 1.0), (":".join(clock), 0.0), (":".join(clock * 2), 0.0)]
        return [(1, label, s, "", "") for s, label in out]
    if kind == 2:
        split = [d[i : i + 4] for i in range(0, len(d), 4)]
        wrong = d[:-1] + str((int(d[-1]) + 1) % 10)
        out = [
            (".".join(split), 1.0), ("/".join(split), 1.0), ("  ".join(split), 1.0), (wrong, 0.0),
            (".".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)), 0.0), (wrong[:14], 0.0),
        ]
    else:
        near = d[-10:]
        out = [
            (f"({near[:3]}) {near[3:6]}-{near[6:]}", 1.0), (f"{near[:3]}-{near[3:6]}-{near[6:]}", 1.0),
            (f"{near[:3]}.{near[3:6]}.{near[6:]}", 1.0), (f"00{d[:2]} {d[2:5]} {d[5:]}", 1.0), (d, 0.0),
            (f"20{d[-2:]}-0{d[-1]}-1{d[-2]}", 0.0), (f"1{d[-1]}/0{d[-2]}/20{d[-2:]}", 0.0), (f"{d[:3]}.{d[3:5]}.{d[5:]}", 0.0),
            (f"{d[0]}.{d[1]}.{d[2:9]}", 0.0), (d * 2, 0.0), (f"{d[:4]}-{d[4:8]}", 0.0),
        ]
    rows = [(kind, label, s, "", "") for s, label in out]
    for number, label in out:
        cuts = [c for c in candidates(number) if (c[0], c[2] - c[1]) != (kind, len(number))]
        rows += [(k, 0.0, number[a:b], number[:a], number[b:]) for k, a, b in cuts]
        if label:
            rows += [(kind, 0.0, x, "", "") for x in (f"{number} {d[-1]}", f"{number} {d[-3:]}", f"{d[:2]} {number}")]
            rows += [(kind, 1.0, number, f"{d[:n]} ", "") for n in (1, 4)] + [(kind, 1.0, number, "", f" {d[:n]}") for n in (1, 3)]
    return rows


def _examples(text: str) -> Iterator[tuple[int, float, str, str, str]]:
    """(kind, label, span, before, after) of a text's training rows."""

    def around(start: int, end: int) -> tuple[str, str, str]:
        return text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]

    base = base_spans(text)
    known, borders = set(base), _borders(base)
    for kind, start, end in base_matches(text):
        span, before, after = around(start, end)
        good = (kind, start, end) in known
        yield kind, float(good), span, before, after
        if good:
            yield from ((k, label, s, before + x, y + after) for k, label, s, x, y in _rewritten(kind, span))
    for block in batched(candidates(text), BLOCK):
        for kind, start, end in _clear(block, borders):
            if not _plausible(kind, text[start:end]):
                yield kind, 0.0, *around(start, end)


def labelled(texts: Sequence[str]) -> list[dict[tuple[int, float], Counter]]:
    """For each text and (kind, label), how many training rows have which bins."""
    found: list[dict[tuple[int, float], Counter]] = [{} for _ in texts]
    every = ((i, *example) for i, text in enumerate(texts) for example in _examples(text))
    for block in batched(every, BLOCK):
        bins = np.searchsorted(EDGES, _read([(kind, *words) for _, kind, _, *words in block])).astype(np.uint8)
        data, width = bins.tobytes(), bins.shape[1]
        for n, (i, kind, label, *_) in enumerate(block):
            found[i].setdefault((kind, label), Counter())[data[n * width : (n + 1) * width]] += 1
    return found


def _plausible(kind: int, span: str) -> bool:
    """Whether an unlabelled candidate could be personal data, and so is no negative."""
    if kind == 0:
        return ". " not in span  # the end of a sentence
    digits = _digits(span)
    if kind == 2:
        return luhn(digits)
    return kind < 2 or (len(digits) >= 10 and len(re.findall("[0-9]+", span)) > 2)


@dataclass
class Boosted:
    """Additive regression trees for the log odds; ``thresholds`` per kind."""

    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=lambda: [float("inf")] * len(KINDS))

    def odds(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.start)
        for tree in self.trees:
            out += _apply(tree, rows)
        return out


def _apply(tree: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Values of a complete binary tree: inner nodes (column, cut), then leaves."""
    column, cut, value = tree
    return value[_walk(column, cut, rows, DEPTH) - len(column)]


def _walk(column: np.ndarray, cut: np.ndarray, rows: np.ndarray, levels: int) -> np.ndarray:
    """The node each row has reached after some levels."""
    node = np.zeros(len(rows), dtype=np.int64)
    for _ in range(levels):
        node = 2 * node + 1 + (rows[np.arange(len(rows)), column[node]] > cut[node])
    return node


def _unpacked(batch) -> tuple[np.ndarray, ...]:
    """(kinds, labels, masses, numbers, bins) of a batch of summed rows."""
    kinds, labels, masses, numbers = (batch.column(c).to_numpy() for c in ("kind", "label", "mass", "n"))
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8)
    return kinds, labels, masses, numbers, bins.reshape(batch.num_rows, -1)


def _sums(rows: DataFrame, model: Boosted, tree: tuple, level: int, scale: np.ndarray, columns: int) -> np.ndarray:
    """Sums of slope and weight over all rows by node of a level of the tree, column and bin."""
    import pyarrow as pa

    column, cut = tree
    nodes = 2**level

    def run(batches):
        total = np.zeros((2, nodes * columns * BINS))
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds, labels, masses, _, bins = _unpacked(batch)
            values = VALUES[bins]
            p = 1 / (1 + np.exp(-model.odds(values)))
            weight = masses * scale[kinds, (labels > 0).astype(int)]
            at = _walk(column, cut, values, level) - (nodes - 1)
            slots = ((at[:, None] * columns + np.arange(columns)) * BINS + bins).ravel()
            for sums, each in zip(total, (weight * (labels - p), weight * p * (1 - p)), strict=True):
                sums += np.bincount(slots, np.repeat(np.rint(each * FINE), columns), len(sums))
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    total = np.zeros(2 * nodes * columns * BINS)
    for r in rows.mapInArrow(run, "sums binary").collect():
        total += np.frombuffer(r["sums"])
    return total.reshape(2, nodes, columns, BINS) / FINE


def _grow(rows: DataFrame, model: Boosted, scale: np.ndarray, columns: int):
    """One tree by Newton gain; a node that can't be cut sends all rows left."""
    inner = 2**DEPTH - 1
    column, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
    sums, going = np.zeros((2, 2 * inner + 1)), True  # slope and weight of each node
    for level in range(DEPTH):
        # Where no node of a level is cut, none below is.
        found = _sums(rows, model, (column, cut), level, scale, columns) if going else None
        going = False
        for i in range(2**level):
            n = 2**level - 1 + i
            whole = sums[:, n] if found is None or n else found[:, 0, 0].sum(axis=1)
            left = whole
            if found is not None:
                gl, hl = np.cumsum(found[:, i], axis=2)[:, :, :-1]
                g, h = whole
                gain = gl**2 / (hl + 1.0) + (g - gl) ** 2 / (h - hl + 1.0) - g**2 / (h + 1.0)
                c, k = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[c, k] > 1e-6:
                    column[n], cut[n], left, going = c, EDGES[k], np.array([gl[c, k], hl[c, k]]), True
            sums[:, 2 * n + 1], sums[:, 2 * n + 2] = left, whole - left
    total, mass = sums[:, inner:]
    return column, cut, STEP * total / (mass + 1.0)


def text_parts(kinds: np.ndarray, labels: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """A part below ``PARTS`` for each row: rows of one text share it.

    Texts with positives are dealt out kind by kind, the rarest kind first, so
    that no part lacks a kind that has ``PARTS`` texts of its own.
    """
    part: dict[int, int] = {}
    own = [set(texts[(kinds == k) & (labels > 0)].tolist()) for k in range(len(KINDS))]
    for keys in [*sorted(own, key=len), set(texts.tolist())]:
        part |= {key: i % PARTS for i, key in enumerate(sorted(keys - part.keys()))}
    return np.array([part[key] for key in texts.tolist()], dtype=np.int64)


def calibrated(score: np.ndarray, truth: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Rising share of true rows by score (isotonic regression); rows of one score share a value."""
    weight = np.ones(len(score)) if weight is None else weight
    steps, place = np.unique(score, return_inverse=True)
    mass, hits = np.bincount(place, weight, len(steps)), np.bincount(place, truth * weight, len(steps))
    pools: list[list[float]] = []  # hits, mass, steps
    for pool in zip(hits.tolist(), mass.tolist(), [1] * len(steps), strict=True):
        pools.append(list(pool))
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            pools[-2:] = [[a + b for a, b in zip(*pools[-2:], strict=True)]]
    return np.repeat([h / m for h, m, _ in pools], [int(n) for *_, n in pools])[place]


def _scales(rows: DataFrame) -> tuple[np.ndarray, list]:
    """Weight of a unit of mass by kind and label, and (part, kind, label, mass) of the rows."""
    found = rows.groupBy("part", "kind", "label").agg(F.sum("mass").alias("mass")).collect()
    total = np.zeros((len(KINDS), 2))
    for r in found:
        total[r["kind"], int(r["label"])] += r["mass"] / UNIT
    return np.minimum(1.0, ROWS / np.maximum(total, 1.0)) / UNIT, found


def _scored(rows: DataFrame, model: Boosted) -> list:
    """(kind, label, step, mass, n): rows summed by their score, in steps of 1 / ``STEPS``."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                kinds, labels, masses, numbers, bins = _unpacked(batch)
                step = np.floor(np.clip(model.odds(VALUES[bins]), -16, 16) * STEPS).astype(np.int64)
                arrays = [pa.array(a) for a in (kinds, labels, step, masses, numbers)]
                yield pa.RecordBatch.from_arrays(arrays, names=["kind", "label", "step", "mass", "n"])

    each = rows.mapInArrow(run, "kind int, label double, step long, mass long, n long")
    return each.groupBy("kind", "label", "step").agg(F.sum("mass").alias("mass"), F.sum("n").alias("n")).collect()


def boost(rows: DataFrame, parts: Sequence[int] = tuple(range(PARTS))) -> Boosted:
    """Trees on all summed rows of the parts but the held one; thresholds from that one.

    Per kind the threshold is the least positive score whose calibrated share of
    true spans on the held-out texts reaches ``PRECISION``.
    """
    model = Boosted()
    scale, found = _scales(rows.filter(F.col("part").isin(*parts)))
    weight = {True: [0.0, 0.0], False: [0.0, 0.0]}
    for r in sorted(found):
        weight[r["part"] == HELD][int(r["label"])] += r["mass"] * scale[r["kind"], int(r["label"])]
    if not sum(weight[True]) or not all(weight[False]):
        return model
    fitted = rows.filter(F.col("part").isin(*(p for p in parts if p != HELD)))
    columns = len(features(0, "", "", ""))
    share = np.clip(weight[False][1] / sum(weight[False]), 1e-3, 1 - 1e-3)
    model.start = float(np.log(share / (1 - share)))
    for _ in range(TREES):
        model.trees.append(_grow(fitted, model, scale, columns))
    held = sorted(_scored(rows.filter(F.col("part") == HELD), model))
    for k in range(len(KINDS)):
        own = [r for r in held if r["kind"] == k]
        score, truth = np.array([r["step"] / STEPS for r in own]), np.array([r["label"] for r in own])
        mass = np.array([r["mass"] * scale[k, int(r["label"])] for r in own])
        fine = score[(calibrated(score, truth, mass) >= PRECISION) & (score > 0)]
        if len(fine):
            model.thresholds[k] = float(fine.min())
    return model


def quality(rows: DataFrame) -> dict[str, tuple[int, float, float]]:
    """Per kind (true spans, precision, recall) on a fifth of the texts that neither trees nor thresholds saw."""
    model = boost(rows, [p for p in range(PARTS) if p != UNSEEN])
    scale, _ = _scales(rows)
    true, count = np.zeros(len(KINDS)), np.zeros(len(KINDS), dtype=np.int64)
    found, right = np.zeros(len(KINDS)), np.zeros(len(KINDS))
    for r in _scored(rows.filter(F.col("part") == UNSEEN), model):
        k, weight = r["kind"], r["mass"] * scale[r["kind"], int(r["label"])]
        taken = r["step"] / STEPS >= model.thresholds[k]
        true[k] += weight * r["label"]
        count[k] += r["n"] * int(r["label"])
        found[k] += weight * taken
        right[k] += weight * taken * r["label"]
    return {
        name: (int(count[k]), float(right[k] / (found[k] or 1)), float(right[k] / (true[k] or 1))) for k, name in enumerate(KINDS)
    }


def training_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, kind, label, n, rows): of every text, how many examples of a kind and label, and their bins with numbers.

    Equal texts count once.
    """
    texts = docs.select(text_of(text_col).alias("text")).filter(F.col("text").rlike(r"[0-9@]| (?i:at) |[\[({](?i:at)[\])}]"))

    def make():
        def work(chosen: list[str]):
            return [
                [
                    {"kind": kind, "label": label, "n": own.total(), "rows": [{"bins": b, "n": n} for b, n in own.items()]}
                    for (kind, label), own in found.items()
                ]
                for found in labelled(chosen)
            ]

        return lambda chosen: [work(chosen)]

    found = "array<struct<kind:int,label:double,n:long,rows:array<struct<bins:binary,n:long>>>>"
    made = map_text(texts.withColumn("key", F.xxhash64("text")), make, f"found {found}")
    return made.select("key", F.inline("found")).dropDuplicates(["key", "kind", "label"])


def _parted(rows: DataFrame) -> DataFrame:
    """``rows`` with the part of their text: by its key, but for the texts of rare kinds, which are dealt out."""
    true = rows.filter(F.col("label") > 0).select("kind", "key")
    rare = [r["kind"] for r in true.groupBy("kind").count().filter(F.col("count") <= DOCUMENTS).collect()]
    own = sorted(true.filter(F.col("kind").isin(*rare)).collect()) if rare else []
    if not own:
        return rows.withColumn("part", F.pmod("key", F.lit(PARTS)).cast("int"))
    kinds, keys = np.array([r["kind"] for r in own]), np.array([r["key"] for r in own], dtype=np.int64)
    dealt = sorted(set(zip(keys.tolist(), text_parts(kinds, np.ones(len(own)), keys).tolist(), strict=True)))
    parts = rows.sparkSession.createDataFrame(dealt, "key long, part int")
    joined = rows.join(F.broadcast(parts), "key", "left")
    return joined.withColumn("part", F.coalesce("part", F.pmod("key", F.lit(PARTS)).cast("int")))


def collected(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame]:
    """What ``boost`` and ``quality`` take: all training rows, summed by (part, kind, label, bins), with mass and number."""
    rows = _parted(written(training_rows(docs, text_col)))
    unit = F.least(F.lit(1.0), F.lit(float(PER_TEXT)) / F.col("n")) * UNIT
    flat = rows.withColumn("unit", unit).drop("n").select("part", "kind", "label", "unit", F.inline("rows"))
    mass = F.sum(F.round(F.col("unit") * F.col("n")).cast("long"))
    summed = written(flat.groupBy("part", "kind", "label", "bins").agg(mass.alias("mass"), F.sum("n").alias("n")))
    # Each level of each tree is one pass over these rows: no more tasks than they are worth.
    return (summed.coalesce(summed.count() // SUMMED + 1),)


def fit(docs: DataFrame, text_col: str = "text") -> Boosted:
    """Fits on the base spans and candidates of all texts."""
    return boost(*collected(docs, text_col))


def spans_of(text: str, model: Boosted) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by kind and start."""
    base = base_spans(text)
    borders = _borders(base)
    limits = np.array(model.thresholds)
    found, scores = [], []
    for block in batched((s for s in candidates(text) if model.thresholds[s[0]] < np.inf), BLOCK):
        if clear := _clear(block, borders):
            odds = model.odds(_table(text, clear))
            clear = np.array(clear)
            fine = odds >= limits[clear[:, 0]]
            found.append(clear[fine])
            scores.append(odds[fine])
    if not sum(map(len, found)):
        return base, base
    spans = np.concatenate(found)
    kind, start, end = spans.T
    taken: list[Span] = []
    covered = bytearray(len(text))
    # Best first, the longer of equals; a covered character bars a span.
    for k, a, b in spans[np.lexsort((kind, start, start - end, -np.concatenate(scores)))].tolist():
        if covered.find(1, a, b) < 0:
            taken.append((k, a, b))
            covered[a:b] = b"\1" * (b - a)
    return base, sorted(base + taken)


def _borders(base: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of base spans in order and the farthest end up to each."""
    ordered = np.array(sorted((b[1], b[2]) for b in base), dtype=np.int64).reshape(-1, 2)
    return ordered[:, 0], np.maximum.accumulate(ordered[:, 1])


def _clear(spans: Sequence[Span], borders: tuple[np.ndarray, np.ndarray]) -> list[Span]:
    """Spans that overlap no base span."""
    starts, ends = borders
    if not len(starts) or not spans:
        return list(spans)
    _, begin, end = np.array(spans).T
    k = np.searchsorted(starts, end)  # base spans that begin before this one ends
    free = (k == 0) | (ends[k - 1] <= begin)
    return [s for s, f in zip(spans, free.tolist(), strict=True) if f]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    model = fit(docs, text_col)
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def make():
        def work(texts: list[str]):
            rows = []
            for text in texts:
                base, every = spans_of(text, model)
                counts = [sum(s[0] == k for s in base) for k in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
            return list(zip(*rows, strict=True)) or [()] * 6

        return work

    return map_text(
        source, make, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with each stretch of spans replaced by the kind of the first, in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in its text replaced; null stays null."""
    model = fit(docs, text_col)
    names = docs.columns
    source = docs.withColumn("text", F.col(text_col)) if text_col == "text" else docs.withColumnRenamed(text_col, "text")

    def make():
        return lambda texts: [[t if t is None else redacted(t, spans_of(t, model)[1]) for t in texts]]

    return map_text(source, make, "_redacted string").withColumnRenamed("_redacted", text_col).select(*names)
