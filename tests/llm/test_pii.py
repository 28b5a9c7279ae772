import hashlib
import random
import re
import time

import numpy as np
import pytest
from wavelark.llm import pii as P

#: The patterns as the definition gives them.
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def slow(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2:
                total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1]))
                if not 16 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_by_definition():
    rng = random.Random(4)
    alphabets = ("ab.@-_%+1 é", "0123456789. -", "+(0)123 .-a", "4111 -@.com+")
    for _ in range(20000):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 50)))
        assert P.base_spans(text) == slow(text), text
    card = "x 4111 1111-1111 1111 y 4111111111111111-4"
    assert P.base_spans(card) == slow(card) and P.base_spans(card)


@pytest.mark.parametrize("unit", ["a", "1", "1.", "@", "a@", "+1", "+1 ", ".", "1 ", "a@b.", ":1"])
def test_long_texts_take_linear_time(unit):
    began = time.time()
    P.spans_of(unit * 200_000, P.Boosted(thresholds=[0.0] * 4))
    assert time.time() - began < 30


ROWS = [
    "mail a.b7@mail3.example.com or +1 (319) 555-5132", "server 27.109.211.155 is up", "card 4799134681044206 there",
    None, "", "clean text without anything", "one 1 two 22 version 2.0", "9999999999999999", "300.1.1.1", "é" * 50 + " x@y.zz",
]


def test_table(spark):
    docs = spark.createDataFrame([(i // 2, t, "clash", 3) for i, t in enumerate(ROWS)], "doc_id long, text string, spans string, n_ip int")
    got = sorted(P.find_pii(docs).collect(), key=str)
    assert len(got) == len(ROWS)
    want = []
    for i, text in enumerate(ROWS):
        base = slow(text or "")
        line = P.listed(base)
        counts = tuple(sum(s[0] == k for s in base) for k in range(4))
        want.append((i // 2, *counts, hashlib.sha256(line.encode()).hexdigest()))
    assert sorted(tuple(r)[:6] for r in got) == sorted(want)
    assert P.find_pii(docs.filter("false")).collect() == []


def plausible(kind, text):
    """Whether an added span is of its kind by the kind's own definition."""
    digits = [int(c) for c in text if c.isdigit()]
    if kind == "card":
        doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "ip":
        parts = text.split(".")
        return ":" in text or (len(parts) == 4 and all(0 <= int(p) <= 255 for p in parts))
    return "@" in text or "at" in text.lower()


def test_model_adds_disguised_spans_and_leaves_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    planted = ["call (319) 555-5132 now", "card 4799.1346.8104.4206 ok", "reach fe80:0:0:0:1:2:3:4 up"]
    clean = ["on 2024-01-15 at 10:30", "the sum was 12.50 and 1234567890", "card 4799.1346.8104.4207", "she was at home dot dot"]
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(planted + clean)], "doc_id long, text string")
    got = {r.doc_id: r for r in P.find_pii(docs.select("doc_id", "text").union(more)).collect()}
    assert [got[10**6 + i].spans for i in range(3)] == ["phone:5:19", "card:5:24", "ip:6:24"]
    assert all(got[10**6 + 3 + i].spans == "" for i in range(len(clean)))
    alone = {}
    for r in docs.collect():
        base = {f"{P.KINDS[k]}:{a}:{b}" for k, a, b in slow(r.text or "")}
        every = [x for x in got[r.doc_id].spans.split(",") if x]
        assert base <= set(every)
        added = [x for x in every if x not in base]
        for kind, a, b in (x.split(":") for x in added):
            assert plausible(kind, r.text[int(a) : int(b)]), (r.doc_id, kind, r.text[int(a) : int(b)])
        if added and not base:
            alone[r.doc_id] = added
    # Two card-like numbers side by side: the base pattern reads both as one of 32 digits and drops it.
    assert alone == {1262: ["card:30:46"]}


def test_redaction(spark):
    assert P.redacted("a x@y.zz b 1.2.3.4", [(0, 2, 8), (1, 11, 18)]) == "a [EMAIL] b [IP]"
    assert P.redacted("+1 4111111111111111", [(2, 3, 19), (3, 0, 19)]) == "[PHONE]"
    docs = spark.createDataFrame([(1, "a x@y.zz", "s"), (2, None, "s")], "doc_id long, text string, source string")
    assert [tuple(r) for r in P.redact(docs).orderBy("doc_id").collect()] == [(1, "a [EMAIL]", "s"), (2, None, "s")]


@pytest.mark.parametrize(
    "text, kind, want",
    [
        ("write jane (at) example.com now", 0, "jane (at) example.com"),
        ("write JANE (AT) EXAMPLE (DOT) COM now", 0, "JANE (AT) EXAMPLE (DOT) COM"),
        ("ask bob at example.org. Then wait", 0, "bob at example.org"),
        ("call 555-123-4567 2nd floor", 3, "555-123-4567"),
        ("in 2024 (319) 555-5132 or", 3, "(319) 555-5132"),
        ("pay 12 4799.1346.8104.4206 3 times", 2, "4799.1346.8104.4206"),
    ],
)
def test_real_cases_are_proposed(text, kind, want):
    start = text.index(want)
    assert (kind, start, start + len(want)) in set(P.candidates(text))


def test_every_stretch_of_whole_groups_is_proposed():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("0123456789" * 2 + "  -./a") for _ in range(rng.randint(0, 40)))
        want = set()
        groups = [m.span() for m in re.finditer(r"(?<![A-Za-z0-9])[0-9]+(?![A-Za-z0-9])", text)]
        for (a, _), i in zip(groups, range(len(groups)), strict=True):
            for _, b in groups[i:]:
                n = sum(c.isdigit() for c in text[a:b])
                if re.fullmatch(r"[0-9]+(?:[ ().\-/]{1,2}[0-9]+)*", text[a:b]):
                    want |= {(2, a, b)} if 13 <= n <= 19 else set()
                    want |= {(3, a, b)} if 7 <= n <= 15 else set()
        assert {s for s in P.candidates(text) if s[0] >= 2} == want, text


def test_stretches_are_chosen_in_their_neighbourhood(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    planted = ["call 319-555-5132 2nd floor", "write jane (at) mail3.example.com now", "in 2024 (319) 555-5132 we"]
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(planted)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in P.find_pii(docs.union(more)).filter("doc_id >= 1000000").collect()}
    assert [got[10**6 + i] for i in range(3)] == ["phone:5:17", "email:6:33", "phone:8:22"]


def test_rare_kinds_are_fitted_and_long_texts_crowd_none_out(spark, monkeypatch):
    monkeypatch.setattr(P, "DOCUMENTS", 20)
    many = [(i, f"page {i} of 2019-03-{i % 28 + 1:02d} 10:30") for i in range(4000)]
    many += [(10**6 + i, f"card 479913468104420{6} no {i}") for i in range(3)]
    many.append((10**7, " ".join(f"{i:04d}-{i % 12 + 1:02d}-11 v{i}" for i in range(20_000))))
    rows = P.training_rows(spark.createDataFrame(many, "doc_id long, text string")).select("kind", "label", "key").collect()
    assert any((r.kind, r.label) == (2, 1.0) for r in rows)
    counts = {}
    for r in rows:
        counts[r.key, r.kind, r.label] = counts.get((r.key, r.kind, r.label), 0) + 1
    assert max(counts.values()) <= P.PER_TEXT


def test_parts_keep_texts_whole_and_kinds_everywhere():
    rng = np.random.default_rng(2)
    texts = rng.integers(0, 400, 5000)
    kinds = np.where(texts < 5, 2, texts % 2)
    parts = P.text_parts(kinds, np.ones(5000), texts)
    assert all(len(set(parts[texts == t])) == 1 for t in set(texts))
    assert all(set(parts[kinds == k]) == set(range(P.PARTS)) for k in set(kinds))
    assert len(P.text_parts(*(np.array([]),) * 3)) == 0


def test_calibration_is_the_closest_rising_fit():
    rng = np.random.default_rng(3)
    for _ in range(50):
        score, truth = rng.integers(0, 12, 40).astype(float), rng.integers(0, 2, 40).astype(float)
        got = P.calibrated(score, truth)
        # Least squares among rising functions: the greatest least mean over stretches of scores.
        for s in set(score):
            lower = [min(truth[(score >= a) & (score <= b)].mean() for b in set(score) if b >= s) for a in set(score) if a <= s]
            assert np.allclose(got[score == s], max(lower))
    assert len(P.calibrated(np.array([]), np.array([]))) == 0


def test_quality_on_unseen_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = P.quality(*P.collected(docs))
    for name in P.KINDS:
        true, precision, recall = found[name]
        assert true >= 50 and precision > 0.97 and recall > 0.8, found


def test_the_fit_counts_every_example_of_every_text(spark, monkeypatch):
    monkeypatch.setattr(P, "DOCUMENTS", 20)
    monkeypatch.setattr(P, "ROWS", 50)
    texts = [f"mail u{i}@host{i}.example.org or 10.0.{i % 256}.{i // 256}, by 2019-03-{i % 28 + 1:02d} 1030" for i in range(300)]
    texts.append(" ".join(f"{i:04d}-{i % 12 + 1:02d}-11 v{i}" for i in range(9000)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:40])], "doc_id long, text string").repartition(5)
    want = {}
    for text in texts:  # equal texts count once
        for kind, label, *words in P._examples(text):
            bins = np.searchsorted(P.EDGES, P.features(kind, *words)).astype(np.uint8).tobytes()
            want[kind, label, bins] = want.get((kind, label, bins), 0) + 1
    (rows,) = P.collected(docs)
    got = {}
    for r in rows.collect():
        key = (r.kind, r.label, bytes(r.bins))
        got[key] = got.get(key, 0) + r.n
    assert got == want
    # One text weighs PER_TEXT at most; where it has fewer examples, each weighs 1.
    phones = sum(r.mass for r in rows.filter("kind = 3 and label = 0").collect()) / P.UNIT
    others = sum(n for (k, label, _), n in want.items() if (k, label) == (3, 0.0)) - 9000
    assert phones == pytest.approx(P.PER_TEXT + others, rel=1e-3)


def test_trees_grow_from_sums_over_all_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "TREES", 6)
    rng = np.random.default_rng(6)
    columns = len(P.features(0, "", "", ""))
    bins = rng.integers(0, P.BINS, (600, columns)).astype(np.uint8)
    kinds, n = rng.integers(0, 4, 600), rng.integers(1, 9, 600)
    labels = ((bins[:, 7] > 12) ^ (rng.random(600) < 0.1)).astype(float)
    rows = [
        (i % P.PARTS, int(k), float(y), b.tobytes(), int(m) * P.UNIT, int(m))
        for i, (k, y, b, m) in enumerate(zip(kinds, labels, bins, n, strict=True))
    ]
    made = spark.createDataFrame(rows, "part int, kind int, label double, bins binary, mass long, n long")
    one, many = (P.boost(P.written(made.repartition(n))) for n in (1, 3))
    assert len(one.trees) == P.TREES and one.thresholds == many.thresholds
    assert all(np.array_equal(a, b) for s, t in zip(one.trees, many.trees, strict=True) for a, b in zip(s, t, strict=True))
    fitted = np.arange(600) % P.PARTS != P.HELD
    x, y, w = bins[fitted], labels[fitted], n[fitted].astype(float)
    p = 1 / (1 + np.exp(-one.start))
    assert p == pytest.approx((w * y).sum() / w.sum())

    def gain(at):
        g, h = (w * (y - p))[at].sum(), (w * p * (1 - p))[at].sum()
        return g * g / (h + 1)

    def best(at):
        cuts = [(gain(at & (x[:, c] <= k)) + gain(at & (x[:, c] > k)), c, P.EDGES[k]) for c in range(columns) for k in range(P.BINS - 1)]
        return max(cuts, key=lambda cut: cut[0])

    column, cut, value = one.trees[0]
    everything = np.ones(len(x), dtype=bool)
    assert best(everything)[1:] == (column[0], cut[0])
    node = x[:, column[0]] > np.searchsorted(P.EDGES, cut[0])
    for child, at in ((1, ~node), (2, node)):
        assert best(at)[1:] == (column[child], cut[child])
    leaf = P._walk(column, cut, P.VALUES[x], P.DEPTH) - len(column)
    for k in range(2**P.DEPTH):
        at = leaf == k
        assert value[k] == pytest.approx(P.STEP * (w * (y - p))[at].sum() / ((w * p * (1 - p))[at].sum() + 1))


def test_no_part_of_a_rare_kind_is_left_out(spark):
    docs = [(i, f"card 4799 1346 8104 4206 no {i}") for i in range(10)] + [(100 + i, f"write a{i}@b.cc") for i in range(10)]
    (rows,) = P.collected(spark.createDataFrame(docs, "doc_id long, text string"))
    for kind in (0, 2):
        assert {r.part for r in rows.filter(f"kind = {kind} and label = 1").collect()} == set(range(P.PARTS))
