import hashlib
import zlib

import pytest
from compare import connect, difference
from wavelark.llm import merkle as M
from wavelark.llm.queries import ORACLES, QUERIES


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = (row[0], row[1], row[2], row[3], text)
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def grow(nodes):
    """Levels from the bottom to a single digest."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + 16]) for i in range(0, len(below), 16)])
    return levels


def path(levels, at):
    out = []
    for nodes in levels[:-1]:
        run, place = nodes[at // 16 * 16 : at // 16 * 16 + 16], at % 16
        out.append((run[:place], run[place + 1 :]))
        at //= 16
    return out


def slow(rows):
    """One result per row by building the whole tree."""
    lower = {c: c + 32 for c in range(65, 91)}
    trees, out = {}, []
    for r in rows:
        tampered = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        trees.setdefault(r[1], []).append((r[0], leaf(r, r[4]), leaf(r, r[4].translate(lower) if tampered else r[4])))
    order = sorted(trees, key=lambda s: b"" if s is None else b"1" + s.encode())
    for t in trees.values():
        t.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    grown = {s: grow([x[1] for x in trees[s]]) for s in order}
    top = grow([grown[s][-1][0] for s in order])
    for place, s in enumerate(order):
        above = path(top, place)
        for at, (doc, own, given) in enumerate(trees[s]):
            steps, folded = path(grown[s], at) + above, given
            for left, right in steps:
                folded = digest(*left, folded, *right)
            proof = digest(*[d for left, right in steps for d in left + right])
            out.append((doc, own, grown[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, rank int, low string, path string"


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 1, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in M.manifest(docs).select(*names).collect()), key=str)


def row(i, source, text="Some Text", lang="en"):
    return (i, source, lang, None if text is None else len(text), text)


@pytest.mark.parametrize(
    "sizes", [{"a": 1}, {"a": 16}, {"a": 17}, {"a": 300, "b": 1, None: 33, "": 2, "é": 257}, {f"s{i}": 1 + i % 3 for i in range(40)}]
)
def test_against_whole_tree(spark, sizes):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append(row(i * 7 % 1009, source, f"Text {i} É"))
            i += 1
    got, want = run(spark, rows), slow(rows)
    assert got == want
    assert all(g[-1] == (g[5] == g[3]) for g in got)


def test_defined_cases(spark):
    rows = [
        row(None, "a"), row(None, "a", None), row(5, None, None), row(6, None, ""), row(7, None, "ABC" * 500_000),
        row(8, "a", "x"), row(8, "a", "x"), row(8, "a", "Y", None), row(10, "-", "-"), row(11, "a\nb", "1:2"),
    ]
    assert run(spark, rows) == slow(rows)
    assert run(spark, []) == [] and run(spark, [row(1, None, None)]) == slow([row(1, None, None)])


def test_tampering_is_found(spark):
    rows = [row(i, f"s{i % 3}", "Capital" if i % 2 else "small") for i in range(200)]
    for doc, *_, verified in run(spark, rows):
        assert verified is not (zlib.crc32(str(doc).encode()) % 5 == 0 and doc % 2 == 1)


def test_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    name = "op12_nested_interval_merkle"
    assert difference(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) is None
