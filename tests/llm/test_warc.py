import base64
import hashlib

import pytest
import zstandard
from wavelark.llm import warc as W

SCHEMA = "page_id long, url string, html string, payload string, first long"


def expected(rows, least):
    first = {}
    for page, _, html in rows:
        first[html or ""] = min([x for x in (first.get(html or ""), page) if x is not None], default=None)
    out = []
    for page, url, html in rows:
        data = (html or "").encode()
        own = page == first[html or ""] or len(data) < least
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "response" if own else "revisit", None if own else first[html or ""], url))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, frame, bundle", [(0, 64, 300), (3, 1 << 18, 1 << 28)])
def test_round_trip(spark, tmp_path, monkeypatch, least, frame, bundle):
    monkeypatch.setattr(W, "FRAME", frame)
    monkeypatch.setattr(W, "BUNDLE", bundle)
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>") for i in range(60, 0, -1)]
    rows += [(70, None, None), (71, "u", ""), (72, "a\r\nb%0D: c", "é\r\n\r\n中"), (72, "again", "é\r\n\r\n中"), (None, "n", "<p>1</p>")]
    rows += [(80, "long", "z" * 300000), (3, "http://x/3", "<p>3</p>")]
    pages = spark.createDataFrame([(*r, "clash", 9) for r in rows], SCHEMA).repartition(3)
    bundles = W.write_bundles(pages, str(tmp_path / "out"), least=least)
    got = W.read_bundles(bundles).collect()
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
    assert sorted((tuple(r[f] for f in fields) for r in got), key=str) == expected(rows, least)
    assert sum(b.records for b in bundles.collect()) == len(rows)
    # One record by its id, and every frame by a plain Zstandard reader.
    for bundle_row in bundles.collect():
        reader = W.BundleReader(bundle_row.address)
        own = reader.places[-1][0]
        assert W.parse_record(reader.record(own))[-1] == own
        with open(bundle_row.address, "rb") as file:
            whole = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
        assert whole == b"".join(reader.frame(i) for i in range(len(reader.frames)))
        assert [len(reader.frame(i)) for i in range(len(reader.frames))] == [c for _, _, c in reader.frames]


def test_damage_is_found(spark):
    own, record = W.make_record(1, "u", b"hello", None, False)
    assert W.parse_record(record)[1] == 5
    with pytest.raises(ValueError):
        W.parse_record(record.replace(b"hello", b"hullo"))


def test_empty_table(spark, tmp_path):
    assert W.read_bundles(W.write_bundles(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))).collect() == []


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = W.warc_round_trip(pages).collect()
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
    assert sorted((tuple(r[f] for f in fields) for r in got), key=str) == expected(rows, 0)
