import base64
import hashlib
import io

from rulequarry.llm import warc

PAGES = [(5, "http://a", "x"), (3, "http://b\nc", "x"), (9, None, "y" * 100_000), (1, "http://d", None), (2, "u", ""), (None, "u", "x"), (3, "http://b", "x"), (7, "é", "ü\x1f\x8b\x08é")]


def test_op8(spark):
    got = sorted(map(tuple, warc.write_and_read(spark.createDataFrame(PAGES, "page_id long, url string, html string")).collect()), key=str)
    want = []
    for i, _, h in PAGES:
        same = [p for p, _, x in PAGES if (x or "") == (h or "") and p is not None]
        revisit = i is not None and i != min(same)
        data = (h or "").encode()
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", min(same) if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.write_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_every_split_owns_its_records():
    data = b"".join(warc.member(warc.record(i, "u", bytes([i]) * (i * 37) + warc.MAGIC * i, None)) for i in range(1, 60))
    for split in (1, 7, 100, 5000, len(data)):
        seen = [warc.parse(c)[0] for s in range(0, len(data), split) for _, c in warc.records(io.BytesIO(data), len(data), s, s + split)]
        assert seen == list(range(1, 60))


def test_junk_between_members_is_skipped():
    good = warc.member(warc.record(4, "u", b"abc", None))
    data = warc.MAGIC + b"junk" + good + b"\x1f\x8b\x08\x00" + good[:20] + good
    assert [warc.parse(c)[0] for _, c in warc.records(io.BytesIO(data), len(data), 0, len(data))] == [4, 4]
