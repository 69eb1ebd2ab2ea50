from __future__ import annotations

import hashlib
import random

from millrace.llm import warc as R


def test_loser_tree_merges_as_sorting_does():
    rng = random.Random(1)
    for _ in range(150):
        runs = [sorted(((str(rng.randint(0, 5)), "t", rng.choice([None, 1, 2, 3]), "", "", "", 0, None, "f", rng.randint(0, 99), 0, True) for _ in range(rng.randint(0, 8))), key=R._order) for _ in range(rng.randint(0, 9))]
        rows = [x for r in runs for x in r]
        assert [R._order(x) for x in R.LoserTree(runs)] == sorted(map(R._order, rows))
        assert [x for r in R.ascending(rows) for x in r] == rows


def test_url_keys():
    assert R.url_key("https://www.Example.com:80/A?b=1#c") == "com,example:80)/A?b=1"
    assert R.url_key("http://x.org") == "org,x)/"
    assert R.url_key("user@h.de/p") == "de,h)/p"
    assert R.url_key("") == ")/"


PAGES = [
    (1, "http://b.org/x", "p" * 200, 1), (2, "http://a.org/\r\nEvil: 1", "p" * 200, 1), (3, None, "small", 1), (4, "http://a.org", "small", 1),
    (5, "http://a.org", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 9, 1), (6, "http://www.b.org/x", None, 1), (7, "http://b.org/x", "", 1),
    (8, "http://b.org/x", "é" * 50, 1), (9, "http://b.org/x", "é" * 50, 1), (9, "http://b.org/x", "é" * 50, 1), (None, "http://b.org/x", "p" * 200, 1),
    (10, "http://b.org/x", "\n" * 99, 1), (11, "http://b.org/x", "\n" * 99, 1), (12, "h", "x" * 100_000, 1),
]


def test_round_trip_and_order(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest int")
    path = str(tmp_path / "w")
    got = R.archive(pages, path, file_bytes=3000).collect()
    want = []
    for page_id, _, html, _ in PAGES:
        raw = (html or "").encode()
        first = min(i for i, _, h, _ in PAGES if i is not None and (h or "").encode() == raw)
        revisit = len(raw) >= 100 and page_id != first
        want.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.intact for r in got) and len({r.file for r in got}) > 1
    keys = [(r.url_key, r.time, -1 if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys)
    raw = {f.name: f.read_bytes() for f in (tmp_path / "w").glob("part-*")}
    for r in got:  # the index leads to the record
        record = raw[r.file][r.offset : r.offset + r.length]
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and f"urn:page:{'' if r.page_id is None else r.page_id}>".encode() in record


def test_index_as_text_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest int")
    index = R.archive(pages)
    R.write_index(index, str(tmp_path / "i"))
    lines = [x for f in sorted((tmp_path / "i").glob("part-*")) for x in f.read_text().splitlines()]
    assert len(lines) == len(PAGES) and [x.split()[:2] for x in lines] == sorted(x.split()[:2] for x in lines)
    assert R.archive(pages.limit(0)).count() == 0
