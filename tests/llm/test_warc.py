"""WARC files: what comes back, what is in them, and that they do not depend on the layout."""

import gzip
import hashlib
import json

import pytest

from stayline.llm import warc

SMALL = warc.Settings(shard_bytes=6000, roll_bytes=2500)
BIG, OTHER = "<p>é" + "x" * 1200, "<p>" + "yz " * 900
ROWS = [
    (5, "http://a/5", BIG), (9, "http://a/9", BIG), (2, "http://a/2", BIG), (7, "http://a/7", OTHER), (7, "http://a/7", OTHER), (8, None, "short"),
    (10, "http://a/10\r\nX: y", "short"), (11, "http://a/11", None), (12, "", ""), (None, "http://n", BIG), (None, "http://n", BIG), (None, None, "alone" * 400), (None, None, "alone" * 400), (None, None, None), (8, None, "short"), (3, "http://a/3", OTHER),
    (-4, "http://a/m", "\r\n\r\nbody\r\n\r\n" * 300), (1 << 62, "http://far", "z" * 999), (9, "http://a/9b", "q" * 5000), (13, "u", "Line\n" * 20000),
]


def expected(rows):
    largest = {}
    for page_id, _, html in rows:
        if page_id is not None and len((html or "").encode()) >= 1000:
            largest[html] = max(largest.get(html, page_id), page_id)
    out, held = [], set()
    for page_id, _, html in rows:
        data = (html or "").encode()
        keeper = largest.get(html)
        revisit = keeper is not None and (keeper != page_id or (page_id, html) in held)
        held.add((page_id, html))
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=repr)


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, shard int").repartition(partitions)


def read(spark, folder):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[n] for n in names) for r in warc.read_warc(spark, folder).collect()), key=repr)


def test_round_trip(spark, tmp_path):
    folder = warc.write_warc(frame(spark, ROWS), str(tmp_path / "w"), SMALL)
    assert read(spark, folder) == expected(ROWS)
    back = {(r["page_id"], r["record_type"]): r for r in warc.read_warc(spark, folder).collect()}
    assert bytes(back[13, "response"]["html"]).decode() == "Line\n" * 20000 and back[2, "revisit"]["html"] is None
    assert back[10, "response"]["url"] == "http://a/10%0D%0AX: y"


def test_files(spark, tmp_path):
    folder = tmp_path / "w"
    warc.write_warc(frame(spark, ROWS), str(folder), SMALL)
    listed = json.loads((folder / "manifest.json").read_text())
    assert listed["records"] == len(ROWS) and len(listed["files"]) > 3
    assert sorted(p.name for p in folder.glob("*.gz")) == [f["name"] for f in listed["files"]]
    assert not list((folder / "_temporary").iterdir())
    ids, names = [], []
    for f in listed["files"]:
        data = (folder / f["name"]).read_bytes()
        assert len(data) == f["bytes"] and hashlib.sha1(data).hexdigest() == f["sha1"]
        text = gzip.decompress(data)
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        ids += [int(line.split(b": ")[1]) for line in text.split(b"\r\n") if line.startswith(b"X-Page-ID: ")]
        names += [line for line in text.split(b"\r\n") if line.startswith(b"WARC-Record-ID: ")]
    assert ids == sorted(ids) and len(set(names)) == len(names) == len(ROWS) + len(listed["files"])


def test_same_bytes_whatever_the_layout(spark, tmp_path):
    lists = []
    for partitions, shuffle in ((1, "3"), (6, "9")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        folder = tmp_path / str(partitions)
        warc.write_warc(frame(spark, ROWS, partitions), str(folder), SMALL)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        lists.append(json.loads((folder / "manifest.json").read_text()))
    assert lists[0] == lists[1]


def test_bounds_follow_the_bytes(spark):
    rows = [(i, 100) for i in range(50)] + [(1_000_000_000 + i, 100) for i in range(50)] + [(77, 5000)]
    bounds, parts = warc.shard_bounds(spark.createDataFrame(rows, "page_id long, size long"), 1000)
    assert bounds == sorted(bounds) and max(parts) == 5 and sum(parts) >= 15
    sizes = [sum(s for i, s in rows if a <= i < b) for a, b in zip(bounds, [*bounds[1:], 1 << 60])]
    assert all(size <= 1000 * n for size, n in zip(sizes, parts))


def test_damage_and_empty_table(spark, tmp_path):
    folder = warc.write_warc(frame(spark, ROWS[:1]).where("false"), str(tmp_path / "e"))
    assert warc.read_warc(spark, folder).count() == 0
    folder = tmp_path / "d"
    warc.write_warc(frame(spark, [(1, "u", "a" * 50)]), str(folder))
    (path,) = folder.glob("*.gz")
    members = gzip.decompress(path.read_bytes()).replace(b"a" * 50, b"a" * 49 + b"b")
    head, rest = members.split(b"WARC/1.1\r\nWARC-Type: response")
    path.write_bytes(gzip.compress(head) + gzip.compress(b"WARC/1.1\r\nWARC-Type: response" + rest))
    with pytest.raises(Exception, match="damaged"):
        warc.read_warc(spark, str(folder)).collect()
