import gzip
import hashlib
import random

import pytest

from shoalgrid.llm import warc


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions_and_conversion(version):
    bodies = [warc.page_body(7, "é\r\n\r\n\n".encode()), b"", b"plain dns answer\n", b"HTTP/1.0 404 Not Found\n\n" + b"x" * 3000]
    data = warc.write_arc([{"url": f"http://a b/{i}", "ip": "1.2.3.4", "date": "20010203040506", "mime": "text/html", "body": b} for i, b in enumerate(bodies)], version)
    assert [e["body"] for e in warc.parse_arc(data)][1:] == bodies
    got = list(warc.convert(data))
    assert [g["type"] for g in got] == ["warcinfo", "response", "resource", "resource", "response"]
    assert got[1]["payload"] == "é\r\n\r\n\n".encode() and got[4]["payload"] == b"x" * 3000
    assert got[1]["date"] == "2001-02-03T04:05:06Z" and got[1]["uri"] == "http://a%20b/0"
    assert got[4]["digest"] == hashlib.sha1(b"x" * 3000).hexdigest() and len({g["record_id"] for g in got}) == 5
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-30]))


def brute(rows):
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "").encode() == p and j is not None]
        first = max(ids, default=None) if len(p) >= 1000 else None
        revisit = first is not None and i != first
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    big, edge = "é" * 500, "y" * 999
    rows = [(1, "http://x/1", big), (5, "http://x/2", big), (3, None, big), (2, "u\n v", edge), (4, "u", edge), (6, "", None), (7, "u", ""), (None, "u", big), (8, "u", "WARC/1.1\r\n\r\n" * 200), (8, "u", "WARC/1.1\r\n\r\n" * 200), (5, "http://x/2", big)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "w")
    got = [tuple(r) for r in warc.archive_round_trip(df, path).collect()]
    assert sorted(got, key=str) == brute(rows)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.txt")))
    assert len(list(warc.parse_warc(data))) == len(rows) and data.endswith(b"\r\n\r\n")
    assert warc.archive_round_trip(df.where("false"), str(tmp_path / "e")).count() == 0
    # the URLs come back as archives hold them
    assert sorted(r.uri for r in warc.read_warc(spark, path).collect()) == sorted(warc.target_uri(u) for _, u, _ in rows)
    assert warc.target_uri("u\n v\u00a0é") == "u%0A%20v%C2%A0é" and warc.target_uri(None) == warc.target_uri("") == "unknown:"


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PACK_BYTES", 4000)
    monkeypatch.setattr(warc, "PACKS", 3)
    monkeypatch.setattr(warc, "CONTAINER_BYTES", 30_000)
    rng = random.Random(5)
    rows = [(i, "http://x", "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice([10, 400, 3000])))) for i in range(300)] + [(300, "http://x", "z" * 5_000_000), (301, "http://x", "".join(map(str, range(20_000))))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = tmp_path / "w"
    assert sorted([tuple(r) for r in warc.archive_round_trip(df, str(path)).collect()], key=str) == brute(rows)
    files = list(path.glob("*.txt"))
    assert len(files) > 8 and max(f.stat().st_size for f in files) < 3 * 4000 + 80_000
    # each record is a gzip member of its own
    records = [m for f in files for m in warc.members(f.read_bytes()) if m]
    assert len(records) == len(rows) and all(m.startswith(b"WARC/1.1") and m.endswith(b"\r\n\r\n") for m in records)
    with pytest.raises(ValueError):
        list(warc.members(files[0].read_bytes()[:-25]))


def test_reading_legacy_archives(spark, tmp_path):
    entries = [{"url": f"http://a/{i}", "ip": "1.2.3.4", "date": "20010203040506", "mime": "text/html", "body": b"HTTP/1.0 200 OK\r\nX: \xe9\r\n\r\n" + bytes([65 + i]) * (1200 + i % 2)} for i in range(6)]
    one, two = warc.write_arc(entries[:4], 1), warc.write_arc([*entries[4:], entries[0]], 2)
    (tmp_path / "one.arc").write_bytes(one)
    (tmp_path / "two.arc.gz").write_bytes(gzip.compress(two[:700]) + gzip.compress(two[700:]))
    (tmp_path / "none.arc").write_bytes(b"")
    got = warc.read_arc(spark, str(tmp_path))
    assert sorted(bytes(r.payload) for r in got.collect()) == sorted([e["body"].split(b"\r\n\r\n")[1] for e in [*entries, entries[0]]])
    out = warc.read_warc(spark, warc.write_warc(warc.mark_revisits(got), str(tmp_path / "out"))).collect()
    assert len(out) == 7 and {r.date for r in out} == {"2001-02-03T04:05:06Z"} and all(r.page_id is None for r in out)
