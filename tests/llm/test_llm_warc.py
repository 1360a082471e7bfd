"""Operator 12: archives written, normalised and read back, against what went in."""

import gzip
import hashlib
import io
import random

import pytest

from factweave.llm import warc


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, key string, n string, _rid string, payload string")


def plain(rows, least):
    """Rows of the result; of equal payloads that of the largest id, then the first, is the response."""
    best = {}
    for i, (p, _, h) in enumerate(rows):
        best[h or ""] = max(best.get(h or "", (False,)), (True, p is not None, p or 0, -i))
    out = []
    for i, (p, _, h) in enumerate(rows):
        data = (h or "").encode()
        first = best[h or ""]
        again = len(data) >= least and first[3] != -i
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", (first[2] if first[1] else None) if again else None))
    return sorted(out, key=str)


def pages():
    rng = random.Random(5)
    long = ["".join(rng.choice("ab é<>\r\n\t漢") for _ in range(rng.randint(900, 4000))) for _ in range(12)]
    rows = [(i * 13 % 101, f"http://x/{i} y\r\nz", rng.choice([*long, None, "", "short", "same small"])) for i in range(90)]
    trap = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 40
    rows += [(500, None, trap), (501, "", trap), (501, "u", trap), (None, "u", trap), (None, None, long[0]), (None, None, "z" * 1000), (None, None, "z" * 1000), (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "u", "y" * 3_000_000)]
    return rows


def test_round_trip(spark):
    rows = pages()
    df = frame(spark, [(*r, "a", "b", "c", "d") for r in rows]).coalesce(3)
    numbered = [(r["page_id"], r["url"], r["html"]) for r in df.collect()]
    assert [r[2] for r in numbered] == [r[2] for r in rows]
    out = warc.round_trip(df, payloads=True)
    got = out.collect()
    assert out.dtypes[:5] == [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain(rows, 1000)
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in got if r["payload"] is not None)


def test_empty_table(spark):
    assert warc.round_trip(frame(spark, [])).count() == 0


def test_members_stand_alone_and_the_sidecar_says_where(spark, tmp_path):
    rows = pages()
    whole, folder = f"file://{tmp_path}/whole", f"file://{tmp_path}/members"
    warc.write_monolithic(frame(spark, [(*r, "a", "b", "c", "d") for r in rows]).coalesce(2), whole)
    sources = list((tmp_path / "whole").glob("*.gz"))
    assert len(sources) == 2 and all(members_of(p.read_bytes()) == 1 for p in sources)
    (tmp_path / "members").mkdir()
    (tmp_path / "members" / "left-by-a-failed-attempt.warc.gz").write_bytes(b"x")
    index = warc.normalise(spark, whole, folder)
    entries = sorted(map(tuple, index.collect()))
    assert sorted(map(tuple, warc.sidecar(spark, folder).select(*index.columns).collect())) == entries and len(entries) == len(rows)
    assert not list((tmp_path / "members").glob("left-by*"))
    files = {f: (tmp_path / "members" / f.rsplit("/", 1)[-1]).read_bytes() for f in {e[0] for e in entries}}
    assert sorted(gzip.decompress(d) for d in files.values()) == sorted(gzip.decompress(p.read_bytes()) for p in sources)
    for f, data in files.items():
        mine = [e for e in entries if e[0] == f]
        assert [e[1] for e in mine] == list(range(len(mine))) and sum(e[3] for e in mine) == len(data) and members_of(data) == len(mine)
        for _, _, offset, length, name, kind in mine:
            one = gzip.decompress(data[offset : offset + length])
            assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n") and f"WARC-Record-ID: {name}\r\n".encode() in one and f"WARC-Type: {kind}\r\n".encode() in one
    split = warc.read(index, split_bytes=1000).collect()
    assert sorted(map(str, split)) == sorted(map(str, warc.read(index).collect()))


def members_of(data):
    import zlib

    n = 0
    while data:
        one = zlib.decompressobj(31)
        one.decompress(data)
        data, n = one.unused_data, n + 1
    return n


def test_foreign_archives(tmp_path):
    """Other kinds of records, several members, odd sizes of pieces; and files that are broken."""
    records = [f"WARC/1.0\r\nWARC-Type: {k}\r\nWARC-Record-ID: <urn:x:{i}>\r\ncontent-length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for i, (k, b) in enumerate([("warcinfo", b"software: x"), ("metadata", b""), ("resource", b"\r\n\r\n" * 9), ("conversion", bytes(range(256)) * 9000)])]
    (tmp_path / "out").mkdir()
    source = tmp_path / "a.warc.gz"
    source.write_bytes(gzip.compress(b"".join(records[:2])) + gzip.compress(b"".join(records[2:])))
    rows = list(warc.normalised_file(str(source.as_uri()), (tmp_path / "out").as_uri()))
    assert [r["record_type"] for r in rows] == ["warcinfo", "metadata", "resource", "conversion"]
    data = (tmp_path / "out" / rows[0]["file"].rsplit("/", 1)[-1]).read_bytes()
    assert [gzip.decompress(data[r["offset"] :][: r["length"]]) for r in rows] == records
    for size in (1, 7, 1000):
        pieces = iter(lambda f=io.BytesIO(source.read_bytes()): f.read(size), b"")
        assert b"".join(warc.inflated(pieces)) == b"".join(records)
    for broken in (gzip.compress(b"".join(records))[:-9], gzip.compress(records[2][:-6]), gzip.compress(b"junk" + records[0]), gzip.compress(records[0] + b"WARC/1.0\r\nx: 1\r\n\r\n"), b"no gzip"):
        source.write_bytes(broken)
        with pytest.raises(ValueError, match=r"a\.warc\.gz"):
            list(warc.normalised_file(str(source.as_uri()), (tmp_path / "out").as_uri()))


def test_a_payload_must_have_its_digest():
    bad = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1:1>\r\nWARC-Payload-Digest: sha1:00\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 22\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        warc.record(warc.Stream(iter([bad])), True)
