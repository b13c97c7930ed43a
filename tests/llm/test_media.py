import hashlib
import io
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.archives import Package, read_packages, write_package, write_packages
from tidemark.llm.common import stored
from tidemark.llm.transport import PACKET, demux, mux, op8_transport_streams, payload_of, read_media, to_media

from .conftest import edge_rows


@given(st.binary(min_size=64, max_size=3000), st.sampled_from([64, 100, 162, 170, 1000, 32768]))
@settings(max_examples=120, deadline=None)
def test_streams_round_trip(payload, size):
    s = mux(payload, size)
    x = demux(s)
    assert len(s) % PACKET == 0 and b"".join(p[3] for p in x["packets"]) == payload
    assert (x["lost"], x["jumps"], x["short"]) == (0, 0, 0) and x["programs"] == {1: 4096} and x["streams"] == {257: 6}
    assert [p[1] for p in x["packets"]] == [k * 3600 for k in range(-(-len(payload) // size))]
    assert [k for k, p in enumerate(x["packets"]) if p[2]] == list(range(0, len(x["packets"]), 16))
    for k, p in enumerate(x["packets"]):
        if p[2]:  # a reader that begins with the tables before a point gets all that follows
            rest = demux(s[p[4] - 2 * PACKET :])
            assert b"".join(q[3] for q in rest["packets"]) == payload[k * size :] and rest["jumps"] == 0 and rest["programs"] == {1: 4096}
            assert rest["packets"][0][1] == p[1]


def test_streams_with_faults():
    s = mux(bytes(range(256)) * 20)
    packets = [s[i : i + PACKET] for i in range(0, len(s), PACKET)]
    lost = demux(b"".join(packets[:5] + packets[6:]))
    assert lost["jumps"] == 1 and lost["short"] == 1
    twice = demux(b"".join(packets[:6] + packets[5:]))
    assert twice["jumps"] == 0 and twice["packets"][0][3] == bytes(range(256)) * 20
    assert demux(b"x" + s[1:])["lost"] == 1 and demux(s[:-1])["lost"] == 1
    broken = bytearray(s)
    broken[20] ^= 1  # within the program association table
    assert demux(bytes(broken))["programs"] == {}
    assert demux(b"")["packets"] == []


def test_documents_as_streams(spark, edge, none):
    got = read_media(to_media(edge)).collect()
    want = sorted((str(d), len((t or "").encode()), hashlib.sha256(payload_of(t)).hexdigest()) for d, t in edge_rows())
    assert sorted((str(r.doc_id), r.n_bytes, hashlib.sha256(r.payload).hexdigest()) for r in got) == want
    assert all(r.lost + r.jumps + r.short == 0 and len(r.payload) % 64 == 0 and len(r.payload) > 0 for r in got)
    assert read_media(to_media(none)).count() == 0


def test_query_reads_a_stored_table(spark, tmp_path, edge):
    import re

    edge.write.parquet(f"{tmp_path}/documents.parquet")
    got = op8_transport_streams(spark, str(tmp_path))
    assert re.search(r"Location: [^\n]*/tidemark/media-", got._jdf.queryExecution().executedPlan().treeString())
    rows = sorted(got.collect(), key=lambda r: (str(r.doc_id), r.payload_sha256))
    want = []
    for d, t in edge_rows():
        payload = payload_of(t)
        media = mux(payload)
        points = [p for p in demux(media)["packets"] if p[2]]
        last = (len(payload) - 1) // 32768 * 3600
        feature = f"programs=1:4096;streams=257:6;pes={-(-len(payload) // 32768)};pts=0-{last};access={','.join(str(p[4]) for p in points)};errors=0"
        want.append((d, len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
    assert [tuple(r) for r in rows] == sorted(want, key=lambda r: (str(r[0]), r[3]))


@pytest.mark.parametrize("wide", [True, False])
def test_package_of_a_file(tmp_path, wide):
    from tidemark.llm.archives import record

    recs = [(i, f"http://x/{i} y\n", record(i, f"http://x/{i} y\n", b"p" * i, "d", None)) for i in range(5)]
    path = tmp_path / "a.zip"
    path.write_bytes(write_package(recs, zip64=wide))
    assert zipfile.ZipFile(path).testzip() is None
    with path.open("rb") as f:
        p = Package(f)
        entries = list(p.index())
        assert [e["page_id"] for e in entries] == list(range(5))
        head, block = p.read(entries[3]["offset"], entries[3]["length"])
        assert head["WARC-Type"] == "response" and block.endswith(b"\r\n\r\nppp") and head["WARC-Target-URI"] == "http://x/3 y%0A"
        with pytest.raises(ValueError):
            p.read(entries[-1]["offset"], 10**9)


def test_package_with_zip64_directory():
    """A directory that stands in the ZIP64 records only, as with more than 65,535 members."""
    import struct

    raw = write_package([(1, "u", b"WARC/1.1\r\nContent-Length: 1\r\n\r\nx\r\n\r\n")])
    end = raw.rfind(b"PK\5\6")
    count, size, at = struct.unpack("<HII", raw[end + 10 : end + 20])
    big = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, at)
    locator = b"PK\6\7" + struct.pack("<IQI", 0, end, 1)
    short = raw[end : end + 8] + struct.pack("<HHIIH", 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    p = Package(io.BytesIO(raw[:end] + big + locator + short))
    entry = next(p.index())
    assert p.read(entry["offset"], entry["length"])[1] == b"x"
    with pytest.raises(ValueError):
        Package(io.BytesIO(b"no archive"))


def test_pages_round_trip(spark):
    big = "x" * 150
    rows = [(3, "u", big), (1, "v", big), (2, None, "small"), (4, "w", "small"), (5, "é", None), (None, "n", big), (1, "v", big), (6, "z", "é" * 60), (7, "z", "é" * 60)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in read_packages(stored(write_packages(pages, 200), "p")).collect())
    refers = {3: 1, 7: 6}
    want = sorted((str(i), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if i in refers else "response", str(refers.get(i))) for i, _, h in rows)
    assert got == want
    assert read_packages(stored(write_packages(pages.limit(0)), "p")).count() == 0


def test_crc_is_the_engine_s(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.crc32(F.lit(b"abc"))).first()[0] == zlib.crc32(b"abc")
