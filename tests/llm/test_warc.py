"""WARC: exact round trips and salvage of damaged archives."""

import gzip
import hashlib
import random
import re

import numpy as np
import pytest

from groundwork.llm import warc


def record(number, payload, digest=None):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    digest = digest or hashlib.sha256(block).hexdigest()
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{number}>\r\nWARC-Block-Digest: sha256:{digest}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def ids(found):
    return [h["warc-record-id"][10:-1] for h, _, _ in found.records]


def test_clean_archive_with_a_version_line_in_a_payload():
    data = b"".join(record(i, b"x\r\n\r\nWARC/1.1\r\nWARC-Type: fake\r\n\r\n" * 3) for i in range(5))
    found = warc.salvage_archive(data)
    assert ids(found) == list("01234") and not found.gaps


def test_damage_is_a_gap_and_later_records_are_found():
    parts = [record(i, bytes([65 + i]) * 300) for i in range(6)]
    broken = parts[1][:120] + b"?" + parts[1][121:]
    cut = parts[3][:200]
    data = parts[0] + broken + parts[2] + cut + parts[4] + b"junk" + parts[5]
    found = warc.salvage_archive(data)
    assert ids(found) == ["0", "2", "4", "5"]
    assert [(a, n) for a, n, _ in found.gaps] == [(len(parts[0]), len(broken)), (len(parts[0] + broken + parts[2]), len(cut)), (len(data) - len(parts[5]) - 4, 4)]


def test_wrong_digest_and_cut_end():
    data = record(0, b"a") + record(1, b"b", "0" * 64) + record(2, b"c") + record(3, b"d")[:-30]
    found = warc.salvage_archive(data)
    assert ids(found) == ["0", "2"] and [r for _, _, r in found.gaps][0] == "block digest differs"


def test_damaged_members_are_skipped():
    members = [gzip.compress(record(i, bytes([65 + i]) * 4000 + str(i).encode() * 50)) for i in range(5)]
    bad = bytearray(members[2])
    bad[len(bad) // 2] ^= 0xFF
    found = warc.salvage_archive(members[0] + members[1] + bytes(bad) + members[3] + b"\0\0junk" + members[4])
    assert {"0", "1", "3", "4"} <= set(ids(found)) and found.gaps


def test_damaged_head_of_a_packed_archive():
    rng = random.Random(1)
    members = [gzip.compress(record(i, rng.randbytes(6000).hex().encode())) for i in range(5)]
    data = bytearray(b"".join(members))
    data[: 8 << 10] = rng.randbytes(8 << 10)
    found = warc.salvage_archive(bytes(data))
    assert ids(found) == ["2", "3", "4"] and found.gaps
    plain = record(0, b"x" * 5000) + record(1, gzip.compress(record(7, b"y"))) + record(2, b"z")
    assert ids(warc.salvage_archive(b"?" * 20 + plain[20:])) == ["1", "2"]  # a packed payload does not make a plain archive a packed one


def test_damage_inside_a_written_archive(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>é {i} " * 200) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.with_revisits(pages).coalesce(1), f"file://{tmp_path}/a")
    (path,) = (tmp_path / "a").glob("part-*")
    data = bytearray(path.read_bytes())
    assert gzip.decompress(bytes(data)).count(b"WARC/1.1\r\n") == 40
    assert len(warc.salvage_archive(bytes(data)).records) == 40 and not warc.salvage_archive(bytes(data)).gaps
    data[len(data) // 2] ^= 0xFF
    found = warc.salvage_archive(bytes(data))
    assert len(found.records) == 39 and found.gaps


def test_records_after_a_cut_member_are_found():
    members = [gzip.compress(record(i, bytes([65 + i]) * 3000 + random.Random(i).randbytes(2000))) for i in range(4)]
    found = warc.salvage_archive(members[0] + members[1][:-900] + members[2] + members[3])
    assert ids(found) == ["0", "2", "3"] and [a for a, _, _ in found.gaps][0] == len(members[0])
    found = warc.salvage_archive(members[0] + members[1][: len(members[1]) // 2])
    assert ids(found) == ["0"] and found.gaps[0][:2] == (len(members[0]), len(members[1]) // 2)


def test_gaps_are_logged_by_the_query(spark, tmp_path):
    from pyspark.sql.types import LongType

    pages = spark.createDataFrame([(i, "u", f"<p>{i} " * 90) for i in range(20)], "page_id long, url string, html string")
    warc.write_archives(warc.with_revisits(pages).coalesce(1), f"file://{tmp_path}/a")
    (path,) = (tmp_path / "a").glob("part-*")
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 0xFF
    path.write_bytes(bytes(data))
    (tmp_path / "a" / f".{path.name}.crc").unlink(missing_ok=True)
    rows = warc.pages_read(spark, f"file://{tmp_path}/a", LongType()).collect()
    gaps = [r for r in rows if r.record_type == "gap"]
    assert len(rows) - len(gaps) == 19 and gaps and all(r.page_id is None and r.payload_bytes > 0 for r in gaps)


def test_large_record_is_a_whole_member():
    packed = warc._member(record(1, b"x" * (1 << 24))) + b"\0" + warc._member(record(2, b"y")) + b"\0"
    assert ids(warc.salvage_archive(packed)) == ["1", "2"] and not warc.salvage_archive(packed).gaps


def test_round_trip(spark):
    long = "<p>é " * 60
    rows = [(3, "u", long), (1, "u", long), (2, "v", long), (4, None, "tiny"), (5, "w\nx", "tiny"), (6, "w", None), (None, "n", "no id " * 40), (7, "w", "WARC/1.1\r\n\r\n" * 30), (2, "v", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("payload", "payload_digest", "payload_bytes", "refers_to", "record_type", "_n", "_first", "value", "kind", "length"):
        pages = pages.selectExpr("*", f"'x' AS {name}")  # names that are used inside
    out = sorted(map(tuple, warc.round_trip(pages).collect()), key=str)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        twin = len(data) >= 100 and html == long and i != 1
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if twin else "response", 1 if twin else None))
    assert out == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_gaps_come_as_rows(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(1, b"x" * 200) + b"garbage" + record(2, b"y" * 200))
    rows = {r.kind: r for r in warc.read_archives(spark, f"file://{tmp_path}").collect()}
    assert rows["gap"].length == 7 and bytes(rows["record"].payload)[:1] in (b"x", b"y")


@pytest.mark.parametrize("name,value", [(b"Content-Length", "\u00b2"), (b"Content-Length", "-5"), (b"Content-Length", "9" * 40), (b"Content-Length", "999999999"), (b"Content-Length", "1x"), (b"X-Payload-Length", "1x"), (b"X-Payload-Length", "-1")])
def test_headers_that_are_no_numbers_are_gaps(spark, tmp_path, name, value):
    parts = [record(i, b"payload %d" % i) for i in range(3)]
    bad = re.sub(rb"(?<=Content-Length: )[0-9]+", value.encode(), parts[1]) if name == b"Content-Length" else re.sub(rb"WARC-Type: \w+", b"WARC-Type: revisit\r\n" + name + b": " + value.encode(), parts[1])
    assert bad != parts[1]
    (tmp_path / "a.warc").write_bytes(parts[0] + bad + parts[2])
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.record_id for r in rows if r.kind == "record") == ["0", "2"] and [(r.at, r.length) for r in rows if r.kind == "gap"] == [(len(parts[0]), len(bad))]


@pytest.mark.parametrize("packed", [False, True])
def test_random_damage_never_raises_and_costs_only_its_records(packed):
    rng = random.Random(7)
    parts = [record(i, bytes(rng.randrange(256) for _ in range(rng.randrange(400)))) for i in range(6)]
    if packed:
        parts = [gzip.compress(p) for p in parts]
    starts = np.cumsum([0, *map(len, parts)])
    for _ in range(1000):
        data = bytearray(b"".join(parts))
        hit = set()
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(data))
            data[at] = rng.randrange(256)
            hit.add(str(int(np.searchsorted(starts, at, side="right") - 1)))
        found = warc.salvage_archive(bytes(data))
        assert {str(i) for i in range(6)} - hit <= {h.get("warc-record-id", "")[10:-1] for h, _, _ in found.records}
