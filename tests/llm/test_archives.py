"""Archives: round trips, revisits against brute force, and damaged files."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from jobsight.llm import warc

SCHEMA = "page_id long, url string, html string"


def page_rows():
    rng = random.Random(3)
    body = lambda n: "".join(rng.choice("abcdé日 <>\r\n") for _ in range(n))
    same, exact, short = body(3000), "x" * 1000, body(100)
    rows = [(i, f"http://a.example/{i}", body(rng.randrange(0, 4000))) for i in range(40)]
    rows += [(100 + i, f"http://b.example/{i % 7}", same) for i in range(60)]  # a hot payload
    rows += [(159, "http://z.example/", same)] * 3 + [(159, None, same), (None, "n", same)]  # ties and repeated rows
    rows += [(200, "u", exact), (201, "u", exact), (202, "u", "x" * 999), (203, "u", "x" * 999)]
    rows += [(300, None, None), (301, "two words\r\nWARC-Type: x", ""), (302, "http://ü.example/日", short), (303, "q", short)]
    rows += [(None, None, body(1500)), (400, "big", "WARC/1.1\r\n\x1f\x8b" + body(400_000))]
    rows += [(None, "m", "null ids " * 200), (None, "m", "null ids " * 200)]
    return rows


def wanted(rows, least=1000):
    groups: dict[str, list] = {}
    for page_id, _, html in rows:
        groups.setdefault(html or "", []).append(page_id)
    out = Counter()
    for text, ids in groups.items():
        data = text.encode()
        keep = max(ids, key=lambda i: -1 if i is None else i)
        first = ids.index(keep)
        for place, i in enumerate(ids):
            again = len(data) >= least and place != first
            out[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", keep if again else None] += 1
    return out


@pytest.fixture(scope="module")
def pages(spark):
    frame = spark.createDataFrame(page_rows(), SCHEMA).repartition(4)
    return frame.selectExpr("*", "1 AS payload", "2 AS n", "3 AS part", "4 AS _key", "5 AS keep_id", "6 AS record_type").cache()


def test_pages_come_back(pages):
    got = warc.archive_pages(pages)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, got.collect())) == wanted(page_rows())


def test_small_files_and_payloads(spark, pages, tmp_path):
    files = warc.write_archives(pages, f"file://{tmp_path}", least=50, file_bytes=2000)
    assert files.count() > 20
    assert {f.name for f in tmp_path.iterdir()} == {r["name"] for r in files.collect()}
    read = warc.read_archives(files, f"file://{tmp_path}").collect()
    assert Counter(r["record_type"] for r in read)["gap"] == 0
    pages_read = [r for r in read if r["record_type"] in ("response", "revisit")]
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in pages_read) == wanted(page_rows(), 50)
    by_id = {r["record_id"]: r for r in read}
    assert len(by_id) == len(read)  # every record has a name of its own
    texts = {(i, h or "") for i, _, h in page_rows()}
    for r in pages_read:
        original = by_id[r["refers_to_id"]] if r["record_type"] == "revisit" else r
        assert original["record_type"] == "response" and original["payload_digest"] == r["payload_digest"]
        assert r["record_type"] == "response" or original["page_id"] == r["refers_to"]
        assert (r["page_id"], original["payload"].decode()) in texts


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


class Memory:
    def __init__(self, data):
        self._data = data

    def size(self):
        return len(self._data)

    def read_at(self, n, at):
        return self._data[at:at + n]


def read(data):
    rows = list(warc.salvage(warc.Source(Memory(data))))
    assert sum(r["stop"] - r["start"] for r in rows) == len(data)  # every byte is in a record or a gap
    assert all(a["stop"] == b["start"] for a, b in zip(rows, rows[1:]))
    records = [r["page_id"] for r in rows if r["record_type"] != "gap"]
    return records, [(r["start"], r["stop"]) for r in rows if r["record_type"] == "gap"], [r.get("reason") for r in rows if r["record_type"] == "gap"]


def records(n=12, packed=True):
    rng = random.Random(5)
    rows = [{"page_id": i, "url": f"u{i}", "payload": rng.randbytes(rng.randrange(3000)), "is_revisit": i % 5 == 4, "keep_id": 1, "keep_url": None}
            for i in range(n)]
    made = [warc.page_record(r, warc.record_id(i, "")) for i, r in enumerate(rows)]
    return [warc.member(m) for m in made] if packed else made


def placed(parts):
    ends = [sum(map(len, parts[:i + 1])) for i in range(len(parts))]
    return list(zip([0, *ends], ends))


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("where", [0, 3, 11])
def test_a_flipped_byte_costs_its_record(packed, where):
    parts = records(packed=packed)
    rng = random.Random(where)
    for at in [0, 1, len(parts[where]) // 2, len(parts[where]) - 1, *[rng.randrange(len(parts[where])) for _ in range(30)]]:
        broken = bytearray(parts[where])
        broken[at] ^= 0x55
        found, gaps, _ = read(b"".join([*parts[:where], bytes(broken), *parts[where + 1:]]))
        if gaps:  # bytes that no check covers, such as the time in a gzip header, may differ
            assert found == [i for i in range(12) if i != where]
            assert gaps == [placed(parts)[where]]
        else:
            assert len(found) == 12


@pytest.mark.parametrize("packed", [True, False])
def test_truncation_and_noise(packed):
    parts = records(packed=packed)
    noise = b"\x1f\x8b\x08\x00 WARC/1.1\r\nContent-Length: 5\r\n\r\nab" + random.Random(1).randbytes(5000)
    whole = b"".join(parts)
    assert read(whole) == (list(range(12)), [], [])
    cut = parts[4][:len(parts[4]) // 2]
    found, gaps, _ = read(b"".join([noise, *parts[:4], cut, *parts[5:8], noise, noise, *parts[8:11], parts[11][:-3]]))
    assert found == [0, 1, 2, 3, 5, 6, 7, 8, 9, 10]
    assert len(gaps) == 4 and gaps[0] == (0, len(noise)) and gaps[2][1] - gaps[2][0] == 2 * len(noise)
    assert read(b"") == ([], [], []) and read(noise)[0] == []


def test_wrong_lengths_and_digests():
    parts = records(packed=False)
    longer = parts[2].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    wrong = parts[6].replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:A", 1)
    mixed = [*parts[:2], longer, *parts[3:6], wrong, *records()[7:]]  # plain records, then compressed ones
    found, gaps, reasons = read(b"".join(mixed))
    assert found == [0, 1, 3, 4, 5, *range(7, 12)]
    assert gaps == [placed(mixed)[2], placed(mixed)[6]] and reasons[1] == "payload digest differs"


def test_other_writers():
    """Records of other kinds, digests in hexadecimal or of other algorithms, no digests at all."""
    block = b"HTTP/1.0 200 OK\r\n\r\nbody"
    plain = lambda *lines: ("WARC/1.0\r\n" + "".join(f"{x}\r\n" for x in lines) + "\r\n").encode()
    sha = hashlib.sha1(b"body").hexdigest()
    data = plain("WARC-Type: response", "content-type: application/http", f"WARC-Payload-Digest: sha1:{sha.upper()}", f"content-length: {len(block)}") + block + b"\r\n\r\n"
    data += plain("WARC-Type: resource", "WARC-Block-Digest: md5:00", "Content-Length: 2") + b"ab\r\n\r\n"
    rows = list(warc.salvage(warc.Source(Memory(data))))
    assert [(r["record_type"], r["payload"], r["payload_digest"]) for r in rows] == [
        ("response", b"body", sha), ("resource", b"ab", hashlib.sha1(b"ab").hexdigest())]


def test_gaps_are_rows(spark, tmp_path):
    parts = records()
    (tmp_path / "a.warc.gz").write_bytes(b"".join([*parts[:5], parts[5][40:], *parts[6:]]))
    (tmp_path / "b.warc").write_bytes(b"".join(records(packed=False)))
    files = spark.createDataFrame([("a.warc.gz",), ("b.warc",)], "name string")
    got = warc.read_archives(files, f"file://{tmp_path}").collect()
    gaps = [(r["file"], r["start"], r["stop"]) for r in got if r["record_type"] == "gap"]
    start = sum(map(len, parts[:5]))
    assert gaps == [("a.warc.gz", start, start + len(parts[5]) - 40)]
    assert Counter(r["file"] for r in got) == {"a.warc.gz": 12, "b.warc": 12}
