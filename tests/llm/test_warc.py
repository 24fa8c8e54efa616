import gzip
import hashlib
import io
import random

import pytest
from basketry.llm import warc
from basketry.llm.warc import page_of, read_archives, record, round_trip, salvage, sha1_base32, with_revisits, write_archives


def parts(n=12):
    bodies = [f"<p>{i} WARC/1.1 \r\n\r\n é \x1f\x8b\x08</p>".encode() * (i * 40 + 1) for i in range(n)]
    return [record(i, f"http://x/{i}", b, sha1_base32(b)) for i, b in enumerate(bodies)]


def ids(rows):
    """Page ids; -1 for one that damage to a plain file's headers, which no digest covers, has changed."""
    found = [(r["record_id"] or "").removeprefix("<urn:x-page:")[:-1] for r in rows if r["problem"] is None]
    return [int(x) if x.isdecimal() else -1 for x in found]


def test_whole_files_read_back():
    for data in (b"".join(parts()), b"".join(map(gzip.compress, parts()))):
        rows = list(salvage(io.BytesIO(data)))
        assert ids(rows) == list(range(12)) and sum(r["length"] for r in rows) == len(data)
    assert list(salvage(io.BytesIO(b""))) == []
    assert [r["length"] for r in salvage(io.BytesIO(b"no archive at all"))] == [17]


def test_records_after_damage_are_recovered_and_gaps_add_up():
    draw = random.Random(4)
    for pack in (gzip.compress, bytes):
        members = [pack(p) for p in parts()]
        starts = [sum(map(len, members[:i])) for i in range(13)]
        data = b"".join(members)
        for _ in range(40):
            hit = sorted(draw.sample(range(12), draw.randrange(1, 4)))
            broken = bytearray(data)
            for i in hit:
                at = starts[i] + draw.randrange(20, len(members[i]) - 12)
                broken[at] ^= 0x55
            rows = list(salvage(io.BytesIO(bytes(broken))))
            assert set(range(12)) - set(hit) <= set(ids(rows)), hit
            spans = sorted((r["offset"], r["length"]) for r in rows)
            assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) == len(data)
        cut = list(salvage(io.BytesIO(data[: starts[7] + 30])))
        assert ids(cut) == list(range(7)) and cut[-1]["problem"] and cut[-1]["length"] == 30
        assert ids(salvage(io.BytesIO(b"junk" * 9 + data))) == list(range(12))
        assert ids(salvage(io.BytesIO(data[starts[3] + 15 :]))) == list(range(4, 12))


def test_pages_round_trip(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    odd = [(900_001, None, None), (900_002, "http://a", ""), (900_003, "x\r\ny", "é" * 300_000), (900_003, "x", "same"), (900_003, "x", "same"), (900_001, "x", "same"), (None, "x", "same"), (None, "q", "alone")]
    pages = pages.unionByName(spark.createDataFrame(odd, pages.schema))
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    best = {}
    for i, body in rows:
        if i is not None:
            best[body] = max(i, best.get(body, i))
    want = sorted(str((i, len(b), sha1_base32(b), i != best.get(b, i), best[b] if i != best.get(b, i) else None)) for i, b in rows)
    got = round_trip(spark, pages, str(tmp_path / "w")).withColumn("page", page_of("record_id")).withColumn("other", page_of("refers_to")).collect()
    assert sorted(str((r.page, r.payload_bytes, r.payload_digest, r.record_type == "revisit", r.other)) for r in got) == want
    assert all(r.problem is None for r in got)
    assert round_trip(spark, pages.limit(0), str(tmp_path / "e")).count() == 0


def test_payload_bytes_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a\r\n\r\nb"), (2, "u", None)], "page_id long, url string, html string")
    rows = read_archives(write_archives(with_revisits(pages), str(tmp_path / "p"))).collect()
    assert {bytes(r.payload) for r in rows} == {b"a\r\n\r\nb", b""}
    assert sha1_base32(b"") == __import__("base64").b32encode(hashlib.sha1().digest()).decode()


def test_headers_of_any_length_come_back(spark, tmp_path):
    url = "http://x/" + "a" * (2 << 20)
    data = [record(1, url, b"one", sha1_base32(b"one")), record(2, "http://y", b"two", sha1_base32(b"two"))]
    for pack in (gzip.compress, bytes):
        assert [len(r["target_uri"]) for r in salvage(io.BytesIO(b"".join(map(pack, data))))] == [len(url), 8]
    got = round_trip(spark, spark.createDataFrame([(1, url, "one"), (2, None, "two")], "page_id long, url string, html string"), str(tmp_path / "h"))
    assert sorted(len(r.target_uri) for r in got.collect()) == [0, len(url)]
    # a version line in a long text without line ends is given up at its first line that is no header
    noise = b"WARC/1.1\r\n" + b"no header here\r\n" * 100_000 + data[1]
    rows = list(salvage(io.BytesIO(noise)))
    assert [bool(r["problem"]) for r in rows] == [True, False] and rows[0]["length"] == len(noise) - len(data[1])


def test_files_are_read_by_a_task_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    pages = spark.createDataFrame([(i, f"http://h/{i}", hashlib.sha1(str(i).encode()).hexdigest() * 20) for i in range(60)], "page_id long, url string, html string")
    files = write_archives(with_revisits(pages.coalesce(1)), str(tmp_path / "t"))
    rows = read_archives(files)
    assert files.count() > 8 and rows.rdd.getNumPartitions() == files.count() and rows.count() == 60


def test_a_lost_record_is_an_error(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"body {i}") for i in range(9)], "page_id long, url string, html string")
    whole = warc.write_archives

    def damaged(pages, folder):
        out = whole(pages, folder)
        path = out.first().path
        data = bytearray(open(path, "rb").read())
        data[30] ^= 0x55
        open(path, "wb").write(data)
        return out

    monkeypatch.setattr(warc, "write_archives", damaged)
    with pytest.raises(RuntimeError, match="records written"):
        round_trip(spark, pages, str(tmp_path / "l"))


def test_members_of_several_records():
    each = parts()
    whole = gzip.compress(b"".join(each))
    rows = list(salvage(io.BytesIO(whole)))
    assert ids(rows) == list(range(12)) and sum(r["length"] for r in rows) == len(whole) and not any(r.get("problem") for r in rows)
    cut = list(salvage(io.BytesIO(whole[:-20])))
    assert ids(cut) == list(range(11)) or ids(cut) == list(range(12))
    assert cut[-1]["problem"] and sum(r["length"] for r in cut) == len(whole) - 20
    broken = bytearray(b"".join(each))
    broken[len(each[0]) + len(each[1]) - 10] ^= 0x55  # the block of the second record, before it was packed
    rows = list(salvage(io.BytesIO(gzip.compress(bytes(broken)) + gzip.compress(each[0]))))
    assert ids(rows) == [0, *range(2, 12), 0] and [bool(r.get("problem")) for r in rows].index(True) == 1
    mixed = b"".join(map(gzip.compress, (each[0], each[1] + each[2], each[3])))
    assert ids(salvage(io.BytesIO(mixed))) == [0, 1, 2, 3]


def test_a_damaged_length_is_not_read_to_the_end_of_the_file():
    each = parts()
    filler = b"".join(each) * 400
    data = each[0].replace(b"Content-Length: ", b"Content-Length: 99999", 1) + filler
    assert len(data) > 2_000_000
    file = io.BytesIO(data)
    rows = salvage(file)
    first = next(rows)
    assert first["problem"] == "the block ends before its length says" and file.tell() < 1_000_000
    assert len(ids(rows)) == 12 * 400
