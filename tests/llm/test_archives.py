from __future__ import annotations

import gzip
import hashlib
import io
import random

import pytest

from reabasto.llm import archives

PAGES = "page_id long, url string, html string, record_id string, payload string"


def pages():
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abc é\r\n\t<>") for _ in range(n))
    same, short = text(400), text(40)
    rows = [(i, f"http://h{i % 7}.net/p q?x={i}#é", text(rng.randrange(600)), "r", "p") for i in range(80)]
    rows += [(100 + i, "https://a.com/", same, None, None) for i in range(9)] + [(120 + i, None, short, "", "") for i in range(3)]
    rows += [(200, None, None, "", ""), (201, "", "", "", ""), (202, "dns:a b", "HTTP/1.1 odd\r\n\r\nbody" * 9, "", "")]
    rows += [(None, "http://x.org/", same, "", ""), (105, "http://x.org/", same, "", ""), (300, "http://x.org/", "WARC/1.1\r\n\r\n" * 2000, "", "")]
    rows += [(301, "http://x.org/", "z" * 99, "", ""), (302, "http://x.org/", "z" * 99, "", ""), (303, "http://x.org/", "é" * 50, "", ""), (304, None, "é" * 50, "", "")]
    return rows


def want(rows):
    data = [(i, (h or "").encode()) for i, _, h, _, _ in rows]
    first = {}
    for i, b in data:
        if len(b) >= 100:
            first[b] = min(first.get(b, i), i, key=lambda x: (x is None, x))
    out, done = [], set()
    for i, b in sorted(data, key=lambda x: (x[0] is None, x[0])):
        again = len(b) >= 100 and (first[b] != i or b in done)
        done.add(b)
        out.append((str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", str(first[b] if again else None)))
    return sorted(out)


@pytest.mark.parametrize("small", [True, False])
def test_round_trip(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(archives, "FILE_BYTES", 1500)
        monkeypatch.setattr(archives, "BATCH_BYTES", 900)
    rows = pages()
    made = archives.round_trip(spark.createDataFrame(rows, PAGES).repartition(4)).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in made) == want(rows)
    assert all(r.whole for r in made)


def test_empty_table(spark):
    assert archives.round_trip(spark.createDataFrame([], PAGES)).collect() == []


BODY = b"HTTP/1.0 404 Not Found\r\nContent-Type: text/html\r\n\r\n<p>gone</p>"


def test_version_one():
    about = b"1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n"
    data = b"filedesc://a.arc 0.0.0.0 20010203 text/plain %d\n" % len(about) + about + b"\n"
    data += b"http://a.com/with blank 1.2.3.4 20010203040506 text/html %d\n" % len(BODY) + BODY + b"\n\n"
    data += b"dns:a.com 1.2.3.4 2001 text/dns 9\n20010203\n\n"
    one, two = archives.parse_arc(io.BytesIO(data), "a.arc")
    assert (one["arc_version"], one["target_uri"], one["ip"], one["date"]) == (1, "http://a.com/with blank", "1.2.3.4", "2001-02-03T04:05:06Z")
    assert (one["warc_type"], one["status"], one["payload"], one["payload_digest"]) == ("response", 404, b"<p>gone</p>", hashlib.sha256(b"<p>gone</p>").hexdigest())
    assert (two["warc_type"], two["payload"], two["date"]) == ("resource", b"20010203\n", "2001-01-01T00:00:00Z")
    assert one["record_id"] != two["record_id"]
    again, _ = archives.parse_arc(io.BytesIO(data), "a.arc")
    assert again == one


def test_pages_named_like_the_first_record(spark):
    rows = [(1, "filedesc://a.arc", "<p>one</p>", "", ""), (2, "filedesc:", "<p>two</p>", "", ""), (3, "http://a.com/", "<p>three</p>", "", "")]
    made = archives.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in made) == want(rows)


def test_version_two():
    about = b"2 0 Org\nURL ...\n"
    data = b"filedesc://b.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 b.arc %d\n" % len(about) + about + b"\n"
    data += b"http://a.com/ 1.2.3.4 20010203040506 text/html 404 abc - 99 b.arc %d\n" % len(BODY) + BODY + b"\n"
    (one,) = archives.parse_arc(io.BytesIO(data), "b.arc")
    assert (one["arc_version"], one["status"], one["payload_bytes"], one["mime"]) == (2, 404, 11, "text/html")


@pytest.mark.parametrize(
    "tail, error",
    [(b"http://a.com/ 1.2.3.4 2001 text/html 50\nshort", "5 of 50 bytes"), (b"http://a.com/ 5\n", "2 fields"), (b"http://a.com/ 1.2.3.4 2001 text/html many\n", "invalid literal")],
)
def test_damaged_files_say_so(spark, tmp_path, tail, error):
    about = b"1 0 Org\n"
    good = b"http://a.com/ 1.2.3.4 20010203040506 text/html %d\n" % len(BODY) + BODY + b"\n"
    data = b"filedesc://a.arc 0.0.0.0 20010203 text/plain %d\n" % len(about) + about + b"\n" + good + tail
    (tmp_path / "a.arc").write_bytes(data)
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(data))
    (tmp_path / "c.arc").write_bytes(b"http://a.com/ 1\n")
    files = spark.createDataFrame([(str(tmp_path / n), 1) for n in ("a.arc", "b.arc.gz", "c.arc")], "path string, records long")
    listed = {r.archive: r.error for r in archives.errors(files, str(tmp_path)).collect()}
    assert error in listed["a.arc"] and error in listed["b.arc.gz"] and "no filedesc" in listed["c.arc"]
    warcs = archives.convert(files, str(tmp_path), str(tmp_path / "warc"))
    made = archives.read_warc(warcs, str(tmp_path / "warc")).collect()
    assert [(r.record_type, bytes(r.payload)) for r in made] == [("response", b"<p>gone</p>")] * 2


def test_warc_text():
    first, encode = archives.warc_encoder("x.warc.gz")
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and first.endswith(b"\r\n\r\n")
    (record,) = archives.parse_arc(io.BytesIO(b"filedesc://a 0.0.0.0 2001 text/plain 0\nhttp://a.com/ 1.2.3.4 20010203040506 text/html %d\n" % len(BODY) + BODY), "a")
    lines = encode(record, 0).split(b"\r\n")
    assert lines[:2] == [b"WARC/1.1", b"WARC-Type: response"] and b"WARC-Date: 2001-02-03T04:05:06Z" in lines
    assert b"Content-Type: application/http;msgtype=response" in lines and b"Content-Length: %d" % len(BODY) in lines
    other = {"record_id": "u", "target_uri": "http://b.com/", "date": archives.NO_DATE}
    text = encode(record | {"refers": other}, 0)
    assert b"WARC-Type: revisit" in text and b"WARC-Refers-To: <urn:uuid:u>" in text and b"<p>gone" not in text
