import base64
import gzip
import hashlib
import io
import zlib
from collections import defaultdict

import pytest

from riskloom.llm.files import open_file
from riskloom.llm.warc import member, read_records, read_warc, record, write_warc
from riskloom.session import work_path

SCHEMA = "page_id bigint, url string, html string, digest string, key string, refers_to bigint"


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 5) for r in rows], SCHEMA).repartition(3)


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    rows = [(i, f"http://a/{i}", f"<p>{'ü' * (i % 5)}{i % 7}</p>") for i in range(60)]
    rows += [(100, None, None), (101, "u\r\nX: y", ""), (102, "v", "x\r\n\r\n" * 300_000), (None, "w", None), (None, "w", "only here")]
    rows += [(103, "r", "twice"), (103, "r", "twice"), (90, "r", "twice")]
    manifest = write_warc(made(spark, rows), work_path(spark, "archives"), archive_bytes=2000)
    assert manifest.count() > 3
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[html or ""].append(i)
    want = []
    for i, _, html in rows:
        known = [k for k in groups[html or ""] if k is not None]
        last = max(known) if known else None
        kind, refers = ("response", None) if i == last else ("revisit", str(last))
        want.append((None if i is None else str(i), kind, len((html or "").encode()), sha1(html), refers, True))
    found = read_warc(manifest, with_payload=True).collect()
    got = [(r["key"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"], r["verified"]) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    texts = {str(i): html for i, _, html in rows if i is not None}
    assert all(bytes(r["payload"]).decode() == (texts[r["key"]] or "") for r in found if r["record_type"] == "response" and r["key"])
    assert {r["url"] for r in found if r["key"] == "101"} == {"u%0D%0AX:%20y"}
    # every archive is plain gzip, too
    with open_file(manifest.first()["archive"]) as stream:
        assert gzip.decompress(stream.read()).startswith(b"WARC/1.1\r\n")


def test_small_payloads_are_all_responses(spark):
    manifest = write_warc(made(spark, [(1, "a", "x"), (2, "a", "x"), (3, "a", "long one"), (4, "a", "long one")]), work_path(spark, "w"), min_revisit_bytes=2)
    assert sorted((r["key"], r["record_type"]) for r in read_warc(manifest).collect()) == [("1", "response"), ("2", "response"), ("3", "revisit"), ("4", "response")]


def test_broken_archives():
    whole = member(record("1", "u", b"abc", None, "d"), 6)
    assert next(read_records(io.BytesIO(whole), True))[-2:] == (True, b"abc")
    changed = zlib.decompress(whole, 31).replace(b"abc", b"abd")
    assert next(read_records(io.BytesIO(member(changed, 6)), False))[-2] is False
    for bad in (whole[:-20], member(changed[:-9], 6), member(b"nothing\r\n\r\n", 6), member(changed + b"x", 6)):
        with pytest.raises((ValueError, zlib.error)):
            list(read_records(io.BytesIO(bad), False))


def test_empty(spark):
    manifest = write_warc(made(spark, []), work_path(spark, "archives"))
    assert manifest.count() == 0 and read_warc(manifest).count() == 0
