"""Archives against Python's own digests, with small splits and magic inside payloads."""

import base64
import hashlib
import random
import uuid

import pytest

from tablegauge.llm import warc
from tablegauge.session import shared_folder

MAGIC = warc.MAGIC.decode()
FAKE = f"{MAGIC}WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def wanted(rows):
    first = {}
    for i, _, html in rows:
        first[html or ""] = max(first.get(html or "", i), i)
    return sorted(
        (i, len((html or "").encode()), digest(html), *(("response", None) if first[html or ""] == i else ("revisit", first[html or ""])), url)
        for i, url, html in rows
    )


def result(spark, rows):
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").coalesce(2)
    return sorted(tuple(r) for r in warc.round_trip(pages).collect())


@pytest.mark.parametrize("split", ["1k", "5k", "128m"])
def test_round_trip_with_magic_inside(spark, split):
    draw = random.Random(6)
    rows = []
    for i in range(40):
        body = "".join(draw.choice(["é", "a ", "\r\n", MAGIC, FAKE, "WARC/1.0", "<p>"]) for _ in range(draw.choice([0, 1, 5, 40, 300])))
        rows.append((i, f"http://x/{i}", body))
    rows += [(100 + i, None, rows[draw.randrange(40)][2]) for i in range(30)] + [(200, "u", None), (201, "u", "")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        assert result(spark, rows) == wanted(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_payloads_come_back(spark):
    rows = [(1, "a\nb", f"x{FAKE}y"), (2, None, "ß" * 100000), (3, "u", "")]
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    pages = spark.createDataFrame([(i, u, h.encode()) for i, u, h in rows], "page_id long, url string, payload binary")
    warc.write_archives(pages, folder)
    got = {r.page_id: r for r in warc.read_archives(spark, folder).collect()}
    assert {i: bytes(got[i].payload).decode() for i in got} == {i: h for i, _, h in rows}
    assert got[1].url == "a%0Ab" and got[2].url is None and all(r.stated_digest == r.digest for r in got.values())


def test_broken_chain_and_truncated_end(spark, tmp_path):
    one = f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n".encode()
    (tmp_path / "a.warc").write_bytes(one + one.replace(b":1>", b":2>") + b"junk" + one.replace(b":1>", b":3>"))
    (tmp_path / "b.warc").write_bytes(one.replace(b":1>", b":4>") + one.replace(b":1>", b":5>")[:-5])
    (tmp_path / "c.warc").write_bytes(b"junk" + one)
    assert sorted(r.page_id for r in warc.read_archives(spark, str(tmp_path)).collect()) == [1, 2, 4]


def test_odd_rows(spark):
    assert result(spark, []) == []
    got = result(spark, [(5, "u", "same"), (5, "u", "same"), (4, "u", "same")])
    assert [r[3:5] for r in got] == [("revisit", 5), ("response", None), ("response", None)]
    pages = spark.createDataFrame([(None, "u", "same"), (7, "u", "same"), (None, "u", "own")], "page_id long, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(pages).collect()}
    assert got == {(None, "revisit", 7, 4), (7, "response", None, 4), (None, "response", None, 3)}
