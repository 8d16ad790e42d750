"""WARC: round trips, copies, and what is read from damaged archives."""

import gzip
import hashlib
import io
import random

import pytest

from graphloom.llm import warc
from graphloom.llm.registry import ORACLE, QUERIES
from graphloom.llm.shared import Tables
from tests.compare import assert_same, oracle
from tests.conftest import SMALL


def test_same_as_sql(spark):
    assert_same(QUERIES["op13_warc"](spark, SMALL), oracle(SMALL), ORACLE["op13_warc"])


PAGE = "page_id long, url string, html string, digest string, first int, value string"
LONG = "<p>" + "long enough to be revisited " * 8


def odd_pages():
    texts = ["", None, "short", "short", LONG, "é" * 49 + "ab", "é" * 50, "é" * 50, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 5, "x\r\n\r\ny\x1f\x8b", "z" * 300_000, LONG + "\n"]
    rows = [(i, f"http://h/{i}", t) for i, t in enumerate(texts)]
    rows += [(100 + i, "http://a b\r\nX: y\x7f/é" if i % 2 else None, LONG) for i in range(50)] + [(-3, "u", LONG + "!"), (9, "u", LONG + "!"), (9, "u", LONG + "!"), (None, "n", LONG), (None, "n", "nameless " * 20), (None, None, None)]
    return rows


def want(rows):
    first, out = {}, []
    for page, _, html in rows:
        b = (html or "").encode()
        if page is not None and len(b) >= 100:
            first[b] = min(page, first.get(b, page))
    for page, _, html in rows:
        b = (html or "").encode()
        again = b in first and (page is None or page > first[b])
        out.append((str(page), len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", str(first[b]) if again else "None"))
    return sorted(out)


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("small", [warc.SMALL, 0])
def test_round_trip(spark, tmp_path, monkeypatch, compress, small):
    monkeypatch.setattr(warc, "SMALL", small)
    rows = odd_pages()
    df = spark.createDataFrame([(*r, "d", 1, "v") for r in rows], PAGE).repartition(3)
    at = str(tmp_path / "w")
    warc.write_archives(df, at, Tables(spark, "w"), compress=compress, records=10)
    got = warc.read_archives(spark, at).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == want(rows)
    assert all(r["reason"] is None and r["payload_ok"] is not False for r in got)
    payloads = {(r["page_id"], bytes(r["payload"])) for r in got if r["record_type"] == "response"}
    assert payloads <= {(p, (h or "").encode()) for p, _, h in rows} and (10, b"z" * 300_000) in payloads
    assert {r["url"] for r in got if r["page_id"] == 101} == {"http://a%20b%0D%0AX:%20y%7F/é"}
    if compress:  # any gzip reader takes the files
        whole = b"".join(gzip.GzipFile(fileobj=io.BytesIO(p.read_bytes())).read() for p in (tmp_path / "w").glob("part-*"))
        assert whole.count(b"WARC-Record-ID") == len(rows)


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"), Tables(spark, "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


def archive(n, compress):
    rng = random.Random(n)
    parts = []
    for i in range(n):
        body = " ".join(rng.choice(["alpha", "beta", "WARC/1.1", "\r\n\r\n", "γ"]) for _ in range(rng.randrange(3, 400))).encode()
        r = warc.record(i, "http://x", body, hashlib.sha256(body).hexdigest(), None, False, "2000-01-01T00:00:00Z") + warc.END
        parts.append(warc.member(r) if compress else r)
    return parts


def ids(found):
    return [warc._page(f.fields["warc-record-id"]) for f in found if f.reason is None]


@pytest.mark.parametrize("compress", [True, False])
def test_damage_costs_only_what_it_hits(compress):
    parts = archive(12, compress)
    assert ids(warc.salvage(b"".join(parts))) == list(range(12))
    rng = random.Random(7)
    for _ in range(60):
        hit = sorted(rng.sample(range(12), 3))
        bad = list(parts)
        for k in hit:
            b = bytearray(bad[k])
            how = rng.randrange(4)
            if how == 0:
                # no digest covers the header of a record that isn't compressed
                b[rng.randrange(len(b) // 2 if compress else parts[k].index(warc.END) + 4, len(b) - (9 if compress else 4))] ^= 0x5A
            elif how == 1:
                del b[len(b) // 2 :]
            elif how == 2:
                b = bytearray(rng.randbytes(len(b)))
            else:
                b[: len(b) // 2] = b""
            bad[k] = bytes(b)
        data = b"".join(bad)
        found = list(warc.salvage(data))
        assert ids(found) == [k for k in range(12) if k not in hit]
        gaps = [f for f in found if f.reason is not None]
        # every byte is in a record or in a gap, once
        covered = sorted({(f.offset, f.length) for f in found})
        at = 0
        for offset, length in covered:
            assert offset == at
            at += length
        assert at == len(data) and sum(g.length for g in gaps) == sum(len(bad[k]) for k in hit)


def test_noise_around_and_between():
    parts = archive(3, True)
    data = b"junk\x1f\x8b\x08junk" + parts[0] + b"WARC/1.1 nonsense" + parts[1] + b"WARC/1.0\r\nContent-Length: 99999999\r\n\r\n" + parts[2] + b"\x1f\x8b"
    found = list(warc.salvage(data))
    assert ids(found) == [0, 1, 2] and [f.offset for f in found if f.reason] == [0, 11 + len(parts[0]), 28 + len(parts[0]) + len(parts[1]), len(data) - 2]
    assert list(warc.salvage(b"")) == []
    only = list(warc.salvage(b"nothing here"))
    assert [(f.offset, f.length, f.reason) for f in only] == [(0, 12, "no record")]


def test_one_member_of_many_records_and_a_bad_one_inside():
    parts = archive(4, False)
    bad = parts[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    found = list(warc.salvage(warc.member(parts[0] + bad + parts[2] + parts[3])))
    assert ids(found) == [0, 2, 3] and sum(f.reason is not None for f in found) == 1


def test_damaged_archive_in_spark(spark, tmp_path):
    parts = archive(6, True)
    parts[2] = parts[2][:-4] + b"\0\0\0\0"
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    got = warc.read_archives(spark, str(tmp_path)).orderBy("offset").collect()
    assert [r["page_id"] for r in got] == [0, 1, None, 3, 4, 5] and [r["reason"] for r in got][2] == "member"
    assert (got[2]["offset"], got[2]["length"]) == (len(parts[0]) + len(parts[1]), len(parts[2]))
