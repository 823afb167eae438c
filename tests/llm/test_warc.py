"""WARC packages: brute force over pages, other programs' ZIP archives, damaged and odd ones."""

import gzip
import io
import json
import zipfile
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from screenlake.llm import queries, warc

SCHEMA = "page_id long, url string, html string, record_type string"
ROWS = [
    (5, "http://a.example/x", "<p>same</p>", "clash"), (3, "http://b.example/", "<p>same</p>", "clash"), (9, None, "<p>same</p>", None), (None, "u", "<p>same</p>", "c"),
    (1, "http://c.example/ä b\r\nWARC-Type: x", "", "c"), (2, "http://d", None, "c"), (4, "e", "only é 日本 \x00 \r\n\r\n body", "c"),
    (7, "t", "twin", "c"), (7, "t", "twin", "c"), (7, "s", "twin", "c"), (None, None, "alone", "c"), (8, "http://[broken", "x" * 300_000, "c"),
]


def brute(rows):
    out, groups = [], {}
    for page_id, url, html, _ in rows:
        groups.setdefault(html or "", []).append((page_id is None, page_id, url is None, url))
    for text, group in groups.items():
        payload = text.encode()
        group.sort(key=lambda g: tuple((x is None, x) for x in g))
        for k, (_, page_id, _, _) in enumerate(group):
            out.append((page_id, len(payload), warc.base32_sha1(payload), "revisit" if k else "response", group[0][1] if k else None))
    return Counter(out)


def told(df):
    return Counter(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


@pytest.mark.parametrize("bounds", [(1 << 20, 1000), (1 << 20, 2), (100, 1000)])
def test_round_trip(spark, tmp_path, bounds):
    rows = ROWS + [(100 + i, f"http://x/{i}", f"group {i % 5}", "c") for i in range(60)]
    packages = warc.write_packages(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / "w"), *bounds)
    assert packages.agg(F.sum("records")).first()[0] == len(rows) and packages.count() >= 3
    records = warc.read_records(packages, payloads=True)
    assert told(records) == brute(rows)
    assert records.where("not intact").count() == 0
    held = {(r["page_id"], r["payload"].decode()) for r in records.where("record_type = 'response' and page_id is not null").collect()}
    assert (4, ROWS[6][2]) in held and (3, "<p>same</p>") in held and (1, "") in held
    assert records.where("page_id = 1").first()["url"] == "http://c.example/%C3%A4%20b%0D%0AWARC-Type:%20x"
    assert records.select("record_id").distinct().count() == len(rows)
    # Any ZIP program reads a package, and its index points at gzip members.
    for path in [r["path"] for r in packages.collect()]:
        z = zipfile.ZipFile(path)
        assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        data, lines = z.read("archive/data.warc.gz"), z.read("indexes/index.cdx").decode().splitlines()
        assert lines == sorted(lines)
        for line in lines:
            about = json.loads(line[line.index("{") :])
            assert gzip.decompress(data[about["offset"] : about["offset"] + about["length"]]).startswith(b"WARC/1.1")


def test_equals_its_sql(spark):
    rows = spark.createDataFrame(ROWS[:4] + ROWS[5:7] + ROWS[10:11], SCHEMA).drop("record_type")
    con = duckdb.connect()
    con.register("pages", rows.toPandas().convert_dtypes())
    got = warc.warc_round_trip(rows)
    want = con.sql(queries.ORACLE_SQL["op11_warc"])
    assert sorted(got.columns) == sorted(want.columns)
    pick = lambda r: (r[0], r[1], r[2], r[3], r[4], r[5])
    assert Counter(map(pick, want.project("page_id, payload_bytes, payload_digest, record_type, refers_to, intact").fetchall())) == Counter(
        tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()
    )


def test_empty(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_payload_spreads(spark):
    """One payload of half the rows: nobody else's line is broadcast, and no row is lost."""
    rows = [(i, f"u{i}", "hot" if i % 2 else f"p{i // 4}", "c") for i in range(2000)]
    assert told(warc.warc_round_trip(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(rows)


def plain(n, text):
    payload = text.encode()
    return warc.record("response", f"urn:page:{n}:x", n, f"http://x/{n}", payload, warc.base32_sha1(payload), len(payload), None)


def archive(tmp_path, name, member, data, index=None, before=b"", comment=b"", method=zipfile.ZIP_STORED, many=0):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(many):
            z.writestr(f"pages/{k}", b"")
        z.writestr(zipfile.ZipInfo(member), data, compress_type=method)
        if index is not None:
            z.writestr(zipfile.ZipInfo("indexes/index.cdx.gz"), index)
        z.comment = comment
    path = tmp_path / name
    path.write_bytes(before + out.getvalue())
    return str(path)


def read(spark, *paths):
    return sorted((r["page_id"], bytes(r["payload"]).decode(), r["intact"]) for r in warc.read_records(spark.createDataFrame([(p,) for p in paths], "path string"), payloads=True).collect())


def test_other_archives(spark, tmp_path, monkeypatch):
    texts = ["one", "two\r\n\r\n", "x" * 3_000_000]
    want = [(n, t, True) for n, t in enumerate(texts)]
    whole = b"".join(plain(n, t) for n, t in want_pairs(want))
    packed = b"".join(gzip.compress(plain(n, t)) for n, t in want_pairs(want))
    assert read(spark, archive(tmp_path, "walked", "archive/a.warc.gz", packed)) == want
    assert read(spark, archive(tmp_path, "plain", "a.warc", whole)) == want
    assert read(spark, archive(tmp_path, "shifted", "a.warc", whole, before=b"junk" * 99)) == want
    assert read(spark, archive(tmp_path, "signed", "a.warc", whole, comment=b"x PK\x05\x06 y" + b"\0" * 30)) == want
    assert read(spark, archive(tmp_path, "many", "a.warc", whole, many=66_000)) == want  # more than 16 bits count: ZIP64
    line = lambda o, n: f"x 1970 {json.dumps({'offset': str(o), 'length': n, 'filename': 'a.warc.gz'})}\n".encode()
    first = len(gzip.compress(plain(0, "one")))
    index = gzip.compress(line(0, first)) + gzip.compress(line(first, len(gzip.compress(plain(1, texts[1])))))
    assert read(spark, archive(tmp_path, "indexed", "archive/a.warc.gz", packed, index)) == want[:2]
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)  # lengths and places in ZIP64 fields
    assert read(spark, archive(tmp_path, "wide", "a.warc", whole, many=3), archive(tmp_path, "wide shifted", "a.warc", whole, before=b"j" * 9)) == sorted(want * 2)


def want_pairs(want):
    return [(n, t) for n, t, _ in want]


def test_damage_is_seen(spark, tmp_path):
    data = plain(1, "payload").replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n")
    assert read(spark, archive(tmp_path, "changed", "a.warc", data)) == [(1, "pAyload", False)]
    for name, broken in (("deflated", {"method": zipfile.ZIP_DEFLATED}),):
        with pytest.raises(Exception, match="not stored"):
            read(spark, archive(tmp_path, name, "a.warc", plain(1, "x" * 99), **broken))
    (tmp_path / "no").write_bytes(b"nothing")
    with pytest.raises(Exception, match="no ZIP archive"):
        read(spark, str(tmp_path / "no"))
