import gzip
import hashlib

import duckdb
import pytest

from lodestrata.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, payload int, i int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2) for r in rows], SCHEMA)


def brute(rows):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == body and j is not None]
        last = max(same, default=None)
        again = len([1 for _, _, h in rows if (h or "").encode() == body]) > 1 and last is not None and i != last
        out.append((i, len(body), warc.base32_sha1(body), "revisit" if again else "response", last if again else None))
    return sorted(map(repr, out))


ROWS = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, "http://c/\r\nX: y", "\r\n\r\nWARC/1.1\r\n\r\n"), (4, None, None), (9, "http://é/", ""), (5, "", "é世🤦" * 50_000), (6, "u", "<p>x</p>"), (6, "u", "<p>x</p>"), (None, "n", "<p>x</p>"), (None, "n", "only"), (None, "m", "only"), (-7, "v", "alone")]


def test_round_trip_equals_brute_force(spark):
    got = warc.archive_digests(frame(spark, ROWS)).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(ROWS)
    assert warc.archive_digests(frame(spark, [])).count() == 0


def test_query_equals_its_sql(spark):
    rows = [(i, f"http://h/{i}", None if i % 17 == 0 else "é" * (i % 9)) for i in range(200)]
    df = frame(spark, rows)
    con = duckdb.connect()
    con.register("pages", df.select("page_id", "url", "html").toPandas().astype({"html": object}).where(lambda f: f.notna(), None))
    want = con.sql(warc.ORACLE).project("page_id, payload_bytes, payload_digest, record_type, refers_to").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in warc.archive_digests(df).collect()) == brute(rows)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_whole_records_and_files(spark, tmp_path, compression):
    at = f"file://{tmp_path}/a"
    warc.write_archives(warc.page_records(frame(spark, ROWS)).repartition(3), at, compression=compression, fileBytes=200, date="2020-01-02T03:04:05Z")
    rows = warc.read_archives(spark, at).collect()
    assert len(rows) == len(ROWS) and {r.date for r in rows} == {"2020-01-02T03:04:05Z"} and {r.http_status for r in rows} == {200}
    by = {r.record_id: r for r in rows}
    assert by["<urn:x-page:3>"].payload == b"\r\n\r\nWARC/1.1\r\n\r\n" and by["<urn:x-page:3>"].target_uri == "http://c/%0D%0AX: y"
    assert by["<urn:x-page:5>"].payload == ROWS[5][2].encode() and by["<urn:x-page:9>"].payload == b"" and by["<urn:x-page:9>"].target_uri == "http://é/"
    r = by["<urn:x-page:1>"]
    assert (r.record_type, r.refers_to, r.payload, r.payload_length, r.http_content_length, r.truncated, r.profile) == ("revisit", "<urn:x-page:6>", None, None, 8, "length", warc.IDENTICAL)
    assert r.headers["warc-payload-digest"] == "sha1:" + warc.base32_sha1(b"<p>x</p>") and by["<urn:x-page:4>"].target_uri is None
    if compression == "gzip":  # any tool reads them: members of one record each
        text = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("a/*.warc.gz"))
        assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS)
    assert len(list(tmp_path.glob("a/part-*"))) > 3
    few = warc.read_archives(spark, at, partitionBytes=1)
    assert few.rdd.getNumPartitions() == len(list(tmp_path.glob("a/part-*"))) and few.count() == len(ROWS)


def test_filters_are_pushed_and_payloads_skipped(spark, tmp_path, capsys):
    at = f"{tmp_path}/a"
    warc.write_archives(warc.page_records(frame(spark, ROWS)), at)
    df = warc.read_archives(spark, at)
    ids = lambda c: sorted(r.record_id for r in df.where(c).select("record_id").collect())
    assert len(ids("record_type = 'revisit'")) == 4 and len(ids("record_type <> 'revisit'")) == 8 and len(ids("refers_to is null")) == 8
    assert ids("record_id in ('<urn:x-page:5>', 'q') and record_type = 'response'") == ["<urn:x-page:5>"] and ids("target_uri like 'http://c%'") == ["<urn:x-page:3>"]
    assert ids("content_length > 100000") == ["<urn:x-page:5>"] and ids("target_uri <=> null") == ["<urn:x-page:4>"] and ids("http_status = 404") == [] and len(ids("record_type = 'revisit' or content_length > 100000")) == 5
    reader = warc.WarcReader({"path": at}, None)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    keep = list(reader.pushFilters([EqualTo(("record_type",), "response"), EqualTo(("http_status",), 200), GreaterThan(("headers", "x"), "a")]))
    assert len(keep) == 2 and len(reader.filters) == 1

    class Source:  # counts what is read of a plain archive
        def __init__(self, data):
            import io

            self.f, self.got = io.BytesIO(data), 0

        def readline(self):
            out = self.f.readline()
            self.got += len(out)
            return out

        def read(self, n):
            out = self.f.read(n)
            self.got += len(out)
            return out

        def seek(self, n):
            self.f.seek(n)

    data = b"".join(warc.record_bytes({"record_type": k, "record_id": str(i), "payload": b"z" * 100_000}, "d") for i, k in enumerate(["response", "resource", "response"]))
    for wanted, filters, n, least, most in (({"record_id"}, [], 3, 0, 2000), ({"payload"}, [EqualTo(("record_type",), "resource")], 1, 100_000, 102_000), ({"payload"}, [], 3, 300_000, 400_000)):
        src = Source(data)
        assert len(list(warc.records(warc._Plain(src, len(data)), "f", wanted, filters))) == n and least <= src.got <= most


def test_foreign_files(spark, tmp_path):
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 4\r\nX-Odd: a\r\n  b\r\n\r\nk: v\r\n\r\n"
    two = b"WARC/1.1\nwarc-type: response\nContent-Type: application/http;msgtype=response\nContent-Length: 43\n\nHTTP/1.1 404 Not Found\r\nA: b\r\n\r\n<p>gone</p>\n\n\n"
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "a.warc").write_bytes(one + two)
    (folder / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (folder / "c.warc.gz").write_bytes(gzip.compress(one + two + one))  # one member for many records
    (folder / "d.warc").write_bytes(b"")
    (folder / "readme.txt").write_bytes(b"no archive")
    rows = warc.read_archives(spark, str(folder)).collect()
    assert sorted((r.record_type, r.http_status, bytes(r.payload)) for r in rows if r.http_status) == [("response", 404, b"<p>gone</p>")] * 3
    assert [(r.payload, r.headers["x-odd"]) for r in rows if r.record_type == "warcinfo"] == [(b"k: v", "a b")] * 4
    assert warc.read_archives(spark, str(folder), "record_type string").where("record_type = 'response'").count() == 3
    (folder / "e.warc").write_bytes(one[:-10])
    with pytest.raises(Exception, match="cut short"):
        warc.read_archives(spark, str(folder)).collect()


def test_only_committed_files_are_read(spark, tmp_path):
    at = f"{tmp_path}/a"
    rows = warc.page_records(frame(spark, ROWS))
    warc.write_archives(rows, at)
    (tmp_path / "a" / "part-lost.warc").write_bytes(b"left by a lost executor")
    warc.write_archives(rows, at)
    assert warc.read_archives(spark, at, "record_id string").count() == 2 * len(ROWS)
    rows.write.format("warc").mode("overwrite").save(at)
    assert warc.read_archives(spark, at, "record_id string").count() == len(ROWS)
    with pytest.raises(Exception, match="no part of a record"):
        warc.write_archives(rows.withColumn("extra", rows.record_id), at)
    assert hashlib.sha1(b"").digest_size == 20 and warc.base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
