import hashlib

import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from isograd.llm import warc
from isograd.session import scratch

PAGES = "page_id long, url string, html string, n_bytes int, payload string"


def pages():
    same = "<p>" + "é" * 60 + "</p>"
    return [(5, "http://a/5", same), (3, "http://a/3", same), (9, None, same), (1, "u", "<p>short</p>"),
            (2, "u", "<p>short</p>"), (4, "a\r\nb", None), (6, "", ""), (7, "u", "x" * 600_000),
            (8, "u", "WARC/1.1\r\n\r\nline\r\n\r\n" * 20), (None, "u", "<i>no id</i>"),
            (10, "u", "\x00\U0001f600" * 50), (3, "u", "other " * 30), (11, "u", "y" * 99),
            (12, "u", "y" * 99), (13, "u", "z" * 100), (14, "u", "z" * 100)]


def wanted(rows):
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if page is not None and len(data) >= 100:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        again = page is not None and data in first and page > first[data]
        out.append((page or 0, len(data), hashlib.sha256(data).hexdigest(),
                    "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, 1, "p") for r in pages()], PAGES)
    got = warc.archive_round_trip(df).collect()
    assert sorted(((r[0] or 0, *r[1:]) for r in got), key=str) == wanted(pages())
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_single_records_and_plain_decoding(spark):
    df = spark.createDataFrame([(*r, 1, "p") for r in pages()], PAGES)
    folder = scratch(spark, "warc-test")
    index = warc.write_archives(df, folder)
    some = index.where("page_id IN (7, 8, 13)")
    got = {r.page_id: bytes(r.payload) for r in warc.read_records(some, folder).collect()}
    assert got == {r[0]: r[2].encode() for r in pages() if r[0] in (7, 8, 13)}
    # a bundle is also an ordinary Zstandard file, whose parts are whole frames
    store, path = fs.FileSystem.from_uri(warc._with_uri(folder))
    for row in index.select("bundle").distinct().collect():
        with store.open_input_file(f"{path}/{row.bundle}") as file:
            table = warc.read_seek_table(file)
            file.seek(0)
            raw = file.read()
        whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert len(whole) == sum(plain for _, _, plain in table)
        at, count = 0, 0
        while at < len(whole):
            _, _, at = warc.parse(whole, at)
            count += 1
        assert count == index.where(index.bundle == row.bundle).count()


def test_bundles_are_read_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE", 500)
    df = spark.createDataFrame([(k, "u", f"page {k} " * 40, 1, "p") for k in range(60)], PAGES)
    folder = scratch(spark, "warc-tasks")
    index = warc.write_archives(df, folder)
    assert index.select("bundle").distinct().count() > 20
    for read in (warc.read_archives, warc.read_records):
        found = read(index, folder)
        assert found.select(F.spark_partition_id()).distinct().count() > 4
        assert sorted(r.page_id for r in found.collect()) == list(range(60))
