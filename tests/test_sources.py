"""Archives by byte ranges, token files as one stream."""

import gzip

import pytest

from corpusmill.sources import files, wet

TEXTS = [f"text {i} " * (3 + i * 7 % 400) for i in range(120)] + ["WARC/1.0\r\nnot a record\r\n\r\nWARC/1.0 again", "\x1f\x8b\x08 no member", "é" * 500, "", "x" * 300_000]


def _record(i: int, text: str, kind: str = "conversion") -> bytes:
    body = text.encode()
    return b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Target-URI: http://x/%d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind.encode(), i, len(body), body)


@pytest.mark.parametrize("form", ["members", "one", "plain"])
def test_ranges_of_any_size_give_every_record_once(spark, tmp_path, form):
    every = [_record(i, t) for i, t in enumerate(TEXTS)]
    content = {"members": b"".join(map(gzip.compress, every)), "one": gzip.compress(b"".join(every)), "plain": b"".join(every)}[form]
    (tmp_path / "a.wet").write_bytes(content)
    want = [(f"http://x/{i}", t.strip()) for i, t in enumerate(TEXTS)]
    for split in (700, 5_001, 1 << 26):
        if form == "one" and split == 700:
            continue
        found = wet.records(spark, str(tmp_path), split)
        assert found.rdd.getNumPartitions() == -(-len(content) // split)
        assert [(r.url, r.text) for r in found.orderBy("start").collect()] == want
    if form != "one":  # several tasks own some
        starts = [r.start for r in wet.records(spark, str(tmp_path), 5_001).collect()]
        assert len({s // 5_001 for s in starts}) > 2


def test_broken_archives_and_folders(spark, tmp_path):
    (tmp_path / "b.wet.gz").write_bytes(gzip.compress(_record(1, "whole " * 50)) + gzip.compress(_record(2, "cut off " * 900))[:60])
    (tmp_path / "a.wet").write_bytes(_record(3, "first " * 50, "warcinfo") + _record(4, "second " * 50) + _record(5, "third " * 50)[:-200])
    (tmp_path / "_hidden").write_bytes(_record(6, "hidden"))
    (tmp_path / "c.wet").write_bytes(b"")
    assert sorted(r.url[-1] for r in wet.records(spark, str(tmp_path)).collect()) == ["1", "3", "4"]
    assert [r.url[-1] for r in files.read_wet(spark, str(tmp_path), cap=1).orderBy("url").collect()] == ["1", "4"]
    with pytest.raises(Exception, match="nowhere"):
        wet.records(spark, str(tmp_path / "nowhere")).count()


@pytest.mark.parametrize("packed", [True, False])
def test_archives_written_and_read(spark, tmp_path, packed):
    rows = spark.createDataFrame([(f"u{i}", t, None if i % 2 else "eng") for i, t in enumerate(TEXTS)] + [("n", None, "deu")], "url string, text string, language string").selectExpr("*", "'2024' AS timestamp").repartition(3)
    wet.write(rows, str(tmp_path / "w"), packed=packed)
    got = {r.url: (r.text, r.language) for r in wet.records(spark, str(tmp_path / "w"), 4_000).collect()}
    assert got == {f"u{i}": (t.strip(), "unknown" if i % 2 else "eng") for i, t in enumerate(TEXTS)} | {"n": ("", "deu")}
    total = files.process_wet(spark, [str(tmp_path / "w"), str(tmp_path / "w")], str(tmp_path / "out"))
    assert total == len({t.strip() for t in TEXTS if len(t.strip()) >= 200}) and spark.read.json(str(tmp_path / "out")).filter("source = 'common_crawl'").count() == total
