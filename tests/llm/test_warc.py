import base64
import hashlib

import zstandard

from feedlens.llm import warc

SCHEMA = "page_id long, url string, html string, payload string"


def pages():
    rows = [(n, f"http://h/{n}", f"<p>{n % 7} é" * (n % 5 + 1)) for n in range(60)]
    return rows + [(100, None, None), (101, "u", ""), (102, "u", "x" * 300_000), (103, "u", "x" * 300_000), (5, "http://h/5", rows[5][2])]


def test_round_trip_with_revisits(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    index = warc.write_bundles(df, f"file://{tmp_path}/w", frame_bytes=2000, bundle_bytes=20_000)
    got = warc.read_bundles(index, f"file://{tmp_path}/w").collect()
    assert len(got) == index.count() == len(rows) and all(r["intact"] for r in got)
    data = {i: (h or "").encode() for i, _, h in rows}
    largest = {p: max(i for i, q in data.items() if q == p) for p in data.values()}
    for r in got:
        page = int(r["record_id"].rpartition(":")[2])
        payload, most = data[page], largest[data[page]]
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if page == most else ("revisit", f"urn:x-page:{most}"))


def test_index_finds_each_record_by_itself(spark, tmp_path):
    df = spark.createDataFrame([(*r, "x") for r in pages()], SCHEMA)
    index = warc.write_bundles(df, str(tmp_path / "w"), frame_bytes=3000)
    for r in warc.fetch(index.where("length % 3 = 0"), str(tmp_path / "w")).collect():
        (fields, _), = warc.parse_records(bytes(r["data"]))
        assert fields["warc-record-id"] == f"<{r['record_id']}>"
    for path in (tmp_path / "w").iterdir():  # any reader of Zstandard can read a bundle from end to end
        out = zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True).read()
        assert out.startswith(b"WARC/1.1")


def test_small_payloads_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab", "x"), (2, "u", "ab", "x")], SCHEMA)
    got = warc.read_bundles(warc.write_bundles(df, str(tmp_path / "a"), least_bytes=3), str(tmp_path / "a")).collect()
    assert {r["record_type"] for r in got} == {"response"}
    none = df.where("page_id < 0")
    assert not warc.read_bundles(warc.write_bundles(none, str(tmp_path / "b")), str(tmp_path / "b")).collect()
