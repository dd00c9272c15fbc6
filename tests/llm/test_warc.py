import base64
import gzip
import hashlib
import random

from quillmill.llm import warc

from .helpers import SF, driver_rows


def brute(rows, least=0):
    best = {}
    for r in rows:
        body = (r["html"] or "").encode()
        if r["page_id"] is not None:
            best[body] = max(best.get(body, r["page_id"]), r["page_id"])
    out = []
    for r in rows:
        body = (r["html"] or "").encode()
        refers = best.get(body)
        if len(body) < least or refers is None or refers == r["page_id"]:
            refers = None
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((r["page_id"], len(body), digest, "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_pages(spark):
    got = warc.capture_histories(spark.read.parquet(f"{SF}/pages.parquet")).cache()
    assert result(got) == brute(driver_rows("pages"))
    rows = sorted(got.collect(), key=lambda r: (r.range_id, r.range_pos))
    order = [(r.url_key, r.capture_ts, r.page_id) for r in rows]
    assert order == sorted(order)


def test_odd_rows_and_empty_table(spark):
    rows = [(1, "http://a.b/x", None), (2, None, ""), (3, "http://www.a.b:80/X?q#f", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (4, "u\r\nX: y", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (None, "u", "<b>"), (None, "v", "é" * 100000), (7, "v", "é" * 100000), (7, "v", "é" * 100000)]
    pages = spark.createDataFrame([(*r, 0, "x") for r in rows], "page_id long, url string, html string, range_id int, _sha1 string")
    dicts = [dict(zip(("page_id", "url", "html"), r)) for r in rows]
    assert result(warc.capture_histories(pages)) == brute(dicts)
    assert result(warc.capture_histories(pages, min_bytes=10)) == brute(dicts, 10)
    assert warc.capture_histories(pages.limit(0)).count() == 0


def test_loser_tree_is_a_stable_merge():
    rnd = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rnd.randrange(20), r) for _ in range(rnd.randrange(0, 30))) for r in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x[0])) == sorted((x for r in runs for x in r), key=lambda x: x[0])


def test_url_keys():
    assert warc.url_key("http://www.Ex.com:80/A?b#c") == "com,ex)/A?b"
    assert warc.url_key("https://ex.com") == "com,ex)/"
    assert warc.url_key(None) == ""


def test_ids_of_any_size_and_repeats(spark):
    ids = [7 * 10**18, 3 * 10**11, -5, 0, None, None, 4, 4]
    rows = [{"page_id": i, "url": f"http://h/{k}", "html": "same" if k > 3 else f"x{k}"} for k, i in enumerate(ids)]
    pages = spark.createDataFrame([tuple(r.values()) for r in rows], "page_id long, url string, html string").selectExpr("*", "1 as _first", "2 as _max", "'b' as _body")
    got = warc.capture_histories(pages)
    assert result(got) == brute(rows)
    assert all(len(r.capture_ts) == 14 for r in got.collect())


def test_record_ids_differ_and_refer_to_a_response(spark, tmp_path):
    rows = [(i, "u", "p") for i in (1, 1, 2, 2, None, None)] + [(2, "v", "q")]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    headers = []
    for f in (tmp_path / "w").glob("part-*"):
        with gzip.open(f) as data:
            headers += [h for _, h, _ in warc.parse_records(data)]
    names = [h["warc-record-id"] for h in headers]
    assert len(set(names)) == len(names) == 7
    responses = {h["warc-record-id"] for h in headers if h["warc-type"] == "response"}
    assert {h["warc-refers-to"] for h in headers if h["warc-type"] == "revisit"} <= responses


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    rows = [(i, f"u{i}", "x" * (20_000 if i % 50 == 0 else 100)) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/w", records_per_file=100, file_bytes=60_000)
    for f in (tmp_path / "w").glob("part-*"):
        with gzip.open(f) as data:
            sizes = [len(block) for _, _, block in warc.parse_records(data)]
        assert len(sizes) <= 100 and sum(sizes) < 60_000 + 100 * 150, sizes


def test_positions_are_the_global_order(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}/{i % 3}", f"p{i % 11}") for i in range(300)], "page_id long, url string, html string")
    rows = sorted(warc.capture_histories(pages).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(300))
    order = [(r.url_key, r.capture_ts, r.page_id) for r in rows]
    assert order == sorted(order)
