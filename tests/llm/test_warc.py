import base64
import glob
import gzip
import hashlib
import json

from bitdex.llm import warc


def test_round_trip(spark, sf001, tmp_path):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf001}/pages.parquet").collect()}
    df = warc.op6_warc(spark, sf001)
    rows = df.collect()
    assert len(rows) == 2 * len(pages)
    path = str(tmp_path / "out")
    warc.write_warc(df, path)
    back = [x for f in glob.glob(path + "/part-*") for x in warc.parse_warc(gzip.open(f).read())]
    assert len(back) == len(rows)
    by_id = {h["WARC-Record-ID"]: (h, b) for h, b in back}
    assert len(by_id) == len(rows)
    for r in rows:
        head, block = by_id[r.record_id]
        assert block == r.block.encode() and int(head["Content-Length"]) == r.content_length
        assert head["WARC-Refers-To"] == r.refers_to and head["WARC-Type"] == r.warc_type
        assert head["WARC-Target-URI"] == pages[r.page_id].url == r.target_uri
        want = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert head["WARC-Block-Digest"] == r.block_digest == want
        payload = pages[r.page_id].html.encode()
        assert r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if r.warc_type == "metadata":
            meta = json.loads(r.block)["Envelope"]
            assert meta["WARC-Header-Metadata"]["WARC-Record-ID"] == r.refers_to
            http = meta["Payload-Metadata"]["HTTP-Response-Metadata"]
            assert http["Headers"]["Content-Length"] == str(len(payload))
            assert len(http["HTML-Metadata"]["Links"]) == pages[r.page_id].html.count("<a href=")
    assert sorted(map(str, rows)) == sorted(map(str, warc.op6_warc(spark, sf001).collect()))   # ids are stable


def test_plain_text_and_headers():
    assert warc.plain_text("<head><title>t</title></head><p>a  &amp;\nb<br>c</p><script>x</script><!-- y --><div>d<i>e</i></div>") \
        == "a & b\nc\nde"
    assert warc.http_headers("HTTP/1.1 200 OK\r\nA: 1\r\na-b:2\r\nA: 3\r\n\r\n") == ("HTTP/1.1 200 OK", {"A": "1, 3", "a-b": "2"})


def test_nulls_long_repeated_and_empty(spark):
    rows = [("r1", None, None, None, None, 7), ("r1", None, None, None, None, 7), ("r2", "u\r\nX: y", "d", "h", "<p>" + "é " * 99999, 8),
            (None, "", "", "", "", None)]
    schema = "response_id string, target_uri string, date string, http_head string, payload string, block int"
    df = spark.createDataFrame(rows, schema)
    got = warc.derivatives(df).collect()
    assert len(got) == 8 and "X: y" in [r for r in got if r.refers_to == "r2"][0].header.split("\r\n")[2]
    assert {r.content_length for r in got if r.refers_to == "r1" and r.warc_type == "conversion"} == {0}
    assert warc.derivatives(df.limit(0)).collect() == []


def test_links_and_metas_with_and_without_quotes():
    import json
    page = ("<title>T</title><meta name=robots content='a &amp; b'><a href=/x>1</a><a class=c href='/y?a=1&amp;b=2'>2</a>"
            "<img alt=\"\" src=\"z.png\"><a href=\"\">3</a><script src=s.js></script><a name=n>no</a>")
    text = warc._metadata("id", "http://h/", "", page.encode(), page)
    found = json.dumps(json.loads(text))
    for url in ("/x", "/y?a=1&b=2", "z.png", "s.js"):
        assert json.dumps({"url": url})[1:-1] in found
    assert warc.LINK.findall("<img alt=\"see src=no\" src=yes><a title='href=no'>x</a><abbr href=no>")[0][1:5:3] == ("src", "yes")
    assert len(warc.LINK.findall("<img alt=\"see src=no\" src=yes><a title='href=no'>x</a><abbr href=no>")) == 1
    assert found.count('"url"') >= 5 and "a & b" in found and '"robots"' in found
