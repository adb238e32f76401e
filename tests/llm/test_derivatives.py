import base64
import hashlib
import json

from innings_engine.llm import derivatives as dv

COLUMNS = "record_id string, target_uri string, warc_date string, warc_headers string, http_headers string, body string, block string"
PAGE = ('<!DOCTYPE html><html lang="en-GB"><head><title>A &amp;\n B</title><style>p{x:"</p>"}</style><script>var t="<p>no</p>";</script></head><body><!-- <a href="/no">n</a> -->'
        '<p>One <b>two</b>&nbsp;&lt;three&gt;<br>four<p>five  six<a href="/x?a=1&amp;b=2">L</a><img src=\'i.png\'></body></html>')


def test_facts_and_text():
    assert dv.plain_text(PAGE) == "One two <three>\nfour\nfive sixL"
    assert dv.page_facts(PAGE) == {"title": "A & B", "lang": "en-GB", "links": [{"tag": "a", "url": "/x?a=1&b=2"}, {"tag": "img", "url": "i.png"}]}
    assert dv.plain_text("") == "" and dv.plain_text("a < b and <unclosed") == "a < b and <unclosed" and dv.plain_text("<script>x") == ""


def test_records_are_linked(spark):
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-A: 1\r\nX-A: 2\r\n"
    rows = [("<urn:uuid:1>", "http://a/", "2024-01-01T00:00:00Z", "WARC-Type: response\r\n", head, PAGE, "clash"), ("<urn:uuid:2>", None, None, None, None, None, "x"), (None, "u", "d", "", "", "é", "x")]
    rows += [rows[0]]
    got = dv.derivatives(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(got) == 8
    for r in got:
        raw = r.block.encode()
        assert r.content_length == len(raw) and r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
        whole = dv.record_bytes(r)
        front, _, rest = whole.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in front.decode().split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(rest) - 4 and fields.get("WARC-Refers-To") == r.refers_to and fields["WARC-Type"] == r.warc_type
    own = {r.warc_type: r for r in got if r.refers_to == "<urn:uuid:1>"}
    assert own["metadata"].record_id != own["conversion"].record_id
    facts = json.loads(own["metadata"].block)
    assert facts["http"] == [["", "HTTP/1.1 200 OK"], ["Content-Type", "text/html"], ["X-A", "1"], ["X-A", "2"]] and facts["warc"] == [["WARC-Type", "response"]]
    assert facts["payload_digest"] == own["conversion"].source_digest == dv.digest(PAGE.encode())
    assert [r.block for r in got if r.refers_to == "<urn:uuid:2>" and r.warc_type == "conversion"] == [""]
    assert len({r.record_id for r in got if r.record_id}) == 4  # repeats have the same ids
    assert dv.derivatives(spark.createDataFrame([], COLUMNS)).collect() == []
