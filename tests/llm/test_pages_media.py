import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import htmltext, ogg, urlgbt, warc


# Ogg ------------------------------------------------------------------------------------


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1) & 0xFFFFFFFF
    return crc


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=200))
def test_page_crc(data):
    assert ogg.page_crc(data) == slow_crc(data)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1200), min_size=1, max_size=6), min_size=1, max_size=3), st.integers(1, 5))
def test_mux_round_trip(shapes, per_page):
    streams = [ogg.Stream(10 + s, [bytes([s + 1]) * n for n in sizes], list(range(len(sizes)))) for s, sizes in enumerate(shapes)]
    back = ogg.demux(ogg.mux(streams, per_page))
    assert {k: v.packets for k, v in back.items()} == {s.serial: s.packets for s in streams}


def test_long_packets_span_pages():
    big = bytes(range(256)) * 1000
    stream = ogg.Stream(1, [b"head", big, b"", b"x" * 255, big], [0, 1, 2, 3, 4])
    assert ogg.demux(ogg.mux([stream]))[1].packets == stream.packets


@pytest.mark.parametrize("n", [1, 64, 4096, 4097, 500_000])
def test_store_and_timestamps(n):
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    back, note, stream = ogg.load(ogg.store(payload, "note"))
    assert back == payload and note == "note"
    ends = np.cumsum([len(p) for p in stream.packets[1:]]) / ogg.RATE
    assert np.allclose(stream.timestamps[1:], ends)


def test_damage_is_found():
    media = bytearray(ogg.store(b"payload" * 100))
    for at in (5, 30, len(media) // 2, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 0xFF
        with pytest.raises(ogg.OggError):
            ogg.load(bytes(bad))
    for cut in (10, len(media) - 3):
        with pytest.raises(ogg.OggError):
            ogg.load(bytes(media[:cut]))


def test_media_columns(spark, rows, empty):
    df = rows()
    got = ogg.decode_media(ogg.encode_texts(df)).collect()
    want = sorted((r.doc_id, r.text or "") for r in df.collect())
    assert len(got) == len(want)
    for r, (i, t) in zip(sorted(got, key=lambda r: r.doc_id), want, strict=True):
        raw = t.encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.error is None and r.feature
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (4, 5)}) == 1
    assert ogg.decode_media(ogg.encode_texts(empty)).collect() == []
    broken = spark.createDataFrame([(1, 3, b"OggSbad"), (2, 3, None)], "doc_id long, n_bytes long, media binary")
    assert [(r.doc_id, r.payload_sha256, bool(r.error)) for r in ogg.decode_media(broken).orderBy("doc_id").collect()] == [(1, None, True), (2, None, False)]


# WARC -----------------------------------------------------------------------------------

PAGE = "<html><head><title>T</title><style>p{}</style></head><body><h1>Head &amp; more</h1><p>One<br>two</p><script>x='<p>'</script><!-- no --><ul><li>a<li>b</ul></body></html>"


def test_derivatives_link_to_their_source():
    raw = warc.response("http://a.example/x", PAGE, "1", "2024-01-01T00:00:00Z")
    meta, conv = warc.derive(raw)
    source, block = warc.parse(raw)
    look = dict(source)
    for d in (meta, conv):
        fields, own = warc.parse(d["record"])
        f = dict(fields)
        assert f["WARC-Refers-To"] == look["WARC-Record-ID"] == d["refers_to"]
        assert f["WARC-Refers-To-Target-URI"] == f["WARC-Target-URI"] == "http://a.example/x"
        assert f["WARC-Block-Digest"] == warc.digest(own) == d["block_digest"]
        assert int(f["Content-Length"]) == len(own) == d["content_length"]
        assert d["source_block_digest"] == warc.digest(block) and d["source_payload_digest"] == warc.digest(PAGE.encode())
        assert json.loads(d["source_headers"]) == [list(x) for x in source]
    assert warc.parse(conv["record"])[1].decode() == "Head & more\n\nOne\ntwo\n\n- a\n- b"
    assert b"http-content-type: text/html; charset=utf-8\r\n" in meta["record"]
    assert b"source-warc-payload-digest: " + look["WARC-Payload-Digest"].encode() in meta["record"]
    assert warc.derive(raw) == [meta, conv]


@pytest.mark.parametrize("spoil", [lambda r: r[:-10], lambda r: r.replace(b"One", b"Two"), lambda r: b"junk", lambda r: r.replace(b"HTTP/1.1", b"HTTQ/1.1"), lambda r: b""])
def test_broken_records_say_so(spoil):
    out = warc.derive(spoil(warc.response("http://a/x", PAGE, "1", "2024-01-01T00:00:00Z")))
    assert [d["record_type"] for d in out] == ["metadata"] and out[0]["error"]


def test_warc_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (2, "http://a/b", "", "x"), (3, "http://a/b", PAGE, "x"), (3, "http://a/b", PAGE, "x"), (4, "http://a/c", "<p>" + "word " * 50_000, "x")], "page_id long, url string, html string, record string")
    got = warc.build_derivatives(warc.pages_to_responses(df)).collect()
    assert len(got) == 10 and not any(r.error for r in got)
    assert len({r.record_id for r in got}) == 8
    assert warc.build_derivatives(warc.pages_to_responses(df.where("false"))).collect() == []
    assert [r.content_length for r in got if r.page_id == 4 and r.record_type == "conversion"] == [5 * 50_000 - 1]


# HTML -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>One<p>Two", "One\n\nTwo"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>x<li>y<ul><li>z</ul></ul>", "- x\n- y\n  - z"),
        ("<ol start=3><li>x</li><li>y</li></ol>", "3. x\n4. y"),
        ("<table><tr><th>Name<th>N<tr><td>Ann<td>1<tr><td>Christopher<td>22</table>", "Name        | N\nAnn         | 1\nChristopher | 22"),
        ("<p hidden>no</p><div style='color:red;display: none'>no</div><p>yes</p>", "yes"),
        ("<script>if(a<b){}</script><style>p{}</style><p>t</p><noscript>n</noscript>", "t"),
        ("<title>t</title><body>b", "b"),
        ("<pre>a\n  b\n</pre>c", "a\n  b\n\nc"),
        ("x &lt;b&gt; &amp; &eacute;&#65;", "x <b> & éA"),
        ("<p>open <b>bold<p>next</b> end", "open bold\n\nnext end"),
        ("a < b and c > d", "a < b and c > d"),
        ("<img alt='pic'> <input type=hidden value=no><input type=submit value=Go>", "pic Go"),
        ("<!-- <p>no</p> -->yes<!-- open", "yes"),
        ("<blockquote>q</blockquote>z", "    q\n\nz"),
        ("<p title='a>b'>t</p>", "t"),
    ],
)
def test_render(html, text):
    assert htmltext.render(html) == text


def test_render_formulas_and_charts():
    page = """<p>Before <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>3</mn></mrow><annotation encoding="application/x-tex">x=3 tex</annotation></semantics></math> after</p>
    <div>Chart: <svg viewBox="0 0 9 9"><title>tip</title><desc>long tip</desc><style/><defs><text>unused</text></defs><defs/><path d="M0 0"/><g><text x="1">Sales</text><text x="2">Costs</text></g><text display="none">off</text></svg>end</div>
    <p>last <desc>shown</desc></p>"""
    assert htmltext.render(page) == "Before x=3 after\n\nChart: Sales Costs end\n\nlast shown"
    assert htmltext.render("<svg>" + "<path/>" * 500 + "<text>a</text></svg><p>b</p>") == "a\n\nb"
    assert htmltext.render("<svg/><p>c</p><svg><style>d{}</style><text>e</text></svg>") == "c\n\ne"


def test_render_deep_and_long():
    assert htmltext.render("<div>" * 5000 + "deep") == "deep"
    assert htmltext.render("<ul><li>" * 2000 + "x").endswith("x")
    assert len(htmltext.render("<p>" + "word " * 100_000).split()) == 100_000


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<ul>", "<li>", "</ul>", "<div>", "</div>", "<br>", "<pre>", "</pre>", "w1", "w2", " ", "\n", "<", "&amp;"]), max_size=25))
def test_no_visible_word_is_lost(parts):
    source = " ".join(parts)
    assert sorted(w for w in htmltext.render(source).replace("|", " ").split() if w in ("w1", "w2")) == sorted(w for w in parts if w in ("w1", "w2"))


def test_html_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, PAGE, "x"), (3, PAGE, "x")], "page_id long, html string, text string")
    got = sorted((r.page_id, r.text, r.n_lines) for r in htmltext.extract(df).collect())
    assert got == [(1, "", 0), (2, "", 0)] + 2 * [(3, "Head & more\n\nOne\ntwo\n\n- a\n- b", 7)]
    assert htmltext.extract(df.where("false")).collect() == []


# URLs -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [
        (None, "", ""),
        ("no scheme", "", ""),
        ("http://A.Example.COM", "a.example.com", ""),
        ("https://x.org/fr/P?q=/a#b", "x.org", "/fr/P"),
        ("https://x.org#f/g", "x.org", ""),
        ("https://x.org?u=://b/c", "x.org", ""),
        ("://h/p", "h", "/p"),
        ("a://b://c/d", "b:", "//c/d"),
        ("http://É.NET/", "É.net", "/"),
    ],
)
def test_split_url(url, host, path):
    assert urlgbt.split_url(url) == (host, path)


@pytest.mark.parametrize(
    ("host", "path", "rule"),
    [("example.net", "/en/1", ("example.net/en/", "allow")), ("a.net", "/", ("net/", "block")), ("a.net", "", None), ("anet", "/", None), ("w.example.com", "/de/x", ("example.com/de/", "block")), ("badexample.com", "/de/x", None), ("x.org", "/fr/", ("org/fr/", "allow")), ("x.org", "/de/", None), ("m.example.net", "/fr/", ("net/", "block"))],
)
def test_rules(host, path, rule):
    assert urlgbt.match_rule(host, path) == rule


def test_rules_decide_where_they_fit(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/../sf0.1/pages.parquet")
    got = urlgbt.judge(pages, urlgbt.train(pages)).collect()
    assert all(r.verdict == ("allow" if r.rule in ("example.net/en/", "org/fr/") else "block") for r in got if r.rule)
    free = [r for r in got if r.rule is None]
    assert free and all((r.verdict == "block") == (r.p_block >= 0.5) for r in free)


def test_trees_separate_held_out_rows():
    rng = np.random.default_rng(0)
    names = ["".join(rng.choice(list("abcdefgh"), 7)) for _ in range(600)]
    urls = [f"http://{n}-{k}{k}.example.com/p{k}" if k % 3 == 0 else f"http://{n}.example.com/p{k}" for k, n in enumerate(names)]
    labels = [k % 3 == 0 for k in range(600)]
    model = urlgbt.fit(urls[:400], labels[:400])
    x = np.array([urlgbt.lexical(u, *urlgbt.split_url(u), model.stats) for u in urls[400:]])
    assert np.mean((model.blocked(x) >= 0.5) == np.array(labels[400:])) > 0.97


def test_url_rows(spark):
    df = spark.createDataFrame([(1, None, "h"), (2, "", "h"), (3, "http://a.net/x", "h"), (3, "http://a.net/x", "h")], "page_id long, url string, host string")
    got = urlgbt.judge(df, urlgbt.train(df)).orderBy("page_id").collect()
    assert [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got] == [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.net", "/x", "net/", "block"), (3, "a.net", "/x", "net/", "block")]
    assert urlgbt.judge(df.where("false"), urlgbt.fit([], [])).collect() == []


def test_header_struct_is_the_container_format():
    assert ogg.HEADER.size == 27 and struct.calcsize("<4sBBqIIIB") == 27
