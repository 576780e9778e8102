import json

import pytest

from driftfield.llm import html_extract as H
from driftfield.llm import warc

ARTICLE = "<article><h1>Title &amp; more</h1><p>First <b>bold</b> line.<br>Next&nbsp;one.<p>Second paragraph of the story, with several words in it.</article>"
PAGES = [
    (f"<html><head><title>t</title><style>p{{}}</style><script>var t='</p><p>no';</script></head><body><nav><ul><li><a href='/a'>Home page</a></li></ul></nav><!-- <p>no</p> --><div class='ad'>Buy now.</div>{ARTICLE}<footer>&copy; me</footer></body></html>", "Title & more First bold line. Next one. Second paragraph of the story, with several words in it."),
    ("", ""), (None, ""),
    ("<html><body><nav><ul><li><a href='/a'>only a menu</a></li></ul></nav></body></html>", ""),
    (f"<body><header><p>Site name</p></header>{ARTICLE}<aside><h3>Related</h3><ul><li><a href=x>Other story</a></li></ul></aside><section class='comments'><h3>Comments</h3><div class='comment'><p>I think so.</p></div></section><form><p>Subscribe today</p><button>Go</button></form>", "Title & more First bold line. Next one. Second paragraph of the story, with several words in it."),
    ("<article><p>Cut off in the middle of a lovely sentence &am", "Cut off in the middle of a lovely sentence &am"), ("<article><p>Cut off in the middle of a tag, after the words</p><p cla", "Cut off in the middle of a tag, after the words"),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_main_text(page, want):
    assert H.default_model().extract(page) == want


def test_held_out_pages():
    good = total = 0
    for page in H.labelled_pages(120, seed=501):
        tree = H.Tree(page)
        y = [tree.label[0] or 0]
        for i in range(1, len(tree.tag)):
            y.append(tree.label[i] if tree.label[i] is not None else y[tree.parent[i]])
        good += sum((m >= 0.5) == bool(t) for m, t in zip(H.default_model().marginals(tree), y))
        total += len(y)
    assert good / total > 0.98


def test_messages_give_exact_marginals():
    import itertools
    import math

    tree = H.Tree("<div><p>a</p><section><p>b</p><nav>c</nav></section></div>")
    model = H.Model({}, [[0.3, -0.7, 0.2, 0.9], [0.5, -1.0, 0.1, -0.2], [-0.4, 0.6, 0.8, -0.3]])
    own = [0.4, -0.3, 1.2, -0.8, 0.1, 0.7]
    n, weight, on = len(tree.tag), 0.0, [0.0] * len(tree.tag)
    assert n == len(own)
    for ys in itertools.product((0, 1), repeat=n):
        w = math.exp(sum(o * y for o, y in zip(own, ys)) + sum(model.pairs[H.kind(tree.tag[i])][2 * ys[tree.parent[i]] + ys[i]] for i in range(1, n)))
        weight += w
        on = [x + w * y for x, y in zip(on, ys)]
    assert model.beliefs(tree, own)[0] == pytest.approx([x / weight for x in on])


def test_extract_operator(spark):
    df = spark.createDataFrame([(i, p, "mine") for i, (p, _) in enumerate(PAGES + PAGES[:1])], "page_id long, html string, Text string")
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    assert got == {i: w for i, (_, w) in enumerate(PAGES + PAGES[:1])} and H.extract(df.where("false")).count() == 0


def test_deep_and_long_pages():
    deep = "<article><h1>Title</h1><p>Some words of a long story, with more to come.</p>" + "<div>" * 3000 + "<p>and deep text of the story, with several more words in it</p>" + "</div>" * 10
    tree = H.Tree(deep)
    assert max(tree.parent) == 3003 and len(tree.tag) == 3005 and tree.text([True] * 3005).endswith("several more words in it")
    assert H.default_model().extract(deep).startswith("Title Some words of a long story, with more to come.")
    assert len(H.default_model().extract("<article>" + "<p>some words in a paragraph.</p>" * 5000)) > 100_000


@pytest.mark.parametrize("unit", ["<title>", "<a ", "<a href='", "</li>", "<li></li>", "<div>", "<p", "<script ", "<!--", "<div class=", "<", "&#", "&amp", "<svg>", "<html lang ", "<ul><li>", "</script", "<x y=\"", "&#0"])
def test_a_million_characters_take_seconds(unit):
    import time

    for page in (unit * (1_000_000 // len(unit)), "<li><ul>" + "<div>" * 20_000 + unit * (800_000 // len(unit))):
        began = time.perf_counter()
        H.Tree(page).text([True] * len(H.Tree(page).tag))
        warc.derivatives("id", "u", "d", page, "x")
        assert time.perf_counter() - began < 40


def test_references_of_any_length():
    assert H.default_model().extract(f"<article><h1>A title</h1><p>Words &#{'9' * 6000}; &#{'0' * 6000}65; &#x{'0' * 6000}41; &amp; &am<b>p;</b> more of the story</article>") == "A title Words � A A & &amp; more of the story"


def test_titles_languages_and_links_come_from_tags():
    page = "<html lang=de><head><title>A &amp; b</title></head><body><!-- <a href=no>x</a> --><script>'<a href=\"no\">'</script><a title='<a href=no>' href='/x?a&amp;b'>link</a><svg><title>no</title></svg><template><a href=no></a></template><a name=x>y</a></body></html>"
    assert warc.read_page(page)[:3] == ("A & b", "de", ["/x?a&b"])


def test_records_of_files_and_back(spark, tmp_path):
    import gzip

    body = "<html><title>é</title><p>text</p></html>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nX-A: 1\r\nX-A: 2\r\n\r\n" + body.encode("latin-1")
    squeezed = gzip.compress(b"<p>squeezed</p>")
    chunks = b"".join(b"%x\r\n%s\r\n" % (len(x), x) for x in (squeezed[:7], squeezed[7:])) + b"0\r\n\r\n"
    other = b"HTTP/1.1 404 Not Found\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunks
    make = lambda kind, i, block, more="": f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{i}>\r\nWARC-Date: 2024-01-0{i}T00:00:00Z\r\nWARC-Target-URI: http://h/{i}\r\n{more}Content-Type: {'application/http; msgtype=response' if kind == 'response' else 'text/plain'}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    parts = [make("warcinfo", 1, b"a: b"), make("response", 2, http, "WARC-IP-Address: 1.2.3.4\r\nWARC-Payload-Digest: sha1:DECLARED\r\n"), make("response", 3, other), make("request", 4, b"GET / HTTP/1.1\r\n\r\n")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "in" / "b.warc").write_bytes(b"".join(parts) + make("response", 5, b"x" * 100)[:-60])  # cut off
    records = warc.read_warc(spark, str(tmp_path / "in"))
    assert records.count() == 8
    got = warc.http_responses(records)
    rows = {(r["key"].rpartition("/")[2], r["source_id"]): r for r in got.collect()}
    assert sorted(rows) == [("a.warc.gz#1", "<urn:x:2>"), ("a.warc.gz#2", "<urn:x:3>"), ("b.warc#1", "<urn:x:2>"), ("b.warc#2", "<urn:x:3>")]
    first, second = rows["a.warc.gz#1", "<urn:x:2>"], rows["b.warc#2", "<urn:x:3>"]
    assert (first["payload"], first["ip"], first["date"], first["payload_digest"], first["http_status"]) == (body, "1.2.3.4", "2024-01-02T00:00:00Z", "sha1:DECLARED", 200)
    assert json.loads(first["http_headers"]) == [["Content-Type", "text/html; charset=ISO-8859-1"], ["X-A", "1"], ["X-A", "2"]]
    assert second["payload"] == "<p>squeezed</p>" and second["payload_digest"] == warc.digest(chunks) and second["http_status"] == 404
    made = warc.derived_records(got.where("key LIKE '%gz#1'"), "key")
    warc.write_warc(made, str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("*.warc.gz")
    back = warc.parsed_records(file.read_bytes())
    assert [h["WARC-Type"] for h, _ in back] == ["metadata", "conversion"] and back[1][1] == b"\xc3\xa9\ntext"[3:]
    for h, b in back:
        assert h["WARC-Refers-To"] == "<urn:x:2>" and h["WARC-Refers-To-Target-URI"] == h["WARC-Target-URI"] == "http://h/2" and h["WARC-Refers-To-Date"] == "2024-01-02T00:00:00Z"
        assert h["WARC-Source-Payload-Digest"] == "sha1:DECLARED" and h["WARC-IP-Address"] == "1.2.3.4" and h["WARC-Block-Digest"] == warc.digest(b) and int(h["Content-Length"]) == len(b)
    assert json.loads(back[0][1])["http_headers"][0] == ["Content-Type", "text/html; charset=ISO-8859-1"]
    data, n = file.read_bytes(), 0
    import zlib

    while data:  # a member for each record
        member = zlib.decompressobj(31)
        assert member.decompress(data).startswith(b"WARC/1.1\r\n")
        data, n = member.unused_data, n + 1
    assert n == 2


def test_records_link_and_digests_hold(spark, tmp_path):
    rows = [(i, f"http://x/{i}", p) for i, (p, _) in enumerate(PAGES)] + [(None, None, None)] + [(0, "http://x/0", PAGES[0][0])] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    source = warc.responses(pages)
    ids = {r["source_id"]: r for r in source.collect()}
    assert len(ids) == len(rows) and {r["source_id"] for r in warc.responses(pages.repartition(3)).collect()} == set(ids)
    out = warc.derived_records(source).collect()
    assert len(out) == 2 * len(rows) and {r["warc_type"] for r in out} == {"metadata", "conversion"} and len({r["record_id"] for r in out}) == len(out)
    for r in out:
        s = ids[r["refers_to"]]
        assert r["target_uri"] == s["uri"] and r["refers_to_digest"] == warc.digest(s["payload"].encode()) and r["block_digest"] == warc.digest(r["block"].encode())
    pairs = {r["record_id"]: r["concurrent_to"] for r in out}
    assert all(pairs[b] == a for a, b in pairs.items())
    first = next(json.loads(r["block"]) for r in out if r["page_id"] == 0 and r["warc_type"] == "metadata")
    assert first["title"] == "t" and first["links"] == ["/a"]
    assert warc.derived_records(source.where("false")).count() == 0
    for how in ("gzip", None):
        warc.write_warc(warc.derived_records(source), str(tmp_path / f"out-{how}"), how)
        read = [x for f in sorted((tmp_path / f"out-{how}").glob("part-*")) for x in warc.parsed_records(f.read_bytes())]
        assert sorted((h["WARC-Record-ID"], b.decode()) for h, b in read) == sorted((r["record_id"], r["block"]) for r in out)
        assert all(h["WARC-Block-Digest"] == warc.digest(b) for h, b in read)


def test_the_query_has_two_records_for_each_page(spark):
    from driftfield.llm import registry

    pages = {r["page_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    out = registry.op10_warc(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 2 * len(pages)
    for r in out:
        page = pages[r["page_id"]]
        assert r["target_uri"] == (page["url"] or "") and r["refers_to_digest"] == warc.digest((page["html"] or "").encode()) and r["block_digest"] == warc.digest(r["block"].encode())
        if r["warc_type"] == "metadata":
            assert json.loads(r["block"])["html_chars"] == len(page["html"] or "")
