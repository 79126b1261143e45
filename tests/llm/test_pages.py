import base64
import gzip
import hashlib
import io
import json
import zlib
from html.parser import HTMLParser

import pytest

from tessella.llm import htmltext, warc
from tessella.session import scratch_path

ROWS = [(1, "u", "x"), (2, "u", "x"), (3, None, "x"), (3, "b", "x"), (4, "c", None), (5, "c", ""), (6, "é\n", "é"), (None, "c", "x"), (None, "c", "lone"), (7, "d", "long " * 300_000)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha1 string")


@pytest.mark.parametrize("least", [0, 2])
def test_archive_round_trip(spark, least):
    out = warc.round_trip(pages(spark), least).collect()
    assert len(out) == len(ROWS) and all(r.intact for r in out)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted((str(r.page_id), r.payload_digest, r.payload_bytes) for r in out) == sorted((str(p), digest(h), len((h or "").encode())) for p, _, h in ROWS)
    for size in {r.payload_digest for r in out}:
        rows = [r for r in out if r.payload_digest == size]
        first = [r for r in rows if r.record_type == "response"]
        if rows[0].payload_bytes < least:
            assert len(first) == len(rows)
        else:
            assert len(first) == 1 and all(r.refers_to == first[0].page_id for r in rows if r.record_type == "revisit")
            assert first[0].page_id == max((r.page_id for r in rows if r.page_id is not None), default=None)


def test_members_and_sidecar(spark):
    folder = scratch_path(spark, "warc-test")
    index = warc.normalise(warc.archive(pages(spark), folder)).collect()
    place = folder.removeprefix("file://")
    for path in {r.path for r in index}:
        local = place + path[len(folder) :]
        data = open(local, "rb").read()
        lines = [json.loads(x) for x in open(local.removesuffix(".warc.gz") + ".idx")]
        assert sum(x["length"] for x in lines) == len(data)
        for x in lines:
            fields, _, _ = warc.parse_record(zlib.decompress(data[x["offset"] : x["offset"] + x["length"]], 31))
            assert fields.get("x-page-id") == (None if x["page_id"] is None else str(x["page_id"])) and fields["warc-type"] == x["type"]
        raw = local.rpartition("/")[0] + "/raw-" + local.rpartition("/")[2]
        assert gzip.decompress(open(raw, "rb").read()) == gzip.decompress(data)


def test_stream_is_inflated_in_pieces(monkeypatch):
    records = [warc.build_record(k, "u", b"p" * (k * 7), k * 7, "D", None, False) for k in range(50)]
    for stream in (gzip.compress(b"".join(records)), b"".join(gzip.compress(r) for r in records)):
        for piece in (1, 13, 1 << 20):
            monkeypatch.setattr(warc, "PIECE", piece)
            assert list(warc.records_of(io.BytesIO(stream))) == records
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(gzip.compress(records[3][:-9]))))


def test_no_pages(spark):
    assert warc.round_trip(pages(spark).limit(0)).count() == 0
    assert htmltext.extract(pages(spark).limit(0)).count() == 0


BOILER = '<nav><a href="/">Home</a> <a href="/x">Other</a></nav><div class="ad-box">Buy now, really.</div>'


@pytest.mark.parametrize(("source", "text"), [
    (None, ""), ("", ""), ("   ", ""), ("<html><body></body></html>", ""),
    (f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{BOILER}<article><h1>Head &amp; more</h1><p>One,\n two.  <b>bold</b>x<br>y<p>Three.</article><footer>&copy; me</footer>", "Head & more\n\nOne, two. boldx y\n\nThree."),
    ("<body><article><p>Cut short &amp; so <b>on</b> <a hr", "Cut short & so on"),
    ('<body class="with-sidebar"><div id="main"><h2>Head</h2><p>A paragraph with text, and more text. Yes.</p><p>Short.</p></div><div class="sidebar">Links, and more.</div><section id="comments"><p>Nice post, thanks!</p></section><form><p>Your name, please.</p></form></body>', "Head\n\nA paragraph with text, and more text. Yes.\n\nShort."),
    ("<article><header><h1>Kept</h1></header><p>Body text, here.</p><aside>Not this.</aside><div class='comment-list'>Nor this, at all.</div></article>", "Kept\n\nBody text, here."),
    ("<main><ul><li>First item, fine.<li>Second item, fine.</ul></main>", "First item, fine.\n\nSecond item, fine."),
    ("plain words, no markup 1 < 2", "plain words, no markup 1 < 2"),
    ("<article><p>a<!-- hidden > --> b</p><p hidden>no</p><p style='display: none'>no</p></article>", "a b"),
])
def test_main_text(spark, source, text):
    assert htmltext.main_text(source or "") == text


def test_extract_keeps_rows_and_columns(spark):
    rows = [(1, "u", "<article><p>Text.</p></article>", "c"), (1, "u", "<article><p>Text.</p></article>", "c"), (None, None, None, None), (2, "v", "<p>" * 5000 + "deep, deep." + "<div>" * 5000, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = htmltext.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((str(r.page_id), r.text, r.n_chars) for r in out.collect())) == [("1", "Text.", 5), ("1", "Text.", 5), ("2", "deep, deep.", 11), ("None", "", 0)]


LONG = "A long paragraph, with many words. " * 60


@pytest.mark.parametrize(("source", "text"), [
    (f"<body><article><h1>Title</h1><p>Lead, short.</p><div class='body'><p>{LONG}</p></div><p>Closing.</p></article></body>", ["Title", "Lead, short.", LONG.strip(), "Closing."]),
    (f"<article><section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2><p>Brief, but here.</p></section></article>", ["One", LONG.strip(), "Two", "Brief, but here."]),
    (f"<main><article><p>{LONG}</p></article><p>After it, a word.</p></main>", [LONG.strip(), "After it, a word."]),
    (f"<body><div><h1>Head</h1><div><p>{LONG}</p></div><div><p>The end, at last.</p></div></div></body>", ["Head", LONG.strip(), "The end, at last."]),
    (f"<body><div class='has-sidebar page-header-fixed'><p>{LONG}</p><div class='sidebar'>Links.</div></div></body>", [LONG.strip()]),
])
def test_main_text_of_nested_pages(source, text):
    assert htmltext.main_text(source) == "\n\n".join(text)


@pytest.mark.parametrize(("source", "text"), [
    (f"<body><div class='content no-sidebar'><p>{LONG}</p></div></body>", [LONG.strip()]),
    (f"<body><div class='post has-comments'><p>{LONG}</p><div class='comments'><p>A reader's word, said here.</p></div></div></body>", [LONG.strip()]),
    (f"<body><form action='/'><nav><a href='/'>Home</a></nav><div><h2>Head</h2><p>{LONG}</p></div></form></body>", ["Head", LONG.strip()]),
    (f"<article><div class='article-header'><h1>Title</h1></div><p>{LONG}</p><p class='related-note'>A note, to keep.</p></article>", ["Title", LONG.strip(), "A note, to keep."]),
    (f"<body><div class='title'><h1>Title</h1></div><div class='text'><p>{LONG}</p></div><div class='site-footer'>All that, and more.</div></body>", ["Title", LONG.strip()]),
    (f"<body><ul><li><a href='/a'>One</a><li><a href='/b'>Two</a></ul><h1>Title</h1><p>{LONG}</p><ul><li>Short</li></ul><p>{LONG}</p><div class='cookie-notice'>We use them, too.</div></body>", ["Title", LONG.strip(), "Short", LONG.strip()]),
    (f"<body><ul><li><a href='/a'>One</a></ul><h1>Title</h1><p><b>Brief lead</b></p><p>{LONG}</p><p>{LONG}</p></body>", ["Title", "Brief lead", LONG.strip(), LONG.strip()]),
    ("<body><nav><a href='/'>Home</a></nav><div class='comment-list'><p>Only readers, here.</p></div><footer>End.</footer></body>", []),
    (f"<body><div class='user-comments'><p>{LONG}</p></div><div><p>An article, and no long one.</p></div></body>", ["An article, and no long one."]),
    (f"<main><p>{LONG}</p><p><a href='/x'>A link to read, alone</a></p></main><div><p>Beside it, in a box.</p></div>", [LONG.strip(), "A link to read, alone"]),
])
def test_names_only_lower_a_ratio(source, text):
    assert htmltext.main_text(source) == "\n\n".join(text)


class PlainPage(HTMLParser):
    """Text by path of tags and classes, with every element closed as the pages of the table close them."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.open, self.nodes = [], []
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in htmltext.VOID:
            return
        if tag not in htmltext.INLINE and any(t == "p" for t, _ in self.open):
            while self.open.pop()[0] != "p":
                pass
        self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if data.strip() and not {"script", "style", "head", "title", "noscript", "template"} & {t for t, _ in self.open}:
            self.nodes.append((tuple(self.open), data))


def test_ratios_choose_the_paths_of_the_table(spark, data):
    """Every page: the fused ratios by plain sums over a plain parser's nodes, and what they or the names change."""
    changed = {"ratios": 0, "names": 0}
    rows = [r.html or "" for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    for source in rows:
        page = htmltext.Page(source)
        low = htmltext.lowered(page, 0.9)
        paths = htmltext.Paths(page, low, htmltext.Limits())
        sums = {}
        for path, text in PlainPage(source).nodes:
            s = sums.setdefault(path, [0, 0, 0, 0])
            n = len(text) - text.count(" ")
            for k, x in enumerate((n, sum(c in ".,;:!?…、。，！？" for c in text), 1, n * any(t == "a" for t, _ in path))):
                s[k] += x
        plain, order = {}, list(sums)
        article = any(any(t in ("article", "main") for t, _ in p) for p in order)
        for k, p in enumerate(order):
            near = [order[j] if 0 <= j < len(order) and order[j][:-1] == p[:-1] else p for j in (k - 1, k + 1)]
            chars, marks = (0.5 * sums[p][i] / sums[p][2] + 0.25 * sum(sums[q][i] / sums[q][2] for q in near) for i in (0, 1))
            named = any(t in htmltext.BOILERPLATE or t in ("header", "form") or (c and set(c.split("-")) & (htmltext.STRONG | htmltext.WEAK)) for t, c in p)
            outside = article and not any(t in ("article", "main") for t, _ in p)
            plain[p] = chars * (1 + marks) * (1 - sums[p][3] / sums[p][0]) * (htmltext.LOWERED if named else 1) * (htmltext.OUTSIDE if outside else 1)
        assert sorted(paths.ratio.values()) == pytest.approx(sorted(plain.values())), source
        text = htmltext.main_text(source)
        assert text == "\n\n".join(filter(None, (" ".join(b.split()) for b in blocks(source))))
        for switch in changed:
            changed[switch] += text != htmltext.main_text(source, htmltext.Limits(**{switch: False}))
    assert changed["ratios"] == len(rows) and changed["names"] > len(rows) / 2


def blocks(source):
    """Blocks of the article as a plain parser sees them: text between tags that are not inline."""

    class Blocks(HTMLParser):
        out, deep = [""], 0

        def handle_starttag(self, tag, attrs):
            self.deep += tag == "article"
            self.out = [*self.out, ""] if tag not in htmltext.INLINE else self.out
            if tag == "br" and self.deep:
                self.out[-1] += " "

        def handle_endtag(self, tag):
            self.deep -= tag == "article"
            self.out = [*self.out, ""] if tag not in htmltext.INLINE else self.out

        def handle_data(self, data):
            if self.deep:
                self.out[-1] += data

    parser = Blocks(convert_charrefs=True)
    parser.feed(source)
    return parser.out


@pytest.mark.parametrize("part", ["<a", "<a '", "</", "<p><div>", "<div>", "<ul><li>a", '<a ">x', "<b><i>x</b>", "<!--", "<script>"])
def test_odd_markup_takes_linear_time(part):
    import time

    start = time.perf_counter()
    htmltext.main_text(part * (400_000 // len(part)))
    assert time.perf_counter() - start < 10


def test_threads_and_walls_outside_the_article_go():
    body = "<p>" + "A sentence of the article, with some words in it. " * 8 + "</p>"
    page = lambda inner: f"<html><body><article><h1>Title</h1>{body}{inner}</article><div class='discussion'><p>Nice read, thanks a lot, really.</p></div><div id='reactions'><p>I do not agree, not at all.</p></div><div class='paywall'>Sign in to read more.</div></body></html>"
    text = htmltext.main_text(page(f"<section class='discussion'>{body}</section>"))
    assert "Nice read" not in text and "agree" not in text and "Sign in" not in text and text.count("A sentence") == 16
    bare = htmltext.main_text(f"<html><body><h1>Title</h1>{body}{body}<div class='discussion'><p>Nice read, thanks a lot, really.</p></div><div class='paywall'>Sign in to read more.</div></body></html>")
    assert bare.count("A sentence") == 16 and "Nice read" not in bare and "Sign in" not in bare
