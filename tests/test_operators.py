import datetime
import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.functions import text, vectors
from tessella.operators import charts, chunking, lexical, mutations, rules, search, topics
from tessella.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("block", "parts"), [(1, 3), (7, 4), (64, 2), (4096, 1)])
def test_row_buckets_of_large_sheets_in_slices(spark, block, parts):
    """Sheets of every size, one of most rows, rows longer than the limit and empty ones, a null sheet."""
    import random

    rng = random.Random(block)
    rows = [(s, k, rng.choice((0, 1, 9, 30, 40, 41, 130)), f"{s}-{k}") for s, n in ((1, 1), (2, 700), (None, 90), (4, 33), (5, 5)) for k in range(n)]
    frame = spark.createDataFrame(rows, "sheet long, k long, n long, line string").repartition(parts)
    found = {(r.line, r.row, r.bucket, r.chars) for r in chunking.row_buckets(frame, ["sheet"], ["k"], "n", 120, "line", block=block).collect()}
    due = set()
    for _, k, n, line in rows:
        if k == 0:
            number, bucket, chars = 1, 0, 0
        number += 1
        if chars and chars + n > 120:
            bucket, chars = bucket + 1, 0
        chars += n + 1
        due.add((line, number, bucket, chars))
    assert found == due
    assert chunking.row_buckets(frame.limit(0), ["sheet"], ["k"], "n", 120, "line").collect() == []


def test_packed_units():
    whole = ["aaaa", "bbbb", "cccc", "d"]
    assert chunking.packed(whole, 10, 4) == ["aaaa\n\nbbbb", "bbbb\n\ncccc", "cccc\n\nd"]
    assert chunking.packed(whole, 13, 2) == ["aaaa\n\nbbbb", "bbbb\n\ncccc", "cccc\n\nd"]
    assert chunking.packed([], 10, 4) == []
    assert [len(c) for c in chunking.packed(["x" * 1800] * 3, 1800, 270)] == [1800, 3602, 3602]


def test_chunks(spark):
    df = spark.createDataFrame([(1, "aaaa\n\nbbbb\n \ncccc\n\nd"), (2, ""), (3, None), (4, "x" * 25), (5, "One two. Three four. Five")], "id long, text string")
    out = {}
    for r in chunking.chunked(df, "id", size=10).orderBy("id", "chunk_index").collect():
        out.setdefault(r.id, []).append(r.text)
    # The overlap of two characters carries one unit.
    assert out[1] == ["aaaa\n\nbbbb", "bbbb\n\ncccc", "cccc\n\nd"]
    ten = "x" * 10
    assert 2 not in out and 3 not in out and out[4] == [ten, f"{ten}\n\n{ten}", f"{ten}\n\nxxxxx"]
    assert out[5][0] == "One two."


@pytest.mark.parametrize(("limit", "ranges"), [(45, ["2-3", "4-4"]), (30, ["2-2", "3-3", "4-4"]), (1000, ["2-4"])])
def test_row_buckets(spark, limit, ranges):
    rows = spark.createDataFrame([("North", "1"), ("South", "2"), ("East", "3")], "a string, b string")
    lines = [r.v for r in rows.select(chunking.row_text(["Region", ""], F.array("a", "b")).alias("v")).collect()]
    assert lines[0] == "Region: North | Col2: 1"
    sizes = spark.createDataFrame([("s", k, len("Region: North | Q1: 1") - d) for k, d in enumerate((0, 0, 1))] + [("t", 0, 5), (None, 1, 7)], "sheet string, k int, n int")
    placed = chunking.row_buckets(sizes, ["sheet"], ["k"], "n", limit).groupBy("sheet", "bucket").agg(F.min("row").alias("a"), F.max("row").alias("b"))
    assert [f"{r.a}-{r.b}" for r in placed.where("sheet = 's'").orderBy("bucket").collect()] == ranges
    assert [(r.a, r.b) for r in placed.where("sheet = 't' or sheet is null").collect()] == [(2, 2), (2, 2)]


def test_keywords(spark):
    df = spark.createDataFrame([(1, "Revenue revenue growth the with data")], "id long, text string")
    assert {r.word: r.weight for r in topics.keyword_weights(df, "id").collect()} == {"revenue": 0.5, "growth": 0.25, "data": 0.25}


def test_distributions(spark):
    p, q = (F.create_map(*[F.lit(x) for pair in m.items() for x in pair]) for m in ({"a": 0.5, "b": 0.5}, {"a": 0.5, "c": 0.5}))
    assert one(spark, vectors.bhattacharyya(p, q)) == pytest.approx(0.5)
    back = one(spark, vectors.unmerged(vectors.merged(p, q, F.lit(3)), q, F.lit(4)))
    assert back == pytest.approx({"a": 0.5, "b": 0.5})
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(spark, vectors.with_member(v(1, 2), F.lit(2), v(4, 5))) == [2.0, 3.0]
    assert one(spark, vectors.without_member(v(2, 3), F.lit(3), v(4, 5))) == [1.0, 2.0]
    assert one(spark, vectors.without_member(v(2, 3), F.lit(3), F.lit(None).cast("array<double>"))) == [2.0, 3.0]
    assert one(spark, vectors.cosine(v(0, 0), v(1, 2))) == 0.0


def test_online_topics_equal_a_plain_loop(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(k % 2, k, (rng.normal(size=8) + 4 * np.eye(8)[k % 3]).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "p long, id long, v array<double>").repartition(3)
    expected = {}
    for p in (0, 1):
        names, means, counts = [], [], []
        for _, k, v in (r for r in rows if r[0] == p):
            x = np.array(v)
            scores = [float(m @ x / np.linalg.norm(m) / np.linalg.norm(x)) for m in means]
            best = max(range(len(scores)), key=lambda i: (scores[i], counts[i], -i), default=None)
            if best is not None and scores[best] >= 0.6:
                means[best] = (means[best] * counts[best] + x) / (counts[best] + 1)
                counts[best] += 1
                expected[k] = names[best]
            else:
                names.append(k), means.append(x), counts.append(1)
                expected[k] = k
    assert {r.id: r.topic for r in topics.online(df, "p", "id", "v").collect()} == expected


def test_bm25_repeated_terms_and_no_matches(spark):
    docs = spark.createDataFrame([(1, "apple apple pear"), (2, "pear plum"), (3, None)], "doc_id long, text string")
    ask = spark.createDataFrame([(1, "apple"), (2, "apple apple"), (3, "zebra")], "query int, question string")
    out = {(r["query"], r.doc_id): r.score for r in lexical.bm25(docs, ask, "doc_id", "query").collect()}
    assert set(out) == {(1, 1), (2, 1)} and out[2, 1] == pytest.approx(2 * out[1, 1])


def test_search_in_blocks(spark):
    rows = [(k, [float(k % 7), float(k % 5), 1.0]) for k in range(50)] + [(99, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    ask = df.where("id % 10 = 0")
    small = search.cosine_topk(df, ask, "id", "v", k=3, block=2).collect()
    assert sorted(small) == sorted(search.cosine_topk(df, ask, "id", "v", k=3).collect()) and len(small) == 15
    assert all(r.score == pytest.approx(1.0) for r in small if r["rank"] == 1)


def test_text_rules(spark):
    assert one(spark, text.sanitised(F.lit("a\\q\\n\x01�b"))) == "aq\\nb"
    assert one(spark, text.folded(F.lit("Éà  Straße-1.x_y"))) == "ea stra e-1.x y"
    assert one(spark, text.slug(F.lit("--A b!--"))) == "a-b" and one(spark, text.slug(F.lit("??"))) == "chart"
    assert [one(spark, text.human_size(F.lit(n))) for n in (0, 1023, 1536, 1 << 20, 5 << 30)] == ["0 Bytes", "1023 Bytes", "1.5 KB", "1 MB", "5 GB"]
    now = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    at = lambda hours: F.lit(str(datetime.datetime(2024, 1, 10, 12) - datetime.timedelta(hours=hours))).cast("timestamp_ntz")
    assert [one(spark, text.relative_day(at(h), now)) for h in (23, 25, 144, 168)] == ["Today", "Yesterday", "6 days ago", "Jan 3, 2024"]
    assert one(spark, text.page_count(F.repeat(F.lit("w "), 400))) == 1 and one(spark, text.page_count(F.repeat(F.lit("w "), 401))) == 2
    assert [one(spark, text.finite(F.lit(x))) for x in ("", " 7 ", "0x10", "true", "x", "1e400", None)] == [0.0, 7.0, 16.0, 1.0, None, None, None]
    assert one(spark, text.preview(F.lit("# A\n- b\n1. **c**"))) == "A b c"
    assert one(spark, text.full_fold(F.lit("ﬁÉ"))) == "fie"
    assert one(spark, text.search_folded(F.lit("Oﬃce Ｎｏ．１２ Ñandú Ⅳ"))) == "office no.12 nandu iv" and one(spark, text.search_folded(F.lit("Plain É"))) == "plain e"
    assert one(spark, text.search_folded(F.lit(None).cast("string"))) is None


def test_charts(spark):
    specs = [
        '{"chart":{"type":"bar","title":" T ","categories":["A","B"," "],"series":[{"name":"s","data":[1,"x"]},{"name":"","data":["y"]}]}}',
        '{"chart":{"type":"scatter","series":[{"data":[{"x":1,"y":2},{"x":"a","y":3},{"x":null,"y":4}]}]}}',
        '{"chart":{"type":"radar"}}', "nonsense", '{"chart":null}', None, '{"chart":{"type":"pie","categories":[],"series":[{"data":[1]}]}}',
    ]
    df = spark.createDataFrame([(k, s, "q") for k, s in enumerate(specs)], "id int, spec string, question string")
    out = {r.id: r for r in charts.validated(df, "spec", "question").collect()}
    assert out[0].title == "T" and out[0].categories == ["A", "B", "—"] and [(s.name, s.data) for s in out[0].series] == [("s", [1.0, None, None])]
    assert out[1].kind == "scatter" and [(p.x, p.y) for p in out[1].scatter[0].points] == [(1.0, 2.0), (0.0, 4.0)]
    assert [out[k].kind for k in range(2, 7)] == [None] * 5


def test_rules(spark):
    past, future, now = (F.lit(x) for x in (1, 9, 5))
    none = F.lit(None).cast("int")
    active = [one(spark, rules.subscription_active(F.lit(s), F.lit(c), e, now)) for s, c, e in (("active", True, past), ("active", True, future), ("active", True, none), ("past_due", False, future), (None, False, future))]
    assert active == [False, True, True, False, False]
    assert [one(spark, rules.over_quota(F.lit(1073741823), F.lit(n), F.lit(1 << 30))) for n in (1, 2)] == [False, True]
    assert tuple(one(spark, rules.retry(F.lit("embed")))) == ("embed", "chunked") and tuple(one(spark, rules.retry(F.lit(None).cast("string")))) == ("chunk", "queued")


def test_mutations(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    assert sorted(tuple(r) for r in mutations.upsert(now, new, ["k"]).collect()) == [(1, "a"), (2, None), (3, "c")]
    changes = spark.createDataFrame([(1, 1, "x", 5), (1, 2, None, 6), (1, 3, "z", None)], "k long, t long, s string, v long")
    assert tuple(mutations.latest(changes, ["k"], ["t"], {"s": "s", "v": "v"}).first()) == (1, "z", 6)


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", width, height) + b"\0" * 16


def test_files(spark, tmp_path):
    document = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>you</w:t></w:r></w:p><w:p/></w:body></w:document>'
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", document)
        for n, size in (("image10.png", (200, 150)), ("image2.png", (99, 300)), ("image3.png", (120, 130)), ("image4.png", (120, 130)), ("chart1.emf", (500, 500))):
            z.writestr(f"word/media/{n}", png(*size))
    (tmp_path / "a.docx").write_bytes(word.getvalue())
    (tmp_path / "b.TXT").write_text("plain é")
    (tmp_path / "c.pdf").write_bytes(b"%PDF broken")
    (tmp_path / "d.csv").write_text("Name,Name,\nx,1,2\n,,\ny,3,\n")
    found = files.read_files(spark, str(tmp_path))
    texts = {r.filename: (r.content_text, r.needs_ocr) for r in files.with_text(found).collect()}
    assert texts["a.docx"] == ("Hello\tyou\n\n\n\n", False) and texts["b.TXT"] == ("plain é", False) and texts["c.pdf"] == ("", True)
    assert [(r.figure, r.width, r.height) for r in files.figures(found).orderBy("figure").collect()] == [(1, 120, 130), (2, 200, 150)]
    rows = files.sheets(found)
    assert [(r.row, r["values"]) for r in rows.orderBy("row").collect()] == [(1, ["Name", "Name", ""]), (2, ["x", "1", "2"]), (3, ["y", "3", ""])]
    assert {r.total_rows for r in files.sheet_preview(rows, 1).collect()} == {2} and files.sheet_preview(rows, 1).count() == 1
    assert {r.row: r.record for r in files.sheet_preview(rows).collect()} == {2: {"Name": "1", "": "2"}, 3: {"Name": "3", "": ""}}
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x20\x00\x40" + b"x" * 9000 + b"\xff\xd9"
    assert files.carved_jpegs(b"__" + jpeg + b"\xff\xd8\xffsmall\xff\xd9") == [jpeg] and files.image_size(jpeg) == (64, 32)


def workbook():
    """Two sheets and one of a header alone: shared, inline, logical and skipped cells, a blank row."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = lambda rows: f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sales" sheetId="1" r:id="rId2"/><sheet name="Bare" sheetId="2" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet2.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Region</t></si><si><r><t>No</t></r><r><t>rth</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Open</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>12.5</v></c><c r="C2" t="b"><v>1</v></c></row><row r="3"><c r="A3"/></row><row r="5"><c r="B5"><v>7</v></c></row>'))
        z.writestr("xl/worksheets/sheet2.xml", sheet('<row r="1"><c r="A1" t="inlineStr"><is><t> Only </t></is></c></row>'))
    return out.getvalue()


def test_workbooks_and_damaged_files(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    (tmp_path / "b.xlsx").write_bytes(b"PK broken")
    (tmp_path / "c.txt").write_bytes("caf\xe9 au lait".encode("latin-1"))
    (tmp_path / "d.csv").write_bytes(b"a\xff,b\n1,2\n")
    found = files.read_files(spark, str(tmp_path))
    texts = {r.filename: r.content_text for r in files.with_text(found).collect()}
    assert texts["c.txt"] == "caf\ufffd au lait" and texts["b.xlsx"] == "" and texts["d.csv"] == "## Sheet: Sheet1\nColumns: a\ufffd, b\n\na\ufffd: 1 | b: 2"
    assert texts["a.xlsx"] == "## Sheet: Sales\nColumns: Region, , Open\n\nRegion: North | Col2: 12.5 | Open: TRUE\nRegion:  | Col2: 7 | Open: \n\n## Sheet: Bare\nColumns: Only"
    sheets = files.sheets(found)
    chunks = {(r.path.rpartition("/")[2], r.place, r.chunk): (r.row_range, r.text) for r in chunking.sheet_chunks(sheets, 40).collect()}
    head = "Workbook: a.xlsx\nSheet: Sales\nColumns: Region, , Open\n\nRows "
    assert chunks["a.xlsx", 0, 0] == ("2-2", head + "2-2\n\nRegion: North | Col2: 12.5 | Open: TRUE") and chunks["a.xlsx", 0, 1] == ("3-3", head + "3-3\n\nRegion:  | Col2: 7 | Open: ")
    assert chunks["a.xlsx", 1, 0] == (None, "Workbook: a.xlsx\nSheet: Bare\nColumns: Only\n\n(No data rows)") and len(chunks) == 4


def test_pdf_images_come_in_page_order():
    jpeg = lambda n: b"\xff\xd8\xff\xe0\x00\x04ab" + bytes([n]) * 9000 + b"\xff\xd9"
    image = lambda k, n: b"%d 0 obj << /Type /XObject /Subtype /Image /Filter /DCTDecode >> stream\n" % k + jpeg(n) + b"\nendstream endobj\n"
    page = lambda k, names: b"%d 0 obj << /Type /Page /Resources << /XObject << %b >> >> >> endobj\n" % (k, names)
    data = b"%PDF-1.4\n" + image(9, 1) + image(8, 2) + image(7, 3) + page(1, b"/B 7 0 R /A 8 0 R") + b"2 0 obj << /Type /Pages >> endobj\n" + page(3, b"/C 9 0 R /B 7 0 R")
    assert files.pdf_images(data) == [(1, jpeg(3)), (1, jpeg(2)), (2, jpeg(1)), (2, jpeg(3))]
    assert files.pdf_images(b"%PDF" + jpeg(5)) == [(1, jpeg(5))]


def test_bm25_with_bounds_equals_scoring_all(spark):
    """Random texts with common and rare words, copies (ties), more of the k than there are chunks, and questions that nothing answers."""
    import math
    import random
    from collections import Counter

    rng = random.Random(6)
    word = lambda: f"word{min(int(rng.paretovariate(0.5)), 400)}"
    texts = [" ".join(word() for _ in range(rng.choice((3, 30, 300)))) for _ in range(700)] + ["word1 word2 word399"] * 30 + ["", None, "?!"]
    asks = [" ".join(word() for _ in range(n)) for n in (1, 4, 12, 40)] + ["word1", "nothing here", "", "word399 word399 word1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    ask = spark.createDataFrame(list(enumerate(asks)), "query long, question string")
    cut = [[w for w in (t or "").split(" ") if len(w) > 3] for t in texts]
    mean = sum(map(len, cut)) / len(cut)
    for k in (3, 50):
        found = {}
        for r in lexical.bm25(docs, ask, "doc_id", "query", k).collect():
            found.setdefault(r["query"], []).append((r["rank"], r.doc_id, round(r.score, 6)))
        for q, a in enumerate(asks):
            due = []
            for i, c in enumerate(cut):
                tf = Counter(c)
                s = sum(math.log((len(cut) - df + 0.5) / (df + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(c) / mean)) for w in a.split() if tf[w] for df in [sum(w in x for x in cut)])
                if s:
                    due.append((-round(s, 9), i))
            assert sorted(found.get(q, [])) == [(n + 1, i, round(-s, 6)) for n, (s, i) in enumerate(sorted(due)[:k])]
    postings = lexical.Postings(docs, ask, "doc_id", "query")
    sharing = postings.asked.join(postings.rows, "token").select("query", "doc_id").distinct().count()
    assert lexical.candidates(postings, 3).count() < sharing / 3


def test_pairs_are_counted_where_they_arise(spark, monkeypatch):
    """Copies (ties), a text that nothing asks for, and fewer texts than are asked for; a floor that is too high is seen as a loss."""
    texts = ["apple pear plum"] * 20 + ["apple pear", "plum", "cherry tree", "zebra", "", None]
    asks = ["apple plum plum", "cherry", "nothing", "zebra tree"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ask = spark.createDataFrame(list(enumerate(asks)), "query long, question string")
    postings = lexical.Postings(docs, ask, "doc_id", "query")
    assert {r["query"]: (r.sharing, r.lost) for r in lexical.pairs_lost(postings, 3).collect()} == {0: (22, 0), 1: (1, 0), 3: (2, 0)}
    plan = postings.sums(postings.asked)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(doc_id") == 1
    plain = lexical.limits
    monkeypatch.setattr(lexical, "limits", lambda *a: plain(*a).withColumn("floor", F.when(F.col("query") == 0, 1e9).otherwise(F.col("floor"))))
    assert {r["query"]: r.lost for r in lexical.pairs_lost(postings, 3).collect()} == {0: 3, 1: 0, 3: 0}


@pytest.mark.parametrize("most", [lexical.NAMES, 0])
def test_names_are_found_wherever_they_stand(spark, most):
    import random

    rng = random.Random(2)
    names = ["a.pdf", "A.pdf", "Q3 report, (v2).PDF", "b.txt", "Makefile", "deck.pptx", "a", "é", "aaaa", "aaaaaaaa", "", None, "a.pdf", "(.*)", "x" * 500, "Makefile.old"]
    names += ["".join(rng.choice("abé.") for _ in range(rng.randrange(1, 12))) for _ in range(120)]
    texts = ["See a.pdf, and a.pdf.", "in the Q3 report, (v2).PDF!", "no name .pdf", None, "", "xb.txt", "the Makefile.old of deck.pptx(.*)", "x" * 700, "a" * 30] + ["".join(rng.choice("abé. ") for _ in range(60)) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, answer string").withColumn("stretch", F.lit("clash"))
    files_ = spark.createDataFrame([(n,) for n in names], "filename string")
    found = [tuple(r) for r in lexical.with_names(rows, "answer", files_, "filename", most).select("id", "filename").collect()]
    assert sorted(found) == sorted((i, n) for i, t in enumerate(texts) for n in {n for n in names if n} if t and n in t)
    assert lexical.with_names(rows.limit(0), "answer", files_, "filename", most).collect() == [] == lexical.with_names(rows, "answer", files_.limit(0), "filename", most).collect()


@pytest.mark.parametrize("most", [lexical.NAMES, 0])
def test_names_in_a_very_long_text_take_linear_time(spark, most):
    import time

    rows = spark.createDataFrame([(1, "lorem ipsum " * 80_000 + "Makefile")], "id long, answer string")
    names = spark.createDataFrame([("Makefile",), ("lorem",), ("dolor",)], "filename string")
    start = time.perf_counter()
    assert sorted(r.filename for r in lexical.with_names(rows, "answer", names, "filename", most).collect()) == ["Makefile", "lorem"]
    assert time.perf_counter() - start < 20


def test_names_sort_by_language(spark):
    """The order of a collation: accents and capitals do not part words of equal letters."""
    from tessella.plans.relations import book

    rows = book.queries["sorted_by_locale"](spark, "/root/testdata/sf0.001").collect()
    key = lambda r: [str(v).casefold() for v in r if isinstance(v, str)]
    assert rows and [key(r) for r in rows] == sorted(key(r) for r in rows)
    words = spark.createDataFrame([("zebra",), ("\u00c9clair",), ("eclair",), ("apple",), ("Zoo",)], "w string")
    assert [r.w for r in words.orderBy(F.collate("w", "fr"), "w").collect()][0] == "apple" and [r.w for r in words.orderBy(F.collate("w", "fr")).collect()][-1] == "Zoo"


def test_online_topics_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.randrange(3), k, [rng.gauss(0, 1) for _ in range(3)]) for k in range(150)]
    found = {r.id: (r.topic, r.confidence) for r in topics.online(spark.createDataFrame(rows, "project long, id long, v array<double>"), "project", "id", "v", 0.6).collect()}
    now = {}
    for project, k, v in rows:
        best = None
        for name, members in now.setdefault(project, {}).items():
            mean = [sum(x) / len(members) for x in zip(*members, strict=True)]
            dot, a, b = sum(x * y for x, y in zip(mean, v, strict=True)), sum(x * x for x in mean) ** 0.5, sum(x * x for x in v) ** 0.5
            if best is None or (dot / (a * b), len(members)) > best[:2]:
                best = (dot / (a * b), len(members), name)
        name, sure = (best[2], best[0]) if best and best[0] >= 0.6 else (k, 0.0)
        now[project].setdefault(name, []).append(v)
        assert found[k] == (name, pytest.approx(sure))
