"""Uploads that cannot be read, puts, calls of a model, and moves between topics."""

import io
import zipfile

from pyspark.sql import functions as F

from tessella.functions import parse
from tessella.operators import models, topics
from tessella.session import scratch_path
from tessella.sources import files

COLUMNS = "path string, filename string, route string, content binary"


def archive(name, body, break_it=False, flags=0):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, body)
    data = bytearray(out.getvalue())
    if break_it:
        at = 30 + len(name)
        data[at : at + 6] = b"\xff" * 6
    if flags:
        for mark in (b"PK\x03\x04", b"PK\x01\x02"):
            at = data.find(mark)
            data[at + (6 if mark[2] == 3 else 8)] |= flags
    return bytes(data)


def uploads(spark):
    word = b'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>Fine words.</w:t></w:r></w:p></w:document>'
    rows = [
        ("1", "good.docx", "docx", archive("word/document.xml", word)), ("2", "deflate.docx", "docx", archive("word/document.xml", word * 9, break_it=True)), ("3", "locked.docx", "docx", archive("word/document.xml", word, flags=1)),
        ("4", "old.xls", "spreadsheet", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 600), ("5", "empty.xlsx", "spreadsheet", b""), ("6", "half.xlsx", "spreadsheet", b"PK\x03\x04half"), ("7", "a.csv", "spreadsheet", b"a,b\n1,2\n"), ("8", "other.xlsx", "spreadsheet", archive("word/document.xml", word)),
    ]
    return spark.createDataFrame(rows, COLUMNS)


def test_what_cannot_be_read_is_a_failure_and_no_error(spark):
    given = uploads(spark)
    failed = {r.path: r.last_error for r in files.failures(given).collect()}
    assert set(failed) == {"2", "3", "4", "5", "6", "8"} and "old binary" in failed["4"]
    texts = {r.path: r.content_text for r in files.with_text(given).collect()}
    assert texts["1"].strip() == "Fine words." and not any(texts[k] for k in failed)
    assert files.docx_media(archive("word/media/image1.png", b"x" * 900, break_it=True)) == []
    assert {r.path for r in files.sheets(given).collect()} == {"7"}


def test_puts_are_there_and_failures_are_told(spark):
    folder = scratch_path(spark, "puts")
    rows = spark.createDataFrame([(k, f"a/{k}.bin", b"x" * k if k % 3 else None) for k in range(20)], "id long, key string, data binary")
    done = {r.id: r.result for r in files.put_all(rows, "id", "key", "data", files.into_folder(folder)).collect()}
    assert done == {k: "put" if k % 3 else "skipped" for k in range(20)}
    there = {r.path.rpartition("/")[2]: r.length for r in spark.read.format("binaryFile").load(f"{folder}/a").collect()}
    assert there == {f"{k}.bin": k for k in range(20) if k % 3}


def counting(folder):
    """A model that leaves a file for every text it is sent."""

    def predict(texts):
        import pathlib
        import uuid

        if any("bad" in t for t in texts):
            raise RuntimeError("bad text")
        for t in texts:
            (pathlib.Path(folder) / f"{t[:3]}-{uuid.uuid4().hex}").touch()
        return [[float(len(t))] for t in texts]

    return predict


def test_each_text_is_sent_once_and_what_failed_again(spark, tmp_path):
    table = scratch_path(spark, "results")
    rows = spark.createDataFrame([(1, "one"), (2, "two two"), (3, "one"), (4, None), (5, " "), (6, "bad"), (7, "x" * 9000), (8, "x" * 8500)], "id long, text string").withColumn("digest", F.lit("clash"))
    for _ in range(2):
        out = {r.id: r for r in models.with_results(rows, "text", counting(str(tmp_path)), table).collect()}
        assert {k: r.result and r.result[0] for k, r in out.items()} == {1: 3.0, 2: 7.0, 3: 3.0, 4: None, 5: None, 6: None, 7: 8000.0, 8: 8000.0}
        assert {k for k, r in out.items() if r.error} == {6} and out[6].error == "RuntimeError: bad text"
    assert sorted(f.name[:3] for f in tmp_path.iterdir()) == ["one", "two", "xxx"]
    fixed = models.with_results(rows.where("id = 6"), "text", lambda texts: [[1.0] for _ in texts], table).first()
    assert fixed.result == [1.0] and fixed.error is None


def test_moves_equal_means_of_the_members_after(spark):
    members = [(k, k % 4 if k < 40 else k, [float(k), float(k * k % 7)]) for k in range(43)]
    table = spark.createDataFrame(members, "id long, topic long, v array<double>")
    went = {k: (t, (t + 1) % 4 if k < 40 else 2) for k, t, _ in members if k % 5 == 0 or k >= 41}
    moves = table.where(F.col("id").isin(list(went))).select("id", F.col("topic").alias("source"), F.when(F.col("id") < 40, (F.col("topic") + 1) % 4).otherwise(2).alias("target"), "v")
    found = {r.topic: (r.n, [round(x, 9) for x in r.centroid]) for r in topics.moved(topics.centroids(table, "topic", "v"), moves).collect()}
    due = {}
    for k, t, v in members:
        due.setdefault(went[k][1] if k in went else t, []).append(v)
    assert found == {t: (len(vs), [round(sum(x) / len(vs), 9) for x in zip(*vs, strict=True)]) for t, vs in due.items()}


def test_prompt_data_is_the_cut_json(spark):
    rows = spark.createDataFrame([("a", k, "é" * (k % 30)) for k in range(3000)] + [("b", 1, None), ("c", 1, "x" * 50_000)], "g string, id long, p string")
    import json

    def whole(g):
        mine = [{"id": r.id, **({"p": r.p} if r.p is not None else {})} for r in sorted(rows.where(F.col("g") == g).collect(), key=lambda r: r.id)]
        return json.dumps(mine, separators=(",", ":"), ensure_ascii=False)[:40_000]

    out = {r.g: r.data for r in parse.prompt_data(rows, "g", "id", ["id", "p"]).collect()}
    assert out == {g: whole(g) for g in "abc"} and len(out["a"]) == 40_000
