import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.sources import crops, docx, readers, writers
from lectern.streaming import running


def test_line_csv(spark, tmp_path):
    p = tmp_path / "val.csv"
    p.write_text('image_path,transcription\nC:\\x\\output3\\5\\line_001.png,"a ""b"", c"\nC:\\x\\output3\\6\\line_012.png,d\te\n', encoding="utf-8")
    rows = readers.line_csv(spark, str(p)).collect()
    assert [(r.page_id, r.line_no, r.transcription) for r in rows] == [(5, 1, 'a "b", c'), (6, 12, "d\te")]
    out = readers.line_csv(spark, str(p)).select(readers.remapped(F.col("image_path")).alias("x")).first().x
    assert out == "output3/5/line_001.png"


def test_line_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a/5/line_001.png", 'x "y", \\z'), ("a/5/line_002.png", "ñ\tç")], readers.LINE)
    writers.line_csv(df, str(tmp_path / "out"))
    assert {(r.image_path, r.transcription) for r in readers.line_csv(spark, str(tmp_path / "out")).collect()} == {tuple(r) for r in df.collect()}


def test_page_texts(spark, tmp_path):
    for page, raw in ((1, "uno\n\ndos\n \n".encode()), (2, "año\n".encode("latin-1"))):
        (tmp_path / str(page)).mkdir()
        (tmp_path / str(page) / "transcription.txt").write_bytes(raw)
    rows = readers.page_texts(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.gt_idx, r.gt) for r in rows) == [(1, 0, "uno"), (1, 1, ""), (1, 2, "dos"), (2, 0, "año")]


def test_broken_bytes(spark, tmp_path):
    (tmp_path / "3").mkdir()
    (tmp_path / "3" / "a.txt").write_bytes(b"a\xffb")
    assert readers.page_texts(spark, str(tmp_path), errors="replace").first().gt == "a\ufffdb"
    assert readers.page_texts(spark, str(tmp_path)).first().gt == "a\u00ffb"
    with pytest.raises(Exception, match="not UTF-8"):
        readers.page_texts(spark, str(tmp_path), errors="strict").collect()


def test_paths_and_points(spark, tmp_path):
    files = spark.createDataFrame([("/d/10/a.png",), ("/d/9/b.png",), ("/d/9/c.png",), ("/d/x/c.png",), ("output3/1/a.png",)], "path string")
    assert [(r.page_id, r.files) for r in readers.page_folders(files).collect()] == [(1, 1), (9, 2), (10, 1)]
    rows = spark.createDataFrame([("/d/9/b.png",), ("C:\\x\\output3\\1\\a.png",), ("x/myoutput/z/q.png",), ("y/output3/none.png",)], "image_path string")
    assert [r.image_path for r in readers.resolved(rows, files).orderBy(F.desc("image_path")).collect()] == ["y/output3/none.png", "x/myoutput/z/q.png", "output3/1/a.png", "/d/9/b.png"]
    (tmp_path / "m.json").write_text('{"metrics": {"final": {"CER": 0.5}}}')
    assert readers.json_value(spark, str(tmp_path / "m.json"), "$.metrics.final.CER").first().value == "0.5"
    assert readers.json_value(spark, str(tmp_path / "m.json"), "$.metrics.other.CER").first().value == "N/A"
    (tmp_path / "w.txt").write_text("Año niño\n de Año", encoding="utf-8")
    assert {r.word for r in readers.vocabulary(spark, str(tmp_path / "w.txt")).collect()} == {"año", "niño", "de"}


def test_images(spark, tmp_path):
    for page, names in ((1, ["b.JPG", "source.tif", "a.png"]), (2, ["z.jpg", "c.png"])):
        (tmp_path / str(page)).mkdir()
        for n in names:
            (tmp_path / str(page) / n).write_bytes(b"x")
    found = readers.images(spark, str(tmp_path))
    assert {r.page_id: r["name"] for r in readers.page_image(found).collect()} == {1: "source.tif", 2: "c.png"}
    assert {r.page_id: r["name"] for r in readers.page_image(found, True).collect()} == {1: "a.png", 2: "c.png"}


def test_json_sources(spark, tmp_path):
    (tmp_path / "1").mkdir()
    (tmp_path / "1" / "mapping.json").write_text(json.dumps({"folder_id": "1", "lines": [{"line_index": 0, "crop_file": "a", "transcription": " x ", "matched": True}, {"line_index": 1, "crop_file": "b", "transcription": "", "matched": True}, {"line_index": 2, "crop_file": "c", "transcription": "y", "matched": False}]}))
    assert [(r.line_index, r.transcription) for r in readers.mapping_lines(spark, str(tmp_path)).collect()] == [(0, "x")]
    crops = lambda *c: spark.createDataFrame([("1", x) for x in c], "folder_id string, crop_file string")
    assert readers.mapping_lines(spark, str(tmp_path), crops("a", "z")).count() == 1 and readers.mapping_lines(spark, str(tmp_path), crops("b")).count() == 0
    (tmp_path / "p.json").write_text(json.dumps([{"ocr_output": "a", "ground_truth": "b"}]))
    assert readers.predictions(spark, str(tmp_path / "p.json")).first().rule_corrected == "a"
    (tmp_path / "t.json").write_text(json.dumps({"log_history": [{"step": 1, "loss": 2.0}, {"step": 2, "eval_loss": 1.0, "eval_cer": 0.1}, {"step": 3}]}))
    assert [(r.step, r.kind) for r in readers.trainer_log(spark, str(tmp_path / "t.json")).collect()] == [(1, "train"), (2, "eval")]


XML = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">{}</w:document>'


def test_paragraphs(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", XML.format('<w:p><w:r><w:t>uno &amp; </w:t><w:t xml:space="preserve">dos</w:t></w:r></w:p><w:p w:id="1"><w:r><w:t>tr&#233;s</w:t><w:tab/><w:t>x</w:t></w:r></w:p><w:p/>'))
    (tmp_path / "sub").mkdir()
    with zipfile.ZipFile(tmp_path / "sub" / "B.DOCX", "w") as z:
        z.writestr("word/document.xml", XML.format("<w:p><w:r><w:t>a</w:t><w:br/></w:r></w:p>" * 9000))
    rows = docx.paragraphs(spark, str(tmp_path / "a.docx")).collect()
    assert [(r.pos, r.text) for r in rows] == [(0, "uno & dos"), (1, "trés\tx"), (2, "")]
    assert docx.paragraphs(spark, str(tmp_path)).count() == 3
    both = docx.paragraphs(spark, str(tmp_path), recursive=True)
    assert sorted((r.path.rsplit("/", 1)[1], r.n, r.t) for r in both.groupBy("path").agg(F.count("*").alias("n"), F.max("text").alias("t")).collect()) == [("B.DOCX", 9000, "a\n"), ("a.docx", 3, "uno & dos")]
    one = spark.read.format("docx").schema("text string").load(str(tmp_path / "a.docx"))
    assert one.columns == ["text"] and {r.text for r in one.collect()} == {"uno & dos", "trés\tx", ""}


def test_other_word_files_are_refused_before_any_task_runs(spark, tmp_path):
    (tmp_path / "b.doc").write_bytes(b"x")
    for path in (tmp_path / "b.doc", tmp_path):
        with pytest.raises(Exception, match="only .docx"):
            docx.paragraphs(spark, str(path))
    (tmp_path / "none").mkdir()
    assert docx.paragraphs(spark, str(tmp_path / "none")).collect() == []
    with pytest.raises(Exception, match="missing"):
        docx.paragraphs(spark, str(tmp_path / "missing"))


def boxes(spark, rows):
    return spark.createDataFrame(rows, "folder string, name string, grey binary, width int, x1 int, y1 int, x2 int, y2 int, path string")


def test_crops_are_all_there_or_none(spark, tmp_path):
    page, to = bytes(range(60)), tmp_path / "out"
    good = [(str(i % 3), f"line_{i}.png", page, 10, 2, i % 4, 7, 6, "clash") for i in range(20)]
    crops.write(boxes(spark, good).repartition(4), str(to))
    back = {r.path.split("/out/")[1]: (r.height, r.width, bytes(r.grey)) for r in crops.read(spark, str(to)).collect()}
    grid = np.frombuffer(page, np.uint8).reshape(6, 10)
    assert back == {f"{f}/{n}": (6 - y, 5, grid[y:6, 2:7].tobytes()) for f, n, _, _, _, y, _, _, _ in good}
    assert {r.page_id for r in readers.images(spark, str(to)).collect()} == {0, 1, 2}
    before = sorted(p.relative_to(to) for p in to.rglob("*"))
    for wrong in [("9", "x.png", page, 10, 5, 0, 5, 3, ""), ("9", "x.png", page, 7, 0, 0, 2, 2, "")]:
        for mode in ("append", "overwrite"):
            with pytest.raises(Exception):  # noqa: B017
                crops.write(boxes(spark, [("8", f"{i}.png", *good[0][2:]) for i in range(8)] + [wrong]).repartition(4), str(to), mode)
            assert sorted(p.relative_to(to) for p in to.rglob("*")) == before
    crops.write(boxes(spark, [("5", "more.png", *good[0][2:])]), str(to), "append")
    assert crops.read(spark, str(to)).count() == 21
    crops.write(boxes(spark, []), str(to))
    assert list(to.rglob("*.png")) == []


def test_crops_are_read_many_a_task_and_moved_by_folder(spark, tmp_path):
    """Small files don't get a task each; folders in folders, of several tasks, already there, and none; other files are let be."""
    page, to = bytes(range(60)), tmp_path / "out"
    row = lambda folder, name: (folder, name, page, 10, 2, 1, 7, 6, "")
    rows = [row(f, f"{i}.png") for i, f in enumerate(["a", "a/b", "a/b/c", "d", ""] * 8)]
    crops.write(boxes(spark, rows).repartition(4), str(to))
    crops.write(boxes(spark, [row("d", "more.png"), row("e/f", "new.png")]).coalesce(1), str(to), "append")
    (to / "a" / "note.txt").write_text("x")
    back = crops.read(spark, str(to))
    want = sorted([*(f"{f}/{n}".lstrip("/") for f, n, *_ in rows), "d/more.png", "e/f/new.png"])
    assert sorted(r.path.split("/out/")[1] for r in back.collect()) == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        assert crops.read(spark, str(to)).rdd.getNumPartitions() <= 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert not [p for p in to.rglob("_staged*")]


def test_broken_images_are_refused():
    data = crops.png(np.arange(12, dtype=np.uint8).reshape(3, 4))
    assert (crops.pixels(data) == np.arange(12).reshape(3, 4)).all()
    for bad in (b"", data[8:], data[:40] + bytes([data[40] ^ 1]) + data[41:]):
        with pytest.raises(ValueError):
            crops.pixels(bad)


def test_documents(spark):
    df = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "page int, n int, x string")
    assert [tuple(x) for x in writers.page_documents(df, "page", "n", ["x"]).first().lines] == [(0, "a"), (1, "b")]
    m = spark.createDataFrame([("raw", 0.1, 0.2)], "stage string, CER double, WER double")
    assert writers.metrics_document(m).first().metrics["raw"].CER == 0.1
    meta = writers.text_meta(spark.createDataFrame([(1, "a b", "ok"), (1, "c", "ok"), (1, "", "no")], "p int, t string, s string"), "p", "t", "s").first()
    assert (meta.lines, meta.words, meta.statuses) == (3, 3, {"ok": 2, "no": 1})


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(([(1, "fe", "se")], [(1, "ab", "ab"), (2, "x", "yy")])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"page_id": p, "line_no": 0, "ocr_output": a, "ground_truth": b, "ts": "2024-01-01T00:01:00"}) for p, a, b in rows))
    got = {}
    q = running.start(running.running_rates(running.predictions(spark, str(tmp_path / "in"), 1)), lambda df, n: got.update({r.page_id: (r.edits, r.ref_len, r.lines) for r in df.collect()}), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert got == {1: (1, 4, 2), 2: (2, 2, 1)}


def test_json_arrays_and_files_of_pages(spark, tmp_path):
    """Arrays with nulls, quotes and no rows at all; files that are written twice."""
    from lectern.sources import package

    package.send(spark)
    rows = [("a", None, "g \"1\"\n", "p/0"), ("b", "r", "g2", "p/1"), (None, None, None, "p/2")] * 50
    df = spark.createDataFrame(rows, "ocr_output string, rule_corrected string, ground_truth string, image_path string").repartition(3)
    writers.json_array(df, f"file://{tmp_path}/arrays")
    got = readers.predictions(spark, f"file://{tmp_path}/arrays").select(*df.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((o, r if r is not None else o, g, i)) for o, r, g, i in rows)
    writers.json_array(df.where("false"), f"file://{tmp_path}/none")
    assert readers.predictions(spark, f"file://{tmp_path}/none").count() == 0
    files = spark.createDataFrame([(3, "t.txt", "x\ny\n\n"), (12, "t.txt", "é"), (12, "empty.txt", "")], "page int, name string, body string")
    for _ in range(2):
        assert writers.page_files(files, f"file://{tmp_path}/pages", "page", "name", "body") == 3
    assert sorted(map(tuple, readers.page_texts(spark, f"file://{tmp_path}/pages").select("page_id", "gt_idx", "gt").collect())) == [(3, 0, "x"), (3, 1, "y"), (12, 0, "é")]
    assert writers.page_files(files.where("false"), f"file://{tmp_path}/pages", "page", "name", "body") == 0
