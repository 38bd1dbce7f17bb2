"""Text files written by tasks and read back whole."""

import os
import tempfile

from tidewater.sources import tables as st


def test_a_file_per_text_read_back_whole(spark):
    texts = ["a", "two\nlines\r\n", "ends with a nul\x00", "\x00\x00", "황백화", "a"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "text STRING").repartition(3)
    for lead in ("", "file:", "file://"):
        path = tempfile.mkdtemp(prefix="texts-")
        folders = st.write_text_files(rows, "text", lead + path)
        # Lost attempts leave folders that are in no list
        os.makedirs(f"{path}/lost")
        with open(f"{path}/lost/0.txt", "w") as f:
            f.write("lost\x00")
        back = st.read_text_files(spark, folders).selectExpr("left(text, length(text) - 1) AS text")
        assert sorted(r[0] for r in back.collect()) == sorted(texts)
        assert sum(len(files) for _, _, files in os.walk(path)) == len(texts) + 1
    assert st.write_text_files(rows.limit(0), "text", path) == []


def test_folders_are_bounded_and_read_by_tasks(spark, monkeypatch):
    """Tasks list the files, not the driver; paths and bytes are those that Spark's reader gives."""
    monkeypatch.setattr(st, "FOLDER_FILES", 3, raising=False)
    monkeypatch.setattr(st, "FOLDER_BYTES", 1000, raising=False)
    monkeypatch.setattr(st, "BATCH_BYTES", 20, raising=False)
    rows = spark.range(20, numPartitions=2).selectExpr(
        "CASE id WHEN 3 THEN '' WHEN 5 THEN repeat('황', 700) WHEN 7 THEN CAST(X'61FF62' AS STRING) ELSE concat('text ', id, '\\r\\n') END AS text"
    )
    wanted = sorted(bytes(r[0]) for r in rows.selectExpr("CAST(text AS BINARY)").collect())
    for end in ("\x00", ""):
        folders = st.write_text_files(rows, "text", tempfile.mkdtemp(prefix="texts of 황+@(1)%20#^"), end)
        sizes = [len(os.listdir(f.removeprefix("file://"))) for f in folders]
        assert max(sizes) == 3 and sum(sizes) == 20
        back = st.read_text_files(spark, folders)
        assert back.inputFiles() == []
        got = [(r[0], bytes(r[1])) for r in back.selectExpr("path", "CAST(text AS BINARY)").collect()]
        assert sorted(t for _, t in got) == sorted(t + end.encode() for t in wanted if t or end)
        plain = st.read_text_files(spark, list(folders)).selectExpr("path", "CAST(text AS BINARY)")
        assert sorted(got) == sorted((r[0], bytes(r[1])) for r in plain.collect())
    assert st.read_text_files(spark, st.write_text_files(rows.limit(0), "text", tempfile.mkdtemp())).count() == 0
