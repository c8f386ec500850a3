import os

from chatlake.operators import analytics as N
from chatlake.operators import ingest as I
from chatlake.sources import files, sinks
from chatlake.streaming import jobs as J

BODY = "Some words about a subject that matter to readers of this file number "


def write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text.encode() if isinstance(text, str) else text)


def report(frame):
    return {r.status: r.documents for r in frame.collect()}


def test_refresh_skips_replaces_and_purges(spark, tmp_path):
    folder = str(tmp_path / "docs")
    for i in range(3):
        write(folder, f"f{i}.md", BODY + str(i))
    write(folder, "sub/g.txt", "bad byte \xff".encode("latin-1") + (" " + BODY).encode())
    write(folder, "empty.txt", "\n")
    write(folder, "skip.pdf", "x")
    empty = I.chunks(files.text_files(spark, folder).limit(0).withColumnRenamed("path", "source_path"))
    index, outcome = I.refresh(empty, files.text_files(spark, folder), f"file:{folder}")
    assert report(outcome) == {"indexed": 4, "empty": 1}
    first = I.write_version(index, str(tmp_path / "index"), "v1", buckets=2)
    index = spark.read.parquet(first)
    assert index.where("doc_name = 'g.txt'").first().content.startswith("bad byte")

    write(folder, "f1.md", BODY + "changed")
    os.remove(os.path.join(folder, "f2.md"))
    again, outcome = I.refresh(index, files.text_files(spark, folder), f"file:{folder}")
    assert report(outcome) == {"indexed": 1, "skipped": 2, "empty": 1, "purged": 1}
    assert sorted(r.doc_name for r in again.select("doc_name").distinct().collect()) == ["f0.md", "f1.md", "g.txt"]
    assert "changed" in again.where("doc_name = 'f1.md'").first().content
    _, forced = I.refresh(index, files.text_files(spark, folder), f"file:{folder}", force=True)
    assert report(forced) == {"indexed": 3, "empty": 1}


def test_stream_builds_versions(spark, tmp_path):
    folder, index = str(tmp_path / "in"), str(tmp_path / "index")
    handle = J.ingest_batches(index, folder, size=1100, overlap=120)
    stream = lambda: files.text_file_stream(spark, folder)
    check = str(tmp_path / "check")

    def run():
        q = stream().writeStream.foreachBatch(handle).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()

    write(folder, "a.md", BODY + "a")
    write(folder, "b.md", BODY + "b")
    run()
    write(folder, "later/b.md", BODY + "new")
    run()
    newest = spark.read.parquet(f"{index}/version=1")
    assert {r.doc_name: r.content[-3:] for r in newest.collect()} == {"a.md": "r a", "b.md": "new"}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "ไทย", "2024-01-01"), (2, "b", "2024-01-03")], "id INT, text STRING, ts STRING")
    sinks.export_json(df, str(tmp_path / "j"), kind="demo")
    head = spark.read.json(str(tmp_path / "j" / "manifest")).first()
    assert (head.total, head.first_ts, head.kind) == (2, "2024-01-01", "demo")
    assert "ไทย" in "".join(r.value for r in spark.read.text(str(tmp_path / "j" / "data")).collect())
    sinks.export_csv(df.coalesce(1), str(tmp_path / "c"), bom=True)
    part = next(p for p in (tmp_path / "c").iterdir() if p.suffix == ".csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfid,text,ts")


def test_latest_form_of_two_codes(spark):
    rows = [("1", "u", "2024-01-01", "verified", '{"ai_summary":"old"}'), ("2", "u", "2024-01-02", "verified", '{"ai_summary":"new"}'), ("3", "u", "2024-01-03", "pending", "{}")]
    df = spark.createDataFrame(rows, "code STRING, user_id STRING, verified_at STRING, status STRING, form_data STRING")
    assert N.latest_form(df).first().ai_summary == "new"
