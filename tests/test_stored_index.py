import os
import time

from chatlake.operators import stored_index as X

BODY = "Some words about a subject that matter to readers of this file number "


def write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def names(spark, path):
    return {r.doc_name: r.content[-3:] for r in X.read_index(spark, path).collect()}


def test_refresh_rewrites_only_what_changed(spark, tmp_path, monkeypatch):
    folder, path = str(tmp_path / "docs"), str(tmp_path / "index")
    for i in range(12):
        write(folder, f"f{i}.md", BODY + f"{i:03}")
    assert X.refresh(spark, path, folder) == {"indexed": 12, "purged": 0, "skipped": 0}
    assert names(spark, path) == {f"f{i}.md": f"{i:03}" for i in range(12)}

    opened = []
    real = X.read_listed
    monkeypatch.setattr(X, "read_listed", lambda s, f, wanted: opened.append(sorted(r.doc_name for r in wanted.collect())) or real(s, f, wanted))
    before = sorted(os.listdir(f"{path}/chunks"))
    assert X.refresh(spark, path, folder) == {"indexed": 0, "purged": 0, "skipped": 12}
    assert opened == [] and sorted(os.listdir(f"{path}/chunks")) == before and X.version(spark, path) == 0

    time.sleep(1.1)
    write(folder, "f3.md", BODY + "new")
    assert X.refresh(spark, path, folder) == {"indexed": 1, "purged": 0, "skipped": 11}
    assert opened == [["f3.md"]] and len([d for d in os.listdir(f"{path}/chunks/version=1") if d.startswith("bucket")]) == 1
    assert names(spark, path) == {f"f{i}.md": "new" if i == 3 else f"{i:03}" for i in range(12)}

    # A file of the same name further on decides; when it goes, the first one counts again; a vanished name leaves.
    write(folder, "sub/f5.md", BODY + "sub")
    os.remove(os.path.join(folder, "f7.md"))
    assert X.refresh(spark, path, folder) == {"indexed": 1, "purged": 1, "skipped": 10}
    assert names(spark, path)["f5.md"] == "sub" and "f7.md" not in names(spark, path)
    os.remove(os.path.join(folder, "sub/f5.md"))
    write(folder, "empty.txt", "\n")
    X.refresh(spark, path, folder)
    assert names(spark, path) == {f"f{i}.md": "new" if i == 3 else f"{i:03}" for i in range(12) if i != 7}
    assert {d for d in os.listdir(f"{path}/files") if d.startswith("version")} == {"version=2", "version=3"}
    for i in range(12):
        if os.path.exists(os.path.join(folder, f"f{i}.md")):
            os.remove(os.path.join(folder, f"f{i}.md"))
    assert X.refresh(spark, path, folder)["purged"] == 11 and X.read_index(spark, path) is None
