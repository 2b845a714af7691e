"""Trees of document files: written, read again, brought up to date; failures leave what was there."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliospark.sources import document_files, trees


def tree(root):
    return {str(p.relative_to(root)): p.read_text() for p in Path(root).rglob("*") if p.is_file() and not p.name.endswith(".crc")}


DOCS = {"a/guide.md": "one\n", "a/b/ü & x.md": "zwei\n", "c/100%+.md": "", "top.md": "x" * 100_000}


def frame(spark, docs, parts=3):
    return spark.createDataFrame(list(docs.items()), "path string, document string").repartition(parts)


def test_a_tree_is_what_the_rows_say(spark, tmp_path):
    root = str(tmp_path / "docs")
    document_files.write_document_files(frame(spark, DOCS), root)
    assert tree(root) == DOCS
    read = {r["source_path"]: r["raw"] for r in trees.read_content_tree(spark, root).collect()}
    assert read == {k: v for k, v in DOCS.items() if v}  # Spark's readers pass over empty files
    changed = {"a/guide.md": "two\n", "new/one.md": "1", "top.md": DOCS["top.md"]}
    document_files.write_document_files(frame(spark, changed).withColumn("path", F.concat(F.lit("/"), "path")), f"file://{root}")
    assert tree(root) == changed


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "docs")
    document_files.write_document_files(frame(spark, DOCS), root)
    many = spark.range(50).select(F.concat(F.lit("n/"), "id").alias("path"), F.when(F.col("id") == 37, F.raise_error(F.lit("lost"))).otherwise("x").alias("document"))
    with pytest.raises(Exception, match="lost"):
        document_files.write_document_files(many.repartition(4), root)
    assert tree(root) == DOCS and not list(Path(root).glob(".new-*"))
    for bad in ("../out.md", "a/../../out.md", ""):
        with pytest.raises(Exception, match="not a path"):
            document_files.write_document_files(frame(spark, {bad: "x"}), root)
    with pytest.raises(ValueError, match="two documents"):
        document_files.write_document_files(spark.createDataFrame([("a", "1"), ("/a", "2")], "path string, document string"), root)
    assert tree(root) == DOCS and not (tmp_path / "out.md").exists()


def test_publishing_that_broke_off_is_finished(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "docs")
    monkeypatch.setattr(document_files, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        document_files.write_document_files(frame(spark, DOCS), root)
    monkeypatch.undo()
    (hidden,) = Path(root).glob(".new-*")
    assert {k for k in tree(root) if not k.startswith(".new-")} == set()
    document_files.publish(spark, root, hidden.name.removeprefix(".new-"))
    assert tree(root) == DOCS


def test_a_tree_is_listed_by_tasks(spark, tmp_path):
    """The driver holds no file's name; what is hidden, empty or of another kind is passed over as Spark's readers do."""
    root = tmp_path / "docs"
    names = ("p/a.md", "p/deep/er/b.txt", "p=1/c.JSON", "p/_x=1/d.md", "top.md", "p/no.bin", "p/_hidden.md", "p/.dot.md", "_q/e.md", ".r/f.md", "p/empty.md")
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("" if "empty" in name else name)
    (root / "none").mkdir()
    got = trees.read_content_tree(spark, str(root))
    assert got._jdf.queryExecution().analyzed().collectLeaves().size() == 1 and got.inputFiles() == []
    assert {r["source_path"]: r["raw"] for r in got.collect()} == {n: n for n in names[:5]}
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,txt,JSON}").load(str(root)).where("length > 0").count()
    assert seen == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        trees.read_content_tree(spark, str(tmp_path / "absent"))
