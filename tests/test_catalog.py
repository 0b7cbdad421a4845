import pytest
from pyspark.sql import functions as F

from vellum.operators import catalog as C
from vellum.operators.ingest import ingest
from vellum.sources.files import parse
from vellum.sources.store import Conflict, Store


def ids(df, col="id"):
    return sorted(r[0] for r in df.select(col).collect())


def parsed(spark, rows):
    return spark.createDataFrame(rows, "id string, name string, mime string, size long, text string, pages array<string>, error string")


def two_libraries(spark):
    s = C.create_library(C.Snapshot.empty(spark), "lib-1", "  One ", 10, "first")
    s = C.create_library(s, "lib-2", "Two", 20)
    s = ingest(s, parsed(spark, [("d1", "a.txt", "", 5, "Alpha beta.", None, None), ("d2", "b.md", "", 5, "# H\nGamma", None, None), ("d3", "c.txt", "", 0, "  ", None, None)]), "lib-1", 30)
    return ingest(s, parsed(spark, [("d4", "p.pdf", "application/pdf", 9, "x", ["Page one.", "Page two."], None), ("d5", "q.pdf", "application/pdf", 9, None, None, "broken")]), "lib-2", 40)


def test_ingest_counts_and_errors(spark):
    s = two_libraries(spark)
    docs = {r.id: r for r in s.documents.collect()}
    assert {k: (d.status, d.chunk_count, d.error, d.type) for k, d in docs.items()} == {
        "d1": ("indexed", 1, None, "txt"), "d2": ("indexed", 1, None, "md"), "d3": ("error", 0, "No text could be extracted from document", "txt"),
        "d4": ("indexed", 1, None, "pdf"), "d5": ("error", 0, "broken", "pdf"),
    }
    libs = {r.id: (r.name, r.document_count, r.chunk_count) for r in s.libraries.collect()}
    assert libs == {"lib-1": ("One", 3, 2), "lib-2": ("Two", 2, 1)}
    chunk = C.where(s.chunks, document_id="d4").first()
    assert (chunk.page, chunk.text, len(chunk.embedding)) == (2, "Page one. Page two.", 384)
    again = ingest(s, parsed(spark, [("d1", "a.txt", "", 5, "Alpha beta.", None, None)]), "lib-1", 50)
    assert again.chunks.count() == 3 and again.documents.count() == 5


def test_order_and_update(spark):
    s = two_libraries(spark)
    assert [r.id for r in C.newest_first(s.libraries).collect()] == ["lib-2", "lib-1"]
    s = C.update_library(s, "lib-1", 99, description="new")
    row = C.get(s.libraries, "id", "lib-1").first()
    assert (row.name, row.description, row.updated_at, row.created_at) == ("One", "new", 99, 10)
    assert C.get(s.libraries, "id", "none").count() == 0


def test_delete_document_leaves_the_others(spark):
    s = C.delete_documents(two_libraries(spark), spark.createDataFrame([("d1",), ("none",)], "id string"))
    assert ids(s.documents) == ["d2", "d3", "d4", "d5"] and ids(s.chunks, "document_id") == ["d2", "d4"] and "d1" not in ids(s.contents, "document_id")
    assert C.get(s.libraries, "id", "lib-1").first().document_count == 2


def test_delete_library_leaves_nothing(spark):
    s = C.delete_library(two_libraries(spark), "lib-1")
    assert [set(ids(t.select("library_id"), "library_id")) for t in (s.documents, s.contents, s.chunks)] == [{"lib-2"}] * 3 and ids(s.libraries) == ["lib-2"]


def test_status_and_cleanup(spark):
    s = two_libraries(spark)
    s = C.set_status(s, spark.createDataFrame([("d1", "parsing", 7), ("d4", "error", 50)], "id string, status string, processing_progress int"), 60)
    docs = {r.id: r for r in s.documents.collect()}
    assert (docs["d1"].status, docs["d1"].processing_progress, docs["d1"].updated_at) == ("parsing", 7, 60)
    assert (docs["d4"].status, docs["d4"].processing_progress) == ("error", None)
    assert ids(C.cleanup_interrupted(s).documents) == ["d2", "d3", "d4", "d5"]
    fresh = C.create_library(s, "lib-3", "Fresh", 70)
    assert {r[0]: tuple(r[1:]) for r in C.status_counts(fresh.documents, fresh.libraries).collect()} == {"lib-1": (1, 1, True), "lib-2": (0, 0, False), "lib-3": (0, 0, False)}


def test_store_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.version() == 0 and store.read().libraries.count() == 0
    s = two_libraries(spark)
    assert store.commit(s) == 1
    assert store.commit(C.delete_library(store.read(), "lib-1")) == 2
    assert ids(store.read().documents) == ["d4", "d5"] and ids(store.read(1).documents) == ["d1", "d2", "d3", "d4", "d5"]
    plan = C.where(store.read().chunks, library_id="lib-2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(library_id" in plan


def test_store_writes_what_changed(spark, tmp_path):
    store, other = Store(spark, str(tmp_path / "store")), Store(spark, str(tmp_path / "store"))
    store.commit(two_libraries(spark))
    held, seen = store.read(), other.read()
    changes = spark.createDataFrame([("d1", "parsing", 7)], "id string, status string, processing_progress int")
    assert store.commit(C.set_status(held, changes, 60)) == 2
    written = sorted(p.name for p in (tmp_path / "store" / "data").glob("*/*"))
    assert written == ["chunks", "contents", "documents", "documents", "libraries"]
    assert {r.id: r.status for r in store.read().documents.collect()}["d1"] == "parsing" and store.read().chunks.count() == held.chunks.count()
    with pytest.raises(Conflict):  # it would undo what the first writer did
        other.commit(C.delete_library(seen, "lib-1"))
    assert store.version() == 2 and len(list((tmp_path / "store" / "data").iterdir())) == 2
    assert other.commit(C.delete_library(other.read(), "lib-1")) == 3 and ids(other.read().documents) == ["d4", "d5"]


def test_parse(spark):
    import io
    import zipfile

    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>you</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    rows = [("a.docx", "", buf.getvalue()), ("b.pdf", "", b"%PDF"), ("c.txt", "", "Grüße".encode()), ("d.docx", "", b"no zip")]
    out = {r.name: r for r in parse(spark.createDataFrame(rows, "name string, mime string, content binary"), pdf=lambda c: [["one", None], ["two"]]).collect()}
    assert out["a.docx"].text == "Hello\tyou\n\nTwo\n\n" and (out["b.pdf"].text, out["b.pdf"].pages) == ("one \n\ntwo", ["one ", "two"])
    assert out["c.txt"].text == "Grüße" and out["d.docx"].text is None and "BadZipFile" in out["d.docx"].error


def test_with_content(spark):
    s = two_libraries(spark)
    shown = {r.id: r.shown for r in C.with_content(s.documents, s.contents.filter("document_id <> 'd2'")).collect()}
    assert shown["d1"] == "Alpha beta." and shown["d5"] == "Document processing failed" and shown["d2"] == "Document is being processed..."
    nested = {r.library_id: [d.id for d in r.documents] for r in C.libraries_with_documents(s.libraries, s.documents.withColumn("created_at", F.hex("id").cast("long"))).collect()}
    assert nested["lib-1"] == ["d3", "d2", "d1"]
