"""Files of all kinds through the ingest, and from a folder to an answer."""

import zlib

import pytest
from pyspark.sql import functions as F

from marlstone.plans import verbs
from marlstone.sources import ingest, pdf


def make_pdf(pages, toc=(), title="", more=b"", flate=False):
    """``pages``: lists of (size, text) blocks; ``toc``: (title, page index)."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 3 0 R >>"}
    n, kids = 10, []
    for blocks in pages:
        data = b" ".join(b"BT /F1 %d Tf (%s) Tj ET" % (size, text.encode("latin-1").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")) for size, text in blocks)
        head = b"/Filter /FlateDecode" if flate else b""
        objects[n] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (n + 1)
        objects[n + 1] = b"<< /Length 1 %s >>\nstream\n%s\nendstream" % (head, zlib.compress(data) if flate else data)
        kids.append(n)
        n += 2
    objects[2] = b"<< /Type /Pages /Kids [%s] >>" % b" ".join(b"%d 0 R" % k for k in kids)
    items = list(range(n, n + len(toc)))
    objects[3] = b"<< /Type /Outlines %s >>" % (b"/First %d 0 R" % items[0] if items else b"")
    for k, (name, page) in enumerate(toc):
        dest = b"/Dest [%d 0 R /Fit]" % kids[page] if page is not None else b""
        objects[items[k]] = b"<< /Title (%s) %s %s >>" % (name.encode(), dest, b"/Next %d 0 R" % items[k + 1] if k + 1 < len(items) else b"")
    objects[9] = b"<< /Title (%s) /CreationDate (D:20230101120000+05'30') >>" % title.encode()
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in sorted(objects.items()))
    return b"%PDF-1.4\n" + body + b"trailer\n<< /Root 1 0 R /Info 9 0 R " + more + b">>\n%%EOF\n"


GOOD = make_pdf([[(24, "Guide"), (11, "Refer to STTM_LOANS (loan) terms."), (11, "More on loan repayment.")], [(24, "Second"), (11, "Text of it")]], [("Guide", 0), ("Nowhere", None), ("Second", 1)], "Loan Guide")


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    files = {"a.pdf": GOOD, "sub/copy.pdf": GOOD, "flate.pdf": make_pdf([[(18, "Head"), (11, "é body"), (11, "b")]], flate=True), "none.pdf": make_pdf([]), "locked.pdf": make_pdf([[(11, "x")]], more=b"/Encrypt 8 0 R "), "cut.pdf": GOOD[:-30], "text.pdf": b"hello", "empty.pdf": b"", "a.txt": b"x"}
    for name, content in files.items():
        (root / name).write_bytes(content)
    return str(root)


def test_reader():
    got = pdf.read_plain_pdf(GOOD)
    assert got["page_count"] == 2 and got["metadata"]["title"] == "Loan Guide" and got["toc"] == [["1", "Guide", "1"], ["1", "Nowhere"], ["1", "Second", "2"]]
    assert [s[4] for s in got["spans"]] == ["Guide", "Refer to STTM_LOANS (loan) terms.", "More on loan repayment.", "Second", "Text of it"]
    for content, kind in ((b"", pdf.CORRUPTED), (GOOD[:200], pdf.CORRUPTED), (make_pdf([]), pdf.EMPTY), (make_pdf([[(1, "x")]], more=b"/Encrypt 1 0 R "), pdf.ENCRYPTED), (b"%PDF-1.4\n1 0 obj\n<< >>\nendobj\n%%EOF", pdf.INVALID)):
        with pytest.raises(pdf.BadPdf) as e:
            pdf.read_plain_pdf(content)
        assert e.value.kind == kind


def test_single_paths(spark, folder):
    assert ingest.check_path(spark, folder + "/a.pdf") is None
    assert ingest.check_path(spark, folder) == pdf.NOT_A_FILE
    assert ingest.check_path(spark, folder + "/x.pdf") == pdf.NOT_FOUND


def test_folder(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    made = ingest.ingest(spark, folder, out)
    assert {r.filename: r.error_class for r in made["failures"].collect()} == {"none.pdf": "empty", "locked.pdf": "encrypted", "cut.pdf": "corrupted", "text.pdf": "corrupted"}
    docs = {r.title: r for r in made["documents"].collect()}
    assert set(docs) == {"Loan Guide", ""} and docs["Loan Guide"].page_count == 2 and docs["Loan Guide"].word_count == 14
    toc = made["toc"].where(F.col("document_id") == docs["Loan Guide"].document_id).orderBy("ord").collect()
    assert [(r.ord, r.level, r.title, r.page) for r in toc] == [(1, 1, "Guide", 1), (2, 1, "Second", 2)]
    blocks = made["blocks"].where(F.col("document_id") == docs["Loan Guide"].document_id).orderBy("page", "block_index").collect()
    assert [(r.type, r.level) for r in blocks] == [("heading", 2), ("text", None), ("text", None), ("heading", 4), ("text", None)]
    # A second run finds nothing new, and the manifest keeps what it has.
    again = ingest.ingest(spark, folder, out)
    assert again["documents"].count() == 0 and ingest.read_manifest(spark, out + "/manifest").count() == 2
    assert ingest.read_manifest(spark, out + "/nothing") is None


def test_reader_can_be_replaced(spark, folder):
    def reader(content):
        if content == b"hello":
            return {"page_count": 1, "metadata": {}, "toc": [["1", "x"]], "spans": [(1, 0, 0, 11.0, "hello", 0), (1, 1, 0, 0.0, "", 1)]}
        raise KeyError("no")

    from marlstone.sources import corpus

    opened = ingest.open_files(corpus.scan_files(spark, folder), reader)
    assert ingest.failures(opened).where("error_class = 'invalid'").count() == 6
    assert [(r.type, r.text) for r in ingest.blocks(opened).orderBy("block_index").collect()] == [("text", "hello"), ("figure", "")]
    assert ingest.toc_rows(opened).count() == 0


def test_from_a_folder_to_hits(spark, folder, tmp_path):
    path = str(tmp_path / "index")
    verbs.ingest_and_index(spark, folder, path)
    asked = spark.createDataFrame([(1, "STTM_LOANS terms")], "query_id bigint, question string")
    best = verbs.search(spark, path, asked, entities=True).orderBy("rank").first()
    assert "STTM_LOANS" in best.text and best.module == "Loans"
    assert verbs.metrics(spark, path).first().failures == 0
