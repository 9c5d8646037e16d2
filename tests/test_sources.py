"""PDF files built here, and searches that show a page at a time."""

import random
import zlib

import pytest

from tallyspark.sources import pdf, search


def obj(n, body):
    return b"%d 0 obj\n%b\nendobj\n" % (n, body)


def stream(n, body, head=b"", length=None):
    return obj(n, b"<< /Length %b %b >>\nstream\n%b\nendstream" % (length or b"%d" % len(body), head, body))


def flate(n, body, head=b""):
    return stream(n, zlib.compress(body), head + b" /Filter /FlateDecode")


CMAP = b"/CIDInit begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00E9> <00660069>] endbfrange endcmap"
SHOWN = rb"BT /F1 12 Tf 0 -14 Td (Plain \(nested (one)\) \101\n\\ and \351) Tj 0 -14 Td [(Ab) -20 (cd) -500 (ef)] TJ ET BT /F2 9 Tf 1 0 0 1 0 700 Tm <0001001000110012> Tj 1 0 0 1 90 700 Tm <00020020> Tj 1 0 0 1 0 690 Tm <0021> Tj ET"


def built(*parts, tail=b"trailer\n<< /Root 1 0 R >>\n%%EOF"):
    return b"%PDF-1.5\n%\xe2\xe3\n" + b"".join(parts) + tail


def book(*contents):
    kids = b" ".join(b"%d 0 R" % (10 + k) for k in range(len(contents)))
    pages = [obj(10 + k, b"<< /Type /Page /Contents %d 0 R >>" % (30 + k)) + c(30 + k) for k, c in enumerate(contents)]
    fonts = b"/Resources << /Font << /F1 5 0 R /F2 6 0 R >> >>"
    return built(obj(1, b"<</Type/Catalog/Pages 2 0 R>>"), obj(2, b"<< /Type /Pages " + fonts + b" /Kids [" + kids + b"] >>"), obj(5, b"<< /Type /Font >>"), obj(6, b"<< /Type /Font /ToUnicode 7 0 R >>"), flate(7, CMAP), *pages)


WANT = "Plain (nested (one)) A\n\\ and é\nAbcd ef\nAabc\U0001f600é\nfi"


def test_text_operators_and_filters():
    a85 = lambda n: stream(n, __import__("base64").a85encode(SHOWN) + b"~>", b"/Filter /ASCII85Decode")
    both = lambda n: stream(n, zlib.compress(SHOWN).hex().encode() + b">", b"/Filter [/ASCIIHexDecode /FlateDecode]")
    assert pdf.page_texts(book(lambda n: flate(n, SHOWN), lambda n: stream(n, SHOWN), a85, both)) == [WANT] * 4
    # a wrong length, one kept in another object, an unknown filter, a cut stream
    odd = book(lambda n: stream(n, SHOWN, length=b"3"), lambda n: stream(n, SHOWN, length=b"99 0 R") + obj(99, b"%d" % len(SHOWN)), lambda n: stream(n, SHOWN, b"/Filter /JPXDecode"), lambda n: stream(n, zlib.compress(SHOWN)[:-8], b"/Filter /FlateDecode"))
    got = pdf.page_texts(odd)
    assert got[:3] == [WANT, WANT, ""] and got[3].startswith("Plain (nested")


def test_later_definitions_trees_and_object_streams():
    new = book(lambda n: stream(n, b"BT (old) Tj ET"))
    assert pdf.page_texts(new + stream(30, b"BT (new) Tj ET")) == ["new"]
    packed = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Kids [3 0 R 4 0 R 2 0 R] >>"), (3, b"<< /Kids [10 0 R] >>"), (4, b"<< /Type /Page /Contents [30 0 R 31 0 R] >>"), (10, b"<< /Type /Page /Contents 31 0 R >>")]
    head, body = b"", b""
    for n, b in packed:
        head += b"%d %d " % (n, len(body))
        body += b + b" "
    file = built(flate(50, head + body, b"/Type /ObjStm /N %d /First %d" % (len(packed), len(head))), stream(30, b"BT (a) Tj"), stream(31, b"(b) Tj ET"))
    # the tree holds itself, which adds no page
    assert pdf.page_texts(file) == ["b", "ab"]
    loose = built(*[obj(n, b) for n, b in packed], stream(30, b"BT (a) Tj"), stream(31, b"(b) Tj ET"))
    assert pdf.page_texts(loose) == ["b", "ab"]


@pytest.mark.parametrize("data", [None, b"", b"no file", b"%PDF-1.4\n", built(), book(lambda n: stream(n, SHOWN)).replace(b"trailer\n<<", b"trailer\n<< /Encrypt 9 0 R"), b"%PDF-1.4 1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj"])
def test_broken_and_encrypted_files_have_no_text(data):
    assert "".join(pdf.page_texts(data)) == ""


def test_cut_files_do_not_fail():
    whole, rng = book(lambda n: flate(n, SHOWN), lambda n: stream(n, SHOWN)), random.Random(3)
    for _ in range(300):
        at = rng.randrange(len(whole))
        pdf.page_texts(whole[:at])
        pdf.page_texts(whole[:at] + bytes([rng.randrange(256)]) + whole[at + 1 :])


def test_files_through_the_reader(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.pdf").write_bytes(book(*[lambda n, k=k: flate(n, b"BT (file %d) Tj ET" % k)] * (k + 1)))
    (tmp_path / "x.pdf").write_bytes(b"junk")
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/*.pdf").selectExpr("path as doc", "content")
    got = sorted((r.doc[-5:], r.page, r.text) for r in pdf.pdf_pages(files).collect())
    assert got == [(f"{k}.pdf", p, f"file {k}") for k in range(3) for p in range(k + 1)]


def recorded(seed):
    rng = random.Random(seed)
    rows = [(i, min(999, int(rng.expovariate(0.01)))) for i in range(900)] + [(1000 + i, 77) for i in range(60)]
    return sorted(rows, key=lambda r: (-r[1], r[0]))


def test_ranges_equal_plain_halving(spark):
    rows = recorded(1)
    got = sorted((r.lo, r.hi, r.n, r.over) for r in search.search_ranges(spark.createDataFrame(rows, "id long, stars long"), "stars", 50, 10).collect())
    count = lambda lo, hi: sum(lo <= s < hi for _, s in rows)
    want = [(lo, hi, count(lo, hi), count(lo, hi) > 50) for lo, hi in search.halved(count, 0, 1024, 50)]
    assert got == want and any(r[3] for r in got) and sum(r[2] for r in got) == len(rows)
    assert search.search_ranges(spark.createDataFrame([], "stars long"), "stars", 50, 10).collect() == []


def test_all_rows_of_a_search_are_read_once(spark):
    rows = recorded(2)
    hits = lambda lo, hi: [r for r in rows if lo <= r[1] < hi]
    source = search.paged_search(lambda lo, hi: len(hits(lo, hi)), lambda lo, hi, k: hits(lo, hi)[:100][20 * k : 20 * k + 20], "id long, stars long", 1024, 100, "recorded_search")
    spark.dataSource.register(source)
    df = spark.read.format("recorded_search").load()
    assert sorted(map(tuple, df.collect())) == sorted(rows) and df.rdd.getNumPartitions() > 5
    spark.dataSource.register(search.paged_search(lambda lo, hi: 0, lambda lo, hi, k: [], "id long", 16, name="empty_search"))
    assert spark.read.format("empty_search").load().collect() == []
