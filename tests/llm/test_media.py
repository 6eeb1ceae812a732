import hashlib
import zlib

from hertzlake.llm import media

HTML = """<html><head><title>no</title><style>p{}</style><script>var a="<img src=q>";</script></head><body><p>One <b>two</b></p>
<figure><img src="sha256:aa" alt="old"><figcaption>The &amp; caption</figcaption></figure><p>three<img src="sha256:bb" alt="alt">four<br>five"""


def test_sequences_keep_order_and_captions():
    found = [(e["kind"], e["text"] or e["ref"], e["caption"]) for e in media.parse_sequence(HTML)]
    assert found == [("text", "One two", None), ("media", "sha256:aa", "The & caption"), ("text", "three", None), ("media", "sha256:bb", "alt"), ("text", "four", None), ("text", "five", None)]
    assert [e["pos"] for e in media.parse_sequence(HTML)] == list(range(6)) and media.parse_sequence("") == []


def test_digest_join_keeps_positions(spark):
    pages = spark.createDataFrame([(1, HTML, "c"), (1, HTML, "c"), (2, None, "c")], "page_id long, html string, digest string")
    payloads = spark.createDataFrame([("aa", 5)], "digest string, size int")
    found = sorted(media.resolve(media.interleaved(pages), payloads, ["page_id"]).collect(), key=lambda r: (r.page_id, r.pos))
    assert len(found) == 12 and [r.size for r in found if r.ref == "sha256:aa"] == [5, 5] and [r.size for r in found if r.ref == "sha256:bb"] == [None, None]
    assert media.interleaved(pages.limit(0)).count() == 0


def test_pages_of_the_tables(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    for row in media.interleaved(pages).collect():
        assert [e.pos for e in row.elements] == list(range(len(row.elements)))
        assert not any("track(" in (e.text or "") for e in row.elements)


def expected(text):
    data = (text or "").encode()
    size = max(64, (len(data) + 63) // 64 * 64)
    payload = data.ljust(size, b"\0")
    stored = f"P5\n64 {size // 64}\n255\n".encode() + payload
    rows = [sum(payload[k : k + 64]) for k in range(0, size, 64)]
    falls = sum(b < a for a, b in zip(rows, rows[1:]))
    feature = f"sum={sum(payload)};squares={sum(x * x for x in payload)};values={len(set(payload))};falls={falls}"
    return len(data), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def test_documents_and_cases(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-2, ""), (-3, "x" * 64), (-4, "é" * 500_000), (-5, "x\0"), (-6, "x")], "doc_id long, text string")
    every = docs.union(more)
    texts = {r.doc_id: r.text for r in every.collect()}
    found = media.text_media(every.selectExpr("doc_id", "text", "1 AS feature")).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == expected(texts[r.doc_id])
        lines = [x for x in (texts[r.doc_id] or "").split("\n") if x.split()]
        assert (r.pos, r.n_texts, r.caption) == (len(lines), len(lines), f"{len(texts[r.doc_id] or '')} code points")
    assert media.text_media(docs.limit(0)).count() == 0


def test_sequences_of_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, HTML), (-3, HTML)], "page_id long, html string")
    known = spark.createDataFrame([("bb", 1)], "digest string, n int")
    every = pages.union(odd)
    expected = []
    for row in every.collect():
        found = media.parse_sequence(row.html or "")
        texts = [e["text"] for e in found if e["kind"] == "text"]
        refs = [e["ref"] for e in found if e["kind"] == "media"]
        expected.append((row.page_id, len(texts), len(refs), refs.count("sha256:bb"), hashlib.sha256("\n".join(texts).encode()).hexdigest()))
    assert sorted(map(tuple, media.page_sequences(every, known).collect())) == sorted(expected)
    assert media.page_sequences(every.limit(0), known).count() == 0


def test_pages_give_back_their_texts():
    text = "a <b> & c\n\n  two  blanks \t\n</p>&amp;<img src=x>"
    found = media.parse_sequence(media.text_page(text, "aa"))
    assert [e["text"] for e in found[:-1]] == ["a <b> & c", "two blanks", "</p>&amp;<img src=x>"]
    assert (found[-1]["ref"], found[-1]["pos"], found[-1]["caption"]) == ("sha256:aa", 3, f"{len(text)} code points")
