"""Media columns: documents as sequences of texts and media references.

Parsing a page yields its texts and its media references in reading order. A reference names its
payload by the digest of the stored bytes; payloads lie once for each digest and writing task in a
Parquet store, and features are computed from the bytes read back. A join on the digest brings them
to the references; positions and captions stay with the references.
"""

from __future__ import annotations

import hashlib
import html as markup
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

ELEMENT = "struct<pos:int,kind:string,text:string,ref:string,caption:string>"
SEQUENCE = f"array<{ELEMENT}>"
SCHEME = "sha256:"
WIDTH = 64
#: Tags whose content is not read, tags that hold a reference, tags that end a text.
SKIPPED = frozenset(("script", "style", "noscript", "template", "title"))
MEDIA = frozenset(("img", "audio", "video", "source", "embed"))
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


class _Sequence(HTMLParser):
    """Collects texts and references in order; a figure's caption goes to its references."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.words: list[str] = []
        self.skipped = 0
        self.figure: list[int] | None = None
        self.in_caption = False

    def add(self, kind: str, text: str | None, ref: str | None, caption: str | None) -> None:
        self.found.append({"pos": len(self.found), "kind": kind, "text": text, "ref": ref, "caption": caption})

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words.clear()
        if text and self.in_caption and self.figure:
            for at in self.figure:
                self.found[at]["caption"] = text
        elif text:
            self.add("text", text, None, None)

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag in SKIPPED:
            self.skipped += 1
        if tag in BLOCKS or tag in MEDIA or tag == "figcaption":
            self.flush()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.in_caption = True
        elif tag in MEDIA and own.get("src") and not self.skipped:
            if self.figure is not None:
                self.figure.append(len(self.found))
            self.add("media", None, own["src"], own.get("alt") or None)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        if tag in BLOCKS or tag == "figcaption":
            self.flush()
        if tag == "figcaption":
            self.in_caption = False
        elif tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.skipped:
            self.words.append(data)


def parse_sequence(html: str) -> list[dict]:
    parser = _Sequence()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.found


def _parsed(df: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """df's keys and `elements`, the parsed sequence of its html."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
    picked = df.select(*keys, html)
    fields = ", ".join(f"`{name}` {picked.schema[name].dataType.simpleString()}" for name in keys)

    def run(batches):
        for batch in batches:
            found = [parse_sequence(x or "") for x in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(found, kind)], [*keys, "elements"])

    return picked.mapInArrow(run, f"{fields}, elements {SEQUENCE}")


def interleaved(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and elements, the ordered texts and references of each row's html.

    Null or empty html gives an empty sequence; repeated rows give repeated results, an empty table an
    empty result; other columns are ignored.
    """
    return _parsed(pages, [key], html)


def padded(payload: bytes) -> bytes:
    """payload and zero bytes up to a positive multiple of WIDTH."""
    return payload + bytes(max(WIDTH, -(-len(payload) // WIDTH) * WIDTH) - len(payload))


def to_image(samples: bytes) -> bytes:
    """An 8-bit grey image, WIDTH samples a row."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(samples) // WIDTH) + samples


def from_image(media: bytes) -> bytes:
    head, size, depth, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if head != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit grey image")
    return samples


def image_feature(samples: bytes) -> str:
    """Exact whole-number statistics: sum, sum of squares, distinct values, rows whose sum is below the row before's."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    rows = x.reshape(-1, WIDTH).sum(1)
    used = int((np.bincount(x, minlength=256) > 0).sum())
    return f"sum={int(x.sum())};squares={int((x * x).sum())};values={used};falls={int((np.diff(rows) < 0).sum())}"


def text_page(text: str, digest: str) -> str:
    """A page of a text's lines as paragraphs and a figure that refers to the text's image, with its size as caption."""
    lines = "".join(f"<p>{markup.escape(line, quote=False)}</p>" for line in text.split("\n"))
    return f'<article>{lines}<figure><img src="{SCHEME}{digest}"><figcaption>{len(text)} code points</figcaption></figure></article>'


def pages_and_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, elements, digest, media of docs' texts: the parsed sequence of each text's page, and the text's image.

    Made in one pass over the texts and stored. The sequence's texts are kept as their digests (sha256), as
    the texts lie in docs. A writing task stores equal images once, null otherwise; copies in other tasks
    are dropped after reading, when rows are small, as to bring equal payloads together first would shuffle
    every payload.
    """
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode()
                media = to_image(padded(data))
                digest = hashlib.sha256(media)
                elements = parse_sequence(text_page(text or "", digest.hexdigest()))
                for element in elements:
                    element["text"] = element["text"] and sha(element["text"])
                rows.append((len(data), elements, digest.hexdigest(), None if digest.digest() in seen else media))
                seen.add(digest.digest())
            if len(seen) > 1_000_000:
                seen.clear()
            columns = zip(*rows) if rows else [()] * 4
            kinds = [pa.int64(), kind, pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds))], ["doc_id", "n_bytes", "elements", "digest", "media"])

    made = docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_bytes long, elements {SEQUENCE}, digest string, media binary")
    return stored(made, "pages-and-media")


def media_features(store: DataFrame) -> DataFrame:
    """What the stored bytes of each digest hold, one row a digest."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(digest: str, media: bytes) -> tuple:
        payload, sha = from_image(media), hashlib.sha256(media).hexdigest()
        if sha != digest:
            raise ValueError(f"stored bytes of {digest} have digest {sha}")
        return digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), sha, image_feature(payload)

    def run(batches):
        for batch in batches:
            rows = [one(*x) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], names)

    found = store.select("digest", "media").mapInArrow(
        run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    return stored(found.groupBy("digest").agg(*(F.first(x).alias(x) for x in names[1:])), "features")


def resolve(sequences: DataFrame, media: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each element of the sequences (keys, elements), with media's columns where its
    digest is the element's reference and null elsewhere; pos and caption stay with the element.

    An unknown reference keeps its row. The join is by digest; a digest that very many elements share is
    split by adaptive execution, as both sides come straight from an exchange.
    """
    ref: Column = F.expr(f"if(startswith(e.ref, '{SCHEME}'), substr(e.ref, {len(SCHEME) + 1}), null)")
    elements = sequences.select(*keys, F.explode("elements").alias("e")).select(*keys, "e.*", ref.alias("digest"))
    return elements.join(media, "digest", "left")


def text_media(docs: DataFrame) -> DataFrame:
    """The media column of docs' texts: one row a document.

    Text in UTF-8 (null: empty), padded with zero bytes, stored as an 8-bit image. A page holds the text's
    lines and a figure that refers to the image; its sequence is parsed and the reference resolved. pos is the
    figure's place behind the texts, n_texts their number, caption the figure's, all as the sequence has
    them. Equal texts give equal values; repeated rows give repeated results, an empty table an empty
    result; other columns are ignored.
    """
    made = pages_and_media(docs)
    n_texts = F.size(F.filter("elements", lambda e: e["kind"] == "text")).alias("n_texts")
    figures = made.select("doc_id", "n_bytes", n_texts, F.filter("elements", lambda e: e["kind"] == "media").alias("elements"))
    found = resolve(figures, media_features(made.filter("media is not null")), ["doc_id", "n_bytes", "n_texts"])
    columns = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return found.select("doc_id", "n_bytes", *columns, "pos", "n_texts", "caption")


def page_sequences(pages: DataFrame, media: DataFrame) -> DataFrame:
    """page_id, n_texts, n_media, n_resolved, texts_sha256 of each row of pages (page_id, html): its sequence, put together again after
    its references met media (digest, more) by digest.

    texts_sha256 is the digest of the texts in the order of their positions, joined by line ends. Repeated rows give repeated results.
    """
    rows = interleaved(pages).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "sequences")
    met = resolve(rows, media.select("digest", F.lit(True).alias("there")), ["page_id", "row"])
    texts = F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "text", F.struct("pos", "text")))), lambda x: x["text"])
    found = met.groupBy("row").agg(
        F.count_if(F.col("kind") == "text").alias("n_texts"), F.count_if(F.col("kind") == "media").alias("n_media"), F.count("there").alias("n_resolved"),
        F.sha2(F.array_join(texts, "\n"), 256).alias("texts_sha256"),
    )
    none = F.lit(hashlib.sha256(b"").hexdigest())
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_texts", "n_media", "n_resolved")]
    return rows.select("page_id", "row").join(found, "row", "left").select("page_id", *counts, F.coalesce("texts_sha256", none).alias("texts_sha256"))
