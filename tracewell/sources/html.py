"""Word-exported HTML as ordered elements: the standard library's parser in Arrow batches, then column expressions for what a paragraph is."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.text import is_citation_only, is_heading_class, is_indented_style, is_noise, normalise, trailing_citation
from tracewell.operators.sequence import merge_soft_wrapped, renumber
from tracewell.schema import IMAGE

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style", "template", "rp", "rt"))


def decode(data: bytes) -> str:
    """The text of a page: by its declared charset, else UTF-8, Windows-1252 or Latin-1, the first that fits."""
    declared = re.search(r"charset=[\"']?([\w-]+)", data[:4096].decode("latin-1").lower())
    for name in ([declared[1]] if declared else []) + ["utf-8-sig", "utf-8", "cp1252"]:
        try:
            return data.decode(name)
        except (UnicodeDecodeError, LookupError):
            pass
    return data.decode("latin-1")


class _Outline(HTMLParser):
    """Collects images and paragraphs of the body in document order; an unclosed paragraph holds those within it, as a tree would.

    Texts lie in one list, each paragraph notes where its own begin and end, so paragraphs within paragraphs copy nothing while they are read.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.stack: list[tuple[str, dict | None]] = []
        self.texts: list[str] = []
        self.raw = 0
        self.body: int | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "body" and self.body is None:
            self.body = len(self.nodes)
        given = {k: v or "" for k, v in reversed(attrs)}
        node = None
        if tag == "p":
            node = {"kind": "p", "from": len(self.texts), "to": None, "class": given.get("class", ""), "style": given.get("style", "")}
        elif tag == "img":
            node = {"kind": "img", "src": given.get("src", "")}
        if node:
            self.nodes.append(node)
        if tag not in _VOID:
            self.stack.append((tag, node))
            self.raw += tag in _RAW

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                for name, node in self.stack[i:]:
                    self.raw -= name in _RAW
                    if node:
                        node["to"] = len(self.texts)
                del self.stack[i:]
                return

    def handle_data(self, data):
        if not self.raw:
            self.texts.append(data)


def outline(html: str) -> list[dict]:
    """Images (src) and paragraphs (text, class, style) of the body, or of all if there is no body."""
    parser = _Outline()
    parser.feed(html)
    parser.close()
    return [{**n, "text": " ".join(parser.texts[n["from"] : n["to"]])} if n["kind"] == "p" else n for n in parser.nodes[parser.body or 0 :]]


def _nodes(pages: DataFrame) -> DataFrame:
    """doc_id, seq, kind, text, css_class, style, src of every node; ``pages`` has doc_id and html (string or binary)."""

    def run(batches):
        for batch in batches:
            for doc_id, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                html = html.as_py()
                found = outline(decode(html) if isinstance(html, bytes) else html or "")
                columns = [[n.get(k) for n in found] for k in ("kind", "text", "class", "style", "src")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * len(found), batch.column(0).type), pa.array(range(len(found)), pa.int32()), *(pa.array(c, pa.string()) for c in columns)],
                    ["doc_id", "seq", "kind", "text", "css_class", "style", "src"],
                )

    kind = T.StructType([pages.schema["doc_id"], *T._parse_datatype_string("seq int, kind string, text string, css_class string, style string, src string").fields])
    return pages.select("doc_id", "html").mapInArrow(run, kind)


def emit(nodes: DataFrame, kinds: Column) -> DataFrame:
    """Elements of nodes in order: ``kinds`` is an array of (type, text) for each node, nulls left out; images get the id of their position."""
    each = nodes.select("doc_id", "seq", "src", F.posexplode(F.array_compact(kinds)).alias("part", "made"))
    position = (F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "part")) - 1).cast("int")
    placed = each.select("doc_id", position.alias("position"), F.col("made.type").alias("type"), F.col("made.text").alias("text"), F.col("made.image_id").alias("image_id"), "src")
    image = F.struct(
        F.coalesce("image_id", F.concat(F.lit("img_"), F.col("position").cast("string"))).alias("image_id"), F.col("src").alias("src"), F.col("position").alias("position"),
        F.lit(None).cast("string").alias("thumbnail_base64"),
    ).cast(IMAGE)
    return placed.select("doc_id", "position", "type", "text", F.when(F.col("type") == "image", image).alias("image"))


def made(kind: str | Column, text: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), text.alias("text"), F.lit(None).cast("string").alias("image_id"))


def classify(nodes: DataFrame) -> DataFrame:
    """``nodes`` (text, css_class, style) with ``paragraph``, what a paragraph is, and ``tail``, the citation that becomes an element after it (null if none does)."""
    nodes = nodes.withColumn("only", is_citation_only(F.col("text"))).withColumn("titled", is_heading_class(F.col("css_class")))
    # a citation in parentheses at the end is looked for only where one can be
    tail = F.when(~F.col("only") & ~F.col("titled") & F.col("text").rlike(r"\)\s*\z"), trailing_citation(F.col("text")))
    quoted = F.contains(F.lower("css_class"), F.lit("style1")) | is_indented_style(F.col("style"))
    kind = F.when(F.col("only"), "citation").when(quoted, "quote").when(F.col("titled"), "heading").otherwise("narration")
    return nodes.withColumn("paragraph", kind).withColumn("tail", tail).drop("only", "titled")


def extract_html(pages: DataFrame, site_phrases: tuple[str, ...] = ()) -> DataFrame:
    """Elements of Word-exported pages, soft wraps joined. ``pages`` has doc_id and html; ``site_phrases`` mark further paragraphs as furniture.

    A paragraph is a citation if it is nothing else; else a quote by class or margins, a heading by class, or
    narration, and a trailing citation becomes an element after it, headings aside. Images of a paragraph follow it. Payloads are joined by ``with_payloads``; nothing is fetched.
    """
    nodes = _nodes(pages).withColumn("text", normalise(F.col("text")))
    nodes = nodes.where((F.col("kind") == "img") | ~is_noise(F.col("text"), site_phrases))
    nodes = classify(nodes)
    kind, tail = F.col("paragraph"), F.when(F.col("tail").isNotNull(), made("citation", F.col("tail")))
    image = F.array(made("image", F.lit(None).cast("string")))
    return merge_soft_wrapped(emit(nodes, F.when(F.col("kind") == "img", image).otherwise(F.array(made(kind, F.col("text")), tail))))


def read_html(spark: SparkSession, folder: str, site_phrases: tuple[str, ...] = ()) -> DataFrame:
    """Elements of the HTML files of a folder; doc_id is a hash of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.htm*").load(folder)
    return extract_html(files.select(F.xxhash64("path").alias("doc_id"), F.col("content").alias("html")), site_phrases)


def local_payloads(spark: SparkSession, elements: DataFrame, folder: str, roots: DataFrame | None = None) -> DataFrame:
    """The image files of a folder that elements name by a relative path: doc_id, image_id, payload, for ``with_payloads``.

    ``roots`` (doc_id, root) says in which folder below ``folder`` a document lies; else all lie in it. Addresses, absolute paths and
    paths that leave the folder have no payload: files are listed by Spark and matched by name, none is opened by what a page says.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    top = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    named = files.select(F.substring_index(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), top + "/", -1).alias("name"), F.col("content").alias("payload"))
    asked = elements.where("type = 'image'").select("doc_id", F.col("image.image_id").alias("image_id"), F.regexp_replace("image.src", r"^(\./)+|[?#].*$", "").alias("src"))
    asked = asked.where(~F.col("src").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^/|(^|/)\.\.(/|$)"))
    if roots is not None:
        asked = asked.join(roots, "doc_id").withColumn("src", F.concat_ws("/", F.nullif(F.regexp_replace("root", "/+$", ""), F.lit("")), "src"))
    return asked.join(named, F.col("src") == F.col("name")).select("doc_id", "image_id", "payload")


def with_payloads(elements: DataFrame, images: DataFrame) -> DataFrame:
    """Images with their payload (doc_id, image_id, payload) as base64; joined last, so that bytes pass through no window."""
    held = images.select("doc_id", F.col("image_id").alias("_id"), F.base64("payload").alias("_payload"))
    joined = elements.withColumn("_id", F.col("image.image_id")).join(held, ["doc_id", "_id"], "left")
    return joined.withColumn("image", F.when(F.col("image").isNotNull(), F.col("image").withField("thumbnail_base64", F.col("_payload")))).select(*elements.columns)


__all__ = ["classify", "decode", "emit", "extract_html", "local_payloads", "made", "outline", "read_html", "renumber", "with_payloads"]
