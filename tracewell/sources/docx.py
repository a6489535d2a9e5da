"""Word documents as ordered elements: ZIP and XML of the standard library in Arrow batches, then column expressions."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.text import is_citation_only, is_heading_style_name, is_indented_points, is_quote_style_name, normalise, trailing_citation
from tracewell.operators.sequence import merge_soft_wrapped
from tracewell.sources.html import emit, made

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _points(properties: ET.Element | None, *names: str) -> float | None:
    """An indent in points; Word stores twentieths."""
    found = properties.find(f"{_W}ind") if properties is not None else None
    value = next((found.get(_W + n) for n in names if found is not None and found.get(_W + n)), None)
    return float(value) / 20 if value and value.lstrip("-").isdigit() else None


def paragraphs(data: bytes) -> list[dict]:
    """Text, style name, indents and embedded images (relation and payload) of each paragraph of the body; tables are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = set(archive.namelist())
        body = ET.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
        styles = {}
        if "word/styles.xml" in names:
            for style in ET.fromstring(archive.read("word/styles.xml")).iter(f"{_W}style"):
                name = style.find(f"{_W}name")
                styles[style.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
        targets = {}
        if "word/_rels/document.xml.rels" in names:
            targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(archive.read("word/_rels/document.xml.rels"))}
        out = []
        for p in body.findall(f"{_W}p") if body is not None else []:
            properties = p.find(f"{_W}pPr")
            style = properties.find(f"{_W}pStyle") if properties is not None else None
            text = "".join("\t" if e.tag == f"{_W}tab" else "\n" if e.tag in (f"{_W}br", f"{_W}cr") else e.text or "" for r in p.iter(f"{_W}r") for e in r if e.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr"))
            relations = [b.get(f"{_R}embed") for b in p.iter(f"{_A}blip") if b.get(f"{_R}embed")]
            member = lambda r: f"word/{targets.get(r, '')}"
            out.append({
                "text": text, "style": styles.get(style.get(f"{_W}val"), style.get(f"{_W}val")) if style is not None else "Normal",
                "left": _points(properties, "left", "start"), "right": _points(properties, "right", "end"),
                "images": [(r, archive.read(member(r)) if member(r) in names else None) for r in relations],
            })
        return out


def _nodes(files: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                number = 0
                for p in paragraphs(content.as_py()):
                    for relation, payload in p["images"]:
                        number += 1
                        rows.append(("img", None, None, None, None, f"docx://{relation}", f"docx_img_{number}", payload))
                    rows.append(("p", p["text"], p["style"], p["left"], p["right"], None, None, None))
                kinds = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.binary()]
                columns = list(zip(*rows)) if rows else [[]] * 8
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * len(rows), batch.column(0).type), pa.array(range(len(rows)), pa.int32()), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    ["doc_id", "seq", "kind", "text", "style", "left", "right", "src", "image_id", "payload"],
                )

    rest = "seq int, kind string, text string, style string, left double, right double, src string, image_id string, payload binary"
    return files.select("doc_id", "content").mapInArrow(run, T.StructType([files.schema["doc_id"], *T._parse_datatype_string(rest).fields]))


def extract_docx(files: DataFrame) -> DataFrame:
    """Elements of Word documents (doc_id, content), soft wraps joined. A paragraph's images come before its text; headings are told before quotes."""
    nodes = _nodes(files).drop("payload").withColumn("text", normalise(F.col("text"))).where("kind = 'img' or text <> ''")
    nodes = nodes.withColumn("only", is_citation_only(F.col("text"))).withColumn("tail", trailing_citation(F.col("text"))).withColumn("titled", is_heading_style_name(F.col("style")))
    quoted = is_quote_style_name(F.col("style")) | is_indented_points(F.col("left"), F.col("right"))
    kind = F.when(F.col("only"), "citation").when(F.col("titled"), "heading").when(quoted, "quote").otherwise("narration")
    tail = F.when(~F.col("only") & ~F.col("titled") & F.col("tail").isNotNull(), made("citation", F.col("tail")))
    image = F.array(made("image", F.lit(None).cast("string")).withField("image_id", F.col("image_id")))
    return merge_soft_wrapped(emit(nodes, F.when(F.col("kind") == "img", image).otherwise(F.array(made(kind, F.col("text")), tail))))


def docx_images(files: DataFrame) -> DataFrame:
    """The embedded images (doc_id, image_id, payload), for ``sources.html.with_payloads``."""
    return _nodes(files).where("kind = 'img' and payload is not null").select("doc_id", "image_id", "payload")


def read_docx(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(folder)
    return extract_docx(files.select(F.xxhash64("path").alias("doc_id"), "content"))
