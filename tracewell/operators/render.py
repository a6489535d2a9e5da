"""The annotated document: a relational plan of what stands where, and a thin writer of DOCX bytes from it."""

from __future__ import annotations

import base64
import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import join_key
from tracewell.operators.alignment import Located, clashes
from tracewell.operators.sequence import quote_blocks

#: What stands in a paragraph's place, in the order of its lines; citations and images follow the last quote.
KINDS = ("heading", "narration", "quote", "citation")
RUNS = "array<struct<start:int,run:string,color:string,group_id:string>>"


def quote_part_offsets(links: DataFrame) -> DataFrame:
    """A row for each paragraph of each quote: part_number (from 0), part, and where it starts and ends in the whole quote."""
    parts = links.select("*", F.posexplode(F.split("quote_text", "\n\n")).alias("part_number", "part"))
    before = Window.partitionBy("doc_id", "quote_number").orderBy("part_number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("part") + 2).over(before), F.lit(0)).cast("int")
    return parts.withColumn("start", start).withColumn("end", start + F.length("part"))


def colored_runs(pieces: DataFrame, keys: list[str], spans: str = "spans", text: str = "text") -> DataFrame:
    """Texts cut into runs: ``keys``, start, end, color (null for plain text), group_id and the run's text.

    ``spans`` is an array of structs (start, end, color, group_id) in the text's own positions. From left to right a
    span that begins within what is already coloured keeps only its rest; equal ranges count once, for the first group.
    """
    order = Window.partitionBy(*keys).orderBy("s_start", F.desc("s_end"), "group_id")
    clipped = pieces.select(*keys, text, F.explode(spans).alias("s")).select(
        *keys, text, F.greatest(F.lit(0), F.col("s.start")).alias("s_start"), F.least(F.length(text), F.col("s.end")).alias("s_end"), F.col("s.color").alias("color"), F.col("s.group_id").alias("group_id")
    )
    reached = F.coalesce(F.max("s_end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    colored = clipped.where("s_end > s_start").withColumn("start", F.greatest("s_start", reached)).where("s_end > start").select(*keys, text, "start", F.col("s_end").alias("end"), "color", "group_id")
    along = Window.partitionBy(*keys).orderBy("start")
    gaps = colored.withColumn("from", F.coalesce(F.lag("end").over(along), F.lit(0))).where("start > from").select(*keys, text, F.col("from").alias("start"), F.col("start").alias("end"), F.lit(None).cast("string").alias("color"), F.lit(None).cast("string").alias("group_id"))
    ends = pieces.join(colored.groupBy(*keys).agg(F.max("end").alias("last")), keys, "left").withColumn("start", F.coalesce("last", F.lit(0))).where(F.length(text) > F.col("start"))
    rest = ends.select(*keys, text, "start", F.length(text).alias("end"), F.lit(None).cast("string").alias("color"), F.lit(None).cast("string").alias("group_id"))
    runs = colored.unionByName(gaps).unionByName(rest)
    return runs.select(*keys, "start", "end", "color", "group_id", F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")).alias("run"))


def quote_runs(links: DataFrame) -> DataFrame:
    """The runs of every quote paragraph: spans of the whole quote clipped to the paragraph and moved into it."""
    parts = quote_part_offsets(links)
    local = F.filter(
        F.transform("claim_spans", lambda s: F.struct(
            (F.greatest(s["quote_start"], F.col("start")) - F.col("start")).alias("start"), (F.least(s["quote_end"], F.col("end")) - F.col("start")).alias("end"), s["color"].alias("color"), s["group_id"].alias("group_id"))),
        lambda s: s["end"] > s["start"],
    )
    pieces = parts.select("doc_id", "quote_number", "part_number", F.col("part").alias("text"), local.alias("spans"))
    return colored_runs(pieces, ["doc_id", "quote_number", "part_number"])


def project(source: str, target: str, spans: list[dict]) -> list[dict]:
    """Spans (start, end, ...) of one text moved into another one that differs in white space, from left to right.

    Each goes to the first place of its words after the one before, else to the first of all; a span that would overlap one already moved, or isn't there, is left out.
    """
    if source == target:
        return spans
    there, moved, reached = Located(target), [], 0
    for span in sorted(spans, key=lambda s: s["start"]):
        if not 0 <= span["start"] < span["end"] <= len(source):
            continue
        places = list(there.exact(source[span["start"] : span["end"]]))
        place = next((p for p in places if p[0] >= reached), places[0] if places else None)
        if place and not clashes(((m["start"], m["end"]) for m in moved), *place):
            moved.append({**span, "start": place[0], "end": place[1]})
            reached = place[1]
    return moved


def project_spans(pieces: DataFrame, source: str, target: str, spans: str = "spans") -> DataFrame:
    """``pieces``, all its columns, with ``spans`` of the text ``source`` moved into ``target``. Only rows whose texts differ pass through Python."""
    same = F.col(source).eqNullSafe(F.col(target))
    packed = pieces.where(~same).select(F.struct(*pieces.columns).alias("row"), source, target, spans)

    def run(batches):
        for batch in batches:
            moved = [project(a or "", b or "", s or []) for a, b, s in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(moved, batch.column(3).type)], ["row", "moved"])

    kind = packed.schema[spans].dataType.simpleString()
    done = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, moved {kind}")
    rest = [F.col("moved").alias(c) if c == spans else F.col("row").getField(c).alias(c) for c in pieces.columns]
    return pieces.where(same).unionByName(done.select(*rest))


def match_in_order(segments: list[str], parts: list[str]) -> list[int | None]:
    """For each segment the number of the part that is the same text, holds it or is held by it: the next such part after the last one taken, else the first of those before; None if there is none."""
    out, cursor = [], 0
    for text in segments:
        alike = [i for i, part in enumerate(parts) if text and (text in part or part in text)]
        ahead = next((i for i in alike if i >= cursor), None)
        out.append(ahead if ahead is not None else next(iter(alike), None))
        cursor = cursor if ahead is None else ahead + 1
    return out


def match_quote_plan(elements: DataFrame, links: DataFrame) -> DataFrame:
    """The part of a link that each quote element shows, in document order: doc_id, position, quote_number, part_number (null where none fits).

    Texts are compared by their join keys. A document's quotes are matched in sequence, so they meet in one row; documents are independent.
    """
    parts = quote_part_offsets(links).select("doc_id", F.struct("quote_number", "part_number", join_key(F.col("part")).alias("key")).alias("p"))
    parts = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("parts"))
    quotes = elements.where("type = 'quote'").select("doc_id", F.struct("position", join_key(F.col("text")).alias("key")).alias("s"))
    quotes = quotes.groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("segments"))

    def run(batches):
        for batch in batches:
            ids, positions, numbers, places = [], [], [], []
            for doc_id, segments, held in zip(*(c.to_pylist() for c in batch.columns)):
                held = held or []
                for segment, at in zip(segments, match_in_order([s["key"] for s in segments], [p["key"] for p in held])):
                    ids.append(doc_id)
                    positions.append(segment["position"])
                    numbers.append(None if at is None else held[at]["quote_number"])
                    places.append(None if at is None else held[at]["part_number"])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *(pa.array(c, pa.int32()) for c in (positions, numbers, places))], ["doc_id", "position", "quote_number", "part_number"])

    kind = elements.schema["doc_id"].dataType.simpleString()
    return quotes.join(parts, "doc_id", "left").mapInArrow(run, f"doc_id {kind}, position int, quote_number int, part_number int")


def evidence_images(groups: DataFrame) -> DataFrame:
    """The images of each citation text of a document, equal ones (by id, else by payload) once, those of earlier groups first: doc_id, text, images."""
    each = groups.select("doc_id", F.col("citation_text").alias("text"), "position", F.posexplode("images").alias("number", "image"))
    key = F.coalesce(F.nullif("image.image_id", F.lit("")), F.nullif("image.thumbnail_base64", F.lit("")))
    order = Window.partitionBy("doc_id", "text", "key").orderBy("position", "number")
    first = each.withColumn("key", key).where("key is not null").withColumn("rank", F.row_number().over(order)).where("rank = 1")
    held = F.array_sort(F.collect_list(F.struct("position", "number", "image")))
    return first.groupBy("doc_id", "text").agg(F.transform(held, lambda x: x["image"]).alias("images"))


def render_plan(elements: DataFrame, links: DataFrame, groups: DataFrame) -> DataFrame:
    """The annotated document in order: doc_id, seq, kind, text, runs, anchor, link, images.

    Headings and narrations stand as they are; a description carries its spans and the anchor that its quotes link
    back to; the paragraphs of a linked quote carry theirs; after the last of a block come its citation and images.
    A link without a citation has no citation line.
    """
    starts = links.select("doc_id", "quote_number", "quote_start_position", "quote_end_position", "citation_text", F.coalesce("colorization_description_position", "description_position").alias("at"), "claim_spans")
    described = starts.select("doc_id", F.col("at").alias("position"), F.explode("claim_spans").alias("s")).select("doc_id", "position", F.struct(
        F.col("s.description_start").alias("start"), F.col("s.description_end").alias("end"), F.col("s.color").alias("color"), F.col("s.group_id").alias("group_id")).alias("s"))
    texts = elements.where("type in ('heading', 'narration')").select("doc_id", "position", "type", "text")
    sources = links.select("doc_id", F.coalesce("colorization_description_position", "description_position").alias("position"), F.coalesce("colorization_description_text", "description_text").alias("source"))
    sources = sources.groupBy("doc_id", "position").agg(F.trim(F.max("source")).alias("source"))
    anchors = starts.groupBy("doc_id", F.col("at").alias("position")).agg(F.min("quote_number").alias("anchor"))
    painted = texts.join(described.groupBy("doc_id", "position").agg(F.array_distinct(F.collect_list("s")).alias("spans")), ["doc_id", "position"], "left")
    empty = F.array().cast("array<struct<start:int,end:int,color:string,group_id:string>>")
    painted = painted.join(sources, ["doc_id", "position"], "left").withColumns({"spans": F.coalesce("spans", empty), "source": F.coalesce("source", "text")})
    painted = project_spans(painted, "source", "text").drop("source")
    run = F.struct("start", "run", "color", "group_id")
    lists = colored_runs(painted, ["doc_id", "position"]).groupBy("doc_id", "position").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    plain = texts.join(lists, ["doc_id", "position"], "left").join(anchors, ["doc_id", "position"], "left").select(
        "doc_id", "position", F.lit(0).alias("sub"), F.col("type").alias("kind"), "text", "runs", F.concat(F.lit("description_"), F.col("anchor").cast("string")).alias("anchor"), F.lit(None).cast("string").alias("link"))
    quoted = quote_runs(links).groupBy("doc_id", "quote_number", "part_number").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    quoted = quoted.join(starts.select("doc_id", "quote_number", F.col("quote_start_position").alias("position"), "at"), ["doc_id", "quote_number"]).select(
        "doc_id", "position", F.col("part_number").alias("sub"), F.lit("quote").alias("kind"), F.array_join(F.transform("runs", lambda r: r["run"]), "").alias("text"), "runs",
        F.when(F.col("part_number") == 0, F.concat(F.lit("quote_"), F.col("quote_number").cast("string"))).alias("anchor"),
        # the way back exists only if the description stands earlier
        F.when(F.col("at") < F.col("position"), F.concat(F.lit("description_"), F.col("quote_number").cast("string"))).alias("link"),
    )
    # a link covers whole blocks, so its start finds the block by an equi-join
    held = quote_blocks(elements).where("type = 'quote'")
    opened = held.join(starts.select("doc_id", F.col("quote_start_position").alias("position")).distinct(), ["doc_id", "position"], "left_semi").select("doc_id", "block")
    unlinked = held.join(opened, ["doc_id", "block"], "left_anti").select("doc_id", "position", "text")
    none = F.lit(None).cast("string")
    loose = unlinked.select("doc_id", "position", F.lit(0).alias("sub"), F.lit("quote").alias("kind"), "text", F.lit(None).cast(plain.schema["runs"].dataType).alias("runs"), none.alias("anchor"), none.alias("link"))
    cited = starts.where("citation_text is not null").select("doc_id", F.col("quote_end_position").alias("position"), F.lit(0).alias("sub"), F.lit("citation").alias("kind"), F.col("citation_text").alias("text"), F.lit(None).cast(plain.schema["runs"].dataType).alias("runs"), none.alias("anchor"), none.alias("link"))
    rows = plain.unionByName(quoted).unionByName(loose).unionByName(cited)
    # a citation stands at its block's end, behind every paragraph of the quote, whose place is the block's start
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("position", place, "sub")) - 1
    images = evidence_images(groups).withColumn("kind", F.lit("citation"))
    return rows.withColumn("seq", seq.cast("int")).join(images, ["doc_id", "kind", "text"], "left").select("doc_id", "seq", "kind", "text", "runs", "anchor", "link", "images")


_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/><Default Extension="jpeg" ContentType="image/jpeg"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
_MAIN = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_DRAW = "http://schemas.openxmlformats.org/drawingml/2006"
_PIC = f"{_DRAW}/picture"
CAPTION = "↑ Matched screenshot evidence"
_HIGHLIGHTS = {"YELLOW": "yellow", "TURQUOISE": "cyan", "BRIGHT_GREEN": "green", "PINK": "magenta", "GRAY_25": "lightGray", "BLUE": "blue", "RED": "red"}


def _picture(number: int) -> str:
    """A drawing of the relation ``image{number}``, as wide as the text; readers scale it."""
    size = 'cx="4114800" cy="3086100"'
    return (
        f'<w:p><w:r><w:drawing><wp:inline><wp:extent {size}/><wp:docPr id="{number}" name="image{number}"/><a:graphic><a:graphicData uri="{_PIC}"><pic:pic><pic:nvPicPr><pic:cNvPr id="{number}" name="image{number}"/><pic:cNvPicPr/></pic:nvPicPr>'
        f'<pic:blipFill><a:blip r:embed="image{number}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext {size}/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r></w:p>'
    )


def docx_bytes(rows: list[dict]) -> bytes:
    """A Word file of a document's plan rows in order. Images with a payload follow their citation, each with a line under it; a payload that isn't base64 is passed over."""
    body, number, media = [], 0, []
    for row in rows:
        style = {"heading": "Heading1", "quote": "Quote"}.get(row["kind"], "Normal")
        runs = row["runs"] or [{"run": row["text"] or "", "color": None}]
        text = "".join(f'<w:r>{f"<w:rPr><w:highlight w:val=\"{_HIGHLIGHTS[r["color"]]}\"/></w:rPr>" if r["color"] else ""}<w:t xml:space="preserve">{escape(r["run"])}</w:t></w:r>' for r in runs)
        if row["link"]:
            text += f'<w:hyperlink w:anchor="{row["link"]}"><w:r><w:t xml:space="preserve"> ↑</w:t></w:r></w:hyperlink>'
        if row["anchor"]:
            number += 1
            text = f'<w:bookmarkStart w:id="{number}" w:name="{row["anchor"]}"/>{text}<w:bookmarkEnd w:id="{number}"/>'
        body.append(f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>{text}</w:p>')
        images = row.get("images") or []
        for place, image in enumerate(images, 1):
            try:
                payload = base64.b64decode(image["thumbnail_base64"] or "", validate=True)
            except ValueError:
                continue
            if payload:
                media.append(payload)
                of = f" ({place}/{len(images)})" if len(images) > 1 else ""
                body.append(f'{_picture(len(media))}<w:p><w:r><w:rPr><w:i/><w:sz w:val="16"/></w:rPr><w:t>{CAPTION}{of}</w:t></w:r></w:p>')
    spaces = f'xmlns:w="{_MAIN}" xmlns:r="{_REL}" xmlns:a="{_DRAW}/main" xmlns:pic="{_PIC}" xmlns:wp="{_DRAW}/wordprocessingDrawing"'
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document {spaces}><w:body>{"".join(body)}</w:body></w:document>'
    names = [f"media/image{i}.{'jpeg' if m[:2] == b'\xff\xd8' else 'png'}" for i, m in enumerate(media, 1)]
    relations = "".join(f'<Relationship Id="image{i}" Type="{_REL}/image" Target="{n}"/>' for i, n in enumerate(names, 1))
    own = f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{relations}</Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", document), ("word/_rels/document.xml.rels", own), *((f"word/{n}", m) for n, m in zip(names, media))):
            archive.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def to_docx(plan: DataFrame) -> DataFrame:
    """doc_id and the bytes of its Word file. A document's rows meet in one row, as one file does."""

    def run(batches):
        for batch in batches:
            rows = [docx_bytes(r) for r in batch.column("rows").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "content"])

    whole = plan.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "text", "runs", "anchor", "link", "images"))).alias("rows"))
    return whole.mapInArrow(run, "doc_id bigint, content binary")
