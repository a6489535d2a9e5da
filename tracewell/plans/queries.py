"""The registered queries of the engine, over the driver's tables and the article fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import similarity as S
from tracewell.functions import text as X
from tracewell.operators import citations, claims, evidence, nearest, quotes, render, runs, sequence, spans
from tracewell.plans import assemble
from tracewell.plans.fixtures import articles, paragraphs
from tracewell.plans.fixtures import claims as claim_rows
from tracewell.sources import html


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "raw"))
    return docs.select("doc_id", "ln", F.trim("raw").alias("line")).where("line <> ''")


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.merge_soft_wrapped(articles(spark, sf_dir))


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    elements = _elements(spark, sf_dir)
    return elements, citations.build_citation_groups(elements)


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.match_segments(*_groups(spark, sf_dir))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(*_groups(spark, sf_dir))


def elements_by_type(spark, sf_dir):
    return _elements(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


def normalize_ws(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "ln", X.normalise(F.col("line")).alias("normalised"))


def terminal_punct(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(X.is_terminal(F.col("line"))).alias("n_terminal"))


def speaker_turn(spark, sf_dir):
    return _elements(spark, sf_dir).where(X.is_speaker_turn(F.col("text"))).select("doc_id", "position", "type")


def noise_filter(spark, sf_dir):
    return _lines(spark, sf_dir).where(~X.is_noise(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


def _texts(spark, sf_dir):
    return _elements(spark, sf_dir).where("text is not null")


def citation_predicate(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", "position", X.is_citation(F.col("text")).alias("cited"), X.is_citation_only(F.col("text")).alias("cited_only"))


def citation_marker_count(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", "position", X.citation_marker_count(F.col("text")).alias("n_markers"), X.has_year(F.col("text")).alias("dated"))


def trailing_citation(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", "position", X.trailing_citation(F.col("text")).alias("tail")).where("tail is not null")


def citation_parse(spark, sf_dir):
    return _groups(spark, sf_dir)[1].select("doc_id", "citation_id", "source_title", "outlet", "date", "url")


def soft_wrap_merge(spark, sf_dir):
    return _elements(spark, sf_dir).select("doc_id", "position", "type", "text")


def dense_positions(spark, sf_dir):
    return _elements(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last_position"), F.count_distinct("position").alias("n_positions"))


def _image_ids(column):
    return F.array_join(F.transform(column, lambda i: i["image_id"]), "|")


def citation_groups(spark, sf_dir):
    return _groups(spark, sf_dir)[1].select("doc_id", "citation_id", "citation_text", _image_ids("images").alias("images"), "position")


def citation_group_image_counts(spark, sf_dir):
    return _groups(spark, sf_dir)[1].groupBy(F.size("images").alias("n_images")).agg(F.count(F.lit(1)).alias("n_groups"))


def segment_matches(spark, sf_dir):
    return _matches(spark, sf_dir).drop("matched_images")


def segment_score_histogram(spark, sf_dir):
    return _matches(spark, sf_dir).groupBy(X.score_label(F.col("match_score")).alias("label"), "segment_type").agg(F.count(F.lit(1)).alias("n"))


def confidence_filter(spark, sf_dir):
    return citations.filter_matches(_matches(spark, sf_dir), "high").select("doc_id", "segment_id", "matched_citation_id")


def run_summary(spark, sf_dir):
    return runs.summarise(_matches(spark, sf_dir))


def quote_blocks(spark, sf_dir):
    after = F.when(F.col("after.type") == "citation", F.col("after.position"))
    return quotes.quote_parts(_elements(spark, sf_dir)).select("doc_id", "quote_start_position", "quote_end_position", after.alias("citation_after"))


def quote_descriptions(spark, sf_dir):
    return quotes.quote_parts(_elements(spark, sf_dir)).where("intro is not null").select("doc_id", "quote_start_position", F.col("intro.position").alias("description_position"))


def quote_links(spark, sf_dir):
    return _links(spark, sf_dir).drop("quote_number", "nearest_image_id")


def nearest_image(spark, sf_dir):
    near = sequence.nearest_image(_elements(spark, sf_dir)).where("type = 'quote' and image_near is not null")
    return near.select("doc_id", "position", "image_near.image_id", F.col("image_near.position").alias("image_position"))


def heading_like_lines(spark, sf_dir):
    """Lines as they are, in capitals, as a part's title, and in capitals with closing punctuation."""
    line = F.col("line")
    forms = F.array(*(F.struct(F.lit(name).alias("form"), text.alias("t")) for name, text in (("plain", line), ("loud", X.capitals(line)), ("part", F.concat(F.lit("Part "), line)), ("closed", F.concat(X.capitals(line), F.lit(".")))) ))
    each = _lines(spark, sf_dir).select("doc_id", "ln", F.explode(forms).alias("f")).select("doc_id", "ln", "f.form", "f.t")
    return each.where(X.is_heading_like(F.col("t"))).select("doc_id", "ln", "form")


def images_by_text(spark, sf_dir):
    return citations.images_by_text(_groups(spark, sf_dir)[1]).select("doc_id", "cited_key", _image_ids("images").alias("images"))


def tokens_content(spark, sf_dir):
    text = F.col("text")
    return _table(spark, sf_dir, "benchmark").select("item_id", F.array_join(S.content_tokens(text), " ").alias("tokens"), F.size(S.content_tokens(text, False)).alias("n_all"))


def jaccard_pairs(spark, sf_dir):
    """Items that share a token meet through it; no pair without one is made."""
    items = _table(spark, sf_dir, "benchmark").select("item_id", S.content_tokens(F.col("text")).alias("k"))
    posted = items.select("item_id", F.size("k").alias("n"), F.explode("k").alias("token"))
    pairs = posted.alias("x").join(posted.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.item_id") < F.col("y.item_id")))
    shared = pairs.groupBy(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m")).agg(F.count(F.lit(1)).alias("both"))
    return shared.select("a", "b", F.round(F.col("both") / (F.col("n") + F.col("m") - F.col("both")), 6).alias("jaccard"))


def query_overlap_topk(spark, sf_dir):
    """The six documents that hold most of an item's tokens: an equi-join on tokens, counted before the ranking."""
    wanted = _table(spark, sf_dir, "benchmark").select("item_id", S.page_tokens(F.col("text")).alias("k")).select("item_id", F.size("k").alias("n"), F.explode("k").alias("token"))
    held = _table(spark, sf_dir, "documents").select("doc_id", F.explode(S.page_tokens(F.col("text"))).alias("token"))
    scored = wanted.join(held, "token").groupBy("item_id", "doc_id").agg(F.round(F.count(F.lit(1)) / F.first("n"), 6).alias("overlap"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("overlap"), "doc_id"))
    return scored.withColumn("rank", rank).where("rank <= 6").select("item_id", "rank", "doc_id", "overlap")


def cosine_topk(spark, sf_dir):
    return nearest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 6)


def page_margin_accept(spark, sf_dir):
    """Page choice with cosines as scores: the rule that ``evidence.accept_pages`` applies."""
    top = nearest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, evidence.SHORTLIST)
    ranked = top.select(F.lit(0).alias("doc_id"), F.col("query_id").alias("citation_id"), F.col("vec_id").alias("page_number"), F.col("cosine").alias("score"), "rank")
    return evidence.accept_pages(ranked).select(F.col("citation_id").alias("query_id"), F.col("page_number").alias("vec_id"), F.col("score").alias("cosine"), F.round("margin", 6).alias("margin"))


def needs_ocr(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where(X.needs_ocr(F.col("text"))).select("doc_id")


def shell_lines(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.count_if(X.is_shell(F.col("line"))).alias("n_shell"), F.count(F.lit(1)).alias("n"))


def span_score(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "ln", F.round(S.boundary_bonus(F.col("line")), 6).alias("bonus"))


def target_groups(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", S.target_groups(F.col("text")).alias("target"))


def run_history_topk(spark, sf_dir):
    log = _table(spark, sf_dir, "events").withColumnRenamed("ts", "created_at").withColumn("run_id", F.col("event_id"))
    return runs.history(log).select("event_id", F.col("created_at").alias("ts"), "event_type")


def latest_run(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("path"), F.col("ts").alias("modified"))
    return runs.latest(log, ["event_type"]).withColumnRenamed("path", "event_id")


def borrow_lookback(spark, sf_dir):
    """Every third link of a document counts as coloured."""
    spans = F.when(F.col("quote_number") % 3 == 1, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    links = _links(spark, sf_dir).withColumn("claim_spans", spans).withColumn("colorization_description_text", F.lit(None).cast("string")).withColumn("colorization_description_position", F.lit(None).cast("int"))
    return sequence.borrow_lookback(links).where("borrowed_text is not null").select("doc_id", "quote_number", "borrowed_text", "borrowed_position")


def quote_part_offsets(spark, sf_dir):
    return render.quote_part_offsets(_links(spark, sf_dir)).select("doc_id", "quote_number", "part_number", "part", "start")


def fingerprint_theta_join(spark, sf_dir):
    """Citations of the fixture against its narrations as pages, by fingerprint."""
    elements, groups = _groups(spark, sf_dir)
    pages = elements.where("text is not null").select("doc_id", F.col("position").alias("page_number"), "text", "image")
    ranked = evidence.rank_pages(evidence.bearing_pages(groups, pages))
    return ranked.select("doc_id", "citation_id", "page_number", "rank", F.round("score", 6).alias("score"))


def fuzzy_coverage(spark, sf_dir):
    """For each link, how far its quote covers its description."""
    unit, span = S.content_tokens(F.col("description_text")), S.content_tokens(F.col("quote_text"))
    return _links(spark, sf_dir).select("doc_id", "quote_id", F.round(S.coverage(unit, span), 6).alias("coverage"), S.fuzzy_matches(unit, span).alias("n_matched"))


def _claims(spark, sf_dir):
    return claim_rows(_links(spark, sf_dir))


def claim_texts(spark, sf_dir):
    """What the checks of units and spans say of each description and quote."""
    rows = claim_rows(_links(spark, sf_dir)).where("n = 5").select("doc_id", "quote_number", F.posexplode(F.array("description_unit", "quote_span_text", "quote_text")).alias("side", "t"))
    t = F.col("t")
    return rows.select(
        "doc_id", "quote_number", "side", S.is_substantive(t).alias("substantive"), S.enough_words(t).alias("enough"), S.is_weak_description(t).alias("weak"), S.is_mappable(t).alias("mappable"),
        S.is_bad_fragment(t).alias("fragment"), S.match_limit(t).alias("match_limit"),
    )


def claim_gates(spark, sf_dir):
    """The gates of a unit and a span, by kind, entity and related evidence."""
    unit, span = S.content_tokens(F.col("description_unit")), S.content_tokens(F.col("quote_span_text"))
    covered = _claims(spark, sf_dir).withColumns({"covered": S.coverage(unit, span), "entity": S.fuzzy_overlap(unit, span), "related": S.is_related(F.col("description_unit"), F.col("quote_span_text"))})
    return covered.select("doc_id", "quote_number", "n", S.passes_kind("entity", F.col("covered")).alias("by_entity"), S.passes_kind("action", F.col("covered")).alias("by_action"), "entity", "related")


def claim_scores(spark, sf_dir):
    """Quality, selection score and dense score of each claim."""
    unit, text = F.col("description_unit"), F.col("quote_span_text")
    scores = {"quality": S.span_quality(unit, text), "selection": S.selection_score(unit, text, F.col("quote_end") - F.col("quote_start")), "dense": S.dense_score(unit, text)}
    return _claims(spark, sf_dir).select("doc_id", "quote_number", "n", *(F.round(v, 6).alias(k) for k, v in scores.items()))


def claim_overlaps(spark, sf_dir):
    """How far a claim overlaps the one before it, over the length of the shorter."""
    order = Window.partitionBy("doc_id", "quote_number").orderBy("n")
    a, b = F.lag("quote_start").over(order), F.lag("quote_end").over(order)
    return _claims(spark, sf_dir).select("doc_id", "quote_number", "n", F.round(S.overlap_ratio(a, b, F.col("quote_start"), F.col("quote_end")), 6).alias("ratio")).where("n > 0")


def group_best_span(spark, sf_dir):
    return claims.best_of_groups(_claims(spark, sf_dir)).select("doc_id", "quote_number", "group_id", "n", "color", "quote_start", "quote_end", F.round("score", 6).alias("score"))


def validated_spans(spark, sf_dir):
    return claims.validate(_claims(spark, sf_dir)).select("doc_id", "quote_number", "number", "group_id", "quote_start", "quote_end", "description_unit", "quote_span_text")


def next_groups(spark, sf_dir):
    return claims.next_group(_claims(spark, sf_dir))


def quoted_phrases(spark, sf_dir):
    """Phrases in quotation marks, put into lines of the documents."""
    w = F.col("w")
    said = F.concat(F.lit('He said "'), F.array_join(F.slice(w, 1, 3), " "), F.lit('" and “'), F.array_join(F.slice(w, 3, 8), " "), F.lit('” or "'), F.upper(F.array_join(F.slice(w, 1, 3), " ")), F.lit('" once ‘'), F.array_join(F.slice(w, 5, 2), " "), F.lit("’"))
    whole = _lines(spark, sf_dir).where(F.length("line").between(40, 110)).withColumn("line", F.replace("line", F.lit("ß"), F.lit("ss")))
    lines = whole.withColumn("w", F.split(F.regexp_replace("line", "[\"'“”‘’]", ""), " ")).select("doc_id", "ln", claims.quoted_phrases(said).alias("phrases"))
    return lines.select("doc_id", "ln", F.posexplode("phrases").alias("number", "phrase"))


def quote_ngram_candidates(spark, sf_dir):
    plain = _links(spark, sf_dir).withColumn("quote_text", F.regexp_replace("quote_text", r"[^A-Za-z0-9_.;, '-]", " "))
    return claims.ngram_windows(plain, "quote_text")


def exact_occurrences(spark, sf_dir):
    """Every place where the first word of a link's quote stands in it, within other words too."""
    word = F.substring_index("quote_text", " ", 1)
    return _links(spark, sf_dir).select("doc_id", "quote_number", F.explode(claims.occurrences(F.col("quote_text"), word)).alias("start"))


def claim_runs(spark, sf_dir):
    """The coloured runs of every quote paragraph, for the claims of the fixture."""
    held = _claims(spark, sf_dir)
    spans_ = held.groupBy("doc_id", "quote_number").agg(F.first("quote_text").alias("quote_text"), F.collect_list(F.struct("quote_start", "quote_end", "color", "group_id")).alias("claim_spans"))
    return render.quote_runs(spans_)


def claim_ner_links(spark, sf_dir):
    """Distinct triples of group, unit and span, for the claims of the fixture."""
    held = _claims(spark, sf_dir)
    links = held.groupBy("doc_id", F.concat(F.lit("quote_"), F.col("quote_number").cast("string")).alias("quote_id")).agg(F.collect_list(F.struct("group_id", "description_unit", "quote_span_text", "quote_start", "color")).alias("claim_spans"))
    return spans.ner_links(links)


def paragraph_kinds(spark, sf_dir):
    """What paragraphs are by class, style and text, and their citations."""
    given = paragraphs(spark, sf_dir).withColumn("text", X.normalise(F.col("text")))
    return html.classify(given).select("doc_id", "position", "paragraph", "tail")


def style_rules(spark, sf_dir):
    """Classes, styles, style names and indents of paragraphs."""
    style = F.col("style")
    margins = {side: F.round(X.css_centimetres(X.style_property(style, f"margin-{side}")), 6).alias(f"{side}_cm") for side in ("left", "right")}
    return paragraphs(spark, sf_dir).select(
        "doc_id", "position", X.is_heading_class(F.col("css_class")).alias("heading"), X.style_property(style, "margin-left").alias("margin"), margins["left"], margins["right"], X.is_indented_style(style).alias("indented"),
        X.is_quote_style_name(F.col("style_name")).alias("quote_name"), X.is_heading_style_name(F.col("style_name")).alias("heading_name"), X.is_indented_points(F.col("left"), F.col("right")).alias("by_points"),
    )


def clipped_texts(spark, sf_dir):
    """Texts as lists show them, and the length of a text read as a duration."""
    return _lines(spark, sf_dir).select("doc_id", "ln", X.clip(F.col("line"), 30).alias("clipped"), X.format_duration(F.length("line").cast("double") * 1.5).alias("took"))


def json_objects(spark, sf_dir):
    """The object within a reply, or nothing where there is none."""
    n = F.col("doc_id") % 3
    reply = F.when(n == 0, F.concat(F.lit('Sure: {"page": '), F.col("doc_id").cast("string"), F.lit(', "confidence": 0.5} done'))).when(n == 1, F.lit("no object")).otherwise(F.concat(F.lit('{"page": '), F.length("text").cast("string"), F.lit("}")))
    found = X.json_object(reply, "page bigint, confidence double")
    return _table(spark, sf_dir, "documents").select("doc_id", found["page"].alias("page"), found["confidence"].alias("confidence"))


def file_digests(spark, sf_dir):
    """The cache keys of files: page content in place of theirs."""
    return _table(spark, sf_dir, "pages").select("page_id", evidence.file_sha1(F.col("html")).alias("source_sha1"))


def evidence_images(spark, sf_dir):
    return render.evidence_images(_groups(spark, sf_dir)[1]).select("doc_id", "text", _image_ids("images").alias("images"))


def page_fingerprints(spark, sf_dir):
    """Numbers, years and acronyms of the citations, and the texts that pages are matched in."""
    marked = evidence.fingerprint(_groups(spark, sf_dir)[1])
    joined = {c: F.array_join(c, "|").alias(c) for c in ("years", "surnames", "doc_numbers", "acronyms", "outlet_phrase")}
    return marked.select("doc_id", "citation_id", "exact", *joined.values(), evidence.citation_query().alias("query"))


def html_paragraphs(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    return html.extract_html(pages).select("doc_id", "position", "type", "text")


def quote_plan(spark, sf_dir):
    """The part of a link that each quote element shows, in document order."""
    elements = _elements(spark, sf_dir)
    return render.match_quote_plan(elements, _links(spark, sf_dir))


def _colored(level):
    def claim_spans(spark, sf_dir):
        return spans.explode_spans(spans.color_claims(_links(spark, sf_dir), level))

    claim_spans.__name__ = f"claim_spans_{level}"
    return claim_spans


def _analysis(spark, sf_dir, level="medium"):
    return assemble.analyse(_elements(spark, sf_dir), level)


def ner_links(spark, sf_dir):
    return spans.ner_links(_analysis(spark, sf_dir).links)


def render_runs(spark, sf_dir):
    return render.quote_runs(_analysis(spark, sf_dir).links)


def render_plan(spark, sf_dir):
    found = _analysis(spark, sf_dir)
    return render.render_plan(found.elements, found.links, found.groups).select("doc_id", "seq", "kind", "text", "anchor", "link")


def assembled_json(spark, sf_dir):
    return assemble.to_json(assemble.assemble(_analysis(spark, sf_dir)))


QUERIES = {
    f.__name__: f
    for f in (
        elements_by_type, normalize_ws, terminal_punct, speaker_turn, noise_filter, citation_predicate, citation_marker_count, trailing_citation, citation_parse,
        soft_wrap_merge, dense_positions, citation_groups, citation_group_image_counts, segment_matches, segment_score_histogram, confidence_filter, run_summary,
        quote_blocks, quote_descriptions, quote_links, nearest_image, heading_like_lines, images_by_text, tokens_content, jaccard_pairs, query_overlap_topk,
        cosine_topk, page_margin_accept, needs_ocr, shell_lines, span_score, target_groups, run_history_topk, latest_run, borrow_lookback, quote_part_offsets,
        claim_texts, claim_gates, claim_scores, claim_overlaps, group_best_span, validated_spans, next_groups, quoted_phrases, quote_ngram_candidates, exact_occurrences, claim_runs, claim_ner_links,
        paragraph_kinds, style_rules, clipped_texts, json_objects, file_digests, evidence_images, page_fingerprints, quote_plan,
        fingerprint_theta_join, fuzzy_coverage, html_paragraphs, *map(_colored, ("minimal", "medium", "maximum", "dense")), ner_links, render_runs, render_plan, assembled_json,
    )
}
