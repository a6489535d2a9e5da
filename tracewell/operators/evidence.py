"""Scanned pages as evidence: fingerprints of citations, the pages that bear them, their ranking and the choice of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.similarity import PAGE_STOPS, cosine, page_tokens, query_overlap
from tracewell.functions.text import YEAR, join_key

# Weights of cosine and overlap, pages shortlisted, what the best must reach and lead by, and a pick's confidence.
COSINE_WEIGHT, OVERLAP_WEIGHT, SHORTLIST, LEAST_SCORE, LEAST_MARGIN, PICKER_CONFIDENCE = 0.78, 0.22, 6, 0.36, 0.04, 0.5

# Further words that are no fingerprint.
FINGERPRINT_STOPS = (
    "after already american article britain british bulletin chapter comment communism communist conference description document eastern egypt egyptian "
    "evidence file francis international journal march middle necessary page papers press report review secret security society sources studies sudan taylor "
    "university vol volume wilson woodrow january february april june july august september october november december"
).split()
# Words left out of an outlet's phrase, and words kept only inside it.
PHRASE_STOPS = "article description evidence page source sources january february march april may june july august september october november december".split()
CONNECTORS = "& and for in of on the to".split()
# Numbers of documents, volumes, pages and chapters.
DOCUMENT_NUMBERS = (
    r"(?i)\b(No\.?\s*\d+[A-Za-z]?)\b",
    r"(?i)\b(Vol\.?\s*\d+[A-Za-z]?)\b",
    r"(?i)\b(pp?\.?\s*\d+[A-Za-z]?(?:\s*[-–]\s*\d+[A-Za-z]?)?)\b",
    r"\b(\d{1,3}/\d{1,3}(?:/\d{1,3})?)\b",
    r"(?i)\b(Chapter\s+\d+[A-Za-z]?)\b",
)


def compact(text: Column) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))


def _variants(tokens: Column) -> Column:
    """Each token normalised, and without its punctuation."""
    named = F.transform(tokens, lambda t: F.array(join_key(t), compact(t)))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(named), lambda t: t != "")))


def title_phrase(text: Column) -> Column:
    """Up to five significant words of a name in lower case, connectors kept inside it."""
    raw = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z&'-]+)"), F.lit(1)), lambda t: F.lower(t))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"))

    def step(at: Column, t: Column) -> Column:
        connects = t.isin(CONNECTORS)
        skips = (at["n"] >= 5) | (~connects & t.isin([*PAGE_STOPS, *PHRASE_STOPS])) | (connects & (F.size(at["kept"]) == 0))
        return F.when(skips, at).otherwise(F.struct(F.array_append(at["kept"], t).alias("kept"), (at["n"] + (~connects).cast("int")).alias("n")))

    kept = F.aggregate(raw, start, step, lambda at: at["kept"])
    last = F.array_max(F.transform(kept, lambda t, i: F.when(~t.isin(CONNECTORS), i + 1)))
    return F.array_join(F.slice(kept, 1, F.coalesce(last, F.lit(0))), " ")


def fingerprint(groups: DataFrame) -> DataFrame:
    """``groups`` with ``exact`` and the token classes ``years``, ``surnames``, ``doc_numbers``, ``acronyms`` and ``outlet_phrase``, each a sorted array."""
    text = F.col("citation_text")
    combined = F.concat_ws(" ", F.nullif("source_title", F.lit("")), F.nullif("outlet", F.lit("")), text)
    proper = r"\b([A-Z][A-Za-z]+(?:[-'][A-Z]?[A-Za-z]+)?)\b"
    stops = F.array(*(F.lit(w) for w in [*PAGE_STOPS, *FINGERPRINT_STOPS]))
    names = F.filter(F.array_distinct(F.transform(F.concat(_all(text, proper), _all(combined, proper)), lambda t: join_key(t))), lambda t: (F.length(compact(t)) >= 3) & ~F.array_contains(stops, t))
    numbers = F.concat(*(_all(text, p) for p in DOCUMENT_NUMBERS))
    acronyms = F.filter(F.array_distinct(_all(text, r"\b([A-Z0-9]{2,6})\b")), lambda t: ~t.rlike(r"^\d+$") & ~F.array_contains(stops, F.lower(t)))
    phrase = F.coalesce(F.nullif(title_phrase(F.col("outlet")), F.lit("")), title_phrase(F.col("source_title")))
    return groups.withColumns({
        "exact": compact(text), "years": F.array_sort(F.array_distinct(_all(text, f"({YEAR})"))), "surnames": _variants(names),
        "doc_numbers": _variants(numbers), "acronyms": F.array_sort(acronyms), "outlet_phrase": _variants(F.array(phrase)),
    })


def page_forms(pages: DataFrame) -> DataFrame:
    """``pages`` with the forms their text is matched in: whole, upper-case, normalised and compact, and the ranked first 2000 characters. An empty text falls back to the image's source."""
    full = F.replace(F.coalesce(F.nullif("text", F.lit("")), F.col("image.src"), F.lit("")), F.lit("\n"), F.lit(" "))
    return pages.withColumn("page_full", full).withColumns({
        "page_upper": F.upper("page_full"), "page_norm": join_key(F.col("page_full")), "page_compact": compact(F.col("page_full")), "page_ranked": F.left("page_full", F.lit(2000)),
    }).withColumn("page_words", F.array_distinct(F.split("page_norm", r"[^\p{L}\p{N}_]+"))).withColumn("page_tokens", page_tokens(F.col("page_ranked")))


def _present(tokens: Column) -> Column:
    """Whether one of the tokens is on the page: plain ones as whole words, others in any form."""
    plain = F.filter(tokens, lambda t: t.rlike(r"\A[a-z0-9]+\z"))
    marked = F.filter(tokens, lambda t: ~t.rlike(r"\A[a-z0-9]+\z"))
    return F.arrays_overlap("page_words", plain) | F.exists(marked, lambda t: ((compact(t) != "") & F.contains(F.col("page_compact"), compact(t))) | F.contains(F.col("page_norm"), t))


def page_bears() -> Column:
    """The join condition of a fingerprint and a page: the whole citation; else a year and one strong class; else, without years, two of them."""
    strong = [_present(F.col(c)) for c in ("surnames", "doc_numbers", "outlet_phrase")] + [F.exists("acronyms", lambda t: F.contains(F.col("page_upper"), t))]
    count = sum((s.cast("int") for s in strong), F.lit(0))
    dated = (F.size("years") > 0) & (F.size("surnames") + F.size("acronyms") + F.size("doc_numbers") + F.size("outlet_phrase") > 0)
    year = F.exists("years", lambda t: F.contains(F.col("page_norm"), t))
    whole = (F.col("exact") != "") & F.contains(F.col("page_compact"), F.col("exact"))
    return whole | F.when(dated, year & (count >= 1)).otherwise(count >= 2)


def bearing_pages(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """Every citation with every page of its document that bears its fingerprint. Citations without years and strong tokens have none.

    An equi-join on the document, so that pairs are made within a document only; the fingerprint is its other condition.
    """
    marked = fingerprint(groups).where(F.size("years") + F.size("surnames") + F.size("acronyms") + F.size("doc_numbers") + F.size("outlet_phrase") > 0)
    # what belongs to one side is computed before the join, not for each pair
    asked = marked.withColumn("query_tokens", page_tokens(citation_query()))
    return asked.join(page_forms(pages).drop("text"), "doc_id").where(page_bears())


def citation_query() -> Column:
    """Title, outlet, date and text of a citation, at most 2000 characters."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("source_title", "outlet", "date", "citation_text")]
    joined = F.concat(parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2], F.lit(" "), parts[3])
    return F.left(F.trim(joined), F.lit(2000))


def token_cosine(a: Column, b: Column) -> Column:
    """The cosine of two token sets as vectors of zeros and ones: the offline stand-in for that of embeddings."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a) * F.size(b))).otherwise(F.lit(0.0))


def rank_pages(pairs: DataFrame, query_vector: Column | None = None, page_vector: Column | None = None, keep: int = SHORTLIST) -> DataFrame:
    """The best pages of each citation: score (weighted cosine and token overlap) and rank, ties to the earlier page. Columns of embeddings may be given; else the cosine is that of the token sets."""
    query, page = F.col("query_tokens"), F.col("page_tokens")
    similar = token_cosine(query, page) if query_vector is None or page_vector is None else cosine(query_vector, page_vector)
    scored = pairs.withColumn("score", COSINE_WEIGHT * similar + OVERLAP_WEIGHT * query_overlap(query, page))
    rank = F.row_number().over(Window.partitionBy("doc_id", "citation_id").orderBy(F.desc("score"), "page_number"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= keep)


def accept_pages(ranked: DataFrame, picks: DataFrame | None = None) -> DataFrame:
    """One page for a citation at most: a provider's pick of enough confidence among the shortlist, else the best if it scores and leads enough.

    ``picks`` has doc_id, citation_id, page_number and confidence.
    """
    second = F.lead("score").over(Window.partitionBy("doc_id", "citation_id").orderBy("rank"))
    led = ranked.withColumn("margin", F.col("score") - F.coalesce(second, F.lit(0.0)))
    clear = (F.col("rank") == 1) & (F.col("score") >= LEAST_SCORE) & (F.col("margin") >= LEAST_MARGIN)
    if picks is None:
        return led.where(clear)
    chosen = picks.where(F.col("confidence") >= PICKER_CONFIDENCE).select("doc_id", "citation_id", "page_number", F.lit(True).alias("_picked"))
    both = led.join(chosen, ["doc_id", "citation_id", "page_number"], "left")
    any_pick = F.coalesce(F.max(F.col("_picked").cast("int")).over(Window.partitionBy("doc_id", "citation_id")), F.lit(0)) == 1
    return both.withColumn("_any", any_pick).where(F.when(F.col("_any"), F.coalesce("_picked", F.lit(False))).otherwise(clear)).drop("_any", "_picked")


def match_pdf_pages(groups: DataFrame, pages: DataFrame, picks: DataFrame | None = None) -> DataFrame:
    """``groups`` with the images of a citation replaced by its page's, where a page is accepted."""
    accepted = accept_pages(rank_pages(bearing_pages(groups, pages)), picks).select("doc_id", "citation_id", F.col("image").alias("_page"))
    joined = groups.join(accepted, ["doc_id", "citation_id"], "left")
    return joined.withColumn("images", F.when(F.col("_page").isNotNull(), F.array("_page")).otherwise(F.col("images"))).select(*groups.columns)


def file_sha1(content: Column) -> Column:
    """The hex SHA-1 of a file's bytes (of a text, in UTF-8; null counts as empty): the key of recognised texts with the page number."""
    return F.sha1(F.coalesce(content.cast("binary"), F.lit(b"")))


def recognised_text(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages whose text layer is too thin, with the cached recognition (source_sha1, page_number, ocr_text); ``missing`` marks those still to be recognised."""
    from tracewell.functions.text import needs_ocr

    thin = pages.withColumn("thin", needs_ocr(F.col("text")))
    found = thin.join(cache, ["source_sha1", "page_number"], "left")
    text = F.when(F.col("thin"), F.coalesce(F.nullif("ocr_text", F.lit("")), F.col("text"))).otherwise(F.col("text"))
    return found.withColumn("missing", F.col("thin") & F.col("ocr_text").isNull()).withColumn("text", text).drop("ocr_text")
