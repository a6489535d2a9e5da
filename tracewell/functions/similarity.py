"""Token sets and the scores of pairs of texts, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.text import WORD, is_shell

# Words that don't count as content of a claim.
CLAIM_STOPS = (
    "the and for from with that this these those was were are is has have had into onto over under than then after before while during about around "
    "against between within party group organization president leader commander minister director vice supreme"
).split()

# Words that don't count when pages are ranked.
PAGE_STOPS = (
    "the and for with from that this are was were into about under over between their there they his her its our your you not but than then "
    "also have has had been being can could would should may might to of in on at as by or an a is it"
).split()

# Words at which a span should neither begin nor end.
WEAK_WORDS = (
    "a an and as because by calling could despite final first for from he her his however in including into is it its last moreover of on or our points "
    "second she since that the their these third those this to try unfortunately was were who which with would"
).split()

# Least token coverage by kind of unit.
KIND_COVERAGE = {"entity": 0.40, "action": 0.55, "relation": 0.55}


def _array(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def content_tokens(text: Column, drop_stops: bool = True) -> Column:
    """The distinct tokens of three letters or more, sorted: lower case, hyphens taken out, apostrophes at the ends too."""
    raw = F.transform(words(F.lower(text)), lambda w: F.replace(F.regexp_replace(w, "^['-]+|['-]+$", ""), F.lit("-"), F.lit("")))
    kept = F.filter(raw, lambda w: F.length(w) >= 3)
    return F.array_sort(F.array_except(kept, _array(CLAIM_STOPS)) if drop_stops else F.array_distinct(kept))


def page_tokens(text: Column) -> Column:
    """The distinct runs of letters and digits of two characters or more, sorted, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_sort(F.array_except(F.filter(found, lambda w: F.length(w) > 1), _array(PAGE_STOPS)))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def query_overlap(query: Column, candidate: Column) -> Column:
    """How much of the query's token set the candidate has."""
    return _share(F.size(F.array_intersect(query, candidate)), F.size(query))


def tokens_alike(a: Column, b: Column) -> Column:
    """Equal, or both of four letters or more and one inside the other."""
    return (a == b) | ((F.length(a) >= 4) & (F.length(b) >= 4) & (F.contains(a, b) | F.contains(b, a)))


def fuzzy_matches(a: Column, b: Column) -> Column:
    """How many tokens of ``a`` find one of ``b`` that is alike, each used once, in sorted order."""
    start = F.struct(F.lit(0).alias("n"), b.alias("left"))

    def take(at: Column, token: Column) -> Column:
        hit = F.get(F.filter(at["left"], lambda o: tokens_alike(token, o)), 0)
        used = F.struct((at["n"] + 1).alias("n"), F.array_remove(at["left"], hit).alias("left"))
        return F.when(hit.isNull(), at).otherwise(used)

    return F.aggregate(a, start, take, lambda at: at["n"])


def fuzzy_overlap(a: Column, b: Column) -> Column:
    """Whether any two tokens are alike."""
    return F.exists(a, lambda x: F.exists(b, lambda y: tokens_alike(x, y)))


def coverage(unit: Column, candidate: Column) -> Column:
    """The share of the unit's tokens that the candidate matches."""
    return F.when((F.size(unit) > 0) & (F.size(candidate) > 0), fuzzy_matches(unit, candidate) / F.size(unit)).otherwise(F.lit(0.0))


def passes_kind(kind: str, covered: Column) -> Column:
    return covered >= KIND_COVERAGE.get(kind, 0.67)


def is_related(a_text: Column, b_text: Column) -> Column:
    """Neither is an attribution, and some token is alike."""
    return ~is_shell(a_text) & ~is_shell(b_text) & fuzzy_overlap(content_tokens(a_text), content_tokens(b_text))


def is_substantive(text: Column) -> Column:
    """Has words, isn't an attribution, and 45 % of its words are content."""
    found = words(text)
    content = F.filter(found, lambda w: ~F.lower(w).isin(CLAIM_STOPS))
    return (F.size(found) > 0) & ~is_shell(text) & (F.size(content) / F.greatest(F.size(found), F.lit(1)) >= 0.45)


def enough_words(text: Column) -> Column:
    """Three words, or two of which one is long or of a learned ending."""
    found = words(text)
    special = F.exists(found, lambda w: (F.length(w) >= 8) | ((F.length(F.regexp_replace(w, "^['-]+|['-]+$", "")) >= 5) & F.lower(F.regexp_replace(w, "^['-]+|['-]+$", "")).rlike("(ism|ist|ists|ization|isation|ology|ocracy|cracy)$")))
    return (F.size(found) >= 3) | ((F.size(found) >= 2) & special)


def is_weak_description(text: Column) -> Column:
    """Under eight words, not substantive, or without a capitalised word of three letters."""
    found = words(text)
    named = F.exists(found, lambda w: (F.length(w) >= 3) & w.rlike("^[A-Z]"))
    return (F.size(found) < 8) | ~is_substantive(text) | ~named


def is_mappable(text: Column) -> Column:
    """A description that the dense level may force a match for."""
    return ~is_weak_description(text) & (F.size(words(text)) >= 5) & is_substantive(text)


def boundary_bonus(text: Column) -> Column:
    """Less for weak words at the ends, a little more for closing punctuation; -1 without words."""
    found = words(text)
    first, last = F.lower(F.get(found, 0)), F.lower(F.element_at(found, -1))
    closed = F.rtrim(F.coalesce(text, F.lit(""))).rlike("[.!?”\"']\\z")
    bonus = F.when(first.isin(WEAK_WORDS), -0.35).otherwise(0.0) + F.when(last.isin(WEAK_WORDS), -0.45).otherwise(0.0) + F.when(closed, 0.08).otherwise(0.0)
    return F.when(F.size(found) == 0, -1.0).otherwise(bonus)


def is_bad_fragment(text: Column) -> Column:
    """Runs over a sentence end, or stops at a weak or joining word."""
    from tracewell.functions.text import normalise

    value = normalise(text)
    last = F.lower(F.element_at(words(value), -1))
    joining = value.rlike(r"(?i)\b(?:and|or|but|because|since|if|when|while|with|for|to|of|in|on|by)\z")
    runs_on = value.rlike(r"[.!?]\s+[a-z]") | (value.rlike(r"[.!?]\s+[A-Z]") & ~value.rlike(r"[.!?]\z"))
    return (F.size(words(value)) == 0) | runs_on | last.isin(WEAK_WORDS) | joining


def span_quality(unit: Column, span: Column) -> Column:
    a, b = content_tokens(unit), content_tokens(span)
    return 0.7 * coverage(a, b) + 0.3 * jaccard(a, b)


def selection_score(unit: Column, span: Column, length: Column) -> Column:
    """Quality and boundaries, less a penalty for length."""
    return span_quality(unit, span) + boundary_bonus(span) - F.least(F.lit(0.35), F.greatest(length, F.lit(1)) / 450)


def dense_score(unit: Column, candidate: Column) -> Column:
    a, b = content_tokens(unit), content_tokens(candidate)
    covered = coverage(a, b)
    gate = passes_kind("entity", covered) | is_related(unit, candidate)
    return 0.60 * covered + 0.22 * jaccard(a, b) + F.when(gate, 0.16).otherwise(0.0) + F.greatest(F.lit(-0.08), F.least(F.lit(0.08), 0.20 * boundary_bonus(candidate)))


def overlap_ratio(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The overlap of two ranges over the length of the shorter."""
    shared = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    return shared / F.greatest(F.lit(1), F.least(a_end - a_start, b_end - b_start))


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors; 0 if either has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def match_limit(quote: Column) -> Column:
    """Highlights of one unit: 3 for up to two lines, 7 up to 90 words, else 12."""
    lines = F.size(F.filter(F.split(quote, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), lambda x: F.trim(x) != ""))
    return F.when(lines.between(1, 2), 3).when(F.size(words(quote)) <= 90, 7).otherwise(12)


def target_groups(description: Column) -> Column:
    """Colour groups aimed at: 5 for five sentences or 120 words, 4 for three or 70, else 2."""
    sentences = F.size(F.filter(F.split(F.coalesce(description, F.lit("")), r"(?<=[.!?;:])\s+"), lambda s: F.trim(s) != ""))
    n = F.size(words(description))
    return F.when((sentences >= 5) | (n >= 120), 5).when((sentences >= 3) | (n >= 70), 4).otherwise(2)
