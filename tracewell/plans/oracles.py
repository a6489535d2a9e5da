"""SQL for DuckDB that states the registered queries independently of the engine's own plans."""

from __future__ import annotations

from tracewell.functions.similarity import CLAIM_STOPS, PAGE_STOPS, WEAK_WORDS
from tracewell.functions.text import CITATION_MARKERS, NOISE_PHRASES, SHELL_PHRASES


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def markers(x: str) -> str:
    return "(" + " + ".join(f"regexp_matches({x}, {_q('(?i)' + p)})::INTEGER" for p in CITATION_MARKERS) + ")"


def year(x: str) -> str:
    return rf"regexp_matches({x}, '\b(18|19|20)\d\d\b')"


def cited(x: str, parentheses: bool) -> str:
    n = norm(x)
    enclosed = f"(starts_with({n}, '(') AND ends_with({n}, ')') AND length({n}) > 1)"
    inner = f"CASE WHEN {enclosed} THEN trim(substr({n}, 2, length({n}) - 2)) ELSE {n} END"
    commas = f"(length({inner}) - length(replace({inner}, ',', '')))"
    body = f"(({year(inner)} AND ({commas} >= 2 OR {markers(inner)} >= 1)) OR ({commas} >= 2 AND {markers(inner)} >= 2))"
    return f"({body} AND ({inner}) <> '' AND length({n}) <= 2500" + (f" AND {enclosed})" if parentheses else ")")


WORDS = r"""regexp_extract_all(regexp_replace({x}, '[A-Za-z\d_À-ÖØ-öø-ÿœŒ]*[\d_À-ÖØ-öø-ÿœŒ][A-Za-z\d_À-ÖØ-öø-ÿœŒ]*', '', 'g'), '[A-Za-z][A-Za-z''-]*')"""


def heading_like(x: str) -> str:
    n = norm(x)
    words = WORDS.format(x=n)
    titled = f"len(list_filter({words}, lambda w: regexp_matches(w, '^[A-Z]')))"
    return rf"({n} = '' OR regexp_matches({n}, '(?i)^(chapter|section|part)\b') OR (NOT regexp_matches({n}, '[.!?;:]$') AND len({words}) BETWEEN 3 AND 24 AND {titled}::DOUBLE / greatest(len({words}), 1) >= 0.70))"


def tokens(x: str, stops: bool = True) -> str:
    raw = f"list_transform(regexp_extract_all(lower(coalesce({x}, '')), '[a-z][a-z''-]*'), lambda w: replace(trim(w, '''-'), '-', ''))"
    keep = f"length(w) >= 3 AND NOT list_contains({_list(CLAIM_STOPS)}, w)" if stops else "length(w) >= 3"
    return f"list_sort(list_distinct(list_filter({raw}, lambda w: {keep})))"


def page_tokens(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains({_list(PAGE_STOPS)}, w))))"


def shell(x: str) -> str:
    return f"({norm(x)} = '' OR regexp_matches(lower({norm(x)}), {_q('|'.join(f'(?:{p})' for p in SHELL_PHRASES))}))"


LINES = """
lines AS (
  SELECT doc_id, source, ln, trim(raw) AS line FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents
  ) WHERE trim(raw) <> ''
)"""

ARTICLES = LINES + """,
cites AS (
  SELECT *, '(''Report ' || doc_id || ''', ' || source || ' Journal, vol. ' || ((ln + CASE WHEN ln % 8 = 5 THEN 1 ELSE 0 END) % 16) || ', '
    || (1900 + (ln + CASE WHEN ln % 8 = 5 THEN 1 ELSE 0 END) % 16) || CASE WHEN doc_id % 4 = 0 THEN ', https://example.org/r' ELSE '' END || ')' AS cite FROM lines
),
raw AS (
  SELECT doc_id, ln AS position,
    CASE ln % 8 WHEN 0 THEN 'heading' WHEN 3 THEN 'image' WHEN 4 THEN 'quote' WHEN 5 THEN 'quote' WHEN 6 THEN 'citation' ELSE 'narration' END AS type,
    CASE ln % 8 WHEN 2 THEN line || ':' WHEN 3 THEN NULL WHEN 6 THEN cite
      WHEN 5 THEN CASE WHEN doc_id % 3 = 0 THEN line || ' ' || cite WHEN doc_id % 7 = 0 THEN '[Q:] ' || line ELSE line END
      WHEN 0 THEN line WHEN 7 THEN line ELSE line || CASE WHEN doc_id % 2 = 0 THEN ',' ELSE '' END END AS text,
    CASE WHEN ln % 8 = 3 THEN 'img_' || ln END AS image_id
  FROM cites
),
lagged AS (SELECT *, lag(type) OVER w AS ptype, lag(text) OVER w AS ptext FROM raw WINDOW w AS (PARTITION BY doc_id ORDER BY position)),
islands AS (
  SELECT *, sum(CASE WHEN ptype = type AND type IN ('narration', 'quote') AND coalesce(ptext, '') <> '' AND coalesce(text, '') <> ''
      AND NOT regexp_matches(ptext, '[.!?:"]\\s*$') AND NOT (type = 'quote' AND regexp_matches(text, '(?i)^\\s*\\[[QA]\\s*:\\]')) THEN 0 ELSE 1 END)
    OVER (PARTITION BY doc_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS island FROM lagged
),
merged AS (
  SELECT doc_id, min(position) AS first_position, min(type) AS type, string_agg(text, ' ' ORDER BY position) AS text, min(image_id) AS image_id FROM islands GROUP BY doc_id, island
),
elements AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first_position) - 1)::INTEGER AS position, type, text, image_id FROM merged)"""

GROUPS = ARTICLES + r""",
counted AS (SELECT *, coalesce(sum((type = 'citation')::INTEGER) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM elements),
groups AS (
  SELECT doc_id, 'citation_' || (g + 1)::BIGINT AS citation_id, max(text) FILTER (WHERE type = 'citation') AS citation_text,
    coalesce(string_agg(image_id, '|' ORDER BY position) FILTER (WHERE type = 'image'), '') AS images,
    min(position) FILTER (WHERE type = 'image') AS first_image, (max(position) FILTER (WHERE type = 'citation'))::INTEGER AS position
  FROM counted GROUP BY doc_id, g HAVING count(*) FILTER (WHERE type = 'citation') > 0
),
by_text AS (
  SELECT doc_id, lower(""" + norm("citation_text") + r""") AS cited_key, arg_max(citation_id, position) AS citation_id, arg_max(citation_text, position) AS citation_text, max(position) AS position
  FROM groups GROUP BY ALL
)"""

# the citations of the fixture have no nested parentheses
TRAILING = r"CASE WHEN ends_with({n}, ')') AND {ok} THEN regexp_extract({n}, '\([^()]*\)$') END"


def trailing(x: str) -> str:
    found = rf"regexp_extract({norm(x)}, '\([^()]*\)$')"
    return f"CASE WHEN {found} <> '' AND {cited(found, True)} THEN {found} END"


AROUND = GROUPS + """,
nexts AS (
  SELECT *, lead(position) OVER w AS next_position, lead(type) OVER w AS next_type, lag(type) OVER w AS prev_type FROM elements WINDOW w AS (PARTITION BY doc_id ORDER BY position)
),
blocks AS (SELECT *, sum((type = 'quote' AND prev_type IS DISTINCT FROM 'quote')::INTEGER) OVER (PARTITION BY doc_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS b FROM nexts),
bounds AS (
  SELECT doc_id, b AS block, min(position) AS quote_start_position, max(position) AS quote_end_position, arg_max(next_position, position) AS after_position, arg_max(next_type, position) AS after_type
  FROM blocks WHERE type = 'quote' GROUP BY doc_id, b
)"""

MATCHES = AROUND + f""",
segments AS (
  SELECT e.doc_id, e.position, e.type, e.text, CASE WHEN e.type <> 'heading' THEN lower({trailing('e.text')}) END AS cited_key,
    CASE WHEN e.type = 'heading' OR {cited('e.text', True)} THEN NULL
      WHEN e.type = 'quote' THEN CASE WHEN q.after_type = 'citation' THEN q.after_position END
      WHEN e.next_type = 'citation' THEN e.next_position END AS cited_position
  FROM blocks e LEFT JOIN bounds q ON e.type = 'quote' AND q.doc_id = e.doc_id AND q.block = e.b
  WHERE e.type IN ('narration', 'quote', 'heading') AND coalesce(e.text, '') <> '' AND e.doc_id IN (SELECT doc_id FROM groups)
),
matches AS (
  SELECT s.doc_id, 'seg_' || s.position AS segment_id, s.text AS segment_text, s.type AS segment_type, coalesce(t.citation_id, p.citation_id) AS matched_citation_id,
    coalesce(t.citation_text, p.citation_text) AS matched_citation_text,
    CASE WHEN t.citation_id IS NOT NULL THEN 0.92::DOUBLE WHEN p.citation_id IS NOT NULL THEN 0.72::DOUBLE END AS match_score
  FROM segments s LEFT JOIN by_text t ON t.doc_id = s.doc_id AND t.cited_key = s.cited_key LEFT JOIN groups p ON p.doc_id = s.doc_id AND p.position = s.cited_position
)"""

LINKS = AROUND + f""",
intros AS (
  SELECT *, max(CASE WHEN type = 'narration' AND length({norm('text')}) >= 20 AND regexp_matches({norm('text')}, '(:|：)$') THEN position END)
    OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS intro FROM blocks
),
parts AS (
  SELECT doc_id, b AS block, position, trim(text) AS t, {trailing('text')} AS tail, {cited('text', True)} AS only_cited FROM blocks WHERE type = 'quote' AND NOT {heading_like('text')}
),
takes AS (
  SELECT *, count(*) FILTER (WHERE tail IS NOT NULL OR only_cited) OVER (PARTITION BY doc_id, block ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_n FROM parts
),
cuts AS (
  SELECT *, CASE WHEN tail IS NOT NULL AND before_n = 0 THEN regexp_replace(left(t, length(t) - length(tail)), '[ \\t\\n\\r,;:-]+$', '') END AS cut FROM takes WHERE NOT only_cited
),
texts AS (SELECT doc_id, block, string_agg(CASE WHEN coalesce(cut, '') <> '' THEN cut ELSE t END, chr(10) || chr(10) ORDER BY position) AS quote_text, arg_min(tail, position) FILTER (WHERE tail IS NOT NULL) AS inline_citation FROM cuts GROUP BY ALL),
linked AS (
  SELECT o.doc_id, o.quote_start_position, o.quote_end_position, i.intro AS description_position, e.text AS description_text, t.quote_text,
    coalesce(t.inline_citation, p.citation_text) AS citation_text, p.citation_id AS next_id
  FROM bounds o JOIN texts t USING (doc_id, block) JOIN intros i ON i.doc_id = o.doc_id AND i.position = o.quote_start_position AND i.intro IS NOT NULL
  JOIN elements e ON e.doc_id = o.doc_id AND e.position = i.intro LEFT JOIN groups p ON p.doc_id = o.doc_id AND p.position = o.after_position AND o.after_type = 'citation'
),
placed AS (
  SELECT l.*, coalesce(t.citation_id, l.next_id) AS cited_id FROM linked l LEFT JOIN by_text t ON t.doc_id = l.doc_id AND t.cited_key = lower({norm('l.citation_text')}) AND l.citation_text IS NOT NULL
),
nears AS (
  SELECT l.doc_id, l.quote_start_position, arg_min(e.position, (abs(e.position - l.quote_start_position), e.position)) AS near_position
  FROM placed l JOIN elements e ON e.doc_id = l.doc_id AND e.type = 'image' GROUP BY ALL
),
links AS (
  SELECT p.doc_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.quote_start_position)::INTEGER AS quote_number, p.description_text, p.quote_text, p.citation_text, p.description_position::INTEGER AS description_position,
    p.quote_start_position, p.quote_end_position, g.position AS citation_position, coalesce(g.first_image, n.near_position)::INTEGER AS image_position
  FROM placed p LEFT JOIN groups g ON g.doc_id = p.doc_id AND g.citation_id = p.cited_id LEFT JOIN nears n ON n.doc_id = p.doc_id AND n.quote_start_position = p.quote_start_position
)"""

WORDS_OF = "regexp_extract_all(coalesce({x}, ''), '[A-Za-z][A-Za-z''-]*')"
NOT_WORD = r"(?:^|[^A-Za-z0-9_À-ÖØ-öø-ÿŒœ])"


def ws(x: str) -> str:
    return WORDS_OF.format(x=x)


def substantive(x: str) -> str:
    content = f"len(list_filter({ws(x)}, lambda w: NOT list_contains({_list(CLAIM_STOPS)}, lower(w))))"
    return f"(len({ws(x)}) > 0 AND NOT {shell(x)} AND {content}::DOUBLE / greatest(len({ws(x)}), 1) >= 0.45)"


def enough(x: str) -> str:
    bare = "trim(w, '''-')"
    special = f"len(list_filter({ws(x)}, lambda w: length(w) >= 8 OR (length({bare}) >= 5 AND regexp_matches(lower({bare}), '(ism|ist|ists|ization|isation|ology|ocracy|cracy)$'))))"
    return f"(len({ws(x)}) >= 3 OR (len({ws(x)}) >= 2 AND {special} > 0))"


def weak(x: str) -> str:
    return f"(len({ws(x)}) < 8 OR NOT {substantive(x)} OR len(list_filter({ws(x)}, lambda w: length(w) >= 3 AND regexp_matches(w, '^[A-Z]'))) = 0)"


def fragment(x: str) -> str:
    n = norm(x)
    joining = _q(rf"(?i){NOT_WORD}(?:and|or|but|because|since|if|when|while|with|for|to|of|in|on|by)$")
    return rf"(len({ws(n)}) = 0 OR regexp_matches({n}, '[.!?]\s+[a-z]') OR (regexp_matches({n}, '[.!?]\s+[A-Z]') AND NOT regexp_matches({n}, '[.!?]$')) OR list_contains({_list(WEAK_WORDS)}, lower(({ws(n)})[-1])) OR regexp_matches({n}, {joining}))"


def alike(a: str, b: str) -> str:
    return f"({a} = {b} OR (length({a}) >= 4 AND length({b}) >= 4 AND (contains({a}, {b}) OR contains({b}, {a}))))"


def matched(u: str, s: str) -> str:
    """Tokens of u that take one of s each: a fold over u whose state is what is left of s."""
    hit = f"list_filter(acc, lambda o: {alike('o', 'x[1]')})[1]"
    return f"(len({s}) - len(list_reduce(list_prepend({s}, list_transform({u}, lambda t: [t])), lambda acc, x: CASE WHEN {hit} IS NULL THEN acc ELSE list_filter(acc, lambda o: o <> {hit}) END)))"


def covered(u: str, s: str) -> str:
    return f"CASE WHEN len({u}) > 0 AND len({s}) > 0 THEN {matched(u, s)}::DOUBLE / len({u}) ELSE 0 END"


def jaccard(u: str, s: str) -> str:
    return f"CASE WHEN len({u}) > 0 AND len({s}) > 0 THEN len(list_intersect({u}, {s}))::DOUBLE / len(list_distinct(list_concat({u}, {s}))) ELSE 0 END"


def bonus(x: str) -> str:
    first, last = (f"list_contains({_list(WEAK_WORDS)}, lower(({ws(x)})[{i}]))" for i in (1, -1))
    return f"CASE WHEN len({ws(x)}) = 0 THEN -1.0::DOUBLE ELSE CASE WHEN {first} THEN -0.35::DOUBLE ELSE 0 END + CASE WHEN {last} THEN -0.45::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(rtrim({x}), '[.!?”\"'']$') THEN 0.08::DOUBLE ELSE 0 END END"


CLAIMS = LINKS + f""",
voiced AS (
  SELECT doc_id, quote_number, CASE WHEN quote_number % 2 = 0 THEN upper(replace(description_text, 'ß', 'ss')) ELSE description_text END AS description_text,
    CASE WHEN quote_number % 2 = 0 THEN upper(replace(quote_text, 'ß', 'ss')) ELSE quote_text END AS quote_text FROM links
),
ranged AS (
  SELECT v.*, n::INTEGER AS n, least(length(description_text), 40 + 30 * (n % 3))::INTEGER AS description_end, ((n * 13) % greatest(length(quote_text), 1))::INTEGER AS quote_start FROM voiced v, range(6) t(n)
),
claims AS (
  SELECT *, 'g' || (n % 3 + 1) AS group_id, ['YELLOW', 'TURQUOISE', 'BRIGHT_GREEN'][n % 3 + 1] AS color, trim(substr(description_text, 1, description_end)) AS description_unit,
    trim(substr(quote_text, quote_start + 1, quote_end - quote_start)) AS quote_span_text
  FROM (SELECT *, least(length(quote_text), quote_start + 20 + 15 * n)::INTEGER AS quote_end FROM ranged)
),
weighed AS (SELECT *, u_ AS u, s_ AS s, {covered('u_', 's_')} AS cov, {jaccard('u_', 's_')} AS jac, {bonus('quote_span_text')} AS bon
  FROM (SELECT *, {tokens('description_unit')} AS u_, {tokens('quote_span_text')} AS s_ FROM claims)),
judged AS (SELECT *, NOT {shell('description_unit')} AND NOT {shell('quote_span_text')} AND len(list_filter(u, lambda a: len(list_filter(s, lambda b: {alike('a', 'b')})) > 0)) > 0 AS related,
  0.7 * cov + 0.3 * jac + bon - least(0.35::DOUBLE, greatest(quote_end - quote_start, 1)::DOUBLE / 450) AS selection FROM weighed)"""

PARAGRAPHS = ARTICLES + """,
paragraphs AS (
  SELECT doc_id, position::INTEGER AS position, text, ['', 'MsoTitle', 'Style1', 'MsoNormal Heading2', 'x heading1', 'MsoHeading 9', 'subtitle', 'plain'][(position + doc_id) % 8 + 1] AS css_class,
    ['', 'margin-left:36pt;MARGIN-RIGHT:1.0cm', 'margin: 2cm', 'margin-left:0.5cm; margin-right : 0.2in', 'margin-left:0.2in', 'margin-right:1in;margin-left:x', 'margin-left:14pt;margin-right:15pt'][(position + 3 * doc_id) % 7 + 1] AS style,
    ['Normal', 'Intense Quote', 'Heading 1', ' Title ', 'Subtitle', 'quote', 'Body'][(position + 2 * doc_id) % 7 + 1] AS style_name,
    CASE WHEN position % 3 > 0 THEN position % 5 * 5 END AS left_points
  FROM raw WHERE text IS NOT NULL
)"""


def style_value(name: str) -> str:
    pair = f"list_filter(string_split(style, ';'), lambda p: contains(p, ':') AND lower(trim(split_part(p, ':', 1))) = '{name}')[1]"
    return f"trim(substr({pair}, strpos({pair}, ':') + 1))"


def centimetres(name: str) -> str:
    found = rf"regexp_extract(lower({style_value(name)}), '(-?\d+(?:\.\d+)?)(cm|pt|in)', ['n', 'u'])"
    return f"CASE {found}.u WHEN 'cm' THEN {found}.n::DOUBLE WHEN 'pt' THEN {found}.n::DOUBLE / 28.3465::DOUBLE WHEN 'in' THEN {found}.n::DOUBLE * 2.54::DOUBLE END"


INDENTED = f"(coalesce({centimetres('margin-left')} >= 0.5, false) AND coalesce({centimetres('margin-right')} >= 0.5, false))"
HEADED = r"regexp_matches(lower(css_class), '(^|\s)(msotitle|subtitle)(\s|$)|(^|\s)(heading|msoheading)')"

ORACLES = {
    "elements_by_type": f"WITH {ARTICLES} SELECT type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM elements GROUP BY type",
    "normalize_ws": f"WITH {LINES} SELECT doc_id, ln::INTEGER AS ln, {norm('line')} AS normalised FROM lines",
    "terminal_punct": rf"""WITH {LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(line, '[.!?:"]\s*$')) AS n_terminal FROM lines GROUP BY doc_id""",
    "speaker_turn": rf"WITH {ARTICLES} SELECT doc_id, position, type FROM elements WHERE regexp_matches(text, '(?i)^\s*\[[QA]\s*:\]')",
    "noise_filter": f"WITH {LINES} SELECT doc_id, count(*) AS kept FROM lines WHERE NOT regexp_matches(lower(line), {_q('|'.join(p.replace('|', '[|]') for p in NOISE_PHRASES))}) GROUP BY doc_id",
    "citation_predicate": f"WITH {ARTICLES} SELECT doc_id, position, {cited('text', False)} AS cited, {cited('text', True)} AS cited_only FROM elements WHERE text IS NOT NULL",
    "citation_marker_count": f"WITH {ARTICLES} SELECT doc_id, position, {markers('text')} AS n_markers, {year('text')} AS dated FROM elements WHERE text IS NOT NULL",
    "trailing_citation": f"WITH {ARTICLES}, t AS (SELECT doc_id, position, {trailing('text')} AS tail FROM elements WHERE type <> 'image') SELECT * FROM t WHERE tail IS NOT NULL",
    "citation_parse": rf"""WITH {GROUPS}, u AS (SELECT doc_id, citation_id, nullif(regexp_extract(citation_text, 'https?://\S+'), '') AS url, trim(regexp_replace(citation_text, 'https?://\S+', '', 'g'), ' ()') AS clean FROM groups),
p AS (SELECT *, regexp_extract(clean, '''([^'']+)''', 1) AS source_title, list_filter(list_transform(string_split(trim(regexp_replace(clean, '^.*?''[^'']+''', ''), ' ,'), ','), lambda x: trim(x)), lambda x: x <> '') AS rest FROM u)
SELECT doc_id, citation_id, source_title, rest[1] AS outlet, CASE WHEN len(rest) > 1 THEN rest[-1] END AS date, url FROM p""",
    "soft_wrap_merge": f"WITH {ARTICLES} SELECT doc_id, position, type, text FROM elements",
    "dense_positions": f"WITH {ARTICLES} SELECT doc_id, count(*) AS n, max(position) AS last_position, count(DISTINCT position) AS n_positions FROM elements GROUP BY doc_id",
    "citation_groups": f"WITH {GROUPS} SELECT doc_id, citation_id, citation_text, images, position FROM groups",
    "citation_group_image_counts": f"WITH {GROUPS} SELECT n_images, count(*) AS n_groups FROM (SELECT len(list_filter(string_split(images, '|'), lambda x: x <> ''))::INTEGER AS n_images FROM groups) GROUP BY n_images",
    "segment_matches": f"WITH {MATCHES} SELECT * FROM matches",
    "segment_score_histogram": f"WITH {MATCHES} SELECT CASE WHEN match_score >= 0.80 THEN 'high' WHEN match_score >= 0.55 THEN 'review' ELSE 'none' END AS label, segment_type, count(*) AS n FROM matches GROUP BY ALL",
    "confidence_filter": f"WITH {MATCHES} SELECT doc_id, segment_id, matched_citation_id FROM matches WHERE segment_type = 'quote' AND match_score >= 0.80",
    "run_summary": f"WITH {MATCHES} SELECT doc_id, count(*)::INTEGER AS segment_count, (count(*) FILTER (WHERE segment_type = 'quote'))::INTEGER AS quote_count FROM matches GROUP BY doc_id",
    "quote_blocks": f"WITH {AROUND} SELECT doc_id, quote_start_position, quote_end_position, CASE WHEN after_type = 'citation' THEN after_position END AS citation_after FROM bounds",
    "quote_descriptions": f"""WITH {AROUND}, i AS (SELECT o.doc_id, o.quote_start_position, max(e.position)::INTEGER AS description_position FROM bounds o JOIN elements e ON e.doc_id = o.doc_id AND e.position < o.quote_start_position AND e.type = 'narration'
AND length({norm('e.text')}) >= 20 AND regexp_matches({norm('e.text')}, '(:|：)$') GROUP BY ALL) SELECT * FROM i""",
    "quote_links": f"WITH {LINKS} SELECT doc_id, 'quote_' || quote_number AS quote_id, description_text, quote_text, citation_text, description_position, quote_start_position, quote_end_position, citation_position, image_position FROM links",
    "nearest_image": f"""WITH {ARTICLES} SELECT q.doc_id, q.position, arg_min(i.image_id, (abs(i.position - q.position), i.position)) AS image_id, arg_min(i.position, (abs(i.position - q.position), i.position))::INTEGER AS image_position
FROM elements q JOIN elements i ON i.doc_id = q.doc_id AND i.type = 'image' WHERE q.type = 'quote' GROUP BY q.doc_id, q.position""",
    "heading_like_lines": f"""WITH {LINES}, f AS (SELECT doc_id, ln::INTEGER AS ln, unnest(['plain', 'loud', 'part', 'closed']) AS form, unnest([line, upper(line), 'Part ' || line, upper(line) || '.']) AS t FROM lines)
SELECT doc_id, ln, form FROM f WHERE {heading_like('t')}""",
    "images_by_text": f"WITH {GROUPS} SELECT doc_id, lower({norm('citation_text')}) AS cited_key, arg_max(images, position) AS images FROM groups WHERE images <> '' GROUP BY ALL",
    "tokens_content": f"SELECT item_id, array_to_string({tokens('text')}, ' ') AS tokens, len({tokens('text', False)})::INTEGER AS n_all FROM benchmark",
    "jaccard_pairs": f"""WITH t AS (SELECT item_id, {tokens('text')} AS k FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(CASE WHEN len(a.k) > 0 AND len(b.k) > 0 THEN len(list_intersect(a.k, b.k))::DOUBLE / len(list_distinct(list_concat(a.k, b.k))) ELSE 0 END, 6) AS jaccard FROM t a JOIN t b ON a.item_id < b.item_id WHERE len(list_intersect(a.k, b.k)) > 0""",
    "query_overlap_topk": f"""WITH q AS (SELECT item_id, {page_tokens('text')} AS k FROM benchmark), w AS (SELECT item_id, len(k) AS n, unnest(k) AS token FROM q), d AS (SELECT doc_id, unnest({page_tokens('text')}) AS token FROM documents),
s AS (SELECT item_id, doc_id, round(count(*)::DOUBLE / any_value(n), 6) AS overlap FROM w JOIN d USING (token) GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id)::INTEGER AS rank FROM s) WHERE rank <= 6""",
    "cosine_topk": """WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS cosine FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 6""",
    "page_margin_accept": """WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS cosine FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER w AS rank, lead(cosine) OVER w AS second FROM s WINDOW w AS (PARTITION BY query_id ORDER BY cosine DESC, vec_id))
SELECT query_id, vec_id, cosine, round(cosine - coalesce(second, 0), 6) AS margin FROM r WHERE rank = 1 AND cosine >= 0.36 AND round(cosine - coalesce(second, 0), 6) >= 0.04""",
    "needs_ocr": r"""WITH t AS (SELECT doc_id, trim(coalesce(text, '')) AS t FROM documents)
SELECT doc_id FROM t WHERE t = '' OR length(t) < 120 OR len(regexp_extract_all(t, '[A-Za-z0-9]+')) < 24 OR length(regexp_replace(t, '\P{L}', '', 'g'))::DOUBLE / greatest(length(t), 1) < 0.18 OR length(t) - length(replace(t, chr(65533), '')) >= 2""",
    "shell_lines": f"WITH {LINES} SELECT doc_id, count(*) FILTER (WHERE {shell('line')}) AS n_shell, count(*) AS n FROM lines GROUP BY doc_id",
    "span_score": f"""WITH {LINES}, w AS (SELECT doc_id, ln, line, regexp_extract_all(line, '[A-Za-z][A-Za-z''-]*') AS ws FROM lines)
SELECT doc_id, ln::INTEGER AS ln, round(CASE WHEN len(ws) = 0 THEN -1.0::DOUBLE ELSE CASE WHEN list_contains({_list(WEAK_WORDS)}, lower(ws[1])) THEN -0.35::DOUBLE ELSE 0 END + CASE WHEN list_contains({_list(WEAK_WORDS)}, lower(ws[-1])) THEN -0.45::DOUBLE ELSE 0 END
+ CASE WHEN regexp_matches(rtrim(line), '[.!?”"'']$') THEN 0.08::DOUBLE ELSE 0 END END, 6) AS bonus FROM w""",
    "target_groups": r"""WITH t AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z''-]*')) AS n, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?;:])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(10)) <> '')) AS s FROM documents)
SELECT doc_id, CASE WHEN s >= 5 OR n >= 120 THEN 5 WHEN s >= 3 OR n >= 70 THEN 4 ELSE 2 END AS target FROM t""",
    "run_history_topk": "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "latest_run": "SELECT event_type, max(ts) AS modified, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY event_type",
    "borrow_lookback": f"""WITH {LINKS}, f AS (SELECT *, quote_number % 3 = 1 AS spanned FROM links)
SELECT a.doc_id, a.quote_number, arg_max(b.description_text, b.quote_number) AS borrowed_text, max(b.description_position)::INTEGER AS borrowed_position FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.quote_number < a.quote_number AND b.spanned WHERE NOT a.spanned GROUP BY a.doc_id, a.quote_number""",
    "quote_part_offsets": f"""WITH {LINKS}, p AS (SELECT doc_id, quote_number, unnest(string_split(quote_text, chr(10) || chr(10))) AS part, generate_subscripts(string_split(quote_text, chr(10) || chr(10)), 1) - 1 AS n FROM links)
SELECT doc_id, quote_number, n::INTEGER AS part_number, part, (coalesce(sum(length(part) + 2) OVER (PARTITION BY doc_id, quote_number ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS start FROM p""",
    "fuzzy_coverage": f"WITH {LINKS}, t AS (SELECT doc_id, 'quote_' || quote_number AS quote_id, {tokens('description_text')} AS u, {tokens('quote_text')} AS s FROM links) SELECT doc_id, quote_id, round({covered('u', 's')}, 6) AS coverage, {matched('u', 's')}::INTEGER AS n_matched FROM t",
    "claim_texts": f"""WITH {CLAIMS}, t AS (SELECT doc_id, quote_number, unnest([0, 1, 2]) AS side, unnest([description_unit, quote_span_text, quote_text]) AS t FROM claims WHERE n = 5)
SELECT doc_id, quote_number, side, {substantive('t')} AS substantive, {enough('t')} AS enough, {weak('t')} AS weak, NOT {weak('t')} AND len({ws('t')}) >= 5 AND {substantive('t')} AS mappable, {fragment('t')} AS fragment,
  CASE WHEN len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) BETWEEN 1 AND 2 THEN 3 WHEN len({ws('t')}) <= 90 THEN 7 ELSE 12 END AS match_limit FROM t""",
    "claim_gates": f"WITH {CLAIMS} SELECT doc_id, quote_number, n, cov >= 0.40 AS by_entity, cov >= 0.55 AS by_action, len(list_filter(u, lambda a: len(list_filter(s, lambda b: {alike('a', 'b')})) > 0)) > 0 AS entity, related FROM judged",
    "claim_scores": f"""WITH {CLAIMS} SELECT doc_id, quote_number, n, round(0.7 * cov + 0.3 * jac, 6) AS quality, round(selection, 6) AS selection,
  round(0.60 * cov + 0.22 * jac + CASE WHEN cov >= 0.40 OR related THEN 0.16 ELSE 0 END + greatest(-0.08, least(0.08, 0.20 * bon)), 6) AS dense FROM judged""",
    "claim_overlaps": f"""WITH {CLAIMS} SELECT a.doc_id, a.quote_number, a.n, round(greatest(0, least(a.quote_end, b.quote_end) - greatest(a.quote_start, b.quote_start))::DOUBLE / greatest(1, least(a.quote_end - a.quote_start, b.quote_end - b.quote_start)), 6) AS ratio
FROM claims a JOIN claims b ON a.doc_id = b.doc_id AND a.quote_number = b.quote_number AND a.n = b.n + 1""",
    "group_best_span": f"""WITH {CLAIMS}, c AS (SELECT *, count(*) FILTER (WHERE true) OVER () AS all_rows FROM judged)
SELECT doc_id, quote_number, group_id, n, color, quote_start, quote_end, round(selection, 6) AS score FROM c a
WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.doc_id = a.doc_id AND b.quote_number = a.quote_number AND b.group_id = a.group_id AND
  (round(b.selection, 9) > round(a.selection, 9) OR (round(b.selection, 9) = round(a.selection, 9) AND (b.quote_end - b.quote_start, b.quote_start, b.n) < (a.quote_end - a.quote_start, a.quote_start, a.n))))""",
    "validated_spans": f"""WITH {CLAIMS} SELECT doc_id, quote_number, (row_number() OVER (PARTITION BY doc_id, quote_number ORDER BY group_id, quote_start, quote_end) - 1)::INTEGER AS number, group_id, quote_start, quote_end, description_unit, quote_span_text
FROM claims WHERE description_end > 0 AND quote_start < quote_end AND {substantive('description_unit')} AND {enough('description_unit')} AND {substantive('quote_span_text')} AND {enough('quote_span_text')}""",
    "next_groups": f"WITH {CLAIMS} SELECT doc_id, quote_number, count(DISTINCT group_id)::INTEGER AS n_groups, max(substr(group_id, 2)::INTEGER) + 1 AS next_group FROM claims GROUP BY doc_id, quote_number",
    "quoted_phrases": f"""WITH {LINES}, w AS (SELECT doc_id, ln::INTEGER AS ln, string_split(regexp_replace(replace(line, 'ß', 'ss'), '["''“”‘’]', '', 'g'), ' ') AS w FROM lines WHERE length(line) BETWEEN 40 AND 110),
p AS (SELECT doc_id, ln, unnest([0, 1, 2, 3]) AS k, unnest([array_to_string(w[1:3], ' '), array_to_string(w[3:10], ' '), upper(array_to_string(w[1:3], ' ')), array_to_string(w[5:6], ' ')]) AS raw FROM w),
c AS (SELECT doc_id, ln, k, trim({norm('raw')}, '.,;:!?()[]{{}}') AS phrase FROM p WHERE length(raw) BETWEEN 2 AND 120),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ln, lower(phrase) ORDER BY k) AS again FROM c WHERE len({ws('phrase')}) BETWEEN 2 AND 7)
SELECT doc_id, ln, (row_number() OVER (PARTITION BY doc_id, ln ORDER BY k) - 1)::INTEGER AS number, phrase FROM f WHERE again = 1""",
    "quote_ngram_candidates": f"""WITH {LINKS}, q AS (SELECT doc_id, quote_number, regexp_replace(quote_text, '[^A-Za-z0-9_.;, ''-]', ' ', 'g') AS t FROM links),
chars AS (SELECT doc_id, quote_number, t, unnest(range(1, length(t) + 1)) AS i FROM q),
marked AS (SELECT *, regexp_matches(substr(t, i, 1), '[A-Za-z0-9_''-]') AS inside, regexp_matches(substr(t, i, 1), '[.;,]') AS cut, i > 1 AND regexp_matches(substr(t, i - 1, 1), '[A-Za-z0-9_''-]') AS before FROM chars),
numbered AS (SELECT *, sum((inside AND NOT before)::INTEGER) OVER w AS word, sum(cut::INTEGER) OVER w AS clause FROM marked WINDOW w AS (PARTITION BY doc_id, quote_number ORDER BY i ROWS UNBOUNDED PRECEDING)),
words AS (SELECT doc_id, quote_number, any_value(t) AS t, word, any_value(clause) AS clause, min(i) - 1 AS s, max(i) AS e FROM numbered WHERE inside GROUP BY doc_id, quote_number, word HAVING bool_or(regexp_matches(substr(t, i, 1), '[A-Za-z0-9_]'))),
spots AS (SELECT *, row_number() OVER (PARTITION BY doc_id, quote_number, clause ORDER BY s) AS k FROM words),
windows AS (SELECT a.doc_id, a.quote_number, a.t, a.s, b.e FROM spots a JOIN spots b ON a.doc_id = b.doc_id AND a.quote_number = b.quote_number AND a.clause = b.clause AND b.k BETWEEN a.k + 1 AND a.k + 6),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, quote_number ORDER BY s, e) - 1 AS number FROM windows)
SELECT doc_id, quote_number, number::INTEGER AS number, s::INTEGER AS start, e::INTEGER AS "end", substr(t, s + 1, e - s) AS phrase FROM ranked WHERE number < 280""",
    "exact_occurrences": f"""WITH {LINKS}, q AS (SELECT doc_id, quote_number, quote_text AS t, string_split(quote_text, ' ')[1] AS w FROM links), p AS (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM q)
SELECT doc_id, quote_number, (i - 1)::INTEGER AS start FROM p WHERE w <> '' AND starts_with(substr(t, i), w)""",
    "claim_runs": f"""WITH {CLAIMS}, paras AS (
  SELECT doc_id, quote_number, part_number, part, (coalesce(sum(length(part) + 2) OVER (PARTITION BY doc_id, quote_number ORDER BY part_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS at
  FROM (SELECT doc_id, quote_number, unnest(string_split(quote_text, chr(10) || chr(10))) AS part, (generate_subscripts(string_split(quote_text, chr(10) || chr(10)), 1) - 1)::INTEGER AS part_number FROM voiced)
),
chars AS (SELECT *, unnest(range(0, length(part)))::INTEGER AS i FROM paras),
inked AS (SELECT p.doc_id, p.quote_number, p.part_number, p.part, p.i, arg_min({{'c': c.color, 'g': c.group_id, 'n': c.n}}, (greatest(0, c.quote_start - p.at), -least(length(p.part), c.quote_end - p.at), c.group_id, c.n)) FILTER (WHERE c.n IS NOT NULL) AS ink
  FROM chars p LEFT JOIN claims c ON c.doc_id = p.doc_id AND c.quote_number = p.quote_number AND p.at + p.i >= c.quote_start AND p.at + p.i < c.quote_end GROUP BY ALL),
edges AS (SELECT *, (i = 0 OR ink IS DISTINCT FROM lag(ink) OVER w)::INTEGER AS fresh FROM inked WINDOW w AS (PARTITION BY doc_id, quote_number, part_number ORDER BY i)),
patches AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, quote_number, part_number ORDER BY i ROWS UNBOUNDED PRECEDING) AS patch FROM edges)
SELECT doc_id, quote_number, part_number, min(i) AS start, max(i) + 1 AS "end", any_value(ink.c) AS color, any_value(ink.g) AS group_id, substr(any_value(part), min(i) + 1, max(i) + 1 - min(i)) AS run FROM patches GROUP BY doc_id, quote_number, part_number, patch""",
    "claim_ner_links": f"""WITH {CLAIMS}, t AS (SELECT doc_id, 'quote_' || quote_number AS quote_id, group_id, description_unit, quote_span_text, min(quote_start) AS quote_start, min(color) AS color FROM claims GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY doc_id, quote_id ORDER BY quote_start, group_id, description_unit, quote_span_text)::INTEGER AS number FROM t""",
    "paragraph_kinds": f"""WITH {PARAGRAPHS}, k AS (SELECT doc_id, position, {cited('text', True)} AS only_cited, {HEADED} AS headed, contains(lower(css_class), 'style1') OR {INDENTED} AS quoted, {trailing('text')} AS tail FROM paragraphs)
SELECT doc_id, position, CASE WHEN only_cited THEN 'citation' WHEN quoted THEN 'quote' WHEN headed THEN 'heading' ELSE 'narration' END AS paragraph, CASE WHEN NOT only_cited AND NOT headed THEN tail END AS tail FROM k""",
    "style_rules": f"""WITH {PARAGRAPHS} SELECT doc_id, position, {HEADED} AS heading, {style_value('margin-left')} AS margin, round({centimetres('margin-left')}, 6) AS left_cm, round({centimetres('margin-right')}, 6) AS right_cm, {INDENTED} AS indented,
  contains(lower(style_name), 'quote') AS quote_name, regexp_matches(lower(trim(style_name)), '^heading|^(title|subtitle)$') AS heading_name, coalesce(left_points >= 10, false) AS by_points FROM paragraphs""",
    "clipped_texts": f"""WITH {LINES}, t AS (SELECT doc_id, ln::INTEGER AS ln, {norm('line')} AS t, length(line) * 1.5::DOUBLE AS s FROM lines)
SELECT doc_id, ln, CASE WHEN length(t) <= 30 THEN t ELSE rtrim(left(t, 30)) || '…' END AS clipped, CASE WHEN s < 60 THEN printf('%.1f s', s) ELSE (floor(s + 0.5)::BIGINT // 60) || 'm ' || (floor(s + 0.5)::BIGINT % 60) || 's' END AS took FROM t""",
    "json_objects": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id WHEN 2 THEN length(text) END AS page, CASE doc_id % 3 WHEN 0 THEN 0.5::DOUBLE END AS confidence FROM documents",
    "file_digests": "SELECT page_id, sha1(coalesce(html, '')) AS source_sha1 FROM pages",
    "evidence_images": f"""WITH {GROUPS}, i AS (SELECT doc_id, citation_text AS text, position, unnest(string_split(images, '|')) AS image_id, generate_subscripts(string_split(images, '|'), 1) AS k FROM groups WHERE images <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text, image_id ORDER BY position, k) AS again FROM i)
SELECT doc_id, text, string_agg(image_id, '|' ORDER BY position, k) AS images FROM f WHERE again = 1 GROUP BY doc_id, text""",
}
