"""DuckDB SQL for the registered queries, put together from a few common tables."""

from __future__ import annotations

from siltstone.functions.text import STOP_WORDS, SUFFIXES

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_STEM = "CASE " + " ".join(f"WHEN suffix(x, '{s}') AND length(x) - {len(s)} > 2 THEN left(x, length(x) - {len(s)})" for s in SUFFIXES) + " ELSE x END"

TOKENS = rf"""raw AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[a-z0-9]+(?:[''\-][a-z0-9]+)*') AS w FROM documents),
kept AS (SELECT doc_id, len(w) AS doc_len, list_filter(w, lambda x: length(x) BETWEEN 2 AND 64 AND NOT list_contains({_STOP}, x)) AS k FROM raw),
each AS (SELECT doc_id, doc_len, i - 1 AS position, k[i] AS x FROM (SELECT *, unnest(range(1, len(k) + 1)) AS i FROM kept)),
tok AS (SELECT doc_id, doc_len, position, {_STEM} AS term FROM each),
post AS (SELECT term, doc_id, any_value(doc_len) AS doc_len, count(*) AS tf, list(position ORDER BY position) AS positions FROM tok GROUP BY term, doc_id),
stats AS (SELECT count(*) AS n, sum(len(w)) AS total, sum(len(w)) / count(*) AS avgdl FROM raw),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""


def tokens(select: str) -> str:
    return f"WITH {TOKENS}\n{select}"


def _in(terms: list[str]) -> str:
    return ", ".join(f"'{t}'" for t in terms)


def matches(terms: list[str], every: bool = False, phrase: bool = False, without: list[str] | None = None, zero_length: bool = False) -> str:
    """Tables up to ``m``: doc_id, score, first_ord, matched_terms (joined by commas)."""
    words = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    length = "0" if zero_length else "doc_len"
    more = ""
    if every:
        more += f" AND doc_id IN (SELECT doc_id FROM post WHERE term IN ({_in(terms)}) GROUP BY doc_id HAVING count(*) = {len(set(terms))})"
    if phrase:
        more += " AND doc_id IN (SELECT doc_id FROM (SELECT doc_id, unnest(positions) - o AS start FROM post JOIN q USING (term)) GROUP BY doc_id, start HAVING count(*) = (SELECT count(*) FROM q))"
    if without:
        more += f" AND doc_id NOT IN (SELECT doc_id FROM post WHERE term IN ({_in(without)}))"
    return f"""{TOKENS},
q AS (SELECT * FROM (VALUES {words}) AS v(o, term)),
part AS (SELECT doc_id, o, term, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * {length} / avgdl)) AS part
         FROM q JOIN post USING (term) JOIN df USING (term) CROSS JOIN stats),
m AS (SELECT doc_id, round(sum(part), 6) AS score, min(o) AS first_ord FROM part WHERE true{more} GROUP BY doc_id),
mt AS (SELECT doc_id, string_agg(term, ',' ORDER BY o) AS matched_terms FROM (SELECT doc_id, term, min(o) AS o FROM part GROUP BY doc_id, term) GROUP BY doc_id)"""


def search(terms: list[str], **how) -> str:
    return f"WITH {matches(terms, **how)}\n"


SCORES = "SELECT doc_id, score, first_ord, matched_terms FROM m JOIN mt USING (doc_id)"

_UNESCAPED = "replace(replace(replace(replace({x}, '&quot;', '\"'), '&lt;', '<'), '&amp;', '&'), '&amp', '&')"


def unescaped(x: str) -> str:
    return _UNESCAPED.format(x=x)


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


PAGE_FIELDS = f"""f AS (SELECT page_id, url, trim({unescaped("regexp_extract(html, '<title>(.*?)</title>', 1)")}) AS title, lower(left(regexp_extract(html, '<html lang="([^"]*)"', 1), 2)) AS language,
  {collapsed(unescaped("regexp_extract(html, '<h1>(.*?)</h1>', 1)"))} AS headings,
  {collapsed(unescaped("regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<h1>.*?</h1>', ' '), '<[^>]*>', ' ', 'g')"))} AS body_text FROM pages)"""


def on_pages(query: str) -> str:
    """A query on ``documents`` as one on the full text of all pages that have any."""
    return query.replace("WITH ", f"WITH {PAGE_FIELDS},\ndocuments AS (SELECT page_id AS doc_id, {FULL_TEXT} AS text FROM f WHERE body_text <> ''),\n", 1)


FULL_TEXT = collapsed("concat_ws(' ', title, title, title, headings, body_text)")
#: Normalised URLs of pages and the first page of each.
PAGE_URLS = r"u AS (SELECT regexp_replace(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '\?$', ''), '/+$', '') AS link, * FROM pages)"
#: Links of a page: all start with a slash.
LINKS = r"""list_distinct(list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda h: regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*') || h, '/+$', '')))"""
PROCESSED = tokens("""SELECT sha256(p.link) AS doc_id, p.link AS url, p.title, p.body_text AS clean_text, any_value(c.doc_len)::INT AS token_count, lower(regexp_extract(p.link, '^[a-z]+://([^/?#]*)', 1)) AS domain, 'processed' AS status,
       count(post.term)::INT AS unique_terms, '[' || string_agg('{"term":"' || post.term || '","tf":' || tf || ',"positions":[' || array_to_string(positions, ',') || ']}', ',' ORDER BY positions[1]) || ']' AS tokens
FROM p JOIN kept c ON c.doc_id = p.page_id LEFT JOIN post ON post.doc_id = p.page_id GROUP BY ALL""").replace(
    "WITH ", f"""WITH {PAGE_FIELDS}, {PAGE_URLS},
p AS (SELECT f.*, u.link FROM u JOIN f USING (page_id) WHERE page_id = (SELECT min(page_id) FROM u AS v WHERE v.link = u.link) AND body_text <> ''),
documents AS (SELECT page_id AS doc_id, {FULL_TEXT} AS text FROM p),
""", 1
)
#: The first two levels of a crawl from the first twenty pages, where no link leads to another page.
CRAWLED = f"""WITH {PAGE_URLS}, {PAGE_FIELDS},
s AS (SELECT DISTINCT ON (lower(link)) * FROM (SELECT * FROM u ORDER BY page_id LIMIT 20) ORDER BY page_id),
w AS (SELECT s.page_id AS ord, s.link, f.title, {LINKS.removeprefix("list_distinct").replace("html", "first.html").replace("(url,", "(s.link,")} AS links
      FROM s JOIN u AS first ON first.link = s.link AND first.page_id = (SELECT min(page_id) FROM u AS v WHERE v.link = s.link) JOIN f ON f.page_id = first.page_id),
l AS (SELECT DISTINCT ON (lower(link)) link FROM (SELECT ord, unnest(range(len(links))) AS i, unnest(links) AS link FROM w) ORDER BY ord, i)
SELECT link AS url, 0 AS depth, 'crawled' AS status, title, len(list_distinct(links))::INT AS links FROM w
UNION ALL SELECT link, 1, 'failed', NULL, NULL FROM l WHERE lower(link) NOT IN (SELECT lower(link) FROM s)"""
