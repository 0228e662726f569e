"""SQL equivalents of the core's queries, for DuckDB over the same tables."""

from __future__ import annotations

import re

from folio.functions import textclean, titles
from folio.operators import content, evaluate, metadata

_CN = "零〇一二两三四五六七八九十百千万亿"
_NUM = rf"(?:[0-9]+(?:\.[0-9]+)?|[{_CN}]+)"
_GAP = r"[:：\-—_\s　]*"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# -- urls ------------------------------------------------------------------------------------------


def norm_url(u: str) -> str:
    return f"regexp_replace(trim({u}, ' '), '(?s)#.*$', '')"


def path(u: str) -> str:
    return f"regexp_extract(regexp_replace({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*', ''), '^([^?#]*)', 1)"


def directory(u: str) -> str:
    return f"regexp_extract({path(u)}, '(?s)^(.*)/[^/]*$', 1)"


def authority(u: str) -> str:
    return f"nullif(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '')"


def page_no(u: str) -> str:
    query = f"regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1)"
    keys = ", ".join(f"nullif(regexp_extract({query}, '(?i)(?:^|&){k}=([0-9]{{1,4}})(?:&|$)', 1), '')" for k in ("page", "p", "pg", "pageindex", "page_index", "pageno"))
    return (
        f"CAST(coalesce({keys}, nullif(regexp_extract({path(u)}, '(?i)[_-]([0-9]{{1,4}})[.]s?html?$', 1), ''), "
        f"CASE WHEN regexp_matches({path(u)}, '(?i)(?:index|list|catalog|default)[.]s?html?$') THEN '1' END) AS INT)"
    )


def url_sim(a: str, b: str) -> str:
    last = lambda u: f"TRY_CAST(list_last(regexp_extract_all({path(u)}, '[0-9]+')) AS BIGINT)"
    return f"CASE WHEN {directory(a)} <> {directory(b)} THEN 0.0 WHEN coalesce(abs({last(a)} - {last(b)}) = 1, false) THEN 1.0 ELSE 0.5 END"


# -- titles ----------------------------------------------------------------------------------------


def cn_value(x: str) -> str:
    """Value of a well-formed Chinese numeral below ten thousand, by its places."""
    digit = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in titles.CN_DIGITS.items()) + " END"

    def place(unit: str, n: int) -> str:
        d = digit.format(f"regexp_extract({x}, '([一二两三四五六七八九]){unit}', 1)")
        return f"CASE WHEN contains({x}, '{unit}') THEN coalesce({d}, 1) * {n} ELSE 0 END"

    ones = digit.format(f"regexp_extract({x}, '([一二两三四五六七八九])$', 1)")
    return f"nullif({place('千', 1000)} + {place('百', 100)} + {place('十', 10)} + coalesce({ones}, 0), 0)"


def number(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[{_CN}]') THEN CAST({cn_value(x)} AS DOUBLE) ELSE TRY_CAST(nullif({x}, '') AS DOUBLE) END"


_TRIM = q(titles.TRIMMED.replace("\t\r\n", "")) + " || chr(9) || chr(13) || chr(10)"
_SPECIAL = "|".join(sorted(titles.SPECIAL, key=len, reverse=True))


def parse(table: str, keys: str, where: str = "true") -> str:
    """CTEs that parse titles: t_parsed(keys, chapter_number, chapter_type, order_token, confidence, sub_number)."""
    kind = "CASE word " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in titles.SPECIAL.items()) + " END"
    numbered, volume = rf"^第[\s　]*({_NUM})[\s　]*([章节回话篇卷部]){_GAP}(.*)$", rf"^([卷部])[\s　]*({_NUM}){_GAP}(.*)$"
    english = r"(?i)^chapter[\s　]*([0-9]+(?:\.[0-9]+)?)[\s　]*[:：\-—_.\s　]*(.*)$"
    special, loose = rf"^({_SPECIAL})[\s　]*{_GAP}(.*)$", rf"第[\s　]*({_NUM})[\s　]*[章节回话篇卷部]"
    sub = r"^[\s　:：\-—_(（]*([0-9]{1,4})[)）\s　:：\-—_]*$"
    some = "[一二两三四五六七八九十百千万亿0-9]"

    def ok(p: str, i: int) -> str:
        return f"(regexp_matches(t, {q(p)}) AND regexp_matches(regexp_extract(t, {q(p)}, {i}), '{some}'))"

    return f"""
t_clean AS (SELECT *, trim(translate(title, '０１２３４５６７８９．', '0123456789.'), {_TRIM}) AS t FROM {table} WHERE {where}),
t_rule AS (SELECT *, CASE WHEN coalesce(t, '') = '' THEN 0 WHEN {ok(numbered, 1)} THEN 1 WHEN {ok(volume, 2)} THEN 2 WHEN regexp_matches(t, {q(english)}) THEN 3
  WHEN regexp_matches(t, {q(special)}) THEN 4 WHEN {ok(loose, 1)} THEN 5 ELSE 0 END AS rule FROM t_clean),
t_raw AS (SELECT *, CASE rule WHEN 1 THEN regexp_extract(t, {q(numbered)}, 1) WHEN 2 THEN regexp_extract(t, {q(volume)}, 2) WHEN 3 THEN regexp_extract(t, {q(english)}, 1)
  WHEN 4 THEN regexp_extract(trim(regexp_extract(t, {q(special)}, 2)), {q(rf"^({_NUM})(?:[^\p{{L}}\p{{N}}_]|$)")}, 1) WHEN 5 THEN regexp_extract(t, {q(loose)}, 1) END AS raw,
  CASE rule WHEN 1 THEN trim(regexp_extract(t, {q(numbered)}, 3)) WHEN 2 THEN trim(regexp_extract(t, {q(volume)}, 3)) WHEN 3 THEN trim(regexp_extract(t, {q(english)}, 2)) WHEN 4 THEN trim(regexp_extract(t, {q(special)}, 2)) ELSE '' END AS rest,
  CASE rule WHEN 1 THEN regexp_extract(t, {q(numbered)}, 2) WHEN 4 THEN regexp_extract(t, {q(special)}, 1) ELSE '' END AS word FROM t_rule),
t_num AS (SELECT *, CASE WHEN rule > 0 THEN {number('raw')} END AS num, CASE WHEN rule = 1 AND NOT contains(raw, '.') THEN TRY_CAST(nullif(regexp_extract(rest, {q(sub)}, 1), '') AS INT) END AS sub FROM t_raw),
t_parsed AS (SELECT {keys}, CASE WHEN rule > 0 THEN num END AS chapter_number,
  CASE WHEN rule = 0 THEN NULL WHEN rule = 2 OR word IN ('卷', '部') THEN 'volume' WHEN rule = 4 THEN {kind} ELSE 'normal' END AS chapter_type,
  CASE WHEN rule > 0 THEN num + coalesce(sub, 0) / 10000.0 END AS order_token,
  CASE WHEN rule = 0 THEN NULL WHEN rule = 4 THEN CASE WHEN rest = '' THEN 0.90 ELSE 0.85 END WHEN rule = 5 THEN 0.55 WHEN rest = '' THEN 0.95 ELSE 0.92 END AS confidence, sub AS sub_number FROM t_num)
"""


# -- pages -----------------------------------------------------------------------------------------

_ATEXT = "list_transform(regexp_extract_all(html, '(?is)<a\\b[^>]*>(.*?)</a>', 1), lambda x: trim(regexp_replace(x, '(?s)<[^>]*>', '', 'g'), ' '))"
_H1 = "nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>{}</h1>', 1), ' '), '')"
_TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>{}</title>', 1), ' ')"
_LEN = "lens AS (SELECT page_id, max(length(trim(coalesce(text, ''), ' ' || chr(9) || chr(13) || chr(10) || '　'))) AS n FROM content_extractions GROUP BY page_id)"
_NAME = r"lower(regexp_replace(x, '[\s　《》〈〉「」『』【】\[\]()（）·：:，,。.;；''" + r'"' + r"’‘“”!！?？~～\-—_=+*&^%$#@]+', '', 'g'))"
_SEG = r"regexp_split_to_array(regexp_replace({}, '[0-9]+', '#', 'g'), '[|｜_＿\-—·,，;；\s]+')"


def _contains(col: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def _status() -> str:
    rules = [
        ("code IN (404, 410)", "NOT_FOUND", 0.95), ("code = 401", "LOGIN_REQUIRED", 0.80),
        (f"code IN (403, 429, 503) AND (contains(server, 'cloudflare') OR {_contains('low', content.BOT_MARKS)})", "ANTI_BOT", 0.80), ("code IN (403, 429, 503)", "ACCESS_RESTRICTED", 0.70),
        *[(f"n <= 500 AND {_contains('low', words)}", k, c) for k, c, words in content.PHRASES], ("n = 0", "EMPTY_CONTENT", 0.85), ("n < 200 AND starved", "EMPTY_CONTENT", 0.70), ("n < 200", "EMPTY_CONTENT", 0.60), ("starved", "EMPTY_CONTENT", 0.55),
    ]
    a = " ".join(f"WHEN {w} THEN '{k}'" for w, k, _ in rules)
    b = " ".join(f"WHEN {w} THEN {c}" for w, _, c in rules)
    return f"""WITH {_LEN}, p AS (SELECT page_id, coalesce(status_code, 200) AS code, lower(html) AS low, lower(coalesce(headers['server'], '')) AS server, coalesce(n, 0) AS n, host FROM fetched_pages LEFT JOIN lens USING (page_id)),
m AS (SELECT host, floor(median(n)) AS med FROM p WHERE host IS NOT NULL GROUP BY host), s AS (SELECT p.*, coalesce(med >= 1000 AND n < 0.2 * med, false) AS starved FROM p LEFT JOIN m USING (host))
SELECT page_id, CASE {a} ELSE 'CONTENT_OK' END AS status, CAST(CASE {b} ELSE 0.8 END AS DOUBLE) AS confidence FROM s"""


def _template(t: str) -> str:
    noise = "(?i)" + "|".join(metadata.TITLE_NOISE)
    clean = f"trim(regexp_replace(x, {q(noise)}, '', 'g'), ' |＿_-—·,，:：')"
    bad = ", ".join(q(b) for b in metadata.BAD_TITLES)
    parts = r"[|｜_＿\-—－·,，;；\s　]+"
    return f"list_filter(list_transform(regexp_split_to_array({t}, '{parts}'), lambda x: {clean}), lambda x: x <> '' AND lower(x) NOT IN ({bad}))[1]"


def _value(t: str) -> str:
    noise = "(?i)" + "|".join(metadata.TITLE_NOISE)
    c = f"trim(regexp_replace({t}, {q(noise)}, '', 'g'), ' |＿_-—·,，:：')"
    bad = ", ".join(q(b) for b in metadata.BAD_TITLES)
    return f"CASE WHEN {c} <> '' AND lower({c}) NOT IN ({bad}) THEN {c} END"


_KEPT = f"""kept AS (SELECT book_id, norm_url, entry_id, title, url, dom_index FROM (SELECT *, {norm_url('url')} AS norm_url,
  row_number() OVER (PARTITION BY book_id, {norm_url('url')} ORDER BY coalesce(dom_index, -1) DESC, entry_id DESC) AS rn FROM catalog_entries WHERE book_id IS NOT NULL AND url IS NOT NULL) WHERE rn = 1)"""
_SQUEEZE = r"regexp_replace(x, '[\s\p{Z}]+', '', 'g')"
_BLOCKS = r"list_filter(list_transform(regexp_split_to_array(text, '\r?\n[\s　]*\r?\n'), lambda x: trim(x, ' ')), lambda x: x <> '')"
_REC = f"""docs AS (SELECT host AS book_id, page_id AS doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM (SELECT page_id, max(text) AS text FROM content_extractions GROUP BY page_id) JOIN fetched_pages USING (page_id)),
d AS (SELECT book_id, doc_id, text FROM docs WHERE book_id IS NOT NULL AND text IS NOT NULL), n AS (SELECT book_id, count(DISTINCT doc_id) AS n FROM d GROUP BY book_id),
b AS (SELECT DISTINCT book_id, doc_id, unnest(list_transform(list_filter(list_transform({_BLOCKS}, lambda x: {_SQUEEZE}), lambda x: length(x) >= 60), lambda x: md5(x))) AS h FROM d),
rec AS (SELECT book_id, h, count(*) AS n_docs FROM b GROUP BY book_id, h), r AS (SELECT book_id, h, n_docs FROM rec JOIN n USING (book_id) WHERE n >= 3 AND n_docs >= greatest(3, (n + 9) // 10))"""
_EDGES = f"""{_KEPT}, o AS (SELECT book_id, entry_id, row_number() OVER (PARTITION BY book_id ORDER BY dom_index NULLS FIRST, entry_id) AS pos FROM kept), m AS (SELECT * FROM o),
e AS (SELECT book_id, entry_id AS src, lead(entry_id) OVER (PARTITION BY book_id ORDER BY pos) AS dst FROM m)"""


# -- links and lists -------------------------------------------------------------------------------


def _step(step: int) -> str:
    hit = f"there = here + {step}" if step else "false"
    return f"CASE WHEN self THEN 0.0 ELSE greatest(0.0, least(0.95, 0.62 + CASE WHEN same THEN 0.10 ELSE 0.0 END + CASE WHEN there IS NOT NULL AND here IS NOT NULL THEN CASE WHEN {hit} THEN 0.15 ELSE -0.10 END WHEN there IS NOT NULL AND same THEN -0.10 ELSE 0.0 END)) END"


_WS = "' ' || chr(9) || chr(10) || chr(12) || chr(13)"
_NAV = f"""e AS (SELECT entry_id AS page_id, book_id, url, source_page_url, lead(url) OVER w AS nu, lag(url) OVER w AS pu FROM catalog_entries WHERE book_id IS NOT NULL AND url IS NOT NULL WINDOW w AS (PARTITION BY book_id ORDER BY dom_index NULLS FIRST, entry_id)),
a AS (SELECT page_id, url, 0 AS idx, 'NEXT_CHAPTER' AS relation, nu AS target FROM e UNION ALL SELECT page_id, url, 1, 'PREVIOUS_CHAPTER', pu FROM e WHERE page_id % 5 <> 0 UNION ALL SELECT page_id, url, 2, 'CATALOG_LINK', source_page_url FROM e
  UNION ALL SELECT page_id, url, 3, 'NEXT_PAGE', nu FROM e WHERE page_id % 4 = 0 UNION ALL SELECT page_id, url, 4, 'NEXT_PAGE', nu FROM e WHERE page_id % 6 = 0),
tr AS (SELECT page_id, idx, relation, trim(url, {_WS}) AS url, trim(target, {_WS}) AS target FROM a WHERE target IS NOT NULL AND target <> ''),
f AS (SELECT *, {directory('url')} = {directory('target')} AS same, {page_no('url')} AS here, {page_no('target')} AS there, {norm_url('url')} = {norm_url('target')} AS self, rtrim(regexp_replace(url, '/+$', '')) = rtrim(regexp_replace(target, '/+$', '')) AS bare FROM tr),
sc AS (SELECT page_id, idx, relation, target, CAST(CASE idx WHEN 0 THEN {_step(1)} WHEN 1 THEN {_step(-1)} WHEN 2 THEN {_step(0)}
  WHEN 3 THEN CASE WHEN NOT same OR bare THEN 0.0 ELSE greatest(0.0, least(0.95, 0.62 + CASE WHEN here IS NOT NULL AND there IS NOT NULL THEN CASE WHEN there = here + 1 THEN 0.25 ELSE -0.15 END ELSE 0.0 END)) END
  ELSE CASE WHEN same AND there - here = 1 THEN 0.62 ELSE 0.0 END END AS DOUBLE) AS score FROM f),
ids AS (SELECT {norm_url('url')} AS norm, max(page_id) AS to_id FROM e GROUP BY 1),
best AS (SELECT b.*, ids.to_id FROM (SELECT page_id, relation, target, score, row_number() OVER (PARTITION BY page_id, relation ORDER BY score DESC, idx) AS rn FROM sc WHERE score > 0) b LEFT JOIN ids ON ids.norm = {norm_url('b.target')} WHERE rn = 1),
both_ways AS (SELECT n.page_id AS a, n.to_id AS b FROM best n JOIN best p ON n.relation = 'NEXT_CHAPTER' AND p.relation = 'PREVIOUS_CHAPTER' AND p.page_id = n.to_id AND p.to_id = n.page_id)"""
_CHAIN = f"""{_NAV}, x AS (SELECT CASE WHEN relation = 'NEXT_CHAPTER' THEN page_id ELSE to_id END AS src, CASE WHEN relation = 'NEXT_CHAPTER' THEN to_id ELSE page_id END AS dst, score FROM best
  WHERE relation IN ('NEXT_CHAPTER', 'PREVIOUS_CHAPTER') AND score >= 0.6 AND to_id <> page_id),
ed AS (SELECT src, dst, max(score) + 0.1 * (count(*) - 1) AS confidence FROM x GROUP BY src, dst),
fwd AS (SELECT src, dst, confidence FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst) AS rn FROM ed) WHERE rn = 1),
bk AS (SELECT dst, src FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY confidence DESC, src) AS rn FROM fwd) WHERE rn = 1),
k AS (SELECT key, bk.src AS up FROM (SELECT src AS key FROM ed UNION SELECT dst FROM ed) LEFT JOIN bk ON bk.dst = key)"""
_CLUSTERS = f"""z AS (SELECT *, min(entry_id) OVER (PARTITION BY source_page_url) AS page_id FROM catalog_entries WHERE source_page_url IS NOT NULL AND url IS NOT NULL), {parse('z', 'page_id, entry_id, title, url, volume', "url <> '' AND length(title) BETWEEN 1 AND 100")},
c AS (SELECT page_id, entry_id AS idx, {directory('url')} AS dir, coalesce(length(volume), 0) AS p2, coalesce(length(volume), 0) % 3 AS p3, 0 AS p4 FROM t_parsed WHERE confidence >= 0.85),
lv AS (SELECT page_id, min(lv) AS lv FROM (SELECT page_id, 1 AS lv FROM c GROUP BY page_id, p2 HAVING count(*) >= 5 UNION ALL SELECT page_id, 2 FROM c GROUP BY page_id, p3 HAVING count(*) >= 5 UNION ALL SELECT page_id, 3 FROM c GROUP BY page_id, p4 HAVING count(*) >= 5) GROUP BY page_id),
kc AS (SELECT page_id, idx, dir, CASE lv WHEN 1 THEN p2 WHEN 2 THEN p3 WHEN 3 THEN p4 ELSE -1 END AS cluster FROM c LEFT JOIN lv USING (page_id)),
dd AS (SELECT page_id, cluster, dir, count(*) AS n, min(idx) AS first FROM kc GROUP BY page_id, cluster, dir),
dz AS (SELECT *, CAST(sum(n) OVER w AS BIGINT) AS size, min(first) OVER w AS first_idx, row_number() OVER (PARTITION BY page_id, cluster ORDER BY n DESC, first) AS rn FROM dd WINDOW w AS (PARTITION BY page_id, cluster)),
cl AS (SELECT page_id, cluster, size, CAST(CASE WHEN size >= 30 THEN 0.55 WHEN size >= 15 THEN 0.45 WHEN size >= 8 THEN 0.30 WHEN size >= 5 THEN 0.20 ELSE 0 END + CASE WHEN dir <> '' AND n >= 0.8 * size THEN 0.10 ELSE 0 END AS DOUBLE) AS score, dir AS dominant_dir, CAST(n AS DOUBLE) / size AS dir_share, first_idx FROM dz WHERE rn = 1)"""
_SETS = """s AS (SELECT host, source_page_url AS doc, list_sort(list(DISTINCT left(title, 2))) AS m FROM catalog_entries WHERE source_page_url IS NOT NULL AND host IS NOT NULL GROUP BY host, source_page_url),
c AS (SELECT *, min(doc) OVER w AS class_id, count(*) OVER w AS n_members FROM s WINDOW w AS (PARTITION BY host, m))"""
_PHRASE_PAGES = ", ".join(f"({-i}, {q(f'<p>- {w} -</p>')})" for i, w in enumerate((w for _, _, words in content.PHRASES for w in words), 1))
_NAV_SPLIT = q(textclean.NAV_SPLIT)
_NAV_WORDS = "[" + ", ".join(map(q, textclean.NAV_TOKENS)) + "]"
_NAV_GLUED = q("^(?:" + "|".join(sorted(map(re.escape, textclean.NAV_TOKENS), key=len, reverse=True)) + ")+$")

SQL: dict[str, str] = {
    "host_link_density": f"SELECT host, count(*) AS n_pages, CAST(sum(len(a)) AS BIGINT) AS n_anchors, CAST(sum(coalesce(list_sum(list_transform(a, lambda x: length(x))), 0)) AS BIGINT) AS anchor_chars FROM (SELECT host, {_ATEXT} AS a FROM fetched_pages) GROUP BY host",
    "url_normalize": f"SELECT entry_id, {norm_url('url')} AS norm_url, {authority('url')} AS authority, {directory('url')} AS dir FROM catalog_entries",
    "url_page_number": f"SELECT entry_id, {page_no('url')} AS page_no FROM catalog_entries",
    "url_pair_similarity": f"""WITH n AS (SELECT entry_id AS b_id, url AS b_url, lag(entry_id) OVER w AS a_id, lag(url) OVER w AS a_url FROM catalog_entries WHERE book_id IS NOT NULL WINDOW w AS (PARTITION BY book_id ORDER BY dom_index NULLS FIRST, entry_id))
SELECT a_id, b_id, CAST({url_sim('a_url', 'b_url')} AS DOUBLE) AS sim FROM n WHERE a_id IS NOT NULL""",
    "anchor_inventory": f"""WITH z AS (SELECT page_id, {_ATEXT} AS t, regexp_extract_all(html, '(?is)<a\\b[^>]*?href="([^"]*)"[^>]*>', 1) AS h FROM fetched_pages), i AS (SELECT *, unnest(range(greatest(len(t), len(h)))) AS dom_index FROM z)
SELECT page_id, CAST(dom_index AS INT) AS dom_index, t[dom_index + 1] AS text, h[dom_index + 1] AS href FROM i""",
    "page_title_pick": f"SELECT page_id, coalesce({_H1.format('(.*?)')}, nullif({_TITLE.format('(.*?)')}, '')) AS title FROM fetched_pages",
    "title_parse": f"WITH {parse('catalog_entries', 'entry_id')} SELECT * FROM t_parsed",
    "strip_suffixes": r"""SELECT match_id, trim(regexp_replace(trim(title), '(?:\s*(?:[（(]\s*(?:第\s*[0-9]+\s*页|[0-9]+\s*/\s*[0-9]+|[0-9]+)\s*[)）]|[_\-][0-9]{1,3}|第\s*[0-9]+\s*页))+\s*$', '')) AS no_page,
regexp_replace(trim(title), '^(第[\s　]*[0-9零〇一二两三四五六七八九十百千万]+[\s　]*[章节回话篇])[\s　:：\-—_(（]*[0-9]{1,4}[)）\s　:：\-—_]*$', '\1') AS no_part,
regexp_matches(title, '[（(]\s*第\s*[0-9]+\s*页\s*[)）]|[（(]\s*[0-9]+\s*/\s*[0-9]+\s*[)）]') AS has_marker FROM chapter_title_matches""",
    "content_status": _status(),
    "phrase_hits": f"WITH p AS (SELECT page_id, html FROM fetched_pages UNION ALL SELECT * FROM (VALUES {_PHRASE_PAGES}) v(page_id, html)) " + " UNION ALL ".join(f"SELECT page_id, '{k}' AS category FROM p WHERE {_contains('lower(html)', words)}" for k, _, words in content.PHRASES),
    "metadata_best": f"""WITH p AS (SELECT page_id, {_value(_H1.format('([^<]*)'))} AS a, {_template(_TITLE.format('([^<]*)'))} AS b FROM fetched_pages)
SELECT page_id, coalesce(a, b) AS title, CASE WHEN a IS NOT NULL THEN 'h1' WHEN b IS NOT NULL THEN 'title' END AS source, CAST(CASE WHEN a IS NOT NULL THEN 0.65 WHEN b IS NOT NULL THEN 0.45 END AS DOUBLE) AS confidence FROM p""",
    "fingerprint_jaccard": f"""WITH m AS (SELECT host, page_id, list_distinct(list_filter(list_transform({_ATEXT}, lambda x: {_NAME}), lambda x: x <> '')) AS m FROM fetched_pages WHERE host IS NOT NULL),
n AS (SELECT page_id AS b_id, m AS b, lag(page_id) OVER w AS a_id, lag(m) OVER w AS a FROM m WINDOW w AS (PARTITION BY host ORDER BY page_id))
SELECT a_id, b_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END AS jaccard FROM n WHERE a_id IS NOT NULL""",
    "tag_signature_similarity": (
        "WITH m AS (SELECT host, page_id, [" + ", ".join(f"len(regexp_extract_all(html, '(?i)<{t}\\b'))" for t in ("a", "aside", "br", "div", "footer", "h1", "li", "nav", "p", "td", "ul")) + "] AS m FROM fetched_pages WHERE host IS NOT NULL), "
        "n AS (SELECT page_id AS b_id, m AS b, lag(page_id) OVER w AS a_id, lag(m) OVER w AS a FROM m WINDOW w AS (PARTITION BY host ORDER BY page_id)) "
        "SELECT a_id, b_id, coalesce(CAST(list_sum(list_transform(list_zip(a, b), lambda x: least(x[1], x[2]))) AS DOUBLE) / nullif(list_sum(list_transform(list_zip(a, b), lambda x: greatest(x[1], x[2]))), 0), 0.0) AS sim FROM n WHERE a_id IS NOT NULL"
    ),
    "list_classes": f"WITH {_SETS} SELECT doc, class_id, n_members FROM c",
    "lists_alike": f"""WITH {_SETS}, r AS (SELECT DISTINCT host, class_id, m FROM c WHERE len(m) > 0), j AS (SELECT a.host AS key, a.class_id AS a_id, b.class_id AS b_id, CAST(len(list_intersect(a.m, b.m)) AS DOUBLE) / len(list_distinct(list_concat(a.m, b.m))) AS jaccard FROM r a JOIN r b ON a.host = b.host AND a.class_id < b.class_id)
SELECT * FROM j WHERE round(jaccard, 9) >= 0.3""",
    "relation_score": f"""WITH {_NAV}, {parse('catalog_entries', 'book_id, entry_id, dom_index, url', 'book_id IS NOT NULL')},
n AS (SELECT entry_id AS b_id, url AS b_url, order_token AS b_t, dom_index AS b_i, lag(entry_id) OVER w AS a_id, lag(url) OVER w AS a_url, lag(order_token) OVER w AS a_t, lag(dom_index) OVER w AS a_i FROM t_parsed WINDOW w AS (PARTITION BY book_id ORDER BY dom_index NULLS FIRST, entry_id)),
nav AS (SELECT page_id AS a_id, to_id AS b_id, max(score) AS nav FROM best WHERE relation = 'NEXT_CHAPTER' AND to_id IS NOT NULL GROUP BY 1, 2), rec AS (SELECT DISTINCT a AS a_id, b AS b_id, 1.0 AS back FROM both_ways),
x AS (SELECT a_id, b_id, CAST(nav AS DOUBLE) AS nav, CAST(back AS DOUBLE) AS back, CASE WHEN b_i > a_i THEN 1.0 WHEN b_i < a_i THEN 0.0 END AS cat, CASE WHEN b_t - a_t IS NULL THEN NULL WHEN b_t - a_t > 0 AND b_t - a_t <= 1 THEN 1.0 WHEN b_t - a_t > 1 THEN 0.4 WHEN b_t - a_t = 0 THEN 0.1 ELSE 0.0 END AS num,
  {url_sim('a_url', 'b_url')} AS same FROM n LEFT JOIN nav USING (a_id, b_id) LEFT JOIN rec USING (a_id, b_id) WHERE a_id IS NOT NULL),
y AS (SELECT *, CAST(CASE WHEN nav IS NOT NULL THEN 0.30 ELSE 0 END + CASE WHEN back IS NOT NULL THEN 0.20 ELSE 0 END + CASE WHEN cat IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN num IS NOT NULL THEN 0.15 ELSE 0 END AS DOUBLE) AS w,
  CAST(coalesce(0.30 * nav, 0) + coalesce(0.20 * back, 0) + coalesce(0.15 * cat, 0) + coalesce(0.15 * num, 0) AS DOUBLE) AS v FROM x), z AS (SELECT *, v / nullif(w, 0) AS s FROM y)
SELECT a_id, b_id, coalesce(s, 0.0) AS score, CASE WHEN s >= 0.6 THEN 'A_BEFORE_B' WHEN s IS NULL OR s >= 0.4 THEN 'UNKNOWN' ELSE 'B_BEFORE_A' END AS direction,
coalesce(s * (0.4 + 0.6 * (w / 0.8)) * CASE WHEN same IS NULL THEN 0.5 ELSE 0.6 + 0.4 * CAST(same AS DOUBLE) END, 0.0) AS confidence FROM z""",
    "nav_best": f"WITH {_NAV} SELECT page_id, relation, target, score FROM best",
    "reciprocal_links": f"WITH {_NAV} SELECT DISTINCT a, b FROM both_ways",
    "chapter_traversal": f"""WITH RECURSIVE {_CHAIN}, w AS (SELECT key, key AS head, CAST(0 AS BIGINT) AS rank FROM k WHERE up IS NULL UNION ALL SELECT k.key, w.head, w.rank + 1 FROM w JOIN k ON k.up = w.key)
SELECT k.key, w.head, w.rank, w.head IS NULL AS broken FROM k LEFT JOIN w USING (key)""",
    "graph_cycles": f"""WITH RECURSIVE {_CHAIN}, w AS (SELECT src AS start, dst AS here FROM fwd UNION SELECT w.start, fwd.dst FROM w JOIN fwd ON fwd.src = w.here WHERE w.here <> w.start) SELECT DISTINCT start AS key FROM w WHERE here = start""",
    "graph_cycle_paths": f"""WITH RECURSIVE {_CHAIN}, w AS (SELECT src AS start, dst AS here FROM fwd UNION SELECT w.start, fwd.dst FROM w JOIN fwd ON fwd.src = w.here WHERE w.here <> w.start),
ring AS (SELECT DISTINCT start AS key FROM w WHERE here = start), low AS (SELECT key, least(key, min(w.here)) AS cycle FROM ring JOIN w ON w.start = ring.key GROUP BY key),
st AS (SELECT key AS cycle, 0 AS step, key FROM low WHERE key = cycle UNION ALL SELECT st.cycle, step + 1, fwd.dst FROM st JOIN fwd ON fwd.src = st.key WHERE fwd.dst <> st.cycle) SELECT cycle, CAST(step AS BIGINT) AS step, key FROM st""",
    "profile_counters": f"""WITH s AS (SELECT host, arg_max(struct_pack(t := title_template, d := chapter_dir), version) AS p FROM site_profiles GROUP BY host),
x AS (SELECT f.host, CASE WHEN len(p.t) > 0 THEN CAST(len(list_intersect({_SEG.format(_TITLE.format('([^<]*)'))}, p.t)) > 0 AS INT) END AS a, CASE WHEN p.d IS NOT NULL THEN CAST({directory('url')} = p.d AS INT) END AS b FROM fetched_pages f JOIN s USING (host)),
y AS (SELECT host, (coalesce(a, 0) + coalesce(b, 0)) / nullif((CASE WHEN a IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN b IS NOT NULL THEN 1 ELSE 0 END), 0) >= 0.5 AS ok FROM x),
n AS (SELECT host, count(*) FILTER (ok) AS h, count(*) FILTER (NOT ok) AS m FROM y GROUP BY host)
SELECT p.host, CAST(coalesce(p.hits, 0) + coalesce(h, 0) AS INT) AS hits, CAST(coalesce(p.misses, 0) + coalesce(m, 0) AS INT) AS misses, coalesce(p.invalidations, 0) AS invalidations FROM site_profiles p LEFT JOIN n USING (host)""",
    "page_walks": f"""WITH RECURSIVE {_KEPT}, x AS (SELECT book_id, norm_url AS u, {page_no('url')} AS no, {directory('url')} AS dir FROM kept WHERE {page_no('url')} IS NOT NULL),
st AS (SELECT a.u AS src, min(b.u) AS dst FROM x a JOIN x b ON a.book_id = b.book_id AND a.dir = b.dir AND b.no = a.no + 1 WHERE a.u <> b.u GROUP BY a.u),
w AS (SELECT DISTINCT norm_url AS start, 1 AS pos, norm_url AS page, [norm_url] AS seen FROM kept UNION ALL SELECT w.start, pos + 1, st.dst, list_append(seen, st.dst) FROM w JOIN st ON st.src = w.page WHERE pos < 20 AND NOT list_contains(seen, st.dst))
SELECT start, pos, page FROM w""",
    "catalog_cluster": f"WITH {_CLUSTERS} SELECT page_id, cluster, size, score, dominant_dir, dir_share, first_idx FROM cl",
    "catalog_detect": f"""WITH {_CLUSTERS}, best AS (SELECT page_id, score AS best, dominant_dir FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, size DESC, first_idx) AS rn FROM cl) WHERE rn = 1),
kp AS (SELECT page_id, cluster, best, sum(size) OVER (PARTITION BY page_id) AS n FROM cl JOIN best USING (page_id, dominant_dir) WHERE score >= 0.20)
SELECT page_id, idx, least(0.95, best + 0.15) AS confidence FROM kc JOIN kp USING (page_id, cluster) WHERE n >= 5""",
    "book_diagnostics": f"""WITH {_KEPT}, {parse('kept', 'book_id')}, t AS (SELECT DISTINCT book_id, CAST(floor(order_token) AS BIGINT) AS n FROM t_parsed WHERE order_token >= 1),
m AS (SELECT book_id, max(n) - min(n) + 1 - count(*) AS missing FROM t GROUP BY book_id), c AS (SELECT book_id, count(*) AS n FROM kept GROUP BY book_id), raw AS (SELECT book_id, count(*) AS raw FROM catalog_entries WHERE book_id IS NOT NULL AND url IS NOT NULL GROUP BY book_id)
SELECT book_id, n, raw - n AS duplicates, CAST(coalesce(missing, 0) AS BIGINT) AS missing, CASE WHEN n = 1 THEN 1 ELSE 0 END AS orphans, false AS broken FROM c JOIN raw USING (book_id) LEFT JOIN m USING (book_id)""",
    "line_kinds": f"""WITH c AS (SELECT DISTINCT page_id, text FROM content_extractions WHERE text IS NOT NULL), l AS (SELECT page_id, regexp_replace(unnest(string_split(text, chr(10))), '^[\\s\\x{{3000}}\\x{{A0}}]+|[\\s\\x{{3000}}\\x{{A0}}]+$', '', 'g') AS line FROM c),
w AS (SELECT page_id, line, lower(line) AS low, list_filter(regexp_split_to_array(lower(line), {_NAV_SPLIT}), lambda x: x <> '') AS tokens FROM l WHERE line <> '')
SELECT page_id, count(*) AS n_lines, count(*) FILTER (length(line) <= 30 AND (list_contains({_NAV_WORDS}, regexp_replace(low, '^' || {_NAV_SPLIT} || '|' || {_NAV_SPLIT} || '$', '', 'g')) OR regexp_matches(low, {_NAV_GLUED}) OR (len(tokens) > 0 AND len(list_filter(tokens, lambda x: NOT list_contains({_NAV_WORDS}, x))) = 0))) AS n_nav,
  count(*) FILTER (length(line) <= 100 AND regexp_matches(line, {q("|".join(textclean.SITE_PROMPTS))})) AS n_prompt, count(*) FILTER (length(line) <= 12 AND regexp_matches(line, '^[0-9\\s　/页第\\-_（()）.]+$')) AS n_number FROM w GROUP BY page_id""",
    "catalog_dominant_dir": f"""WITH g AS (SELECT source_page_url, {directory('url')} AS dir, count(*) AS n, min(struct_pack(a := dom_index, b := entry_id)) AS first FROM catalog_entries WHERE source_page_url IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY source_page_url) AS size, row_number() OVER (PARTITION BY source_page_url ORDER BY n DESC, first) AS rn FROM g)
SELECT source_page_url, CAST(size AS BIGINT) AS size, dir AS dominant_dir, CAST(CASE WHEN size >= 30 THEN 0.55 WHEN size >= 15 THEN 0.45 WHEN size >= 8 THEN 0.30 WHEN size >= 5 THEN 0.20 ELSE 0 END + CASE WHEN dir <> '' AND n >= 0.8 * size THEN 0.10 ELSE 0 END AS DOUBLE) AS score FROM t WHERE rn = 1""",
    "catalog_keep_last": f"WITH {_KEPT} SELECT book_id, norm_url, entry_id, dom_index FROM kept",
    "catalog_direction": f"""WITH {_KEPT}, {parse('kept', 'book_id, entry_id, dom_index')}, e AS (SELECT book_id, order_token AS t, lag(order_token) OVER (PARTITION BY book_id ORDER BY dom_index NULLS FIRST, entry_id) AS b FROM t_parsed WHERE order_token IS NOT NULL),
g AS (SELECT book_id, count(*) AS n_numbered, count(*) FILTER (t > b) AS inc, count(*) FILTER (t < b) AS dec, count(*) FILTER (t = b) AS flat FROM e GROUP BY book_id), h AS (SELECT *, CAST(greatest(inc, dec) AS DOUBLE) / nullif(inc + dec, 0) AS ratio FROM g),
k AS (SELECT *, coalesce(n_numbered >= 3 AND inc + dec >= 2 AND ratio >= 0.85, false) AS sure FROM h)
SELECT book_id, n_numbered, inc, dec, flat, CASE WHEN sure AND inc > dec THEN 'ASCENDING' WHEN sure THEN 'DESCENDING' ELSE 'UNKNOWN' END AS direction, CASE WHEN sure THEN least(0.95, 0.60 + 0.35 * ratio) ELSE least(0.40, coalesce(ratio * 0.4, 0.0)) END AS confidence FROM k""",
    "catalog_segment_rotate": f"""WITH {_KEPT}, {parse('kept', 'book_id, entry_id, dom_index')}, e AS (SELECT book_id, entry_id, CAST(floor(order_token) AS BIGINT) AS t, row_number() OVER (PARTITION BY book_id ORDER BY dom_index NULLS FIRST, entry_id) AS pos FROM t_parsed),
n AS (SELECT *, CASE WHEN t > lag(t) OVER (PARTITION BY book_id ORDER BY pos) THEN 1 ELSE 0 END AS up FROM e WHERE t IS NOT NULL),
s AS (SELECT a.book_id, a.pos FROM n a JOIN n b ON b.book_id = a.book_id AND b.pos = a.pos + 1 WHERE b.t <= a.t - 3
  AND (SELECT count(*) FROM n x WHERE x.book_id = a.book_id AND x.pos <= a.pos) >= 2 AND (SELECT count(*) FROM n x WHERE x.book_id = a.book_id AND x.pos > a.pos) >= 2
  AND (SELECT sum(up) / greatest(1, count(*) - 1) FROM n x WHERE x.book_id = a.book_id AND x.pos <= a.pos) >= 0.95
  AND (SELECT sum(CASE WHEN x.pos > a.pos + 1 THEN up ELSE 0 END) / greatest(1, count(*) - 1) FROM n x WHERE x.book_id = a.book_id AND x.pos > a.pos) >= 0.95
  AND (SELECT max(t) FROM n x WHERE x.book_id = a.book_id AND x.pos > a.pos) <= (SELECT min(t) FROM n x WHERE x.book_id = a.book_id AND x.pos <= a.pos)),
f AS (SELECT book_id, min(pos) AS seam FROM s GROUP BY book_id), c AS (SELECT book_id, count(*) AS n FROM e GROUP BY book_id)
SELECT book_id, entry_id, CAST(pos AS INT) AS pos, CAST(seam AS INT) AS seam, CAST(CASE WHEN seam IS NULL THEN pos WHEN pos > seam THEN pos - seam ELSE pos + n - seam END AS INT) AS new_pos FROM e JOIN c USING (book_id) LEFT JOIN f USING (book_id)""",
    "catalog_gaps": f"""WITH {_KEPT}, {parse('kept', 'book_id')}, t AS (SELECT DISTINCT book_id, CAST(floor(order_token) AS BIGINT) AS n FROM t_parsed WHERE order_token >= 1),
w AS (SELECT book_id, lag(n) OVER (PARTITION BY book_id ORDER BY n) + 1 AS lo, n - 1 AS hi FROM t) SELECT book_id, lo, hi FROM w WHERE lo <= hi""",
    "boilerplate_blocks": f"WITH {_REC} SELECT book_id AS host, h AS block_md5, n_docs FROM r",
    "boilerplate_removed": f"""WITH {_REC}, h AS (SELECT d.doc_id, list(DISTINCT r.h) AS cut FROM (SELECT book_id, doc_id, unnest(list_transform({_BLOCKS}, lambda x: md5({_SQUEEZE}))) AS h FROM d) d JOIN r USING (book_id, h) GROUP BY d.doc_id),
k AS (SELECT o.doc_id, CASE WHEN cut IS NULL THEN text ELSE array_to_string(list_filter({_BLOCKS}, lambda x: NOT list_contains(cut, md5({_SQUEEZE}))), chr(10) || chr(10)) END AS text, cut FROM docs o LEFT JOIN h USING (doc_id))
SELECT doc_id AS page_id, length(text) AS n_left, md5(text) AS text_md5, cut IS NOT NULL AND text = '' AS emptied FROM k""",
    "duplicate_content_pages": r"""WITH p AS (SELECT host, page_id, regexp_replace(text, '[\s\p{Z}]+', '', 'g') AS t FROM content_extractions JOIN fetched_pages USING (page_id) WHERE host IS NOT NULL)
SELECT host, md5(t) AS hash, count(DISTINCT page_id) AS n_pages, min(page_id) AS first_page FROM p WHERE length(t) >= 300 GROUP BY host, md5(t) HAVING count(DISTINCT page_id) > 1""",
    "part_merge": """WITH c AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY order_token NULLS FIRST, match_id) AS pos FROM chapter_title_matches WHERE book_id IS NOT NULL), d AS (SELECT * FROM c),
e AS (SELECT *, CASE WHEN coalesce(sub_number IS NOT NULL AND lag(sub_number) OVER w IS NOT NULL AND floor(chapter_number) = lag(floor(chapter_number)) OVER w AND sub_number > lag(sub_number) OVER w, false) THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY book_id ORDER BY pos)),
f AS (SELECT *, sum(new) OVER (PARTITION BY book_id ORDER BY pos) AS run FROM e)
SELECT book_id, CAST(min(pos) AS INT) AS first_pos, count(*) AS n_parts, arg_min(title, pos) AS title, count(*) > 1 AS merged FROM f GROUP BY book_id, run""",
    "running_median_ok": """WITH c AS (SELECT book_id, n_chars, row_number() OVER (PARTITION BY book_id ORDER BY doc_id) AS pos FROM documents WHERE book_id IS NOT NULL)
SELECT book_id, CAST(pos AS INT) AS pos, n_chars, CAST(floor(median(CASE WHEN n_chars >= 200 THEN n_chars END) OVER (PARTITION BY book_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS BIGINT) AS median_prev FROM c WHERE pos <= 2000""",
    "consecutive_failure_cut": """WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bad FROM events),
s AS (SELECT *, sum(bad) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run FROM r) SELECT user_id, CAST(min(pos) AS INT) AS cut_pos FROM s WHERE run = 3 GROUP BY user_id""",
    "adaptive_pacing": """WITH RECURSIVE r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type = 'error' AS shell FROM events),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS pos, CAST(0.3 AS DOUBLE) AS i, 0 AS streak, 0 AS backoffs FROM (SELECT DISTINCT user_id FROM events) UNION ALL
SELECT f.user_id, r.pos, CASE WHEN shell THEN least(5.0, greatest(i, 0.3) * 2) WHEN streak + 1 >= 6 THEN greatest(0.3, i / 2) ELSE i END, CASE WHEN shell OR streak + 1 >= 6 THEN 0 ELSE streak + 1 END, backoffs + CASE WHEN shell THEN 1 ELSE 0 END FROM f JOIN r ON r.user_id = f.user_id AND r.pos = f.pos + 1)
SELECT user_id, arg_max(i, pos) AS "interval", arg_max(streak, pos) AS streak, arg_max(backoffs, pos) AS backoffs FROM f GROUP BY user_id""",
    "status_counts": "SELECT status_code, count(*) AS n FROM fetched_pages GROUP BY status_code",
    "profile_by_host": f"""WITH p AS (SELECT host, url, {_TITLE.format('([^<]*)')} AS title, list_distinct(list_filter({_ATEXT}, lambda x: x <> '')) AS nav FROM fetched_pages WHERE host IS NOT NULL),
b AS (SELECT host, count(*) AS n_pages FROM p GROUP BY host), sg AS (SELECT host, least(8, count(DISTINCT seg)) AS n FROM (SELECT host, unnest(list_filter({_SEG.format("coalesce(title, '')")}, lambda x: x <> '')) AS seg FROM p) GROUP BY host),
nv AS (SELECT host, t, row_number() OVER (PARTITION BY host ORDER BY c DESC, t) AS r FROM (SELECT host, t, count(*) AS c FROM (SELECT host, unnest(nav) AS t FROM p) GROUP BY host, t)), na AS (SELECT host, string_agg(t, '|' ORDER BY r) AS nav_texts, count(*) AS n FROM nv WHERE r <= 40 GROUP BY host),
dd AS (SELECT host, dir, row_number() OVER (PARTITION BY host ORDER BY count(*) DESC, dir DESC) AS r FROM (SELECT host, {directory('url')} AS dir FROM p) GROUP BY host, dir)
SELECT b.host, n_pages, dir AS chapter_dir, regexp_matches(regexp_extract(dir, '([^/]*)$', 1), '^[0-9]+$') AS chapter_dirname_numeric, CAST(coalesce(sg.n, 0) AS INT) AS n_segments, CAST(coalesce(na.n, 0) AS INT) AS n_nav, nav_texts
FROM b LEFT JOIN sg USING (host) LEFT JOIN na USING (host) LEFT JOIN dd ON dd.host = b.host AND dd.r = 1""",
    "profile_check": f"""WITH s AS (SELECT host, arg_max(struct_pack(t := title_template, d := chapter_dir), version) AS p FROM site_profiles GROUP BY host),
j AS (SELECT page_id, {_SEG.format("coalesce(" + _TITLE.format('([^<]*)') + ", '')")} AS segs, {directory('url')} AS dir, p.t AS t, p.d AS d FROM fetched_pages JOIN s USING (host)),
k AS (SELECT page_id, CASE WHEN len(t) > 0 THEN CAST(list_has_any(segs, t) AS INT) END AS a, CASE WHEN d IS NOT NULL THEN CAST(dir = d AS INT) END AS b FROM j)
SELECT page_id, CAST(coalesce(a, 0) + coalesce(b, 0) AS DOUBLE) / nullif(CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT), 0) AS passed FROM k""",
    "graph_next_edges": f"WITH {_EDGES} SELECT src, dst, CAST(0.9 AS DOUBLE) AS confidence FROM e WHERE dst IS NOT NULL",
    "graph_ends": f"WITH {_EDGES} SELECT entry_id AS key, pos = 1 AS is_head, pos = max(pos) OVER (PARTITION BY book_id) AS is_tail, max(pos) OVER (PARTITION BY book_id) = 1 AS is_orphan FROM m",
    "graph_reading_order": f"WITH {_EDGES} SELECT entry_id AS key, first_value(entry_id) OVER (PARTITION BY book_id ORDER BY pos) AS head, CAST(pos - 1 AS BIGINT) AS rank, false AS broken FROM m",
    "catalog_precision_recall": """WITH p AS (SELECT DISTINCT book_id, title FROM chapter_title_matches WHERE book_id IS NOT NULL), g AS (SELECT DISTINCT book_id, title FROM catalog_entries WHERE book_id IS NOT NULL),
h AS (SELECT count(*) AS h FROM p JOIN g USING (book_id, title)) SELECT 'precision' AS metric, h AS numerator, (SELECT count(*) FROM p) AS denominator, h / nullif((SELECT count(*) FROM p), 0) AS value FROM h
UNION ALL SELECT 'recall', h, (SELECT count(*) FROM g), h / nullif((SELECT count(*) FROM g), 0) FROM h""",
    "metric_rollup": f"""WITH {_LEN}, p AS (SELECT host, encoding, input_kind, status_code, coalesce(n, 0) AS n FROM fetched_pages LEFT JOIN lens USING (page_id)),
s AS (SELECT host, encoding, input_kind, 'has_content' AS metric, CAST(n > 0 AS BIGINT) AS a, CAST(1 AS BIGINT) AS b FROM p UNION ALL SELECT host, encoding, input_kind, 'ok_has_content', CAST(coalesce(status_code = 200 AND n >= 200, false) AS BIGINT), CAST(coalesce(status_code = 200, false) AS BIGINT) FROM p)
SELECT metric, host, encoding, input_kind, CASE WHEN grouping(host) = 0 THEN 'host' WHEN grouping(encoding) = 0 THEN 'encoding' WHEN grouping(input_kind) = 0 THEN 'input_kind' ELSE 'overall' END AS level, CAST(sum(a) AS BIGINT) AS numerator, CAST(sum(b) AS BIGINT) AS denominator, sum(a) / nullif(sum(b), 0) AS value, count(*) AS n
FROM s GROUP BY GROUPING SETS ((metric), (metric, host), (metric, encoding), (metric, input_kind))""",
    "confusion_matrix": (
        f"WITH {parse('chapter_title_matches', 'match_id')}, m AS (SELECT coalesce(c.chapter_type, 'none') AS expected, coalesce(p.chapter_type, 'none') AS predicted FROM chapter_title_matches c JOIN t_parsed p USING (match_id)), "
        "k AS (SELECT unnest(['normal', 'prologue', 'epilogue', 'extra', 'afterword', 'interlude', 'volume', 'none']) AS expected) SELECT expected, "
        + ", ".join(f"count(*) FILTER (predicted = '{c}') AS \"{c}\"" for c in ("normal", "prologue", "epilogue", "extra", "afterword", "interlude", "volume", "none")) + " FROM k LEFT JOIN m USING (expected) GROUP BY expected"
    ),
    "failure_distribution": (
        f"WITH {_LEN}, p AS (SELECT CAST(page_id AS VARCHAR) AS case_id, coalesce(n, 0) AS n, status_code, html FROM fetched_pages LEFT JOIN lens USING (page_id)), "
        "f AS (SELECT case_id, 'FETCH_ERROR' AS category FROM p WHERE status_code >= 400 UNION ALL SELECT case_id, 'ENCODING_ERROR' FROM p WHERE contains(html, '�') UNION ALL SELECT case_id, 'CONTENT_TRUNCATED' FROM p WHERE n < 200 AND status_code = 200), "
        f"k AS (SELECT unnest([{', '.join(q(c) for c in evaluate.TAXONOMY)}]) AS category) "
        "SELECT category, count(case_id) AS n, coalesce(array_to_string(list_sort(list(DISTINCT case_id) FILTER (case_id IS NOT NULL))[1:3], ','), '') AS first_cases FROM k LEFT JOIN f USING (category) GROUP BY category"
    ),
    "safe_filenames": r"""WITH a AS (SELECT entry_id, regexp_replace(regexp_replace(regexp_replace(title, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '^[\s　]+|[\s　]+$', '', 'g'), '[. ]+$', '') AS x FROM catalog_entries), b AS (SELECT entry_id, regexp_replace(x[1:80], '[. ]+$', '') AS x FROM a)
SELECT entry_id, CASE WHEN x = '' THEN '_' WHEN regexp_matches(upper(x), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN '_' || x ELSE x END AS safe FROM b""",
    "export_bodies": """WITH p AS (SELECT page_id, url, coalesce(status_code, 200) AS code, t.text FROM fetched_pages LEFT JOIN (SELECT page_id, max(text) AS text FROM content_extractions GROUP BY page_id) t USING (page_id)),
s AS (SELECT *, CASE code WHEN 200 THEN 'CONTENT_OK' WHEN 404 THEN 'NOT_FOUND' ELSE 'ACCESS_RESTRICTED' END AS st, coalesce(text, '') AS c FROM p),
b AS (SELECT page_id, CASE WHEN st = 'CONTENT_OK' THEN c WHEN trim(c) <> '' THEN c || chr(10) || chr(10) || '【本章状态：' || st || '，未完整收录】' ELSE '【本章未能正常提取】状态：' || st || chr(10) || '源页面：' || coalesce(url, '') || chr(10) || '（受限或异常页不会被当作正文静默保存）' END AS b FROM s)
SELECT page_id, length(b) AS n_chars, md5(b) AS body_md5 FROM b""",
    "capture_requests": "SELECT e.entry_id, c.page_id, c.page_id IS NULL AS out_of_scope FROM catalog_entries e LEFT JOIN (SELECT url, max(page_id) AS page_id FROM fetched_pages GROUP BY url) c USING (url)",
    "captures_latest": f"SELECT norm_url, arg_max(page_id, struct_pack(a := coalesce(received_at, captured_at), b := page_id)) AS page_id FROM (SELECT *, {norm_url('url')} AS norm_url FROM fetched_pages WHERE url IS NOT NULL) GROUP BY norm_url",
    "capture_incomplete": "SELECT page_id, strlen(html) < 3000 OR " + _contains("lower(html)", ("请开启javascript", "请开启 javascript", "enable javascript", "requires javascript", 'id="app"></div>', 'id="root"></div>')) + " AS incomplete FROM fetched_pages",
    "table_violations": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, 'duplicate {k}' AS problem, count(*) AS n FROM (SELECT {k} FROM {t} WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) > 1) UNION ALL SELECT '{t}', 'null {k}', count(*) FROM {t} WHERE {k} IS NULL "
        f"UNION ALL SELECT '{t}', 'dangling {h}', count(*) FROM {t} WHERE {h} IS NOT NULL AND {h} NOT IN (SELECT {h} FROM {o} WHERE {h} IS NOT NULL)"
        for t, k, h, o in (("content_extractions", "page_id", "page_id", "fetched_pages"), ("chapter_title_matches", "match_id", "book_id", "catalog_entries"))
    ),
}
