"""Queries of the training-data operators and, where SQL can express them, their equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import boilerplate, encoding_repair, format_duplicates, lookalikes, mixing, packing, repeated_lines, residue, splitting
from folio.util import table

Query = Callable[[SparkSession, str], DataFrame]


def _lim(spark: SparkSession, d: str) -> dict[str, int]:
    return splitting.limits(table(spark, d, "size_limits"))


def queries() -> dict[str, Query]:
    t = table

    def p7_containers(s: SparkSession, d: str) -> DataFrame:
        return packing.pack(t(s, d, "documents"), _lim(s, d)["container_capacity"])

    def p9_pieces(s: SparkSession, d: str) -> DataFrame:
        lim = _lim(s, d)
        return splitting.split_long(t(s, d, "documents"), lim["piece_limit"], lim["piece_overlap"])

    def p9_found(s: SparkSession, d: str) -> DataFrame:
        lim = _lim(s, d)
        p = splitting.split_long(t(s, d, "documents"), lim["piece_limit"], lim["piece_overlap"], with_text=False)
        return p.where("piece_no = 1 AND n_pieces > 1").select("doc_id").distinct()

    return {
        "p1_found": lambda s, d: encoding_repair.found(t(s, d, "fetched_pages")),
        "p1_restored": lambda s, d: encoding_repair.restore(t(s, d, "fetched_pages"), t(s, d, "raw_captures")),
        "p1_texts": lambda s, d: encoding_repair.repair(t(s, d, "content_extractions"), "text").drop("chains").distinct(),
        "p1_validation": lambda s, d: encoding_repair.validation(t(s, d, "fetched_pages")),
        "p2_found": lambda s, d: boilerplate.found(t(s, d, "content_extractions"), t(s, d, "fetched_pages")),
        "p2_main_text": lambda s, d: boilerplate.main_text(t(s, d, "content_extractions"), t(s, d, "fetched_pages")),
        "p3_found": lambda s, d: repeated_lines.found(t(s, d, "content_extractions"), t(s, d, "fetched_pages")),
        "p3_blocks": lambda s, d: repeated_lines.blocks(t(s, d, "content_extractions"), t(s, d, "fetched_pages"))[0],
        "p3_block_sizes": lambda s, d: repeated_lines.block_sizes(t(s, d, "content_extractions"), t(s, d, "fetched_pages")),
        "p3_removed": lambda s, d: repeated_lines.removed(t(s, d, "content_extractions"), t(s, d, "fetched_pages")),
        "p4_found": lambda s, d: format_duplicates.copies(t(s, d, "catalog_entries")),
        "p4_records": lambda s, d: format_duplicates.collapse(t(s, d, "catalog_entries")),
        "p5_found": lambda s, d: residue.found(t(s, d, "fetched_pages")),
        "p5_kept": lambda s, d: residue.kept(t(s, d, "fetched_pages")),
        "p6_found": lambda s, d: lookalikes.pairs(t(s, d, "catalog_entries"), t(s, d, "chapter_title_matches")),
        "p6_forms": lambda s, d: lookalikes.forms(t(s, d, "catalog_entries"), t(s, d, "chapter_title_matches")),
        "p7_found": lambda s, d: packing.oversized(p7_containers(s, d)),
        "p7_containers": p7_containers,
        "p7_fill": lambda s, d: packing.fill(p7_containers(s, d), _lim(s, d)["container_capacity"]),
        "p8_found": lambda s, d: mixing.rates(t(s, d, "documents"), t(s, d, "mix_targets")).where("short").select("source"),
        "p8_uses": lambda s, d: mixing.uses(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p8_shares": lambda s, d: mixing.report(t(s, d, "documents"), t(s, d, "mix_targets")).select(
            "source", "target_share", F.round("actual_share", 9).alias("actual_share"), "used_tokens", "short"
        ),
        "p9_found": p9_found,
        "p9_pieces": p9_pieces,
        "p9_rebuilt": lambda s, d: splitting.rebuilt(p9_pieces(s, d)).select("doc_id", "n_tokens", "text_md5", (F.col("most") <= _lim(s, d)["piece_limit"]).alias("kept_to_limit")),
    }


_LINES = r"""
WITH p AS (SELECT DISTINCT c.page_id, f.host, c.text FROM content_extractions c JOIN fetched_pages f USING (page_id) WHERE c.text IS NOT NULL AND f.host IS NOT NULL),
l AS (SELECT page_id, host, CAST(i AS INT) AS line_no, lower(trim(regexp_replace(line, '[\s\p{Z}\x1C-\x1F\x{85}]+', ' ', 'g'))) AS n
      FROM (SELECT page_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM p)),
nb AS (SELECT * FROM l WHERE n <> ''),
b AS (SELECT host, count(DISTINCT page_id) AS n_base FROM nb GROUP BY host),
g AS (SELECT host, n, count(DISTINCT page_id) AS k FROM nb GROUP BY host, n),
r AS (SELECT host, n FROM g JOIN b USING (host) WHERE k >= 5 AND k * 10 >= n_base)
"""

# letters that formatting can't change, as in format_duplicates.fold
_FOLD = r"regexp_replace(lower({}), '[\s\p{{Z}}\p{{Cc}}\p{{P}}$+<=>^`|~＄＋＜＝＞＾｀｜～￨]+', '', 'g')"


def _sorted_fields(x: str, split: str) -> str:
    return f"array_to_string(list_sort(list_filter(list_transform(string_split_regex({x}, '{split}'), lambda v: {_FOLD.format('v')}), lambda v: v <> '')), chr(31))"


_COPIES = f"""
WITH k AS (SELECT entry_id, {_sorted_fields('title', '[|｜￨]')} AS kt,
  concat_ws(chr(30), {_FOLD.format("split_part(split_part(url, '#', 1), '?', 1)")},
    {_sorted_fields("regexp_extract(split_part(url, '#', 1), '(?s)^[^?]*[?](.*)$', 1)", '[&;]')},
    {_FOLD.format("regexp_extract(url, '(?s)^[^#]*#(.*)$', 1)")}) AS ku FROM catalog_entries),
g AS (SELECT *, min(entry_id) OVER (PARTITION BY kt, ku) AS keep_id, count(*) OVER (PARTITION BY kt, ku) AS copies FROM k)
"""

_RATES = """
WITH per AS (SELECT source, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS tokens FROM documents GROUP BY source),
tot AS (SELECT CAST(sum(tokens) AS BIGINT) AS total_tokens FROM per),
r AS (SELECT m.source, m.target_share, m.max_repeats, coalesce(p.tokens, 0) AS tokens, m.target_share * total_tokens AS wanted,
  CASE WHEN coalesce(p.tokens, 0) > 0 THEN least(m.target_share * total_tokens / p.tokens, CAST(m.max_repeats AS DOUBLE)) ELSE 0.0 END AS rate
  FROM mix_targets m LEFT JOIN per p USING (source) CROSS JOIN tot),
u AS (SELECT d.doc_id, d.source, CAST(coalesce(strlen(d.text), 0) AS BIGINT) AS tokens,
  CAST(floor(coalesce(rate, 0.0)) AS INT) + CASE WHEN CAST(('0x' || md5('mix-1:' || d.doc_id)[1:8]) AS BIGINT) / 4294967296.0 < coalesce(rate, 0.0) - floor(coalesce(rate, 0.0)) THEN 1 ELSE 0 END AS n_uses
  FROM documents d LEFT JOIN r USING (source))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _LINES + "SELECT DISTINCT page_id, line_no FROM nb JOIN r USING (host, n)",
        "p3_block_sizes": _LINES.replace("WITH", "WITH RECURSIVE", 1) + """, s AS (SELECT DISTINCT l.page_id, l.host, l.n, row_number() OVER (PARTITION BY page_id, text_no ORDER BY line_no) AS seq FROM
    (SELECT DISTINCT nb.*, dense_rank() OVER (ORDER BY t.text) AS text_no FROM nb JOIN (SELECT DISTINCT page_id, text FROM content_extractions WHERE text IS NOT NULL) t USING (page_id)) l),
h AS (SELECT s.* FROM s JOIN r USING (host, n)),
e0 AS (SELECT a.host, a.n AS a, b.n AS b FROM h a JOIN h b ON a.page_id = b.page_id AND b.seq = a.seq + 1 GROUP BY a.host, a.n, b.n HAVING count(*) >= 5),
e AS (SELECT host, a, b FROM e0 UNION SELECT host, b, a FROM e0 UNION SELECT host, n, n FROM r),
reach AS (SELECT host, a, b FROM e UNION SELECT x.host, x.a, e.b FROM reach x JOIN e ON e.host = x.host AND e.a = x.b),
c AS (SELECT host, a, min(b) AS root FROM reach GROUP BY host, a),
z AS (SELECT host, root, count(*) AS n_lines FROM c GROUP BY host, root)
SELECT host, n_lines, count(*) AS n_blocks FROM z GROUP BY host, n_lines""",
        "p3_removed": _LINES + """, occ AS (SELECT DISTINCT page_id, line_no FROM nb JOIN r USING (host, n)), c AS (SELECT DISTINCT page_id, text FROM content_extractions),
x AS (SELECT page_id, text AS t0, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM c WHERE text IS NOT NULL),
k AS (SELECT x.page_id, t0, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (occ.line_no IS NULL), '') AS kept FROM x LEFT JOIN occ ON occ.page_id = x.page_id AND occ.line_no = x.i GROUP BY x.page_id, t0),
n AS (SELECT page_id, CAST(count(*) AS INT) AS n FROM occ GROUP BY page_id)
SELECT c.page_id, k.kept AS text, coalesce(n.n, 0) AS n_removed FROM c LEFT JOIN k ON k.page_id = c.page_id AND k.t0 = c.text LEFT JOIN n ON n.page_id = c.page_id""",
        "p4_found": _COPIES + "SELECT DISTINCT keep_id, entry_id AS copy_id FROM g WHERE entry_id <> keep_id",
        "p4_records": _COPIES + "SELECT entry_id, copies FROM g WHERE entry_id = keep_id",
        "p7_found": "SELECT DISTINCT doc_id FROM documents WHERE strlen(text) > (SELECT tokens FROM size_limits WHERE limit_name = 'container_capacity')",
        "p7_fill": """WITH c AS (SELECT tokens AS cap FROM size_limits WHERE limit_name = 'container_capacity')
SELECT CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS tokens, count(*) FILTER (coalesce(strlen(text), 0) <= cap) AS unsplit, count(*) FILTER (strlen(text) > cap) AS split,
  CAST(0 AS BIGINT) AS containers_over, true AS bound_kept FROM documents, c""",
        "p8_found": _RATES + "SELECT source FROM r WHERE max_repeats * tokens < wanted",
        "p8_uses": _RATES + "SELECT doc_id, source, tokens, CAST(n_uses AS INT) AS n_uses FROM u",
        "p8_shares": _RATES + """SELECT r.source, target_share, round(CAST(coalesce(s.used_tokens, 0) AS DOUBLE) / a.all_used, 9) AS actual_share,
  coalesce(s.used_tokens, 0) AS used_tokens, max_repeats * tokens < wanted AS short
  FROM r LEFT JOIN (SELECT source, CAST(sum(tokens * n_uses) AS BIGINT) AS used_tokens FROM u GROUP BY source) s USING (source)
  CROSS JOIN (SELECT CAST(sum(tokens * n_uses) AS BIGINT) AS all_used FROM u) a""",
        "p9_rebuilt": "SELECT doc_id, CAST(strlen(text) AS INT) AS n_tokens, md5(text) AS text_md5, true AS kept_to_limit FROM documents WHERE strlen(text) > (SELECT tokens FROM size_limits WHERE limit_name = 'piece_limit')",
        "p9_found": "SELECT DISTINCT doc_id FROM documents WHERE strlen(text) > (SELECT tokens FROM size_limits WHERE limit_name = 'piece_limit')",
    }
