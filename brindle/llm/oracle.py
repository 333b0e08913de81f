"""DuckDB statements for the queries whose whole result SQL can state."""

from __future__ import annotations

_CANON = """CASE WHEN regexp_matches(x, '^https?://') THEN 'http://' || regexp_replace(lower(regexp_extract(x, '^https?://([^/]*)', 1)), '^www\\.', '') || regexp_replace(x, '^https?://[^/]*', '')
 WHEN starts_with(x, 'AV:') THEN 'http://avelon.example/ont#AV_' || substr(x, 4) WHEN starts_with(x, 'MB:') THEN 'http://morbex.example/obo/MB_' || substr(x, 4)
 WHEN starts_with(x, 'MBL:') THEN 'http://morbex.example/legacy#MB_' || substr(x, 5) ELSE x END"""


def _canon(col: str) -> str:
    x = f"replace(regexp_replace(regexp_replace({col}, '^[\\s<]+', ''), '[\\s>]+$', ''), '%23', '#')"
    return f"nullif((SELECT {_CANON} FROM (SELECT {x} AS x)), '')"


def _words(col: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(regexp_replace(strip_accents(nfc_normalize({col})), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')"


_TOKENS = r"""CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+')) END"""
_SOURCE = r"regexp_replace(trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')), ' ', '_', 'g')"
_BEST = """SELECT src_iri, tgt_iri, max(sapbert_cosine) FILTER (NOT isnan(sapbert_cosine)) AS s FROM candidates WHERE src_iri IS NOT NULL AND tgt_iri IS NOT NULL GROUP BY ALL"""


def _top(n: int) -> str:
    return f"SELECT src_iri, tgt_iri, s, row_number() OVER (PARTITION BY src_iri ORDER BY s DESC, tgt_iri) AS rank FROM ({_BEST}) WHERE s IS NOT NULL QUALIFY rank <= {n}"


_LABELLED = f"""SELECT iri, unnest({_words('label')}) AS term FROM (SELECT DISTINCT iri, label FROM (SELECT src_iri AS iri, src_label AS label FROM candidates UNION ALL SELECT tgt_iri, tgt_label FROM candidates)
 WHERE iri IS NOT NULL AND trim(regexp_replace(label, '\\s+', ' ', 'g')) <> '')"""

_SCORED = f"""SELECT p.src_iri, p.tgt_iri, p.s AS a, u.s AS b, m.s AS c FROM ({_BEST}) p
 LEFT JOIN (SELECT src_iri, tgt_iri, max(graph06_score) FILTER (NOT isnan(graph06_score)) AS s FROM union_scores WHERE from_graph06 = 1 GROUP BY ALL) u USING (src_iri, tgt_iri)
 LEFT JOIN (SELECT src_iri, tgt_iri, max(model_score) FILTER (NOT isnan(model_score)) AS s FROM predictions GROUP BY ALL) m USING (src_iri, tgt_iri)"""


def _above(s: str) -> str:
    return f"(x.{s} IS NOT NULL AND (y.{s} IS NULL OR x.{s} > y.{s}))::int"


def _similar(field: str, sets: str, threshold: str) -> str:
    return f"""SELECT a.iri AS iri_a, b.iri AS iri_b, '{field}' AS field_name FROM ({sets}) a JOIN ({sets}) b ON a.e = b.e AND a.iri < b.iri
 GROUP BY a.iri, b.iri HAVING count(*)::double / (any_value(a.n) + any_value(b.n) - count(*)) >= {threshold}"""


def _sets(values: str) -> str:
    both = "(SELECT iri, label_tokens, labels FROM src_profiles UNION ALL SELECT iri, label_tokens, labels FROM tgt_profiles)"
    return f"SELECT iri, e, count(*) OVER (PARTITION BY iri) AS n FROM (SELECT DISTINCT iri, e FROM (SELECT iri, {values} AS e FROM {both}) WHERE e IS NOT NULL AND e <> '')"


_SPLIT_ROWS = f"""SELECT {_canon('srcentity')} AS src_iri, fold FROM train UNION ALL SELECT src_iri, fold FROM oof_scores"""
_LINKS = f"SELECT DISTINCT a, b FROM (SELECT {_canon('srcentity')} AS a, {_canon('tgtentity')} AS b FROM train) WHERE a IS NOT NULL AND b IS NOT NULL"

ORACLE = {
    "p2_found": f"""WITH t AS (SELECT DISTINCT iri, term FROM ({_LABELLED})), rare AS (SELECT term FROM t GROUP BY term HAVING count(*) <= 8),
 r AS (SELECT src_iri, tgt_iri, unnest(list_intersect({_words('src_label')}, {_words('tgt_label')})) AS term FROM candidates WHERE src_iri IS NOT NULL AND tgt_iri IS NOT NULL AND trim(src_label) <> '' AND trim(tgt_label) <> '')
 SELECT DISTINCT src_iri, tgt_iri, term FROM r WHERE term IN (SELECT term FROM rare)""",
    "p3_found": _similar("label_tokens", _sets("unnest(label_tokens)"), "0.8") + " UNION ALL " + _similar("labels", _sets(f"array_to_string({_words('value')}, ' ')").replace("FROM (SELECT iri, label_tokens", "FROM (SELECT iri, unnest(labels) AS value FROM (SELECT iri, label_tokens").replace("FROM tgt_profiles)", "FROM tgt_profiles))"), "0.6"),
    "p4_found": f"SELECT src_iri FROM ({_SPLIT_ROWS}) WHERE src_iri IS NOT NULL GROUP BY src_iri HAVING count(DISTINCT fold) >= 2",
    "p5_found": f"""WITH n AS (SELECT *, count(*) OVER (PARTITION BY src_iri) AS n FROM ({_SCORED}))
 SELECT x.src_iri, x.tgt_iri FROM n x JOIN n y ON x.src_iri = y.src_iri AND x.tgt_iri <> y.tgt_iri WHERE x.n >= 3 GROUP BY ALL HAVING min({_above('a')} + {_above('b')} + {_above('c')}) >= 2""",
    "p5_ranking": f"""WITH r AS (SELECT src_iri, tgt_iri, rank() OVER (PARTITION BY src_iri ORDER BY a DESC NULLS LAST) AS rank_sapbert_cosine, rank() OVER (PARTITION BY src_iri ORDER BY b DESC NULLS LAST) AS rank_graph06_score, rank() OVER (PARTITION BY src_iri ORDER BY c DESC NULLS LAST) AS rank_model_score FROM ({_SCORED})),
 m AS (SELECT *, list_sort([rank_sapbert_cosine, rank_graph06_score, rank_model_score])[2] AS median_rank, round((rank_sapbert_cosine + rank_graph06_score + rank_model_score) / 3.0, 6) AS mean_rank FROM r)
 SELECT *, row_number() OVER (PARTITION BY src_iri ORDER BY median_rank, mean_rank, tgt_iri) AS place FROM m""",
    "p6_found": f"SELECT src_iri, tgt_iri FROM ({_top(5)})",
    "p6_ranks": f"""SELECT t.src_iri, t.tgt_iri, t.rank, t.s AS sapbert_cosine, r.recorded_rank FROM ({_top(10)}) t LEFT JOIN (SELECT src_iri, tgt_iri, min(rank_src_tgt) FILTER (abs(rank_src_tgt) < 1e300) AS recorded_rank FROM candidates GROUP BY ALL) r USING (src_iri, tgt_iri)""",
    "p7_found": f"""WITH RECURSIVE l AS ({_LINKS}), e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l), r AS (SELECT x AS n, x AS g FROM e UNION SELECT e.y, r.g FROM r JOIN e ON e.x = r.n WHERE r.g < e.y)
 SELECT n AS entity_iri, min(g) AS group_iri FROM r GROUP BY n""",
    "p8_found": f"SELECT doc_id FROM documents WHERE {_TOKENS} > 1024",
    "p9_found": f"""WITH t AS (SELECT {_SOURCE} AS k, {_TOKENS} AS n FROM documents), s AS (SELECT k, sum(n) AS n FROM t GROUP BY k)
 SELECT m.source FROM mix_targets m LEFT JOIN s ON s.k = m.source WHERE coalesce(s.n, 0) * m.max_repeats < m.target_share * (SELECT sum(n) FROM t)""",
}

ORACLE["p7_sizes"] = f"SELECT n AS n_entities, count(*) AS n_groups FROM (SELECT group_iri, count(*) AS n FROM ({ORACLE['p7_found']}) GROUP BY group_iri) GROUP BY n"


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
