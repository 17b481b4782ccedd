"""The same results as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from almanac.llm.licenses import DICE, GAP, TEMPLATES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_GIVEN = ", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(TEMPLATES))
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_PAIRS = (
    "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
)

LICENSES = f"""
WITH given(template, license, text) AS (VALUES {_GIVEN}),
templates AS (
    SELECT template, license, {_PAIRS} AS t
    FROM (SELECT template, license, {_WORDS.format('text')} AS w FROM given)
), units AS (
    SELECT doc_id, 'line' AS unit, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS number
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
    UNION ALL
    SELECT doc_id, 'paragraph', part, number
    FROM (SELECT doc_id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS number
          FROM (SELECT doc_id, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS parts
                FROM documents))
    WHERE contains(trim(part), chr(10))
), own AS (
    SELECT doc_id, unit, number, {_PAIRS} AS b
    FROM (SELECT doc_id, unit, number, {_WORDS.format('part')} AS w FROM units)
    WHERE len(w) > 1
), scored AS (
    SELECT doc_id, unit, number, license, template, len(list_intersect(b, t)) AS common,
           2.0::DOUBLE * len(list_intersect(b, t)) / (len(b) + len(t)) AS dice
    FROM own JOIN templates
      ON len(b) BETWEEN len(t) * {DICE} / (2 - {DICE}) - 1e-9
                    AND len(t) * (2 - {DICE}) / {DICE} + 1e-9
), bags AS (
    SELECT template, license, tsize, bigram, count(*) AS often
    FROM (SELECT template, license, len(w) - 1 AS tsize,
                 unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram
          FROM (SELECT template, license, {_WORDS.format('text')} AS w FROM given) WHERE len(w) > 1)
    GROUP BY ALL
), placed AS (
    SELECT doc_id, unnest(range(1, len(w))) AS nth,
           unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram
    FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents) WHERE len(w) > 1
), hits AS (
    SELECT *, nth - lag(nth) OVER (PARTITION BY doc_id, template ORDER BY nth) AS away
    FROM placed JOIN bags USING (bigram)
), cut AS (
    SELECT *, sum(CASE WHEN away <= {GAP + 1} THEN 0 ELSE 1 END)
                OVER (PARTITION BY doc_id, template ORDER BY nth) AS run
    FROM hits
), shared AS (
    SELECT doc_id, template, license, tsize, run, least(count(*), any_value(often)) AS n,
           min(nth) AS first, max(nth) AS last
    FROM cut GROUP BY doc_id, template, license, tsize, run, bigram
), run_scores AS (
    SELECT doc_id, template, license, min(first) AS number, CAST(sum(n) AS BIGINT) AS common,
           2.0::DOUBLE * sum(n) / (max(last) - min(first) + 1 + tsize) AS dice
    FROM shared GROUP BY doc_id, template, license, tsize, run
)
SELECT doc_id, unit, number, license, common, dice
FROM scored WHERE dice >= {DICE}
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, number
                           ORDER BY dice DESC, license, template) = 1
UNION ALL
SELECT doc_id, 'run', number, license, common, dice FROM run_scores WHERE dice >= {DICE}
QUALIFY row_number() OVER (PARTITION BY doc_id, number ORDER BY dice DESC, license, template) = 1
"""

URL_FILTER = """
WITH cut AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3)
                         ELSE '' END AS rest
    FROM pages
), parts AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^([^/?#]*)', 1),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
           regexp_extract(rest, '^[^?#]*(\\?[^#]*)', 1) AS query
    FROM cut
), rules(rule, rule_host, rule_path, rule_verdict) AS (
    VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
           ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), fits AS (
    SELECT p.*, r.rule, r.rule_verdict,
           row_number() OVER (PARTITION BY page_id, host, path, query
                              ORDER BY length(r.rule) DESC NULLS LAST) AS place
    FROM parts p LEFT JOIN rules r
      ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN rule_verdict
            WHEN regexp_matches(
                host || path || query,
                '(?s)^[^/?]*(spam|cheap-pills|casino|free-bets)|/wp-login|(\\.exe|\\.zip)$')
            THEN 'block' ELSE 'allow' END AS verdict
FROM fits WHERE place = 1
"""


FILTER_AUDIT = """
WITH RECURSIVE filters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
own AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents
), failed AS (
    SELECT doc_id, part,
           CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
           + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
           + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text)
                  THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 16 ELSE 0 END AS mask
    FROM own
), marks AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic
    FROM labels GROUP BY doc_id
), cells AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good,
           count(*) FILTER (toxic) AS toxic
    FROM failed LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), orders(filter_order, applied) AS (
    SELECT '', 0
    UNION ALL
    SELECT filter_order || letter, applied | bit FROM orders, filters WHERE applied & bit = 0
), steps AS (
    SELECT filter_order, step, bit,
           (SELECT sum(b.bit) FROM filters b
            WHERE contains(substr(filter_order, 1, step - 1), b.letter)) AS before
    FROM orders, range(1, 6) AS r(step), filters
    WHERE applied = 31 AND letter = substr(filter_order, step, 1)
), counted AS (
    SELECT part, filter_order, step, bit,
           coalesce(sum(n) FILTER (mask & (coalesce(before, 0)::INT | bit) = 0), 0) AS kept,
           coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(before, 0)::INT = 0), 0)
               AS removed,
           coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(before, 0)::INT <> 0), 0)
               AS redundant,
           coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
           coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & coalesce(before, 0)::INT = 0), 0)
               AS good_lost,
           coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & coalesce(before, 0)::INT = 0), 0)
               AS toxic_lost
    FROM steps, cells GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""


#: All pairs of vectors; ids are unique in the given table.
EMBEDDINGS = """
WITH RECURSIVE fine AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN 0 ELSE 1 END),
                         'sum') = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL)) = 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b
      ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
), reached(id, other) AS (
    SELECT a, b FROM links
    UNION
    SELECT id, b FROM reached JOIN links ON a = other
), lowest AS (SELECT id, min(other) AS low FROM reached GROUP BY id),
counts AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links,
       least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN counts c ON c.id = vec_id LEFT JOIN lowest l ON l.id = vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_licenses": LICENSES, "op9_url_filter": URL_FILTER,
            "op6_embeddings": EMBEDDINGS, "op12_filter_audit": FILTER_AUDIT}
