"""SQL for the queries of operators that SQL can express only at length: what DuckDB computes from the same tables, by other means."""

from __future__ import annotations

from lumensift.llm.common import UPPER
from lumensift.llm.langid import BUCKETS, COUNTRIES, SUFFIXES, Settings

#: The main texts of pages whose article is marked and whose character references are these.
_TEXTS_SQL = r"""a AS (SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?b>', '', 'g'), '<br>', ' ', 'g') AS a FROM pages),
    b AS (SELECT page_id, url, html, [trim(regexp_replace(x, '\s+', ' ', 'g')) for x in regexp_split_to_array(a, '</?(?:p|h1)>')] AS b FROM a),
    c AS (SELECT page_id, url, html, array_to_string([x for x in b if x <> ''], chr(10) || chr(10)) AS c FROM b),
    texts AS (SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS text FROM c)"""
HTML_SQL = f"WITH {_TEXTS_SQL} SELECT page_id, url, text, length(text) AS n_chars FROM texts"

#: All windows that start with a shingle of an item of their length, or end the text; items have five words at least.
LEAKS_SQL = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
    d AS (SELECT doc_id, unnest(range(0, len(w) - 4)) AS pos, len(w) - 4 AS size, w FROM w WHERE len(w) >= 5),
    ds AS (SELECT doc_id, pos, size, array_to_string(w[pos + 1 : pos + 5], ' ') AS s FROM d),
    i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
    u AS (SELECT item_id, len(w) - 4 AS span, unnest(range(0, len(w) - 4)) AS pos, w FROM i WHERE len(w) >= 5),
    it AS (SELECT item_id, span, array_to_string(w[pos + 1 : pos + 5], ' ') AS s FROM u),
    ic AS (SELECT item_id, span, s, count(*) AS c FROM it GROUP BY ALL),
    spans AS (SELECT DISTINCT span FROM it), anchors AS (SELECT DISTINCT s, span FROM it),
    near AS (SELECT DISTINCT doc_id, size FROM ds WHERE s IN (SELECT s FROM it)),
    win AS (SELECT DISTINCT doc_id, span, pos AS start FROM ds JOIN anchors USING (s) WHERE pos + span <= size UNION SELECT doc_id, span, greatest(0, size - span) FROM near, spans),
    wc AS (SELECT win.doc_id, span, start, s, count(*) AS c FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.pos BETWEEN start AND start + span - 1 GROUP BY ALL),
    wn AS (SELECT doc_id, span, start, sum(c) AS n FROM wc GROUP BY ALL),
    same AS (SELECT doc_id, item_id, wc.span, start, sum(least(wc.c, ic.c)) AS same FROM wc JOIN ic ON wc.span = ic.span AND wc.s = ic.s GROUP BY ALL),
    sim AS (SELECT doc_id, item_id, start, same::DOUBLE / (n + span - same)::DOUBLE AS sim FROM same JOIN wn USING (doc_id, span, start)),
    top AS (SELECT doc_id, item_id, max(sim) AS best FROM sim GROUP BY ALL HAVING max(sim) >= 0.8)
    SELECT doc_id, item_id, round(best, 6) AS similarity, min(start)::BIGINT AS start_word FROM top JOIN sim USING (doc_id, item_id) WHERE sim = best GROUP BY ALL"""


_DOCUMENT_ROWS = "doc AS (SELECT doc_id, text, lower(lang) AS declared, NULL::VARCHAR AS suffix, coalesce(source, '') AS host FROM documents)"
_ADDRESS = "^[a-zA-Z][a-zA-Z0-9+.-]*://"
_PAGE_ROWS = rf"""{_TEXTS_SQL},
    named AS (SELECT page_id AS doc_id, text, nullif(lower(regexp_extract(html, '(?i)<html\b[^>]*?\slang\s*=\s*["'']?([a-z]{{2,3}})', 1)), '') AS declared,
        lower(regexp_extract(url, '{_ADDRESS}[^/?#]+/([a-zA-Z]{{2}})(?:[-_][a-zA-Z]{{2}})?(?:[/?#]|$)', 1)) AS path, lower(regexp_extract(url, '{_ADDRESS}[^/?#:]*\.([a-zA-Z]{{2}})(?:[:/?#]|$)', 1)) AS country,
        lower(regexp_extract(url, '{_ADDRESS}(?:[^/?#@]*@)?([^/?#:@]*)', 1)) AS host FROM texts),
    doc AS (SELECT doc_id, text, declared, CASE WHEN path IN ({', '.join(f"'{x}'" for x in sorted(COUNTRIES))}) THEN path ELSE map {{{', '.join(f"'{k}': '{v}'" for k, v in SUFFIXES.items())}}}[country] END AS suffix, host FROM named)"""


def language_sql(settings: Settings, pages: bool = False, alpha: float = 0.05, least_grams: int = 1000) -> str:
    """Language identification of documents, or of pages, where all labelled documents are in the fit's sample: 20 000 at most."""
    s = settings
    grams = lambda of: rf"""(SELECT doc_id, ((code * 2654435761) & 4294967295) >> 17 AS b, count(*) AS k FROM (
        SELECT doc_id, ('0x' || substr(h, 2 * unnest(range(0, length(h) // 2 - 2)) + 1, 6))::BIGINT AS code FROM (
        SELECT doc_id, hex(' ' || regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x00-\x60\x7B-\x7F]', ' ', 'g') || ' ') AS h FROM {of})) GROUP BY ALL)"""  # noqa: E731
    says = lambda named, error: f"""CASE WHEN {named} IS NULL OR {named} NOT IN (SELECT label FROM lab) THEN 0 WHEN {named} = ll.label THEN ln(1 - {error}) ELSE ln({error} / greatest(1, m - 1)) END"""
    return rf"""
    WITH {_PAGE_ROWS if pages else _DOCUMENT_ROWS},
    g AS {grams("doc")},
    fit AS {grams("documents") if pages else "(SELECT * FROM g)"},
    tr AS (SELECT lang AS label, b, sum(k) AS n FROM fit JOIN documents USING (doc_id) WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
    lab AS (SELECT label, sum(n)::DOUBLE AS total FROM tr GROUP BY label HAVING sum(n) >= {least_grams}),
    m AS (SELECT count(*)::DOUBLE AS m, sum(total) AS every FROM lab),
    cm AS (SELECT r.b, (coalesce(sum(n), 0) + {alpha}) / (any_value(every) + {alpha * BUCKETS}) AS common FROM range({BUCKETS}) r(b) CROSS JOIN m LEFT JOIN (SELECT * FROM tr SEMI JOIN lab USING (label)) t ON t.b = r.b GROUP BY r.b),
    lp AS (SELECT label, cm.b, ln((coalesce(n, 0) + {alpha * BUCKETS} * common) / (total + {alpha * BUCKETS}))::FLOAT::DOUBLE AS p FROM lab CROSS JOIN cm LEFT JOIN tr USING (label, b)),
    own AS (SELECT label, sum(exp(p) * p) AS own FROM lp GROUP BY label),
    found AS (SELECT doc_id, label, sum(k * p) AS ll, sum(k) AS grams FROM g JOIN lp USING (b) GROUP BY ALL),
    ll AS (SELECT doc.doc_id, host, declared, suffix, text, lab.label, coalesce(ll, 0.0) AS ll, coalesce(grams, 0)::BIGINT AS grams FROM doc CROSS JOIN lab LEFT JOIN found ON found.doc_id = doc.doc_id AND found.label = lab.label),
    best AS (SELECT doc_id, any_value(host) AS host, CASE WHEN any_value(grams) > 0 THEN list(label ORDER BY ll DESC, label)[1] END AS best FROM ll GROUP BY doc_id),
    hosts AS (SELECT host, CASE WHEN host LIKE '%.%' THEN regexp_extract(host, '([^.]+\.[^.]+)$', 1) ELSE regexp_replace(host, '\d+', '', 'g') END AS parent, best, count(*)::DOUBLE AS c FROM best WHERE best IS NOT NULL GROUP BY ALL),
    grid AS (SELECT DISTINCT host, CASE WHEN host LIKE '%.%' THEN regexp_extract(host, '([^.]+\.[^.]+)$', 1) ELSE regexp_replace(host, '\d+', '', 'g') END AS parent, label FROM best CROSS JOIN lab),
    corpus AS (SELECT label, coalesce(sum(c), 0) AS c, (SELECT coalesce(sum(c), 0) FROM hosts) AS n FROM lab LEFT JOIN hosts ON best = label GROUP BY label),
    above AS (SELECT p.parent, p.label, (coalesce(sum(h.c), 0) + {s.smoothing} * (any_value(corpus.c) + 1) / (any_value(corpus.n) + any_value(m))) / ((SELECT coalesce(sum(c), 0) FROM hosts x WHERE x.parent = p.parent) + {s.smoothing}) AS u
        FROM (SELECT DISTINCT parent, label FROM grid) p JOIN corpus USING (label) CROSS JOIN m LEFT JOIN hosts h ON h.parent = p.parent AND h.best = p.label GROUP BY p.parent, p.label),
    prior AS (SELECT grid.host, grid.label, (coalesce(h.c, 0) + {s.smoothing} * u) / ((SELECT coalesce(sum(c), 0) FROM hosts x WHERE x.host = grid.host) + {s.smoothing}) AS prior
        FROM grid JOIN above USING (parent, label) LEFT JOIN hosts h ON h.host = grid.host AND h.best = grid.label),
    post AS (SELECT ll.*, own, ll * {s.text_weight!r} + ln(prior) + {says("declared", s.declared_error)} + {says("suffix", s.suffix_error)} AS lp FROM ll JOIN prior USING (host, label) JOIN own USING (label) CROSS JOIN m),
    win AS (SELECT doc_id, max(lp) AS top, list(label ORDER BY lp DESC, label)[1] AS lang FROM post GROUP BY doc_id),
    prob AS (SELECT doc_id, 1 / sum(exp(lp - top)) AS prob FROM post JOIN win USING (doc_id) GROUP BY doc_id)
    SELECT doc_id AS {'page_id' if pages else 'doc_id'}, lang, round(prob, 6) AS prob, best AS text_lang, declared AS declared_lang, suffix AS suffix_lang, grams AS n_grams,
        regexp_matches(coalesce(text, ''), '\p{{L}}') AND prob >= {s.min_prob} AND ll / greatest(1, grams) >= own - {s.strange} - {s.strange_short} / sqrt(greatest(1, grams)) AS kept
    FROM win JOIN prob USING (doc_id) JOIN best USING (doc_id) JOIN post ON post.doc_id = win.doc_id AND post.label = win.lang"""
