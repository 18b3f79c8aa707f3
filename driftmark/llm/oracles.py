"""DuckDB SQL of the training-data queries that SQL can express."""

def _attr(name: str) -> str:
    """An attribute's value in ``tag``."""
    pattern = rf"""(?is)[\s"''/]{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(tag, '{pattern}', {i}), '')" for i in (1, 2, 3)) + ", '')"


def _dots(path: str) -> str:
    """A path without dot segments."""
    return (f"(list_reduce(string_split({path}, '/'), lambda a, x: CASE x WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') "
            f"WHEN '.' THEN a ELSE a || '/' || x END) || CASE WHEN string_split({path}, '/')[-1] IN ('.', '..') THEN '/' ELSE '' END)")


_REFRESH = ", ".join(f"""nullif(regexp_extract(content, '(?is)\\burl\\s*=\\s*(?:"([^"]*)|''([^'']*)|([^"''].*))', {i}), '')""" for i in (1, 2, 3))
_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_PLAIN = "href"
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&apos;", "''"), ("&#38;", "&"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_e}', '{_c}')"

OP1 = rf"""
WITH RECURSIVE parts AS (
  SELECT page_id, html,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
addr0 AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), {_LOW}) AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(coalesce(rest, ''), '^[^?#]*(\?[^#]*)?', 1) AS query
  FROM parts),
addr AS (SELECT *, host || {_dots('path')} || query AS node FROM addr0),
rules(rule, verdict, h, p) AS (VALUES
  ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
  ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
  ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
tags AS (
  SELECT host, path, query, node, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS tag
  FROM addr WHERE host <> ''),
attrs AS (
  SELECT *, translate(substr(tag, 2, 4), {_LOW}) AS kind, {_attr('rel')} AS rel, {_attr('href')} AS to_, {_attr('http-equiv')} AS equiv, {_attr('content')} AS content
  FROM tags),
hrefs0 AS (
  SELECT *, CASE WHEN kind = 'link' AND regexp_matches(rel, '(?i)(^|\s)canonical(\s|$)') THEN to_
                 WHEN kind = 'meta' AND translate(trim(equiv), {_LOW}) = 'refresh' THEN coalesce({_REFRESH}, '')
                 ELSE '' END AS href
  FROM attrs),
hrefs AS (SELECT host, path, query, node, trim({_PLAIN}) AS href FROM hrefs0),
targets AS (
  SELECT node AS a, host, path,
         CASE WHEN contains(href, '://') THEN href
              WHEN href LIKE '//%' THEN 'x:' || href
              WHEN href LIKE '/%' THEN 'x://' || host || href
              WHEN href LIKE '?%' THEN 'x://' || host || path || href
              WHEN href LIKE '#%' THEN 'x://' || host || path || query
              ELSE 'x://' || host || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || href END AS u
  FROM hrefs WHERE href <> ''),
to_parts AS (SELECT a, host, path, substr(u, strpos(u, '://') + 3) AS rest FROM targets),
links0 AS (
  SELECT a, host, path, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_LOW}) AS th,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS tp0, regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1) AS tq
  FROM to_parts),
links AS (SELECT *, {_dots('tp0')} AS tp FROM links0 WHERE th <> ''),
ends AS (
  SELECT a AS node, host, path FROM links
  UNION SELECT th || tp || tq, th, tp FROM links),
edges AS (
  SELECT a, th || tp || tq AS b FROM links
  UNION SELECT th || tp || tq, a FROM links),
tainted AS (
  SELECT node FROM (
    SELECT node, (SELECT r.verdict FROM rules r
                  WHERE (e.host = r.h OR suffix(e.host, '.' || r.h)) AND starts_with(e.path, r.p)
                  ORDER BY length(r.rule) DESC LIMIT 1) AS verdict
    FROM ends e) WHERE verdict = 'block'
  UNION SELECT b FROM edges JOIN tainted ON edges.a = tainted.node),
best AS (
  SELECT page_id, host, path, node, rule, verdict
  FROM addr LEFT JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN node IN (SELECT node FROM tainted) THEN 'block' END, 'allow') AS verdict
FROM best
"""

OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
          WHERE 100 * k >= 85 * (na.n + nb.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
          UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id
"""

OP5 = """
WITH near AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, greatest(len(q.embedding), len(v.embedding)) + 1), lambda i:
         CASE WHEN (coalesce(q.embedding[i], 0) > 0) <> (coalesce(v.embedding[i], 0) > 0) THEN 1 ELSE 0 END)) AS BIGINT) AS distance
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance
FROM near QUALIFY rank <= 10
"""

OP12 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
o AS (SELECT payload_bytes, payload_digest, max(page_id) AS owner FROM d WHERE payload_bytes >= 1000 GROUP BY 1, 2)
SELECT d.page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM owner AND owner IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM d LEFT JOIN o USING (payload_bytes, payload_digest)
"""

OP13 = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (  -- CRC-32: a byte is xored in, then eight shifts
  SELECT k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(k) + 1), lambda i:
           [CAST(ascii(substr(k, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x:
           CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 20 AS kind
  FROM (SELECT DISTINCT k FROM c)),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM c JOIN kinds USING (k) WHERE kind <> 0),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(strlen(role) || ':' || role || text)) AS i FROM d),
f AS (
  SELECT *, substr(role, 1, 1) AS r0, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
         WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM n),
-- states: 0 start, 1 after the system row, 2 after a user, 3 after an assistant
ins(s, s2, k, lines) AS (VALUES
  (0, 0, 0, CAST([] AS VARCHAR[])), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []),
  (0, 2, 1, ['user:']), (1, 2, 1, ['user:']), (2, 3, 1, ['assistant:']), (3, 2, 1, ['user:']),
  (0, 3, 2, ['user:', 'assistant:']), (1, 3, 2, ['user:', 'assistant:'])),
edit(s2, e, s3, c, who) AS (VALUES
  (0, 'D', 0, 2, ''), (1, 'D', 1, 2, ''), (2, 'D', 2, 2, ''), (3, 'D', 3, 2, ''),
  (0, 'R', 2, 1, 'user'), (1, 'R', 2, 1, 'user'), (2, 'R', 3, 1, 'assistant'), (3, 'R', 2, 1, 'user'),
  (0, 'K', 1, 0, 's'), (0, 'K', 2, 0, 'u'), (1, 'K', 2, 0, 'u'), (2, 'K', 3, 0, 'a'), (3, 'K', 2, 0, 'u')),
st AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, {'c': CAST(0 AS BIGINT), 'a': '', 'o': CAST([] AS VARCHAR[])} AS w
  FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT conv_id, i, s3, min(w) FROM (
    SELECT f.conv_id, f.i, s3,
           {'c': CAST(st.w.c + 5 * k + edit.c + CASE WHEN e <> 'D' AND fault = 't' THEN 5 ELSE 0 END AS BIGINT),
            'a': st.w.a || repeat('I', k) || e,
            'o': list_concat(st.w.o, lines, CASE e WHEN 'D' THEN [] WHEN 'R' THEN [who || ':' || f.text] ELSE [f.role || ':' || f.text] END)} AS w
    FROM st JOIN f ON f.conv_id IS NOT DISTINCT FROM st.conv_id AND f.i = st.i + 1
    JOIN ins ON ins.s = st.s JOIN edit ON edit.s2 = ins.s2
    WHERE (e = 'D' OR fault NOT IN ('b', 'd')) AND (e <> 'K' OR who = r0))
  GROUP BY conv_id, i, s3),
last AS (SELECT conv_id, max(i) AS i FROM f GROUP BY conv_id),
best AS (
  SELECT st.conv_id, min({'c': st.w.c + 5 * k, 'a': st.w.a || repeat('I', k), 'o': list_concat(st.w.o, lines)}) AS w
  FROM st JOIN last ON st.conv_id IS NOT DISTINCT FROM last.conv_id AND st.i = last.i
  JOIN ins ON ins.s = st.s WHERE ins.s2 IN (0, 3) GROUP BY st.conv_id),
num AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
         count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || r0 NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
x AS (
  SELECT a.conv_id, gaps, blank, duplicate, truncated, illegal, w
  FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN num ON num.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.c, 0) AS cost, coalesce(w.a, '') AS audit,
       sha256(coalesce(array_to_string(w.o, chr(10)), '')) AS repaired_sha256
FROM x
"""

ORACLES = {"op13_conversation_repair": OP13, "op12_warc_pages": OP12, "op5_code_neighbours": OP5, "op3_near_duplicates": OP3, "op1_url_aliases": OP1}
