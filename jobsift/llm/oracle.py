"""Answers of the queries in SQL, where SQL can express the operator.

Written from the meaning of the operators for the second engine; the patterns and texts that
a result is made of are stated again here.
"""

from html.entities import html5

_ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)")


def _found(kind: int, pattern: str, group: int, least: int) -> str:
    """Rows (row, kind, b, e, v): places of the matches, from the lengths of gaps and matches."""
    return f"""
    SELECT row, {kind} AS kind, b, b + length(m) AS e, v FROM (
      SELECT row, m, v, (sum(length(g)) OVER (PARTITION BY row ORDER BY i)
             + coalesce(sum(length(m)) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS b
      FROM (SELECT row, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[:len(ms)]) AS g
            FROM (SELECT row, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {group}) AS vs,
                         string_split_regex(t, '{pattern}') AS gs FROM d))) WHERE length(v) >= {least}"""


_SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents),
base AS ({_found(0, _ASSIGN, 2, 8)} UNION ALL {_found(1, 'AKIA[A-Z0-9]+', 0, 16)} UNION ALL {_found(2, '[0-9a-f]+', 0, 32)}),
weak AS (SELECT * FROM ({_found(3, '[A-Za-z0-9+/_=-]{20,}', 0, 20)}) w
         WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND length(v) <= 200
           AND 10 * len(regexp_extract_all(v, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')) >= 3 * length(v) AND list_aggregate(string_split(v, ''), 'entropy') >= 3.0
           AND NOT EXISTS (SELECT 1 FROM base WHERE base.row = w.row AND base.b < w.e AND w.b < base.e)),
cand AS (SELECT c.*, d.source, d.t FROM (SELECT * FROM base UNION ALL SELECT * FROM weak) c JOIN d USING (row)),
freq AS (SELECT v, count(DISTINCT coalesce('=' || source, '')) AS owners, count(DISTINCT t) AS copies FROM cand GROUP BY v),
kept AS (SELECT row, kind, b, e, owners <= 1 AND copies <= 10 AS live, ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || b || ':' || e AS w
         FROM cand JOIN freq USING (v)),
g AS (SELECT row, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
             count(*) FILTER (kind = 3) AS n3, count(*) FILTER (live) AS l, count(*) FILTER (NOT live) AS s,
             string_agg(w, ',' ORDER BY b, kind) FILTER (kind < 3) AS ws, string_agg(w, ',' ORDER BY b, kind) AS wa FROM kept GROUP BY row)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(ws, '')) AS base_sha256,
       coalesce(wa, '') AS spans, coalesce(n3, 0) AS n_opaque, coalesce(l, 0) AS n_live, coalesce(s, 0) AS n_shared
FROM d LEFT JOIN g USING (row)"""

_MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
      FROM d GROUP BY source),
o AS (SELECT *, count(*) OVER p AS place, sum(2.0::DOUBLE * total) OVER p - 2.0::DOUBLE * total AS full_before, sum(w) OVER () - sum(w) OVER p + w AS open_w,
             1.5::DOUBLE * sum(total) OVER () AS mix FROM s
      WINDOW p AS (ORDER BY 2.0::DOUBLE * total / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
r AS (SELECT arg_min((mix - full_before) / open_w, place) FILTER ((mix - full_before) / open_w * w <= 2.0::DOUBLE * total) AS rate FROM o),
t AS (SELECT source, total, CASE WHEN rate IS NULL OR rate * w > 2.0::DOUBLE * total THEN 2.0::DOUBLE * total ELSE rate * w END AS target FROM s, r),
c AS (SELECT d.*, t.total, t.target, floor(t.target + 0.5)::BIGINT AS whole, coalesce(sum(size) OVER (PARTITION BY t.source
             ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT, doc_id, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, total AS source_size, target,
       (CASE WHEN 2 * start + size < 2 * whole THEN size ELSE 0 END
        + CASE WHEN 2 * (start + total) + size < 2 * whole THEN size ELSE 0 END)::BIGINT AS taken FROM c"""

_TOP_K = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, max(list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5"""

_REACH = """
part AS (SELECT id, id AS root FROM node UNION SELECT e.b, part.root FROM part JOIN edge e ON e.a = part.id WHERE part.root < e.b)"""

_NEAR = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
        ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS h FROM d),
x AS (SELECT row, unnest(h) AS h FROM s),
common AS (SELECT x.row AS a, y.row AS b, count(*) AS n FROM x JOIN x y USING (h) WHERE x.row <> y.row GROUP BY ALL),
edge AS (SELECT DISTINCT p.doc_id AS a, q.doc_id AS b FROM common JOIN s p ON p.row = a JOIN s q ON q.row = b
         WHERE 100 * n >= 80 * (len(p.h) + len(q.h) - n) AND p.doc_id <> q.doc_id),
node AS (SELECT DISTINCT doc_id AS id FROM documents), {_REACH}
SELECT s.doc_id, len(s.h)::BIGINT AS n_shingles, c.root AS component_id, s.doc_id IS NOT DISTINCT FROM c.root AS kept
FROM s LEFT JOIN (SELECT id, min(root) AS root FROM part GROUP BY id) c ON c.id = s.doc_id"""

_VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
edge AS (SELECT DISTINCT p.id AS a, q.id AS b FROM v p JOIN v q ON p.id <> q.id WHERE list_cosine_similarity(p.e, q.e) >= 0.9),
node AS (SELECT DISTINCT vec_id AS id FROM embeddings), {_REACH}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, root AS component_id, vec_id IS NOT DISTINCT FROM root AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM edge GROUP BY a) ON a = vec_id
LEFT JOIN (SELECT id, min(root) AS root FROM part GROUP BY id) ON id = vec_id"""

_UUID = "'<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>'"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Character references: what has a name, with and without semicolon, and the numbers of Windows signs.
_NAMES = "MAP {" + ", ".join(f"{_quoted(n)}: {_quoted(sign)}" for n, sign in html5.items()) + "}"
_OPEN = "|".join(sorted((n for n in html5 if n[-1] != ";"), key=len, reverse=True))
_REFERENCE = f"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;|(?:{_OPEN}))"
_WINDOWS = "[" + ", ".join(str(ord(bytes([n]).decode("cp1252", "ignore") or chr(n))) for n in range(128, 160)) + "]"
_CODE = ("coalesce(CASE WHEN length(ltrim(rtrim(r[3:], ';'), 'xX0')) > 7 THEN 0 WHEN lower(r[3]) = 'x' THEN try_cast('0x' || rtrim(r[4:], ';') AS BIGINT)"
         " ELSE try_cast(rtrim(r[3:], ';') AS BIGINT) END, 0)")
_NUMBERED = (f"CASE WHEN {_CODE} BETWEEN 128 AND 159 THEN chr(({_WINDOWS})[({_CODE} - 127)::INT]::INT)"
             f" WHEN {_CODE} BETWEEN 1 AND 55295 OR {_CODE} BETWEEN 57344 AND 1114111 THEN chr({_CODE}::INT) ELSE chr(65533) END")
_BY_NAME = (f"coalesce(({_NAMES})[r[2:]], ({_NAMES})[r[2:] || ';'], ({_NAMES})[nullif(regexp_extract(r, '^&({_OPEN})', 1), '')]"
            f" || r[2 + length(regexp_extract(r, '^&({_OPEN})', 1)):], r)")
_SIGN = f"regexp_replace(CASE WHEN r = '' THEN '' WHEN r[2] = '#' THEN {_NUMBERED} ELSE {_BY_NAME} END, '^[\\x09-\\x0D\\x{{A0}}]$', ' ')"


def _plain(text: str) -> str:
    """All references at once: gaps and signs in turn."""
    return (f"array_to_string(list_transform(list_zip(string_split_regex({text}, '{_REFERENCE}'), list_append(regexp_extract_all({text}, '{_REFERENCE}'), '')),"
            f" lambda x: x[1] || list_transform([x[2]], lambda r: {_SIGN})[1]), '')")


def _swap(text: str, pattern: str, new: str) -> str:
    return f"regexp_replace({text}, '{pattern}', {new}, 'g')"


_HIDDEN = "|".join(["<!--.*?-->", *(rf"<{t}\b.*?</{t}[^>]*>" for t in ("script", "style", "template", "noscript", "title"))])
_BLOCKS = (
    r"(?i)<(?:/?(?:p|div|article|section|header|footer|main|nav|aside|ul|ol|li|dl|dt|dd|table|tr|h[1-6]|blockquote|pre|form|figure"
    r"|figcaption)|br|hr)(?:[\x20\x09-\x0D/][^>]*)?>")
_TEXT = _swap(_swap("html", "(?is)" + _HIDDEN, "' '"), r"[\x20\x09-\x0D]+", "' '")
_TEXT = _plain(_swap(_swap(_TEXT, _BLOCKS, "chr(10)"), "<[^>]*>", "''"))
_TEXT = _swap(_swap(_swap(_TEXT, r"[ \n]*\n[ \n]*", "chr(10)"), " +", "' '"), r"^[ \n]+|[ \n]+$", "''")
_TITLE = "trim(" + _plain(_swap(_swap("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)", "<[^>]*>", "''"), r"[\x20\x09-\x0D]+", "' '")) + ", ' ')"
_LANG = r"""lower(regexp_extract(html, '(?i)<html\b[^>]*?[\x20\x09-\x0D]lang=["'']?([A-Za-z-]+)', 1))"""

_WARC = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, chr(13) || chr(10) AS nl FROM pages),
r AS (SELECT *, md5('response|' || coalesce(page_id::VARCHAR, '') || '|' || url || '|sha256:' || sha256(html)) AS h, 'sha256:' || sha256(html) AS source_digest,
             {_TEXT} AS txt FROM p),
s AS (SELECT *, {_UUID} AS refers_to,
  'title: ' || {_TITLE} || nl || 'declared-language: ' || {_LANG} || nl || 'source-payload-digest: ' || source_digest || nl
  || 'source-length: ' || strlen(html) || nl || 'text-length: ' || strlen(txt) || nl || 'http-status: 200 OK' || nl
  || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || strlen(html) || nl AS meta FROM r),
k AS (SELECT page_id, url, refers_to, source_digest, 'metadata' AS record_type, 'application/warc-fields' AS content_type, meta AS block FROM s
      UNION ALL SELECT page_id, url, refers_to, source_digest, 'conversion', 'text/plain; charset=utf-8', txt FROM s),
i AS (SELECT *, md5(record_type || '|' || refers_to) AS h FROM k)
SELECT page_id, record_type, {_UUID} AS record_id, refers_to, url AS target_uri, '1970-01-01T00:00:00Z' AS warc_date, content_type, block,
       strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, source_digest FROM i"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT row, lang, source, t, count(*)::HUGEINT AS n FROM (SELECT row, lang, source, unnest(ts) AS t FROM d) GROUP BY ALL),
k AS (SELECT lang, t, sum(n) AS n FROM w GROUP BY ALL HAVING count(*) >= 30),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.t, sum(w.n) AS n FROM w JOIN k ON k.lang = w.lang AND k.t = w.t GROUP BY ALL),
g AS (SELECT a.lang, a.source, coalesce(b.total, 0)::HUGEINT AS total, coalesce(l.v, 0) AS v, l.total AS lang_total
      FROM (SELECT DISTINCT lang, source FROM d) a LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) b USING (lang, source)
      LEFT JOIN l ON l.lang = a.lang),
p AS (SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS p,
             1 + (1000000000 * (k.n + 5)) // (g.lang_total + 5 * g.v) AS q
      FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source
      GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', t, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM r)
WHERE part = 'pair' OR rank <= 50"""

_SPELLINGS = rf"""
WITH RECURSIVE bytes AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS crc
                         FROM range(256) AS t(b)),
r AS (SELECT id, run, count(*) AS n FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(list_transform(
        regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+'), lambda x: {_LOWER.format("x")})) AS run FROM documents) GROUP BY ALL),
h AS (SELECT id, run, n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(id || ':' || run, ''),
        lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195, ord(x)::BIGINT - 64] END))),
        lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM r, bytes),
w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN run[:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word FROM h)
      WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
s AS (SELECT word, n, unnest(range(length(word)))::INT AS i FROM w),
o AS (SELECT word, n, word[:i] || '*' || word[i + 2:] AS same, word[:i] || word[i + 2:] AS less FROM s),
near AS (SELECT a.word, b.word AS near, b.n FROM o a JOIN o b ON a.same = b.same AND a.word <> b.word
         UNION SELECT o.word, w.word, w.n FROM o JOIN w ON o.less = w.word UNION SELECT w.word, o.word, o.n FROM o JOIN w ON o.less = w.word),
f AS (SELECT w.word, w.n, count(b.near) AS n_near, first(b.near ORDER BY b.n DESC, encode(b.near)) AS best, max(b.n) AS best_n
      FROM w LEFT JOIN near b ON b.word = w.word GROUP BY ALL),
forms AS (SELECT word, n, n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM f),
walk AS (SELECT word, word AS root, 0 AS step FROM forms UNION ALL
         SELECT walk.word, forms.form, step + 1 FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY word)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN ends ON ends.word = forms.word"""

ORACLE: dict[str, str] = {
    "op1_secret_ownership": _SECRETS,
    "op2_curriculum_mix": _MIX,
    "op4_block_top_k": _TOP_K,
    "op5_minhash_near_dedup": _NEAR,
    "op8_warc_derivatives": _WARC,
    "op10_lattice_near_dedup": _VECTORS,
    "op11_source_divergence": _DIVERGENCE,
    "op12_spelling_variants": _SPELLINGS,
}
