"""The SQL answer to each query of ``plans/queries.py``, for a second engine to check.

The statements are written from the operators' meaning (row-wise joins, running
windows, unnested rows) and not from the way the Spark jobs compute it.
"""

from __future__ import annotations

from jobsift import constants as K
from jobsift.plans import views as v
from jobsift.plans.queries import NOW


# What a link is, stated for this engine on its own.
SPACE = "[ \\t\\n\\x0B\\f\\r]"
HIDDEN_MARKUP = "(?is)<!--.*?-->|<script[ >].*?</script>|<style[ >].*?</style>"
HREF = f"""(?is)<a{SPACE}(?:[^>]*?{SPACE})?href{SPACE}*={SPACE}*("[^"]*"|'[^']*'|[^ \\t\\n\\x0B\\f\\r"'>]+)"""


def q(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def lst(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def pick(words, index: str) -> str:
    return f"{lst(words)}[CAST(({index}) % {len(words)} + 1 AS BIGINT)]"


def some(words, start: str, length: str) -> str:
    return f"{lst(words)}[({start}) : ({start}) + ({length}) - 1]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{K.WS}+|{K.WS}+$', '', 'g')"


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def words_of(x: str) -> str:
    return (f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^a-z]+'), "
            f"lambda w: length(w) >= 2))")


def terms(x: str) -> str:
    padded = f"' ' || regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}.+#]+', ' ', 'g') || ' '"
    return f"regexp_replace(regexp_replace({padded}, '[.]+ ', ' ', 'g'), ' +', ' ', 'g')"


LADDER = lst([w.lower() for w in K.SENIORITY_LADDER])
NL = "chr(10)"


def level(x: str) -> str:
    return (f"list_max(list_filter(list_transform(regexp_split_to_array(lower({x}), '[^a-z]+'), "
            f"lambda w: list_position({LADDER}, w)), lambda n: n > 0))")


def composite(a: str, r: str) -> str:
    return f"CAST((45 * ({a}) + 55 * ({r}) + 50) // 100 AS INTEGER)"


def saved(n: str) -> str:
    m = f"(12 * ({n}))"
    return (f"CASE WHEN {m} < 60 THEN {m} || ' min' WHEN {m} % 60 > 0 "
            f"THEN {m} // 60 || ' hr ' || {m} % 60 || ' min' ELSE {m} // 60 || ' hr' END")


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, body: str, *needs: str) -> None:
    VIEWS[name] = (needs, body)


def with_views(body: str, *names: str) -> str:
    """``body`` preceded by the views it needs; a leading WITH in ``body`` is merged."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    text = body.strip()
    if not parts:
        return text
    if text.upper().startswith("WITH "):
        return f"WITH {parts},\n{text[5:]}"
    return f"WITH {parts}\n{text}"


ORACLE: dict[str, str] = {}


def oracle(key: str, body: str, *views: str) -> None:
    ORACLE[key] = with_views(body, *views)


# --- views ------------------------------------------------------------------------

view("screenings", f"""
SELECT CAST(doc_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id,
  user_id || '-' || strftime(ts, '%Y-%m-%d') AS batch_id, doc_id AS seq, url AS job_url,
  {pick(v.LEVEL_WORDS, "doc_id")} || ' ' || source AS job_title,
  CASE WHEN doc_id % 17 <> 0 THEN source END AS company, text AS jd_text,
  CAST(CASE WHEN rejected THEN 0 ELSE ats END AS INTEGER) AS ats_score,
  CAST(CASE WHEN rejected THEN 0 ELSE role END AS INTEGER) AS role_level_score,
  CASE WHEN rejected THEN 0 ELSE {composite("ats", "role")} END AS composite_score,
  CASE WHEN rejected THEN 'REJECT' WHEN {composite("ats", "role")} >= 80 THEN 'STRONG'
       WHEN {composite("ats", "role")} >= 60 THEN 'DECENT' ELSE 'WEAK' END AS verdict,
  CASE WHEN NOT rejected THEN CAST([] AS VARCHAR[]) WHEN doc_id % 2 = 0 THEN ['rule ' || doc_id % 5]
       ELSE ['rule a', 'rule b'] END AS hard_reject_reasons,
  CASE WHEN doc_id % 3 = 0 THEN text END AS headline,
  CASE WHEN doc_id % 4 <> 0 THEN
    ['APPLY IF ', 'APPLY ', 'SKIP ', 'apply' || {NL}, 'Maybe '][doc_id % 5 + 1] || text END AS recommendation,
  ts AS created_at
FROM (SELECT d.doc_id, d.text, d.source, e.user_id, e.ts, p.url,
        (d.doc_id * 37 + 13) % 101 AS ats, (d.doc_id * 53 + 29) % 101 AS role,
        coalesce(l.toxic, 0) = 1 OR d.doc_id % 7 = 0 AS rejected
      FROM documents d JOIN events e ON e.event_id = d.doc_id
      LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)
""")
view("errored", """
SELECT * REPLACE (
  CASE WHEN seq % 23 = 0 THEN '' ELSE id END AS id,
  CASE WHEN seq % 23 = 0 THEN 'REJECT' ELSE verdict END AS verdict,
  CASE WHEN seq % 23 = 0 THEN 0 ELSE ats_score END AS ats_score,
  CASE WHEN seq % 23 = 0 THEN 0 ELSE role_level_score END AS role_level_score,
  CASE WHEN seq % 23 = 0 THEN 0 ELSE composite_score END AS composite_score)
FROM screenings
""", "screenings")
view("outcomes", """
SELECT s.*, CASE WHEN seq % 211 = 0 THEN 'invalid_key' WHEN seq % 97 = 0 THEN 'rate_limit'
    WHEN seq % 23 = 0 THEN 'item_error' ELSE 'ok' END AS outcome,
  CASE WHEN seq % 211 = 0 OR seq % 97 = 0 OR seq % 23 = 0 THEN
    CASE WHEN seq % 2 = 0 THEN job_title || ': is wrong, ' || job_title || ': is wrong'
         WHEN seq % 3 = 0 AND company IS NOT NULL THEN 'detail ' || company
         WHEN seq % 5 = 0 THEN job_title ELSE 'Server Error' END END AS message
FROM screenings s
""", "screenings")
view("profiles", f"""
SELECT CAST(u AS VARCHAR) AS id, 'u' || u || '@example.com' AS email, c_name AS full_name,
  CASE u % 3 WHEN 1 THEN text WHEN 2 THEN ' ' || {NL} || chr(9) || ' ' END AS resume_text,
  CASE WHEN u % 4 = 1 THEN '' WHEN u % 4 > 1 THEN 'k' || u END AS api_key_encrypted,
  CASE WHEN u % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS api_provider,
  {some(v.DEALBREAKERS, "u % 3 + 1", "u % 6")} AS tech,
  CASE WHEN u % 11 = 10 THEN '' ELSE {pick(v.LEVEL_WORDS, "u")} END AS floor_level,
  {some(v.ALLOWED, "u % 4 + 1", "u % 3")} AS places,
  {some(v.FIRMS[:3], "1", "u % 4")} AS firms,
  {some(v.ROLES_OUT, "u % 2 + 1", "u % 3")} AS roles,
  {some(v.LIKED, "u % 3 + 1", "u % 5")} AS liked,
  {some(v.INDUSTRIES, "1", "u % 4")} AS industries,
  CAST(CASE WHEN u % 5 <> 0 THEN u % 5 * 10 END AS INTEGER) AS min_size,
  CASE WHEN u % 4 <> 0 THEN 1000 END AS max_size, u % 2 = 0 AS onboarded,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'paid' ELSE 'free' END AS tier,
  CAST(u % 7 AS INTEGER) AS screens_used_this_month,
  CASE WHEN u % 2 = 0 THEN 'o' || u END AS pending_order_id,
  TIMESTAMP '2023-12-01 00:00:00' AS updated_at
FROM (SELECT DISTINCT user_id AS u FROM events) JOIN customer ON c_custkey = u
LEFT JOIN documents ON doc_id = u
""")
view("jds", f"""
SELECT id, user_id, batch_id, seq, job_url, job_title, company, {words_of("jd_text")} AS required_skills,
  jd_text || {NL} || 'Location: ' || {pick(v.CITIES, "seq")} || '. Stack: ' || {pick(v.STACKS, "seq")}
  || ', ' || {pick(v.STACKS, "seq // 9")} || '. Type: ' || {pick(v.ROLE_TYPES, "seq // 5")}
  || '. Firm: ' || {pick(v.FIRMS, "seq // 11")} AS jd_text
FROM screenings
""", "screenings")
view("tracker", f"""
SELECT 't' || event_id AS id, CAST(user_id AS VARCHAR) AS user_id,
  CASE WHEN event_id % 10 <> 0 THEN CAST(event_id AS VARCHAR) END AS screening_result_id,
  {pick(v.LEVEL_WORDS, "event_id")} || ' role' AS job_title, 'firm' || event_id % 20 AS company,
  {pick(v.STATUSES, "event_id")} AS status, CASE WHEN event_id % 4 = 0 THEN props END AS notes,
  ts AS created_at, ts + to_hours(CAST(event_id % 48 AS INTEGER)) AS updated_at, event_id
FROM events WHERE event_type = 'click'
""")
view("payments", """
SELECT event_id, ts, event_type,
  CASE WHEN event_id % 13 <> 0 THEN 'u' || user_id || '@example.com' END AS email
FROM events WHERE event_type IN ('purchase', 'error')
""")
view("usage_items", """
SELECT event_id AS item_id, CAST(user_id AS VARCHAR) AS user_id, ts, event_type <> 'error' AS success,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'paid' ELSE 'free' END AS tier
FROM events JOIN customer ON c_custkey = user_id
""")
view("job_pages", """
SELECT page_id,
  CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '[?#].*$', '') || '?currentJobId=4' || page_id ELSE url END AS url,
  replace(replace(replace(html, 'href="/', 'href="/jobs/1' || page_id || '-'),
    '<li>', '<li data-job-id="20000' || page_id || '">'),
    '<p>', '<p class="x" data-entity-urn="urn:li:jobPosting:3' || page_id || '"><a href="/jobs/view/5' || page_id
           || '?currentJobId=6&amp;x=1">l</a>') AS html
FROM pages
""")
view("url_lists", f"""
SELECT page_id AS batch_id, '  ' || url || {NL} || {NL} || ' ' || chr(9) || {NL} || 'not a link' || {NL}
  || regexp_replace(url, '^https?://', '') || ' ' || chr(13) || {NL} || 'www.linkedin.com/jobs' || {NL}
  || 'https://www.linkedin.com/jobs/collections/recommended/?currentJobId=' || page_id || '&origin=x' || {NL}
  || 'https://in.linkedin.com/jobs?x=1' || {NL} || chr(12288) || url || {NL} AS pasted
FROM pages
""")
view("url_items", f"""
SELECT batch_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY pos) - 1 AS INTEGER) AS seq, url
FROM (SELECT batch_id, pos, {trim("line")} AS url
      FROM (SELECT batch_id, unnest(string_split(pasted, {NL})) AS line,
              generate_subscripts(string_split(pasted, {NL}), 1) AS pos FROM url_lists))
WHERE url <> ''
""", "url_lists")
view("noisy", f"""
SELECT doc_id, CASE doc_id % 50 WHEN 1 THEN '  ' || {NL} WHEN 2 THEN replace(text, 'e', chr(1) || chr(2) || 'e')
  WHEN 3 THEN repeat(text, 30) ELSE text END AS text
FROM documents
""")
view("requests", """
SELECT event_id * 2 + again AS request_id, CAST(user_id AS VARCHAR) AS user_id,
  CASE WHEN event_id % 6 <> 0 THEN CAST(event_id AS VARCHAR) END AS screening_result_id,
  'job ' || event_id AS job_title
FROM events, LATERAL (SELECT unnest(CASE WHEN event_id % 3 = 0 THEN [0, 1] ELSE [0] END) AS again)
WHERE event_type IN ('click', 'signup')
""")
view("batches", """
SELECT user_id, batch_id, count(*) AS n, max(created_at) AS last_at, min(seq) AS first_seq
FROM screenings GROUP BY ALL
""", "screenings")
view("confirmations", """
SELECT event_id AS payment_id, CAST(user_id AS VARCHAR) AS user_id,
  'o' || (user_id + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS order_id
FROM events WHERE event_type = 'purchase'
""")
view("updates", f"""
SELECT event_id * 2 + k AS update_id, 't' || event_id AS id,
  CAST(user_id + CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS user_id,
  CASE WHEN (event_id + k) % 8 = 0 THEN 'Hired'
       WHEN (event_id + k) % 3 <> 0 THEN {pick(v.STATUSES, "event_id + k + 1")} END AS status,
  CASE WHEN event_id % 5 <> 0 THEN 'note ' || k END AS notes, (event_id + k) % 4 = 0 AS has_notes,
  ts + to_days(CAST(k + 3 AS INTEGER)) AS ts
FROM events, (SELECT unnest([0, 1]) AS k) WHERE event_type = 'click'
""")
view("detections", """
SELECT *, seq % 5 <> 4 AND seq % 3 = 0 AND seq % 4 IN (0, 1) AS flagged FROM screenings
""", "screenings")
view("required", """
SELECT id, j.user_id, batch_id, unnest(required_skills) AS skill
FROM jds j JOIN (SELECT id AS user_id FROM profiles) USING (user_id)
""", "jds", "profiles")
view("owned", f"""
SELECT CAST(doc_id AS VARCHAR) AS user_id, unnest({words_of("text")}) AS skill FROM documents
""")
view("matched", """
SELECT r.id, r.user_id, r.batch_id, r.skill, o.skill IS NOT NULL AS hit
FROM required r LEFT JOIN owned o ON o.user_id = r.user_id AND o.skill = r.skill
""", "required", "owned")
view("coverage", """
SELECT j.id, count(m.skill) FILTER (hit) AS matching, count(m.skill) FILTER (NOT hit) AS missing,
  md5(coalesce(string_agg(m.skill, '|' ORDER BY m.skill) FILTER (hit), '')) AS matching_md5,
  md5(coalesce(string_agg(m.skill, '|' ORDER BY m.skill) FILTER (NOT hit), '')) AS missing_md5
FROM jds j LEFT JOIN matched m ON m.id = j.id GROUP BY j.id
""", "jds", "matched")


def named(list_name: str, label: str) -> str:
    return (f"list_transform(list_filter({list_name}, lambda x: contains(terms, {terms('x')})), "
            f"lambda x: {q(label)} || x)")


KNOWN = lst(v.KNOWN_LOCATIONS)
view("judged", f"""
SELECT id, list_concat({named("tech", "Tech dealbreaker: ")},
  CASE WHEN title_rank < floor_rank THEN ['Below title floor: ' || floor_level] ELSE [] END,
  CASE WHEN len(places) > 0 AND len(found) > 0
       AND len(list_filter(places, lambda x: contains(terms, {terms("x")}))) = 0
       THEN ['Outside allowed locations: ' || array_to_string(found, ', ')] ELSE [] END,
  {named("firms", "Excluded company type: ")}, {named("roles", "Excluded role type: ")}) AS reasons,
  title_rank, floor_rank
FROM (SELECT *, list_filter({KNOWN}, lambda x: contains(terms, {terms("x")})) AS found
      FROM (SELECT j.id, p.* EXCLUDE (id), {terms(f"concat_ws({NL}, j.job_title, j.company, j.jd_text)")} AS terms,
              {level("j.job_title")} AS title_rank, {level("p.floor_level")} AS floor_rank
            FROM jds j JOIN profiles p ON p.id = j.user_id))
""", "jds", "profiles")
ROLE = "CAST(coalesce(greatest(0, 100 - 20 * abs(title_rank - floor_rank)), 50) AS INTEGER)"
ATS = "CAST(CASE WHEN matching + missing = 0 THEN 0 ELSE (200 * matching + matching + missing) // (2 * (matching + missing)) END AS INTEGER)"
view("native", f"""
SELECT id, ats_score, role_level_score, composite_score,
  CASE WHEN rejected THEN 'REJECT' WHEN composite_score >= 80 THEN 'STRONG'
       WHEN composite_score >= 60 THEN 'DECENT' ELSE 'WEAK' END AS verdict,
  array_to_string(reasons, '|') AS reasons
FROM (SELECT *, CASE WHEN rejected THEN 0 ELSE {composite("ats_score", "role_level_score")} END AS composite_score
      FROM (SELECT id, reasons, len(reasons) > 0 AS rejected,
              CASE WHEN len(reasons) > 0 THEN 0 ELSE {ATS} END AS ats_score,
              CASE WHEN len(reasons) > 0 THEN 0 ELSE {ROLE} END AS role_level_score
            FROM judged JOIN coverage USING (id)))
""", "judged", "coverage")
view("demand", """
SELECT *, CAST((jds * 2000 + total_jds) // (2 * total_jds) AS DOUBLE) / 10 AS percentage,
  CASE WHEN jds * 100 >= 60 * total_jds THEN 'high_demand'
       WHEN jds * 100 >= 30 * total_jds THEN 'moderate' ELSE 'rare' END AS trend
FROM (SELECT batch_id, skill, count(DISTINCT id) AS jds,
        CAST(row_number() OVER (PARTITION BY batch_id ORDER BY count(DISTINCT id) DESC, skill) AS INTEGER) AS rank
      FROM matched GROUP BY batch_id, skill QUALIFY rank <= 8)
JOIN (SELECT batch_id, count(*) AS total_jds FROM screenings GROUP BY batch_id) USING (batch_id)
""", "matched", "screenings")
view("missing_top", """
SELECT batch_id, skill, count(DISTINCT id) AS jds,
  CAST(row_number() OVER (PARTITION BY batch_id ORDER BY count(DISTINCT id) DESC, skill) AS INTEGER) AS rank
FROM matched WHERE NOT hit GROUP BY batch_id, skill QUALIFY rank <= 8
""", "matched")
view("links", f"""
SELECT page_id, url, pos, replace(regexp_replace(raw, {q('''^["']|["']$''')}, '', 'g'), '&amp;', '&') AS href
FROM (SELECT page_id, url, unnest(l) AS raw, generate_subscripts(l, 1) AS pos
      FROM (SELECT page_id, url, regexp_extract_all(
              regexp_replace(html, {q(HIDDEN_MARKUP)}, '', 'g'), {q(HREF)}, 1) AS l FROM job_pages))
""", "job_pages")

# --- sources and sinks --------------------------------------------------------------

oracle("a1_scan_screenings", f"""
SELECT id, user_id, batch_id, job_url, job_title, company, CAST(length(jd_text) AS INTEGER) AS chars,
  composite_score, verdict, array_to_string(hard_reject_reasons, '|') AS reasons, {ts("created_at")} AS created
FROM screenings""", "screenings")
oracle("a2_scan_profiles", """
SELECT id, email, full_name, tier, screens_used_this_month, array_to_string(tech, '|') AS tech,
  floor_level AS floor, array_to_string(liked, '|') AS liked, min_size, onboarded
FROM profiles""", "profiles")
oracle("a3_scan_tracker", f"""
SELECT id, user_id, screening_result_id, company, status, notes, {ts("created_at")} AS created,
  {ts("updated_at")} AS updated FROM tracker""", "tracker")
oracle("a4_scan_reports", """
SELECT batch_id, id, job_title, composite_score, verdict, CAST(length(jd_text) AS INTEGER) AS chars
FROM screenings""", "screenings")
oracle("a5_decode_analysis", """
SELECT id, seq % 10 <> 4 AS analysis_ok, CASE WHEN full_doc THEN verdict END AS verdict,
  CASE WHEN full_doc THEN composite_score END AS composite,
  CASE WHEN full_doc THEN array_to_string(hard_reject_reasons, '|') END AS reasons,
  CASE WHEN full_doc THEN CAST(length(headline) AS INTEGER) END AS headline_chars
FROM (SELECT *, seq % 10 NOT IN (3, 4, 5) AS full_doc FROM screenings)""", "screenings")
oracle("a6_parse_model_output", """
SELECT id, ok, CASE WHEN ok THEN floor_level END AS floor,
  CASE WHEN ok THEN array_to_string(liked, '|') END AS liked, CASE WHEN ok THEN min_size END AS min_size
FROM (SELECT *, CAST(id AS BIGINT) % 4 <> 3 AS ok FROM profiles)""", "profiles")
oracle("a7_append_screenings", """
SELECT id, CASE WHEN bad_verdict THEN 'MAYBE' ELSE verdict END AS verdict,
  array_to_string(list_concat(CASE WHEN seq % 29 = 0 THEN ['ats_score is missing'] ELSE [] END,
    CASE WHEN bad_verdict THEN ['verdict is not allowed: MAYBE'] ELSE [] END), '|') AS problems
FROM (SELECT *, seq % 19 = 0 AS bad_verdict FROM screenings)""", "screenings")
EXPORT = """
SELECT batch_id, job_title AS "Job Title", coalesce(company, '') AS "Company", coalesce(job_url, '') AS "URL",
  {number}ats_score{end} AS "ATS Score", {number}role_level_score{end} AS "Role Level Score",
  {number}composite_score{end} AS "Composite Score", verdict AS "Verdict",
  array_to_string(hard_reject_reasons, '; ') AS "Hard Reject Reasons",
  strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS "Screened At"
FROM screenings"""
oracle("a8_export_rows", EXPORT.format(number="", end=""), "screenings")
oracle("a8_export_batches_csv", EXPORT.format(number="CAST(", end=" AS VARCHAR)"), "screenings")
oracle("a8_export_all_csv", EXPORT.format(number="CAST(", end=" AS VARCHAR)").replace(
    "SELECT batch_id,", "SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY composite_score DESC, seq) AS place,"), "screenings")
oracle("a9_export_ranked_csv", """
SELECT batch_id, coalesce(company, '') AS "Company", job_title AS "Job Title", ats_score::VARCHAR AS "ATS %",
  role_level_score::VARCHAR AS "Role Fit %", composite_score::VARCHAR AS "Composite %", verdict AS "Verdict"
FROM screenings""", "screenings")
ORACLE["a8_export_all_crlf"] = ORACLE["a8_export_all_csv"]
ORACLE["a9_export_ranked_crlf"] = ORACLE["a9_export_ranked_csv"]
oracle("a7_append_runs", """
SELECT id, CASE WHEN seq % 3 <> 2 THEN 'a' ELSE 'b' END AS run, '' AS problems FROM screenings
UNION ALL SELECT id, 'b', 'id is already stored' FROM screenings WHERE seq % 3 = 1""", "screenings")
oracle("e2_track_runs", """
SELECT run || seq AS id, user_id, id AS screening_result_id, run
FROM (SELECT *, CASE WHEN seq % 4 <> 3 THEN 'a' ELSE 'b' END AS run FROM screenings)""", "screenings")
oracle("a9_ranked_rows", """
SELECT batch_id, seq, coalesce(company, '') AS "Company", job_title AS "Job Title", ats_score AS "ATS %",
  role_level_score AS "Role Fit %", composite_score AS "Composite %", verdict AS "Verdict"
FROM screenings""", "screenings")
oracle("a9_time_saved_summary", f"""
SELECT batch_id, count(*) AS rejects, {saved("count(*)")} AS saved
FROM screenings WHERE verdict = 'REJECT' GROUP BY batch_id""", "screenings")
oracle("a10_intake_documents", f"""
SELECT path, length, kind, CASE
  WHEN length > {K.MAX_FILE_BYTES} THEN 'File too large. Max size is 5 MB (got ' || printf('%.1f', length / 1048576) || ' MB).'
  WHEN kind NOT IN ('pdf', 'txt') THEN {q(K.UNSUPPORTED_FILE)}
  WHEN kind = 'pdf' AND NOT starts_with(body, '%PDF-') THEN {q(K.NOT_PDF)}
  WHEN kind = 'pdf' AND regexp_matches(body, {q(K.ACTIVE_PDF_CONTENT)}) THEN {q(K.ACTIVE_PDF)} END AS problem
FROM (SELECT '/in/d' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.docx' ELSE '.PDF' END AS path,
        CASE doc_id % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'docx' ELSE 'pdf' END AS kind, body,
        CASE WHEN doc_id % 10 = 8 THEN strlen(body) * 10000 ELSE strlen(body) END AS length
      FROM (SELECT doc_id, CASE WHEN doc_id % 5 <> 2 THEN '%PDF-1.7' || {NL} ELSE '' END || text
              || CASE doc_id % 10 WHEN 3 THEN '/JS  (x)' WHEN 4 THEN '/AA<<' ELSE '' END AS body FROM documents))""")

# --- ingestion ------------------------------------------------------------------------

oracle("b1_explode_url_list", "SELECT batch_id, seq, url FROM url_items", "url_items")
oracle("b2_count_valid_urls", r"""
SELECT batch_id, CAST(count(*) FILTER (starts_with(url, 'http') OR regexp_matches(url, '^[\w-]+\.\w+')) AS INTEGER) AS valid
FROM url_items GROUP BY batch_id""", "url_items")
oracle("b3_drop_blank", f"""
SELECT doc_id, CAST(length(text) AS INTEGER) AS chars FROM noisy WHERE {trim("text")} <> ''""", "noisy")
oracle("b4_normalize_job_url", """
SELECT batch_id, seq, CASE
  WHEN contains(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), 'linkedin.com')
   AND regexp_matches(url, '[?&]currentJobId=')
  THEN 'https://www.linkedin.com/jobs/view/' || regexp_extract(url, '[?&]currentJobId=([^&#]*)', 1) || '/'
  ELSE url END AS job_url
FROM url_items""", "url_items")
oracle("b5_extract_job_links", f"""
WITH parts AS (
  SELECT *, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)//', 1) AS scheme,
    regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS origin,
    regexp_replace(url, '#.*$', '') AS page, regexp_replace(url, '[?#].*$', '') AS bare
  FROM links),
resolved AS (
  SELECT page_id, pos, CASE
    WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href
    WHEN starts_with(href, '//') THEN scheme || href WHEN starts_with(href, '/') THEN origin || href
    WHEN starts_with(href, '?') THEN bare || href
    WHEN href = '' OR starts_with(href, '#') THEN page || href
    ELSE CASE WHEN bare = origin THEN bare || '/' ELSE regexp_replace(bare, '[^/]*$', '') END || href END AS job_url
  FROM parts)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) - 1 AS INTEGER) AS seq, job_url
FROM resolved
WHERE NOT starts_with(job_url, '#') AND NOT regexp_matches(job_url, '(?i)^mailto:')
  AND regexp_matches(job_url, {q("(?i)(?:" + "|".join(K.JOB_LINK_PATTERNS) + ")")})
GROUP BY page_id, job_url""", "links")
oracle("b6_extract_posting_ids", rf"""
WITH clean AS (SELECT page_id, regexp_replace(html, {q(HIDDEN_MARKUP)}, '', 'g') AS html FROM job_pages),
by_id AS (SELECT page_id, 1 AS part, generate_subscripts(l, 1) AS pos, unnest(l) AS posting_id
  FROM (SELECT page_id, regexp_extract_all(html, '<li{SPACE}data-job-id="(\d{{5,}})"', 1) AS l FROM clean)),
by_urn AS (SELECT page_id, 2, generate_subscripts(l, 1), unnest(l)
  FROM (SELECT page_id, regexp_extract_all(html, 'data-entity-urn="urn:li:jobPosting:(\d+)"', 1) AS l FROM clean)),
by_link AS (SELECT page_id, 3, pos, coalesce(nullif(regexp_extract(href, '/jobs/view/(\d+)', 1), ''),
    regexp_extract(href, '[?&]currentJobId=(\d+)', 1)) FROM links),
own AS (SELECT page_id, 4, 0, regexp_extract(url, '[?]currentJobId=(\d+)$', 1) FROM job_pages),
everything AS (SELECT * FROM by_id UNION ALL SELECT * FROM by_urn UNION ALL SELECT * FROM by_link UNION ALL SELECT * FROM own),
firsts AS (SELECT page_id, posting_id, min(part * CAST(1000000000 AS BIGINT) + pos) AS place FROM everything
  WHERE posting_id <> '' GROUP BY page_id, posting_id)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS INTEGER) AS seq, posting_id,
  'https://www.linkedin.com/jobs/view/' || posting_id || '/' AS job_url
FROM firsts QUALIFY seq < 20""", "links")
oracle("b7_validate_text", f"""
SELECT doc_id, CAST(length(t) AS INTEGER) AS chars, CASE
  WHEN t = '' THEN {q(K.EMPTY_TEXT)}
  WHEN 100 * (length(t) - length(regexp_replace(t, '{K.CONTROL_CHARS}', '', 'g'))) > 15 * length(t) THEN {q(K.BINARY_TEXT)}
  WHEN length(t) > 50000 THEN {q(K.LONG_TEXT)} END AS problem
FROM (SELECT doc_id, {trim("text")} AS t FROM noisy)""", "noisy")
oracle("b8_word_count", f"""
SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '{K.WS}+'), lambda w: w <> '')) AS INTEGER) AS words
FROM documents""")
oracle("b9_lists", f"""
WITH items AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '[.\\n]', ',', 'g'), ','),
    lambda x: {trim("x")}), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, CAST(len(l) AS INTEGER) AS items, md5(array_to_string(l, ', ')) AS joined,
  CAST(len(l) + CASE WHEN list_contains(l, 'new') THEN 0 ELSE 1 END AS INTEGER) AS tags,
  CASE WHEN list_contains(l, 'new') THEN l[-1] ELSE 'new' END AS last_tag
FROM items""")
oracle("b10_overlay_profile", """
SELECT id, CASE WHEN n % 2 = 0 THEN 'Rust|Go' ELSE array_to_string(liked, '|') END AS liked,
  array_to_string(industries, '|') AS industries,
  CASE WHEN n % 2 = 0 THEN 7 ELSE min_size END AS min_size, max_size,
  CASE WHEN n % 3 = 0 THEN floor_level ELSE 'Lead' END AS floor,
  CASE WHEN n % 5 = 0 THEN 'Spain' ELSE array_to_string(places, '|') END AS places,
  array_to_string(tech, '|') AS tech, 'night' AS roles
FROM (SELECT *, CAST(id AS BIGINT) AS n FROM profiles)""", "profiles")
oracle("b11_cap_batch", """
SELECT 'u' || user_id AS batch_id, item_id AS seq FROM usage_items
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY item_id) <= 10
UNION ALL SELECT CAST(batch_id AS VARCHAR), CAST(seq AS BIGINT) FROM url_items WHERE seq < 20""",
       "usage_items", "url_items")

# --- predicates -----------------------------------------------------------------------

oracle("c1_tenant_scope", """
SELECT id, user_id FROM screenings
WHERE user_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING')""", "screenings")
oracle("c2_filter_history", """
SELECT id, company, job_title, verdict FROM screenings
WHERE verdict = 'WEAK' AND (lower(company) LIKE '%src1%' OR lower(job_title) LIKE '%src1%')""", "screenings")
oracle("c3_live_reports", f"""
SELECT substr(md5(batch_id), 1, 16) AS slug, {ts("last_at + INTERVAL 30 DAY")} AS expires
FROM batches WHERE last_at + INTERVAL 30 DAY > TIMESTAMP '{NOW}'""", "batches")
ORACLE["c3_stored_reports"] = ORACLE["c3_live_reports"]
oracle("c4_split_results", """
SELECT seq, id, CASE WHEN id = '' THEN 'error' WHEN verdict = 'REJECT' THEN 'reject' ELSE 'good' END AS part
FROM errored""", "errored")
oracle("c5_constraint_violations", """
SELECT id, array_to_string(problems, '|') AS problems FROM (
  SELECT id, list_concat(
    CASE WHEN event_id % 8 <> 0 AND event_id % 9 = 0 THEN ['status is missing'] ELSE [] END,
    CASE WHEN event_id % 5 = 0 THEN ['updated_at is missing'] ELSE [] END,
    CASE WHEN event_id % 8 = 0 THEN ['status is not allowed: Hired'] ELSE [] END) AS problems
  FROM tracker) WHERE len(problems) > 0""", "tracker")
oracle("c6_inflated_manager", "SELECT id, flagged FROM detections", "detections")

# --- scoring and scalar columns -----------------------------------------------------------

oracle("d1_effective_resume", f"""
SELECT id, CASE WHEN {trim("coalesce(resume_text, '')")} <> '' THEN {trim("resume_text")} ELSE concat_ws({NL},
  CASE WHEN len(liked) > 0 THEN 'Technical skills: ' || array_to_string(liked, ', ') END,
  CASE WHEN len(industries) > 0 THEN 'Industries: ' || array_to_string(industries, ', ') END,
  CASE WHEN floor_level <> '' THEN 'Seniority: ' || floor_level END,
  CASE WHEN len(places) > 0 THEN 'Preferred locations: ' || array_to_string(places, ', ') END) END AS resume
FROM profiles""", "profiles")
oracle("d2_composite_score", """
SELECT id, ats_score, role_level_score,
  CAST(floor((45 * ats_score + 55 * role_level_score) / 100.0 + 0.5) AS INTEGER) AS composite
FROM screenings""", "screenings")
oracle("d3_hard_rejects", """
SELECT id, array_to_string(reasons, '|') AS reasons, len(reasons) > 0 AS rejected FROM judged""", "judged")
oracle("d4_ats_coverage", f"""
SELECT id, CAST(matching AS INTEGER) AS matching, CAST(missing AS INTEGER) AS missing, matching_md5, missing_md5,
  {ATS} AS ats_score FROM coverage""", "coverage")
def _found_terms(source: str) -> str:
    """Terms of the passages in the texts of ``source(id, text)``: every run of words is tried."""
    def split(x: str) -> str:
        return f"string_split(trim({terms(x)}), ' ')"
    return f"""
dict AS (SELECT DISTINCT term, len(string_split(term, ' ')) AS n FROM (
  SELECT unnest([array_to_string(w[:k], ' ') for k in [1, 2, 3, 4]] || [array_to_string(w[len(w) - 1:], ' ')]) AS term
  FROM (SELECT {split("text")} AS w FROM benchmark) WHERE len(w) >= 4) WHERE term <> ''),
texts AS (SELECT id, {split("coalesce(text, '')")} AS w FROM ({source})),
places AS (SELECT id, w, unnest(range(len(w))) AS place FROM texts),
runs AS (SELECT id, place, n, array_to_string(w[place + 1:place + n], ' ') AS term FROM places, (SELECT DISTINCT n FROM dict) WHERE place + n <= len(w)),
here AS (SELECT id, place, max(n) AS n, arg_max(term, n) AS term FROM runs SEMI JOIN dict USING (term) GROUP BY id, place),
found AS (SELECT id, place, n, term FROM here QUALIFY coalesce(max(place + n) OVER (
  PARTITION BY id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < place + n)"""


oracle("d4_skills_in_text", f"""
WITH {_found_terms("SELECT doc_id AS id, text FROM documents")}
SELECT id, CAST(place AS INTEGER) AS place, CAST(n AS INTEGER) AS words, term FROM found""")
oracle("d4_coverage_from_text", f"""
WITH {_found_terms("SELECT id, jd_text AS text FROM jds")},
hits AS (SELECT f.id, term AS skill, o.skill IS NOT NULL AS hit FROM (SELECT DISTINCT id, term FROM found) f JOIN jds j ON j.id = f.id
  LEFT JOIN owned o ON o.user_id = j.user_id AND o.skill = f.term),
coverage AS (SELECT j.id, count(skill) FILTER (hit) AS matching, count(skill) FILTER (NOT hit) AS missing,
  md5(coalesce(string_agg(skill, '|' ORDER BY skill) FILTER (hit), '')) AS matching_md5,
  md5(coalesce(string_agg(skill, '|' ORDER BY skill) FILTER (NOT hit), '')) AS missing_md5
  FROM jds j LEFT JOIN hits h ON h.id = j.id GROUP BY j.id)
SELECT id, CAST(matching AS INTEGER) AS matching, CAST(missing AS INTEGER) AS missing, matching_md5, missing_md5,
  {ATS} AS ats_score FROM coverage""", "jds", "owned")
oracle("d4_skill_spelling", f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda x: length(x) >= 2) AS w FROM documents),
s AS (SELECT doc_id, w || list_transform(w, lambda x: upper(x)) AS w FROM w),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM s),
wanted AS (SELECT doc_id, lower(x) AS low, arg_min(x, i) AS x, min(i) AS i FROM words GROUP BY ALL),
hits AS (SELECT j.*, EXISTS (SELECT 1 FROM wanted o WHERE o.doc_id = j.doc_id + 1 AND o.low = j.low) AS hit FROM wanted j),
sums AS (SELECT doc_id, count(*) FILTER (hit) AS a, count(*) FILTER (NOT hit) AS b, string_agg(x, '|' ORDER BY i) FILTER (hit) AS xs,
  string_agg(x, '|' ORDER BY i) FILTER (NOT hit) AS ys FROM hits GROUP BY doc_id)
SELECT CAST(d.doc_id AS VARCHAR) AS id, CAST(coalesce(a, 0) AS INTEGER) AS matching, CAST(coalesce(b, 0) AS INTEGER) AS missing,
  md5(coalesce(xs, '')) AS matching_md5, md5(coalesce(ys, '')) AS missing_md5,
  CAST(CASE WHEN coalesce(a + b, 0) > 0 THEN (200 * a + a + b) // (2 * (a + b)) ELSE 0 END AS INTEGER) AS ats_score
FROM documents d LEFT JOIN sums USING (doc_id) WHERE d.doc_id < (SELECT max(doc_id) FROM documents)""")
oracle("d4_ats_coverage_weighted", """
WITH weighed AS (SELECT id, hit, CASE WHEN length(skill) > 4 THEN length(skill) ELSE 1 END AS weight FROM matched),
sums AS (SELECT id, sum(weight) AS whole, coalesce(sum(weight) FILTER (hit), 0) AS part FROM weighed GROUP BY id)
SELECT j.id, CAST(coalesce((200 * part + whole) // (2 * whole), 0) AS INTEGER) AS ats_score
FROM jds j LEFT JOIN sums USING (id)""", "matched", "jds")
oracle("d5_role_level_score", f"SELECT id, {ROLE} AS role_level_score FROM judged", "judged")
oracle("d6_verdict", "SELECT id, composite_score, verdict FROM screenings", "screenings")
oracle("d7_verdict_label", """
SELECT id, verdict, CASE verdict WHEN 'STRONG' THEN 'Excellent Match' WHEN 'DECENT' THEN 'Worth Applying'
  WHEN 'WEAK' THEN 'Low Priority' WHEN 'REJECT' THEN 'Skip This One' ELSE 'Unknown' END AS label
FROM (SELECT id, CASE WHEN seq % 31 = 0 THEN 'OTHER' ELSE verdict END AS verdict FROM screenings)""", "screenings")
oracle("d8_score_band", """
SELECT id, ats_score, CASE WHEN ats_score >= 70 THEN 'green' WHEN ats_score >= 50 THEN 'amber' ELSE 'red' END AS band
FROM screenings""", "screenings")
oracle("d9_why_verdict", """
SELECT id, CASE verdict
  WHEN 'STRONG' THEN 'STRONG: skills (' || a || ') and level (' || r || ') are both where they should be.'
  WHEN 'DECENT' THEN CASE WHEN a < r THEN 'DECENT: the level suits well (' || r || '), yet ' || CASE
      WHEN seq % 4 = 0 THEN 'the ATS score of ' || a || ' is middling'
      ELSE seq % 4 || ' required skill' || CASE WHEN seq % 4 <> 1 THEN 's' ELSE '' END
           || ' absent, ATS only ' || a END || '.'
    ELSE 'DECENT: the skills mostly match (' || a || '), the level (' || r || ') only in part.' END
  WHEN 'WEAK' THEN CASE
    WHEN a < 50 AND r < 50 THEN 'WEAK: neither the skills (' || a || ') nor the level (' || r || ') reach what is needed.'
    WHEN a < r THEN 'WEAK: too few of the skills match (' || a || '), although the level may do (' || r || ').'
    ELSE 'WEAK: the level is far off (' || r || ').' END
  ELSE 'REJECT without a score: ' || CASE WHEN seq % 21 <> 0 AND len(hard_reject_reasons) > 0
    THEN 'it breaks the rule ' || hard_reject_reasons[1] ELSE 'it breaks one of your rules' END || '.' END AS why
FROM (SELECT *, ats_score AS a, role_level_score AS r FROM screenings)""", "screenings")
oracle("d10_reason_line", f"""
SELECT id, CASE WHEN verdict = 'REJECT' THEN coalesce(hard_reject_reasons[1], 'Breaks a rule')
  WHEN long_text IS NULL THEN '' WHEN length(long_text) > 90 THEN substring(long_text, 1, 90) || '…' ELSE long_text END AS reason
FROM (SELECT id, verdict, hard_reject_reasons, coalesce(nullif(headline, ''),
        regexp_replace(nullif(recommendation, ''), '^(?i:APPLY IF|APPLY|SKIP){K.WS}*', '')) AS long_text FROM screenings)""",
       "screenings")
oracle("d11_recommendation_action", """
SELECT id, CASE WHEN starts_with(recommendation, 'APPLY IF') THEN 'APPLY IF'
  WHEN starts_with(recommendation, 'APPLY') THEN 'APPLY' WHEN starts_with(recommendation, 'SKIP') THEN 'SKIP' END AS action
FROM screenings""", "screenings")
oracle("d12_score_breakdown", """
SELECT id, CASE WHEN verdict <> 'REJECT' THEN 'Composite ' || composite_score || ' = (ATS ' || ats_score
  || ' × 0.45) + (Role ' || role_level_score || ' × 0.55) = ' || tenths // 10 || '.' || tenths % 10 END AS breakdown
FROM (SELECT *, (45 * ats_score + 55 * role_level_score + 5) // 10 AS tenths FROM screenings)""", "screenings")
oracle("d13_time_saved", f"SELECT id, {saved('seq % 40')} AS saved FROM screenings", "screenings")
oracle("d14_active_rules", """
SELECT id, array_to_string(list_concat(tech[1:4], CASE WHEN len(tech) > 4 THEN ['+' || (len(tech) - 4) || ' more'] ELSE [] END,
  CASE WHEN floor_level <> '' THEN ['Below ' || floor_level] ELSE [] END,
  CASE WHEN len(places) > 0 THEN ['Outside ' || array_to_string(places[1:2], '/')] ELSE [] END,
  firms[1:2], roles[1:2]), '|') AS rules
FROM profiles""", "profiles")
oracle("d15_profile_completeness", """
WITH filled AS (SELECT id, len(liked) > 0 OR len(industries) > 0 OR min_size IS NOT NULL OR max_size IS NOT NULL AS p,
    len(tech) > 0 OR floor_level <> '' OR len(places) > 0 OR len(firms) > 0 OR len(roles) > 0 AS f,
    coalesce(api_key_encrypted, '') <> '' AS k FROM profiles),
scored AS (SELECT *, CAST(CASE WHEN p THEN 40 ELSE 0 END + CASE WHEN f THEN 30 ELSE 0 END
    + CASE WHEN k THEN 30 ELSE 0 END AS INTEGER) AS score FROM filled)
SELECT id, score, CASE WHEN score >= 80 THEN 'green' WHEN score >= 50 THEN 'amber' ELSE 'red' END AS band,
  CASE WHEN NOT p THEN 'Fill in what you look for, or add a resume'
    WHEN NOT f THEN 'Write down what rules a job out'
    WHEN NOT k THEN 'Store an API key so that jobs can be screened' END AS next_action
FROM scored""", "profiles")
oracle("d16_onboarding_flags", """
SELECT id, coalesce(resume_text, '') = '' AND coalesce(api_key_encrypted, '') = '' AND len(liked) = 0
    AND len(industries) = 0 AND coalesce(min_size, 0) = 0 AND coalesce(max_size, 0) = 0 AND NOT onboarded AS is_new,
  len(liked) > 0 OR len(industries) > 0 OR floor_level <> '' OR len(places) > 0 AS has_preferences
FROM profiles""", "profiles")
oracle("d17_safe_profiles", """
SELECT id, email, full_name, resume_text, api_provider, tier, screens_used_this_month,
  coalesce(api_key_encrypted, '') <> '' AS has_api_key FROM profiles""", "profiles")
oracle("d18_assemble_results", """
SELECT seq, CASE WHEN ok THEN id ELSE '' END AS id, user_id, batch_id, job_url,
  CASE WHEN seq % 3 = 0 THEN 'typed title' WHEN ok THEN job_title END AS job_title,
  CASE WHEN seq % 4 = 0 THEN '' WHEN ok THEN company END AS company,
  CAST(length(CASE WHEN seq % 2 = 0 THEN 'typed text' WHEN ok THEN jd_text ELSE '' END) AS INTEGER) AS chars,
  CASE WHEN ok THEN ats_score ELSE 0 END AS ats_score, CASE WHEN ok THEN role_level_score ELSE 0 END AS role_level_score,
  CASE WHEN ok THEN composite_score ELSE 0 END AS composite_score, CASE WHEN ok THEN verdict ELSE 'REJECT' END AS verdict,
  CASE WHEN ok THEN array_to_string(hard_reject_reasons, '|') ELSE message END AS reasons
FROM (SELECT *, outcome = 'ok' AS ok FROM outcomes)""", "outcomes")
oracle("d19_classify_outcome", "SELECT seq, outcome, message FROM outcomes", "outcomes")

# --- joins ------------------------------------------------------------------------------

oracle("e1_with_tracked_flag", """
SELECT id, EXISTS (SELECT 1 FROM tracker t WHERE t.screening_result_id = s.id AND t.user_id = s.user_id) AS tracked
FROM screenings s""", "screenings", "tracker")
oracle("e2_track", """
WITH linked AS (SELECT * FROM requests WHERE screening_result_id IS NOT NULL),
fresh AS (SELECT * FROM linked r WHERE NOT EXISTS (SELECT 1 FROM tracker t
    WHERE t.user_id = r.user_id AND t.screening_result_id = r.screening_result_id)
  QUALIFY row_number() OVER (PARTITION BY user_id, screening_result_id ORDER BY request_id) = 1)
SELECT CAST(request_id AS VARCHAR) AS id, user_id, screening_result_id, job_title, 'Applied' AS status, 'new' AS kind
FROM (SELECT * FROM fresh UNION ALL SELECT * FROM requests WHERE screening_result_id IS NULL)
UNION ALL SELECT id, user_id, screening_result_id, job_title, status, 'existing' FROM tracker t
WHERE EXISTS (SELECT 1 FROM linked r WHERE t.user_id = r.user_id AND t.screening_result_id = r.screening_result_id)""",
       "requests", "tracker")
oracle("e3_report_with_owner", """
SELECT substr(md5(batch_id), 1, 16) AS slug, full_name
FROM batches b LEFT JOIN profiles p ON p.id = b.user_id AND p.tier = 'free'""", "batches", "profiles")
oracle("e4_with_profile", """
SELECT j.id, p.email, p.tier FROM jds j LEFT JOIN profiles p ON p.id = j.user_id AND p.api_key_encrypted <> ''""",
       "jds", "profiles")
oracle("e5_flag_in_profile", """
SELECT batch_id, upper(skill[1]) || skill[2:] AS skill, jds, EXISTS (
  SELECT 1 FROM matched m WHERE m.hit AND m.batch_id = d.batch_id AND m.skill = d.skill) AS in_profile
FROM demand d""", "demand", "matched")
oracle("e6_owned_orders", """
SELECT c.* FROM confirmations c JOIN profiles p ON p.id = c.user_id AND p.pending_order_id = c.order_id""",
       "confirmations", "profiles")
oracle("e6_confirm_orders", """
SELECT id, CASE WHEN c THEN 'paid' ELSE tier END AS tier, CASE WHEN NOT c THEN pending_order_id END AS pending_order_id
FROM (SELECT *, EXISTS (SELECT 1 FROM confirmations f WHERE f.user_id = p.id AND f.order_id = p.pending_order_id) AS c
      FROM profiles p)""", "confirmations", "profiles")
oracle("e7_delete_profiles", """
WITH gone AS (SELECT id FROM profiles WHERE tier = 'paid')
SELECT id, 'profiles' AS kind FROM profiles WHERE tier <> 'paid'
UNION ALL SELECT id, 'results' FROM screenings WHERE user_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT id, 'tracker' FROM tracker WHERE user_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT batch_id, 'reports' FROM batches WHERE user_id NOT IN (SELECT id FROM gone)""",
       "profiles", "screenings", "tracker", "batches")
oracle("e7_delete_results", """
SELECT id, NULL AS link, 'result' AS kind FROM screenings WHERE verdict <> 'REJECT'
UNION ALL SELECT t.id, CASE WHEN s.id IS NULL THEN screening_result_id END, 'tracker'
FROM tracker t LEFT JOIN screenings s ON s.id = t.screening_result_id AND s.verdict = 'REJECT'""",
       "screenings", "tracker")

# --- aggregations -------------------------------------------------------------------------

oracle("f1_batch_rollup", f"""
WITH recent AS (SELECT * FROM screenings
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) <= 20)
SELECT user_id, batch_id, {ts("max(created_at)")} AS batch_at, count(*) AS rows,
  string_agg(id, '|' ORDER BY created_at DESC, id) AS ids
FROM recent GROUP BY user_id, batch_id""", "screenings")
oracle("f2_verdict_counts", """
SELECT batch_id, count(*) FILTER (id <> '' AND verdict = 'STRONG') AS strong,
  count(*) FILTER (id <> '' AND verdict = 'DECENT') AS decent, count(*) FILTER (id <> '' AND verdict = 'WEAK') AS weak,
  count(*) FILTER (id <> '' AND verdict = 'REJECT') AS reject,
  count(*) FILTER (id <> '' AND verdict <> 'REJECT') AS worth_a_look
FROM errored GROUP BY batch_id""", "errored")
oracle("f3_lifetime_saved", f"""
SELECT user_id, count(*) AS rejects, {saved("count(*)")} AS saved
FROM screenings WHERE verdict = 'REJECT' GROUP BY user_id""", "screenings")
oracle("f4_history_tallies", """
SELECT user_id, count(*) FILTER (shown) AS filtered_rows, count(*) AS total_rows,
  count(DISTINCT batch_id) FILTER (shown) AS batches_left
FROM (SELECT *, verdict = 'WEAK' AND (lower(company) LIKE '%src1%' OR lower(job_title) LIKE '%src1%') AS shown FROM screenings)
GROUP BY user_id""", "screenings")
oracle("f5_skill_demand", "SELECT batch_id, skill, jds, rank, total_jds, percentage, trend FROM demand", "demand")
oracle("f6_top_missing_cut", "SELECT batch_id, skill, jds, rank FROM missing_top", "missing_top")
oracle("f6_top_missing", """
SELECT batch_id, skill, count(DISTINCT id) AS jds,
  CAST(row_number() OVER (PARTITION BY batch_id ORDER BY count(DISTINCT id) DESC, skill) AS INTEGER) AS rank
FROM matched WHERE NOT hit GROUP BY batch_id, skill""", "matched")
oracle("f7_batch_matching_skills", "SELECT DISTINCT batch_id, skill FROM matched WHERE hit", "matched")
TITLES = """
SELECT {key} AS batch_id, lower(job_title) AS pattern, count(*) AS jds,
  CAST(row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, lower(job_title)) AS INTEGER) AS rank
FROM screenings GROUP BY 1, 2 QUALIFY rank <= 5"""
oracle("f8_title_patterns_cut", TITLES.format(key="user_id"), "screenings")
oracle("f8_title_patterns", TITLES.format(key="user_id").replace(" QUALIFY rank <= 5", ""), "screenings")
oracle("f9_red_flag_count", """
SELECT batch_id, count(*) FILTER (flagged) AS red_flags_count FROM detections GROUP BY batch_id""", "detections")
oracle("f10_min_batch", """
SELECT batch_id, count(*) AS total_jds FROM screenings GROUP BY batch_id HAVING count(*) >= 3""", "screenings")
oracle("f11_blocking_skills", """
WITH worst AS (SELECT user_id, skill, row_number() OVER (PARTITION BY user_id ORDER BY count(DISTINCT id) DESC, skill) AS r
  FROM matched WHERE NOT hit GROUP BY user_id, skill QUALIFY r <= 2),
blocked AS (SELECT m.user_id, count(DISTINCT id) AS blocked_jds FROM matched m
  JOIN worst w ON w.user_id = m.user_id AND w.skill = m.skill WHERE NOT hit GROUP BY m.user_id),
totals AS (SELECT user_id, count(*) AS jds FROM screenings GROUP BY user_id)
SELECT user_id, (SELECT string_agg(skill, '|' ORDER BY r) FROM worst w WHERE w.user_id = b.user_id) AS blockers,
  blocked_jds, jds, CAST((200 * blocked_jds + jds) // (2 * jds) AS INTEGER) AS blocked_percent
FROM blocked b JOIN totals USING (user_id)""", "matched", "screenings")
oracle("f12_explode_requirements", """
SELECT id, CAST(i AS INTEGER) AS seq, string_split(job_title, ' ')[i + 1] AS requirement,
  ['met', 'partial', 'missing', 'unclear'][(s.seq + i) % 4 + 1] AS status, company AS evidence,
  ['✓', '◐', '✗', '✗'][(s.seq + i) % 4 + 1] AS mark
FROM screenings s, (SELECT unnest([0, 1]) AS i) WHERE s.seq % 6 <> 0""", "screenings")
oracle("f13_apply_usage", """
SELECT id, CAST(screens_used_this_month + (SELECT count(*) FROM usage_items u WHERE u.user_id = p.id AND success) AS INTEGER)
  AS screens_used_this_month FROM profiles p""", "profiles", "usage_items")
oracle("f14_batch_intelligence", f"""
WITH titles AS ({TITLES.format(key="batch_id")}),
d AS (SELECT batch_id, string_agg(skill || ':' || jds || ':' || trend, '|' ORDER BY rank) AS required FROM demand GROUP BY batch_id),
m AS (SELECT batch_id, string_agg(skill, '|' ORDER BY rank) AS missing FROM missing_top GROUP BY batch_id),
t AS (SELECT batch_id, string_agg(pattern, '|' ORDER BY rank) AS titles FROM titles GROUP BY batch_id)
SELECT batch_id, total_jds, red_flags_count, required, coalesce(missing, '') AS missing, coalesce(titles, '') AS titles
FROM (SELECT batch_id, count(*) AS total_jds, count(*) FILTER (flagged) AS red_flags_count
      FROM detections GROUP BY batch_id HAVING count(*) >= 3)
LEFT JOIN d USING (batch_id) LEFT JOIN m USING (batch_id) LEFT JOIN t USING (batch_id)""",
       "demand", "missing_top", "detections")
oracle("f14_intelligence_lists", """
WITH large AS (SELECT batch_id FROM screenings GROUP BY batch_id HAVING count(*) >= 3),
items AS (SELECT batch_id, 'required' AS list, skill AS item, count(DISTINCT id) AS jds FROM matched GROUP BY batch_id, skill
  UNION ALL SELECT batch_id, 'missing', skill, count(DISTINCT id) FROM matched WHERE NOT hit GROUP BY batch_id, skill
  UNION ALL SELECT batch_id, 'titles', lower(job_title), count(*) FROM screenings GROUP BY batch_id, lower(job_title))
SELECT batch_id, list, CAST(row_number() OVER (PARTITION BY batch_id, list ORDER BY jds DESC, item) AS INTEGER) AS rank, item, jds
FROM items SEMI JOIN large USING (batch_id)""", "matched", "screenings")
oracle("f15_report_summary", f"""
SELECT batch_id AS slug, strong, decent, weak, reject, strong + decent + weak AS worth_a_look,
  strong + decent + weak + reject AS roles, CASE WHEN reject > 0 THEN {saved("reject")}
  ELSE 'None of the ' || (strong + decent + weak) || ' jobs broke a rule.' END AS headline
FROM (SELECT batch_id, count(*) FILTER (verdict = 'STRONG') AS strong, count(*) FILTER (verdict = 'DECENT') AS decent,
        count(*) FILTER (verdict = 'WEAK') AS weak, count(*) FILTER (verdict = 'REJECT') AS reject
      FROM screenings GROUP BY batch_id)""", "screenings")

# --- windows --------------------------------------------------------------------------------

oracle("g1_until_fatal", """
SELECT user_id AS batch_id, seq, outcome FROM outcomes
QUALIFY count(*) FILTER (outcome IN ('invalid_key', 'rate_limit'))
  OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) = 0""", "outcomes")
oracle("g2_quota_gate", """
SELECT item_id, user_id, tier <> 'free' OR coalesce(sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (
  PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, item_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 5 AS admitted
FROM usage_items""", "usage_items")
oracle("g2_quota_carried", """
WITH f AS (SELECT date_trunc('week', min(ts)) AS week FROM usage_items)
SELECT item_id, i.user_id, i.tier <> 'free' OR coalesce(sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (
  PARTITION BY i.user_id, date_trunc('week', ts) ORDER BY ts, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + CASE WHEN date_trunc('week', ts) = f.week THEN coalesce(p.screens_used_this_month, 0) ELSE 0 END < 5 AS admitted
FROM usage_items i CROSS JOIN f LEFT JOIN profiles p ON p.id = i.user_id""", "usage_items", "profiles")
oracle("g3_flag_duplicates_by_title", """
SELECT id, row_number() OVER (PARTITION BY job_title, company ORDER BY created_at DESC, id) > 1 AS is_duplicate
FROM screenings""", "screenings")
oracle("g3_flag_duplicates", """
SELECT id, user_id, company,
  row_number() OVER (PARTITION BY user_id, company ORDER BY created_at DESC, id) > 1 AS is_duplicate
FROM screenings""", "screenings")
oracle("g4_recent_history", """
SELECT CAST(item_id AS VARCHAR) AS id, user_id FROM usage_items
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(item_id AS VARCHAR)) <= 50""", "usage_items")

# --- sorts ----------------------------------------------------------------------------------

oracle("h1_rank_results", """
SELECT batch_id, id, composite_score,
  row_number() OVER (PARTITION BY batch_id ORDER BY composite_score DESC, seq) AS position
FROM screenings""", "screenings")
oracle("h1_sort_results_by_verdict", """
SELECT batch_id, id, verdict, row_number() OVER (ORDER BY batch_id, CASE verdict WHEN 'STRONG' THEN 0 WHEN 'DECENT' THEN 1 WHEN 'WEAK' THEN 2 WHEN 'REJECT' THEN 3 ELSE 4 END, seq) AS place FROM screenings""", "screenings")
oracle("h2_section_results", """
SELECT batch_id, CAST(CASE WHEN id = '' THEN 1 WHEN verdict = 'REJECT' THEN 2 ELSE 0 END AS INTEGER) AS section,
  seq, id, composite_score, row_number() OVER (ORDER BY batch_id, CASE WHEN id = '' THEN 1 WHEN verdict = 'REJECT' THEN 2 ELSE 0 END,
    CASE WHEN id <> '' THEN composite_score END DESC, seq) AS place FROM errored""", "errored")
oracle("h3_tracker_list", f"""SELECT user_id, id, {ts('updated_at')} AS updated,
  row_number() OVER (ORDER BY user_id, updated_at DESC, id) AS place FROM tracker""", "tracker")
oracle("h4_order_batches", f"""
SELECT user_id, batch_id, {ts("last_at")} AS batch_at, n AS rows,
  row_number() OVER (ORDER BY user_id, last_at, batch_id) AS place FROM batches""", "batches")

# --- change sets ------------------------------------------------------------------------------

oracle("j1_profile_patch", f"""
WITH p AS (SELECT event_id AS n, CAST(user_id AS VARCHAR) AS id, ts, props FROM events WHERE event_type = 'signup'),
names AS (SELECT id, CASE WHEN n % 4 <> 0 THEN 'name ' || n END AS x FROM p WHERE n % 2 = 0
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, n DESC) = 1),
texts AS (SELECT id, CASE WHEN n % 9 <> 0 THEN props END AS x FROM p WHERE n % 3 = 0
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, n DESC) = 1),
providers AS (SELECT id, CASE WHEN n % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS x FROM p WHERE n % 5 = 0
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, n DESC) = 1),
keys AS (SELECT id, 'k' || n AS x FROM p WHERE n % 7 = 0
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, n DESC) = 1),
times AS (SELECT id, max(ts) AS x FROM p GROUP BY id)
SELECT f.id, CASE WHEN n.id IS NULL THEN full_name ELSE n.x END AS full_name,
  md5(CASE WHEN t.id IS NULL THEN resume_text ELSE t.x END) AS resume_md5, coalesce(v.x, api_provider) AS api_provider,
  coalesce(k.x, api_key_encrypted) AS api_key_encrypted, {ts("coalesce(u.x, updated_at)")} AS updated
FROM profiles f LEFT JOIN names n ON n.id = f.id LEFT JOIN texts t ON t.id = f.id LEFT JOIN providers v ON v.id = f.id
LEFT JOIN keys k ON k.id = f.id LEFT JOIN times u ON u.id = f.id""", "profiles")
TIERS = """
WITH last AS (SELECT email, CASE WHEN event_type = 'purchase' THEN 'paid' ELSE 'free' END AS t FROM payments
  WHERE email IS NOT NULL QUALIFY row_number() OVER (PARTITION BY email ORDER BY ts DESC, event_id DESC) = 1)
SELECT id, p.email, coalesce(t, tier) AS tier FROM profiles p LEFT JOIN last ON last.email = p.email"""
oracle("j2_payment_events", TIERS, "profiles", "payments")
oracle("j3_tracker_updates", f"""
WITH legal AS (SELECT * FROM updates WHERE status IS NULL OR status <> 'Hired'),
s AS (SELECT id, user_id, status AS x FROM legal WHERE status IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id, user_id ORDER BY ts DESC, update_id DESC) = 1),
n AS (SELECT id, user_id, notes AS x FROM legal WHERE has_notes
  QUALIFY row_number() OVER (PARTITION BY id, user_id ORDER BY ts DESC, update_id DESC) = 1),
u AS (SELECT id, user_id, max(ts) AS x FROM legal GROUP BY id, user_id)
SELECT t.id, coalesce(s.x, t.status) AS status, CASE WHEN n.id IS NULL THEN t.notes ELSE n.x END AS notes,
  {ts("coalesce(u.x, t.updated_at)")} AS updated
FROM tracker t LEFT JOIN s ON s.id = t.id AND s.user_id = t.user_id LEFT JOIN n ON n.id = t.id AND n.user_id = t.user_id
LEFT JOIN u ON u.id = t.id AND u.user_id = t.user_id
UNION ALL SELECT 'refused ' || update_id, status, NULL, '' FROM updates WHERE status = 'Hired'""", "tracker", "updates")
oracle("j4_tracker_deletes", """
SELECT id, user_id FROM tracker t
WHERE NOT EXISTS (SELECT 1 FROM updates u WHERE u.id = t.id AND u.user_id = t.user_id AND has_notes)""", "tracker", "updates")
oracle("j5_publish_reports", f"""
SELECT batch_id, id, composite_score, verdict, {ts(f"TIMESTAMP '{NOW}' + INTERVAL 30 DAY")} AS expires,
  CAST(length(jd_text) AS INTEGER) AS chars FROM screenings
UNION ALL SELECT batch_id, 'refused ' || batch_id || '/x', NULL, NULL, NULL, NULL FROM batches WHERE first_seq % 5 = 0""",
       "screenings", "batches")
oracle("j6_reset_usage", "SELECT id, CAST(0 AS INTEGER) AS screens_used_this_month FROM profiles", "profiles")

# --- streams ----------------------------------------------------------------------------------

oracle("k1_stream_screen", "SELECT * FROM native", "native")
oracle("k1_stream_admission", """
WITH gated AS (SELECT j.id, tier <> 'free' OR row_number() OVER (PARTITION BY j.user_id, date_trunc('month', s.created_at) ORDER BY s.created_at, j.id) <= 5 AS admitted
  FROM jds j JOIN (SELECT id, created_at FROM screenings) s ON s.id = j.id JOIN profiles p ON p.id = j.user_id
  WHERE coalesce(p.api_key_encrypted, '') <> '' AND jd_text <> '')
SELECT id, ats_score, role_level_score, composite_score, verdict FROM native SEMI JOIN (SELECT id FROM gated WHERE admitted) USING (id)""",
       "native", "jds", "screenings", "profiles")
oracle("k3_stream_daily_usage", f"""
SELECT user_id, {ts("date_trunc('month', ts)")} AS period, count(*) AS used
FROM usage_items WHERE success GROUP BY user_id, date_trunc('month', ts)""", "usage_items")
oracle("k2_stream_tiers", TIERS, "profiles", "payments")
oracle("k3_stream_usage", f"""
SELECT user_id, {ts("date_trunc('month', ts)")} AS period, count(*) AS used
FROM usage_items WHERE success GROUP BY user_id, date_trunc('month', ts)""", "usage_items")
oracle("k4_stream_finalize", f"""
SELECT batch_id, {ts("a")} AS first_at, {ts("b + INTERVAL 2 HOUR")} AS closed_at, rows, strong, decent, weak, reject,
  strong + decent + weak AS worth_a_look
FROM (SELECT batch_id, min(created_at) AS a, max(created_at) AS b, count(*) AS rows,
    count(*) FILTER (id <> '' AND verdict = 'STRONG') AS strong, count(*) FILTER (id <> '' AND verdict = 'DECENT') AS decent,
    count(*) FILTER (id <> '' AND verdict = 'WEAK') AS weak, count(*) FILTER (id <> '' AND verdict = 'REJECT') AS reject
  FROM errored GROUP BY batch_id) WHERE b + INTERVAL 2 HOUR <= (SELECT max(created_at) FROM errored)""", "errored")
oracle("k4_finalized_intelligence", f"""
SELECT f.batch_id, total_jds, red_flags_count, missing FROM ({ORACLE["f14_batch_intelligence"]}) f
JOIN ({ORACLE["k4_stream_finalize"]}) k USING (batch_id)""")

# --- pluggable scorer and whole flows ------------------------------------------------------------

oracle("k4_incremental_intelligence", f"""
SELECT f.batch_id, total_jds, red_flags_count, missing FROM ({ORACLE["f14_batch_intelligence"]}) f
JOIN ({ORACLE["k4_stream_finalize"]}) k USING (batch_id)""")

# --- pluggable scorer and whole flows ------------------------------------------------------------

oracle("l1_score_with", f"""
WITH resumes AS ({ORACLE["d1_effective_resume"]}),
answers AS (SELECT j.id, batch_id, seq, CAST(CASE WHEN length(resume) > 2000 THEN 500 ELSE 200 END AS INTEGER) AS status,
    CAST(length(jd_text) % 101 AS INTEGER) AS ats_score, CAST(length(resume) % 101 AS INTEGER) AS role_level_score
  FROM jds j JOIN resumes r ON r.id = j.user_id)
SELECT *, {composite("ats_score", "role_level_score")} AS composite_score FROM answers""", "jds")
oracle("p1_screen_batches", f"""
SELECT n.* FROM native n JOIN jds j USING (id) WHERE {trim("j.jd_text")} <> ''""", "native", "jds")
oracle("p1_screen_with", f"""
WITH resumes AS ({ORACLE["d1_effective_resume"]}),
tried AS (SELECT j.seq, j.user_id, j.job_url, j.job_title, length(j.jd_text) AS chars, length(resume) AS r, tier, created_at
  FROM jds j JOIN resumes ON resumes.id = j.user_id JOIN profiles p ON p.id = j.user_id
  JOIN (SELECT id, created_at FROM screenings) s ON s.id = j.id),
answered AS (SELECT *, chars % 53 = 0 OR chars % 31 = 0 AS fatal, chars % 53 <> 0 AND chars % 31 <> 0 AND r <= 2000 AS ok FROM tried),
kept AS (SELECT * FROM answered
  QUALIFY count(*) FILTER (fatal) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) = 0),
admitted AS (SELECT * FROM kept QUALIFY tier <> 'free' OR coalesce(count(*) FILTER (ok) OVER (
  PARTITION BY user_id, date_trunc('month', created_at) ORDER BY created_at, seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 5)
SELECT CASE WHEN ok THEN 'r' || seq ELSE '' END AS id, user_id, seq, job_url,
  CASE WHEN seq % 2 = 0 THEN job_title WHEN ok THEN 'scored' END AS job_title,
  CAST(CASE WHEN ok THEN chars % 101 ELSE 0 END AS INTEGER) AS ats_score,
  CAST(CASE WHEN ok THEN r % 101 ELSE 0 END AS INTEGER) AS role_level_score,
  CASE WHEN ok THEN 'WEAK' ELSE 'REJECT' END AS verdict, CASE WHEN ok THEN '' ELSE 'failed' END AS reasons
FROM admitted""", "jds", "profiles", "screenings")
RUN = """
entered AS (SELECT j.id, j.user_id, CASE WHEN seq % 19 <> 0 THEN batch_id END AS batch_id, s.created_at, p.tier, p.screens_used_this_month AS used_before,
    CASE WHEN seq % 19 = 0 THEN 'no batch' WHEN p.id IS NULL THEN 'no profile' WHEN coalesce(p.api_key_encrypted, '') = '' THEN 'no key'
      WHEN seq % 13 = 0 OR jd_text = '' THEN 'no text' END AS reason
  FROM jds j JOIN (SELECT id, created_at FROM screenings) s ON s.id = j.id LEFT JOIN profiles p ON p.id = j.user_id),
gated AS (SELECT *, tier <> 'free' OR row_number() OVER (PARTITION BY user_id, date_trunc('month', created_at) ORDER BY created_at, id)
    + CASE WHEN date_trunc('month', created_at) = DATE '2024-01-01' THEN coalesce(used_before, 0) ELSE 0 END <= 5 AS admitted
  FROM entered WHERE reason IS NULL)"""
oracle("p1_run_results", f"""
WITH {RUN}
SELECT id, ats_score, role_level_score, composite_score, verdict FROM native SEMI JOIN (SELECT id FROM gated WHERE admitted) USING (id)""",
       "native", "jds", "screenings", "profiles")
oracle("p1_run_refused", f"""
WITH {RUN}
SELECT id, user_id, batch_id, reason FROM entered WHERE reason IS NOT NULL
UNION ALL SELECT id, user_id, batch_id, 'over quota' FROM gated WHERE NOT admitted""", "jds", "screenings", "profiles")
oracle("p1_run_usage", f"""
WITH {RUN}
SELECT user_id, {ts("date_trunc('month', created_at)")} AS period, count(*) AS used
FROM gated WHERE admitted GROUP BY user_id, date_trunc('month', created_at)""", "jds", "screenings", "profiles")
oracle("p1_refused_items", """
SELECT id, user_id, batch_id, reason FROM (
  SELECT j.id, j.user_id, CASE WHEN seq % 19 <> 0 THEN batch_id END AS batch_id, CASE WHEN seq % 19 = 0 THEN 'no batch'
    WHEN p.id IS NULL THEN 'no profile' WHEN coalesce(p.api_key_encrypted, '') = '' THEN 'no key'
    WHEN seq % 13 = 0 OR jd_text = '' THEN 'no text' END AS reason
  FROM jds j LEFT JOIN profiles p ON p.id = j.user_id AND p.tier = 'free') WHERE reason IS NOT NULL""", "jds", "profiles")
oracle("p1_fatal_errors", """
SELECT user_id AS batch_id, seq, outcome AS type, message FROM outcomes WHERE outcome IN ('invalid_key', 'rate_limit')
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq) = 1""", "outcomes")
oracle("p1_ranked_report", f"""
WITH reasons AS ({ORACLE["d10_reason_line"]}),
labels_shown AS (SELECT 'STRONG' AS verdict, 'Excellent Match' AS label UNION ALL SELECT 'DECENT', 'Worth Applying'
  UNION ALL SELECT 'WEAK', 'Low Priority' UNION ALL SELECT 'REJECT', 'Skip This One')
SELECT *, {saved("rejects")} AS saved FROM (
  SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY composite_score DESC, seq) AS position, id, job_title,
    company, composite_score, verdict, label, reason, count(*) FILTER (verdict <> 'REJECT') OVER b AS worth_a_look,
    count(*) FILTER (verdict = 'REJECT') OVER b AS rejects
  FROM screenings JOIN reasons USING (id) JOIN labels_shown USING (verdict) WINDOW b AS (PARTITION BY batch_id))""",
       "screenings")
oracle("p2_history_page", f"""
WITH recent AS (SELECT *, max(created_at) OVER (PARTITION BY user_id, batch_id) AS newest FROM (SELECT * FROM screenings
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) <= 20))
SELECT user_id, batch_id, id, EXISTS (SELECT 1 FROM tracker t WHERE t.screening_result_id = r.id AND t.user_id = r.user_id)
  AS tracked, {ts("newest")} AS batch_at,
  row_number() OVER (ORDER BY user_id, newest DESC, batch_id, created_at DESC, id) AS place
FROM recent r WHERE verdict = 'DECENT' AND (lower(company) LIKE '%src%' OR lower(job_title) LIKE '%src%')""",
       "screenings", "tracker")
oracle("p3_report_page", f"""
SELECT batch_id, full_name, s.roles, worth_a_look, headline
FROM ({ORACLE["f15_report_summary"]}) s JOIN batches b ON b.batch_id = s.slug LEFT JOIN profiles p ON p.id = b.user_id""",
       "batches", "profiles")
