"""SQL for the registered queries, over the same tables; stand-ins as in ``standins.py``."""

from __future__ import annotations

from pagesim.fixed_values import STRUCTURE_FEATURES

from .standins import K, MINIMAL_DOM, SMALL_DOM

ORACLE: dict[str, str] = {}

# Fixed values, as in pagesim.fixed_values.
DETAIL = "https://phishtank.com/phish_detail.php?phish_id="
VOID = ("area base br col embed hr img input keygen link menuitem meta param source track wbr "
        "basefont bgsound command frame image isindex nextid spacer").split()
SKIPPED = "URL not found in PhishTank database, NCD analysis skipped"

HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)"
PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
LABEL = "CASE WHEN url LIKE 'http://%' THEN 'phish' ELSE 'legit' END"
STAMP = "strftime(timestamp '2024-01-01' + to_hours({0}), '%Y-%m-%d %H:%M:%S')"


def sql(*ctes: str, select: str) -> str:
    head = ",\n".join(c for c in ctes if c)
    return f"WITH RECURSIVE {head}\n{select}" if head else select


# --- pages ---------------------------------------------------------------------------------

NO_COMMENTS = r"regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"


def _drop(text: str, element: str) -> str:
    return rf"regexp_replace({text}, '(?is)<{element}\b[^>]*>.*?</{element}\s*>', '', 'g')"


def _blank(text: str, element: str) -> str:
    return rf"regexp_replace({text}, '(?is)(<{element}\b[^>]*>).*?(</{element}\s*>)', '\1\2', 'g')"


SANITIZED = _drop(_drop(_drop(NO_COMMENTS, "script"), "style"), "noscript")
BLANKED = _blank(_blank(NO_COMMENTS, "script"), "style")
START = r"'<([a-zA-Z][^\s/>]*)'"

DOMS = rf"""doms AS (
  SELECT page_id, url, html, {LABEL} AS label,
    CASE WHEN url NOT LIKE 'http://%' THEN 'legit'
         WHEN {HOST} LIKE '%.com' THEN 'phish_cluster_1' ELSE 'phish_cluster_2' END AS proto_set,
    array_to_string(list_transform(regexp_extract_all({SANITIZED}, {START}, 1), lambda t: lower(t)), ' ') AS dom
  FROM pages)"""

ORACLE["sanitize_tags"] = sql(DOMS, select=f"""
SELECT page_id, dom, strlen(dom) AS dom_length,
  CASE WHEN strlen(dom) < {SMALL_DOM} THEN 'resource-signature' ELSE 'dom-structure' END AS mode,
  strlen(dom) < {MINIMAL_DOM} AS minimal FROM doms""")
ORACLE["sanitize_tags_native"] = sql(DOMS, select="SELECT page_id, dom FROM doms")
ORACLE["filter_minimal"] = sql(DOMS, select=f"SELECT page_id, label FROM doms WHERE strlen(dom) >= {MINIMAL_DOM}")

ORACLE["sanitize_tags_attrs"] = rf"""
WITH t AS (
  SELECT page_id, unnest(regexp_extract_all({SANITIZED}, '<[a-zA-Z][^>]*>')) AS tag,
    generate_subscripts(regexp_extract_all({SANITIZED}, '<[a-zA-Z][^>]*>'), 1) AS i FROM pages),
n AS (
  SELECT page_id, i, lower(regexp_extract(tag, {START}, 1)) AS name,
    regexp_extract_all(regexp_replace(tag, '"[^"]*"', '""', 'g'), '\s([^\s=>"]+)=', 1) AS attrs FROM t),
p AS (
  SELECT page_id, i, CASE WHEN len(attrs) = 0 THEN name
    ELSE array_to_string(list_transform(list_distinct(attrs), lambda a: name || ':' || lower(a)), ' ') END AS pair FROM n)
SELECT page_id, string_agg(pair, ' ' ORDER BY i) AS dom FROM p GROUP BY page_id"""

ORACLE["sanitize_tags_attrs_native"] = ORACLE["sanitize_tags_attrs"]

EVENTS = rf"""events_of AS (
  SELECT page_id, html,
    list_transform(regexp_extract_all({BLANKED}, '</?[a-zA-Z][^\s/>]*'), lambda t: lower(t)) AS events,
    list_transform(regexp_extract_all({BLANKED}, {START}, 1), lambda t: lower(t)) AS tags FROM pages)"""

VOID_LIST = "[" + ", ".join(f"'{v}'" for v in VOID) + "]"

# the stack of open tags, folded event by event; an end tag closes up to its nearest match
NESTING = rf"""stack AS (
  SELECT page_id, events, 1 AS i, []::VARCHAR[] AS opened, 0 AS deepest, 0 AS closed FROM events_of
  UNION ALL
  SELECT page_id, events, i + 1,
    CASE WHEN events[i] LIKE '</%' THEN
           CASE WHEN list_contains(opened, events[i][3:]) THEN opened[list_position(opened, events[i][3:]) + 1:] ELSE opened END
         WHEN list_contains({VOID_LIST}, events[i][2:]) THEN opened
         ELSE list_prepend(events[i][2:], opened) END,
    CASE WHEN events[i] LIKE '</%' THEN deepest ELSE greatest(deepest, len(opened) + 1) END,
    closed + CASE WHEN events[i] LIKE '</%' THEN coalesce(list_position(opened, events[i][3:]), 0)
                  WHEN list_contains({VOID_LIST}, events[i][2:]) THEN 1 ELSE 0 END
  FROM stack WHERE i <= len(events)),
nested AS (SELECT page_id, deepest, closed FROM stack WHERE i = len(events) + 1)"""

ORACLE["html_tokens"] = sql(EVENTS, NESTING, select="""
SELECT e.page_id, len(e.tags) + n.closed AS events, n.closed::BIGINT AS closed
FROM events_of e JOIN nested n USING (page_id)""")

ORACLE["html_tokens_native"] = ORACLE["html_tokens"]
ORACLE["page_nesting_native"] = sql(EVENTS, NESTING, select="""
SELECT e.page_id, array_to_string(e.tags, ' ') AS tags, n.deepest::BIGINT AS depth FROM events_of e JOIN nested n USING (page_id)""")


def _tag_count(name: str) -> str:
    return f"round(len(list_filter(tags, lambda t: t = '{name}'))::DOUBLE, 6) AS count_{name}"


STRUCTURE = f"""chars AS (
  SELECT page_id, c, count(*) AS n FROM (
    SELECT page_id, unnest(string_split(array_to_string(tags, ' '), '')) AS c FROM events_of) GROUP BY ALL),
entropy AS (
  SELECT page_id, -sum(n / total * log2(n / total)) AS bits FROM (
    SELECT page_id, n::DOUBLE AS n, sum(n) OVER (PARTITION BY page_id)::DOUBLE AS total FROM chars) GROUP BY page_id),
structure AS (
  SELECT e.page_id, len(tags)::DOUBLE AS total_tag_count, len(list_distinct(tags))::DOUBLE AS unique_tag_count,
    n.deepest::DOUBLE AS depth_of_dom_tree, CASE WHEN len(tags) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS average_children_per_node,
    {", ".join(_tag_count(t) for t in ["form", "input", "script", "img", "iframe", "link", "meta"])},
    round(b.bits, 6) AS dom_entropy, len(tags)::DOUBLE AS dom_token_count,
    strlen(e.html)::DOUBLE AS dom_length_bytes,
    round(len(list_filter(tags, lambda t: t IN ('form', 'input', 'button'))) / len(tags), 6) AS ratio_interactive_tags
  FROM events_of e JOIN nested n USING (page_id) JOIN entropy b USING (page_id))"""

ORACLE["page_structure_features"] = sql(EVENTS, NESTING, STRUCTURE, select="SELECT * FROM structure")
ORACLE["char_frequency"] = sql(DOMS, select="""
SELECT page_id, character, count(*) AS occurrences FROM (
  SELECT page_id, unnest(string_split(dom, '')) AS character FROM doms) GROUP BY ALL""")

ORACLE["url_parts"] = rf"""
WITH u AS (
  SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS netloc, {PATH} AS path FROM pages)
SELECT page_id, replace(netloc, 'www.', '') || path AS normalized, string_split(netloc, ':')[1] AS host,
  regexp_replace(string_split(netloc, ':')[1], '^www\.', '') AS domain,
  regexp_replace(CASE WHEN trim(path, '/') <> '' THEN replace(netloc, 'www.', '') || '_' || replace(trim(path, '/'), '/', '_')
    ELSE replace(netloc, 'www.', '') END, '[^\p{{L}}\p{{N}}_]', '_', 'g') AS sample_name,
  starts_with(url, 'http://') OR starts_with(url, 'https://') AS is_http,
  '{DETAIL}' || page_id AS detail_page FROM u"""

RESOURCES = f"""r AS (SELECT page_id, {HOST} AS host, replace({HOST}, 'www.', '') AS bare, page_id::VARCHAR AS i FROM pages)"""
ORACLE["resource_signature"] = sql(RESOURCES, """s AS (SELECT page_id, bare, array_to_string(list_sort(list_distinct([
    bare || '/js/app' || i || '.js', 'https://cdn.' || host || '/s.css',
    replace('www.' || host, 'www.', '') || '/i/' || i || '.png', bare || '/bg/' || host || '.gif',
    'ads.example.org', 'frame.example.net/x', bare || '/v.mp4'])), ' ') AS signature,
  array_to_string(list_sort(list_distinct([replace('cdn.' || host, 'www.', ''), replace('www.' || host, 'www.', ''),
    'ads.example.org', 'frame.example.net'])), ' ') AS domains FROM r)""", select="""
SELECT page_id, signature, strlen(signature) AS signature_length, domains FROM s""")
ORACLE["resource_refs"] = sql(RESOURCES, select="""
SELECT page_id, unnest(['/js/app' || i || '.js?v=1', '//cdn.' || host || '/s.css',
  'https://www.' || host || '/i/' || i || '.png#x', 'data:image/png;base64,AA', '/bg/' || host || '.gif',
  'https://ads.example.org', 'https://frame.example.net/x?y=1', '/v.mp4', '/v.mp4']) AS ref FROM r""")

ORACLE["resource_refs_native"] = ORACLE["resource_refs"]

ORACLE["read_url_list"] = "SELECT url FROM pages"

# --- signatures ----------------------------------------------------------------------------

CHECKS = "checks AS (SELECT e.*, p.url FROM events e JOIN pages p ON e.user_id = p.page_id)"
FEED_RAW = f"""feed_raw AS (
  SELECT page_id AS phish_id, url, 'detail/' || page_id AS phish_detail_url, {STAMP.format('page_id')} AS submission_time,
    CASE WHEN {HOST} LIKE '%.com' THEN 'yes' ELSE 'no' END AS verified,
    CASE WHEN contains(url, '#') THEN 'no' ELSE 'yes' END AS online, 'Other' AS target, page_id AS input_seq FROM pages)"""
FEED_LOG = f"""feed_log AS (
  SELECT * FROM feed_raw UNION ALL
  SELECT 1000000 + floor(value)::BIGINT, url, 'detail/' || event_id, {STAMP.format('event_id')},
    CASE WHEN event_type = 'error' THEN 'no' ELSE 'yes' END, CASE WHEN event_type = 'signup' THEN 'no' ELSE 'yes' END,
    'Other', 1000000 + event_id FROM checks)"""
LOG = [CHECKS, FEED_RAW, FEED_LOG]
FEED = """feed AS (SELECT phish_id, url, submission_time, target, '2024-06-01' AS updated_at
  FROM feed_raw WHERE verified = 'yes' AND online = 'yes')"""


def _last(source: str, *keys: str) -> str:
    tests = " AND ".join(f"input_seq = max(input_seq) OVER (PARTITION BY {k})" for k in keys)
    return f"SELECT * FROM {source} QUALIFY {tests}"


ORACLE["feed_filter"] = sql(*LOG, select="""
SELECT phish_id, url, submission_time, target FROM feed_log WHERE verified = 'yes' AND online = 'yes'""")
ORACLE["read_feed_csv"] = ORACLE["feed_filter"]
ORACLE["feed_json"] = sql(*LOG, select="""
SELECT phish_id, url, CASE WHEN verified = 'yes' THEN 1 ELSE 0 END::BIGINT AS verified, submission_time,
  phish_detail_url AS detail_url FROM feed_log""")
ORACLE["replace_signatures_unique_url"] = sql(
    *LOG, "kept AS (SELECT * FROM feed_log WHERE verified = 'yes' AND online = 'yes')",
    f"last AS ({_last('kept', 'phish_id', 'url')})",
    select="SELECT phish_id, url, submission_time, target, '2024-06-01' AS updated_at FROM last")
ORACLE["replace_signatures_pk_only"] = sql(*LOG, f"last AS ({_last('feed_log', 'phish_id')})", select="""
SELECT phish_id, url, CASE WHEN verified = 'yes' THEN 1 ELSE 0 END::BIGINT AS verified, submission_time,
  '2024-06-01' AS updated_at FROM last""")
ORACLE["feed_refresh"] = sql(
    *LOG, "kept AS (SELECT * FROM feed_log WHERE verified = 'yes' AND online = 'yes')",
    f"last AS ({_last('kept', 'phish_id', 'url')})", select="SELECT phish_id, url, '2024-06-02' AS updated_at FROM last")
ORACLE["signature_lookup"] = sql(CHECKS, FEED_RAW, FEED, select=f"""
SELECT event_id, url, phish_id, submission_time AS submitted_at, target, phish_id IS NOT NULL AS in_database,
  phish_id IS NOT NULL AS verified, '{DETAIL}' || phish_id AS detail_page, 'phishtank-local' AS lookup_source
FROM checks LEFT JOIN feed USING (url)""")
ORACLE["signature_lookup_skipped"] = sql(CHECKS, select="""
SELECT event_id, url, false AS in_database, false AS verified, 'skipped' AS lookup_source FROM checks""")
ORACLE["signature_hits"] = sql(CHECKS, FEED_RAW, FEED, select="""
SELECT event_id, url FROM checks WHERE url IN (SELECT url FROM feed)""")
ORACLE["signature_misses"] = sql(CHECKS, FEED_RAW, FEED, select="""
SELECT event_id, url FROM checks WHERE url NOT IN (SELECT url FROM feed)""")
ORACLE["signature_stats"] = sql(FEED_RAW, FEED, select="""
SELECT count(*) AS entry_count, max(updated_at) AS last_updated, count(*) > 0 AS exists FROM feed""")

# --- distances -----------------------------------------------------------------------------


def jaccard(a: str, b: str) -> str:
    a, b = f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))"
    shared = f"len(list_intersect({a}, {b}))"
    return f"(1.0::DOUBLE - {shared}::DOUBLE / (len({a}) + len({b}) - {shared}))"


def l2(a: str, b: str) -> str:
    return f"list_distance({a}, {b})"


def fpf(source: str, group: str, key: str, payload: str, distance, k: int, first: str, name: str) -> str:
    """Farthest-point-first with its k rounds written out."""
    ctes = [f"{name}_c1 AS (SELECT {group} AS g, {first} AS key, NULL::DOUBLE AS cover FROM {source} GROUP BY 1)"]
    for i in range(1, k):
        previous = f"{name}_s{i - 1}" if i > 1 else None
        d = distance(f"s.{payload}", f"c.{payload}")
        d = f"CASE WHEN s.{key} = c.{key} THEN '-infinity'::DOUBLE ELSE {d} END"
        if previous:
            d = f"least(p.d, {d})"
        join = f"JOIN {previous} p ON p.key = s.{key} AND p.g = s.{group}" if previous else ""
        ctes.append(f"""{name}_s{i} AS MATERIALIZED (
  SELECT s.{group} AS g, s.{key} AS key, {d} AS d FROM {source} s
  JOIN {name}_c{i} x ON x.g = s.{group} JOIN {source} c ON c.{key} = x.key AND c.{group} = x.g {join})""")
        ctes.append(f"""{name}_c{i + 1} AS (
  SELECT g, key, d AS cover FROM {name}_s{i} QUALIFY row_number() OVER (PARTITION BY g ORDER BY d DESC, key) = 1)""")
    union = " UNION ALL ".join(f"SELECT g, key, {i} AS idx, cover FROM {name}_c{i}" for i in range(1, k + 1))
    ctes.append(f"{name} AS ({union})")
    return ",\n".join(ctes)


BIG = f"big AS MATERIALIZED (SELECT * FROM doms WHERE strlen(dom) >= {MINIMAL_DOM})"
PROTOS = (BIG + ",\n" + fpf("big", "label", "page_id", "dom", jaccard, K, "min(page_id)", "picks") + """,
protos AS MATERIALIZED (SELECT d.page_id, d.label, d.dom, d.url, p.idx, p.cover FROM picks p
  JOIN doms d ON d.page_id = p.key AND d.label = p.g)""")
SETS = (fpf("doms", "proto_set", "page_id", "dom", jaccard, K, "min(page_id)", "set_picks") + """,
sets AS MATERIALIZED (SELECT d.page_id, d.proto_set, d.dom FROM set_picks p
  JOIN doms d ON d.page_id = p.key AND d.proto_set = p.g)""")
MDOMS = DOMS.replace("doms AS (", "doms AS MATERIALIZED (", 1)


def scores(payload: str, source: str = "doms") -> str:
    d = jaccard(f"c.{payload}", "p.dom")
    return f"""scored AS MATERIALIZED (
  SELECT page_id, min(d) FILTER (label = 'phish') AS phish_min, avg(d) FILTER (label = 'phish') AS phish_avg,
    min(d) FILTER (label = 'legit') AS legit_min, avg(d) FILTER (label = 'legit') AS legit_avg
  FROM (SELECT c.page_id, p.label, {d} AS d FROM {source} c CROSS JOIN protos p) GROUP BY page_id)"""


SET_NAMES = ["phish_cluster_1", "phish_cluster_2", "phish_cluster_3", "legit"]
SET_SCORES = f"""set_d AS MATERIALIZED (
  SELECT c.page_id, p.proto_set, {jaccard('c.dom', 'p.dom')} AS d FROM doms c CROSS JOIN sets p),
set_wide AS (SELECT page_id, {", ".join(
    f"coalesce(min(d) FILTER (proto_set = '{s}'), 1.0) AS ncd_{s}_min, coalesce(avg(d) FILTER (proto_set = '{s}'), 1.0) AS ncd_{s}_avg"
    for s in SET_NAMES)} FROM set_d GROUP BY page_id),
set_scores AS (SELECT page_id, {", ".join(f"round(ncd_{s}_{m}, 6) AS ncd_{s}_{m}" for s in SET_NAMES for m in ("min", "avg"))},
  round(least(ncd_phish_cluster_1_min, ncd_phish_cluster_2_min, ncd_phish_cluster_3_min), 6) AS ncd_phish_best,
  round((ncd_phish_cluster_1_avg + ncd_phish_cluster_2_avg + ncd_phish_cluster_3_avg) / 3, 6) AS ncd_phish_avg FROM set_wide)"""

ORACLE["prototype_distances_tag_jaccard"] = sql(MDOMS, PROTOS, select=f"""
SELECT c.page_id, p.label, p.idx::BIGINT AS prototype_index, round({jaccard('c.dom', 'p.dom')}, 6) AS distance
FROM doms c CROSS JOIN protos p""")
ORACLE["pairwise_distances_tag_jaccard"] = sql(MDOMS, PROTOS, select=f"""
SELECT a.label, a.page_id AS i, b.page_id AS j, round({jaccard('a.dom', 'b.dom')}, 6) AS distance
FROM protos a JOIN protos b ON a.label = b.label AND a.page_id < b.page_id""")
CROSS = f"""cross_d AS (SELECT a.page_id AS i, b.page_id AS j, {jaccard('a.dom', 'b.dom')} AS distance, b.label
  FROM protos a CROSS JOIN protos b WHERE a.label = 'legit')"""
ORACLE["cross_set_distances_tag_jaccard"] = sql(MDOMS, PROTOS, CROSS, select="""
SELECT i, j, round(distance, 6) AS distance FROM cross_d WHERE label = 'phish'""")
ORACLE["distance_stats_tag_jaccard"] = sql(MDOMS, PROTOS, CROSS, select="""
SELECT count(*) AS comparisons, round(min(distance), 6) AS min_distance, round(max(distance), 6) AS max_distance,
  round(avg(distance), 6) AS avg_distance FROM cross_d WHERE label = 'phish'""")
ORACLE["tune_threshold_tag_jaccard"] = sql(MDOMS, PROTOS, CROSS, """
ll AS (SELECT count(*) AS n, min(distance) AS lo, max(distance) AS hi, avg(distance) AS av FROM cross_d WHERE label = 'legit' AND distance <> 0)""", """
lp AS (SELECT count(*) AS n, min(distance) AS lo, max(distance) AS hi, avg(distance) AS av FROM cross_d WHERE label = 'phish')""", select="""
SELECT ll.n AS ll_comparisons, lp.n AS lp_comparisons, ll.hi < lp.lo AS separated, round(ll.lo, 6) AS ll_min,
  round(ll.hi, 6) AS ll_max, round(ll.av, 6) AS ll_avg, round(lp.lo, 6) AS lp_min, round(lp.hi, 6) AS lp_max,
  round(lp.av, 6) AS lp_avg, round(ll.hi, 6) AS lower_bound, round(lp.lo, 6) AS upper_bound,
  round((ll.hi + lp.lo) / 2, 6) AS suggested_threshold FROM ll, lp""")
ORACLE["nearest_sample_tag_jaccard"] = sql(MDOMS, f"""
near AS (SELECT c.page_id, s.url, {jaccard('c.dom', 's.dom')} AS d, s.page_id AS idx
  FROM doms c CROSS JOIN doms s WHERE c.label = 'phish' AND s.label = 'legit'
  QUALIFY row_number() OVER (PARTITION BY c.page_id ORDER BY d, idx) = 1)""", select="""
SELECT page_id, round(least(d, 1.0), 4) AS ncd, CASE WHEN d > 0.48 THEN 'phish' ELSE 'legit' END AS classification,
  CASE WHEN d < 1.0 THEN url END AS closest_sample FROM near""")
ORACLE["nearest_other_tag_jaccard"] = sql(MDOMS, f"""
near AS (SELECT c.page_id, s.url, s.label, {jaccard('c.dom', 's.dom')} AS d, s.page_id AS idx
  FROM doms c JOIN doms s ON c.page_id <> s.page_id
  QUALIFY row_number() OVER (PARTITION BY c.page_id ORDER BY d, idx) = 1)""", select="""
SELECT page_id, round(least(d, 1.0), 4) AS ncd, CASE WHEN d > 0.48 THEN 'phish' ELSE label END AS classification,
  CASE WHEN d < 1.0 THEN url END AS closest_sample FROM near""")
ORACLE["nearest_other_grid_tag_jaccard"] = ORACLE["nearest_other_tag_jaccard"]
ORACLE["class_scores_tag_jaccard"] = sql(MDOMS, PROTOS, scores("dom"), select="""
SELECT page_id, round(phish_min, 6) AS phish_min, round(phish_avg, 6) AS phish_avg, round(legit_min, 6) AS legit_min,
  round(legit_avg, 6) AS legit_avg FROM scored""")
ORACLE["class_scores_grid_tag_jaccard"] = sql(MDOMS, f"""
pairs AS (SELECT c.page_id, s.label, {jaccard('c.dom', 's.dom')} AS d, s.page_id AS idx FROM doms c CROSS JOIN doms s)""", select="""
SELECT page_id, label, count(*) AS n, round(avg(d), 6) AS avg_distance, round(min(d), 6) AS min_distance,
  arg_min(idx, (d, idx)) AS nearest FROM pairs GROUP BY page_id, label""")
ORACLE["cluster_scores_tag_jaccard"] = sql(MDOMS, SETS, SET_SCORES, select="SELECT * FROM set_scores")
ORACLE["page_features_tag_jaccard"] = sql(MDOMS, SETS, SET_SCORES, EVENTS, NESTING, STRUCTURE, select="""
SELECT * FROM structure JOIN set_scores USING (page_id)""")

VECTORS = "v AS MATERIALIZED (SELECT vec_id AS idx, embedding::DOUBLE[] AS e, 'all' AS g FROM embeddings)"
MEANS = """means AS (SELECT a.idx, sum(list_distance(a.e, b.e)) / count(*) AS m FROM v a CROSS JOIN v b GROUP BY a.idx)"""
ORACLE["mean_distance_l2"] = sql(VECTORS, MEANS, select="SELECT idx, round(m, 6) AS mean_distance FROM means")
ORACLE["nearest_other_l2"] = sql(VECTORS, select="""
SELECT a.idx, arg_min(b.idx, (list_distance(a.e, b.e), b.idx)) AS nearest, round(min(list_distance(a.e, b.e)), 6) AS min_distance
FROM v a JOIN v b ON a.idx <> b.idx GROUP BY a.idx""")
ORACLE["farthest_on_average_l2"] = sql(VECTORS, MEANS, select="SELECT idx FROM means ORDER BY m DESC, idx LIMIT 1")
ORACLE["fpf_select_l2"] = sql(VECTORS, fpf("v", "g", "idx", "e", l2, 5, "min(idx)", "picks"), select="""
SELECT key AS idx, idx::BIGINT AS prototype_index, round(cover, 6) AS cover_distance FROM picks""")
ORACLE["build_prototypes_tag_jaccard"] = sql(MDOMS, PROTOS, select="""
SELECT page_id, label, label || '_prototype_' || lpad(idx::VARCHAR, 2, '0') AS name, strlen(dom) AS size, url,
  round(cover, 6) AS cover_distance FROM protos""")
ORACLE["write_prototypes"] = sql(MDOMS, PROTOS, select="""
SELECT label || '_prototype_' || lpad(idx::VARCHAR, 2, '0') AS name, label, strlen(dom) AS size, dom FROM protos""")
ORACLE["prototype_build_summary"] = sql(MDOMS, PROTOS, select="""
SELECT p.label, count(*) AS k, any_value(n.n) AS samples,
  string_agg(p.label || '_prototype_' || lpad(idx::VARCHAR, 2, '0'), ',' ORDER BY idx) AS prototypes,
  string_agg(page_id::VARCHAR, ',' ORDER BY idx) AS indices
FROM protos p JOIN (SELECT label, count(*) AS n FROM big GROUP BY label) n ON n.label = p.label GROUP BY p.label""")
ORACLE["union_prototype_sets"] = sql(MDOMS, PROTOS, select="""
SELECT CASE WHEN label = 'phish' THEN 'first' ELSE 'legit' END AS proto_set, page_id FROM protos""")

KNOWN = """files AS (SELECT 's' || lpad(page_id::VARCHAR, 9, '0') AS stem, url, dom, label,
  starts_with(url, 'http://') OR contains(url, '.com') AS known FROM doms)"""
ORACLE["read_samples_sidecar"] = ORACLE["join_sidecar"] = sql(MDOMS, KNOWN, select="""
SELECT stem, url, label, dom, strlen(dom) AS size FROM files WHERE known""")
ORACLE["read_samples_labelled_dirs"] = sql(MDOMS, select="""
SELECT page_id::VARCHAR AS stem, page_id::VARCHAR AS url, label, dom FROM doms""")
ORACLE["read_prototype_sets"] = sql(MDOMS, select=f"""
SELECT proto_set, page_id::VARCHAR AS stem, dom FROM doms WHERE strlen(dom) >= {MINIMAL_DOM}""")
ORACLE["read_prototype_files"] = sql(MDOMS, PROTOS, select="""
SELECT label, label || '_prototype_' || lpad(idx::VARCHAR, 2, '0') AS stem, dom FROM protos""")
ORACLE["write_manifest_files"] = sql(MDOMS, KNOWN, select="""
SELECT stem || '.dom' AS dom, stem || '.meta.json' AS meta, CASE WHEN known AND label = 'phish' THEN 'phish' ELSE 'unknown' END AS label FROM files""")


def _cluster_rounds(k: int, apart: str = "list_distance(v.e, c.e)") -> str:
    ctes = ["k1 AS (SELECT idx AS key FROM means ORDER BY m DESC, idx LIMIT 1)"]
    for i in range(1, k + 1):
        measured = f"CASE WHEN v.idx = c.idx THEN 0 ELSE {apart} END"
        before = f"least(p.d, {measured})" if i > 1 else measured
        join = f"JOIN d{i - 1} p ON p.idx = v.idx" if i > 1 else ""
        ctes.append(f"d{i} AS MATERIALIZED (SELECT v.idx, {before} AS d FROM v JOIN v c ON c.idx = (SELECT key FROM k{i}) {join})")
        ctes.append(f"k{i + 1} AS (SELECT idx AS key, d AS cover FROM d{i} ORDER BY d DESC, idx LIMIT 1)")
    return ",\n".join(ctes)


def _clusters(gain: float) -> str:
    """Centres, each added while all before it lowered the variance by ``gain``."""
    first = """SELECT 1::BIGINT AS cluster, key AS idx, NULL::DOUBLE AS cover_distance, NULL::DOUBLE AS variance_before, NULL::DOUBLE AS variance_after FROM k1
"""
    return first + "".join(f"""UNION ALL SELECT {i}, key, round(cover, 6), (SELECT round(var_pop(d), 6) FROM d{i - 1}), (SELECT round(var_pop(d), 6) FROM d{i}) FROM k{i}
WHERE (SELECT bool_and(gain >= {gain}) FROM (VALUES {", ".join(f"((SELECT var_pop(d) FROM d{j - 1}) - (SELECT var_pop(d) FROM d{j}))" for j in range(2, i + 1))}) t(gain))
""" for i in range(2, 5))


ORACLE["fpf_cluster_l2"] = sql(VECTORS, MEANS, _cluster_rounds(4), select=_clusters(-1))
ORACLE["fpf_cluster_gain_l2"] = sql(VECTORS, MEANS, _cluster_rounds(4), select=_clusters(0.001))
TAG_ROWS = "v AS MATERIALIZED (SELECT page_id AS idx, dom FROM doms WHERE label = 'phish')"
TAG_MEANS = f"""means AS (SELECT a.idx, round(sum(CASE WHEN a.idx = b.idx THEN 0 ELSE {jaccard('a.dom', 'b.dom')} END), 9) AS m
  FROM v a CROSS JOIN v b GROUP BY a.idx)"""
ORACLE["fpf_cluster_gain_tag_jaccard"] = sql(MDOMS, TAG_ROWS, TAG_MEANS, _cluster_rounds(4, jaccard("v.dom", "c.dom")), select=_clusters(0.001))
SELECTED = f"""centres AS MATERIALIZED (SELECT cluster, idx FROM ({_clusters(-1)}) x)"""
NEAR_SELECTED = """assigned AS MATERIALIZED (SELECT v.idx, v.e, c.cluster, list_distance(v.e, w.e) AS d
  FROM v CROSS JOIN centres c JOIN v w ON w.idx = c.idx QUALIFY row_number() OVER (PARTITION BY v.idx ORDER BY d, c.cluster) = 1)"""
ORACLE["assign_selected_clusters_l2"] = sql(VECTORS, MEANS, _cluster_rounds(4), SELECTED, NEAR_SELECTED, select="""
SELECT idx, cluster, round(d, 6) AS center_distance FROM assigned""")
ORACLE["cluster_samples_l2"] = sql(VECTORS, MEANS, _cluster_rounds(4), SELECTED, NEAR_SELECTED, """
sizes AS (SELECT cluster, count(*) AS size, avg(d) AS a FROM assigned GROUP BY cluster)""", """
inner_d AS (SELECT x.cluster, list_distance(x.e, y.e) AS d FROM assigned x JOIN assigned y ON x.cluster = y.cluster AND x.idx < y.idx)""", select="""
SELECT s.cluster, any_value(c.idx) AS center, s.size, nullif(count(i.d), 0) AS pairs, round(any_value(s.a), 6) AS avg_center_distance,
  round(min(i.d), 6) AS min_distance, round(max(i.d), 6) AS max_distance, round(avg(i.d), 6) AS avg_distance
FROM sizes s JOIN centres c USING (cluster) LEFT JOIN inner_d i USING (cluster) GROUP BY s.cluster, s.size""")
ORACLE["cover_variance_l2"] = sql(VECTORS, """
near AS (SELECT v.idx, c.idx AS centre, list_distance(v.e, c.e) AS d FROM v JOIN v c ON c.idx IN (0, 1, 2))""", """
cover AS (SELECT n.n, near.idx, min(d) AS d FROM near JOIN (VALUES (1), (2), (3)) n(n) ON near.centre < n.n GROUP BY ALL)""", select="""
SELECT n::BIGINT AS centres, round(var_pop(d), 6) AS variance FROM cover GROUP BY n""")
ASSIGNED = """assigned AS MATERIALIZED (SELECT v.idx, v.e, c.idx + 1 AS cluster, list_distance(v.e, c.e) AS d
  FROM v JOIN v c ON c.idx IN (0, 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY v.idx ORDER BY d, c.idx) = 1)"""
ORACLE["assign_clusters_l2"] = sql(VECTORS, ASSIGNED, select="""
SELECT idx, cluster, round(d, 6) AS center_distance FROM assigned""")
ORACLE["write_clustered_l2"] = sql(VECTORS, ASSIGNED, select="""
SELECT cluster, count(*) AS samples FROM assigned GROUP BY cluster""")
ORACLE["cluster_report_l2"] = sql(VECTORS, ASSIGNED, """
sizes AS (SELECT cluster, count(*) AS size, avg(d) AS a FROM assigned GROUP BY cluster)""", """
inner_d AS (SELECT x.cluster, list_distance(x.e, y.e) AS d FROM assigned x JOIN assigned y ON x.cluster = y.cluster AND x.idx < y.idx)""", select="""
SELECT s.cluster, s.cluster - 1 AS center, s.size, count(i.d) AS pairs, round(any_value(s.a), 6) AS avg_center_distance,
  round(min(i.d), 6) AS min_distance, round(max(i.d), 6) AS max_distance, round(avg(i.d), 6) AS avg_distance
FROM sizes s LEFT JOIN inner_d i USING (cluster) GROUP BY s.cluster, s.size""").replace(
    "count(i.d) AS pairs", "nullif(count(i.d), 0) AS pairs")

# --- verdicts ------------------------------------------------------------------------------

# the driver's pages name no resources, so a small page is classified by an empty signature
CLASSIFIED = f"""classified AS MATERIALIZED (
  SELECT page_id, url, CASE WHEN strlen(dom) < {SMALL_DOM} THEN '' ELSE dom END AS payload, strlen(dom) AS dom_length,
    CASE WHEN strlen(dom) < {SMALL_DOM} THEN 0 END AS resource_sig_length,
    CASE WHEN strlen(dom) < {SMALL_DOM} THEN 'resource-signature' ELSE 'dom-structure' END AS detection_mode FROM doms)"""
F4 = "printf('%.4f', round({0}, 4))"
VERDICTS = f"""judged AS (
  SELECT *, strlen(payload) AS dom_size, strlen(payload) < {MINIMAL_DOM} AS minimal,
    CASE WHEN strlen(payload) < {MINIMAL_DOM} THEN legit_min + 0.05::DOUBLE ELSE legit_min END AS adjusted
  FROM classified JOIN scored USING (page_id)),
decided AS (
  SELECT *, CASE WHEN phish_min < adjusted THEN 'phish' ELSE 'legit' END AS verdict,
    CASE WHEN abs(phish_min - adjusted) > 0.1::DOUBLE THEN 'high' WHEN abs(phish_min - adjusted) > 0.05::DOUBLE THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN phish_min < adjusted AND minimal THEN 'Phishing prototype match (' || {F4.format('phish_min')} || ') better than adjusted legitimate ('
           || {F4.format('adjusted')} || ', original: ' || {F4.format('legit_min')} || ')'
         WHEN phish_min < adjusted THEN 'Phishing prototype match (' || {F4.format('phish_min')} || ') better than legitimate (' || {F4.format('legit_min')} || ')'
         WHEN minimal THEN 'Legitimate prototype match (' || {F4.format('adjusted')} || ', original: ' || {F4.format('legit_min')} || ') better than phishing (' || {F4.format('phish_min')} || ')'
         ELSE 'Legitimate prototype match (' || {F4.format('legit_min')} || ') better than phishing (' || {F4.format('phish_min')} || ')' END AS final_decision
  FROM judged),
verdicts AS MATERIALIZED (
  SELECT page_id, url, verdict, confidence, final_decision, minimal AS minimal_dom_adjustment_applied, detection_mode, dom_size,
    dom_length, resource_sig_length::BIGINT AS resource_sig_length, round(phish_min, 4) AS phish_min, round(phish_avg, 4) AS phish_avg,
    round(legit_min, 4) AS legit_min, round(legit_avg, 4) AS legit_avg,
    'Classified as ' || verdict || '. Phishing prototype distances: min=' || {F4.format('phish_min')} || ', avg=' || {F4.format('phish_avg')}
      || '. Legitimate prototype distances: min=' || {F4.format('legit_min')} || ', avg=' || {F4.format('legit_avg')} || '. '
      || CASE WHEN minimal THEN 'Minimal DOM penalty applied (+0.05). ' ELSE '' END || final_decision AS reason
  FROM decided)"""
JUDGED = [MDOMS, PROTOS, CLASSIFIED, scores("payload", "classified"), VERDICTS]
ORACLE["classify_tag_jaccard"] = sql(*JUDGED, select="SELECT * EXCLUDE (url) FROM verdicts")

DETECTED = f"""detected AS (
  SELECT c.event_id, c.url, f.phish_id, '{DETAIL}' || f.phish_id AS detail_page, f.submission_time AS submitted_at,
    CASE WHEN f.phish_id IS NOT NULL THEN 'phish' ELSE v.verdict END AS classification,
    CASE WHEN f.phish_id IS NOT NULL THEN 'signature-local' ELSE 'ncd' END AS source,
    CASE WHEN f.phish_id IS NOT NULL THEN 'high' ELSE v.confidence END AS confidence,
    {", ".join(f"CASE WHEN f.phish_id IS NULL THEN v.{c} END AS {c}" for c in
               ["detection_mode", "dom_size", "phish_min", "phish_avg", "legit_min", "legit_avg"])}
  FROM checks c LEFT JOIN feed f USING (url) JOIN verdicts v USING (url))"""
ORACLE["detect_tag_jaccard"] = sql(*JUDGED, CHECKS, FEED_RAW, FEED, DETECTED, select="SELECT * FROM detected")
ORACLE["detect_parse_first_tag_jaccard"] = ORACLE["detect_tag_jaccard"]
ORACLE["detect_carried_pages_tag_jaccard"] = ORACLE["detect_tag_jaccard"]
ORACLE["detect_stream"] = ORACLE["detect_tag_jaccard"]
ORACLE["classify_resources_tag_jaccard"] = sql(MDOMS, PROTOS, RESOURCES, """s AS (SELECT page_id, array_to_string(list_sort(list_distinct([
    bare || '/js/app' || i || '.js', 'https://cdn.' || host || '/s.css',
    replace('www.' || host, 'www.', '') || '/i/' || i || '.png', bare || '/bg/' || host || '.gif',
    'ads.example.org', 'frame.example.net/x', bare || '/v.mp4'])), ' ') AS signature FROM r)""", """classified AS MATERIALIZED (
  SELECT d.page_id, d.url, s.signature AS payload, 0 AS dom_length, strlen(s.signature) AS resource_sig_length,
    'resource-signature' AS detection_mode FROM doms d JOIN s USING (page_id))""", scores("payload", "classified"), VERDICTS,
                                               select="SELECT * EXCLUDE (url, dom_length, reason) FROM verdicts")
ORACLE["classify_ncd_rules"] = sql(MDOMS, CLASSIFIED, select="""
SELECT page_id, true AS ordered, true AS follows, detection_mode, strlen(payload) AS dom_size FROM classified""")
ORACLE["prototype_distances_ncd_rules"] = sql(MDOMS, BIG, select=f"""
SELECT d.page_id, p.label, p.i AS prototype_index, true AS in_range
FROM doms d CROSS JOIN (SELECT label, unnest(range(1, least({K}, count(*)) + 1)) AS i FROM big GROUP BY label) p""")
ORACLE["build_prototypes_ncd_rules"] = sql(MDOMS, BIG, select=f"""
SELECT label, label || '_prototype_' || lpad(i::VARCHAR, 2, '0') AS name, true AS sized
FROM (SELECT label, unnest(range(1, least({K}, count(*)) + 1)) AS i FROM big GROUP BY label)""")
ORACLE["nearest_sample_ncd_rules"] = "SELECT page_id, true AS follows, true AS in_range FROM pages"
ORACLE["cluster_samples_ncd_rules"] = f"SELECT count(*) AS samples, true AS all_named, true AS ordered FROM pages WHERE {LABEL} = 'phish'"
ORACLE["page_features_ncd_rules"] = "SELECT page_id, true AS best, true AS ordered, 1.0::DOUBLE AS absent_set FROM pages"
ORACLE["tune_threshold_ncd_rules"] = sql(MDOMS, BIG, select=f"""
SELECT (least({K}, count(*) FILTER (label = 'legit')) * least({K}, count(*) FILTER (label = 'phish')))::BIGINT AS lp_comparisons,
  true AS middle, true AS separates, true AS ordered FROM big""")
ORACLE["detect_ncd_rules"] = sql(CHECKS, FEED_RAW, FEED, select="""
SELECT event_id, CASE WHEN phish_id IS NULL THEN 'ncd' ELSE 'signature-local' END AS source, phish_id,
  CASE WHEN phish_id IS NOT NULL THEN 'phish' END AS by_feed, true AS decided FROM checks LEFT JOIN feed USING (url)""")
ORACLE["detect_default_ids"] = sql(CHECKS, FEED_RAW, FEED, select="""
SELECT CASE WHEN phish_id IS NULL THEN 'ncd' ELSE 'signature-local' END AS source, count(*) AS checks,
  count(*) FILTER (phish_id IS NULL) AS ids FROM checks LEFT JOIN feed USING (url) GROUP BY 1""")
ORACLE["detect_features_tag_jaccard"] = sql(EVENTS, NESTING, STRUCTURE, CHECKS, FEED_RAW, FEED, select="""
SELECT c.event_id, """ + ", ".join(f"CASE WHEN f.phish_id IS NULL THEN x.{c} END AS {c}" for c in STRUCTURE_FEATURES) + """
FROM checks c LEFT JOIN feed f USING (url) JOIN pages p USING (url) JOIN structure x ON x.page_id = p.page_id""")
ORACLE["redetect_tag_jaccard"] = sql(*JUDGED, CHECKS, FEED_RAW, FEED.replace("feed AS", "first_feed AS"), """
feed AS (SELECT url, min(phish_id) AS phish_id, any_value(submission_time) AS submission_time, any_value(target) AS target FROM (
  SELECT phish_id, url, submission_time, target FROM first_feed WHERE NOT contains(url, 'blog.')
  UNION ALL SELECT page_id + 5000000, url, NULL, NULL FROM pages WHERE contains(url, '#')) GROUP BY url)""", DETECTED, select="""
SELECT event_id, url, classification, source, phish_id FROM detected""")
ORACLE["detect_signature_only"] = sql(CHECKS, FEED_RAW, FEED, select=f"""
SELECT event_id, url, CASE WHEN phish_id IS NOT NULL THEN 'phish' ELSE 'legit' END AS classification, 'signature-local' AS source,
  CASE WHEN phish_id IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence, phish_id,
  CASE WHEN phish_id IS NULL THEN '{SKIPPED}' END AS message FROM checks LEFT JOIN feed USING (url)""")
ORACLE["legacy_unverified_verdict"] = sql(*JUDGED, CHECKS, FEED_RAW, select="""
SELECT c.event_id, CASE WHEN f.verified = 'yes' THEN 'phish' ELSE 'suspicious' END AS classification,
  CASE WHEN f.verified = 'yes' THEN 'signature-local' ELSE 'phishtank_unverified' END AS source,
  CASE WHEN f.verified = 'yes' THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN f.verified = 'no' THEN v.verdict END AS similar
FROM checks c JOIN feed_raw f USING (url) JOIN verdicts v USING (url)""")
ORACLE["hybrid_decision"] = """
WITH e AS (SELECT event_id, least(value / 100, 1.0::DOUBLE) AS p, CASE WHEN event_type = 'click' THEN 'phish' ELSE 'legit' END AS ncd FROM events)
SELECT event_id, CASE WHEN p >= 0.6::DOUBLE THEN CASE WHEN p >= 0.5::DOUBLE THEN 'phish' ELSE 'legit' END ELSE ncd END AS final_verdict,
  CASE WHEN p >= 0.6::DOUBLE THEN 'ml' ELSE 'ncd' END AS decision_source,
  CASE WHEN greatest(p, 1 - p) > 0.8::DOUBLE THEN 'high' WHEN greatest(p, 1 - p) > 0.6::DOUBLE THEN 'medium' ELSE 'low' END AS ml_confidence,
  CASE WHEN ncd = 'phish' THEN 1 ELSE 0 END::BIGINT AS ncd_int,
  CASE WHEN p / 5 > 0.1::DOUBLE THEN 'high' WHEN p / 5 > 0.05::DOUBLE THEN 'medium' ELSE 'low' END AS band FROM e"""
ORACLE["verdict_family"] = """
SELECT vec_id, CASE WHEN label <= 3 THEN 'phish' WHEN label = 4 THEN 'suspicious' WHEN label = 5 THEN 'legit' ELSE 'unknown' END AS family
FROM embeddings"""

# --- model ---------------------------------------------------------------------------------

SCALED = ["total_tag_count", "depth_of_dom_tree", "dom_length_bytes", "average_children_per_node"]
ORACLE["scale_features"] = sql(EVENTS, NESTING, STRUCTURE, select="SELECT page_id, " + ", ".join(
    f"round(({f} - avg({f}) OVER ()) / CASE WHEN stddev_pop({f}) OVER () = 0 THEN 1 ELSE stddev_pop({f}) OVER () END, 6) AS {f}"
    for f in SCALED) + " FROM structure")
SAMPLES = """samples AS (
  SELECT d.doc_id, d.source || '/' || d.doc_id AS url, CASE WHEN l.quality = 0 THEN 'phish' ELSE 'legit' END AS label, d.text
  FROM documents d JOIN labels l USING (doc_id))"""
ORACLE["fpf_select_documents_ncd_rules"] = sql(SAMPLES, select="""
SELECT label, unnest(range(1, least(5, count(*)) + 1)) AS prototype_index, true AS falls FROM samples GROUP BY label""")
ORACLE["balanced_weights"] = sql(SAMPLES, select="""
SELECT doc_id, round(count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY label)), 6) AS weight FROM samples""")
ORACLE["stratified_split"] = sql(SAMPLES, select="""
SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || '-42'), doc_id)
  <= round(count(*) OVER (PARTITION BY label) * 0.2) AS is_test FROM samples""")
ORACLE["sample_index"] = sql(SAMPLES, select="""
SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY url) - 1 AS position FROM samples""")
CONFUSION = """c AS (SELECT count(*)::DOUBLE AS n, (count(*) FILTER (quality = toxic))::DOUBLE AS hit,
  (count(*) FILTER (quality = 1 AND toxic = 1))::DOUBLE AS tp1, (count(*) FILTER (toxic = 1))::DOUBLE AS said1, (count(*) FILTER (quality = 1))::DOUBLE AS true1,
  (count(*) FILTER (quality = 0 AND toxic = 0))::DOUBLE AS tp0, (count(*) FILTER (toxic = 0))::DOUBLE AS said0, (count(*) FILTER (quality = 0))::DOUBLE AS true0 FROM labels)"""
ORACLE["classification_metrics"] = sql(CONFUSION, select="""
SELECT round(hit / n, 6) AS accuracy, round(tp1 / said1, 6) AS precision, round(tp1 / true1, 6) AS recall,
  round(2 * tp1 / (said1 + true1), 6) AS f1_score FROM c""")
ORACLE["classification_report"] = sql(CONFUSION, """
per AS (SELECT 'phish' AS class, tp1 / said1 AS p, tp1 / true1 AS r, 2 * tp1 / (said1 + true1) AS f, true1 AS s FROM c
  UNION ALL SELECT 'legit', tp0 / said0, tp0 / true0, 2 * tp0 / (said0 + true0), true0 FROM c)""", """
everything AS (SELECT * FROM per UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM per
  UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM per)""", select="""
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score, s::BIGINT AS support FROM everything""")

# --- corpus --------------------------------------------------------------------------------

ORACLE["label_counts"] = sql(SAMPLES, select="""
SELECT coalesce(s.label, 'unknown') AS label, count(*) AS samples FROM documents d LEFT JOIN samples s USING (doc_id) GROUP BY 1""")
ORACLE["dataset_overview"] = sql(SAMPLES, select="""
SELECT count(*) AS samples, (SELECT string_agg(url, ',' ORDER BY doc_id) FROM (SELECT * FROM samples ORDER BY doc_id LIMIT 10)) AS examples,
  count(*) FILTER (label = 'phish') AS phish, count(*) FILTER (label = 'legit') AS legit FROM samples""")
ORACLE["validate_samples"] = """
SELECT count(*) AS total, count(*) FILTER (source = 'src7') AS missing_meta,
  count(*) FILTER (source <> 'src7' AND lang = 'fr') AS missing_label, count(*) FILTER (source <> 'src7' AND lang = 'de') AS missing_url,
  count(*) FILTER (source <> 'src7' AND lang = 'es') AS invalid_json,
  count(*) FILTER (source = 'src7' OR lang IN ('fr', 'es')) = 0 AS valid FROM documents"""
ORACLE["problem_examples"] = """
SELECT doc_id FROM documents WHERE source <> 'src7' AND lang = 'fr' ORDER BY doc_id LIMIT 5"""
ORACLE["build_manifest"] = sql(SAMPLES, select="""
SELECT d.doc_id || '.dom' AS dom, d.doc_id || '.meta.json' AS meta, coalesce(s.label, 'unknown') AS label
FROM documents d LEFT JOIN samples s USING (doc_id)""")
AT = "1717243200"
ORACLE["build_samples"] = sql(MDOMS, CHECKS, "uses AS (SELECT url, count(*) AS n FROM checks GROUP BY url)", select=f"""
SELECT '{AT}_' || left(sha1(d.url || '{AT}'), 12) AS sample_id, d.url, {AT}::BIGINT AS ts, strlen(d.dom) AS size, d.label, u.n
FROM uses u JOIN doms d USING (url)""")
ORACLE["write_samples"] = sql(MDOMS, select="""
SELECT (1704067200 + page_id) || '_' || left(sha1(url || (1704067200 + page_id)), 12) AS sample_id, url, 1704067200 + page_id AS ts,
  strlen(dom) AS size, label, dom FROM doms""")
ORACLE["ingest_summary"] = sql(SAMPLES, select=f"""
SELECT label, count(*) AS attempted, count(*) FILTER (ok) AS completed, count(*) FILTER (NOT ok) AS failed FROM (
  SELECT {LABEL} AS label, true AS ok FROM pages UNION ALL SELECT 'legit', false FROM samples) GROUP BY label""")
ORACLE["union_samples"] = sql(MDOMS, SAMPLES, select="""
SELECT label, count(*) AS n, sum(b)::BIGINT AS bytes FROM (
  SELECT label, strlen(dom) AS b FROM doms UNION ALL SELECT label, strlen(text) FROM samples) GROUP BY label""")

# --- enrichment, feedback, metrics ---------------------------------------------------------

LANG = "regexp_extract(url, '/(en|fr|de|es)/', 1)"
ISSUER = f"""CASE WHEN NOT starts_with(url, 'https://') THEN 'HTTP only (no SSL)'
  WHEN contains(url, '?') AND {LANG} = 'en' THEN 'SSL connection interrupted'
  WHEN {LANG} = 'fr' THEN 'Certificate verification failed' WHEN {LANG} = 'de' THEN 'Connection timeout'
  WHEN {LANG} = 'es' THEN 'SSL handshake failed' ELSE 'Test CA' END"""
VALID_TO = "CASE WHEN contains(url, '#') THEN 'some day' ELSE '2030-12-31' END"
ORACLE["cert_probe_status"] = f"SELECT url, {ISSUER} AS issuer, '2018-01-05' AS valid_from, {VALID_TO} AS valid_to FROM pages"
ORACLE["enrich_domain"] = sql(CHECKS, rf"""
facts AS (SELECT url, {HOST} AS host, regexp_replace({HOST}, '^www\.', '') AS domain, {ISSUER} AS issuer, {VALID_TO} AS valid_to FROM pages)""", """
aged AS (SELECT *, CASE WHEN domain NOT LIKE '%.org' THEN date '2015-01-01' + 37 * length(domain)::INTEGER END AS born FROM facts)""", select="""
SELECT c.event_id, c.url, CASE WHEN host NOT LIKE 'blog.%' THEN '10.0.0.' || length(host) END AS ip,
  CASE WHEN host NOT LIKE 'blog.%' THEN CASE WHEN host LIKE 'm.%' THEN 'no PTR record' ELSE 'ptr.' || host END END AS hosting_reverse_dns,
  CASE WHEN born IS NULL THEN 'unknown' ELSE 'R' || upper(left(domain, 1)) END AS registrar,
  date_diff('day', born, date '2024-06-01') AS domain_age_days, born::DATE::VARCHAR AS domain_created, (born::DATE + 3650)::VARCHAR AS domain_expires,
  CASE WHEN contains(domain, 'spam') THEN '' ELSE 'ns1.' || domain || ',ns2.' || domain END AS nameservers,
  CASE WHEN contains(domain, 'spam') THEN '' WHEN domain LIKE '%.net' THEN 'none' ELSE 'mx.' || domain END AS mx_records,
  issuer = 'Test CA' AS ssl_enabled, issuer AS ssl_issuer, CASE WHEN issuer = 'Test CA' THEN '2018-01-05' ELSE 'unknown' END AS ssl_valid_from,
  CASE WHEN issuer = 'Test CA' THEN valid_to ELSE 'unknown' END AS ssl_valid_to
FROM checks c JOIN aged a USING (url)""")
FEEDBACK = """entries AS (SELECT (CASE WHEN event_type = 'click' THEN event_id ELSE event_id + 1000000000 END)::VARCHAR AS id,
  CASE WHEN value >= 50 THEN 'Yes' WHEN value >= 10 THEN 'no' ELSE 'maybe' END AS correct, ts + INTERVAL 10 MINUTE AS ts FROM events)"""
ACCEPTED = f"""accepted AS (SELECT f.id, c.url, {LABEL.replace('url', 'c.url')} AS verdict, lower(f.correct) AS user_feedback,
  epoch_us(f.ts) AS at, epoch_us(c.ts) AS detected FROM entries f JOIN checks c ON c.event_id::VARCHAR = f.id WHERE lower(f.correct) IN ('yes', 'no'))"""
ORACLE["join_feedback"] = sql(CHECKS, FEEDBACK, ACCEPTED, select="SELECT * FROM accepted")
ORACLE["feedback_stream"] = ORACLE["join_feedback"]
ORACLE["reject_feedback"] = sql(CHECKS, FEEDBACK, select="""
SELECT id, correct, CASE WHEN lower(correct) NOT IN ('yes', 'no') THEN 400 ELSE 404 END::BIGINT AS status FROM entries
WHERE lower(correct) NOT IN ('yes', 'no') OR id NOT IN (SELECT event_id::VARCHAR FROM checks)""")
ORACLE["append_feedback"] = sql(CHECKS, FEEDBACK, ACCEPTED, select="""
SELECT verdict, user_feedback, count(*) AS n FROM accepted GROUP BY ALL""")
ORACLE["detection_metrics"] = sql(CHECKS, FEED_RAW, FEED, FEEDBACK, ACCEPTED, SAMPLES, select="""
SELECT count(*) AS lookup_count, count(phish_id) AS hits, 0::BIGINT AS errors, count(phish_id) AS db_hits,
  (SELECT count(*) FROM samples) AS samples_loaded, (SELECT count(*) FROM accepted) AS total_submissions
FROM checks LEFT JOIN feed USING (url)""")
ORACLE["dedupe_checks_stream"] = sql(CHECKS, """
kept AS (SELECT url, min(ts) AS ts FROM checks GROUP BY url UNION ALL
  SELECT k.url, min(c.ts) FROM kept k JOIN checks c ON c.url = k.url AND c.ts >= k.ts + INTERVAL 1 HOUR GROUP BY k.url)""", select="""
SELECT url, count(*) AS kept FROM kept GROUP BY url""")
ORACLE["dedupe_checks_rows"] = sql(CHECKS, """
kept AS (SELECT url, min(ts) AS ts FROM checks GROUP BY url UNION ALL
  SELECT k.url, min(c.ts) FROM kept k JOIN checks c ON c.url = k.url AND c.ts >= k.ts + INTERVAL 1 HOUR GROUP BY k.url)""", select="""
SELECT url, epoch_us(ts) AS at FROM kept WHERE ts IS NOT NULL""")
ORACLE["feedback_answers_stream"] = sql(CHECKS, FEEDBACK, select=f"""
SELECT f.id, f.correct, CASE WHEN valid THEN c.url END AS url, CASE WHEN valid AND c.url IS NOT NULL THEN {LABEL.replace('url', 'c.url')} END AS verdict,
  epoch_us(f.ts) AS at, CASE WHEN NOT valid THEN 400 WHEN c.url IS NULL THEN 404 ELSE 200 END::BIGINT AS status
FROM (SELECT *, lower(correct) IN ('yes', 'no') AS valid FROM entries) f LEFT JOIN checks c ON c.event_id::VARCHAR = f.id""")
ORACLE["signature_lookup_bucketed"] = sql(CHECKS, FEED_RAW, FEED, select=f"""
SELECT event_id, url, phish_id IS NOT NULL AS in_database, phish_id, '{DETAIL}' || phish_id AS detail_page FROM checks LEFT JOIN feed USING (url)""")
ORACLE["page_tokens_sql"] = sql(DOMS, select="""
SELECT page_id, (i - 1)::INTEGER AS position, string_split(dom, ' ')[i] AS tag FROM (
  SELECT page_id, dom, unnest(range(1, len(string_split(dom, ' ')) + 1)) AS i FROM doms) WHERE dom <> ''""")
ORACLE["detect_enriched_tag_jaccard"] = sql(*JUDGED, CHECKS, FEED_RAW, FEED, DETECTED, rf"""
facts AS (SELECT url, {HOST} AS host, regexp_replace({HOST}, '^www\.', '') AS domain, {ISSUER} AS issuer FROM pages)""", select="""
SELECT d.event_id, d.classification, d.source,
  CASE WHEN d.phish_id IS NULL THEN CASE WHEN domain LIKE '%.org' THEN 'unknown' ELSE 'R' || upper(left(domain, 1)) END END AS registrar,
  CASE WHEN d.phish_id IS NULL THEN issuer END AS ssl_issuer FROM detected d JOIN facts USING (url)""")
ORACLE["saved_models"] = """SELECT k.kind, count(*) AS pages, true AS same, true AS sums, true AS follows
FROM pages CROSS JOIN (VALUES ('logistic_regression'), ('random_forest')) k(kind) GROUP BY k.kind"""
ORACLE["metrics_stream"] = sql(CHECKS, FEED_RAW, FEED, select="""
SELECT CASE WHEN phish_id IS NOT NULL THEN 'signature-local' ELSE 'ncd' END AS source, count(*) AS detections
FROM checks LEFT JOIN feed USING (url) GROUP BY 1""")


# the same answers whatever the size of the prototype set, and whatever is repeated
for _large, _small in (("detect_large_set", "detect"), ("detect_carried_large_set", "detect"), ("detect_repeated_rows", "detect"),
                       ("page_features_large_set", "page_features"), ("tune_threshold_large_set", "tune_threshold")):
    ORACLE[f"{_large}_tag_jaccard"] = ORACLE[f"{_small}_tag_jaccard"]
