"""The registered queries again as plain SQL over the given tables, for checking."""

from __future__ import annotations

from wayloom.plans.inputs import AS_OF, MAX_DEPTH
from wayloom.plans.queries import URL_BASE, WALK_BATCH

NOW = f"TIMESTAMP '{AS_OF}'"
DAY = 86_400_000_000


def _iso(value: str) -> str:
    return (
        f"CASE WHEN epoch_us({value}) % 1000000 = 0 THEN strftime({value}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({value}, '%Y-%m-%dT%H:%M:%S.%f') END"
    )


def _days(micros: str, unit: str = str(DAY)) -> str:
    return f"CAST((({micros}) - ((({micros}) % ({unit})) + ({unit})) % ({unit})) // ({unit}) AS BIGINT)"


CUSTOMER_LINK = "CASE WHEN {0} % 10 = 0 THEN '/c/' || {0} ELSE '/customer/' || {0} END"

HEADS = f"""
heads(requested_path, path, title, body, content_type, last_updated, org) AS (
  SELECT '/browse', '/browse', 'Browse', 'root', 'browse_page', '', ''
  UNION ALL SELECT '/region/' || r_regionkey, '/region/' || r_regionkey, r_name, r_name, 'browse_page', '', ''
    FROM region
  UNION ALL SELECT '/nation/' || n_nationkey, '/nation/' || n_nationkey, n_name, n_name, 'topic', '', '' FROM nation
  UNION ALL SELECT {CUSTOMER_LINK.format('c_custkey')}, '/customer/' || c_custkey, c_name,
    CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END, 'detailed_guide', '', c_mktsegment FROM customer
  UNION ALL SELECT '/supplier/' || s_suppkey, '/supplier/' || s_suppkey, s_name, s_name, 'service', '', ''
    FROM supplier
  UNION ALL SELECT '/order/' || o_orderkey, '/order/' || o_orderkey, CAST(o_orderkey AS VARCHAR),
    CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, 'transaction', CAST(o_orderdate AS VARCHAR),
    o_orderpriority FROM orders
  UNION ALL SELECT '/part/' || p_partkey, '/part/' || p_partkey, p_name, p_type, 'guide', '', p_brand
    FROM part WHERE p_partkey % 50 <> 0
)"""

LINKS = f"""
links(src, link_type, pos, dst) AS (
  SELECT '/browse', 'children', CAST(r_regionkey AS BIGINT), '/region/' || r_regionkey FROM region
  UNION ALL SELECT '/region/' || n_regionkey, 'children', n_nationkey, '/nation/' || n_nationkey FROM nation
  UNION ALL SELECT '/nation/' || c_nationkey, 'children', c_custkey * 2, {CUSTOMER_LINK.format('c_custkey')}
    FROM customer
  UNION ALL SELECT '/nation/' || s_nationkey, 'children', s_suppkey * 2 + 1, '/supplier/' || s_suppkey FROM supplier
  UNION ALL SELECT '/supplier/' || s_suppkey, 'related', 0, '/nation/' || s_nationkey FROM supplier
  UNION ALL SELECT '/customer/' || o_custkey, 'related', o_orderkey, '/order/' || o_orderkey FROM orders
  UNION ALL SELECT '/order/' || o_orderkey, 'related', 0, '/assets/' || o_orderkey || '.pdf' FROM orders
  UNION ALL SELECT '/order/' || l_orderkey, 'related', l_linenumber * 2, '/part/' || l_partkey FROM lineitem
  UNION ALL SELECT '/order/' || l_orderkey, 'related', l_linenumber * 2 + 1, '/supplier/' || l_suppkey FROM lineitem
)"""

SECTIONS = """
sections(ord, title, path) AS (SELECT r_regionkey, r_name, '/region/' || r_regionkey FROM region)"""

FOLLOW = """starts_with(dst, '/') AND NOT contains(dst, '/assets/') AND NOT contains(dst, '/images/')
    AND NOT contains(dst, '/attachments/')"""

EDGES = f"""
edges(src, dst) AS (
  SELECT DISTINCT l.src, h.path FROM links l JOIN heads h ON l.dst = h.requested_path WHERE {FOLLOW}
)"""

WALK = f"""
walk(ord, path, depth) AS (
  SELECT ord, path, 0 FROM sections
  UNION
  SELECT w.ord, e.dst, w.depth + 1 FROM walk w JOIN edges e ON w.path = e.src WHERE w.depth < {MAX_DEPTH}
),
reached(ord, path, depth) AS (SELECT ord, path, min(depth) FROM walk GROUP BY ord, path)"""


def _owned(order: str) -> str:
    return f"""
owned(ord, path, depth) AS (
  SELECT ord, path, depth FROM reached QUALIFY row_number() OVER (PARTITION BY path ORDER BY {order}) = 1
)"""


STATUS = "CASE WHEN coalesce(h.title, '') = '' OR coalesce(h.body, '') = '' THEN 'placeholder' ELSE 'active' END"

SITE = f"""
site AS (
  SELECT s.path AS section, h.path, h.content_type, h.last_updated, {STATUS} AS status, o.depth AS depth_level,
    h.org AS publishing_org,
    CASE WHEN o.depth < {MAX_DEPTH} THEN coalesce(c.n, 0) ELSE 0 END AS related_links_count
  FROM owned o JOIN sections s ON o.ord = s.ord JOIN heads h ON o.path = h.path
  LEFT JOIN (SELECT src, count(*) AS n FROM links GROUP BY src) c ON c.src = h.path
)"""

EVENT_SITE = """
site AS (
  SELECT CAST(user_id % 10 AS VARCHAR) AS section, '/doc/' || event_id AS path, event_type AS content_type,
    CAST(ts AS VARCHAR) AS last_updated, CAST(user_id % 6 AS INTEGER) AS depth_level,
    CASE WHEN event_id % 7 = 0 THEN '' ELSE 'org' || (user_id % 12) END AS publishing_org
  FROM events
)"""

EVENT_SECTIONS = """
sections(ord, title, path) AS (
  SELECT DISTINCT CAST(user_id % 10 AS INTEGER), 'Section ' || (user_id % 10), CAST(user_id % 10 AS VARCHAR) FROM events
)"""

PAGE_EVENTS = """
page_events AS (
  SELECT event_id, ts AS event_time, CAST(user_id AS VARCHAR) AS section,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS section_started,
    user_id % 6 AS depth, event_type AS content_type, event_type = 'error' AS rate_limited
  FROM events
)"""

DURATION = """
  CASE WHEN us // 86400000000 = 0 THEN '' WHEN us // 86400000000 = 1 THEN '1 day, '
    ELSE (us // 86400000000) || ' days, ' END
  || (us % 86400000000) // 3600000000 || ':' || lpad(CAST((us % 3600000000) // 60000000 AS VARCHAR), 2, '0')
  || ':' || lpad(CAST((us % 60000000) // 1000000 AS VARCHAR), 2, '0')"""

PROGRESS = f"""
totals AS (
  SELECT CAST(count(*) FILTER (section_started) AS BIGINT) AS sections_analyzed, count(*) AS total_links_found,
    count(*) FILTER (rate_limited) AS rate_limit_hits,
    (SELECT section FROM page_events ORDER BY event_time DESC, event_id DESC LIMIT 1) AS current_section,
    epoch_us(max(event_time)) - epoch_us(min(event_time)) AS us
  FROM page_events
),
progress AS (SELECT *, {DURATION} AS scan_duration FROM totals)"""

PRIORITY = """CAST(greatest(1, depth_level * 10
  + CASE content_type WHEN 'guide' THEN -500 WHEN 'detailed_guide' THEN -400 WHEN 'service' THEN -300
    WHEN 'transaction' THEN -300 ELSE 0 END
  + CASE WHEN contains(path, '/services/') THEN -100 ELSE 0 END
  + CASE WHEN contains(path, '/guidance/') THEN -50 ELSE 0 END) AS INTEGER)"""

# All pages ever queued, each with its round and place once it is taken; a step is a round.
PRIORITY_WALK = f"""
kinds AS (SELECT path, any_value(content_type) AS content_type FROM heads GROUP BY path),
entered AS (SELECT DISTINCT h.path, 0 AS depth_level, k.content_type FROM sections s
  JOIN heads h ON h.requested_path = s.path JOIN kinds k ON k.path = h.path),
queue(step, path, depth, priority, taken, place) AS (
  SELECT 0, path, depth_level, CAST({PRIORITY} AS INTEGER), CAST(NULL AS INTEGER), CAST(NULL AS BIGINT) FROM entered
  UNION ALL
  (WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY taken IS NULL ORDER BY priority, path, depth) AS rank FROM queue),
    batch AS (SELECT * FROM ranked WHERE taken IS NULL AND rank <= {WALK_BATCH}),
    linked AS (SELECT e.dst AS path, min(b.depth) + 1 AS depth_level FROM batch b JOIN edges e ON e.src = b.path
      WHERE b.depth < {MAX_DEPTH} GROUP BY e.dst),
    fresh AS (SELECT l.path, l.depth_level, k.content_type FROM linked l JOIN kinds k ON k.path = l.path ANTI JOIN ranked r ON r.path = l.path)
  SELECT step + 1, path, depth, priority, CASE WHEN taken IS NULL AND rank <= {WALK_BATCH} THEN step ELSE taken END,
    CASE WHEN taken IS NULL AND rank <= {WALK_BATCH} THEN rank ELSE place END
  FROM ranked WHERE EXISTS (FROM batch)
  UNION ALL SELECT (SELECT max(step) FROM ranked) + 1, path, depth_level, CAST({PRIORITY} AS INTEGER), NULL, NULL FROM fresh)
)"""

ITEMS = f"WITH {HEADS}, {LINKS}"
CATALOGUE = f"WITH {LINKS}, {SECTIONS}"


def _graph(order: str = "ord") -> str:
    return f"WITH RECURSIVE {HEADS}, {LINKS}, {SECTIONS}, {EDGES}, {WALK}, {_owned(order)}"


CRAWL = "SELECT s.path AS section, o.path, o.depth AS depth_level FROM owned o JOIN sections s ON o.ord = s.ord"

# Over a CTE ``site`` (and ``sections``) in the shape of a page table.
DATED = "SELECT section, TRY_CAST(nullif(last_updated, '') AS TIMESTAMP) AS t FROM site"
UPDATES = f"""
updates AS (
  SELECT section, {_iso('min(t)')} AS oldest_update, {_iso('max(t)')} AS newest_update, count(t) AS total_updates,
    CAST({_days(f"sum(CAST(epoch_us({NOW}) - epoch_us(t) AS HUGEINT))", f"count(t) * {DAY}")} AS DOUBLE)
      AS average_age_days,
    {_days(f"epoch_us({NOW}) - epoch_us(max(t))")} AS newest_age_days,
    CASE WHEN count(t) = 0 THEN 'No update data available' END AS error
  FROM ({DATED}) GROUP BY section
)"""
TYPES = "SELECT section, coalesce(content_type, 'unknown') AS content_type, count(*) AS n FROM site GROUP BY ALL"
ORGS = "SELECT section, publishing_org, count(*) AS n FROM site WHERE coalesce(publishing_org, '') <> '' GROUP BY ALL"
TYPE_TOTALS = "SELECT section, count(DISTINCT content_type) AS total_types FROM site GROUP BY section"
ORG_TOTALS = "SELECT section, count(DISTINCT nullif(publishing_org, '')) AS total_organisations FROM site GROUP BY section"
DEPTHS = """SELECT section, greatest(0, max(depth_level)) AS max_depth,
  CAST(sum(depth_level) AS DOUBLE) / count(*) AS average_depth FROM site GROUP BY section"""


def _top(counts: str, value: str, k: int) -> str:
    return f"""SELECT section, {value}, n, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, {value}) AS rank FROM ({counts})
    ) WHERE rank <= {k}"""


OWNER = f"""SELECT s.path AS section, t.publishing_org, t.n FROM sections s
  LEFT JOIN ({_top(ORGS, 'publishing_org', 1)}) t ON t.section = s.path"""

TRENDS = f"""{UPDATES},
trends AS (
  SELECT s.path AS section, u.oldest_update, u.newest_update, coalesce(u.total_updates, 0) AS total_updates,
    u.average_age_days, u.newest_age_days,
    CASE WHEN coalesce(u.total_updates, 0) = 0 THEN 'No update data available' END AS error,
    coalesce(t.total_types, 0) AS total_types, coalesce(d.max_depth, 0) AS max_depth,
    coalesce(d.average_depth, 0.0) AS average_depth, coalesce(o.total_organisations, 0) AS total_organisations
  FROM sections s LEFT JOIN updates u ON u.section = s.path LEFT JOIN ({TYPE_TOTALS}) t ON t.section = s.path
  LEFT JOIN ({DEPTHS}) d ON d.section = s.path LEFT JOIN ({ORG_TOTALS}) o ON o.section = s.path
)"""
STALENESS = "coalesce(least(1.0::DOUBLE, newest_age_days / 365.0::DOUBLE), 1.0::DOUBLE) AS staleness_score"
COMPLEXITY = """(least(1.0::DOUBLE, max_depth / 10.0::DOUBLE) + least(1.0::DOUBLE, average_depth / 5.0::DOUBLE))
  / 2.0::DOUBLE AS complexity_score"""

QUEUE = f"SELECT section, path, depth_level AS depth, {PRIORITY} AS priority FROM site"


def _over_site() -> dict[str, tuple[str, str]]:
    """Queries over a page table: extra CTEs and the final SELECT."""
    return {
        "update_patterns": (UPDATES, "SELECT * FROM updates"),
        "content_type_distribution": ("", TYPES),
        "content_type_totals": ("", TYPE_TOTALS),
        "depth_distribution": ("", "SELECT section, depth_level, count(*) AS n FROM site GROUP BY ALL"),
        "depth_metrics": ("", DEPTHS),
        "org_distribution": ("", ORGS),
        "org_totals": ("", ORG_TOTALS),
        "top_content_types": ("", _top(TYPES, "content_type", 3)),
        "top_publishers": ("", _top(ORGS, "publishing_org", 5)),
        "primary_owner": ("", OWNER),
        "staleness_score": (TRENDS, f"SELECT section, {STALENESS} FROM trends"),
        "complexity_score": (TRENDS, f"SELECT section, {COMPLEXITY} FROM trends"),
        "section_trends": (TRENDS, "SELECT * FROM trends"),
        "section_report": (
            TRENDS,
            f"""SELECT t.section, s.title AS section_title, {_iso(NOW)} AS analysis_timestamp, oldest_update,
              newest_update, total_updates, average_age_days, error, {STALENESS}, max_depth, average_depth,
              {COMPLEXITY}, total_organisations, o.publishing_org AS primary_owner, o.n AS primary_owner_pages,
              total_types
            FROM trends t JOIN sections s ON s.path = t.section JOIN ({OWNER}) o ON o.section = t.section""",
        ),
    }


def _audit(micros: int, limit: int) -> str:
    return f"""SELECT CAST(user_id AS VARCHAR) AS client, event_id AS request_id, n_window,
      n_window > {limit} AS over_limit
    FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
      RANGE BETWEEN {micros - 1} PRECEDING AND CURRENT ROW) AS n_window FROM events)"""


OUTCOME = """CASE WHEN event_id % 20 = 3 THEN 'Request timed out' WHEN event_id % 20 = 4 THEN 'Request failed'
  WHEN event_id % 20 = 0 THEN 'not_found' WHEN event_id % 20 = 1 THEN 'Rate limit exceeded'
  WHEN event_id % 20 = 2 THEN 'HTTP 500'
  WHEN event_id % 20 = 5 OR NOT json_valid(props) THEN 'Invalid JSON response from API' ELSE 'ok' END"""

def _report(types: str) -> str:
    return f"""
SELECT CAST(unnest(range(1, 14)) AS INTEGER) AS line_no, unnest([
  'Content Mapping Report', repeat('=', 30), 'Generated: ' || {_iso(NOW)}, 'Duration: ' || scan_duration, '',
  'Summary', repeat('-', 7), 'Sections analyzed: ' || sections_analyzed, 'Total links found: ' || total_links_found,
  'Rate limit hits: ' || rate_limit_hits, '', 'Content Types', repeat('-', 12)]) AS line
FROM progress
UNION ALL SELECT 14, content_type || ': ' || count(*) FROM {types} GROUP BY content_type"""


QUEUE_SITE = """
site AS (
  SELECT CAST(user_id % 10 AS VARCHAR) AS section,
    CASE event_id % 4 WHEN 1 THEN '/services/' WHEN 2 THEN '/guidance/' ELSE '/doc/' END || event_id AS path,
    ['guide', 'detailed_guide', 'service', 'transaction', 'topic'][event_id % 5 + 1] AS content_type,
    CAST(event_id % 97 AS INTEGER) AS depth_level
  FROM events
)"""

# Links of the fetched items: suppliers of every eleventh key are gone, customers are leaves.
FETCHED = f"""
fetched(asked, path) AS (
  SELECT '/region/' || r_regionkey, '/region/' || r_regionkey FROM region
  UNION ALL SELECT '/nation/' || n_nationkey, '/nation/' || n_nationkey FROM nation
  UNION ALL SELECT '/supplier/' || s_suppkey, '/supplier/' || s_suppkey FROM supplier WHERE s_suppkey % 11 <> 0
  UNION ALL SELECT {CUSTOMER_LINK.format('c_custkey')}, '/customer/' || c_custkey FROM customer
),
answered(src, dst) AS (
  SELECT '/region/' || r_regionkey, '/nation/' || unnest(range(r_regionkey * 5, r_regionkey * 5 + 5)) FROM region
  UNION ALL SELECT '/nation/' || n_nationkey, '/supplier/' || unnest(range(n_nationkey, n_nationkey + 176, 25)) FROM nation
  UNION ALL SELECT '/supplier/' || s, {CUSTOMER_LINK.format('c')} FROM (
    SELECT s_suppkey AS s, unnest(range(s_suppkey * 10, s_suppkey * 10 + 10)) AS c FROM supplier)
  UNION ALL SELECT '/supplier/' || s_suppkey, '/region/0' FROM supplier WHERE s_suppkey % 7 = 0
),
edges(src, dst) AS (
  SELECT DISTINCT s.path, t.path FROM answered a JOIN fetched s ON s.path = a.src JOIN fetched t ON t.asked = a.dst
)"""

SITE_PROGRESS = f"""
progress AS (
  SELECT (SELECT count(DISTINCT section) FROM site) AS sections_analyzed,
    (SELECT count(*) FROM site) AS total_links_found,
    (SELECT count(*) FROM events WHERE event_id % 20 = 1) AS rate_limit_hits, {DURATION} AS scan_duration
  FROM (SELECT epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events)
)"""

METRICS = """
SELECT 'sections_analyzed' AS metric, '' AS item, sections_analyzed AS n FROM totals
UNION ALL SELECT 'total_links_found', '', total_links_found FROM totals
UNION ALL SELECT 'rate_limit_hits', '', rate_limit_hits FROM totals
UNION ALL SELECT 'content_type', content_type, count(*) FROM page_events GROUP BY content_type
UNION ALL SELECT 'depth', CAST(depth AS VARCHAR), count(*) FROM page_events GROUP BY depth"""


LANDED = f"""SELECT '/doc/' || event_id AS requested_path,
    CASE WHEN outcome = 'ok' THEN json_extract_string(props, '$.base_path') END AS base_path,
    CASE WHEN outcome = 'not_found' THEN outcome END AS error
  FROM (SELECT *, {OUTCOME} AS outcome FROM events) WHERE outcome IN ('ok', 'not_found')"""


def all_oracles() -> dict[str, str]:
    site = f"{_graph()}, {SITE}"
    event_site = f"WITH {EVENT_SITE}, {EVENT_SECTIONS}"
    progress = f"WITH {PAGE_EVENTS}, {PROGRESS}"
    oracles = {
        "page_records": f"{ITEMS} SELECT path, content_type, last_updated FROM heads",
        "page_status": f"{ITEMS} SELECT path, {STATUS} AS status FROM heads h",
        "publishing_orgs": f"{ITEMS} SELECT path, org FROM heads",
        "related_links": f"""{ITEMS} SELECT h.path, coalesce(c.n, 0) AS n_links FROM (
            SELECT path FROM heads UNION SELECT src FROM links) h
          LEFT JOIN (SELECT src, count(*) AS n FROM links GROUP BY src) c ON c.src = h.path""",
        "link_edges": f"{ITEMS} SELECT * FROM links",
        "followable_links": f"{ITEMS} SELECT DISTINCT dst FROM links WHERE {FOLLOW}",
        "resolved_links": f"{ITEMS}, {EDGES} SELECT * FROM edges",
        "build_urls": f"{ITEMS} SELECT path, '{URL_BASE}/' || ltrim(path, '/') AS url FROM heads",
        "section_of_path": "SELECT url, '/' || split_part(trim(url, '/'), '/', 1) AS section FROM pages",
        "section_catalogue": f"{CATALOGUE} SELECT * FROM sections",
        "select_sections": f"{CATALOGUE} SELECT * FROM sections WHERE title = 'AMERICA' OR path = '/region/3'",
        "section_priority": f"""{CATALOGUE} SELECT path,
          CASE WHEN title IN ('ASIA', 'EUROPE') THEN 1 ELSE 10 END AS priority FROM sections""",
        "section_sample": f"""{CATALOGUE} SELECT title, path,
          (SELECT count(*) FROM links WHERE src = path AND link_type = 'children') AS estimated_pages,
          'browse_page' AS content_type FROM sections""",
        "section_children": f"""{CATALOGUE} SELECT s.path AS section, s.title AS section_title,
            CAST(n_nationkey AS BIGINT) AS pos, n_name AS title, '/nation/' || n_nationkey AS path
          FROM sections s JOIN nation ON n_regionkey = s.ord""",
        "crawl_pages": f"{_graph()} {CRAWL}",
        "crawl_nearest": f"{_graph('depth, ord')} {CRAWL}",
        "priority_walk": f"""WITH RECURSIVE {HEADS}, {LINKS}, {SECTIONS}, {EDGES}, {PRIORITY_WALK}
          SELECT path, depth, priority, taken AS round, place FROM queue WHERE step = (SELECT max(step) FROM queue)""",
        "section_reach": f"""WITH RECURSIVE {HEADS}, {LINKS}, {SECTIONS}, {EDGES}, {WALK}
          SELECT s.path AS section, r.path, CAST(r.depth AS INTEGER) AS depth_level FROM reached r JOIN sections s ON r.ord = s.ord""",
        "crawl_resumed": f"{_graph()} {CRAWL}",
        "crawl_snapshots": f"""{_graph()}, firsts AS (SELECT path, min(depth) AS d FROM reached GROUP BY path)
          SELECT CAST(r.d AS INTEGER) AS depth, count(*) AS pages_processed, count(*) AS snapshots_due
          FROM range(0, {MAX_DEPTH + 1}) r(d) JOIN firsts f ON f.d <= r.d GROUP BY r.d""",
        "parsed_dates": f"""SELECT event_id, {_iso('m')} AS moment FROM (SELECT event_id, CASE event_id % 7
            WHEN 2 THEN date_trunc('second', ts) - INTERVAL 1 HOUR WHEN 3 THEN date_trunc('hour', ts)
            WHEN 4 THEN date_trunc('day', ts) WHEN 5 THEN date_trunc('second', ts) + INTERVAL 500 MILLISECOND
            WHEN 6 THEN NULL ELSE date_trunc('second', ts) END::TIMESTAMP AS m FROM events)""",
        "page_table": f"{site} SELECT * FROM site",
        "section_rollup": f"""{site} SELECT section, count(*) AS total_pages,
            count(*) FILTER (status = 'active') AS active_pages,
            count(*) FILTER (status <> 'active') AS placeholder_pages
          FROM site GROUP BY section""",
        "scan_metadata": f"""{site} SELECT {_iso(NOW)} AS scanned_at, {MAX_DEPTH} AS depth_limit, count(*) AS total_pages,
          count(DISTINCT section) AS sections_covered FROM site""",
        "exclude_types": f"""{site} SELECT section, path, content_type FROM site
          WHERE content_type IS NULL OR content_type NOT IN ('transaction', 'topic')""",
        "export_pages_flat": f"{site} SELECT * FROM site",
        "url_priority": f"{site} SELECT path, {PRIORITY} AS priority FROM site",
        "frontier_new": f"""{site} SELECT DISTINCT s.depth_level AS depth, e.dst AS path
          FROM edges e JOIN site s ON s.path = e.src LEFT JOIN site t ON t.path = e.dst
          WHERE t.depth_level IS NULL OR t.depth_level > s.depth_level""",
        "url_priority_events": f"WITH {QUEUE_SITE} SELECT path, {PRIORITY} AS priority FROM site",
        "next_batch_events": f"WITH {QUEUE_SITE} {QUEUE} ORDER BY priority, path, depth LIMIT 10",
        "frontier_batches_events": f"""WITH {QUEUE_SITE} SELECT *,
          (row_number() OVER (PARTITION BY section ORDER BY priority, path, depth) - 1) // 10 AS batch FROM ({QUEUE})""",
        "page_links": f"""{site} SELECT s.section, s.path, l.link_type, l.pos, l.dst
          FROM site s JOIN links l ON l.src = s.path WHERE s.depth_level < {MAX_DEPTH}""",
        "scan_progress_site": f"""{site}, {SITE_PROGRESS}
          SELECT unnest(['sections_analyzed', 'total_links_found', 'rate_limit_hits']) AS metric, '' AS item,
            unnest([sections_analyzed, total_links_found, rate_limit_hits]) AS n FROM progress
          UNION ALL SELECT 'content_type', content_type, count(*) FROM site GROUP BY content_type
          UNION ALL SELECT 'depth', CAST(depth_level AS VARCHAR), count(*) FROM site GROUP BY depth_level""",
        "export_json": f"{site} SELECT * FROM site",
        "export_csv": f"{site} SELECT * FROM site",
        "crawl_from_fetches": f"WITH RECURSIVE {FETCHED}, {SECTIONS}, {WALK}, {_owned('ord')} {CRAWL}",
        "next_batch": f"{site} {QUEUE} ORDER BY priority, path, depth LIMIT 10",
        "frontier_batches": f"""{site} SELECT *,
          (row_number() OVER (PARTITION BY section ORDER BY priority, path, depth) - 1) // 10 AS batch FROM ({QUEUE})""",
        "classify_fetches": f"SELECT {OUTCOME} AS outcome, count(*) AS n FROM events GROUP BY ALL",
        "landed_items": LANDED,
        "landed_stream": LANDED,
        "rate_audit": _audit(1_000_000, 10),
        "rate_audit_hourly": _audit(3_600_000_000, 2),
        "scan_progress": f"""{progress} SELECT sections_analyzed, total_links_found, rate_limit_hits, current_section,
          scan_duration FROM progress""",
        "progress_by_type": f"{progress} SELECT content_type, count(*) AS n FROM page_events GROUP BY content_type",
        "progress_by_depth": f"""{progress} SELECT CAST(depth AS INTEGER) AS depth, count(*) AS n
          FROM page_events GROUP BY depth""",
        "scan_duration": f"""SELECT section, {DURATION} AS scan_duration FROM (
          SELECT CAST(user_id AS VARCHAR) AS section, epoch_us(max(ts)) - epoch_us(min(ts)) AS us
          FROM events GROUP BY user_id)""",
        "report_lines": f"{progress} {_report('page_events')}",
        "site_report_lines": f"{site}, {SITE_PROGRESS} {_report('site')}",
        "progress_stream": f"""{progress} {METRICS}
          UNION ALL SELECT 'sections_covered', '', count(DISTINCT section) FROM page_events""",
        "heartbeat_events": f"""WITH RECURSIVE moments AS (SELECT ts, min(event_id) AS event_id FROM events WHERE ts IS NOT NULL GROUP BY ts),
          pointers AS (SELECT ts, event_id, min(ts) OVER (ORDER BY ts RANGE BETWEEN INTERVAL '60.000001 seconds' FOLLOWING
            AND UNBOUNDED FOLLOWING) AS next FROM moments),
          beats(beat, ts, event_id, next) AS (
            SELECT CAST(0 AS BIGINT), ts, event_id, next FROM pointers WHERE ts = (SELECT min(ts) FROM moments)
            UNION ALL SELECT b.beat + 1, p.ts, p.event_id, p.next FROM beats b JOIN pointers p ON p.ts = b.next)
          SELECT beat, event_id, {DURATION} AS elapsed FROM (
            SELECT *, epoch_us(ts) - epoch_us((SELECT min(ts) FROM moments)) AS us FROM beats WHERE beat > 0)""",
        "published_tables": f"""{site} SELECT 'metadata' AS name, CAST(1 AS BIGINT) AS n
          UNION ALL SELECT 'sections', count(DISTINCT section) FROM site
          UNION ALL SELECT 'section_depths', count(DISTINCT (section, depth_level)) FROM site
          UNION ALL SELECT 'progress', 3 + count(DISTINCT content_type) + count(DISTINCT depth_level) FROM site
          UNION ALL SELECT 'pages', count(*) FROM site
          UNION ALL SELECT 'page_links', CAST(sum(related_links_count) AS BIGINT) FROM site""",
    }
    for name, (ctes, final) in _over_site().items():
        extra = f", {ctes}" if ctes else ""
        oracles[name] = f"{site}{extra} {final}"
        oracles[f"{name}_events"] = f"{event_site}{extra} {final}"
    oracles["section_report_from_cells"] = oracles["section_report"]
    oracles["section_trends_from_cells_events"] = oracles["section_trends_events"]
    return oracles
