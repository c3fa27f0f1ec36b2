"""Common table expressions the expected-result SQL is built from.

``sql(body)`` puts the expressions a statement refers to, directly or through others, in front of
it, so every statement is complete on its own.
"""

import re

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f')"


def eid(method: str, host: str, pattern: str) -> str:
    return f"substr(sha256({method} || ':' || coalesce({host}, '') || ':' || {pattern}), 1, 12)"


def pattern(path: str) -> str:
    step = f"rtrim({path}, '/')"
    for rule, name in (
        (r"/\p{Nd}+", "/{id}"),
        (r"(?i)/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "/{uuid}"),
        (r"(?i)/[0-9a-f]{24}", "/{objectId}"),
        (r"/[A-Za-z0-9_-]{20,}", "/{token}"),
    ):
        step = f"regexp_replace({step}, '{rule}', '{name}', 'g')"
    return f"CASE WHEN {step} = '' THEN '/' ELSE {step} END"


def inventory(source: str) -> str:
    """Unclassified endpoints of a traffic relation."""
    return f"""SELECT {eid('method', 'host', 'path_pattern')} AS endpoint_id, method, path_pattern, host,
        list_sort(list(DISTINCT auth_method)) AS auth, list_sort(list(DISTINCT discovery_source)) AS sources,
        count(DISTINCT coalesce(auth_subject, source_ip, source_service)) AS consumer_count,
        min("timestamp") AS first_seen, max("timestamp") AS last_seen, count(*) AS total_calls,
        count(*) FILTER (status_code >= 400) AS error_count, avg(response_time_ms) AS avg_ms
        FROM {source} GROUP BY method, host, path_pattern"""


def classified(source: str) -> str:
    return f"""SELECT *, CASE WHEN st = 'deprecated' THEN 'deprecated'
        WHEN declared AND total_calls > 0 AND coalesce(last_seen > {AS_OF} - INTERVAL 30 DAY, false) THEN 'active'
        WHEN declared AND NOT coalesce(last_seen > {AS_OF} - INTERVAL 30 DAY, false) THEN 'zombie'
        WHEN total_calls > 0 AND NOT declared THEN 'shadow' ELSE 'undocumented' END AS status
        FROM ({source})"""


def alerts(source: str) -> str:
    rate = "(error_count / total_calls)"
    head = "method || ' ' || path_pattern ||"
    return f"""
        SELECT endpoint_id, 'shadow_api' AS alert_type, 'high' AS severity,
            '🔴 SHADOW API: ' || {head} ' (' || total_calls || ' calls, not in any spec)' AS message
            FROM {source} WHERE status = 'shadow'
        UNION ALL SELECT endpoint_id, 'unauthenticated', 'high',
            '⚠️  UNAUTHENTICATED: ' || {head} ' receives unauthenticated traffic'
            FROM {source} WHERE list_contains(auth, 'none') AND total_calls > 0
        UNION ALL SELECT endpoint_id, 'high_error_rate', 'medium',
            '🟡 HIGH ERROR RATE: ' || {head} ' (' || printf('%.0f', {rate} * 100) || '% errors over ' || total_calls || ' calls)'
            FROM {source} WHERE total_calls > 10 AND {rate} > 0.5
        UNION ALL SELECT endpoint_id, 'new_endpoint', 'info',
            '🆕 NEW ENDPOINT: ' || {head} ' (first seen ' || strftime(first_seen, '%Y-%m-%dT%H:%M:%S.%f') || ')'
            FROM {source} WHERE first_seen > {AS_OF} - INTERVAL 24 HOUR
        UNION ALL SELECT endpoint_id, 'zombie_api', 'low',
            '💀 ZOMBIE API: ' || {head} ' (in spec but no traffic since ' ||
                coalesce(strftime(last_seen, '%Y-%m-%d %H:%M:%S.%f'), 'None') || ')'
            FROM {source} WHERE status = 'zombie'"""


WINDOW = 200  # training window used by the anomaly queries
BOLA = 20

CTES = {
    "ev": "SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events",
    "rt": """SELECT event_id AS record_id, ts AS "timestamp", k, user_id,
        CASE WHEN event_type IN ('click', 'view') THEN 'GET' WHEN event_type = 'purchase' THEN 'POST'
             WHEN event_type = 'signup' THEN 'PUT' ELSE 'DELETE' END AS method,
        CASE WHEN event_id % 13 = 0 THEN '/internal/metrics'
             WHEN event_id % 17 = 0 THEN '/api/v1/users/' || user_id || '/orders/'
             ELSE '/api/v1/' || event_type || 's/' || k END AS path,
        CAST(CASE WHEN event_type = 'error' THEN CASE WHEN k % 10 = 0 THEN 500 WHEN k % 2 = 1 THEN 401 ELSE 403 END
             WHEN k % 25 = 0 THEN 404 ELSE 200 END AS INTEGER) AS status_code,
        CASE WHEN event_type = 'error' AND k >= 50 THEN '203.0.113.7' WHEN user_id % 3 = 0 THEN NULL
             ELSE '10.0.0.' || (user_id % 8) END AS source_ip,
        CASE WHEN user_id % 3 = 0 THEN 'svc-' || (user_id % 4) END AS source_service,
        CASE k % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'bearer' WHEN 2 THEN 'api_key' WHEN 3 THEN 'basic' ELSE 'unknown' END AS auth_method,
        CASE WHEN k % 6 = 0 THEN 'sub-' || (user_id % 6) END AS auth_subject,
        CASE WHEN event_id % 11 <> 0 THEN value END AS response_time_ms,
        CASE user_id % 6 WHEN 0 THEN 'api.stripe.com' WHEN 1 THEN 'FCM.googleapis.com' WHEN 2 THEN '10.1.2.3'
             WHEN 3 THEN 'svc-2' WHEN 4 THEN 'mystery.example.org' END AS host,
        'log_generic' AS discovery_source FROM ev""",
    "traffic": f"SELECT *, {pattern('path')} AS path_pattern FROM rt",
    # log lines: what a perfect parse yields
    "ln": """SELECT *, coalesce(source_ip, '198.51.100.' || (user_id % 5)) AS ip, date_trunc('second', "timestamp") AS sec,
        CAST(k || '.' || lpad(CAST(record_id % 1000 AS VARCHAR), 3, '0') AS DOUBLE) AS secs
        FROM rt WHERE record_id % 19 <> 0""",
    "nginx": """SELECT method, path, status_code, ip AS source_ip, sec, NULL AS host, 'log_nginx' AS discovery_source,
        CASE k % 5 WHEN 1 THEN 'bearer' WHEN 2 THEN 'api_key' WHEN 3 THEN 'basic' WHEN 4 THEN 'none' ELSE 'unknown' END AS auth_method,
        CASE WHEN record_id % 11 <> 0 THEN secs * 1000 END AS response_time_ms, NULL AS auth_subject
        FROM ln WHERE record_id % 23 <> 0""",
    "alb": """SELECT method, path, CAST(CASE WHEN record_id % 7 = 0 THEN status_code ELSE 201 END AS INTEGER) AS status_code,
        ip AS source_ip, sec, 'shop.example.com' AS host, 'log_alb' AS discovery_source, 'unknown' AS auth_method,
        CASE WHEN record_id % 7 = 0 THEN -1000.0 ELSE secs * 1000 END AS response_time_ms, NULL AS auth_subject FROM ln""",
    "gateway": """SELECT method, CASE WHEN k % 2 = 0 THEN '/shop/{item}' ELSE path END AS path, status_code, ip AS source_ip, sec,
        'gw.example.com' AS host, 'log_api_gateway' AS discovery_source,
        CASE k % 5 WHEN 1 THEN 'bearer' WHEN 2 THEN 'api_key' WHEN 3 THEN 'unknown' ELSE 'none' END AS auth_method,
        CASE WHEN record_id % 11 <> 0 THEN secs END AS response_time_ms, auth_subject FROM ln""",
    "gjson": """SELECT method, path, CASE WHEN record_id % 3 = 2 THEN 0 ELSE status_code END AS status_code, ip AS source_ip, sec,
        host, 'log_generic' AS discovery_source,
        CASE k % 5 WHEN 1 THEN 'bearer' WHEN 2 THEN 'api_key' WHEN 3 THEN 'basic' ELSE 'none' END AS auth_method,
        secs AS response_time_ms, NULL AS auth_subject FROM ln""",
    "gtext": """SELECT method, path, status_code, NULL AS source_ip, sec, NULL AS host, 'log_generic' AS discovery_source,
        'unknown' AS auth_method, CASE k % 3 WHEN 1 THEN secs WHEN 2 THEN secs * 1000 END AS response_time_ms,
        NULL AS auth_subject FROM ln""",
    # inventory
    "inv": inventory("traffic"),
    "half1": inventory("(SELECT * FROM traffic WHERE \"timestamp\" < TIMESTAMP '2024-01-16 00:00:00')"),
    "half2": inventory("(SELECT * FROM traffic WHERE \"timestamp\" >= TIMESTAMP '2024-01-10 00:00:00')"),
    "cons": f"""SELECT {eid('method', 'host', 'path_pattern')} AS endpoint_id, coalesce(auth_subject, source_ip, source_service) AS consumer,
        count(*) AS calls, count(*) FILTER (status_code >= 400) AS errors, min("timestamp") AS first_seen
        FROM traffic GROUP BY method, host, path_pattern, consumer HAVING consumer IS NOT NULL""",
    "used": """SELECT DISTINCT host, method, path_pattern AS path, path_pattern = '/api/v1/clicks/{id}' AS deprecated
        FROM traffic WHERE method IN ('GET', 'POST') AND NOT starts_with(path, '/internal/')""",
    "spec": """SELECT * FROM used UNION ALL SELECT DISTINCT host, 'PATCH', '/api/v9/planned', false FROM used
        UNION ALL SELECT DISTINCT host, 'GET', '/api/v9/retired', true FROM used""",
    "routes": "SELECT method, path, max(deprecated) AS deprecated FROM spec GROUP BY method, path",
    "plainep": classified("SELECT *, 'undocumented' AS st, false AS declared FROM inv"),
    "corr": f"""SELECT coalesce(i.endpoint_id, s.id) AS endpoint_id, coalesce(i.method, s.method) AS method,
        coalesce(i.path_pattern, s.path) AS path_pattern, coalesce(i.host, s.host) AS host,
        coalesce(i.auth, []) AS auth, CASE WHEN s.id IS NULL THEN i.sources
            ELSE list_sort(list_concat(coalesce(i.sources, []), ['scan_openapi'])) END AS sources,
        coalesce(i.consumer_count, 0) AS consumer_count, i.first_seen, i.last_seen,
        coalesce(i.total_calls, 0) AS total_calls, coalesce(i.error_count, 0) AS error_count, i.avg_ms,
        CASE WHEN s.deprecated THEN 'deprecated' ELSE 'undocumented' END AS st, s.id IS NOT NULL AS declared
        FROM inv i FULL JOIN (SELECT *, {eid('method', 'host', 'path')} AS id FROM spec) s ON i.endpoint_id = s.id""",
    "ep": classified("SELECT * FROM corr"),
    "alerts": alerts("ep"),
    "acks": f"""SELECT DISTINCT {eid('method', 'host', 'path_pattern')} AS endpoint_id, 'shadow_api' AS alert_type
        FROM traffic WHERE method = 'PUT'""",
    "flagged": """SELECT a.*, k.endpoint_id IS NOT NULL AS acknowledged FROM alerts a LEFT JOIN acks k
        ON a.endpoint_id = k.endpoint_id AND a.alert_type = k.alert_type""",
    # anomalies
    "obs": """SELECT record_id, "timestamp" AS tm, method, path_pattern, method || ' ' || path_pattern AS endpoint,
        coalesce(source_ip, source_service, 'unknown') AS source, status_code, response_time_ms AS latency,
        string_split(rtrim(path, '/'), '/')[list_position(list_transform(string_split(path_pattern, '/'),
            lambda x: starts_with(x, '{') AND ends_with(x, '}')), true)] AS rid FROM traffic""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY tm, record_id) AS n FROM obs",
    "prof": f"""SELECT endpoint, count(*) AS sample_count, coalesce(avg(latency), 0) AS mean,
        coalesce(stddev_pop(latency), 0) AS dev, count(*) >= {WINDOW} AS trained FROM ranked WHERE n <= {WINDOW} GROUP BY endpoint""",
    "scored": f"""SELECT r.*, p.mean, p.dev, CASE WHEN dev > 0 THEN abs(latency - mean) / dev END AS z
        FROM ranked r JOIN prof p USING (endpoint) WHERE p.trained AND n > {WINDOW}""",
    "outliers": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY endpoint, source ORDER BY n) AS f
        FROM scored WHERE z > 3 AND latency > mean) WHERE f = 1""",
    "idrun": """SELECT *, sum(fresh) OVER (PARTITION BY endpoint, source ORDER BY n) AS ids FROM (SELECT *, CASE WHEN
        row_number() OVER (PARTITION BY endpoint, source, rid ORDER BY n) = 1 THEN 1 ELSE 0 END AS fresh
        FROM ranked WHERE rid IS NOT NULL)""",
    "firstids": """SELECT endpoint, source, string_agg(rid, ',' ORDER BY n) AS sample FROM (SELECT *, row_number()
        OVER (PARTITION BY endpoint, source ORDER BY n) AS f FROM idrun WHERE fresh = 1) WHERE f <= 5 GROUP BY endpoint, source""",
    "bola": f"""SELECT * FROM (SELECT i.*, row_number() OVER (PARTITION BY i.endpoint, source ORDER BY n) AS f
        FROM idrun i JOIN prof p USING (endpoint) WHERE p.trained AND n > {WINDOW} AND ids > {BOLA}) WHERE f = 1""",
    "newcons": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY endpoint, source ORDER BY n) AS f FROM ranked)
        r JOIN prof p USING (endpoint) WHERE f = 1 AND p.trained AND n > """ + str(WINDOW),
    "early": """SELECT f.* FROM (SELECT *, row_number() OVER (PARTITION BY endpoint, source ORDER BY n) AS f,
        count(*) OVER (PARTITION BY endpoint) AS total FROM ranked) f WHERE f = 1 AND total >= 5 AND n > 5""",  # window of 5
    "bysource": """SELECT source, count(*) AS n, count(*) FILTER (status_code IN (401, 403)) AS failed, min(tm) AS lo, max(tm) AS hi,
        epoch_us(max(tm)) - epoch_us(min(tm)) AS us FROM obs GROUP BY source""",
    "gaps": """SELECT endpoint, source, num, num - lag(num) OVER (PARTITION BY endpoint, source ORDER BY num) AS gap
        FROM (SELECT DISTINCT endpoint, source, rid, CAST(rid AS BIGINT) AS num FROM obs WHERE regexp_full_match(rid, '[0-9]+'))""",
    "enums": """SELECT endpoint, source, count(*) AS total, count(*) FILTER (gap = 1) AS seq, min(num) AS lo, max(num) AS hi
        FROM gaps GROUP BY endpoint, source HAVING count(*) >= 10 AND count(*) FILTER (gap = 1) > (count(*) - 1) * 0.7""",
    # egress
    "providers": """SELECT * FROM (VALUES (0, 'Stripe', 'api.stripe.com'), (1, 'Twilio', 'api.twilio.com'), (2, 'SendGrid', 'api.sendgrid.com'),
        (3, 'OpenAI', 'api.openai.com'), (4, 'Anthropic', 'api.anthropic.com'), (5, 'AWS S3', 's3.amazonaws.com'),
        (5, 'AWS S3', 's3.us-east-1.amazonaws.com'), (6, 'AWS SES', 'email.us-east-1.amazonaws.com'), (7, 'Google APIs', 'googleapis.com'),
        (7, 'Google APIs', 'oauth2.googleapis.com'), (8, 'GitHub', 'api.github.com'), (9, 'Slack', 'slack.com'), (9, 'Slack', 'hooks.slack.com'),
        (10, 'Datadog', 'api.datadoghq.com'), (11, 'PagerDuty', 'api.pagerduty.com'), (12, 'Sentry', 'sentry.io'),
        (13, 'LaunchDarkly', 'app.launchdarkly.com'), (14, 'Auth0', 'auth0.com'), (15, 'Okta', 'okta.com'), (16, 'Firebase', 'firebaseio.com'),
        (16, 'Firebase', 'fcm.googleapis.com'), (17, 'Cloudflare', 'api.cloudflare.com')) p(priority, provider, domain)""",
    "outbound": """SELECT *, coalesce(source_service, source_ip, 'unknown') AS caller FROM traffic WHERE host IS NOT NULL
        AND NOT regexp_matches(lower(host), '^(10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|192\\.168\\.|127\\.|localhost)')""",
    "named": """SELECT host, coalesce(arg_min(provider, priority), 'Unknown') AS provider_name FROM (SELECT DISTINCT host FROM outbound) h
        LEFT JOIN providers p ON lower(host) = domain OR ends_with(lower(host), '.' || domain) GROUP BY host""",
    "parties": """SELECT o.host, any_value(provider_name) AS provider_name, count(*) AS total_calls,
        count(*) FILTER (status_code >= 400) AS error_count, min("timestamp") AS first_seen, max("timestamp") AS last_seen,
        avg(response_time_ms) AS avg_ms, list_sort(list(DISTINCT method)) AS methods, count(DISTINCT caller) AS callers
        FROM outbound o JOIN named n ON o.host = n.host GROUP BY o.host""",
    "docs": """SELECT doc_id, text, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id % 40000) AS tm, '/docs/' || doc_id AS path,
        CASE WHEN doc_id % 9 = 0 THEN 503 ELSE 200 END AS status_code, n_chars,
        coalesce(CASE WHEN doc_id % 3 = 0 THEN 'svc-' || (doc_id % 2) END, CASE WHEN doc_id % 4 = 0 THEN '10.2.0.' || (doc_id % 5) END, 'unknown') AS caller,
        CASE doc_id % 6 WHEN 0 THEN 'api.stripe.com' WHEN 1 THEN 'hooks.slack.com' WHEN 2 THEN '192.168.4.5'
            WHEN 3 THEN 'eu.mystery.example.org' WHEN 4 THEN 'api.openai.com' ELSE 'Files.corp.example' END AS host FROM documents""",
    "secrets": r"""SELECT * FROM (
        SELECT d.*, 'Stripe API Key' AS secret_type, unnest(regexp_extract_all(text, '(?:sk|pk)[-_](?:live|test)[-_][A-Za-z0-9]{20,}')) AS m FROM docs d
        UNION ALL SELECT d.*, 'JWT Token', unnest(regexp_extract_all(text, 'Bearer\s+eyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}')) FROM docs d
        UNION ALL SELECT d.*, 'Generic Secret', unnest(regexp_extract_all(text, '(?i)(?:api[_-]?key|apikey|token|secret|password|passwd|pwd)\s*[=:]\s*["'']?[A-Za-z0-9_\-]{16,}')) FROM docs d
        UNION ALL SELECT d.*, 'AWS Access Key', unnest(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}')) FROM docs d
        UNION ALL SELECT d.*, 'GitHub Personal Token', unnest(regexp_extract_all(text, 'ghp_[A-Za-z0-9]{36}')) FROM docs d
        UNION ALL SELECT d.*, 'Slack Bot Token', unnest(regexp_extract_all(text, 'xoxb-[0-9]+-[A-Za-z0-9]+')) FROM docs d
        UNION ALL SELECT d.*, 'OpenAI API Key', unnest(regexp_extract_all(text, 'sk-[A-Za-z0-9]{20,}')) FROM docs d
        UNION ALL SELECT d.*, 'Email Address (PII)', unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b')) FROM docs d
        UNION ALL SELECT d.*, 'SSN Pattern (PII)', unnest(regexp_extract_all(text, '\b\d{3}-\d{2}-\d{4}\b')) FROM docs d)""",
    "leaks": """SELECT *, CASE WHEN length(m) > 16 THEN substr(m, 1, 8) || '...' || right(m, 4) ELSE substr(m, 1, 4) || '****' END AS redacted
        FROM secrets WHERE host <> '192.168.4.5'""",
    "docparties": """SELECT host, count(*) AS calls, count(*) FILTER (status_code >= 400) AS errors FROM docs WHERE host <> '192.168.4.5' GROUP BY host""",
    "docrisk": """SELECT p.*, coalesce(l.leaks, 0) AS leaks, CASE host WHEN 'api.stripe.com' THEN 'Stripe' WHEN 'hooks.slack.com' THEN 'Slack'
        WHEN 'api.openai.com' THEN 'OpenAI' ELSE 'Unknown' END AS provider_name,
        CASE WHEN l.leaks > 0 THEN 'critical' WHEN host IN ('api.stripe.com', 'hooks.slack.com', 'api.openai.com') THEN 'low' ELSE 'medium' END AS risk
        FROM docparties p LEFT JOIN (SELECT host AS h, count(*) AS leaks FROM leaks GROUP BY host) l ON p.host = l.h""",
    # graph
    "calls": """SELECT CASE WHEN starts_with(consumer, '10.') OR starts_with(consumer, '172.') OR starts_with(consumer, '192.168.')
        THEN 'internal-' || consumer ELSE consumer END AS source, coalesce(host, 'unknown-service') AS target, i.method, i.path_pattern,
        i.total_calls, i.error_count, c.calls AS own_calls, c.errors AS own_errors FROM cons c JOIN inv i USING (endpoint_id)""",
    "edges": """SELECT source, target, sum(total_calls)::BIGINT AS call_count, sum(error_count)::BIGINT AS error_count,
        list_sort(list(DISTINCT method)) AS methods FROM calls GROUP BY source, target""",
    "nodes": """SELECT name, min(host) AS host, sum(n)::BIGINT AS endpoint_count, sum(calls)::BIGINT AS total_calls,
        CASE WHEN sum(served) > 0 THEN sum(errors) / sum(served) ELSE 0 END AS error_rate FROM (
        SELECT coalesce(host, 'unknown-service') AS name, host, 1 AS n, total_calls AS calls, total_calls AS served, error_count AS errors FROM inv
        UNION ALL SELECT source, NULL, 0, total_calls, 0, 0 FROM calls) GROUP BY name""",
    "partynames": "SELECT *, CASE WHEN provider_name = 'Unknown' THEN host ELSE provider_name END AS name FROM parties",
    "partycallers": """SELECT DISTINCT host, CASE WHEN starts_with(caller, '10.') OR starts_with(caller, '172.') OR starts_with(caller, '192.168.')
        THEN 'internal-' || caller ELSE caller END AS source FROM outbound""",
    "enodes": """SELECT name, 'third_party' AS node_type, host, total_calls, error_count / total_calls AS error_rate,
        CASE WHEN provider_name = 'Unknown' THEN 'medium' ELSE 'low' END AS risk FROM (SELECT *, row_number() OVER
        (PARTITION BY name ORDER BY total_calls, host) AS f FROM partynames) WHERE f = 1
        UNION ALL SELECT DISTINCT source, 'service', NULL, 0, 0, NULL FROM partycallers WHERE source NOT IN (SELECT name FROM partynames)""",
    "eedges": """SELECT source, name AS target, total_calls AS call_count, error_count, methods FROM (SELECT c.source, p.*, row_number() OVER
        (PARTITION BY source, name ORDER BY total_calls, p.host) AS f FROM partycallers c JOIN partynames p ON c.host = p.host) WHERE f = 1""",
    # accounts
    "audit": """SELECT event_id AS audit_id, ts AS tm, user_id, 'user-' || user_id AS username, '{"k":' || k || '}' AS details,
        CASE event_type WHEN 'signup' THEN 'login_success' WHEN 'error' THEN 'login_failure' ELSE event_type || '_item' END AS action FROM ev""",
}


def sql(body: str) -> str:
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+\(?{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    recursive = "RECURSIVE " if "/*recursive*/" in body else ""
    own = re.search(r"/\*with\*/(.*)/\*end\*/", body, re.S)
    heads = [f"{name} AS ({CTES[name]})" for name in CTES if name in needed]
    if own:
        heads.append(own.group(1).strip())
        body = body[own.end() :]
    return f"WITH {recursive}{', '.join(heads)} {body}" if heads else body
