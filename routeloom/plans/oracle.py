"""DuckDB SQL for the named queries."""

from __future__ import annotations

import re

from routeloom.functions import types as T
from routeloom.functions.patterns import PHYSICAL_TYPES, STATIC_PATTERN, VARIABLE_REGEX, VARIABLE_SUFFIX, re2
from routeloom.functions.requests import URL_PARTS
from routeloom.operators.documents import LOGICAL_SCHEMA, PHYSICAL_SCHEMA
from routeloom.sources.requests import REQUEST_SQL

_DAY = r"(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\d{3}"
_IDENTITY = rf"^[1-9]\d{{5}}((19|20)\d{{2}}{_DAY}[\dXx]|\d{{2}}{_DAY})$"
#: The patterns again, written for DuckDB's expressions, so that the queries are held against something that isn't theirs.
SIBLING_PATTERNS = {
    "uuid": r"^[[:xdigit:]]{8}(-[[:xdigit:]]{4}){3}-[[:xdigit:]]{12}$", "email": r"^[\w.%+-]+@[[:alnum:].-]+\.[[:alpha:]]{2,}$", "ip": r"^\d{1,3}(\.\d{1,3}){3}$", "date": r"^\d{4}(-\d{2}){2}", "phone": r"^((\+86|86)?1[3-9]\d{9})$",
    "idcard": _IDENTITY, "bankcard": r"^[3456]\d{15}\d{0,3}$", "plate": r"^\p{Han}[A-Z][A-Z\d]{5}[A-Z\d]?$", "version": r"^v\d+$", "alphanumeric": r"^[[:alpha:]]+\d+$", "float": r"^\d+\.\d+$", "integer": r"^\d+$",
}
LOGICAL_PATTERNS = {
    "uuid": SIBLING_PATTERNS["uuid"], "ipaddress": SIBLING_PATTERNS["ip"], "phone": r"^(\+86|86|0086)?1[3-9]\d{9}$|^0\d{2,3}[1-9]\d{6}\d?$", "idcard": _IDENTITY, "bankcard": SIBLING_PATTERNS["bankcard"], "plate": SIBLING_PATTERNS["plate"],
    "email": SIBLING_PATTERNS["email"], "datetime": r"^\d{4}(-\d{2}){2}[T ]\d{2}(:\d{2}){2}", "date": r"^\d{4}(-\d{2}){2}$", "time": r"^\d{2}(:\d{2}){2}", "url": r"^https?://", "json": r"^\s*(\{.*\}|\[.*\])\s*$", "xml": r"^\s*<",
}

q = lambda s: "'" + re2(s).replace("'", "''") + "'"


def like(v: str, pattern: str) -> str:
    return f"regexp_matches({v}, {q(pattern)})"


def ctes(*names: str) -> str:
    return ", ".join(f"{n} AS ({REQUEST_SQL[n]})" for n in names)


def path(url: str) -> str:
    return f"regexp_extract({url}, {q(URL_PARTS)}, 1)"


def query(url: str) -> str:
    return f"regexp_extract({url}, {q(URL_PARTS)}, 2)"


def segments(url: str) -> str:
    return f"list_filter([url_decode(x) for x in string_split({path(url)}, '/') if x <> ''], lambda x: x NOT IN ('', '.', '..'))"


def decode(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def pairs(text: str) -> str:
    """List of structs name, value."""
    return f"[{{'name': lower({decode("split_part(p, '=', 1)")}), 'value': CASE WHEN contains(p, '=') THEN {decode("substr(p, strpos(p, '=') + 1)")} ELSE '' END}} for p in string_split({text}, '&') if p <> '']"


PHYSICAL = f"""CASE WHEN v IN ('', 'null', 'NULL') THEN 'null' WHEN v IN ('true', 'false', 'TRUE', 'FALSE') THEN 'boolean' WHEN strlen(v) < 16 AND {like('v', T.INTEGER)} THEN 'integer'
 WHEN {like('v', T.HEX)} THEN 'integer' WHEN {like('v', T.SCIENTIFIC)} OR {like('v', T.PLAIN_FLOAT)} THEN 'float'
 WHEN length(v) >= 2 AND v[1] = '[' AND v[-1] = ']' THEN 'array' WHEN length(v) >= 2 AND v[1] = '{{' AND v[-1] = '}}' THEN 'object' ELSE 'string' END"""


def is_logical(name: str) -> str:
    return like("regexp_replace(v, '[^0-9+]', '', 'g')" if name == "phone" else "v", LOGICAL_PATTERNS[name])


LOGICAL = "CASE " + " ".join(f"WHEN {is_logical(n)} THEN '{n}'" for n in LOGICAL_PATTERNS) + " END"
FORMAT = f"CASE WHEN v LIKE '%\\%' ESCAPE '\\' THEN 'percentage' WHEN {like('v', T.CURRENCY)} THEN 'currency' WHEN {like('v', T.DECIMAL)} THEN 'decimal' END"

OBSERVED = f"""{ctes('req_parts', 'req_orders', 'req_formats')},
params AS (SELECT unnest(list_concat({pairs(query('url'))}, {pairs("coalesce(body, '')")})) AS p FROM (SELECT url, body FROM req_parts UNION ALL SELECT url, body FROM req_orders)),
observed AS (SELECT p.name AS owner, p.value AS v FROM params WHERE p.value <> '' UNION ALL SELECT s[2], s[3] FROM (SELECT {segments('url')} AS s FROM req_formats)),
hist AS (SELECT owner, v, count(*) AS cnt FROM observed GROUP BY ALL)"""
SHARES = ", ".join(
    [f"sum(CASE WHEN p = '{n}' THEN cnt ELSE 0 END) AS p_{n}" for n in PHYSICAL_TYPES]
    + [f"sum(CASE WHEN l = '{n}' THEN cnt ELSE 0 END) AS l_{n}" for n in LOGICAL_PATTERNS]
    + [f"sum(CASE WHEN f = '{n}' THEN cnt ELSE 0 END) AS f_{n}" for n in ("percentage", "currency", "decimal")]
    + [f"count(*) FILTER (WHERE {is_logical(n)}) AS is_{n}" for n in LOGICAL_PATTERNS]
)
BEST = "greatest(" + ", ".join(f"p_{n}" for n in PHYSICAL_TYPES) + ")"
VOTES = f"""{OBSERVED},
marked AS (SELECT owner, v, cnt, {PHYSICAL} AS p, {LOGICAL} AS l, {FORMAT} AS f FROM hist),
sums AS (SELECT owner, count(*) AS n_values, CAST(sum(cnt) AS BIGINT) AS total, max(strlen(v)) AS longest, {SHARES} FROM marked GROUP BY owner),
typed AS (SELECT owner, n_values, total, CASE {' '.join(f"WHEN p_{n} = {BEST} THEN '{n}'" for n in PHYSICAL_TYPES)} END AS physical_type,
 CASE {' '.join(f"WHEN l_{n} >= 0.6 * total THEN '{n}'" for n in LOGICAL_PATTERNS)} {' '.join(f"WHEN f_{n} >= 0.6 * total THEN '{n}'" for n in ('percentage', 'currency', 'decimal'))}
 WHEN n_values >= 2 AND total >= 3 AND n_values <= 0.3 * total AND longest <= 50 AND greatest({', '.join(f'is_{n}' for n in LOGICAL_PATTERNS)}) <= 0.5 * n_values THEN 'enum' ELSE 'string' END AS lt FROM sums),
votes AS (SELECT owner, n_values, total, physical_type, CASE WHEN lt = physical_type AND lt <> 'string' THEN 'string' ELSE lt END AS logical_type FROM typed)"""

CODE = "({0} <> '' AND (" + like("{0}", r"^[+-]?[0-9]*\z") + " OR (" + like("{0}", r"^[A-Za-z0-9][A-Za-z0-9]*\z") + " AND regexp_matches({0}, '[A-Za-z]') AND regexp_matches({0}, '[0-9]'))))"
LCP = "substr({0}, 1, len(list_filter(range(1, least(length({0}), length({1})) + 1), lambda i: substr({0}, 1, i) = substr({1}, 1, i))))"
MOST = "greatest(" + ", ".join(f"m_{k}" for k in SIBLING_PATTERNS) + ")"


def detect_ctes(siblings: str) -> str:
    """detected (parent, n, pattern, hits, prefix, suffix) from a table of distinct (parent, segment)."""
    counts = ", ".join(f"count(*) FILTER (WHERE {like('segment', p)}) AS m_{k}" for k, p in SIBLING_PATTERNS.items())
    named = " ".join(f"WHEN m_{k} = {MOST} AND {MOST} > 0 THEN '{k}'" for k in SIBLING_PATTERNS)
    weak = f"{MOST} * 2 < n"
    return f"""s1 AS (SELECT parent, count(*) AS n, min(segment) AS lo, max(segment) AS hi, min(reverse(segment)) AS rlo, max(reverse(segment)) AS rhi, floor(avg(strlen(segment))) AS mean_bytes, {counts} FROM {siblings} GROUP BY parent),
s2 AS (SELECT *, regexp_replace({LCP.format('lo', 'hi')}, '[0-9]+$', '') AS prefix, regexp_replace(reverse({LCP.format('rlo', 'rhi')}), '^[0-9]+', '') AS suffix FROM s1),
s3 AS (SELECT parent, CASE WHEN prefix <> '' THEN substr(segment, length(prefix) + 1) ELSE '' END AS a, CASE WHEN suffix <> '' THEN substr(segment, 1, length(segment) - length(suffix)) ELSE '' END AS b, abs(strlen(segment) - mean_bytes) <= 2 AS c FROM {siblings} JOIN s2 USING (parent)),
s4 AS (SELECT parent, count(*) FILTER (WHERE {CODE.format('a')}) AS m_prefix, count(*) FILTER (WHERE {CODE.format('b')}) AS m_suffix, count(*) FILTER (WHERE c) AS m_similar FROM s3 GROUP BY parent),
s5 AS (SELECT *, CASE WHEN {weak} AND n >= 3 AND m_prefix * 10 >= n * 6 THEN 'prefix' WHEN {weak} AND n >= 3 AND m_suffix * 10 >= n * 6 THEN 'suffix' WHEN {weak} AND m_similar * 10 >= n * 8 THEN 'similar_length_strings' {named} ELSE '' END AS pattern FROM s2 JOIN s4 USING (parent)),
detected AS (SELECT parent, n, pattern, CASE pattern WHEN 'prefix' THEN m_prefix WHEN 'suffix' THEN m_suffix WHEN 'similar_length_strings' THEN m_similar ELSE {MOST} END AS hits, prefix, suffix FROM s5),
d2 AS (SELECT *, CASE WHEN n < 3 THEN 'none' WHEN pattern = 'similar_length_strings' THEN CASE WHEN n >= 6 THEN 'all' ELSE 'none' END WHEN pattern IN ('prefix', 'suffix') OR hits * 10 >= n * 8 THEN 'all' WHEN hits >= 3 THEN 'some' ELSE 'none' END AS action,
 CASE WHEN regexp_replace(string_split(parent, '/')[-1], '^\\{{|\\}}$', '', 'g') = '' THEN 'root' ELSE regexp_replace(string_split(parent, '/')[-1], '^\\{{|\\}}$', '', 'g') END AS pname,
 regexp_replace(prefix, '[_.-]+$', '') AS pbase, regexp_replace(suffix, '^[_.-]+', '') AS sbase FROM detected),
decided AS (SELECT parent, n, pattern, hits, action, CASE WHEN action <> 'none' THEN CASE pattern WHEN 'prefix' THEN CASE WHEN pbase = '' THEN pname ELSE pbase END || '_id' WHEN 'suffix' THEN CASE WHEN sbase = '' THEN pname ELSE sbase END || '_id'
 {' '.join(f"WHEN '{k}' THEN pname || '_{v}'" for k, v in VARIABLE_SUFFIX.items())} ELSE 'var_' || pname END END AS variable,
 CASE WHEN action <> 'none' THEN CASE pattern WHEN 'prefix' THEN regexp_escape_min(prefix) || '[0-9]+' WHEN 'suffix' THEN '[0-9]+' || regexp_escape_min(suffix) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in VARIABLE_REGEX.items())} ELSE '' END END AS regex FROM d2)""".replace("regexp_escape_min(prefix)", QUOTE.format("prefix")).replace("regexp_escape_min(suffix)", QUOTE.format("suffix"))


QUOTE = r"regexp_replace({0}, '([\\.+*?()|\[\]{{}}^$])', '\\\1', 'g')"
FITS = "CASE pattern " + " ".join(f"WHEN '{k}' THEN {like('segment', p)}" for k, p in SIBLING_PATTERNS.items()) + " ELSE false END"
SIBLINGS = f"""{ctes('req_pages', 'req_suppliers', 'req_parts', 'req_formats')},
urls AS (SELECT url FROM req_pages UNION ALL SELECT url FROM req_suppliers UNION ALL SELECT url FROM req_parts UNION ALL SELECT url FROM req_formats),
sib AS (SELECT DISTINCT '/' || array_to_string(s[:-2], '/') AS parent, s[-1] AS segment FROM (SELECT {segments('url')} AS s FROM urls) WHERE len(s) > 1),
{detect_ctes('sib')},
members AS (SELECT sib.parent, segment, CASE WHEN action = 'all' OR (action = 'some' AND {FITS}) THEN variable END AS variable FROM sib JOIN decided USING (parent))"""


def tree_ctes(*names: str, depth: int = 4) -> str:
    """placed (seq, method, url..., route) by whole sibling sets, level by level."""
    union = " UNION ALL ".join(f"SELECT seq + {i} * 1000000000 AS seq, method, url, content_type, body, accept, \"authorization\", cookie FROM {n}" for i, n in enumerate(names))
    key = like("x", "^[A-Za-z_][A-Za-z0-9_]*=")
    out = [ctes(*names), f"reqs AS ({union})", f"l0 AS (SELECT *, [CASE WHEN {key} THEN split_part(x, '=', 1) ELSE x END for x in {segments('url')}] AS keys, '' AS route FROM reqs)"]
    for d in range(depth):
        part = detect_ctes(f"sib{d}")
        for name in ("s1", "s2", "s3", "s4", "s5", "detected", "d2", "decided"):
            part = re.sub(rf"\b{name}\b", f"{name}_{d}", part)
        out += [
            f"sib{d} AS (SELECT DISTINCT route AS parent, keys[{d + 1}] AS segment FROM l{d} WHERE len(keys) > {d})",
            part,
            f"step{d} AS (SELECT parent, segment, CASE WHEN action = 'all' OR (action = 'some' AND {FITS}) THEN '{{' || variable || '}}' ELSE segment END AS step FROM sib{d} JOIN decided_{d} USING (parent))",
            f"l{d + 1} AS (SELECT l{d}.* EXCLUDE (route), CASE WHEN step IS NULL THEN route ELSE route || '/' || step END AS route FROM l{d} LEFT JOIN step{d} ON parent = route AND segment = keys[{d + 1}] AND len(keys) > {d})",
        ]
    return ",\n".join([*out, f"placed AS (SELECT * FROM l{depth})"])


ORDERS = tree_ctes("req_orders")
THREE = tree_ctes("req_pages", "req_orders", "req_formats")
ACCEPT, SCHEME = "trim(split_part(trim(split_part(accept, ',', 1)), ';', 1))", "split_part(\"authorization\", ' ', 1)"
COOKIES = "[{'name': trim(split_part(trim(c), '=', 1)), 'value': trim(substr(trim(c), strpos(trim(c), '=') + 1))} for c in string_split(cookie, ';')]"
NAMED_VALUES = "count(*) AS hits, count(*) - 1 AS seen_again"
QUESTIONS = f"""{ORDERS},
asked AS (SELECT * REPLACE (CASE WHEN seq % 5 = 0 THEN url || '&extra=1' WHEN seq % 7 = 0 THEN '/v2' || url ELSE url END AS url) FROM req_orders),
nodes AS (SELECT DISTINCT route FROM placed),
hit AS (SELECT asked.*, CASE WHEN seq % 5 <> 0 AND seq % 7 = 0 THEN NULL ELSE (SELECT route FROM nodes WHERE route = '/api/customers/{{customers_id}}/orders') END AS route FROM asked),
m AS (SELECT DISTINCT route, method FROM placed),
pn AS (SELECT DISTINCT route, method, p.name AS name FROM (SELECT route, method, unnest({pairs(query('url'))}) AS p FROM placed)),
hn AS (SELECT DISTINCT route, method, 'a' || {ACCEPT} AS v FROM placed UNION SELECT DISTINCT route, method, 'z' || {SCHEME} FROM placed),
cn AS (SELECT DISTINCT route, method, c.name || '=' || c.value AS v FROM (SELECT route, method, unnest({COOKIES}) AS c FROM placed)),
bad AS (SELECT seq FROM hit ANTI JOIN m USING (route, method)
 UNION SELECT seq FROM (SELECT seq, route, method, p.name AS name FROM (SELECT seq, route, method, unnest({pairs(query('url'))}) AS p FROM hit WHERE route IS NOT NULL)) ANTI JOIN pn USING (route, method, name)
 UNION SELECT seq FROM (SELECT seq, route, method, unnest(['a' || {ACCEPT}, 'z' || {SCHEME}]) AS v FROM hit WHERE route IS NOT NULL) ANTI JOIN hn USING (route, method, v)
 UNION SELECT seq FROM (SELECT seq, route, method, c.name || '=' || c.value AS v FROM (SELECT seq, route, method, unnest({COOKIES}) AS c FROM hit WHERE route IS NOT NULL)) ANTI JOIN cn USING (route, method, v))"""
KIND = "CASE WHEN " + " WHEN ".join(f"logical_type = '{k}' THEN '{t}'" for k, (t, _) in LOGICAL_SCHEMA.items()) + " WHEN " + " WHEN ".join(f"physical_type = '{k}' THEN '{t}'" for k, t in PHYSICAL_SCHEMA.items()) + " ELSE 'string' END"
FORM = "CASE logical_type " + " ".join(f"WHEN '{k}' THEN '{f}'" for k, (_, f) in LOGICAL_SCHEMA.items() if f) + " END"
BAD_URL = "CASE WHEN seq % 10 = 3 THEN CASE WHEN contains(url, '?') THEN 'bad query' ELSE 'bad escape in path' END WHEN seq % 10 = 7 THEN 'missing protocol scheme' END"
OPERATION = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(route, '[{}]', '', 'g'), '[^A-Za-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g'), '_+', '_', 'g')"

#: Path nodes (node, parts) of the routes in placed, the root's empty one included.
PRE = "pre AS (SELECT DISTINCT array_to_string(parts[1:i], '/') AS node, parts[1:i] AS parts FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT DISTINCT string_split(route, '/') AS parts FROM placed)))"
TWO = tree_ctes("req_orders", "req_events") + ",\n" + PRE
BARE = "replace(replace({0}, '{{', ''), '}}', '')"
KEY = "CASE WHEN node = '' THEN 'root' ELSE " + BARE.format("parts[-1]") + " END"
TYPE = "CASE WHEN node = '' THEN 'root' WHEN parts[-1] LIKE '{%' THEN 'request_path_variable' ELSE 'request_path' END"
BELOW = f"""m AS (SELECT route, method, count(*) AS requests FROM placed GROUP BY ALL),
pn AS (SELECT route, method, p.name AS name, count(*) AS presence FROM (SELECT route, method, unnest({pairs(query('url'))}) AS p FROM placed) GROUP BY ALL),
hv AS (SELECT DISTINCT route, method, 'Accept' AS name, {ACCEPT} AS v FROM placed UNION SELECT DISTINCT route, method, 'Authorization', {SCHEME} FROM placed),
cv AS (SELECT DISTINCT route, method, c.name AS name, c.value AS v FROM (SELECT route, method, unnest({COOKIES}) AS c FROM placed))"""
COUNT = "(SELECT count(*) FROM {0})"
SETS = " UNION ALL ".join(f"SELECT parent, n, action FROM decided_{d}" for d in range(4))
#: Physical type, pattern type and number format of each text of the catalog's list, in its order.
CLASSES = (
    ("null",), ("boolean",), ("integer",), ("integer",), ("float",), ("array", "json"), ("object", "json"), ("string",), ("string", "ipaddress"), ("string", "ipaddress"), ("string", "phone"), ("string", "plate"), ("string", "email"),
    ("string", "datetime"), ("string", "date"), ("string", "time"), ("string", "url"), ("string", "xml"), ("string", None, "percentage"), ("string", None, "currency"), ("float", None, "decimal"), ("integer", "phone"),
    ("string", "bankcard"), ("string",), ("string",), ("float",),
)


def type_classes(texts: tuple[str, ...]) -> str:
    of = lambda k: " ".join(f"WHEN {i} THEN '{c[k]}'" for i, c in enumerate(CLASSES) if len(c) > k and c[k])
    i = f"CAST(x % {len(texts)} AS INT)"
    values = " ".join(f"WHEN {n} THEN {t}" for n, t in enumerate(texts))
    return f"WITH {ctes('req_formats')} SELECT x, CASE {i} {values} END AS value, CASE {i} {of(0)} END AS physical, CASE {i} {of(1)} END AS logical, CASE {i} {of(2)} END AS format FROM (SELECT seq AS x FROM req_formats)"


def counts(source: str) -> str:
    return f"SELECT route, method, count(*) AS requests FROM (WITH {source} SELECT route, method FROM placed) GROUP BY ALL"


SQL = {
    "routing_headers": f"""WITH {ctes('req_orders')} SELECT seq, 'Accept' AS name, {ACCEPT} AS value FROM req_orders UNION ALL SELECT seq, 'Authorization', {SCHEME} FROM req_orders UNION ALL SELECT seq, 'X-Api-Version', 'v' || (seq % 3) FROM req_orders
 UNION ALL SELECT seq, 'Accept-Language', CASE WHEN seq % 2 = 0 THEN 'en-US' ELSE 'zh-CN' END FROM req_orders UNION ALL SELECT seq, 'X-Requested-With', 'XMLHttpRequest' FROM req_orders WHERE seq % 4 = 0""",
    "ajax_requests": "SELECT o_orderkey % 4 = 0 AS ajax, count(*) AS n FROM orders GROUP BY ALL",
    "param_extract": "SELECT CAST(o_orderkey AS BIGINT) AS seq, (o_orderkey % 7) || CASE WHEN o_orderkey % 4 = 0 THEN ',9' ELSE '' END AS page, o_orderkey % 4 = 0 AS multi, CASE WHEN o_orderkey % 3 = 0 THEN substr(o_orderpriority, 1, 1) ELSE '0' END AS prio, o_orderkey % 3 = 0 AS has_prio FROM orders",
    "param_values": "SELECT CAST(p_partkey AS BIGINT) AS seq, unnest([CAST(p_size AS VARCHAR), 's', 't', '']) AS value FROM part",
    "param_match": "SELECT o_orderkey % 3 = 0 AS prio, false AS pri, true AS page, false AS ag, count(*) AS n FROM orders GROUP BY ALL",
    "variable_extract": """WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS seq, CASE s_suppkey % 2 WHEN 0 THEN 'user_' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') ELSE lpad(CAST(s_suppkey AS VARCHAR), 5, '0') || '_user' END AS x FROM supplier
 UNION ALL SELECT p_partkey + 1000000000, CASE p_partkey % 10 WHEN 0 THEN 'list' WHEN 1 THEN 'create' ELSE CAST(p_partkey AS VARCHAR) END FROM part), t AS (SELECT seq, CASE WHEN seq % 6 = 0 THEN x || '.HTML' ELSE x END AS x FROM s)
 SELECT seq, CASE WHEN contains(x, '_user') THEN x END AS numbered, CASE WHEN seq % 6 <> 0 THEN x END AS other, CASE WHEN x IN ('list', 'create') THEN x END AS word FROM t""",
    "json_nested_flatten": """SELECT CAST(p_partkey AS BIGINT) AS seq, p.name AS name, p.value AS value FROM (SELECT p_partkey, unnest([{'name': 'user.id', 'value': CAST(p_partkey AS VARCHAR)}, {'name': 'user.tags.0', 'value': 'a'}, {'name': 'user.tags.1.b', 'value': p_partkey || '.5'},
 {'name': 'user.none', 'value': ''}, {'name': 'f.0', 'value': '1000'}, {'name': 'f.1', 'value': '0.25'}, {'name': 'f.2', 'value': 'true'}, {'name': 'big', 'value': '12345678901'}]) AS p FROM part)""",
    "request_log": f"WITH {ctes('req_pages')}, e AS (SELECT {BAD_URL} AS e FROM req_pages) SELECT CASE WHEN e IS NULL THEN 'info' WHEN e = 'bad query' THEN 'warn' ELSE 'error' END AS level, coalesce(e, 'request GET') AS message, count(*) AS n FROM e GROUP BY ALL",
    "order_tree_stats": f"""WITH {ORDERS}, {PRE}, {BELOW}, c AS (SELECT {COUNT.format("pre WHERE parts[-1] LIKE '{%'")} AS request_path_variable, {COUNT.format("pre WHERE node <> '' AND parts[-1] NOT LIKE '{%'")} AS request_path, {COUNT.format('m')} AS request_method, {COUNT.format('pn')} AS request_param,
 0 AS request_content_type, {COUNT.format('(SELECT DISTINCT route, method, name FROM hv)')} AS request_header, {COUNT.format('hv')} AS request_header_value, {COUNT.format('(SELECT DISTINCT route, method, name FROM cv)')} AS request_cookie, {COUNT.format('cv')} AS request_cookie_value)
 SELECT 1 + request_path + request_path_variable + request_method + request_param + request_header + request_header_value + request_cookie + request_cookie_value AS nodes, *, (SELECT max(len(parts)) + 2 FROM pre) AS max_depth, (SELECT CAST(2 * sum(requests) AS BIGINT) FROM m) AS requests,
 request_param + request_header_value + request_cookie_value AS leaves FROM c""",
    "order_snapshot": f"""WITH {ORDERS}, {PRE}, {BELOW}, sets AS ({SETS}), t AS (SELECT count(*) FILTER (WHERE n >= 3) AS tried, count(*) FILTER (WHERE n >= 3 AND action = 'none') AS skipped FROM sets),
 k AS (SELECT {COUNT.format("pre WHERE parts[-1] LIKE '{%'")} AS vars, {COUNT.format('pn')} AS params, (SELECT count(*) FROM pn JOIN m USING (route, method) WHERE requests > 1 AND presence >= 0.9 * requests) AS required)
 SELECT {COUNT.format('placed')} AS requests_processed, vars AS path_variables_identified, tried AS pattern_detections, params AS params_created, params + vars AS type_inferences, 0 AS body_params_parsed, required AS required_params_inferred, tried AS merge_attempts,
 skipped AS merge_skipped, 0 AS warnings, 0 AS errors FROM t, k""",
    "resumed_routes": counts(tree_ctes("req_pages", "req_orders")),
    "streamed_routes": counts(ORDERS),
    "folded_routes": counts(ORDERS),
    "pattern_variables": """WITH s AS (SELECT CASE s_suppkey % 2 WHEN 0 THEN 'user_' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') ELSE lpad(CAST(s_suppkey AS VARCHAR), 5, '0') || '_user' END AS segment FROM supplier
 UNION SELECT CASE p_partkey % 10 WHEN 0 THEN 'list' WHEN 1 THEN 'create' ELSE CAST(p_partkey AS VARCHAR) END FROM part),
 m AS (SELECT segment, CASE WHEN regexp_matches(segment, 'user_[0-9]') THEN 'user_[0-9]+' WHEN regexp_matches(segment, '[0-9]_user') THEN '[0-9]+_user' WHEN regexp_matches(segment, '[0-9]') THEN '[0-9]+' END AS pattern FROM s)
 SELECT '/x' AS parent, segment, CASE WHEN contains(pattern, 'user') THEN 'user_id' ELSE 'parts_id' END AS variable, pattern FROM m WHERE pattern IS NOT NULL""",
    "find_route_types": f"WITH {tree_ctes('req_events')} SELECT seq, route, method, CASE WHEN seq % 3 <> 0 THEN content_type END AS content_type FROM placed",
    "sketched_types": f"WITH {VOTES} SELECT owner, total, physical_type, logical_type FROM votes",
    "ruled_types": f"WITH {OBSERVED} SELECT owner, CASE WHEN max(length(v)) > 8 THEN 'wide' ELSE 'narrow' END AS type FROM hist GROUP BY owner",
    "merged_trees": f"SELECT route, method, CAST(sum(requests) AS BIGINT) AS requests FROM (({counts(tree_ctes('req_orders', 'req_pages'))}) UNION ALL ({counts(tree_ctes('req_orders', 'req_events'))})) GROUP BY ALL",
    "tree_ancestors": f"WITH {TWO} SELECT node AS node_id, array_to_string(parts[1:j], '/') AS ancestor_id, len(parts) - j AS distance FROM (SELECT node, parts, unnest(range(1, len(parts))) AS j FROM pre)",
    "tree_siblings": f"WITH {TWO} SELECT node AS node_id, CASE WHEN node = '' THEN 0 ELSE count(*) OVER (PARTITION BY parts[:-2], node = '') - 1 END AS siblings FROM pre",
    "tree_paths": f"WITH {TWO} SELECT node AS node_id, CASE WHEN node = '' THEN '/' ELSE {BARE.format('node')} END AS path FROM pre",
    "tree_children": f"WITH {TWO} SELECT node AS node_id, parts[-1] AS key FROM pre WHERE len(parts) = 3 AND parts[2] = 'track' AND parts[-1] NOT LIKE '{{%'",
    "tree_removed": f"WITH {TWO} SELECT node AS node_id, {KEY} AS key FROM pre WHERE NOT list_contains(parts, 'customers')",
    "node_documents": f"""WITH {TWO} SELECT node AS node_id, '{{"node_type":"' || {TYPE} || '","key":"' || {KEY} || '","value":""}}' AS text, {TYPE} AS node_type, {KEY} AS key FROM pre""",
    "variable_displays": f"WITH {TWO} SELECT parent || '/{{' || variable || '}}' AS node_id, '{{' || variable || ':' || regex || '}}' AS shown FROM ({' UNION ALL '.join(f'SELECT parent, variable, regex FROM decided_{d}' for d in range(4))}) WHERE variable IS NOT NULL",
    "url_path_segments": f"WITH {ctes('req_pages', 'req_orders')}, u AS (SELECT seq, {segments('url')} AS s FROM (SELECT seq, url FROM req_pages UNION ALL SELECT seq + 1000000000, url FROM req_orders)) SELECT seq, pos - 1 AS pos, s[pos] AS segment FROM (SELECT seq, s, unnest(range(1, len(s) + 1)) AS pos FROM u)",
    "url_query_params": f"WITH {ctes('req_orders')} SELECT seq, p.name AS name, p.value AS value FROM (SELECT seq, unnest({pairs(query('url'))}) AS p FROM req_orders)",
    "url_path_params": f"WITH {ctes('req_parts')} SELECT seq, lower(split_part(x, '=', 1)) AS name, substr(x, strpos(x, '=') + 1) AS value FROM (SELECT seq, unnest({segments("'/a/' || replace(body, '&', '/')")}) AS x FROM req_parts) WHERE {like('x', '^[A-Za-z_][A-Za-z0-9_]*=')}",
    "method_normalize": f"WITH {ctes('req_orders')} SELECT CASE WHEN seq % 3 = 0 THEN 'GET' ELSE method END AS method, count(*) AS n FROM req_orders GROUP BY ALL",
    "content_type_normalize": f"WITH {ctes('req_events')} SELECT lower(trim(split_part(trim(' ' || upper(content_type)), ';', 1))) AS media_type, method IN ('POST', 'PUT', 'PATCH') AS takes_body, count(*) AS n FROM req_events GROUP BY ALL",
    "percent_decode": f"WITH {ctes('req_parts')} SELECT seq, string_split(body, '&')[1] || '+#' AS decoded FROM req_parts",
    "form_body_params": f"WITH {ctes('req_parts')} SELECT seq, p.name AS name, p.value AS value FROM (SELECT seq, unnest({pairs('body')}) AS p FROM req_parts)",
    "json_body_flatten": f"WITH {ctes('req_events')} SELECT seq, lower(j.key) AS name, j.value->>'$' AS value FROM req_events, json_each(body) j",
    "multipart_fields": f"WITH {ctes('req_parts')} SELECT seq, 'brand' AS name, method AS value FROM req_parts UNION ALL SELECT seq, 'file', CAST(seq AS VARCHAR) || '.txt' FROM req_parts",
    "cookie_parse": f"WITH {ctes('req_orders')} SELECT seq, c.name AS name, c.value AS value FROM (SELECT seq, unnest({COOKIES}) AS c FROM req_orders)",
    "header_values_normalized": f"WITH {ctes('req_orders')} SELECT seq, {ACCEPT} AS accept, {SCHEME} AS scheme FROM req_orders",
    "static_ext_filter": f"WITH {ctes('req_pages')} SELECT seq, {like(f"lower(trim({path('url')}, '/'))", STATIC_PATTERN)} AS is_static FROM req_pages",
    "param_source_union": f"WITH {ctes('req_events')} SELECT 'uid' AS name, 'query' AS source, count(*) AS n FROM req_events UNION ALL SELECT lower(j.key), 'body', count(*) FROM req_events, json_each(body) j GROUP BY ALL",
    "value_histogram": f"WITH {OBSERVED} SELECT owner, v AS value, cnt FROM hist",
    "unique_values": f"WITH {OBSERVED} SELECT owner, count(*) AS n_values, CAST(sum(cnt) AS BIGINT) AS total FROM hist GROUP BY owner",
    "value_types": f"WITH {OBSERVED} SELECT owner, v AS value, {PHYSICAL} AS physical, {LOGICAL} AS logical, {FORMAT} AS format FROM hist",
    "type_votes": f"WITH {VOTES} SELECT * FROM votes",
    "openapi_schema_map": f"WITH {VOTES} SELECT owner, {KIND} AS type, {FORM} AS format FROM votes",
    "pattern_detect": f"WITH {SIBLINGS} SELECT * FROM detected",
    "merge_decision": f"WITH {SIBLINGS} SELECT parent, n, pattern, hits, action, variable, regex FROM decided",
    "merge_members": f"WITH {SIBLINGS} SELECT * FROM members",
    "fixed_kept": f"WITH {SIBLINGS} SELECT parent, segment FROM members WHERE variable IS NULL",
    "route_counts": f"WITH {THREE} SELECT route, method, count(*) AS requests FROM placed GROUP BY ALL",
    "endpoints_sorted": f"WITH {THREE} SELECT DISTINCT route, method, substr(lower(method) || '_' || CASE WHEN {OPERATION} = '' THEN 'root' ELSE {OPERATION} END, 1, 100) AS operation_id FROM placed",
    "required_params": f"""WITH {ORDERS}, t AS (SELECT route, method, count(*) AS requests FROM placed GROUP BY ALL), p AS (SELECT route, method, p.name AS name, p.value AS v FROM (SELECT route, method, unnest({pairs(query('url'))}) AS p FROM placed)),
hist AS (SELECT route, method, name, v, count(*) AS cnt FROM p GROUP BY ALL), k AS (SELECT route, method, name, count(*) AS n_values, sum(cnt) AS total, sum(CASE WHEN regexp_full_match(v, '[0-9]+') THEN cnt ELSE 0 END) AS whole FROM hist GROUP BY ALL)
SELECT route, method, name, CAST(total AS BIGINT) AS presence, requests, requests > 1 AND total >= 0.9 * requests AS required, CASE WHEN 2 * whole > total THEN 'integer' ELSE 'string' END AS physical_type, CASE WHEN n_values >= 2 AND total >= 3 AND n_values <= 0.3 * total THEN 'enum' ELSE 'string' END AS logical_type FROM k JOIN t USING (route, method)""",
    "content_type_nodes": f"WITH {tree_ctes('req_events')} SELECT route, method, content_type, lower(trim(split_part(content_type, ';', 1))) AS media_type, count(*) AS cnt FROM placed GROUP BY ALL",
    "header_values": f"WITH {ORDERS} SELECT route, method, 'Accept' AS name, {ACCEPT} AS value, {NAMED_VALUES} FROM placed GROUP BY ALL UNION ALL SELECT route, method, 'Authorization', {SCHEME}, {NAMED_VALUES} FROM placed GROUP BY ALL",
    "cookie_values": f"WITH {ORDERS} SELECT route, method, c.name AS name, c.value AS value, {NAMED_VALUES} FROM (SELECT route, method, unnest({COOKIES}) AS c FROM placed) GROUP BY ALL",
    "find_route": f"WITH {QUESTIONS} SELECT seq, m.route AS route, hit.method AS method FROM hit LEFT JOIN m ON m.route = hit.route AND m.method = hit.method",
    "is_need_request": f"WITH {QUESTIONS} SELECT seq, seq IN (SELECT seq FROM bad) AS need FROM asked",
    "security_schemes": f"WITH {ctes('req_orders')} SELECT lower({SCHEME}) || 'Auth' AS name, lower({SCHEME}) AS scheme, count(*) AS n FROM req_orders WHERE lower({SCHEME}) IN ('bearer', 'basic', 'digest') GROUP BY ALL",
    "batch_errors": f"WITH {ctes('req_pages')} SELECT seq, {BAD_URL} AS error FROM req_pages WHERE seq % 10 IN (3, 7) ORDER BY seq LIMIT 100",
    "router_stats": f"WITH {ctes('req_pages')} SELECT count(*) FILTER (WHERE seq % 10 NOT IN (3, 7)) AS processed, count(*) FILTER (WHERE seq % 10 IN (3, 7)) AS failed FROM req_pages",
    "curl_parse": f"WITH {ctes('req_parts')} SELECT seq, 'POST' AS method, 'http://h.example' || url AS url, 'application/x-www-form-urlencoded' AS content_type, body, 'text/html' AS accept FROM req_parts",
}
