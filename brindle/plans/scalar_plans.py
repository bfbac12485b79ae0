"""Queries of scalar functions: strings, hashes, addresses, URLs, redaction, chat."""

from pyspark.sql import functions as F

from ..functions import net, redact, text
from ..operators import chat
from .registry import query, table

#: Unicode white space in the oracles' patterns.
_WS = r"[\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Strings with blanks, case and punctuation, made alike in both engines.
_MIXED = "concat(CASE doc_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN '-' WHEN 2 THEN 'A_' ELSE '' END, coalesce(text, ''), CASE doc_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN '!' ELSE '.x' END)"


def _mixed(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_MIXED} AS s")


@query("SELECT doc_id, CASE WHEN length(text) > 50 THEN concat(substring(text, 1, 50), '...') ELSE text END AS short FROM documents")
def string_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), 50).alias("short"))


@query(f"WITH m AS (SELECT doc_id, {_MIXED} AS s FROM documents) SELECT doc_id, lower(regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g')) AS norm, translate(lower(regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g')), ' -_.!☆・‘’''ー—', '') AS key FROM m")
def normalize_key(spark, sf_dir):
    return _mixed(spark, sf_dir).select("doc_id", text.normalized(F.col("s")).alias("norm"), text.normalized_key(F.col("s")).alias("key"))


@query(f"WITH m AS (SELECT doc_id, {_MIXED} AS s FROM documents), f AS (SELECT *, regexp_replace(regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+', ' ', 'g') AS flat FROM m) SELECT doc_id, substring(sha256(s), 1, 32) AS short, CASE WHEN flat = '' THEN '' ELSE substring(sha256(flat), 1, 32) END AS log, substring(sha256(s), 1, 16) AS rate, sha256(s) AS payload FROM f")
def hashes(spark, sf_dir):
    s = F.col("s")
    return _mixed(spark, sf_dir).select("doc_id", text.short_hash(s).alias("short"), text.log_hash(s).alias("log"), text.rate_key_hash(s).alias("rate"), F.sha2(s, 256).alias("payload"))


_LISTED = "concat(source, ', ', lang, CASE WHEN doc_id % 2 = 0 THEN ',' ELSE ' ' END, lang, ',,', source, ' x', CAST(doc_id % 3 AS STRING))"


@query("SELECT doc_id, concat_ws('|', source, lang, concat('x', CAST(doc_id % 3 AS STRING))) AS items FROM documents")
def list_parse(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_LISTED} AS s").select("doc_id", F.array_join(text.parse_list(F.col("s")), "|").alias("items"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat(lang, '=', source, '|n=', CAST(doc_id AS STRING)) END AS pairs FROM documents")
def map_parse(spark, sf_dir):
    s = "concat(lang, ':', source, ', n=', CAST(doc_id AS STRING), CASE WHEN doc_id % 5 = 0 THEN ',n=again' ELSE '' END)"
    parsed = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{s} AS s").select("doc_id", text.parse_map(F.col("s")).alias("m"))
    return parsed.select("doc_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("pairs"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN NULL ELSE true END AS flag FROM events")
def bool_parse(spark, sf_dir):
    s = "CASE event_id % 6 WHEN 0 THEN 'YES' WHEN 1 THEN '1' WHEN 2 THEN 'off' WHEN 3 THEN 'N' WHEN 4 THEN 'maybe' ELSE 'On' END"
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{s} AS s").select("event_id", text.parse_bool(F.col("s")).alias("flag"))


@query(f"WITH m AS (SELECT doc_id, {_MIXED} AS s FROM documents), k AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g')), '[-.]', '_', 'g'), '[^a-z0-9_]', '', 'g'), '^_+|_+$', '', 'g') AS k FROM m) SELECT doc_id, CASE WHEN k = '' THEN 'id' ELSE k END AS prefix FROM k")
def id_prefixes(spark, sf_dir):
    return _mixed(spark, sf_dir).select("doc_id", text.id_prefix(F.col("s")).alias("prefix"))


_IP = "CASE WHEN event_id % 50 = 49 THEN '1.2.3' ELSE concat(CAST((event_id * 7) % 256 AS STRING), '.', CAST((user_id * 13) % 256 AS STRING), '.', CAST(event_id % 256 AS STRING), '.', CAST((event_id * 31) % 256 AS STRING)) END"


def _ranges(number: str, nets=net.BLOCKED_V4) -> str:
    return " OR ".join(f"{number} BETWEEN {a} AND {b}" for a, b in map(net._range, nets))


_NUMBER = "(CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(nullif(split_part(ip, '.', 4), '') AS BIGINT))"


@query(f"WITH a AS (SELECT event_id, {_IP} AS ip FROM events) SELECT event_id, ip, coalesce({_ranges(_NUMBER)}, true) AS blocked FROM a")
def ip_blocklist(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{_IP} AS ip").withColumn("blocked", net.blocked_ipv4(F.col("ip")))


_V6 = ("2606:4700::1111", "fe80::1", "::1", "2001:db8::5", "2a00:1450:4001::200e", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "fe80::1%eth0", "64:ff9b::808:808", "not:an:address")


@query("SELECT page_id, CASE page_id % 10 WHEN 0 THEN false WHEN 4 THEN false WHEN 6 THEN false ELSE true END AS blocked FROM pages")
def ip_blocklist_v6(spark, sf_dir):
    pick = F.element_at(F.array(*[F.lit(v) for v in _V6]), (F.col("page_id") % 10 + 1).cast("int"))
    return net.blocked_ip(table(spark, sf_dir, "pages").select("page_id", pick.alias("ip")), "ip", "blocked").select("page_id", "blocked")


_URL = "CASE page_id % 7 WHEN 0 THEN replace(url, 'https://', 'ftp://') WHEN 1 THEN replace(url, '.com/', '.com:8443/') WHEN 2 THEN concat('HTTP://user@', substring(url, 9)) ELSE url END"
_PARTS = "regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?(?:[/?#]|$)', {})"
_PORT = "CASE WHEN p <> '' THEN p WHEN s = 'http' THEN '80' WHEN s = 'https' THEN '443' ELSE '' END"
_URLS = f"x AS (SELECT page_id, {_URL} AS u FROM pages), y AS (SELECT page_id, u, lower({_PARTS.format(1)}) AS s, lower({_PARTS.format(2)}) AS h, {_PARTS.format(3)} AS p FROM x)"


@query(f"WITH {_URLS} SELECT page_id, h AS host, {_PORT} AS port, CASE WHEN s NOT IN ('http', 'https') THEN 'scheme' WHEN h = '' THEN 'missing_host' WHEN {_PORT} NOT IN ('80', '443') THEN 'port' END AS broken FROM y")
def url_policy(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_URL} AS u")
    u = F.col("u")
    return urls.select("page_id", net.host(u).alias("host"), net.effective_port(u).alias("port"), net.url_policy(u, ports=("80", "443")).alias("broken"))


@query(f"WITH {_URLS}, z AS (SELECT page_id, s, h, {_PORT} AS port FROM y) SELECT a.page_id, (a.s = b.s AND a.h = b.h AND a.port = b.port) AS same FROM z a JOIN z b ON b.page_id = a.page_id - a.page_id % 5")
def same_origin_pairs(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_URL} AS u")
    first = urls.selectExpr("page_id AS b_id", "u AS b_u")
    return urls.join(first, F.col("b_id") == F.col("page_id") - F.col("page_id") % 5).select("page_id", net.same_origin(F.col("u"), F.col("b_u")).alias("same"))


@query(f"WITH {_URLS}, z AS (SELECT page_id, page_id - page_id % 4 AS chain, s, h, {_PORT} AS port FROM y) SELECT page_id, CASE WHEN row_number() OVER w - 1 > 2 THEN 'too_many' WHEN s NOT IN ('http', 'https') THEN 'scheme' WHEN h = '' THEN 'missing_host' ELSE 'ok' END AS verdict, coalesce(NOT (s = lag(s) OVER w AND h = lag(h) OVER w AND port = lag(port) OVER w), false) AS strip_headers FROM z WINDOW w AS (PARTITION BY chain ORDER BY page_id)")
def redirect_verdicts(spark, sf_dir):
    hops = table(spark, sf_dir, "pages").selectExpr("page_id", "page_id - page_id % 4 AS chain", f"{_URL} AS u")
    return net.redirect_verdicts(hops, "chain", "page_id", "u", 2).select("page_id", "verdict", "strip_headers")


_TRUSTED = ("10.0.0.0/8", "192.168.0.0/16")
_REMOTE = "CASE WHEN event_id % 3 = 0 THEN '203.0.113.9' ELSE concat('10.1.2.', CAST(event_id % 256 AS STRING)) END"
_XFF = "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('198.51.100.', CAST(user_id % 256 AS STRING), ', 10.0.0.1') WHEN 2 THEN concat('8.8.8.8, 1.1.1.', CAST(user_id % 256 AS STRING), ', 192.168.1.1') WHEN 3 THEN '10.0.0.2,10.0.0.3' ELSE 'junk, 9.9.9.9, junk' END"


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '203.0.113.9' ELSE CASE event_id % 5 WHEN 0 THEN '7.7.7.7' WHEN 1 THEN concat('198.51.100.', CAST(user_id % 256 AS STRING)) WHEN 2 THEN concat('1.1.1.', CAST(user_id % 256 AS STRING)) WHEN 3 THEN concat('10.1.2.', CAST(event_id % 256 AS STRING)) ELSE '9.9.9.9' END END AS ip FROM events")
def forwarded_client_ip(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{_REMOTE} AS remote", f"{_XFF} AS xff", "CASE WHEN event_id % 5 = 0 THEN '7.7.7.7' END AS real")
    return rows.select("event_id", net.client_ip(F.col("remote"), F.col("xff"), F.col("real"), _TRUSTED).alias("ip"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN concat('key:', substring(sha256(concat('k', CAST(user_id AS STRING))), 1, 16)) WHEN event_id % 4 = 1 THEN 'ip:unknown' ELSE concat('ip:1.2.3.', CAST(user_id % 256 AS STRING)) END AS identity FROM events")
def rate_identities(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 4 = 0 THEN concat(' k', CAST(user_id AS STRING), ' ') ELSE ' ' END AS api_key", "CASE WHEN event_id % 4 = 1 THEN '' ELSE concat('1.2.3.', CAST(user_id % 256 AS STRING)) END AS ip")
    return rows.select("event_id", net.rate_identity(F.col("api_key"), F.col("ip")).alias("identity"))


_KEYS = "CASE event_id % 12 WHEN 0 THEN 'Api-Key' WHEN 1 THEN 'session.token' WHEN 2 THEN 'user' WHEN 3 THEN ' Password ' WHEN 4 THEN 'tokens' WHEN 5 THEN 'db secret key' WHEN 6 THEN 'Cookie' WHEN 7 THEN 'keyboard' WHEN 8 THEN 'x_pwd' WHEN 9 THEN 'authorization' WHEN 10 THEN 'auth' ELSE event_type END"
_SENSITIVE = "n IN ('api_key', 'session_token', 'password', 'db_secret_key', 'cookie', 'x_pwd', 'authorization')"


@query(f"WITH k AS (SELECT event_id, translate(lower(trim({_KEYS})), '-. ', '___') AS n FROM events) SELECT event_id, n AS key, {_SENSITIVE} AS sensitive FROM k")
def sensitive_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{_KEYS} AS k")
    return rows.select("event_id", redact.log_key(F.col("k")).alias("key"), redact.sensitive_key(F.col("k")).alias("sensitive"))


_VALUE = "CASE event_id % 8 WHEN 0 THEN concat('sk_', CAST(event_id AS STRING)) WHEN 1 THEN ' Access-Token ' WHEN 2 THEN concat('Ab0', md5(CAST(event_id AS STRING))) WHEN 3 THEN md5(CAST(event_id AS STRING)) WHEN 4 THEN 'EYJhbGci' WHEN 5 THEN concat('Ab0 ', md5(CAST(event_id AS STRING))) WHEN 6 THEN 'Ab0short' ELSE event_type END"
_PREFIX = "|".join(redact.PREFIXES)


@query(f"WITH v AS (SELECT event_id, {_VALUE} AS v FROM events) SELECT event_id, lower(trim(v)) IN {redact.VALUES} OR regexp_matches(lower(v), '^(?:{_PREFIX})') OR (length(v) >= 24 AND regexp_full_match(v, '[A-Za-z0-9_.+/=-]+') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')) AS secret FROM v")
def secret_like_values(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{_VALUE} AS v").select("event_id", redact.secret_like(F.col("v")).alias("secret"))


_LOG = "concat(CASE doc_id % 6 WHEN 0 THEN concat('Authorization uses Bearer abc.', CAST(doc_id AS STRING), '~x ') WHEN 1 THEN concat('GET /p?a=1&api_key=', CAST(doc_id AS STRING), '&b=2 ') WHEN 2 THEN concat('dsn https://user:pw', CAST(doc_id AS STRING), '@host/path ') WHEN 3 THEN 'plain ' WHEN 4 THEN concat('my.api-key: \"k ', CAST(doc_id AS STRING), '\", tokens=3 ') ELSE '' END, coalesce(text, ''))"
_M = redact.MASK
_QUERY = "|".join(redact.QUERY_KEYS)
_ASSIGNED = f"(?i)(^|[^0-9A-Za-z])((?:{redact.ASSIGNED_KEYS})[\"'']?[\\t ]*[:=][\\t ]*)(?:\"[^\"\\n]*\"|''[^''\\n]*''|[^\\t\\n\\r ,;&\"'']+)"


@query(
    f"WITH l AS (SELECT doc_id, {_LOG} AS s FROM documents) SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '(?i)\\b(bearer\\s+)[A-Za-z0-9._~+/=-]+', '\\1{_M}', 'g'), '(?i)([?&;](?:{_QUERY})=)[^&\\s]+', '\\1{_M}', 'g'), '(?i)\\b([a-z][a-z0-9+.-]*://)[^/@\\s]+@', '\\1{_M}@', 'g'), '{_ASSIGNED}', '\\1\\2{_M}', 'g') AS clean FROM l"
)
def redact_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_LOG} AS s")
    return rows.select("doc_id", redact.redact(F.col("s")).alias("clean"))


_LINE = "concat('{\"time\":\"t', CAST(doc_id AS STRING), '\",\"level\":\"INFO\",\"msg\":\"', repeat('é', 700), '\",\"extra\":\"', repeat('x', CAST(doc_id % 2 * 66000 AS INT)), '\"}')"


@query(f"WITH l AS (SELECT doc_id, {_LINE} AS s FROM documents) SELECT doc_id, CASE WHEN strlen(s) <= 65536 THEN s ELSE concat('{{\"stdout_truncated\":true,\"stdout_original_bytes\":', CAST(strlen(s) AS STRING), ',\"time\":\"t', CAST(doc_id AS STRING), '\",\"level\":\"INFO\",\"msg\":\"', repeat('é', 512), '\"}}') END AS line FROM l")
def log_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_LINE} AS s").select("doc_id", redact.shorten_line(F.col("s")).alias("line"))


@query("SELECT event_id, CASE WHEN k IN (0, 1) THEN NULL ELSE 400 + k END AS status, CASE WHEN k IN (0, 1) OR k = 4 THEN NULL ELSE 'denied' END AS code, CASE WHEN k IN (0, 1) OR k = 4 THEN NULL ELSE concat('m', CAST(event_id AS STRING)) END AS message FROM (SELECT event_id, event_id % 5 AS k FROM events)")
def http_error_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "CAST(CASE WHEN event_id % 5 < 2 THEN 200 + event_id % 5 ELSE 400 + event_id % 5 END AS INT) AS status", "CASE WHEN event_id % 5 = 4 THEN 'not json' ELSE concat('{\"error\":\"denied\",\"message\":\"m', CAST(event_id AS STRING), '\"}') END AS body")
    rows = rows.withColumn("e", redact.http_status(F.col("status"), F.col("body")))
    return rows.select("event_id", "e.status", "e.code", "e.message")


@query("SELECT conv_id, turn, CASE WHEN lower(trim(role)) IN ('developer', 'assistant', 'system') THEN lower(trim(role)) ELSE 'user' END AS role, CASE WHEN conv_id % 4 = 1 THEN 'single_developer' ELSE 'openai' END AS profile FROM conversations")
def chat_roles(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "concat(' ', upper(role)) AS role", "CASE WHEN conv_id % 4 = 1 THEN ' Grok-4' ELSE 'gpt' END AS model")
    return rows.select("conv_id", "turn", chat.completion_role(F.col("role")).alias("role"), chat.instruction_profile(F.col("model")).alias("profile"))


#: Each conversation led by instructions: two invariants, the first with a breakpoint, and a developer message; conversations of id % 5 = 0 end with a late one.
_LED = (
    "SELECT conv_id, turn + 10 AS turn, role, text AS content, false AS cache_breakpoint FROM {t} WHERE role <> 'system' UNION ALL SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 'system', 'rule one', true FROM {t} UNION ALL SELECT DISTINCT conv_id, CAST(1 AS BIGINT), 'System', concat('rule ', CAST(conv_id AS STRING)), false FROM {t} "
    "UNION ALL SELECT DISTINCT conv_id, CAST(2 AS BIGINT), 'developer', 'be brief', conv_id % 2 = 0 FROM {t} UNION ALL SELECT DISTINCT conv_id, CAST(9999 AS BIGINT), 'developer', 'late', false FROM {t} WHERE conv_id % 5 = 0"
)


@query(
    f"WITH led AS ({_LED.format(t='conversations')}), h AS (SELECT conv_id, count(*) FILTER (WHERE role NOT IN ('system', 'System', 'developer')) AS n, string_agg(content, '|' ORDER BY turn) FILTER (WHERE role NOT IN ('system', 'System', 'developer')) AS body, max(turn) FILTER (WHERE role = 'developer') = 9999 AS late FROM led GROUP BY conv_id) "
    "SELECT conv_id, CASE WHEN late AND n > 0 THEN 'developer_after_history' END AS error, CASE WHEN late AND n > 0 THEN NULL ELSE md5(concat_ws('|', concat('[APPLICATION INVARIANTS]', chr(10), 'rule one'), concat('rule ', CAST(conv_id AS STRING)), concat('[DEVELOPER INSTRUCTIONS]', chr(10), 'be brief'), body)) END AS digest, CASE WHEN late AND n > 0 THEN NULL ELSE CAST(n + 3 AS INT) END AS messages FROM h WHERE n > 0"
)
def instruction_adapt(spark, sf_dir):
    table(spark, sf_dir, "conversations").createOrReplaceTempView("_brindle_conversations")
    led = spark.sql(_LED.format(t="_brindle_conversations"))
    some = led.where("role NOT IN ('system', 'System', 'developer')").select("conv_id").distinct()
    out = chat.adapt(led.join(some, "conv_id", "left_semi"))
    digest = F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "|"))
    return out.select("conv_id", "error", F.when(F.col("messages").isNotNull(), digest).alias("digest"), F.when(F.col("messages").isNotNull(), F.size("messages")).alias("messages"))


_ENVELOPE = "CASE event_id % 6 WHEN 0 THEN '{\"tool_calls\": []}' WHEN 1 THEN ' {\"a\": 1, \"function_call\": {}} ' WHEN 2 THEN '{\"text\": \"tool_calls\"}' WHEN 3 THEN 'tool_call' WHEN 4 THEN '{\"tool_call\": {\"x\"' ELSE concat('answer ', CAST(event_id AS STRING)) END"


@query("SELECT event_id, event_id % 6 IN (0, 1, 4) AS envelope FROM events")
def tool_call_envelope(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{_ENVELOPE} AS s").select("event_id", chat.tool_call_envelope(F.col("s")).alias("envelope"))


@query(
    "WITH i AS (SELECT user_id AS response, event_id AS pos, event_id % 6 AS k, CASE WHEN event_id % 4 = 0 THEN 'in_progress' ELSE 'completed' END AS status, CASE WHEN event_id % 9 = 0 THEN 'final_answer' ELSE 'commentary' END AS phase FROM events), ok AS (SELECT *, CASE k WHEN 2 THEN '{\"text\": \"tool_calls\"}' WHEN 3 THEN 'tool_call' ELSE concat('answer ', CAST(pos AS STRING)) END AS t FROM i WHERE status = 'completed' AND k IN (2, 3, 5)) "
    "SELECT response, coalesce(arg_min(t, pos) FILTER (WHERE phase = 'final_answer'), arg_max(t, pos)) AS text FROM ok GROUP BY response"
)
def completion_text(spark, sf_dir):
    items = table(spark, sf_dir, "events").selectExpr("user_id AS response", "event_id AS pos", f"{_ENVELOPE} AS s", "CASE WHEN event_id % 4 = 0 THEN 'in_progress' ELSE 'completed' END AS status", "CASE WHEN event_id % 9 = 0 THEN 'final_answer' ELSE 'commentary' END AS phase")
    return chat.preferred_text(items, "response", "pos", "status", "phase", "s")


@query("SELECT event_type AS model, CAST(sum(user_id) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 100) AS BIGINT) AS output_tokens FROM events GROUP BY 1")
def token_usage(spark, sf_dir):
    return chat.usage(table(spark, sf_dir, "events").selectExpr("event_type AS model", "user_id AS prompt_tokens", "event_id % 100 AS output_tokens"), "model", "prompt_tokens", "output_tokens")
