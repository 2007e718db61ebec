"""How dangerous web requests look, by their method, target, headers and body."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.network import ip_scope
from ..functions.payload import risk_level

#: Patterns of attacks and of tools, as they are looked for in targets and bodies, or in the name of the client's program.
SQL = r"(?i)(\bunion\s+select\b|\bor\s+1=1\b|information_schema|sleep\(|benchmark\(|'\s*or\s*'1'='1)"
TRAVERSAL = r"(?i)(\.\./|%2e%2e%2f|%252e%252e%252f)"
COMMAND = r"(?i)(;|\|\||&&|\$\(|`)(?:[^\n\r]{0,80})(cmd|sh|bash|powershell|whoami|curl|wget)"
INTERNAL = r"(?i)(?:https?://|=)(?:127\.0\.0\.1|localhost|0\.0\.0\.0)(?![\w.-])|169\.254\.169\.254"
TOOLS = r"(?i)\b(sqlmap|nikto|nmap|masscan|acunetix|havij|wpscan|dirbuster|gobuster|curl/|wget/|python-requests)\b"
LONG_BASE64 = r"\b[A-Za-z0-9+/]{200,}={0,2}\b"
#: Names of parameters that carry credentials.
CREDENTIALS = ("password", "passwd", "pwd", "token", "api_key", "apikey", "secret", "auth", "authorization")
#: Bytes from which on a body is large.
LARGE = 50_000


def _decoded(text: Column) -> Column:
    """A parameter without its percent signs; as it is if these are damaged."""
    return F.coalesce(F.try_url_decode(text), text)


def parameters(text: Column) -> Column:
    """The parameters of a query or form, as (key in lower case, value), decoded; the value is empty where there is none."""
    pair = lambda p: F.struct(F.lower(F.trim(_decoded(F.regexp_extract(p, "^([^=]*)", 1)))).alias("key"), _decoded(F.regexp_extract(p, "=(.*)$", 1)).alias("value"))
    return F.transform(F.filter(F.split(text, "&"), lambda p: p != ""), pair)


def request_risks(requests: DataFrame) -> DataFrame:
    """Requests (method, dst, uri, headers, body in bytes, body_bytes) with score, level (low, medium or high) and reasons.

    Points are given for unusual methods, posts to public addresses, patterns
    of attacks in target or body, tools, credentials among the parameters (more
    in those of GET) or in the body, internal targets, long encoded stretches,
    large bodies and uploads that leave their folder. The body is looked at as far as it was kept, as latin-1.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    header = lambda name: F.coalesce(F.try_element_at("headers", F.lit(name)), F.lit(""))
    rows = requests.withColumns({
        "own_method": F.upper(text("method")), "own_uri": text("uri"), "own_body": F.decode(F.coalesce("body", F.lit(b"")), "ISO-8859-1"), "own_agent": header("user-agent"), "own_type": F.lower(header("content-type")),
    })
    rows = rows.withColumn("own_both", F.concat("own_uri", F.lit("\n"), "own_body"))
    form = F.when(F.col("own_type").contains("x-www-form-urlencoded"), parameters(F.col("own_body"))).otherwise(parameters(F.lit("")))
    query = parameters(F.regexp_extract("own_uri", r"\?([^#]*)", 1))
    rows = rows.withColumn("own_parameters", F.concat(query, form))
    credentials = F.filter("own_parameters", lambda p: p["key"].isin(*CREDENTIALS) & (p["value"] != ""))
    inner = F.filter("own_parameters", lambda p: p["value"].rlike(INTERNAL))
    is_get = F.col("own_method") == "GET"
    lowered = F.lower("own_body")
    marked = reduce(lambda a, b: a | b, [lowered.contains(f"{key}=") | lowered.contains(f'"{key}"') for key in CREDENTIALS])
    checks = {
        "uncommon_method": F.when(F.col("own_method").isin("TRACE", "CONNECT"), 2),
        "post_to_public": F.when((F.col("own_method") == "POST") & (ip_scope(F.col("dst")) == "public"), 1),
        "sql": F.when(F.col("own_both").rlike(SQL), 3),
        "traversal": F.when(F.col("own_both").rlike(TRAVERSAL), 3),
        "command": F.when(F.col("own_both").rlike(COMMAND), 3),
        "internal_target": F.when(F.col("own_both").rlike(INTERNAL), 3),
        "tool": F.when(F.col("own_agent").rlike(TOOLS), 2),
        "credential_parameter": F.size(credentials) * F.when(is_get, 3).otherwise(1),
        "internal_parameter": F.size(inner) * 2,
        "credential_in_body": F.when(marked, F.when(is_get, 2).otherwise(1)),
        "long_base64": F.when(F.col("own_body").rlike(LONG_BASE64), 2),
        "large_body": F.when(F.col("body_bytes") >= LARGE, 1),
        "suspicious_upload": F.when(F.col("own_type").contains("multipart/form-data") & (F.col("own_uri").contains("../") | F.col("own_body").rlike(TRAVERSAL)), 2),
    }
    points = {name: F.coalesce(value, F.lit(0)) for name, value in checks.items()}
    found = rows.withColumns({f"own_points_{name}": value for name, value in points.items()})
    score = reduce(add, [F.col(f"own_points_{name}") for name in points])
    reasons = F.array_compact(F.array(*(F.when(F.col(f"own_points_{name}") > 0, name) for name in points)))
    return found.select(*requests.columns, score.cast("int").alias("score"), risk_level(score).alias("level"), reasons.alias("reasons"))
