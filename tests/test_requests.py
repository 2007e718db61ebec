"""Risks of requests at the edges of each pattern."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from netquarry.operators.requests import parameters, request_risks

CASES = [
    (("GET", "10.0.0.1", "/", {}, b"", 0), 0, []),
    (("connect", "10.0.0.1", "h:443", {}, b"", 0), 2, ["uncommon_method"]),
    (("POST", "8.8.8.8", "/", {}, b"", 0), 1, ["post_to_public"]),
    (("POST", "10.0.0.1", "/", {}, b"", 0), 0, []),
    (("GET", "10.0.0.1", "/?q=1+UNION%20SELECT", {}, b"a union  select b", 17), 3, ["sql"]),
    (("GET", "10.0.0.1", "/%252E%252e%252f", {}, b"", 0), 3, ["traversal"]),
    (("GET", "10.0.0.1", "/localhost-monitor?localhostname=x", {}, b"", 0), 0, []),
    (("GET", "10.0.0.1", "/?u=http%3A%2F%2Flocalhost%2F", {}, b"", 0), 2, ["internal_parameter"]),
    (("GET", "10.0.0.1", "/169.254.169.254", {}, b"", 0), 3, ["internal_target"]),
    (("GET", "10.0.0.1", "/?Password=a&TOKEN=b&pwd=&x", {}, b"", 0), 6, ["credential_parameter"]),
    (("POST", "10.0.0.1", "/", {"content-type": "application/x-www-form-urlencoded"}, b"password=a&b=c", 14), 2, ["credential_parameter", "credential_in_body"]),
    (("GET", "10.0.0.1", "/", {}, b'{"secret": 1}', 13), 2, ["credential_in_body"]),
    (("GET", "10.0.0.1", "/", {"user-agent": "curl/8"}, b"A" * 200, 200), 4, ["tool", "long_base64"]),
    (("GET", "10.0.0.1", "/", {"user-agent": "Mozilla sqlmap/1"}, b"A" * 199, 60_000), 3, ["tool", "large_body"]),
    (("PUT", "10.0.0.1", "/../x", {"content-type": "Multipart/Form-Data; x"}, b"\xff;\x00 whoami", 10), 8, ["traversal", "command", "suspicious_upload"]),
    ((None, None, None, None, None, None), 0, []),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(n, *c[0]) for n, c in enumerate(CASES)], "n int, method string, dst string, uri string, headers map<string,string>, body binary, body_bytes long")
    return {r.n: r for r in request_risks(rows).collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_risk(found, n):
    _, score, reasons = CASES[n]
    assert (found[n].score, found[n].reasons) == (score, reasons)
    assert found[n].level == ("high" if score >= 6 else "medium" if score >= 3 else "low")


def test_parameters(spark):
    (row,) = spark.createDataFrame([("A=1&b=x%20y+z=&&c&%zz=%zz&=e",)], "t string").select(parameters(F.col("t"))).collect()
    assert [(p.key, p.value) for p in row[0]] == [("a", "1"), ("b", "x y z="), ("c", ""), ("%zz", "%zz"), ("", "e")]
