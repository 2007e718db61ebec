"""Records of changing shape, and baselines merged from stored ones against exact figures."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from netquarry.operators import baselines
from netquarry.sources import eve


def test_records_of_any_shape(spark, tmp_path):
    alert = lambda sid, level=1, **more: {"event_type": "Alert", "src_ip": "1.1.1.1", "dest_ip": "2.2.2.2", "alert": {"signature_id": sid, "signature": f"S{sid}", "severity": level, **more}}
    lines = [
        *map(json.dumps, [alert(1), alert(1, 2), alert("2", "high"), alert(3), {"event_type": "alert", "alert": "odd"}, {"event_type": "alert"}, {"alert": {"signature_id": 9}}]),
        json.dumps({"event_type": "alert", "alert": {}}), json.dumps({"event_type": "dns", "dns": {"rrname": " A.B "}}), json.dumps({"event_type": "dns", "dns": [1]}), json.dumps({"event_type": "anomaly", "anomaly": 3}),
        json.dumps({"event_type": "fileinfo", "fileinfo": {"magic": "PDF"}}), json.dumps({"event_type": ["x"]}), "{broken", "[1, 2]", "", "null",
    ]
    (tmp_path / "eve.json").write_text("\n".join(lines))
    events = eve.read_eve(spark, str(tmp_path / "eve.json"))
    found = [(r.sid, r.signature, r.severity, r.src) for r in eve.alerts(events, suppressed=("3",)).collect()]
    assert sorted(found) == [("", "alert", "info", ""), ("1", "S1", "critical", "1.1.1.1"), ("1", "S1", "high", "1.1.1.1"), ("2", "S2", "high", "1.1.1.1")]
    assert {r.sid for r in eve.alerts(events, only=("2", "3")).collect()} == {"2", "3"}
    counted = {r.signature: (r.alerts, r.severity, r.sources) for r in eve.alert_counts(eve.alerts(events)).collect()}
    assert counted == {"S1": (2, "critical", 1), "S2": (1, "high", 1), "S3": (1, "critical", 1), "alert": (1, "info", 0)}
    assert {(r.event_type, r.name): r.records for r in eve.named_records(events).collect()} == {("dns", "a.b"): 1, ("anomaly", "anomaly"): 1, ("fileinfo", "PDF"): 1}
    assert sorted(r.line for r in eve.damaged_lines(events).collect()) == ["[1, 2]", "null", "{broken"]


def test_merged_baselines_are_those_of_all_data(spark, tmp_path):
    rng = random.Random(9)
    rows = [(f"c{k % 3}", rng.choice(["a", "b", None]), f"p{int(rng.paretovariate(0.5)) % 9_000}", rng.randrange(1_500)) for k in range(30_000)] + [("c0", "d", None, None)]
    packets = spark.createDataFrame(rows, "capture string, src string, dst string, bytes long").repartition(4)
    path = str(tmp_path / "stored")
    for capture in ("c0", "c1", "c2"):
        baselines.baseline(packets.where(F.col("capture") == capture), "src", "dst", "bytes").write.mode("append").parquet(path)
    got = {r.host: r for r in baselines.figures(baselines.merged(spark.read.parquet(path))).collect()}
    direct = {r.host: r for r in baselines.figures(baselines.merged(baselines.baseline(packets.withColumn("capture", F.lit("all")), "src", "dst", "bytes"))).collect()}
    assert got.keys() == {"a", "b", "d"}
    for host in ("a", "b"):
        own = [r for r in rows if r[1] == host]
        assert got[host].packets == len(own) and got[host].bytes == sum(r[3] for r in own)
        peers = len({r[2] for r in own})
        assert abs(got[host].peers - peers) <= 0.05 * peers and abs(got[host].peers - direct[host].peers) <= 0.05 * peers
        sizes = sorted(r[3] for r in own)
        for name, share in (("median_size", 0.5), ("high_size", 0.95)):
            rank = sum(s <= got[host][name] for s in sizes) / len(sizes)
            assert abs(rank - share) <= 0.03
    assert (got["d"].packets, got["d"].peers, got["d"].median_size) == (1, 0, None)


def test_drift(spark):
    def whole(rows):
        return baselines.merged(baselines.baseline(spark.createDataFrame(rows, "capture string, src string, dst string, bytes long"), "src", "dst", "bytes"))

    before = [("x", "old", "p", 5)] * 3 + [("x", "same", f"p{k}", 10) for k in range(20)] + [("x", "wide", "p", 10)] * 20 + [("x", "large", "p", 10)] * 20
    now = [("y", "new", "p", 5)] * 3 + [("y", "same", f"p{k}", 11) for k in range(21)] + [("y", "wide", f"q{k}", 10) for k in range(20)] + [("y", "large", "p", 40)] * 20
    found = {r.host: r for r in baselines.drift(whole(before), whole(now)).collect()}
    assert {h: r.state for h, r in found.items()} == {"old": "missing", "new": "new", "wide": "changed", "large": "changed"}
    assert (round(found["wide"].peers_before), round(found["wide"].peers_now), found["large"].median_size_now) == (1, 20, 40.0)
    assert baselines.drift(whole(before), whole(before)).count() == 0
