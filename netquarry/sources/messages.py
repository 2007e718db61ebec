"""Messages of text and fixed-layout protocols in packets' payloads: logs, logins, mail, banners, time, echo and management.

Every extract is a projection of packets (see ``captures``) with SQL functions
alone; packets of other ports or of another form give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of ICMP types.
ICMP_TYPES = {0: "echo_reply", 3: "unreachable", 5: "redirect", 8: "echo", 11: "time_exceeded", 13: "timestamp", 14: "timestamp_reply"}
#: Modes of NTP by number.
NTP_MODES = ("reserved", "symmetric_active", "symmetric_passive", "client", "server", "broadcast", "control", "private")
_ENDS = ("capture", "pkt_no", "ts", "src", "sport", "dst", "dport")


def byte(payload: Column, place: int | Column) -> Column:
    """The byte at a place from 0 as a number; null beyond the end."""
    at = F.lit(place) if isinstance(place, int) else place
    return F.when(F.octet_length(payload) > at, F.conv(F.hex(F.substring(payload, at + 1, F.lit(1))), 16, 10).cast("int"))


def text(payload: Column) -> Column:
    """A payload with one character a byte."""
    return F.decode(payload, "ISO-8859-1")


def _of(packets: DataFrame, *ports: int) -> DataFrame:
    return packets.where(F.col("sport").isin(*ports) | F.col("dport").isin(*ports))


def _group(pattern: str, n: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text(F.col("payload")), pattern, n), F.lit(""))


def syslog(packets: DataFrame, port: int = 514) -> DataFrame:
    """Log messages: facility, severity (0 is the worst) and bytes after the priority; priorities above 191 are none."""
    priority = F.regexp_extract(text(F.col("payload")), r"^<(\d{1,3})>", 1)
    rows = packets.where(F.col("dport") == port).select(*_ENDS, F.nullif(priority, F.lit("")).cast("int").alias("priority"), (F.octet_length("payload") - F.length(priority) - 2).alias("bytes"))
    return rows.where("priority <= 191").select(*_ENDS, F.expr("priority div 8").cast("int").alias("facility"), (F.col("priority") % 8).alias("severity"), "bytes")


def ssh_banners(packets: DataFrame) -> DataFrame:
    """Who says which version and software, on any port."""
    pattern = r"^SSH-([0-9.]+)-([^ \r\n]+)"
    return packets.where("transport = 'TCP'").select(*_ENDS, _group(pattern).alias("version"), _group(pattern, 2).alias("software")).where("version IS NOT NULL")


def ftp(packets: DataFrame, port: int = 21) -> DataFrame:
    """Commands in upper case with their argument, and replies with their code; client and server whatever the direction."""
    line, answer = r"^([A-Za-z]{3,4})(?: ([^\r\n]*))?\r?\n", r"^(\d{3})[ -]"
    asked = F.col("dport") == port
    ends = (F.when(asked, F.col("src")).otherwise(F.col("dst")).alias("client"), F.when(asked, F.col("dst")).otherwise(F.col("src")).alias("server"))
    rows = _of(packets, port).select(*_ENDS, *ends, F.when(asked, F.upper(_group(line))).alias("command"), F.when(asked, _group(line, 2)).alias("argument"), F.when(~asked, _group(answer)).cast("int").alias("code"))
    return rows.where("command IS NOT NULL OR code IS NOT NULL")


def logins(messages: DataFrame, least: int = 5) -> DataFrame:
    """What clients did on FTP servers: users tried, failures, successes, files moved both ways, and whether passwords were guessed (so many failures)."""
    n = lambda test: F.count(F.when(test, 1))
    did = lambda *c: F.col("command").isin(*c)
    found = messages.groupBy("client", "server").agg(
        F.count_distinct(F.when(did("USER"), F.col("argument"))).alias("users"), n(F.col("code") == 530).alias("failures"), n(F.col("code") == 230).alias("successes"),
        n(did("STOR", "APPE")).alias("uploads"), n(did("RETR")).alias("downloads"),
    )
    return found.withColumn("guessed", F.col("failures") >= least)


def mail_envelopes(packets: DataFrame, ports: tuple[int, ...] = (25, 465, 587)) -> DataFrame:
    """Addresses of senders and recipients, in lower case, as clients give them."""
    line = r"(?i)^(MAIL FROM|RCPT TO):\s*<([^>]*)>"
    rows = packets.where(F.col("dport").isin(*ports)).select(*_ENDS, F.when(F.upper(_group(line)).startswith("MAIL"), "sender").otherwise("recipient").alias("role"), F.lower(_group(line, 2)).alias("address"))
    return rows.where("address IS NOT NULL")


def basic_credentials(packets: DataFrame) -> DataFrame:
    """User and password of requests with basic authentication; what isn't base64 or has no colon gives no row."""
    given = F.try_to_binary(_group(r"(?i)\r\nAuthorization:\s*Basic\s+([A-Za-z0-9+/]+={0,2})"), F.lit("base64"))
    rows = packets.select(*_ENDS, text(given).alias("given")).where("contains(given, ':')")
    return rows.select(*_ENDS, F.substring_index("given", ":", 1).alias("user"), F.expr("substring(given, locate(':', given) + 1)").alias("password"))


def icmp(packets: DataFrame) -> DataFrame:
    """ICMP over IPv4: type, code, the type's name (other if it has none) and bytes after the header."""
    kind = byte(F.col("payload"), 0)
    names = F.create_map(*(F.lit(x) for pair in ICMP_TYPES.items() for x in pair))
    rows = packets.where("transport = 'ICMP' AND octet_length(payload) >= 4")
    return rows.select(*_ENDS, kind.alias("type"), byte(F.col("payload"), 1).alias("code"), F.coalesce(F.try_element_at(names, kind), F.lit("other")).alias("name"), F.greatest(F.octet_length("payload") - 8, F.lit(0)).alias("bytes"))


def echo_hosts(messages: DataFrame, least_targets: int = 20, large: int = 128) -> DataFrame:
    """Sources of echoes: how many, to how many targets, those with a large payload; sweep (so many targets) and tunnel (most are large)."""
    pairs = messages.where("name = 'echo'").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("bytes") > large, 1)).alias("large"))
    found = pairs.groupBy("src").agg(F.sum("n").alias("echoes"), F.count(F.lit(1)).alias("targets"), F.sum("large").alias("large"))
    return found.withColumns({"sweep": F.col("targets") >= least_targets, "tunnel": 2 * F.col("large") > F.col("echoes")})


def ntp(packets: DataFrame, port: int = 123) -> DataFrame:
    """Version, mode and stratum of time messages; modes control and private answer with far more than they are asked."""
    first = byte(F.col("payload"), 0)
    modes = F.array(*map(F.lit, NTP_MODES))
    rows = _of(packets.where("transport = 'UDP'"), port).where("octet_length(payload) >= 2")
    return rows.select(*_ENDS, F.shiftright(first, 3).bitwiseAND(7).alias("version"), F.get(modes, first.bitwiseAND(7)).alias("mode"), byte(F.col("payload"), 1).alias("stratum"))


def snmp(packets: DataFrame, ports: tuple[int, ...] = (161, 162)) -> DataFrame:
    """Version (1, 2c) and community of management messages with short lengths; others, among them version 3, give no row."""
    p = F.col("payload")
    header = (byte(p, 0) == 0x30) & (byte(p, 1) < 0x80) & (byte(p, 2) == 2) & (byte(p, 3) == 1) & (byte(p, 4) < 2) & (byte(p, 5) == 4) & (byte(p, 6) < 0x80)
    rows = _of(packets.where("transport = 'UDP'"), *ports).where(header & (F.octet_length(p) >= 7 + byte(p, 6)))
    return rows.select(*_ENDS, F.when(byte(p, 4) == 0, "1").otherwise("2c").alias("version"), text(F.substring(p, F.lit(8), byte(p, 6))).alias("community"))


def in_vlans(packets: DataFrame, least: int = 2) -> DataFrame:
    """Hosts that send in ``least`` different virtual networks or more, by the outermost tag; and packets with more than one tag."""
    rows = packets.where("size(vlan_ids) > 0 AND src IS NOT NULL")
    pairs = rows.groupBy("src", F.get("vlan_ids", F.lit(0)).alias("vlan")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.size("vlan_ids") > 1, 1)).alias("stacked"))
    return pairs.groupBy("src").agg(F.count(F.lit(1)).alias("vlans"), F.sum("n").alias("packets"), F.sum("stacked").alias("stacked")).where(F.col("vlans") >= least)
