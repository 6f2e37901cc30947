"""One query per operator over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sqltext
from checks.fixture import DAY, EVENTS_SQL, SEVERITY_SQL, security_events, spark_events, threats
from ravelin.functions.times import rfc3339
from ravelin.operators import alerts as A
from ravelin.operators import analytics, delivery, metrics, persist
from ravelin.operators.batches import assign_batches, event_batches
from ravelin.operators.conditions import condition_column, conditions_column, field, group_key
from ravelin.operators.enrich import enrich, geo_enrich, guarded, ip_range_enrich, put_metadata, text_map, threat_enrich
from ravelin.operators.evaluate import evaluate
from ravelin.operators.ingest import batch_counts, reject_reason, rejection_lists, summarise
from ravelin.operators.keyindex import KeyIndex
from ravelin.operators.logs import parse_log_lines
from ravelin.operators.processes import process_diff
from ravelin.operators.rules import Condition, Rule, Step, load_rules
from ravelin.operators.segments import ip_segment_enrich, segment_chunks
from ravelin.operators.severity import classify_severity
from ravelin.plans.pipeline import alert_counts, enriched_events, run_pipeline, standard_enrichers
from ravelin.plans.replay import replay
from ravelin.sources.decode import decode, encode_json, encode_protobuf
from ravelin.session import ensure_checkpoint_dir, materialise
from ravelin.sources.topics import alert_records, event_records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
RULES_DIR = str(Path(__file__).resolve().parent.parent / "examples" / "rules")


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def with_events(body: str, more: str = "") -> str:
    return f"WITH RECURSIVE {EVENTS_SQL}{', ' + more if more else ''} {body}"


def us(column: str):
    return F.unix_micros(F.col(column))


def kind_is(*names: str) -> tuple[Condition, ...]:
    full = [f"EVENT_TYPE_{n}" for n in names]
    if len(full) == 1:
        return (Condition("type", "eq", full[0]),)
    return (Condition("type", "regex", "^(" + "|".join(full) + ")$"),)


FAILURE, SUCCESS, ESCALATION = "EVENT_TYPE_AUTH_FAILURE", "EVENT_TYPE_AUTH_SUCCESS", "EVENT_TYPE_PRIVILEGE_ESCALATION"
ERRORS_SQL = f"SELECT source_ip AS key, ts_us AS ts, event_id AS id FROM ev WHERE type = '{FAILURE}'"
SEQ_SQL = (
    f"SELECT source_ip AS key, ts_us AS ts, event_id AS id, type = '{FAILURE}' AS s0, type = '{SUCCESS}' AS s1, "
    f"type = '{ESCALATION}' AS s2 FROM ev WHERE type IN ('{FAILURE}', '{SUCCESS}', '{ESCALATION}')"
)

# ---- sources and projections ---------------------------------------------------------------------------


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark_events(spark, sf_dir).select(
        F.concat(F.lit("/var/log/"), "hostname").alias("path"), F.col("raw_message").alias("line"), "ts_us", "event_id", "hostname"
    )


@query(
    "log_line_events",
    with_events(
        f"""SELECT sha256('/var/log/' || hostname || chr(1) || event_id || chr(1) || raw_message) AS event_id,
 CASE WHEN contains(l, 'failed password') OR contains(l, 'authentication failure') THEN '{FAILURE}'
  WHEN contains(l, 'accepted password') OR contains(l, 'session opened') THEN '{SUCCESS}'
  WHEN contains(l, 'sudo') AND contains(l, 'root') THEN '{ESCALATION}' ELSE 'EVENT_TYPE_SYSTEM_CALL' END AS type,
 CASE WHEN contains(l, 'failed password') OR contains(l, 'authentication failure') OR contains(l, 'accepted password') OR contains(l, 'session opened')
  THEN CASE WHEN contains(word, '[') THEN split_part(word, '[', 1) WHEN word LIKE '%:' THEN word[:-2] ELSE word END
  WHEN contains(l, 'sudo') AND contains(l, 'root') THEN 'sudo' ELSE '' END AS service,
 CASE WHEN contains(l, 'from ') THEN split_part(substr(raw_message, instr(l, 'from ') + 5), ' ', 1) ELSE '' END AS source_ip,
 hostname, '/var/log/' || hostname AS source_file, ts_us
 FROM (SELECT *, lower(raw_message) AS l, coalesce(string_split_regex(trim(raw_message), '\\s+')[5], '') AS word FROM ev)
 WHERE raw_message <> ''"""
    ),
)
def log_line_events(spark, sf_dir):
    lines = log_lines(spark, sf_dir)
    parsed = parse_log_lines(
        lines, hostname=F.col("hostname"), timestamp=F.timestamp_micros("ts_us"), offset="event_id", agent_id="agent-0"
    )
    return parsed.select(
        "event_id", "type", "service", "source_ip", "hostname", F.col("metadata")["source_file"].alias("source_file"), us("timestamp").alias("ts_us")
    )


@query(
    "log_line_classes",
    with_events(
        f"""SELECT CASE WHEN contains(l, 'failed password') OR contains(l, 'authentication failure') THEN '{FAILURE}'
  WHEN contains(l, 'accepted password') OR contains(l, 'session opened') THEN '{SUCCESS}'
  WHEN contains(l, 'sudo') AND contains(l, 'root') THEN '{ESCALATION}' ELSE 'EVENT_TYPE_SYSTEM_CALL' END AS type,
 count(*) AS lines FROM (SELECT lower(raw_message) AS l FROM ev WHERE raw_message <> '') GROUP BY 1"""
    ),
)
def log_line_classes(spark, sf_dir):
    parsed = parse_log_lines(log_lines(spark, sf_dir))
    return parsed.groupBy("type").agg(F.count(F.lit(1)).alias("lines"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily snapshots per host: a process runs when its user was active that day."""
    raw = spark_events(spark, sf_dir)
    return raw.groupBy(
        F.col("hostname").alias("host"), F.floor(F.col("ts_us") / DAY).cast("bigint").alias("day"), (F.col("user_id") % 50).alias("pid")
    ).agg(F.min("event_type").alias("command")).select(
        "host",
        F.timestamp_micros(F.col("day") * DAY).alias("snapshot_ts"),
        "pid",
        F.when(F.col("pid") % 5 == 0, "\u0000 \u0000").otherwise(F.concat(F.lit(" "), "command", F.lit("\u0000--id\u0000"), F.col("pid").cast("string"), F.lit("\u0000"))).alias("cmdline"),
    )


@query(
    "process_diff",
    with_events(
        f"""SELECT 'EVENT_TYPE_PROCESS_START' AS type, host AS hostname, pid::VARCHAR AS pid, process, ts FROM snap s JOIN nums USING (host, day)
  WHERE no > 1 AND NOT EXISTS (SELECT 1 FROM snap p JOIN nums q USING (host, day) WHERE p.host = s.host AND p.pid = s.pid AND q.no = nums.no - 1)
 UNION ALL
 SELECT 'EVENT_TYPE_PROCESS_STOP', host, pid::VARCHAR, process, next_day * {DAY} FROM snap s JOIN nums USING (host, day)
  WHERE next_day IS NOT NULL AND NOT EXISTS (SELECT 1 FROM snap p JOIN nums q USING (host, day) WHERE p.host = s.host AND p.pid = s.pid AND q.no = nums.no + 1)""",
        f"""snap AS (SELECT host, day, pid, day * {DAY} AS ts, CASE WHEN pid % 5 = 0 THEN '[pid:' || pid || ']' ELSE command || ' --id ' || pid END AS process
  FROM (SELECT hostname AS host, ts_us // {DAY} AS day, user_id % 50 AS pid, min(event_type) AS command FROM ev GROUP BY ALL)),
 nums AS (SELECT host, day, row_number() OVER (PARTITION BY host ORDER BY day) AS no, lead(day) OVER (PARTITION BY host ORDER BY day) AS next_day
  FROM (SELECT DISTINCT host, day FROM snap))""",
    ),
)
def process_diff_query(spark, sf_dir):
    return process_diff(snapshots(spark, sf_dir)).select(
        "type", "hostname", F.col("metadata")["pid"].alias("pid"), "process", us("timestamp").alias("ts")
    )


BATCH_SIZE, BATCH_SECONDS = 10, 21_600
BATCH_SQL = f"""tickd AS (SELECT agent_id, event_id, ts_us, (ts_us - min(ts_us) OVER (PARTITION BY agent_id)) // {BATCH_SECONDS * 1_000_000} AS tick FROM ev),
 chk AS (SELECT *, (row_number() OVER (PARTITION BY agent_id, tick ORDER BY ts_us, event_id) - 1) // {BATCH_SIZE} AS chunk FROM tickd),
 seq AS (SELECT agent_id, event_id, ts_us, dense_rank() OVER (PARTITION BY agent_id ORDER BY tick, chunk) AS sequence FROM chk)"""


def batched(spark, sf_dir):
    rows = spark_events(spark, sf_dir).select("agent_id", "event_id", "ts_us")
    return assign_batches(rows, "ts_us", "event_id", BATCH_SIZE, f"{BATCH_SECONDS}s")


@query("batch_assignment", with_events("SELECT agent_id, event_id, sequence FROM seq", BATCH_SQL))
def batch_assignment(spark, sf_dir):
    return batched(spark, sf_dir).select("agent_id", "event_id", "sequence")


@query(
    "event_batches",
    with_events(
        "SELECT agent_id, sequence, count(*) AS events, arg_min(event_id, (ts_us, event_id)) AS first_id, arg_max(event_id, (ts_us, event_id)) AS last_id FROM seq GROUP BY ALL",
        BATCH_SQL,
    ),
)
def event_batches_query(spark, sf_dir):
    return event_batches(batched(spark, sf_dir), "ts_us", "event_id").select(
        "agent_id",
        "sequence",
        F.size("events").cast("bigint").alias("events"),
        F.element_at("events", 1)["event_id"].alias("first_id"),
        F.element_at("events", -1)["event_id"].alias("last_id"),
    )


# ---- decode, encode, topics ----------------------------------------------------------------------------


def records(spark, sf_dir, encoding):
    """Encoded events; records with an empty message text carry a damaged payload."""
    events = security_events(spark, sf_dir)
    encoded = encode_json(events) if encoding == "json" else encode_protobuf(events)
    damaged = F.lit("{broken") if encoding == "json" else F.lit(b"\x0a\xff\x01")
    return encoded.select(
        F.col("event_id").alias("record_id"), F.when(F.col("raw_message") == "", damaged).otherwise(F.col("value")).alias("value")
    )


DECODE_SQL = with_events(
    """SELECT type, hostname, count(*) AS events, sum(k)::BIGINT AS ports, sum(length(raw_message))::BIGINT AS chars, max(ts_us) AS newest, 0::BIGINT AS malformed
 FROM ev WHERE raw_message <> '' GROUP BY ALL
 UNION ALL SELECT '', '', 0, 0, 0, 0, count(*) FROM ev WHERE raw_message = ''"""
)


def decoded_report(spark, sf_dir, encoding):
    out = decode(records(spark, sf_dir, encoding), "value", "SecurityEvent", encoding)
    good = out.good.groupBy("type", "hostname").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("source_port").alias("ports"),
        F.sum(F.length("raw_message")).alias("chars"),
        F.max(us("timestamp")).alias("newest"),
        F.lit(0).cast("bigint").alias("malformed"),
    )
    zero = F.lit(0).cast("bigint")
    bad = out.malformed.agg(F.count(F.lit(1)).alias("malformed")).select(
        F.lit("").alias("type"), F.lit("").alias("hostname"), zero.alias("events"), zero.alias("ports"), zero.alias("chars"), zero.alias("newest"), "malformed"
    )
    return good.unionByName(bad)


@query("decode_json_events", DECODE_SQL)
def decode_json_events(spark, sf_dir):
    return decoded_report(spark, sf_dir, "json")


@query("decode_protobuf_events", DECODE_SQL)
def decode_protobuf_events(spark, sf_dir):
    return decoded_report(spark, sf_dir, "protobuf")


@query(
    "publish_event_records",
    with_events("SELECT 'raw-events' AS topic, hostname AS key, raw_message AS value FROM ev"),
)
def publish_event_records(spark, sf_dir):
    records = event_records(security_events(spark, sf_dir), "raw_message")
    return records.select("topic", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


# ---- ingest --------------------------------------------------------------------------------------------

INGEST_SQL = f"""base AS (SELECT event_id, ts_us AS arrival, agent_id, 0 AS copy FROM ev
 UNION ALL SELECT event_id, ts_us + 100000000, agent_id, 1 FROM ev WHERE k % 10 = 0
 UNION ALL SELECT event_id, ts_us + 300000000, agent_id, 2 FROM ev WHERE k % 10 = 1
 UNION ALL SELECT event_id, ts_us + 400000000, agent_id, 3 FROM ev WHERE k % 10 = 0
 UNION ALL SELECT event_id, ts_us + 450000000, agent_id, 4 FROM ev WHERE k % 10 = 0
 UNION ALL SELECT '', ts_us + 5, agent_id, 5 FROM ev WHERE k % 10 = 2), {
    sqltext.first_per_window("SELECT event_id AS key, arrival AS ts, copy::VARCHAR AS id FROM base WHERE event_id <> ''", 300_000_000, False)
}, judged AS (SELECT b.event_id, b.arrival, b.agent_id, b.arrival // {DAY} AS sequence,
 CASE WHEN b.event_id = '' THEN 'empty event_id' WHEN NOT w.kept THEN 'duplicate' END AS reason
 FROM base b LEFT JOIN walk w ON w.key = b.event_id AND w.ts = b.arrival AND w.id = b.copy::VARCHAR)"""


def arrivals(spark, sf_dir):
    """Every event, some delivered again inside, at and after the time to live, some without an id."""
    base = spark_events(spark, sf_dir).select("event_id", F.col("ts_us").alias("arrival_us"), "agent_id", "k")
    digit = F.col("k") % 10
    copies = [(100_000_000, digit == 0), (300_000_000, digit == 1), (400_000_000, digit == 0), (450_000_000, digit == 0)]
    shifts = F.array(F.lit(0), *[F.when(test, F.lit(shift)) for shift, test in copies])
    repeated = base.select("*", F.explode(F.array_compact(shifts)).alias("shift")).withColumn("arrival_us", F.col("arrival_us") + F.col("shift"))
    nameless = base.filter(digit == 2).withColumn("event_id", F.lit("")).withColumn("arrival_us", F.col("arrival_us") + 5)
    both = repeated.drop("shift").unionByName(nameless).drop("k")
    return both.withColumn("sequence", F.floor(F.col("arrival_us") / DAY).cast("bigint"))


@query("ingest_decisions", with_events("SELECT event_id, arrival AS arrival_us, coalesce(reason, '') AS reason FROM judged", INGEST_SQL))
def ingest_decisions(spark, sf_dir):
    return reject_reason(arrivals(spark, sf_dir)).select("event_id", "arrival_us", F.coalesce("reason", F.lit("")).alias("reason"))


@query(
    "ingest_summary",
    with_events(
        """SELECT agent_id, sequence, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS rejected,
 coalesce(string_agg(event_id || '=' || reason, ',' ORDER BY event_id, reason) FILTER (reason IS NOT NULL), '') AS rejected_events FROM judged GROUP BY ALL""",
        INGEST_SQL,
    ),
)
def ingest_summary(spark, sf_dir):
    return summarise(reject_reason(arrivals(spark, sf_dir))).select(
        "agent_id",
        "sequence",
        "accepted",
        "rejected",
        F.array_join(F.transform("rejected_events", lambda e: F.concat(e["event_id"], F.lit("="), e["reason"])), ",").alias("rejected_events"),
    )


@query(
    "ingest_counts",
    with_events(
        f"""SELECT a.agent_id AS agent_id, d.day AS sequence, coalesce(accepted, 0) AS accepted, coalesce(rejected, 0) AS rejected
 FROM (SELECT DISTINCT agent_id FROM ev) a CROSS JOIN (SELECT unnest(range(min(ts_us) // {DAY} - 2, max(ts_us) // {DAY} + 1)) AS day FROM ev) d
 LEFT JOIN (SELECT agent_id, sequence, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS rejected FROM judged GROUP BY ALL) j
 ON j.agent_id = a.agent_id AND j.sequence = d.day""",
        INGEST_SQL,
    ),
)
def ingest_counts(spark, sf_dir):
    """Batches without events have zeros; events without an id have a null one here."""
    came = arrivals(spark, sf_dir).withColumn("event_id", F.when(F.col("event_id") != "", F.col("event_id")))
    first, last = spark_events(spark, sf_dir).agg(F.floor(F.min("ts_us") / DAY), F.floor(F.max("ts_us") / DAY)).first()
    days = F.explode(F.sequence(F.lit(first - 2), F.lit(last))).alias("sequence")
    return batch_counts(reject_reason(came), came.select("agent_id").distinct().select("agent_id", days))


@query(
    "rejected_lists",
    with_events("SELECT agent_id, sequence, event_id, reason FROM judged WHERE reason IS NOT NULL", INGEST_SQL),
)
def rejected_lists(spark, sf_dir):
    """Lists of about three, so that most batches have several."""
    lists = rejection_lists(reject_reason(arrivals(spark, sf_dir)), 3)
    return lists.select("agent_id", "sequence", F.inline("rejected_events"))


@query(
    "ingest_without_store",
    with_events("SELECT CASE WHEN event_id = '' THEN 'empty event_id' ELSE '' END AS reason, count(*) AS events FROM base GROUP BY ALL", INGEST_SQL),
)
def ingest_without_store(spark, sf_dir):
    judged = reject_reason(arrivals(spark, sf_dir), dedup=False)
    return judged.groupBy(F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("events"))


# ---- enrichment and severity ---------------------------------------------------------------------------

# Address spellings by the last digit of k, with the class each must get.
ADDRESS_FORMS = [
    ("source_ip", None),
    ("'::ffff:' || source_ip", None),
    ("'fc00::' || CAST(k AS VARCHAR(9))", True),
    ("'2001:db8::' || CAST(k AS VARCHAR(9))", False),
    ("'010.0.0.' || CAST(k AS VARCHAR(9))", "none"),
    ("''", "none"),
    ("'0:0:0:0:0:0:0:1'", True),
    ("'127.0.0.' || CAST(k AS VARCHAR(9))", True),
    ("source_ip || ' '", "none"),
    ("'fe80::1%eth' || CAST(k AS VARCHAR(9))", "none"),
]
ADDRESS_SQL = "CASE k % 10 " + " ".join(f"WHEN {i} THEN {text}" for i, (text, _) in enumerate(ADDRESS_FORMS)) + " END"


def _address_class(yes: str, no: str) -> str:
    arms = []
    for i, (_, kind) in enumerate(ADDRESS_FORMS):
        text = {"none": "''", True: f"'{yes}'", False: f"'{no}'"}.get(kind, f"CASE WHEN is_private THEN '{yes}' ELSE '{no}' END")
        arms.append(f"WHEN {i} THEN {text}")
    return "CASE k % 10 " + " ".join(arms) + " END"


@query(
    "geo_enrichment",
    with_events(
        f"SELECT event_id, {ADDRESS_SQL} AS source_ip, {_address_class('true', 'false')} AS geo_is_private, {_address_class('PRIVATE', 'UNKNOWN')} AS geo_country FROM ev"
    ),
)
def geo_enrichment(spark, sf_dir):
    raw = spark_events(spark, sf_dir)
    spelled = raw.withColumn("source_ip", F.expr(ADDRESS_SQL.replace("VARCHAR(9)", "STRING")))
    out = geo_enrich(spelled.select("event_id", "source_ip", F.lit(None).cast("map<string,string>").alias("metadata")))
    return out.select("event_id", "source_ip", field("geo_is_private").alias("geo_is_private"), field("geo_country").alias("geo_country"))


@query(
    "threat_enrichment",
    with_events(
        """SELECT event_id, CASE WHEN threat_hit IS NOT NULL THEN 'true' ELSE 'false' END AS threat_known,
 coalesce(threat_hit, CASE WHEN k % 7 = 0 THEN 'vendor' ELSE '' END) AS threat_category, k::VARCHAR AS kept FROM ev"""
    ),
)
def threat_enrichment(spark, sf_dir):
    """A producer-supplied category stays on a miss and is replaced on a hit."""
    events = security_events(spark, sf_dir)
    supplied = put_metadata(
        events, F.when(F.col("source_port") % 7 == 0, text_map(threat_category="vendor")), ["threat_category"]
    )
    out = threat_enrich(supplied, threats(spark, sf_dir))
    return out.select("event_id", field("threat_known").alias("threat_known"), field("threat_category").alias("threat_category"), field("k").alias("kept"))


@query(
    "enrichment_pipeline",
    with_events(
        f"""SELECT event_id, CASE WHEN is_private THEN 'true' ELSE 'false' END AS geo_is_private, CASE WHEN threat_hit IS NOT NULL THEN 'true' ELSE 'false' END AS threat_known,
 CASE WHEN k % 4 = 0 THEN '' ELSE (100 // (k % 4))::VARCHAR END AS share, CASE WHEN k % 4 = 0 THEN 'share: no divisor' ELSE '' END AS first_error FROM ev"""
    ),
)
def enrichment_pipeline(spark, sf_dir):
    """A step that fails for some rows leaves the other steps alone."""
    divisor = F.col("source_port") % 4
    share = F.floor(F.try_divide(F.lit(100), divisor)).cast("string")
    steps = [geo_enrich, guarded("share", {"share": share}, F.when(divisor == 0, "no divisor")), lambda df: threat_enrich(df, threats(spark, sf_dir))]
    out = enrich(security_events(spark, sf_dir), steps)
    return out.select(
        "event_id",
        *[field(n).alias(n) for n in ("geo_is_private", "threat_known", "share")],
        F.coalesce(F.try_element_at("enrich_errors", F.lit(1)), F.lit("")).alias("first_error"),
    )


@query(
    "geo_range_enrichment",
    with_events(
        """SELECT event_id, CASE WHEN user_id % 5 = 3 THEN CASE WHEN (user_id // 256) % 256 < 2 THEN 'AA' ELSE 'BB' END
  WHEN user_id % 5 = 4 THEN 'CC' ELSE '' END AS geo_country,
 CASE WHEN user_id % 5 IN (3, 4) THEN CAST(64500 + user_id % 5 AS VARCHAR) ELSE '' END AS geo_asn FROM ev"""
    ),
)
def geo_range_enrichment(spark, sf_dir):
    """Ranges derived from the networks that occur in the events: wide, narrow and adjacent ones."""
    nets = spark_events(spark, sf_dir).filter("user_id % 5 in (3, 4)").select(
        F.substring_index("source_ip", ".", 2).alias("net"), (F.col("user_id") % 5).alias("class")
    ).distinct()
    eights = nets.filter("class = 3").select(
        F.explode(
            F.array(
                F.struct(F.concat("net", F.lit(".0.0")).alias("first_ip"), F.concat("net", F.lit(".1.255")).alias("last_ip"), F.lit("AA").alias("country")),
                F.struct(F.concat("net", F.lit(".2.0")).alias("first_ip"), F.concat("net", F.lit(".255.255")).alias("last_ip"), F.lit("BB").alias("country")),
            )
        ).alias("r"), "class",
    ).select("r.*", "class")
    wide = nets.filter("class = 4").select(F.lit("185.0.0.0").alias("first_ip"), F.lit("185.255.255.255").alias("last_ip"), F.lit("CC").alias("country"), "class").distinct()
    ranges = eights.unionByName(wide).select("first_ip", "last_ip", "country", F.lit("somewhere").alias("city"), (F.col("class") + 64500).alias("asn"))
    out = ip_range_enrich(security_events(spark, sf_dir), ranges)
    return out.select("event_id", field("geo_country").alias("geo_country"), field("geo_asn").alias("geo_asn"))


@query(
    "geo_segment_enrichment",
    with_events(
        """SELECT event_id, six, CASE WHEN user_id % 5 = 3 THEN CASE WHEN (user_id // 256) % 256 < 2 THEN 'AA' WHEN user_id % 256 = 7 THEN 'DD' ELSE 'BB' END
  WHEN user_id % 5 = 4 THEN 'CC' ELSE '' END AS geo_country FROM ev, (VALUES (FALSE), (TRUE)) v(six)"""
    ),
)
def geo_segment_enrichment(spark, sf_dir):
    """Wide, narrow and single-address ranges over each other; every event once from its IPv4 address and once from an
    IPv6 address that ends in it."""
    raw = spark_events(spark, sf_dir)
    nets = raw.filter("user_id % 5 in (3, 4)").select(F.substring_index("source_ip", ".", 2).alias("net"), (F.col("user_id") % 5).alias("class")).distinct()
    span = lambda low, high, country: F.struct(low.alias("first_ip"), high.alias("last_ip"), F.lit(country).alias("country"))
    net = F.col("net")
    wide = nets.filter("class = 3").select(F.inline(F.array(
        span(F.concat(net, F.lit(".0.0")), F.concat(net, F.lit(".255.255")), "BB"), span(F.concat(net, F.lit(".0.0")), F.concat(net, F.lit(".1.255")), "AA"))))
    single = raw.filter("user_id % 5 = 3 AND user_id % 256 = 7 AND floor(user_id / 256) % 256 >= 2").select(F.inline(F.array(span(F.col("source_ip"), F.col("source_ip"), "DD")))).distinct()
    other = nets.filter("class = 4").select(F.inline(F.array(span(F.lit("185.0.0.0"), F.lit("185.255.255.255"), "CC")))).distinct()
    four = wide.unionByName(single).unionByName(other)
    six = four.select(*[F.concat(F.lit("2001:db8::"), c).alias(c) for c in ("first_ip", "last_ip")], "country")
    ranges = four.unionByName(six).select("*", F.lit("somewhere").alias("city"), F.lit(1).alias("asn"))
    twice = security_events(spark, sf_dir).withColumn("six", F.explode(F.array(F.lit(False), F.lit(True))))
    twice = twice.withColumn("source_ip", F.when(F.col("six"), F.concat(F.lit("2001:db8::"), "source_ip")).otherwise(F.col("source_ip")))
    return ip_segment_enrich(twice, segment_chunks(ranges, 64, 16)).select("event_id", "six", field("geo_country").alias("geo_country"))


@query("event_severity", with_events(f"SELECT event_id, type, {SEVERITY_SQL} AS severity FROM ev"))
def event_severity(spark, sf_dir):
    out = classify_severity(threat_enrich(security_events(spark, sf_dir), threats(spark, sf_dir)))
    return out.select("event_id", "type", "severity")


# ---- conditions ----------------------------------------------------------------------------------------


@query(
    "condition_operators",
    with_events(
        f"""SELECT event_id, (type = '{FAILURE}') AS eq, (k::VARCHAR <> '5') AS neq, TRUE AS neq_missing, FALSE AS neq_missing_empty,
 contains(raw_message, 'root') AS contains, TRUE AS contains_empty, regexp_matches(raw_message, 'user-[0-9]*7($|[^0-9])') AS regex,
 regexp_matches(raw_message, '(?i)FROM (?P<net>10|8)\\.') AS regex_named, FALSE AS regex_lookahead, FALSE AS regex_broken, (raw_message <> '') AS exists_text,
 FALSE AS exists_missing, FALSE AS unknown, FALSE AS empty_list, (service = 'sshd' AND hostname = 'host-3') AS both FROM ev"""
    ),
)
def condition_operators(spark, sf_dir):
    tests = {
        "eq": ("type", "eq", FAILURE),
        "neq": ("meta.k", "neq", "5"),
        "neq_missing": ("absent", "neq", "x"),
        "neq_missing_empty": ("absent", "neq", ""),
        "contains": ("raw_message", "contains", "root"),
        "contains_empty": ("absent", "contains", ""),
        "regex": ("raw_message", "regex", "user-[0-9]*7($|[^0-9])"),
        "regex_named": ("raw_message", "regex", r"(?i)FROM (?P<net>10|8)\."),
        "regex_lookahead": ("raw_message", "regex", "user(?=-)"),
        "regex_broken": ("raw_message", "regex", "user["),
        "exists_text": ("raw_message", "exists", ""),
        "exists_missing": ("destination_port", "exists", ""),
        "unknown": ("type", "startswith", "EVENT"),
    }
    columns = [condition_column(*test).alias(name) for name, test in tests.items()]
    both = conditions_column([Condition("service", "eq", "sshd"), Condition("hostname", "eq", "host-3")])
    return security_events(spark, sf_dir).select("event_id", *columns, conditions_column([]).alias("empty_list"), both.alias("both"))


@query(
    "rule_fields",
    with_events(
        """SELECT event_id, type AS event_type, hostname, source_ip, '' AS destination_ip, CASE WHEN k > 0 THEN k::VARCHAR ELSE '' END AS source_port, user_name AS "user",
 '' AS process, service, 'SEVERITY_UNSPECIFIED' AS severity, agent_id, raw_message, k::VARCHAR AS meta_k, k::VARCHAR AS k, '' AS destination_port FROM ev"""
    ),
)
def rule_fields(spark, sf_dir):
    names = ["event_type", "hostname", "source_ip", "destination_ip", "source_port", "user", "process", "service", "severity", "agent_id", "raw_message", "meta.k", "k", "destination_port"]
    return security_events(spark, sf_dir).select("event_id", *[field(n).alias(n.replace(".", "_")) for n in names])


@query(
    "group_keys",
    with_events("SELECT source_ip || '|' || service || '|' AS group_key, '' AS no_fields, count(*) AS events FROM ev GROUP BY ALL"),
)
def group_keys(spark, sf_dir):
    keyed = security_events(spark, sf_dir).select(group_key(["source_ip", "service", "absent"]).alias("group_key"), group_key([]).alias("no_fields"))
    return keyed.groupBy("group_key", "no_fields").agg(F.count(F.lit(1)).alias("events"))


# ---- rules ---------------------------------------------------------------------------------------------


def fires(spark, sf_dir, *rules: Rule) -> DataFrame:
    out = evaluate(security_events(spark, sf_dir), rules)
    return out.select("group_key", "event_id", "event_count", us("timestamp").alias("ts_us"))


def threshold_rule(wanted: int, days: int) -> Rule:
    return Rule("errors", "errors", "threshold", conditions=kind_is("AUTH_FAILURE"), group_by=("source_ip",), threshold=wanted, window_micros=days * DAY)


def sequence_rule(days: int) -> Rule:
    steps = (Step(kind_is("AUTH_FAILURE"), 2), Step(kind_is("AUTH_SUCCESS")), Step(kind_is("PRIVILEGE_ESCALATION")))
    return Rule("chain", "chain", "sequence", group_by=("source_ip",), window_micros=days * DAY, steps=steps)


def _fired_sql(walk: str, count: int) -> str:
    return with_events(f"SELECT key AS group_key, id AS event_id, {count}::BIGINT AS event_count, ts AS ts_us FROM walk WHERE fired", walk)


@query("single_rule", with_events(f"SELECT service AS group_key, event_id, 1::BIGINT AS event_count, ts_us FROM ev WHERE type = '{ESCALATION}' AND hostname = 'host-2'"))
def single_rule(spark, sf_dir):
    conditions = (*kind_is("PRIVILEGE_ESCALATION"), Condition("hostname", "eq", "host-2"))
    return fires(spark, sf_dir, Rule("root", "root", "single", conditions=conditions, group_by=("service",)))


@query("threshold_3_in_3_days", _fired_sql(sqltext.threshold(ERRORS_SQL, 3 * DAY, 3), 3))
def threshold_3_in_3_days(spark, sf_dir):
    return fires(spark, sf_dir, threshold_rule(3, 3))


@query("threshold_3_in_1_day", _fired_sql(sqltext.threshold(ERRORS_SQL, DAY, 3), 3))
def threshold_3_in_1_day(spark, sf_dir):
    return fires(spark, sf_dir, threshold_rule(3, 1))


@query("threshold_one", _fired_sql(sqltext.threshold(ERRORS_SQL, DAY, 1), 1))
def threshold_one(spark, sf_dir):
    return fires(spark, sf_dir, threshold_rule(1, 1))


@query("sequence_3_days", _fired_sql(sqltext.sequence(SEQ_SQL, 3 * DAY, [2, 1, 1]), 3))
def sequence_3_days(spark, sf_dir):
    return fires(spark, sf_dir, sequence_rule(3))


@query("sequence_5_days", _fired_sql(sqltext.sequence(SEQ_SQL, 5 * DAY, [2, 1, 1]), 3))
def sequence_5_days(spark, sf_dir):
    return fires(spark, sf_dir, sequence_rule(5))


@query(
    "hot_group_rules",
    with_events(
        "SELECT 't' AS rule_id, id AS event_id FROM walk WHERE fired UNION ALL SELECT 's', id FROM walk2 WHERE fired",
        sqltext.threshold(f"SELECT agent_id AS key, ts_us AS ts, event_id AS id FROM ev WHERE type = '{FAILURE}'", 3_600_000_000, 4)
        + ", "
        + sqltext.sequence(SEQ_SQL.replace("source_ip AS key", "agent_id AS key"), 7_200_000_000, [2, 1, 1]).replace("walk", "walk2").replace("num ", "num2 "),
    ),
)
def hot_group_rules(spark, sf_dir):
    """Three groups hold all rows and go through the split for hot keys."""
    steps = (Step(kind_is("AUTH_FAILURE"), 2), Step(kind_is("AUTH_SUCCESS")), Step(kind_is("PRIVILEGE_ESCALATION")))
    rules = [
        Rule("t", "t", "threshold", conditions=kind_is("AUTH_FAILURE"), group_by=("agent_id",), threshold=4, window_micros=3_600_000_000),
        Rule("s", "s", "sequence", group_by=("agent_id",), window_micros=7_200_000_000, steps=steps),
    ]
    out = evaluate(security_events(spark, sf_dir), rules, hot_rows=500, chunk_rows=200)
    return out.select("rule_id", "event_id")


# Nearly all rows of a group fall into one minute, a few are spread over the month, some have no time.
BURST_SQL = "CASE WHEN k % 17 = 0 THEN 0 WHEN k % 20 <> 0 THEN 1704844800000000 + ts_us % 60000000 ELSE ts_us END"


@query(
    "bursty_group_rules",
    with_events(
        "SELECT 't' AS rule_id, id AS event_id FROM walk WHERE fired UNION ALL SELECT 's', id FROM walk2 WHERE fired",
        sqltext.threshold(f"SELECT agent_id AS key, {BURST_SQL} AS ts, event_id AS id FROM ev WHERE type = '{FAILURE}'", 2_000_000, 4)
        + ", "
        + sqltext.sequence(SEQ_SQL.replace("source_ip AS key", "agent_id AS key").replace("ts_us AS ts", f"{BURST_SQL} AS ts"), 1_000_000, [2, 1, 1]).replace("walk", "walk2").replace("num ", "num2 "),
    ),
)
def bursty_group_rules(spark, sf_dir):
    steps = (Step(kind_is("AUTH_FAILURE"), 2), Step(kind_is("AUTH_SUCCESS")), Step(kind_is("PRIVILEGE_ESCALATION")))
    rules = [
        Rule("t", "t", "threshold", conditions=kind_is("AUTH_FAILURE"), group_by=("agent_id",), threshold=4, window_micros=2_000_000),
        Rule("s", "s", "sequence", group_by=("agent_id",), window_micros=1_000_000, steps=steps),
    ]
    events = security_events(spark, sf_dir)
    k = F.col("metadata")["k"].cast("bigint")
    burst = F.timestamp_micros(1704844800000000 + us("timestamp") % 60000000)
    moved = events.withColumn("timestamp", F.when(k % 17 == 0, F.lit(None).cast("timestamp")).when(k % 20 != 0, burst).otherwise(F.col("timestamp")))
    return evaluate(moved, rules, hot_rows=200, chunk_rows=80).select("rule_id", "event_id")


@query(
    "rules_over_copies",
    with_events(
        f"""SELECT key, id AS event_id, ts AS ts_us, CASE WHEN id = '' THEN count(*) ELSE 1 END AS fires FROM (
 SELECT source_ip AS key, CASE WHEN k % 4 = 0 THEN '' ELSE event_id END AS id, ts_us + c.n * CASE WHEN k % 5 = 0 THEN 1000000 ELSE 0 END AS ts
 FROM ev CROSS JOIN (VALUES (0), (1)) c(n) WHERE type = '{FAILURE}') GROUP BY key, id, ts"""
    ),
)
def rules_over_copies(spark, sf_dir):
    """Every event comes twice: at once or a second later, some without an id."""
    rule = Rule("failure", "failure", "single", conditions=kind_is("AUTH_FAILURE"), group_by=("source_ip",))
    k = F.col("metadata")["k"].cast("bigint")
    twice = security_events(spark, sf_dir).withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    twice = twice.withColumn("timestamp", F.timestamp_micros(us("timestamp") + F.when(k % 5 == 0, F.col("n") * 1_000_000).otherwise(0)))
    twice = twice.withColumn("event_id", F.when(k % 4 == 0, "").otherwise(F.col("event_id"))).drop("n")
    fired = evaluate(twice, [rule], dedup=True)
    return fired.groupBy(F.col("group_key").alias("key"), "event_id", us("timestamp").alias("ts_us")).agg(F.count(F.lit(1)).alias("fires"))


MANY_RULES = 2_000


def many_rules() -> list[Rule]:
    """Four kinds of rules in turn, each for one user: a failure, a name in the message, two failures in three days,
    and a failure followed by something else."""
    rules = []
    for i in range(MANY_RULES):
        user = Condition("user", "eq", f"user-{i}")
        if i % 4 == 0:
            rules.append(Rule(f"r{i}", "n", "single", conditions=(*kind_is("AUTH_FAILURE"), user), group_by=("user",)))
        elif i % 4 == 1:
            rules.append(Rule(f"r{i}", "n", "single", conditions=(Condition("raw_message", "contains", f"user-{i}"),), group_by=("user",)))
        elif i % 4 == 2:
            rules.append(Rule(f"r{i}", "n", "threshold", conditions=(*kind_is("AUTH_FAILURE"), user), group_by=("user",), threshold=2, window_micros=3 * DAY))
        else:
            steps = (Step((user, *kind_is("AUTH_FAILURE"))), Step((user, Condition("type", "neq", FAILURE))))
            rules.append(Rule(f"r{i}", "n", "sequence", steps=steps, group_by=("user",), window_micros=5 * DAY))
    return rules


@query(
    "rules_by_index",
    with_events(
        f"""SELECT 'r' || user_id AS rule_id, user_name AS group_key, event_id FROM ev WHERE user_id % 4 = 0 AND type = '{FAILURE}' AND user_id < {MANY_RULES}
 UNION ALL SELECT 'r' || i, user_name, event_id FROM ev, (SELECT unnest(range(1, {MANY_RULES}, 4)) AS i) WHERE contains(raw_message, 'user-' || i)
 UNION ALL SELECT 'r' || substr(key, 6), key, id FROM walk1 WHERE fired UNION ALL SELECT 'r' || substr(key, 6), key, id FROM walk2 WHERE fired""",
        sqltext.threshold(f"SELECT user_name AS key, ts_us AS ts, event_id AS id FROM ev WHERE user_id % 4 = 2 AND type = '{FAILURE}' AND user_id < {MANY_RULES}", 3 * DAY, 2).replace("walk", "walk1").replace("num ", "num1 ")
        + ", "
        + sqltext.sequence(f"SELECT user_name AS key, ts_us AS ts, event_id AS id, type = '{FAILURE}' AS s0, type <> '{FAILURE}' AS s1 FROM ev WHERE user_id % 4 = 3 AND user_id < {MANY_RULES}", 5 * DAY, [1, 1]).replace("walk", "walk2").replace("num ", "num2 "),
    ),
)
def rules_by_index(spark, sf_dir):
    """Two thousand rules; an event is tested only against those its user or its message lead to."""
    return evaluate(security_events(spark, sf_dir), many_rules(), carried=()).select("rule_id", "group_key", "event_id")


@query(
    "rules_over_null_ids",
    with_events(
        """SELECT key AS agent_id, count(*) FILTER (fired) AS fires FROM walk GROUP BY key""",
        sqltext.threshold(f"SELECT agent_id AS key, ts_us AS ts, CASE WHEN k % 3 = 0 THEN '' ELSE event_id END AS id FROM ev WHERE type = '{FAILURE}'", 3_600_000_000, 3),
    ),
)
def rules_over_null_ids(spark, sf_dir):
    """A third of the events have no id; they are no copies of each other, in busy groups as in others."""
    rule = Rule("t", "t", "threshold", conditions=kind_is("AUTH_FAILURE"), group_by=("agent_id",), threshold=3, window_micros=3_600_000_000)
    events = security_events(spark, sf_dir)
    k = F.col("metadata")["k"].cast("bigint")
    events = events.withColumn("event_id", F.when(k % 3 != 0, F.col("event_id")))
    fired = evaluate(events, [rule], dedup=True, hot_rows=500, chunk_rows=200)
    counts = fired.groupBy("group_key").agg(F.count(F.lit(1)).alias("fires")).withColumnRenamed("group_key", "of")
    agents = events.filter(F.col("type") == FAILURE).select("agent_id").distinct()
    return agents.join(counts, F.col("agent_id") == F.col("of"), "left").select("agent_id", F.coalesce("fires", F.lit(0)).alias("fires"))


# ---- the whole path ------------------------------------------------------------------------------------

ERROR_BURST = sqltext.threshold(ERRORS_SQL, 3 * DAY, 3)
SSHD_BURST = sqltext.threshold(
    f"SELECT source_ip || '|' || hostname AS key, ts_us AS ts, event_id AS id FROM ev WHERE type = '{FAILURE}' AND service = 'sshd'", DAY, 2
)
CHAIN = sqltext.sequence(SEQ_SQL, 3 * DAY, [2, 1, 1])


def _renamed(sql: str, suffix: str) -> str:
    return sql.replace("walk", f"walk{suffix}").replace("num ", f"num{suffix} ")


# The rules of the example folder; expects the enriched threat category in ``ev``.
FIRED_SQL = (
    f"{_renamed(ERROR_BURST, '1')}, {_renamed(SSHD_BURST, '2')}, {_renamed(CHAIN, '3')}, "
    """fired AS (
 SELECT 'error-burst' AS rule_id, 'Repeated login failures' AS rule_name, 'HIGH' AS raw_severity, 'SEVERITY_HIGH' AS severity, key AS group_key, id AS event_id, 3::BIGINT AS event_count, '["brute_force","login"]' AS tags FROM walk1 WHERE fired
 UNION ALL SELECT 'error-burst-sshd', 'Repeated ssh login failures', 'urgent', 'SEVERITY_MEDIUM', key, id, 2, '["ssh"]' FROM walk2 WHERE fired
 UNION ALL SELECT 'kill-chain', 'Failures, login, escalation', 'CRITICAL', 'SEVERITY_CRITICAL', key, id, 3, '["kill_chain"]' FROM walk3 WHERE fired
 UNION ALL SELECT 'listed-login', 'Login failure from a listed exit node', 'HIGH', 'SEVERITY_HIGH', source_ip, event_id, 1, '["tor","login"]' FROM ev WHERE type = 'EVENT_TYPE_AUTH_FAILURE' AND threat_hit = 'tor_exit'
 UNION ALL SELECT 'root-shell', 'Root shell <opened> & logged', 'LOW', 'SEVERITY_LOW', '', event_id, 1, 'null' FROM ev WHERE regexp_matches(raw_message, 'USER=root$') AND service <> 'nginx'
), alr AS (
 SELECT f.*, e.ts_us, e.k, e.threat_hit, e.is_private, sha256(f.rule_id || chr(1) || f.group_key || chr(1) || f.event_id) AS alert_id,
 'Rule ''' || f.rule_name || ''' fired for group ''' || f.group_key || ''' (' || f.event_count || ' events)' AS description FROM fired f JOIN ev e ON e.event_id = f.event_id)"""
)


def example_rules(spark):
    return load_rules(RULES_DIR)


def all_alerts(spark, sf_dir) -> DataFrame:
    return run_pipeline(security_events(spark, sf_dir), example_rules(spark), threats(spark, sf_dir)).alerts


@query("rules_in_one_pass", with_events("SELECT rule_id, severity, group_key, event_id, event_count FROM fired", FIRED_SQL))
def rules_in_one_pass(spark, sf_dir):
    ready = enriched_events(security_events(spark, sf_dir), standard_enrichers(threats(spark, sf_dir)))
    return evaluate(ready, example_rules(spark)).select("rule_id", "severity", "group_key", "event_id", "event_count")


@query(
    "alerts",
    with_events(
        """SELECT alert_id, rule_id, rule_name, severity, ts_us AS created_us, description, group_key, event_count, event_id AS first_event, tags,
 CASE WHEN is_private THEN 'PRIVATE' ELSE 'UNKNOWN' END AS geo_country, coalesce(threat_hit, '') AS threat_category FROM alr""",
        FIRED_SQL,
    ),
)
def alerts_query(spark, sf_dir):
    e = F.col("enrichment")
    return all_alerts(spark, sf_dir).select(
        "alert_id", "rule_id", "rule_name", "severity", us("created_at").alias("created_us"), "description", F.col("group_values")["group_key"].alias("group_key"),
        "event_count", F.element_at("event_ids", 1).alias("first_event"), F.when(F.size("tags") > 0, F.to_json("tags")).otherwise("null").alias("tags"),
        e["geo_country"].alias("geo_country"), F.coalesce(e["threat_category"], F.lit("")).alias("threat_category"),
    )


@query(
    "event_pipeline",
    with_events(
        f"""SELECT 'event' AS kind, type AS name, {SEVERITY_SQL} AS severity, count(*) AS n FROM ev GROUP BY ALL
 UNION ALL SELECT 'alert', rule_id, severity, count(*) FROM fired GROUP BY ALL""",
        FIRED_SQL,
    ),
)
def event_pipeline(spark, sf_dir):
    """Redelivered copies of every tenth event count once in the rules and once in the table."""
    events = security_events(spark, sf_dir)
    twice = events.unionByName(events.filter(F.col("source_port") % 10 == 0))
    out = run_pipeline(twice, example_rules(spark), threats(spark, sf_dir))
    stored = persist.first_by(persist.event_rows(out.events), "event_id", "timestamp")
    table = stored.groupBy(F.lit("event").alias("kind"), F.col("event_type").alias("name"), "severity").agg(F.count(F.lit(1)).alias("n"))
    raised = out.alerts.groupBy(F.lit("alert").alias("kind"), F.col("rule_id").alias("name"), "severity").agg(F.count(F.lit(1)).alias("n"))
    return table.unionByName(raised)


@query("alert_counts", with_events("SELECT rule_id, severity, count(*) AS alerts, sum(event_count)::BIGINT AS events FROM fired GROUP BY ALL", FIRED_SQL))
def alert_counts_query(spark, sf_dir):
    return alert_counts(all_alerts(spark, sf_dir))


@query(
    "insert_if_absent",
    with_events(
        f"""SELECT event_id, type AS event_type, {SEVERITY_SQL} AS severity, hostname, source_ip, service, ts_us FROM ev
 WHERE ts_us >= (SELECT (min(ts_us) // {DAY} + 10) * {DAY} FROM ev)"""
    ),
)
def insert_if_absent_query(spark, sf_dir):
    """The first ten days are stored; all days arrive, every event twice, the copy a second later."""
    ready = persist.event_rows(enriched_events(security_events(spark, sf_dir), standard_enrichers(threats(spark, sf_dir))))
    copies = F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")
    incoming = ready.select("*", copies).withColumn("timestamp", F.timestamp_micros(us("timestamp") + F.col("copy") * 1_000_000)).drop("copy")
    first_day = ready.agg((F.floor(F.min(us("timestamp")) / DAY) + 10).alias("cut"))
    stored = ready.join(F.broadcast(first_day), us("timestamp") < F.col("cut") * DAY).select(*ready.columns)  # one row
    return persist.absent_rows(incoming, stored).select("event_id", "event_type", "severity", "hostname", "source_ip", "service", us("timestamp").alias("ts_us"))


def stored_events(spark, sf_dir) -> DataFrame:
    """The events inserted through the index of keys in three parts that overlap, the last one twice; read again."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/events-{uuid.uuid4().hex}"
    ready = persist.event_rows(security_events(spark, sf_dir))
    number = F.pmod(F.xxhash64("event_id"), F.lit(10))
    for part in (number < 4, number.between(2, 6), number > 4, number > 4):
        KeyIndex(spark, path, bucket_keys=1_024).insert(ready.filter(part), F.col("timestamp"))
    return spark.read.parquet(path)


@query("insert_by_index", with_events("SELECT event_id, type AS event_type, hostname, source_ip, service, ts_us FROM ev"))
def insert_by_index(spark, sf_dir):
    return stored_events(spark, sf_dir).select("event_id", "event_type", "hostname", "source_ip", "service", us("timestamp").alias("ts_us"))


@query(
    "stored_access_paths",
    with_events(
        """SELECT 'source' AS path, event_id, type AS event_type FROM ev WHERE source_ip = '10.0.0.10'
 UNION ALL SELECT 'host', event_id, type FROM ev WHERE hostname = 'host-4'
 UNION ALL SELECT 'time', event_id, type FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-11 18:30:00'"""
    ),
)
def stored_access_paths(spark, sf_dir):
    """A source, a host and a range of time over the written table."""
    from ravelin.functions.times import parse_rfc3339

    table = stored_events(spark, sf_dir)
    parts = {
        "source": persist.from_source(table, "10.0.0.10"),
        "host": persist.on_host(table, "host-4"),
        "time": persist.in_time_range(table, parse_rfc3339("2024-01-10T06:00:00Z"), parse_rfc3339("2024-01-11T18:30:00Z")),
    }
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("path"), "event_id", "event_type") for name, rows in parts.items()])


@query("publish_alert_records", with_events("SELECT 'alerts' AS topic, rule_id AS key, count(*) AS records FROM fired GROUP BY ALL", FIRED_SQL))
def publish_alert_records(spark, sf_dir):
    records = alert_records(A.notification_payload(all_alerts(spark, sf_dir)), "payload")
    return records.groupBy("topic", F.col("key").cast("string").alias("key")).agg(F.count("value").alias("records"))


# ---- alert management ----------------------------------------------------------------------------------


def error_alerts(spark, sf_dir) -> DataFrame:
    """One alert per login failure, grouped by source."""
    rule = Rule("failure", "failure", "single", conditions=kind_is("AUTH_FAILURE"), group_by=("source_ip",), severity="HIGH")
    return A.to_alerts(evaluate(security_events(spark, sf_dir), [rule]))


FAILURE_ALERTS_SQL = f"""fal AS (SELECT 'failure|' || source_ip AS key, ts_us AS ts, sha256('failure' || chr(1) || source_ip || chr(1) || event_id) AS id, event_id
 FROM ev WHERE type = '{FAILURE}')"""


@query(
    "suppression",
    with_events("SELECT id AS alert_id, kept FROM walk WHERE rn > 0", f"{FAILURE_ALERTS_SQL}, {sqltext.first_per_window('SELECT key, ts, id FROM fal', DAY, True)}"),
)
def suppression(spark, sf_dir):
    return A.suppress(error_alerts(spark, sf_dir), "24h").select("alert_id", "kept")


HALF_HOUR = 1_800_000_000


@query(
    "token_bucket_global",
    with_events("SELECT id AS event_id, allowed FROM admitted", sqltext.token_bucket("SELECT 0 AS key, ts_us AS ts, event_id AS id FROM ev", HALF_HOUR, 5)),
)
def token_bucket_global(spark, sf_dir):
    rows = spark_events(spark, sf_dir).select("event_id", "ts_us")
    return A.token_bucket(rows, "ts_us", "event_id", HALF_HOUR, 5).select("event_id", "allowed")


@query(
    "token_bucket_of_copies",
    with_events(
        "SELECT id AS event_id, count(*) FILTER (allowed) AS admitted FROM admitted GROUP BY id",
        sqltext.token_bucket("SELECT 0 AS key, ts_us AS ts, event_id AS id FROM ev CROSS JOIN (VALUES (0), (1), (2)) c(n)", HALF_HOUR, 5),
    ),
)
def token_bucket_of_copies(spark, sf_dir):
    """Every row three times: each takes a token of its own."""
    rows = spark_events(spark, sf_dir).select("event_id", "ts_us", F.explode(F.array(F.lit(0), F.lit(0), F.lit(0))).alias("tick"))
    out = A.token_bucket(rows, "ts_us", "event_id", HALF_HOUR, 5)
    return out.groupBy("event_id").agg(F.count_if("allowed").alias("admitted"))


@query(
    "token_bucket_in_parts",
    with_events("SELECT id AS event_id, allowed FROM admitted", sqltext.token_bucket("SELECT type AS key, ts_us AS ts, event_id AS id FROM ev", HALF_HOUR, 3)),
)
def token_bucket_in_parts(spark, sf_dir):
    """The table in parts of seven days in order, as micro-batches take it; the buckets go on from part to part."""
    rows = spark_events(spark, sf_dir).select("event_id", "ts_us", "type")
    low, high = rows.agg(F.floor(F.min("ts_us") / DAY), F.floor(F.max("ts_us") / DAY)).first()
    state, parts = None, []
    for day in range(low, high + 1, 7):
        part = rows.filter(F.floor(F.col("ts_us") / DAY).between(day, day + 6))
        out, state = A.token_bucket_from(part, state, "ts_us", "event_id", HALF_HOUR, 3, ["type"])
        parts.append(out.select("event_id", "allowed"))
        state = materialise(state)
    return reduce(DataFrame.unionByName, parts)


@query(
    "token_bucket_per_type",
    with_events("SELECT id AS event_id, allowed FROM admitted", sqltext.token_bucket("SELECT type AS key, ts_us AS ts, event_id AS id FROM ev", HALF_HOUR, 3)),
)
def token_bucket_per_type(spark, sf_dir):
    rows = spark_events(spark, sf_dir).select("event_id", "ts_us", "type")
    return A.token_bucket(rows, "ts_us", "event_id", HALF_HOUR, 3, ["type"], ticks_per_chunk=64).select("event_id", "allowed")


DECIDE_SQL = (
    f"{FAILURE_ALERTS_SQL}, {sqltext.first_per_window('SELECT key, ts, id FROM fal', DAY, True)}, "
    + sqltext.token_bucket("SELECT 0 AS key, ts, id FROM walk WHERE kept", 4 * HALF_HOUR, 4)
    + """, dec AS (SELECT w.id AS alert_id, w.ts, CASE WHEN NOT w.kept THEN 'suppressed' WHEN a.allowed THEN 'sent' ELSE 'rate_limited' END AS decision
 FROM walk w LEFT JOIN admitted a ON a.id = w.id WHERE w.rn > 0)"""
)


def decided(spark, sf_dir):
    return A.decide(error_alerts(spark, sf_dir), "24h", interval_micros=4 * HALF_HOUR, capacity=4)


@query("alert_decisions", with_events("SELECT alert_id, decision FROM dec", DECIDE_SQL))
def alert_decisions(spark, sf_dir):
    return decided(spark, sf_dir).select("alert_id", "decision")


STAMP_SQL = "strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%SZ')"
PAYLOAD_SQL = f"""pay AS (SELECT *, '{{"alert_id":"' || alert_id || '","created_at":"' || {STAMP_SQL} || '","description":"' || replace(replace(replace(description, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e')
 || '","enrichment":{{"geo_country":"' || CASE WHEN is_private THEN 'PRIVATE' ELSE 'UNKNOWN' END || '","geo_is_private":"' || CASE WHEN is_private THEN 'true' ELSE 'false' END
 || '","k":"' || k || CASE WHEN threat_hit IS NOT NULL THEN '","threat_category":"' || threat_hit ELSE '' END || '","threat_known":"' || CASE WHEN threat_hit IS NOT NULL THEN 'true' ELSE 'false' END
 || '"}},"event_count":' || event_count || ',"group":{{"group_key":"' || group_key || '"}},"rule_id":"' || rule_id || '","rule_name":"'
 || replace(replace(replace(rule_name, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') || '","severity":"' || severity || '","tags":' || tags || '}}' AS payload FROM alr)"""


@query("notification_payload", with_events("SELECT alert_id, payload FROM pay", f"{FIRED_SQL}, {PAYLOAD_SQL}"))
def notification_payload_query(spark, sf_dir):
    return A.notification_payload(all_alerts(spark, sf_dir)).select("alert_id", "payload")


@query(
    "alert_routing",
    with_events("SELECT alert_id, 'alerts.dispatch' AS subject, 'alerts.' || lower(replace(severity, 'SEVERITY_', '')) AS severity_subject FROM alr", FIRED_SQL),
)
def alert_routing(spark, sf_dir):
    both = A.route(A.route(all_alerts(spark, sf_dir), True).withColumnRenamed("subject", "severity_subject"))
    return both.select("alert_id", "subject", "severity_subject")


# ---- delivery ------------------------------------------------------------------------------------------

SECRET = "correct horse battery staple"
LONG_SECRET = "s" * 100
CHANNELS = [
    delivery.Channel("log"),
    delivery.Channel("webhook", "https://hooks.example/alerts", SECRET),
    delivery.Channel("pager", "https://pager.example/v1", LONG_SECRET),
    delivery.Channel("unset", ""),
]


def tasks(spark, sf_dir):
    return delivery.delivery_tasks(A.notification_payload(all_alerts(spark, sf_dir)), CHANNELS)


def _hmac_sql(secret: str) -> str:
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()
    return f"'sha256=' || sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode(payload))))"


@query(
    "delivery_tasks",
    with_events(
        f"""SELECT alert_id, channel, url, CASE channel WHEN 'webhook' THEN {_hmac_sql(SECRET)} WHEN 'pager' THEN {_hmac_sql(LONG_SECRET)} ELSE '' END AS signature, 'application/json' AS content_type
 FROM pay CROSS JOIN (VALUES ('log', ''), ('webhook', 'https://hooks.example/alerts'), ('pager', 'https://pager.example/v1'), ('unset', '')) c(channel, url)""",
        f"{FIRED_SQL}, {PAYLOAD_SQL}",
    ),
)
def delivery_tasks_query(spark, sf_dir):
    h = F.col("headers")
    return tasks(spark, sf_dir).select(
        "alert_id", "channel", "url", F.coalesce(h["X-Alert-Signature"], F.lit("")).alias("signature"), h["Content-Type"].alias("content_type")
    )


# Recorded attempts: how many are made and with which status follows from the event number.
TRIES_SQL = """tsk AS (SELECT id AS alert_id, event_id::BIGINT AS no, ts FROM fal), tries AS (
 SELECT t.alert_id, c.channel, a.attempt, CASE WHEN (no + a.attempt + length(c.channel)) % 4 = 0 THEN 200 WHEN no % 5 = 0 THEN 299 + a.attempt ELSE 503 END AS status, ts + a.attempt * 1000000 AS tried
 FROM tsk t CROSS JOIN (VALUES ('webhook'), ('pager')) c(channel) CROSS JOIN (VALUES (1), (2), (3)) a(attempt) WHERE a.attempt <= 1 + no % 3 OR no % 2 = 0
), folded AS (SELECT alert_id, channel, min(attempt) FILTER (status < 300) AS ok, max(attempt) AS last, arg_max(status, attempt) AS last_status,
 arg_min(tried, attempt) FILTER (status < 300) AS ok_at, max(tried) AS last_at FROM tries GROUP BY ALL
), rec AS (SELECT t.alert_id, c.channel, t.ts, CASE WHEN c.channel = 'unset' OR ok IS NOT NULL THEN 'sent' WHEN last >= 3 THEN 'dlq' ELSE 'failed' END AS status,
 coalesce(ok_at, last_at) AS attempted_us, coalesce(ok, last, 0)::BIGINT AS attempts,
 CASE WHEN c.channel = 'unset' OR ok IS NOT NULL THEN '' WHEN last >= 3 THEN 'max retry attempts reached: webhook returned status ' || last_status ELSE 'webhook returned status ' || last_status END AS error
 FROM tsk t CROSS JOIN (VALUES ('webhook'), ('pager'), ('unset')) c(channel) LEFT JOIN folded f ON f.alert_id = t.alert_id AND f.channel = c.channel)"""


def recorded(spark, sf_dir):
    alerts = error_alerts(spark, sf_dir)
    work = delivery.delivery_tasks(A.notification_payload(alerts), [c for c in CHANNELS if c.name != "log"])
    number = F.element_at("event_ids", 1).cast("bigint")
    shape = alerts.select("alert_id", "created_at", number.alias("no"))
    tries = (
        shape.withColumn("channel", F.explode(F.array(F.lit("webhook"), F.lit("pager"))))
        .withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
        .filter((F.col("attempt") <= 1 + F.col("no") % 3) | (F.col("no") % 2 == 0))
        .withColumn(
            "status",
            F.when((F.col("no") + F.col("attempt") + F.length("channel")) % 4 == 0, 200).when(F.col("no") % 5 == 0, 299 + F.col("attempt")).otherwise(503),
        )
        .withColumn("attempted_at", F.timestamp_micros(us("created_at") + F.col("attempt") * 1_000_000))
    )
    return delivery.receipts(work, tries)


@query("delivery_receipts", with_events("SELECT alert_id, channel, status, attempts, error, attempted_us FROM rec", f"{FAILURE_ALERTS_SQL}, {TRIES_SQL}"))
def delivery_receipts(spark, sf_dir):
    return recorded(spark, sf_dir).select("alert_id", "channel", "status", F.col("attempts").cast("bigint").alias("attempts"), "error", us("attempted_at").alias("attempted_us"))


@query(
    "retry_schedule",
    with_events(
        """SELECT alert_id, 'log' AS channel, a.attempt, a.wait_ms::BIGINT AS wait_ms, a.low AS wait_low_ms, a.high AS wait_high_ms, a.off::BIGINT AS offset_ms
 FROM alr CROSS JOIN (VALUES (1, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0), (2, 4000, 3000.0, 5000.0, 4000), (3, 8000, 6000.0, 10000.0, 12000), (4, 10000, 7500.0, 12500.0, 22000)) a(attempt, wait_ms, low, high, off)""",
        FIRED_SQL,
    ),
)
def retry_schedule_query(spark, sf_dir):
    work = delivery.delivery_tasks(A.notification_payload(all_alerts(spark, sf_dir)), [delivery.LOG_CHANNEL])
    return delivery.retry_schedule(work, attempts=4, base_ms=4000)


LETTER_SQL = """let AS (SELECT 'alerts.dispatch' AS original_topic, 'channel ' || channel || ': ' || error AS error, attempts::INTEGER AS attempts, attempted_us AS failed_us, alert_id FROM rec WHERE status = 'dlq')"""


def letters(spark, sf_dir):
    return delivery.dead_letters(recorded(spark, sf_dir))


def letter_columns(df):
    return df.select(
        "original_topic", "error", "attempts", us("failed_at").alias("failed_us"), delivery.payload_alert_id(F.col("value").cast("string")).alias("alert_id")
    )


@query(
    "dead_letters",
    with_events("SELECT *, 'topic=' || original_topic || ' attempts=' || attempts || ' error=' || error AS text FROM let", f"{FAILURE_ALERTS_SQL}, {TRIES_SQL}, {LETTER_SQL}"),
)
def dead_letters_query(spark, sf_dir):
    return letter_columns(letters(spark, sf_dir)).withColumn("text", delivery.format_error(F.col("original_topic"), F.col("error"), F.col("attempts")))


@query(
    "dead_letters_newest",
    with_events("SELECT * FROM let ORDER BY failed_us DESC, error DESC LIMIT 50", f"{FAILURE_ALERTS_SQL}, {TRIES_SQL}, {LETTER_SQL}"),
)
def dead_letters_newest(spark, sf_dir):
    return letter_columns(delivery.keep_newest(letters(spark, sf_dir), 50, ("failed_at", "error")))


@query(
    "dead_letter_drain",
    with_events("SELECT error, count(*) AS waiting FROM let WHERE error NOT LIKE 'channel pager%' GROUP BY ALL", f"{FAILURE_ALERTS_SQL}, {TRIES_SQL}, {LETTER_SQL}"),
)
def dead_letter_drain(spark, sf_dir):
    """Letters of one channel were processed again; the others wait."""
    waiting = letter_columns(letters(spark, sf_dir))
    done = waiting.filter(F.col("error").startswith("channel pager"))
    return delivery.drain(waiting, done, ["alert_id", "error"]).groupBy("error").agg(F.count(F.lit(1)).alias("waiting"))


@query("log_channel", with_events("SELECT alert_id, severity, payload FROM pay", f"{FIRED_SQL}, {PAYLOAD_SQL}"))
def log_channel(spark, sf_dir):
    return delivery.log_lines(A.notification_payload(all_alerts(spark, sf_dir)))


# ---- replay and forensics ------------------------------------------------------------------------------

START, END = "2024-01-05T00:00:00Z", "2024-01-20T12:00:00Z"
RANGE_SQL = "ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"
REPLAY_SQL = FIRED_SQL.replace("FROM ev WHERE", f"FROM ev WHERE {RANGE_SQL} AND")


@query(
    "replay_matches",
    with_events("SELECT rule_id, rule_name, raw_severity AS severity, group_key, event_count, ts_us AS record_us, event_id FROM alr", REPLAY_SQL),
)
def replay_matches(spark, sf_dir):
    out = replay(security_events(spark, sf_dir), START, END, example_rules(spark), standard_enrichers(threats(spark, sf_dir)))
    return out.matches.withColumn("record_us", us("record_time")).drop("record_time")


@query(
    "replay_without_enrichment",
    with_events("SELECT rule_id, count(*) AS matches FROM fired WHERE rule_id <> 'listed-login' GROUP BY ALL", REPLAY_SQL),
)
def replay_without_enrichment(spark, sf_dir):
    out = replay(security_events(spark, sf_dir), START, END, example_rules(spark))
    return out.matches.groupBy("rule_id").agg(F.count(F.lit(1)).alias("matches"))


@query(
    "replay_totals",
    with_events(f"SELECT (SELECT count(*) FROM ev WHERE {RANGE_SQL}) AS total_events, (SELECT count(*) FROM fired) AS total_matches", REPLAY_SQL),
)
def replay_totals(spark, sf_dir):
    return replay(security_events(spark, sf_dir), START, END, example_rules(spark), standard_enrichers(threats(spark, sf_dir))).totals


@query(
    "replay_of_records",
    with_events("SELECT rule_id, count(*) AS matches FROM fired WHERE rule_id <> 'listed-login' GROUP BY ALL", REPLAY_SQL.replace("FROM ev WHERE", "FROM ev WHERE raw_message <> '' AND")),
)
def replay_of_records(spark, sf_dir):
    """Encoded records, some damaged: those are skipped."""
    good = decode(records(spark, sf_dir, "json")).good
    return replay(good, START, END, example_rules(spark)).matches.groupBy("rule_id").agg(F.count(F.lit(1)).alias("matches"))


@query(
    "events_in_time_range",
    with_events("SELECT event_id, hostname, ts_us FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-11 18:30:00'"),
)
def events_in_time_range(spark, sf_dir):
    from ravelin.functions.times import parse_rfc3339

    events = security_events(spark, sf_dir)
    out = persist.in_time_range(events, parse_rfc3339("2024-01-10T06:00:00Z"), parse_rfc3339("2024-01-11T18:30:00Z"))
    return out.select("event_id", "hostname", us("timestamp").alias("ts_us"))


@query("events_of_source", with_events("SELECT event_id, source_ip, type FROM ev WHERE source_ip = '10.0.0.10'"))
def events_of_source(spark, sf_dir):
    return persist.from_source(security_events(spark, sf_dir), "10.0.0.10").select("event_id", "source_ip", "type")


@query("events_on_host", with_events("SELECT type, service, count(*) AS events FROM ev WHERE hostname = 'host-4' GROUP BY ALL"))
def events_on_host(spark, sf_dir):
    rows = persist.on_host(security_events(spark, sf_dir), "host-4")
    return rows.groupBy("type", "service").agg(F.count(F.lit(1)).alias("events"))


# ---- metrics -------------------------------------------------------------------------------------------

HOUR = 3_600_000_000
COUNTER_SQL = f"""cnt AS (SELECT type, service, ts_us // {HOUR} AS hour, count(*) AS n FROM ev GROUP BY ALL),
 smp AS (SELECT type, service, hour * {HOUR} AS ts, sum(n) OVER (PARTITION BY type, service, hour // 168 ORDER BY hour)::DOUBLE AS value FROM cnt)"""


def counter_samples(spark, sf_dir) -> DataFrame:
    """An events counter per type and service with a sample per busy hour; it restarts each week."""
    from pyspark.sql import Window

    counts = spark_events(spark, sf_dir).groupBy("type", "service", F.floor(F.col("ts_us") / HOUR).cast("bigint").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    week = Window.partitionBy("type", "service", F.floor(F.col("hour") / 168)).orderBy("hour")
    return counts.select("type", "service", (F.col("hour") * HOUR).alias("ts_us"), F.sum("n").over(week).cast("double").alias("value"))


def _rate_sql(window: int) -> str:
    seconds = window / 1_000_000
    return f"""SELECT type, service, ts AS ts_us, (sum(step) OVER w - first_value(step) OVER w) / {seconds}::DOUBLE AS rate
 FROM (SELECT *, CASE WHEN before IS NULL THEN 0 WHEN value >= before THEN value - before ELSE value END AS step
  FROM (SELECT *, lag(value) OVER (PARTITION BY type, service ORDER BY ts) AS before FROM smp))
 WINDOW w AS (PARTITION BY type, service ORDER BY ts RANGE BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"""


@query("counter_rate", with_events(_rate_sql(12 * HOUR), COUNTER_SQL))
def counter_rate_query(spark, sf_dir):
    return metrics.counter_rate(counter_samples(spark, sf_dir), ["type", "service"], window="12h").select("type", "service", "ts_us", "rate")


@query("alerts_per_minute", with_events(f"SELECT type, service, ts_us, rate * 60 AS per_minute FROM ({_rate_sql(24 * HOUR)})", COUNTER_SQL))
def alerts_per_minute(spark, sf_dir):
    rated = metrics.counter_rate(counter_samples(spark, sf_dir), ["type", "service"], window="24h")
    return rated.select("type", "service", "ts_us", (F.col("rate") * 60).alias("per_minute"))


BOUNDS_SQL = "(VALUES (0.001), (0.005), (0.01), (0.025), (0.05), (0.1), (0.25), (0.5), (1.0), (5.0), ('inf'::DOUBLE)) b(le)"
BUCKET_SQL = f"""obs AS (SELECT type, value / 20 AS seconds FROM ev), bkt AS (SELECT type, b.le::DOUBLE AS le, count(*) FILTER (seconds <= b.le::DOUBLE) AS count
 FROM obs CROSS JOIN {BOUNDS_SQL} GROUP BY ALL)"""


def latency_buckets(spark, sf_dir) -> DataFrame:
    observed = spark_events(spark, sf_dir).select("type", (F.col("value") / 20).alias("seconds"))
    return metrics.bucketize(observed, ["type"], "seconds")


@query("latency_histogram", with_events("SELECT type, CASE WHEN le = 'inf'::DOUBLE THEN -1 ELSE le END AS le, count FROM bkt", BUCKET_SQL))
def latency_histogram(spark, sf_dir):
    return latency_buckets(spark, sf_dir).withColumn("le", F.when(F.col("le") == metrics.INFINITE, -1.0).otherwise(F.col("le")))


def _quantile_sql(q: float) -> str:
    return f"""SELECT type, {q}::DOUBLE AS q, CASE WHEN le = 'inf'::DOUBLE THEN low ELSE low + (le - low) * (({q}::DOUBLE * total - under) / (count - under)) END AS quantile
 FROM (SELECT *, lag(le, 1, 0.0::DOUBLE) OVER w AS low, lag(count, 1, 0) OVER w AS under, max(count) OVER (PARTITION BY type) AS total FROM bkt WINDOW w AS (PARTITION BY type ORDER BY le))
 WHERE count >= {q}::DOUBLE * total AND under < {q}::DOUBLE * total"""


@query("latency_quantiles", with_events(" UNION ALL ".join(_quantile_sql(q) for q in (0.5, 0.95, 0.99)), BUCKET_SQL))
def latency_quantiles(spark, sf_dir):
    buckets = latency_buckets(spark, sf_dir)
    parts = [metrics.histogram_quantile(buckets, ["type"], q).withColumn("q", F.lit(q)) for q in (0.5, 0.95, 0.99)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SIX_HOURS = 6 * HOUR
RATE_BUCKETS_SQL = f"""slot AS (SELECT type, ts_us // {SIX_HOURS} AS slot, value / 20 AS seconds FROM ev), held AS (
 SELECT type, slot, b.le::DOUBLE AS le, count(*) FILTER (seconds <= b.le::DOUBLE) AS n FROM slot CROSS JOIN {BOUNDS_SQL} GROUP BY ALL
), grown AS (SELECT type, le, slot * {SIX_HOURS} AS ts, sum(n) OVER (PARTITION BY type, le ORDER BY slot)::DOUBLE AS value FROM held
), steps AS (SELECT *, coalesce(value - lag(value) OVER (PARTITION BY type, le ORDER BY ts), 0) AS step FROM grown
), bkt AS (SELECT type, ts AS ts_us, le, (sum(step) OVER w - first_value(step) OVER w) / 86400.0::DOUBLE AS count FROM steps
 WINDOW w AS (PARTITION BY type, le ORDER BY ts RANGE BETWEEN {24 * HOUR - 1} PRECEDING AND CURRENT ROW))"""


@query(
    "latency_quantiles_of_rate",
    with_events(
        " UNION ALL ".join(_quantile_sql(q).replace("SELECT type,", "SELECT type, ts_us,", 1).replace("PARTITION BY type", "PARTITION BY type, ts_us") for q in (0.5, 0.99)),
        RATE_BUCKETS_SQL,
    ),
)
def latency_quantiles_of_rate(spark, sf_dir):
    """Bucket counters are sampled every six hours; quantiles of what came in during a day."""
    from pyspark.sql import Window

    observed = spark_events(spark, sf_dir).select("type", F.floor(F.col("ts_us") / SIX_HOURS).cast("bigint").alias("slot"), (F.col("value") / 20).alias("seconds"))
    counts = metrics.bucketize(observed, ["type", "slot"], "seconds")
    grown = F.sum("count").over(Window.partitionBy("type", "le").orderBy("slot")).cast("double")
    samples = counts.select("type", "le", (F.col("slot") * SIX_HOURS).alias("ts_us"), grown.alias("value"))
    return metrics.quantile_of_rate(samples, ["type"], [0.5, 0.99], window="24h").filter("quantile IS NOT NULL")


@query("gauge_latest", with_events("SELECT hostname, service, arg_max(k, ts_us)::DOUBLE AS value, max(ts_us) AS ts_us FROM ev GROUP BY ALL"))
def gauge_latest(spark, sf_dir):
    samples = spark_events(spark, sf_dir).select("hostname", "service", "ts_us", F.col("k").cast("double").alias("value"))
    return metrics.latest(samples, ["hostname", "service"])


# ---- reports -------------------------------------------------------------------------------------------


@query(
    "baseline_anomalies",
    with_events(
        """SELECT hostname, bucket, events, mean, deviation, (events - mean) / deviation AS score FROM (
 SELECT *, c + s / 12.0::DOUBLE AS mean, sqrt(greatest(s2 - s * s / 12.0::DOUBLE, 0) / 11.0::DOUBLE) AS deviation FROM (
  SELECT *, coalesce(sum(events - c) OVER w, 0)::DOUBLE - (12 - count(*) OVER w) * c AS s, coalesce(sum((events - c) * (events - c)) OVER w, 0)::DOUBLE + (12 - count(*) OVER w) * c * c AS s2,
  min(bucket) OVER (PARTITION BY hostname) AS first FROM (SELECT *, floor(avg(events) OVER (PARTITION BY hostname)) AS c FROM hr)
  WINDOW w AS (PARTITION BY hostname ORDER BY bucket RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING)))
 WHERE bucket >= first + 12 AND deviation > 0 AND (events - mean) / deviation > 1.5""",
        f"hr AS (SELECT hostname, ts_us // {2 * HOUR} AS bucket, count(*) AS events FROM ev GROUP BY ALL)",
    ),
)
def baseline_anomalies_query(spark, sf_dir):
    rows = spark_events(spark, sf_dir).select("hostname", "ts_us")
    return analytics.baseline_anomalies(rows, ["hostname"], "ts_us", "2h", 12, 1.5)


@query(
    "delivery_analytics",
    with_events(
        f"""SELECT channel, ts // {DAY} AS day, count(*) AS deliveries, count(*) FILTER (status <> 'sent') AS failures,
 count(*) FILTER (status <> 'sent')::DOUBLE / count(*)::DOUBLE AS failure_rate, sum(attempts)::BIGINT AS attempts FROM rec GROUP BY ALL""",
        f"{FAILURE_ALERTS_SQL}, {TRIES_SQL}",
    ),
)
def delivery_analytics_query(spark, sf_dir):
    created = error_alerts(spark, sf_dir).select("alert_id", F.floor(us("created_at") / DAY).cast("bigint").alias("created_day"))
    done = recorded(spark, sf_dir).withColumn("attempts", F.col("attempts").cast("bigint")).join(created, "alert_id")
    return analytics.delivery_analytics(done, F.col("created_day"))


@query(
    "alert_page",
    with_events(
        """SELECT alert_id, ts_us AS created_us, rule_id FROM alr WHERE ts_us > epoch_us(TIMESTAMP '2024-01-10 00:00:00') OR (ts_us = epoch_us(TIMESTAMP '2024-01-10 00:00:00') AND alert_id > '8')
 ORDER BY created_us, alert_id LIMIT 40""",
        FIRED_SQL,
    ),
)
def alert_page(spark, sf_dir):
    after = (F.lit("2024-01-10 00:00:00").cast("timestamp"), F.lit("8"))
    return A.page(all_alerts(spark, sf_dir), 40, after).select("alert_id", us("created_at").alias("created_us"), "rule_id")


@query(
    "sla_compliance",
    with_events(
        """SELECT severity, count(*) AS deliveries, CASE WHEN max(target) IS NOT NULL THEN count(*) FILTER (delay <= target) END AS within_target,
 CASE WHEN max(target) IS NOT NULL THEN count(*) FILTER (delay <= target)::DOUBLE / count(*)::DOUBLE END AS compliance
 FROM (SELECT severity, k * 1000000 AS delay, CASE severity WHEN 'SEVERITY_CRITICAL' THEN 30000000 WHEN 'SEVERITY_HIGH' THEN 60000000 WHEN 'SEVERITY_MEDIUM' THEN 90000000 END AS target FROM alr)
 GROUP BY severity""",
        FIRED_SQL,
    ),
)
def sla_compliance_query(spark, sf_dir):
    delayed = all_alerts(spark, sf_dir).select("severity", (F.col("enrichment")["k"].cast("bigint") * 1_000_000).alias("delay_us"))
    return analytics.sla_compliance(delayed, {"SEVERITY_CRITICAL": 30_000_000, "SEVERITY_HIGH": 60_000_000, "SEVERITY_MEDIUM": 90_000_000})


@query(
    "alerts_by_priority",
    with_events(
        """SELECT alert_id, severity, ts_us AS created_us, row_number() OVER (ORDER BY CASE severity WHEN 'SEVERITY_CRITICAL' THEN 0 WHEN 'SEVERITY_HIGH' THEN 1 WHEN 'SEVERITY_MEDIUM' THEN 2 ELSE 3 END, ts_us, alert_id) AS place FROM alr""",
        FIRED_SQL,
    ),
)
def alerts_by_priority(spark, sf_dir):
    return A.by_priority(all_alerts(spark, sf_dir)).select("alert_id", "severity", us("created_at").alias("created_us"), "place")


@query("alert_times", with_events(f"SELECT alert_id, {STAMP_SQL} AS created_at FROM alr", FIRED_SQL))
def alert_times(spark, sf_dir):
    return all_alerts(spark, sf_dir).select("alert_id", rfc3339(F.col("created_at")).alias("created_at"))
