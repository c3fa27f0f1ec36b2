"""Behavioural profiles and anomaly detection.

The order of records matters (who trains a profile, who comes first).  Every record carries ``seq``, one fixed-width number
that packs phase (0 is the explicit training set), time and record id, so the first or last of a group is a plain minimum or
maximum that hashes and combines map-side: nothing sorts the records.  Records of one number are identical.

The training window of an endpoint is found by selection: counts per (endpoint, slice of time) tell in which slice it fills, and
only records of that slice are ranked, after each task has dropped those that cannot be among the first.  The traffic is then
folded into an *activity* table with one row per (endpoint, source, resource id).  All six detectors work on that table.  No
detector orders or collects the rows of a group.
"""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelens.functions.paths import anomaly_source, endpoint_name, resource_id
from routelens.functions.pytext import percent, whole
from routelens.functions.times import seconds_between
from routelens.plans.shared import broadcast_if_small, materialize, spread_join, top_k_per_group, union_all

# Detector thresholds and scores.
TRAINING_WINDOW = 1000
BOLA_IDS = 20
OUTLIER_DEVIATIONS = 3.0
AUTH_FAILURE_RATE = 0.8
AUTH_FAILURE_REQUESTS = 10
RATE_REQUESTS = 5
RATE_MEDIUM_RPM = 100
RATE_HIGH_RPM = 500
ENUMERATION_IDS = 10
ENUMERATION_SHARE = 0.7
NEW_CONSUMER_SCORE = 0.3
SAMPLE_IDS = 5

ENDPOINT = ["method", "path_pattern"]
PAIR = [*ENDPOINT, "source"]
#: A slice of time in which training windows are looked for is 2**36 microseconds, some 19 hours.
SLICE_BITS = 36


def _micros(at: Column) -> Column:
    """A wall clock as microseconds, independent of the session zone; NULL is before all."""
    days = F.unix_date(at.cast("date")).cast("bigint")
    second = (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("bigint")
    return F.coalesce(((days * 24 + F.hour(at)) * 60 + F.minute(at)) * 60_000_000 + second, F.lit(-(2**56)))


def _sequence(phase: int) -> Column:
    """Phase, time and record id in one number; even, so that there is room after each."""
    wide = lambda c: c.cast("decimal(38,0)")
    number = lambda n: F.lit(Decimal(n))
    record = F.coalesce(wide(F.col("record_id")) + number(2**63 + 1), wide(number(0)))
    return wide((wide(_micros(F.col("timestamp"))) * number(2**65) + record) * number(2) + number(phase * 2**125))


def observations(traffic: DataFrame, phase: int = 1) -> DataFrame:
    """Traffic with ``path_pattern`` -> the narrow rows profiles and detectors need."""
    return traffic.select(
        "method",
        "path_pattern",
        anomaly_source(F.col("source_ip"), F.col("source_service")).alias("source"),
        resource_id(F.col("path"), F.col("path_pattern")).alias("resource_id"),
        "status_code",
        F.col("response_time_ms").alias("latency"),
        F.lit(phase).alias("phase"),
        "timestamp",
        "record_id",
        _sequence(phase).alias("seq"),
    )


def recorded(rows: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """The narrow rows, and those of ``training``, written once, as training and scoring read them several times."""
    return materialize(rows if training is None else training.unionByName(rows), "records")


def _stats() -> list[Column]:
    return [
        F.count("*").alias("sample_count"),
        F.coalesce(F.avg("latency"), F.lit(0.0)).alias("avg_latency"),
        F.coalesce(F.stddev_pop("latency"), F.lit(0.0)).alias("std_latency"),
    ]


# ── Profiles ──


def train(rows: DataFrame, training_window: int = TRAINING_WINDOW) -> DataFrame:
    """Profile statistics over a whole training set; trained once it holds enough records."""
    stats = rows.groupBy(*ENDPOINT).agg(*_stats())
    return stats.withColumn("is_trained", F.col("sample_count") >= training_window)


def train_then_detect(rows: DataFrame, training_window: int = TRAINING_WINDOW) -> DataFrame:
    """Profiles as they stand when detection starts, with ``cut``, the number of the last training record of phase 1.

    All of an explicit training set (phase 0) trains.  An endpoint for which that is too small goes on
    training with its first analysed records up to and including the one that fills the window; only
    later records are scored.  ``cut_left`` tells whether records identical to the last one are left to be scored.
    """
    rows = rows.withColumn("slice", F.shiftright(_micros(F.col("timestamp")), SLICE_BITS))
    counts = rows.groupBy(*ENDPOINT, "slice").agg(
        F.count_if(F.col("phase") == 0).alias("given"), F.count_if(F.col("phase") == 1).alias("n")
    )
    upto = Window.partitionBy(*ENDPOINT).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    need = F.greatest(F.lit(0), training_window - F.sum("given").over(Window.partitionBy(*ENDPOINT)))
    take = F.least("n", need - F.coalesce(F.sum("n").over(upto), F.lit(0)))
    marks = counts.select(*ENDPOINT, "slice", "n", take.alias("take")).filter("take > 0")
    marks = broadcast_if_small(materialize(marks, "training-slices"))

    first = rows.filter("phase = 1").join(marks, [*ENDPOINT, "slice"])
    ranked = top_k_per_group(first.filter("take < n"), ENDPOINT, [F.col("seq")], training_window + 1)  # one slice per endpoint
    ranked = materialize(ranked.filter(F.col("_rank") <= F.col("take") + 1), "first-records")
    follows = ranked.groupBy(*ENDPOINT).agg(
        F.max(F.when(F.col("_rank") == F.col("take"), F.col("seq"))).alias("_cut"), F.max(F.when(F.col("_rank") > F.col("take"), F.col("seq"))).alias("_next")
    )
    learned = union_all(
        [
            x.select(*ENDPOINT, "latency", "timestamp", "seq", "phase")
            for x in (rows.filter("phase = 0"), first.filter("take = n"), ranked.filter(F.col("_rank") <= F.col("take")))
        ]
    )
    last = [F.max(F.when(F.col("phase") == 1, F.col("seq"))).alias("cut"), F.max_by("timestamp", "seq").alias("cut_at")]
    profiles = learned.groupBy(*ENDPOINT).agg(*_stats(), *last)
    left = F.coalesce(F.col("_next") == F.col("_cut"), F.lit(False)).alias("cut_left")
    profiles = profiles.join(follows, ENDPOINT, "left").select(*profiles.columns, left)
    return profiles.withColumn("is_trained", F.col("sample_count") >= training_window)


def _is_scored(cut: Column, cut_left: Column) -> Column:
    """Whether a record comes after the training of its endpoint."""
    return cut.isNull() | (F.col("seq") > cut) | ((F.col("seq") == cut) & cut_left)


def status_distribution(rows: DataFrame) -> DataFrame:
    """Calls per status code as a map per endpoint (status codes are a small closed set)."""
    counts = rows.groupBy(*ENDPOINT, "status_code").agg(F.count("*").alias("n"))
    entries = F.sort_array(F.collect_list(F.struct("status_code", "n")))
    return counts.groupBy(*ENDPOINT).agg(F.map_from_entries(entries).alias("status_codes"))


def known_consumers(rows: DataFrame) -> DataFrame:
    return rows.select(*PAIR).distinct()


def known_resource_ids(rows: DataFrame) -> DataFrame:
    return rows.filter("resource_id is not null").select(*PAIR, "resource_id").distinct()


def profile_summary(rows: DataFrame, training_window: int = TRAINING_WINDOW) -> DataFrame:
    """Sample count, trained flag, mean latency, consumers and status map per endpoint.

    One pass over the rows to the (endpoint, source, status) grain, which is written; the rest is
    rolled up from it.
    """
    grain = rows.groupBy(*PAIR, "status_code").agg(
        F.count("*").alias("n"), F.sum("latency").alias("ms"), F.count("latency").alias("timed")
    )
    grain = materialize(grain, "profile-grain")
    by_status = grain.groupBy(*ENDPOINT, "status_code").agg(F.sum("n").alias("n"))
    maps = by_status.groupBy(*ENDPOINT).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("status_code", "n")))).alias("status_codes")
    )
    totals = grain.groupBy(*ENDPOINT).agg(
        F.sum("n").alias("sample_count"),
        F.coalesce(F.sum("ms") / F.nullif(F.sum("timed"), F.lit(0)), F.lit(0.0)).alias("avg"),
        F.countDistinct("source").alias("known_consumers"),
    )
    summary = totals.join(maps, ENDPOINT).select(
        endpoint_name(F.col("method"), F.col("path_pattern")).alias("endpoint"),
        "sample_count",
        (F.col("sample_count") >= training_window).alias("is_trained"),
        F.round("avg", 2).alias("avg_latency_ms"),
        "known_consumers",
        "status_codes",
    )
    return summary.orderBy(F.desc("sample_count"), "endpoint")


# ── Activity ──


def activity(rows: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Fold records to one row per (endpoint, source, resource id).

    ``profiles``, a written table with one row per endpoint, says which records are scored.  A record
    whose endpoint has no profile is not scored, but counts for the source and enumeration detectors as
    any other.  Without profiles nothing is scored.

    Write the result before running detectors on it: their filters would otherwise be moved below
    the aggregation and evaluate paths and ids again on every raw row.
    """
    analysed = F.col("phase") == 1
    none = F.lit(None).cast("decimal(38,0)")
    if profiles is None:
        nothing = {"is_trained": F.lit(False), "avg_latency": F.lit(None).cast("double"), "std_latency": F.lit(None).cast("double")}
        joined = rows.withColumns(nothing | {"cut": none, "cut_left": F.lit(False)})
    else:
        known = {c: F.col(c) if c in profiles.columns else other for c, other in (("cut", none), ("cut_left", F.lit(False)))}
        wanted = profiles.select(*ENDPOINT, "is_trained", "avg_latency", "std_latency", *[x.alias(c) for c, x in known.items()])
        joined = spread_join(rows, wanted, ENDPOINT, F.xxhash64("seq"), "left")
    scored = analysed & F.coalesce(F.col("is_trained") & _is_scored(F.col("cut"), F.col("cut_left")), F.lit(False))
    after_equal = F.when(F.col("seq") == F.col("cut"), 1).otherwise(0)  # a scored record comes after an equal one that trained
    scored_at = (F.col("seq") + after_equal).cast("decimal(38,0)")
    z = F.when(F.col("std_latency") > 0, F.abs(F.col("latency") - F.col("avg_latency")) / F.col("std_latency"))
    far = scored & (z > OUTLIER_DEVIATIONS) & (F.col("latency") > F.col("avg_latency"))
    scored_seq, far_seq = F.when(scored, scored_at), F.when(far, scored_at)
    return joined.groupBy(*PAIR, "resource_id").agg(
        F.count_if(analysed).alias("requests"),
        F.count_if(analysed & F.col("status_code").isin(401, 403)).alias("auth_failures"),
        F.min(F.when(analysed, F.col("timestamp"))).alias("first_at"),
        F.max(F.when(analysed, F.col("timestamp"))).alias("last_at"),
        F.min("seq").alias("first_seq"),
        F.min_by("timestamp", "seq").alias("first_time"),
        F.min(scored_seq).alias("first_scored"),
        F.min_by("timestamp", scored_seq).alias("scored_time"),
        F.min(far_seq).alias("outlier_seq"),
        F.min_by("timestamp", far_seq).alias("outlier_time"),
        F.min_by("latency", far_seq).alias("outlier_latency"),
        F.max(F.when(F.col("is_trained"), F.col("avg_latency"))).alias("avg_latency"),
        F.max(F.when(F.col("is_trained"), F.col("std_latency"))).alias("std_latency"),
    )


def merge_activity(*tables: DataFrame) -> DataFrame:
    """Add activity tables of different batches up; the result is again an activity table."""
    return union_all(list(tables)).groupBy(*PAIR, "resource_id").agg(
        F.sum("requests").alias("requests"),
        F.sum("auth_failures").alias("auth_failures"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.min("first_seq").alias("first_seq"),
        F.min_by("first_time", "first_seq").alias("first_time"),
        F.min("first_scored").alias("first_scored"),
        F.min_by("scored_time", "first_scored").alias("scored_time"),
        F.min("outlier_seq").alias("outlier_seq"),
        F.min_by("outlier_time", "outlier_seq").alias("outlier_time"),
        F.min_by("outlier_latency", "outlier_seq").alias("outlier_latency"),
        F.max("avg_latency").alias("avg_latency"),
        F.max("std_latency").alias("std_latency"),
    )


# ── Detectors ──


def _anomaly(kind: str, severity, endpoint: Column, source: Column, message: Column, score: Column,
             timestamp: Column, details: dict[str, Column]) -> list[Column]:
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    body = F.create_map(*pairs) if pairs else F.lit(None)
    level = F.lit(severity) if isinstance(severity, str) else severity
    return [
        F.lit(kind).alias("anomaly_type"),
        level.alias("severity"),
        endpoint.alias("endpoint"),
        source.alias("source"),
        message.alias("message"),
        score.cast("double").alias("score"),
        timestamp.cast("timestamp_ntz").alias("timestamp"),
        body.cast("map<string,string>").alias("details"),
    ]


def _name() -> Column:
    return endpoint_name(F.col("method"), F.col("path_pattern"))


def latency_outliers(act: DataFrame) -> DataFrame:
    """First scored response per (endpoint, source) more than three deviations above the mean."""
    first = act.filter("outlier_seq is not null").groupBy(*PAIR).agg(
        F.min_by("outlier_latency", "outlier_seq").alias("seen"),
        F.min_by("outlier_time", "outlier_seq").alias("at"),
        F.max("avg_latency").alias("mean"),
        F.max("std_latency").alias("deviation"),
    )
    seen, mean = F.col("seen"), F.col("mean")
    z = F.abs(seen - mean) / F.col("deviation")
    message = F.concat(
        F.lit("Unusual response time on "), _name(), F.lit(": "), whole(seen), F.lit("ms vs avg "), whole(mean),
        F.lit("ms ("), F.format_string("%.1f", F.bround(z, 1)), F.lit(" std devs) — possible data exfiltration"),
    )
    details = {"observed_latency_ms": seen, "avg_latency_ms": mean, "z_score": F.round(z, 2)}
    return first.select(
        *_anomaly("data_exfiltration", "high", _name(), F.col("source"), message,
                  F.least(z / 10, F.lit(1.0)), F.col("at"), details)
    )


def bola(act: DataFrame, threshold: int = BOLA_IDS) -> DataFrame:
    """A source that reaches more than ``threshold`` distinct ids of one endpoint.

    Ids seen while training count.  The alarm is the first scored record with an id at which the
    number of distinct ids so far exceeds the threshold: either the record that brings the
    deciding id, or, when training had already passed the threshold, the first scored one.
    """
    ids = act.filter("resource_id is not null")
    trained_id = F.col("first_scored").isNull() | (F.col("first_seq") < F.col("first_scored"))
    pairs = ids.groupBy(*PAIR).agg(
        F.min("first_scored").alias("first_scored"),
        F.min_by("scored_time", "first_scored").alias("scored_time"),
        F.count_if(trained_id).alias("trained_ids"),
        F.count("*").alias("all_ids"),
        F.min(F.when(~trained_id, F.col("first_seq"))).alias("first_new"),
    )
    pairs = pairs.filter((F.col("all_ids") > threshold) & F.col("first_scored").isNotNull())
    # the earliest threshold + 1 ids of the pairs in question; all later ids cannot move the alarm
    wanted = ids.select(*PAIR, "resource_id", "first_seq", "first_time").join(pairs.select(*PAIR), PAIR, "left_semi")
    early = top_k_per_group(wanted, PAIR, [F.col("first_seq")], threshold + 1)
    crossing = early.groupBy(*PAIR).agg(
        F.max(F.when(F.col("_rank") == threshold + 1, F.col("first_time"))).alias("crossed"),
        F.sort_array(F.collect_list(F.when(F.col("_rank") <= SAMPLE_IDS, F.struct("_rank", "resource_id")))).alias("s"),
    )
    found = pairs.join(crossing, PAIR)
    while_training = F.col("trained_ids") > threshold
    fired = F.when(while_training, F.col("scored_time")).otherwise(F.col("crossed"))
    brings_new = F.when(F.col("first_new") == F.col("first_scored"), 1).otherwise(0)
    reached = F.when(while_training, F.col("trained_ids") + brings_new).otherwise(threshold + 1)
    message = F.concat(
        F.lit("Possible BOLA attack: "), F.col("source"), F.lit(" has accessed "), reached.cast("string"),
        F.lit(" unique resource IDs on "), _name(),
    )
    sample = F.array_join(F.transform("s", lambda x: x["resource_id"]), ",")
    details = {"unique_ids_accessed": reached, "threshold": F.lit(threshold), "sample_ids": sample}
    return found.select(
        *_anomaly("bola", "critical", _name(), F.col("source"), message,
                  F.least(reached / (threshold * 5), F.lit(1.0)), fired, details)
    )


def new_consumers(act: DataFrame) -> DataFrame:
    """Sources whose very first record on a trained endpoint is a scored one."""
    pairs = act.groupBy(*PAIR).agg(
        F.min("first_seq").alias("first_seq"),
        F.min("first_scored").alias("scored"),
        F.min_by("scored_time", "first_scored").alias("at"),
    )
    new = pairs.filter(F.col("first_seq") == F.col("scored"))
    message = F.concat(F.lit("New consumer "), F.col("source"), F.lit(" accessing "), _name())
    return new.select(
        *_anomaly("new_consumer", "low", _name(), F.col("source"), message,
                  F.lit(NEW_CONSUMER_SCORE), F.col("at"), {})
    )


def _by_source(act: DataFrame) -> DataFrame:
    return act.groupBy("source").agg(
        F.sum("requests").alias("n"),
        F.sum("auth_failures").alias("failed"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    )


def credential_stuffing(act: DataFrame, threshold: float = AUTH_FAILURE_RATE) -> DataFrame:
    rate = F.col("failed") / F.col("n")
    hits = _by_source(act).filter((F.col("n") >= AUTH_FAILURE_REQUESTS) & (rate > threshold))
    message = F.concat(
        F.lit("Possible credential stuffing from "), F.col("source"), F.lit(": "), F.col("failed").cast("string"),
        F.lit("/"), F.col("n").cast("string"), F.lit(" requests failed auth ("), percent(rate), F.lit(")"),
    )
    details = {"total_requests": F.col("n"), "auth_failures": F.col("failed"), "failure_rate": F.round(rate, 3)}
    return hits.select(
        *_anomaly("credential_stuffing", "critical", F.lit("multiple"), F.col("source"), message, rate,
                  F.col("last_at"), details)
    )


def rate_anomalies(act: DataFrame, medium_rpm: float = RATE_MEDIUM_RPM, high_rpm: float = RATE_HIGH_RPM) -> DataFrame:
    span = seconds_between(F.col("first_at"), F.col("last_at"))
    rates = _by_source(act).filter(F.col("n") >= RATE_REQUESTS).withColumn("span", span).filter("span > 0")
    rates = rates.withColumn("rpm", F.col("n") / (F.col("span") / 60)).filter(F.col("rpm") > medium_rpm)
    message = F.concat(
        F.lit("High request rate from "), F.col("source"), F.lit(": "), whole(F.col("rpm")),
        F.lit(" requests/min over "), whole(F.col("span")), F.lit("s"),
    )
    details = {
        "requests_per_minute": F.round("rpm", 1),
        "total_requests": F.col("n"),
        "time_span_seconds": F.round("span", 1),
    }
    return rates.select(
        *_anomaly("rate_anomaly", F.when(F.col("rpm") > high_rpm, "high").otherwise("medium"), F.lit("multiple"),
                  F.col("source"), message, F.least(F.col("rpm") / 1000, F.lit(1.0)), F.col("last_at"), details)
    )


def _canonical(digits: Column) -> Column:
    """Digits without leading zeros; any length, so ids may exceed every integer type."""
    return F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0"))


def _successor(number: Column) -> Column:
    """The next integer of a canonical digit string."""
    nines = F.regexp_extract(number, "(9*)$", 1)
    head = F.expr("substring(num, 1, length(num) - length(regexp_extract(num, '(9*)$', 1)))")
    last = F.right(head, F.lit(1))
    bumped = F.concat(
        F.expr("substring(num, 1, length(num) - length(regexp_extract(num, '(9*)$', 1)) - 1)"),
        F.coalesce(F.nullif(last, F.lit("")).cast("int") + 1, F.lit(1)).cast("string"),
    )
    long_way = F.concat(bumped, F.repeat(F.lit("0"), F.length(nines)))
    return F.when(F.length(number) < 18, (number.try_cast("bigint") + 1).cast("string")).otherwise(long_way)


def enumeration(act: DataFrame) -> DataFrame:
    """Sources that walk through consecutive numeric ids of one endpoint.

    Two sorted neighbours are consecutive exactly when an id's predecessor is present too.  So
    instead of ordering all ids of a pair, every id is offered under its own value and under its
    successor's, and values that got both are counted: one aggregation by value.
    """
    numeric = act.filter(F.col("resource_id").rlike("^[0-9]+$")).select(
        *PAIR, "requests", _canonical(F.col("resource_id")).alias("num")
    )
    offered = numeric.select(
        *PAIR,
        F.inline(
            F.array(
                F.struct(F.col("num").alias("value"), F.lit(1).alias("own"), F.lit(0).alias("next"), "requests"),
                F.struct(
                    _successor(F.col("num")).alias("value"), F.lit(0).alias("own"), F.lit(1).alias("next"),
                    F.lit(0).cast("bigint").alias("requests"),
                ),
            )
        ),
    )
    values = offered.groupBy(*PAIR, "value").agg(
        F.sum("own").alias("ids"), F.max("next").alias("has_predecessor"), F.sum("requests").alias("requests")
    )
    present = values.filter("ids > 0")
    by_size = F.struct(F.length("value").alias("len"), F.col("value").alias("num"))  # numeric order
    pairs = present.groupBy(*PAIR).agg(
        F.sum("ids").alias("total"),
        F.sum("has_predecessor").alias("sequential"),
        F.sum("requests").alias("requests"),
        F.min(by_size).alias("lowest"),
        F.max(by_size).alias("highest"),
    )
    gaps = F.col("total") - 1
    hits = pairs.filter(
        (F.col("total") >= ENUMERATION_IDS)
        & (F.col("requests") > 0)  # at least one analysed record touches a numeric id
        & (F.col("sequential") > gaps * ENUMERATION_SHARE)
    )
    message = F.concat(
        F.lit("Sequential ID enumeration detected from "), F.col("source"), F.lit(" on "), _name(), F.lit(": "),
        F.col("total").cast("string"), F.lit(" IDs, "), F.col("sequential").cast("string"), F.lit("/"),
        gaps.cast("string"), F.lit(" sequential"),
    )
    details = {
        "total_ids": F.col("total"),
        "sequential_pairs": F.col("sequential"),
        "id_range": F.concat_ws("-", "lowest.num", "highest.num"),
    }
    return hits.select(
        *_anomaly("enumeration", "high", _name(), F.col("source"), message, F.col("sequential") / gaps,
                  F.lit(None), details)
    )


# ── All together ──


def score(
    rows: DataFrame, training: DataFrame | None = None, training_window: int = TRAINING_WINDOW
) -> DataFrame:
    """Train, then fold the traffic to the activity table, written once for all detectors."""
    rows = recorded(rows, training)
    profiles = materialize(train_then_detect(rows, training_window), "profiles")
    return materialize(activity(rows, profiles), "activity")


def pair_anomalies(act: DataFrame, bola_threshold: int = BOLA_IDS) -> DataFrame:
    """What the detectors find that look at one endpoint and source at a time."""
    return union_all([latency_outliers(act), bola(act, bola_threshold), new_consumers(act), enumeration(act)])


def source_anomalies(act: DataFrame, medium_rpm: float = RATE_MEDIUM_RPM, high_rpm: float = RATE_HIGH_RPM) -> DataFrame:
    """What the detectors find that look at all requests of a source."""
    return credential_stuffing(act).unionByName(rate_anomalies(act, medium_rpm, high_rpm))


def detect(act: DataFrame, bola_threshold: int = BOLA_IDS, medium_rpm: float = RATE_MEDIUM_RPM,
           high_rpm: float = RATE_HIGH_RPM, by_source: DataFrame | None = None) -> DataFrame:
    """All anomalies, one per (type, source, endpoint), sorted by severity name.

    ``by_source`` is the activity the two per-source detectors look at when it is not all of it:
    a stream passes the activity of the current batch.
    """
    recent = act if by_source is None else by_source
    found = pair_anomalies(act, bola_threshold).unionByName(source_anomalies(recent, medium_rpm, high_rpm))
    return found.orderBy("severity", "anomaly_type", "source", "endpoint")


def first_per_key(anomalies: DataFrame) -> DataFrame:
    """Keep the earliest anomaly per (type, source, endpoint) when several batches overlap."""
    first = F.min_by(F.struct("*"), F.struct("timestamp", "message"))
    return anomalies.groupBy("anomaly_type", "source", "endpoint").agg(first.alias("a")).select("a.*")


def call_transitions(rows: DataFrame) -> DataFrame:
    """How often a source calls one endpoint right after another.

    Offered as data only: nothing is detected from it.  The calls are range-partitioned and sorted by
    (source, time), so a source with most of the traffic spreads over many runs.  Neighbours are looked
    up within runs; the first call of a run is paired with the last one of the source's run before it,
    which takes two rows per run.
    """
    order = ["source", "timestamp", "record_id"]
    calls = rows.select(*order, _name().alias("endpoint")).repartitionByRange(*order).sortWithinPartitions(*order)
    calls = materialize(calls.select("source", "endpoint", F.monotonically_increasing_id().alias("seq")), "calls")
    inside = Window.partitionBy("source", F.shiftright("seq", 16)).orderBy("seq")
    paired = calls.select(
        "source", "endpoint", "seq", F.lag("endpoint").over(inside).alias("previous"), F.lead("endpoint").over(inside).alias("next")
    )
    ends = paired.filter("previous is null or next is null")
    before = F.lag("endpoint").over(Window.partitionBy("source").orderBy("seq"))
    across = ends.withColumn("before", before).filter("previous is null").select("source", F.col("before").alias("previous"), "endpoint")
    moves = paired.select("source", "previous", "endpoint").unionByName(across).filter("previous is not null")
    return moves.groupBy("source", "previous", "endpoint").agg(F.count("*").alias("transitions"))
