"""Small random traffic and plain-Python folds that say what the operators must return."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from routelens.schemas import TRAFFIC
from routelens.sources.logs import with_pattern

AS_OF = "2024-01-31 00:00:00"
START = datetime(2024, 1, 1)


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def random_records(seed: int, n: int = 300, hot: float = 0.4) -> list[dict]:
    """Records in time order; a share ``hot`` of them falls on one endpoint and one source."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        is_hot = rng.random() < hot
        ip = "10.0.0.1" if is_hot else rng.choice([None, "10.0.0.2", "203.0.113.9", "172.16.0.4"])
        rows.append(
            {
                "record_id": i,
                "timestamp": START + timedelta(seconds=i // 2),  # ties in time
                "method": "GET" if is_hot else rng.choice(["GET", "POST"]),
                "path": f"/items/{rng.randrange(60)}" if is_hot else rng.choice(["/a", "/b/7/c/", f"/items/{rng.randrange(9)}"]),
                "status_code": rng.choice([200, 200, 200, 401, 403, 404, 500]),
                "source_ip": ip,
                "source_service": rng.choice([None, "", "svc-1"]),
                "auth_method": rng.choice(["none", "bearer", "basic"]),
                "auth_subject": rng.choice([None, "", "sub-1", "sub-2"]),
                "response_time_ms": 900.0 if i > 200 and rng.random() < 0.05 else rng.choice([None, round(rng.expovariate(0.02), 2)]),
                "host": rng.choice([None, "api.stripe.com", "x.example.org"]),
                "discovery_source": rng.choice(["log_nginx", "log_generic"]),
            }
        )
    return rows


def frame(spark, records: list[dict], shuffle_seed: int | None = 0):
    rows = list(records)
    if shuffle_seed is not None:
        random.Random(shuffle_seed).shuffle(rows)
    names = TRAFFIC.fieldNames()
    return with_pattern(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], TRAFFIC).repartition(5))
