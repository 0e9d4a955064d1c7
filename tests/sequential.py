"""One-by-one processing in plain Python: the yardstick for the parallel plan."""

from __future__ import annotations

import json
import re
from datetime import datetime, timedelta

FIELDS = ["eventId", "userId", "trackId", "timestamp", "msPlayed"]
REQUIRED = FIELDS[:4]
START = datetime(2026, 1, 1)

EVENT_SCHEMA = (
    "source string, origin string, fallback_id string, payload string, "
    "ord struct<batch:bigint,session:bigint,seq:bigint,tie:string>, received_at timestamp"
)


def norm(key: str) -> str:
    return re.sub("[^A-Za-z0-9]", "", key).lower()


def scalar(value):
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    return repr(value) if isinstance(value, float) else None


def extract(obj, aliases, required=REQUIRED):
    values, via = {}, {}
    for f in aliases:
        for key in aliases[f]:
            text = scalar(obj[key]) if isinstance(obj, dict) and key in obj else None
            if text is not None:
                values[f], via[f] = text, key
                break
    return values, via, [f for f in required if f not in values]


def match(field, obj, used=()):
    if not isinstance(obj, dict):
        return "none", None, []
    keys = sorted((k for k in obj if k not in used and norm(k) == norm(field)), key=str.encode)
    texts = [scalar(obj[k]) for k in keys]
    if not keys:
        return "none", None, []
    if len(keys) == 1 or all(t == texts[0] for t in texts):
        return "unique", keys[0], keys
    return "ambiguous", None, keys


class Engine:
    def __init__(self, policy=True, fields=FIELDS, required=REQUIRED, protected=("userId",)):
        self.aliases = {f: [f] for f in fields}
        self.required, self.protected = required, protected
        self.policy = policy
        self.learned = []

    def allowed(self, origin, field):
        return not self.policy or field not in self.protected or origin in ("partner-feed", "internal-batch")

    def process(self, seq, origin, obj):
        values, via, before = extract(obj, self.aliases, self.required)
        repairs, used = [], set(via.values())
        for f in before:
            outcome, key, keys = match(f, obj, used)
            if outcome == "unique":
                used.add(key)
                if not self.allowed(origin, f):
                    outcome = "denied"
                else:
                    outcome = "healed"
                    if key not in self.aliases[f]:
                        self.aliases[f].append(key)
                        self.learned.append((f, key, seq))
            repairs.append((f, outcome, key, keys))
        values, via, after = extract(obj, self.aliases, self.required)
        return values, via, before, repairs, after


def frame(spark, rows):
    """Events from (origin, payload text) rows, numbered in order."""
    data = [
        (f"s{i}", origin, f"fallback-{i}", payload, (0, 0, i, ""), START + timedelta(seconds=i))
        for i, (origin, payload) in enumerate(rows)
    ]
    return spark.createDataFrame(data, EVENT_SCHEMA)


def random_events(rng, count):
    """Traces dense in conflicts: few spellings, nulls, nested values, agreeing and disagreeing copies."""
    spellings = {
        "userId": ["userId", "user_id", "USERID", "user-id", "UserId", "user.id"],
        "trackId": ["trackId", "track_id", "TRACKID", "Track-Id"],
        "eventId": ["eventId", "event_id", "EVENT_ID"],
        "timestamp": ["timestamp", "time_stamp", "TimeStamp"],
        "msPlayed": ["msPlayed", "ms_played"],
    }
    rows = []
    for i in range(count):
        obj = {}
        for field, keys in spellings.items():
            chosen = rng.sample(keys, rng.choice([0, 1, 1, 1, 2, 3]) if len(keys) > 2 else 1)
            base = rng.choice(["a", "b", 7, True, None, {"z": 1}, [1]])
            for k in chosen:
                obj[k] = base if rng.random() < 0.75 else rng.choice(["a", "c", None, {"z": 2}])
        if rng.random() < 0.4:
            obj["userId"] = f"u{i % 3}"
        if rng.random() < 0.05:
            obj = rng.choice([[1], "text", None, 5])
        rows.append((rng.choice(["partner-feed", "untrusted-source", "unknown-app"]), obj))
    return rows
