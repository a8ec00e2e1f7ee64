"""Audit logs, compliance, catalogues, access and security events as tables."""

from __future__ import annotations

import hashlib
import hmac
import itertools
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ketspark.base import one_of
from ketspark.sources import record_log

#: words in a column's name that mark personal data
SENSITIVE = ("ssn", "password", "credit_card", "phone", "email", "address")


def retained(events: DataFrame, order: list, n: int) -> DataFrame:
    """The last ``n`` events."""
    return events.orderBy(*[F.desc(c) for c in order]).limit(n)


def audit_statistics(events: DataFrame, user: str, resource: str, kind: str, success: Column) -> DataFrame:
    """(total, unique_users, unique_resources, event_types, success_rate)."""
    return events.agg(
        F.count("*").alias("total"), F.count_distinct(user).alias("unique_users"), F.count_distinct(resource).alias("unique_resources"),
        F.count_distinct(kind).alias("event_types"), F.coalesce(F.avg(F.coalesce(success, F.lit(False)).cast("double")), F.lit(0.0)).alias("success_rate"),
    )


def activity(events: DataFrame, by: str, kind: str) -> DataFrame:
    """(by, kind, n, value): events of each user or on each resource."""
    return events.groupBy(by, kind).agg(F.count("*").alias("n"))


def is_sensitive(name: Column) -> Column:
    return F.lower(name).rlike("|".join(SENSITIVE))


def limit_violations(usage: DataFrame, limits: DataFrame, key: str, used: str, limit: str) -> DataFrame:
    """Usage over the limit, of keys in both."""
    return usage.join(limits, key).where(F.col(used) > F.col(limit))


def retention_violations(df: DataFrame, at: str, today: str, max_days: int) -> DataFrame:
    age = F.date_diff(F.lit(today).cast("date"), F.col(at).cast("date"))
    return df.withColumn("age_days", age.cast("long")).where(F.col("age_days") > max_days)


def catalog(datasets: DataFrame) -> DataFrame:
    """Metadata with "unknown" for what is missing."""
    return datasets.withColumns({c: F.coalesce(F.col(c), F.lit("unknown")) for c in ("owner", "classification", "created_date", "source")})


def owners(datasets: DataFrame, owner: Column, dataset: str) -> DataFrame:
    """(owner, dataset, n): a row for each dataset of an owner, with how many the owner has; an owner may have any number."""
    own = datasets.select(F.coalesce(owner.cast("string"), F.lit("unknown")).alias("owner"), F.col(dataset).alias("dataset")).distinct()
    sizes = own.groupBy("owner").agg(F.count("*").alias("n"))
    return own.join(sizes, "owner")


def export_trail(events: DataFrame, path: str) -> None:
    """The audit trail as JSON lines in a folder that the cluster shares."""
    events.write.json(path)


def append_trail(events: DataFrame, path: str, batch: str) -> None:
    """Add a batch of events to a trail that is a record log; the same batch again adds nothing."""
    record_log.append(events, path, batch)


def violations(data: DataFrame, policies: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """(policy, key, measure, value, limit): what breaks a policy. ``policies``: policy, measure and the largest
    value allowed (limit); a missing value breaks none."""
    cells = data.unpivot([key], [F.col(c).cast("double").alias(c) for c in measures], "measure", "value")
    return cells.join(F.broadcast(policies) if policies.count() <= 100_000 else policies, "measure").where(F.col("value") > F.col("limit")).select("policy", key, "measure", "value", "limit")


def compliance_report(found: DataFrame, policies: DataFrame) -> DataFrame:
    """(policy, measure, limit, n_violations, worst): one row a policy, also where nothing breaks it."""
    counts = found.groupBy("policy", "measure").agg(F.count("*").alias("n_violations"), F.max("value").alias("worst"))
    return policies.join(counts, ["policy", "measure"], "left").select("policy", "measure", "limit", F.coalesce("n_violations", F.lit(0)).alias("n_violations"), "worst")


def ancestors(edges: DataFrame, child: str, parent: str, dataset) -> DataFrame:
    """(dataset, ancestor, depth) of one dataset: a join a level from it alone, not the closure of all."""
    from ketspark.plans.storage import stored

    step = edges.select(F.col(child).alias("__child"), F.col(parent).alias("ancestor")).where("__child is not null and ancestor is not null").distinct()
    front = step.where(F.col("__child") == dataset).select(F.col("__child").alias("dataset"), "ancestor")
    up = step.withColumnRenamed("ancestor", "__next").withColumnRenamed("__child", "ancestor")
    found = front = stored(front.withColumn("depth", F.lit(1).cast("long")), "closure")
    for d in itertools.count(2):
        new = front.join(up, "ancestor").select("dataset", F.col("__next").alias("ancestor")).distinct()
        front = stored(new.join(found, ["dataset", "ancestor"], "left_anti").withColumn("depth", F.lit(d).cast("long")), "closure")
        if not front.limit(1).count():
            return found
        found = found.unionByName(front)
        if d % 20 == 0:  # else the plan grows with the depth
            found = stored(found, "closure")


#: datasets that one task joins through one dataset between, at most
HUB = 20_000


def closure(edges: DataFrame, child: str, parent: str, max_depth: int | None = None) -> DataFrame:
    """(dataset, ancestor, depth): all ancestors with the shortest distance, by doubling of paths.

    After a round all pairs up to a distance of 2^k are known. The pairs at exactly that distance are joined with all known ones, which
    gives those up to 2^(k+1), as every shortest path has a dataset at that distance; so there are as many rounds as the
    depth has binary digits, and a round joins no pair that isn't an ancestor. A dataset through which many paths go is
    split by the datasets that come to it. Edges with a null end don't count; repeated ones count once; in a cycle a dataset
    is its own ancestor. Without edges there is nothing. Raises an error if there are ancestors beyond a caller's ``max_depth``."""
    from ketspark.plans.storage import stored

    step = edges.select(F.col(child).alias("dataset"), F.col(parent).alias("ancestor")).where("dataset is not null and ancestor is not null").distinct()
    found, reach = stored(step.withColumn("depth", F.lit(1).cast("long")), "closure"), 1
    while True:
        front = found.where(F.col("depth") == reach).select("dataset", F.col("ancestor").alias("__mid"))
        # under a dataset in HUB of the front: few
        hubs = F.broadcast(front.groupBy("__mid").count().where(F.col("count") > HUB).select("__mid", F.ceil(F.col("count") / HUB).cast("int").alias("__parts")))
        parts = F.coalesce("__parts", F.lit(1))
        left = front.join(hubs, "__mid", "left").withColumn("__part", F.pmod(F.xxhash64("dataset"), parts).cast("int")).drop("__parts")
        right = found.select(F.col("dataset").alias("__mid"), "ancestor", "depth").join(hubs, "__mid", "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
        pairs = left.join(right, ["__mid", "__part"]).groupBy("dataset", "ancestor").agg((F.min("depth") + reach).alias("depth"))
        new = stored(pairs.join(found, ["dataset", "ancestor"], "left_anti"), "closure")
        deepest = new.agg(F.max("depth")).first()[0]
        if max_depth is not None and max(deepest or 0, 1) > max_depth:
            raise ValueError(f"there are ancestors beyond max_depth = {max_depth}")
        if deepest is None:
            return found
        found, reach = found.unionByName(new), 2 * reach


class AccessControl:
    """Users with salted, stretched password digests, and roles with permissions ("*": all)."""

    ROLES = {"admin": ("*",), "developer": ("read", "write", "execute"), "user": ("read", "execute"), "viewer": ("read",)}
    ROUNDS = 100_000

    def __init__(self) -> None:
        self.users: dict[str, dict] = {}

    def _digest(self, password: str, salt: bytes) -> bytes:
        return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, self.ROUNDS)

    def add_user(self, name: str, password: str, role: str) -> None:
        if name in self.users:
            raise ValueError(f"{name} exists")
        salt = os.urandom(16)
        self.users[name] = {"role": one_of(role, tuple(self.ROLES), "role"), "salt": salt, "digest": self._digest(password, salt)}

    def authenticate(self, name: str, password: str) -> str | None:
        user = self.users.get(name)
        if user and hmac.compare_digest(user["digest"], self._digest(password, user["salt"])):
            return os.urandom(32).hex()
        return None

    def check_permission(self, name: str, permission: str) -> bool:
        own = self.ROLES.get(self.users.get(name, {}).get("role", ""), ())
        return "*" in own or permission in own

    def roles(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r, list(p)) for r, p in self.ROLES.items()], "role string, permissions array<string>")


def allowed(users: DataFrame, role: str, roles: DataFrame, permissions: list[str]) -> DataFrame:
    """``users`` with a row for each permission and whether the role has it."""
    asked = users.withColumn("permission", F.explode(F.array(*[F.lit(p) for p in permissions])))
    joined = asked.join(F.broadcast(roles.withColumnRenamed("role", "__role")), F.col(role) == F.col("__role"), "left")
    ok = F.array_contains("permissions", F.lit("*")) | F.array_contains("permissions", F.col("permission"))
    return joined.withColumn("allowed", F.coalesce(ok, F.lit(False))).drop("__role", "permissions")


def encrypted(col: Column, key: bytes) -> Column:
    return F.base64(F.aes_encrypt(col, F.lit(key)))


def decrypted(col: Column, key: bytes) -> Column:
    return F.aes_decrypt(F.unbase64(col), F.lit(key)).cast("string")


def rotated(col: Column, old: bytes, new: bytes) -> Column:
    """What ``encrypted`` wrote with the old key, under the new one."""
    return F.base64(F.aes_encrypt(F.aes_decrypt(F.unbase64(col), F.lit(old)), F.lit(new)))


def alerts(events: DataFrame, source: str, kind: str, severity: Column, failed: Column, most: int = 5) -> DataFrame:
    """(source, reason, n): an alert for each critical kind of event of a source, and one for over ``most`` failures."""
    critical = events.where(severity == "critical").groupBy(source, F.concat(F.lit("critical "), F.col(kind)).alias("reason")).agg(F.count("*").alias("n"))
    often = failed_attempts(events, source, failed, most).where("anomalous").select(source, F.lit("failed attempts").alias("reason"), F.col("n_failed").alias("n"))
    return critical.unionByName(often)


def security_report(events: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    """(n_events, n_kinds, n_alerts)."""
    counts = found.agg(F.count("*").alias("n_alerts"))
    return events.agg(F.count("*").alias("n_events"), F.count_distinct(kind).alias("n_kinds")).crossJoin(F.broadcast(counts))  # one row each


def failed_attempts(events: DataFrame, source: str, failed: Column, most: int = 5) -> DataFrame:
    """(source, n_failed, anomalous)."""
    return events.groupBy(source).agg(F.count_if(failed).alias("n_failed")).withColumn("anomalous", F.col("n_failed") > most)
