"""Users, roles and who may do what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions import values

RIGHTS = ("read", "write", "read_rest", "write_rest")


def effective(users: DataFrame, roles: DataFrame) -> DataFrame:
    """users: username, role, read … write_rest (claims, nullable). roles: role, read …
    Returns username and bits."""
    named = roles.select("role", *(F.col(r).alias(f"role_{r}") for r in RIGHTS))
    both = users.join(named, "role", "left")
    return both.select("username", values.permissions({r: F.col(r) for r in RIGHTS}, {r: F.col(f"role_{r}") for r in RIGHTS}).alias("bits"))


def allowed(requests: DataFrame, bits: DataFrame, default_user: str = "default") -> DataFrame:
    """requests: request, username, need (a bit). Those whose user has the right; a request
    without a user is the default user's."""
    asked = requests.withColumn("username", F.coalesce("username", F.lit(default_user)))
    return asked.join(bits, "username").where(F.col("bits").bitwiseAND(F.col("need")) != 0).select("request", "username")


def peers(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls that come from a configured node at its own address; these have every right."""
    host = F.substring_index("address", ":", 1)
    return calls.join(nodes.select(F.col("name").alias("node"), host.alias("ip")), ["node", "ip"], "left_semi")
