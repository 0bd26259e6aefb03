"""User lookups, role changes as a batch, and login state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealmargin.functions.rules import ROLES, role_allowed
from dealmargin.operators.latest import newest_order
from dealmargin.sources.parquet_tables import ParquetTables

PUBLIC_COLUMNS = ("id", "email", "role")


def user_by_email(users: DataFrame, email: str) -> DataFrame:
    """The login lookup: the one result that carries the stored password.

    The match is exact and case-sensitive on the input without white space at
    its ends; at most one row.
    """
    return (
        users.where(F.col("email") == F.lit(email.strip()))
        .select("id", "email", "password", "role")
        .limit(1)
    )


def user_list(users: DataFrame) -> DataFrame:
    return users.select(*PUBLIC_COLUMNS).orderBy(F.col("id").asc_nulls_last())


def user_detail(users: DataFrame, user_id: int) -> DataFrame:
    return users.where(F.col("id") == user_id).select(*PUBLIC_COLUMNS)


def apply_role_changes(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Users with the last accepted change of each user id applied; unknown ids change nothing.

    Roles are compared as their number in the list of roles, which an aggregate
    keeps in place, where text would have to be sorted.
    """
    roles = F.array(*map(F.lit, ROLES))
    last = (
        changes.where(_reject_reason().isNull())
        .groupBy(F.col("user_id").alias("id"))
        .agg(F.max_by(F.array_position(roles, F.col("role")).cast("int"), "seq").alias("_number"))
        .select("id", F.element_at(roles, F.col("_number")).alias("new_role"))
    )
    others = [name for name in users.columns if name != "role"]
    return users.join(last, "id", "left").select(
        *others, F.coalesce("new_role", "role").alias("role")
    )


def _reject_reason() -> Column:
    return (
        F.when(~role_allowed(F.col("role")), "role not allowed")
        .when(F.col("user_id").isNull(), "no user")
        .when(F.col("seq").isNull(), "no sequence")
    )


def role_change_rejects(changes: DataFrame) -> DataFrame:
    """The changes that are not applied to anyone, with the reason; all others are accepted."""
    judged = changes.select("seq", "user_id", "role", _reject_reason().alias("reason"))
    return judged.where(F.col("reason").isNotNull())


def store_role_changes(store: ParquetTables, changes: DataFrame) -> None:
    """Apply the changes to the stored users and commit them as the table's next version.

    ConcurrentChange if someone else has changed the users meanwhile.
    """
    base = store.versions("users").current()
    store.save("users", apply_role_changes(store.at("users", base), changes), base)


def current_logins(users: DataFrame, history: DataFrame) -> DataFrame:
    """Users whose newest login has no logout yet."""
    newest = history.where(F.col("user_id").isNotNull()).groupBy(
        F.col("user_id").alias("id")
    ).agg(
        F.max("login_at").alias("login_at"),
        F.max_by("logout_at", newest_order(F.col("login_at"), F.col("id"))).alias("logout_at"),
    )
    online = newest.where(F.col("logout_at").isNull()).select("id", "login_at")
    return users.select("id", "email").join(online, "id")


def last_login(users: DataFrame, history: DataFrame) -> DataFrame:
    """Each user's last login time, NULL for a user who never logged in."""
    last = history.groupBy(F.col("user_id").alias("id")).agg(
        F.max("login_at").alias("last_login_at")
    )
    return users.select("id", "email").join(last, "id", "left")
