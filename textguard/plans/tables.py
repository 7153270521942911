"""Audit-table maintenance as set operations (S7-S11) and detector evaluation.

The reference edits one row at a time; here each operation takes a whole batch of
requests as a DataFrame and is a join (semi/anti/left) on the key, so a batch of any
size is one shuffle on the key. "First request wins" is a partial aggregate
(``min_by``), not a window, so a key that receives a third of all requests is
pre-aggregated on every partition before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import lexicons as L
from textguard.operators.ordered import blocked_running_sum

# Columns the second schema version added, with their defaults (FIXED VALUES).
MESSAGE_ADDED_COLUMNS = [
    ("original_content", "string", None),
    ("masked_content", "string", None),
    ("pii_mappings", "string", None),
    ("filtered_content", "string", None),
    ("bias_detected", "boolean", False),
    ("bias_score", "double", None),
    ("jailbreak_detected_in_output", "boolean", False),
    ("jailbreak_score_in_output", "double", None),
    ("filter_analysis", "string", None),
    ("sanitization_strategy", "string", None),
]
CONVERSATION_ADDED_COLUMNS = [("bias_detected", "boolean", False), ("jailbreak_detected_in_output", "boolean", False)]


def evolve(df: DataFrame, added: list[tuple[str, str, object]]) -> DataFrame:
    """Add each missing column with its default; present columns keep their values, and a
    NULL in a column that has a default reads as the default."""
    for name, typ, default in added:
        lit = F.lit(default).cast(typ)
        if name in df.columns:
            df = df.withColumn(name, F.coalesce(F.col(name), lit) if default is not None else F.col(name))
        else:
            df = df.withColumn(name, lit)
    return df


def merge_versions(old: DataFrame, new: DataFrame, added) -> DataFrame:
    """Rows of both schema versions in one table of the new schema."""
    return evolve(old.unionByName(new, allowMissingColumns=True), added)


def apply_role_updates(users: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batch of (user_id, new_role, ts, update_id). Invalid roles and unknown users are
    rejected; of the valid updates of a user the latest wins. Returns (users, rejects)."""
    valid_role = F.col("new_role").isin(*L.USER_ROLES)
    rejects = (updates.filter(~valid_role).withColumn("reason", F.lit("invalid role"))
               .unionByName(updates.filter(valid_role).join(users.select("user_id"), "user_id", "left_anti")
                            .withColumn("reason", F.lit("user not found"))))
    # one row a user before it meets the users, so a user who receives a third of all updates is no hot key
    last = (updates.filter(valid_role).groupBy("user_id")
                   .agg(F.max_by("new_role", F.struct("ts", "update_id")).alias("new_role")))
    out = users.join(last, "user_id", "left").select(
        "user_id", F.col("role").alias("old_role"), F.coalesce("new_role", "role").alias("role"),
        (F.col("new_role").isNotNull() & (F.col("new_role") != F.col("role"))).alias("changed"))
    return out, rejects


def delete_cascade(convs: DataFrame, msgs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete the conversations in ``keys`` (column ``id``) and their messages; keys
    that match no conversation are returned as not found. Returns (convs, msgs, not_found)."""
    k = keys.select("id").distinct()
    found = k.join(convs.select("id"), "id", "left_semi")
    return (convs.join(found, "id", "left_anti"),
            msgs.join(found.withColumnRenamed("id", "conversation_id"), "conversation_id", "left_anti"),
            k.join(convs.select("id"), "id", "left_anti"))


def delete_outcomes(convs: DataFrame, msgs: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, outcome, messages) for each distinct key: 'deleted' with the number of its messages, or 'not found'. Messages are
    counted per conversation before they meet the keys; messages whose conversation is gone are not counted."""
    counted = msgs.groupBy(F.col("conversation_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    known = convs.select("id").distinct().withColumn("_known", F.lit(True))
    k = keys.select("id").where(F.col("id").isNotNull()).distinct().join(known, "id", "left").join(counted, "id", "left")
    found = F.col("_known").isNotNull()
    return k.select("id", F.when(found, "deleted").otherwise("not found").alias("outcome"),
                    F.when(found, F.coalesce("_n", F.lit(0))).otherwise(0).cast("bigint").alias("messages"))


def get_or_create(existing: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """One row per requested key - the stored row when it exists, else a new one
    (``created`` tells which)."""
    req = requested.select(key).distinct()
    old = req.join(existing, key, "inner").withColumn("created", F.lit(False))
    new = req.join(existing.select(key), key, "left_anti").withColumn("created", F.lit(True))
    return old.unionByName(new, allowMissingColumns=True)


def reject_duplicate_keys(existing: DataFrame, requests: DataFrame, key: str, order: list[str],
                          req_id: str) -> DataFrame:
    """A request is accepted when its key is new and it is the first request for the
    key; otherwise rejected as 'exists' or 'duplicate'."""
    known = existing.select(key).distinct().withColumn("_ex", F.lit(True))
    # what a request needs to know about its key is one row a key; the requests meet it once
    keys = requests.groupBy(key).agg(F.min_by(req_id, F.struct(*order)).alias("_first")).join(known, key, "left")
    tagged = requests.join(keys, key, "left")
    status = (F.when(F.col("_ex"), "exists").when(F.col(req_id) == F.col("_first"), "accepted").otherwise("duplicate"))
    return tagged.select(*requests.columns, status.alias("status"))


def conversation_messages(convs: DataFrame, msgs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The messages of the conversations in ``keys`` (column ``id``), each with its place in order of time, and the keys that
    name no conversation. A conversation without messages is found and has no rows."""
    k = keys.select("id").where(F.col("id").isNotNull()).distinct()
    found = k.join(convs.select("id", "title"), "id").withColumnsRenamed({"id": "conversation_id"})
    placed = blocked_running_sum(msgs.withColumn("_one", F.lit(1)), "conversation_id", "turn", "_one", "position").drop("_one")
    return placed.join(found, "conversation_id"), k.join(convs.select("id"), "id", "left_anti")


def confusion(df: DataFrame, expected: Column, predicted: Column, by: list[str]) -> DataFrame:
    """Confusion counts and accuracy / precision / recall / F1 per group."""
    e, p = expected.cast("boolean"), predicted.cast("boolean")
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(e & p).alias("tp"),
                            F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"),
                            F.count_if(~e & ~p).alias("tn"))
    return _ratios(g, by)


def _ratios(g: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, precision, recall and F1 of confusion counts (n, tp, fp, fn, tn)."""
    def ratio(a, b):
        return F.when(b > 0, F.round(a.cast("double") / b.cast("double"), 4)).otherwise(F.lit(0.0))
    tp, fp, fn, tn, n = (F.col(c) for c in ["tp", "fp", "fn", "tn", "n"])
    prec, rec = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.when(tp > 0, F.round(2.0 * tp / (2.0 * tp + fp + fn), 4)).otherwise(F.lit(0.0))
    return g.select(*by, "n", "tp", "fp", "fn", "tn", ratio(tp + tn, n).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def _types(types: Column) -> Column:
    return F.array_distinct(F.filter(F.coalesce(types, F.array().cast("array<string>")), lambda t: t.isNotNull()))


def multilabel_verdict(expected: Column, predicted: Column) -> Column:
    """E1 per row: a case passes when a finding is expected and one of the expected types is found, or none is expected and
    none is found. Null reads as no types; order and repeats do not matter."""
    e, p = _types(expected), _types(predicted)
    return F.when(F.size(e) > 0, F.arrays_overlap(e, p)).otherwise(F.size(p) == 0)


def multilabel_confusion(df: DataFrame, expected: Column, predicted: Column, labels: list[str]) -> DataFrame:
    """E1 over a table, in one pass: a row for each of ``labels`` with its confusion counts, accuracy, precision, recall and F1, and the
    totals of cases that passed and failed as a whole. An empty table has a row of zeros for each label."""
    d = df.select(_types(expected).alias("e"), _types(predicted).alias("p"), multilabel_verdict(expected, predicted).alias("ok"))
    has = {x: (F.array_contains("e", x), F.array_contains("p", x)) for x in labels}
    g = d.agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), *[
        F.count_if(c).alias(f"{m}_{i}") for i, (e, p) in enumerate(has.values()) for m, c in (("tp", e & p), ("fp", ~e & p), ("fn", e & ~p), ("tn", ~e & ~p))])
    rows = F.array(*[F.struct(F.lit(x).alias("label"), *[F.col(f"{m}_{i}").alias(m) for m in ("tp", "fp", "fn", "tn")]) for i, x in enumerate(labels)])
    g = g.select("n", "passed", "failed", F.explode(rows).alias("r")).select("r.*", "n", "passed", "failed")
    return _ratios(g, ["label", "passed", "failed"])
