"""Table maintenance (S8, S11) against plain loops over the same requests."""

import random

from textguard.plans import tables as T


def test_role_updates_of_a_hot_user(spark):
    r = random.Random(1)
    users = [(i, "user") for i in range(5)]
    updates = [(r.choice([0, 0, 0, 1, 2, 9]), r.choice(["admin", "user", "moderator", "root"]), r.randint(0, 20), i) for i in range(300)]
    out, rejects = T.apply_role_updates(spark.createDataFrame(users, "user_id int, role string"),
                                        spark.createDataFrame(updates, "user_id int, new_role string, ts int, update_id int"))
    roles, valid = dict(users), set(T.L.USER_ROLES)
    for u, role, _, _ in sorted(updates, key=lambda x: x[2:]):
        if role in valid and u in roles:
            roles[u] = role
    assert {x["user_id"]: x["role"] for x in out.collect()} == roles
    want = {i: "invalid role" if role not in valid else "user not found" for u, role, _, i in updates if role not in valid or u not in dict(users)}
    assert {x["update_id"]: x["reason"] for x in rejects.collect()} == want


def test_requests_for_a_hot_key_and_without_key(spark):
    r = random.Random(2)
    existing = [("a",), ("a",), ("b",), (None,)]
    requests = [(i, r.choice(["hot"] * 5 + ["a", "b", "c", None]), r.randint(0, 50)) for i in range(300)]
    got = T.reject_duplicate_keys(spark.createDataFrame(existing, "email string"), spark.createDataFrame(requests, "req int, email string, ts int"),
                                  "email", ["ts", "req"], "req")
    seen, want = set(), {}
    for i, k, _ in sorted(requests, key=lambda x: (x[2], x[0])):
        want[i] = "exists" if k in ("a", "b") else "duplicate" if k is None or k in seen else "accepted"
        seen.add(k)
    assert {x["req"]: x["status"] for x in got.collect()} == want
