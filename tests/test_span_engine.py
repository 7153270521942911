"""Resolution, masks, splicing and mappings against a plain Python version, and their growth."""

import random
import time

from pyspark.sql import functions as F

from textguard.functions import lexicons as L
from textguard.operators import pii as P

TYPES = ["email", "phone", "ssn", "credit_card", "ip_address", "zip_code", "name"]


def overlaps(a, b):
    ov = min(a[1], b[1]) - max(a[0], b[0])
    return ov > 0 and (ov * 10 > (b[1] - b[0]) * 3 or ov * 10 > (a[1] - a[0]) * 3)


def resolved(model, rules):
    kept = []
    for m in model:
        for i, k in enumerate(kept):
            if k[:3] == m[:3]:
                if m[4] > k[4]:
                    kept[i] = m
                break
        else:
            kept.append(m)
    for r in rules:
        first = next((k for k in kept if overlaps(k, r)), None)
        if first is None:
            kept.append(r)
            continue
        a, b = (L.TYPE_PRIORITY.get(x[2], L.DEFAULT_TYPE_PRIORITY) for x in (r, first))
        if a > b or (a == b and r[4] > first[4]):
            kept.remove(first)
            kept.append(r)
    return sorted(kept)


def masked(text, spans):
    """spans: (start, end, ..., mask), replaced from the last to the first."""
    for s in reversed(spans):
        text = text[:s["start"]] + s["mask"] + text[s["end"]:]
    return text


def random_spans(rnd, n, length):
    out = []
    for _ in range(n):
        a = rnd.randrange(length - 1)
        b = min(length, a + rnd.choice([1, 3, 8, 20]))
        out.append((a, b, rnd.choice(TYPES), f"v{rnd.randrange(6)}@x", rnd.choice([0.5, 0.7, 0.9])))
    return out


def test_matches_plain_python(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(60):
        text = "".join(rnd.choice("ab é\U0001F600") for _ in range(rnd.choice([40, 300, 9000])))
        n = rnd.choice([0, 1, 5, 40, 600]) if len(text) > 5000 else rnd.choice([0, 1, 4, 12])
        rows.append((i, text, random_spans(rnd, rnd.choice([0, 2, n]), len(text)), random_spans(rnd, n, len(text))))
    df = spark.createDataFrame(rows, f"id int, text string, model {P.SPAN_ARRAY}, rules {P.SPAN_ARRAY}").repartition(8)
    df = df.withColumn("spans", P.resolve_spans(F.col("rules"), F.col("model"))).withColumn("bare", P.resolve_spans(F.col("rules")))
    df = df.withColumn("m", P.with_masks(F.col("spans")))
    df = df.withColumn("out", P.splice("text", F.col("m"))).withColumn("map", P.mapping_entries(F.col("m")))
    got = {r["id"]: r for r in df.collect()}
    for i, text, model, rules in rows:
        g = got[i]
        assert [tuple(s) for s in g["spans"]] == resolved(model, rules)
        assert [tuple(s) for s in g["bare"]] == resolved([], rules)
        for k, s in enumerate(g["m"]):
            assert s["idx"] == sum(x["type"] == s["type"] for x in g["m"][k:])
        assert g["out"] == masked(text, g["m"])
        want = {}
        for s in reversed(g["m"]):
            want[s["mask"]] = s["value"]
        assert [(e["placeholder"], e["original"]) for e in g["map"]] == list(want.items())


def test_zip_context(spark):
    rows = [("far + far apart by more than twenty 94107 x", 1), ("94107 plus", 0), ("é94107", 1), ("x" * 5000 + " 94107 " + "y" * 5000, 1), ("94107", 1)]
    df = spark.createDataFrame(rows, "text string, n int").withColumn("spans", P.rule_pii_spans("text"))
    for r in df.collect():
        assert len([s for s in r["spans"] if s["type"] == "zip_code"]) == (r["n"] if r["text"] != "é94107" else 0), r["text"][:40]


def test_growth_is_about_linear(spark):
    """A text with eight times the spans takes about eight times as long, not sixty-four."""
    def seconds(n):
        text = " ".join(f"10.{i % 250}.{i // 250}.7" for i in range(n))
        df = spark.createDataFrame([(text,)], "text string")
        t = time.perf_counter()
        r = P.with_privacy(df, "text").select(F.size("privacy.spans").alias("n"), "privacy.masked_text").first()
        assert r["n"] == n and r["masked_text"].startswith(f"[IP_{n}] ") and r["masked_text"].endswith("[IP_1]")
        return time.perf_counter() - t
    seconds(200)  # warm-up
    small, large = seconds(1000), seconds(8000)
    print(small, large)
    assert large < 12 * small + 2
