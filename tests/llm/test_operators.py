"""The corpus operators against brute force and on edge cases."""

import time
import gzip
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textguard.llm import (context_pii, hyperminhash, order_minhash, packing, pfair_mix, quality_cascade, sentencepieces, suffix_dedup, warc_segments,
                           zstd_secrets)

DOC = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, _h string"


def docs_of(spark, pairs, source="s"):
    """documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, source, None if t is None else len(t), "x", None, "h") for i, t in pairs], DOC)


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n)) if vocabulary else ""


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "é😀 one"), (5, "one two"), (5, "one two"), (None, "null id"), (7, "a" * 60_000), (8, words(1, 9000))]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- 1
KINDS = [("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
         ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))]


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def base_pii(text):
    out = []
    for rank, (kind, pattern) in enumerate(KINDS):
        for m in pattern.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                  "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


PII = [(20, "a@b.c_d@e.f x@y a@b.c.d%z@q.w 1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4"), (21, "+1 (415) 555-0199 or 4111 1111 1111 1111, 4111-1111-1111-1112"),
       (22, "é😀 a@b.co 4111111111111111é"), (23, "1.2.3.4 " * 700), (24, "+" * 3000 + "12345678901"), (25, "a." * 5000 + "@b.c")]


def test_pii_base_spans(spark):
    pairs = EDGE + PII
    got = rows(context_pii.report(docs_of(spark, pairs)))
    want = []
    for i, t in pairs:
        b = base_pii(t)
        text = ",".join(f"{k}:{a}:{z}" for a, _, z, k in b)
        want.append((i, *(sum(x[3] == k for x in b) for k, _ in KINDS), hashlib.sha256(text.encode()).hexdigest(), text))
    assert got == sorted(want, key=str)


def test_pii_discovers_in_trusted_context(spark):
    seeds = [(i, f"write to mailbox user{i}@corp.example today") for i in range(30)]
    df = docs_of(spark, seeds + [(99, "write to mailbox root9@localhost today"), (100, "see page 12345678 there")])
    got = {r["doc_id"]: r["spans"] for r in context_pii.report(df).collect()}
    assert got[99] == "ctx_email:17:32" and got[100] == "" and got[0] == "email:17:35"
    out = {r["doc_id"]: r for r in context_pii.redact(df).collect()}
    assert out[0]["text"] == "write to mailbox [EMAIL] today" and out[0]["n_chars"] == 30 and out[100]["text"] == "see page 12345678 there"
    assert context_pii.redact(df).columns == df.columns


def test_pii_discovers_words_without_digits_and_groups(spark):
    names = ["".join(p) for p in zip("abcdefghijklmnopqrst", "bcdefghijklmnopqrstu")]
    seeds = [(i, f"Write to mailbox <{n}@corp.example>, today") for i, n in enumerate(names)] + \
            [(100 + i, f"please call +1 415 555 0{i}9 tonight") for i in range(10, 40)]
    new = {200: ("write to mailbox root@localhost today", "ctx_email:17:31"), 201: ("please call 415 555 0199 tonight", "ctx_phone:12:24"),
           202: ("please call (415) 555-0199, tonight", "ctx_phone:13:26"), 203: ("please call 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 tonight", ""),
           204: ("ask @root or page 415 555 0199 there", "")}
    got = {r["doc_id"]: r["spans"] for r in context_pii.report(docs_of(spark, seeds + [(i, t) for i, (t, _) in new.items()])).collect()}
    assert {i: got[i] for i in new} == {i: s for i, (_, s) in new.items()} and got[0] == "email:18:33"


def test_native_operators_run_no_python(spark):
    df = docs_of(spark, EDGE)
    for out in (context_pii.report(df), context_pii.redact(df), order_minhash.report(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


# --- 2
def test_quality_counts(spark):
    pairs = EDGE + [(30, "\n".join(["same line of text here"] * 20)), (31, words(2, 300)), (32, "x# " * 200), (33, words(3, 100).upper()), (34, "ß " + words(4, 80))]
    for i, n, chars, symbols, dup, rep, failed, kept in rows(quality_cascade.judge(docs_of(spark, pairs))):
        t = next(t for k, t in pairs if k == i) or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = Counter(zip(w, w[1:], w[2:]))
        cover = {p for k in range(len(w) - 2) if c[tuple(w[k:k + 3])] > 1 for p in (k, k + 1, k + 2)}
        assert (n, chars, symbols, dup, rep) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert failed == (n < 50 or 100 * rep > 50 * n)
        assert kept == (i in (8, 31, 34))


def test_quality_order_changes_no_verdict(spark):
    df = docs_of(spark, EDGE + [(31, words(2, 300)), (33, words(3, 100).upper())])
    names = list(quality_cascade.RULES)
    assert rows(quality_cascade.judge(df, order=names)) == rows(quality_cascade.judge(df, order=names[::-1]))
    cost = [quality_cascade.RuleCost("dear", 1.0, 0.5), quality_cascade.RuleCost("cheap", 0.1, 0.2), quality_cascade.RuleCost("idle", 0.1, 0.0)]
    assert quality_cascade.order_rules(cost) == ["cheap", "dear", "idle"]
    assert sorted(r["doc_id"] for r in quality_cascade.keep_good(df).collect()) == [8, 31]
    got = {c.name: c for c in quality_cascade.rule_costs(df, fraction=1.0)}  # 8, 31 and 33 pass the base rules
    assert got["shouting"].rejected == 1 / 3 and got["symbol_heavy"].rejected == 0 and all(c.seconds > 0 for c in got.values())


# --- 3
@pytest.mark.parametrize("seed", range(12))
def test_schedule_deviates_less_than_a_block(seed):
    r = random.Random(seed)
    shares = pfair_mix.units({f"s{i}": r.random() ** 3 + 1e-4 for i in range(r.randint(1, 25))}, 512)
    done = Counter()
    for source, block, slot in pfair_mix.schedule(shares):
        assert block == done[source]
        done[source] += 1
        assert all(abs(done[k] * 512 - (slot + 1) * u) < 512 for k, u in shares.items())
    assert done == shares


@pytest.mark.parametrize("n", [20, 100, 1000, 6000])
def test_plan_deviates_less_than_a_block_from_the_targets(n):
    """A source with a third of the weight, among many, over three times the 4096 slots of a former period."""
    r = random.Random(n)
    weights = {"hot": 1.0} | {f"s{i}": r.random() + 0.01 for i in range(n - 1)}
    weights["hot"] = sum(weights.values(), -1.0) / 2
    whole, done = sum(weights.values()), Counter()
    for source, block, slot in pfair_mix.slots(pfair_mix.units(weights), dict.fromkeys(weights, 12288)):
        assert block == done[source] and abs(done[source] - slot * weights[source] / whole) < 1
        done[source] += 1
        assert abs(done[source] - (slot + 1) * weights[source] / whole) < 1
        if slot == 12287:
            break
    assert all(abs(done[k] - 12288 * w / whole) < 1 for k, w in weights.items())


def test_mix_of_many_sources(spark, monkeypatch):
    d = spark.range(6000).selectExpr("id AS doc_id", "concat('s', id % 5000) AS source", "'t' AS text")
    got = pfair_mix.mix(d, pfair_mix.tempered(d)).collect()
    assert len(got) == 6000 and len({r["mix_place"] for r in got}) == 6000 and len({r["mix_slot"] for r in got}) == 5000
    monkeypatch.setattr(pfair_mix, "PLAN_ROWS", 1000)  # a plan in pieces
    assert rows(pfair_mix.mix(d, pfair_mix.tempered(d))) == sorted((tuple(r) for r in got), key=str)


def test_mix_keeps_every_row_once(spark):
    d = docs_of(spark, [(i, f"t{i}") for i in range(900)], "hot").unionByName(docs_of(spark, [(i, None) for i in range(900, 1000)], "b")) \
        .unionByName(docs_of(spark, EDGE, None))
    got = pfair_mix.mix(d, {"hot": 3.0, "b": 1.0, "": 0.2}, block_rows=4).collect()
    assert len(got) == 1009 and len({r["mix_place"] for r in got}) == 1009
    early = [r["mix_source"] for r in got if r["mix_slot"] < 40]
    assert abs(early.count("hot") / 4 - 40 * 3 / 4.2) < 1.1 and abs(early.count("b") / 4 - 40 / 4.2) < 1.1
    assert len(pfair_mix.mix(d, {"b": 1.0}).collect()) == 1009  # sources without a target
    assert rows(pfair_mix.reorder(d)) == rows(d)


# --- 4
def brute_components(pairs, size, percent):
    sets = []
    for _, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < size else zip(*(w[k:] for k in range(size)))))
    group = list(range(len(pairs)))
    for a in range(len(pairs)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = []
    for k, (i, _) in enumerate(pairs):
        ids = [x for (x, _), g in zip(pairs, group) if g == group[k] and x is not None]
        cid = min(ids) if ids and sets[k] else i
        out.append((i, len(sets[k]), cid, i == cid))
    return sorted(out, key=str)


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(5)
    base = words(6, 120).split()
    near = []
    for i in range(70):  # a group around the threshold, in which not all are linked with one another
        w = list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = f"edit{r.random()}"
        near.append((100 + i, " ".join(w)))
    small = [(300 + i, " ".join(r.choice("abc") for _ in range(r.randint(1, 9)))) for i in range(60)]
    pairs = EDGE + near + small + [(400, near[0][1].upper()), (401, near[3][1])]
    assert rows(hyperminhash.near_duplicates(docs_of(spark, pairs), 3, 85)) == brute_components(pairs, 3, 85)
    kept = {x[0] for x in brute_components(pairs, 5, 80) if x[3]}
    assert {x["doc_id"] for x in hyperminhash.keep_one(docs_of(spark, pairs), 5, 80).collect()} - {None} == kept - {None}


def test_registers_estimate():
    r = np.random.default_rng(1)
    common, a, b = (r.integers(0, 2 ** 63, n).astype(np.uint64) for n in (900, 100, 100))
    x, y = np.concatenate([common, a]), np.concatenate([common, b])
    regs = hyperminhash.sketch(np.repeat([0, 1], 1000), np.concatenate([x, y]), 2)
    assert abs((regs[0] == regs[1]).mean() - 900 / 1100) < 0.12
    n = np.array([1000])
    assert hyperminhash.likely(regs[:1], regs[1:], n, n, 85)[0] and not hyperminhash.likely(regs[:1], hyperminhash.sketch(np.zeros(100, int), a, 1), n, n, 85)[0]


@pytest.mark.parametrize("common,left,right", [(6, 0, 1), (7, 0, 1), (12, 1, 1), (17, 2, 1), (46, 6, 5)])
def test_small_sets_share_a_band(common, left, right):
    """Linked sets of few shingles, most of whose registers are filled from others."""
    n = 20_000
    h = np.random.default_rng(2).integers(0, 2 ** 64, (n, common + left + right), dtype=np.uint64)
    x, y = h[:, :common + left], np.concatenate([h[:, :common], h[:, common + left:]], axis=1)
    a, b = (hyperminhash.band_keys(hyperminhash.sketch(np.repeat(np.arange(n), s.shape[1]), s.ravel(), n)) for s in (x, y))
    assert (a == b).any(axis=1).all()


# --- 5
def test_viterbi_finds_the_best_path_and_round_trips(spark):
    v = sentencepieces.load()
    texts = ["Hello  world\n▁x", "", "a", " ", "   lead", "tabs\tand\n\n", "é😀中文", "<s> </s> <0x41>", "the " * 10]
    raw = [t.encode() for t in texts]
    tokens, ids = sentencepieces.encode(v, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]))
    table = {bytes(v.text[v.bounds[i]:v.bounds[i + 1]]): s for i, s in zip(v.ids.tolist(), v.scores.tolist())}
    score = dict(zip(v.ids.tolist(), v.scores.tolist()))
    at = np.cumsum([0, *tokens])
    for k, t in enumerate(raw):
        if t:
            s, best = b" " + t, [0.0]
            for e in range(1, len(t) + 2):
                best.append(max([best[e - 1] + v.byte_score] + [best[e - n] + table[s[e - n:e]] for n in range(1, min(e, 48) + 1) if s[e - n:e] in table]))
            assert sum(score.get(int(i), v.byte_score) for i in ids[at[k]:at[k + 1]]) == pytest.approx(best[-1])
    got = sentencepieces.tokenize(docs_of(spark, EDGE + list(enumerate(texts, 50))), decoded=True).collect()
    want = dict(EDGE + list(enumerate(texts, 50)))
    assert all(r["round_trip"] and r["decoded"] == (want[r["doc_id"]] or "") and r["n_tokens"] == len(r["ids"]) for r in got) and len(got) == 18


# --- 6
def test_edited_texts_and_likeness(spark):
    pairs = EDGE + [(40, words(7, 200)), (41, words(8, 200)), (42, words(7, 200))]
    src = sorted(((i, t or "") for i, t in pairs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = []
    for k, (i, t) in enumerate(src):
        h = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[:len(t) - h] + src[(k + 1) % len(src)][1][:h]).encode()).hexdigest()))
    for cut in (500, 2):
        d = order_minhash.with_next(docs_of(spark, pairs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), {}, cut)
        assert sorted(((r["doc_id"], r["next_text"]) for r in d.collect()), key=str) == sorted(((i, src[(k + 1) % len(src)][1]) for k, (i, _) in enumerate(src)), key=str)
    got = order_minhash.report(docs_of(spark, pairs)).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)
    by = {r["doc_id"]: r for r in got}
    assert by[40]["fingerprint"] == by[42]["fingerprint"] and by[40]["near_next"] < by[40]["near_edited"] < 1 and by[1]["near_next"] == 1.0


def test_moved_halves_of_short_texts_are_less_alike(spark):
    r = random.Random(8)
    data = []
    for n in (12, 50, 100):
        for _ in range(20):
            w = [f"w{x}" for x in r.sample(range(10 ** 6), n)]
            data.append((n, " ".join(w), " ".join(w[n // 2:] + w[:n // 2])))
    d = spark.createDataFrame(data, "n int, a string, b string").select("n", F.expr(order_minhash.fingerprint("a")).alias("a"), F.expr(order_minhash.fingerprint("b")).alias("b"))
    got = {x["n"]: x["near"] for x in d.groupBy("n").agg(F.avg(order_minhash.likeness("a", "b")).alias("near")).collect()}
    assert all(0.2 < v < 0.6 for v in got.values()), got


# --- 7
def brute_repeats(pairs, n):
    raw = [(t or "").encode() for _, t in pairs]
    seen = Counter(b[i:i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for (i, _), b in zip(pairs, raw):
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k:k + n]] > 1:
                gone[k:k + n] = b"\1" * n
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"batch_bytes": 3000, "hot_rows": 1}, {"batch_bytes": 3000}])
def test_suffix_dedup_equals_brute_force(spark, limits):
    passage, line = words(9, 60), words(10, 12)[:70]
    pairs = [*EDGE[:7], (7, "ab" * 400), (8, words(1, 300))]
    pairs += [(60 + i, f"{words(60 + i, 20 + i)} {passage[i:]} {line} é{words(90 + i, 15)}") for i in range(12)] + [(90, words(62, 22)), (91, passage), (91, passage)]
    assert rows(suffix_dedup.remove_repeats(docs_of(spark, pairs), 100, **limits)) == brute_repeats(pairs, 100)


def test_suffix_dedup_deals_a_frequent_beginning_to_several_ranges(spark, monkeypatch):
    r = random.Random(5)
    shared = ["".join(r.choices("ab", (30, 1), k=400)) for _ in range(12)]  # most suffixes begin with aaaaaaaa
    pairs = [(i, f"{words(200 + i, 30)} {''.join(r.sample(shared, 3))} {words(300 + i, 9)}") for i in range(60)]
    seen = []
    split = suffix_dedup._splitters
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "_splitters", lambda hits, ranges: seen.append(split(hits, ranges)) or seen[-1])
    assert rows(suffix_dedup.remove_repeats(docs_of(spark, pairs), 100, batch_bytes=2000)) == brute_repeats(pairs, 100)
    edges, times, own, n = suffix_dedup._ranges(seen[0])
    assert times.max() > 1 and n == len(edges) + 1 + times[times > 1].sum() and own[times > 1].min() == len(edges) + 1


def test_loser_tree_merges_with_prefix_lengths():
    r = random.Random(3)
    strings = [["".join(r.choice("ab") for _ in range(r.randint(1, 12))).encode() for _ in range(r.randint(0, 30))] for _ in range(5)]
    runs = [suffix_dedup.front_decoded(suffix_dedup.front_coded([(s, b"", False) for s in sorted(x)])) if x else [] for x in strings]
    got, last = [], b""
    for i, j, h in suffix_dedup.loser_tree_merge(runs):
        s = runs[i][j][1]
        assert h == suffix_dedup.common_prefix(last, s) or not got
        got.append(s)
        last = s
    assert got == sorted(s for x in strings for s in x)


# --- 8
@pytest.mark.parametrize("hot_share", [2, 16_384])
def test_warc_round_trip(spark, tmp_path, hot_share):
    big = "é😀<p>" * 30_000
    pages = [(1, "u\r\nx", "WARC/1.1\r\n\r\n" * 20), (2, None, None), (3, "", ""), (None, "z", big), (5, "q", big), (6, "q", "x" * 50), (7, "q", "x" * 50),
             (8, "q", "y" * 100), (8, "q", "y" * 100), (9, "q", "y" * 100)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, record_type string")
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        ids = [k for k, _, x in pages if k is not None and (x or "").encode() == raw]
        first = min(ids) if ids and len(raw) >= 100 else i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    path = str(tmp_path / "warc")
    warc_segments.write_warc(df, path, hot_share=hot_share)
    assert rows(warc_segments.read_warc(spark, path)) == sorted(want, key=str)
    heads = [f for p in (tmp_path / "warc").glob("part-*") for f, _ in warc_segments.parse(gzip.decompress(p.read_bytes()))]
    kinds = Counter(f["WARC-Type"] for f in heads)
    by_id = {f["WARC-Record-ID"]: f for f in heads}
    assert len(by_id) == len(heads) and all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", f["WARC-Date"]) for f in heads)
    for f in heads:
        if f["WARC-Type"] == "revisit":
            origin = by_id[f["WARC-Refers-To"]]
            assert (origin["WARC-Type"], origin["X-Page-Id"], origin["WARC-Payload-Digest"]) == ("response", f["X-Refers-To-Page"], f["WARC-Payload-Digest"])
    assert kinds["continuation"] >= 3 and kinds["revisit"] == 2


def test_warc_checks_segments():
    import pyarrow as pa
    part = {"number": 1, "total": None, "page": "1", "block": b"x"}
    with pytest.raises(ValueError):
        list(warc_segments._assemble([pa.RecordBatch.from_pylist([{"parts": [part, {**part, "number": 3, "total": 2}]}])]))
    with pytest.raises(ValueError):
        list(warc_segments._assemble([pa.RecordBatch.from_pylist([{"parts": [part, {**part, "number": 2, "total": 5}]}])]))
    assert warc_segments.dechunked(warc_segments.chunked("é" * 9000).encode()).decode() == "é" * 9000


# --- 9
def test_packing_is_lossless_and_best_fit(spark):
    r = random.Random(1)
    for n in (1, 7, 300):
        size = [r.randint(1, 100) for _ in range(n)]
        bins = []
        for x in sorted(size, reverse=True):
            fits = [b for b in bins if sum(b) + x <= 100]
            (max(fits, key=sum) if fits else bins.append([]) or bins[-1]).append(x)
        got = packing.best_fit_decreasing(size, 100)
        assert sorted(sum(b) for b in bins) == sorted(sum(size[i] for i in g) for g in got) and sorted(i for g in got for i in g) == list(range(n))
    pairs = EDGE + [(60, "<|endoftext|> is text"), (61, words(11, 4000))]
    parts = {}
    for row in packing.pack(docs_of(spark, pairs), row_tokens=256).collect():
        ids = np.frombuffer(row["input_ids"], "<u2")
        assert len(ids) == 256 and row["n_tokens"] == row["cu_seqlens"][-1] and row["position_resets"] == row["cu_seqlens"][:-1]
        for k, (a, z) in enumerate(zip(row["cu_seqlens"], row["cu_seqlens"][1:])):
            parts.setdefault(row["doc_ids"][k], []).append((row["pieces"][k], ids[a:z].tolist()))
    enc = packing.encoder(open(packing.VOCABULARY, "rb").read())
    end = enc.max_token_value + 1
    for i, t in dict(pairs).items():
        got = [x for _, p in sorted(parts[i], key=lambda x: x[0]) for x in p]
        text = b"".join(b"" if x == end else enc.decode_single_token_bytes(x) for x in got).decode()
        assert text == (t or "") * (2 if i == 5 else 1)


# --- 10
def test_secret_base_spans_and_novelty(spark):
    pairs = EDGE + [(70, 'password = "abcdefghijkl" PASSWD:short token==AAAAAAAAAAAAAA apiKey: x'), (71, "AKIAABCDEFGHIJKLMN AKIASHORT " + "0123456789abcdef" * 2),
                    (72, "the token is Xk29Lm3Qp81ZtRb7Yw4N and more"), (73, "the token is config_version_release_2024 and more"), (74, "Xk29Lm3Qp81ZtRb7Yw4N alone")]
    got = {r["doc_id"]: r for r in zstd_secrets.scan(docs_of(spark, pairs)).collect()}
    assert got[70]["spans"] == "assign:0:24,assign:39:60" and got[70]["n_assign"] == 2
    assert got[71]["spans"] == "access:0:18,hex:29:61" and got[71]["base_sha256"] == hashlib.sha256(got[71]["spans"].encode()).hexdigest()
    assert got[72]["spans"] == "novel:13:33" and got[72]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[73]["spans"] == got[74]["spans"] == got[1]["spans"] == ""


# --- all
def test_novel_spans_of_long_runs():
    """One candidate for each run of key characters, whole, in time that grows with the text."""
    key = "Zk9Qx2Lr7TwB4mVn8Yc3"
    text = f"token {key} then secret-token-{key[::-1]} end"
    assert [(text[a:z], r) for a, r, z in zstd_secrets.novel_spans(text, [])] == [(key, 3), ("-" + key[::-1], 3)]
    rnd = np.random.default_rng(5)
    run = "".join(rnd.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"), 400))
    text = f"bearer {run} and token1" + "token1" * 30_000 + " last"
    t = time.perf_counter()
    spans = zstd_secrets.novel_spans(text, [])
    assert time.perf_counter() - t < 20
    assert (7, 3, 407) in spans and len({z for _, _, z in spans}) == len(spans)


def test_novel_spans_of_every_alphabet_and_length():
    """Random text is novel whatever its alphabet, length and surroundings; names and repeated values are not."""
    r = random.Random(7)
    around = ["", words(12, 9), words(12, 100)]
    for alphabet in ("0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789",
                     "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
        for n in (16, 20, 32, 64, 96, 128, 256, 1600, 4000):
            for side in around:
                key = "7" + "".join(r.choices(alphabet, k=n - 2)) + alphabet[10]
                text = f"{side} the token is {key} {side}"
                a = text.index(key)
                assert zstd_secrets.novel_spans(text, []) == [(a, 3, a + n)], (alphabet, n, len(side))
    for name in ("config_version_release_2024", "client_secret_api_key_version_2023", "a1" * 300, "2020-01-01/application/json/2020-01-01"):
        assert zstd_secrets.novel_spans(f"{around[1]} the token is {name} {around[1]}", []) == []


def test_novel_spans_keep_whole_keys():
    """A sensitive word inside a key by chance does not cut it; keys without a digit are judged like others."""
    key = "Zk9Qx2Lr7TwB4mVn8Yc3Hd5Gs6Jf1PqA0eUiNoXbpwdQxKvTzRmWnBpYdLsHgFc"
    assert zstd_secrets.novel_spans(f"bearer {key}", []) == [(7, 3, 7 + len(key))]
    assert zstd_secrets.novel_spans(f"bearer client_secret-{key}", []) == [(20, 3, 21 + len(key))]
    r = random.Random(9)
    for alphabet in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"):
        for _ in range(20):
            assert zstd_secrets.novel_spans(f"the token is {''.join(r.choices(alphabet, k=16))} now", []) == [(13, 3, 29)]
    text = "the token " + " ".join(f"token{k}token{k * 7919 % 9973}" for k in range(300)) + "".join(f"token{k * 7919 % 9973}" for k in range(9000))
    t = time.perf_counter()
    zstd_secrets.novel_spans(text, [])
    assert time.perf_counter() - t < 60


def test_empty_tables(spark):
    d = docs_of(spark, EDGE).where("1 = 0")
    for f in (context_pii.report, context_pii.redact, quality_cascade.judge, quality_cascade.keep_good, hyperminhash.near_duplicates, hyperminhash.keep_one,
              sentencepieces.tokenize, order_minhash.report, suffix_dedup.remove_repeats, packing.pack, zstd_secrets.scan, pfair_mix.reorder):
        assert f(d).collect() == [], f.__name__
    assert warc_segments.round_trip(d.select(F.col("doc_id").alias("page_id"), F.lit("").alias("url"), F.col("text").alias("html"))).collect() == []
