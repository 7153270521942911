"""Inputs that broke earlier versions: thousands of spans in a text, patterns found by way of others, words built to collide, clashing column names."""

import time

import numpy as np
import pytest

from textguard.llm import common, context_pii, hyperminhash, pfair_mix, sentencepieces

SCHEMA = "doc_id long, text string"


def test_thousands_of_spans_in_one_text(spark):
    def run(n):
        df = spark.createDataFrame([(1, "1.2.3.4 " * n + "tail"), (2, "a@b.co " * n + "zz"), (3, "5.6.7.8-" + "x@y.z," * n)], SCHEMA)
        begin = time.time()
        found = {r.doc_id: (r.n_ip, r.n_email) for r in context_pii.report(df).collect()}
        clean = {r.doc_id: r.text for r in context_pii.redact(df).collect()}
        assert found == {1: (n, 0), 2: (0, n), 3: (1, n)}
        assert clean[1] == "[IP] " * n + "tail" and clean[2] == "[EMAIL] " * n + "zz"
        return time.time() - begin
    run(10)
    assert run(20_000) < 20 + 12 * run(2_000)


def plain(spans, seen):
    return [w for w in seen if not any(a < w[1] and w[0] < b for a, b in spans)]


@pytest.mark.parametrize("seed", range(3))
def test_candidates_that_no_span_overlaps(spark, seed):
    rng = np.random.default_rng(seed)
    spans = sorted((int(a), int(a + n)) for a, n in zip(rng.integers(0, 4000, 700), rng.integers(1, 9, 700)))
    seen = [(int(a), int(a + n)) for a, n in zip(np.sort(rng.integers(0, 4000, 900)), rng.integers(1, 9, 900))]
    df = spark.createDataFrame([(spans, seen)], "found array<struct<start: int, end: int>>, seen array<struct<start: int, end: int>>")
    got = df.selectExpr(context_pii._free("found", "seen") + " AS free").collect()[0].free
    assert sorted((r.start, r.end) for r in got) == sorted(plain(spans, seen))


def test_discovered_instances_are_seeds_of_further_patterns(spark):
    rows = [f"please mail user{i}@site{i}.org today" for i in range(30)]
    rows += [f"please mail alpha{i}@localhost today" for i in range(20)]   # found next to the seeds
    rows += [f"kindly ping alpha{i}@localhost tonight" for i in range(20)]  # the same words in a context without a seed
    rows += ["kindly ping zed9@localhost tonight", "never see zed8@localhost here"]
    got = {r.doc_id: r.spans for r in context_pii.report(spark.createDataFrame(list(enumerate(rows)), SCHEMA)).collect()}
    assert got[70] == "ctx_email:12:26" and got[71] == ""
    assert all(got[i].startswith("ctx_email:12:") for i in range(30, 70))


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_different_words_have_different_hashes(n):
    x = thue_morse(n)
    y = x.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer(f"{x} {y} {x}".encode(), np.uint8)
    start = np.array([0, n + 1, 2 * n + 2])
    a, b, c = common.word_hash(data, start, start + n)
    assert a == c != b


def test_words_built_to_collide_are_not_linked_and_round_trip(spark):
    x = thue_morse(2048)
    texts = [f"one two {x}", f"one two {x.translate(str.maketrans('ab', 'ba'))}"]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert [r.component_id for r in sorted(hyperminhash.near_duplicates(df, 3, 85).collect())] == [0, 1]
    got = sorted(sentencepieces.tokenize(df, decoded=True).collect())
    assert all(r.round_trip for r in got) and [r.decoded for r in got] == texts


CLASH = ["base", "spans", "_row", "row", "_found", "_seen", "added", "_text", "new_text", "_gone", "mix_place", "mix_slot", "mix_block", "mix_source", "_s", "_h", "_part",
         "_c", "free", "pattern", "kind", "word", "kept", "component_id", "a.b"]


@pytest.mark.parametrize("stage", [context_pii.redact, hyperminhash.keep_one, pfair_mix.reorder])
def test_stages_keep_columns_of_any_name(spark, stage):
    df = spark.createDataFrame([(i, f"call me at +1 415 555 01{i:02} or user{i}@site.org", f"s{i % 3}", *("v" * len(CLASH))) for i in range(12)],
                               "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASH))
    out = stage(df)
    assert out.columns == df.columns
    for r in out.collect():
        assert tuple(r)[3:] == tuple("v" * len(CLASH))
