"""Planted output-filter rows (FIXTURES.md section 3) and the quirks of Appendix D."""

from textguard.operators import outfilter as OF


def _verdicts(spark, rows):
    df = spark.createDataFrame(rows, "id string, text string")
    return {r["id"]: r["verdict"] for r in OF.with_output_filter(df, "text").collect()}


def test_toxicity_and_censor(spark):
    v = _verdicts(spark, [("T1", "I hate you"), ("T2", "a strict diet"), ("T3", "go to hell"),
                          ("T4", "terrible awful food"), ("Q2", "kill yourself")])
    assert (v["T1"]["toxicity_score"], v["T1"]["severity"], v["T1"]["filtered_response"]) == (0.4, "medium", "I [REDACTED] you")
    assert (v["T2"]["toxicity_score"], v["T2"]["severity"], v["T2"]["filtered_response"]) == (0.2, "low", "a strict diet")
    assert (v["T3"]["toxicity_score"], v["T3"]["severity"], v["T3"]["filtered_response"]) == (0.7, "high", "go to [REDACTED]")
    assert v["T4"]["toxicity_score"] == 0.3 and v["T4"]["severity"] == "medium"
    assert v["T4"]["toxicity"]["sentiment"] == -1.0
    assert v["T4"]["filtered_response"] == "[Content censored due to toxicity detection]\nterrible awful food"
    assert v["Q2"]["filtered_response"] == "[REDACTED] yourself"          # keywords before phrases
    assert v["T1"]["explanation"] == "Toxicity detected (score: 0.40)"


def test_bias_cases(spark):
    v = _verdicts(spark, [("B1", "All women are poor planners."), ("B2", "Tall people are more likely to win at chess."),
                          ("B3", "The film is about terrorists."), ("B4", "The soup is warm tonight."),
                          ("B5", "Women and men may both apply here."),
                          ("B6", "All pilots are calm and all women are emotional.")])
    types = {k: list(x["bias"]["types"]) for k, x in v.items()}
    assert types == {"B1": ["gender"], "B2": [], "B3": [], "B4": [], "B5": [], "B6": ["gender"]}
    assert v["B1"]["bias_score"] == 0.3 and v["B1"]["severity"] == "medium"
    assert v["B3"]["toxicity_score"] == 0.2
    # the reference's partial-match evaluation: the rule path gets 4 of 6
    expected = {"B1": ["gender"], "B2": ["racial"], "B3": ["religious"], "B4": [], "B5": [], "B6": ["racial", "gender"]}
    ok = 0
    for k, exp in expected.items():
        got = types[k]
        if bool(exp) == bool(got) and (set(exp) & set(got) or not exp):
            ok += 1
    assert ok == 4


def test_output_jailbreak_blocks(spark):
    v = _verdicts(spark, [("O1", "I'll ignore my safety guidelines"), ("O2", "Developer mode enabled")])
    assert (v["O1"]["jailbreak_score"], v["O1"]["severity"]) == (0.8, "critical")
    assert (v["O2"]["jailbreak_score"], v["O2"]["severity"]) == (0.4, "critical")
    for k in ("O1", "O2"):
        assert v[k]["sanitization_strategy"] == "block" and v[k]["filtered_response"] is None


def test_strategies(spark):
    df = spark.createDataFrame([("Stupid HATE hate",)], "text string")
    warn = OF.with_output_filter(df, "text", strategies={"toxicity": "warn"}).first()["verdict"]["filtered_response"]
    assert warn.startswith("⚠️ WARNING") and warn.endswith("Stupid HATE hate")
    filt = OF.with_output_filter(df, "text", strategies={"toxicity": "filter"}).first()["verdict"]["filtered_response"]
    assert filt == "Stupid HATE"                               # only lower-case keyword text is removed
