import json

from codesift.operators import responses as R

GOOD = {"line": 1, "severity": "high", "category": "logic", "issue": "i", "explanation": "e", "suggestion": "s"}


def judge(spark, docs):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "response_id int, text string")
    parsed = R.parsed(df)
    rejects = {r.response_id: r.reject for r in parsed.select("response_id", "reject").collect()}
    reasons = {(r.response_id, r.i): r.reason for r in R.items(parsed, "response_id").collect()}
    return rejects, reasons, parsed


def envelope(*items):
    return json.dumps({"suggestions": list(items)})


def test_reasons_in_order(spark):
    bad = [
        ({k: v for k, v in GOOD.items() if k != "explanation"}, "Missing required field: explanation"),
        ({**GOOD, "line": 0}, "line must be a positive number"), ({**GOOD, "line": "1"}, "line must be a positive number"),
        ({**GOOD, "line": None}, "line must be a positive number"), ({**GOOD, "severity": "warning"}, "Invalid severity: warning"),
        ({**GOOD, "severity": None}, "Invalid severity: null"), ({**GOOD, "category": "perf"}, "Invalid category: perf"),
        ({**GOOD, "issue": ""}, "issue must be a non-empty string"), ({**GOOD, "issue": 5}, "issue must be a non-empty string"),
        ({**GOOD, "line": 2.5, "explanation": None}, None), (GOOD, None), ([1], "Missing required field: line"),
        ({"severity": "x"}, "Missing required field: line"),
    ]
    _, reasons, parsed = judge(spark, [envelope(*[b for b, _ in bad])])
    assert [reasons[(0, i)] for i in range(len(bad))] == [want for _, want in bad]
    checked = R.items(parsed, "response_id")
    assert sorted(r.line for r in R.valid(checked, "response_id").collect()) == [1.0, 2.5]
    errors = {r.i: r.error for r in R.errors(checked, "response_id").collect()}
    assert errors[1] == "Suggestion[1]: line must be a positive number"
    kept = R.suggestions_per_response(parsed, "response_id").first().suggestions
    assert [s.line for s in kept] == [2.5, 1.0]


def test_whole_responses(spark):
    docs = [envelope(GOOD), "```json\n" + envelope(GOOD) + "\n```", "not json", "[]", "5", '{"suggestions": {}}',
            envelope(GOOD, "text"), envelope(None), envelope(), ""]
    rejects, reasons, _ = judge(spark, docs)
    assert [rejects[i] for i in range(len(docs))] == [
        None, None, "not JSON", R.NOT_ARRAY, R.NOT_OBJECT, R.NOT_ARRAY, "a suggestion is not an object",
        "a suggestion is not an object", None, "no text"]
    assert set(reasons) == {(0, 0), (1, 0)}
