"""Cases from the review of the second round."""

import json

from lintlake.operators import responses as RE

FINITE = (0, 1)


def by_json(text):
    """Titles and lines of what Python's own reader lets through."""
    try:
        found = list(json.loads(text)["findings"])
    except (ValueError, KeyError, TypeError):
        return []
    number = lambda x, low, high: isinstance(x, (int, float)) and low <= x <= high
    return [(f["title"], f.get("line_start")) for f in found
            if isinstance(f.get("title"), str) and number(f.get("confidence", 0.5), *FINITE) and (f.get("line_start") is None or number(f["line_start"], -9e8, 9e8))]


def test_numbers_that_are_none_cost_their_finding_only(spark):
    good = '{"title":"good \\\\\\" NaN, Infinity: [-Infinity] \\\\","confidence":0.5,"line_start":3}'
    odd = ['{"title":"a","confidence":NaN}', '{"title":"b","line_start":Infinity}', '{"title":"c","line_start":-Infinity,"confidence":0.1}', '{"title":NaN}',
           '{"title":"d","other":[NaN,-Infinity,{"x":Infinity}]}', '{"title":"e","confidence":-NaN}', '{"title":"f","confidence":NaNs}', '{"title":"g","confidence":"x']
    texts = ['{"findings":[' + good + "," + o + ', {"title":"z"}]}' for o in odd]
    texts += ['{"findings":NaN}', "NaN", "Infinity", '{"findings":[' + good + '],"score":-Infinity}', '{"findings":[' + good + '],"score": NaN , "NaN":"NaN"}']
    # Long answers, with many strings and many escapes.
    texts += ['{"findings":[' + ",".join([good] * 20_000) + ',{"title":"' + '\\\\n' * 200_000 + '","confidence":NaN}]}']
    df = spark.createDataFrame([(i, "a.py", "llm", t) for i, t in enumerate(texts)], "job_id long, file_path string, model_used string, response_text string")
    got = {i: [] for i in range(len(texts))}
    for r in RE.normalised(df).orderBy("det_ordinal").collect():
        got[r["job_id"]].append((r["title"], r["line_start"]))
    assert got == {i: by_json(t) for i, t in enumerate(texts)}
    assert [len(got[i]) for i in range(8)] == [2, 2, 2, 2, 3, 0, 0, 0]
