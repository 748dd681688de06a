"""The response parser on written-out cases, and on corrupted JSON, which must never raise."""

import json
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from screenlake.functions import expr, parsing
from screenlake.operators import documents

CASES = [('{"score": 80}', 80), ('{"score": "80"}', 80), ('{"score": 75.9}', 75), ('{"score": 180}', 100), ('x {"severity_score": 7} y', 7), ("Score: 55", 55), ("it is 40/100", 40), ("40 out of 100", 40), ('{"score": 61, "rea', 61), ("nothing", None), ("", None), (None, None), ("assessment maybe 33", 33)]
CASES += [("Margins rose 12% on the year.", None), ("severity 180", None), ("the rating: I think 40", 40), ("the rating was, I think, 40", None), ("Score is 7 or a score of 8", 7), ("a score of 8, 9/100", 8), ("score: 250", 100), ('{"score": null, "severity_score": 9}', 9), ('{"score": "12x"} 30 out of 100', 30), ('{"score": \\"44', 44), ('{"score": true}', 1), ("5 cats, score unknown", 5), ("12 and much later, after many other words, a score", None), ("75 bps at a ratio of 75, rating 75", None), ("rated 50 overall", None)]


def test_cascade(spark):
    df = spark.createDataFrame([(c,) for c, _ in CASES], "r string")
    assert [x[0] for x in df.select(parsing.cascade_score(F.col("r"))).collect()] == [v for _, v in CASES]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_never_raises(spark, texts):
    df = spark.createDataFrame([('{"score": 5, "excerpts": ["a"]' + t.replace("\x00", ""),) for t in texts], "r string")
    r = F.col("r")
    assert len(df.select(parsing.cascade_score(r), parsing.excerpts(r), parsing.flag(r), parsing.salvaged(r, ["score", "excerpts"]), parsing.canonical(r)).collect()) == len(texts)


def fields_of(text, keys):
    """The fields by a plain reading of the rule: quoted keys in the given order, slices between them."""
    text = re.sub(r"\s+", " ", text).replace("\\", "")
    places, at = [], 0
    for k in keys:
        p = text.find(f'"{k}"', at)
        if p >= 0:
            places.append((k, p))
            at = p + len(k) + 2
    out = {"score": None, "reasoning": None, "excerpts": None}
    for (k, p), (_, end) in zip(places, [*places[1:], ("", len(text))]):
        part = text[p + len(k) + 2 : end]
        if k == "score":
            found = re.search(r"\d+", part)
            out[k] = int(found.group()) if found else None
            continue
        _, colon, rest = part.partition(":")
        if k == "reasoning":
            letters = [i for i, c in enumerate(rest) if c.isalpha()]
            out[k] = rest[letters[0] : letters[-1] + 1] if letters else ""
        else:
            a, b = rest.find("["), rest.find("]")
            out[k] = (rest if a < 0 else rest[a + 1 :] if b < 0 else rest[a + 1 : b]).strip(" ") if colon else ""
    return out


SALVAGE = ['{"reasoning": "75% certain."}', '{"reasoning": "a", "score": 4', '{"score": 80, "score": 20, "reasoning": "no, 3', '{"score" 5 "reasoning" none "excerpts" ]x[ y', '{"score": "x1y22", "reasoning": 12, "excerpts": ["a", "b"', '{"excerpts": ["q"], "score": 3}', '"score"', '{"score":\t7,\n"reasoning":\t"Zoë \\"said\\" so…", "excerpts": a]b[c]}', "", "nothing", '{"excerpts": [\n]']


@pytest.mark.parametrize("keys", [["score", "reasoning", "excerpts"], ["excerpts", "score", "reasoning"], ["reasoning"]])
def test_salvage_of_written_cases(spark, keys):
    df = spark.createDataFrame([(c,) for c in SALVAGE], "r string")
    got = [x[0].asDict() for x in df.select(parsing.salvaged(F.col("r"), keys)).collect()]
    assert got == [fields_of(c, keys) for c in SALVAGE]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(['"score"', '"reasoning"', '"excerpts"', ":", "[", "]", "12", "é", "a b", " ", "\n", "\\", ",", "{", "}", '"']), max_size=24), min_size=20, max_size=40))
def test_salvage_of_any_text(spark, parts):
    texts, keys = ["".join(p) for p in parts], ["score", "reasoning", "excerpts"]
    df = spark.createDataFrame([(c,) for c in texts], "r string")
    assert [x[0].asDict() for x in df.select(parsing.salvaged(F.col("r"), keys)).collect()] == [fields_of(c, keys) for c in texts]


CANONICAL = [
    ('{"score": 80, "reasoning": "why", "excerpts": ["a", 2, null]}', (80, "why", ["a", "2", "None"])), ('{"score": "70.5", "excerpts": "one"}', (70, "", ["one"])), ('{"score": 71.5}', (72, "", [])), ('{"score": true, "reasoning": null}', (1, "", [])),
    ('{"score": 180}', None), ('{"score": -1, "reasoning": "r"}', None), ('{"score": [5]}', None), ('{"severity_score": 40, "reasoning": "r"}', (40, "r", [])), ("Score: 55", (55, "", [])), ('{"score": 61, "reasoning": "cut o', (61, "cut o", [])),
    ('So {"score": 4, "excerpts": ["x", "y"]} ok', (4, "", ['"x", "y"'])), ("{}", None), ("", None), (None, None), ("nothing", None), ('{"score": null, "reasoning": "the rating is 30"}', (30, "the rating is 30", [])), ('{"score": 5} {"score": 6}', (5, "", [])), ('{"score": 5, "reasoning": 7, "excerpts": 3}', (5, "7", ["3"])),
]


def test_canonical_responses(spark):
    df = spark.createDataFrame([(c,) for c, _ in CANONICAL], "r string")
    got = [x[0] and tuple(json.loads(x[0]).values()) for x in df.select(parsing.canonical(F.col("r"))).collect()]
    assert got == [v for _, v in CANONICAL]


def test_the_last_of_repeated_keys_counts(spark):
    df = spark.createDataFrame([('{"score": 80, "score": 20}',), ('a {"score": 1, "score": 250} b',), ('{"score": 80, "score": "x"}',)], "r string")
    assert [tuple(x[0]) for x in df.select(parsing.cascade(F.col("r"))).collect()] == [(20.0, "json:score"), (100.0, "json:score"), (80.0, "pattern:1")]


def test_each_pattern_is_once_in_the_plan(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("r")).select(parsing.cascade(F.col("r")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == len(parsing.SCORE_PATTERNS) + 2 and plan.count("parse_json") <= 2


def test_assembly(spark):
    turns = [(1, 2, "Answer", None, " \tlate\x85 "), (1, 1, None, "CEO", "a\\\\b \x07c\r 🙂é\x9f\nd "), (1, 3, "Q", "x", None), (2, None, None, None, "")]
    df = spark.createDataFrame(turns, "doc int, turn int, kind string, who string, text string")
    got = {r["doc"]: r["text"] for r in documents.assembled(df, "doc", "turn", "kind", "who", "text").collect()}
    assert got == {1: "Comment from CEO: a\\b c é\nd\n\nAnswer from Call Participant: late\n\nQ from x: \n", 2: "Comment from Call Participant: \n"}


def test_first_flag_key_decides(spark):
    cases = [('{"signal": true, "indicator": false}', 1), ('{"indicator": "no"}', 0), ('{"signal": null, "indicator": true}', None), ('{"signal": "maybe", "indicator": true}', None), ('{"overall_indicator": 1}', 1), ('{"signal": "t"}', None), ("{}", None), (None, None), ("x", None)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "r string")
    assert [x[0] for x in df.select(parsing.flag(F.col("r"))).collect()] == [v for _, v in cases]


def test_declared_formats(spark):
    cases = [
        ("SignalReasoning", '{"signal": "s", "reasoning": "r"}', True), ("FlagReasoning", '{"signal": true, "reasoning": "r", "more": 1}', True), ("FlagReasoning", '{"signal": "maybe", "reasoning": "r"}', False),
        ("IndicatorExcerpts", '{"indicator": false, "excerpts": []}', True), ("IndicatorExcerpts", '{"indicator": 2, "excerpts": []}', False), ("IndicatorExcerpts", '{"indicator": true, "excerpts": ["a", null]}', False), ("IndicatorExcerpts", '{"indicator": true, "excerpts": [1]}', False),
        ("OverallSignalSeverity", '{"overall_indicator": true, "signal": "s", "excerpts": ["e"], "severity_score": 3, "reasoning": "r"}', True), ("OverallIndicatorsConfidence", '{"overall_indicator": true, "indicators": ["i"], "confidence_score": 300, "excerpts": ["e"]}', True),
        ("ScoreReasoning", '{"score": 5}', False), ("ScoreReasoning", '{"score": 5, "reasoning": 7}', False), ("ScoreReasoningExcerpts", '{"score": 5, "reasoning": "r", "excerpts": null}', False),
        ("Score", '{"score": 5.0}', True), ("Score", '{"score": "5"}', True), ("Score", '{"score": 5.5}', False), ("Score", '{"score": "x"}', False), ("Score", ' {"score": 5} \n', True), ("Score", 'So {"score": 5}', False), ("Score", '{"score": 5} so', False), ("Score", '{"score": 5}, {}', False), ("Score", '{"score": 5}] {}', False), ("Score", "[5]", False), ("Score", None, False), ("None", '{"score": 5}', False), (None, '{"score": 5}', False),
    ]
    df = spark.createDataFrame([(i, f, r) for i, (f, r, _) in enumerate(cases)], "i int, f string, r string")
    got = {x["i"]: x["v"] for x in df.select("i", parsing.validated(F.col("r"), F.col("f")).alias("v")).collect()}
    assert [c for i, c in enumerate(cases) if got[i] != c[2]] == [] and len(parsing.FORMATS) == 11


def test_accents_of_whole_texts(spark, small):
    from __spark_entry__ import queries

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if ord(c) < 128)
    got = {r["doc_id"]: r["full_folded"] for r in queries()["fold_document_accents"](spark, small).collect()}
    assert got == {i: None if t is None else plain(t) for i, t in docs.items()} and any(t and plain(t) != t for t in docs.values())
    odd = ["ﬁn ½ Å 한 ① ǆ", "", "e\u0301", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", expr.fold_accents_full(F.col("t")).alias("f")).collect()
    assert {r["i"]: r["f"] for r in rows} == {i: None if t is None else plain(t) for i, t in enumerate(odd)}


def test_folding_all_of_unicode(spark):
    """Every character alone and all of them in long texts, against the standard library; no Python in the plan."""
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(every[k : k + 977]) for k in range(0, len(every), 977)] + [f"a{c}b" for c in expr.ascii_parts()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(8)
    folded = df.select("i", expr.fold_accents_full(F.col("t")).alias("f"))
    assert not any(w in folded._jdf.queryExecution().executedPlan().toString() for w in ("Python", "Arrow"))
    got = {r["i"]: r["f"] for r in folded.collect()}
    assert [t for i, t in enumerate(texts) if got[i] != unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()] == []


def test_saved_cells(spark):
    cases = [("True", True), (" yes ", True), ("1", True), ("1.0", True), ("1.9", True), ("y", True), ("0", False), ("2.0", False), ("false", False), ("t", False), ("", False), ("nan", False), (None, False)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "v string")
    assert [x[0] for x in df.select(parsing.saved(F.col("v"))).collect()] == [v for _, v in cases]
    assert spark.range(3).select(parsing.saved(F.col("id") == 1)).collect() == [(False,), (True,), (False,)]


def test_expressions(spark):
    row = spark.createDataFrame([("0161", " t ", "Énorme", 0, 0)], "c string, l string, a string, h int, n int")
    low, high = expr.wilson(F.col("h").cast("double"), F.col("n").cast("double"))
    got = row.select(expr.zero_padded(F.col("c"), 3), expr.zero_padded(F.col("c"), 6), expr.normal_label(F.col("l")), expr.fold_accents(F.col("a")), expr.fold_accents_full(F.col("a")), low, high).first()
    assert tuple(got) == ("0161", "000161", "T", "Enorme", "Enorme", None, None)
