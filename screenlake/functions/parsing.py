"""Columns that turn scorer responses into typed values. Native expressions only; bad input gives NULL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys under which a score may stand, and the wordings it is salvaged from, in order (stage, pattern).
SCORE_KEYS = ("score", "severity_score", "confidence_score")
SCORE_PATTERNS = (
    ("pattern:1", r'(?i)"score"\s*:\s*(\d+)'),
    ("pattern:2", r"(?i)score\s*:\s*(\d+)"),
    ("pattern:3", r'(?i)"score"\s*=\s*(\d+)'),
    ("pattern:4", r"(?i)score\s+is\s+(\d+)"),
    ("pattern:4", r"(?i)score\s+of\s+(\d+)"),
    ("pattern:5", r"(?i)(\d+)\s*/\s*100"),
    ("pattern:6", r"(?i)(\d+)\s+out\s+of\s+100"),
)
CONTEXT_WORDS = "score|rating|assessment|severity"
CONTEXT_REACH = 20
FLAG_KEYS = ("signal", "indicator", "overall_indicator")
WHOLE_OBJECT = r"(?s)^\s*\{.*\}\s*$"
SPACES = r"(?U)[\s\x1c-\x1f]+"

# The declared response formats, their required fields and types.
SCORE, REASONING, EXCERPTS = {"score": "int"}, {"reasoning": "string"}, {"excerpts": "array"}
FORMATS: dict[str, dict[str, str]] = {
    "Score": SCORE,
    "ScoreReasoning": SCORE | REASONING,
    "ScoreReasoningExcerpts": SCORE | REASONING | EXCERPTS,
    "ScoreReasoningExcerptsTable": SCORE | REASONING | EXCERPTS | {"table": "string"},
    "SignalReasoning": {"signal": "string"} | REASONING,
    "SignalScoreReasoning": {"signal": "string"} | SCORE | REASONING,
    "FlagReasoning": {"signal": "boolean"} | REASONING,
    "FlagScoreReasoning": {"signal": "boolean"} | SCORE | REASONING,
    "IndicatorExcerpts": {"indicator": "boolean"} | EXCERPTS,
    "OverallSignalSeverity": {"overall_indicator": "boolean", "signal": "string"} | EXCERPTS | {"severity_score": "int"} | REASONING,
    "OverallIndicatorsConfidence": {"overall_indicator": "boolean", "indicators": "array", "confidence_score": "int"} | EXCERPTS,
}
BOOLEANS = ("0", "1", "t", "f", "y", "n", "true", "false", "yes", "no", "on", "off")


def matched(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; NULL without a match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def clamped(value: Column, low: float = 0, high: float = 100) -> Column:
    """``value`` within bounds; NULL stays NULL (least and greatest would skip it)."""
    return F.when(value.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value)))


def json_field(text: Column, key: str) -> Column:
    """A key's value in a text that is one JSON object, as a string."""
    fields = F.from_json(text, f"`{key}` STRING", {"allowSingleQuotes": "false"})
    return F.when(text.rlike(WHOLE_OBJECT), fields[key])


def number(text: Column) -> Column:
    return text.try_cast("double")


def simple_score(response: Column, key: str = "score") -> Column:
    """The key's number in a JSON response, or after the quoted key in a malformed one; unclamped."""
    return F.coalesce(number(json_field(response, key)), number(matched(response, rf'"{key}"\s*:\s*"?(-?\d+(?:\.\d+)?)')))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def embedded_object(response: Column) -> Column:
    """The part from the first { to the last }; empty without one."""
    return F.regexp_extract(response, r"(?s)(\{.*\})", 1)


def found_number(text: Column, pattern: str) -> Column:
    """The number in the pattern's first match. Without a match nothing is cast, as failing casts are slow."""
    return let(F.regexp_extract(text, pattern, 1), lambda t: F.when(t != "", number(t)))


def last_fields(text: Column, keys: tuple[str, ...]) -> Column:
    """The keys' values, as text, of an object that may repeat keys: the last one counts. NULL for broken JSON."""
    ddl = ", ".join(f"`{k}` STRING" for k in keys)
    read = F.from_json(text, f"{ddl}, _broken STRING", {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_broken"})
    return let(read, lambda r: F.when(r["_broken"].isNull(), r))


def json_score(parsed: Column, key: str) -> Column:
    """A key's number, or its text of digits alone, within bounds and without its fraction; true counts as 1."""

    def of(x: Column) -> Column:
        text = x["text"]
        value = F.when(x["kind"] == "BOOLEAN", (text == "true").cast("double")).when((x["kind"] != "STRING") | text.rlike(r"^\d+$"), number(text))
        return F.floor(let(value, lambda v: clamped(v))).cast("double")

    return let(F.struct(F.try_variant_get(parsed, f"$.{key}", "string").alias("text"), F.schema_of_variant(F.try_variant_get(parsed, f"$.{key}", "variant")).alias("kind")), of)


def context_score(response: Column) -> Column:
    """The first number of at most 100 near whose first mention a scoring word stands."""

    def near(x: Column) -> Column:
        start = lambda at: F.greatest(at - CONTEXT_REACH, F.lit(0))
        words = let(F.position(x, response) - 1, lambda at: F.lower(F.substr(response, start(at) + 1, at + CONTEXT_REACH - start(at))))
        return (number(x) <= 100) & words.rlike(CONTEXT_WORDS)

    return number(F.get(F.filter(F.regexp_extract_all(response, F.lit(r"\b(\d{1,3})\b"), F.lit(1)), near), F.lit(0)))


def cascade(response: Column) -> Column:
    """A struct of the score and the stage that found it; NULL if none does.

    The order: the object's keys, the wordings, a score salvaged after its quoted key, a number in a scoring
    context. JSON is parsed once (again only if it is broken or repeats keys), and each pattern is searched at most
    once, and only where everything before it found nothing.
    """
    staged = lambda name, score: let(score, lambda v: F.when(v.isNotNull(), F.struct(v.alias("score"), F.lit(name).alias("stage"))))
    by_key = lambda parsed: F.coalesce(*(staged(f"json:{k}", json_score(parsed, k)) for k in SCORE_KEYS))
    digits = lambda text, k: F.when(text[k].rlike(r"^-?\d+(\.\d+)?$"), F.floor(let(number(text[k]), lambda v: clamped(v))).cast("double"))
    repeated = lambda text: F.coalesce(*(staged(f"json:{k}", digits(text, k)) for k in SCORE_KEYS))
    from_object = let(embedded_object(response), lambda text: F.when(text != "", let(F.try_parse_json(text), lambda parsed: F.when(parsed.isNotNull(), by_key(parsed)).otherwise(let(last_fields(text, SCORE_KEYS), repeated)))))
    wordings = [staged(stage, let(found_number(response, p), lambda v: clamped(v))) for stage, p in SCORE_PATTERNS]
    salvage = let(found_number(F.replace(response, F.lit("\\"), F.lit("")), r'(?s)"score".*?(\d+)'), lambda v: clamped(v))
    return F.coalesce(from_object, *wordings, staged("salvage", salvage), staged("context", context_score(response)))


def cascade_score(response: Column) -> Column:
    return cascade(response)["score"]


def salvaged(response: Column, keys: list[str]) -> Column:
    """Fields of a malformed object, as a struct (score, reasoning, excerpts); NULL where the field isn't found.

    White space is one space and backslashes are gone. The quoted ``keys`` are searched in the given order, each behind the one
    found before it, so a key that stands too early is missed; a field reaches to the next key found, or to the end. Of it
    score takes the first whole number; reasoning what is behind the first colon from the first letter to the last; excerpts
    what is behind the colon, between the first brackets if one opens, and to the end if none closes.
    """
    flat = F.replace(F.regexp_replace(response, SPACES, " "), F.lit("\\"), F.lit(""))
    found = "array<struct<key:string,at:int>>"

    def places(text: Column) -> Column:
        def step(acc: Column, key: Column) -> Column:
            quoted = F.concat(F.lit('"'), key, F.lit('"'))
            return let(F.call_function("locate", quoted, text, acc["from"]), lambda at: F.when(at > 0, F.struct((at + F.length(quoted)).alias("from"), F.concat(acc["parts"], F.array(F.struct(key.alias("key"), at.alias("at")))).cast(found).alias("parts"))).otherwise(acc))

        return F.aggregate(F.array(*map(F.lit, keys)), F.struct(F.lit(1).alias("from"), F.array().cast(found).alias("parts")), step, lambda acc: acc["parts"])

    def slices(text: Column) -> Column:
        def one(parts: Column) -> Column:
            def cut(part: Column) -> Column:
                start = part["at"] + F.length(part["key"]) + 2
                later = F.array_min(F.transform(F.filter(parts, lambda p: p["at"] > part["at"]), lambda p: p["at"]))
                return F.struct(part["key"].alias("key"), F.substr(text, start, F.coalesce(later, F.length(text) + 1) - start).alias("text"))

            return F.transform(parts, cut)

        return let(places(text), one)

    after_colon = lambda t, rule: let(F.position(F.lit(":"), t), lambda at: F.when(at > 0, let(F.substr(t, at + 1), rule)).when(t.isNotNull(), F.lit("")))

    def bracketed(t: Column) -> Column:
        between = let(F.struct(F.position(F.lit("["), t).alias("a"), F.position(F.lit("]"), t).alias("b")), lambda x: F.when(x["a"] == 0, t).when(x["b"] == 0, F.substr(t, x["a"] + 1)).otherwise(F.substr(t, x["a"] + 1, F.greatest(x["b"] - x["a"] - 1, F.lit(0)))))
        return F.trim(between)

    def fields(parts: Column) -> Column:
        of = lambda key: F.get(F.filter(parts, lambda p: p["key"] == key), F.lit(0))["text"]
        score = F.regexp_extract(of("score"), r"\d+", 0).try_cast("decimal(38,0)")
        reasoning = after_colon(of("reasoning"), lambda t: F.regexp_extract(t, r"(?s)\p{L}(?:.*\p{L})?", 0))
        return F.struct(score.alias("score"), reasoning.alias("reasoning"), after_colon(of("excerpts"), bracketed).alias("excerpts"))

    return let(let(flat, slices), fields)


def response_fields(response: Column) -> Column:
    """A struct of the score (there, value), the reasoning and the list of excerpts; NULL for an empty response.

    They come from a response that is one JSON object, else from what can be salvaged of it. A single excerpt is a list of
    one; other values that should be text are written as JSON.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), response, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), response, F.lit("}"))).isNotNull()
    kind_of = lambda v, k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))

    def of_object(v: Column) -> Column:
        def score(x: Column) -> Column:
            there = x["kind"].isNotNull() & (x["kind"] != "VOID")
            return F.struct(there.alias("there"), F.when(x["kind"] == "BOOLEAN", (x["text"] == "true").cast("double")).otherwise(number(x["text"])).alias("value"))

        listed = lambda kind: F.when(kind.startswith("ARRAY"), F.transform(F.try_variant_get(v, "$.excerpts", "array<string>"), lambda e: F.coalesce(e, F.lit("None")))).when(kind.isNull() | (kind == "VOID"), F.array().cast("array<string>")).otherwise(F.array(F.try_variant_get(v, "$.excerpts", "string")))
        read = F.struct(F.try_variant_get(v, "$.score", "string").alias("text"), kind_of(v, "score").alias("kind"))
        return F.struct(let(read, score).alias("score"), F.coalesce(F.try_variant_get(v, "$.reasoning", "string"), F.lit("")).alias("reasoning"), let(kind_of(v, "excerpts"), listed).alias("excerpts"))

    def of_parts(s: Column) -> Column:
        value = F.struct(s["score"].isNotNull().alias("there"), s["score"].cast("double").alias("value"))
        return F.struct(value.alias("score"), F.coalesce(s["reasoning"], F.lit("")).alias("reasoning"), F.when(s["excerpts"].isNotNull(), F.array(s["excerpts"])).otherwise(F.array().cast("array<string>")).alias("excerpts"))

    whole = F.when(response.rlike(WHOLE_OBJECT) & wrapped, F.try_parse_json(response))
    read = let(whole, lambda v: F.when(v.isNotNull() & (F.schema_of_variant(v) != "OBJECT<>"), of_object(v)).otherwise(let(salvaged(response, ["score", "reasoning", "excerpts"]), of_parts)))
    return F.when(response != "", read)


def canonical(response: Column) -> Column:
    """The response as JSON with score (rounded, half to even), reasoning and a list of excerpts; NULL without a score from 0 to 100.

    The fields are those of ``response_fields``; a missing score is the cascade's.
    """

    def written(r: Column) -> Column:
        score = F.when(r["score"]["there"], r["score"]["value"]).otherwise(cascade_score(response))
        return let(score, lambda v: F.when(v.between(0, 100), F.to_json(F.struct(F.bround(v).cast("int").alias("score"), r["reasoning"].alias("reasoning"), r["excerpts"].alias("excerpts")))))

    return let(response_fields(response), written)


def excerpts(response: Column, mode: str = "joined") -> Column:
    """The list of excerpts as text: joined by '; '. A malformed list is sliced between its brackets,
    and split at commas (mode joined) or left as it is (mode raw)."""
    listed = F.from_json(F.when(response.rlike(WHOLE_OBJECT), response), "excerpts ARRAY<STRING>", {"allowSingleQuotes": "false"})["excerpts"]
    raw = matched(response, r'(?s)"excerpts"\s*:\s*\[([^\]]*)')
    parts = F.transform(F.split(raw, ","), lambda x: F.trim(F.regexp_replace(x, r'^\s*["\']|["\']\s*$', "")))
    return F.coalesce(F.array_join(listed, "; "), F.array_join(F.filter(parts, lambda x: x != ""), "; ") if mode == "joined" else raw)


def has_field(parsed: Column, key: str, kind: str) -> Column:
    """Whether a parsed object has the field with a value that can be read as of this kind; never NULL for an object."""
    value = F.try_variant_get(parsed, f"$.{key}", "variant")
    name, text = F.schema_of_variant(value), F.try_variant_get(parsed, f"$.{key}", "string")
    number = name.rlike("^(BIGINT|DECIMAL|DOUBLE)")
    match kind:
        case "string":
            fits = name == "STRING"
        case "array":  # of strings only
            items = F.try_variant_get(parsed, f"$.{key}", "array<string>")
            fits = name.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(items, lambda x: x.isNull())
        case "boolean":
            fits = (name == "BOOLEAN") | ((name == "STRING") & F.lower(text).isin(*BOOLEANS)) | (number & text.try_cast("double").isin(0.0, 1.0))
        case _:  # whole numbers, also as text or with a zero fraction
            fits = (name == "BOOLEAN") | ((name == "STRING") & text.rlike(r"^\s*[+-]?\d+(\.0*)?\s*$")) | (number & (text.try_cast("double") == F.floor(text.try_cast("double"))))
    return F.coalesce(fits, F.lit(False))


def validated(response: Column, format_name: Column) -> Column:
    """Whether the response is one JSON object with all required fields of the declared format; other fields are let through.

    NULL, broken or surrounded JSON, repeated keys and unknown formats aren't valid.
    """
    parsed = F.try_parse_json(response)
    alone = F.try_parse_json(F.concat(F.lit("["), response, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), response, F.lit("}"))).isNotNull()
    checks = F.lit(False)
    for name, fields in FORMATS.items():
        checks = F.when(format_name == name, reduce(lambda a, b: a & b, [has_field(parsed, k, t) for k, t in fields.items()])).otherwise(checks)
    return F.coalesce(parsed.isNotNull() & alone & checks, F.lit(False))


def flag(response: Column) -> Column:
    """The first of the flag keys that the object has, as 0/1; NULL if its value is not flag-like."""
    parsed = F.try_parse_json(F.when(response.rlike(WHOLE_OBJECT), response))
    rest = F.lit(None).cast("double")
    for k in reversed(FLAG_KEYS):
        rest = F.when(F.try_variant_get(parsed, f"$.{k}", "variant").isNotNull(), flag_number(F.try_variant_get(parsed, f"$.{k}", "string"))).otherwise(rest)
    return rest


def flag_number(value: Column) -> Column:
    """Flag-like text to 1, 0 or NULL."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("1", "1.0", "true", "yes", "y"), F.lit(1.0)).when(text.isin("0", "0.0", "false", "no", "n"), F.lit(0.0))


def saved(value: Column) -> Column:
    """Whether a tracker's cell says that a batch is saved: true, yes, y or 1 as text in any case, or a number whose whole part is 1; NULL says no."""
    text = F.lower(F.trim(value.cast("string")))
    number_of = F.when(text.rlike(r"^[+-]?\d+\.\d+$"), text.try_cast("double"))
    return F.coalesce(text.isin("true", "1", "yes", "y") | ((number_of >= 1) & (number_of < 2)), text.isin("true", "1", "yes", "y"), F.lit(False))


def period(headline: Column) -> tuple[Column, Column]:
    """Quarter and year of a headline such as '..., Q3 2011 Earnings Call'."""
    pattern = r"Q([1-4])\s+(\d{4})"
    return matched(headline, pattern, 1).try_cast("bigint"), matched(headline, pattern, 2).try_cast("bigint")
