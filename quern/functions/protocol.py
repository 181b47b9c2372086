"""Model text to actions: tagged responses, strict actions, SQL extraction, canonical JSON, observation limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOOLS = ("list_tables", "inspect_tables", "inspect_values", "execute_sql", "submit_sql")
TAGGED = r"(?s)^\s*<reasoning>(.*?)</reasoning>\s*<tool>\s*(\{.*\})\s*</tool>\s*$"


def parse_response(text: Column) -> Column:
    """reasoning, tool, arguments (JSON) and error of a tagged response; exactly name and arguments are allowed."""
    text = F.coalesce(text, F.lit(""))
    body = F.regexp_extract(text, TAGGED, 2)
    keys = F.json_object_keys(body)
    name = F.get_json_object(body, "$.name")
    arguments = F.get_json_object(body, "$.arguments")
    error = (
        F.when(~text.rlike(TAGGED), "invalid_format")
        .when(keys.isNull(), "invalid_json")
        .when((F.size(F.array_distinct(keys)) != 2) | ~F.array_contains(keys, "name") | ~F.array_contains(keys, "arguments"), "invalid_keys")
        .when(F.json_object_keys(arguments).isNull(), "invalid_arguments")
        .when(~name.isin(*TOOLS), "unknown_tool")
    )
    fine = error.isNull()
    return F.struct(F.when(fine, F.trim(F.regexp_extract(text, TAGGED, 1))).alias("reasoning"), F.when(fine, name).alias("tool"), F.when(fine, arguments).alias("arguments"), error.alias("error"))


def _strings(j: Column) -> Column:
    return F.from_json(j, "array<string>")


def parse_action(tool: Column, arguments: Column) -> Column:
    """The error of an action, null if it is sound: invalid_json, invalid_action or invalid_arguments.

    Each tool takes its own keys and no others; table lists hold 1 to 8 names that differ when case is folded.
    """
    keys = F.sort_array(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")))
    tables = _strings(F.get_json_object(arguments, "$.tables"))
    folded = F.array_distinct(F.transform(tables, F.lower))
    filled = lambda k: F.length(F.trim(F.coalesce(F.get_json_object(arguments, f"$.{k}"), F.lit("")))) > 0
    want = F.create_map(*(x for t, k in (("list_tables", []), ("inspect_tables", ["tables"]), ("inspect_values", ["column", "table"]), ("execute_sql", ["sql"]), ("submit_sql", ["sql"])) for x in (F.lit(t), F.array(*map(F.lit, k)).cast("array<string>"))))
    sound = (
        F.when(tool == "list_tables", F.lit(True))
        .when(tool == "inspect_tables", F.coalesce((F.size(tables) >= 1) & (F.size(tables) <= 8) & (F.size(folded) == F.size(tables)), F.lit(False)))
        .when(tool == "inspect_values", filled("table") & filled("column"))
        .otherwise(filled("sql"))
    )
    return (
        F.when(F.json_object_keys(arguments).isNull(), "invalid_json")
        .when(~F.coalesce(tool.isin(*TOOLS), F.lit(False)), "invalid_action")
        .when((keys != F.try_element_at(want, tool)) | ~sound, "invalid_arguments")
    )


def repair_completion(text: Column) -> Column:
    """A response whose last tag was left open gets it, if it parses then; else the text as it was."""
    open_tool = text.rlike("(?s)<tool>") & ~text.rlike("(?s)</tool>\\s*$")
    fixed = F.when(open_tool, F.concat(F.regexp_replace(text, r"(?s)</?(?:tool|t|to|too)?>?\s*$", ""), F.lit("</tool>"))).otherwise(text)
    return F.when(parse_response(text)["error"].isNull(), text).when(parse_response(fixed)["error"].isNull(), fixed).otherwise(text)


def extract_sql(text: Column) -> Column:
    """The SQL of an answer: without its code fence, out of {"sql": ...}, or as it is; blank is null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:sql|json)?\s*(.*?)```", 1)
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    body = bare(F.when(fenced != "", fenced).otherwise(text))
    sql = bare(F.coalesce(F.get_json_object(body, "$.sql"), body))
    return F.when(sql != "", sql)


def canonical_json(columns: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys; non-finite numbers must be made strings before (see safe_number)."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})


def safe_number(x: Column) -> Column:
    """A number as text, NaN and infinities by name."""
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").otherwise(x.cast("string"))


def safe_bytes(x: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(x)))


def cell(x: Column, limit: int) -> Column:
    """A cell cut to a number of characters, with a mark where something was cut."""
    return F.when(F.char_length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit("..."))).otherwise(x)


def fitting_rows(costs: Column, budget: int, base: Column) -> Column:
    """How many leading rows fit a token budget that `base` has been taken from."""
    start = F.struct(base.cast("long").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(a, c):
        fits = a["open"] & (a["used"] + c <= budget)
        return F.struct(F.when(fits, a["used"] + c).otherwise(a["used"]).cast("long").alias("used"), F.when(fits, a["n"] + 1).otherwise(a["n"]).alias("n"), fits.alias("open"))

    return F.aggregate(costs, start, step, lambda a: a["n"])


# The phrases by which reasoning gives away that it was shown an answer.
EXTERNAL_REFERENCE = (
    r"\bgold(?:en)?[ _-]+(?:sql|query|answer|result)\b",
    r"\b(?:provided|teacher|training|privileged)\s+hint\b",
    r"\binternal(?:ly)?\s+(?:calibrat\w*|supplied)\b",
    r"\bteacher(?:'s)?\s+(?:answer|query|sql)\b",
    r"\bcontinuation\s+instruction\b",
    r"内部校准|参考答案|教师答案|提供的查询|指定的最终\s*SQL",
)
#: What no message that a student sees may hold.
TEACHER_TAG = "<teacher_only_sql>"


def external_reference(reasoning: Column) -> Column:
    """Whether reasoning speaks of an answer it was given, in English or Chinese; a null does not."""
    return F.coalesce(reasoning.rlike("(?iuU)" + "|".join(EXTERNAL_REFERENCE)), F.lit(False))


def public(columns: list[str]) -> list[str]:
    """Columns that may leave: those without the private_ prefix."""
    return [c for c in columns if not c.startswith("private_")]


def remaining_rounds(text: Column, turn: Column, limit: int) -> Column:
    return F.concat(text, F.format_string("\n[%d of %d rounds remain]", F.lit(limit) - turn, F.lit(limit)))
