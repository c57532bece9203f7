"""Parts of model responses and of the texts in them, as columns: JSON paths and patterns, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOOLS = "array<struct<id:string,name:string,input:string,function:struct<name:string,arguments:string>>>"
_BLOCKS = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string>>"


def _blocks(root: Column, path: str) -> Column:
    return F.from_json(F.get_json_object(root, path), _BLOCKS)


def _joined(blocks: Column, kind: str, field: str) -> Column:
    return F.nullif(F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == kind) & b[field].isNotNull()), lambda b: b[field]), "\n"), F.lit(""))


def content(root: Column) -> Column:
    """Text of a response: the first choice (a text, or blocks of text), then content blocks, then output_text."""
    message = F.get_json_object(root, "$.choices[0].message.content")
    parts = F.when(message.startswith("["), _joined(_blocks(root, "$.choices[0].message.content"), "text", "text")).otherwise(F.nullif(message, F.lit("")))
    delta = F.nullif(F.get_json_object(root, "$.choices[0].delta.content"), F.lit(""))
    return F.coalesce(parts, delta, _joined(_blocks(root, "$.content"), "text", "text"), F.get_json_object(root, "$.output_text"))


def thinking(root: Column) -> Column:
    return F.coalesce(_joined(_blocks(root, "$.content"), "thinking", "thinking"), F.get_json_object(root, "$.choices[0].message.reasoning_content"))


def usage(root: Column) -> Column:
    """(prompt, completion) tokens under either name; 0 where missing."""
    number = lambda *names: F.coalesce(*[F.get_json_object(root, f"$.usage.{n}").try_cast("bigint") for n in names], F.lit(0))
    return F.struct(number("prompt_tokens", "input_tokens").alias("prompt"), number("completion_tokens", "output_tokens").alias("completion"))


def tool_calls(root: Column) -> Column:
    """Array of (id, name, arguments): of the first choice's message, else of the content blocks that use a tool."""
    calls = F.from_json(F.get_json_object(root, "$.choices[0].message.tool_calls"), _TOOLS)
    own = F.transform(calls, lambda c: F.struct(c["id"].alias("id"), c["function"]["name"].alias("name"), c["function"]["arguments"].alias("arguments")))
    used = F.filter(_blocks(root, "$.content"), lambda b: b["type"] == "tool_use")
    return F.coalesce(F.when(F.size(own) > 0, own), F.transform(used, lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name"), b["input"].alias("arguments"))))


def last_code_block(text: Column) -> Column:
    """The last fence marked json that isn't empty (an unclosed one runs to the end), else the last fence of any kind; null without one."""

    def last(pattern: str) -> Column:
        found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
        return F.get(found, F.size(found) - 1)

    return F.coalesce(last(r"(?s)```json\s*\n?(.*?)(?:```|\z)"), last(r"(?s)```[a-zA-Z]*\s*\n?(.*?)(?:```|\z)"))


def tail(text: Column, most: int, mark: str = "...") -> Column:
    """The last `most` bytes on a character border, after a mark where it is cut."""
    raw = F.hex(F.substring(text.cast("binary"), -most, most))
    whole = F.decode(F.unhex(F.regexp_replace(raw, "^([89AB][0-9A-F]){1,3}", "")), "UTF-8")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.lit(mark), whole))


def repaired(rows: DataFrame, text: str, out: str = "value") -> DataFrame:
    """rows with `out`: the JSON that jsonx.parse_lenient() reads in the text, written with sorted keys; null where it reads none. Also last_object, last_array and balanced (braces repaired)."""
    from collections.abc import Iterator

    from gleaner.functions import jsonx

    names, fields = rows.columns, rows.schema.fields

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b[text]]
            values = [jsonx.parse_lenient(t) for t in texts]
            b = b.copy()
            b[out] = [None if v is None else jsonx.dumps(v) for v in values]
            b["last_object"] = [jsonx.last_balanced(t, "{") for t in texts]
            b["last_array"] = [jsonx.last_balanced(t, "[") for t in texts]
            b["balanced"] = [jsonx.repair_braces(t) for t in texts]
            yield b[[*names, out, "last_object", "last_array", "balanced"]]

    from pyspark.sql.types import StringType, StructField, StructType

    return rows.mapInPandas(run, StructType([*fields, *(StructField(n, StringType()) for n in (out, "last_object", "last_array", "balanced"))]))
