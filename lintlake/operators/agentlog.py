"""Agent session logs: JSON lines of two dialects to typed events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions.text import trim

_PART = "array<struct<type:string,text:string>>"
_CALL = "struct<args:struct<path:string>>"
SCHEMA = (
    f"struct<type:string,subtype:string,content:{_PART},message:struct<content:{_PART}>,"
    f"tool_call:struct<name:string,args:struct<path:string>,readToolCall:{_CALL},writeToolCall:{_CALL},searchReplaceToolCall:{_CALL}>>"
)


def events(lines: DataFrame) -> DataFrame:
    """session, seq, kind (start, text, tool, done), text, tool, file from (session, seq, line).

    Lines that are no JSON object or of no known type are left out. A file is the last two parts of its path.
    """
    d = lines.where(F.try_parse_json("line").isNotNull()).withColumn("j", F.from_json("line", SCHEMA))
    kind, sub = F.col("j.type"), F.col("j.subtype")
    said = F.filter(F.coalesce("j.message.content", "j.content"), lambda c: (c["type"] == "text") & (c["text"] != ""))
    text = trim(F.get(said, 0)["text"])
    call = F.col("j.tool_call")
    other = F.coalesce(call["readToolCall"], call["writeToolCall"], call["searchReplaceToolCall"])
    tool = F.when(call["readToolCall"].isNotNull(), "Reading").when(call["writeToolCall"].isNotNull(), "Writing").when(call["searchReplaceToolCall"].isNotNull(), "Editing").otherwise(F.coalesce(call["name"], F.lit("tool")))
    parts = F.split(F.coalesce(other["args"]["path"], call["args"]["path"]), "/")
    file = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")
    what = (
        F.when((kind == "message_start") | ((kind == "system") & (sub == "init")), "start")
        .when(kind.isin("message_delta", "assistant") & (text != ""), "text")
        .when(kind.isin("tool_use", "tool_call") & (sub == "started"), "tool")
        .when((kind == "message_stop") | ((kind == "result") & (sub == "success")), "done")
    )
    d = d.withColumn("kind", what).where("kind is not null")
    return d.select(
        "session", "seq", "kind", F.when(F.col("kind") == "text", text).alias("text"), F.when(F.col("kind") == "tool", tool).alias("tool"), F.when(F.col("kind") == "tool", F.coalesce(file, F.lit(""))).alias("file")
    )
