"""Bodies of chat requests as those of response requests, and back, by DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ITEM = "struct<type:string,role:string,content:array<struct<type:string,text:string>>>"


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def content_text(content: Column) -> Column:
    """The text of a message's content: a string, or the texts of its parts in a row; null is ''."""
    part = lambda p: F.when(_is(p, "OBJECT"), F.coalesce(_get(p, "$.text", "string"), F.lit(""))).otherwise("")
    parts = F.array_join(F.transform(_get(content, "$", "array<variant>"), part), "")
    return F.coalesce(F.when(_is(content, "ARRAY"), parts).otherwise(_get(content, "$", "string")), F.lit(""))


def _list(body: Column, path: str) -> Column:
    return F.coalesce(_get(body, path, "array<variant>"), F.array().cast("array<variant>"))


def chat_to_responses(chat: Column) -> Column:
    """A chat request (JSON) as a response request (JSON).

    Texts of system and developer messages become the instructions, an empty line
    between them; others become items, those of tools as a user's. Token limits take
    their other name; stream, tools, tool_choice and a reasoning object pass; what else
    there is does not. What is no JSON object gives null.
    """
    body = F.try_parse_json(chat)
    rows = F.transform(_list(body, "$.messages"), lambda m: F.struct(_get(m, "$.role", "string").alias("role"), content_text(_get(m, "$.content", "variant")).alias("text")))
    ruling = lambda m: F.coalesce(m["role"].isin("system", "developer"), F.lit(False))
    told = F.transform(F.filter(rows, lambda m: ruling(m) & (m["text"] != "")), lambda m: m["text"])

    def item(m: Column) -> Column:
        own = F.coalesce(m["role"] == "assistant", F.lit(False))
        content = F.array(F.struct(F.when(own, "output_text").otherwise("input_text").alias("type"), m["text"].alias("text")))
        return F.struct(F.lit("message").alias("type"), F.when(own, "assistant").otherwise("user").alias("role"), content.alias("content"))

    reasoning, tools = _get(body, "$.reasoning", "variant"), _get(body, "$.tools", "variant")
    limit = F.coalesce(*[F.nullif(_get(body, f"$.{k}", "bigint"), F.lit(0)) for k in ("max_completion_tokens", "max_tokens")])
    out = F.struct(
        _get(body, "$.model", "string").alias("model"),
        F.when(F.size(told) > 0, F.array_join(told, "\n\n")).alias("instructions"),
        F.transform(F.filter(rows, lambda m: ~ruling(m)), item).alias("input"),
        limit.alias("max_output_tokens"),
        F.when(_get(body, "$.stream", "boolean"), True).alias("stream"),
        F.when(F.size(_get(body, "$.tools", "array<variant>")) > 0, tools).alias("tools"),
        _get(body, "$.tool_choice", "variant").alias("tool_choice"),
        F.when(_is(reasoning, "OBJECT"), reasoning).alias("reasoning"),
    )
    return F.when(_is(body, "OBJECT"), F.to_json(out))


def responses_to_messages(request: Column) -> Column:
    """array<struct<role, text>>: the messages of a response request (JSON), instructions first as
    a system message; the way back of ``chat_to_responses`` but for names of roles."""
    body = F.from_json(request, f"instructions string, input array<{_ITEM}>")
    text = lambda i: F.array_join(F.transform(i["content"], lambda c: F.coalesce(c["text"], F.lit(""))), "")
    others = F.transform(F.coalesce(body["input"], F.array().cast(f"array<{_ITEM}>")), lambda i: F.struct(i["role"].alias("role"), text(i).alias("text")))
    first = F.array(F.struct(F.lit("system").alias("role"), body["instructions"].alias("text")))
    return F.when(body["instructions"].isNotNull(), F.concat(first, others)).otherwise(others)


def responses_to_chat(response: Column, model: Column, created: Column) -> Column:
    """A response (JSON) as a chat completion (JSON): its texts in a row, its function calls, usage and why it ended."""
    body = F.try_parse_json(response)
    output = _list(body, "$.output")
    kind = lambda i: F.coalesce(_get(i, "$.type", "string"), F.lit(""))
    shown = lambda i: F.array_join(F.transform(F.filter(_list(i, "$.content"), lambda c: kind(c).isin("output_text", "text")), lambda c: F.coalesce(_get(c, "$.text", "string"), F.lit(""))), "")
    text = F.array_join(F.transform(F.filter(output, lambda i: kind(i) == "message"), shown), "")

    def call(i: Column, k: Column) -> Column:
        key = F.coalesce(F.nullif(_get(i, "$.call_id", "string"), F.lit("")), F.nullif(_get(i, "$.id", "string"), F.lit("")), F.concat(F.lit("call_"), k.cast("string")))
        function = F.struct(F.coalesce(_get(i, "$.name", "string"), F.lit("")).alias("name"), F.coalesce(_get(i, "$.arguments", "string"), F.lit("")).alias("arguments"))
        return F.struct(key.alias("id"), F.lit("function").alias("type"), function.alias("function"))

    calls = F.transform(F.filter(output, lambda i: kind(i) == "function_call"), call)
    some = F.size(calls) > 0
    count = lambda path: _get(body, f"$.usage.{path}", "bigint")
    prompt, completion = F.coalesce(count("input_tokens"), F.lit(0)), F.coalesce(count("output_tokens"), F.lit(0))
    detail = lambda path, name: F.when(count(path).isNotNull(), F.struct(count(path).alias(name)))
    usage = F.struct(
        prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), F.coalesce(count("total_tokens"), prompt + completion).alias("total_tokens"),
        detail("output_tokens_details.reasoning_tokens", "reasoning_tokens").alias("completion_tokens_details"), detail("input_tokens_details.cached_tokens", "cached_tokens").alias("prompt_tokens_details"),
    )
    message = F.struct(F.lit("assistant").alias("role"), F.when((text != "") | ~some, text).alias("content"), F.when(some, calls).alias("tool_calls"))
    finish = F.when(some, "tool_calls").when(_get(body, "$.status", "string") == "incomplete", "length").otherwise("stop")
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"), finish.alias("finish_reason"))
    out = F.struct(F.coalesce(_get(body, "$.id", "string"), F.lit("chatcmpl")).alias("id"), F.lit("chat.completion").alias("object"), created.alias("created"), model.alias("model"), F.array(choice).alias("choices"), usage.alias("usage"))
    return F.when(_is(body, "OBJECT"), F.to_json(out))
