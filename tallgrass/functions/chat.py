"""Chat messages, tool calls and placeholders as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CALL = "struct<name:string,arguments:map<string,string>>"


def tool_calls(text: Column) -> Column:
    """Calls in <tool_call> tags, in order; those that aren't JSON with a name are skipped."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.from_json(x, CALL)), lambda c: c["name"].isNotNull())


def without_calls(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<tool_call>.*?</tool_call>", "")


def gpt_oss_calls(text: Column) -> Column:
    """(name, arguments) of functions that a commentary channel addresses, analysis spans left out."""
    plain = F.regexp_replace(text, r"(?s)<\|channel\|>analysis<\|message\|>.*?<\|end\|>", "")
    pattern = r"(?s)to=functions\.(\w+).*?<\|message\|>(\{.*?\})<\|call\|>"
    return F.arrays_zip(F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(plain, F.lit(pattern), F.lit(2)).alias("arguments"))


def split_placeholders(content: Column) -> Column:
    """Text cut at <image> and <video>, as typed parts in order; empty texts are left out."""
    parts = F.split(content, r"(?=<image>|<video>)|(?<=<image>|<video>)")
    typed = F.transform(parts, lambda p: F.struct(F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text").alias("type"), F.when(~p.isin("<image>", "<video>"), p).alias("text")))
    return F.filter(typed, lambda p: (p["type"] != "text") | (p["text"] != ""))


def flatten_parts(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "text", p["text"]).otherwise(F.concat(F.lit("<"), p["type"], F.lit(">")))), "")


def shorten(text: Column, limit: int, side: str = "middle") -> Column:
    """Text over a limit with its cut marked; left keeps the beginning, right the end."""
    n = F.length(text)
    if side == "left":
        cut = F.concat(F.left(text, F.lit(limit)), F.lit("...(truncated)"))
    elif side == "right":
        cut = F.concat(F.lit("(truncated)..."), F.right(text, F.lit(limit)))
    else:
        half = limit // 2
        cut = F.concat(F.left(text, F.lit(half)), F.lit("...(truncated)..."), F.right(text, F.lit(half)))
    return F.when(n <= limit, text).otherwise(cut)


def passages(docs: Column) -> Column:
    """Documents (title, text) as numbered lines."""
    return F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), d["title"], F.lit(") "), d["text"], F.lit("\n"))), "")


def last_of(messages: Column, role: str) -> Column:
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"]


def token_count(text: Column) -> Column:
    """The default tokenizer: runs of anything but white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


SHORT_SYSTEM = "You are a helpful assistant."


def truncated(messages: Column, budget: int) -> Column:
    """The first of these that fits: all messages; with a short system message; without one; then with the short one, if there was any, and without the oldest pairs of user and assistant, while more than two messages are left. Null where none does."""
    size = lambda ms: F.aggregate(ms, F.lit(0), lambda a, m: a + token_count(m["content"]))
    short = F.transform(messages, lambda m: F.when(m["role"] == "system", m.withField("content", F.lit(SHORT_SYSTEM))).otherwise(m))
    rest = F.filter(messages, lambda m: m["role"] != "system")
    first = F.when(F.get(messages["role"], 0) == "system", 1).otherwise(0)
    steps = F.when(F.size(short) > 2, F.sequence(F.lit(1), F.floor((F.size(short) - first) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    dropped = F.transform(steps, lambda k: F.concat(F.slice(short, 1, first), F.slice(short, first + 2 * k + 1, F.greatest(F.size(short) - first - 2 * k, F.lit(0)))))
    # the last step is the one that leaves two or fewer
    enough = F.filter(dropped, lambda ms, k: (F.size(ms) > 0) & ((k == 0) | (F.size(F.get(dropped, k - 1)) > 2)))
    every = F.concat(F.array(messages, short), F.filter(F.array(rest), lambda ms: (F.size(ms) > 0) & (F.size(ms) < F.size(messages))), enough)
    return F.try_element_at(F.filter(every, lambda ms: size(ms) <= budget), F.lit(1))
