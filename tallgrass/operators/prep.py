"""Preparation of prompt, response and preference tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet and JSON files as one table; other suffixes are refused."""
    frames = []
    for p in paths:
        if p.endswith(".parquet"):
            frames.append(spark.read.parquet(p))
        elif p.endswith((".json", ".jsonl")):
            frames.append(spark.read.json(p))
        else:
            raise ValueError(f"neither Parquet nor JSON: {p}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def rl_row(source: Column, question: Column, truth: Column, ability: str, split: str, index: Column, system: str | None = None) -> list[Column]:
    """The columns of a prompt row."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    prompt = F.array(*([message("system", F.lit(system))] if system else []), message("user", question))
    return [source.alias("data_source"), prompt.alias("prompt"), F.lit(ability).alias("ability"), F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"), F.struct(F.lit(split).alias("split"), index.alias("index")).alias("extra_info")]


def preference_to_sft(df: DataFrame) -> DataFrame:
    """Two rows from each: chosen and rejected."""
    return df.select("*", F.explode(F.array("chosen", "rejected")).alias("response")).drop("chosen", "rejected")


def position_split(df: DataFrame, n: int, share: float, row: str = "row_id") -> DataFrame:
    """train for the first share of rows, test behind it."""
    return df.withColumn("split", F.when(F.col(row) < int(n * share), "train").otherwise("test"))


def interleave(a: DataFrame, na: int, b: DataFrame, nb: int, row: str = "row_id") -> DataFrame:
    """Both tables in proportion: row i of a at i / na, of b at i / nb, a first where they tie; adds place (a sort key, not a number) as struct."""
    key = lambda df, n, rank: df.withColumn("place", F.struct((F.col(row) / n).alias("at"), F.lit(rank).alias("side"), F.col(row).alias("i")))
    return key(a, na, 0).unionByName(key(b, nb, 1))


def stratified(df: DataFrame, source: str, percent: float, order: Column) -> DataFrame:
    """max(1, n * percent / 100) rows of each source, by an order that decides."""
    w = Window.partitionBy(source)
    rank = F.row_number().over(w.orderBy(order))
    take = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) * percent / 100))
    return df.withColumn("_keep", rank <= take).where("_keep").drop("_keep")


def filter_constant_groups(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Groups whose metric varies."""
    w = Window.partitionBy(group)
    return df.withColumn("_v", F.max(metric).over(w) != F.min(metric).over(w)).where("_v").drop("_v")


def split_by_keys(df: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """test for rows whose key is in held, train for all others (keys that are null are in neither list, so train)."""
    marked = held.select(*keys).distinct().withColumn("_t", F.lit(True))
    return df.join(marked, keys, "left").withColumn("split", F.when(F.col("_t"), "test").otherwise("train")).drop("_t")


def resolve_paths(paths: Column, root: str) -> Column:
    return F.transform(paths, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p)))


def clean_choice(text: Column) -> Column:
    """Trimmed, " [title]" as a full stop, other brackets gone, one double space made single."""
    x = F.replace(F.trim(text), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(x, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def extra_info(column: Column, keys: dict[str, str]) -> list[Column]:
    """Values out of a JSON text, with defaults; what isn't JSON counts as empty."""
    parsed = F.coalesce(F.try_parse_json(column), F.parse_json(F.lit("{}")))
    return [F.coalesce(F.try_variant_get(parsed, f"$.{k}", "string"), F.lit(v)).alias(k) for k, v in keys.items()]


_DATASETS: dict[str, object] = {}


def register_dataset(name: str):
    """Named functions from a session and options to a DataFrame."""

    def put(fn):
        _DATASETS[name] = fn
        return fn

    return put


def dataset(name: str):
    if name not in _DATASETS:
        raise ValueError(f"unknown dataset {name}")
    return _DATASETS[name]


def first_answer(text: Column) -> Column:
    """The number behind the first ####, without commas; a solution without one is an error."""
    found = F.regexp_extract(text, r"#### (-?[0-9.,]+)", 1)
    return F.when(found == "", F.raise_error(F.lit("a solution without ####")).cast("string")).otherwise(F.replace(found, F.lit(","), F.lit("")))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.cast("string").alias("content"))


def chat_rows(question: Column, answer: Column) -> Column:
    """A question and its answer as messages."""
    return F.array(message("user", question), message("assistant", answer))


def tool_kwargs(name: str, **create: Column) -> Column:
    """What a tool gets when it is made for a row."""
    return F.struct(F.struct(F.struct(*[v.alias(k) for k, v in create.items()]).alias("create_kwargs")).alias(name))


def agent_row(source: Column, question: Column, truth: Column, split: str, index: Column, system: str, agent: str, tool: str | None = None) -> list[Column]:
    """A prompt row for an agent with a tool, which is made with the row's truth."""
    info = [F.lit(split).alias("split"), index.alias("index"), question.alias("question")]
    if tool:
        info += [F.lit(True).alias("need_tools_kwargs"), tool_kwargs(tool, ground_truth=truth).alias("tools_kwargs")]
    return [source.alias("data_source"), F.lit(agent).alias("agent_name"), F.array(message("system", F.lit(system)), message("user", question)).alias("prompt"), F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"), F.struct(*info).alias("extra_info")]


def interaction_row(source: Column, question: Column, truth: Column, split: str, index: Column, system: str, name: str) -> list[Column]:
    """A prompt row whose answers are judged in a dialogue."""
    kwargs = F.struct(F.lit(name).alias("name"), question.alias("query"), truth.alias("ground_truth")).alias("interaction_kwargs")
    return [source.alias("data_source"), F.array(message("system", F.lit(system)), message("user", question)).alias("prompt"), F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"), F.struct(F.lit(split).alias("split"), index.alias("index"), kwargs).alias("extra_info")]


def image_row(source: Column, question: Column, images: Column, truth: Column, split: str, index: Column, instruction: str) -> list[Column]:
    """A prompt row with pictures: the question, an instruction behind it."""
    return [source.alias("data_source"), F.array(message("user", F.concat(question, F.lit(" " + instruction)))).alias("prompt"), images.alias("images"), F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"), F.struct(F.lit(split).alias("split"), index.alias("index"), question.alias("question")).alias("extra_info")]


def sample_key(videos: Column, prompt: Column) -> Column:
    """What identifies a sample: its first video and the first thing its user says."""
    return F.struct(F.get(videos, 0)["video"].alias("video"), F.get(F.filter(prompt, lambda m: m["role"] == "user"), 0)["content"].alias("content"))


def cap_frames(videos: Column, most: int) -> Column:
    return F.transform(videos, lambda v: v.withField("max_frames", F.least(F.coalesce(v["max_frames"], F.lit(most)), F.lit(most))))


def with_reasoning(prompt: Column, reasoning: Column) -> Column:
    """The prompt's messages, and the reasoning as the assistant's."""
    return F.array_append(prompt, message("assistant", reasoning))


def has_vision(messages: Column) -> Column:
    """Whether a message holds a picture or a video."""
    return F.exists(messages, lambda m: m["content"].contains("<image>") | m["content"].contains("<video>"))


def random_split(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """test for about a share of rows, by a hash of their key, so that a row's side doesn't depend on the others."""
    return df.withColumn("split", F.when(F.pmod(F.crc32(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), F.lit(10_000)) < int(share * 10_000), "test").otherwise("train"))


def video_frames(nframes: Column, fps: Column, duration: Column, least: int, most: int) -> Column:
    """How many frames of a video are taken: as many as are asked for, or by rate; both is an error; at least and at most so many."""
    both = F.raise_error(F.lit("either a number of frames or a rate")).cast("int")
    n = F.when(nframes.isNotNull() & fps.isNotNull(), both).when(nframes.isNotNull(), nframes).otherwise(F.floor(F.coalesce(fps, F.lit(2.0)) * duration).cast("int"))
    return F.greatest(F.least(n, F.lit(most)), F.lit(least)).cast("int")


def head_rows(df: DataFrame, n: int, row: str = "row_id") -> DataFrame:
    """The first n rows; all for a negative n."""
    return df if n < 0 else df.where(F.col(row) < n)


def sampled_rows(df: DataFrame, size: int, n: int, seed: int = 1, row: str = "row_id") -> DataFrame:
    """n of `size` rows without replacement, by the generator of the seed; the picks are the feature, and travel as a table."""
    import numpy as np

    picks = np.random.default_rng(seed).choice(size, size=min(n, size), replace=False)
    table = df.sparkSession.createDataFrame([(int(i), k) for k, i in enumerate(picks)], f"{row} long, pick int")
    return df.join(table, row)


def stacked_preferences(chosen: Column, rejected: Column) -> Column:
    """Token ids of the chosen and the rejected answer, one over the other."""
    return F.array(chosen, rejected)


def marker_mask(ids: Column, start: list[int], end: int) -> Column:
    """1 for ids between the marker that begins an assistant's turn and the id that ends it; 0 for the markers, and for a turn that doesn't end."""
    n = len(start)
    zero = F.struct(F.lit(-1).alias("open"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"), F.lit(0).alias("i"))

    def step(s: Column, x: Column) -> Column:
        here = F.slice(ids, s["i"] + 1, n) == F.array(*map(F.lit, start))
        closes = (s["open"] >= 0) & (s["i"] >= s["open"]) & (x == end)
        spans = F.when(closes, F.array_append(s["spans"], F.struct(s["open"].alias("a"), s["i"].alias("b")))).otherwise(s["spans"])
        opened = F.when(closes, F.lit(-1)).when((s["open"] < 0) & here, s["i"] + n).otherwise(s["open"])
        return F.struct(opened.cast("int").alias("open"), spans.alias("spans"), (s["i"] + 1).alias("i"))

    spans = F.aggregate(ids, zero, step, lambda s: s["spans"])
    # one list of borders, then a running state: spans don't overlap
    inside = F.flatten(F.transform(spans, lambda p: F.when(p["b"] > p["a"], F.sequence(p["a"], p["b"] - 1)).otherwise(F.array().cast("array<int>"))))
    marks = F.map_from_arrays(inside, F.transform(inside, lambda _: F.lit(1)))
    return F.transform(ids, lambda _, i: F.coalesce(F.try_element_at(marks, i), F.lit(0)))


def label_key(label: Column) -> Column:
    """A group's label as a key: whole numbers by value, however they are written ("0042" and 42 are one), all others as text."""
    whole = label.rlike(r"^[+-]?[0-9]{1,18}$")
    near = F.round(label.try_cast("double"))
    close = label.rlike(r"^[+-]?[0-9]{1,15}\.[0-9]+$") & (F.abs(label.try_cast("double") - near) <= 1e-6)
    return F.when(whole, label.try_cast("bigint").cast("string")).when(close, near.cast("bigint").cast("string")).otherwise(label)
