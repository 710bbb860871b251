"""Masked arithmetic over arrays of numbers, as Column expressions: the base of advantages, losses and corrections.

Values where the mask is 0 are replaced before any arithmetic, so NaN and garbage in padding never spread.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def kept(values: Column | str, mask: Column | str) -> Column:
    """values times mask, 0 where the mask is 0."""
    return F.zip_with(col(values), col(mask), lambda v, m: F.when(m != 0, v * m).otherwise(F.lit(0.0)))


def total(values: Column | str) -> Column:
    return F.aggregate(col(values), F.lit(0.0).cast("double"), lambda a, x: a + x)


def masked_sum(values: Column | str, mask: Column | str) -> Column:
    return total(kept(values, mask))


def mask_sum(mask: Column | str) -> Column:
    return F.aggregate(col(mask), F.lit(0.0).cast("double"), lambda a, x: a + x)


def masked_mean(values: Column | str, mask: Column | str) -> Column:
    return masked_sum(values, mask) / (mask_sum(mask) + EPS)


def clip(x: Column, lo, hi) -> Column:
    """Between lo and hi; NaN stays NaN."""
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.least(x, F.lit(hi) if not isinstance(hi, Column) else hi), F.lit(lo) if not isinstance(lo, Column) else lo))


def response_mask_to_eos(ids: Column | str, eos: int = 2) -> Column:
    """1 up to the first end-of-sequence id and on it, 0 behind; all 1 without one."""
    at = F.array_position(col(ids), eos)
    return F.transform(col(ids), lambda _, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def response_mask_from_attention(attention: Column | str, responses: Column | str) -> Column:
    """The last size(responses) entries of the attention mask."""
    n = F.size(col(responses))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.slice(col(attention), F.size(col(attention)) - n + 1, n))


def running(values: Column | str) -> Column:
    """Cumulative sums."""
    acc = F.aggregate(col(values), F.struct(F.lit(0.0).cast("double").alias("s"), F.array().cast("array<double>").alias("out")), lambda a, x: F.struct((a["s"] + x).alias("s"), F.array_append(a["out"], a["s"] + x).alias("out")))
    return acc["out"]


def position_ids(mask: Column | str) -> Column:
    """Running count of the mask less 1, at least 0."""
    return F.transform(running(F.transform(col(mask), lambda m: m.cast("double"))), lambda x: F.greatest(x - 1, F.lit(0.0)).cast("int"))


def pad_to(x: Column | str, length: int, pad, left: bool = False) -> Column:
    """Filled up to a length; longer arrays stay as they are."""
    x = col(x)
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(x), F.lit(0)))
    return F.concat(fill, x) if left else F.concat(x, fill)


def fit_to(x: Column | str, length: int, pad, left_pad: bool = True, truncation: str = "error") -> Column:
    """Padded or cut to a length. truncation: left keeps the end, right the beginning, middle half of each, error raises."""
    x = col(x)
    if truncation == "left":
        cut = F.slice(x, F.greatest(F.size(x) - length + 1, F.lit(1)), length)
    elif truncation == "right":
        cut = F.slice(x, 1, length)
    elif truncation == "middle":
        head = length // 2
        tail = length - head
        cut = F.when(F.size(x) > length, F.concat(F.slice(x, 1, head), F.slice(x, F.size(x) - tail + 1, tail))).otherwise(x)
    elif truncation == "error":
        cut = F.when(F.size(x) > length, F.raise_error(F.concat(F.lit("sequence of "), F.size(x).cast("string"), F.lit(f" is longer than {length}")))).otherwise(x)
    else:
        raise ValueError(f"unknown truncation {truncation}")
    return pad_to(cut, length, pad, left_pad)


def strip_left_pad(ids: Column | str, attention: Column | str) -> Column:
    """The last sum(attention) ids."""
    n = mask_sum(F.transform(col(attention), lambda m: m.cast("double"))).cast("int")
    return F.when(n == 0, F.slice(col(ids), 1, 0)).otherwise(F.slice(col(ids), F.size(col(ids)) - n + 1, n))


def sft_loss_mask(prompt_len: Column, total_len: Column) -> Column:
    """Per token of a prompt and its response: 1 where the next token is one of the response's; the last token has none."""
    return F.transform(F.sequence(F.lit(0), total_len - 1), lambda i: F.when((i >= prompt_len - 1) & (i < total_len - 1), 1).otherwise(0))


def compact(values: Column | str, mask: Column | str) -> Column:
    """Padded to jagged: entries whose mask is not 0."""
    pairs = F.filter(F.arrays_zip(col(values).alias("v"), col(mask).alias("m")), lambda p: p["m"] != 0)
    return F.transform(pairs, lambda p: p["v"])


def shifted_response(values: Column | str, response_len: Column | str, width: int) -> Column:
    """Of per-token outputs, those that predict the response (one place earlier), padded with 0 to width."""
    v, n = col(values), col(response_len)
    return pad_to(F.slice(v, F.greatest(F.size(v) - n, F.lit(1)), n), width, 0.0)


def log_softmax_at(logits: Column | str, label: Column | str) -> Column:
    """Log-probability of one label, shifted by the maximum."""
    x = col(logits)
    top = F.array_max(x)
    return F.get(x, col(label)) - top - F.log(total(F.transform(x, lambda v: F.exp(v - top))))


def entropy(logits: Column | str) -> Column:
    x = col(logits)
    top = F.array_max(x)
    z = total(F.transform(x, lambda v: F.exp(v - top)))
    return top + F.log(z) - total(F.transform(x, lambda v: F.exp(v - top) * v)) / z


def sum_pi_squared(logits: Column | str) -> Column:
    x = col(logits)
    top = F.array_max(x)
    z = total(F.transform(x, lambda v: F.exp(v - top)))
    return total(F.transform(x, lambda v: F.exp(2 * (v - top)))) / (z * z)


def cosine_warmup(step: Column, warmup: int, steps: int, floor: float = 0.0, cycles: float = 0.5) -> Column:
    """Learning-rate factor: linear to 1, then a cosine down to the floor."""
    p = (step - warmup) / max(1, steps - warmup)
    wave = F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(3.141592653589793 * 2 * cycles) * p)))
    return F.when(step < warmup, step / max(1, warmup)).otherwise(floor + (1 - floor) * wave)
