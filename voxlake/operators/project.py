"""Per-voxel functions, each from DataFrame to DataFrame with built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INT_BITS = {"uint8": (8, False), "uint16": (16, False), "uint32": (32, False), "int8": (8, True), "int16": (16, True), "int32": (32, True), "int64": (64, True)}


def _each(df: DataFrame, cols: Sequence[str], f) -> DataFrame:
    return df.withColumns({c: f(F.col(c)) for c in cols})


def binarize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return _each(df, cols, lambda v: F.when(v > 0, 1).otherwise(0))


def invert_labels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return _each(df, cols, lambda v: F.when(v == 0, 1).otherwise(0))


def cast_like(v: Column, dtype: str) -> Column:
    """Narrowing wraps around, floats are truncated toward zero first."""
    if dtype in ("float32", "float64"):
        return v.cast("float" if dtype == "float32" else "double")
    bits, signed = INT_BITS[dtype]
    v = v.cast("long")
    if bits == 64:
        return v
    wrapped = F.pmod(v, F.lit(1 << bits))
    return F.when(wrapped >= 1 << bits - 1, wrapped - (1 << bits)).otherwise(wrapped) if signed else wrapped


def to_dtype(df: DataFrame, cols: Sequence[str], dtype: str, out: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({o: cast_like(F.col(c), dtype) for c, o in zip(cols, out or cols, strict=True)})


def _checked(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("int"))


def float_to_uint8(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """0..1 to 0..255, halves to even; negative values count as 0, values outside -1..1 are an error."""
    v = F.col(col)
    return df.withColumn(out or col, _checked((v >= -1) & (v <= 1), F.rint(F.greatest(v, F.lit(0.0)) * 255).cast("int"), "value outside -1..1"))


def uint8_to_float(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, (F.col(col) / 255).cast("float"))


def normalize(df: DataFrame, col: str, dtype: str = "uint8", out: str | None = None) -> DataFrame:
    """Integers by the largest value of their type; floats stay."""
    if dtype.startswith("float"):
        return df.withColumn(out or col, F.col(col).cast("float"))
    bits, signed = INT_BITS[dtype]
    return df.withColumn(out or col, (F.col(col) / float((1 << bits - signed) - 1)).cast("float"))


def scale_shift(df: DataFrame, col: str, scale: float, shift: float, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, F.col(col) * scale + shift)


def invert_raw(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, 255 - F.col(col))


def to_8bit(df: DataFrame, col: str, keep_depth: bool = False) -> DataFrame:
    return df if keep_depth else df.withColumn(col, F.pmod(F.floor(F.col(col) / 256), F.lit(256)))


def export_uint8(df: DataFrame, col: str, dtype: str) -> DataFrame:
    """uint32: non-zero is 255; other integers must not exceed 255; floats must lie in 0..1."""
    v = F.col(col)
    if dtype == "uint32":
        return df.withColumn(col, F.when(v != 0, 255).otherwise(0))
    if dtype in INT_BITS:
        return df.withColumn(col, _checked((v >= 0) & (v <= 255), v.cast("int"), "value does not fit 8 bits"))
    if dtype in ("float32", "float64"):
        return df.withColumn(col, _checked((v >= 0) & (v <= 1), F.rint(v * 255).cast("int"), "value outside 0..1"))
    raise TypeError(dtype)


def relabel_to(df: DataFrame, col: str, value: int) -> DataFrame:
    return df.withColumn(col, F.when(F.col(col) != 0, value).otherwise(0))


def relabel_to_uid(df: DataFrame, col: str, path: str) -> DataFrame:
    """Non-zero becomes the CRC-32 of the path, the same in every run."""
    return df.withColumn(col, F.when(F.col(col) != 0, F.crc32(F.encode(F.col(path), "UTF-8"))).otherwise(F.lit(0).cast("long")))


def rgb_to_gray_invert(df: DataFrame, r: str, g: str, b: str, out: str) -> DataFrame:
    """255 - luma, with the integer weights 299, 587 and 114 of 1000."""
    luma = F.floor((F.col(r) * 299 + F.col(g) * 587 + F.col(b) * 114) / 1000)
    return df.withColumn(out, 255 - luma)


def constant_like(df: DataFrame, out: str, value: int) -> DataFrame:
    """A constant array of the same shape: background labels with 0, masks with 1."""
    return df.withColumn(out, F.lit(value))


def sigmoid(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, 1 / (1 + F.exp(-F.col(col))))


def threshold_segment(df: DataFrame, prob: str, t: float, mask: str | None = None, out: str = "seg") -> DataFrame:
    on = F.col(prob) >= t
    return df.withColumn(out, F.when(on if mask is None else on & (F.col(mask) != 0), 255).otherwise(0))


def apply_mask(df: DataFrame, prob: str, mask: str, metric_mask: str | None = None) -> DataFrame:
    """Probabilities outside the mask become 0; the metric mask becomes mask AND metric mask."""
    out = df.withColumn(prob, F.col(prob) * (F.col(mask) != 0).cast("int"))
    return out if metric_mask is None else out.withColumn(metric_mask, ((F.col(mask) != 0) & (F.col(metric_mask) != 0)).cast("int"))


DRAWS = 1_000_003


def draw(seed: int, *keys: str | Column) -> Column:
    """One of DRAWS numbers in [0, 1) that depends on the seed and the keys only, with integer arithmetic any engine repeats.

    What a key has beyond DRAWS goes through a step of its own, so that keys DRAWS apart draw apart. The steps are linear,
    so draws of neighbouring seeds would differ by a constant; the fifth power, one to one modulo this prime, breaks that.
    """
    h = F.lit(seed % DRAWS).cast("long")
    for k in keys:
        k = (F.col(k) if isinstance(k, str) else k).cast("long")
        low = F.pmod(k, F.lit(DRAWS))
        h = F.pmod(h * 48_271 + low * 69_621 + 12_345, F.lit(2_147_483_647))
        beyond = F.pmod(F.floor((k - low) / DRAWS), F.lit(2_147_483_647))
        h = F.when(k == low, h).otherwise(F.pmod(h * 39_373 + beyond * 16_807 + 54_321, F.lit(2_147_483_647)))
    h = F.pmod(h, F.lit(DRAWS))
    square = F.pmod(h * h, F.lit(DRAWS))
    fifth = F.pmod(F.pmod(square * square, F.lit(DRAWS)) * h, F.lit(DRAWS))
    return F.pmod(fifth * 48_271 + 11, F.lit(DRAWS)) / float(DRAWS)


def draw_below(n: Column, seed: int, *keys: str | Column) -> Column:
    """A BIGINT in [0, n): floor(draw * n) up to DRAWS, beyond it 53 bits of a hash of the seed and the keys, so that all can be drawn."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    wide = F.pmod(F.xxhash64(F.lit(seed).cast("long"), *[c.cast("long") for c in cols]), F.lit(1 << 53)) / float(1 << 53)
    return F.floor(F.when(n <= DRAWS, draw(seed, *keys)).otherwise(wide) * n).cast("long")


def gamma_augment(df: DataFrame, col: str, block: Sequence[str], gmin: float, gmax: float, seed: int) -> DataFrame:
    """v ** g with g drawn per block, evenly in the space where 1/g below 1 mirrors g above 1; result in 0..1."""
    lo, hi = (-1 / gmin + 1 if gmin < 1 else gmin - 1), (-1 / gmax + 1 if gmax < 1 else gmax - 1)
    u = lo + (hi - lo) * draw(seed, *block)
    g = F.when(u < 0, 1 / (1 - u)).otherwise(1 + u)
    return df.withColumn(col, F.least(F.greatest(F.pow(F.col(col), g), F.lit(0.0)), F.lit(1.0)))


def _clip01(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def _between(bounds: tuple[float, float], u: Column) -> Column:
    return bounds[0] + (bounds[1] - bounds[0]) * u


def intensity_augment(df: DataFrame, col: str, block: Sequence[str], scale: tuple[float, float], shift: tuple[float, float], seed: int) -> DataFrame:
    """Random scale around the block's mean and random shift, clipped to 0..1. Blocks' means are summed in tasks and joined back."""
    means = df.groupBy(*block).agg(F.avg(col).alias("__mean"))
    s, t = _between(scale, draw(seed, *block)), _between(shift, draw(seed + 1, *block))
    out = df.join(means, list(block)).withColumn(col, _clip01((F.col(col) - F.col("__mean")) * s + F.col("__mean") + t))
    return out.drop("__mean")


def masked_intensity_augment(df: DataFrame, col: str, mask: str, block: Sequence[str], scale: tuple[float, float], shift: tuple[float, float], seed: int) -> DataFrame:
    """Only where the mask is set, and without the mean."""
    s, t = _between(scale, draw(seed, *block)), _between(shift, draw(seed + 1, *block))
    return df.withColumn(col, F.when(F.col(mask) != 0, _clip01(F.col(col) * s + t)).otherwise(F.col(col)))


def pick_channel(df: DataFrame, c: int) -> DataFrame:
    return df.filter(F.col("c") == c).drop("c")


def slice_channels(df: DataFrame, ranges: Sequence[tuple[int, int]]) -> list[DataFrame]:
    """One table for each half-open channel range, its channels counted from 0."""
    return [df.filter((F.col("c") >= a) & (F.col("c") < b)).withColumn("c", F.col("c") - a) for a, b in ranges]


def stack_channels(dfs: Sequence[DataFrame]) -> DataFrame:
    """Tables (z, y, x, v) as channels 0, 1, ... of one."""
    if len(dfs) < 2:
        raise ValueError("at least two arrays")
    return reduce(DataFrame.unionByName, [d.withColumn("c", F.lit(k)) for k, d in enumerate(dfs)])


def squeeze(df: DataFrame) -> DataFrame:
    """Drop a channel axis of length 1; an error if it is longer."""
    lo, hi = df.agg(F.min("c"), F.max("c")).first()
    if lo != hi:
        raise ValueError(f"channels {lo}..{hi}")
    return df.drop("c")


def unsqueeze(df: DataFrame) -> DataFrame:
    return df.withColumn("c", F.lit(0))


def copy_array(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.withColumn(dst, F.col(src))


def block_of(df: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Add the block position cz, cy, cx of each voxel."""
    return df.withColumns({f"c{a}": F.expr(f"CAST(floor({a} / {s}) AS BIGINT)") for a, s in zip("zyx", shape, strict=True)})
