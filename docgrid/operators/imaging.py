"""Images: votes over recognition passes, quality rules and metrics in numpy; pixel filters are plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import IMAGE_LIMITS


def vote(texts: Column) -> Column:
    """text and confidences: per place the most frequent character, the first seen of equals, and its share of all
    passes."""
    longest = F.coalesce(F.array_max(F.transform(texts, lambda t: F.length(t))), F.lit(0))

    def place(i: Column) -> Column:
        chars = F.filter(F.transform(texts, lambda t: F.substring(t, i, F.lit(1))), lambda c: c != "")
        votes = F.transform(F.array_distinct(chars), lambda c, k: F.struct(F.size(F.filter(chars, lambda x: x == c)).alias("n"), (-k).alias("k"), c.alias("c")))
        return F.array_max(votes)

    best = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(longest, F.lit(1))), place), lambda b: b.isNotNull())
    return F.struct(F.array_join(F.transform(best, lambda b: b["c"]), "").alias("text"), F.transform(best, lambda b: b["n"] / F.size(texts)).alias("confidence"))


def vote_long(variants: DataFrame, key: str) -> DataFrame:
    """The same over rows (key, pass, text): for texts too long to hold all passes in one row."""
    chars = variants.select(key, "pass", F.posexplode(F.split("text", "")).alias("at", "c")).where("c <> ''")
    votes = chars.groupBy(key, "at", "c").agg(F.count("*").alias("n"), F.min("pass").alias("first"))
    best = Window.partitionBy(key, "at").orderBy(F.desc("n"), "first")
    passes = variants.groupBy(key).agg(F.count("*").alias("passes"))
    return votes.withColumn("_r", F.row_number().over(best)).where("_r = 1").join(passes, key).select(key, "at", "c", (F.col("n") / F.col("passes")).alias("confidence"))


def michelson(low: Column, high: Column) -> Column:
    low, high = low.cast("double"), high.cast("double")
    return F.when(high + low < 1e-6, 0.0).otherwise((high - low) / (high + low))


def page_dpi(w: Column, h: Column) -> Column:
    """Dots an inch if the shorter side is that of an A4 page."""
    return F.least(w, h) / F.lit(210 / 25.4)


def quality_flags(m: str = "m", limits: dict[str, float] = IMAGE_LIMITS) -> Column:
    """Flags from a struct column of metrics."""
    c = lambda name: F.col(f"{m}.{name}")
    return F.struct(
        (c("blur_score") < limits["blur_variance_min"]).alias("is_blurry"),
        (c("noise_level") > limits["noise_std_max"]).alias("is_noisy"),
        (c("contrast") < limits["contrast_min"]).alias("is_low_contrast"),
        (F.abs(c("skew_angle")) > limits["skew_max_deg"]).alias("needs_deskew"),
        (c("stamp_pixel_ratio") >= limits["stamp_area_ratio_min"]).alias("has_stamps"),
        (c("estimated_dpi") < limits["dpi_min"]).alias("needs_upscale"),
    )


def repair_steps(flags: Column, skew: Column, target_dpi: int = 300, binarize: bool = False) -> Column:
    """Names of the filters that an image gets, in order."""
    steps = [
        F.when(flags["needs_upscale"], F.lit(f"upscale_to_{target_dpi}dpi")),
        F.when(flags["has_stamps"], F.lit("stamp_removal")),
        F.when(flags["needs_deskew"], F.format_string("deskew_%.2fdeg", skew)),
        F.when(flags["is_low_contrast"], F.lit("clahe_contrast")),
        F.when(flags["is_noisy"], F.lit("denoise")),
        F.lit("sauvola_binarization" if binarize else None).cast("string"),
    ]
    return F.array_compact(F.array(*steps))


METRICS = "blur_score double, noise_level double, contrast double, skew_angle double, stamp_pixel_ratio double, estimated_dpi double, width int, height int"


def measure(gray: np.ndarray) -> dict[str, float]:
    """Blur (variance of the Laplacian), noise (deviation from the median of 3 x 3) and contrast of a gray image;
    skew and stamps need pixel libraries and stay 0."""
    g = np.pad(gray.astype(float), 1, mode="reflect")
    h, w = gray.shape
    shifts = np.stack([g[i : i + h, j : j + w] for i in range(3) for j in range(3)])
    laplacian = shifts[1] + shifts[3] + shifts[5] + shifts[7] - 4 * shifts[4]
    rest = gray - np.median(shifts, axis=0)
    low, high = float(gray.min()), float(gray.max())
    return {
        "blur_score": float(laplacian.var()),
        "noise_level": float(np.median(np.abs(rest - np.median(rest))) * 1.4826),
        "contrast": 0.0 if high + low < 1e-6 else (high - low) / (high + low),
        "skew_angle": 0.0,
        "stamp_pixel_ratio": 0.0,
        "estimated_dpi": min(w, h) / (210 / 25.4),
        "width": w,
        "height": h,
    }


def assess(images: DataFrame, decode: Callable[[bytes], np.ndarray], key: str = "path", content: str = "content") -> DataFrame:
    """Metrics of images by a decoder that is plugged in (bytes to a gray array)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([{key: k, **measure(decode(x))} for k, x in zip(pdf[key], pdf[content], strict=True)], columns=[key, *[x.split()[0] for x in METRICS.split(", ")]])

    return images.select(key, content).mapInPandas(run, f"{key} string, {METRICS}")
