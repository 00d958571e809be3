"""Decisions on image annotations: safe-search levels, labels, recognised text; and pixel statistics."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moderata.config import DEFAULT, Settings
from moderata.functions import detect as D
from moderata.functions import text as T
from moderata.operators import verdicts as V

# Likelihoods in order, and the words that labels are searched for.
LIKELIHOODS = ("UNKNOWN", "VERY_UNLIKELY", "UNLIKELY", "POSSIBLE", "LIKELY", "VERY_LIKELY")
TOY_LABELS = (
    "toy", "game", "child", "play", "doll", "lego", "puzzle", "infant", "kid", "baby", "figure", "block", "plush", "stuffed", "board game", "educational", "toddler", "children", "playful",
    "mask", "masque", "costume", "mascot", "fictional character", "superhero", "cosplay", "pretend play", "roleplay", "character", "action figure", "merchandise",
    "product", "packaged product", "box", "packaging", "gift", "carton", "cardboard box",
    "plastic", "wooden", "wood", "fabric", "textile", "miniature", "model", "scale model", "vehicle", "car", "train", "airplane", "truck", "motorcycle", "figurine", "collectible", "novelty", "hobby", "recreation",
)
REAL_WEAPONS = ("firearm", "handgun", "rifle", "shotgun", "assault weapon", "tactical firearm", "revolver", "military weapon", "machine gun", "carbine", "sniper rifle", "ammunition", "weapon sales", "bullet", "ammunition belt")
UNCLEAR_WEAPONS = ("weapon", "knife", "gun", "pistol")
TOY_WEAPONS = ("toy", "water gun", "nerf", "blaster", "plaything", "plastic", "cartoon", "water pistol", "child play weapon", "cosplay", "foam", "play weapon", "model")
SUSPICIOUS = ("fight", "fighting", "wrestling", "altercation", "aggression", "assault", "physical conflict", "bullying", "smoking", "alcohol", "beer", "wine", "gamble", "gambling", "casino")


def level(c: Column) -> Column:
    return F.greatest(F.array_position(F.array(*[F.lit(x) for x in LIKELIHOODS]), c) - 1, F.lit(0))


def safe_search(adult: Column, violence: Column, racy: Column) -> Column:
    """The first gate that closes, or null."""
    return F.when(level(adult) >= 4, "adult").when(level(violence) >= 4, "violence").when(level(racy) >= 5, "racy")


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return F.lower(c).rlike("|".join(words))


def toy_indicator(labels: Column, s: Settings = DEFAULT) -> Column:
    return F.exists(labels, lambda x: (x["score"] >= s.indicator_score) & _any(x["description"], TOY_WEAPONS))


def label_violation(labels: Column, s: Settings = DEFAULT) -> Column:
    """The kind of the first label that is not allowed, or null; a toy indicator excuses weapons."""
    toy = toy_indicator(labels, s)
    kind = lambda x: F.when(_any(x, SUSPICIOUS), "suspicious").when(~toy & _any(x, REAL_WEAPONS), "real_weapon").when(~toy & _any(x, UNCLEAR_WEAPONS), "unclear_weapon")
    kinds = F.transform(F.filter(labels, lambda x: x["score"] >= s.violation_score), lambda x: kind(x["description"]))
    return F.get(F.array_compact(kinds), F.lit(0))


def toy_found(labels: Column, s: Settings = DEFAULT) -> Column:
    return toy_indicator(labels, s) | F.exists(labels, lambda x: (x["score"] >= s.toy_score) & _any(x["description"], TOY_LABELS))


def top_labels(labels: Column, n: int) -> Column:
    return F.array_join(F.transform(F.slice(labels, 1, n), lambda x: F.format_string("%s(%.2f)", x["description"], x["score"])), ", ")


def decided(annotations: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(…, decision, flag, reason): gates, labels, then the recognised text as it is and cleaned, then whether a toy is seen."""
    labels, ocr = F.col("labels"), F.col("ocr")
    rows = annotations.withColumn("violation", F.coalesce(safe_search(F.col("adult"), F.col("violence"), F.col("racy")), label_violation(labels, s)))
    # Labels and gates come first, so a text is read only where they let an image pass.
    found = lambda cleaned: F.coalesce(F.when(T.profane(ocr) | T.profane(cleaned, cleaned=True), F.lit("profanity")), D.sensitive(ocr), D.sensitive(cleaned))
    rows = rows.withColumn("text_reason", F.when(F.col("violation").isNull() & (F.coalesce(ocr, F.lit("")) != ""), T.let(T.clean(ocr), found)))
    flag = F.when(F.col("violation").isNotNull(), "hard_violation").when(F.col("text_reason") == "profanity", "text_profanity").when(F.col("text_reason").isNotNull(), "text_violation").when(~toy_found(labels, s), "no_toy_label")
    reason = F.coalesce("violation", "text_reason", F.when(~toy_found(labels, s), top_labels(labels, 5)).otherwise(top_labels(labels, 3)))
    return rows.withColumn("flag", flag).withColumn("reason", reason).withColumn("decision", F.when(flag.isNull(), "APPROVED").otherwise("REJECTED")).drop("violation", "text_reason")


def with_annotations(images: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every image with its decision; those without an annotation go to a person."""
    found = decisions.select("image_id", "decision", "flag")
    return images.join(found, "image_id", "left").withColumn("flag", F.when(F.col("decision").isNull(), "vision_api_failed").otherwise(F.col("flag"))).withColumn("decision", F.coalesce("decision", F.lit("MANUAL_REVIEW")))


def size_gate(files: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """binaryFile rows with the reason why a file can't be an image to screen, or null."""
    head = F.hex(F.substring("content", 1, 4))
    known = head.startswith("FFD8FF") | (head == "89504E47") | (head == "52494646")
    return files.withColumn("refused", F.when(F.col("length") < s.image_min_bytes, "too_small").when(F.col("length") > s.image_max_bytes, "too_large").when(~known, "unknown_format"))


@functools.lru_cache(maxsize=64)
def _steps(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two neighbours of each of `size` places along n pixels, and the second one's share; pixel centres aligned."""
    at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
    first = np.floor(at).astype(int)
    return first, np.minimum(first + 1, n - 1), at - first


def _resized(gray: np.ndarray, size: int, rows_at_once: int = 64) -> Iterator[np.ndarray]:
    """Bilinear, as whole numbers; in strips that stay in the processor's cache."""
    (y0, y1, fy), (x0, x1, fx) = (_steps(n, size) for n in gray.shape)
    for at in range(0, size, rows_at_once):
        strip = slice(at, at + rows_at_once)
        share = fy[strip, None]
        rows = gray[y0[strip]] * (1 - share) + gray[y1[strip]] * share
        out = rows.take(x0, axis=1)
        out *= 1 - fx
        more = rows.take(x1, axis=1)
        more *= fx
        out += more
        yield np.rint(out, out=out).astype(np.int16)


def _sharpness(gray: np.ndarray, size: int = 512) -> float:
    """The variance of the Laplacian of the resized picture, mirrored at its edges; sums of whole numbers, so that their order doesn't matter."""
    padded = np.empty((size + 2, size + 2), np.int16)
    at = 1
    for strip in _resized(gray, size):
        padded[at : at + len(strip), 1:-1] = strip
        at += len(strip)
    padded[:, 0], padded[:, -1] = padded[:, 2], padded[:, -3]
    padded[0], padded[-1] = padded[2], padded[-3]
    edges = padded[:-2, 1:-1] + padded[2:, 1:-1]
    edges += padded[1:-1, :-2]
    edges += padded[1:-1, 2:]
    edges -= 4 * padded[1:-1, 1:-1]
    n, total = edges.size, int(edges.sum(dtype=np.int64))
    squares = int(np.square(edges, dtype=np.int32).sum(dtype=np.int64))
    return (n * squares - total * total) / (n * n)


def _statistics(wanted: Callable[[float, float], bool]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def statistics(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.height <= 0:
                    out.append((row.origin, None, None, None))
                    continue
                pixels = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, -1).astype(float)
                gray = pixels[..., 0] if pixels.shape[2] == 1 else np.rint(pixels[..., 2] * 0.299 + pixels[..., 1] * 0.587 + pixels[..., 0] * 0.114)
                brightness, deviation, sharpness = float(gray.mean()), float(gray.std()), None
                if wanted(brightness, deviation):
                    sharpness = _sharpness(gray)
                out.append((row.origin, brightness, deviation, sharpness))
            yield pd.DataFrame(out, columns=["origin", "brightness", "deviation", "sharpness"])

    return statistics


def screened(images: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Spark's image rows with brightness, deviation, sharpness and what is wrong with the picture, or null.

    The sharpness is measured only where brightness and deviation are in order, and null otherwise.
    """
    return faulty(pixel_statistics(images, lambda brightness, deviation: brightness >= s.dark_below and deviation >= s.flat_below), s)


def pixel_statistics(images: DataFrame, wanted: Callable[[float, float], bool] = lambda brightness, deviation: True) -> DataFrame:
    """(origin, brightness, deviation, sharpness) of Spark's image rows; nulls for a picture that could not be read.

    wanted: whether the sharpness of a picture of that brightness and deviation is asked for.
    """
    return images.select("image.origin", "image.height", "image.width", "image.data").mapInPandas(_statistics(wanted), "origin string, brightness double, deviation double, sharpness double")


def faulty(stats: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    fault = F.when(F.col("brightness").isNull(), "image_load_failed").when(F.col("brightness") < s.dark_below, "black_image").when(F.col("deviation") < s.flat_below, "uniform_image").when(F.col("sharpness") / (F.col("brightness") + 1) < s.blur_below, "blurry_image")
    return stats.withColumn("fault", fault)


def unreadable(files: DataFrame, faults: DataFrame, key: str) -> DataFrame:
    """(key, decision, flag): files that gave no picture, among them those that the reader left out, are rejected."""
    read = faults.select(key, F.coalesce("fault", F.lit("")).alias("fault"))
    rows = files.join(read, key, "left").where(F.coalesce("fault", F.lit("image_load_failed")) == "image_load_failed")
    return rows.select(key, F.lit("REJECTED").alias("decision"), F.lit("image_load_failed").alias("flag"))


def judged_images(images: DataFrame, faults: DataFrame, annotations: DataFrame, completions: DataFrame) -> DataFrame:
    """(image_id, review_id, decision, flag, reason): load and quality, then annotations, then the verdict on recognised text.

    images: image_id, review_id, file_id; faults: (file_id, fault) of every file that was read; annotations: as `decided`
    gives them; completions: (image_id, raw) of the model that read the recognised text.
    """
    read = faults.select("file_id", F.coalesce("fault", F.lit("")).alias("fault"))
    rows = images.join(read, "file_id", "left").withColumn("fault", F.coalesce("fault", F.lit("image_load_failed")))
    seen = annotations.select("image_id", F.col("decision").alias("seen"), F.col("flag").alias("seen_flag"), F.col("reason").alias("seen_reason"), "ocr")
    said = completions.select("image_id", "raw")
    rows = rows.join(seen, "image_id", "left").join(said, "image_id", "left")
    asked = (F.col("fault") == "") & (F.col("seen") == "APPROVED") & (T.alnum_count(F.col("ocr")) >= 5)
    rows = rows.withColumn("said", F.array(F.when(asked, V.read_ocr(F.col("raw"))))).withColumn("said", F.element_at("said", 1))
    overruled = F.col("said")["decision"] != "APPROVED"
    as_ = lambda decision, flag, reason: F.struct(decision.alias("decision"), flag.alias("flag"), reason.alias("reason"))
    final = (
        F.when(F.col("fault") != "", as_(F.lit("REJECTED"), F.col("fault"), F.col("fault")))
        .when(F.col("seen").isNull(), as_(F.lit("MANUAL_REVIEW"), F.lit("vision_api_failed"), F.lit("no annotation")))
        .when(overruled, as_(F.col("said")["decision"], F.lit("vision_ocr_llm"), F.concat(F.lit("text in the image: "), F.col("said")["reason"])))
        .otherwise(as_(F.col("seen"), F.col("seen_flag"), F.col("seen_reason")))
    )
    return rows.withColumn("final", final).select("image_id", "review_id", "final.decision", "final.flag", "final.reason")


def with_text_verdicts(decisions: DataFrame, verdicts: DataFrame, least: int = 5) -> DataFrame:
    """Approved images with enough recognised text take the text's verdict where that is no approval.

    verdicts: (image_id, text_decision); a text without one is taken as approved.
    """
    rows = decisions.join(verdicts.select("image_id", "text_decision"), "image_id", "left")
    takes = (F.col("decision") == "APPROVED") & (T.alnum_count(F.col("ocr")) >= least) & F.col("text_decision").isin("REJECTED", "MANUAL_REVIEW")
    return rows.withColumn("decision", F.when(takes, F.col("text_decision")).otherwise(F.col("decision"))).drop("text_decision")
