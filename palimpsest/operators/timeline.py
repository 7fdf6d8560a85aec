"""Media timelines in exact integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.ordered import previous

# The audio the timeline is rendered to.
SAMPLE_RATE = 16_000
WIDE = "decimal(38,0)"


def packet_continuity(packets: DataFrame, *, width: int = 1 << 20) -> DataFrame:
    """First anomaly of each stream. An unusable packet is one, and resets the expectation.

    packets: `stream_id, ordinal, pts, duration`, ordinals counting from 0.
    """
    usable = F.col("pts").isNotNull() & F.coalesce(F.col("duration") > 0, F.lit(False))
    rows = previous(
        packets.withColumn("part", F.floor(F.col("ordinal") / width)),
        ["stream_id"], ["ordinal"], "part",
        expected=F.when(usable, F.col("pts") + F.col("duration")),
    )
    code = (
        F.when(~usable, "timestamp_unavailable")
        .when(F.col("pts") < F.col("expected"), "backward_jump")
        .when(F.col("pts") > F.col("expected"), "gap")
    )
    flagged = rows.withColumn("code", code)
    first = F.when(F.col("code").isNotNull(), F.col("ordinal"))
    found = flagged.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("packets_scanned"),
        F.min_by(F.struct("code", "ordinal", "expected", "pts"), first).alias("a"),
    )
    return found.select(
        "stream_id",
        F.when(F.col("a").isNull(), "continuous").otherwise("discontinuous").alias("status"),
        "packets_scanned",
        F.col("a.code").alias("code"),
        F.col("a.ordinal").alias("packet_ordinal"),
        F.when(F.col("a.code") != "timestamp_unavailable", F.col("a.expected")).alias("expected"),
        F.when(F.col("a.code") != "timestamp_unavailable", F.col("a.pts")).alias("observed"),
    )


def timeline_origin(frames: DataFrame) -> DataFrame:
    """Earliest valid video frame and audio sample per stream, and their exact offset.

    Times stay fractions: numerator columns and one denominator. Skipped samples move an audio
    frame; a frame skipped as a whole does not count. Time bases are constant within one
    medium, so the earliest is the smallest numerator.
    """
    video = F.when(F.col("media_type") == "video", F.col("pts") * F.col("tb_num"))
    whole = F.coalesce(F.col("skip_samples") >= F.col("nb_samples"), F.lit(False))
    # pts * tb_num / tb_den + skip / rate over the common denominator tb_den * rate
    audio = F.when(
        (F.col("media_type") == "audio") & ~whole,
        F.col("pts") * F.col("tb_num") * F.col("sample_rate")
        + F.greatest("skip_samples", F.lit(0)) * F.col("tb_den"),
    )
    is_video, is_audio = F.col("media_type") == "video", F.col("media_type") == "audio"
    picked = frames.groupBy("stream_id").agg(
        F.min(video).cast(WIDE).alias("v_num"),
        F.max(F.when(is_video, F.col("tb_den"))).cast(WIDE).alias("v_den"),
        F.min(audio).cast(WIDE).alias("a_num"),
        F.max(F.when(is_audio, F.col("tb_den") * F.col("sample_rate"))).cast(WIDE).alias("a_den"),
        F.bool_or(is_video).alias("has_video"),
    )
    num = F.when(~F.col("has_video") & F.col("a_num").isNotNull(), F.lit(0).cast(WIDE)).otherwise(
        (F.col("a_num") * F.col("v_den") - F.col("v_num") * F.col("a_den")).cast(WIDE)
    )
    den = F.when(F.col("has_video"), (F.col("a_den") * F.col("v_den")).cast(WIDE)).otherwise(
        F.col("a_den")
    )
    return picked.select(
        "stream_id", "v_num", "v_den", "a_num", "a_den",
        num.alias("offset_num"), F.when(num.isNotNull(), den).alias("offset_den"),
    )


def quantize(num: Column, den: Column, rate: int) -> Column:
    """Samples of a fraction of a second, rounding half away from zero."""
    scaled = (F.abs(num) * rate).cast(WIDE)
    rest = (scaled % den).cast(WIDE)
    whole = ((scaled - rest) / den).cast(WIDE)
    size = whole + F.when(rest * 2 >= den, 1).otherwise(0)
    return F.when(num < 0, -size).otherwise(size).cast("long")


def timeline_actions(origins: DataFrame, *, rate: int = SAMPLE_RATE) -> DataFrame:
    """What to do at the start of each timeline, and why.

    origins: `stream_id, offset_num, offset_den, total_samples, continuity_code`.
    """
    samples = quantize(F.col("offset_num"), F.col("offset_den"), rate)
    rows = origins.withColumn("samples", samples)
    n, broken = F.col("samples"), F.col("continuity_code")
    action = (
        F.when(n.isNull(), "timeline_origin_unverified")
        .when(n > 0, "pad_silence_before")
        .when(n < 0, "trim_before_timeline")
        .otherwise("timeline_origin_unchanged")
    )
    issues = F.array_compact(
        F.array(
            F.when(n.isNull(), "opening_presentation_timestamp_unavailable"),
            F.when(n > 0, "audio_starts_after_media").when(n < 0, "audio_starts_before_media"),
            broken,
        )
    )
    status = (
        F.when(n.isNull() | broken.isNotNull(), "unverified")
        .when(n == 0, "normal")
        .otherwise("corrected")
    )
    return rows.select(
        "stream_id",
        status.alias("timeline_status"),
        action.alias("action"),
        F.when(n != 0, F.abs(n)).alias("sample_count"),
        "total_samples",
        F.array_join(issues, ",").alias("issues"),
    )


def duration_authority(media: DataFrame, *, rate: int = SAMPLE_RATE) -> DataFrame:
    """Presentation length: the video stream before the audio stream, its clock before text.

    media: `media_id, container_duration` (decimal text) and, for video and audio,
    `{kind}_present, {kind}_duration_ts, {kind}_tb_num, {kind}_tb_den, {kind}_duration`.
    """

    def chosen(name: str) -> Column:
        return F.when(F.col("video_present"), F.col(f"video_{name}")).otherwise(
            F.col(f"audio_{name}")
        )

    ticks, num, den = chosen("duration_ts"), chosen("tb_num"), chosen("tb_den")
    clocked = F.coalesce((ticks > 0) & (num > 0) & (den > 0), F.lit(False))
    text = F.coalesce(
        F.nullif(chosen("duration").try_cast("decimal(20,6)"), F.lit(0)),
        F.col("container_duration").try_cast("decimal(20,6)"),
    )
    micros = (text * 1_000_000).cast(WIDE)
    top = F.when(clocked, (ticks * num).cast(WIDE)).otherwise(micros)
    bottom = F.when(clocked, den.cast(WIDE)).otherwise(F.lit(1_000_000).cast(WIDE))
    rows = media.withColumn("total_samples", quantize(top, bottom, rate))
    samples = F.col("total_samples")
    usable = F.coalesce(samples > 0, F.lit(False))
    return rows.select(
        "media_id",
        F.when(F.col("video_present"), "video").otherwise("audio").alias("authority"),
        F.when(clocked, "stream_clock").otherwise("decimal_text").alias("source"),
        F.when(usable, samples).alias("total_samples"),
        F.when(usable, F.floor((samples * 1000 + rate // 2) / rate)).alias("duration_ms"),
    )
