"""Checks over timed utterances and their rendering as subtitles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.ordered import following, previous

SLICE = 65_536


def _sliced(units: DataFrame) -> DataFrame:
    return units.withColumn("part", F.floor(F.col("pos") / SLICE))


def adjacent_overlaps(units: DataFrame) -> DataFrame:
    """Neighbours in provider order whose intervals share more than a point."""
    pairs = following(
        _sliced(units), ["doc_id"], ["pos"], "part",
        next_start=F.col("start_ms"), next_end=F.col("end_ms"),
    )
    begin = F.greatest("start_ms", "next_start")
    end = F.least("end_ms", "next_end")
    return pairs.where(F.col("next_start").isNotNull() & (begin < end)).select(
        "doc_id", "pos", begin.alias("overlap_start"), end.alias("overlap_end")
    )


def timed_unit_audit(units: DataFrame) -> DataFrame:
    """Codes for empty text, an empty or negative interval, and a start before the last end."""
    rows = previous(_sliced(units), ["doc_id"], ["pos"], "part", last_end=F.col("end_ms"))
    rules = (
        ("empty_text", F.col("text") == ""),
        ("bad_interval", (F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms"))),
        ("out_of_order", F.col("start_ms") < F.col("last_end")),
    )
    codes = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))
    return rows.select("doc_id", "pos", F.array_join(codes, ",").alias("codes")).where(
        F.col("codes") != ""
    )


def diagnostics(units: DataFrame, inputs: DataFrame) -> DataFrame:
    """A receipt per document; it never judges. `inputs` holds `doc_id, audio_text`."""
    pairs = following(
        _sliced(units), ["doc_id"], ["pos"], "part",
        next_start=F.col("start_ms"), next_end=F.col("end_ms"),
    )
    start, end = F.col("start_ms"), F.col("end_ms")
    overlap = F.greatest(start, F.col("next_start")) < F.least(end, F.col("next_end"))
    counted = pairs.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("utterance_count"),
        F.sum(F.length("text")).alias("output_length"),
        F.count_if(F.col("text") == "").alias("empty_text_count"),
        F.count_if((start < 0) | (end < 0)).alias("negative_time_count"),
        F.count_if(end < start).alias("reversed_interval_count"),
        F.count_if(end == start).alias("zero_duration_count"),
        F.count_if(F.col("next_start").isNotNull() & overlap).alias("overlap_count"),
    )
    size = F.length("audio_text").cast("long")
    # only an output of the input's length can be identical, so what is gathered is bounded
    same_length = counted.join(inputs, "doc_id").where(F.col("output_length") == size)
    spoken = (
        units.where(F.col("text") != "")
        .join(same_length.select("doc_id"), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("u"))
        .select("doc_id", F.array_join(F.transform("u", lambda u: u["text"]), "").alias("output"))
    )
    joined = inputs.join(counted, "doc_id", "left").join(spoken, "doc_id", "left")
    identical = F.coalesce(F.col("output") == F.col("audio_text"), F.col("audio_text") == "")
    identical = identical & (F.coalesce("output_length", F.lit(0)) == size)
    numbers = [
        F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        for c in (
            "utterance_count", "output_length", "empty_text_count", "negative_time_count",
            "reversed_interval_count", "zero_duration_count", "overlap_count",
        )
    ]
    return joined.select(
        "doc_id",
        F.when(identical, "identical").otherwise("differs").alias("relation"),
        size.alias("input_length"),
        (F.coalesce("output_length", F.lit(0)) - size).alias("length_delta"),
        *numbers,
    )


def srt_time(ms: Column) -> Column:
    def digits(value: Column, width: int) -> Column:
        text = value.cast("string")
        return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))

    return F.concat(
        digits(F.floor(ms / 3_600_000), 2), F.lit(":"),
        digits(F.floor(ms / 60_000) % 60, 2), F.lit(":"),
        digits(F.floor(ms / 1000) % 60, 2), F.lit(","),
        digits(ms % 1000, 3),
    )


def render_srt(documents: DataFrame, units: DataFrame, *, cues_per_part: int = 10_000) -> DataFrame:
    """Subtitle text in parts of bounded size; a document's parts in order are its file.

    `units.pos` counts from 0 without holes. Documents with a negative or reversed time get
    one row without text. A document without cues renders as an empty file.
    """
    bad = (F.col("start_ms") < 0) | (F.col("end_ms") < 0) | (F.col("start_ms") > F.col("end_ms"))
    totals = units.groupBy("doc_id").agg(
        F.max("pos").alias("last_pos"), F.bool_or(bad).alias("bad")
    )
    status = documents.select("doc_id").join(totals, "doc_id", "left")
    cue = F.concat(
        (F.col("pos") + 1).cast("string"), F.lit("\n"),
        srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")), F.lit("\n"),
        F.col("text"),
    )
    parts = (
        units.join(status.where(~F.col("bad")), "doc_id")
        .withColumn("part", F.floor(F.col("pos") / cues_per_part))
        .groupBy("doc_id", "part")
        .agg(
            F.sort_array(F.collect_list(F.struct("pos", cue.alias("cue")))).alias("cues"),
            F.max(F.col("pos") == F.col("last_pos")).alias("ends"),
        )
        .select(
            "doc_id",
            "part",
            F.concat(
                F.when(F.col("part") > 0, "\n\n").otherwise(""),
                F.array_join(F.transform("cues", lambda c: c["cue"]), "\n\n"),
                F.when(F.col("ends"), "\n").otherwise(""),
            ).alias("text"),
        )
    )
    return status.join(parts, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("bad"), "bad_time").otherwise("rendered").alias("outcome"),
        F.coalesce("part", F.lit(0)).alias("part"),
        F.when(F.coalesce(F.col("bad"), F.lit(False)), None)
        .otherwise(F.coalesce("text", F.lit("")))
        .alias("text"),
    )
