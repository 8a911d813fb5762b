"""What lists and legends of documents show: ages, estimates, stage timings, colours; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import format_duration, let

# Colours of communities, in their order, and of the origins of links; the last is for any other.
COMMUNITY_COLORS = ["#eaeaea", "#ff2a2a", "#ffb000", "#2de2e6", "#7aa2ff", "#c792ea", "#ff9e64", "#e0af68", "#7dcfff", "#bb9af7", "#f7768e", "#b8c0e0"]
TAG_COLORS = {"llm": "#eaeaea", "cooccurrence": "#5c6370", "both": "#ffb000"}
OTHER_TAG = "#5c6370"
# Keys of the statistics of a run with their labels, in the order shown.
STAGES = {"parsing_seconds": "parse", "chunking_seconds": "chunk", "statistical_seconds": "statistical", "llm_seconds": "llm", "pipeline_seconds": "total"}
STATS = "map<string,string>"
STALE_SECONDS = 120


def time_ago(at: Column, now: Column) -> Column:
    """How long ago a time was, in whole seconds, minutes, or hours and minutes; times to come are just now."""
    age = F.greatest(F.lit(0), F.floor(now.cast("double") - at.cast("double") + 0.5)).cast("bigint")

    def shown(s: Column) -> Column:
        m = F.floor(s / 60)
        text = lambda c: c.cast("string")
        return (
            F.when(s < 5, F.lit("just now")).when(s < 60, F.concat(text(s), F.lit("s ago"))).when(m < 60, F.concat(text(m), F.lit("m ago")))
            .otherwise(F.concat(text(F.floor(m / 60)), F.lit("h "), text(m % 60), F.lit("m ago")))
        )

    return let(age, shown)


def eta(seconds: Column) -> Column:
    """What is left of a run, rounded up; nothing is known of less than a second."""
    left = lambda c, unit: F.concat(F.lit("~"), F.ceil(c).cast("string"), F.lit(unit + " left"))
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 1), F.lit("calculating ETA")).when(seconds < 60, left(seconds, "s")).otherwise(left(seconds / 60, "m"))


def progress_detail(raw: Column) -> Column:
    """The JSON object of a status row's progress, as a struct; null where it is none."""
    return F.from_json(raw, "completed bigint, total bigint, cache_hits bigint, cache_misses bigint, eta_seconds double, concurrency bigint, throttle_events bigint")


def _number(stats: Column, key: str) -> Column:
    """A finite number among the statistics."""
    v = F.try_element_at(stats, F.lit(key)).try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)


def stage_timings(stats_json: Column) -> Column:
    """The stages that have a time, as ``array<struct<label, seconds>>`` in their order; null where no stage has one.

    The model's stage counts only if it took time or got chunks.
    """
    stats = F.from_json(stats_json, STATS)
    used = (F.coalesce(_number(stats, "llm_seconds"), F.lit(0.0)) > 0) | (F.coalesce(_number(stats, "llm_chunks"), F.lit(0.0)) > 0)
    any_ = F.coalesce(*(_number(stats, k) for k in STAGES)).isNotNull()
    each = [F.struct(F.lit(label).alias("label"), (F.when(used, _number(stats, k)) if label == "llm" else _number(stats, k)).alias("seconds")) for k, label in STAGES.items()]
    return F.when(any_, F.filter(F.array(*each), lambda x: x["seconds"].isNotNull()))


def timing_line(timings: Column) -> Column:
    """Stage timings in one line; empty without any."""
    return F.coalesce(F.array_join(F.transform(timings, lambda x: F.concat_ws(" ", x["label"], format_duration(x["seconds"]))), " · "), F.lit(""))


def context_line(stats_json: Column) -> Column:
    """Chunks, chunks that the model was asked, and calls at once, as far as they are known."""
    stats = F.from_json(stats_json, STATS)
    n = lambda k: F.coalesce(_number(stats, k), F.lit(0.0))
    used = (n("llm_seconds") > 0) | (n("llm_chunks") > 0)
    part = lambda k, before, after, ok: F.when(ok & (n(k) != 0), F.concat(F.lit(before), n(k).cast("bigint").cast("string"), F.lit(after)))
    return F.concat_ws(" · ", part("chunks", "", " chunks", F.lit(True)), part("llm_selected_chunks", "", " LLM-selected", used), part("llm_concurrency", "concurrency ", "", used))


def stalled(status: Column, updated_at: Column, now: Column) -> Column:
    """Is a run under way that hasn't said anything for two minutes?"""
    return ~status.isin("done", "error") & (now.cast("double") - updated_at.cast("double") > STALE_SECONDS)


def community_color(community: Column) -> Column:
    return F.get(F.array(*map(F.lit, COMMUNITY_COLORS)), F.pmod(community, F.lit(len(COMMUNITY_COLORS))))


def tag_color(tag: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in TAG_COLORS.items() for x in kv))[tag], F.lit(OTHER_TAG))
