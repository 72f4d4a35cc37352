"""Selecting clips: subjects, hands, dates, sessions and recordings, and a summary of what a selection holds."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.functions import names
from tremorlake.functions.scalars import all_finite
from tremorlake.operators import labels


@dataclass(frozen=True)
class Selector:
    """All given filters hold together; an empty selector keeps everything. Lists may be comma-separated texts."""

    subjects: Iterable[str] | str = ()
    hand: str | None = None
    dates: Iterable[str] | str = ()
    date_from: str | None = None
    date_to: str | None = None
    sessions: Iterable[str] | str = ()
    recordings: Iterable[str] | str = ()
    exact_hand: bool = False

    def filters(self) -> dict:
        lists = {k: names.split_list(getattr(self, k)) for k in ("subjects", "dates", "sessions", "recordings")}
        rest = {"hand": self.hand, "date_from": self.date_from, "date_to": self.date_to}
        return {k: v for k, v in (lists | rest).items() if v}


def _any_prefix(c: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])


def predicate(selector: Selector, subject: str = "subject", hand: str = "hand", date: str = "date", stem: str = "stem", source_file: str = "source_file") -> Column:
    """The selector as one condition, pushed to the scan as far as its parts allow. A blank date lies in no range."""
    f = selector.filters()
    parts = [F.lit(True)]
    if "subjects" in f:
        wanted = [x for x in ("".join(c for c in s.lower() if c.isascii() and c.isalnum()) for s in f["subjects"])]
        parts.append(names.normalise_subject(F.col(subject)).isin(wanted))
    if "hand" in f:
        parts.append(F.col(hand) == f["hand"] if selector.exact_hand else F.lower(hand) == f["hand"].lower())
    if "dates" in f:
        parts.append(_any_prefix(F.col(date), f["dates"]))
    if "date_from" in f or "date_to" in f:
        parts.append((F.col(date) != "") & F.col(date).between(f.get("date_from", "00000000"), f.get("date_to", "99999999")))
    if "sessions" in f:
        parts.append(_any_prefix(names.session_token(F.col(stem)), f["sessions"]))
    if "recordings" in f:
        parts.append(names.without_npz(F.col(source_file)).isin([r.removesuffix(".npz") for r in f["recordings"]]))
    return reduce(lambda a, b: a & b, parts)


def select_clips(clips: DataFrame, selector: Selector, **columns: str) -> tuple[DataFrame, dict]:
    """The clips that the selector keeps, and the selection's scope: its filters and a name for it."""
    f = selector.filters()
    return clips.where(predicate(selector, **columns)), {"filters": f, "tag": names.scope_tag(f)}


def scope_summary(clips: DataFrame, subject: str = "subject", date: str = "date", stem: str = "stem", source_file: str = "source_file") -> DataFrame:
    """One row: clips, recordings, subjects, sorted sessions, first and last date that isn't blank."""
    known = F.when(F.col(date) != "", F.col(date))
    session = names.session_token(F.col(stem))
    return clips.agg(
        F.count("*").alias("n_clips"), F.countDistinct(source_file).alias("n_recordings"),
        F.countDistinct(F.when(F.col(subject).isNotNull(), names.normalise_subject(F.col(subject)))).alias("n_subjects"),
        F.array_sort(F.collect_set(F.when(session != "", session))).alias("sessions"), F.min(known).alias("date_min"), F.max(known).alias("date_max"),
    )


def without_paths(catalog: DataFrame, part: str = "/force_data/", allowed: bool = False, path: str = "path") -> DataFrame:
    return catalog if allowed else catalog.where(~F.lower(path).contains(part.lower()))


def to_process(catalog: DataFrame, dropped: DataFrame, done: DataFrame, force: bool = False, key: str = "rec_key") -> DataFrame:
    """Recordings neither dropped for good nor, unless forced, complete already; nothing of them is read before."""
    left = catalog.join(dropped, key, "left_anti")
    return left if force else left.join(done, key, "left_anti")


def finite_rows(df: DataFrame, values: str) -> DataFrame:
    return df.where(all_finite(F.col(values)))


def quality_passed(recordings: DataFrame, max_missing: float = 0.01) -> DataFrame:
    """Recordings whose lag is as it should be and that miss less than a share of their pose."""
    return recordings.where((F.col("lag_flag") == "ok") & (F.col("pose_nan_frac") < max_missing))


def first_per(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def palette_or_top(chosen: list[str] | dict | None, annotations: DataFrame, most: int = 20) -> DataFrame:
    """``label, position`` of a chosen palette (a list, or a mapping with the list under ``labels``); without one, the labels given most often."""
    names = chosen.get("labels", []) if isinstance(chosen, dict) else list(chosen or [])
    if names:
        return palette(annotations.sparkSession.createDataFrame([(str(n), k) for k, n in enumerate(names)], "label string, position long"), most)
    top = labels.top_labels(annotations, most)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "value")) - 1  # over at most ``most`` rows
    return top.select(F.col("value").alias("label"), place.cast("long").alias("position"))


def palette(labels: DataFrame, most: int = 20, label: str = "label", position: str = "position") -> DataFrame:
    """Trimmed labels without blanks and repeats in the order of their first place, at most ``most``."""
    cleaned = labels.select(F.trim(label).alias("label"), F.col(position).alias("position")).where("label <> ''")
    return cleaned.groupBy("label").agg(F.min("position").alias("position")).orderBy("position", "label").limit(most)
