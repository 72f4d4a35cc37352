"""Names of recordings: paths, subjects, hands, sessions, dates, clip keys and folders, as column expressions."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HANDS = ("left", "right", "both")
#: Fixed patterns of the layouts: a session folder, and a batch folder named by a subject without hyphen.
SESSION = r"(?i)^(\d{8})-(left|right|both)(?:-(\d+))?$"
BATCH = r"^([A-Za-z]{2,}\d{3,})(?:_(.+))?$"
DATE = r"20\d{6}"


def _blank_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_date(*texts: Column) -> Column:
    """The first ``20YYMMDD`` in the texts, in their order; empty when there is none."""
    return F.coalesce(*[_blank_null(F.regexp_extract(F.coalesce(t, F.lit("")), DATE, 0)) for t in texts], F.lit(""))


def common_prefix(paths: DataFrame, path: str = "path") -> DataFrame:
    """One row with ``prefix``: the longest folder that all paths lie in, with its slash; empty without one. It is that of the least and the greatest path."""
    ends = paths.agg(F.min(path).alias("a"), F.max(path).alias("b")).select(F.split("a", "/").alias("a"), F.split("b", "/").alias("b"))
    folders = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size("a"), F.size("b")) - 1))
    same = F.filter(folders, lambda k: (F.slice("a", F.lit(1), k) == F.slice("b", F.lit(1), k)) & (k < F.size("a")) & (k < F.size("b")))
    depth = F.coalesce(F.array_max(same), F.lit(0))
    return ends.select(F.when(depth > 0, F.concat(F.array_join(F.slice("a", F.lit(1), depth), "/"), F.lit("/"))).otherwise("").alias("prefix"))


def normalise_subject(s: Column) -> Column:
    """Lower-case letters and digits of a subject's id; null gives an empty text."""
    return F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]", "")


def hyphenated(s: Column) -> Column:
    return F.regexp_replace(s, r"^([A-Za-z]+)(\d+)$", "$1-$2")


def session_token(stem: Column) -> Column:
    """The second of three or more fields of a stem, else empty."""
    parts = F.split(stem, "__")
    return F.when(F.size(parts) >= 3, F.get(parts, 1)).otherwise("")


def stem_of(path: Column) -> Column:
    """The file's name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def _parent(path: Column, up: int) -> Column:
    parts = F.split(path, "/")
    return F.coalesce(F.get(parts, F.size(parts) - 1 - up), F.lit(""))


def parse_path(path: Column) -> Column:
    """``stem, subject, hand, grp, date, parsed`` of a recording's path.

    Three layouts in order: ``subject__date-hand...__time`` names; a parent folder ``date-hand[-n]`` under the subject's;
    a parent folder that begins with a subject without hyphen. Anything else is its own group, without subject and hand.
    """
    stem, folder, above = stem_of(path), _parent(path, 1), _parent(path, 2)
    parts = F.split(stem, "__")
    middle = F.split(F.coalesce(F.get(parts, 1), F.lit("")), "-")
    token = F.lower(F.coalesce(F.get(middle, 1), F.lit("")))
    named = F.coalesce(*[F.when(token.startswith(h), h) for h in HANDS])
    is_named = (F.size(parts) >= 3) & (F.size(middle) >= 2) & (F.get(parts, 0) != "") & named.isNotNull()
    is_session = folder.rlike(SESSION) & (above != "")
    session_hand = F.lower(F.regexp_extract(folder, SESSION, 2))
    is_batch = folder.rlike(BATCH)
    batch_subject = hyphenated(F.regexp_extract(folder, BATCH, 1))
    rest = F.split(F.lower(F.regexp_extract(folder, BATCH, 2)), "_")
    batch_hand = F.get(F.filter(rest, lambda x: x.isin(*HANDS)), 0)

    def row(stem: Column, subject: Column, hand: Column, group: Column, date: Column, parsed: bool) -> Column:
        text = lambda c, n: c.cast("string").alias(n)
        return F.struct(text(stem, "stem"), text(subject, "subject"), text(hand, "hand"), text(group, "grp"), text(date, "date"), F.lit(parsed).alias("parsed"))

    joined = lambda s, h: F.concat_ws("-", s, h)
    made = lambda s: F.concat_ws("__", s, folder, stem)
    last = F.element_at(parts, -1)
    return (
        F.when(is_named, row(stem, F.get(parts, 0), named, joined(F.get(parts, 0), named), first_date(F.get(parts, 1), last), True))
        .when(is_session, row(made(above), above, session_hand, joined(above, session_hand), F.regexp_extract(folder, SESSION, 1), True))
        .when(is_batch, row(made(batch_subject), batch_subject, batch_hand, joined(batch_subject, batch_hand), first_date(stem, folder), True))
        .otherwise(row(stem, F.lit(None), F.lit(None), stem, first_date(stem), False))
    )


def rec_key(source_file: Column, hand: Column) -> Column:
    """One recording of one hand: two hands may share a file."""
    return F.concat(source_file, F.lit("#"), F.coalesce(hand, F.lit("")))


def side_of(hand: Column, *hints: Column, fallback: str = "left") -> Column:
    """An explicit hand, else the first hint that names one (right is looked for before left), else the fallback."""
    out = F.when(F.lower(hand).isin("left", "right"), F.lower(hand))
    for hint in hints:
        low = F.lower(F.coalesce(hint, F.lit("")))
        out = out.when(low.contains("right"), "right").when(low.contains("left"), "left")
    return out.otherwise(fallback)


def clip_key(stem: Column, clip_id: Column) -> Column:
    return F.format_string("%s__c%04d", stem, clip_id)


def clip_key_parts(key: Column) -> Column:
    pattern = r"^(.*)__c(\d+)$"
    return F.struct(F.regexp_extract(key, pattern, 1).alias("stem"), F.regexp_extract(key, pattern, 2).cast("long").alias("clip_id"))


def export_name(label: Column, subject: Column, hand: Column, stem: Column, clip_id: Column) -> Column:
    return F.format_string("%s__%s-%s__%s__clip%04d", label, subject, hand, stem, clip_id)


def folder_of(path: Column) -> Column:
    """The path without its last part."""
    return F.regexp_replace(path, "/[^/]*$", "")


def folder_key(path: Column) -> Column:
    """The last two folders of a path, joined and freed of odd characters."""
    return F.regexp_replace(F.concat_ws("__", _blank_null(_parent(path, 2)), _blank_null(_parent(path, 1))), "[^A-Za-z0-9._-]", "_")


def group_hand(group: Column) -> Column:
    return F.substring_index(group, "-", -1)


def remap_group(group: Column, by: str) -> Column:
    """The group itself (``subject-hand``), its hand, or one group of all."""
    return {"subject-hand": group, "hand": group_hand(group), "all": F.lit("all")}[by]


def without_npz(name: Column) -> Column:
    return F.regexp_replace(name, r"\.npz$", "")


def split_list(text: str | Iterable[str] | None) -> list[str]:
    """A comma-separated list, trimmed and without blanks."""
    items = text.split(",") if isinstance(text, str) else list(text or [])
    return [x for x in (i.strip() for i in items) if x]


def scope_tag(filters: Mapping) -> str:
    """A short name of a selection: subjects, sessions, dates, range, hand, recordings, in this order; at most 48 characters."""
    parts = [*filters.get("subjects", []), *filters.get("sessions", []), *filters.get("dates", [])]
    if filters.get("date_from") or filters.get("date_to"):
        parts.append(f"{filters.get('date_from') or ''}-{filters.get('date_to') or ''}")
    if filters.get("hand"):
        parts.append(filters["hand"])
    if filters.get("recordings"):
        parts.append(f"{len(filters['recordings'])}rec")
    return re.sub(r"[^A-Za-z0-9._-]", "-", "_".join(parts))[:48] or "all"


def segmentation_version(parameters: Mapping) -> str:
    """Eight hexadecimal digits that change with any parameter, absolute thresholds included."""
    return hashlib.sha1(json.dumps(dict(parameters), sort_keys=True, default=str).encode()).hexdigest()[:8]


def run_id(parameters: Mapping, label: str = "", now: datetime | None = None) -> str:
    stamp = (now or datetime.now()).strftime("%Y%m%d-%H%M%S")
    return "__".join([stamp, *([label] if label else []), segmentation_version(parameters)])
