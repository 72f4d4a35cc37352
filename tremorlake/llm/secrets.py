"""Secret scans: fixed patterns, and weak parts of credentials that count only where complementary parts are near.

Strong finds (assignments, access identifiers, hexadecimal runs) are always reported. Weak candidates (service endpoints,
sites, addresses, account names, bare key-like strings, short access identifiers) are joined with the other parts within
``SCOPE`` code points of the same text and reported only where parts that complete them co-occur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Fixed patterns of the strong kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGN = 12
#: Weak parts. Each match begins where no longer one can, and is taken whole or not at all, so a text is read once.
ENDPOINT = r"(?<![A-Za-z0-9])(?:https?|s3|s?ftp|jdbc:[a-z0-9]+|mongodb(?:\+srv)?|redis|amqp|postgres(?:ql)?|mysql)://[A-Za-z0-9._@:%-]+"
ADDRESS = r"(?<![0-9A-Za-z./@-])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?(?![0-9A-Za-z])(?!\.[0-9])"
ACCOUNT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
KEYLIKE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+"
SHORT_ACCESS = r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{8,13}|ASIA[A-Z0-9]{8,}+)(?![A-Za-z0-9])"
#: The rest of a URL from its separator on: what lies in it is part of a link, not a key.
URL = r"://[^\s\"'<>]+"
#: Kinds in the order in which spans that start together are listed; the last is never reported.
KINDS = ("assign", "access", "hex", "endpoint", "keylike", "short_access", "address", "account", "url")
BASE = ("assign", "access", "hex")
SCOPE = 400
#: What a weak kind needs within the scope: one of these sets of kinds, a part of each. Endpoints that name a user or a port, or aren't web sites, need a secret
#: only, and only they complete others.
SECRETS, IDENTIFIERS, SERVICES = ("assign", "hex", "keylike"), ("access", "short_access"), ("endpoint", "address")
NEEDS: dict[str, tuple[tuple[tuple[str, ...], ...], ...]] = {
    "endpoint": ((("assign",),), (SECRETS, IDENTIFIERS)),
    "keylike": ((IDENTIFIERS,), (SERVICES,)),
    "short_access": ((SECRETS,),),
    "address": ((SECRETS,),),
    "account": ((("assign",),),),
}
MASK = "[SECRET]"
SPAN = "struct<start:int,kind:int,end:int,part:boolean>"


def _number(kind: str) -> int:
    return KINDS.index(kind)


def _always(found: Column) -> Column:
    return F.lit(True)


def _mixed(found: Column) -> Column:
    """Whether a hexadecimal run looks like a key: a bare number does not."""
    return found.rlike("[a-f]") & found.rlike("[0-9]")


def _random(found: Column) -> Column:
    """Whether a string looks drawn at random: both cases, and digits next to letters at two places or more; whole access identifiers aren't keys."""
    return found.rlike("[A-Z]") & found.rlike("[a-z]") & (F.regexp_count(found, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")) >= 2) & ~found.rlike("^A[KS]IA[A-Z0-9]{14,}=*$")


def _service(found: Column) -> Column:
    return ~found.rlike("^https?://[^@:]*$")


def _spans(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0, keep: Callable = _always, part: Callable = _always) -> Column:
    """Leftmost non-overlapping matches as an array of ``SPAN``, in code points.

    A match starts where the texts between and within the matches before it end. Matches whose ``group`` is shorter than
    ``least`` or that ``keep`` refuses are dropped after matching; ``part`` tells which may complete others.
    """

    def placed(parts: Column) -> Column:
        gaps, found, value = parts["g"], parts["m"], parts["v"]
        items = F.transform(
            found,
            lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("g"), F.length(m).alias("m"), ((F.length(F.get(value, i)) >= least) & keep(m)).alias("keep"), part(m).alias("part")),
        )

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            begin = at + x["g"]
            span = F.struct(begin.alias("start"), F.lit(_number(kind)).alias("kind"), (begin + x["m"]).alias("end"), x["part"].alias("part"))
            return begin + x["m"], F.when(x["keep"], F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))

        return common.let(items, lambda a: common.running(a, F.lit(0), SPAN, step))

    parts = F.struct(
        F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v")
    )
    return F.when(text.rlike(pattern), common.let(parts, placed)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _found(docs: DataFrame, kept: list[str]) -> DataFrame:
    """``row, doc`` (a struct of the kept columns, whatever their names), ``base`` and ``weak`` spans of every text, written.

    Each weak kind needs a strong span or a key-like string near, so the other patterns run on texts with one of these only.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    text = F.col("text")
    strong = F.concat(_spans(text, "assign", ASSIGN, 2, MIN_ASSIGN), _spans(text, "access", ACCESS), _spans(text, "hex", HEX, part=_mixed))
    rows = rows.withColumns({"base": F.sort_array(strong), "keys": _spans(text, "keylike", KEYLIKE, keep=_random)})
    others = F.concat(
        "keys", _spans(text, "endpoint", ENDPOINT, part=_service), _spans(text, "short_access", SHORT_ACCESS), _spans(text, "address", ADDRESS), _spans(text, "account", ACCOUNT),
        _spans(text, "url", URL),
    )
    weak = F.when(F.size("base") + F.size("keys") > 0, others).otherwise(F.array().cast(f"array<{SPAN}>"))
    return common.materialize(rows.select(F.monotonically_increasing_id().alias("row"), "doc", "base", weak.alias("weak")), "spans")


def _linked(found: DataFrame, scope: int) -> DataFrame:
    """``row, linked``: weak spans of each text that overlap no strong one and have what they need within ``scope``.

    The interval join goes through the nearest part of each kind on both sides, found by one window in each direction over
    the spans of one text: rows stay as many as spans, however many lie in a scope.
    """
    spans = found.select("row", F.explode(F.concat("base", "weak")).alias("s")).select("row", "s.*")
    forward = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    backward = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    of = lambda kinds: F.col("kind").isin(*[_number(k) for k in kinds])
    groups = {"base": BASE, "link": ("url", "endpoint")} | {f"g{k}": g for k, g in enumerate(dict.fromkeys(g for ways in NEEDS.values() for way in ways for g in way))}
    name_of = {g: n for n, g in groups.items() if n.startswith("g")}
    counts = {n: of(g) & (F.col("part") if n.startswith("g") else F.lit(True)) for n, g in groups.items()}
    spans = spans.withColumns({f"e_{n}": F.max(F.when(c, F.col("end"))).over(forward) for n, c in counts.items()})
    spans = spans.withColumns({f"s_{n}": F.min(F.when(c, F.col("start"))).over(backward) for n, c in counts.items()})
    sure = lambda c: F.coalesce(c, F.lit(False))
    near = lambda g: sure(F.col("start") - F.col(f"e_{name_of[g]}") <= scope) | sure(F.col(f"s_{name_of[g]}") - F.col("end") <= scope)
    touches = lambda n: sure(F.col(f"e_{n}") > F.col("start")) | sure(F.col(f"s_{n}") < F.col("end"))
    complete = F.lit(False)
    for kind, ways in NEEDS.items():
        met = F.lit(False)
        for way in ways:
            every = F.lit(True)
            for g in way:
                every = every & near(g)
            met = met | every
        if kind == "endpoint":
            complete = complete | (of([kind]) & (met | (F.col("part") & near(SECRETS))))
        else:  # what lies in a link belongs to it
            complete = complete | (of([kind]) & met & ~touches("link"))
    spans = spans.where(complete & ~touches("base"))
    return spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "part"))).alias("linked"))


def _scanned(docs: DataFrame, kept: list[str], scope: int) -> DataFrame:
    """``doc, base, linked`` of every row; only texts with a weak part and some other part take part in the join."""
    found = _found(docs, kept)
    possible = (F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)
    joined = found.where(possible).join(_linked(found.where(possible), scope), "row", "left")
    none = F.array().cast(f"array<{SPAN}>")
    joined = joined.select("doc", "base", F.coalesce("linked", none).alias("linked"))
    return joined.unionByName(found.where(~possible).select("doc", "base", none.alias("linked")))


def scan(docs: DataFrame, scope: int = SCOPE, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of every row (default: all but ``text``), with ``base`` and ``linked`` arrays of ``SPAN``.

    Offsets are in code points, ends exclusive, kinds numbered as in ``KINDS``. Null text is empty and has no spans.
    Repeated rows are scanned each. Weak spans that overlap strong ones, and key-like ones within links, are not reported.
    ``keep`` columns named ``base`` or ``linked`` are replaced. An empty table gives no rows.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "linked") and (keep or c != "text")]
    return _scanned(docs, kept, scope).select("doc.*", "base", "linked")


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with the union of the sorted ``spans`` masked; a block of spans at a time, each from its own piece of the text."""

    def block(acc: Column, number: Column) -> Column:
        own = F.slice(spans, number * common.BLOCK + 1, F.lit(common.BLOCK))
        reach = F.greatest(acc["at"], F.array_max(F.transform(own, lambda s: s["end"])))
        piece = F.substr(text, acc["at"] + 1, reach - acc["at"])

        def inside(cut: Column) -> Column:
            def one(a: Column, s: Column) -> Column:
                gap = F.concat(F.substr(cut["piece"], a["at"] - acc["at"] + 1, s["start"] - a["at"]), F.lit(mask))
                out = F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(gap))).otherwise(a["out"])
                return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

            return F.aggregate(cut["own"], F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("out")), one)

        done = common.let(F.struct(own.alias("own"), piece.alias("piece")), inside)
        return common.let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(d["out"], ""))).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    numbers = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / common.BLOCK).cast("int"))
    return F.aggregate(numbers, start, block, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame, scope: int = SCOPE, mask: str = MASK, length: str | None = None) -> DataFrame:
    """``docs`` with every span found replaced by ``mask`` in ``text``; texts without spans stay as they are, nulls too.

    Overlapping spans are masked once. All columns stay, in their order and whatever their names. A column named
    ``length`` gets the new number of code points of changed texts. Repeated rows stay; an empty table gives no rows.
    """
    scanned = _scanned(docs, docs.columns, scope).withColumn("spans", F.sort_array(F.concat("base", "linked")))
    text, changed = F.col("doc").getField("text"), F.size("spans") > 0
    scanned = scanned.withColumn("masked", F.when(changed, common.let(F.col("spans"), lambda s: _masked(text, s, mask))))

    def column(c: str) -> Column:
        was = F.col("doc").getField(c)
        if c == "text":
            return F.when(changed, F.col("masked")).otherwise(was).alias(c)
        if c == length:
            return F.when(changed, F.length("masked").cast(docs.schema[c].dataType)).otherwise(was).alias(c)
        return was.alias(c)

    return scanned.select(*[column(c) for c in docs.columns])
