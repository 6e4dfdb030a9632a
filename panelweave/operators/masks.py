"""Interval tables against a calendar, and the row-set masks they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from panelweave.functions.codes import pad_to, padded

FAR_FUTURE = "9999-12-31"
OPEN_INDUSTRY_END = "2200-12-31"
ST_TYPES = ("S", "Y", "L")


def day_rows(intervals: DataFrame, calendar: DataFrame, start: Column, end: Column, closed: str = "left") -> DataFrame:
    """One row per interval and trading day it covers; other columns are kept.

    ``intervals`` has ``code``, ``start`` and ``end`` (NULL = open). ``closed`` is ``left`` for
    start <= day < end and ``both`` for start <= day <= end. Each interval is turned into its
    own days, so there is no range join; the calendar (a row per day) is the broadcast side.

    Intervals are spread by code before they grow into days, in as many tasks as a shuffle has:
    the many day rows then stay where they are, also when they are grouped by (date, code).
    """
    if closed not in ("left", "both"):
        raise ValueError("closed must be 'left' or 'both'")
    last = F.col("end") if closed == "both" else F.date_sub("end", 1)
    lo = F.greatest(F.col("start"), start)
    hi = F.least(F.coalesce(last, end), end)
    keep = [c for c in intervals.columns if c not in ("start", "end")]
    clipped = intervals.select(*keep, lo.alias("_lo"), hi.alias("_hi")).filter("_lo <= _hi")
    days = by_code(clipped).select(*keep, F.explode(F.sequence("_lo", "_hi")).alias("date"))
    return days.join(F.broadcast(calendar.select("date").distinct()), "date", "left_semi")


def by_code(df: DataFrame) -> DataFrame:
    """Hash by code into twice the session's shuffle partitions.

    A stated number is not coalesced at run time, where rows look few before they grow into
    days, and twice the default keeps the step from being dropped as a repeat of a shuffle by code.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(2 * n, "code")


def longest(intervals: DataFrame, keys: tuple[str, ...] = ("code",)) -> DataFrame:
    """One interval per (code, start), the longest. The days covered stay the same, and a code
    keeps at most one interval per day, however many rows it has."""
    end = F.max(F.coalesce("end", F.lit(FAR_FUTURE).cast("date"))).alias("end")
    return intervals.groupBy(*keys, "start").agg(end)


def merged(intervals: DataFrame, keys: tuple[str, ...] = ("code",)) -> DataFrame:
    """Intervals of a code joined where they overlap, so that no day is covered twice.

    After ``longest`` a code has at most one interval per day, which keeps the window small.
    """
    w = W.partitionBy(*keys).orderBy("start")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = longest(intervals, keys).withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    islands = fresh.withColumn("_i", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")


def over_days(spans: DataFrame, calendar: DataFrame, by: list[str], sums: dict[str, Column], tops: dict[str, Column], start: str | None = None, end: str | None = None, closed: str = "left") -> DataFrame:
    """Per group and trading day that some span covers: sums and greatest values over the spans that cover it.

    A span is never turned into its days. It is cut into at most two aligned blocks of each size 1, 2, 4, … days; what
    has the same block is added up before it moves, and a day then takes what its own blocks hold, one of each size.
    So the work goes by the number of spans, and by groups times days, but not by spans times days.
    """
    bounds = calendar.agg(F.min("date").alias("a"), F.max("date").alias("b"), (F.max(F.unix_date("date")) - F.min(F.unix_date("date"))).alias("days")).first()  # one row
    sizes = range(int(bounds["days"] or 0).bit_length() + 1)
    lo, hi = (F.lit(x).cast("date") for x in (start or bounds["a"], end or bounds["b"]))
    last = F.coalesce("end", F.lit(FAR_FUTURE).cast("date"))
    a = F.unix_date(F.greatest("start", lo))
    b = F.unix_date(F.least(last if closed == "both" else F.date_sub(last, 1), hi)) + 1  # the first day after
    rows = spans.select(*by, *[c.alias(n) for n, c in (sums | tops).items()], a.alias("_a"), b.alias("_b")).filter("_a < _b")
    blocks = []
    for k in sizes:
        left, right = F.shiftright(F.col("_a") + F.lit(2**k - 1), k), F.shiftright("_b", k)
        here = left < right
        block = lambda at, k=k: F.struct(F.lit(k).alias("size"), at.alias("block"))
        blocks += [F.when(here & (left.bitwiseAND(F.lit(1)) == 1), block(left)), F.when(here & (right.bitwiseAND(F.lit(1)) == 1), block(right - 1))]
    joined = [F.sum(n).alias(n) for n in sums] + [F.max(n).alias(n) for n in tops]
    held = rows.select(*by, *sums, *tops, F.explode(F.array_compact(F.array(*blocks))).alias("_k")).groupBy(*by, "_k").agg(F.count(F.lit(1)).alias("_n"), *joined)
    days = calendar.select("date").distinct().filter(F.col("date").between(lo, hi))
    day = F.unix_date("date")
    days = days.select("date", F.explode(F.array(*[F.struct(F.lit(k).alias("size"), F.shiftright(day, k).alias("block")) for k in sizes])).alias("_k"))
    return held.join(F.broadcast(days), "_k").groupBy(*by, "date").agg(*joined)


def calendar_bounds(calendar: DataFrame, start: str | None, end: str | None) -> tuple[Column, Column]:
    lo = F.lit(start).cast("date") if start else calendar.agg(F.min("date")).scalar()
    hi = F.lit(end).cast("date") if end else calendar.agg(F.max("date")).scalar()
    return lo, hi


def interval_mask(calendar: DataFrame, intervals: DataFrame, start: str | None = None, end: str | None = None, closed: str = "left") -> DataFrame:
    """The (date, code) cells covered by at least one interval."""
    lo, hi = calendar_bounds(calendar, start, end)
    return day_rows(merged(intervals), calendar, lo, hi, closed).select("date", "code")


def st_mask(calendar: DataFrame, st: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Special-treatment cells: only the listed types count."""
    return interval_mask(calendar, st.filter(F.col("type").isin(*ST_TYPES)), start, end)


def suspended(calendar: DataFrame, events: DataFrame, daily_status: DataFrame, order: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Suspended cells: event intervals, overruled by the day's trading status where there is one.

    The last status of a day in ``order`` wins and any status other than -1 means suspended.
    Both inputs are spread by code and meet in one grouping.
    """
    lo, hi = calendar_bounds(calendar, start, end)
    by_event = day_rows(merged(events), calendar, lo, hi).select("date", "code", F.lit(True).alias("_event"), F.lit(None).cast("int").alias("_status"))
    status = daily_status.filter(F.col("status").isNotNull() & F.col("date").between(lo, hi))
    status = status.join(F.broadcast(calendar.select("date").distinct()), "date", "left_semi")
    last = status.groupBy("date", "code").agg(F.max_by(F.col("status").cast("int"), F.struct(*order)).alias("_status"))
    by_status = by_code(last).select("date", "code", F.lit(False).alias("_event"), "_status")
    cells = by_event.unionByName(by_status).groupBy("date", "code").agg(F.bool_or("_event").alias("_event"), F.max("_status").alias("_status"))
    return cells.filter(F.coalesce(F.col("_status") != -1, F.col("_event"))).select("date", "code")


def suspended_spans(events: DataFrame, daily_status: DataFrame, order: list[str]) -> DataFrame:
    """``suspended`` as disjoint spans per code: a status of -1 takes its day out of a span, any other one adds its day.

    A day's span is the last one that starts by then, found in one window per code over spans and statuses.
    """
    last = daily_status.filter(F.col("status").isNotNull()).groupBy("date", "code").agg(F.max_by(F.col("status").cast("int"), F.struct(*order)).alias("_status"))
    spans = merged(events).select("code", F.col("start").alias("date"), F.lit(None).cast("int").alias("_status"), F.struct("start", "end").alias("_s"))
    both = spans.unionByName(last.select("code", "date", "_status", F.lit(None).cast("struct<start:date,end:date>").alias("_s")))
    seen = F.last("_s", ignorenulls=True).over(W.partitionBy("code").orderBy("date", F.col("_s").isNull()).rowsBetween(W.unboundedPreceding, 0))
    marks = both.withColumn("_in", seen).withColumn("_is", F.coalesce(F.col("_in.end") > F.col("date"), F.lit(False)))
    added = marks.filter((F.col("_status") != -1) & ~F.col("_is")).select("code", F.col("date").alias("start"), F.date_add("date", 1).alias("end"))
    # Cuts of each span: days taken out, and its end.
    cuts = marks.filter(((F.col("_status") == -1) & F.col("_is")) | F.col("_s").isNotNull())
    cuts = cuts.select("code", "_in", F.when(F.col("_s").isNotNull(), F.col("_s.end")).otherwise(F.col("date")).alias("cut"))
    before = F.lag("cut").over(W.partitionBy("code", "_in").orderBy("cut"))
    pieces = cuts.select("code", F.coalesce(F.date_add(before, 1), F.col("_in.start")).alias("start"), F.col("cut").alias("end"))
    return pieces.filter("start < end").unionByName(added)


def member_totals(members: DataFrame, calendar: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """``member_lists`` of ``index_members``, from the memberships' ends and without a row per member and day."""
    whole = merged(members, ("index_code", "code")).select("index_code", "start", "end", F.lit(1).alias("_one"), F.lit(None).cast("date").alias("opdate"))
    stamps = members.select("index_code", "start", "end", F.lit(0).alias("_one"), F.col("opdate").cast("date").alias("opdate"))
    found = over_days(whole.unionByName(stamps), calendar, ["index_code"], {"n_members": F.col("_one")}, {"opdate": F.col("opdate")}, start, end, "both")
    return found.select("date", "index_code", "n_members", "opdate")


def index_members(members: DataFrame, calendar: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Members of each index on each trading day; both ends of a membership count."""
    lo, hi = calendar_bounds(calendar, start, end)
    spans = members.groupBy("index_code", "code", "start", "end").agg(F.max("opdate").alias("opdate"))
    return day_rows(spans, calendar, lo, hi, "both").groupBy("date", "index_code", "code").agg(F.max("opdate").alias("opdate"))


def members_on(members: DataFrame, day: str) -> DataFrame:
    """Members of each index on one day."""
    at = F.lit(day).cast("date")
    active = members.filter((F.col("start") <= at) & (F.col("end").isNull() | (F.col("end") >= at)))
    return active.groupBy("index_code", "code").agg(F.max("opdate").alias("opdate"))


def member_lists(daily_members: DataFrame) -> DataFrame:
    """Per index and day the member count and the latest change stamp."""
    return daily_members.groupBy("date", "index_code").agg(
        F.count(F.lit(1)).alias("n_members"), F.max("opdate").alias("opdate")
    )


def universe(daily_members: DataFrame, index_code: str) -> DataFrame:
    """The (date, code) cells that belong to one index."""
    return daily_members.filter(F.col("index_code") == index_code).select("date", "code")


def industry_history(history: DataFrame, code_table: DataFrame, scheme: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Industry spells with names looked up at three depths of the industry code.

    A depth without an entry in ``code_table`` falls back to the raw code's characters.
    ``history`` has (code, ind_code, entry, remove).
    """
    if scheme not in ("zx", "sw"):
        raise ValueError("scheme must be 'zx' or 'sw'")
    h = history
    if end:
        h = h.filter(F.col("entry") <= F.lit(end).cast("date"))
    if start:
        h = h.filter(F.col("remove").isNull() | (F.col("remove") > F.lit(start).cast("date")))
    raw = F.col("ind_code")
    depths = {"first": padded(raw, 4), "second": padded(raw, 6), "full": pad_to(raw)}
    fallback = {"first": F.substring(raw, 1, 4), "second": F.substring(raw, 1, 6), "full": raw}
    for name, key in depths.items():
        table = code_table.select(
            F.col("industriescode").alias(f"_{name}"),
            F.nullif("industriesalias", F.lit("")).alias(f"_{name}_alias"),
            F.nullif("industriesname", F.lit("")).alias(f"_{name}_name"),
        )
        h = h.withColumn("_key", key).join(table, F.col("_key") == F.col(f"_{name}"), "left").drop("_key", f"_{name}")
        h = h.withColumn(f"{name}_code", F.coalesce(f"_{name}_alias", fallback[name]))
        h = h.withColumn(f"{name}_name", F.coalesce(f"_{name}_name", fallback[name]))
    cancel = F.coalesce(F.col("remove"), F.lit(OPEN_INDUSTRY_END).cast("date")).alias("cancel_date")
    base = ["code", F.col("entry").alias("start_date"), cancel]
    if scheme == "zx":
        return h.select(
            *base, F.col("first_code").alias("first_industry_code"), F.col("first_name").alias("first_industry_name"),
            F.col("second_code").alias("second_industry_code"), F.col("second_name").alias("second_industry_name"),
        )
    return h.select(
        *base, F.lit(2).alias("version"), F.col("first_name").alias("index_name"),
        F.concat("first_code", F.lit(".INDX")).alias("index_code"), F.col("second_name").alias("index_name2"),
        F.concat("second_code", F.lit(".INDX")).alias("index_code2"),
    )
