"""Limits, quotas and budgets of requests, as windows over the requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_MINUTE, PER_HOUR, QUOTA, PER_DAY = 5, 30, 10, 200
HEALTH_FAILURES, HEALTH_MINUTES = 3, 15


def _before(keys: list, order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _with_row_of(rows: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what ``one`` has for their keys; nulls are keys like others. ``one`` has a row for each of the rows' keys."""
    named = one.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return rows.join(named, same).drop(*(f"__k_{k}" for k in keys))


def rate_limited(requests: DataFrame, *, caller: str, ts: str, order: list[str], per_minute: int = PER_MINUTE, per_hour: int = PER_HOUR) -> DataFrame:
    """Add minute_count, hour_count and allowed. Every attempt counts in both windows, refused ones too. ``order`` begins
    with ``ts``.

    An hour's count is that of the minutes before, of which there are 59 at most, and that within the minute. So the
    largest window holds what one caller sends in a minute.
    """
    rows = requests.withColumn("minute_start", F.date_trunc("minute", ts).cast("timestamp_ntz")).withColumn("hour_start", F.date_trunc("hour", ts).cast("timestamp_ntz"))
    sums = rows.groupBy(caller, "hour_start", "minute_start").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(caller, "hour_start").orderBy("minute_start").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(caller, "minute_start", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    rows = rows.withColumn("minute_count", F.count(F.lit(1)).over(_before([caller, "minute_start"], order)))
    rows = _with_row_of(rows, sums, [caller, "minute_start"]).withColumn("hour_count", F.col("__base") + F.col("minute_count")).drop("__base")
    return rows.withColumn("allowed", (F.col("minute_count") <= per_minute) & (F.col("hour_count") <= per_hour))


def within_quota(requests: DataFrame, *, visitor: str, order: list[str], consumes: Column, quota: int = QUOTA) -> DataFrame:
    """Add used (before the request) and reserved. Only accepted requests that are not refunded consume; those after
    the quota is used up are refused, so counting all consuming ones before is enough. ``order`` tells requests apart.

    A visitor's first ``quota`` consuming requests decide for all others. Each task ranks its own first ones, so no
    window holds a visitor.
    """
    place = F.struct(*order)
    taken = requests.where(consumes).select(visitor, place.alias("__place"))
    ranked = taken.withColumn("__n", F.row_number().over(Window.partitionBy(visitor).orderBy("__place"))).where(F.col("__n") <= quota)
    first = ranked.groupBy(F.col(visitor).alias("__visitor")).agg(F.collect_list("__place").alias("__first"))
    rows = requests.withColumn("__place", place).join(first, F.col(visitor).eqNullSafe(F.col("__visitor")), "left")
    used = F.coalesce(F.size(F.filter("__first", lambda p: p < F.col("__place"))), F.lit(0))
    rows = rows.withColumn("used", F.when(F.col("__first").isNull(), 0).otherwise(used).cast("long")).drop("__place", "__visitor", "__first")
    return rows.withColumn("reserved", F.col("used") < quota)


#: Outcomes that give the question back.
REFUNDED = ("out_of_scope", "error", "timeout", "provider_error", "validation_error")


def is_refunded(outcome: Column) -> Column:
    return outcome.isin(*REFUNDED)


def within_daily_budget(requests: DataFrame, *, ts: str, order: list[str], limit: int = PER_DAY) -> DataFrame:
    """Add day, day_count and reserved: one reservation a request, whatever its calls, and no refunds.

    The count within a day is a running one over hours' subtotals and within an hour, so that no window holds a day.
    """
    rows = requests.withColumn("day", F.to_date(ts)).withColumn("__hour", F.date_trunc("hour", ts))
    sums = rows.groupBy("day", "__hour").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("day").orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__base", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    rows = rows.join(sums, ["day", "__hour"])
    rows = rows.withColumn("day_count", F.col("__base") + F.count(F.lit(1)).over(_before(["day", "__hour"], order)))
    return rows.withColumn("reserved", F.col("day_count") <= limit).drop("__hour", "__base")


def retry_after(limited: DataFrame, *, ts: str, per_minute: int = PER_MINUTE, per_hour: int = PER_HOUR) -> DataFrame:
    """Add retry_after: whole seconds until the last exceeded window ends, at least 1; null if allowed."""
    left = lambda start, size: F.lit(float(size)) - (F.col(ts).cast("timestamp").cast("double") - F.col(start).cast("timestamp").cast("double"))
    minute = F.when(F.col("minute_count") > per_minute, left("minute_start", 60))
    hour = F.when(F.col("hour_count") > per_hour, left("hour_start", 3600))
    return limited.withColumn("retry_after", F.when(~F.col("allowed"), F.greatest(F.lit(1), F.ceil(F.greatest(minute, hour)))).cast("long"))


def rate_buckets(requests: DataFrame, *, caller: str, ts: str) -> DataFrame:
    """Rows (caller, kind, bucket_start, request_count, expires_at) as they stand after all requests."""
    kinds = [F.struct(F.lit(k).alias("kind"), F.date_trunc(k, ts).cast("timestamp_ntz").alias("bucket_start")) for k in ("minute", "hour")]
    rows = requests.select(caller, F.explode(F.array(*kinds)).alias("b")).groupBy(caller, "b.kind", "b.bucket_start")
    return rows.agg(F.count(F.lit(1)).alias("request_count")).withColumn("expires_at", F.col("bucket_start") + F.expr("interval 24 hours"))


def unexpired(buckets: DataFrame, now: Column) -> DataFrame:
    return buckets.where(F.col("expires_at") > now)


def provider_health(events: DataFrame, *, provider: str, ts: str, order: list[str], ok: Column, failures: int = HEALTH_FAILURES, minutes: int = HEALTH_MINUTES, now: Column | None = None) -> DataFrame:
    """Add streak (failures since the last success) and degraded: a streak long and recent enough at ``now``, by
    default the event's own time. ``order`` begins with ``ts``.

    A streak is what the hours before leave, and what the hour adds. Hours are a row each, so no window holds a provider.
    """
    rows = events.withColumn("__hour", F.date_trunc("hour", ts)).withColumn("__ok", ok)
    local = _before([provider, "__hour"], order)
    rows = rows.withColumn("__island", F.sum(F.col("__ok").cast("int")).over(local))
    rows = rows.withColumn("__streak", F.sum((~F.col("__ok")).cast("long")).over(_before([provider, "__hour", "__island"], order)))
    left = F.max_by("__streak", F.struct(*order)).alias("__left")
    hours = rows.groupBy(provider, "__hour").agg(left, F.max((F.col("__island") > 0).cast("int")).alias("__some"))
    by_hour = Window.partitionBy(provider).orderBy("__hour")
    hours = hours.withColumn("__run", F.sum("__some").over(by_hour.rowsBetween(Window.unboundedPreceding, 0)))
    hours = hours.withColumn("__sum", F.sum("__left").over(Window.partitionBy(provider, "__run").orderBy("__hour").rowsBetween(Window.unboundedPreceding, 0)))
    hours = hours.withColumn("__base", F.coalesce(F.lag("__sum").over(by_hour), F.lit(0))).select(provider, "__hour", "__base")
    rows = _with_row_of(rows, hours, [provider, "__hour"])
    rows = rows.withColumn("streak", F.col("__streak") + F.when(F.col("__island") > 0, 0).otherwise(F.col("__base"))).drop("__hour", "__ok", "__island", "__streak", "__base")
    recent = F.lit(True) if now is None else F.col(ts) >= now - F.expr(f"interval {minutes} minutes")
    return rows.withColumn("degraded", (F.col("streak") >= failures) & recent)


_BYTE = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"{_BYTE}(?:\.{_BYTE}){{3}}"


def is_ip(address: Column) -> Column:
    """Whether a text is an address of either kind: four numbers up to 255, or eight groups of up to four hexadecimal
    digits, of which one run may be written ``::`` and the last two as four numbers."""
    plain = F.regexp_replace(address, r"%[^%/]+$", "")
    groups = F.regexp_replace(plain, rf"(^|:){IPV4}$", "$10:0")
    n = F.regexp_count(groups, F.lit(r"[0-9A-Fa-f]+"))
    shaped = groups.rlike(r"^(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?(?:::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?)?$")
    v6 = F.contains(plain, F.lit(":")) & shaped & F.when(F.contains(groups, F.lit("::")), n <= 7).otherwise(n == 8)
    return F.coalesce(address.rlike(f"^{IPV4}$") | v6, F.lit(False))


def client_ip(forwarded: Column, host: Column, hops: int) -> Column:
    """The address that the ``hops``-th trusted proxy from the right saw; the direct host without proxies, without so
    many entries, or if the entry is no address."""
    if hops <= 0:
        return host
    parts = F.transform(F.split(forwarded, ","), lambda x: F.trim(x))
    seen = F.when(F.size(parts) >= hops, F.element_at(parts, -hops))
    return F.coalesce(F.when(is_ip(seen), seen), host)


def embedding_batches(items: DataFrame, *, group: list[str], order: str, tokens: str, most: int = 1000, most_tokens: int = 320_000) -> DataFrame:
    """Add batch: consecutive items of a document go together until either cap would be passed; null for an item that
    is too large by itself, which is an error and closes no batch. An ordered fold over a document's items."""
    listed = items.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).cast("long").alias("t")))).alias("items"))
    start = F.struct(F.lit(1).alias("b"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("t"), F.from_json(F.lit("[]"), "array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        alone = x["t"] > most_tokens
        opens = (s["n"] >= most) | (s["t"] + x["t"] > most_tokens)
        b = F.when(opens, s["b"] + 1).otherwise(s["b"])
        return F.struct(
            F.when(alone, s["b"]).otherwise(b).alias("b"),
            F.when(alone, s["n"]).when(opens, F.lit(1)).otherwise(s["n"] + 1).alias("n"),
            F.when(alone, s["t"]).when(opens, x["t"]).otherwise(s["t"] + x["t"]).alias("t"),
            F.concat(s["out"], F.array(F.when(~alone, b))).alias("out"),
        )

    folded = listed.withColumn("batch", F.aggregate("items", start, step, lambda s: s["out"]))
    zipped = F.explode(F.arrays_zip("items", "batch")).alias("z")
    return folded.select(*group, zipped).select(*group, F.col("z.items.o").alias(order), F.col("z.items.t").alias(tokens), F.col("z.batch").alias("batch"))


def ingestion_budget(items: DataFrame, *, group: list[str], order: str, size: str, most: int = 5, most_size: int = 10_000) -> DataFrame:
    """Add accepted: an item takes of the day's budget if both caps allow it; one that is refused takes nothing, so a
    smaller one may still fit.

    ``order`` tells a group's items apart. What is left changes only when an item is accepted, so the next one accepted
    is the first after it that fits: ``most`` rounds of a minimum per group find them all, and no task holds a group.
    """
    rows = items.select(*group, F.col(order).alias("__o"), F.col(size).cast("long").alias("__t"))
    state = rows.groupBy(*group).agg(F.min(F.when(F.col("__t") <= most_size, F.struct("__o", "__t"))).alias("__next"))
    state = state.select(*group, F.array_compact(F.array("__next")).alias("__taken"))
    for _ in range(most - 1):
        last, used = F.element_at("__taken", -1)["__o"], F.aggregate("__taken", F.lit(0).cast("long"), lambda a, x: a + x["__t"])
        open_ = rows.join(state.where(F.size("__taken") > 0).select(*group, last.alias("__last"), used.alias("__used")), group)
        fits = (F.col("__o") > F.col("__last")) & (F.col("__used") + F.col("__t") <= most_size)
        found = open_.where(fits).groupBy(*group).agg(F.min(F.struct("__o", "__t")).alias("__next"))
        state = state.join(found, group, "left").select(*group, F.concat("__taken", F.array_compact(F.array("__next"))).alias("__taken"))
    done = items.select(*group, F.col(order), F.col(size).cast("long").alias(size)).join(state, group)
    return done.withColumn("accepted", F.exists("__taken", lambda x: x["__o"] == F.col(order))).drop("__taken")


def failure_class(status: Column, kind: Column) -> Column:
    """Of a failed call, by HTTP status and kind of exception. A billing error is told by its kind, whatever its status."""
    return (
        F.when(kind.contains("timeout"), "timeout")
        .when(status.isNotNull() & (kind == "billing_error"), "credit_exhausted")
        .when(status == 429, "rate_limited")
        .when(status.isin(401, 403), "auth")
        .when(status >= 500, "server_error")
        .otherwise("other")
    )


def stable_files(polls: DataFrame, *, path: str, poll: str, size: str, mtime: str) -> DataFrame:
    """Add stable: size and time are those of the poll before."""
    w = Window.partitionBy(path).orderBy(poll)
    same = (F.lag(size).over(w) == F.col(size)) & (F.lag(mtime).over(w) == F.col(mtime)) & (F.lag(poll).over(w) == F.col(poll) - 1)
    return polls.withColumn("stable", F.coalesce(same, F.lit(False)))


FINAL_STATES = ("imported", "failed", "duplicate", "conflict")


def deferred_until(ts: Column) -> Column:
    """The next day in Bucharest: when what ran out of budget may try again."""
    return F.date_add(F.to_date(F.from_utc_timestamp(ts, "Europe/Bucharest")), 1)


def to_process(files: DataFrame, state: DataFrame, *, key: str = "source_sha256", today: Column) -> DataFrame:
    """Files without a final state, and not deferred to a later day; an unreadable state (null) keeps a file back."""
    rows = files.join(state.select(key, "status", "not_before", F.lit(True).alias("__seen")), key, "left")
    held = F.col("__seen").isNotNull() & (F.col("status").isNull() | F.col("status").isin(*FINAL_STATES) | (F.col("not_before") > today))
    return rows.where(~held).drop("__seen", "status", "not_before")
