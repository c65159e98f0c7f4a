"""Operations reporting: latest rows, cache state, usage, quotas, feedback, history, subscriptions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed, schemas
from ..functions.columns import round_half_up
from ..session import land, remove


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key by partial aggregation, so a hot key costs one row per task."""
    others = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*order)).alias("r")
    return rows.groupBy(*keys).agg(newest).select(*keys, "r.*")


def cache_status(
    analyses: DataFrame, heads: DataFrame, requests: DataFrame, as_of: Column, version: int, ttl_hours: int = 24,
) -> DataFrame:
    """hit / stale / miss for each requested (repo_url, user_id); anonymous users are null and match null."""
    fresh = analyses.filter(
        (F.col("analysis_version") == version) & (F.col("created_at") >= as_of - F.make_dt_interval(hours=F.lit(ttl_hours))))
    newest = latest_per_key(fresh.select("repo_url", "user_id", "commit_sha", "created_at", "id"),
                            ["repo_url", "user_id"], ["created_at", "id"])
    r, n = requests.alias("r"), newest.alias("n")
    found = F.col("n.commit_sha").isNotNull()
    stale = found & F.coalesce(F.col("h.live_sha") != F.col("n.commit_sha"), F.lit(False))
    return (
        r.join(n, (F.col("r.repo_url") == F.col("n.repo_url")) & F.col("r.user_id").eqNullSafe(F.col("n.user_id")), "left")
        .join(heads.alias("h"), F.col("r.repo_url") == F.col("h.repo_url"), "left")
        .select(
            F.col("r.repo_url"), F.col("r.user_id"), (found & ~stale).alias("hit"), stale.alias("stale"),
            F.col("n.commit_sha").alias("stored_sha"), F.when(found, F.col("h.live_sha")).alias("live_sha"),
            F.col("n.created_at").alias("cached_at"))
    )


def invalidate_cache(analyses: DataFrame, keys: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, deleted count per key); ``by`` is [repo_url] or [repo_url, user_id]."""
    wanted = keys.select(*by).distinct()
    gone = analyses.join(wanted, by, "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias("deleted"))
    deleted = wanted.join(gone, by, "left").withColumn("deleted", F.coalesce("deleted", F.lit(0)))
    return analyses.join(wanted, by, "left_anti"), deleted


def rewrite_without(spark: SparkSession, path: str, keys: DataFrame, by: list[str], partition: str = "analysis_version") -> None:
    """Delete the keys from the table at ``path``: only partitions that hold one are written anew.

    What remains of these is written aside first and then replaces them; partitions of which nothing remains go.
    """
    table = spark.read.parquet(path)
    concerned = [r[0] for r in table.join(keys.select(*by).distinct(), by, "left_semi").select(partition).distinct().collect()]
    if not concerned:
        return
    part = table.filter(F.col(partition).isin(concerned))
    aside = land(invalidate_cache(part, keys, by)[0], "remaining")
    remaining = spark.read.schema(table.schema).parquet(aside)
    left = {r[0] for r in remaining.select(partition).distinct().collect()}
    (remaining.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path))
    for value in concerned:
        if value not in left:
            remove(spark, f"{path}/{partition}={value}")
    remove(spark, aside)


def group_by_repo(analyses: DataFrame) -> DataFrame:
    """One row per repository address: latest and oldest time, latest commit, number of analyses."""
    first = F.struct("created_at", "id")
    return analyses.groupBy("repo_url").agg(
        F.min_by("repo_name", first).alias("repo_name"),
        F.max_by("commit_sha", F.struct("created_at", "id")).alias("latest_commit_sha"),
        F.max("created_at").alias("latest_created_at"), F.min("created_at").alias("oldest_created_at"),
        F.count(F.lit(1)).alias("analysis_count"),
    )


def sorted_groups(groups: DataFrame, sort_key: str = "latest-desc") -> DataFrame:
    column = {"latest": "latest_created_at", "count": "analysis_count"}[sort_key.split("-")[0]]
    return groups.orderBy(F.desc(column) if sort_key.endswith("desc") else F.asc(column), "repo_url")


def feedback_rate(feedback: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    return feedback.agg(
        F.when(total == 0, F.lit(0)).otherwise(
            round_half_up(F.count_if("is_helpful") / total * 100)).cast("int").alias("success_rate"),
        total.alias("total_scans"))


def usage_class(kind: Column) -> Column:
    """Repository and pull-request analyses share one daily quota."""
    return F.when(kind.isin("repo", "pr"), "scan").otherwise(kind)


def daily_usage(usage: DataFrame) -> DataFrame:
    return usage.groupBy(
        "user_id", F.to_date("ts").alias("day"), usage_class(F.col("kind")).alias("kind")
    ).agg(F.count(F.lit(1)).alias("n"))


def plan_limits(usage: DataFrame, profiles: DataFrame) -> DataFrame:
    """(user_id, plan_tier, scan_limit, used): every profile with its plan's limit; users without usage have used 0."""
    free, pro = fixed.LIMITS["scan"]
    used = usage.groupBy("user_id").agg(F.count(F.lit(1)).alias("used"))
    return profiles.join(used, "user_id", "left").select(
        "user_id", "plan_tier", F.when(F.col("plan_tier") == "pro", pro).otherwise(free).alias("scan_limit"),
        F.coalesce("used", F.lit(0)).alias("used"))


def quota_check(usage: DataFrame, profiles: DataFrame, as_of: Column) -> DataFrame:
    """Per user and kind: allowed, used, limit, remaining on the UTC day of ``as_of``; assistant use counts for all time."""
    kind = usage_class(F.col("kind"))
    today = F.col("ts") >= F.date_trunc("DAY", as_of)
    used = (
        usage.filter((kind == "ai") | today).groupBy("user_id", kind.alias("kind"))
        .agg(F.count(F.lit(1)).alias("used"))
    )
    limits = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(free).alias("free"), F.lit(pro).alias("pro"))
        for k, (free, pro) in fixed.LIMITS.items()])
    limit = F.when(F.col("kind") == "debug", F.when(F.col("is_admin") | (F.col("plan_tier") == "pro"), F.col("pro")).otherwise(F.col("free"))) \
        .otherwise(F.when(F.col("plan_tier") == "pro", F.col("pro")).otherwise(F.col("free")))
    n = F.when(F.col("is_admin"), F.lit(0)).otherwise(F.coalesce("used", F.lit(0)))
    return (
        profiles.select("user_id", "plan_tier", "is_admin", F.inline(limits))
        .join(used, ["user_id", "kind"], "left")
        .select("user_id", "kind", n.alias("used"), limit.cast("bigint").alias("limit"), "is_admin")
        .select("user_id", "kind", (F.col("is_admin") | (F.col("used") < F.col("limit"))).alias("allowed"), "used", "limit",
                F.greatest(F.lit(0), F.col("limit") - F.col("used")).alias("remaining"))
    )


def history_timeline(repo_scans: DataFrame, pr_scans: DataFrame) -> DataFrame:
    """Repository and pull-request analyses as one timeline, newest first when ordered by created_at."""
    repos = repo_scans.select(
        F.concat(F.lit("repo-"), "id").alias("id"), F.lit("repo").alias("type"), F.col("repo_name").alias("title"),
        F.lit("Full Codebase Scan").alias("subtitle"), "created_at")
    prs = pr_scans.select(
        F.concat(F.lit("pr-"), "id").alias("id"), F.lit("pr").alias("type"),
        F.concat("repo_name", F.lit(" #"), "pr_number").alias("title"), F.col("title").alias("subtitle"), "created_at")
    return repos.unionByName(prs)


def recent_history(analyses: DataFrame, as_of: Column, search: str = "", limit: int | None = None) -> DataFrame:
    """The name search over each user's analyses, or over the latest ``limit``, with their rank by time and age in words."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp("created_at")
    words = (
        F.when(age < 60, "just now").when(age < 3600, F.concat(F.floor(age / 60), F.lit("m ago")))
        .when(age < 86400, F.concat(F.floor(age / 3600), F.lit("h ago")))
        .otherwise(F.concat(F.floor(age / 86400), F.lit("d ago"))))
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return (
        analyses.select("user_id", "id", "repo_url", "repo_name", "created_at")
        .withColumn("rn", F.row_number().over(newest)).filter(F.lit(True) if limit is None else F.col("rn") <= limit)
        .filter(F.lower("repo_name").contains(search.lower())).withColumn("age", words)
    )


def sliding_window_quota(events: DataFrame, key: str, n: int, span_seconds: int, slices: int = 60) -> DataFrame:
    """Events with the number of events of the same key in the span ending at them, and whether that exceeds ``n``.

    The time line is cut into slices, so the sorting of a hot key is split over them. An event counts from its own
    time on and leaves one span later, so every event stands twice, as a coming and as a leaving, each in the slice of
    its own time. The count at an event is exact for any span: the comings less the leavings of all slices before, and
    those of its own slice up to it.
    """
    span = span_seconds * 1_000_000
    width = max(1, span // slices)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    coming = events.select("*", micros.alias("pos"), F.lit(1).alias("own"))
    leaving = coming.withColumns({"pos": F.col("pos") + span, "own": F.lit(0)})
    both = coming.unionByName(leaving).withColumn("slice", F.floor(F.col("pos") / width))
    order = Window.partitionBy(key, "slice").orderBy("pos")
    upto, before = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(Window.unboundedPreceding, -1)
    # one row per slice that has an event: what is inside when the slice begins
    net = both.groupBy(key, "slice").agg(F.sum(2 * F.col("own") - 1).alias("net"))
    inside = net.withColumn("inside", F.coalesce(
        F.sum("net").over(Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("net")
    return (
        both.withColumns({"own_upto": F.sum("own").over(upto), "left": F.coalesce(F.sum(1 - F.col("own")).over(before), F.lit(0))})
        .filter(F.col("own") == 1)
        .join(inside, [key, "slice"])
        .withColumn("n_in_window", F.col("inside") + F.col("own_upto") - F.col("left"))
        .withColumn("exceeded", F.col("n_in_window") > n)
        .select(*events.columns, "n_in_window", "exceeded")
    )


def unseen_events(events: DataFrame, seen: DataFrame) -> DataFrame:
    """Of every event id not seen before, the earliest row; ties go by the other columns in order."""
    others = [c for c in events.columns if c not in ("event_id", "ts")]
    first = events.groupBy("event_id").agg(F.min(F.struct("ts", *others)).alias("e"))
    return first.join(seen.select("event_id"), "event_id", "left_anti").select(
        *[F.col("event_id") if c == "event_id" else F.col(f"e.{c}").alias(c) for c in events.columns])


# --- subscriptions -----------------------------------------------------------------

def profile_update(events: DataFrame) -> DataFrame:
    """Map subscription events to the profile change they cause; others are dropped."""
    event, status = F.col("event"), F.col("status")
    state = (
        F.when(event == "subscription.activated", "active")
        .when((event == "subscription.updated") & (status == "active"), "active")
        .when((event == "subscription.updated") & status.isin(fixed.SUBSCRIPTION_INACTIVE), status)
        .when(event == "subscription.cancelled", "cancelled").when(event == "subscription.halted", "halted")
        .when(event == "subscription.completed", "completed"))
    return (
        events.filter(F.col("event_id").isNotNull() & F.col("user_id").isNotNull())
        .withColumn("subscription_status", state).filter(F.col("subscription_status").isNotNull())
        .withColumn("plan_tier", F.when(F.col("subscription_status") == "active", "pro").otherwise("free"))
    )


def profile_update_simple(events: DataFrame) -> DataFrame:
    """The second provider's map: created → pro, updated → pro only while active, cancelled → free."""
    event, status = F.col("event"), F.col("status")
    state = (
        F.when(event == "subscription_created", "active").when(event == "subscription_updated", status)
        .when(event == "subscription_cancelled", "cancelled"))
    return (
        events.filter(F.col("user_id").isNotNull()).withColumn("subscription_status", state)
        .filter(F.col("subscription_status").isNotNull())
        .withColumn("plan_tier", F.when(F.col("subscription_status") == "active", "pro").otherwise("free"))
    )


def profile_state(updates: DataFrame) -> DataFrame:
    """Current tier and status per user: that of the latest update."""
    last = F.max_by(F.struct("plan_tier", "subscription_status", "ts"), F.struct("ts", "event_id")).alias("s")
    return updates.groupBy("user_id").agg(last).select(
        "user_id", "s.plan_tier", "s.subscription_status", F.col("s.ts").alias("changed_at"))


def live_subscription(subscriptions: DataFrame, as_of: Column) -> DataFrame:
    """The newest subscription in a live status per user; one left in ``created`` for over a day is abandoned."""
    newest = latest_per_key(
        subscriptions.filter(F.col("status").isin(fixed.SUBSCRIPTION_LIVE)).select(
            "user_id", "subscription_id", "status", "created_at"),
        ["user_id"], ["created_at", "subscription_id"])
    old = F.col("created_at") < as_of - F.expr("INTERVAL 24 HOURS")
    return newest.withColumn("is_abandoned", (F.col("status") == "created") & old)


# --- documents -----------------------------------------------------------------------

def analysis_schema_check(analyses: DataFrame) -> DataFrame:
    """(id, valid, reason) of each stored result document against the result schema."""
    doc = F.from_json("result_json", schemas.RESULT_DOCUMENT, {"columnNameOfCorruptRecord": "_corrupt"})
    d = F.col("d")

    def missing(column: str) -> Column:
        return d[column].isNull()

    def broken_item(array: Column, fields: list[str]) -> Column:
        return F.exists(array, lambda x: reduce_or([x[f].isNull() for f in fields]))

    def reduce_or(rules: list[Column]) -> Column:
        out = rules[0]
        for r in rules[1:]:
            out = out | r
        return out

    a = d["analysis"]
    text_fields = ["owner", "repo", "description", "language", "mermaidDiagram"]
    rules = [(d["_corrupt"].isNotNull() | d.isNull(), "not a document of the expected types")]
    rules += [(missing(c), f"missing {c}") for c in [*text_fields, "stars", "totalFiles", "entryPoints", "analysis", "fileMetrics"]]
    rules += [(a[c].isNull(), f"missing analysis.{c}") for c in (
        "architecture_pattern", "what_it_does", "execution_flow", "tech_stack", "key_modules", "onboarding_guide", "blast_radius")]
    rules += [
        (broken_item(d["fileMetrics"], ["path", "size"]), "incomplete fileMetrics"),
        (broken_item(a["tech_stack"], ["name", "purpose"]), "incomplete tech_stack"),
        (broken_item(a["key_modules"], ["file", "role", "why_it_exists"]), "incomplete key_modules"),
        (broken_item(a["blast_radius"], ["file", "dependents", "warning", "safe_refactor_steps"]), "incomplete blast_radius"),
        (a["health_status"].isNotNull() & ~F.coalesce(a["health_status"]["grade"].isin("A", "B", "C", "D", "F"), F.lit(False)),
         "grade is not one of A, B, C, D, F"),
        (a["health_status"].isNotNull() & reduce_or([a["health_status"][f].isNull() for f in ("score", "status", "refactor_plan")]),
         "incomplete health_status"),
    ]
    reason = F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1])
    for rule, text in rules[1:]:
        reason = reason.when(F.coalesce(rule, F.lit(False)), text)
    return analyses.withColumn("d", doc).select("id", reason.isNull().alias("valid"), reason.alias("reason"))


def conversation_assemble(turns: DataFrame) -> DataFrame:
    """Messages in the request form, one row per turn: order by conv_id, turn."""
    return turns.select("conv_id", "turn", F.when(F.col("role") == "ai", "assistant").otherwise("user").alias("role"),
                        F.col("text").alias("content"))
