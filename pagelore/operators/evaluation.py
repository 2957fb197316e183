"""Evaluation rows of several arms to reports and verdicts.

Two medians occur: `median` averages the middle pair; the printed reports take the element at half the count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.functions.medians import middle, with_medians
from pagelore.functions.text import alphanumeric, collapsed

MARKER_WORDS, MARKER_BLOCK_WORDS = 12, 15
NAIVE_CHARS = 500
NOISE_CHARS = 50
QUERY_COST, PAGES_PER_QUERY, RIVAL_COST = 0.025, 8, 0.049
RATES_PER_GB = (8.50, 6.00, 4.00, 2.75, 1.75, 0.59)
LEAST_SUCCESS, COST_WIN, SUCCESS_WIN = 0.80, 1.5, 0.10
CONTEXT_TOKENS = 200_000


def markers(blocks: DataFrame, page: str = "page_id") -> DataFrame:
    """Page and marker, the first words of its longest block of enough words; the first of equals."""
    words = F.split(collapsed(F.col("text")), " ")
    long = blocks.where("kind <> 'heading'").withColumn("_words", words).where(F.size("_words") >= MARKER_BLOCK_WORDS)
    best = F.max_by(F.slice("_words", 1, MARKER_WORDS), F.struct(F.length("text"), -F.col("block_id")))
    return long.groupBy(page).agg(F.array_join(best, " ").alias("marker"))


def reach_rows(read: DataFrame, static: DataFrame, marks: DataFrame, page: str = "page_id") -> DataFrame:
    """Page, browser_chars, static_chars, browser_ok and static_ok, whether the static text holds the marker.

    read: page, text of the blocks; static: page, text.
    """
    a = read.select(page, F.length("text").cast("long").alias("browser_chars"))
    b = static.select(page, F.col("text").alias("_static"))
    joined = b.join(a, page, "left").join(marks, page, "left")
    mark = alphanumeric(F.col("marker"))
    holds = F.coalesce((mark != "") & F.contains(alphanumeric(F.col("_static")), mark), F.lit(False))
    return joined.select(page, F.coalesce("browser_chars", F.lit(0)).alias("browser_chars"), F.length("_static").cast("long").alias("static_chars"), F.col("marker").isNotNull().alias("browser_ok"), holds.alias("static_ok"))


def reach_report(rows: DataFrame) -> DataFrame:
    """Per category, and in total (category TOTAL): n, browser, static, gap, and the overhead ratios of pages that
    both arms read: upper median, least and largest."""
    both = F.col("browser_ok") & F.col("static_ok") & (F.col("browser_chars") > 0)
    ratio = F.when(both, F.col("static_chars") / F.col("browser_chars"))
    told = rows.select("browser_ok", "static_ok", ratio.alias("_ratio"), F.explode(F.array("category", F.lit("TOTAL"))).alias("category"))
    out = told.groupBy("category").agg(F.count("*").alias("n"), F.count_if("browser_ok").alias("browser"), F.count_if("static_ok").alias("static"), F.min("_ratio").alias("min_ratio"), F.max("_ratio").alias("max_ratio"))
    found = with_medians(out, told, ["category"], _m=F.col("_ratio"))
    return found.withColumns({"median_ratio": F.col("_m.upper"), "gap": F.col("browser") - F.col("static")}).drop("_m")


def silent_failures(rows: DataFrame) -> DataFrame:
    """Rows (expect_failure, static_status, static_chars, error_type, chars) with the naive gate, flagged, outcome."""
    naive = F.coalesce((F.col("static_status").try_cast("int") == 200) & (F.col("static_chars") > NAIVE_CHARS), F.lit(False))
    flagged = (F.coalesce("error_type", F.lit("")) != "") | (F.coalesce("chars", F.lit(0)) < NAIVE_CHARS)
    outcome = (
        F.when(~F.col("expect_failure"), F.when(F.col("flagged"), "false_positive").otherwise("true_negative"))
        .when(~F.col("naive_gate"), "self_reported")
        .when(F.col("flagged"), "true_positive")
        .otherwise("missed")
    )
    return rows.withColumns({"naive_gate": naive, "flagged": flagged}).withColumn("outcome", outcome)


OUTCOMES = ("true_positive", "missed", "self_reported", "false_positive", "true_negative")


def silent_failure_matrix(rows: DataFrame) -> DataFrame:
    """E5: outcomes by category."""
    return rows.groupBy("category").pivot("outcome", list(OUTCOMES)).count().fillna(0)


def silent_failure_split(rows: DataFrame) -> DataFrame:
    """E5: rows and flagged rows by category and by ground truth, as grouping sets."""
    return rows.groupingSets([["category"], ["expect_failure"]], "category", "expect_failure").agg(F.count("*").alias("n"), F.count_if("flagged").alias("n_flagged"))


def reveal_gain(before: DataFrame, after: DataFrame, page: str = "page_id") -> DataFrame:
    """Page, new_blocks and gain_chars: what after holds beyond before, repeated blocks counted each time."""
    new = after.join(before.select(page, "text").distinct(), [page, "text"], "left_anti").groupBy(page).agg(F.count("*").alias("new_blocks"))
    size = lambda df, name: df.groupBy(page).agg(F.sum(F.length("text")).alias(name))
    joined = size(after, "_after").join(size(before, "_before"), page, "full_outer").join(new, page, "left").fillna(0, ["_after", "_before", "new_blocks"])
    return joined.select(page, "new_blocks", (F.col("_after") - F.col("_before")).alias("gain_chars"))


def gained(rows: DataFrame) -> DataFrame:
    """Rows (gain_chars, new_blocks, control_gain_chars) with raw_gained, gained and hydrated."""
    raw = (F.col("gain_chars") > NOISE_CHARS) & (F.col("new_blocks") > 0)
    return rows.withColumn("raw_gained", raw).withColumn("gained", F.col("raw_gained") & (F.col("control_gain_chars") <= NOISE_CHARS)).withColumn("hydrated", F.col("raw_gained") & ~F.col("gained"))


def reveal_report(rows: DataFrame) -> DataFrame:
    """Per category n, gained, hydrated, false positives, upper medians of gained characters and milliseconds, and
    the ratio of mean costs over rows without an error. rows: see gained, with before_ms, after_ms, note, expected."""
    clean = F.coalesce("note", F.lit("")) == ""
    out = rows.groupBy("category").agg(
        F.count("*").alias("n"),
        F.count_if("gained").alias("n_gained"),
        F.count_if("hydrated").alias("n_hydrated"),
        F.count_if(F.col("gained") & ~F.col("expected")).alias("false_positives"),
        (F.avg(F.when(clean, F.col("after_ms"))) / F.avg(F.when(clean, F.col("before_ms")))).alias("cost_ratio"),
    )
    found = with_medians(out, rows, ["category"], _c=F.col("gain_chars"), _t=F.col("after_ms") - F.col("before_ms"))
    return found.withColumns({"median_chars": F.col("_c.upper"), "median_ms": F.col("_t.upper")}).drop("_c", "_t")


def page_weights(requests: DataFrame, pages: DataFrame, least_chars: int = NAIVE_CHARS) -> DataFrame:
    """Pages (page_id, arm, category, doc_status, page_error, chars) with bytes, requests, mb, status and reason.

    requests: page_id, arm, bytes.
    """
    sums = requests.groupBy("page_id", "arm").agg(F.sum("bytes").alias("bytes_total"), F.count("*").alias("request_count"))
    rows = pages.join(sums, ["page_id", "arm"], "left").fillna(0, ["bytes_total", "request_count"])
    error, code = F.coalesce("page_error", F.lit("")), F.coalesce("doc_status", F.lit(0))
    bad = (code != 0) & ~code.between(200, 399)
    status = F.when(error != "", "interstitial").when(bad | (F.col("chars") < least_chars), "failed").otherwise("loaded")
    reason = F.when(error != "", error).when(bad, F.concat(F.lit("http_"), code.cast("string"))).when(F.col("chars") < least_chars, F.concat(F.lit("stub_content_"), F.col("chars").cast("string"), F.lit("_chars"))).otherwise("")
    return rows.withColumns({"mb_total": F.round(F.col("bytes_total") / 1048576, 4), "status": status, "reason": reason})


def page_weight_report(rows: DataFrame) -> DataFrame:
    """Per category and arm n, loaded, excluded, mean and upper-median MB of loaded pages."""
    size = F.when(F.col("status") == "loaded", F.col("mb_total"))
    out = rows.groupBy("category", "arm").agg(F.count("*").alias("n"), F.count(size).alias("loaded"), F.count_if(F.col("status") != "loaded").alias("excluded"), F.coalesce(F.avg(size), F.lit(0.0)).alias("mean_mb"))
    return with_medians(out, rows, ["category", "arm"], _m=size).withColumn("median_mb", F.coalesce("_m.upper", F.lit(0.0))).drop("_m")


def exclusions(rows: DataFrame) -> DataFrame:
    """How many pages of each category and arm were left out for which reason."""
    return rows.where("status <> 'loaded'").groupBy("category", "arm", "reason").agg(F.count("*").alias("n"))


def query_costs(report: DataFrame, rates: tuple[float, ...] = RATES_PER_GB, mb: str = "mean_mb") -> DataFrame:
    """Cost of a query at each bandwidth rate, and whether it stays under the rival's."""
    listed = report.where("loaded > 0").withColumn("rate", F.explode(F.array(*map(F.lit, rates))))
    cost = F.lit(QUERY_COST) + F.col(mb) * PAGES_PER_QUERY / 1024 * F.col("rate")
    return listed.withColumn("cost", cost).select("category", "arm", "rate", "cost", (F.col("cost") < RIVAL_COST).alias("cheaper"))


def ratio_stats(counts: DataFrame, base: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Of every other arm against base over pages where both counts are known and not 0: n, median_of_ratios,
    ratio_of_medians, min, max, how many pages base loses, and which statistic flatters base less.

    counts: page, arm, tokens, and the columns of keys.
    """
    known = counts.where("tokens is not null and tokens <> 0")
    own = known.where(F.col("arm") == base).select(*keys, "page", F.col("tokens").alias("b"))
    pairs = known.where(F.col("arm") != base).join(own, [*keys, "page"]).withColumn("ratio", F.col("tokens") / F.col("b"))
    out = pairs.groupBy(*keys, "arm").agg(
        F.count("*").alias("n"), F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio"), F.count_if(F.col("tokens") <= F.col("b")).alias("n_lost")
    )
    found = with_medians(out, pairs, [*keys, "arm"], _r=F.col("ratio"), _o=F.col("tokens"), _b=F.col("b"))
    out = found.withColumns({"median_of_ratios": middle("_r"), "ratio_of_medians": middle("_o") / middle("_b")}).drop("_r", "_o", "_b")
    return out.withColumn("conservative", F.when(F.col("median_of_ratios") <= F.col("ratio_of_medians"), "median_of_ratios").otherwise("ratio_of_medians"))


def arm_summary(wide: DataFrame, arms: list[str], page: str = "page") -> DataFrame:
    """Per arm median, min, max, measured and total pages, from one column for each arm."""
    long = wide.unpivot([page], arms, "arm", "tokens")
    out = long.groupBy("arm").agg(F.min("tokens").alias("least"), F.max("tokens").alias("most"), F.count("tokens").alias("measured"), F.count("*").alias("total"))
    return with_medians(out, long, ["arm"], _m=F.col("tokens")).withColumn("median", middle("_m")).drop("_m")


def unmeasured(wide: DataFrame, arms: list[str], page: str = "page") -> DataFrame:
    """The cells without a count."""
    return wide.unpivot([page], arms, "arm", "tokens").where("tokens is null").select(page, "arm")


def mode_scores(bills: DataFrame, base_mode: str) -> DataFrame:
    """Per mode the median over scenarios of base / mode for cumulative and peak, the largest peak and whether it
    exceeds a context window. bills: scenario, mode, cumulative, peak."""
    base = bills.where(F.col("mode") == base_mode).select("scenario", F.col("cumulative").alias("_c"), F.col("peak").alias("_p"))
    joined = bills.join(base, "scenario").where("cumulative > 0 and peak > 0")
    out = joined.groupBy("mode").agg(F.count("*").alias("scenarios"), F.max("peak").alias("peak"))
    found = with_medians(out, joined, ["mode"], _x=F.col("_c") / F.col("cumulative"), _y=F.col("_p") / F.col("peak"))
    return found.withColumns({"cumulative_ratio": middle("_x"), "peak_ratio": middle("_y"), "too_large": F.col("peak") > CONTEXT_TOKENS}).drop("_x", "_y")


def payload_scores(payloads: DataFrame) -> DataFrame:
    """Per scenario and mode median and largest payload, turns sent as a delta, and deltas over the snapshot.

    payloads: scenario, mode, kind, length, snapshot_length.
    """
    delta = F.col("kind") == "delta"
    keys = ["scenario", "mode"]
    out = payloads.groupBy(keys).agg(F.max("length").alias("largest"), F.count_if(delta).alias("delta_turns"), F.count_if(delta & (F.col("length") > F.col("snapshot_length"))).alias("regressions"))
    return with_medians(out, payloads, keys, _m=F.col("length")).select(*keys, middle("_m").alias("median_payload"), "largest", "delta_turns", "regressions")


def task_rows(tasks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Tasks (arm, task_id, attempts) with success, sums, and turns of the first success or else of the last try, and
    the columns in keep.

    The cost is null if any attempt's is. A task without attempts has no success and sums of 0.
    """
    add = lambda field, kind: F.aggregate(F.transform("attempts", lambda a: a[field].cast(kind)), F.lit(0).cast(kind), lambda s, x: s + x)
    won = F.filter("attempts", lambda a: a["success"])
    return tasks.select(
        "arm",
        "task_id",
        F.exists("attempts", lambda a: a["success"]).alias("success"),
        F.size("attempts").cast("long").alias("attempts_used"),
        add("total_tokens", "bigint").alias("total_tokens"),
        add("llm_calls", "bigint").alias("llm_calls"),
        F.when(F.forall("attempts", lambda a: a["cost_usd"].isNotNull()), add("cost_usd", "double")).alias("total_cost_usd"),
        add("wall_seconds", "double").alias("total_wall_seconds"),
        F.coalesce(F.get(won, F.lit(0))["turns"], F.get("attempts", F.size("attempts") - 1)["turns"]).cast("long").alias("turns"),
        *keep,
    )


def verdict(tasks: DataFrame, arm: str, rival: str, overhead_per_call: float = 0.0) -> DataFrame:
    """One row: success rates, costs per success (less the overhead of each call), the verdict and the clause that
    decides it: cost, success or neither; null if inconclusive."""
    cost = F.col("total_cost_usd") - overhead_per_call * F.col("llm_calls")
    stats = tasks.groupBy("arm").agg(F.count("*").alias("n"), F.count_if("success").alias("wins"), F.count_if(F.col("success") & F.col("total_cost_usd").isNotNull()).alias("priced"), F.sum(cost).alias("cost"))
    of = lambda name, c: F.max(F.when(F.col("arm") == name, F.col(c)))
    one = stats.agg(*(of(name, c).alias(f"{c}_{k}") for k, name in (("a", arm), ("b", rival)) for c in ("n", "wins", "priced", "cost")))
    per = lambda k: F.when(F.col(f"priced_{k}") > 0, F.col(f"cost_{k}") / F.col(f"wins_{k}"))
    rate = lambda k: F.when(F.col(f"n_{k}") > 0, F.col(f"wins_{k}") / F.col(f"n_{k}"))
    rows = one.select(rate("a").alias("rate_a"), rate("b").alias("rate_b"), per("a").alias("cost_a"), per("b").alias("cost_b"))
    told, clause = _judged(*(F.col(c) for c in ("rate_a", "rate_b", "cost_a", "cost_b")))
    return rows.withColumns({"verdict": told, "clause": clause})


def _judged(rate_a: Column, rate_b: Column, cost_a: Column, cost_b: Column) -> tuple[Column, Column]:
    """The verdict and the clause that decides it."""
    cheaper = F.coalesce((cost_a > 0) & (rate_a >= LEAST_SUCCESS) & (rate_b >= LEAST_SUCCESS) & (cost_b / cost_a >= COST_WIN), F.lit(False))
    better = rate_a - rate_b >= SUCCESS_WIN
    unclear = rate_a.isNull() | rate_b.isNull() | ((rate_a < LEAST_SUCCESS) & (rate_b < LEAST_SUCCESS))
    clause = F.when(unclear, None).when(cheaper, "cost").when(better, "success").otherwise("neither")
    return F.when(unclear, "INCONCLUSIVE").when(cheaper | better, "WEDGE").otherwise("NO WEDGE"), clause


def never_started(tasks: DataFrame) -> DataFrame:
    """Arm, task_id and error of tasks that never took a turn, which is no loss: tasks (arm, task_id, attempts, and
    maybe harness_error) whose harness failed, or all of whose attempts, one at least, were aborted before a turn."""
    harness = F.when(F.col("harness_error") != "", F.col("harness_error")) if "harness_error" in tasks.columns else F.lit(None).cast("string")
    stuck = (F.size("attempts") > 0) & F.forall("attempts", lambda a: (F.coalesce(a["turns"], F.lit(0)) == 0) & (F.coalesce(a["aborted"], F.lit("")) != ""))
    error = F.coalesce(harness, F.when(stuck, F.get("attempts", F.size("attempts") - 1)["aborted"]))
    return tasks.select("arm", "task_id", error.alias("error")).where("error is not null")


def timed_out(tasks: DataFrame) -> DataFrame:
    """Arm and task_id of tasks that a watchdog ended. tasks: arm, task_id, timeout."""
    return tasks.where("timeout").select("arm", "task_id")


def verdict_report(tasks: DataFrame, arm: str, rival: str, overhead_per_call: float | None) -> DataFrame:
    """One row from one pass over the tasks: both arms' numbers of tasks, of tasks that never started and that timed
    out, success rates, costs per success as billed and without the overhead of each call, a verdict and clause for either,
    and the headline, the weaker of both.

    tasks: arm, task_id, attempts, success, total_cost_usd, llm_calls, and maybe harness_error and timeout. Tasks that
    never started or timed out count as losses, and are told apart. Without an overhead only the bill counts.
    """
    has = lambda c, kind: F.col(c) if c in tasks.columns else F.lit(None).cast(kind)
    stuck = (F.size("attempts") > 0) & F.forall("attempts", lambda a: (F.coalesce(a["turns"], F.lit(0)) == 0) & (F.coalesce(a["aborted"], F.lit("")) != ""))
    overhead = F.lit(overhead_per_call).cast("double")
    numbers = tasks.select(
        "arm", "success", F.coalesce(stuck | (F.coalesce(has("harness_error", "string"), F.lit("")) != ""), F.lit(False)).alias("unstarted"), F.coalesce(has("timeout", "boolean"), F.lit(False)).alias("late"),
        F.col("total_cost_usd").alias("billed"), (F.col("total_cost_usd") - overhead * F.col("llm_calls")).alias("content"),
    )
    sums = []
    for k, name in (("a", arm), ("b", rival)):
        own = F.col("arm") == name
        sums += [F.count_if(own).alias(f"n_{k}"), F.count_if(own & F.col("success")).alias(f"wins_{k}"), F.count_if(own & F.col("unstarted")).alias(f"never_started_{k}"), F.count_if(own & F.col("late")).alias(f"timed_out_{k}")]
        for cost in ("billed", "content"):
            sums += [F.sum(F.when(own, F.col(cost))).alias(f"{cost}_{k}"), F.count_if(own & F.col("success") & F.col(cost).isNotNull()).alias(f"priced_{cost}_{k}")]
    one = numbers.agg(*sums)
    one = one.withColumns({f"rate_{k}": F.when(F.col(f"n_{k}") > 0, F.col(f"wins_{k}") / F.col(f"n_{k}")) for k in "ab"})
    one = one.withColumns({f"{cost}_{k}": F.when(F.col(f"priced_{cost}_{k}") > 0, F.col(f"{cost}_{k}") / F.col(f"wins_{k}")) for cost in ("billed", "content") for k in "ab"})
    for cost in ("billed", "content"):
        told, clause = _judged(F.col("rate_a"), F.col("rate_b"), F.col(f"{cost}_a"), F.col(f"{cost}_b"))
        one = one.withColumns({f"{cost}_verdict": told, f"{cost}_clause": clause})
    both = F.col("billed_verdict") if overhead_per_call is None else headline(F.col("billed_verdict"), F.col("content_verdict"))
    names = ["n", "never_started", "timed_out", "rate", "billed", "content"]
    return one.select(*(f"{c}_{k}" for c in names for k in "ab"), *(f"{c}_{x}" for c in ("billed", "content") for x in ("verdict", "clause")), both.alias("headline"))


#: From the weakest: the headline is the weaker of two verdicts.
STRENGTH = ("INCONCLUSIVE", "NO WEDGE", "WEDGE")


def headline(a: Column, b: Column) -> Column:
    """The weaker of two verdicts."""
    rank = lambda v: F.array_position(F.array(*map(F.lit, STRENGTH)), v)
    return F.when(rank(a) <= rank(b), a).otherwise(b)


def round_robin(tasks: DataFrame, limit: int) -> DataFrame:
    """Limit tasks, taken from the categories in turn; categories go by their first task's place.

    tasks: task_id, category, place. A category that runs dry is skipped, which the order by (turn, category) is.
    """
    seen = tasks.groupBy(F.col("category").alias("_own")).agg(F.min("place").alias("_seen"))
    turn = F.row_number().over(Window.partitionBy("category").orderBy("place", "task_id"))
    first = tasks.withColumn("turn", turn).where(F.col("turn") <= limit)  # each task keeps so many of a category at most
    return first.join(seen, F.col("category").eqNullSafe(F.col("_own"))).orderBy("turn", "_seen", "category").limit(limit).drop("_own", "_seen")


def classifier_accuracy(runs: DataFrame) -> DataFrame:
    """Per fixture runs, correct, and false alarms where none was expected."""
    return runs.groupBy("fixture", "expected").agg(F.count("*").alias("runs"), F.count_if(F.col("observed") == F.col("expected")).alias("correct"), F.count_if((F.col("expected") == "none") & (F.col("observed") != "none")).alias("false_positives"))


def signal_failed(name: Column, value: Column, cls: Column) -> Column:
    """Whether a probe's row says that automation was noticed."""
    cls, low = F.lower(F.coalesce(cls, F.lit(""))), F.lower(F.coalesce(value, F.lit("")))
    told = F.contains(low, F.lit("headless")) | ((low == "true") & F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit("webdriver")))
    return F.when(F.contains(cls, F.lit("failed")), True).when(F.contains(cls, F.lit("passed")) | F.contains(cls, F.lit("succeed")), False).otherwise(told)


def compare_signals(before: DataFrame, after: DataFrame) -> DataFrame:
    """Name, both values (MISSING where a run lacks it) and both fail flags."""
    side = lambda df, k: df.select("name", F.col("value").alias(f"value_{k}"), signal_failed(F.col("name"), F.col("value"), F.col("cls")).alias(f"failed_{k}"))
    joined = side(before, "before").join(side(after, "after"), "name", "full_outer")
    fill = {f"value_{k}": F.coalesce(f"value_{k}", F.lit("MISSING")) for k in ("before", "after")} | {f"failed_{k}": F.coalesce(f"failed_{k}", F.lit(False)) for k in ("before", "after")}
    return joined.withColumns(fill)


def usable_signals(rows: DataFrame, least: int = 20, sentinels: tuple[str, ...] = ("WebDriver", "User Agent")) -> DataFrame:
    """One row: n, and usable, whether a run has enough rows and its sentinel rows."""
    seen = [F.bool_or(F.contains("name", F.lit(s))) for s in sentinels]
    return rows.agg(F.count("*").alias("n"), F.coalesce(seen[0] & seen[1], F.lit(False)).alias("_seen")).select("n", ((F.col("n") >= least) & F.col("_seen")).alias("usable"))


#: What a probe prints when a check fails, and the text below which it did not load.
TELLS = r"(?i)\b(failed|present \(failed\)|missing \(failed\)|detected|automation|headlesschrome|webdriver)\b"
TELL_CHARS = 400


def tells(df: DataFrame, text: str = "text") -> DataFrame:
    """Df with n_tells and usable."""
    return df.withColumns({"n_tells": F.regexp_count(text, F.lit(TELLS)).cast("long"), "usable": F.length(text) >= TELL_CHARS})


def timings(samples: DataFrame) -> DataFrame:
    """Per label median, min, max and n of value."""
    out = samples.groupBy("label").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"))
    return with_medians(out, samples, ["label"], _m=F.col("value")).withColumn("median", middle("_m")).drop("_m")
