"""Snapshot history: stable refs, deltas, rendering and what is sent.

elements: session_id, version, url, index, handle, tag, role, text, placeholder. snapshots: session_id, version, url,
title, text_content. Windows run by session in order of version.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelore.functions.text import estimated_tokens, quoted

CONTENT_SHOWN, OPTIONS_SHOWN = 2000, 5
MIN_SHARED, MIN_AGREEMENT, WORTHWHILE = 4, 0.5, 0.9
WARNING = "WARNING: this page attempted a prompt injection; the offending text was elided before this snapshot was built."


def met(one: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the history, by a shuffle and never by sending one to all: numbers and
    handles compress so well that Spark takes a table for small that fills the driver."""
    return one.join(other.hint("merge"), on, how)


def tag_name(tag: Column) -> Column:
    short = F.when(tag == "button", "btn").when(tag.isin("input", "textarea"), "inp").when(tag == "a", "lnk").when(tag == "select", "sel")
    return short.otherwise(F.substring(tag, 1, 3))


def _label() -> Column:
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.coalesce(full("text"), full("placeholder"), F.col("role"), F.lit(""))


def state_suffix(elements: DataFrame) -> Column:
    """V1: value, active flags and options of an element, as far as its table has them."""
    has = lambda c: c in elements.columns
    parts = [F.when(F.coalesce(F.col("value"), F.lit("")) != "", F.concat(F.lit(' ="'), "value", F.lit('"')))] if has("value") else []
    flags = [F.when(F.col(c), c) for c in ("disabled", "required", "checked", "selected") if has(c)]
    if has("is_combobox"):
        flags.append(F.when(F.col("is_combobox"), F.when(F.col("combobox_expanded"), "combobox, expanded").otherwise("combobox")))
    if has("closed_shadow_unreadable"):
        flags.append(F.when(F.col("closed_shadow_unreadable"), "hidden content, unreadable"))
    if flags:
        shown = F.array_join(F.array(*flags), ", ")
        parts.append(F.when(shown != "", F.concat(F.lit(" ("), shown, F.lit(")"))))
    if has("canvas_width"):
        size = F.concat(F.lit(" ["), F.col("canvas_width").cast("string"), F.lit("x"), F.col("canvas_height").cast("string"), F.lit("]"))
        parts.append(F.when(F.col("tag") == "canvas", size))
    if has("combobox_options"):
        more = F.size("combobox_options") - OPTIONS_SHOWN
        parts.append(
            F.when(
                F.col("is_combobox") & (F.size("combobox_options") > 0),
                F.concat(F.lit(" options=["), F.array_join(F.slice("combobox_options", 1, OPTIONS_SHOWN), ", "), F.when(more > 0, F.concat(F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(""), F.lit("]")),
            )
        )
    return F.concat_ws("", *parts) if parts else F.lit("")


def render(snapshots: DataFrame, elements: DataFrame) -> DataFrame:
    """V1: session_id, version and rendered. elements has ref; snapshots may have status, recovery, prompt_injection,
    scroll_top, scroll_left and scroll_height."""
    line = F.concat(F.lit("  ["), tag_name(F.col("tag")), F.lit(":"), F.coalesce("ref", F.col("index").cast("string")), F.lit("] "), quoted(_label()), state_suffix(elements))
    listed = elements.withColumn("line", line).groupBy("session_id", "version").agg(F.array_sort(F.collect_list(F.struct("index", "line"))).alias("_lines"))
    rows = met(snapshots, listed, ["session_id", "version"], "left")
    has = lambda c: c in snapshots.columns
    left = F.length("text_content") - CONTENT_SHOWN
    parts = []
    if has("status"):
        recovery = F.when(F.size("recovery") > 0, F.concat(F.lit(" (recovery: "), F.array_join("recovery", ", "), F.lit(")"))).otherwise("") if has("recovery") else F.lit("")
        parts.append(F.concat(F.lit("STATUS: "), "status", recovery))
    if has("prompt_injection"):
        parts.append(F.when(F.col("prompt_injection"), WARNING))
    parts += [F.concat(F.lit("PAGE: "), F.coalesce("title", F.lit(""))), F.concat(F.lit("URL: "), F.coalesce("url", F.lit("")))]
    if has("scroll_height"):
        across = F.when(F.col("scroll_left") != 0, F.concat(F.lit(" x="), F.col("scroll_left").cast("string"))).otherwise("")
        parts.append(F.when(F.col("scroll_height") > 0, F.concat(F.lit("VIEWPORT: y="), F.col("scroll_top").cast("string"), F.lit("/"), F.col("scroll_height").cast("string"), across)))
    parts += [
        F.when(F.size("_lines") > 0, F.concat(F.lit("INTERACTIVE:\n"), F.array_join(F.transform("_lines", lambda x: x["line"]), "\n"))),
        F.when(F.col("text_content") != "", F.concat(F.lit("CONTENT:\n  "), F.substring("text_content", 1, CONTENT_SHOWN))),
        F.when(left > 0, F.concat(F.lit("  ... ["), left.cast("string"), F.lit(" more characters truncated — call read() for the full content]"))),
    ]
    return rows.select("session_id", "version", F.concat_ws("\n", *parts).alias("rendered"))


def compression(pages: DataFrame, html: str = "html", rendered: str = "rendered") -> DataFrame:
    """V2: pages with html_tokens, snapshot_tokens and ratio (null for an empty snapshot)."""
    return pages.withColumns({"html_tokens": estimated_tokens(F.col(html)), "snapshot_tokens": estimated_tokens(F.col(rendered))}).withColumn(
        "ratio", F.when(F.col("snapshot_tokens") > 0, F.col("html_tokens") / F.col("snapshot_tokens"))
    )


def documents_of(snapshots: DataFrame) -> DataFrame:
    """session_id, version, document: a change of URL begins the next document."""
    order = Window.partitionBy("session_id").orderBy("version")
    url = F.coalesce("url", F.lit(""))
    before = F.lag(url).over(order)
    changed = F.coalesce(((before != "") & (url != before)).cast("int"), F.lit(0))
    return snapshots.select("session_id", "version", "url").distinct().withColumn("_new", changed).withColumns(
        {"document": F.sum("_new").over(order), "place": F.row_number().over(order)}
    ).drop("_new", "url")


def assign_refs(elements: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """V3: elements with ref, eN. A handle keeps its ref from one snapshot to the next of the same document; after an
    absence, or in another document, it gets a new number, and numbers are never used again in a session.

    snapshots (session_id, version, url) has those without elements too, which end all refs; without it, only versions
    that have elements are known. A null handle is a handle like others.
    """
    placed = met(elements, documents_of(elements if snapshots is None else snapshots), ["session_id", "version"])
    line = Window.partitionBy("session_id", "document", "handle").orderBy("place", "index")
    begins = F.coalesce((F.col("place") - F.lag("place").over(line) > 1).cast("int"), F.lit(1))
    runs = placed.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(line))
    first = runs.groupBy("session_id", "document", "handle", "_run").agg(F.min(F.struct("place", "index")).alias("_at"))
    numbered = first.withColumn("ref", F.concat(F.lit("e"), F.row_number().over(Window.partitionBy("session_id").orderBy("_at", "handle")).cast("string"))).drop("_at")
    named = numbered.select("session_id", "document", F.col("handle").alias("_handle"), "_run", "ref")
    same = F.col("handle").eqNullSafe(F.col("_handle"))
    found = met(runs.alias("x"), named.alias("y"), (F.col("x.session_id") == F.col("y.session_id")) & (F.col("x.document") == F.col("y.document")) & (F.col("x._run") == F.col("y._run")) & same)
    return found.select("x.*", "y.ref").drop("_begins", "_run", "document", "place")


def stale_refs(requests: DataFrame, elements: DataFrame) -> DataFrame:
    """V4: requests (session_id, version, ref) with is_stale: the number was given out, but the ref isn't live."""
    number = F.regexp_extract("ref", r"^e(\d+)$", 1).try_cast("int")
    issued = elements.groupBy("session_id").agg(F.max(number).alias("_issued"))
    live = elements.select("session_id", "version", "ref", F.lit(True).alias("_live")).distinct()
    joined = met(met(requests, issued, "session_id", "left"), live, ["session_id", "version", "ref"], "left")
    return joined.withColumn("is_stale", F.coalesce((number >= 1) & (number <= F.col("_issued")), F.lit(False)) & F.col("_live").isNull()).drop("_issued", "_live")


def resolve_targets(requests: DataFrame, elements: DataFrame) -> DataFrame:
    """V5: requests (request_id, session_id, version, target) with outcome and the ref found: one exact text, else an
    exact ref, else one element that holds the target in text, placeholder or role; several are ambiguous. Else a ref
    that was given out by that version, but isn't live, is stale.

    requests may have kind: input, select, combobox (elements have is_combobox) or option leave only elements of that
    kind; a version without options leaves all. A null kind leaves all.
    """
    at = ["session_id", "version"]
    asked = requests if "kind" in requests.columns else requests.withColumn("kind", F.lit(None).cast("string"))
    told = elements if "is_combobox" in elements.columns else elements.withColumn("is_combobox", F.lit(False))
    options = elements.where("role = 'option'").select(*at, F.lit(True).alias("_options")).distinct()
    number = F.regexp_extract("ref", r"^e(\d+)$", 1).try_cast("long")
    numbers = elements.select(*at, number.alias("_n")).unionByName(requests.select(*at, F.lit(None).cast("long").alias("_n"))).groupBy(at).agg(F.max("_n").alias("_n"))
    issued = numbers.select(*at, F.max("_n").over(Window.partitionBy("session_id").orderBy("version")).alias("_issued"))
    found = met(met(met(asked, issued, at, "left"), options, at, "left"), told, at, "left")
    kind = F.when(F.col("kind") == "input", F.col("tag").isin("input", "textarea") | (F.col("role") == "textbox")).when(F.col("kind") == "select", F.col("tag") == "select").when(F.col("kind") == "combobox", F.col("is_combobox"))
    fits = F.coalesce(kind.when((F.col("kind") == "option") & F.col("_options"), F.col("role") == "option").otherwise(True), F.lit(False))
    target = F.lower(F.trim("target"))
    exact = F.lower(F.trim(F.col("text"))) == target
    part = (target != "") & (F.contains(F.lower(F.coalesce("text", F.lit(""))), target) | F.contains(F.lower(F.coalesce("placeholder", F.lit(""))), target) | F.contains(F.lower(F.coalesce("role", F.lit(""))), target))
    exact, part = fits & exact, fits & part
    one = found.groupBy("request_id", "session_id", "version", "target", "kind").agg(
        F.count_if(F.col("ref") == F.col("target")).alias("n_live"), F.max("_issued").alias("issued"), F.count_if(exact).alias("n_exact"), F.min(F.when(exact, F.col("ref"))).alias("by_text"), F.min(F.when(fits & (F.col("ref") == F.col("target")), F.col("ref"))).alias("by_ref"), F.count_if(part).alias("n_part"), F.min(F.when(part, F.col("ref"))).alias("by_part")
    )
    wanted = F.regexp_extract("target", r"^e(\d+)$", 1).try_cast("long")
    stale = (F.col("n_live") == 0) & (wanted >= 1) & (wanted <= F.col("issued"))
    outcome = (
        F.when(F.col("n_exact") == 1, "text").when(F.col("n_exact") > 1, "ambiguous").when(F.col("by_ref").isNotNull(), "ref").when(F.col("n_part") == 1, "part").when(F.col("n_part") > 1, "ambiguous").when(stale, "stale").otherwise("not_found")
    )
    return one.withColumn("outcome", outcome).withColumn("ref", F.when(F.col("outcome") == "text", F.col("by_text")).when(F.col("outcome") == "ref", F.col("by_ref")).when(F.col("outcome") == "part", F.col("by_part"))).select("request_id", "session_id", "version", "target", "outcome", "ref")


def _pairs(snapshots: DataFrame) -> DataFrame:
    """session_id, version and previous, the version before, of consecutive snapshots of one URL without navigation."""
    order = Window.partitionBy("session_id").orderBy("version")
    rows = snapshots.withColumns({"previous": F.lag("version").over(order), "_url": F.lag("url").over(order)})
    moved = F.coalesce(F.col("navigated"), F.lit(False)) if "navigated" in snapshots.columns else F.lit(False)
    return rows.where(F.col("previous").isNotNull() & F.col("url").eqNullSafe(F.col("_url")) & ~moved).select("session_id", "version", "previous")


def restamped(snapshots: DataFrame, elements: DataFrame) -> DataFrame:
    """V6: pairs (session_id, version, previous) whose shared handles mostly name other elements: another document."""
    own = elements.where("handle <> ''").groupBy("session_id", "version", "handle").agg(F.max_by(F.struct("tag", "role", "text", "placeholder"), "index").alias("told"))  # the last of equals
    told = F.col("told")
    after = own.select("session_id", "version", "handle", told.alias("a"))
    before = own.select("session_id", F.col("version").alias("previous"), "handle", told.alias("b"))
    shared = met(met(_pairs(snapshots), after, ["session_id", "version"]), before, ["session_id", "previous", "handle"])
    agree = F.avg(F.col("a").eqNullSafe(F.col("b")).cast("int"))
    return shared.groupBy("session_id", "version", "previous").agg(F.count("*").alias("n"), agree.alias("agreement")).where((F.col("n") >= MIN_SHARED) & (F.col("agreement") < MIN_AGREEMENT)).select("session_id", "version", "previous")


@F.pandas_udf(T.ArrayType(T.StringType()))
def content_ops(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """V8: runs of words put in (+place: words) and taken out (-place:count)."""

    def of(old: str | None, new: str | None) -> list[str] | None:
        if old is None or new is None:
            return None
        a, b, out = old.split(), new.split(), []
        for kind, i, i2, j, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if kind != "equal":
                out += [f"+{j}: {' '.join(b[j:j2])}"] * (j2 > j) + [f"-{i}:{i2 - i}"] * (i2 > i)
        return out

    for old, new in parts:
        yield pd.Series([of(a, b) for a, b in zip(old, new, strict=True)])


def deltas(snapshots: DataFrame, elements: DataFrame) -> DataFrame:
    """V7, V8: session_id, version, previous, added, removed, changed and content_ops of pairs that have a delta.

    Elements are compared by ref, and by text alone. One version's elements join on (session, version, ref), so a long
    session still splits over tasks.
    """
    keys = ["session_id", "version", "previous"]
    pairs = met(_pairs(snapshots), restamped(snapshots, elements), keys, "left_anti")
    shown = F.struct("index", "ref", "tag", "role", "text", "placeholder")
    after = met(pairs, elements, ["session_id", "version"]).select(*keys, "ref", shown.alias("a"))
    before = met(pairs, elements.withColumnRenamed("version", "previous"), ["session_id", "previous"]).select(*keys, "ref", shown.alias("b"))
    both_of = met(after, before, [*keys, "ref"], "full_outer")
    pick = lambda holds, value: F.array_sort(F.collect_list(F.when(holds, value)))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    diff = both_of.groupBy(keys).agg(
        pick(F.col("b").isNull(), F.col("a")).alias("added"),
        pick(F.col("a").isNull(), F.struct(F.col("b.index").alias("index"), F.col("ref").alias("ref"))).alias("removed"),
        pick(both & ~F.col("a.text").eqNullSafe(F.col("b.text")), F.struct(F.col("a.index").alias("index"), F.col("ref").alias("ref"), F.col("b.text").alias("old"), F.col("a.text").alias("new"))).alias("changed"),
    )
    texts = snapshots.select("session_id", "version", F.coalesce("text_content", F.lit("")).alias("_new"))
    older = snapshots.select("session_id", F.col("version").alias("previous"), F.coalesce("text_content", F.lit("")).alias("_old"))
    joined = met(met(met(pairs, diff, keys, "left"), texts, ["session_id", "version"]), older, ["session_id", "previous"])
    differ = F.col("_old") != F.col("_new")
    ops = F.coalesce(content_ops(F.when(differ, F.col("_old")), F.when(differ, F.col("_new"))), F.array().cast("array<string>"))
    empty = [F.coalesce(c, F.array().cast(diff.schema[c].dataType)).alias(c) for c in ("added", "removed", "changed")]
    return joined.select(*keys, *empty, ops.alias("content_ops"))


def render_deltas(found: DataFrame) -> DataFrame:
    """V9: deltas with rendered_delta and is_empty."""
    name = lambda a: F.coalesce(F.when(a["text"] != "", a["text"]), F.when(a["placeholder"] != "", a["placeholder"]), a["role"], F.lit(""))
    # labels are quoted in one pass over an exploded column, because a Python function can't run inside transform()
    lines = found.select(
        "session_id",
        "version",
        F.posexplode_outer(
            F.concat(
                F.transform("added", lambda a: F.struct(F.concat(F.lit("  + ["), tag_name(a["tag"]), F.lit(":"), a["ref"], F.lit("] ")).alias("head"), name(a).alias("one"), F.lit(None).cast("string").alias("two"))),
                F.transform("removed", lambda r: F.struct(F.concat(F.lit("  - ["), r["ref"], F.lit("]")).alias("head"), F.lit(None).cast("string").alias("one"), F.lit(None).cast("string").alias("two"))),
                F.transform("changed", lambda c: F.struct(F.concat(F.lit("  ~ ["), c["ref"], F.lit("] ")).alias("head"), F.coalesce(c["old"], F.lit("")).alias("one"), F.coalesce(c["new"], F.lit("")).alias("two"))),
            )
        ).alias("k", "x"),
    )
    line = F.concat_ws("", "x.head", quoted(F.col("x.one")), F.when(F.col("x.two").isNotNull(), F.concat(F.lit(" -> "), quoted(F.col("x.two")))))
    shown = lines.where("x is not null").withColumn("line", line).groupBy("session_id", "version").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("_lines"))
    head = F.concat(F.lit("DELTA v"), F.col("previous").cast("string"), F.lit("->v"), F.col("version").cast("string"))
    content = F.when(F.size("content_ops") > 0, F.concat(F.lit("  CONTENT:\n    "), F.array_join("content_ops", "\n    ")))
    nothing = (F.size("added") + F.size("removed") + F.size("changed") + F.size("content_ops")) == 0
    text = F.when(nothing, F.concat(head, F.lit(": no change"))).otherwise(F.concat_ws("\n", head, "_lines", content))
    return met(found, shown, ["session_id", "version"], "left").withColumns({"rendered_delta": text, "is_empty": nothing}).drop("_lines")


def sent_before(snapshots: DataFrame, sends: DataFrame) -> DataFrame:
    """session_id, version, last_sent and n_sends of each snapshot: an as-of step. last_sent is the newest version
    below its own that was sent, null before the first; n_sends says how often it was sent itself.

    sends: session_id, version, a row for each time that a version was sent. Sends of versions without a snapshot count
    as what a reader has seen, but have no row here.
    """
    keys = ["session_id", "version"]
    both = snapshots.select(*keys, F.lit(0).alias("_send")).unionByName(sends.select(*keys, F.lit(1).alias("_send")))
    seen = both.groupBy(keys).agg(F.sum("_send").alias("n_sends"), F.count_if(F.col("_send") == 0).alias("_shots"))
    earlier = Window.partitionBy("session_id").orderBy("version").rowsBetween(Window.unboundedPreceding, -1)
    return seen.withColumn("last_sent", F.last(F.when(F.col("n_sends") > 0, F.col("version")), ignorenulls=True).over(earlier)).where("_shots > 0").drop("_shots")


def choose_payload(rendered: DataFrame, rendered_deltas: DataFrame, sent: DataFrame | None = None) -> DataFrame:
    """session_id, version, kind (delta or snapshot) and payload of what is sent. A delta is sent if its baseline
    is the version sent last and it is at most WORTHWHILE of the snapshot's length.

    sent: session_id, version, last_sent and n_sends, as sent_before gives them; a version that is sent again is sent
    whole, as its delta's baseline is no longer what was sent last. Without it every version is sent once, in order.
    """
    keys = ["session_id", "version"]
    told = rendered.select(*keys, "rendered")
    if sent is None:
        joined = told.withColumns({"last_sent": F.lag("version").over(Window.partitionBy("session_id").orderBy("version")), "_turn": F.lit(1)})
    else:
        joined = met(told, sent.where("n_sends > 0").select(*keys, "last_sent", F.explode(F.sequence(F.lit(1), F.col("n_sends").cast("int"))).alias("_turn")), keys)
    joined = met(joined, rendered_deltas.select(*keys, "previous", "rendered_delta"), keys, "left")
    delta = F.coalesce((F.col("_turn") == 1) & (F.col("previous") == F.col("last_sent")) & (F.length("rendered_delta") <= WORTHWHILE * F.length("rendered")), F.lit(False))
    return joined.select(*keys, F.when(delta, "delta").otherwise("snapshot").alias("kind"), F.when(delta, F.col("rendered_delta")).otherwise(F.col("rendered")).alias("payload"))
