"""Which pages are usable: page state, challenges, action failures, URL policy, macros."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelore.functions.text import contains_any

#: Wordings of titles and URLs.
CAPTCHA_TITLES = ("captcha", "prove you're human", "verify you are human", "i am not a robot")
BLOCK_TITLES = (
    "cloudflare", "access denied", "ddos-guard", "attention required", "blocked", "security check", "just a moment", "checking your browser",
    "one more step", "are you a robot", "human verification", "verifying you are human", "pardon our interruption", "request blocked",
)
LOGIN_URLS = ("/login", "/signin", "/sign-in", "/auth", "/account/login")
LOGIN_TITLES = ("sign in", "log in", "login", "sign up", "create account")
MISSING_TITLES = ("page not found", "404 not found", "error 404", "404 - page not found")
STALE_MESSAGES = ("cannot find context", "execution context was destroyed", "no such node", "invalid nodeid")
TERMINAL = ("captcha_required", "rate_limited", "anti_bot_block", "auth_required", "no_content")
RAW_FLOOR, THIN_CHARS, THIN_RATIO = 200, 100, 0.15


def _state(kind: str, confidence: float, *recovery: str) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), F.array(*map(F.lit, recovery)).alias("recovery"))


def page_state(title: Column, url: Column, status: Column, raw_chars: Column, content_chars: Column) -> Column:
    """struct(type, confidence, recovery) of the first rule that holds, from blank pages to the default.

    Null titles and URLs are empty; a null status or size decides nothing.
    """
    title, url = F.coalesce(title, F.lit("")), F.coalesce(url, F.lit(""))
    low, address = F.lower(title), F.lower(url)
    thin = (raw_chars >= RAW_FLOOR) & (content_chars > 0) & (content_chars < THIN_CHARS) & (content_chars / raw_chars < THIN_RATIO)
    rules = [
        ((title == "") & url.isin("", "about:blank"), _state("navigation_failed", 0.9, "retry", "exponential_backoff")),
        (contains_any(low, CAPTCHA_TITLES), _state("captcha_required", 0.93, "escalate_to_human", "vision_fallback")),
        (status == 429, _state("rate_limited", 0.97, "exponential_backoff", "retry")),
        (contains_any(low, BLOCK_TITLES) | F.coalesce(status == 403, F.lit(False)), _state("anti_bot_block", 0.88, "rotate_identity", "exponential_backoff")),
        (contains_any(address, LOGIN_URLS) | contains_any(low, LOGIN_TITLES), _state("auth_required", 0.82, "escalate_to_human")),
        (contains_any(low, MISSING_TITLES), _state("no_content", 0.85, "retry")),
        (thin, _state("no_content", 0.75, "retry")),
    ]
    out = F
    for holds, state in rules:
        out = out.when(holds, state)
    return out.otherwise(_state("navigation_failed", 0.6, "retry"))


def page_error(state: Column) -> Column:
    """The state if it is one of the five that end a visit, else null."""
    return F.when(state["type"].isin(*TERMINAL), state)


#: Signatures of challenge widgets, in the order in which they decide.
GRID_FRAMES = ("recaptcha/api2/bframe", "recaptcha/enterprise/bframe")
ANCHOR_FRAMES = ("recaptcha/api2/anchor", "recaptcha/enterprise/anchor", "hcaptcha.com")
TURNSTILE_FRAME = "challenges.cloudflare.com"
SLIDERS = ("geetest_slider", "nc_scale", "slider-verify", "captcha-slider", "verify-slider")
CAPTCHA_IMAGE = r"""(?i)<img[^>]+(?:src|id|class|alt)=["'][^"']*captcha"""
CAPTCHA_FIELD = r"""(?i)<input[^>]+(?:name|id)=["'][^"']*captcha"""
CHALLENGE_PROSE = (
    r"(?i)(?:complete|solve|verify|confirm)[^.<>]{0,40}captcha(?:[^.<>]{0,20}(?:to\s+continue|before\s+continuing|required))"
    r"|(?:complete|solve|verify|confirm)[^.<>]{0,40}(?:you\s+are\s+human|not\s+a\s+robot)"
    r"|(?:captcha|security\s+check)[^.<>]{0,40}(?:to\s+continue|required)|checking\s+your\s+browser"
)


def challenge_stage(html: Column, frames: Column) -> Column:
    """Which challenge a page shows, from its frame URLs and markup. Cheap substring tests guard the patterns."""
    html = F.coalesce(html, F.lit(""))
    low, urls = F.lower(html), F.array_join(F.coalesce(frames, F.array().cast("array<string>")), " ")
    widget = lambda name: F.contains(low, F.lit(name)) & html.rlike(rf"""(?i)<[a-zA-Z][\w-]*\b[^>]*\bclass\s*=\s*["'][^"']*\b{name}\b""")
    captcha = F.contains(low, F.lit("captcha"))
    return (
        F.when(contains_any(urls, GRID_FRAMES), "image_grid")
        .when(F.contains(urls, F.lit(TURNSTILE_FRAME)) | widget("cf-turnstile"), "turnstile")
        .when(contains_any(low, SLIDERS), "slider")
        .when(contains_any(urls, ANCHOR_FRAMES), "checkbox")
        .when(widget("g-recaptcha") | widget("h-captcha"), "invisible")
        .when(captcha & html.rlike(CAPTCHA_IMAGE) & html.rlike(CAPTCHA_FIELD), "text")
        .when(contains_any(low, ("captcha", "human", "robot", "security", "checking")) & html.rlike(CHALLENGE_PROSE), "unknown")
        .otherwise("none")
    )


def solvable(stage: Column) -> Column:
    return stage.isin("checkbox", "turnstile", "slider")


def needs_vision(stage: Column) -> Column:
    return stage.isin("image_grid", "text")


def action_failure(message: Column) -> Column:
    """C4: what a driver's message about a failed action means."""
    return F.when(contains_any(F.lower(message), STALE_MESSAGES), _state("element_stale", 0.92, "re_snapshot", "retry")).otherwise(_state("element_not_found", 0.7, "re_snapshot"))


#: Addresses that hand out credentials.
METADATA_HOSTS = ("169.254.169.254", "169.254.170.2", "metadata.google.internal")


@F.pandas_udf(T.StructType([T.StructField("address", T.StringType()), T.StructField("private", T.BooleanType())]))
def _host_facts(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The dotted form of every spelling of an IPv4 host, and whether the address is private, loopback or link-local."""
    import ipaddress
    import socket

    def of(host: str | None) -> tuple[str | None, bool]:
        try:
            shown = socket.inet_ntoa(socket.inet_aton(host))
        except (OSError, UnicodeError, TypeError):
            shown = host
        try:
            found = ipaddress.ip_address((shown or "").strip("[]"))
        except ValueError:
            return shown, False
        return shown, found.is_private or found.is_loopback or found.is_link_local

    for part in parts:
        yield pd.DataFrame([of(x) for x in part], columns=["address", "private"])


def check_urls(urls: DataFrame, url: str = "url", allow_private: bool = False, allow_file: bool = False) -> DataFrame:
    """Urls with a column refusal, the reason why a URL may not be opened, or null.

    Hosts repeat, so each distinct host is classified once and joined back.
    """
    # As browsers read an address: no blanks and controls around it, no tabs and line ends in it, the host after the last @.
    address = F.regexp_replace(F.regexp_replace(F.col(url), r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")
    scheme, host = F.regexp_extract(address, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:@]*)", 1)
    parsed = urls.withColumns({"_scheme": F.lower(F.coalesce(scheme, F.lit(""))), "_host": F.lower(host)})
    hosts = parsed.select("_host").where(F.col("_host").isNotNull()).distinct().withColumn("_facts", _host_facts("_host"))
    joined = parsed.join(hosts, "_host", "left")
    local = (F.col("_host") == "localhost") | F.col("_host").endswith(".localhost")
    reason = (
        F.when(F.lower(F.trim(url)) == "about:blank", F.lit(None))
        .when(F.lit(allow_file) & (F.col("_scheme") == "file"), F.lit(None))
        .when(~F.col("_scheme").isin("http", "https"), F.concat(F.lit("scheme '"), "_scheme", F.lit("' is not allowed (http/https only)")))
        .when(F.col("_facts.address").isin(*METADATA_HOSTS), F.concat("_host", F.lit(" is a cloud metadata endpoint")))
        .when(local, F.lit(None) if allow_private else F.lit("localhost is not allowed (pass allow_private=True to permit)"))
        .when(F.col("_facts.private") & F.lit(not allow_private), F.concat("_host", F.lit(" is a private or internal address")))
    )
    return joined.withColumn("refusal", reason.cast("string")).drop("_scheme", "_host", "_facts")


#: Search shortcuts.
MACROS = {
    "@google_search": "https://www.google.com/search?q={query}",
    "@youtube_search": "https://www.youtube.com/results?search_query={query}",
    "@amazon_search": "https://www.amazon.com/s?k={query}",
    "@github_search": "https://github.com/search?q={query}",
    "@reddit_search": "https://www.reddit.com/search/?q={query}",
    "@wikipedia_search": "https://en.wikipedia.org/wiki/Special:Search?search={query}",
    "@twitter_search": "https://twitter.com/search?q={query}",
    "@yelp_search": "https://www.yelp.com/search?find_desc={query}",
    "@seekingalpha_search": "https://seekingalpha.com/search?q={query}",
    "@reuters_search": "https://www.reuters.com/search/news?blob={query}",
    "@wsj_search": "https://www.wsj.com/search?query={query}&mod=searchresults_viewallresults",
    "@reddit_wsb": "https://www.reddit.com/r/wallstreetbets/search/?q={query}&restrict_sr=1&sort=new",
}


def expand_macros(requests: DataFrame, url: str = "url", query: str = "query") -> DataFrame:
    """Requests with expanded_url and macro_error; URLs that are no macro pass through."""
    spark: SparkSession = requests.sparkSession
    known = spark.createDataFrame(list(MACROS.items()), "_macro string, _template string")
    joined = requests.join(F.broadcast(known), F.col(url) == F.col("_macro"), "left")
    macro = F.col(url).startswith("@")
    filled = F.replace(F.col("_template"), F.lit("{query}"), F.url_encode(F.coalesce(F.col(query), F.lit(""))))
    error = F.when(macro & F.col("_template").isNull(), F.concat(F.lit("Unknown macro: "), F.col(url)))
    return joined.withColumns({"expanded_url": F.when(macro, filled).otherwise(F.col(url)), "macro_error": error}).drop("_macro", "_template")


def same_document(a: Column, b: Column) -> Column:
    """Whether two URLs are equal but for slashes at the end."""
    return F.rtrim(F.coalesce(a, F.lit("")), F.lit("/")) == F.rtrim(F.coalesce(b, F.lit("")), F.lit("/"))


def origin(url: Column) -> Column:
    """Scheme://authority."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def triage(fetched: DataFrame) -> DataFrame:
    """Fetched pages with reason, null for usable ones: the page error's type, no_content without blocks, or the
    fetch failure; and shown_title, filled from the document. fetched has page_error, n_blocks, failure, title and
    doc_title."""
    reason = F.coalesce(F.col("failure"), F.col("page_error.type"), F.when(F.coalesce(F.col("n_blocks"), F.lit(0)) == 0, "no_content"))
    shown = F.when(F.coalesce(F.col("title"), F.lit("")) == "", F.col("doc_title")).otherwise(F.col("title"))
    return fetched.withColumns({"reason": reason, "shown_title": shown})
