"""Scalar text functions as column expressions; everything stays inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy import vocab

ColumnLike = Column | str


def _c(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def half_up(value: Column) -> Column:
    """Rounds halves upwards, unlike the half-even and half-away built-ins."""
    return F.floor(value + F.lit(0.5))


def percent(value: ColumnLike) -> Column:
    return half_up(_c(value) * 100)


def trim_ws(text: ColumnLike) -> Column:
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles], F.lit(False))


# -- claims as text -------------------------------------------------------------------------------


def claim_sentence(subject: ColumnLike, predicate: ColumnLike, obj: ColumnLike) -> Column:
    return F.concat_ws(
        " ", _c(subject), F.replace(_c(predicate), F.lit("-"), F.lit(" ")), _c(obj)
    )


def escape_markdown(text: ColumnLike) -> Column:
    escaped = F.replace(F.replace(_c(text), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(
        F.replace(escaped, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]")
    )


def escape_table_cell(text: ColumnLike) -> Column:
    return F.replace(escape_markdown(text), F.lit("|"), F.lit("\\|"))


def escape_markdown_full(text: ColumnLike) -> Column:
    return F.replace(escape_table_cell(text), F.lit("`"), F.lit("\\`"))


def claim_display(
    subject: ColumnLike, predicate: ColumnLike, obj: ColumnLike, confidence: ColumnLike
) -> Column:
    def spaced(value: ColumnLike) -> Column:
        return F.replace(_c(value), F.lit("-"), F.lit(" "))

    return F.concat(
        escape_markdown(spaced(subject)),
        F.lit(" "),
        spaced(predicate),
        F.lit(" "),
        escape_markdown(spaced(obj)),
        F.lit(" *("),
        percent(confidence).cast("string"),
        F.lit("% confident)*"),
    )


def slug(title: ColumnLike, limit: int = 50) -> Column:
    dashed = F.regexp_replace(F.lower(_c(title)), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "(^-|-$)", ""), 1, limit)


def clean_claim_text(text: ColumnLike, limit: int = 200) -> Column:
    """Control characters become spaces, runs collapse, long text is cut with an ellipsis."""
    flat = F.regexp_replace(_c(text), r"[\x00-\x1F\x7F]", " ")
    flat = trim_ws(F.regexp_replace(flat, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


def mask_injections(text: ColumnLike, limit: int = 500) -> Column:
    masked = clean_claim_text(text, limit)
    for pattern in vocab.INJECTION_PATTERNS:
        masked = F.regexp_replace(masked, "(?i)" + pattern, "[FILTERED]")
    return F.replace(masked, F.lit("```"), F.lit("'''"))


# -- dates ---------------------------------------------------------------------------------------------


def human_date(text: ColumnLike) -> Column:
    """`2025-12-27` becomes `Saturday, December 27, 2025`; anything else passes through."""
    parsed = F.when(
        _c(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(_c(text), F.lit("yyyy-MM-dd"))
    )
    return F.coalesce(F.date_format(parsed, "EEEE, MMMM d, yyyy"), _c(text))


def short_datetime(ts: ColumnLike) -> Column:
    return F.date_format(_c(ts), "MMM d, yyyy, hh:mm a")


def relative_date(ts: ColumnLike, now: Column) -> Column:
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(_c(ts).cast("timestamp"))
    days = F.floor(seconds / F.lit(86_400_000_000))
    return (
        F.when(days == 0, F.lit("today"))
        .when(days == 1, F.lit("yesterday"))
        .when(days < 7, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(days < 30, F.concat(F.floor(days / 7).cast("string"), F.lit(" weeks ago")))
        .otherwise(F.concat(F.floor(days / 30).cast("string"), F.lit(" months ago")))
    )


# -- shortening -----------------------------------------------------------------------------------------


def cut_dots(text: ColumnLike, limit: int) -> Column:
    """At most `limit` characters, three of them dots when cut."""
    t = _c(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 3), F.lit("...")))


def cut_ellipsis(text: ColumnLike, limit: int) -> Column:
    t = _c(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 1), F.lit("…")))


def cut_words(text: ColumnLike, limit: int) -> Column:
    """Cut at the last space when that space lies beyond 70% of the limit."""
    t = _c(text)
    head = F.substring(t, 1, limit)
    # Zero-based position of the last space; -1 without one.
    from_end = F.instr(F.reverse(head), " ")
    last_space = F.when(from_end == 0, F.lit(-1)).otherwise(F.length(head) - from_end)
    return (
        F.when(F.length(t) <= limit, t)
        .when(last_space > limit * 0.7, F.concat(F.substring(head, F.lit(1), last_space), F.lit("...")))
        .otherwise(F.concat(head, F.lit("...")))
    )


def excerpt(text: ColumnLike, limit: int) -> Column:
    """Hard cut, dots appended only when something was lost."""
    t = _c(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit), F.lit("...")))


def first_sentence(text: ColumnLike) -> Column:
    t = _c(text)
    matched = F.regexp_extract(t, r"^[^.!?]+[.!?]", 0)
    return trim_ws(F.when(matched != "", matched).otherwise(F.split(t, "[.!?]", 2)[0]))


def impact_line(summary: ColumnLike, limit: int = 80) -> Column:
    return cut_dots(first_sentence(summary), limit)


# -- labels -----------------------------------------------------------------------------------------------


def confidence_bar(confidence: ColumnLike) -> Column:
    pct = percent(confidence)
    filled = half_up(pct / 10).cast("int")
    return F.concat(
        F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(10) - filled),
        F.lit(" "), pct.cast("string"), F.lit("%"),
    )


def _lookup(key: Column, table: dict[str, str], default: str | None) -> Column:
    chain = F.lit(default)
    for name, value in reversed(list(table.items())):
        chain = F.when(key == name, F.lit(value)).otherwise(chain)
    return chain


def stance_symbol(stance: ColumnLike) -> Column:
    symbols = {name: pair[0] for name, pair in vocab.STANCE_INDICATORS.items()}
    return _lookup(_c(stance), symbols, vocab.UNRATED_INDICATOR[0])


def stance_label(stance: ColumnLike) -> Column:
    labels = {name: pair[1] for name, pair in vocab.STANCE_INDICATORS.items()}
    return _lookup(_c(stance), labels, vocab.UNRATED_INDICATOR[1])


def priority_icon(priority: ColumnLike) -> Column:
    return _lookup(_c(priority), vocab.PRIORITY_ICONS, None)


def priority(score: ColumnLike, controversy: ColumnLike, sentiment: ColumnLike) -> Column:
    s, c, m = _c(score), _c(controversy), _c(sentiment)
    # A null level or sentiment matches nothing, so each test is made null-safe.
    urgent = (s >= 70) | c.eqNullSafe("high") | m.eqNullSafe("negative")
    developing = (s >= 45) | c.eqNullSafe("medium") | m.eqNullSafe("mixed")
    return F.when(urgent, "urgent").when(developing, "developing").otherwise("informational")


def verification(confidence: ColumnLike) -> Column:
    return F.when(_c(confidence) >= 0.9, "verified").otherwise("unverified")


# -- budget -----------------------------------------------------------------------------------------------


def token_estimate(text: ColumnLike) -> Column:
    return F.ceil(F.length(_c(text)) / 4)


def cost_usd(input_tokens: ColumnLike, output_tokens: ColumnLike) -> Column:
    return (
        _c(input_tokens) / 1e6 * vocab.INPUT_USD_PER_MILLION
        + _c(output_tokens) / 1e6 * vocab.OUTPUT_USD_PER_MILLION
    )


# -- links -----------------------------------------------------------------------------------------------


def url_host(url: ColumnLike) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(_c(url), F.lit("HOST"))), F.lit(""))


def url_domain(url: ColumnLike) -> Column:
    return F.regexp_replace(url_host(url), r"^www\.", "")


def first_integer(text: ColumnLike) -> Column:
    digits = F.regexp_extract(_c(text), r"\d+", 0)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def is_internal_host(host: ColumnLike) -> Column:
    lowered = F.lower(_c(host))
    prefix = reduce(lambda a, b: a | b, [F.startswith(lowered, F.lit(p)) for p in vocab.INTERNAL_HOST_PREFIXES])
    suffix = reduce(lambda a, b: a | b, [F.endswith(lowered, F.lit(s)) for s in vocab.INTERNAL_HOST_SUFFIXES])
    pattern = lowered.rlike("|".join(vocab.INTERNAL_HOST_PATTERNS))
    return prefix | pattern | suffix


def is_domain_allowed(
    domain: ColumnLike,
    blocked: Iterable[str] = tuple(vocab.BLOCKED_DOMAINS),
    allowed: Iterable[str] = (),
) -> Column:
    d = _c(domain)
    allowed = list(allowed)
    passes = contains_any(d, allowed) if allowed else F.lit(True)
    return ~contains_any(d, blocked) & passes


def is_link_post(content: ColumnLike, url: ColumnLike) -> Column:
    u = F.coalesce(_c(url), F.lit(""))
    short = F.length(trim_ws(F.coalesce(_c(content), F.lit("")))) < 50
    external = ~F.contains(u, F.lit("reddit.com")) & ~F.contains(u, F.lit("redd.it"))
    return short & external & u.rlike("^https?://")


def link_prompt(
    title: ColumnLike, content: ColumnLike, domain: ColumnLike, error: ColumnLike, limit: int = 2000
) -> Column:
    """Prompt context of a link post; pass nulls throughout when nothing was fetched."""
    t, c, d, e = _c(title), _c(content), _c(domain), _c(error)
    heading = F.when(F.coalesce(t, F.lit("")) != "", F.concat(F.lit('Linked Article: "'), t, F.lit('"\n'))).otherwise("")
    return (
        F.when(d.isNull(), F.lit(vocab.LINK_NOT_FETCHED))
        .when(F.coalesce(e, F.lit("")) != "", F.concat(F.lit(vocab.LINK_ERROR[0]), e, F.lit(vocab.LINK_ERROR[1])))
        .when(
            F.length(F.coalesce(c, F.lit(""))) < 50,
            F.concat(F.lit(vocab.LINK_NOT_EXTRACTED[0]), d, F.lit(vocab.LINK_NOT_EXTRACTED[1])),
        )
        .otherwise(F.concat(heading, F.lit("Source: "), d, F.lit("\n\n"), excerpt(c, limit)))
    )


def decode_entities(text: ColumnLike) -> Column:
    """Entity decoding of short JVM-side strings: named list, then decimal, then hexadecimal."""
    out = _c(text)
    named = {f"&{k};": v for k, v in vocab.HTML_ENTITIES.items() if k != "amp"}
    # One left-to-right pass: split before every ampersand and decode each piece's head once.
    pieces = F.split(out, "(?=&)")
    table = F.create_map(*[F.lit(x) for kv in {**named, "&amp;": "&"}.items() for x in kv])

    def decode(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^&[a-zA-Z]+;", 0)
        dec = F.regexp_extract(piece, r"^&#(\d+);", 1)
        hexa = F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]+);", 1)
        value = F.try_to_number(F.when(dec != "", dec), F.lit("9" * 18)).cast("bigint")
        hex_value = F.when((hexa != "") & (F.length(hexa) <= 8), F.conv(hexa, 16, 10).cast("bigint"))
        code = F.coalesce(value, hex_value)
        rest = F.regexp_replace(piece, r"^&[^;]*;", "")
        return (
            F.when((name != "") & table[name].isNotNull(), F.concat(table[name], rest))
            .when((dec != "") | (hexa != ""), F.concat(_code_point(code), rest))
            .otherwise(piece)
        )

    return F.array_join(F.transform(pieces, decode), "")


def _code_point(code: Column) -> Column:
    valid = (code > 0) & (code <= 0x10FFFF)
    utf32 = F.unhex(F.lpad(F.hex(code), 8, "0"))
    return F.when(valid, F.decode(utf32, "UTF-32")).otherwise("")
