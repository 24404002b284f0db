"""Typed columns out of free-text model responses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import vocab
from colloquy.functions.text import verification

_S, _D = T.StringType(), T.DoubleType()
_SS = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


@dataclass(frozen=True)
class ResponseSpec:
    """What a response must look like: required fields, enumerations, ranges, defaults, caps."""

    schema: T.StructType
    required: tuple[str, ...] = ()
    enums: dict[str, list[str]] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)
    max_items: dict[str, int] = field(default_factory=dict)
    # Fields whose content is free.
    loose: tuple[str, ...] = ()
    # Per-element rule of an array field; one failing element rejects the response.
    element_rules: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


_SUMMARY_FIELDS = dict(
    summary=_S, notable_comments=_SS, sentiment=_S, key_topics=_SS, confidence=_D,
    controversy_level=_S, information_density=_S, missing_context=_SS,
)
_SUMMARY_ENUMS = dict(
    sentiment=vocab.SENTIMENTS,
    controversy_level=vocab.CONTROVERSY_LEVELS,
    information_density=vocab.INFORMATION_DENSITIES,
)

SUMMARY = ResponseSpec(
    _struct(**_SUMMARY_FIELDS),
    required=("summary",),
    enums=_SUMMARY_ENUMS,
    ranges={"confidence": (0, 1)},
    defaults=dict(
        notable_comments=[], sentiment="neutral", key_topics=[], confidence=0.7,
        controversy_level="none", information_density="moderate", missing_context=[],
    ),
)

ANALYSIS_SCHEMA = _struct(
    main_claim=_S, supporting_points=_SS, opposing_points=_SS,
    community_split=T.ArrayType(_struct(camp_name=_S, percentage=_D, key_argument=_S)),
    nuances=_SS, balanced_summary=_S,
)
CONTROVERSY_SUMMARY = ResponseSpec(
    _struct(**_SUMMARY_FIELDS, controversy_analysis=ANALYSIS_SCHEMA),
    required=("summary",),
    enums=_SUMMARY_ENUMS,
    ranges={"confidence": (0, 1)},
    defaults=dict(
        notable_comments=[], sentiment="mixed", key_topics=[], confidence=0.7,
        controversy_level="high", information_density="moderate", missing_context=[],
    ),
)

CLAIMS = ResponseSpec(
    _struct(
        claims=T.ArrayType(_struct(subject=_S, predicate=_S, object=_S, confidence=_D, source_stance=_S)),
        commenter_stances=_struct(
            agree_percentage=_D, disagree_percentage=_D,
            notable_camps=T.ArrayType(_struct(name=_S, stance=_S, percentage=_D, key_argument=_S)),
        ),
    ),
    defaults=dict(claims=[]),
    loose=("notable_camps",),
    element_rules={
        "claims": lambda c: c["subject"].isNotNull() & c["predicate"].isNotNull() & c["object"].isNotNull()
        & F.coalesce(c["confidence"], F.lit(0.5)).between(0, 1)
        & F.coalesce(c["source_stance"], F.lit("neutral")).isin(vocab.SOURCE_STANCES)
    },
)

THEME_SYNTHESIS = ResponseSpec(
    _struct(
        recurring_themes=T.ArrayType(_struct(
            theme=_S, posts=_SS, summary=_S,
            sentiment_spread=_struct(positive=_D, negative=_D, mixed=_D),
        )),
        conflicting_viewpoints=T.ArrayType(_struct(
            topic=_S,
            viewpoint_a=_struct(position=_S, sources=_SS),
            viewpoint_b=_struct(position=_S, sources=_SS),
        )),
        emerging_trends=T.ArrayType(_struct(trend=_S, evidence=_SS, confidence=_D)),
    ),
    defaults=dict(recurring_themes=[], conflicting_viewpoints=[], emerging_trends=[]),
)

WHAT_MATTERS = ResponseSpec(
    _struct(
        items=T.ArrayType(_struct(
            priority=_S, topic=_S, impact=_S,
            status=_struct(community=_S, official=_S), source_posts=_SS,
        )),
        synthesis_notes=_S,
    ),
    required=("items",),
    max_items={"items": 6},
    element_rules={
        "items": lambda e: e["priority"].isin(vocab.PRIORITIES) & e["topic"].isNotNull()
        & e["impact"].isNotNull() & e["status"]["community"].isNotNull()
    },
)

NOTABLE_THREADS = ResponseSpec(
    _struct(
        notable_threads=T.ArrayType(_struct(
            thread_author=_S, insight=_S, thread_type=_S, engagement_signal=_S,
        )),
        analysis_notes=_S,
    ),
    required=("notable_threads",),
    max_items={"notable_threads": 4},
    element_rules={
        "notable_threads": lambda e: e["thread_author"].isNotNull() & e["insight"].isNotNull()
        & e["thread_type"].isin(vocab.NOTABLE_THREAD_TYPES)
    },
)

STORY = ResponseSpec(_struct(narrative=_S, hook=_S), required=("narrative",))
THEME_LABEL = ResponseSpec(
    _struct(name=_S, description=_S, keywords=_SS), required=("name", "description", "keywords")
)
VERDICT = ResponseSpec(
    _struct(isContradiction=T.BooleanType(), confidence=_D, explanation=_S, contradictionType=_S),
    required=("isContradiction", "confidence", "explanation", "contradictionType"),
    enums={"contradictionType": ["direct", "semantic", "contextual", "none"]},
    ranges={"confidence": (0, 1)},
)
RANKING = ResponseSpec(
    _struct(rankings=T.ArrayType(_struct(post_id=_S, importance_score=_D, reasoning=_S))),
    required=("rankings",),
    element_rules={
        "rankings": lambda e: e["post_id"].isNotNull() & e["importance_score"].between(0, 100)
    },
)

SPECS = {
    "summary": SUMMARY,
    "controversy_summary": CONTROVERSY_SUMMARY,
    "claims": CLAIMS,
    "theme_synthesis": THEME_SYNTHESIS,
    "what_matters": WHAT_MATTERS,
    "notable_threads": NOTABLE_THREADS,
    "story": STORY,
    "theme_label": THEME_LABEL,
    "verdict": VERDICT,
    "ranking": RANKING,
}


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often `then` names it."""
    return F.transform(F.array(value), then)[0]


def _strict_object(text: Column) -> Column:
    """The text when the whole of it is one valid JSON object, else null.

    A text that does not open like one is not parsed: a failing parse costs more than all the rest.
    """
    def is_object(t: Column) -> Column:
        return F.ltrim(t, F.lit(" \t\r\n\ufeff")).startswith("{") & F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT")

    return _once(text, lambda t: F.when(is_object(t), t))


def json_object(text: Column) -> Column:
    """First valid JSON object found: whole text, fenced block, widest braces, balanced braces.

    `coalesce` stops at the first hit, so the scan over closing braces runs only for texts the
    cheaper tries could not read.
    """
    return F.coalesce(
        _strict_object(text),
        _strict_object(F.trim(F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)```", 1))),
        _strict_object(F.regexp_extract(text, r"\{[\s\S]*\}", 0)),
        _first_balanced(text),
    )


def _first_balanced(text: Column) -> Column:
    """The balanced object that starts at the first opening brace, if it is valid.

    Escaped characters are masked, the text is cut into strings, braces and the rest, and one fold
    over these tokens counts the depth; the object is parsed once.
    """
    tail = F.regexp_extract(text, r"\{[\s\S]*", 0)
    masked = F.regexp_replace(tail, r"\\[\s\S]", "__")
    tokens = F.regexp_extract_all(masked, F.lit(r'"[^"]*+"?|[{}]|[^"{}]++'), F.lit(0))
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def count(acc: Column, token: Column) -> Column:
        depth = acc["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        at = acc["at"] + F.length(token)
        end = F.when((acc["end"] == 0) & (depth == 0), at).otherwise(acc["end"])
        return F.struct(depth.alias("depth"), at.alias("at"), end.alias("end"))

    end = F.aggregate(tokens, state, count)["end"]
    return F.when(end > 0, _strict_object(F.substring(tail, F.lit(1), end)))


def _has_type(value: Column, kind: T.DataType, loose: tuple[str, ...]) -> Column:
    """Whether a variant is of the type, elements and fields included; numbers may be whole.

    A field may be missing, but where it stands it must be of its type: an explicit null is none.
    """
    name = F.schema_of_variant(value)
    if isinstance(kind, T.ArrayType):
        inside = F.forall(value.cast("array<variant>"), lambda e: F.coalesce(_has_type(e, kind.elementType, loose), F.lit(False)))
        return F.when(name.startswith("ARRAY"), inside).otherwise(False)
    if isinstance(kind, T.StructType):
        ok = name.startswith("OBJECT")
        for f in kind.fields:
            part = F.try_variant_get(value, f"$.{f.name}", "variant")
            if f.name not in loose:
                ok = ok & (part.isNull() | F.coalesce(_has_type(part, f.dataType, loose), F.lit(False)))
        return ok
    if isinstance(kind, T.BooleanType):
        return name == "BOOLEAN"
    if isinstance(kind, T.StringType):
        return name == "STRING"
    return name.rlike("^(?:BIGINT|DOUBLE|DECIMAL)")


def _null_fails(rule: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """An element that yields null is as invalid as one that yields false."""
    return lambda element: F.coalesce(rule(element), F.lit(False))


def _is_valid(parsed: Column, spec: ResponseSpec) -> Column:
    ok = parsed.isNotNull()
    for name in spec.required:
        ok = ok & parsed[name].isNotNull()
    for name, values in spec.enums.items():
        ok = ok & (parsed[name].isNull() | parsed[name].isin(values))
    for name, (low, high) in spec.ranges.items():
        ok = ok & (parsed[name].isNull() | parsed[name].between(low, high))
    for name, cap in spec.max_items.items():
        ok = ok & (F.size(parsed[name]) <= cap)
    for name, rule in spec.element_rules.items():
        elements = F.coalesce(parsed[name], F.array().cast(spec.schema[name].dataType))
        ok = ok & F.forall(elements, _null_fails(rule))
    return F.coalesce(ok, F.lit(False))


def parse_responses(df: DataFrame, text: str, spec: ResponseSpec, into: str = "response") -> DataFrame:
    """Adds a struct of the spec's fields plus `parse_ok`; all fields null when unreadable.

    A value of another type than the spec's makes a response unreadable, as does an explicit null.
    The steps are separate projections so that the text is searched and parsed once per row.
    """
    parsed = df.withColumn("_json", json_object(F.col(text))).withColumn(
        "_parsed", F.from_json("_json", spec.schema, {"allowSingleQuotes": "false"})
    )
    typed = F.coalesce(_has_type(F.try_parse_json("_json"), spec.schema, spec.loose), F.lit(False))
    parsed = parsed.withColumn("_valid", _is_valid(F.col("_parsed"), spec) & typed)
    columns = []
    for f in spec.schema.fields:
        value = F.col("_parsed")[f.name]
        if f.name in spec.defaults:
            default = spec.defaults[f.name]
            literal = F.array().cast(f.dataType) if default == [] else F.lit(default).cast(f.dataType)
            value = F.coalesce(value, literal)
        columns.append(F.when(F.col("_valid"), value).alias(f.name))
    result = F.struct(*columns, F.col("_valid").alias("parse_ok"))
    return parsed.withColumn(into, result).drop("_json", "_parsed", "_valid")


def summaries_with_fallback(df: DataFrame, text: str) -> DataFrame:
    """Summary columns; an unreadable response becomes its own summary with confidence 0.5."""
    rows = parse_responses(df, text, SUMMARY)
    ok = F.col("response.parse_ok")
    fallback = dict(
        summary=F.col(text), notable_comments=F.array().cast("array<string>"), sentiment=F.lit("neutral"),
        key_topics=F.array().cast("array<string>"), confidence=F.lit(0.5), controversy_level=F.lit("none"),
        information_density=F.lit("moderate"), missing_context=F.array().cast("array<string>"),
    )
    for name, value in fallback.items():
        rows = rows.withColumn(name, F.when(ok, F.col(f"response.{name}")).otherwise(value))
    return rows.withColumn("parse_ok", ok).drop("response")


def claims_from_responses(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per extracted claim: defaults applied, verification derived from confidence."""
    # The outer form keeps the optimizer from testing the parsed array again below the explode.
    rows = parse_responses(df, text, CLAIMS).select(*keep, F.posexplode_outer("response.claims").alias("claim_pos", "c"))
    rows = rows.where(F.col("c").isNotNull())
    confidence = F.coalesce("c.confidence", F.lit(0.5))
    return rows.select(
        *keep, "claim_pos", "c.subject", "c.predicate", "c.object", confidence.alias("confidence"),
        F.coalesce("c.source_stance", F.lit("neutral")).alias("source_stance"),
        verification(confidence).alias("verification_status"),
    )
