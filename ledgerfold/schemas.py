"""Explicit schemas of inputs and of the normalized message table."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _b, _l, _d = T.StringType(), T.BooleanType(), T.LongType(), T.DoubleType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MESSAGE = T.StructType([T.StructField(n, t) for n, t in (
    ("provider", _s), ("conversation_id", _s), ("source_order", _l), ("id", _s), ("native_id", _s), ("parent_native_id", _s), ("call_id", _s), ("role", _s),
    ("kind", _s), ("model", _s), ("text", _s), ("raw_text", _s), ("is_error", _b), ("created_at", T.TimestampType()))])

CANONICAL_MESSAGE = struct(id=_s, role=_s, kind=_s, text=_s, created_at=_s)
CANONICAL_CONVERSATION = struct(id=_s, provider=_s, parent_id=_s, aliases=T.ArrayType(_s), coverage=_s, messages=T.ArrayType(CANONICAL_MESSAGE))
CANONICAL_WORKSPACE = struct(
    id=_s, source_kind=_s, title=_s, purpose=_s, outcome=_s, activity_at=_s, location=_s,
    repository=struct(canonical_remote=_s, display_name=_s, owner=_s, aliases=T.ArrayType(_s), local_locations=T.ArrayType(_s)),
    metadata=T.MapType(_s, _s), conversations=T.ArrayType(CANONICAL_CONVERSATION),
    changes=T.ArrayType(struct(classification=_s, base_id=_s, head_id=_s, files=T.ArrayType(struct(path=_s, status=_s, tracked=_b)))),
    metrics=T.ArrayType(struct(name=_s, value=_d, unit=_s, status=_s, coverage=_d, extractor_version=_s)),
    prs=T.ArrayType(struct(host=_s, number=_l, relationship=_s, confidence=_d)),
)
CANONICAL = struct(workspaces=T.ArrayType(CANONICAL_WORKSPACE))

PRICE_CHANGE = struct(provider=_s, model=_s, effective_from=_s, input=_d, cache_read=_d, cache_write_5m=_d, cache_write_1h=_d, output=_d, status=_s, assumption=_b, source_url=_s, source_title=_s, notes=_s, retrieved_at=_s)
ALIAS_CHANGE = struct(alias=_s, provider=_s, model=_s, effective_from=_s, status=_s, source_url=_s, source_title=_s, notes=_s)
PRICING = struct(changes=T.ArrayType(PRICE_CHANGE), aliases=T.ArrayType(ALIAS_CHANGE))

_RANGE = struct(low=_d, central=_d, high=_d)
CARBON = struct(
    tiers=T.ArrayType(struct(key=_s, label=_s, match=T.ArrayType(_s), output_wh_per_mtok=_RANGE)), default_tier=_s, ratios=T.MapType(_s, _RANGE), pue=_RANGE,
    grids=T.ArrayType(struct(key=_s, g_co2e_per_kwh=_d)), default_grid=_s, equivalents=T.ArrayType(struct(key=_s, g_co2e_per_unit=_d)),
)

CLAUDE_BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
EXPORT_CONVERSATION = "conversation_id string, title string, mapping map<string, struct<message: struct<id: string, author: struct<role: string>, create_time: double, content: struct<parts: array<string>>>>>"
