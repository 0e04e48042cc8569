"""Record schemas: versions 1 and 2 from JSON or TOML, planned once into absolute offsets and codecs."""

from __future__ import annotations

import hashlib
import json
import tomllib
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as text_codec
from ..functions.binary import Binary
from ..functions.floats import HexFloat
from ..functions.packed import Packed
from ..functions.zoned import Zoned

#: Limits of schemas and records.
MAX_FIELDS, MAX_RECORD_BYTES, MAX_SCHEMA_BYTES = 1024, 16 << 20, 1 << 20


class SchemaError(ValueError):
    """A schema that can't be planned (exit code 2)."""

    code = "E_SCHEMA"


@dataclass(frozen=True)
class Codec:
    """How a field's bytes become its value."""

    kind: str
    byte_len: int
    shape: Any = None
    encoding: str = "ascii"
    codepage: int = 37

    @property
    def scale(self) -> int | None:
        return getattr(self.shape, "scale", None)

    def decode(self, data: Column) -> Column:
        """struct<value, sign_nibble, sign_class, error_code>."""
        if self.kind == "alphanumeric":
            return text_codec.decode_text(data, self.encoding, self.codepage)
        if self.kind == "filler":
            none = F.lit(None).cast("string")
            return F.struct(data.alias("value"), none.alias("sign_nibble"), none.alias("sign_class"), none.alias("error_code"))
        return self.shape.decode(data)

    def as_text(self, value: Column) -> Column:
        """The value as the long form shows it: decimals at their scale, floats without fraction as x.0, bytes as hex."""
        if self.kind == "filler":
            return F.hex(value)
        if self.kind.startswith("ibm-float"):
            whole = value == F.floor(value)
            return F.when(whole & (F.abs(value) < 1e15), F.concat(value.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(value.cast("string"))
        return value.cast("string")

    def encode(self, value: Column) -> Column:
        """The field's bytes, null where the value doesn't fit."""
        if self.kind == "alphanumeric":
            return text_codec.encode_text(value.cast("string"), self.byte_len, self.encoding, self.codepage)
        if self.kind == "filler":
            return value
        out = self.shape.encode(value)
        return out if self.kind.startswith("ibm-float") else out["bytes"]

    def verifies(self, data: Column, decoded: Column) -> Column:
        """Whether re-encoding gives the bytes back (zoned fields and floats keep theirs, so they always do)."""
        if self.kind == "packed-decimal":
            return F.coalesce(self.shape.encode_lossless(decoded) == data, F.lit(False))
        if self.kind in ("binary", "native-binary", "alphanumeric"):
            return F.coalesce(self.encode(decoded["value"]) == data, F.lit(False))
        return F.lit(True)


@dataclass(frozen=True)
class Field:
    path: str
    offset: int
    codec: Codec
    required: bool = True

    @property
    def length(self) -> int:
        return self.codec.byte_len


@dataclass(frozen=True)
class Gap:
    """A filler, or slack before an aligned field."""

    path: str
    offset: int
    length: int
    kind: str = "filler"


@dataclass(frozen=True)
class Occurs:
    path: str
    offset: int
    counter: Field
    low: int
    high: int
    element_len: int
    items: tuple = ()

    @property
    def length(self) -> int:
        return self.high * self.element_len


@dataclass(frozen=True)
class Variant:
    name: str
    items: tuple
    selector: tuple[Field, str] | None = None


@dataclass(frozen=True)
class Redefines:
    path: str
    offset: int
    length: int
    variants: tuple[Variant, ...] = ()


Item = Field | Gap | Occurs | Redefines


@dataclass
class Plan:
    version: int
    record_length: int | None
    input_encoding: str
    on_error: str
    scope: str
    items: list[Item]
    ranges: list[tuple[str, str, int, int]] = field(default_factory=list)  # kind, path, start, end
    semantic_hash: str = ""
    file_sha256: str = ""

    @property
    def fields(self) -> list[Field]:
        return [i for i in self.items if isinstance(i, Field)]

    @property
    def has_occurs(self) -> bool:
        return any(isinstance(i, Occurs) for i in self.items)

    @property
    def max_length(self) -> int:
        return max([0, *(i.offset + i.length for i in self.items)])

    @property
    def header_length(self) -> int:
        """Bytes up to the last counter's end: what must be read to know a record's length."""
        return max([0, *(i.counter.offset + i.counter.length for i in self.items if isinstance(i, Occurs))])

    def coverage(self) -> dict[str, Any]:
        return coverage([(a, b) for _, _, a, b in self.ranges], self.record_length)


def coverage(ranges: list[tuple[int, int]], record_length: int | None) -> dict[str, Any]:
    """Covered bytes, gaps and overlaps of byte ranges [start, end)."""
    gaps, overlaps, covered, at = [], [], 0, 0
    for start, end in sorted(ranges):
        if start > at:
            gaps.append((at, start))
        if start < at and min(at, end) > start:
            overlaps.append((start, min(at, end)))
        covered += max(0, end - max(at, start))
        at = max(at, end)
    if record_length is not None and at < record_length:
        gaps.append((at, record_length))
    return {"covered": covered, "gaps": gaps, "overlaps": overlaps, "full": record_length is not None and not gaps and not overlaps}


def load(source: str | bytes | dict, form: str | None = None) -> Plan:
    """A plan from a JSON or TOML text, or from a dict."""
    raw = json.dumps(source).encode() if isinstance(source, dict) else source.encode() if isinstance(source, str) else source
    if len(raw) > MAX_SCHEMA_BYTES:
        raise SchemaError("schema is over 1 MiB")
    if isinstance(source, dict):
        data = source
    else:
        try:
            data = tomllib.loads(raw.decode()) if form == "toml" else json.loads(raw)
        except ValueError as e:
            raise SchemaError(str(e)) from e
    plan = plan_v1(data) if data.get("version") == 1 else plan_v2(data) if data.get("version") == 2 else None
    if plan is None:
        raise SchemaError(f"unsupported schema version {data.get('version')}")
    plan.file_sha256 = hashlib.sha256(raw).hexdigest().upper()
    meaning = json.dumps(_without_descriptions(data), sort_keys=True, separators=(",", ":"))
    plan.semantic_hash = hashlib.sha256(meaning.encode()).hexdigest().upper()
    return plan


def _without_descriptions(x: Any) -> Any:
    if isinstance(x, dict):
        return {k: _without_descriptions(v) for k, v in x.items() if k != "description"}
    return [_without_descriptions(v) for v in x] if isinstance(x, list) else x


def _packed(spec: dict) -> Packed:
    try:
        return Packed(spec["total_digits"], spec.get("scale") or 0, bool(spec.get("signed", False)), str(spec.get("sign_mode") or "pfd").replace("-", "").lower())
    except (KeyError, ValueError) as e:
        raise SchemaError(f"{spec.get('name')}: {e}") from e


def _head(data: dict) -> dict:
    return {
        "record_length": data.get("record_length"), "input_encoding": data.get("input_encoding", "binary"),
        "on_error": data.get("on_error", "fail"), "scope": data.get("verification_scope", "field"),
    }


def _check(plan: Plan, names: list[str]) -> Plan:
    if plan.on_error not in ("fail", "skip-record", "emit-error-row"):
        raise SchemaError(f"unknown on_error {plan.on_error}")
    if not 1 <= len(names) <= MAX_FIELDS:
        raise SchemaError(f"a schema has 1 to {MAX_FIELDS} fields")
    if len(set(names)) != len(names):
        raise SchemaError("duplicate field path")
    if plan.record_length is not None and not 0 < plan.record_length <= MAX_RECORD_BYTES:
        raise SchemaError("record_length must be in 1..=16 MiB")
    return plan


def plan_v1(data: dict) -> Plan:
    """Version 1: packed fields and fillers at declared offsets (or named cells in CSV and JSONL)."""
    named = data.get("input_encoding") in ("csv", "jsonl")
    items: list[Item] = []
    ranges = []
    for spec in data.get("fields", []):
        shape = _packed(spec)
        offset = spec.get("offset")
        if offset is None and not named:
            raise SchemaError(f"{spec['name']} needs an offset")
        if spec.get("length") not in (None, shape.byte_len):
            raise SchemaError(f"{spec['name']}: length isn't that of the digits")
        items.append(Field(spec["name"], offset or 0, Codec("packed-decimal", shape.byte_len, shape), spec.get("required", True)))
        ranges.append(("field", spec["name"], offset or 0, (offset or 0) + shape.byte_len))
    for spec in data.get("fillers", []):
        items.append(Gap(spec["name"], spec["offset"], spec["length"]))
        ranges.append(("filler", spec["name"], spec["offset"], spec["offset"] + spec["length"]))
    plan = _check(Plan(1, items=items, ranges=[] if named else ranges, **_head(data)), [f["name"] for f in data.get("fields", [])])
    if not named and plan.record_length is None and plan.input_encoding == "binary":
        raise SchemaError("binary schemas require record_length")
    for i in items:
        if not named and plan.record_length is not None and i.offset + i.length > plan.record_length:
            raise SchemaError(f"{i.path} ends past the record")
    return plan


def codec_of(spec: dict) -> Codec:
    """The codec of a version 2 field."""
    kind, name = spec.get("field_type"), spec.get("name")
    endian = spec.get("endian") or "big"
    try:
        if kind == "packed-decimal":
            return Codec(kind, _packed(spec).byte_len, _packed(spec))
        if kind == "zoned-decimal":
            shape = Zoned(spec["total_digits"], spec.get("scale") or 0, bool(spec.get("signed", False)), spec.get("encoding") or "ebcdic", spec.get("sign_policy") or "preferred")
            return Codec(kind, shape.byte_len, shape)
        if kind in ("binary", "native-binary"):
            n = spec.get("length") or spec.get("byte_len") or Binary.width(spec["total_digits"])
            return Codec(kind, n, Binary(n, bool(spec.get("signed", False)), endian, spec.get("scale") or 0))
        if kind in ("ibm-float32", "ibm-float64"):
            n = 4 if kind.endswith("32") else 8
            return Codec(kind, n, HexFloat(n, endian))
        n = spec.get("length") or spec.get("byte_len")
        if not n:
            raise SchemaError(f"{name} needs a length")
        if kind == "alphanumeric":
            page = int(str(spec.get("codepage") or 37).lower().removeprefix("cp"))
            if page not in text_codec.CODEPAGES:
                raise SchemaError(f"unsupported codepage cp{page}")
            return Codec(kind, n, None, spec.get("encoding") or "ascii", page)
        if kind == "filler":
            return Codec(kind, n)
    except (KeyError, ValueError) as e:
        raise SchemaError(f"{name}: {e}") from e
    raise SchemaError(f"{name}: unknown field_type {kind}")


def alignment(codec: Codec, platform: str) -> int:
    if platform == "gnu-cobol":
        return 1
    if codec.kind in ("binary", "native-binary", "packed-decimal"):
        return min(codec.byte_len, 8)
    return {"ibm-float32": 4, "ibm-float64": 8}.get(codec.kind, 1)


def plan_v2(data: dict) -> Plan:
    """Version 2: a layout of fields, fillers, tables and redefinitions, at declared or running offsets."""
    sequential = data.get("layout_mode", "declared") == "sequential"
    platform = data.get("platform_profile", "ibm-z-os")
    ranges: list[tuple[str, str, int, int]] = []
    seen: list[Field] = []
    names: list[str] = []

    def lookup(name: str, what: str) -> Field:
        for f in seen:
            if name in (f.path, f.path.rpartition(".")[2]):
                return f
        raise SchemaError(f"{what} {name} must refer to a preceding field")

    def walk(specs: list[dict], base: int, prefix: str, count: bool, top: bool = False) -> tuple[list[Item], int]:
        items: list[Item] = []
        at = base
        for k, spec in enumerate(specs):
            kind, path = spec.get("kind", "field"), f"{prefix}{spec['name']}"
            offset = spec.get("offset")
            if sequential and offset is not None:
                raise SchemaError(f"{path}: sequential layouts have no offsets")
            if not sequential and offset is None:
                raise SchemaError(f"{path} needs an offset")
            here = at if sequential else base + offset if not top else offset
            if kind == "field":
                codec = codec_of(spec)
                if spec.get("sync") and not sequential:
                    raise SchemaError(f"{path}: sync needs a sequential layout")
                if spec.get("sync") and (slack := -here % alignment(codec, platform)):
                    items.append(Gap(f"{path}<slack>", here, slack, "sync-slack"))
                    if count:
                        ranges.append(("sync-slack", path, here, here + slack))
                    here += slack
                item: Item = Field(path, here, codec, spec.get("required", True))
                seen.append(item)
                names.append(path)
            elif kind == "filler":
                item = Gap(path, here, spec["length"])
            elif kind in ("occurs", "occurs-group"):
                if sequential and k < len(specs) - 1:
                    raise SchemaError(f"{path}: a table must come last in a sequential layout")
                counter = lookup(spec["counter_field"], "OCCURS counter field")
                if counter.codec.scale != 0 or counter.codec.kind.startswith("ibm-float"):
                    raise SchemaError(f"OCCURS counter field {counter.path} must be a scale-zero numeric field")
                if counter.offset + counter.length > here:
                    raise SchemaError(f"OCCURS counter field {counter.path} must end before the table")
                if spec["min_occurs"] > spec["max_occurs"] or not spec["max_occurs"]:
                    raise SchemaError(f"{path}: bad occurs bounds")
                inner, end = walk(spec.get("element_layout", []), 0, f"{path}[].", False)
                item = Occurs(path, here, counter, spec["min_occurs"], spec["max_occurs"], end, tuple(inner))
            elif kind in ("redefines", "redefines-group"):
                variants, longest = [], 0
                for v in spec["variants"]:
                    inner, end = walk(v.get("layout", []), 0, f"{path}.{v['name']}.", False)
                    selector = None
                    if v.get("selector"):
                        want = v["selector"].get("equals", v["selector"].get("value"))
                        selector = (lookup(v["selector"]["field"], "REDEFINES selector field"), str(want).lower() if isinstance(want, bool) else str(want))
                    variants.append(Variant(v["name"], tuple(inner), selector))
                    longest = max(longest, end)
                item = Redefines(path, here, spec.get("base_length") or longest, tuple(variants))
                if longest > item.length:
                    raise SchemaError(f"{path}: a variant is longer than base_length")
            else:
                raise SchemaError(f"{path}: unknown kind {kind}")
            items.append(item)
            if count:
                ranges.append((kind, path, item.offset, item.offset + item.length))
            at = max(at, item.offset + item.length)
        return items, at

    items, end = walk(data.get("layout", []), 0, "", True, top=True)
    head = _head(data)
    plan = _check(Plan(2, items=items, ranges=ranges, **head), names)
    if plan.record_length is None and not plan.has_occurs:
        plan.record_length = end
    if plan.record_length is not None and end > plan.record_length and not plan.has_occurs:
        raise SchemaError("the layout ends past the record")
    return plan


def compare(left: Plan, right: Plan) -> list[dict[str, str | None]]:
    """Field paths added, removed or changed, in order of path."""

    def described(p: Plan) -> dict[str, str]:
        return {i.path: repr(i) for i in p.items if not isinstance(i, Gap) or i.kind == "filler"}

    a, b = described(left), described(right)
    change = lambda k: "added" if k not in a else "removed" if k not in b else "changed"
    return [{"path": k, "change": change(k), "before": a.get(k), "after": b.get(k)} for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k)]
