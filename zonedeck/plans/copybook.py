"""Flat copybooks as version 2 schemas."""

from __future__ import annotations

import re

from .schema import SchemaError

_PICTURE = re.compile(r"\bPIC(?:TURE)?\s+(?:IS\s+)?(\S+)", re.I)
_REFUSED = ("REDEFINES", "OCCURS", "SYNC", "SYNCHRONIZED", "SIGN", "JUSTIFIED", "JUST", "RENAMES")


def picture(text: str) -> dict:
    """Category, digits, scale and sign of a picture of X, A, 9, S and V."""
    plain = re.sub(r"(.)\((\d+)\)", lambda m: m[1] * int(m[2]), text.upper())
    if re.fullmatch(r"[XA]+", plain):
        return {"text": True, "length": len(plain)}
    m = re.fullmatch(r"(S?)(9*)(?:V(9*))?", plain)
    if not m or not (m[2] or m[3]):
        raise SchemaError(f"unsupported picture {text}")
    whole, part = len(m[2]), len(m[3] or "")
    return {"text": False, "signed": bool(m[1]), "total_digits": whole + part, "scale": part}


def to_schema(text: str, record_length: int | None = None, input_encoding: str = "binary", codepage: str = "cp037", endian: str = "big") -> dict:
    """The schema of a copybook's elementary items in order; groups give no field."""
    lines = [line[6:72] if re.match(r"^.{6}[ *\-/D]", line) and line[:6].strip().isdigit() else line for line in text.splitlines()]
    code = " ".join(line for line in lines if not line.lstrip().startswith("*"))
    layout = []
    for sentence in re.split(r"\.(?:\s+|$)", code):
        words = sentence.split()
        if len(words) < 2 or not words[0].isdigit():
            continue
        upper = sentence.upper()
        for word in _REFUSED:
            if re.search(rf"\b{word}\b", upper):
                raise SchemaError(f"{words[1]}: {word} isn't supported in a flat copybook")
        level, name = int(words[0]), words[1]
        if level in (66, 88):
            continue
        found = _PICTURE.search(sentence)
        if not found:
            continue
        pic = picture(found[1])
        spec: dict = {"kind": "field", "name": name}
        if pic["text"]:
            spec |= {"field_type": "alphanumeric", "length": pic["length"], "encoding": "ebcdic", "codepage": codepage}
        else:
            spec |= {k: pic[k] for k in ("total_digits", "scale", "signed")}
            if re.search(r"\b(COMP(UTATIONAL)?-3|PACKED-DECIMAL)\b", upper):
                spec |= {"field_type": "packed-decimal", "sign_mode": "pfd", "mode": "lossless"}
            elif re.search(r"\b(COMP(UTATIONAL)?(-4|-5)?|BINARY)\b", upper):
                spec |= {"field_type": "binary", "endian": endian}
            else:
                spec |= {"field_type": "zoned-decimal", "encoding": "ebcdic", "sign_policy": "preferred"}
        layout.append(spec)
    if not layout:
        raise SchemaError("the copybook has no elementary item")
    schema = {"version": 2, "input_encoding": input_encoding, "layout_mode": "sequential", "on_error": "fail", "layout": layout}
    return schema | ({"record_length": record_length} if record_length else {})
