"""Which file a program's name stands for, and how it may be opened."""

from __future__ import annotations

import json
from dataclasses import dataclass

#: File statuses.
OK, AT_END, PARTIAL, MISSING, REFUSED, LOGIC = "00", "10", "30", "35", "37", "90"
MODES = ("INPUT", "OUTPUT", "I-O", "EXTEND")


class BindingError(ValueError):
    """A file map that can't be used (exit code 2)."""

    code = "E_CONFIG"


@dataclass(frozen=True)
class Binding:
    """disposition: old (must exist), new (must not), shared (read only) or mod (may be extended)."""

    name: str
    path: str
    record_length: int
    disposition: str = "old"

    def status(self, mode: str, exists: bool) -> str:
        """What OPEN in that mode gives."""
        if mode not in MODES:
            return LOGIC
        if mode in ("INPUT", "I-O") and not exists:
            return MISSING
        if mode != "INPUT" and self.disposition == "shared" or mode == "OUTPUT" and self.disposition == "new" and exists:
            return REFUSED
        if mode == "EXTEND" and not exists and self.disposition == "old":
            return MISSING
        return OK

    @property
    def write_mode(self) -> dict[str, str]:
        """Spark's write mode by OPEN mode."""
        return {"OUTPUT": "overwrite", "EXTEND": "append", "I-O": "overwrite"}


def load(text: str, remap: dict[str, str] | None = None) -> dict[str, Binding]:
    """The bindings of a JSON file map {"files": [{name, path, organization, record_format, encoding, record_length, disposition}]}.

    Only sequential files of fixed ASCII records can be bound. remap: other paths by name, as --file NAME=path gives them.
    """
    try:
        files = json.loads(text)["files"]
    except (ValueError, KeyError, TypeError) as e:
        raise BindingError(f"E_CONFIG: not a file map: {e}") from e
    out: dict[str, Binding] = {}
    for f in files:
        name = str(f.get("name", "")).upper()
        for key, only in (("organization", "sequential"), ("record_format", "fixed"), ("encoding", "ascii")):
            if f.get(key, only) != only:
                raise BindingError(f"E_CONFIG: {name}: {key} {f[key]} can't be bound")
        length = f.get("record_length")
        if not name or name in out or not isinstance(length, int) or length < 1:
            raise BindingError(f"E_CONFIG: {name or 'a file'} needs a name of its own and a record length")
        if f.get("disposition", "old") not in ("old", "new", "shared", "mod"):
            raise BindingError(f"E_CONFIG: {name}: unknown disposition")
        out[name] = Binding(name, f.get("path", ""), length, f.get("disposition", "old"))
    for name, path in (remap or {}).items():
        if name.upper() not in out:
            raise BindingError(f"E_CONFIG: {name} isn't in the file map")
        old = out[name.upper()]
        out[name.upper()] = Binding(old.name, path, old.record_length, old.disposition)
    return out


def named(pairs: list[str]) -> dict[str, str]:
    """NAME=path pairs."""
    out = {}
    for pair in pairs:
        name, mark, path = pair.partition("=")
        if not (name and mark and path):
            raise BindingError(f"E_CONFIG: {pair} isn't NAME=path")
        out[name.upper()] = path
    return out
