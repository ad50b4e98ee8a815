"""Settings and domain profiles: small documents checked on the driver."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    default_model: str = "local-small"
    extract_model: str = ""
    enrich_model: str = ""
    synthesis_model: str = ""
    embedding_model: str = "nomic-embed-text"
    top_k: int = 20
    min_score: float = 0.02
    rrf_k: int = 2

    def model(self, role: str) -> str:
        """A role without a model of its own falls back to the default, embedding never."""
        return getattr(self, f"{role}_model") or ("" if role == "embedding" else self.default_model)


def load(path: str | None = None, env: dict[str, str] | None = None, prefix: str = "CLAUSEWRIGHT_") -> Settings:
    """Defaults, then the file, then the environment; malformed numbers are ignored."""
    out, kinds = Settings(), {f.name: type(f.default) for f in fields(Settings)}
    given: dict = {}
    if path and Path(path).exists():
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        given |= raw if isinstance(raw, dict) else {}
    for k in kinds:
        if (v := (os.environ if env is None else env).get(prefix + k.upper())) is not None:
            given[k] = v
    for k, v in given.items():
        if k in kinds:
            try:
                out = replace(out, **{k: kinds[k](v)})
            except (TypeError, ValueError):
                continue
    return out


def update(path: str, partial: dict) -> Settings:
    """Merges into the file; an unknown key is an error, a file that is no object starts anew."""
    known = {f.name for f in fields(Settings)}
    if unknown := sorted(set(partial) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    out = replace(load(path, env={}), **partial)
    Path(path).write_text(json.dumps(asdict(out), indent=2), encoding="utf-8")
    os.chmod(path, 0o600)
    return out


_REQUIRED = {"name": str, "description": str, "obligation_verbs": list, "skip_sections": list, "domain_tags": list, "requirement_types": list}
_OPTIONAL = {"version": str, "checklist_guidance": dict, "prompt_notes": str}


def load_profile(name: str, folder: str) -> dict:
    """A profile by name: no path separators; all fields there, of their type, lists not
    empty, no unknown ones, and the name that of the file."""
    if not name or "/" in name or "\\" in name or ".." in name:
        raise ValueError(f"bad profile name: {name!r}")
    path = Path(folder) / f"{name}.json"
    if not path.exists():
        raise ValueError(f"no profile {name!r}")
    p = json.loads(path.read_text(encoding="utf-8"))
    if unknown := sorted(set(p) - set(_REQUIRED) - set(_OPTIONAL)):
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    if missing := sorted(set(_REQUIRED) - set(p)):
        raise ValueError(f"missing fields: {', '.join(missing)}")
    for k, kind in (_REQUIRED | _OPTIONAL).items():
        if k in p and not isinstance(p[k], kind):
            raise ValueError(f"{k} must be {kind.__name__}")
        if k in p and kind is list and (not p[k] or not all(isinstance(x, str) for x in p[k])):
            raise ValueError(f"{k} must be a list of strings, not empty")
    if p["name"] != name:
        raise ValueError(f"profile {name!r} calls itself {p['name']!r}")
    return p
