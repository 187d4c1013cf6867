"""Options: defaults, files over them, the caller's over those; checks."""

from __future__ import annotations

import copy
import json
import os
from functools import cache

# Default options.
DEFAULTS = {
    "ai": {
        "default_provider": "anthropic",
        "defaults": {"max_tokens": 1024, "temperature": 0.3, "timeout": 60, "max_retries": 3, "retry_delay": 1.0},
        "providers": ["anthropic", "openai", "openrouter", "ollama", "lmstudio"],
    },
    "parsing": {
        "common": {"extract_images": True, "clean_text": True, "detect_chapters": True, "min_chapter_length": 100},
        "html": {"timeout": 10, "rate_limit": 0.0, "verify_ssl": True},
        "pdf": {"use_ocr": True, "ocr_language": "eng", "ocr_timeout": 300, "extract_tables": True},
        "epub": {"use_toc": True, "use_spine_fallback": True},
        "docx": {"preserve_formatting": True, "extract_hyperlinks": True, "extract_lists": True},
    },
    "ai_features": {"tagging": {"max_tags": 10}, "summarization": {"max_length": 500, "style": "concise"}},
}


def merged(base: dict, over: dict) -> dict:
    """``base`` with ``over`` put over it, dictionaries within too; neither changes."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load(folder: str | None = None) -> dict:
    """Defaults, then config.json, then config_local.json of a folder. Files that are absent or no JSON objects change nothing."""
    out = copy.deepcopy(DEFAULTS)
    for name in ("config.json", "config_local.json") if folder else ():
        try:
            with open(os.path.join(folder, name)) as f:
                read = json.load(f)
        except (OSError, ValueError):
            continue
        if isinstance(read, dict):
            out = merged(out, read)
    return out


@cache
def cached(folder: str | None = None) -> dict:
    return load(folder)


def options(section: dict, user: dict | None = None) -> dict:
    """A section's options with the caller's over them; None values of the caller don't count."""
    return merged(section, {k: v for k, v in (user or {}).items() if v is not None})


def parsing_options(format_: str | None = None, config: dict | None = None, user: dict | None = None) -> dict:
    parsing = (config or load())["parsing"]
    return options(merged(parsing.get("common", {}), parsing.get(format_ or "", {})), user)


def ai_options(provider: str, config: dict | None = None, user: dict | None = None) -> dict:
    ai = (config or load())["ai"]
    section = ai.get(provider, {})
    return options(merged(merged(ai.get("defaults", {}), section if isinstance(section, dict) else {}), {"ai_provider": provider}), user)


def write_template(path: str) -> str:
    with open(path, "w") as f:
        json.dump(DEFAULTS, f, indent=2)
    return path


def problems(config: dict) -> list[str]:
    """What is wrong with a configuration; nothing if it may be used."""
    out = []
    ai = config.get("ai", {})
    if ai.get("default_provider") not in ai.get("providers", DEFAULTS["ai"]["providers"]):
        out.append(f"unknown provider: {ai.get('default_provider')}")
    d = ai.get("defaults", {})
    for name, low, high in (("max_tokens", 1, 1_000_000), ("temperature", 0, 2), ("timeout", 1, 3600), ("max_retries", 0, 100)):
        if name in d and not (isinstance(d[name], (int, float)) and low <= d[name] <= high):
            out.append(f"{name} must be from {low} to {high}")
    if not isinstance(config.get("parsing", {}), dict):
        out.append("parsing must be an object")
    return out
