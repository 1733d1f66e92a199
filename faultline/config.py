"""Parameters: defaults, bounds, TOML files and their precedence."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path
from zoneinfo import ZoneInfo

from .functions.header import LEVELS
from .functions.redact import check_pattern

MAX_PATTERNS, MAX_PATTERN_BYTES = 32, 1024
RUNTIME_EXIT, USAGE_EXIT = 1, 2


class ConfigError(ValueError):
    """A parameter or file that is refused before anything runs."""

    exit_code = USAGE_EXIT


@dataclass(frozen=True)
class Tuning:
    levels: tuple[str, ...] = ("ERROR",)
    timezone: str = "utc"
    similarity: float = 0.60
    bucket_cap: int = 100
    max_groups: int = 100_000
    event_max_bytes: int = 262_144
    event_max_lines: int = 2_000
    sample_max_bytes: int = 32_768
    sample_budget_bytes: int = 67_108_864
    fast_half_life_secs: int = 10
    baseline_half_life_secs: int = 300
    new_age_secs: int = 60
    increasing_min_age_secs: int = 60
    increasing_ratio: float = 2.0
    increasing_min_rate: float = 5.0
    extra_patterns: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if not self.levels:
            raise ConfigError("levels must not be empty")
        for key, (name, low, high, _) in FIELDS.items():
            if not low <= (value := getattr(self, name)) <= high:
                raise ConfigError(f"{key} must be between {low} and {high}, not {value}")
        if self.baseline_half_life_secs <= self.fast_half_life_secs:
            raise ConfigError("rates.baseline_half_life_secs must be greater than rates.fast_half_life_secs")
        if self.sample_max_bytes > self.sample_budget_bytes:
            raise ConfigError("sample.max_bytes must not exceed sample.budget_bytes")
        if len(self.extra_patterns) > MAX_PATTERNS:
            raise ConfigError(f"redaction.extra_patterns must contain at most {MAX_PATTERNS} patterns")
        for k, pattern in enumerate(self.extra_patterns):
            if not 1 <= len(pattern.encode()) <= MAX_PATTERN_BYTES:
                raise ConfigError(f"redaction.extra_patterns[{k}] must have 1 to {MAX_PATTERN_BYTES} bytes")
            if why := check_pattern(pattern):
                raise ConfigError(f"redaction.extra_patterns[{k}]: {why}")


#: Key in a file: attribute, least and greatest value, type.
FIELDS: dict[str, tuple[str, float, float, type]] = {
    "templates.similarity": ("similarity", 0.50, 1.00, float),
    "templates.bucket_cap": ("bucket_cap", 1, 1000, int),
    "groups.max": ("max_groups", 1, 1_000_000, int),
    "event.max_bytes": ("event_max_bytes", 1, 16_777_216, int),
    "event.max_lines": ("event_max_lines", 1, 100_000, int),
    "sample.max_bytes": ("sample_max_bytes", 1, 1_048_576, int),
    "sample.budget_bytes": ("sample_budget_bytes", 1, 1_073_741_824, int),
    "rates.fast_half_life_secs": ("fast_half_life_secs", 1, 86_400, int),
    "rates.baseline_half_life_secs": ("baseline_half_life_secs", 1, 86_400, int),
    "rates.new_age_secs": ("new_age_secs", 1, 86_400, int),
    "rates.increasing_min_age_secs": ("increasing_min_age_secs", 1, 86_400, int),
    "rates.increasing_ratio": ("increasing_ratio", 1.0, 100.0, float),
    "rates.increasing_min_rate": ("increasing_min_rate", 0.0, 1_000_000.0, float),
}


def parse_level(text: str) -> str:
    if text.upper() not in LEVELS:
        raise ConfigError(f"not a valid level '{text}'")
    return text.upper()


def parse_timezone(text: str) -> str:
    if text.lower() in ("utc", "local"):
        return text.lower()
    try:
        return ZoneInfo(text).key
    except (ValueError, OSError) as error:
        raise ConfigError(f"unknown timezone '{text}'") from error


def parse(text: str) -> Tuning:
    """A configuration file's text.  ``version = 1`` is required and unknown keys are refused."""
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise ConfigError(str(error)) from error
    if type(doc.get("version")) is not int or doc.pop("version") != 1:
        raise ConfigError("expected version = 1")
    out: dict = {}
    if "levels" in doc:
        levels = doc.pop("levels")
        if not isinstance(levels, list) or not levels or not all(isinstance(x, str) for x in levels):
            raise ConfigError("levels must be a non-empty array of strings")
        out["levels"] = tuple(dict.fromkeys(map(parse_level, levels)))
    if "timezone" in doc:
        if not isinstance(zone := doc.pop("timezone"), str):
            raise ConfigError("timezone must be a string")
        out["timezone"] = parse_timezone(zone)
    tables = {key.split(".")[0] for key in FIELDS} | {"redaction"}
    for name, body in doc.items():
        if name not in tables:
            raise ConfigError(f"unknown field '{name}'")
        if not isinstance(body, dict):
            raise ConfigError(f"{name} must be a table")
        for key, value in body.items():
            path = f"{name}.{key}"
            if path == "redaction.extra_patterns":
                if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
                    raise ConfigError(f"{path} must be an array of strings")
                out["extra_patterns"] = tuple(value)
            elif path not in FIELDS:
                raise ConfigError(f"unknown field '{path}'")
            else:
                attribute, _, _, kind = FIELDS[path]
                if isinstance(value, bool) or not isinstance(value, (int, float) if kind is float else int):
                    raise ConfigError(f"{path} must be {'a number' if kind is float else 'an integer'}")
                out[attribute] = kind(value)
    return Tuning(**out)


def discover(candidates: list[Path]) -> Path | None:
    """The first candidate that is a regular file; files are never merged."""
    return next((p for p in candidates if p.is_file()), None)


def load(explicit: Path | None = None, candidates: list[Path] = ()) -> Tuning | None:
    """An explicit file or the first candidate there is.  A broken file is an error, not a reason to look further."""
    path = explicit or discover(list(candidates))
    if path is None:
        return None
    if not path.exists():
        raise ConfigError(f"no such configuration file: {path}")
    if not path.is_file():
        raise ConfigError(f"not a regular file: {path}")
    try:
        return parse(path.read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError) as error:
        raise ConfigError(f"{path} can't be read: {error}") from error


def resolve(file: Tuning | None = None, levels: list[str] = (), timezone: str | None = None) -> Tuning:
    """Command line over file over defaults; the command line sets only levels and the time zone."""
    out = file or Tuning()
    if levels:
        out = replace(out, levels=tuple(dict.fromkeys(map(parse_level, levels))))
    return replace(out, timezone=parse_timezone(timezone)) if timezone else out
