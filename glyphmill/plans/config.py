"""Configuration: three tiers that resolve, on the driver, to the set of rules that enter the plan."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from ..operators.rules import BY_ID, GROUPS, RULES, Context

FORMATS = ("text", "html", "markdown", "json", "xml", "yaml", "toml", "frontmatter")
TEMPLATES = ("handlebars", "mustache", "twig", "jinja", "nunjucks", "liquid", "erb")
#: Bundles and the rules that they switch.
PRESETS = {
    "nbsp": ["*.nbsp_*", "nobr.*"],
    "emdash": ["dash.em*"],
    "endash": ["dash.en_range", "number.en_range", "date.*range", "other.*range*"],
    "triads": ["number.thin_space_triads", "other.split_triads"],
    "units": ["abbr.nbsp_*unit", "abbr.nbsp_volt", "abbr.nbsp_dpi", "nobr.nbsp_celsius", "symbol.fahrenheit"],
    "currency": ["abbr.currency", "abbr.nbsp_money_magnitude", "abbr.nbsp_currency_prefix"],
}
_ON, _OFF = {True, 1, "on", "1", "true", "yes"}, {False, 0, "off", "0", "false", "no"}
DEFAULT_LENGTH, MOST_LENGTH = 30_000, 5_000_000


class ConfigError(ValueError):
    """All that is wrong with a configuration, in one message."""

    def __init__(self, issues: list[str]):
        self.issues = issues
        super().__init__("; ".join(issues))


def truth(value) -> bool | None:
    v = value.lower() if isinstance(value, str) else value
    try:
        return True if v in _ON else False if v in _OFF else None
    except TypeError:
        return None


def selected(pattern: str) -> list[str]:
    """Rule ids that a selector names: an id, a group, or a pattern with up to four stars."""
    if len(pattern) > 64 or pattern.count("*") > 4:
        raise ConfigError([f"selector {pattern!r} is too long or has too many stars"])
    if pattern in GROUPS:
        pattern += ".*"
    regex = re.compile("[a-z0-9_.-]*".join(map(re.escape, pattern.split("*"))) if pattern == "*" else "[a-z0-9_-]*".join(map(re.escape, pattern.split("*"))), re.I)
    return [r.id for r in RULES if regex.fullmatch(r.id)]


@dataclass(frozen=True)
class Config:
    html: bool = False
    entities: bool = False
    format: str = "text"
    template: str | None = None
    fields: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_input_length: int = DEFAULT_LENGTH
    max_processing_ms: int = 0
    presets: bool | dict = True
    rules: dict = field(default_factory=dict)
    render: dict = field(default_factory=dict)
    strict: bool = False

    def __post_init__(self):
        issues = []
        if self.format not in FORMATS:
            issues.append(f"format {self.format!r} is none of {', '.join(FORMATS)}")
        if self.template is not None and self.template not in TEMPLATES:
            issues.append(f"template {self.template!r} is none of {', '.join(TEMPLATES)}")
        if not isinstance(self.max_input_length, int) or not 1 <= self.max_input_length <= MOST_LENGTH:
            issues.append(f"max_input_length must be from 1 to {MOST_LENGTH}")
        if not isinstance(self.max_processing_ms, int) or self.max_processing_ms < 0:
            issues.append("max_processing_ms must be 0 or more")
        for k, v in self.rules.items():
            if k in ("quote.nested", "quote.inch") and truth(v) is not None:
                continue
            try:
                if not selected(k):
                    issues.append(f"no rule is named {k!r}")
            except ConfigError as e:
                issues += e.issues
            if truth(v) is None:
                issues.append(f"rule {k!r} needs a truth value")
        for k in self.presets if isinstance(self.presets, dict) else ():
            if k not in PRESETS:
                issues.append(f"no bundle is named {k!r}")
        for k, v in self.render.items():
            if k not in ("paragraphs", "autolink", "breakline", "nowrap", "hanging", "prefix", "layout"):
                issues.append(f"render has no {k!r}")
        if self.render.get("nowrap", "span") not in ("span", "nobr", False, "nbsp"):
            issues.append("render.nowrap must be span, nobr or nbsp")
        if issues:
            raise ConfigError(issues)

    @classmethod
    def from_json(cls, text: str) -> Config:
        def plain(pairs):
            if bad := {"__proto__", "constructor", "prototype"} & {k for k, _ in pairs}:
                raise ConfigError([f"key {k!r} is not allowed" for k in sorted(bad)])
            return dict(pairs)

        data = json.loads(text, object_pairs_hook=plain)
        if unknown := set(data) - set(cls.__dataclass_fields__):
            raise ConfigError([f"unknown key {k!r}" for k in sorted(unknown)])
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})

    def enabled(self) -> frozenset[str]:
        """Rules of this configuration, in the order of tiers: defaults, bundles, render, then rules in the order given, the wildcard first."""
        if self.presets is False:
            return frozenset()
        on = {r.id: r.default for r in RULES}
        if self.format == "markdown":
            on["text.paragraphs"] = on["text.breakline"] = False
        for k, v in self.presets.items() if isinstance(self.presets, dict) else ():
            for p in PRESETS[k]:
                on.update(dict.fromkeys(selected(p), bool(truth(v))))
        for k, rule in (("paragraphs", "text.paragraphs"), ("autolink", "text.autolink"), ("breakline", "text.breakline")):
            if truth(self.render.get(k)) is not None:
                on[rule] = bool(truth(self.render[k]))
                if k == "autolink":
                    on["text.email"] = on[rule]
        if self.render.get("hanging"):
            on["hanging.quote"] = on["hanging.bracket"] = True
        if self.render.get("nowrap") == "nbsp":
            on["other.nbsp_in_nowrap"] = True
        for k, v in self.rules.items():
            if k in ("quote.inch",):
                continue
            on.update(dict.fromkeys(selected(k), bool(truth(v))))
        html = self.html and self.format in ("text", "html", "markdown", "frontmatter")
        return frozenset(k for k, v in on.items() if v and (html or not BY_ID[k].html_only))

    def context(self) -> Context:
        html = self.html and self.format in ("text", "html", "markdown", "frontmatter")
        return Context(html=html, nowrap=str(self.render.get("nowrap", "span")), prefix=str(self.render.get("prefix", "")), nested=truth(self.rules.get("quote.nested", True)) is not False, inch=truth(self.rules.get("quote.inch", True)) is not False)

    def layout(self) -> str:
        return str(self.render.get("layout") or (self.render.get("hanging") if self.render.get("hanging") in ("style", "class", "both") else "style"))
