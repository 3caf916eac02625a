"""Rule sets: the configuration that filtering, scoring and tailoring read.

A rule set is small, ordered and typed. It is folded into column expressions on the driver; only the
bullet pool may also come from a table (see ``operators.tailoring``).
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field


# Words and patterns every rule set starts from.
TARGET_ROLE = r"software|sde|backend|back.?end|full.?stack|engineer|forward deployed|fde"
COMBOS = ((("rest", "api"), 2),)
ROLE_WORDS = ((r"backend|back-end", 1), (r"full-stack|fullstack|full stack", 1))
LEVEL_PATTERN = r"(ii|iii|2|3)\b"
LEVEL_WORDS = ("senior", "sr.")
FULL_STACK = r"full-stack|fullstack|full stack"
FULL_STACK_BULLET = ("frontend", "react", "angular", "full-stack")
BACKEND_TITLE = ("backend", "back-end")
BACKEND_BULLET = ("backend", "service", "api")


@dataclass(frozen=True)
class CompanyPool:
    """One employer's bullets, in order, and how many of them a document may show."""

    name: str
    cap: int
    bullets: tuple[str, ...]
    min_lines: int = 0
    max_lines: int = 999


@dataclass(frozen=True)
class SkillRule:
    """A change to a skill line, made where the description has one of ``words`` and none of ``unless``.

    The skill goes to ``place`` (the end without one), if all skills of ``beside`` are on the line and the
    skill itself is there already (``moves``) or is not (else).
    """

    line: str
    words: tuple[str, ...]
    skill: str
    place: int | None = None
    unless: tuple[str, ...] = ()
    beside: tuple[str, ...] = ()
    moves: bool = False


# The skill rules every rule set starts from.
SKILL_RULES = (
    SkillRule("languages", ("java",), "Java", 0, unless=("go ", "golang"), beside=("Go",), moves=True),
    SkillRule("frameworks", ("grpc", "protobuf"), "gRPC", 1),
    SkillRule("misc", ("kafka",), "Kafka"),
)


@dataclass(frozen=True)
class Rules:
    keywords: tuple[tuple[str, int], ...] = ()
    combos: tuple[tuple[tuple[str, str], int], ...] = COMBOS
    role_words: tuple[tuple[str, int], ...] = ROLE_WORDS
    level_pattern: str = LEVEL_PATTERN
    level_words: tuple[str, ...] = LEVEL_WORDS
    level_points: int = 2
    top_companies: tuple[str, ...] = ()
    company_points: int = 2
    strong: int = 13
    match: int = 7
    exclude_companies: tuple[str, ...] = ()
    exclude_descriptions: tuple[str, ...] = ()
    exclude_titles: tuple[str, ...] = ()
    exclude_roles: tuple[str, ...] = ()
    target_role: str = TARGET_ROLE
    pool: tuple[CompanyPool, ...] = ()
    pairs: tuple[tuple[str, str], ...] = ()
    languages: str = ""
    frameworks: str = ""
    misc: str = ""
    full_stack: str = FULL_STACK
    full_stack_bullet: tuple[str, ...] = FULL_STACK_BULLET
    backend_title: tuple[str, ...] = BACKEND_TITLE
    backend_bullet: tuple[str, ...] = BACKEND_BULLET
    skills: tuple[SkillRule, ...] = SKILL_RULES
    extra: Mapping[str, object] = field(default_factory=dict)


def rules_from_config(config: Mapping) -> Rules:
    """Typed rules from the JSON configuration layout (object order is kept)."""
    scoring, filters = config["scoring"], config["filters"]
    skills = config.get("skills_template", {})
    pool = tuple(
        CompanyPool(
            name=entry.get("display_name", key),
            cap=entry["bullet_limit"],
            bullets=tuple(entry["bullets"]),
        )
        for key, entry in config.get("experience", {}).items()
    )
    return Rules(
        keywords=tuple(scoring["tech_keywords"].items()),
        top_companies=tuple(scoring["top_companies"]),
        strong=scoring["tier_thresholds"]["strong"],
        match=scoring["tier_thresholds"]["match"],
        exclude_companies=tuple(filters["exclude_companies_containing"]),
        exclude_descriptions=tuple(filters.get("exclude_description_patterns", ())),
        exclude_titles=tuple(filters["exclude_title_keywords"]),
        exclude_roles=tuple(filters["exclude_role_keywords"]),
        pool=pool,
        pairs=tuple((posting, bullet) for posting, bullet in config.get("bullet_keyword_pairs", ())),
        languages=skills.get("languages", ""),
        frameworks=skills.get("frameworks", ""),
        misc=skills.get("misc", ""),
        skills=tuple(
            SkillRule(**{key: tuple(value) if isinstance(value, list) else value for key, value in rule.items()})
            for rule in config["skill_rules"]
        ) if "skill_rules" in config else SKILL_RULES,
    )


def load_rules(path: str) -> Rules:
    """Read a JSON rule file from the driver's file system."""
    with open(path, encoding="utf-8") as handle:
        return rules_from_config(json.load(handle))
