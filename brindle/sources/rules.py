"""Rule packs of the text guard: rows, loading from JSON or YAML, overlays and checks."""

from __future__ import annotations

import json
import math
import re
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

KINDS = ("plain", "quote", "code", "config")
VIEWS = ("raw", "norm", "joined", "aggregate_norm", "aggregate_joined")


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str = ""
    phrases: tuple[str, ...] = ()
    family: str = ""
    action: str = "score"
    view: str = "aggregate_norm"
    segments: tuple[str, ...] = ()
    weight: float = 0.0
    exclude: tuple[str, ...] = ()
    max_occurrences: int = 1
    sentence_break: int = 0
    match_mode: str = "token"  # of phrases: token stands alone, substring anywhere
    literals: tuple[str, ...] = field(default=())  # one of them is in every text that matches


@dataclass(frozen=True)
class Policy:
    review_threshold: float = 0.55
    block_threshold: float = 1.0
    min_block_families: int = 2
    segment_multipliers: tuple[tuple[str, float], ...] = ()
    view_multipliers: tuple[tuple[str, float], ...] = ()


def filled(rule: Rule) -> Rule:
    """The rule with its defaults: the family is the id; a block rule weighs 1 and looks at plain text, a score rule at all kinds."""
    segments = rule.segments or (("plain",) if rule.action == "block" else KINDS)
    weight = 1.0 if rule.action == "block" and rule.weight == 0 else rule.weight
    return replace(rule, family=rule.family or rule.id, segments=segments, weight=weight)


def problems(rules: list[Rule], policy: Policy) -> list[str]:
    """What is wrong with a pack; empty if nothing."""
    out, seen = [], set()
    for r in rules:
        if not re.fullmatch(r"[a-z0-9_]+", r.id):
            out.append(f"{r.id}: bad id")
        if r.id in seen:
            out.append(f"{r.id}: duplicate id")
        seen.add(r.id)
        if bool(r.pattern) == bool(r.phrases):
            out.append(f"{r.id}: needs a pattern or phrases")
        if r.action not in ("score", "block") or r.view not in VIEWS or not set(r.segments) <= set(KINDS):
            out.append(f"{r.id}: unknown action, view or segment")
        if r.match_mode not in ("token", "substring"):
            out.append(f"{r.id}: unknown match mode")
        if generic := [p for p in r.phrases if len(re.findall(r"\w+", p)) < 2 and len(p) < 12]:
            out.append(f"{r.id}: phrases too generic: {generic}")
        if not math.isfinite(r.weight) or r.weight < 0 or not 1 <= r.max_occurrences <= 64:
            out.append(f"{r.id}: bad weight or occurrences")
        for p in (r.pattern, *r.exclude):
            try:
                re.compile(p)
            except re.error as e:
                out.append(f"{r.id}: {e}")
            if "\\\\" in p:
                out.append(f"{r.id}: doubled escape")
    if not (math.isfinite(policy.block_threshold) and 0 < policy.review_threshold <= policy.block_threshold):
        out.append("policy: bad thresholds")
    return out


def overlay(base: list[Rule], more: list[Rule]) -> list[Rule]:
    """Both packs' rules by id; an id in both is an error."""
    both = {r.id for r in base} & {r.id for r in more}
    if both:
        raise ValueError(f"duplicate rule ids: {sorted(both)}")
    return sorted([*base, *more], key=lambda r: r.id)


def load(folder: str) -> tuple[list[Rule], Policy]:
    """The pack in a folder's .json, .yml and .yaml files, in order of name: one policy, any rules; unknown members are errors."""
    rules, policies = [], []
    root = Path(folder).resolve()
    for path in sorted(root.rglob("*")):
        if path.suffix not in (".json", ".yml", ".yaml"):
            continue
        if path.is_symlink() or root not in path.resolve().parents:
            raise ValueError(f"{path} leaves the folder")
        if path.suffix == ".json":
            doc = json.loads(path.read_text())
        else:
            import yaml

            doc = yaml.safe_load(path.read_text())
        if extra := set(doc) - {"version", "kind", "rules", "policy"}:
            raise ValueError(f"{path.name}: unknown members {sorted(extra)}")
        rules += [filled(Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items()})) for r in doc.get("rules", ())]
        if "policy" in doc:
            p = dict(doc["policy"])
            p.setdefault("review_threshold", min(Policy.review_threshold, 0.75 * p["block_threshold"]) if "block_threshold" in p else Policy.review_threshold)
            for k in ("segment_multipliers", "view_multipliers"):
                p[k] = tuple(sorted(p.get(k, {}).items()))
            policies.append(Policy(**p))
    if len(policies) > 1:
        raise ValueError("more than one policy")
    policy = policies[0] if policies else Policy()
    if bad := problems(rules, policy):
        raise ValueError("; ".join(bad))
    return sorted(rules, key=lambda r: r.id), policy


def digest(rules: list[Rule], policy: Policy) -> str:
    """sha256 of the pack in canonical JSON."""
    import hashlib

    return hashlib.sha256(json.dumps([[asdict(r) for r in sorted(rules, key=lambda r: r.id)], asdict(policy)], sort_keys=True).encode()).hexdigest()


_ALL = KINDS
#: Up to four words; a sentence's end, which is masked with more marks, is no gap.
_GAP = r"\W{1,12}(?:\w+\W{1,12}){0,4}?"
#: The pack that comes with the library.
RULES = [
    filled(r)
    for r in (
        Rule("override_en", rf"\b(?:ignore|disregard|forget|bypass|override){_GAP}(?:previous|prior|above|earlier){_GAP}(?:instruction|rule|prompt|polic)", family="override", action="block", view="aggregate_norm", segments=_ALL, exclude=(r"\b(?:firewall|lint|spam|cache|routing|grammar)\W+rules?\b", r"\bmy\W+(?:previous|prior|earlier)\b"), sentence_break=24, literals=("ignore", "disregard", "forget", "bypass", "override")),
        Rule("override_joined_en", r"(?:ignore|disregard|forget)(?:all|any|the|of){0,3}(?:previous|prior)(?:instruction|rule|prompt)", family="override", action="block", view="aggregate_joined", segments=_ALL, literals=("ignore", "disregard", "forget")),
        Rule("exfil_prompt_en", rf"\b(?:show|print|reveal|repeat|output){_GAP}(?:system|hidden|developer|internal)\W+(?:prompt|message|instruction)", family="prompt_exfil", action="block", view="aggregate_norm", segments=_ALL, sentence_break=24, literals=("show", "print", "reveal", "repeat", "output")),
        Rule("exfil_secret_en", rf"\b(?:show|print|reveal|dump|send){_GAP}(?:api[ _-]?key|access[ _-]?token|password|credential)", family="secret_exfil", action="block", view="aggregate_norm", segments=_ALL, exclude=(r"\bhow\W+to\W+reset\b",), sentence_break=28, literals=("show", "print", "reveal", "dump", "send")),
        Rule("role_play_en", rf"\b(?:you are now|act as|pretend to be){_GAP}(?:unrestricted|jailbroken|without (?:rules|limits))", family="role", weight=0.6, view="norm", literals=("you are now", "act as", "pretend")),
        Rule("mode_switch_en", r"\b(?:developer|debug|god|dan)\W+mode\W+(?:on|enabled|activated)\b", family="mode", weight=0.5, view="norm", literals=("mode",)),
        Rule("tool_abuse_en", rf"\b(?:run|execute|call){_GAP}(?:shell|tool|function){_GAP}(?:silently|without asking)", family="tool", weight=0.5, view="norm", literals=("silently", "without asking")),
        Rule("role_tag", r"<\s*/?\s*(?:system|developer)\s*>", family="role_tag", weight=0.5, view="raw", literals=("system", "developer")),
        Rule("override_ko", r"(?:이전|앞선|위의)\s*(?:지시|규칙|명령)[^.]{0,12}(?:무시|잊어)", family="override", action="block", view="norm", segments=_ALL, literals=("무시", "잊어")),
        Rule("exfil_ko", r"(?:시스템|숨겨진|내부)\s*(?:프롬프트|지시)[^.]{0,12}(?:보여|출력|공개)", family="prompt_exfil", action="block", view="norm", segments=_ALL, literals=("프롬프트", "지시")),
        Rule("override_ja", r"(?:以前|これまで)の(?:指示|命令)[^。]{0,8}(?:無視|忘れ)", family="override", action="block", view="norm", segments=_ALL, literals=("無視", "忘れ")),
        Rule("phrases_en", phrases=("do anything now", "no restrictions apply", "jailbreak prompt"), family="jailbreak", weight=0.6, view="norm", literals=("do anything now", "no restrictions apply", "jailbreak prompt")),
    )
]
POLICY = Policy(min_block_families=2)
