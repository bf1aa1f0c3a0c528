"""Query understanding on the driver: a plan of axis weights, keywords, exclusions and filters from a query's text."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from lodestone.functions.text import EXTENSIONS, STOP_TERMS

# Weights of the visual, meaning and keyword axes by type of query.
PRESETS = {
    "visual": {"V": 0.50, "S": 0.30, "M": 0.20},
    "keyword": {"V": 0.20, "S": 0.30, "M": 0.50},
    "semantic": {"V": 0.20, "S": 0.50, "M": 0.30},
    "balanced": {"V": 0.34, "S": 0.33, "M": 0.33},
}
NEGATION = re.compile(r"\b(?:without|excluding|except|other than|not|no)\s+([\w-]+)", re.I)
# Korean forms of "without", "that isn't", "except" after a noun and its particle.
KOREAN_NEGATION = (
    re.compile(r"(\S+?)(?:이|가|은|는)?\s*없(?:는|어야|이)"),
    re.compile(r"(\S+?)(?:이|가|은|는)?\s*아닌"),
    re.compile(r"(\S+?)(?:을|를)?\s*(?:말고|빼고|제외하고|제외한|제외)"),
    re.compile(r"(\S+?)(?:이|가|은|는)?\s*없이"),
)
ENDS = """,.;:!?"'()[]{}"""
FORMATS = {"psd": "PSD", "png": "PNG", "jpg": "JPG", "jpeg": "JPG"}


@dataclass
class Plan:
    query: str
    query_type: str = "balanced"
    vector_query: str = ""
    negative: str = ""
    keywords: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    filters: dict[str, str] = field(default_factory=dict)


def query_tokens(query: str) -> list[str]:
    """Words of two characters or more without punctuation at their ends, once each: functions.text.query_tokens of one query."""
    return list(dict.fromkeys(w for x in query.lower().split() if len(w := x.strip(ENDS)) >= 2))


def weights(query_type: str, active: list[str], presets: dict[str, dict[str, float]] = PRESETS) -> dict[str, float]:
    """Weights of the active axes, summing to 1; an unknown type is balanced.

    An active structure axis X without weight borrows from the visual one, and has 0.15 if that has none.
    """
    own = dict(presets.get(query_type, presets["balanced"]))
    if "X" in active and not own.get("X"):
        visual = own.get("V", 0.0)
        lent = min(0.15, 0.35 * visual) if visual > 0 else 0.15
        own["X"], own["V"] = lent, max(0.0, visual - lent)
    total = sum(own.get(a, 0.0) for a in active)
    return {a: own.get(a, 0.0) / total if total else 1 / len(active) for a in active}


def _negation(plan: Plan) -> Plan:
    """Takes what the query excludes from the plan's words. Korean nouns before a negation count where the plan excludes
    nothing itself; English words after one always, and they leave the text for the vector with it."""
    korean = list(dict.fromkeys(n for p in KOREAN_NEGATION for n in p.findall(plan.query) if n))
    if korean and not plan.negative and not plan.excluded:
        plan.excluded = korean
    found = [t.lower() for t in NEGATION.findall(plan.query)]
    plan.excluded = list(dict.fromkeys([*plan.excluded, *found]))
    rest = NEGATION.sub(" ", plan.vector_query)
    for p in KOREAN_NEGATION:
        rest = p.sub(" ", rest)
    plan.vector_query = " ".join(rest.split()) or plan.vector_query
    if plan.excluded:
        kept = [k for k in plan.keywords if not any(t.lower() in k.lower() for t in plan.excluded)]
        plan.keywords = kept or plan.keywords
        plan.negative = plan.negative or " ".join(plan.excluded)
    return plan


def _meaningful(token: str) -> bool:
    t = token.lower()
    return len(t) >= 2 and not t.isdigit() and not re.fullmatch(r"v\d+", t) and t not in EXTENSIONS and t not in STOP_TERMS


def _paths(plan: Plan) -> Plan:
    """A query with a slash or an image file's extension is a path, spaces included: its folder is a filter (the whole
    path, if it names no file), its telling words are keywords."""
    query, ext = plan.query.strip(), re.search(r"\.(psd|png|jpg|jpeg)\b", plan.query, re.I)
    if not ("/" in query or "\\" in query or ext):
        return plan
    path = query.replace("\\", "/").strip().strip("\"'`")
    segments = [s for s in path.split("/") if s]
    words = [w for s in segments for w in re.split("[^0-9a-zA-Z가-힣]+", s) if _meaningful(w)]
    plan.keywords = list(dict.fromkeys([*(k.strip() for k in plan.keywords if k.strip()), *words])) or [query]
    folder = ("/".join(segments[:-1]) if ext and len(segments) > 1 else path).strip("/")
    if segments and folder:
        plan.filters.setdefault("folder_path", folder)
    if ext:
        plan.filters.setdefault("format", FORMATS[ext[1].lower()])
    plan.query_type = "keyword"
    return plan


def fallback(query: str) -> Plan:
    """The plan without a language model: balanced, the query as its keyword."""
    return _paths(_negation(Plan(query, vector_query=query, keywords=[query])))


def parse_response(text: str, query: str) -> Plan:
    """A plan from a model's answer: what stands from the first { to the last }; the fallback if that is no object."""
    try:
        got = json.loads(text[text.index("{") : text.rindex("}") + 1])
    except ValueError:
        return fallback(query)
    if not isinstance(got, dict):
        return fallback(query)
    words = lambda k: [str(x) for x in v] if isinstance(v := got.get(k), list) else [str(v)] if v else []
    kind = got.get("query_type")
    plan = Plan(query, kind if kind in PRESETS else "balanced", str(got.get("vector_query") or query), str(got.get("negative_query") or ""), list(dict.fromkeys([*words("keywords"), query])), words("exclude_keywords"))
    if isinstance(got.get("filters"), dict):
        plan.filters = {k: str(v) for k, v in got["filters"].items() if v}
    return _paths(_negation(plan))
