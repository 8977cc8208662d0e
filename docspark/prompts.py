"""From a sentence that describes documents to a model: entities, fields with types, constraints and relationships. Small texts, on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Nouns whose values are of a kind that the noun itself doesn't show.
NOUNS = {
    "integer": ["age", "number", "stock", "floor", "seats", "pages", "votes", "points", "copies", "units", "rank", "visits", "level", "quantity", "year"],
    "number": ["price", "weight", "height", "width", "length", "temperature", "ratio", "distance", "salary", "balance", "total", "discount", "tax", "speed", "latitude", "longitude"],
    "boolean": ["active", "verified", "paid", "open", "visible", "archived", "published", "enabled"],
    "date": ["date", "deadline", "birthday", "arrival", "departure", "expiry", "timestamp"],
    "email": ["email", "mailbox"],
    "url": ["website", "homepage", "link", "url", "webpage"],
    "uuid": ["uuid", "key", "identifier"],
    "array": ["list", "set", "tags", "keywords", "colours", "colors", "ingredients"],
    "object": ["details", "settings", "preferences", "metadata"],
}
#: Words that say a kind outright (`score as decimal`, `text field`).
KIND_WORDS = {
    "text": "string", "word": "string", "phrase": "string", "string": "string", "integer": "integer", "whole": "integer", "decimal": "number", "fraction": "number", "real": "number",
    "boolean": "boolean", "switch": "boolean", "day": "date", "moment": "date", "array": "array", "several": "array", "nested": "object",
}
REQUIRED_WORDS = {"must", "required", "always", "compulsory", "needed"}
UNIQUE_WORDS = {"unique", "distinct", "unrepeated"}
DOMAINS = {
    "user": ["user", "person", "subscriber", "visitor", "employee", "customer"],
    "product": ["product", "gadget", "goods", "stock", "catalogue", "brand"],
    "order": ["order", "basket", "checkout", "delivery", "invoice"],
    "finance": ["bank", "loan", "payment", "ledger", "transfer"],
    "place": ["place", "city", "street", "building", "region"],
    "organisation": ["organisation", "company", "team", "branch", "office"],
    "health": ["patient", "clinic", "doctor", "symptom", "vaccine"],
    "school": ["pupil", "student", "lesson", "exam", "school"],
}
DEFAULTS = {
    "user": {"name": "string", "email": "email", "age": "integer", "createdAt": "date"}, "product": {"name": "string", "description": "string", "price": "number", "quantity": "integer", "sku": "string"},
    "order": {"orderNumber": "string", "customerId": "uuid", "items": "array", "total": "number", "status": "status"}, "general": {"name": "string", "description": "string", "value": "number", "active": "boolean", "createdAt": "date"},
}
STATUSES = ["pending", "processing", "shipped", "delivered"]
ENTITY_MARKS = {"model", "collection", "table", "entity", "type", "class", "schema"}
FIELD_MARKS = {"field", "property", "attribute", "column"}
SMALL_WORDS = set("a an the of for with and or has have contains including that which who to in on at by is are be each every some all new create generate make build store".split())
RELATIONS = [("one_to_many", r"(\w+) (?:has|have|contains?|owns?) (?:many|multiple|several) (\w+)"), ("many_to_one", r"(\w+) belongs? to (?:an? |the )?(\w+)"), ("reference", r"(\w+) (?:references?|links? to|points? to) (?:an? |the )?(\w+)")]

_KIND_OF = {noun: kind for kind, nouns in NOUNS.items() for noun in nouns}


@dataclass
class Analysis:
    prompt: str
    entities: list[str] = field(default_factory=list)
    fields: dict[str, str] = field(default_factory=dict)
    constraints: dict = field(default_factory=dict)
    relationships: list[dict] = field(default_factory=list)
    domain: str = "general"
    confidence: float = 0.0
    model: dict = field(default_factory=dict)


def singular(word: str) -> str:
    if word.endswith("ies"):
        return word[:-3] + "y"
    if re.search(r"(?:ss|x|ch|sh)es$", word):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def camel(text: str) -> str:
    first, *rest = re.split(r"[\s_-]+", text.strip())
    return first[:1].lower() + first[1:] + "".join(w.capitalize() for w in rest)


def type_from_name(name: str) -> str:
    """The kind of a field by its name's words: a question (isOpen) is a boolean, what was done at some time (createdAt, bornOn) a date, otherwise the last noun tells."""
    words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)]
    if not words:
        return "string"
    if len(words) > 1 and words[0] in ("is", "has", "can", "was"):
        return "boolean"
    if len(words) > 1 and words[-1] in ("at", "on", "since", "until"):
        return "date"
    if words[-1] == "id":
        return "uuid"
    if words[0] == "number" and len(words) > 2 and words[1] == "of":
        return "integer"
    return _KIND_OF.get(words[-1]) or _KIND_OF.get(singular(words[-1])) or ("array" if singular(words[-1]) != words[-1] and len(words[-1]) > 4 else "string")


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9_]+", text.lower())


def _field(words: str) -> tuple[str, str] | None:
    """(name, type) of a piece such as `unique email address` or `price`."""
    parts = [w for w in re.findall(r"[A-Za-z_][\w]*", words) if w.lower() not in SMALL_WORDS | REQUIRED_WORDS | UNIQUE_WORDS | {"optional", "as"}]
    told = next((w for w in parts if w.lower() in KIND_WORDS), None)
    names = [w for w in parts if w is not told and w.lower() not in FIELD_MARKS] or parts
    if not names:
        return None
    name = camel(" ".join(names[-2:]) if len(names) > 1 and told is None else names[-1])
    kind = KIND_WORDS[told.lower()] if told else type_from_name(name)
    return (name, kind) if name.isidentifier() else None


def analyze(prompt: str) -> Analysis:
    """Entities, fields, constraints, relationships and domain of a prompt, and the model they make."""
    out = Analysis(prompt)
    words = _words(prompt)
    domain_words = {w: d for d, ws in DOMAINS.items() for w in ws}
    for i, w in enumerate(words):
        after = words[i + 1] if i + 1 < len(words) else ""
        if w in ENTITY_MARKS | {"a", "an"} and after and after not in SMALL_WORDS | ENTITY_MARKS and not after.isdigit():
            out.entities.append(singular(after))
        if singular(w) in domain_words:
            out.entities.append(singular(w))
    out.entities = list(dict.fromkeys(out.entities))
    for sentence in re.split(r"[.!?\n]+", prompt):
        listed = re.search(r"\b(?:with|has|have|contains|including)\b(?! (?:many|multiple|several))(.*)", sentence, re.I)
        pieces = re.split(r",|\band\b", listed[1]) if listed else []
        pieces += re.findall(rf"(\w+) (?:{'|'.join(FIELD_MARKS)})\b", sentence, re.I)
        for found in map(_field, pieces):
            if found:
                out.fields.setdefault(*found)
    out.constraints = _constraints(prompt, words)
    out.relationships = [{"type": kind, "from": singular(a), "to": singular(b)} for kind, pattern in RELATIONS for a, b in re.findall(pattern, prompt.lower())]
    scores = {d: sum(singular(w) in ws for w in words) for d, ws in DOMAINS.items()}
    best = max(scores, key=scores.get)
    out.domain = best if scores[best] else "general"
    out.confidence = min(1.0, 0.3 * bool(out.entities) + 0.3 * bool(out.fields) + 0.2 * (len(out.fields) > 3) + 0.2 * (len(out.entities) > 1))
    out.model = build_model(out)
    return out


def _constraints(prompt: str, words: list[str]) -> dict:
    out: dict = {k: True for k, ws in (("required", REQUIRED_WORDS), ("unique", UNIQUE_WORDS)) if ws & set(words)}
    low = prompt.lower()
    if m := re.search(r"between (\d+) and (\d+)", low):
        out |= {"minimum": int(m[1]), "maximum": int(m[2])}
    if m := re.search(r"\b(?:min(?:imum)?|at least)\D{0,10}(\d+)", low):
        out["minimum"] = int(m[1])
    if m := re.search(r"\b(?:max(?:imum)?|at most)\D{0,10}(\d+)", low):
        out["maximum"] = int(m[1])
    if m := re.search(r"(\d+)\s*(?:characters?|chars?|letters?|digits?)", low):
        out["maxLength"] = int(m[1])
    return out


def property_model(kind: str, constraints: dict | None = None) -> dict:
    c = constraints or {}
    bounds = {k: c[k] for k in ("minimum", "maximum") if k in c}
    return {
        "string": {"type": "string", "minLength": 1, "maxLength": c.get("maxLength", 30)}, "integer": {"type": "integer", "minimum": 0, "maximum": 1000, **bounds}, "number": {"type": "number", "minimum": 0.0, "maximum": 1000.0, **bounds}, "boolean": {"type": "boolean"},
        "date": {"type": "string", "format": "date-time"}, "email": {"type": "string", "format": "email"}, "url": {"type": "string", "format": "uri"}, "uuid": {"type": "string", "format": "uuid"}, "array": {"type": "array", "items": {"type": "string", "maxLength": 12, "minLength": 3}, "minItems": 1, "maxItems": 5},
        "object": {"type": "object", "properties": {"value": {"type": "string"}}, "required": ["value"]}, "status": {"type": "string", "enum": STATUSES},
    }[kind]


def build_model(a: Analysis) -> dict:
    """`_id` and the fields of the prompt, or the domain's usual fields if it names none."""
    fields = a.fields or DEFAULTS.get(a.domain, DEFAULTS["general"])
    properties = {"_id": property_model("uuid"), **{n: property_model(k, a.constraints) for n, k in fields.items()}}
    required = list(properties) if a.constraints.get("required") or not a.fields else ["_id", *list(a.fields)[:1]]
    return {"type": "object", "title": a.entities[0] if a.entities else "document", "properties": properties, "required": sorted(required)}
