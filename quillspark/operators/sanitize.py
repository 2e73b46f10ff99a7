"""Redaction of secrets, injection phrases and poisoned parameters by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: kind, label, pattern, replacement ($1 is the first group); order is part of the contract. Fixed values.
RULES = [
    ("secret", "openai_sk", r"(?i)\bsk-[a-z0-9_-]{16,}", "[REDACTED_OPENAI_KEY]"),
    ("secret", "github_pat", r"(?i)\b(ghp_|github_pat_)[a-z0-9_]{20,}", "[REDACTED_GITHUB_TOKEN]"),
    ("secret", "aws_access_key", r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_AWS_KEY]"),
    ("secret", "slack_token", r"(?i)\bxox[baprs]-[0-9a-z-]{10,}", "[REDACTED_SLACK_TOKEN]"),
    ("secret", "private_key_block", r"(?s)-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    ("secret", "bearer_token", r"(?i)\bBearer\s+[A-Za-z0-9._\-+/=]{16,}", "Bearer [REDACTED]"),
    ("secret", "assignment_secret", r"""(?i)\b[a-z0-9_]*(?:api[_-]?key|password|secret(?:_access_key)?|token|passwd)\s*[:=]\s*['"]?[^\s'"]{8,}""", "[REDACTED_ASSIGNMENT]"),
    ("ipi", "ignore_previous", r"(?i)\bignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions?\b", "[NEUTRALIZED_IPI]"),
    ("ipi", "system_prompt_override", r"(?i)\b(?:system[_ ]?prompt|developer\s+message)\s*[:=]", "[NEUTRALIZED_IPI]:"),
    ("ipi", "jailbreak_persona", r"(?i)\byou\s+are\s+now\s+(?:DAN|unrestricted|jailbroken)\b", "[NEUTRALIZED_IPI]"),
    ("ipi", "disregard_safety", r"(?i)\b(?:disregard|override)\s+(?:all\s+)?(?:safety|security)\s+(?:rules?|guidelines?|policies?)\b", "[NEUTRALIZED_IPI]"),
    ("ipi", "reveal_system_prompt", r"(?i)\b(?:reveal|show|print|dump)\s+(?:your\s+)?(?:system|hidden)\s+prompt\b", "[NEUTRALIZED_IPI]"),
    ("ipi", "do_not_tell_user", r"(?i)\b(?:do\s+not|don't)\s+(?:tell|inform|mention\s+to)\s+(?:the\s+)?user\b", "[NEUTRALIZED_IPI]"),
    ("poison", "system_prompt_param", r"""(?i)(["']?system[_]?prompt["']?\s*[:=]\s*)(["'][^"']*["']|[^\s,}\]]+)""", "$1[STRIPPED_POISON_PARAM]"),
    ("poison", "is_visible_param", r"""(?i)(["']?is[_]?visible["']?\s*[:=]\s*)(true|false|["'][^"']*["']|[^\s,}\]]+)""", "$1[STRIPPED_POISON_PARAM]"),
    ("poison", "hint_param", r"""(?i)(["']hint["']\s*[:=]\s*)(["'][^"']*["']|[^\s,}\]]+)""", "$1[STRIPPED_POISON_PARAM]"),
    ("poison", "tool_config_param", r"""(?i)(["']?(?:toolConfig|tool_config|hiddenInstructions|hidden_instructions)["']?\s*[:=]\s*)(["'][^"']*["']|[^\s,}\]]+)""", "$1[STRIPPED_POISON_PARAM]"),
]


def chosen(secrets: bool = True, injections: bool = True, poison: bool = True) -> list[tuple[str, str, str, str]]:
    on = {"secret": secrets, "ipi": injections, "poison": poison}
    return [r for r in RULES if on[r[0]]]


def scrub(t: Column, secret_replacement: str | None = None, **kinds: bool) -> Column:
    """The text after all chosen rules, each on what the one before left."""
    for kind, _, pattern, to in chosen(**kinds):
        t = F.regexp_replace(t, pattern, secret_replacement if kind == "secret" and secret_replacement is not None else to)
    return t


#: What a text must contain (in lower case) for a rule to match at all; checked before its pattern.
NEEDS = {
    "openai_sk": ["sk-"], "github_pat": ["ghp_", "github_pat_"], "aws_access_key": ["akia"], "slack_token": ["xox"], "private_key_block": ["private key-----"], "bearer_token": ["bearer"],
    "assignment_secret": ["key", "password", "secret", "token", "passwd"], "ignore_previous": ["ignore"], "system_prompt_override": ["prompt", "developer"], "jailbreak_persona": ["you"],
    "disregard_safety": ["disregard", "override"], "reveal_system_prompt": ["prompt"], "do_not_tell_user": ["user"], "system_prompt_param": ["system"], "is_visible_param": ["visible"], "hint_param": ["hint"],
    "tool_config_param": ["config", "instructions"],
}


def sanitize(df: DataFrame, text: str = "text", secret_replacement: str | None = None, **kinds: bool) -> DataFrame:
    """Add content, findings (kind, label, count of rules that fired), redacted_count, metrics.

    The text is lowered once, and a rule's pattern is tried only where a word that it needs
    is there (no rule's replacement brings in such a word but where its own pattern, or one
    before it, had matched, and then all patterns are tried). Texts are never exploded.
    """
    rules = chosen(**kinds)
    low, step, *rest = tx.free(df, "low", "step", *[f"t{i}" for i in range(len(rules) + 1)], *[f"n{i}" for i in range(len(rules))])
    t, n = rest[: len(rules) + 1], rest[len(rules) + 1 :]
    out = df.withColumn(t[0], F.coalesce(F.col(text), F.lit("")))
    out = tx.once(out, low, F.lower(t[0]))
    changed = F.lit(False)
    for i, (kind, label, pattern, to) in enumerate(rules):
        to = secret_replacement if kind == "secret" and secret_replacement is not None else to
        may = changed
        for word in NEEDS[label]:
            may = may | F.col(low).contains(word)
        hit = may & F.col(t[i]).rlike(pattern)
        value = F.when(hit, F.struct(F.regexp_count(t[i], F.lit(pattern)).alias("n"), F.regexp_replace(t[i], pattern, to).alias("t"))).otherwise(F.struct(F.lit(0).alias("n"), F.col(t[i]).alias("t")))
        out = tx.once(out, step, value).withColumns({n[i]: F.col(step)["n"], t[i + 1]: F.col(step)["t"]}).drop(step, t[i])
        changed = changed | (F.col(n[i]) > 0)
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(lb).alias("label"), F.col(n[i]).cast("long").alias("count")) for i, (k, lb, _, _) in enumerate(rules)])
    out = out.withColumn("content", F.col(t[-1])).withColumn("findings", F.filter(found, lambda x: x["count"] > 0))
    out = out.withColumn("redacted_count", F.aggregate("findings", F.lit(0).cast("long"), lambda s, x: s + x["count"])).withColumn("metrics", tx.metrics(F.col(text), F.col("content")))
    return out.drop(low, *n, t[-1])
