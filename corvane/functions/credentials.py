"""Which settings look like a real tool's credential; values are judged, never returned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How tokens of tools begin, and who issues them.
TOOL_PREFIXES = (
    ("github_pat_", "GitHub"), ("ghp_", "GitHub"), ("gho_", "GitHub"), ("ghu_", "GitHub"), ("ghs_", "GitHub"), ("glpat-", "GitLab"),
    ("AKIA", "AWS"), ("ASIA", "AWS"), ("xoxb-", "Slack"), ("xoxp-", "Slack"), ("xoxa-", "Slack"), ("xapp-", "Slack"),
    ("ya29.", "Google OAuth"), ("SG.", "SendGrid"), ("shpat_", "Shopify"),
)
#: How keys of model providers begin.
MODEL_PREFIXES = (("sk-ant-", "Anthropic"), ("sk-", "OpenAI-compatible"), ("gsk_", "Groq"), ("nvapi-", "NVIDIA"), ("AIza", "Google AI Studio"))
#: Names that model providers' keys may have.
MODEL_NAMES = (
    "ANTHROPIC_API_KEY",
    "DEEPSEEK_API_KEY",
    "FIREWORKS_API_KEY",
    "GEMINI_API_KEY",
    "GOOGLE_API_KEY",
    "GROQ_API_KEY",
    "MISTRAL_API_KEY",
    "NVIDIA_API_KEY",
    "OPENAI_API_KEY",
    "OPENROUTER_API_KEY",
    "TOGETHER_API_KEY",
    "XAI_API_KEY",
)
#: Fixed value: how a name is shaped that holds a credential.
NAME_SHAPE = "(?:^|_)(?:API|SECRET|TOKEN|PASSWORD|PASSWD|CREDENTIALS?|KEY)$"


def issuer(value: Column, prefixes: tuple[tuple[str, str], ...]) -> Column:
    """The issuer of the first prefix that ``value`` has, or null."""
    out = F.lit(None).cast("string")
    for prefix, name in reversed(prefixes):
        out = F.when(value.startswith(prefix), name).otherwise(out)
    return out


def finding(name: Column, value: Column, model_names: tuple[str, ...] = MODEL_NAMES, ignored: tuple[str, ...] = ()) -> Column:
    """struct(kind, issuer) of a setting that is shaped like a credential, else null.

    A tool's prefix counts under any name; a model's key only under a name that no
    provider has; other values only if the name is shaped like a credential's.
    """
    value = F.regexp_replace(value, "(?U)^\\s+|\\s+$", "")
    tool, model = issuer(value, TOOL_PREFIXES), issuer(value, MODEL_PREFIXES)
    found = lambda kind, who: F.struct(F.lit(kind).alias("kind"), who.alias("issuer"))
    blank = F.coalesce(F.length(value), F.lit(0)) == 0
    out = F.when(blank | name.isin(*ignored, ""), None).when(tool.isNotNull(), found("value-prefix", tool)).when(name.isin(*model_names), None)
    return out.when(model.isNotNull(), found("value-prefix", model)).when(F.upper(name).rlike(NAME_SHAPE), found("name-shape", F.lit("")))
