"""Quarantined extraction: untrusted text to a typed row through a model seam.

The model is a function of a batch of prompts, run as an Arrow UDF, so a provider (or
the scripted fake below) is injected; None is its refusal. What it returns must be JSON
and hold against the schema; anything else fails the row, and a failed row is flagged,
never guessed. Why it failed is told by places and kinds of fault alone, since an
attacker may steer what the model wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import spotlight
from corvane.functions.lattice import QUARANTINE_DERIVED, UNTRUSTED
from corvane.operators import answers

Provider = Callable[[Sequence[str]], Sequence[str | None]]
INSTRUCTION_FLAG, UNAVAILABLE_FLAG = "quarantine_detected_instruction", "quarantine_unavailable"


def schema_for(fields: Mapping) -> T.StructType:
    """The type of the rows that answers to ``fields`` (a JSON Schema document, or names
    and Python types: scalars, [type] for arrays, dicts for structs) become."""
    return answers.row_type(answers.read(fields))


def scripted(answers: dict[str, str], default: str = "{}") -> Provider:
    """A fake model: the answer of the first key that a prompt contains."""
    return lambda prompts: [next((a for k, a in answers.items() if k in p), default) for p in prompts]


def validated(df: DataFrame, answer: str, schema: Mapping) -> DataFrame:
    """``df`` with extracted (the typed row, or null) and quarantine_reason (null where it holds)."""
    node = answers.read(schema)
    out = df.withColumn("_value", F.try_parse_json(F.col(f"`{answer}`")))
    faults = F.array_join(answers.faults(F.col("_value"), node), "; ")
    reason = F.when(F.col(f"`{answer}`").isNull(), "refused").when(F.col("_value").isNull(), "no json").otherwise(F.nullif(faults, F.lit("")))
    out = out.withColumn("quarantine_reason", reason)
    return out.withColumn("extracted", F.when(F.col("quarantine_reason").isNull(), answers.typed(F.col("_value"), node))).drop("_value")


def extract(
    df: DataFrame, text: str, fields: Mapping, provider: Provider, tier: Column | None = None, nonce: str = "quarantine", model: str = "scripted", name: str = "fields"
) -> DataFrame:
    """``df`` with extracted (the struct, or null), extracted_tier, quarantine_error,
    quarantine_reason and quarantine_note.

    Only untrusted text is accepted; its extraction is quarantine-derived, and the note
    names the schema, the model and the hash of the text read. A null text is asked as none.
    """
    if not model.strip():
        raise ValueError("a note without a model's name attests nothing")

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        return pd.Series(list(provider(prompts.tolist())), dtype="object")

    safe = F.when(tier.isNull() | (tier == UNTRUSTED), F.col(text)).otherwise(F.raise_error(F.lit("only untrusted text goes to quarantine"))) if tier is not None else F.col(text)
    asked = df.withColumn("_answer", ask(spotlight.wrap(safe, spotlight.DELIMIT, F.lit(nonce))))
    out = validated(asked, "_answer", fields)
    good = F.col("quarantine_reason").isNull()
    receipt = F.concat(F.lit(f"declassified via quarantine: schema={name} model={model.strip()} source="), F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return (
        out.withColumn("extracted_tier", F.when(good, QUARANTINE_DERIVED))
        .withColumn("quarantine_error", ~good)
        .withColumn("quarantine_note", F.when(good, receipt))
        .drop("_answer")
    )


def assess(df: DataFrame, text: str, provider: Provider) -> DataFrame:
    """``df`` with quarantine_flags: an instruction was found, or the model was unavailable."""
    out = extract(df, text, {"contains_instruction": bool, "addresses_reader": bool}, provider)
    hit = F.col("extracted.contains_instruction") | F.col("extracted.addresses_reader")
    flags = F.when(F.col("quarantine_error"), F.array(F.lit(UNAVAILABLE_FLAG))).when(hit, F.array(F.lit(INSTRUCTION_FLAG))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("quarantine_flags", flags).drop("extracted", "extracted_tier", "quarantine_reason", "quarantine_note")
