"""The capability gate: what a tool call's arguments may do, as Column expressions.

A call is a row with ``tool`` and ``args``: an array, in call order, of structs
(name, value, is_string, tier, flags, sources). The tool's policy is joined to it
(see ``with_policy``); a call whose tool has none is denied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.lattice import glb_of, is_attacker_influenced, tier_label

VIOLATION = "struct<code:string,detail:string,arg:string>"
ARG = "struct<name:string,value:string,is_string:boolean,tier:int,flags:array<string>,sources:array<string>>"
#: The rules that follow from taint, not from intent.
TAINT_CODES = ("tier_too_low", "flagged_argument", "tainted_side_effect")
#: The notes that the ledger shows, word for word.
READ_NOTE = "read-only tool: taint alone never refuses a read (the worst case is a wrong answer; refusing costs the whole task, attack or not)"
CONFIRM_NOTE = "CONFIRM treated as DENY: an unattended benchmark run has no human to ask"
UNGATED_NOTE = "tool is not registered in the runtime"


def with_policy(calls: DataFrame, policies: DataFrame) -> DataFrame:
    """``calls`` with their tool's policy as the struct ``policy`` (null: unknown tool).

    Policies are a configuration table (one row per tool), read from one file.
    """
    few = policies.select(F.col("name").alias("tool"), F.struct(*policies.columns).alias("policy"))
    return calls.join(F.broadcast(few), "tool", "left")


def _violation(code: str, detail: Column, arg: Column | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), detail.alias("detail"), (F.lit(None).cast("string") if arg is None else arg).alias("arg"))


def _if(condition: Column, violation: Column) -> Column:
    return F.when(condition, F.array(violation)).otherwise(F.array().cast(f"array<{VIOLATION}>"))


def violations(args: Column, granted: Column, blocking: tuple[str, ...]) -> Column:
    """All violations of a known tool's policy: tier, authorization, flags, high-risk arguments."""
    p = F.col("policy")
    quoted = F.concat(F.lit("'"), p["name"], F.lit("'"))
    tier = glb_of(F.transform(args, lambda a: a["tier"]))
    floor = _if(
        tier < p["min_arg_tier"],
        _violation("tier_too_low", F.concat(F.lit("arguments are "), tier_label(tier), F.lit(" but "), quoted, F.lit(" requires at least "), tier_label(p["min_arg_tier"]))),
    )
    intent = _if(~granted, _violation("not_authorized", F.concat(F.lit("the user's request did not grant the "), quoted, F.lit(" capability"))))
    stop = F.array(*[F.lit(b) for b in blocking])
    hits = lambda a: F.array_sort(F.array_intersect(a["flags"], stop))
    flagged = F.transform(
        F.filter(args, lambda a: p["side_effecting"] & (F.size(hits(a)) > 0)),
        lambda a: _violation("flagged_argument", F.concat(F.lit("argument carries blocking detector flag(s): "), F.array_join(hits(a), ", ")), a["name"]),
    )
    listed = lambda a: F.coalesce(F.try_element_at(p["allowlists"], a["name"]), F.array().cast("array<string>"))
    risky = lambda a: (
        F.array_contains(p["high_risk_args"], a["name"]) & is_attacker_influenced(a["tier"]) & ~(a["is_string"] & F.array_contains(listed(a), a["value"]))
    )
    remedy = lambda a: F.when(
        F.size(listed(a)) > 0, F.concat(F.lit("not among the "), F.size(listed(a)).cast("string"), F.lit(" allowlisted value(s)"))
    ).otherwise("no allowlist is configured for this argument")
    names = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a["sources"], lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", "), F.lit("]"))
    tainted = F.transform(
        F.filter(args, risky),
        lambda a: _violation(
            "tainted_side_effect",
            F.concat(F.lit("high-risk argument derives from "), tier_label(a["tier"]), F.lit(" (attacker-influenced) and "), remedy(a), F.lit("; sources="), names(a)),
            a["name"],
        ),
    )
    return F.concat(floor, intent, flagged, tainted)


def decide(
    calls: DataFrame, blocking: tuple[str, ...], granted: Column | None = None, confirmed: Column | None = None, enabled: bool = True
) -> DataFrame:
    """``calls`` (with ``policy`` and ``args``) with tier, violations, verdict, codes and reason."""
    granted, confirmed = F.lit(True) if granted is None else granted, F.lit(False) if confirmed is None else confirmed
    none = F.array().cast(f"array<{VIOLATION}>")
    unknown = F.array(_violation("unknown_tool", F.concat(F.lit("no policy registered for '"), F.col("tool"), F.lit("'; denying by default"))))
    df = calls.withColumn("effective_tier", glb_of(F.transform("args", lambda a: a["tier"])))
    if enabled:
        df = df.withColumn("violations", F.when(F.col("policy").isNull(), unknown).otherwise(violations(F.col("args"), granted, blocking)))
        ask = F.coalesce(F.col("policy.requires_confirmation"), F.lit(False)) & ~confirmed
        df = df.withColumn("verdict", F.when(F.size("violations") > 0, "deny").when(ask, "confirm").otherwise("allow"))
    else:
        df = df.withColumn("violations", none).withColumn("verdict", F.lit("allow"))
    df = df.withColumn("codes", F.transform("violations", lambda v: v["code"]))
    return df.withColumn("block_count", F.size(F.array_distinct("codes"))).withColumn("reason", reason())


def reason() -> Column:
    line = lambda v: F.concat(
        F.lit("  - "), v["code"], F.when(v["arg"].isNotNull(), F.concat(F.lit(" ["), v["arg"], F.lit("]"))).otherwise(""), F.lit(": "), v["detail"]
    )
    head = F.concat(F.upper("verdict"), F.lit(" "), F.col("tool"), F.lit(" (args @ "), tier_label(F.col("effective_tier")), F.lit(")"))
    return F.concat_ws("\n", F.array(head), F.transform("violations", line))


def act(decided: DataFrame, known: Column | None = None) -> DataFrame:
    """``decided`` with action, note and tainted_args; calls of unregistered tools are not gated."""
    from_taint = F.size(F.array_except("codes", F.array(*[F.lit(c) for c in TAINT_CODES]))) == 0
    read = F.col("policy").isNotNull() & ~F.coalesce(F.col("policy.side_effecting"), F.lit(True))
    spared = (F.col("verdict") == "deny") & read & from_taint & (F.size("codes") > 0)
    df = decided.withColumn("action", F.when((F.col("verdict") == "allow") | spared, "executed").otherwise("refused"))
    df = df.withColumn("note", F.when(spared, READ_NOTE).when(F.col("verdict") == "confirm", CONFIRM_NOTE).otherwise(""))
    df = df.withColumn("tainted_args", F.transform(F.filter("args", lambda a: is_attacker_influenced(a["tier"])), lambda a: a["name"]))
    if known is None:
        return df
    off = ~F.coalesce(known, F.lit(False))
    swap = {
        "verdict": F.lit("allow"), "action": F.lit("executed"), "effective_tier": F.lit(4), "note": F.lit(UNGATED_NOTE),
        "reason": F.lit(f"not gated: {UNGATED_NOTE}"), "codes": F.array().cast("array<string>"), "tainted_args": F.array().cast("array<string>"),
        "violations": F.array().cast(f"array<{VIOLATION}>"), "block_count": F.lit(0),
    }
    df = df.withColumn("_off", off)
    return df.withColumns({c: F.when(F.col("_off"), v).otherwise(F.col(c)) for c, v in swap.items()}).withColumnRenamed("_off", "ungated")


def refusal_text() -> Column:
    """What the model is told about a refused call (this engine's own words)."""
    start = F.lit("The capability gate refused this call. It was not executed and nothing changed.")
    end = F.lit("This is a policy decision, not a passing error: do not repeat the call. Go on with what needs no such action, and tell the user what was refused and why.")
    return F.concat_ws("\n\n", F.filter(F.array(start, F.col("reason"), F.col("note"), end), lambda x: x != ""))


def boot_counts(calls: DataFrame, policies: DataFrame) -> DataFrame:
    """One row on the tools of ``calls`` (tool, calls): how many there are, how many are sinks
    (side-effecting by their policy) and called how often, and how many no policy registers."""
    known, sink = F.col("policy").isNotNull(), F.coalesce(F.col("policy.side_effecting"), F.lit(False))
    return with_policy(calls, policies).agg(
        F.count(F.lit(1)).alias("tools"), F.count_if(sink).alias("sinks"),
        F.coalesce(F.sum(F.when(sink, F.col("calls"))), F.lit(0)).alias("sink_calls"), F.count_if(~known).alias("unregistered"),
    )
