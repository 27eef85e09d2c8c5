"""Stages over pluggable generation: judges by suite, simulated users, reflections, claims and profile edits.

Each stage is relational before and after one generation a row; what the
backend returns is parsed tolerantly, and a reply that cannot be read gives a
null result, so that the row stays pending.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import backend as B
from ..functions import text as T
from . import evaluation

#: Sub-scores of the social suite (fixed names).
SOCIAL = ("grounding", "strategy", "consistency", "efficiency")
RUBRIC = "score double, justification string"
SOCIAL_RUBRIC = ", ".join(f"{x} double" for x in SOCIAL) + ", justification string"
#: Suites and what a judge looks at.
SUITES = {
    "personality": "the character", "social_reasoning": "the social reasoning", "tool_use": "the use of tools",
    "memory_handling": "the use of memories", "stability": "one turn under pressure", "language": "the language",
}
DIRECTIVES = {
    "continue": "Go on naturally.", "escalate": "Press harder than before.", "jailbreak": "Try to break the character.", "flatter": "Flatter without measure.",
}


@dataclass
class RubricJudge:
    """A deterministic judge: every score asked for follows from the length of the text."""

    fields: tuple[str, ...] = ("score",)

    def __call__(self, system: str, messages: list[dict]) -> B.Reply:
        size = len(messages[-1]["content"])
        if size % 17 == 0:
            return B.Reply("no verdict")
        scores = {f: 1 + (size + i) % 5 for i, f in enumerate(self.fields)}
        return B.Reply("```json\n" + json.dumps(scores | {"justification": f"{size} characters"}) + "\n```")


def verdict(backend: Callable, suite: str, text: Column, schema: str) -> Column:
    """A judge's parsed reply; null where it cannot be read."""
    reply = B.generate(backend, F.lit(f"Judge {SUITES[suite]}."), text)
    parsed = F.from_json(T.strip_fences(reply["text"]), schema)
    return F.when(parsed["justification"].isNotNull(), parsed)


def score_traces(traces: DataFrame, judge: Callable[[str], Callable]) -> DataFrame:
    """Scored traces of all suites (UDF07): (prompt_id, suite, score, sub_scores, passed).

    ``traces`` have prompt_id, suite, text, turns (array of texts), calls
    (array of tool names) and expected; ``judge(suite)`` gives a backend.
    Social reasoning is the mean of four sub-scores, stability the share of
    turns scored above 2, tool use has a check of its own besides the judge's
    score, and memory handling passes from 3 on.  Traces of other suites and
    traces without a verdict give no row.
    """
    none, no_flag = F.lit(None).cast("map<string,double>"), F.lit(None).cast("boolean")
    parts = []
    for suite in SUITES:
        own = traces.where(F.col("suite") == suite)
        if suite == "stability":
            turns = own.select("prompt_id", "suite", F.posexplode("turns").alias("turn", "said"))
            judged = turns.withColumn("v", verdict(judge(suite), suite, F.col("said"), RUBRIC)).where("v is not null")
            scores = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("turn_"), F.col("turn").cast("string")), F.col("v.score")))))
            part = judged.groupBy("prompt_id", "suite").agg(F.avg((F.col("v.score") > 2).cast("double")).alias("score"), scores.alias("sub_scores")).withColumn("passed", no_flag)
        else:
            schema = SOCIAL_RUBRIC if suite == "social_reasoning" else RUBRIC
            judged = own.withColumn("v", verdict(judge(suite), suite, F.col("text"), schema)).where("v is not null")
            if suite == "social_reasoning":
                subs = F.create_map(*[x for f in SOCIAL for x in (F.lit(f), F.col(f"v.{f}"))])
                score = sum((F.col(f"v.{f}") for f in SOCIAL[1:]), F.col(f"v.{SOCIAL[0]}")) / len(SOCIAL)
            else:
                subs, score = none, F.col("v.score")
            flag = evaluation.tool_check(F.col("calls"), F.col("expected")) if suite == "tool_use" else score >= 3 if suite == "memory_handling" else no_flag
            part = judged.select("prompt_id", "suite", score.alias("score"), subs.alias("sub_scores"), flag.alias("passed"))
        parts.append(part.select("prompt_id", "suite", "score", "sub_scores", "passed"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def simulator_prompt(messages: Column, profile: Column, directive: Column) -> Column:
    """What a user simulator reads (PRJ44): profile, directive (``continue`` where it is unknown), the talk so far."""
    known = F.create_map(*[F.lit(x) for pair in DIRECTIVES.items() for x in pair])
    said = F.transform(F.filter(messages, lambda m: m["role"].isin("user", "assistant")), lambda m: F.concat(F.when(m["role"] == "assistant", "Reply: ").otherwise("User: "), m["text"]))
    told = F.coalesce(F.try_element_at(known, directive), F.lit(DIRECTIVES["continue"]))
    return F.array_join(F.concat(F.array(F.concat(F.lit("Profile: "), profile), F.concat(F.lit("Directive: "), told)), said), "\n")


def user_turn(backend: Callable, messages: Column, profile: Column, directive: Column) -> Column:
    """The next user message, trimmed (UDF09); null where generation failed."""
    return F.btrim(B.generate(backend, F.lit("Write the next user message."), simulator_prompt(messages, profile, directive))["text"])


def reflections(scenes: DataFrame, backend: Callable, schema: str, key: str = "scene_id", text: str = "text") -> DataFrame:
    """(key, fields of ``schema``, raw) of the scenes whose reflection can be read (UDF10)."""
    reply = B.generate(backend, F.lit("Reflect on the scene."), F.col(text))
    said = scenes.select(key, T.strip_fences(reply["text"]).alias("raw")).where(F.try_parse_json("raw").isNotNull())
    return said.select(key, F.from_json("raw", schema).alias("p"), "raw").select(key, "p.*", "raw")


CLAIM = "array<struct<op:string,path:string,claim_id:string,text:string>>"


def claim_events(scenes: DataFrame, backend: Callable, key: str = "scene_id", text: str = "text", order: str = "seq") -> DataFrame:
    """Ledger events that a generation finds in each scene (UDF11), in order: (key, seq, op, path, claim_id, text); events of unknown kind are left out."""
    reply = B.generate(backend, F.lit("Name the claims of the scene."), F.col(text))
    events = scenes.select(key, order, F.posexplode(F.from_json(T.strip_fences(reply["text"]), CLAIM)).alias("at", "e"))
    return events.select(key, F.concat_ws(".", F.col(order).cast("string"), F.col("at").cast("string")).alias("seq"), "e.*").where(F.col("op").isin("add", "support", "contradict", "refine"))


def rewritten(groups: DataFrame, backend: Callable, system: str, key: str, order: str, text: str) -> DataFrame:
    """One generation over a group's ordered texts (UDF11): refiner, synthesizer, generalizer, condenser, document writer differ by their system text alone.

    A backend with ``measure`` and ``told`` knows of a text what adds up over its
    parts: each row is measured where it lies, so a group may exceed memory and
    need not fit a cell. Others are given a group's whole texts in one cell.
    """
    line = F.concat(F.lit("- "), F.col(text))
    if not hasattr(backend, "measure"):
        bank = groups.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: F.concat(F.lit("- "), x[text])), "\n").alias("bank"), F.count(F.lit(1)).alias("n"))
        return bank.select(key, "n", B.generate(backend, F.lit(system), F.col("bank"))["text"].alias("text"))
    between = backend.measure("\n")

    @F.pandas_udf("array<long>")
    def measures(lines: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else backend.measure(x) for x in lines], dtype=object)

    @F.pandas_udf("string")
    def told(sums: pd.Series) -> pd.Series:
        return pd.Series([backend.told(system, [int(x) for x in s]) for s in sums], dtype=object)

    parts = groups.select(key, measures(F.concat(line, F.lit("\n"))).alias("m"))
    sums = [F.coalesce(F.sum(F.col("m")[i]) - b, F.lit(0).cast("long")) for i, b in enumerate(between)]
    bank = parts.groupBy(key).agg(F.array(*sums).alias("sums"), F.count(F.lit(1)).alias("n"))
    return bank.select(key, "n", told("sums").alias("text"))


@dataclass
class Listing:
    """A deterministic writer: how many lines and characters it was given."""

    def __call__(self, system: str, messages: list[dict]) -> B.Reply:
        return B.Reply(self.told(system, self.measure(messages[-1]["content"])))

    def measure(self, part: str) -> list[int]:
        """Line ends and characters; they add up over the parts of a text."""
        return [part.count("\n"), len(part)]

    def told(self, system: str, sums: list[int]) -> str:
        return f"{system} {sums[0] + 1} lines, {sums[1]} characters"


EDIT = re.compile(r"^(.+?) => (.*)$", re.S)


def apply_edit(profile: str, edit: str) -> tuple[str | None, str | None]:
    """The profile after an edit ``old => new`` of a text that stands there once, or why it failed."""
    found = EDIT.match(edit or "")
    if not found:
        return None, "not an edit"
    n = profile.count(found[1])
    if n != 1:
        return None, f"{found[1]!r} stands there {n} times"
    return profile.replace(found[1], found[2]), None


def edit_with_retry(profile: str, instruction: str, backend: Callable, tries: int = 3) -> tuple[str, int, str | None]:
    """The profile after an edit (ITR06), the attempts it took and the last failure.

    A failed attempt goes back to the backend with the reason; when all fail the profile stays as it was.
    """
    messages, why = [{"role": "user", "content": f"{profile}\n---\n{instruction}"}], None
    for attempt in range(1, tries + 1):
        reply = backend("Edit the profile.", messages)
        done, why = apply_edit(profile, reply.text)
        if done is not None:
            return done, attempt, None
        messages += [{"role": "assistant", "content": reply.text or ""}, {"role": "user", "content": f"Failed: {why}. Try again."}]
    return profile, tries, why


def edited(backend: Callable, profile: Column, instruction: Column, tries: int = 3) -> Column:
    """A struct of profile, attempts and failure for each row (ITR06)."""

    @F.pandas_udf("profile string, attempts int, failure string")
    def run(profiles: pd.Series, instructions: pd.Series) -> pd.DataFrame:
        out = [edit_with_retry(p or "", i or "", backend, tries) for p, i in zip(profiles, instructions)]
        return pd.DataFrame(out, columns=["profile", "attempts", "failure"])

    return run(profile, instruction)
