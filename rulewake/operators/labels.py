"""Labels from an injected service: prompts out, JSON in, each row checked and failures kept apart.

A labeler is any function from a list of prompts to a list of answers of the same length; a text answer is JSON, an exception
or None is a failure. Remote models, parsers and recognisers enter here; the default ones are deterministic and need no network.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewake.functions import text
from rulewake.session import prepare

Labeler = Callable[[list[str]], list[str | None]]
_fence = re.compile(r"^\s*```(?:json)?\s*|\s*```\s*$")


def labelled(df: DataFrame, prompt: str, labeler: Labeler, batch: int = 256) -> DataFrame:
    """Adds answer and error. A batch that fails is tried row by row, so that one bad row costs no other. Filter rows before: nothing is pushed through a labeler."""
    prepare(df.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def each(prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            answers = labeler(prompts)
            if len(answers) != len(prompts):
                raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
            return [(a, None if a is not None else "no answer") for a in answers]
        except Exception as e:
            if len(prompts) == 1:
                return [(None, f"{type(e).__name__}: {e}"[:500])]
            return [each([p])[0] for p in prompts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple[str | None, str | None]] = []
            prompts = [p if isinstance(p, str) else "" for p in b[prompt]]
            for i in range(0, len(prompts), batch):
                out += each(prompts[i : i + batch])
            yield b.assign(answer=[a for a, _ in out], error=[e for _, e in out])

    return df.mapInPandas(run, f"{kinds}, answer string, error string")


def unfenced(answer: Column) -> Column:
    """JSON without the fence some models put around it."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")


def match_answer(answer: Column) -> dict[str, Column]:
    """addressed, stance, justification (200 characters at most) and problem of a match answer. Not addressed means stance NONE; problem is null for a good one."""
    j = unfenced(answer)
    v = F.try_parse_json(j)
    said = F.get_json_object(j, "$.addressed")
    addressed = F.when(F.lower(said).isin("true", "false"), F.lower(said) == "true")
    given = text.stance(F.get_json_object(j, "$.stance"))
    problem = (
        F.when(v.isNull(), "not json").when(addressed.isNull(), "addressed").when(given.isNull(), "stance").when(F.get_json_object(j, "$.justification").isNull(), "justification")
    )
    return {"addressed": addressed, "stance": F.when(addressed, given).when(~addressed, "NONE"), "justification": F.left(F.get_json_object(j, "$.justification"), F.lit(200)), "problem": problem}


def flags_answer(answer: Column, names: list[str]) -> dict[str, Column]:
    """Each flag as 0 or 1 and problem: the first that is missing or no such number; true and false are refused."""
    j = unfenced(answer)
    raw = {n: F.get_json_object(j, f"$.{n}") for n in names}
    problem = F.when(F.try_parse_json(j).isNull(), "not json")
    for n in names:
        problem = problem.when(raw[n].isNull() | ~raw[n].isin("0", "1"), n)
    return {**{n: F.when(raw[n].isin("0", "1"), raw[n].cast("int")) for n in names}, "problem": problem}


#: Spellings of modals that are led back to one.
MODAL_ALIASES = {
    "must": "must", "shall": "shall", "must not": "must not", "shall not": "shall not", "may": "may", "may not": "may not", "is required to": "is required to", "are required to": "are required to",
    "required to": "is required to", "is prohibited from": "is prohibited from", "prohibited from": "is prohibited from", "is permitted to": "is permitted to", "permitted to": "is permitted to",
}


def coerced(value: Column, allowed: dict[str, str], default: str | None = None) -> Column:
    """The allowed value that a lower-case, trimmed spelling stands for, else the default."""
    table = F.create_map(*(x for k, v in allowed.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(table, F.lower(text.squeezed(F.coalesce(value, F.lit(""))))), F.lit(default))


def split_rows(df: DataFrame, items: str, tokens: list[str]) -> DataFrame:
    """One row per element of an array, numbered by split_idx from 0; token counts stay on the first and are 0 on the others. An empty or null array gives no row."""
    out = df.select("*", F.posexplode(items).alias("split_idx", "item"))
    for t in tokens:
        out = out.withColumn(t, F.when(F.col("split_idx") == 0, F.col(t)).otherwise(0))
    return out.drop(items)


def sharded(df: DataFrame, keys: list[str], size: int, *order: str) -> DataFrame:
    """Adds shard: rows of a key numbered in order and cut every `size` rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("shard", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def check_cost(rows: int, tokens_in: float, tokens_out: float, rate_in: float, rate_out: float, cap: float) -> float:
    """The price of a run by tokens per row and rates per million; an error beyond the cap, before anything is sent."""
    price = rows * (tokens_in * rate_in + tokens_out * rate_out) / 1_000_000
    if price > cap:
        raise ValueError(f"{price:.2f} is more than the cap of {cap:.2f}")
    return price


def plan(targets: DataFrame, sources: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, reason): done, ready, or missing its source; what a run would do, without doing it."""
    s, d = sources.select(*keys).distinct().withColumn("_s", F.lit(True)), done.select(*keys).distinct().withColumn("_d", F.lit(True))
    t = targets.select(*keys).distinct().join(s, keys, "left").join(d, keys, "left")
    status = F.when(F.col("_d"), "done").when(F.col("_s"), "ready").otherwise("missing")
    return t.select(*keys, status.alias("status"), F.when(status == "done", "already labelled").when(status == "missing", "no source").alias("reason"))


def outcome_of_lines(lines: DataFrame) -> DataFrame:
    """(line, custom_id, answer, bucket) of the lines of a batch's output: ok, failed (an error or a status other than 200), empty or malformed."""
    v = F.col("value")
    status, error = F.get_json_object(v, "$.response.status_code"), F.get_json_object(v, "$.error")
    answer = F.get_json_object(v, "$.response.body.choices[0].message.content")
    bucket = (
        F.when(F.trim(v) == "", "blank").when(F.try_parse_json(v).isNull(), "malformed").when(F.get_json_object(v, "$.custom_id").isNull(), "malformed").when(error.isNotNull() | (F.coalesce(status, F.lit("200")) != "200"), "failed").when(answer.isNull() | (F.trim(answer) == ""), "empty").otherwise("ok")
    )
    return lines.select(v.alias("line"), F.get_json_object(v, "$.custom_id").alias("custom_id"), answer.alias("answer"), bucket.alias("bucket"))


def keyword_matcher(prompts: list[str]) -> list[str | None]:
    """A deterministic labeler: a prompt `comment ||| obligation` is addressed if both share three words of five letters or more."""
    out: list[str | None] = []
    for p in prompts:
        comment, _, obligation = p.lower().partition("|||")
        shared = set(re.findall(r"[a-z]{5,}", comment)) & set(re.findall(r"[a-z]{5,}", obligation))
        stance = "OPPOSING" if re.search(r"\b(?:oppose|withdraw|weaken|delay)\b", comment) else "SUPPORTING" if re.search(r"\b(?:support|favor|retain|strengthen)\b", comment) else "SUGGESTING_MODIFICATION"
        hit = len(shared) >= 3
        out.append(json.dumps({"addressed": hit, "stance": stance if hit else "NONE", "justification": ", ".join(sorted(shared))[:200]}))
    return out


def simple_parser(sentences: list[str]) -> list[str | None]:
    """A deterministic parser of obligations: what stands before the modal is the subject, the next word the action, the rest the object."""
    out: list[str | None] = []
    for s in sentences:
        m = re.search(text.STRONG, s) or re.search(text.PERMISSIVE, s)
        if not m:
            out.append(None)
            continue
        subject, rest = s[: m.start()].strip(" ,"), s[m.end() :].strip(" .")
        passive = re.match(r"be\s+(\w+ed)\b\s*(.*)", rest, re.DOTALL)
        action, _, obj = (passive[1], "", passive[2]) if passive else rest.partition(" ")
        out.append(json.dumps({"subject": subject or "<implicit>", "action": action, "object": obj, "passive_voice": bool(passive)}))
    return out
