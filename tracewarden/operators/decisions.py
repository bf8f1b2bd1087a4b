"""Decisions: closed sets, reorderings, weighted scores, tiers, votes and category chains, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# fixed values: the weights of the seven terms of the root score; what others explain, and what speaks against an element, counts against it
ROOT_WEIGHTS = {
    "local_anomaly": 0.20,
    "temporal_priority": 0.25,
    "outgoing_propagation": 0.20,
    "cross_modal_support": 0.20,
    "predictive_explanation": 0.15,
    "incoming_propagation": -0.15,
    "contradiction": -0.15,
}


def closed_top(lists: list[Column], legal: Column, k: int) -> Column:
    """The first ``k`` different legal entries of several lists, one after the other."""
    return F.slice(F.filter(F.array_distinct(F.concat(*lists)), lambda x: F.array_contains(legal, x)), 1, k)


def ranked(values: Column) -> Column:
    """An array as structs with ranks from 1."""
    return F.transform(values, lambda x, i: F.struct((i + 1).alias("rank"), x.alias("network_element_id")))


def promoted(current: Column, pick: Column, k: int, inside_only: bool = False) -> Column:
    """The pick first, then the others; a null pick, or one from outside if ``inside_only``, changes nothing."""
    moved = F.slice(F.array_distinct(F.concat(F.array(pick), current)), 1, k)
    good = pick.isNotNull() & (F.array_contains(current, pick) if inside_only else F.lit(True))
    return F.when(good, moved).otherwise(current)


def partitioned(values: Column, allowed) -> Column:
    """Allowed entries first, the others after them, both in order."""
    return F.concat(F.filter(values, allowed), F.filter(values, lambda x: ~allowed(x)))


def swapped(values: Column, allowed) -> Column:
    """The first allowed entry changes places with the first entry; nothing changes if there is none."""
    place = F.array_position(F.transform(values, lambda x: allowed(x)), True).cast("int")
    first, best = F.element_at(values, 1), F.try_element_at(values, place)
    return F.when(place <= 1, values).otherwise(F.transform(values, lambda x, i: F.when(i == 0, best).when(i == place - 1, first).otherwise(x)))


def weighted(terms: dict[str, Column], weights: dict[str, float] = ROOT_WEIGHTS) -> Column:
    """The weighted sum; a missing term counts as 0."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.coalesce(terms[name], F.lit(0.0)) * w
    return total


def explained(terms: dict[str, Column], weights: dict[str, float] = ROOT_WEIGHTS) -> Column:
    """The contributions by their absolute size, the largest first."""
    parts = F.array(*(F.struct((-F.abs(F.coalesce(terms[n], F.lit(0.0)) * w)).alias("o"), F.lit(n).alias("name"), (F.coalesce(terms[n], F.lit(0.0)) * w).alias("value")) for n, w in weights.items()))
    return F.transform(F.array_sort(parts), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))


def net_support(support: Column, contra: Column) -> Column:
    """Between -1 and 1: supporting less contradicting facts, in thirds."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (support - contra) / F.lit(3.0)))


def chain(rules: list[tuple[Column, Column]], default: Column) -> Column:
    """The category of the first rule that holds."""
    out = None
    for test, category in rules:
        out = F.when(test, category) if out is None else out.when(test, category)
    return out.otherwise(default)


def collapse_windows(predictions: DataFrame, window: list[str], k: int = 5) -> DataFrame:
    """One row per window from several predictions (id, confidence, top: array): elements by best rank-1 confidence, support and best rank."""
    from pyspark.sql import Window

    rows = predictions.select(*window, "id", "confidence", F.posexplode("top").alias("pos", "element"))
    per = rows.groupBy(*window, "element").agg(F.max(F.when(F.col("pos") == 0, F.col("confidence"))).alias("primary"), F.count("*").alias("support"), F.min("pos").alias("best"))
    order = Window.partitionBy(*window).orderBy(F.desc_nulls_last("primary"), F.desc("support"), "best", "element")
    kept = per.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return kept.groupBy(*window).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "element"))), lambda x: x["element"]).alias("top"))


def named_ranks(said: Column, legal: Column) -> Column:
    """Names in the order in which they were said: a prefix up to the first hyphen goes where the whole is not known, and unknown and repeated names are left out."""
    known = lambda x: F.array_contains(legal, x)
    bare = F.transform(said, lambda x: F.when(known(F.trim(x)), F.trim(x)).otherwise(F.regexp_replace(F.trim(x), "^[^-]*-", "")))
    return F.filter(F.array_distinct(bare), known)


# fixed values: points of a judged prediction
TIME_BASE, TIME_SHARE, TIME_REACH = 0.7, 0.3, 360.0
CAUSE_POINTS, PLACE_SHARES, CATEGORY_POINTS = 40.0, (1.0, 0.8, 0.6, 0.4, 0.2), 10.0


def time_points(a: Column, b: Column, c: Column, d: Column, seconds: float = 1.0) -> Column:
    """The share for the times of a match: all at no distance of the ends, the base from ``TIME_REACH`` seconds on. ``seconds``: of a unit."""
    far = (F.abs(a - c) + F.abs(b - d)) * seconds
    return F.lit(TIME_BASE) + TIME_SHARE * F.greatest(F.lit(0.0), 1 - far / TIME_REACH)


def cause_points(place: Column) -> Column:
    """Points by the place, from 1, at which the true element is named; none if it is not."""
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, PLACE_SHARES)), F.nullif(place.cast("int"), F.lit(0))) * CAUSE_POINTS, F.lit(0.0))


def category_points(major: Column, sub: Column) -> tuple[Column, Column]:
    """(major, minor): points of the category; the minor ones need the major."""
    return F.when(major, CATEGORY_POINTS).otherwise(0.0).alias("major"), F.when(major & sub, CATEGORY_POINTS).otherwise(0.0).alias("minor")


def vote(rows: DataFrame, key: str, choice: str, weight: Column) -> DataFrame:
    """The choice with the largest total weight (the least among equals)."""
    totals = rows.groupBy(key, choice).agg(F.sum(weight).alias("w"))
    return totals.groupBy(key).agg(F.min(F.struct((-F.round("w", 9)).alias("o"), F.col(choice).alias("c"), F.col("w").alias("w"))).alias("s")).select(key, F.col("s.c").alias(choice), F.col("s.w").alias("weight"))


def _balanced(text: str) -> str | None:
    """The last balanced {...} of a text; braces in strings do not count."""
    best, depth, start, quoted, skip = None, 0, 0, False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                best = text[start : i + 1]
    return best


def json_in(text: Column) -> Column:
    """The last JSON object in free text, as text; null if there is none."""

    @F.pandas_udf("string")
    def find(values: pd.Series) -> pd.Series:
        import json

        def one(t):
            found = _balanced(t) if isinstance(t, str) else None
            try:
                return found if found and isinstance(json.loads(found), dict) else None
            except ValueError:
                return None

        return values.map(one)

    return find(text)


class Backend:
    """A model that answers prompts; the offline one below answers from the prompt alone."""

    def answer(self, prompts: list[str]) -> list[str]:
        raise NotImplementedError


class Offline(Backend):
    """Answers with the first candidate that a prompt lists after 'candidates:'."""

    def answer(self, prompts: list[str]) -> list[str]:
        import json

        out = []
        for p in prompts:
            listed = p.partition("candidates:")[2].split("\n")[0].strip()
            names = [x.strip() for x in listed.split(",") if x.strip()]
            out.append(f"I pick this one.\n```json\n{json.dumps({'pick': names[0] if names else None})}\n```")
        return out


def asked(df: DataFrame, prompt: str, backend: Backend, out: str = "response", tries: int = 3) -> DataFrame:
    """``df`` with the backend's answers; each batch is asked again up to ``tries`` times, then answered with null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            answers: list[str | None] = [None] * len(rows)
            for n in range(tries):
                try:
                    answers = list(backend.answer(rows[prompt].tolist()))
                    break
                except Exception:  # a failing service is asked again; the caller checks the share of nulls
                    if n + 1 == tries:
                        break
            yield rows.assign(**{out: answers})

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField(out, StringType())]))


def require_share(df: DataFrame, column: str, least: float) -> None:
    """Raises if fewer than this share of rows have a value."""
    row = df.agg(F.count(column).alias("n"), F.count("*").alias("all")).first()
    if row["n"] < least * row["all"]:
        raise ValueError(f"{row['n']} of {row['all']} rows have {column}")
