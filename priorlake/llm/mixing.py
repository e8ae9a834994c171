"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Documents fold to cells (source, lang, topic) with their token sums; the cells are raked to the targets of each
dimension in turn; a cell's raked weight over its tokens is the rate of its documents, and one factor calibrates the
rates to the wanted share of tokens with no probability above 1. DataFrame functions only.

Texts are read for their token counts and their form; nothing wider than a cell is shuffled, sums are partial before the
shuffle, and the join of documents with cells is a broadcast only where Spark finds the written cells small (else it splits a hot
source). Draws are hashes of (seed, doc_id, text), so a lost task draws the same again.

Defined cases: null source, lang or doc_id count as the empty string; null or empty texts have 0 tokens and the lowest
weight: they are kept with their cell's probability (0 where the cell has no tokens); rows of one id and text draw alike, others, as those without an id, each by
themselves; an empty table gives no rows; columns of documents named like those made here are not read except doc_id, text, source, lang.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorlake.llm.shared import dropped, stored

DIMENSIONS = ("source", "lang", "topic")
TEMPERATURE, SHARE, SWEEPS, CAPS, SEED = 0.7, 0.5, 8, 6, "mix"
WORDS = r"[^ \t-\r]+"


def _without(text: Column, characters: str) -> Column:
    """How many of the characters the text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def labelled(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, source, lang, topic (the text's form), n_tokens (words), digest (of the text) and carried columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(
        "doc_id", *[F.coalesce(F.col(d).cast("string"), F.lit("")).alias(f"_{d}") for d in ("source", "lang")], text.alias("_t"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("n_tokens"), F.md5(text).alias("digest"), *[F.col(c).alias(f"_c_{c}") for c in carry],
    )
    n = F.col("n_tokens")
    topic = (
        F.when(_without(F.col("_t"), "|") * 5 >= n, "table")
        .when(_without(F.col("_t"), "#*$%&<>") * 5 >= n, "markup")
        .when(_without(F.col("_t"), "0123456789") * 2 >= n, "figures")
        .when(_without(F.col("_t"), "\n") * 10 >= n, "lines")
        .when(n < 200, "brief").otherwise("prose")
    )
    return out.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), topic.alias("topic"), "n_tokens", "digest", *[f"_c_{c}" for c in carry])


def tempered(cells: DataFrame, dimension: str, temperature: float = TEMPERATURE) -> DataFrame:
    """Target shares of a dimension's values: their token shares to a power, made to sum to 1."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").alias("s")).where("s > 0").select(dimension, F.pow("s", F.lit(temperature)).alias("s"))
    total = sums.agg(F.sum("s").alias("total"))
    return sums.join(total).select(dimension, (F.col("s") / F.col("total")).alias("target"))


def raked(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """cells (dimensions, tokens) with weight: each sweep scales the weights to every dimension's targets in turn.

    A value without a target gets weight 0. Targets are joined once; then every scaling is a written table of cells, so that a
    plan holds one sum and one join: a whole sweep in one plan reads its cells eight times, and its broadcasts fill the driver.
    """
    for dimension, goal in targets.items():
        cells = cells.join(goal.select(dimension, F.col("target").alias(f"_goal_{dimension}")), dimension, "left")
    goals = [f"_goal_{dimension}" for dimension in targets]
    cells = stored(cells.select(*DIMENSIONS, "tokens", *goals, F.col("tokens").cast("double").alias("weight")).coalesce(4), "raked")
    for _ in range(sweeps):
        for dimension in targets:
            sums = cells.groupBy(dimension).agg(F.sum("weight").alias("_s"))
            factor = F.when(F.col("_s") > 0, F.coalesce(f"_goal_{dimension}", F.lit(0.0)) / F.col("_s")).otherwise(0.0)
            scaled = cells.join(sums, dimension).select(*DIMENSIONS, "tokens", *goals, (F.col("weight") * factor).alias("weight"))
            before, cells = cells, stored(scaled.coalesce(4), "raked")
            dropped(before)
    return cells.drop(*goals)


def calibrated(cells: DataFrame, share: float = SHARE, rounds: int = CAPS) -> DataFrame:
    """cells with probability = min(1, factor * weight / tokens), so that expected tokens are the share of all.

    Each round spreads what capped cells cannot take over the others; the factor is one number.
    """
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    factor = 0.0
    for k in range(rounds):
        capped = F.lit(factor) * rate >= 1 if k else F.lit(False)
        total, full, free = cells.agg(
            F.sum("tokens"), F.sum(F.when(capped, F.col("tokens")).otherwise(0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))
        ).first()
        factor = (share * (total or 0) - (full or 0)) / free if free else factor
    return cells.withColumn("probability", F.least(F.lit(1.0), F.lit(float(factor)) * rate))


def drawn(doc_id: Column, digest: Column, probability: Column, seed: str = SEED) -> Column:
    """Whether the draw of a row, told by its id and its text's digest, keeps it."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), digest)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    return u < probability


def cell_probabilities(
    labels: DataFrame, temperature: float = TEMPERATURE, share: float = SHARE, sweeps: int = SWEEPS, targets: dict[str, DataFrame] | None = None
) -> DataFrame:
    """(source, lang, topic, probability) for every cell of labelled documents; targets: own (value, target) frames."""
    cells = stored(labels.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")).coalesce(4), "cells")
    goals = {d: (targets or {}).get(d) if (targets or {}).get(d) is not None else stored(tempered(cells, d, temperature).coalesce(1), "targets") for d in DIMENSIONS}
    return stored(calibrated(raked(cells, goals, sweeps), share).select(*DIMENSIONS, "tokens", "weight", "probability").coalesce(1), "rates")


def mixed(labels: DataFrame, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """Labelled documents with their probability and whether the draw keeps them."""
    out = labels.join(rates.select(*DIMENSIONS, "probability"), list(DIMENSIONS))
    return out.select(*labels.columns, "probability", drawn(F.col("doc_id"), F.col("digest"), F.col("probability"), seed).alias("kept"))


def mixing(docs: DataFrame, temperature: float = TEMPERATURE, share: float = SHARE, sweeps: int = SWEEPS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, probability, kept."""
    labels = stored(labelled(docs), "labelled")
    return mixed(labels, cell_probabilities(labels, temperature, share, sweeps), seed).drop("digest")


def _sql() -> str:
    step = ["""with docs as (
  select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, coalesce(text, '') as t,
         len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) as n
  from documents),
labelled as (
  select doc_id, source, lang, n as n_tokens, md5(t) as digest,
         case when (length(t) - length(translate(t, '|', ''))) * 5 >= n then 'table'
              when (length(t) - length(translate(t, '#*$%&<>', ''))) * 5 >= n then 'markup'
              when (length(t) - length(translate(t, '0123456789', ''))) * 2 >= n then 'figures'
              when (length(t) - length(replace(t, chr(10), ''))) * 10 >= n then 'lines'
              when n < 200 then 'brief' else 'prose' end as topic
  from docs),
c0 as materialized (select source, lang, topic, sum(n_tokens)::double as tokens, sum(n_tokens)::double as w from labelled group by all)"""]
    for d in DIMENSIONS:
        step.append(f"t_{d} as (select {d}, s / sum(s) over () as target from (select {d}, pow(sum(tokens), {TEMPERATURE}) as s from c0 group by {d} having sum(tokens) > 0))")
    k = 0
    for _ in range(SWEEPS):
        for d in DIMENSIONS:
            step.append(
                f"c{k + 1} as materialized (select c.source, c.lang, c.topic, c.tokens, case when s > 0 then c.w * (coalesce(target, 0) / s) else 0 end as w "
                f"from (select *, sum(w) over (partition by {d}) as s from c{k}) c left join t_{d} using ({d}))"
            )
            k += 1
    step.append(f"rate as materialized (select *, case when tokens > 0 then w / tokens else 0 end as r from c{k})")
    step.append(f"f0 as materialized (select {SHARE} * sum(tokens) / sum(w) as f from rate)")
    for k in range(1, CAPS):
        step.append(
            f"f{k} as materialized (select case when sum(case when f * r >= 1 then 0 else w end) > 0 then ({SHARE} * sum(tokens) - sum(case when f * r >= 1 then tokens else 0 end)) "
            f"/ sum(case when f * r >= 1 then 0 else w end) else any_value(f) end as f from rate, f{k - 1})"
        )
    return ",\n".join(step) + f"""
select doc_id, topic, n_tokens, round(least(1.0, f * r), 6) as probability,
       ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '') || ':' || digest), 1, 12))::bigint / 281474976710656.0 < least(1.0, f * r) as kept
from labelled join rate using (source, lang, topic), f{CAPS - 1}"""


SQL = _sql()
