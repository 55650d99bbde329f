"""Verifier-guided selection over candidate tables.

All prompts advance together: a step is expand, score, rank, cut, for every open beam of
every prompt at once.  A prompt holds only what its generator returned in a step, so
ranking is one aggregation with small groups.
"""

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairwright.functions.text import decode_penalties, strip
from pairwright.operators.joins import dimension_join
from pairwright.operators.requests import column_or
from pairwright.operators.scoring import Scorer
from pairwright.session import ensure_checkpoint_dir

# An expander takes open beams (prompt_id, prompt, prefix and any other columns) and a count;
# it returns every input row once per continuation with cand_ord, cand_text, cand_logprob and
# cand_complete added, or once with nulls there if it has no continuation; call_ms, if it is
# there too, is the generator's time and is summed up as the decoding's latency.
Expander = Callable[[DataFrame, int], DataFrame]

BRANCH = [
    "text",
    "generator_logprob",
    "verifier_reward",
    "total_score",
    "is_complete",
    "stopped_reason",
    "word_count",
    "repeated_line_count",
    "length_penalty",
    "repeated_line_penalty",
]


#: what tells the input rows apart
ROW = ("prompt_id", "prompt", "nth")


def _entries(script: DataFrame, keys: list[str], count: int) -> DataFrame:
    """First ``count`` continuations per key in the order of ``ord``; a row without text marks a key that has none."""
    entry = F.when(F.col("text").isNotNull(), F.struct("ord", "text", "logprob", "is_complete"))
    listed = script.where(F.col("text").isNull() | (F.col("ord") < count)).groupBy(*keys)
    return listed.agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def scripted_expander(script: DataFrame, by_prompt: bool = False) -> Expander:
    """Continuations looked up in a table (prefix, ord, text, logprob, is_complete).

    A prefix that is not listed falls back to the entries of the empty prefix.  With
    ``by_prompt`` the table is kept per prompt_id.
    """

    def expand(beams: DataFrame, count: int) -> DataFrame:
        keys = ["prompt_id", "prefix"] if by_prompt else ["prefix"]
        # entries of the empty prefix are the root's, which every beam meets anyway: they need not travel twice
        entries = _entries(script.where(F.col("prefix") != ""), keys, count)
        root = _entries(script.where(F.col("prefix") == ""), keys[:-1] or keys, count).withColumnRenamed("entries", "root")
        if by_prompt:
            # a prompt has at most beam_width open beams, so no key is hot
            found = beams.join(entries, keys, "left").join(root, ["prompt_id"], "left")
        else:
            found = dimension_join(beams, entries, keys, "left").withColumn("root", root.select("root").scalar())
        return (
            found.withColumn("e", F.explode_outer(F.coalesce("entries", "root")))
            .select(
                *beams.columns,
                F.col("e.ord").alias("cand_ord"),
                F.col("e.text").alias("cand_text"),
                F.col("e.logprob").alias("cand_logprob"),
                F.col("e.is_complete").alias("cand_complete"),
            )
        )

    return expand


def client_expander(open_client: Callable[[], object]) -> Expander:
    """Continuations from a client with ``expand(prompt, prefix, count)`` -> (text, logprob, is_complete) tuples.

    ``call_ms`` is the time of the call, on the first row that it gave; 0 on its others.
    """

    def expand(beams: DataFrame, count: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = open_client()
            for batch in batches:
                found, spent = [], []
                for p, x in zip(batch["prompt"], batch["prefix"]):
                    started = time.perf_counter()
                    found.append(list(client.expand(p, x, count)) or [(None, None, None)])
                    spent += [1000 * (time.perf_counter() - started), *[0.0] * (len(found[-1]) - 1)]
                out = batch.loc[batch.index.repeat([len(f) for f in found])].reset_index(drop=True)
                flat = [(i, *c) for f in found for i, c in enumerate(f)]
                out["cand_ord"] = [i if text is not None else None for i, text, _, _ in flat]
                out["cand_text"] = [text for _, text, _, _ in flat]
                out["cand_logprob"] = [logprob for _, _, logprob, _ in flat]
                out["cand_complete"] = [done for _, _, _, done in flat]
                out["call_ms"] = spent
                yield out

        ddl = ", ".join(f"`{name}` {kind}" for name, kind in beams.dtypes)
        return beams.mapInPandas(
            run, f"{ddl}, cand_ord INT, cand_text STRING, cand_logprob DOUBLE, cand_complete BOOLEAN, call_ms DOUBLE"
        )

    return expand


def _measured(grown: DataFrame, scorer: Scorer, length_weight: float, repeat_weight: float) -> DataFrame:
    """Score and penalties of the candidate texts, each computed once; rows without a text get nulls."""
    return grown.withColumns(
        {
            "reward": scorer(F.col("prompt"), F.col("text")),
            "penalty": decode_penalties(F.col("text"), length_weight, repeat_weight),
        }
    )


def _branch(beta: float) -> Column:
    penalty = F.col("penalty")
    # a candidate that the scorer leaves out must not pass for one with a known total
    reward = F.coalesce("reward", F.when(F.col("text").isNotNull(), F.raise_error("a candidate has no score").cast("double")))
    logprob = F.coalesce("logprob", F.lit(0.0))
    total = (
        logprob
        + F.lit(float(beta)) * reward
        - penalty["length_penalty"]
        - penalty["repeated_line_penalty"]
    )
    return F.struct(
        "text",
        logprob.alias("generator_logprob"),
        F.col("reward").alias("verifier_reward"),
        total.alias("total_score"),
        F.coalesce("is_complete", F.lit(False)).alias("is_complete"),
        F.lit(None).cast("string").alias("stopped_reason"),
        *(penalty[c].alias(c) for c in BRANCH[6:]),
    )


def _check(beam_width: int, expansions: int, max_steps: int, length_weight: float, repeat_weight: float) -> None:
    if min(beam_width, expansions, max_steps) < 1:
        raise ValueError("beam_width, expansions and max_steps must be at least 1")
    if min(length_weight, repeat_weight) < 0:
        raise ValueError("penalties must be non-negative")


def _ranked_step(candidates: DataFrame, beam_width: int, step: int, keys: tuple[str, ...] = ("prompt_id", "prompt")) -> DataFrame:
    """One row per prompt with its ranked branches; as many as the generator gave, none is left out.

    Input: prompt_id, prompt, place (order of arrival), branch, scored.
    """
    key = F.struct((-F.col("branch.total_score")).alias("k"), "place", "branch")
    prompt = [] if "prompt" in keys else [F.min("prompt").alias("prompt")]
    timed = [F.sum("call_ms").alias("call_ms")] if "call_ms" in candidates.columns else []
    ranked = candidates.groupBy(*keys).agg(
        *prompt, *timed, F.array_sort(F.collect_list(key)).alias("values"), F.sum(F.col("scored").cast("int")).alias("calls")
    )
    kept = F.slice("candidates", 1, beam_width)
    return (
        ranked.withColumn("candidates", F.transform("values", lambda x: x["branch"]))
        .drop("values")
        .withColumns({"step_index": F.lit(step), "finished": F.forall(kept, lambda b: b["is_complete"])})
    )


def _numbered(prompts: DataFrame) -> DataFrame:
    """The input rows with the columns of ``ROW``: equal rows are told apart by their number."""
    named = prompts.select(F.col("prompt_id").cast("string").alias("prompt_id"), "prompt")
    return named.withColumn("nth", F.row_number().over(Window.partitionBy("prompt_id", "prompt").orderBy("prompt_id")))


def _results(steps: DataFrame, parameters: dict[str, float], keys: tuple[str, ...] = ("prompt_id", "prompt")) -> DataFrame:
    """Decoding results from the ranked steps of every prompt."""
    width = parameters["beam_width"]
    kept = F.slice("candidates", 1, width)
    pruned = F.slice("candidates", F.lit(width + 1), F.greatest(F.size("candidates"), F.lit(1)))
    trace = F.struct("step_index", "candidates", kept.alias("kept"), pruned.alias("pruned"))
    per_prompt = steps.groupBy(*keys).agg(
        F.max_by(kept, "step_index").alias("branches"),
        F.sum("calls").alias("verifier_call_count"),
        F.array_sort(F.collect_list(trace)).alias("steps"),
        *([F.sum("call_ms").alias("latency_ms")] if "call_ms" in steps.columns else []),
    )
    best = F.col("branches")[0]
    return per_prompt.select(
        "prompt_id",
        "prompt",
        strip(best["text"]).alias("final_answer"),
        best["total_score"].alias("final_score"),
        F.lit("ttc_beam").alias("method"),
        "verifier_call_count",
        "branches",
        "steps",
        *(["latency_ms"] if "latency_ms" in per_prompt.columns else []),
        F.create_map(*(F.lit(x) for k, v in parameters.items() for x in (k, str(v)))).alias("decoding_parameters"),
    )


def rerank(
    candidates: DataFrame,
    scorer: Scorer,
    beam_width: int = 4,
    expansions: int | None = None,
    beta: float = 1.0,
    length_weight: float = 0.0,
    repeat_weight: float = 0.0,
) -> DataFrame:
    """Best of N: score all candidates of each prompt (or its first ``expansions`` by ``ord``), keep the best ones.

    ``candidates`` has prompt_id, ord (from 0), text, logprob, is_complete and optionally
    prompt.  Repeated ``ord`` values are candidates of their own; a missing log-probability
    counts as 0, a missing completeness as false, a missing score is an error.
    """
    _check(beam_width, expansions or 1, 1, length_weight, repeat_weight)
    taken = candidates if expansions is None else candidates.where(F.col("ord") < expansions)
    first = taken.select(
        "prompt_id",
        column_or(candidates, "prompt", "").alias("prompt"),
        F.col("ord").cast("long").alias("place"),
        "text",
        F.col("logprob").cast("double").alias("logprob"),
        "is_complete",
        F.lit(True).alias("scored"),
    )
    scored = _measured(first, scorer, length_weight, repeat_weight).select(
        "prompt_id", "prompt", "place", _branch(beta).alias("branch"), "scored"
    )
    parameters = _parameters(beam_width, "all" if expansions is None else expansions, beta, 1, length_weight, repeat_weight)
    return _results(_ranked_step(scored, beam_width, 0, ("prompt_id",)), parameters)


def _parameters(beam_width, expansions, beta, max_steps, length_weight, repeat_weight) -> dict[str, float]:
    return {
        "beam_width": beam_width,
        "expansions_per_step": expansions,
        "beta": beta,
        "max_steps": max_steps,
        "length_penalty_per_100_words": length_weight,
        "repeated_line_penalty": repeat_weight,
    }


def beam(
    prompts: DataFrame,
    expander: Expander,
    scorer: Scorer,
    beam_width: int = 4,
    expansions: int = 4,
    beta: float = 1.0,
    max_steps: int = 8,
    length_weight: float = 0.0,
    repeat_weight: float = 0.0,
) -> DataFrame:
    """Multi-step beam selection for all prompts (prompt_id, prompt).

    Every row is decoded for itself, equal rows and different prompts that share an id too.
    Each step is checkpointed, so the plan stays short and a lost executor costs one step.
    The driver loop runs at most ``max_steps`` times and stops when no prompt has an open beam.
    """
    _check(beam_width, expansions, max_steps, length_weight, repeat_weight)
    ensure_checkpoint_dir(prompts.sparkSession)
    zero = F.lit(0.0)
    start = F.struct(
        F.lit("").alias("text"), zero.alias("generator_logprob"), zero.alias("verifier_reward"),
        zero.alias("total_score"), F.lit(False).alias("is_complete"),
        F.lit(None).cast("string").alias("stopped_reason"), F.lit(0).alias("word_count"),
        F.lit(0).alias("repeated_line_count"), zero.alias("length_penalty"), zero.alias("repeated_line_penalty"),
    )
    beams = _numbered(prompts).select(*ROW, F.lit(0).alias("rank"), start.alias("b"))
    steps = None
    for step in range(max_steps):
        is_open = ~F.col("b.is_complete")
        expanded = expander(beams.where(is_open).withColumn("prefix", F.col("b.text")), expansions)
        stopped = F.struct(
            *(F.col(f"b.{c}").alias(c) for c in BRANCH[:4]),
            F.lit(True).alias("is_complete"),
            F.lit("no_expansions").alias("stopped_reason"),
            *(F.col(f"b.{c}").alias(c) for c in BRANCH[6:]),
        )
        has_more = F.col("cand_text").isNotNull()
        place = F.col("rank").cast("long") * F.lit(1 << 32)  # by beam, then by arrival
        grown = expanded.select(
            *ROW,
            (place + F.coalesce("cand_ord", F.lit(0))).alias("place"),
            stopped.alias("stopped"),
            has_more.alias("scored"),
            F.concat("b.text", "cand_text").alias("text"),
            (F.col("b.generator_logprob") + F.coalesce("cand_logprob", F.lit(0.0))).alias("logprob"),
            F.col("cand_complete").alias("is_complete"),
            *(["call_ms"] if "call_ms" in expanded.columns else []),
        )
        timed = ["call_ms"] if "call_ms" in expanded.columns else []
        candidates = (
            _measured(grown, scorer, length_weight, repeat_weight)
            .select(
                *ROW, "place", F.when(F.col("scored"), _branch(beta)).otherwise(F.col("stopped")).alias("branch"), "scored", *timed
            )
            .unionByName(
                beams.where(~is_open).select(
                    *ROW, place.alias("place"), F.col("b").alias("branch"), F.lit(False).alias("scored"), *(F.lit(0.0).alias(c) for c in timed)
                )
            )
        )
        ranked = _ranked_step(candidates, beam_width, step, ROW).checkpoint()
        steps = ranked if steps is None else steps.unionByName(ranked)
        open_prompts = ranked.where(~F.col("finished"))
        if step + 1 == max_steps or open_prompts.isEmpty():
            break
        beams = open_prompts.select(*ROW, F.posexplode(F.slice("candidates", 1, beam_width)).alias("rank", "b"))
    return _results(steps, _parameters(beam_width, expansions, beta, max_steps, length_weight, repeat_weight), ROW)


def lookahead_select(level1: DataFrame, level2: DataFrame, budget: int = 32, beta: float = 1.0, keys: tuple[str, ...] = ("prompt_id",)) -> DataFrame:
    """Answer with the best value after looking one level ahead.

    ``keys`` of both tables tell the searches apart.

    ``level1``: prompt_id, ord (from 0), text, logprob, reward and optionally is_complete.
    ``level2``: prompt_id, parent_ord, logprob (of the whole path), reward, for the children
    that were expanded.  Rows of level1 without a text and rows of level2 whose ``found`` is
    false stand for calls that gave nothing.  ``call_ms``, where a level has it, adds up to
    ``latency_ms``.

    Only the first ``budget`` children are visited; a visited child is worth the best total
    below it, or its own total if there is nothing below.  A missing log-probability counts
    as 0, a missing reward is an error.  ``branches`` lists the children in order, as the
    beam's branches, ``branch_values`` what they are worth.
    """
    if budget < 1:
        raise ValueError("budget must be at least 1")
    reward = F.coalesce("reward", F.raise_error(F.lit("a candidate has no score")).cast("double"))
    logprob = F.coalesce("logprob", F.lit(0.0))
    total = logprob + F.lit(float(beta)) * reward
    found = F.col("found") if "found" in level2.columns else F.lit(True)
    timed = "call_ms" in level1.columns
    time_of = lambda level: [F.sum("call_ms").alias("ms_below")] if "call_ms" in level.columns else []
    below = level2.groupBy(F.struct(*keys).alias("key"), F.col("parent_ord").alias("ord")).agg(
        F.max(F.when(found, total)).alias("best_below"), F.count_if(found).alias("calls_below"), *time_of(level2)
    )
    nothing = {"stopped_reason": "string", "word_count": "int", "repeated_line_count": "int", "length_penalty": "double", "repeated_line_penalty": "double"}
    is_complete = F.coalesce("is_complete", F.lit(False)) if "is_complete" in level1.columns else F.lit(False)
    is_child = F.col("text").isNotNull()
    branch = F.struct(
        "text", logprob.alias("generator_logprob"), F.col("reward").alias("verifier_reward"), F.col("total").alias("total_score"),
        is_complete.alias("is_complete"), *(F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()),
    )
    children = level1.withColumn("total", F.when(is_child, total)).select(
        F.struct(*keys).alias("key"), "ord", "text", "total", branch.alias("branch"), *(["call_ms"] if timed else [])
    ).join(below, ["key", "ord"], "left")
    visited = F.col("ord") < budget
    value = F.when(visited, F.coalesce("best_below", "total")).otherwise(F.col("total"))
    calls = F.when(is_child, F.lit(1) + F.when(visited, F.coalesce("calls_below", F.lit(0))).otherwise(0)).otherwise(0)
    best = F.max_by(F.struct("text", "total"), F.when(is_child, F.struct(value.alias("v"), "total", -F.col("ord"))))
    listed = F.array_sort(F.collect_list(F.when(is_child, F.struct("ord", "branch", value.alias("value")))))
    spent = [F.sum(c) for c in ("call_ms", "ms_below") if c in children.columns]
    latency = [sum((F.coalesce(s, F.lit(0.0)) for s in spent[1:]), F.coalesce(spent[0], F.lit(0.0))).alias("latency_ms")] if spent else []
    grouped = children.groupBy("key").agg(best.alias("b"), F.sum(calls).alias("verifier_call_count"), listed.alias("listed"), *latency)
    return grouped.select(
        "key.*",
        strip(F.col("b.text")).alias("final_answer"),
        F.col("b.total").alias("final_score"),
        F.lit("ttc_mcts").alias("method"),
        "verifier_call_count",
        F.transform("listed", lambda c: c["branch"]).alias("branches"),
        F.transform("listed", lambda c: c["value"]).alias("branch_values"),
        *(["latency_ms"] if latency else []),
    )


def lookahead(
    prompts: DataFrame, expander: Expander, scorer: Scorer, expansions: int = 4, budget: int = 32, beta: float = 1.0
) -> DataFrame:
    """Two-level lookahead for all prompts; a prompt without continuations gets an empty answer.

    Every row is searched for itself, equal rows and different prompts that share an id too.

    The first level is checkpointed: the second one hangs below the very children it holds,
    and the generator is asked once for them.
    """
    if expansions < 1:
        raise ValueError("expansions must be at least 1")
    ensure_checkpoint_dir(prompts.sparkSession)
    roots = _numbered(prompts).withColumn("prefix", F.lit(""))
    asked = expander(roots, expansions)
    timed = ["call_ms"] if "call_ms" in asked.columns else []
    has_text = F.col("cand_text").isNotNull()
    children = asked.select(
        *ROW,
        F.col("cand_ord").alias("ord"),
        F.col("cand_text").alias("text"),
        F.col("cand_logprob").alias("logprob"),
        F.coalesce("cand_complete", F.lit(False)).alias("is_complete"),
        F.when(has_text, scorer(F.col("prompt"), F.col("cand_text"))).alias("reward"),
        *timed,
    ).checkpoint()
    visited = children.where(F.col("text").isNotNull() & ~F.col("is_complete") & (F.col("ord") < budget)).select(
        *ROW, "ord", F.col("text").alias("prefix"), F.col("logprob").alias("path_logprob")
    )
    below = expander(visited, expansions).select(
        *ROW,
        F.col("ord").alias("parent_ord"),
        (F.coalesce("path_logprob", F.lit(0.0)) + F.coalesce("cand_logprob", F.lit(0.0))).alias("logprob"),
        F.when(has_text, scorer(F.col("prompt"), F.concat("prefix", "cand_text"))).alias("reward"),
        has_text.alias("found"),
        *timed,
    )
    key = F.struct(*ROW).alias("key")  # a struct equals another with the same nulls
    chosen = lookahead_select(children, below, budget, beta, ROW).withColumn("key", key).drop(*ROW)
    parameters = {"expansions_per_node": expansions, "simulation_budget": budget, "beta": beta}
    none = lambda name: F.coalesce(name, F.array().cast(chosen.schema[name].dataType)).alias(name)
    return roots.select("prompt_id", "prompt", key).join(chosen, "key", "left").select(
        "prompt_id",
        "prompt",
        F.coalesce("final_answer", F.lit("")).alias("final_answer"),
        F.coalesce("final_score", F.lit(0.0)).alias("final_score"),
        F.lit("ttc_mcts").alias("method"),
        F.coalesce("verifier_call_count", F.lit(0)).alias("verifier_call_count"),
        none("branches"),
        none("branch_values"),
        *([F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms")] if timed else []),
        F.create_map(*(F.lit(x) for k, v in parameters.items() for x in (k, str(v)))).alias("decoding_parameters"),
    )


def ucb_rank(visits: DataFrame, weight: float = 1.4) -> DataFrame:
    """Upper confidence bound of each child among its siblings, best first.

    ``visits``: prompt_id, ord, visits, value_sum.  Unvisited children come first.
    """
    total = F.greatest(F.lit(1), F.sum("visits").over(Window.partitionBy("prompt_id")))
    n = F.col("visits")
    bound = F.when(n == 0, F.lit(float("inf"))).otherwise(
        F.try_divide("value_sum", n) + F.lit(float(weight)) * F.sqrt(F.try_divide(F.ln(F.col("total") + 1), n))
    )
    place = F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc("ucb"), "ord"))
    # total and place share one partitioning, so the children are shuffled once
    return visits.withColumn("total", total).select("prompt_id", "ord", "visits", bound.alias("ucb")).withColumn("place", place)


def inference_records(results: DataFrame, generator_model: str, verifier_model: str) -> DataFrame:
    """Decoding results as inference records; those of the beam and of the lookahead have one schema.

    ``branch_values`` is what the lookahead found each branch to be worth, empty for the beam.
    """
    nothing = F.lit(None).cast("long")
    branch = (
        "STRUCT<text: STRING, generator_logprob: DOUBLE, verifier_reward: DOUBLE, total_score: DOUBLE, is_complete: BOOLEAN, "
        "stopped_reason: STRING, word_count: INT, repeated_line_count: INT, length_penalty: DOUBLE, repeated_line_penalty: DOUBLE>"
    )
    empty = lambda kind: F.expr(f"CAST(array() AS ARRAY<{kind}>)")
    optional = {
        "branches": empty(branch),
        "branch_values": empty("DOUBLE"),
        "steps": empty(f"STRUCT<step_index: INT, candidates: ARRAY<{branch}>, kept: ARRAY<{branch}>, pruned: ARRAY<{branch}>>"),
        "decoding_parameters": F.expr("CAST(map() AS MAP<STRING,STRING>)"),
        "latency_ms": F.lit(0.0),
    }

    def of(name: str) -> Column:
        return F.col(name) if name in results.columns else optional[name]

    return results.select(
        "prompt_id",
        "prompt",
        "method",
        "final_answer",
        "final_score",
        of("branches").alias("branch_scores"),
        of("branch_values").alias("branch_values"),
        of("steps").alias("step_traces"),
        "verifier_call_count",
        of("latency_ms").alias("latency_ms"),
        F.lit(generator_model).alias("generator_model"),
        F.lit(verifier_model).alias("verifier_model"),
        nothing.alias("generator_token_count"),
        nothing.alias("verifier_token_count"),
        of("decoding_parameters").alias("decoding_parameters"),
    )


def trace_branches(records: DataFrame, which: str) -> DataFrame:
    """Branches of a kind (kept or pruned) over all steps, one per row; kept falls back to the final branches."""
    found = F.flatten(F.transform("step_traces", lambda s: s[which]))
    if which == "kept":
        found = F.when(F.size(found) > 0, found).otherwise(F.col("branch_scores"))
    return records.select("prompt_id", F.posexplode(found).alias("place", "branch")).select(
        "prompt_id", "place", "branch.*"
    )


def first_trace_item(traces: Column, which: str) -> Column:
    """First branch of a kind over all steps, null if there is none."""
    return F.try_element_at(F.flatten(F.transform(traces, lambda s: s[which])), F.lit(1))


def extreme_branch(branches: Column, best: bool = True) -> Column:
    """Branch with the highest (or lowest) total score; the first one wins a tie."""
    sign = -1 if best else 1
    keyed = F.transform(
        branches, lambda b, i: F.struct((F.lit(sign) * F.coalesce(b["total_score"], F.lit(0.0))).alias("k"), i.alias("i"), b.alias("b"))
    )
    return F.array_min(keyed)["b"]


def case_study_row(records: DataFrame, order: str = "seq") -> DataFrame:
    """First record that has branch scores, else the first record."""
    has_branches = F.coalesce(F.size("branch_scores"), F.lit(0)) > 0
    return records.orderBy(has_branches.desc(), F.asc(order)).limit(1)


def first_rows(df: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """Prefix limit in ingest order."""
    return df.orderBy(order).limit(n)
