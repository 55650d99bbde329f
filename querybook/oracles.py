"""Reference SQL for the registered queries, written for DuckDB from the operators' definitions."""

from pairwright import fixed_values as fixed
from pairwright.functions.text import SPACE_CHARS
from querybook.views import with_views

ORACLES: dict[str, str] = {}

METHODS = ["raw", "sft", "beam", "penalty"]

# RE2 spelling of Python's whitespace and line breaks
_WS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_BREAK = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"trim({x}, {quote(SPACE_CHARS)})"


def lines(x: str) -> str:
    return f"string_split_regex({x}, '{_BREAK}')"


def matches(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {quote(pattern)}))"


def occurrences(x: str, needle: str) -> str:
    return f"(length({x}) - length(replace({x}, {quote(needle)}, ''))) // {len(needle)}"


def repeats(line_array: str) -> str:
    kept = f"list_filter(list_transform({line_array}, lambda x: {trim('x')}), lambda x: x <> '')"
    return f"(len({kept}) - len(list_distinct({kept})))"


def tokens(x: str) -> str:
    return matches(x, f"[^{_WS}]+")


def metric_columns(x: str) -> str:
    abnormal = " + ".join(matches(x, p) for p in fixed.ABNORMAL_SYMBOL_PATTERNS)
    slogans = " + ".join(occurrences(f"lower({x})", p) for p in fixed.SLOGAN_PHRASES)
    heading = f"list_filter({lines(x)}, lambda x: regexp_matches(x, '^#{{1,6}}[{_WS}]+[^{_WS}]'))"
    items = f"list_filter({lines(x)}, lambda x: regexp_matches(x, '^[{_WS}]*(?:[-*+]|\\p{{Nd}}+[.)])[{_WS}]+[^{_WS}]'))"
    return f"""
      CAST({abnormal} AS BIGINT) AS abnormal_symbol_count,
      CAST({occurrences(x, '```')} % 2 AS BIGINT) AS code_fence_mismatch,
      CAST({slogans} AS BIGINT) AS slogan_phrase_count,
      CAST(len({heading}) AS BIGINT) AS heading_count,
      CAST(len({items}) AS BIGINT) AS list_item_count,
      CAST(length({x}) AS BIGINT) AS character_count,
      CAST({matches(x, '[A-Za-z0-9_]+')} AS BIGINT) AS word_count,
      CAST({repeats(lines(f'lower({x})'))} AS BIGINT) AS repeated_line_count"""


MEASURED = f", measured AS (SELECT *, {metric_columns('final_answer')} FROM outputs)"


def mean(column: str, name: str) -> str:
    return f"round(avg({column}), 9) AS {name}"


def total(column: str, name: str) -> str:
    return f"CAST(sum({column}) AS BIGINT) AS {name}"


def rule_reward(x: str, rewards: list[str], penalties: list[str]) -> str:
    hit = [f"CASE WHEN contains(lower({x}), {quote(w)}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for w in rewards + penalties]
    plus, minus = hit[: len(rewards)], hit[len(rewards):]
    return f"(({' + '.join(plus)}) - ({' + '.join(minus)}) + least({tokens(x)} / 100.0::DOUBLE, 0.25::DOUBLE))"


REWARDS, PENALTIES = ["heading", "int x", "the "], ["game changer", "===>"]

_OVERALL = ", ".join(
    ["method", "count(*) AS count"]
    + [mean(n, f"{n}_mean") for n in ("abnormal_symbol_count", "code_fence_mismatch", "slogan_phrase_count", "word_count")]
)
_ERRORS = ", ".join(
    total(n, f"{n}_total") for n in ("abnormal_symbol_count", "code_fence_mismatch", "slogan_phrase_count", "repeated_line_count")
)
_LATENCY = ", ".join(
    mean(f"coalesce({n}, 0)", f"{n}_mean") for n in ("latency_ms", "verifier_call_count")
)
_METRICS = [
    "abnormal_symbol_count", "character_count", "code_fence_mismatch", "heading_count",
    "list_item_count", "repeated_line_count", "slogan_phrase_count", "word_count",
]

ORACLES["text_metrics"] = f"{with_views('outputs')}{MEASURED} SELECT prompt_id, method, {', '.join(_METRICS)} FROM measured"
ORACLES["overall_table"] = f"{with_views('outputs')}{MEASURED} SELECT {_OVERALL} FROM measured GROUP BY method"
ORACLES["error_breakdown"] = f"{with_views('outputs')}{MEASURED} SELECT method, {_ERRORS} FROM measured GROUP BY method"
ORACLES["latency_table"] = f"{with_views('outputs')} SELECT method, count(*) AS count, {_LATENCY} FROM outputs GROUP BY method"
ORACLES["static_summary"] = f"""{with_views('outputs')}{MEASURED}
  SELECT method, count(*) AS count, {', '.join(mean(n, n + '_mean') for n in _METRICS)} FROM measured GROUP BY method"""
ORACLES["answer_precedence"] = f"""{with_views('outputs')}
  , chosen AS (SELECT * REPLACE (CASE WHEN lang = 'fr' THEN source || chr(10) || '# Note' || chr(10) || '- one' || chr(10) || '- two' ELSE final_answer END AS final_answer) FROM outputs)
  {MEASURED.replace('FROM outputs', 'FROM chosen')}
  SELECT method, count(*) AS count, {', '.join(mean(n, n + '_mean') for n in _METRICS)} FROM measured GROUP BY method"""
ORACLES["complete_evaluation"] = f"{with_views('outputs')}{MEASURED} SELECT {_OVERALL}, false AS early FROM measured GROUP BY method"
ORACLES["stream_completeness"] = f"""{with_views('outputs')}
  , wanted AS (SELECT DISTINCT prompt_id FROM outputs WHERE method = 'raw')
  SELECT method, count(DISTINCT prompt_id) AS answered, 0::BIGINT AS missing, 'complete' AS status FROM outputs
  WHERE NOT (method = 'beam' AND seq % 50 = 0) AND regexp_matches(final_answer, '\\S') AND prompt_id IN (SELECT prompt_id FROM wanted)
  GROUP BY method HAVING count(DISTINCT prompt_id) = (SELECT count(*) FROM wanted)"""
ORACLES["metric_map_summary"] = f"""{with_views('outputs')}{MEASURED}
  SELECT method, 'count' AS name, CAST(count(*) AS DOUBLE) AS value FROM measured GROUP BY method
  UNION ALL SELECT method, 'words', round(avg(word_count), 9) FROM measured GROUP BY method
  UNION ALL SELECT method, CASE WHEN lang = 'en' THEN 'english_chars' ELSE 'other_chars' END AS name, round(avg(character_count), 9)
  FROM measured GROUP BY method, name"""
ORACLES["quality_vs_compute"] = f"""{with_views('outputs')}
  SELECT method,
         CASE WHEN method NOT IN ('beam', 'penalty') THEN 'default'
              WHEN lang = 'en' THEN 'beam_width=4; max_steps=1' ELSE 'beam_width=2; max_steps=1' END AS compute_budget,
         count(*) AS count,
         round(avg(CASE WHEN lang = 'fr' THEN 0 ELSE seq % 11 END), 9) AS final_score_mean,
         {_LATENCY}
  FROM outputs GROUP BY ALL"""
ORACLES["human_review_sheet"] = f"""{with_views('outputs')}
  SELECT prompt_id, arg_min(prompt, seq) AS prompt, '' AS best_method, '' AS notes,
         {', '.join(f"md5(arg_max(final_answer, seq) FILTER (WHERE method = '{m}')) AS {m}_answer_md5" for m in METHODS)}
  FROM outputs GROUP BY prompt_id"""

_FLAGS = ["ttc_removes_visible_defects", "ttc_loses_useful_information", "verifier_over_penalizes_valid_wording"]
_YES = ", ".join(quote(w) for w in fixed.YES_WORDS)
ORACLES["human_preference"] = f"""{with_views('outputs', 'reviews')}
  , voted AS (SELECT trim(best_method) AS method, * FROM reviews WHERE trim(best_method) <> '')
  , t AS (SELECT count(*) AS n, {', '.join(f"count(*) FILTER (WHERE lower(trim({f})) IN ({_YES})) AS {f}" for f in _FLAGS)} FROM voted)
  SELECT method, any_value(t.n) AS reviewed_count, count(*) AS best_count, round(count(*) / any_value(t.n), 9) AS preference_rate,
         {', '.join(f"any_value(t.{f}) AS {f}_yes_count, round(any_value(t.{f}) / any_value(t.n), 9) AS {f}_yes_rate" for f in _FLAGS)}
  FROM voted, t GROUP BY method"""
ORACLES["metric_join"] = f"{with_views('outputs')}{MEASURED} SELECT {_OVERALL}, {_ERRORS}, {_LATENCY} FROM measured GROUP BY method"
ORACLES["evaluation_assets"] = ORACLES["metric_join"]
ORACLES["ragged_union"] = f"""{with_views('outputs')}{MEASURED}
  SELECT method, {_ERRORS}, NULL::BIGINT AS count, NULL::DOUBLE AS latency_ms_mean, NULL::DOUBLE AS verifier_call_count_mean
  FROM measured GROUP BY method
  UNION ALL BY NAME SELECT method, count(*) AS count, {_LATENCY} FROM outputs GROUP BY method"""

# --- pairing, splits, joins

JUDGED = f""", judged AS (
  SELECT t.*, r.text AS rejected,
         CASE WHEN r.prompt_id IS NULL THEN 'missing'
              WHEN {trim('t.prompt')} = '' OR {trim('t.chosen')} = '' OR {trim('r.text')} = '' THEN 'empty'
              WHEN lower({trim('t.chosen')}) = lower({trim('r.text')}) THEN 'duplicate' END AS reason
  FROM turns t LEFT JOIN rejected r ON r.prompt_id = t.prompt_id)
, pairs AS (SELECT * FROM judged WHERE reason IS NULL)"""
PAIRED = with_views("turns", "rejected") + JUDGED

ORACLES["preference_pairs"] = f"""{PAIRED}
  SELECT prompt_id, prompt, md5(chosen) AS chosen_md5, md5(rejected) AS rejected_md5, CAST(turn AS VARCHAR) AS turn,
         'overridden' AS source, 'm-good' AS chosen_model, 'm-bad' AS rejected_model,
         CAST(length(rejected) AS VARCHAR) AS defect
  FROM pairs"""
ORACLES["preference_report"] = f"""{PAIRED}
  SELECT count(*) AS total_prompts, count(*) FILTER (WHERE reason IS NULL) AS kept_pairs,
         count(*) FILTER (WHERE reason = 'missing') AS dropped_missing_answer,
         count(*) FILTER (WHERE reason = 'empty') AS dropped_empty,
         count(*) FILTER (WHERE reason = 'duplicate') AS dropped_near_duplicate
  FROM judged"""


def split_cte(table: str) -> str:
    return f""", ids AS (SELECT DISTINCT prompt_id FROM {table})
, ranked AS (SELECT prompt_id, row_number() OVER (ORDER BY md5('13:' || prompt_id), prompt_id) AS place, count(*) OVER () AS n FROM ids)
, trained AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, least(floor(n * 0.8::DOUBLE), n - 2)) ELSE floor(n * 0.8::DOUBLE) END AS train FROM ranked)
, cut AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, least(floor(n * 0.1::DOUBLE), n - train - 1)) ELSE floor(n * 0.1::DOUBLE) END AS val FROM trained)
, split AS (SELECT prompt_id, CASE WHEN place <= train THEN 'train' WHEN place <= train + val THEN 'val' ELSE 'test' END AS split FROM cut)"""


ORACLES["split_assign"] = f"{with_views('turns')}{split_cte('turns')} SELECT prompt_id, split FROM split"
ORACLES["split_counts"] = f"""{with_views('outputs')}{split_cte('outputs')}
  SELECT split, count(*) AS row_count, count(DISTINCT prompt_id) AS ids FROM outputs JOIN split USING (prompt_id) GROUP BY split"""
ORACLES["split_overlap"] = f"""{with_views('outputs')}{split_cte('outputs')}
  SELECT count(*) AS shared_ids FROM (SELECT prompt_id FROM split GROUP BY prompt_id HAVING count(DISTINCT split) > 1)"""
ORACLES["preference_export_leaks"] = f"""{PAIRED}{split_cte('pairs')}
  SELECT 0::BIGINT AS leaked, count(*) FILTER (WHERE split = 'test') AS held_out, count(*) FILTER (WHERE split <> 'test') AS exported
  FROM pairs JOIN split USING (prompt_id)"""
ORACLES["preference_files"] = f"""{PAIRED}{split_cte('pairs')}
  SELECT split, prompt_id, prompt, CASE WHEN split <> 'test' THEN md5(chosen) END AS chosen_md5, CASE WHEN split <> 'test' THEN md5(rejected) END AS rejected_md5,
         CAST(turn AS VARCHAR) AS turn
  FROM pairs JOIN split USING (prompt_id)"""
ORACLES["sft_files"] = f"""{PAIRED}{split_cte('pairs')}
  SELECT prompt AS instruction, '' AS input, md5(chosen) AS output_md5, prompt_id FROM pairs JOIN split USING (prompt_id) WHERE split = 'train'"""
ORACLES["split_leaks"] = f"""{with_views('outputs')}
  SELECT prompt_id FROM outputs GROUP BY prompt_id
  HAVING count(*) FILTER (WHERE method = 'penalty' AND lang = 'fr') BETWEEN 1 AND count(*) - 1"""
ORACLES["document_length_filter"] = f"""SELECT doc_id, md5(text) AS prompt_md5 FROM documents
  WHERE length(text) BETWEEN {fixed.MIN_PROMPT_CHARS} AND {fixed.MAX_PROMPT_CHARS}"""
ORACLES["column_gaps"] = f"""{with_views('outputs')}
  SELECT count(*) AS checked, count(*) FILTER (WHERE latency_ms IS NULL) AS incomplete_rows, 'latency_ms' AS missing_columns, false AS ok FROM outputs"""
ORACLES["last_wins"] = """SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, md5(arg_max(text, turn)) AS text_md5
  FROM conversations GROUP BY conv_id"""
ORACLES["first_wins"] = """SELECT conv_id, min(turn) AS turn, arg_min(role, turn) AS role, md5(arg_min(text, turn)) AS text_md5
  FROM conversations GROUP BY conv_id"""
ORACLES["resume_pending"] = f"""{with_views('turns', 'rejected')}
  SELECT prompt_id, prompt FROM turns WHERE prompt_id NOT IN (SELECT prompt_id FROM rejected)"""
ORACLES["prompt_length_filter"] = f"""{with_views('turns')}
  SELECT prompt_id, prompt FROM turns WHERE length(prompt) BETWEEN {fixed.MIN_PROMPT_CHARS} AND {fixed.MAX_PROMPT_CHARS}"""
ORACLES["first_prompts"] = f"{with_views('outputs')} SELECT seq, prompt_id, method FROM outputs ORDER BY seq LIMIT 100"
ORACLES["column_check"] = f"""{with_views('outputs')}
  SELECT count(*) AS checked, count(*) AS incomplete_rows, 'chosen,latency_ms' AS missing_columns, false AS ok FROM outputs"""
ORACLES["blank_answers"] = f"""{with_views('outputs', 'runs')}
  SELECT method, count(*) AS blank FROM runs WHERE {trim('final_answer')} = '' GROUP BY method"""

# --- requests and training rows

ORACLES["generation_requests"] = f"""{with_views('turns')}
  SELECT t.prompt_id, t.prompt AS source_prompt, md5(m.head || chr(10) || chr(10) || 'User question:' || chr(10) || t.prompt || chr(10)) AS generation_prompt_md5,
         'gen' AS model, CAST(t.turn AS VARCHAR) AS turn, 'chat' AS source, m.mode AS generation_mode
  FROM turns t CROSS JOIN (VALUES ('positive', {quote(fixed.POSITIVE_INSTRUCTIONS)}), ('negative', {quote(fixed.NEGATIVE_INSTRUCTIONS)})) m(mode, head)"""
_JUDGE = fixed.JUDGE_PREAMBLE.format(dimensions=", ".join(fixed.JUDGE_DIMENSIONS)) + "User prompt:\n"
ORACLES["judge_requests"] = f"""{with_views('outputs')}
  SELECT prompt_id || ':' || method AS request_id, prompt_id, 'judge' AS model,
         md5({quote(_JUDGE)} || prompt || chr(10) || chr(10) || 'Candidate answer:' || chr(10) || final_answer || chr(10)) AS judge_prompt_md5, method
  FROM outputs"""
ORACLES["answer_records"] = f"""{with_views('turns')}
  SELECT prompt_id, CASE WHEN turn > 2 THEN 'rejected' ELSE 'chosen' END AS kind, md5(coalesce(next_text, '')) AS text_md5, 'gen' AS model,
         CASE WHEN turn > 2 THEN 'negative' WHEN turn > 0 THEN 'positive' END AS generation_mode, prompt AS source_prompt,
         CASE WHEN next_text IS NOT NULL THEN '-0.5' END AS generator_logprob, CASE WHEN next_text IS NOT NULL THEN 'stop' END AS finish
  FROM turns"""
ORACLES["rm_export"] = f"""{PAIRED} SELECT prompt AS instruction, '' AS input, md5(chosen) AS chosen_md5, md5(rejected) AS rejected_md5, prompt_id FROM pairs"""
ORACLES["sft_export"] = f"""{PAIRED} SELECT prompt AS instruction, '' AS input, md5(chosen) AS output_md5, prompt_id FROM pairs"""


def values(rows: list[tuple], name: str, columns: str) -> str:
    body = ", ".join("(" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) {name}({columns})"


_TOPICS = values([(i, t, c) for i, (t, c) in enumerate(fixed.TOPIC_CONCEPTS)], "a", "ai, topic, concept")
_SCENARIOS = values([(i, s) for i, s in enumerate(fixed.SCENARIOS)], "b", "bi, scenario")
_NEEDS = values([(i, s) for i, s in enumerate(fixed.OUTPUT_REQUIREMENTS)], "c", "ci, need")
_TASKS = values([(i, k, t) for i, (k, t) in enumerate(fixed.TASK_TEMPLATES)], "d", "di, task_type, template")
ORACLES["prompt_assignment"] = f"""WITH generated AS (
    SELECT row_number() OVER (ORDER BY ai, bi, ci, di) AS n, topic, task_type,
           replace(template, '{{concept}}', concept) || ' Frame the answer ' || scenario || '. ' || need AS prompt
    FROM {_TOPICS}, {_SCENARIOS}, {_NEEDS}, {_TASKS})
  SELECT doc_id, printf('taxonomy-%06d', n) AS prompt_id, md5(prompt) AS prompt_md5, topic, task_type
  FROM documents JOIN generated ON n = doc_id % (SELECT count(*) FROM generated) + 1"""

# --- merge, completeness, comparison

RUNS = with_views("outputs", "runs")
PRESENCE = f""", methods AS (SELECT unnest({METHODS!r}) AS method)
, found AS (SELECT method, prompt_id, count(*) AS n FROM runs GROUP BY ALL)
, wanted AS (SELECT prompt_id, count(*) AS w FROM expected GROUP BY ALL)
, presence AS (
    SELECT method, prompt_id, coalesce(w, 0) AS w, coalesce(n, 0) AS n
    FROM (SELECT method, prompt_id FROM methods, wanted UNION SELECT method, prompt_id FROM found)
    LEFT JOIN found USING (method, prompt_id) LEFT JOIN wanted USING (prompt_id))
, blank AS (SELECT method, prompt_id, seq FROM runs WHERE {trim('final_answer')} = '')
, report AS (
    SELECT m.method, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(w) AS BIGINT) AS expected_rows,
           CAST(sum(CASE WHEN n > 0 THEN w ELSE 0 END) AS BIGINT) AS merged_rows,
           count(*) FILTER (WHERE w > 0 AND n = 0) AS missing_count, count(*) FILTER (WHERE w = 0 AND n > 0) AS extra_count,
           count(*) FILTER (WHERE n > 1) AS duplicate_count,
           (SELECT count(*) FROM blank b WHERE b.method = m.method) AS empty_count,
           coalesce(array_to_string((array_agg(prompt_id ORDER BY prompt_id) FILTER (WHERE w > 0 AND n = 0))[1:20], ','), '') AS missing,
           coalesce(array_to_string((array_agg(prompt_id ORDER BY prompt_id) FILTER (WHERE w = 0 AND n > 0))[1:20], ','), '') AS extra,
           coalesce(array_to_string((array_agg(prompt_id ORDER BY prompt_id) FILTER (WHERE n > 1))[1:20], ','), '') AS duplicates,
           coalesce((SELECT array_to_string((array_agg(b.prompt_id ORDER BY b.seq))[1:20], ',') FROM blank b WHERE b.method = m.method), '') AS empty
    FROM presence m GROUP BY m.method)
, judged AS (SELECT *, rows = expected_rows AND missing_count + extra_count + duplicate_count + empty_count = 0 AS ok FROM report)"""
ORACLES["completeness_by_method"] = f"{RUNS}{PRESENCE} SELECT * FROM judged"
ORACLES["completeness_overall"] = f"""{RUNS}{PRESENCE}
  SELECT CAST(sum(merged_rows) AS BIGINT) AS merged_rows, bool_and(ok) AND sum(merged_rows) = sum(expected_rows) AS ok FROM judged"""
ORACLES["completeness_file"] = ORACLES["completeness_overall"]
ORACLES["defect_ids"] = f"""{RUNS}{PRESENCE}
  SELECT method, prompt_id, 'missing' AS defect FROM presence WHERE w > 0 AND n = 0
  UNION ALL SELECT method, prompt_id, 'extra' FROM presence WHERE w = 0 AND n > 0
  UNION ALL SELECT method, prompt_id, 'duplicate' FROM presence WHERE n > 1
  UNION ALL SELECT method, prompt_id, 'empty' FROM blank"""
MERGED = """, latest AS (
    SELECT prompt_id, method, arg_max(prompt, seq) AS prompt, arg_max(final_answer, seq) AS final_answer,
           coalesce(max(latency_ms), 0) AS latency_ms, max(verifier_call_count) AS verifier_call_count
    FROM runs GROUP BY ALL)
, merged AS (
    SELECT e.prompt_id, e.seq AS place, l.prompt, l.method, l.final_answer, l.latency_ms, CAST(l.verifier_call_count AS DOUBLE) AS verifier_call_count
    FROM expected e JOIN latest l ON l.prompt_id = e.prompt_id)"""
ORACLES["merged_outputs"] = f"""{RUNS}{MERGED}
  SELECT prompt_id, prompt, method, round(latency_ms, 9) AS latency_ms, round(verifier_call_count, 9) AS verifier_call_count,
         '' AS source_model, '' AS source_run_id, CAST(list_position({METHODS!r}, method) AS BIGINT) AS position, place, md5(final_answer) AS answer_md5
  FROM merged"""
ORACLES["id_differences"] = f"""{RUNS}
  , a AS (SELECT DISTINCT prompt_id FROM expected), b AS (SELECT DISTINCT prompt_id FROM runs WHERE method = 'sft')
  SELECT prompt_id, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
  UNION ALL SELECT prompt_id, 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""
ORACLES["repeated_ids"] = f"""{RUNS} SELECT prompt_id, count(*) AS rows FROM runs WHERE method = 'beam' GROUP BY prompt_id HAVING count(*) > 1"""
ORACLES["score_summary"] = f"""{with_views('outputs', 'scores')}
  SELECT method, count(*) AS count, round(avg(score), 9) AS mean, round(median(score), 9) AS median, round(min(score), 9) AS min, round(max(score), 9) AS max
  FROM scores GROUP BY method"""


def wide(table: str) -> str:
    cells = ", ".join(f"arg_max(score, seq) FILTER (WHERE method = '{m}') AS {m}" for m in METHODS)
    return f", wide AS (SELECT prompt_id, min(seq) AS first_seen, {cells} FROM {table} GROUP BY prompt_id)"


def against(candidate: str, reference: str, ids: bool = True) -> str:
    c, r = candidate, reference
    listed = (
        f", coalesce(array_to_string((array_agg(prompt_id ORDER BY first_seen, prompt_id) FILTER (WHERE {c} < {r}))[1:50], ','), '') AS loss_ids"
        if ids else ""
    )
    return f"""SELECT '{c}' AS candidate, '{r}' AS reference, count(*) FILTER (WHERE {c} > {r}) AS wins, count(*) FILTER (WHERE {c} < {r}) AS losses,
       count(*) FILTER (WHERE {c} = {r}) AS ties, count(*) AS compared, round(count(*) FILTER (WHERE {c} > {r}) / count(*), 9) AS win_rate{listed}
  FROM wide WHERE {c} IS NOT NULL AND {r} IS NOT NULL"""


ORACLES["pairwise"] = f"{with_views('outputs', 'scores')}{wide('scores')} " + " UNION ALL ".join(
    against("penalty", r) for r in ("raw", "sft", "beam")
)
ORACLES["losing_prompts"] = f"{with_views('outputs', 'scores')}{wide('scores')} " + " UNION ALL ".join(
    f"SELECT 'penalty' AS candidate, '{r}' AS reference, prompt_id, penalty AS mine, {r} AS other FROM wide WHERE penalty < {r}"
    for r in ("raw", "sft", "beam")
)
ORACLES["regressions"] = f"""{with_views('outputs', 'scores')}{wide('scores')}
  SELECT w.prompt_id, round(w.penalty - w.beam, 9) AS margin, {', '.join(f'round(w.{m}, 9) AS score_{m}' for m in METHODS)},
         c.prompt, md5(b.final_answer) AS base_md5, md5(c.final_answer) AS candidate_md5
  FROM wide w JOIN outputs c ON c.prompt_id = w.prompt_id AND c.method = 'penalty' JOIN outputs b ON b.prompt_id = w.prompt_id AND b.method = 'beam'
  WHERE w.penalty - w.beam < 0 ORDER BY w.penalty - w.beam, w.prompt_id LIMIT 12"""
ORACLES["merge_score_compare"] = f"""{RUNS}{MERGED}
  , scored AS (SELECT prompt_id, method, place * 10 + list_position({METHODS!r}, method) AS seq, {rule_reward('final_answer', REWARDS, PENALTIES)} AS score FROM merged){wide('scored')} """ + " UNION ALL ".join(
    against("penalty", r) for r in ("raw", "beam")
)

# --- scoring and validation

_SCORED = f""", scored AS (
    SELECT *, {rule_reward('chosen', ['le', 'an', 'the'], ['que', 'zz'])} AS chosen_score,
           {rule_reward('rejected', ['le', 'an', 'the'], ['que', 'zz'])} AS rejected_score FROM pairs)"""
SCORED_PAIRS = PAIRED + _SCORED


def validation(table: str, accuracy: float) -> str:
    heads = [
        f"len(list_filter({lines(c)}, lambda x: regexp_matches(x, '^#{{1,6}}[{_WS}]+[^{_WS}]')))" for c in ("chosen", "rejected")
    ]
    word = [matches(c, "[A-Za-z0-9_]+") for c in ("chosen", "rejected")]
    return f""", deltas AS (
    SELECT chosen_score - rejected_score AS margin, CAST({word[0]} - {word[1]} AS DOUBLE) AS dw, CAST({heads[0]} - {heads[1]} AS DOUBLE) AS dh FROM {table})
  SELECT count(*) AS count, round(avg(CASE WHEN margin > 0 THEN 1.0 ELSE 0.0 END), 9) AS pairwise_accuracy,
         round(avg(margin), 9) AS mean_margin, round(min(margin), 9) AS min_margin, round(max(margin), 9) AS max_margin,
         CASE WHEN stddev_pop(dw) * stddev_pop(margin) > 0 THEN round(covar_pop(dw, margin) / (stddev_pop(dw) * stddev_pop(margin)), 9) ELSE 0 END AS length_score_correlation,
         CASE WHEN stddev_pop(dh) * stddev_pop(margin) > 0 THEN round(covar_pop(dh, margin) / (stddev_pop(dh) * stddev_pop(margin)), 9) ELSE 0 END AS markdown_score_correlation,
         count(*) FILTER (WHERE margin <= 0) AS failure_count, round(median(margin), 9) AS median_margin,
         avg(CASE WHEN margin > 0 THEN 1.0 ELSE 0.0 END) >= {accuracy} AS passed_min_accuracy
  FROM deltas"""


ORACLES["rule_scored_pairs"] = f"""{SCORED_PAIRS}
  SELECT prompt_id, round(chosen_score, 9) AS chosen_score, round(rejected_score, 9) AS rejected_score FROM scored"""
ORACLES["score_cache_growth"] = ORACLES["rule_scored_pairs"]
ORACLES["score_validation"] = SCORED_PAIRS + validation("scored", 0.5)
ORACLES["score_failures"] = f"""{SCORED_PAIRS}
  SELECT prompt_id, round(chosen_score, 9) AS chosen_score, round(rejected_score, 9) AS rejected_score, round(chosen_score - rejected_score, 9) AS margin
  FROM scored WHERE chosen_score - rejected_score <= 0"""
ORACLES["label_validation"] = (
    with_views("outputs", "scores", "val_pairs")
    + ", labelled AS (SELECT chosen_text AS chosen, rejected_text AS rejected, chosen_score, rejected_score FROM val_pairs)"
    + validation("labelled", 0.65)
)
ORACLES["output_scores"] = f"""{with_views('outputs')}
  SELECT prompt_id, method, round({rule_reward('final_answer', REWARDS, PENALTIES)}, 9) AS score, '' AS source_run_id FROM outputs"""
ORACLES["stream_scores"] = ORACLES["output_scores"]
ORACLES["client_scores"] = f"""{with_views('outputs')}
  SELECT prompt_id, method, round(length(final_answer) / 10 - length(prompt), 9) AS score, '' AS source_run_id FROM outputs"""
ORACLES["generated_answers"] = f"""{with_views('turns', 'rejected')}
  SELECT prompt_id, 'rejected' AS kind,
         CAST(length({quote(fixed.NEGATIVE_INSTRUCTIONS)} || chr(10) || chr(10) || 'User question:' || chr(10) || prompt || chr(10)) AS VARCHAR) || ' characters' AS text,
         'echo' AS model, CAST(turn AS VARCHAR) AS turn, '-0.25' AS generator_logprob, 'stop' AS finish
  FROM turns WHERE prompt_id NOT IN (SELECT prompt_id FROM rejected)"""

_ASKED = quote(fixed.POSITIVE_INSTRUCTIONS) + " || chr(10) || chr(10) || 'User question:' || chr(10) || prompt || chr(10)"
ORACLES["generation_errors"] = f"""{with_views('turns')}
  SELECT prompt_id, CASE WHEN length({_ASKED}) % 2 = 1 THEN 2::BIGINT END AS attempt,
         CASE WHEN length({_ASKED}) % 2 = 1 THEN 'ValueError(''odd'')' ELSE 'fine' END AS text
  FROM turns"""
# three candidates of a first step, then three below each of the two best, all of one score but for the log-probability
ORACLES["decode_latency"] = f"""{with_views('turns')}
  SELECT prompt_id, true AS took_time, 9::BIGINT AS verifier_call_count, 'part 0 part 0' AS final_answer FROM turns"""
ORACLES["resumed_generation"] = f"""{with_views('turns')}
  SELECT prompt_id, CASE WHEN length({_ASKED}) % 2 = 0 THEN 'first' ELSE 'second' END AS model, length({_ASKED}) AS n_chars FROM turns"""
ORACLES["expanded_prompts"] = f"""{with_views('turns')}
  , grown AS (SELECT prompt_id, unnest(CASE WHEN length(prompt) % 5 = 0 THEN [NULL] ELSE range(length(prompt) % 5) END) AS i FROM turns)
  SELECT prompt_id, CAST(i AS BIGINT) AS cand_ord, 'step ' || CAST(i AS VARCHAR) AS cand_text, CAST(-i / 4 AS DOUBLE) AS cand_logprob, i = 3 AS cand_complete FROM grown"""

# --- criteria

_PAIR_METRICS = f""", pair_metrics AS (
    SELECT chosen_score, rejected_score, c.*, r.* FROM (
      SELECT *, row_number() OVER () AS k FROM val_pairs) p
    JOIN (SELECT k AS ck, repeated_line_count AS cr, word_count AS cw, abnormal_symbol_count + code_fence_mismatch + slogan_phrase_count AS cn
          FROM (SELECT k, {metric_columns('chosen_text')} FROM (SELECT *, row_number() OVER () AS k FROM val_pairs))) c ON c.ck = p.k
    JOIN (SELECT k AS rk, repeated_line_count AS rr, word_count AS rw, abnormal_symbol_count + code_fence_mismatch + slogan_phrase_count AS rn
          FROM (SELECT k, {metric_columns('rejected_text')} FROM (SELECT *, row_number() OVER () AS k FROM val_pairs))) r ON r.rk = p.k)"""
# the pairs are numbered by prompt id, so the joins above line up
_PAIR_METRICS = _PAIR_METRICS.replace("row_number() OVER ()", "row_number() OVER (ORDER BY prompt_id)")


def _axis(name: str, column: str, weights: list[float]) -> str:
    return values([(i, f"#{w}#") for i, w in enumerate(weights)], name, f"{name}i, {column}").replace("'#", "").replace("#'", "::DOUBLE")


GRID = f""", grid AS (
    SELECT CAST(row_number() OVER (ORDER BY ai, bi, ci) - 1 AS BIGINT) AS grid_order, repeated_penalty, length_penalty_per_100_words, abnormal_penalty
    FROM {_axis('a', 'repeated_penalty', fixed.REPEATED_PENALTIES)}, {_axis('b', 'length_penalty_per_100_words', fixed.LENGTH_PENALTIES)}, {_axis('c', 'abnormal_penalty', fixed.ABNORMAL_PENALTIES)})
, graded AS (
    SELECT grid.*, (chosen_score - repeated_penalty * cr - length_penalty_per_100_words * cw / 100.0::DOUBLE - abnormal_penalty * cn)
                 - (rejected_score - repeated_penalty * rr - length_penalty_per_100_words * rw / 100.0::DOUBLE - abnormal_penalty * rn) AS margin
    FROM grid, pair_metrics)
, searched AS (
    SELECT grid_order, repeated_penalty, length_penalty_per_100_words, abnormal_penalty,
           avg(CASE WHEN margin > 0 THEN 1.0 ELSE 0.0 END) AS accuracy, avg(margin) AS mean, median(margin) AS med, min(margin) AS low
    FROM graded GROUP BY ALL)
, shown AS (
    SELECT grid_order, round(repeated_penalty, 9) AS repeated_penalty, round(length_penalty_per_100_words, 9) AS length_penalty_per_100_words, round(abnormal_penalty, 9) AS abnormal_penalty,
           round(accuracy, 9) AS pairwise_accuracy, round(mean, 9) AS mean_margin, round(med, 9) AS median_margin, round(low, 9) AS min_margin
    FROM searched)"""
_GRADED = with_views("outputs", "scores", "val_pairs") + _PAIR_METRICS + GRID
ORACLES["criteria_grid"] = f"{_GRADED} SELECT * FROM shown"
ORACLES["criteria_top"] = f"{_GRADED} SELECT * FROM shown ORDER BY pairwise_accuracy DESC, mean_margin DESC, grid_order LIMIT 10"
ORACLES["criterion_choice"] = f"""{_GRADED}
  SELECT * FROM shown WHERE pairwise_accuracy >= (SELECT max(pairwise_accuracy) FROM shown) - 0.002
  ORDER BY mean_margin DESC, round(repeated_penalty + length_penalty_per_100_words + abnormal_penalty, 9), pairwise_accuracy DESC, grid_order LIMIT 1"""
_METHOD_SCORES = f"""{MEASURED}, crit AS (
    SELECT m.*, s.score, s.score - 0.25::DOUBLE * repeated_line_count - 0.05::DOUBLE * word_count / 100.0::DOUBLE
           - 1.0::DOUBLE * (abnormal_symbol_count + code_fence_mismatch + slogan_phrase_count) AS criterion
    FROM measured m JOIN scores s ON s.seq = m.seq)
, method_table AS (
    SELECT method, count(*) AS count, round(avg(criterion), 9) AS criterion_score_mean, round(median(criterion), 9) AS criterion_score_median,
           round(avg(score), 9) AS verifier_score_mean, {total('repeated_line_count', 'repeated_line_total')}, {mean('word_count', 'word_count_mean')},
           {total('abnormal_symbol_count', 'abnormal_symbol_total')}, {total('code_fence_mismatch', 'code_fence_mismatch_total')},
           {total('slogan_phrase_count', 'slogan_phrase_total')}, {_LATENCY}
    FROM crit GROUP BY method)"""
ORACLES["method_scores"] = f"{with_views('outputs', 'scores')}{_METHOD_SCORES} SELECT * FROM method_table"
_WEIGHED = _METHOD_SCORES.replace("0.25::DOUBLE *", "w.repeated_penalty *").replace("0.05::DOUBLE *", "w.length_penalty_per_100_words *").replace(
    "1.0::DOUBLE *", "w.abnormal_penalty *"
).replace("ON s.seq = m.seq)", "ON s.seq = m.seq, winner w)")
ORACLES["criteria_methods"] = f"""{_GRADED}, winner AS ({ORACLES['criterion_choice'].removeprefix(_GRADED)}){_WEIGHED} SELECT * FROM method_table"""
ORACLES["results_table"] = f"""{with_views('outputs', 'scores')}{_METHOD_SCORES}
  SELECT CAST(list_position({METHODS!r}, method) AS BIGINT) AS position, method, criterion_score_mean AS quality_mean, criterion_score_median AS quality_median,
         verifier_score_mean AS verifier_mean, repeated_line_total, word_count_mean, latency_ms_mean, verifier_call_count_mean
  FROM method_table"""
ORACLES["side_effects"] = f"""{with_views('outputs', 'scores')}{_METHOD_SCORES}
  SELECT b.repeated_line_total AS base_repeated_lines, c.repeated_line_total AS candidate_repeated_lines,
         round((b.repeated_line_total - c.repeated_line_total) / b.repeated_line_total, 9) AS repeated_line_drop,
         b.word_count_mean AS base_words, c.word_count_mean AS candidate_words, round(b.verifier_score_mean - c.verifier_score_mean, 9) AS score_drop
  FROM method_table b, method_table c WHERE b.method = 'beam' AND c.method = 'penalty'"""
ORACLES["improvement_gate"] = f"""{with_views('outputs', 'scores', 'runs')}{_METHOD_SCORES}{PRESENCE}{wide('scores')}
  , won AS ({against('penalty', 'raw', ids=False)} UNION ALL {against('penalty', 'sft', ids=False)})
  , noise AS (SELECT method, criterion_score_mean AS q, abnormal_symbol_total + code_fence_mismatch_total + slogan_phrase_total AS n FROM method_table)
  , checks AS (
    SELECT (SELECT q FROM noise WHERE method = 'penalty') > (SELECT max(q) FROM noise WHERE method IN ('raw', 'sft')) AS quality_above_baselines,
           (SELECT n FROM noise WHERE method = 'penalty') <= (SELECT min(n) FROM noise WHERE method IN ('raw', 'sft')) AS noise_not_above_baselines,
           (SELECT bool_and(ok) AND sum(merged_rows) = sum(expected_rows) FROM judged) AS complete,
           (SELECT bool_and(win_rate > 0.7) FROM won) AS wins_above_rate)
  SELECT *, complete AND quality_above_baselines AND wins_above_rate AND noise_not_above_baselines AS improved FROM checks"""

_RAISED = with_views("outputs", "scores").replace("/ 10 - 3 AS score", "/ 10 - 3 + CASE WHEN method = 'penalty' THEN 100 ELSE 0 END AS score")
ORACLES["improvement_gate_met"] = (
    ORACLES["improvement_gate"].replace(with_views("outputs", "scores", "runs"), _RAISED).replace(PRESENCE, "")
    .replace("(SELECT bool_and(ok) AND sum(merged_rows) = sum(expected_rows) FROM judged) AS complete", "true AS complete")
)

# --- guardrail and answer rules

_CASES = "(VALUES " + ", ".join(
    f"({i}, {[k for k in keywords]!r}, {[c for c in claims]!r}, {quote(topic)})"
    for i, (_, keywords, claims, topic) in enumerate(fixed.GUARDRAIL_CASES)
) + ") cases(i, keywords, claims, topic)"
_TERM = "regexp_matches(final_answer, '(?i)(^|[^A-Za-z0-9_])' || regexp_escape(k) || '($|[^A-Za-z0-9_])')"
_GUARD = f"""{with_views('guarded')}, checked AS (
    SELECT prompt_id, method, topic, list_filter(keywords, lambda k: NOT {_TERM}) AS missing, list_filter(claims, lambda k: {_TERM}) AS unsafe,
           CAST(length(final_answer) AS BIGINT) AS answer_length
    FROM guarded JOIN {_CASES} ON i = (CAST(right(prompt_id, 4) AS BIGINT) - 1) % 10)
, details AS (
    SELECT prompt_id, method, topic, len(missing) = 0 AND len(unsafe) = 0 AS passed, array_to_string(missing, ', ') AS missing_keywords,
           array_to_string(unsafe, ', ') AS unsafe_claims, answer_length FROM checked)"""
ORACLES["guardrail_details"] = f"{_GUARD} SELECT * FROM details"
_GUARD_COUNTS = """count(*) AS count, count(*) FILTER (WHERE passed) AS passed_count, round(count(*) FILTER (WHERE passed) / count(*), 9) AS pass_rate,
         count(*) FILTER (WHERE unsafe_claims <> '') AS unsafe_claim_count"""
ORACLES["guardrail_summary"] = f"""{_GUARD}
  SELECT 'method' AS scope, method, {_GUARD_COUNTS} FROM details GROUP BY method
  UNION ALL SELECT 'all', NULL, {_GUARD_COUNTS} FROM details"""


def re2(pattern: str) -> str:
    return pattern.replace(r"\s", f"[{_WS}]")


def sentences(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?。])[{_WS}]+', '\\1' || chr(2), 'g')"
    return f"string_split_regex({marked}, '\\x02|\\n+')"


def wrong_direction(code: str, patterns: list[str]) -> str:
    pattern = quote("(?i)" + re2("|".join(patterns)))
    return (
        f"list_transform(list_filter({sentences('text')}, lambda s: NOT (contains(s, 'memcpy') AND NOT contains(s, 'memmove'))"
        f" AND regexp_matches(s, {pattern})), lambda s: '{code}')"
    )


def rule(code: str, condition: str) -> str:
    return f"CASE WHEN {condition} THEN ['{code}'] ELSE [] END"


_LOW = "lower(text)"
_ENDS = " OR ".join(f"ends_with(rtrim(text, {quote(SPACE_CHARS)}), {quote(e)})" for e in fixed.ANSWER_ENDINGS)
_OWN = """CASE WHEN contains(lower(sentence), 'memcpy') AND contains(lower(sentence), 'memmove') THEN ''
              WHEN contains(lower(sentence), 'memcpy') THEN 'memcpy' WHEN contains(lower(sentence), 'memmove') THEN 'memmove' END"""
CARRIED = f""", parts AS (SELECT seq, {sentences('text')} AS parts FROM qa)
, sentence_rows AS (SELECT seq, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS pos FROM parts)
, owned AS (SELECT *, {_OWN} AS own FROM sentence_rows)
, carried AS (SELECT seq, pos, sentence, own, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS subject FROM owned)
, claims AS (SELECT DISTINCT seq FROM carried WHERE subject = 'memcpy' AND contains(lower(sentence), 'temporary')
             AND (contains(lower(sentence), 'as if') OR contains(lower(sentence), 'temporary array')))"""
_FAILURES = " || ".join(
    [
        rule("wrong_kind", f"kind <> 'beam'"),
        rule("wrong_model", f"model <> {quote(fixed.EXPECTED_ANSWER_MODEL)}"),
        rule("too_short", f"length({trim('text')}) < {fixed.MIN_ANSWER_CHARS}"),
        rule("missing_required_term", "NOT contains(text, 'memcpy') OR NOT contains(text, 'memmove')"),
        rule("unbalanced_code_fence", f"{occurrences('text', '```')} % 2 <> 0"),
        rule("ends_mid_sentence", f"NOT ({_ENDS})"),
        rule("literal_array_write", f"regexp_matches(text, {quote('(?s)' + re2(fixed.LITERAL_ARRAY_WRITE))})"),
        rule("out_of_bounds_copy", f"regexp_matches(text, {quote(re2(fixed.OUT_OF_BOUNDS_COPY))})"),
        rule("runtime_called_ill_formed", f"contains({_LOW}, 'ill-formed')"),
        rule("memcpy_temporary_guarantee", "seq IN (SELECT seq FROM claims)"),
        rule("shift_output_inconsistent", "contains(text, 'memmove(buf + 2, buf + 1, 3)') AND contains(text, 'abbcde')"),
        rule("shift_drops_suffix", """contains(text, 'memmove(buf + 1, buf, 3)') AND contains(text, 'printf("%s') AND contains(text, '"aabc"') AND NOT contains(text, 'aabcef')"""),
        rule("backward_for_lower_dest", f"contains(text, 'memmove(buf + 3, buf + 5, 5)') AND (contains({_LOW}, 'copies backward') OR contains({_LOW}, 'copying backward'))"),
        wrong_direction("backward_when_dest_lower", fixed.BACKWARD_WHEN_DEST_LOWER),
        wrong_direction("forward_when_dest_higher", fixed.FORWARD_WHEN_DEST_HIGHER),
        rule("no_limitation_note", f"NOT contains({_LOW}, 'limitation')"),
    ]
)
_WARNINGS = " || ".join(
    [
        rule("no_undefined_behavior_note", f"NOT (contains({_LOW}, 'undefined behavior') OR contains({_LOW}, 'behavior is undefined'))"),
        rule("no_assumption_note", f"NOT (contains({_LOW}, 'assumption') OR contains({_LOW}, 'precondition'))"),
    ]
)
ORACLES["answer_rule_codes"] = f"""{with_views('outputs', 'qa')}{CARRIED}
  SELECT seq, array_to_string(list_sort({_FAILURES}), ',') AS failures, array_to_string(list_sort({_WARNINGS}), ',') AS warnings FROM qa"""
ORACLES["answer_stats"] = f"""{with_views('outputs', 'qa')}
  SELECT count(*) AS rows, count(DISTINCT prompt_id) AS unique_ids, min(length(text)) AS min_chars, CAST(sum(length(text)) // count(*) AS BIGINT) AS avg_chars,
         max(length(text)) AS max_chars, count(*) = 1000 AS count_ok, count(*) = count(DISTINCT prompt_id) AS ids_unique FROM qa"""
ORACLES["subject_carry"] = f"""{with_views('outputs', 'qa')}{CARRIED}
  SELECT subject, count(*) AS sentences, CAST(sum(length(sentence)) AS BIGINT) AS chars, CAST(sum(pos) AS BIGINT) AS positions FROM carried GROUP BY subject"""

# --- selection

_EXACT = repeats(lines("text"))


def graded(beta: float, length: float, repeat: float, source: str = "candidates", name: str = "graded") -> str:
    return f""", {name} AS (
    SELECT *, logprob + {beta}::DOUBLE * {rule_reward('text', REWARDS, PENALTIES)} - {length}::DOUBLE * {tokens('text')} / 100.0::DOUBLE - {repeat}::DOUBLE * {_EXACT} AS total
    FROM {source})"""


_RANK = "row_number() OVER (PARTITION BY prompt_id ORDER BY total DESC, ord) AS place"
ORACLES["rerank_best_of_n"] = f"""{with_views('outputs', 'candidates')}{graded(1.5, 0.15, 0.5)}
  , ranked AS (SELECT *, {_RANK} FROM graded)
  SELECT prompt_id, md5({trim('max(CASE WHEN place = 1 THEN text END)')}) AS answer_md5, round(max(total), 9) AS final_score, count(*) AS verifier_call_count,
         count(*) FILTER (WHERE place <= 2) AS kept, count(*) FILTER (WHERE place > 2) AS pruned, round(sum(total ORDER BY place), 9) AS total,
         round(min(total) FILTER (WHERE place <= 2), 9) AS worst_kept, '2' AS beam_width
  FROM ranked GROUP BY prompt_id"""
ORACLES["kept_branches"] = f"""{with_views('outputs', 'candidates')}{graded(1.0, 0.0, 0.0)}
  , ranked AS (SELECT *, {_RANK} FROM graded)
  SELECT prompt_id, place - 1 AS place, round(total, 9) AS total_score, md5(text) AS text_md5 FROM ranked WHERE place <= 2"""
ORACLES["first_traced"] = f"""{with_views('outputs', 'candidates')}{graded(1.0, 0.0, 0.0)}
  , ranked AS (SELECT *, {_RANK} FROM graded)
  SELECT prompt_id, md5(max(CASE WHEN place = 1 THEN text END)) AS kept_md5, md5(max(CASE WHEN place = 3 THEN text END)) AS pruned_md5 FROM ranked GROUP BY prompt_id"""
ORACLES["case_study"] = f"""{with_views('outputs', 'candidates')}{graded(1.0, 0.0, 0.0)}
  , ranked AS (SELECT *, {_RANK} FROM graded)
  SELECT prompt_id, md5({trim('text')}) AS answer_md5, round(total, 9) AS final_score FROM ranked WHERE place = 1 AND prompt_id >= '2' ORDER BY prompt_id LIMIT 1"""
ORACLES["lookahead_select"] = f"""{with_views('outputs', 'candidates')}
  , level1 AS (SELECT *, {rule_reward('text', REWARDS, PENALTIES)} AS reward FROM candidates)
  , level2 AS (SELECT prompt_id, ord, logprob - k / 4::DOUBLE + 1.5::DOUBLE * (reward + seq * k % 5 - 2) AS total FROM level1, (VALUES (1), (2)) v(k) WHERE NOT is_complete)
  , below AS (SELECT prompt_id, ord, max(total) AS best, count(*) AS calls FROM level2 GROUP BY ALL)
  , children AS (SELECT l.prompt_id, l.ord, l.text, logprob + 1.5::DOUBLE * reward AS total, best, calls FROM level1 l LEFT JOIN below b ON b.prompt_id = l.prompt_id AND b.ord = l.ord)
  , valued AS (SELECT *, CASE WHEN ord < 3 THEN coalesce(best, total) ELSE total END AS value, 1 + CASE WHEN ord < 3 THEN coalesce(calls, 0) ELSE 0 END AS c FROM children)
  , placed AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY value DESC, total DESC, ord) AS place FROM valued)
  SELECT prompt_id, md5({trim('max(CASE WHEN place = 1 THEN text END)')}) AS answer_md5, round(max(CASE WHEN place = 1 THEN total END), 9) AS final_score,
         'ttc_mcts' AS method, CAST(sum(c) AS BIGINT) AS verifier_call_count
  FROM placed GROUP BY prompt_id"""
ORACLES["ucb_rank"] = """WITH visits AS (
    SELECT CAST(user_id AS VARCHAR) AS prompt_id, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS BIGINT) AS ord,
           count(*) FILTER (WHERE value > 5) AS visits, sum(value) FILTER (WHERE value > 5) AS value_sum
    FROM events GROUP BY ALL)
  , totals AS (SELECT prompt_id, greatest(1, sum(visits)) AS total FROM visits GROUP BY prompt_id)
  , bounds AS (SELECT v.prompt_id, ord, visits, CASE WHEN visits = 0 THEN 'infinity'::DOUBLE ELSE value_sum / visits + 1.4::DOUBLE * sqrt(ln(total + 1) / visits) END AS ucb
               FROM visits v JOIN totals t ON t.prompt_id = v.prompt_id)
  SELECT prompt_id, ord, visits, CASE WHEN visits = 0 THEN -1.0::DOUBLE ELSE round(ucb, 9) END AS ucb,
         row_number() OVER (PARTITION BY prompt_id ORDER BY ucb DESC, ord) AS place
  FROM bounds"""
_REMARKS = """(VALUES (0, ' the heading'), (1, ' ===> int x')) r(k, remark)"""
_TWO_STEPS = f"""{with_views('outputs', 'candidates')}{graded(1.5, 0.0, 0.0, name='first_level')}
  , extended AS (SELECT prompt_id, ord AS parent, k AS ord, text || remark AS text, logprob + k * -0.1::DOUBLE AS logprob FROM first_level, {_REMARKS} WHERE NOT is_complete)
  {graded(1.5, 0.0, 0.0, source='extended', name='second_level')}"""
ORACLES["beam_multi_step"] = f"""{_TWO_STEPS}
  , ranked1 AS (SELECT *, {_RANK} FROM first_level)
  , kept1 AS (SELECT * FROM ranked1 WHERE place <= 2)
  , open_prompts AS (SELECT prompt_id FROM kept1 GROUP BY prompt_id HAVING bool_or(NOT is_complete))
  , step2 AS (
      SELECT k.prompt_id, s.text, s.total, (k.place - 1) * 4 + s.ord AS ord, 1 AS scored
      FROM kept1 k JOIN second_level s ON s.prompt_id = k.prompt_id AND s.parent = k.ord
      UNION ALL SELECT prompt_id, text, total, (place - 1) * 4, 0 FROM kept1 WHERE is_complete AND prompt_id IN (SELECT prompt_id FROM open_prompts))
  , ranked2 AS (SELECT *, {_RANK} FROM step2)
  , ends AS (
      SELECT prompt_id, text, total, place, 2 AS steps FROM ranked2 WHERE place <= 2
      UNION ALL SELECT prompt_id, text, total, place, 1 FROM kept1 WHERE prompt_id NOT IN (SELECT prompt_id FROM open_prompts))
  , calls AS (SELECT prompt_id, CAST(sum(c) AS BIGINT) AS n FROM (SELECT prompt_id, count(*) AS c FROM first_level GROUP BY 1 UNION ALL SELECT prompt_id, sum(scored) FROM step2 GROUP BY 1) GROUP BY 1)
  SELECT e.prompt_id, md5({trim('max(CASE WHEN place = 1 THEN text END)')}) AS answer_md5, round(max(CASE WHEN place = 1 THEN total END), 9) AS final_score,
         any_value(c.n) AS verifier_call_count, CAST(max(steps) AS BIGINT) AS steps, count(*) AS branches
  FROM ends e JOIN calls c ON c.prompt_id = e.prompt_id GROUP BY e.prompt_id"""
ORACLES["lookahead_scripted"] = f"""{_TWO_STEPS}
  , below AS (SELECT prompt_id, parent AS ord, max(total) AS best, count(*) AS calls FROM second_level GROUP BY ALL)
  , valued AS (SELECT f.prompt_id, f.ord, f.text, f.total, CASE WHEN f.ord < 3 THEN coalesce(best, f.total) ELSE f.total END AS value,
                      1 + CASE WHEN f.ord < 3 THEN coalesce(calls, 0) ELSE 0 END AS c
               FROM first_level f LEFT JOIN below b ON b.prompt_id = f.prompt_id AND b.ord = f.ord)
  , placed AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY value DESC, total DESC, ord) AS place FROM valued)
  SELECT prompt_id, md5({trim('max(CASE WHEN place = 1 THEN text END)')}) AS answer_md5, round(max(CASE WHEN place = 1 THEN total END), 9) AS final_score, CAST(sum(c) AS BIGINT) AS verifier_call_count
  FROM placed GROUP BY prompt_id"""
ORACLES["lookahead_records"] = f"""{_TWO_STEPS}
  , below AS (SELECT prompt_id, parent AS ord, max(total) AS best FROM second_level GROUP BY ALL)
  , ranked AS (SELECT *, {_RANK} FROM first_level)
  SELECT f.prompt_id, 'ttc_mcts' AS method, CAST(f.ord AS BIGINT) AS place, md5(f.text) AS text_md5, round(f.total, 9) AS total_score, f.is_complete,
         round(CASE WHEN f.ord < 3 THEN coalesce(best, f.total) ELSE f.total END, 9) AS value, '3' AS budget
  FROM first_level f LEFT JOIN below b ON b.prompt_id = f.prompt_id AND b.ord = f.ord
  UNION ALL
  SELECT prompt_id, 'ttc_beam', place - 1, md5(text), round(total, 9), is_complete, NULL, NULL FROM ranked WHERE place <= 2"""

# --- training logs, formats, streams

_LOSS = "list_filter(list_transform(string_split(text, chr(10)), lambda x: length(x)), lambda x: x % 2 = {0})[-1]"
ORACLES["training_runs"] = f"""SELECT CAST(doc_id AS VARCHAR) AS run, n_chars AS global_step, CAST(len(string_split(text, chr(10))) AS BIGINT) AS log_history_count,
         CAST({_LOSS.format(0)} AS DOUBLE) AS last_train_loss, CAST({_LOSS.format(1)} AS DOUBLE) AS last_eval_loss,
         CAST(len(string_split(text, chr(10))) - 1 AS VARCHAR) AS last_step, true AS ok
  FROM documents"""
ORACLES["jsonl_round_trip"] = f"""{with_views('outputs')}
  SELECT prompt_id, method, round(latency_ms, 9) AS latency_ms, CAST(verifier_call_count AS DOUBLE) AS verifier_call_count, md5(final_answer) AS answer_md5 FROM outputs"""
ORACLES["jsonl_appended"] = f"""{with_views('outputs')}
  SELECT method, count(*) AS count, CAST(sum(length(final_answer)) AS BIGINT) AS chars FROM outputs GROUP BY method"""
ORACLES["jsonl_quarantine"] = """SELECT CASE WHEN lang = 'fr' THEN 'bad' ELSE 'good' END AS side, count(*) AS count,
         CAST(sum(length(text) + CASE WHEN lang = 'fr' THEN 6 ELSE 0 END) AS BIGINT) AS chars
  FROM documents GROUP BY side"""
ORACLES["reward_files"] = f"""{PAIRED}{split_cte('pairs')}
  SELECT split, prompt AS instruction, md5(chosen) AS chosen_md5, md5(rejected) AS rejected_md5, prompt_id
  FROM pairs JOIN split USING (prompt_id) WHERE split <> 'test'"""
ORACLES["typed_answers"] = """SELECT 'answer' AS kind, 'unknown' AS model, count(*) AS count,
         CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS chars, max(turn) AS last_turn FROM conversations"""
ORACLES["csv_round_trip"] = f"""{with_views('outputs')}
  SELECT CAST(seq AS VARCHAR) AS seq, prompt_id, method, round(latency_ms, 9) AS latency_ms, length(final_answer) AS answer_chars FROM outputs"""
ORACLES["csv_cells"] = """WITH cells AS (
    SELECT doc_id, lang <> 'fr' AS is_number, n_chars / (CASE WHEN lang = 'en' THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END) AS v, source FROM documents)
  SELECT doc_id, CASE WHEN is_number AND v = floor(v) THEN CAST(v AS BIGINT) END AS whole, CASE WHEN is_number AND v <> floor(v) THEN v END AS number,
         CASE WHEN NOT is_number THEN source END AS text
  FROM cells"""
ORACLES["progress_counter"] = "SELECT count(*) AS written, count(*) AS rows FROM documents"
ORACLES["stream_users"] = "SELECT DISTINCT user_id FROM events"
ORACLES["stream_method_tables"] = f"""{with_views('outputs')}{MEASURED}
  SELECT method, count(*) AS count, {mean('abnormal_symbol_count', 'abnormal_symbol_count_mean')}, {mean('word_count', 'word_count_mean')},
         {total('repeated_line_count', 'repeated_line_count_total')}, {_LATENCY}
  FROM measured GROUP BY method"""
ORACLES["stream_first_per_prompt"] = f"{with_views('outputs')} SELECT DISTINCT prompt_id FROM outputs"
