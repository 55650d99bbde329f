"""Input views over the given tables, as one SQL text that Spark and DuckDB both run.

The raw documents hold no headings, lists, fences, slogans or symbol noise, so the views
append such marks by document number.  Every view covers every row of its table.
"""

# Method outputs: documents as answers of four methods, four answers per prompt.
OUTPUTS = """
outputs AS (
  SELECT doc_id AS seq,
         CAST(CAST(floor(doc_id / 4) AS BIGINT) AS STRING) AS prompt_id,
         'Question about ' || source || ' in ' || lang AS prompt,
         CASE doc_id % 4 WHEN 0 THEN 'raw' WHEN 1 THEN 'sft' WHEN 2 THEN 'beam' ELSE 'penalty' END AS method,
         text
           || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '>>> game changer ===>' ELSE '' END
           || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '```c' || chr(10) || 'int x;' ELSE '' END
           || CASE WHEN doc_id % 7 = 0 THEN chr(10) || '# Heading' || chr(10) || '- item' || chr(10) || '2) item' || chr(10) || '- Item' ELSE '' END
           AS final_answer,
         CASE WHEN doc_id % 4 < 2 THEN NULL ELSE CAST(n_chars AS DOUBLE) / 2 END AS latency_ms,
         CASE WHEN doc_id % 4 < 2 THEN 0 ELSE 4 END AS verifier_call_count,
         lang, source, n_chars
  FROM documents)"""

SCORES = """
scores AS (
  SELECT seq, prompt_id, method, CAST((seq * 37) % 101 AS DOUBLE) / 10 - 3 AS score FROM outputs)"""

# Conversations as prompts with a chosen answer; the next user message serves as the rejected one.
TURNS = """
turns AS (
  SELECT CAST(u.conv_id AS STRING) || '-' || CAST(u.turn AS STRING) AS prompt_id, u.conv_id, u.turn,
         u.text AS prompt, a.text AS chosen, n.text AS next_text
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  LEFT JOIN conversations n ON n.conv_id = u.conv_id AND n.turn = u.turn + 2
  WHERE u.role = 'user' AND a.role = 'assistant')"""

# Missing where the conversation ends, blank where the message is short, and equal to the
# chosen answer where the lengths alone would not decide the near-duplicate verdict.
REJECTED = """
rejected AS (
  SELECT prompt_id, turn,
         CASE WHEN length(next_text) < 120 THEN '   '
              WHEN 2.0 * least(length(chosen), length(next_text)) >= 0.9 * (length(chosen) + length(next_text)) THEN chosen
              ELSE next_text END AS text
  FROM turns WHERE next_text IS NOT NULL)"""

# Labelled pairs: every output labelled bad meets one labelled good in its language, in turn.
VAL_PAIRS = """
picks AS (
  SELECT o.seq, o.lang, l.quality,
         row_number() OVER (PARTITION BY o.lang, l.quality ORDER BY o.seq) AS nth,
         count(*) OVER (PARTITION BY o.lang, l.quality) AS n
  FROM outputs o JOIN labels l ON l.doc_id = o.seq WHERE l.quality IN (0, 1)),
val_pairs AS (
  SELECT CAST(p.seq AS STRING) AS prompt_id, g.prompt AS prompt, g.final_answer AS chosen_text, b.final_answer AS rejected_text,
         gs.score AS chosen_score, bs.score AS rejected_score
  FROM picks p JOIN picks q ON q.lang = p.lang AND q.quality = 1 AND q.nth = (p.nth - 1) % q.n + 1
  JOIN outputs g ON g.seq = q.seq JOIN scores gs ON gs.seq = q.seq
  JOIN outputs b ON b.seq = p.seq JOIN scores bs ON bs.seq = p.seq
  WHERE p.quality = 0)"""

# Raw runs as they arrive: beam repeats German answers, sft lacks Spanish ones, penalty is
# blank for French ones.  Expected prompts lack those of the last source's raw answers.
RUNS = """
runs AS (
  SELECT seq, prompt_id, prompt, method, latency_ms, verifier_call_count,
         CASE WHEN method = 'penalty' AND lang = 'fr' THEN ' ' ELSE final_answer END AS final_answer
  FROM outputs WHERE NOT (method = 'sft' AND lang = 'es')
  UNION ALL
  SELECT seq + 1000000000 AS seq, prompt_id, prompt, method, latency_ms, verifier_call_count, 'again ' || final_answer AS final_answer
  FROM outputs WHERE method = 'beam' AND lang = 'de'),
expected AS (
  SELECT seq, prompt_id, prompt FROM outputs WHERE method = 'raw' AND source <> 'src4')"""

REVIEWS = """
reviews AS (
  SELECT prompt_id,
         CASE WHEN n_chars < 300 THEN ' ' ELSE ' ' || method END AS best_method,
         CASE WHEN lang = 'en' THEN 'Yes ' ELSE 'no' END AS ttc_removes_visible_defects,
         CASE WHEN lang = 'fr' THEN '1' WHEN lang = 'de' THEN 'TRUE' ELSE '' END AS ttc_loses_useful_information,
         CASE WHEN n_chars > 2000 THEN '是' ELSE NULL END AS verifier_over_penalizes_valid_wording
  FROM outputs)"""

GUARDED = """
guarded AS (
  SELECT 'guardrail-' || lpad(CAST(doc_id % 30 + 1 AS STRING), 4, '0') AS prompt_id,
         doc_id AS seq,
         CASE doc_id % 4 WHEN 0 THEN 'raw' WHEN 1 THEN 'sft' WHEN 2 THEN 'beam' ELSE 'penalty' END AS method,
         text
           || CASE WHEN lang = 'en' THEN ' memcpy, MEMMOVE and overlap; pthread_mutex deadlock (mutex) pthread' ELSE ' overlapping memcpyx' END
           || CASE WHEN n_chars < 900 THEN ' Always safe, it cannot happen.' ELSE ' printf format size_t stack heap lifetime' END AS final_answer
  FROM documents)"""

QA = """
qa AS (
  SELECT seq, prompt_id, method AS kind,
         CASE WHEN lang = 'es' THEN 'other' ELSE 'deepseek-v4-pro' END AS model,
         final_answer || CASE seq % 7
           WHEN 0 THEN ' memcpy and memmove differ. Limitation: none. Undefined behavior and one assumption.'
           WHEN 1 THEN ' Use memmove. It copies backward (when dest < src). Forward is safe when dest > src.'
           WHEN 2 THEN ' memcpy is fast. It acts as if a temporary array existed. The behavior is undefined otherwise'
           WHEN 3 THEN ' memmove acts as if a temporary array existed. memcpy does not. Precondition: ill-formed'
           WHEN 4 THEN ' char b[] = "abc"; memcpy(b + 6, b, 3); memmove(buf + 2, buf + 1, 3) gives abbcde'
           WHEN 5 THEN ' memmove(buf + 1, buf, 3); printf("%s", buf) prints "aabc" and memmove(buf + 3, buf + 5, 5) copies backward'
           ELSE '' END AS text
  FROM outputs)"""

CANDIDATES = """
candidates AS (
  SELECT prompt_id, prompt, CAST(seq % 4 AS INT) AS ord, final_answer AS text,
         -CAST((seq * 13) % 7 AS DOUBLE) / 10 AS logprob, seq % 3 <> 0 AS is_complete, seq
  FROM outputs)"""


def with_views(*names: str) -> str:
    return "WITH " + ",".join(globals()[n.upper()] for n in names)
