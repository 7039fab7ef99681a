"""DuckDB SQL twins of the registered plans (the correctness oracle).

Each string runs on the driver's parquet tables registered as views. Column names and
types match the Spark plans one for one.
"""

from __future__ import annotations

from ..functions import prompts as pr
from ..operators import detection as det
from .evaluation_plans import CLASS_NAMES, LANG_ALIASES, LANG_CLASSES
from .library_sql import library_sql

WORD = r"\p{L}\p{N}_"
MARKER_RE = rf"(^|[^{WORD}])({'|'.join(CLASS_NAMES)})($|[^{WORD}])"


def _case(col: str, mapping, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping)
    return f"CASE {col} {whens} ELSE {default} END"


PREDICTIONS = f"""
predictions AS (
  SELECT doc_id, source, lang,
         coalesce({_case('lang', LANG_CLASSES)}, '') AS ground_truth,
         CASE WHEN text IS NULL OR regexp_extract(lower(text), '{MARKER_RE}', 2) = ''
              THEN 'unknown' ELSE regexp_extract(lower(text), '{MARKER_RE}', 2) END AS prediction
  FROM documents)"""


def _acc_cols(t: str = "total_samples", c: str = "correct_predictions") -> str:
    return (f"round(CASE WHEN {t} > 0 THEN CAST(100.0 AS DOUBLE) * {c} / {t} "
            f"ELSE CAST(0.0 AS DOUBLE) END, 2)")


ACCURACY_AGGS = """
  count(*) FILTER (WHERE prediction <> 'error_empty_input_ids') AS total_samples,
  count(*) FILTER (WHERE prediction <> 'error_empty_input_ids' AND prediction = ground_truth)
    AS correct_predictions,
  count(*) FILTER (WHERE prediction = 'unknown') AS unknown_predictions"""


def evaluation_sql() -> dict[str, str]:
    alias_case = (f"coalesce({_case('lower(trim(lang_up))', list(LANG_ALIASES.items()))}, "
                  "lang_up)")
    q: dict[str, str] = {}
    q["lang_marker_accuracy"] = f"""
WITH {PREDICTIONS},
agg AS (SELECT lang, {ACCURACY_AGGS} FROM predictions GROUP BY lang)
SELECT lang, total_samples, correct_predictions, unknown_predictions,
       {_acc_cols()} AS accuracy_percent
FROM agg ORDER BY lang"""
    q["confusion_matrix"] = f"""
WITH {PREDICTIONS}
SELECT ground_truth, prediction, count(*) AS n FROM predictions GROUP BY ground_truth, prediction"""
    q["class_accuracy"] = f"""
WITH {PREDICTIONS},
agg AS (SELECT ground_truth, {ACCURACY_AGGS} FROM predictions GROUP BY ground_truth)
SELECT ground_truth, total_samples, correct_predictions, unknown_predictions,
       {_acc_cols()} AS accuracy_percent FROM agg"""
    q["language_report"] = f"""
WITH {PREDICTIONS},
named AS (SELECT *, upper(lang) AS lang_up FROM predictions),
agg AS (SELECT {alias_case} AS language,
               {ACCURACY_AGGS} FROM named GROUP BY 1)
SELECT language, total_samples, correct_predictions, unknown_predictions,
       {_acc_cols()} AS accuracy_percent FROM agg"""
    q["running_accuracy"] = f"""
WITH {PREDICTIONS},
r AS (
  SELECT source, doc_id,
    row_number() OVER w AS position,
    sum(CASE WHEN prediction <> 'error_empty_input_ids' THEN 1 ELSE 0 END) OVER w AS running_total,
    sum(CASE WHEN prediction <> 'error_empty_input_ids' AND prediction = ground_truth
             THEN 1 ELSE 0 END) OVER w AS running_correct
  FROM predictions
  WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT source, doc_id, CAST(position AS BIGINT) AS position,
       CAST(running_total AS BIGINT) AS running_total,
       CAST(running_correct AS BIGINT) AS running_correct,
       {_acc_cols('running_total', 'running_correct')} AS running_accuracy
FROM r"""
    q["batch_accuracy"] = f"""
WITH {PREDICTIONS},
b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 8)
                      AS BIGINT) AS batch FROM predictions),
agg AS (SELECT source, batch, {ACCURACY_AGGS} FROM b GROUP BY source, batch)
SELECT source, batch, total_samples, correct_predictions,
       {_acc_cols()} AS accuracy_percent FROM agg"""
    q["predictions_file_round_trip"] = f"""
WITH {PREDICTIONS.replace('SELECT doc_id, source, lang,', 'SELECT doc_id, source, lang, text,')}
SELECT ground_truth, prediction, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS text_chars
FROM predictions"""
    return q


CURVE = f"""
curve AS (
  SELECT exp, step, total_samples, correct_predictions,
         {_acc_cols()} AS accuracy_percent
  FROM (SELECT event_type AS exp,
               CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS step,
               count(*) AS total_samples,
               count(*) FILTER (WHERE value > 10.0) AS correct_predictions
        FROM events GROUP BY 1, 2))"""

BEST = f"""
WITH {CURVE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY exp ORDER BY accuracy_percent DESC, step)
                  AS rn FROM curve)
SELECT exp, step, accuracy_percent, total_samples, correct_predictions FROM ranked
WHERE rn = 1 ORDER BY exp"""


def rollup_sql() -> dict[str, str]:
    return {
        "checkpoint_curve": f"WITH {CURVE} SELECT * FROM curve ORDER BY exp, step",
        "best_checkpoint": BEST,
        "forgetting_curve": f"""
WITH {CURVE},
base AS (SELECT exp, arg_min(accuracy_percent, step) AS baseline_accuracy FROM curve GROUP BY exp)
SELECT c.exp, c.step, c.accuracy_percent, b.baseline_accuracy,
       round(c.accuracy_percent - b.baseline_accuracy, 2) AS accuracy_change
FROM curve c JOIN base b USING (exp)""",
        "result_files_rollup": BEST,
        "rollup_files": f"""
WITH {CURVE}, best AS (
  SELECT *, row_number() OVER (PARTITION BY exp ORDER BY accuracy_percent DESC, step) AS rn
  FROM curve)
SELECT 'curve' AS file, exp, step, accuracy_percent, total_samples, correct_predictions FROM curve
UNION ALL
SELECT 'best', exp, step, accuracy_percent, total_samples, correct_predictions FROM best
WHERE rn = 1""",
        "result_tree_rollup": BEST,
        "step_dir_curves": f"WITH {CURVE} SELECT exp, step, accuracy_percent FROM curve",
        "missing_run_report": f"""
WITH {CURVE},
span AS (SELECT min(step) AS lo, max(step) AS hi FROM curve),
expected AS (SELECT e.exp, s.step FROM (SELECT DISTINCT exp FROM curve) e,
             (SELECT unnest(range(lo, hi + 1)) AS step FROM span) s),
missing AS (SELECT * FROM expected EXCEPT SELECT exp, step FROM curve)
SELECT e.exp, e.n AS expected_runs, coalesce(f.n, 0) AS finished_runs,
       coalesce(m.n, 0) AS missing_runs
FROM (SELECT exp, count(*) AS n FROM expected GROUP BY exp) e
LEFT JOIN (SELECT exp, count(*) AS n FROM curve GROUP BY exp) f USING (exp)
LEFT JOIN (SELECT exp, count(*) AS n FROM missing GROUP BY exp) m USING (exp)""",
    }


PERM = """
perm AS (
  SELECT doc_id, source,
         row_number() OVER (ORDER BY md5(concat('42', ':', CAST(doc_id AS VARCHAR))), doc_id)
           AS perm_pos,
         count(*) OVER () AS n
  FROM documents)"""


def sampling_sql() -> dict[str, str]:
    return {
        "shuffled_documents": f"WITH {PERM} SELECT doc_id, CAST(perm_pos AS BIGINT) AS perm_pos FROM perm",
        "validation_split": f"""
WITH {PERM}
SELECT doc_id, CASE WHEN perm_pos <= floor(n * 0.1) THEN 'validation' ELSE 'train' END AS split
FROM perm""",
        "grouped_sample_stream": f"""
WITH {PERM},
kept AS (SELECT doc_id, perm_pos - 1 AS p FROM perm WHERE floor((perm_pos - 1) / 8) < floor(n / 8)),
k AS (SELECT unnest(range(0, 8)) AS k)
SELECT CAST(floor(p / 8) * 64 + floor(k / 4) * 32 + (p % 8) * 4 + k % 4 AS BIGINT) AS sample_pos,
       doc_id
FROM kept, k""",
        "repeated_sample_stream": f"""
WITH {PERM}, k AS (SELECT unnest(range(0, 3)) AS k)
SELECT CAST((perm_pos - 1) * 3 + k AS BIGINT) AS sample_pos, doc_id FROM perm, k""",
        "incomplete_source_groups": """
SELECT source, count(*) AS rows FROM documents GROUP BY source HAVING count(*) <> 50
ORDER BY source""",
    }


DUCK_STRIP = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
              r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def strip_sql(expr: str) -> str:
    """Python str.strip() in DuckDB."""
    return f"regexp_replace({expr}, '^{DUCK_STRIP}+|{DUCK_STRIP}+$', '', 'g')"


def c1_sql(expr: str) -> str:
    """C1 in DuckDB (same alternation as the Spark form)."""
    hit = f"regexp_extract(lower({expr}), '{MARKER_RE}', 2)"
    return f"CASE WHEN {expr} IS NULL OR {hit} = '' THEN 'unknown' ELSE {hit} END"


ONE, ZERO = "CAST(1.0 AS DOUBLE)", "CAST(0.0 AS DOUBLE)"

SCORED = f"""
ex AS (SELECT conv_id, {c1_sql('arg_min(text, turn)')} AS solution
       FROM conversations WHERE role = 'user' GROUP BY conv_id),
ro AS (SELECT conv_id, turn AS gen_idx, text AS content FROM conversations WHERE role = 'assistant'),
sc AS (SELECT r.conv_id, r.gen_idx, r.content, e.solution,
              CASE WHEN {c1_sql('r.content')} = e.solution THEN {ONE} ELSE {ZERO} END AS reward_accuracy,
              CASE WHEN regexp_matches({strip_sql('r.content')},
                                       '(?i)^the answer is [{WORD}]+\\.?$') THEN {ONE} ELSE {ZERO} END
                AS reward_format
       FROM ro r JOIN ex e USING (conv_id)),
t AS (SELECT *, reward_accuracy + reward_format AS reward FROM sc),
st AS (SELECT conv_id, avg(reward) AS group_mean, stddev_samp(reward) AS group_std
       FROM t GROUP BY conv_id),
adv AS (SELECT t.*, st.group_mean, st.group_std,
               (t.reward - st.group_mean) / (st.group_std + 0.0001) AS advantage
        FROM t JOIN st USING (conv_id))"""

STEP_METRICS = f"""
{SCORED},
wide AS (SELECT CAST(floor(conv_id / 4) AS BIGINT) AS step,
                avg(CAST(len(string_split(content, ' ')) AS DOUBLE)) AS completion_length,
                avg(reward_accuracy) AS ra, avg(reward_format) AS rf, avg(reward) AS r,
                avg(group_std) AS rs
         FROM adv GROUP BY 1),
m AS (SELECT step, 'completion_length' AS name, completion_length AS value FROM wide
      UNION ALL SELECT step, 'rewards/accuracy', ra FROM wide
      UNION ALL SELECT step, 'rewards/format', rf FROM wide
      UNION ALL SELECT step, 'reward', r FROM wide
      UNION ALL SELECT step, 'reward_std', rs FROM wide)"""

TOKENS = """
r AS (SELECT user_id AS row_id,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos,
             coalesce(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3
                      WHEN 'purchase' THEN 4 WHEN 'error' THEN 0 END, -1) AS token,
             -value / 100.0 AS lp, -value / 90.0 AS old_lp, -value / 110.0 AS ref_lp
      FROM events),
a AS (SELECT user_id AS row_id, (avg(value) - 50.0) / 50.0 AS advantage FROM events GROUP BY 1),
fe AS (SELECT row_id, min(pos) AS first_eos FROM r WHERE token = 0 GROUP BY row_id),
t AS (SELECT r.*, a.advantage,
             CASE WHEN fe.first_eos IS NULL OR r.pos <= fe.first_eos THEN 1 ELSE 0 END AS mask
      FROM r JOIN a USING (row_id) LEFT JOIN fe USING (row_id)),
terms AS (SELECT *, exp(ref_lp - lp) - (ref_lp - lp) - 1.0 AS kl,
                 exp(lp - old_lp) AS ratio,
                 least(greatest(exp(lp - old_lp), 0.8), 1.2) AS clipped
          FROM t),
terms2 AS (SELECT *, -least(ratio * advantage, clipped * advantage) + 0.04 * kl AS token_loss,
                  CASE WHEN ratio * advantage < clipped * advantage THEN 1 ELSE 0 END AS is_clipped
           FROM terms),
rows_ AS (SELECT row_id, CAST(sum(mask) AS BIGINT) AS mask_len, count(*) AS n_tokens,
                 sum(kl * mask) / sum(mask) AS row_kl, sum(token_loss * mask) / sum(mask) AS row_loss,
                 CAST(sum(is_clipped * mask) AS BIGINT) AS clipped_tokens
          FROM terms2 GROUP BY row_id)"""


def grpo_sql() -> dict[str, str]:
    return {
        "rollout_advantages": f"""
WITH {SCORED}
SELECT conv_id, gen_idx, solution, reward_accuracy, reward_format, reward,
       round(group_mean, 6) AS group_mean, round(group_std, 6) AS group_std,
       round(advantage, 6) AS advantage
FROM adv""",
        "step_metrics": f"WITH {STEP_METRICS} SELECT step, name, round(value, 6) AS value FROM m",
        "logged_metrics": f"""
WITH {STEP_METRICS}
SELECT CAST(floor(step / 5) AS BIGINT) AS log_window, name, round(avg(value), 6) AS value
FROM m GROUP BY 1, 2""",
        "stream_logged_metrics": f"""
WITH {STEP_METRICS}
SELECT CAST(floor(step / 5) AS BIGINT) AS log_window, name, round(avg(value), 6) AS value
FROM m GROUP BY 1, 2""",
        "token_row_stats": f"""
WITH {TOKENS}
SELECT row_id, n_tokens, mask_len, clipped_tokens, round(row_kl, 9) AS row_kl,
       round(row_loss, 9) AS row_loss FROM rows_""",
        "token_loss_summary": f"""
WITH {TOKENS}
SELECT round(avg(row_kl), 9) AS kl, round(avg(row_loss), 9) AS loss,
       round(sum(clipped_tokens) / sum(mask_len), 9) AS clip_ratio,
       count(*) AS n_rows, CAST(sum(mask_len) AS BIGINT) AS n_masked_tokens
FROM rows_""",
    }


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CLASSES_TEXT = ("(SELECT string_agg(name, ', ' ORDER BY label) FROM (VALUES "
                + ", ".join(f"({i}, '{n}')" for i, (_, n) in enumerate(LANG_CLASSES))
                + ") c(label, name))")
LANG_CLASS = f"lower({_case('lang', LANG_CLASSES)})"
SFT_PROMPT = (f"{_lit(pr.IMAGE_TAG + pr.QUESTION + pr.CHOOSE)} || {CLASSES_TEXT} || '.'")
RL_PROMPT = (f"{_lit(pr.IMAGE_TAG + pr.QUESTION + pr.CHOOSE)} || {CLASSES_TEXT} || "
             f"{_lit('. ' + pr.ANSWER_FORM)}")


def _strip_re(expr: str, pattern: str) -> str:
    return f"regexp_replace({expr}, {_lit(pattern)}, '')"


def records_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["sft_records"] = f"""
SELECT d.doc_id, l.quality, {SFT_PROMPT} AS user_content,
       'The answer is ' || {LANG_CLASS} AS assistant_content,
       'documents/' || printf('%05d', d.doc_id) || '.png' AS image
FROM documents d JOIN labels l USING (doc_id)"""
    q["rl_examples"] = f"""
WITH perm AS (
  SELECT doc_id, lang,
         row_number() OVER (ORDER BY md5(concat('42', ':', CAST(doc_id AS VARCHAR))), doc_id) AS pp,
         count(*) OVER () AS n
  FROM documents),
sp AS (SELECT doc_id, lang, CASE WHEN pp <= floor(n * 0.1) THEN 'test' ELSE 'train' END AS split
       FROM perm),
ix AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS i FROM sp),
ex AS (
  SELECT 'documents-' || split || '-' || CAST(i AS VARCHAR) AS id,
         CASE split WHEN 'train' THEN '/data/images/documents'
                    ELSE '/data/images/documents_eval' END
           || '/' || split || '/' || split || '_' || printf('%05d', i) || '.png' AS image_path,
         replace({RL_PROMPT}, '<image>', '') AS problem,
         {LANG_CLASS} AS solution,
         coalesce(CASE WHEN l.toxic = 1 THEN 'toxicity' END,
                  CASE split WHEN 'train' THEN 'default' ELSE 'accuracy' END) AS accu_reward_method,
         'documents' AS dataset_name
  FROM ix LEFT JOIN labels l USING (doc_id))
SELECT *, replace({_lit(pr.question_template('rec'))}, '{{Question}}', problem) AS prompt_text,
       CAST(2 AS INTEGER) AS prompt_items
FROM ex"""
    templates = " UNION ALL ".join(
        f"SELECT '{family}' AS family, '{task}' AS task, "
        f"{_lit(pr.TEMPLATE_B if family == 'B' else pr.TEMPLATES_A.get(task, '{Question}'))} AS t"
        for family in "AB" for task in ("rec", "ic", "odLength", "other"))
    q["task_prompts"] = f"""
SELECT conv_id, turn, family, task, md5(replace(t, '{{Question}}', text)) AS prompt_md5
FROM conversations, ({templates}) WHERE role = 'user' AND text IS NOT NULL"""
    q["conversation_prompts"] = """
WITH f AS (SELECT conv_id, arg_min(role, turn) AS r0, arg_min(text, turn) AS x0, min(turn) AS t0
           FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, CASE WHEN r0 = 'system' THEN t0 END AS sys_turn,
             CASE WHEN r0 = 'system' THEN x0 END AS system_message FROM f),
b AS (SELECT c.conv_id, c.turn, replace(c.text, '<image>', '<image>' || chr(10)) AS x
      FROM conversations c JOIN s USING (conv_id)
      WHERE s.sys_turn IS NULL OR c.turn <> s.sys_turn),
bi AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM b),
agg AS (SELECT conv_id, count(*) AS n,
               string_agg(CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END || ': ' || x,
                          chr(10) ORDER BY turn) AS body
        FROM bi GROUP BY conv_id)
SELECT s.conv_id, s.system_message, CAST(coalesce(n, 0) AS INTEGER) AS n_messages,
       coalesce(CASE WHEN n % 2 = 1 THEN body || chr(10) || 'assistant: ' ELSE body END, '')
         AS prompt
FROM s LEFT JOIN agg USING (conv_id)"""
    think_parts = ("list_transform(list_filter(string_split(response, '<think>')[2:], "
                   "lambda p: contains(p, '</think>')), lambda p: "
                   + strip_sql("split_part(p, '</think>', 1)") + ")")
    think = f"'<think>' || coalesce(array_to_string({think_parts}, ' '), '') || '</think>'"
    final = _strip_re(strip_sql("split_part(string_split(response, '<answer>')[-1], "
                                "'</answer>', 1)"), r"^Answer:\s*")
    problem = strip_sql(_strip_re(_strip_re(strip_sql("string_split(response, '<think>')[1]"),
                                            r"^Question:\s*"), r"\s*Answer:\s*$"))
    request = (f"md5(replace(replace({_lit(pr.COT_REQUEST)}, '{{original_question}}', "
               "coalesce(question, '')), '{original_answer}', coalesce(answer, '')))")
    q["cot_records"] = f"""
WITH said AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text,
         count_if(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn, role, text
                                       ROWS UNBOUNDED PRECEDING) AS part
  FROM conversations),
parts AS (
  SELECT conv_id, part, min(text) FILTER (WHERE role = 'user') AS question,
         (list(text ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'))[-1] AS answer,
         coalesce(string_agg('<think>' || text || '</think>', '' ORDER BY turn, role, text)
                  FILTER (WHERE role = 'assistant'), '') AS thoughts
  FROM said GROUP BY conv_id, part),
raw AS (
  SELECT conv_id, part, question, answer, length(question) AS width, length(answer) AS height,
         'Question: ' || coalesce(question, '') || ' Answer: ' || thoughts || '<answer>Answer: '
         || coalesce(answer, '') || '</answer>' AS response
  FROM parts),
parsed AS (
  SELECT conv_id, part, width, height, {problem} AS problem,
         CASE WHEN contains(response, '<answer>')
              THEN {think} || chr(10) || chr(10) || '<answer>' || {final} || '</answer>'
              ELSE {think} END AS solution,
         {request} AS request_md5
  FROM raw)
SELECT conv_id, part, problem, solution, request_md5 FROM parsed
WHERE NOT regexp_matches(solution, '<[^>]+></[^>]+>') AND NOT contains(problem, 'Answer:')
  AND height >= 28 AND width >= 28"""
    return q


def boxes_sql() -> dict[str, str]:
    quad = r"\[\d+,\s*\d+,\s*\d+,\s*\d+\]"
    fmt_a = rf"(?s)<think>.*?</think>\s*<answer>.*?\{{.*{quad}.*\}}.*?</answer>"
    fmt_b = rf"(?s)<think>.*?</think>\s*<answer>.*?{quad}.*?</answer>"
    return {
        "box_rewards": f"""
WITH b AS (
  SELECT l_orderkey, l_linenumber, l_returnflag,
         l_linenumber * 10 AS x1, CAST(round(l_quantity) AS INTEGER) AS y1,
         l_linenumber * 10 + 20 + CAST(round(l_tax * 100) AS INTEGER) AS x2,
         CAST(round(l_quantity) AS INTEGER) + 10 + CAST(round(l_discount * 100) AS INTEGER) AS y2,
         CAST(round(l_discount * 100) AS INTEGER) AS dx
  FROM lineitem),
p AS (SELECT *, x1 + dx AS px1, y1 + l_linenumber AS py1, x2 + 3 AS px2, y2 - 1 AS py2 FROM b),
t AS (SELECT *, printf('[%d, %d, %d, %d]', px1, py1, px2, py2) AS pred,
             greatest(px1, x1) AS ix1, greatest(py1, y1) AS iy1,
             least(px2 - 1, x2 - 1) AS ix2, least(py2 - 1, y2 - 1) AS iy2 FROM p),
u AS (SELECT *, CASE WHEN ix1 < ix2 AND iy1 < iy2 THEN (ix2 - ix1 + 1) * (iy2 - iy1 + 1)
                     ELSE 0 END AS inter,
             CASE l_returnflag WHEN 'R' THEN '<think>no box</think> ' || pred
                  WHEN 'A' THEN '<think>found it</think>' || chr(10) || '<answer>' || pred || '</answer>'
                  ELSE '<think>found it</think><answer>{{"bbox_2d": ' || pred || '}}</answer>' END
               AS content
      FROM t)
SELECT l_orderkey, l_linenumber, l_returnflag,
       CASE WHEN l_returnflag = 'R' THEN CAST(0.0 AS DOUBLE)
            ELSE round(CAST(inter AS DOUBLE) / ((px2 - px1) * (py2 - py1) + (x2 - x1) * (y2 - y1)
                       - inter), 9) END AS iou_reward,
       CASE WHEN regexp_matches(content, {_lit(fmt_a)}) THEN {ONE} ELSE {ZERO} END
         AS format_reward_a,
       CASE WHEN regexp_matches(content, {_lit(fmt_b)}) THEN {ONE} ELSE {ZERO} END
         AS format_reward_b
FROM u""",
        "tile_plans": f"""
WITH p AS (SELECT p_partkey, p_size * 40 AS width, (51 - p_size) * 3 AS height FROM part),
g AS (SELECT i, n // i AS j, row_number() OVER (ORDER BY n, i) - 1 AS ord
      FROM range(1, 13) a(n), range(1, 13) b(i) WHERE n % i = 0),
c AS (SELECT p.*, g.i, g.j, g.ord,
             abs(CAST(width AS DOUBLE) / height - CAST(g.i AS DOUBLE) / g.j) AS d,
             CAST(width AS DOUBLE) * height > CAST(100352.0 AS DOUBLE) * g.i * g.j AS cond
      FROM p, g),
m AS (SELECT p_partkey, min(d) AS md FROM c GROUP BY 1),
f AS (SELECT c.p_partkey, min(ord) FILTER (WHERE d = md) AS first_ord,
             max(ord) FILTER (WHERE d = md AND cond) AS cond_ord
      FROM c JOIN m USING (p_partkey) GROUP BY 1),
ch AS (SELECT p_partkey, greatest(first_ord, coalesce(cond_ord, first_ord)) AS ord FROM f)
SELECT p.p_partkey, p.width, p.height, g.i AS cols, g.j AS rows, g.i * g.j AS blocks,
       CASE WHEN g.i * g.j > 1 THEN g.i * g.j + 1 ELSE g.i * g.j END AS tiles,
       CAST(CASE WHEN width < 28 OR height < 28 THEN
              CASE WHEN width < height THEN 28
                   ELSE floor(width * (CAST(28 AS DOUBLE) / height)) END
            ELSE width END AS BIGINT) AS min_width,
       CAST(CASE WHEN width < 28 OR height < 28 THEN
              CASE WHEN width < height THEN floor(height * (CAST(28 AS DOUBLE) / width))
                   ELSE 28 END
            ELSE height END AS BIGINT) AS min_height
FROM p JOIN ch USING (p_partkey) JOIN g USING (ord)""",
    }


#: The written forms of the maths plan: a fraction's arguments are single characters when they
#: have no braces, a quotient of integers and one half are fractions; the rest stays.
_FORM = (r"regexp_replace(regexp_replace(CASE WHEN {0} = '0.5' THEN '\frac{{1}}{{2}}' ELSE {0} END, "
         r"'^(\d+)/(\d+)$', '\\frac{{\1}}{{\2}}'), "
         r"'\\frac([^{{])([^{{])', '\\frac{{\1}}{{\2}}')")


def math_sql() -> dict[str, str]:
    return {"math_grades": rf"""
WITH t AS (
  SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS VARCHAR) AS a,
         CAST(CAST(round(l_quantity, 0) AS INTEGER) AS VARCHAR) AS q, l_returnflag, l_linestatus
  FROM lineitem),
u AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_linestatus = 'O' THEN 'The answer is $\boxed{{\frac' || a || q || '}}$.'
              ELSE 'so \boxed ' || a || '/' || q || '$ done' END AS answer,
         CASE l_returnflag WHEN 'A' THEN '\frac{{' || a || '}}{{' || q || '}}'
                           WHEN 'N' THEN a || '/' || q ELSE '0.5' END AS truth
  FROM t),
b AS (SELECT *, regexp_extract(answer, '\\boxed( ([^$]*)|\{{([^}}]*)\}})', 2)
             || regexp_extract(answer, '\\boxed( ([^$]*)|\{{([^}}]*)\}})', 3) AS box FROM u)
SELECT l_orderkey, l_linenumber, answer, truth,
       CASE WHEN {_FORM.format('box')} = {_FORM.format('truth')} THEN CAST(1.0 AS DOUBLE)
            ELSE CAST(0.0 AS DOUBLE) END AS grade
FROM b"""}


DET = """
li AS (SELECT *, l_orderkey * 100 + l_linenumber * 10 + row_number() OVER (
                   PARTITION BY l_orderkey, l_linenumber
                   ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
                            l_returnflag, l_linestatus, l_shipdate) AS id
       FROM lineitem),
g AS (SELECT l_orderkey + 1 AS image_id, l_partkey % 3 + 1 AS category_id, id AS gt_id,
             CAST(l_linenumber AS DOUBLE) * 12.0 AS x, l_quantity * 2.0 AS y,
             l_quantity * 2.0 + 10.0 AS w, l_extendedprice / 1000.0 AS h,
             CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END AS iscrowd
      FROM li),
d AS (SELECT l_orderkey + 1 AS image_id,
             CASE WHEN l_returnflag = 'A' THEN (l_partkey + 1) % 3 + 1 ELSE l_partkey % 3 + 1 END
               AS category_id,
             id AS dt_id,
             CAST(l_linenumber AS DOUBLE) * 12.0 + l_discount * 100.0 AS x,
             l_quantity * 2.0 + l_tax * 40.0 AS y,
             (l_quantity * 2.0 + 10.0) * (1.0 - l_discount) AS w,
             (l_extendedprice / 1000.0) * (1.0 + l_tax) AS h,
             (l_extendedprice % 1000.0) / 1000.0 AS score
      FROM li)"""


_THRESHOLDS = ", ".join(f"({i}, CAST({v!r} AS DOUBLE))" for i, v in enumerate(det.IOU_THRS))


def _areas(ranges) -> str:
    return ", ".join(f"({i}, CAST({lo!r} AS DOUBLE), CAST({hi!r} AS DOUBLE))"
                     for i, (_, lo, hi) in enumerate(ranges))


def _box_candidates(category: str) -> str:
    """``n``: the top detections, each with the ground truths that reach the lowest IoU;
    ``tg``: the ground truths. ``category``: the group of a box within its image."""
    return f"""
{DET},
gg AS (SELECT image_id, category_id AS own, {category} AS category_id, gt_id, x, y, w, h,
              iscrowd <> 0 AS crowd, w * h AS area FROM g),
tg AS (SELECT category_id, area, NOT crowd AS normal FROM gg),
top AS (SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY image_id, category_id
                                       ORDER BY score DESC, own, dt_id) - 1 AS dt_rank
          FROM (SELECT image_id, category_id AS own, {category} AS category_id, dt_id, x, y, w, h,
                       score FROM d)) WHERE dt_rank < 100),
p AS (SELECT t.image_id, t.category_id, t.dt_id, t.dt_rank, t.score, t.w * t.h AS da, gg.gt_id,
             gg.own, gg.area AS ga, gg.crowd,
             least(t.x + t.w, gg.x + gg.w) - greatest(t.x, gg.x) AS iw,
             least(t.y + t.h, gg.y + gg.h) - greatest(t.y, gg.y) AS ih
      FROM top t LEFT JOIN gg USING (image_id, category_id)),
u AS (SELECT *, CASE WHEN iw > 0 AND ih > 0 THEN iw * ih ELSE 0.0 END AS inter FROM p),
o AS (SELECT *, inter / (CASE WHEN crowd THEN da ELSE da + ga - inter END) AS iou FROM u),
n AS (SELECT image_id, category_id, dt_rank, dt_id, score, da,
             list({{'iou': iou, 'own': own, 'id': gt_id, 'crowd': crowd, 'ignore': crowd,
                    'area': ga}})
               FILTER (WHERE iou >= 0.5) AS found
      FROM o GROUP BY ALL)"""


#: Keypoint similarity of the results and ground truths of an image (see the plan's layout).
def _keypoint_candidates() -> str:
    sigmas = ", ".join(f"({i}, CAST({v!r} AS DOUBLE))" for i, v in enumerate(det.KPT_OKS_SIGMAS))
    return f"""
{DET},
ks AS (SELECT *, CAST(l_linenumber AS DOUBLE) * 12.0 AS x, l_quantity AS y,
              CAST(l_partkey % 6 + 1 AS DOUBLE) AS pitch, l_discount * 20.0 AS dx,
              l_tax * 30.0 AS dy, (l_extendedprice % 1000.0) / 1000.0 AS score,
              l_partkey % 9 = 0 AS crowd, l_returnflag = 'A' AS blank FROM li),
tg AS (SELECT CAST(1 AS BIGINT) AS category_id, pitch * pitch * 128 AS area,
              NOT crowd AND NOT blank AS normal FROM ks),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
                                                    ORDER BY score DESC, id) - 1 AS dt_rank
                       FROM ks) WHERE dt_rank < 20),
pts AS (SELECT t.id AS dt_id, v.id AS gt_id, v.blank, sigma, v.pitch * v.pitch * 128 AS ga,
               t.x + t.pitch * i + t.dx AS px, t.y + t.pitch * i * 0.5 + t.dy AS py,
               v.x + v.pitch * i AS gx, v.y + v.pitch * i * 0.5 AS gy,
               v.x AS bx, v.y AS b_y, v.pitch * 16 AS bw, v.pitch * 8 AS bh
        FROM top t JOIN ks v USING (l_orderkey), (VALUES {sigmas}) s(i, sigma)
        WHERE v.blank OR (v.l_suppkey + i) % 3 > 0),
far AS (SELECT dt_id, gt_id, sigma, ga,
               CASE WHEN NOT blank THEN px - gx ELSE greatest(0.0, bx - bw - px)
                    + greatest(0.0, px - (bx + bw * 2)) END AS ex,
               CASE WHEN NOT blank THEN py - gy ELSE greatest(0.0, b_y - bh - py)
                    + greatest(0.0, py - (b_y + bh * 2)) END AS ey FROM pts),
oks AS (SELECT dt_id, gt_id,
               avg(exp(-(ex * ex + ey * ey) / pow(2 * sigma, 2) / ga / 2)) AS iou
        FROM far GROUP BY ALL),
n AS (SELECT t.l_orderkey + 1 AS image_id, CAST(1 AS BIGINT) AS category_id, t.dt_rank,
             t.id AS dt_id, t.score, (t.pitch * 16) * (t.pitch * 8) AS da,
             list({{'iou': iou, 'own': 1, 'id': v.id, 'crowd': v.crowd,
                    'ignore': v.crowd OR v.blank, 'area': v.pitch * v.pitch * 128}})
               FILTER (WHERE iou >= 0.5) AS found
      FROM top t LEFT JOIN oks ON oks.dt_id = t.id LEFT JOIN ks v ON v.id = oks.gt_id
      GROUP BY ALL)"""


def _fold(ranges) -> str:
    """The greedy matching as a recursion over the rank within a group."""
    return f"""
s AS (
  SELECT image_id, category_id, thr.t, thr.at_least, ar.area_idx, ar.lo, ar.hi,
         CAST(-1 AS BIGINT) AS dt_rank, CAST(NULL AS BIGINT) AS dt_id,
         CAST(NULL AS DOUBLE) AS score, CAST([] AS BIGINT[]) AS taken, false AS matched,
         false AS ignored
  FROM (SELECT DISTINCT image_id, category_id FROM n),
       (VALUES {_THRESHOLDS}) thr(t, at_least), (VALUES {_areas(ranges)}) ar(area_idx, lo, hi)
  UNION ALL
  SELECT image_id, category_id, t, at_least, area_idx, lo, hi, next_rank, next_id, next_score,
         CASE WHEN best IS NULL OR best.crowd THEN taken ELSE list_append(taken, best.id) END,
         best IS NOT NULL,
         CASE WHEN best IS NULL THEN NOT da BETWEEN lo AND hi ELSE NOT best.normal END
  FROM (SELECT s.*, n.dt_rank AS next_rank, n.dt_id AS next_id, n.score AS next_score, n.da,
               list_aggregate(list_transform(
                 list_filter(n.found, lambda c: c.iou >= s.at_least
                             AND (c.crowd OR NOT list_contains(s.taken, c.id))),
                 lambda c: {{'normal': NOT c.ignore AND c.area BETWEEN s.lo AND s.hi,
                             'iou': c.iou, 'own': c.own, 'id': c.id, 'crowd': c.crowd}}), 'max')
                 AS best
        FROM s JOIN n ON n.image_id = s.image_id AND n.category_id = s.category_id
                     AND n.dt_rank = s.dt_rank + 1)),
m AS (SELECT * FROM s WHERE dt_rank >= 0)"""


def _curves(candidates: str, ranges=det.AREA_RANGES, max_dets=det.MAX_DETS) -> str:
    """Interpolated precision, its score, and final recall per (threshold, category, area,
    maxDet)."""
    return f"""
{candidates}, {_fold(ranges)},
npig AS (SELECT category_id, area_idx, CAST(count(*) AS DOUBLE) AS npig
         FROM tg, (VALUES {_areas(ranges)}) ar(area_idx, lo, hi)
         WHERE normal AND area BETWEEN lo AND hi GROUP BY ALL),
cells AS (SELECT * FROM npig, (VALUES {", ".join(f"({i})" for i in range(len(det.IOU_THRS)))}) x(t),
                 (VALUES {", ".join(f"({m})" for m in max_dets)}) y(max_det)),
levels AS (SELECT CAST(range AS INTEGER) AS r, range * CAST(0.01 AS DOUBLE) AS level
           FROM range(101)),
sums AS (SELECT t, category_id, area_idx, max_det, npig, score,
                CAST(sum(CAST(matched AS INT)) OVER pos AS DOUBLE) AS tp,
                CAST(sum(CAST(NOT matched AS INT)) OVER pos AS DOUBLE) AS fp
         FROM m JOIN cells USING (t, category_id, area_idx)
         WHERE dt_rank < max_det AND NOT ignored
         WINDOW pos AS (PARTITION BY t, category_id, area_idx, max_det
                        ORDER BY score DESC, image_id, dt_rank
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
curve AS (SELECT t, category_id, area_idx, max_det, tp / npig AS rc,
                 max(tp / (fp + tp + CAST({det.EPS!r} AS DOUBLE))) AS pr, max(score) AS sc
          FROM sums GROUP BY ALL),
best AS (SELECT t, category_id, area_idx, max_det, r, max(pr) AS pr, max(sc) AS sc
         FROM curve ASOF JOIN levels ON curve.rc >= levels.level GROUP BY ALL),
firsts AS (SELECT t, category_id, area_idx, max(score) AS first_score FROM m GROUP BY ALL),
precisions AS (
  SELECT t, r, category_id, area_idx, max_det,
         coalesce(max(pr) OVER onward, CAST(0.0 AS DOUBLE)) AS prec,
         coalesce(CASE WHEN r = 0 THEN first_score ELSE max(sc) OVER onward END,
                  CAST(0.0 AS DOUBLE)) AS first_at
  FROM (SELECT * FROM cells, levels) LEFT JOIN best USING (t, category_id, area_idx, max_det, r)
       LEFT JOIN firsts USING (t, category_id, area_idx)
  WINDOW onward AS (PARTITION BY t, category_id, area_idx, max_det ORDER BY r DESC
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
recalls AS (SELECT t, category_id, area_idx, max_det, coalesce(max(rc), 0.0) AS rec
            FROM cells LEFT JOIN curve USING (t, category_id, area_idx, max_det) GROUP BY ALL)"""


BOX_CURVES = _curves(_box_candidates("category_id"))


def _summary_rows(names, top: int, counted=(1, 10, 100)) -> str:
    """The summary numbers: (name, measure, threshold or none, area, maxDet). ``names``: the
    area labels; with "small" among them the twelve numbers of boxes, else ten."""
    area = {name: i for i, name in enumerate(names)}
    own = [a for a in ("small", "medium", "large") if a in area]
    rows = [("AP", "prec", None, 0, top), ("AP50", "prec", 0, 0, top), ("AP75", "prec", 5, 0, top)]
    rows += [(f"AP_{a}", "prec", None, area[a], top) for a in own]
    rows += ([(f"AR{m}", "rec", None, 0, m) for m in counted] if "small" in area else
             [("AR", "rec", None, 0, top), ("AR50", "rec", 0, 0, top), ("AR75", "rec", 5, 0, top)])
    rows += [(f"AR_{a}", "rec", None, area[a], top) for a in own]
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS idx, '{name}' AS stat, "
        f"round(coalesce(avg({of}), -1.0), 9) AS value "
        f"FROM {'precisions' if of == 'prec' else 'recalls'} "
        f"WHERE area_idx = {at} AND max_det = {most}" + (f" AND t = {t}" if t is not None else "")
        for i, (name, of, t, at, most) in enumerate(rows))


_BOX_AREAS = [n for n, _, _ in det.AREA_RANGES]
_KEYPOINT_AREAS = [n for n, _, _ in det.KPT_AREA_RANGES]


def detection_sql() -> dict[str, str]:
    return {
        "detection_matches": f"""
WITH RECURSIVE {_box_candidates("category_id")}, {_fold(det.AREA_RANGES)}
SELECT image_id, category_id, dt_id, CAST(dt_rank AS INTEGER) AS dt_rank, area_idx,
       CAST(count_if(matched) AS INTEGER) AS n_matched,
       CAST(count_if(ignored) AS INTEGER) AS n_ignored
FROM m GROUP BY image_id, category_id, dt_id, dt_rank, area_idx""",
        "detection_precision": f"""
WITH RECURSIVE {BOX_CURVES}
SELECT t, r, category_id, area_idx, max_det, round(prec, 9) AS precision,
       round(first_at, 9) AS score FROM precisions""",
        "detection_recall": f"""
WITH RECURSIVE {BOX_CURVES}
SELECT t, category_id, area_idx, max_det, round(rec, 9) AS recall FROM recalls""",
        "detection_summary": f"""
WITH RECURSIVE {BOX_CURVES}
SELECT idx, stat, value FROM ({_summary_rows(_BOX_AREAS, 100)})""",
        "detection_summary_all_categories": f"""
WITH RECURSIVE {_curves(_box_candidates("CAST(-1 AS BIGINT)"))}
SELECT idx, stat, value FROM ({_summary_rows(_BOX_AREAS, 100)})""",
        "keypoint_summary": f"""
WITH RECURSIVE {_curves(_keypoint_candidates(), det.KPT_AREA_RANGES, det.KPT_MAX_DETS)}
SELECT idx, stat, value FROM ({_summary_rows(_KEYPOINT_AREAS, 20)})""",
        "scene_overlaps": """
WITH b AS (
  SELECT l_returnflag AS flag, l_suppkey % 10 AS image_id, l_partkey AS partkey,
         l_orderkey AS orderkey, l_linenumber AS linenumber,
         (l_partkey * 7919 % 40009) / CAST(8.0 AS DOUBLE) AS x,
         (l_orderkey * 31 % 40013) / CAST(8.0 AS DOUBLE) AS y,
         max(l_quantity) + 1.0 AS w, max(l_extendedprice) % 100.0 + 1.0 AS h
  FROM lineitem GROUP BY ALL),
p AS (SELECT a.*, c.partkey AS p2, c.orderkey AS o2, c.linenumber AS l2, c.w * c.h AS area2,
             least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x) AS iw,
             least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y) AS ih
      FROM b a JOIN b c ON a.image_id = c.image_id AND a.flag = 'N' AND c.flag = 'R'
        AND a.x < c.x + c.w AND c.x < a.x + a.w AND a.y < c.y + c.h AND c.y < a.y + a.h)
SELECT image_id, partkey AS a_partkey, orderkey AS a_orderkey, linenumber AS a_linenumber,
       p2 AS b_partkey, o2 AS b_orderkey, l2 AS b_linenumber,
       round(iw * ih / (w * h + area2 - iw * ih), 9) AS iou FROM p""",
        "detection_pairs": f"""
WITH {DET},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, category_id
                                                    ORDER BY score DESC, dt_id) - 1 AS dt_rank
                       FROM d) WHERE dt_rank < 100),
p AS (SELECT t.image_id, t.category_id, t.dt_id, g.gt_id, CAST(t.dt_rank AS INTEGER) AS dt_rank,
             least(t.x + t.w, g.x + g.w) - greatest(t.x, g.x) AS iw,
             least(t.y + t.h, g.y + g.h) - greatest(t.y, g.y) AS ih,
             t.w * t.h AS da, g.w * g.h AS ga, g.iscrowd
      FROM top t JOIN g USING (image_id, category_id)),
q AS (SELECT *, CASE WHEN iw > 0 AND ih > 0 THEN iw * ih ELSE 0.0 END AS inter FROM p),
u AS (SELECT *, CASE WHEN iscrowd <> 0 THEN da ELSE da + ga - inter END AS uni FROM q)
SELECT image_id, category_id, dt_id, gt_id, dt_rank,
       round(CASE WHEN uni > 0 THEN inter / uni ELSE 0.0 END, 9) AS iou
FROM u""",
        "annotation_filter": f"""
WITH {DET}
SELECT image_id, category_id, gt_id AS id, round(w * h, 9) AS area FROM g
WHERE category_id IN (1, 2) AND w * h > 1024.0 AND w * h < 9216.0 AND iscrowd = 0""",
        "images_with_all_categories": f"""
WITH {DET}
SELECT image_id FROM g WHERE category_id IN (1, 2, 3)
GROUP BY image_id HAVING count(DISTINCT category_id) = 3
   AND image_id IN (SELECT image_id FROM d)""",
    }


EMB_SPLIT = """
perm AS (SELECT vec_id, embedding, label,
                row_number() OVER (ORDER BY md5(concat('42', ':', CAST(vec_id AS VARCHAR))), vec_id)
                  AS pp,
                count(*) OVER () AS n
         FROM embeddings),
sp AS (SELECT *, CASE WHEN pp <= floor(n * 0.1) THEN 'validation' ELSE 'train' END AS split
       FROM perm),
ex AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m
       FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i
             FROM sp WHERE split = 'train')
       GROUP BY label, i),
cent AS (SELECT label AS cl, list(m ORDER BY i) AS c FROM ex GROUP BY label)"""

DIST = ("list_reduce(list_transform(list_zip({v}, {c}), lambda z: "
        "(CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])), lambda a, b: a + b)")


def _trained_probe(epochs: int, rate: float) -> str:
    """Gradient steps from zero weights, one block of CTEs per epoch."""
    steps = ["""
v AS (SELECT vec_id, label, CASE vec_id % 10 WHEN 0 THEN 'validation' WHEN 1 THEN 'test'
             ELSE 'train' END AS part,
             list_append(list_transform(embedding, lambda e: CAST(e AS DOUBLE)),
                         CAST(1.0 AS DOUBLE)) AS e FROM embeddings),
x AS (SELECT vec_id, label, part, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
w0 AS (SELECT label AS l, i, CAST(0.0 AS DOUBLE) AS w
       FROM (SELECT DISTINCT label FROM v WHERE part = 'train'),
            (SELECT DISTINCT i FROM x)),
n AS (SELECT count(*) AS n FROM v WHERE part = 'train')"""]
    for k in range(epochs + 1):
        steps.append(f"""
z{k} AS (SELECT vec_id, label, part, l, sum(x * w) AS z FROM x JOIN w{k} USING (i) GROUP BY ALL),
e{k} AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS u FROM z{k}),
p{k} AS (SELECT *, u / sum(u) OVER (PARTITION BY vec_id) AS p FROM e{k}),
a{k} AS (SELECT vec_id, any_value(part) AS part, any_value(label) AS label,
                arg_max(l, z) AS guess, -ln(max(p) FILTER (WHERE l = label)) AS loss
         FROM p{k} GROUP BY vec_id),
w{k + 1} AS (SELECT l, i, any_value(w) - CAST({rate!r} AS DOUBLE)
                * sum((p - CASE WHEN l = label THEN 1 ELSE 0 END) * x) / any_value(n) AS w
             FROM p{k} JOIN x USING (vec_id, label, part) JOIN w{k} USING (l, i), n
             WHERE part = 'train' GROUP BY l, i)""")
    rows = " UNION ALL ".join(f"""
SELECT {k} AS epoch, avg(loss) FILTER (WHERE part = 'train') AS train_loss,
       {", ".join(f"avg(CAST(guess = label AS INT)) FILTER (WHERE part = '{p}') AS {c}"
                  for p, c in (("train", "train_accuracy"), ("validation", "val_accuracy"),
                               ("test", "test_accuracy")))} FROM a{k}"""
                              for k in range(1, epochs + 1))
    return f"""
WITH {", ".join(steps)}, found AS ({rows})
SELECT CAST(epoch AS INTEGER) AS epoch, round(train_loss, 6) AS train_loss,
       round(train_accuracy, 6) AS train_accuracy, round(val_accuracy, 6) AS val_accuracy,
       round(test_accuracy, 6) AS test_accuracy,
       epoch = (SELECT arg_min(epoch, (-val_accuracy, epoch)) FROM found) AS is_best
FROM found"""


def _attentive_pooler() -> str:
    """One query over the vectors of a class: norm, four heads, residual, norm, MLP."""
    def matrix(n: int, m: int, by: int) -> str:
        return (f"(SELECT i, j, CAST((i * {by} + j * 7 + 3) % 13 - 6 AS DOUBLE) / 50.0 AS w "
                f"FROM range({n}) a(i), range({m}) b(j))")

    def norm(source: str, key: str) -> str:
        return (f"(SELECT *, (x - avg(x) OVER own) / sqrt(var_pop(x) OVER own "
                f"+ CAST(1e-5 AS DOUBLE)) AS nx FROM {source} WINDOW own AS (PARTITION BY {key}))")
    return f"""
WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS j,
                  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
n AS {norm("x", "vec_id")},
query AS (SELECT i AS j, w AS x FROM {matrix(64, 1, 5)}),
q AS (SELECT i, sum(w * x) AS q FROM {matrix(64, 64, 11)} JOIN query USING (j) GROUP BY i),
k AS (SELECT vec_id, label, i, sum(w * nx) AS k FROM n JOIN {matrix(64, 64, 17)} USING (j)
      GROUP BY ALL),
v AS (SELECT vec_id, m.i AS i, sum(n.nx * m.w) + any_value(b.w) AS v
      FROM n JOIN {matrix(64, 64, 23)} m USING (j)
           JOIN {matrix(64, 1, 19)} b ON b.i = m.i GROUP BY vec_id, m.i),
s AS (SELECT vec_id, label, i // 16 AS head, sum(q * k) / 4.0 AS s FROM k JOIN q USING (i)
      GROUP BY ALL),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY label, head)) AS e FROM s),
y AS (SELECT label, i AS j, sum(e * v) / sum(e) AS y
      FROM e JOIN v ON v.vec_id = e.vec_id AND v.i // 16 = e.head GROUP BY ALL),
r AS (SELECT label, j, y + x AS x FROM y JOIN query USING (j)),
rn AS {norm("r", "label")},
h AS (SELECT label, m.i AS j, greatest(sum(m.w * nx) + any_value(b.w), 0.0) AS h
      FROM rn JOIN {matrix(128, 64, 29)} m USING (j) JOIN {matrix(128, 1, 37)} b ON b.i = m.i
      GROUP BY label, m.i),
o AS (SELECT label, i, sum(w * h) AS o FROM h JOIN {matrix(64, 128, 31)} USING (j) GROUP BY ALL)
SELECT r.label, CAST(r.j AS INTEGER) AS dim, round(x + o, 6) AS value
FROM r JOIN o ON o.label = r.label AND o.i = r.j"""


def probe_sql() -> dict[str, str]:
    dist = DIST.format(v="v.embedding", c="cent.c")
    dist_c = DIST.format(v="sp.embedding", c="c")
    return {
        "attentive_pooler": _attentive_pooler(),
        "logistic_probe_epochs": _trained_probe(4, 4.0),
        "centroid_probe": f"""
WITH {EMB_SPLIT},
d AS (SELECT v.vec_id, v.label, cent.cl, {dist} AS dist
      FROM sp v, cent WHERE v.split = 'validation'),
pred AS (SELECT vec_id, label, arg_min(cl, (dist, cl)) AS prediction FROM d GROUP BY vec_id, label)
SELECT label, count(*) AS total_samples,
       count(*) FILTER (WHERE prediction = label) AS correct_predictions
FROM pred GROUP BY label""",
        "attention_pooling": """
WITH s AS (SELECT label, embedding,
                  list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 1.0),
                              lambda a, b: a + b) / sqrt(64) AS sc
           FROM embeddings),
m AS (SELECT label, max(sc) AS mx FROM s GROUP BY label),
w AS (SELECT s.label, s.embedding, exp(s.sc - m.mx) AS w FROM s JOIN m USING (label)),
den AS (SELECT label, sum(w) AS den FROM w GROUP BY label),
num AS (SELECT label, CAST(i - 1 AS INTEGER) AS dim, sum(w * CAST(x AS DOUBLE)) AS num
        FROM (SELECT label, w, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i
              FROM w)
        GROUP BY label, i)
SELECT label, dim, round(num / den, 6) AS value FROM num JOIN den USING (label)""",
        "probe_cross_entropy": f"""
WITH {EMB_SPLIT},
cl AS (SELECT list(cl ORDER BY cl) AS labels, list(c ORDER BY cl) AS cs FROM cent),
lg AS (SELECT sp.split, sp.vec_id,
              list_transform(cl.cs, lambda c: -({dist_c})) AS logits,
              list_position(cl.labels, sp.label) AS tpos
       FROM sp, cl),
ce AS (SELECT split, vec_id,
              list_max(logits) + ln(list_reduce(list_transform(logits,
                  lambda x: exp(x - list_max(logits))), lambda a, b: a + b)) - logits[tpos] AS ce
       FROM lg),
b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY split ORDER BY vec_id) - 1) / 64)
                     AS BIGINT) AS batch FROM ce),
pb AS (SELECT split, batch, count(*) AS n, avg(ce) AS bl FROM b GROUP BY split, batch),
ov AS (SELECT split, avg(bl) AS sl FROM pb GROUP BY split)
SELECT split, batch, n, round(bl, 6) AS batch_loss, round(sl, 6) AS split_loss
FROM pb JOIN ov USING (split)""",
    }


def streaming_sql() -> dict[str, str]:
    return {
        "stream_checkpoint_accuracy": f"WITH {CURVE} SELECT * FROM curve",
        "stream_metric_flush": """
SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, event_type AS name,
       count(*) AS n, round(avg(value), 6) AS mean_value
FROM events GROUP BY 1, 2""",
        "stream_result_pickup": BEST,
        "stream_closed_windows": """
WITH e AS (
  SELECT *, user_id % 50 = 0 AS slow, date_trunc('day', ts) AS day FROM events),
clock AS (SELECT max(ts) - INTERVAL 2 DAY AS moment FROM e WHERE NOT slow),
m AS (SELECT *, slow AND day + INTERVAL 1 DAY <= (SELECT moment FROM clock) AS late FROM e)
SELECT event_type AS exp, CAST(floor(epoch_ms(day) / 86400000) AS BIGINT) AS step,
       count_if(NOT late) AS total_samples,
       count_if(NOT late AND value > 10.0) AS correct_predictions,
       count_if(late) AS late_samples, count_if(late AND value > 10.0) AS late_correct
FROM m GROUP BY 1, 2""",
    }


def names_sql() -> dict[str, str]:
    number = "[0-9]+(?:[.][0-9]+)?"
    size = f"{number}(?:x{number})?[bm]"
    value = ("list_reduce(list_prepend(CASE WHEN m LIKE '%b' THEN CAST(1e9 AS DOUBLE) "
             "ELSE CAST(1e6 AS DOUBLE) END, list_transform(string_split(m[1:-2], 'x'), "
             "lambda n: CAST(n AS DOUBLE))), lambda acc, n: acc * n)")
    return {
        "model_names": f"""
WITH p AS (SELECT p_partkey, p_type,
                  p_brand || '/' || replace(p_name, ' ', '-') || '-' || CAST(p_size AS VARCHAR) || 'b'
                    AS model_id
           FROM part)
SELECT p_partkey, model_id,
       coalesce(CASE lower(trim(model_id))
                  WHEN 'qwen2.5vl-3b-instruct' THEN 'Qwen/Qwen2.5-VL-3B-Instruct'
                  WHEN 'qwen2vl-2b-instruct' THEN 'Qwen/Qwen2-VL-2B-Instruct'
                  WHEN 'qwen2vl-2b' THEN 'Qwen/Qwen2-VL-2B'
                  WHEN 'visualthinker' THEN 'turningpoint-ai/VisualThinker-R1-Zero' END,
                model_id) AS resolved_id,
       coalesce(CAST(trunc(list_max(list_transform(
                    regexp_extract_all(lower(model_id), '{size}', 0), lambda m: {value})))
                AS BIGINT), -1) AS param_count,
       replace(model_id, '/', '_') || '_' || lower(p_type) || '_20250813_103037' AS run_name
FROM p""",
    }


def image_tokens_sql() -> dict[str, str]:
    tiles = boxes_sql()["tile_plans"]
    expanded = ("'<img>' || repeat('<IMG_CONTEXT>', 4 * tp.tiles) || '</img>' || chr(10) || "
                "'Describe ' || p.p_name")
    return {
        "image_token_prompts": f"""
WITH tp AS ({tiles})
SELECT tp.p_partkey, tp.tiles, CAST(length({expanded}) AS INTEGER) AS query_chars,
       md5({expanded}) AS query_md5
FROM tp JOIN part p USING (p_partkey)""",
    }


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q.update(image_tokens_sql())
    q.update(names_sql())
    q.update(streaming_sql())
    q.update(probe_sql())
    q.update(detection_sql())
    q.update(math_sql())
    q.update(library_sql(DET, boxes_sql()["tile_plans"]))
    q.update(boxes_sql())
    q.update(records_sql())
    q.update(grpo_sql())
    q.update(sampling_sql())
    q.update(evaluation_sql())
    q.update(rollup_sql())
    return q
