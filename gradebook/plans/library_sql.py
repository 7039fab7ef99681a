"""DuckDB SQL twins of :mod:`gradebook.plans.library_plans`."""

from __future__ import annotations

from .library_plans import BASE_SOURCE, BATCH, WANTED

#: The published keypoint falloffs and the class names of the digit set.
SIGMAS = [.26, .25, .25, .35, .35, .79, .79, .72, .72, .62, .62, 1.07, 1.07, .87, .87, .89, .89]
DIGITS = [str(i) for i in range(10)]


def library_sql(lines: str, tiles: str) -> dict[str, str]:
    """``lines``: the WITH items of the detection plans; ``tiles``: the SQL of
    ``tile_plans``."""
    sigmas = ", ".join(f"({i}, CAST({v} AS DOUBLE) / 10.0)" for i, v in enumerate(SIGMAS))
    wanted = ", ".join(f"({i}, {v})" for i, v in enumerate(WANTED))
    named = ", ".join(f"({i}, '{v}')" for i, v in enumerate(DIGITS))
    return {
        "detection_load": f"""
WITH {lines}
SELECT image_id, category_id, row_number() OVER (ORDER BY dt_id) AS id,
       round(score, 9) AS score, round(w * h, 9) AS area, 0 AS iscrowd FROM d""",
        "category_filter": """
SELECT p_partkey AS id, p_brand AS name, p_type AS supercategory FROM part
WHERE p_brand IN ('Brand#2', 'Brand#3', 'Brand#17') AND p_type IN ('ECONOMY', 'SMALL')""",
        "keypoint_similarities": f"""
WITH {lines},
k AS (SELECT id, i, sigma, l_returnflag <> 'A' AND (l_suppkey + i) % 3 > 0 AS visible,
             CAST(l_linenumber AS DOUBLE) * 12.0 AS x, l_quantity AS y,
             l_discount * 20.0 AS dx, l_tax * 30.0 AS dy
      FROM li, (VALUES {sigmas}) s(i, sigma)),
a AS (SELECT *, max(CAST(visible AS INT)) OVER (PARTITION BY id) > 0 AS any_seen,
             x + 3.0 * i + dx AS px, y + 2.0 * i + dy AS py FROM k),
e AS (SELECT id, any_seen, visible, sigma,
             CASE WHEN any_seen THEN px - (x + 3.0 * i)
                  ELSE greatest(0.0, x - 6.0 - px) + greatest(0.0, px - (x + 12.0)) END AS ex,
             CASE WHEN any_seen THEN py - (y + 2.0 * i)
                  ELSE greatest(0.0, y - 4.0 - py) + greatest(0.0, py - (y + 8.0)) END AS ey
      FROM a)
SELECT id, round(avg(exp(-(ex * ex + ey * ey) / pow(2 * sigma, 2) / CAST(24.0 AS DOUBLE) / 2)),
                 9) AS oks
FROM e WHERE visible OR NOT any_seen GROUP BY id""",
        "union_examples": """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '/img/d' || doc_id || '.png'
            WHEN 1 THEN '/img/d' || doc_id || '.png|/abs/x.png' END AS image_path,
       md5(replace(coalesce(text, ''), '<image>', '')) AS problem_md5,
       'd' || doc_id || '.png' AS solution,
       CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'iou' ELSE 'default' END
         AS accu_reward_method,
       CAST(CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS INTEGER) AS prompt_items
FROM documents""",
        "error_rows": """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 89 <> 3 THEN text END AS text FROM documents),
f AS (SELECT 'function' AS stage, doc_id,
             CASE WHEN text IS NULL THEN 'TypeError: no text'
                  WHEN doc_id % 97 = 5 THEN 'RuntimeError: marked' END AS error,
             length(text) - length(replace(text, ' ', '')) + 1 AS value FROM d),
r AS (SELECT 'reader' AS stage,
             CASE WHEN doc_id % 50 NOT IN (7, 8) THEN doc_id END AS doc_id,
             CASE WHEN doc_id % 50 IN (7, 8) THEN 'ValueError: no record of the schema' END
               AS error, length(text) AS value FROM d),
s AS (SELECT 'reward' AS stage, doc_id,
             CASE WHEN text IS NULL THEN 'ValueError: no solution'
                  WHEN length(text) < 40 THEN 'ValueError: too short' END AS error,
             length(text) AS value FROM d)
SELECT stage, doc_id, CAST(CASE WHEN error IS NULL THEN value END AS BIGINT) AS value, error
FROM (SELECT * FROM f UNION ALL SELECT * FROM r UNION ALL SELECT * FROM s)""",
        "document_sections": f"""
WITH {lines}
SELECT 'images' AS section, o_orderkey AS id, o_orderkey || '.jpg' AS text, o_orderkey AS of
FROM orders
UNION ALL SELECT 'categories', p_partkey, p_brand, p_partkey FROM part
UNION ALL SELECT 'annotations', id, '],"{{ ' || l_returnflag || ' ' || chr(92), l_orderkey + 1
FROM li""",
        "gathered_patches": """
SELECT vec_id, CAST(embedding[vec_id % 64 + 1] AS DOUBLE) AS item_0,
       CAST(embedding[4] AS DOUBLE) AS item_1, CAST(embedding[1] AS DOUBLE) AS item_2
FROM embeddings""",
        "repeated_blocks": """
SELECT doc_id, quality, CAST(range AS INTEGER) AS copy FROM labels, range(3)""",
        "batch_predictions": f"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN '' ELSE text END AS prompt,
                  doc_id // {BATCH} AS batch FROM documents)
SELECT doc_id, batch,
       CASE WHEN max(CAST(coalesce(prompt = '', true) AS INT)) OVER (PARTITION BY batch) = 1
            THEN 'error_empty_input_ids' ELSE CAST(length(prompt) AS VARCHAR) END
         AS generated_text
FROM t""",
        "model_scores": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') || coalesce(text, '') AS whole
           FROM conversations)
SELECT conv_id, turn,
       round(CAST(length(whole) - length(replace(whole, ' ', '')) AS DOUBLE)
             / greatest(length(whole), 1), 9) AS reward
FROM t""",
        "box_formats": """
SELECT l_returnflag,
       CAST(sum(CASE WHEN l_returnflag NOT IN ('A', 'R') THEN 1 ELSE 0 END) AS DOUBLE) AS format_a,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS DOUBLE) AS format_b
FROM lineitem GROUP BY l_returnflag""",
        "next_tokens": """
SELECT event_id, user_id, event_type,
       lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS target_token
FROM events""",
        "token_log_probabilities": """
WITH x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v,
                  generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
t AS (SELECT *, max(v) OVER (PARTITION BY vec_id) AS top FROM x)
SELECT vec_id, round(max(v) FILTER (WHERE i = label) - max(top) - ln(sum(exp(v - top))), 9)
         AS log_probability
FROM t GROUP BY vec_id""",
        "padded_sequences": """
WITH s AS (SELECT conv_id, conv_id // 8 AS batch,
                  list(coalesce(length(text), 0) ORDER BY turn, length(text)) AS ids
           FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id, ids, list_transform(
               range(max(len(ids)) OVER (PARTITION BY batch) - len(ids)), lambda x: -1) AS fill
      FROM s)
SELECT conv_id, array_to_string(list_concat(fill, ids), ',') AS on_left,
       array_to_string(list_concat(ids, fill), ',') AS on_right
FROM f""",
        "clipped_rows": """
SELECT doc_id, array_to_string(list_slice(string_split(text, ' '), 1, 16), ' ') AS text
FROM documents ORDER BY doc_id LIMIT 100""",
        "model_families": """
WITH t AS (SELECT p_partkey, p_partkey % 3 AS kind, p_size,
                  CASE p_partkey % 3 WHEN 0 THEN 'org/Qwen2-VL-' || p_size || 'B'
                                     WHEN 1 THEN 'org/qwen-next-' || p_size
                                     ELSE 'InternVL-qwen2vl-' || p_size END AS model_id
           FROM part)
SELECT p_partkey, model_id,
       CASE WHEN p_size <= 5 THEN 'qwen_noninstruct_like' ELSE 'qwen_instruct_like' END AS family,
       'qwen' AS module
FROM t""",
        "chat_messages": """
SELECT conv_id, turn, md5('User: ' || text || chr(10) || 'Assistant:') AS plain_md5,
       'user' AS message_role, 'image,text' AS message_items, md5(text) AS message_md5,
       'assistant' AS completion_role, md5(text) AS completion_md5
FROM conversations""",
        "crop_boxes": f"""
WITH t AS ({tiles}),
k AS (SELECT p_partkey, cols, blocks, CAST(unnest(range(tiles)) AS INTEGER) AS tile FROM t)
SELECT p_partkey, tile,
       CASE WHEN tile < blocks THEN CAST(tile % cols * 448 AS INTEGER) ELSE 0 END AS x1,
       CASE WHEN tile < blocks THEN CAST(tile // cols * 448 AS INTEGER) ELSE 0 END AS y1,
       CASE WHEN tile < blocks THEN CAST((tile % cols + 1) * 448 AS INTEGER) ELSE 448 END AS x2,
       CASE WHEN tile < blocks THEN CAST((tile // cols + 1) * 448 AS INTEGER) ELSE 448 END AS y2,
       tile >= blocks AS thumbnail
FROM k""",
        "rows_by_id": f"""
SELECT doc_id, lang, n_chars FROM (VALUES {wanted}) w(place, doc_id) JOIN documents USING (doc_id)
ORDER BY place""",
        "forgetting_by_dataset": f"""
WITH s AS (SELECT source, lang, round(avg(quality) * CAST(100.0 AS DOUBLE), 2) AS accuracy_percent
           FROM documents JOIN labels USING (doc_id) GROUP BY source, lang),
b AS (SELECT lang, accuracy_percent AS baseline_accuracy FROM s WHERE source = '{BASE_SOURCE}')
SELECT source, lang, accuracy_percent, baseline_accuracy,
       round(accuracy_percent - baseline_accuracy, 2) AS accuracy_change
FROM s LEFT JOIN b USING (lang)""",
        "distinct_sources": "SELECT DISTINCT source FROM documents ORDER BY source",
        "registered_records": """
SELECT CASE WHEN doc_id < 100000 THEN lpad(CAST(doc_id AS VARCHAR), 5, '0')
            ELSE CAST(doc_id AS VARCHAR) END || '.png' AS image,
       'user,assistant' AS roles, md5(coalesce(text, '')) AS user_md5,
       'The answer is ' || coalesce(lang, '') AS assistant_text
FROM documents""",
        "labelled_items": f"""
SELECT vec_id AS item_id, label, name FROM embeddings JOIN (VALUES {named}) c(label, name)
USING (label)""",
        "rollout_log": """
SELECT conv_id, turn, md5(text) AS completion_md5,
       CASE WHEN conv_id < 100000 THEN lpad(CAST(conv_id AS VARCHAR), 5, '0')
            ELSE CAST(conv_id AS VARCHAR) END || '.png' AS image_path,
       CAST(length(text) AS DOUBLE) AS reward
FROM conversations""",
        "evaluation_samples": """
SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 100""",
        "registry_entries": """
WITH d AS (SELECT 'q' || CAST(doc_id AS VARCHAR) AS prompt, text, lang, source, doc_id,
                  CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split,
                  CASE WHEN length(text) > 500 THEN 'long' ELSE 'short' END AS subset
           FROM documents WHERE doc_id IS NOT NULL)
SELECT 'pairs' AS entry, prompt, 'user,system,assistant' AS roles, md5(text) AS answer_md5,
       lang AS mark FROM d WHERE split = 'train' AND lang <> 'en'
UNION ALL
SELECT 'marked', prompt, '', md5(text), CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END
FROM d WHERE split = 'test' AND subset = 'long' AND doc_id % 5 > 0
UNION ALL
SELECT 'plain', prompt, '', md5(text), '' FROM d WHERE split = 'train'""",
        "content_prompts": """
WITH f AS (SELECT conv_id, arg_min(role, turn) AS r0, arg_min(text, turn) AS x0, min(turn) AS t0
           FROM conversations GROUP BY conv_id),
b AS (SELECT c.conv_id, c.turn, CASE WHEN c.role <> 'system' AND c.turn % 2 = 0
                                     THEN '<image>' || chr(10) ELSE '' END || c.text AS x
      FROM conversations c JOIN f USING (conv_id)
      WHERE f.r0 IS DISTINCT FROM 'system' OR c.turn <> f.t0),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM b),
g AS (SELECT conv_id, count(*) AS n, string_agg(
        CASE WHEN k % 2 = 0 THEN 'user' ELSE 'assistant' END || ': ' || x, chr(10)
        ORDER BY turn) AS body FROM i GROUP BY conv_id)
SELECT f.conv_id, CAST(coalesce(n, 0) AS INTEGER) AS n_messages,
       md5(CASE WHEN r0 = 'system' THEN x0 END) AS system_md5,
       md5(coalesce(CASE WHEN n % 2 = 1 THEN body || chr(10) || 'assistant: ' ELSE body END, ''))
         AS prompt_md5
FROM f LEFT JOIN g USING (conv_id)""",
        "run_summaries": """
WITH d AS (SELECT CASE WHEN doc_id % 3 = 0 AND source <> '' THEN source
                       WHEN doc_id % 3 = 1 AND doc_id % 2 <> 0 AND source <> '' THEN lower(source)
                       ELSE 'imagefolder' END AS dataset, lang,
                  CASE WHEN contains(text, 'the') THEN 'en' ELSE 'de' END AS prediction
           FROM documents)
SELECT dataset, count(*) AS total_examples,
       count(*) FILTER (WHERE lang = prediction) AS total_correct,
       100.0::DOUBLE * count(*) FILTER (WHERE lang = prediction) / count(*) AS final_accuracy
FROM d GROUP BY dataset""",
        "missing_images": """
SELECT c_custkey, 'absent-' || CAST(c_custkey AS VARCHAR) || '.png' AS file FROM customer
WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey > 0)""",
        "plugged_reward": """
SELECT doc_id, CASE WHEN coalesce(contains(text, lang), false) THEN CAST(1.0 AS DOUBLE)
                    ELSE CAST(0.0 AS DOUBLE) END AS reward
FROM documents""",
    }
