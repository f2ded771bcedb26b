"""SQL equivalents of the registered queries, for DuckDB over the same test tables.

Written from the definitions of the figures, not from the Spark plans.
"""

from __future__ import annotations

import re

from fleetscore.operators.findings import ADVICE

_AS_OF = "DATE '2024-02-01'"
_NOW = "TIMESTAMP '2024-02-01 00:00:00'"
_DAYS = ["2024-01-10", "2024-01-20", "2024-01-31"]


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pct(part: str, whole: str) -> str:
    return f"CASE WHEN ({whole}) > 0 THEN round(100e0 * ({part}) / ({whole}), 1) END"


def _factors(source: str, as_of: str) -> str:
    return f"""
      SELECT space_id, count(*) AS msgs, count(DISTINCT user_id) AS users,
        round(100e0 * sum({_ERR}) / count(*), 1) AS error_pct,
        round(quantile_disc(response_time_sec, 0.9), 1) AS p90_latency_s,
        CAST(sum(CASE WHEN feedback_rating = 'POSITIVE' THEN 1 ELSE 0 END) AS BIGINT) AS thumbs_up,
        CAST(sum(CASE WHEN feedback_rating = 'NEGATIVE' THEN 1 ELSE 0 END) AS BIGINT) AS thumbs_down,
        round(100e0 * count(feedback_rating) / count(*), 1) AS feedback_coverage_pct,
        CAST({as_of} - CAST(max(created_ts) AS DATE) AS INTEGER) AS days_since_active
      FROM {source} GROUP BY space_id"""


def _scorecard(factors: str, as_of: str) -> str:
    zero = lambda t, c: f"coalesce({t}.{c}, 0) AS {c}"
    return f"""
      SELECT m.space_id, m.title, m.owner, m.n_tables,
        {zero('f', 'msgs')}, {zero('f', 'users')}, f.error_pct, f.p90_latency_s, {zero('f', 'thumbs_up')},
        {zero('f', 'thumbs_down')}, f.feedback_coverage_pct, {zero('f', 'days_since_active')},
        {zero('r', 'sql_instructions')}, {zero('r', 'text_instructions')}, {zero('r', 'accepted_instructions')},
        {zero('r', 'sample_questions')}, {zero('r', 'benchmark_questions_defined')},
        {zero('b', 'num_questions')}, {zero('b', 'num_correct')}, {zero('b', 'num_needs_review')},
        {zero('b', 'num_done')}, b.latest_run_ts, {zero('b', 'num_runs')}, b.done_eff,
        coalesce(b.benchmark_ran, false) AS benchmark_ran, b.benchmark_quality_pct, b.coverage_pct,
        {_pct('f.thumbs_up', 'f.thumbs_up + f.thumbs_down')} AS feedback_positive_pct, {as_of} AS snapshot_date
      FROM meta m LEFT JOIN {factors} f USING (space_id) LEFT JOIN richness r USING (space_id)
      LEFT JOIN bench b USING (space_id)"""


def _scores(factors: str, as_of: str) -> str:
    zero = lambda t, c: f"CAST(coalesce({t}.{c}, 0) AS BIGINT) AS {c}"
    gate = lambda dead, silent, asked: (
        f"CASE WHEN w.wh_missing THEN {dead} WHEN coalesce(f.msgs, 0) = 0 THEN {silent} ELSE {asked} END")
    grade = gate("'F'", "'—'", "CASE WHEN f.error_pct < 20 THEN 'B' WHEN f.error_pct < 21 THEN 'C' ELSE 'F' END")
    return f"""
      SELECT *, CASE grade WHEN 'A' THEN 92e0 WHEN 'B' THEN 80e0 WHEN 'C' THEN 66e0 WHEN 'D' THEN 48e0
                WHEN 'F' THEN 22e0 END AS score FROM (
      SELECT DATE '{as_of}' AS snapshot_date, m.space_id, m.title, 'test' AS workspace, m.warehouse_id,
        NOT w.wh_missing AS warehouse_ok, {grade} AS grade,
        {gate("'SQL warehouse deleted — space is non-functional'",
              "'No activity harvested yet — nothing to judge.'", "'errors'")} AS verdict_why,
        {gate("'Reassign an existing SQL warehouse in space Settings'",
              "'Drive usage or run an eval benchmark.'", "'look'")} AS verdict_fix,
        {zero('f', 'msgs')}, {zero('f', 'users')}, coalesce(f.error_pct, 0) AS error_pct,
        coalesce(f.p90_latency_s, 0) AS p90_latency_s, {zero('f', 'thumbs_up')}, {zero('f', 'thumbs_down')},
        coalesce(f.feedback_coverage_pct, 0) AS fb_coverage_pct, {zero('f', 'days_since_active')},
        coalesce(s.benchmark_ran, false) AS benchmark_ran, {zero('s', 'num_runs')}, s.accuracy_pct, s.coverage_pct,
        {zero('s', 'full_benchmark_size')}, {zero('s', 'num_questions')}, {zero('s', 'num_correct')},
        {zero('s', 'num_needs_review')}, {zero('s', 'num_failed')}, s.confidence,
        TIMESTAMP '{as_of} 00:00:00' AS updated_at
      FROM meta m JOIN wh_flags w USING (space_id) LEFT JOIN {factors} f USING (space_id)
      LEFT JOIN confidence s USING (space_id))"""


_ERR = "CASE WHEN status <> 'COMPLETED' OR error_type IS NOT NULL THEN 1 ELSE 0 END"
_KIND = "event_type"
_Q_ID, _ASKED = "'SELECT ' || event_id", "event_type = 'purchase'"
_MS = "date_trunc('millisecond', ts)"
_TWO = f"({_ASKED} AND event_id % 5 = 0)"


def _query_json(prefix: str) -> str:
    """The JSON of one query attachment's query."""
    return f"""'{{"id":"{prefix}i' || event_id || '","query":"SELECT ' || event_id || '","title":"{prefix}title ' || event_id || '"'
      || CASE WHEN event_id % 3 <> 0 THEN ',"description":"about ' || event_id || '"' ELSE '' END
      || ',"statement_id":"' || CASE WHEN event_id % 11 = 0 THEN '' ELSE '{prefix}st' || event_id END
      || '","last_updated_timestamp":' || CASE WHEN event_id % 13 = 0 THEN 0 ELSE epoch_us(ts) // 1000 + 500 END
      || ',"parameters":' || CASE WHEN event_id % 2 = 0
           THEN '[{{"keyword":"region","sql_type":"STRING","value":"v' || event_id || '"}}]' ELSE '[]' END
      || CASE WHEN event_id % 4 <> 0 THEN ',"query_result_metadata":{{"row_count":' || (event_id * 3)
           || ',"is_truncated":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '}}' ELSE '' END
      || '}}'"""


_SAID_JSON = """'{"id":"ti' || event_id || '","content":"answer ' || event_id || '"'
      || CASE WHEN event_id % 2 = 0 THEN ',"purpose":"CLARIFICATION"' ELSE '' END || '}'"""

_CTES: dict[str, str] = {
    "md": """
      SELECT 'sp' || CASE WHEN user_id % 27 = 3 THEN 27 ELSE user_id % 27 END AS space_id,
        user_id || '-' || strftime(ts, '%Y%m%d') AS conversation_id, CAST(event_id AS VARCHAR) AS message_id, user_id,
        'question ' || regexp_extract(props, '"k": *([0-9]+)', 1) AS user_question,
        CASE WHEN event_id % 500 = 0 THEN NULL WHEN event_type = 'error' THEN 'FAILED'
             WHEN event_type = 'click' AND value > 150 THEN 'EXECUTING_QUERY' ELSE 'COMPLETED' END AS status,
        ts AS created_ts, ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS completed_ts,
        CASE WHEN event_id % 211 <> 0 THEN value END AS response_time_sec,
        CASE WHEN event_type = 'purchase' THEN 'SELECT ' || event_id END AS sql_generated,
        CASE WHEN event_type = 'error' AND value > 20 THEN 'SQL_EXECUTION_EXCEPTION'
             WHEN event_type = 'view' AND event_id % 97 = 0 THEN 'RATE_LIMIT' END AS error_type,
        CASE WHEN (event_type = 'error' AND value > 20) OR (event_type = 'view' AND event_id % 97 = 0)
             THEN 'failed after ' || CAST(value AS VARCHAR) END AS error_message,
        CASE WHEN event_type = 'signup' AND (user_id % 27) % 3 = 0 THEN 'NEGATIVE'
             WHEN event_type = 'signup' THEN 'POSITIVE'
             WHEN event_type = 'purchase' AND value < 20 THEN 'NEGATIVE'
             WHEN event_type = 'view' AND value > 100 THEN 'NEUTRAL' END AS feedback_rating,
        event_type = 'purchase' AS has_query_attachment, ts + INTERVAL 1 DAY AS harvested_at
      FROM events""",
    "convs": """
      SELECT space_id, conversation_id, min(user_id) AS user_id, min(created_ts) AS created_ts,
        max(completed_ts) AS last_updated_ts, CAST(count(*) AS INTEGER) AS message_count,
        max(harvested_at) AS harvested_at
      FROM md GROUP BY ALL""",
    "runs": """
      SELECT 'sp' || CASE WHEN o_custkey % 25 = 7 THEN 30 ELSE o_custkey % 25 END AS space_id,
        CAST(o_orderkey AS VARCHAR) AS eval_run_id, o_orderkey AS run_no,
        CASE WHEN o_orderstatus = 'P' THEN 'RUNNING' ELSE 'DONE' END AS eval_run_status,
        CAST(coalesce(n, 0) AS INTEGER) AS num_questions, CAST(coalesce(a, 0) AS INTEGER) AS num_correct,
        CAST(coalesce(r, 0) AS INTEGER) AS num_needs_review,
        CAST(CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderstatus = 'P' AND o_orderkey % 10 = 0 THEN 0
             ELSE coalesce(n, 0) END AS INTEGER) AS num_done,
        CASE WHEN o_orderkey % 101 <> 0 THEN epoch_ms(o_orderdate) END AS created_timestamp,
        CASE WHEN o_orderkey % 101 <> 0 THEN o_orderdate END AS run_ts,
        'user ' || o_custkey AS run_by_user
      FROM orders LEFT JOIN (
        SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS a,
          count(*) FILTER (l_returnflag = 'N') AS r FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "ranked_runs": """
      SELECT *, row_number() OVER (PARTITION BY space_id ORDER BY created_timestamp DESC NULLS LAST, run_no DESC)
        AS newest FROM runs""",
    "latest": "SELECT * FROM ranked_runs WHERE newest = 1",
    "results": """
      SELECT 'sp' || CASE WHEN o_custkey % 25 = 7 THEN 30 ELSE o_custkey % 25 END AS space_id,
        CAST(l_orderkey AS VARCHAR) AS eval_run_id, CAST(l_partkey AS VARCHAR) AS benchmark_question_id,
        p_name AS question,
        CASE l_returnflag WHEN 'A' THEN 'GOOD' WHEN 'R' THEN 'BAD' ELSE 'NEEDS_REVIEW' END AS assessment,
        'SELECT ' || l_partkey AS expected_response,
        CASE WHEN l_linenumber < 7 THEN 'SELECT ' || l_suppkey END AS actual_response,
        concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER),
                  strftime(l_shipdate, '%Y%m%d')) AS result_id
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey""",
    "latest_results": """
      SELECT r.* FROM results r JOIN latest l ON l.space_id = r.space_id AND l.eval_run_id = r.eval_run_id""",
    "ins": """
      SELECT 'sp' || CASE WHEN d.doc_id % 20 = 6 THEN 40 ELSE d.doc_id % 20 END AS space_id,
        CAST(d.doc_id AS VARCHAR) AS instruction_id, d.doc_id,
        CASE WHEN d.doc_id % 20 = 4 THEN 'TEXT_INSTRUCTION' WHEN d.doc_id % 20 = 5 THEN 'SQL_INSTRUCTION'
             WHEN lang = 'en' THEN 'SQL_INSTRUCTION' ELSE 'TEXT_INSTRUCTION' END AS instruction_type,
        source AS title, text AS content, 'for ' || lang AS usage_guidance,
        CASE quality WHEN 1 THEN 'ACCEPTED' WHEN 0 THEN 'PROPOSED' END AS instruction_status,
        CASE WHEN d.doc_id % 20 = 0 THEN NULL WHEN n_chars > 500 THEN 'True' ELSE 'False' END AS use_as_tool
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "cq": """
      SELECT 'sp' || (5 + p_partkey % 20) AS space_id, CAST(p_partkey AS VARCHAR) AS curated_question_id,
        p_partkey,
        CASE WHEN p_type = 'PROMO' AND p_size % 10 = 0 THEN 'BENCHMARK' ELSE 'SAMPLE_QUESTION' END AS question_type,
        p_name AS question_text, 'SELECT ' || p_size AS answer_text, p_brand AS eval_note,
        CASE WHEN p_size <> 50 THEN p_size < 5 END AS is_deprecated
      FROM part""",
    "meta": """
      SELECT 'sp' || n_nationkey AS space_id, n_name AS title, r_name AS owner,
        CASE WHEN n_nationkey % 9 <> 0 THEN 'wh' || (n_nationkey % 6) END AS warehouse_id,
        TIMESTAMP '2024-01-01' + to_days(CAST(n_nationkey AS INTEGER)) AS changed,
        CAST(coalesce(n, 0) AS INTEGER) AS n_tables
      FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN (
        SELECT s_nationkey, count(DISTINCT floor(s_acctbal / 1000)) AS n FROM supplier GROUP BY 1
      ) ON s_nationkey = n_nationkey""",
    "spaces": """
      SELECT 'assistant-' || s_suppkey AS space_id, s_suppkey, v,
        CASE WHEN v = 2 AND s_suppkey % 5 = 0 THEN '' WHEN v = 2 THEN s_name || ' II' ELSE s_name END AS title,
        CASE WHEN s_suppkey % 3 <> 0 THEN 'about ' || s_name END AS description,
        CASE WHEN s_suppkey % 9 <> 0 THEN 'wh' || (s_suppkey % 6) END AS warehouse_id,
        CASE s_suppkey % 4 WHEN 1 THEN '/Users/u' || s_nationkey || '/spaces' WHEN 2 THEN '/Shared/spaces'
          WHEN 3 THEN '/Workspace/Users/u' || s_nationkey END AS parent_path,
        TIMESTAMP '2024-01-01' + to_days(CAST(v AS INTEGER)) AS harvested_at
      FROM supplier, (VALUES (1), (2)) AS versions(v)""",
    "wh": "SELECT DISTINCT 'wh' || (c_nationkey % 5) AS warehouse_id FROM customer",
    "wh_flags": """
      SELECT space_id, warehouse_id,
        warehouse_id IS NOT NULL AND warehouse_id NOT IN (SELECT warehouse_id FROM wh) AS wh_missing FROM meta""",
    "factors": None,  # filled in below
    "richness": """
      SELECT coalesce(i.space_id, q.space_id) AS space_id, coalesce(si, 0) AS sql_instructions,
        coalesce(ti, 0) AS text_instructions, coalesce(ai, 0) AS accepted_instructions,
        coalesce(sq, 0) AS sample_questions, coalesce(bq, 0) AS benchmark_questions_defined,
        coalesce(n_tables, 0) AS n_tables
      FROM (SELECT space_id, count(*) FILTER (instruction_type = 'SQL_INSTRUCTION') AS si,
              count(*) FILTER (instruction_type = 'TEXT_INSTRUCTION') AS ti,
              count(*) FILTER (instruction_status = 'ACCEPTED') AS ai FROM ins GROUP BY 1) i
      FULL JOIN (SELECT space_id, count(*) FILTER (question_type = 'SAMPLE_QUESTION') AS sq,
              count(*) FILTER (question_type = 'BENCHMARK') AS bq
              FROM cq WHERE is_deprecated = false OR is_deprecated IS NULL GROUP BY 1) q ON q.space_id = i.space_id
      LEFT JOIN meta m ON m.space_id = coalesce(i.space_id, q.space_id)""",
    "bench": f"""
      SELECT *, num_runs > 0 AS benchmark_ran, {_pct('num_correct', 'done_eff')} AS benchmark_quality_pct,
        {_pct('done_eff', 'benchmark_questions_defined')} AS coverage_pct
      FROM (SELECT r.space_id, benchmark_questions_defined, coalesce(num_questions, 0) AS num_questions,
          coalesce(num_correct, 0) AS num_correct, coalesce(num_needs_review, 0) AS num_needs_review,
          coalesce(num_done, 0) AS num_done, created_timestamp AS latest_run_ts, coalesce(num_runs, 0) AS num_runs,
          CASE WHEN num_done > 0 THEN num_done ELSE coalesce(num_questions, 0) END AS done_eff
        FROM richness r LEFT JOIN latest l USING (space_id)
        LEFT JOIN (SELECT space_id, count(*) AS num_runs FROM runs GROUP BY 1) c USING (space_id))""",
    "scorecard": None,
    "trend": f"""
      SELECT space_id, eval_run_id,
        CAST(row_number() OVER (PARTITION BY space_id ORDER BY created_timestamp ASC NULLS FIRST, run_no) AS INTEGER)
          AS run_index,
        run_ts, num_correct, num_questions, num_done, {_pct('num_correct', 'done_eff')} AS quality_pct,
        {_pct('done_eff', 'benchmark_questions_defined')} AS coverage_pct
      FROM (SELECT r.*, CASE WHEN num_done > 0 THEN num_done ELSE num_questions END AS done_eff,
            benchmark_questions_defined FROM runs r LEFT JOIN richness USING (space_id))""",
    "matrix": """
      SELECT r.space_id, r.eval_run_id,
        CAST(dense_rank() OVER (PARTITION BY r.space_id ORDER BY created_timestamp ASC NULLS FIRST) AS INTEGER)
          AS run_index, run_ts, result_id, benchmark_question_id, substring(question, 1, 300) AS question, assessment
      FROM results r LEFT JOIN runs u ON u.space_id = r.space_id AND u.eval_run_id = r.eval_run_id""",
    "rules": f"""
      SELECT space_id, CAST(row_number() OVER (PARTITION BY space_id ORDER BY no) AS INTEGER) AS emit_pos,
        category, impact, 'auto' AS source, step, why, evidence
      FROM (
        SELECT space_id, 1 AS no, 'NO_BENCHMARK' AS category, 'high' AS impact,
          {_lit(ADVICE['no_benchmark'])} || CASE WHEN sql_instructions > 0 THEN ' The ' || sql_instructions
            || ' curated SQL example(s) are a good start.' ELSE '' END AS step,
          {_lit(ADVICE['no_benchmark_why'])} AS why,
          'benchmark_questions_defined=' || benchmark_questions_defined || ', num_runs=' || num_runs
            || ', sql_instructions=' || sql_instructions AS evidence
        FROM scorecard WHERE benchmark_questions_defined = 0 OR num_runs = 0
        UNION ALL SELECT space_id, 2, 'EMPTY_INSTRUCTIONS', 'high', {_lit(ADVICE['empty'])}, {_lit(ADVICE['empty_why'])},
          'text_instructions=0, sql_instructions=0' FROM scorecard WHERE text_instructions = 0 AND sql_instructions = 0
        UNION ALL SELECT space_id, 3, 'EMPTY_INSTRUCTIONS', 'medium', {_lit(ADVICE['no_text'])},
          {_lit(ADVICE['no_text_why'])}, 'text_instructions=0'
          FROM scorecard WHERE text_instructions = 0 AND sql_instructions > 0
        UNION ALL SELECT space_id, 4, 'NO_SQL_EXAMPLES', 'medium', {_lit(ADVICE['no_sql'])},
          {_lit(ADVICE['no_sql_why'])}, 'sql_instructions=0'
          FROM scorecard WHERE text_instructions > 0 AND sql_instructions = 0
        UNION ALL SELECT space_id, 5, 'LOW_COVERAGE', 'medium', {_lit(ADVICE['coverage'])},
          {_lit(ADVICE['coverage_why'])}, 'coverage_pct=' || coverage_pct FROM scorecard WHERE coverage_pct < 100
        UNION ALL SELECT space_id, 6, 'LOW_ACCURACY', 'high', {_lit(ADVICE['accuracy'])},
          'Of the whole benchmark, ' || benchmark_quality_pct || '% is right.',
          'benchmark_quality_pct=' || benchmark_quality_pct || ', coverage_pct=' || coverage_pct
          FROM scorecard WHERE coverage_pct >= 100 AND benchmark_quality_pct < 80
        UNION ALL SELECT space_id, 7, 'NEGATIVE_FEEDBACK', 'medium', {_lit(ADVICE['feedback'])},
          'Of the ratings, ' || feedback_positive_pct || '% are positive, with ' || thumbs_down || ' thumbs-down.',
          'feedback_positive_pct=' || feedback_positive_pct || ', thumbs_down=' || thumbs_down
          FROM scorecard WHERE feedback_positive_pct < 50 AND thumbs_down > 0)""",
    "ids": """
      SELECT space_id, instruction_id AS id FROM ins
      UNION SELECT space_id, curated_question_id FROM cq WHERE question_type = 'BENCHMARK'
      UNION SELECT space_id, benchmark_question_id FROM latest_results""",
    "steps": """
      SELECT space_id, doc_id AS part, 1 AS emit_pos, 'CONFLICTING_INSTRUCTIONS' AS category, 'reword' AS step,
        'see text' AS why, 'instruction_id ' || doc_id AS evidence, 'high' AS impact FROM ins WHERE doc_id % 5 = 0
      UNION ALL SELECT space_id, doc_id, 1, 'BAD_GROUND_TRUTH', 'reword', 'see text', 'see zz', 'high'
        FROM ins WHERE doc_id % 5 = 1
      UNION ALL SELECT space_id, doc_id, 2, 'CONFLICTING_INSTRUCTIONS', 'reword', 'see text',
        'instruction_id ' || doc_id, NULL FROM ins WHERE doc_id % 5 = 1
      UNION ALL SELECT space_id, doc_id, 1, 'LOW_ACCURACY', 'reword', 'see text', 'instruction_id ' || doc_id, 'high'
        FROM ins WHERE doc_id % 5 = 3
      UNION ALL SELECT space_id, doc_id, 2, 'BAD_GROUND_TRUTH', 'reword', 'see text', 'row ' || (doc_id * 1000 + 7),
        'severe' FROM ins WHERE doc_id % 5 = 3""",
    "grounded": """
      SELECT * FROM steps s WHERE category IN ('CONFLICTING_INSTRUCTIONS', 'BAD_GROUND_TRUTH')
        AND EXISTS (SELECT 1 FROM ids i WHERE i.space_id = s.space_id AND contains(s.evidence, i.id))""",
    "all_steps": """
      SELECT space_id, category, impact FROM rules UNION ALL SELECT space_id, category, impact FROM grounded""",
    "improvements": f"""
      SELECT s.space_id, c.title,
        CAST(row_number() OVER (PARTITION BY s.space_id ORDER BY
          CASE coalesce(impact, 'low') WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END,
          by_model, part, emit_pos) AS INTEGER) AS rank,
        category, impact, source, step, why, evidence, {_NOW} AS generated_at
      FROM (SELECT space_id, 0 AS by_model, 0 AS part, emit_pos, category, impact, source, step, why, evidence FROM rules
            UNION ALL SELECT space_id, 1, part, emit_pos, category, impact, 'agent', step, why, evidence FROM grounded) s
      JOIN scorecard c ON c.space_id = s.space_id""",
    "banded": """
      SELECT s.*, CASE WHEN h.space_id IS NOT NULL OR (benchmark_ran AND coalesce(benchmark_quality_pct, 0) < 50)
          THEN 'attention' WHEN benchmark_ran AND benchmark_quality_pct >= 80 THEN 'proven' ELSE 'monitor' END AS band,
        CASE WHEN benchmark_ran AND coalesce(benchmark_quality_pct, 0) < 50 THEN 'LOW ACCURACY'
          WHEN h.space_id IS NOT NULL THEN 'NEEDS FIX' WHEN benchmark_ran AND benchmark_quality_pct >= 80 THEN 'PROVEN'
          WHEN benchmark_ran THEN 'MODERATE' WHEN benchmark_questions_defined > 0 THEN 'DEFINED · NOT RUN'
          ELSE 'NO BENCHMARK' END AS chip
      FROM scorecard s LEFT JOIN (SELECT DISTINCT space_id FROM rules WHERE impact = 'high') h ON h.space_id = s.space_id""",
    "full_sizes": "SELECT space_id, max(num_questions) AS full_size, count(*) AS n FROM runs GROUP BY 1",
    "strict": f"""
      SELECT l.space_id, true AS benchmark_ran, n AS num_runs, {_pct('num_correct', 'full_size')} AS accuracy_pct,
        CASE WHEN num_questions > 0 THEN round(100e0 * done / num_questions, 1) ELSE 0e0 END AS coverage_pct,
        full_size AS full_benchmark_size, num_questions, num_correct, num_needs_review, done AS num_done,
        greatest(done - num_correct - num_needs_review, 0) AS num_failed, created_timestamp AS latest_run_ts
      FROM (SELECT *, coalesce(num_done, num_questions) AS done FROM latest) l JOIN full_sizes f ON f.space_id = l.space_id""",
    "confidence": f"""
      SELECT *, CAST(floor((epoch_ms({_NOW}) - latest_run_ts) / 86400000e0) AS INTEGER) AS days_since_run,
        CASE WHEN coverage_pct >= 100 AND num_questions >= full_benchmark_size
          AND coalesce((epoch_ms({_NOW}) - latest_run_ts) / 86400000e0, 999) <= 30 THEN 'high' ELSE 'low' END AS confidence
      FROM strict""",
    # messages as landed, one page per event
    "pm": f"""
      SELECT event_id, 'sp' || (user_id % 27) AS space_id, 'a space' AS space_title,
        user_id || '-' || strftime(ts, '%Y%m%d') AS conversation_id, 'chat' AS conversation_title,
        CASE WHEN event_id % 7 = 0 THEN 'id' ELSE 'm' END || event_id AS message_id, user_id,
        'question ' || regexp_extract(props, '"k": *([0-9]+)', 1) AS user_question,
        CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS status, {_MS} AS created_ts,
        CASE WHEN event_id % 223 <> 0 AND event_id % 211 <> 0
             THEN {_MS} + to_milliseconds(CAST(round(value * 1000) AS BIGINT)) END AS completed_ts,
        CASE WHEN event_id % 223 <> 0 AND event_id % 211 <> 0
             THEN CAST(round(value * 1000) AS BIGINT) / 1000e0 END AS response_time_sec,
        CASE WHEN {_ASKED} THEN {_Q_ID} END AS sql_generated,
        CASE WHEN {_ASKED} THEN 'xtitle ' || event_id END AS sql_title,
        CASE WHEN {_ASKED} AND event_id % 3 <> 0 THEN 'about ' || event_id END AS sql_description,
        CASE WHEN {_TWO} THEN 'a' || event_id WHEN {_ASKED} THEN 'xi' || event_id END AS sql_attachment_id,
        CASE WHEN {_ASKED} THEN CASE WHEN event_id % 11 = 0 THEN '' ELSE 'xst' || event_id END END AS sql_statement_id,
        CASE WHEN event_id % 11 = 0 THEN NULL WHEN {_TWO} THEN '["xst' || event_id || '","yst' || event_id || '"]'
             WHEN {_ASKED} THEN '["xst' || event_id || '"]' END AS sql_statement_ids,
        CASE WHEN {_ASKED} AND event_id % 2 = 0
             THEN '[{{"keyword":"region","sql_type":"STRING","value":"v' || event_id || '"}}]' END AS sql_parameters,
        CASE WHEN {_ASKED} AND event_id % 13 <> 0 THEN {_MS} + INTERVAL 500 MILLISECONDS END AS sql_last_updated_ts,
        CASE WHEN {_ASKED} AND event_id % 4 <> 0 THEN event_id * 3 END AS row_count,
        CASE WHEN {_ASKED} AND event_id % 4 <> 0 THEN event_id % 2 = 0 END AS is_truncated,
        CASE WHEN event_id % 3 = 0 THEN 'legacy' || event_id END AS legacy_statement_id,
        CASE WHEN event_id % 3 = 0 THEN event_id + 1 END AS legacy_row_count,
        CASE WHEN event_id % 3 = 0 THEN event_id % 6 = 0 END AS legacy_is_truncated,
        CASE WHEN {_KIND} IN ('purchase', 'view', 'signup') THEN 'answer ' || event_id END AS text_response,
        CASE WHEN {_KIND} IN ('purchase', 'view', 'signup') AND event_id % 2 = 0 THEN 'CLARIFICATION' END AS text_purpose,
        CASE WHEN {_TWO} THEN 'c' || event_id WHEN {_ASKED} THEN 'ti' || event_id
             WHEN {_KIND} IN ('view', 'signup') THEN 't' || event_id END AS text_attachment_id,
        CASE WHEN {_KIND} = 'signup' AND event_id % 2 = 0 THEN '["more ' || event_id || '","why?"]' END
          AS suggested_questions,
        CASE WHEN {_KIND} = 'error' THEN 'SQL_EXECUTION_EXCEPTION' END AS error_type,
        CASE WHEN {_KIND} = 'error' THEN 'bad ' || event_id END AS error_message,
        CASE WHEN {_KIND} = 'view' AND value > 50 THEN 'POSITIVE' END AS feedback_rating,
        CASE WHEN {_TWO} THEN 3 WHEN {_KIND} IN ('purchase', 'signup') THEN 2 WHEN {_KIND} = 'view' THEN 1 ELSE 0 END
          AS attachment_count,
        {_ASKED} AS has_query_attachment, {_KIND} IN ('purchase', 'view', 'signup') AS has_text_attachment,
        {_KIND} = 'signup' AS has_suggested_questions, 1 AS message_position, true AS is_first_message,
        CASE WHEN {_TWO} THEN '[{{"attachment_id":"a' || event_id || '","query":' || {_query_json('x')}
               || '}},{{"attachment_id":"b' || event_id || '","query":' || {_query_json('y')}
               || '}},{{"attachment_id":"c' || event_id || '","text":' || {_SAID_JSON} || '}}]'
             WHEN {_ASKED} THEN '[{{"query":' || {_query_json('x')} || '}},{{"text":' || {_SAID_JSON} || '}}]'
             WHEN {_KIND} = 'view' THEN '[{{"attachment_id":"t' || event_id || '","text":' || {_SAID_JSON} || '}}]'
             WHEN {_KIND} = 'signup' THEN '[{{"suggested_questions":{{"questions":'
               || CASE WHEN event_id % 2 = 0 THEN '["more ' || event_id || '","why?"]' ELSE '[]' END
               || '}}}},{{"attachment_id":"t' || event_id || '","text":' || {_SAID_JSON} || '}}]'
        END AS raw_attachments_json, {_NOW} AS harvested_at
      FROM events""",
    # conversations as landed, messages being the user turns
    "cm": """
      SELECT u.conv_id, u.turn, u.text, a.text AS answer,
        CAST(row_number() OVER (PARTITION BY u.conv_id ORDER BY u.turn) AS INTEGER) AS place,
        TIMESTAMP '2024-01-01' + to_minutes(u.conv_id) + to_seconds(u.turn) AS created_ts
      FROM conversations u LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a
        ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
      WHERE u.role = 'user' AND u.conv_id % 18 <> 0""",
    "cc": """
      SELECT DISTINCT 'sp' || (conv_id % 25) AS space_id, 'Space ' || (conv_id % 25) AS space_title,
        'c' || conv_id AS conversation_id, 'chat ' || conv_id AS conversation_title, conv_id AS user_id,
        TIMESTAMP '2024-01-01' + to_minutes(conv_id) AS created_ts,
        CASE WHEN conv_id % 10 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(conv_id) + INTERVAL 30 SECONDS END
          AS last_updated_ts
      FROM conversations WHERE conv_id % 18 <> 0""",
}
_CTES["factors"] = _factors("md", _AS_OF)
_CTES["scorecard"] = _scorecard("factors", _AS_OF)
for _day in _DAYS:
    _tag = _day.replace("-", "")
    _CTES[f"md_{_tag}"] = f"SELECT * FROM md WHERE created_ts < TIMESTAMP '{_day}'"
    _CTES[f"factors_{_tag}"] = _factors(f"md_{_tag}", f"DATE '{_day}'")
    _CTES[f"scorecard_{_tag}"] = _scorecard(f"factors_{_tag}", f"DATE '{_day}'")
    _CTES[f"scores_{_tag}"] = _scores(f"factors_{_tag}", _day)
_CTES["scores"] = _scores("factors", "2024-02-01")


def _with(sql: str) -> str:
    """The query with the views it needs in front, in an order that lets each use those before it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+([a-z_0-9]+)", text)):
            if name in _CTES and name not in needed:
                visit(_CTES[name])
                needed.append(name)

    visit(sql)
    views = ",\n".join(f"{name} AS ({_CTES[name]})" for name in needed)
    return f"WITH {views}\n{sql}" if needed else sql


def _messages(columns: str) -> str:
    return f"SELECT message_id, {columns} FROM pm"


_MESSAGE_ROW = (
    "space_id, space_title, conversation_id, conversation_title, message_id, user_id, user_question, status, created_ts, "
    "completed_ts, response_time_sec, sql_generated, sql_title, sql_description, sql_attachment_id, sql_statement_id, "
    "sql_statement_ids, sql_parameters, sql_last_updated_ts, row_count, is_truncated, legacy_statement_id, "
    "legacy_row_count, legacy_is_truncated, text_response, text_purpose, text_attachment_id, suggested_questions, "
    "error_type, error_message, feedback_rating, attachment_count, has_query_attachment, has_text_attachment, "
    "has_suggested_questions, message_position, is_first_message, raw_attachments_json, harvested_at"
)
_ROLLUP = """
      CAST(count(*) AS INTEGER) AS message_count,
      CAST(count(*) FILTER (status = 'COMPLETED') AS INTEGER) AS completed_count,
      CAST(count(*) FILTER (status = 'FAILED') AS INTEGER) AS failed_count, min(created_ts) AS first_message_ts,
      max(created_ts) AS last_message_ts,
      CASE WHEN min(created_ts) <> max(created_ts)
        THEN (epoch_us(max(created_ts)) - epoch_us(min(created_ts))) / 1e6 END AS conversation_duration_sec,
      bool_or(has_query_attachment) AS has_sql_output,
      bool_or(error_type IS NOT NULL OR error_message IS NOT NULL) AS has_errors,
      bool_or(feedback_rating IS NOT NULL) AS has_feedback"""


def _weekly(columns: str, source: str = "md") -> str:
    return (f"SELECT CAST(date_trunc('week', created_ts) AS TIMESTAMP) AS wk, space_id, {columns} "
            f"FROM {source} WHERE created_ts IS NOT NULL GROUP BY ALL")


def _top(columns: str, source: str, order: str, k: int) -> str:
    return (f"SELECT *, CAST(row_number() OVER (PARTITION BY space_id ORDER BY {order}) AS INTEGER) AS rk "
            f"FROM (SELECT {columns} FROM {source}) QUALIFY rk <= {k}")


_STRICT_COLUMNS = (
    "space_id, benchmark_ran, num_runs, accuracy_pct, coverage_pct, full_benchmark_size, num_questions, num_correct, "
    "num_needs_review, num_done, num_failed, latest_run_ts"
)
_KPIS = """count(*) AS n, count(*) FILTER (band = 'proven') AS proven, count(*) FILTER (benchmark_ran) AS benchmarked,
      count(*) FILTER (band = 'monitor') AS monitor, count(*) FILTER (band = 'attention') AS attention,
      round(avg(benchmark_quality_pct) FILTER (benchmark_ran), 1) AS avg_quality"""
_FLEET = """count(*) AS n_agents, count(*) FILTER (benchmark_ran) AS n_with_benchmark,
      round(avg(benchmark_quality_pct), 1) AS avg_quality_pct, round(avg(feedback_positive_pct), 1) AS avg_feedback_pct,
      round(avg(feedback_coverage_pct), 1) AS avg_feedback_coverage_pct"""
_CASE_SCORES = """
    SELECT case_id, CAST(len(list_filter(must, lambda c: list_contains(flagged, c))) AS INTEGER) AS n_hit,
      CAST(len(list_filter(must, lambda c: NOT list_contains(flagged, c))) AS INTEGER) AS n_missed,
      CAST(len(list_filter(must_not, lambda c: list_contains(flagged, c))) AS INTEGER) AS n_wrong
    FROM (SELECT s.space_id AS case_id, coalesce(flagged, []) AS flagged,
        list_filter([CASE WHEN num_runs = 0 THEN 'NO_BENCHMARK' END, CASE WHEN thumbs_down > 50 THEN 'NEGATIVE_FEEDBACK' END,
          CASE WHEN text_instructions > 15 THEN 'CONFLICTING_INSTRUCTIONS' END], lambda c: c IS NOT NULL) AS must,
        list_filter([CASE WHEN accepted_instructions > 5 THEN 'EMPTY_INSTRUCTIONS' END,
          CASE WHEN num_correct > 1 THEN 'LOW_ACCURACY' END,
          CASE WHEN num_questions = 0 THEN 'BAD_GROUND_TRUTH' END], lambda c: c IS NOT NULL) AS must_not
      FROM scorecard s LEFT JOIN (
        SELECT space_id, list(DISTINCT category) AS flagged FROM all_steps GROUP BY 1) g ON g.space_id = s.space_id)"""
_TRIMMED = """
    SELECT m.space_id, m.title, CAST(coalesce(ni, 0) AS INTEGER) AS n_instructions, coalesce(iids, '') AS instruction_ids,
      CAST(coalesce(longest, 0) AS INTEGER) AS longest, coalesce(qids, '') AS question_ids,
      coalesce(si, 0) AS sql_instructions, coalesce(ti, 0) AS text_instructions,
      CAST(coalesce(nq, 0) AS INTEGER) AS defined, lastq
    FROM meta m
    LEFT JOIN (SELECT space_id, count(*) FILTER (instruction_type = 'SQL_INSTRUCTION') AS si,
        count(*) FILTER (instruction_type = 'TEXT_INSTRUCTION') AS ti FROM ins GROUP BY 1) k ON k.space_id = m.space_id
    LEFT JOIN (SELECT space_id, count(*) AS ni, string_agg(instruction_id, ',' ORDER BY doc_id) AS iids,
        max(length(substring(content, 1, 600))) AS longest
      FROM (SELECT *, row_number() OVER (PARTITION BY space_id ORDER BY doc_id) AS rk FROM ins) WHERE rk <= 12
      GROUP BY 1) i ON i.space_id = m.space_id
    LEFT JOIN (SELECT space_id, count(*) AS nq, string_agg(curated_question_id, ',' ORDER BY p_partkey) AS qids,
        arg_max(curated_question_id, p_partkey) AS lastq
      FROM (SELECT *, row_number() OVER (PARTITION BY space_id ORDER BY p_partkey) AS rk FROM cq
            WHERE question_type = 'BENCHMARK') WHERE rk <= 4 GROUP BY 1) q ON q.space_id = m.space_id"""
_CTES["trimmed"] = _TRIMMED
_CTES["cases"] = _CASE_SCORES
# Evidence in parts. A home part ends by count or text; a term that fits a part and is used in several brings its users together.
_CTES["items"] = """
    SELECT *, row_number() OVER (ORDER BY space_id, kind, together, id) AS uid FROM (
      SELECT space_id, 0 AS kind, coalesce(nullif(lower(trim(title)), ''), instruction_id) AS together, instruction_id AS id,
        coalesce(length(title), 0) + coalesce(length(content), 0) AS chars, concat_ws(' ', title, content) AS words,
        instruction_id AS i_id, NULL AS q_id, NULL AS r_id, NULL AS question, NULL AS assessment, NULL AS e, NULL AS a,
        CAST(to_json({'instruction_id': instruction_id, 'instruction_type': instruction_type, 'title': title, 'content': content}) AS VARCHAR) AS j
      FROM ins
      UNION ALL SELECT space_id, 1, curated_question_id, curated_question_id, length(question_text) + length(answer_text),
        question_text || ' ' || answer_text, NULL, curated_question_id, NULL, NULL, NULL, NULL, NULL,
        CAST(to_json({'benchmark_question_id': curated_question_id, 'question_text': question_text, 'answer_text': answer_text}) AS VARCHAR)
      FROM cq WHERE question_type = 'BENCHMARK'
      UNION ALL SELECT space_id, 2, coalesce(benchmark_question_id, result_id), result_id,
        length(question) + length(expected_response) + coalesce(length(actual_response), 0), NULL, NULL, benchmark_question_id, result_id,
        question, assessment, expected_response, coalesce(actual_response, ''),
        CAST(to_json({'benchmark_question_id': benchmark_question_id, 'question': question, 'assessment': assessment,
          'expected_sql': expected_response, 'actual_sql': actual_response}) AS VARCHAR)
      FROM latest_results)"""
_CTES["homes"] = """
    SELECT *, greatest((row_number() OVER w - 1) // @ITEMS@, (sum(chars) OVER w - chars) // 4000000) AS home FROM items
    WINDOW w AS (PARTITION BY space_id ORDER BY kind > 0, together NULLS FIRST, kind, id ROWS UNBOUNDED PRECEDING)"""
_CTES["uses"] = """
    SELECT space_id, uid, home, chars, unnest(list_distinct(regexp_extract_all(lower(words), '[\\p{L}\\p{N}_]+'))) AS term
    FROM homes WHERE kind < 2"""
_CTES["term_sets"] = """
    SELECT space_id, users, min(term) AS term, any_value(n) AS n, any_value(chars) AS chars FROM (
      SELECT space_id, term, list(uid ORDER BY uid) AS users, count(*) AS n, sum(chars) AS chars FROM uses
      GROUP BY ALL HAVING min(home) < max(home) AND count(*) <= @ITEMS@ AND sum(chars) <= 4000000) GROUP BY space_id, users"""
_CTES["places"] = """
    SELECT space_id, uid, home AS part FROM homes
    UNION SELECT q.space_id, q.uid, r.home FROM homes q JOIN homes r ON r.space_id = q.space_id AND r.together = q.together
      WHERE q.kind = 1 AND r.kind = 2
    UNION SELECT t.space_id, unnest(users), n_home + place FROM (
        SELECT *, greatest((sum(n) OVER w - n) // @ITEMS@, (sum(chars) OVER w - chars) // 4000000) AS place FROM term_sets
        WINDOW w AS (PARTITION BY space_id ORDER BY term ROWS UNBOUNDED PRECEDING)) t
      JOIN (SELECT space_id, max(home) + 1 AS n_home FROM homes GROUP BY 1) h ON h.space_id = t.space_id"""
_CTES["parts"] = """
    SELECT p.space_id, n_parts, CAST(part AS BIGINT) AS part, count(i_id) AS ni, count(q_id) FILTER (kind = 1) AS nq, count(r_id) AS nr,
      string_agg(i_id, ',' ORDER BY i_id) AS iids, string_agg(q_id, ',' ORDER BY q_id) FILTER (kind = 1) AS qids,
      string_agg(r_id, ',' ORDER BY r_id) AS rids,
      string_agg(j, ',' ORDER BY id) FILTER (kind = 0) AS ij, string_agg(j, ',' ORDER BY id) FILTER (kind = 1) AS qj,
      string_agg(j, ',' ORDER BY q_id, question, assessment, e, a, id) FILTER (kind = 2) AS rj
    FROM places p JOIN items i ON i.uid = p.uid
    JOIN (SELECT space_id, count(DISTINCT part) AS n_parts FROM places GROUP BY 1) c ON c.space_id = p.space_id GROUP BY ALL"""
for _name in ("homes", "term_sets", "places"):
    _CTES[_name] = _CTES[_name].replace("@ITEMS@", "500")
_CTES["grades"] = """
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN substr('ABCDF', CAST(doc_id % 5 + 1 AS INTEGER), 1)
        WHEN 1 THEN substr('ABCDF', CAST(doc_id % 5 + 1 AS INTEGER), 1) ELSE '?' END AS grade,
      CASE doc_id % 4 WHEN 0 THEN 'from ' || source WHEN 1 THEN source
        WHEN 2 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE '' END AS why,
      CASE WHEN doc_id % 4 < 2 THEN lang ELSE '' END AS fix FROM documents"""

_SQL: dict[str, str] = {
    # sources
    "scan_bronze": "SELECT space_id, conversation_id, message_id, status, created_ts, response_time_sec FROM md",
    "flatten_spaces": f"""
      SELECT space_id, title,
        CASE WHEN s_suppkey % 7 <> 0 AND description IS NOT NULL THEN description ELSE 'listed' END AS description,
        CASE WHEN s_suppkey % 5 <> 0 AND warehouse_id IS NOT NULL THEN 'd-' || warehouse_id ELSE warehouse_id END
          AS warehouse_id,
        parent_path, {_NOW} AS harvested_at FROM spaces WHERE v = 1""",
    "flatten_conversations": "SELECT * FROM cc",
    "epoch_ms_to_ts": "SELECT eval_run_id, created_timestamp, run_ts FROM runs",
    "flatten_messages": f"""
      SELECT {_MESSAGE_ROW}, error_type IS NOT NULL OR error_message IS NOT NULL AS has_error, feedback_rating IS NOT NULL AS has_feedback
      FROM pm""",
    "message_core": _messages("user_id, user_question, status, created_ts, completed_ts, response_time_sec"),
    "first_query_attachment": _messages(
        "sql_generated, sql_title, sql_description, sql_attachment_id, sql_statement_id, sql_last_updated_ts"),
    "all_statement_ids": _messages("sql_statement_ids"),
    "query_parameters_json": _messages("sql_parameters"),
    "query_result_meta": _messages("row_count, is_truncated"),
    "legacy_query_result": _messages("legacy_statement_id, legacy_row_count, legacy_is_truncated"),
    "first_text_attachment": _messages("text_response, text_purpose, text_attachment_id"),
    "suggested_questions": _messages("suggested_questions"),
    "message_error_feedback": _messages("error_type, error_message, feedback_rating"),
    "attachment_summary": _messages(
        "attachment_count, has_query_attachment, has_text_attachment, has_suggested_questions, raw_attachments_json"),
    "message_position": """
      SELECT 'm.' || conv_id || '.' || turn AS message_id, place AS message_position, place = 1 AS is_first_message
      FROM cm""",
    "conversation_rollup": f"SELECT space_id, conversation_id, {_ROLLUP} FROM pm GROUP BY ALL",
    "empty_conversations": f"""
      SELECT cc.*, CAST(coalesce(n, 0) AS INTEGER) AS message_count, CAST(coalesce(done, 0) AS INTEGER) AS completed_count,
        CAST(coalesce(n - done, 0) AS INTEGER) AS failed_count, first_message_ts, last_message_ts,
        CASE WHEN first_message_ts <> last_message_ts
          THEN (epoch_us(last_message_ts) - epoch_us(first_message_ts)) / 1e6 END AS conversation_duration_sec,
        false AS has_sql_output, false AS has_errors, false AS has_feedback, {_NOW} AS harvested_at
      FROM cc LEFT JOIN (SELECT conv_id, count(*) AS n, count(answer) AS done, min(created_ts) AS first_message_ts,
        max(created_ts) AS last_message_ts FROM cm GROUP BY 1) ON conv_id = user_id""",
    "flatten_eval_runs": """
      SELECT space_id, eval_run_id, eval_run_status, num_questions, num_correct,
        CASE WHEN run_no % 17 <> 0 THEN num_needs_review END AS num_needs_review, num_done, created_timestamp, run_by_user
      FROM runs""",
    "flatten_instructions": """
      SELECT space_id, instruction_id, instruction_type, title, content, usage_guidance, instruction_status, use_as_tool
      FROM ins""",
    "flatten_curated_questions": """
      SELECT space_id, curated_question_id, question_type, question_text, answer_text, eval_note,
        coalesce(is_deprecated, false) AS is_deprecated FROM cq""",
    "flatten_space_meta": """
      SELECT space_id, title, CASE s_suppkey % 4 WHEN 1 THEN regexp_extract(parent_path, 'u[0-9]+')
          WHEN 2 THEN '/Shared/spaces' WHEN 3 THEN regexp_extract(parent_path, 'u[0-9]+') ELSE 'unknown' END AS owner,
        parent_path, warehouse_id, 'VIEWER' AS run_as_type, 1704067200000 + s_suppkey AS last_updated_timestamp,
        CASE WHEN s_suppkey % 3 <> 0 THEN 2 ELSE 0 END AS n_tables,
        CASE WHEN s_suppkey % 3 <> 0 THEN 'sales.t' || s_suppkey || ',sales.all' ELSE '' END AS tables
      FROM spaces WHERE v = 2""",
    "owner_from_path": """
      SELECT space_id, harvested_at, parent_path, CASE s_suppkey % 4 WHEN 1 THEN regexp_extract(parent_path, 'u[0-9]+')
          WHEN 2 THEN '/Shared/spaces' WHEN 3 THEN regexp_extract(parent_path, 'u[0-9]+') ELSE 'unknown' END AS owner
      FROM spaces""",
    "latest_run_for_results": "SELECT space_id, eval_run_id FROM latest",
    "flatten_eval_results": """
      SELECT space_id, eval_run_id, benchmark_question_id, question,
        CASE WHEN assessment <> 'NEEDS_REVIEW' THEN assessment END AS assessment,
        CASE WHEN assessment <> 'NEEDS_REVIEW' THEN CASE WHEN length(benchmark_question_id) <= 2
          THEN substring(repeat(expected_response, 700), 1, 6000) ELSE expected_response END END AS expected_response,
        CASE WHEN assessment <> 'NEEDS_REVIEW' THEN actual_response END AS actual_response, result_id FROM results""",
    # scope and incremental load
    "scope_by_ids": """
      SELECT space_id, conversation_id, message_id, status, created_ts, response_time_sec FROM md
      WHERE space_id IN ('sp1', 'sp2', 'sp11', 'sp26')""",
    "scope_by_owner_prefix": """
      SELECT space_id, title, description, warehouse_id, parent_path, harvested_at FROM spaces
      WHERE parent_path LIKE '/Users/u1%'""",
    "incremental_cutoff": "SELECT max(harvested_at) - INTERVAL 2 HOURS AS cutoff_ts FROM convs",
    "incremental_filter": """
      SELECT space_id, conversation_id, user_id, created_ts,
        CASE WHEN message_count <> 3 THEN last_updated_ts END AS last_updated_ts, message_count, harvested_at FROM convs
      WHERE message_count = 3
        OR last_updated_ts >= (SELECT max(harvested_at) - INTERVAL 60 HOURS FROM convs)""",
    "stream_ingest_messages": """
      SELECT space_id, message_id, status, created_ts, feedback_rating, CAST(created_ts AS DATE) AS created_date FROM pm""",
    "landed_bronze": """
      SELECT space_id, conversation_id, message_id, status, created_ts, feedback_rating, sql_generated, text_response,
        harvested_at FROM pm""",
    # sinks
    "upsert_spaces": """
      SELECT space_id, title, description, warehouse_id, parent_path, harvested_at FROM spaces WHERE v = 2""",
    "upsert_conversations": """
      SELECT * FROM convs WHERE last_updated_ts >= TIMESTAMP '2024-01-15'
      UNION ALL SELECT c.space_id, c.conversation_id, min(m.user_id), min(m.created_ts), max(m.completed_ts),
        CAST(count(*) AS INTEGER), max(m.harvested_at)
      FROM convs c JOIN md m ON m.space_id = c.space_id AND m.conversation_id = c.conversation_id
      WHERE c.last_updated_ts < TIMESTAMP '2024-01-15' GROUP BY ALL""",
    "upsert_messages": """
      SELECT space_id, conversation_id, message_id, status, feedback_rating,
        harvested_at + INTERVAL 1 HOUR AS harvested_at FROM md""",
    "snapshot_replace_day": " UNION ALL ".join(
        "SELECT * REPLACE (" + (f"msgs + 1000 AS msgs" if day == _DAYS[1] else "msgs AS msgs") +
        f"), DATE '{day}' AS snapshot_date FROM factors_{day.replace('-', '')}" for day in _DAYS),
    "snapshot_upsert": f"""
      SELECT snapshot_date, space_id, title, grade, score, msgs, accuracy_pct, num_runs, updated_at
      FROM scores_20240120
      UNION ALL SELECT snapshot_date, space_id, title, grade, score, msgs + 1, accuracy_pct,
        CASE WHEN msgs > 300 THEN num_runs END, {_NOW} FROM scores_20240131""",
    "export_key_violations": """
      SELECT eval_run_id, benchmark_question_id, count(*) AS n FROM results GROUP BY ALL HAVING count(*) > 1""",
    "expectation_report": """
      SELECT 'message_details' AS table_name, 'has_space_id' AS expectation, count(space_id) AS passed,
        count(*) - count(space_id) AS failed FROM md
      UNION ALL SELECT 'message_details', 'has_status', count(status), count(*) - count(status) FROM md
      UNION ALL SELECT 'message_details', 'has_time', count(*) FILTER (response_time_sec >= 0),
        count(*) - count(*) FILTER (response_time_sec >= 0) FROM md""",
    # gold
    "factors": "SELECT * FROM factors",
    "error_messages": """
      SELECT message_id, space_id, status, error_type FROM md WHERE status <> 'COMPLETED' OR error_type IS NOT NULL""",
    "richness_facts": "SELECT * FROM richness",
    "benchmark_facts": "SELECT * FROM bench",
    "done_eff": """
      SELECT eval_run_id, num_done, num_questions, CASE WHEN num_done > 0 THEN num_done ELSE num_questions END AS done_eff
      FROM runs""",
    "space_scorecard": "SELECT * FROM scorecard",
    "feedback_flags": """
      SELECT space_id, message_id, user_question AS question, substring(sql_generated, 1, 2000) AS sql_generated,
        error_type, created_ts FROM md WHERE feedback_rating = 'NEGATIVE'""",
    "benchmark_runs_monthly": """
      SELECT strftime(run_ts, '%Y-%m') AS run_month, count(*) AS runs, count(DISTINCT space_id) AS spaces,
        CAST(sum(num_correct) AS BIGINT) AS correct FROM runs WHERE run_ts IS NOT NULL GROUP BY 1""",
    "benchmark_run_trend": "SELECT * FROM trend",
    "benchmark_question_matrix": "SELECT * FROM matrix",
    "fleet_rollup": f"SELECT {_AS_OF} AS snapshot_date, {_FLEET} FROM scorecard",
    # trends and detail
    "trend_conversations": _weekly("count(*) AS n", "convs"),
    "trend_users": _weekly("count(DISTINCT user_id) AS n"),
    "trend_feedback": _weekly("""count(*) FILTER (feedback_rating = 'POSITIVE') AS pos,
      count(*) FILTER (feedback_rating = 'NEGATIVE') AS neg, count(feedback_rating) AS rated"""),
    "trend_quality": _weekly(f"""round(100e0 * sum({_ERR}) / count(*), 1) AS error_pct,
      round(quantile_disc(response_time_sec, 0.9), 1) AS p90_s, count(*) AS msgs"""),
    "trend_depth": """
      SELECT space_id, round(avg(message_count), 2) AS avg_msgs_per_convo, count(*) AS convos FROM convs GROUP BY 1""",
    "daily_trends": f"""
      SELECT coalesce(m.space_id, c.space_id) AS space_id, coalesce(m.date, c.date) AS date,
        coalesce(conversations, 0) AS conversations, coalesce(messages, 0) AS messages, coalesce(users, 0) AS users,
        error_rate, feedback_pos, feedback_neg, feedback_cov, p90_latency
      FROM (SELECT space_id, CAST(created_ts AS DATE) AS date, count(*) AS messages, count(DISTINCT user_id) AS users,
          round(100e0 * sum({_ERR}) / count(*), 1) AS error_rate,
          count(*) FILTER (feedback_rating = 'POSITIVE') AS feedback_pos,
          count(*) FILTER (feedback_rating = 'NEGATIVE') AS feedback_neg,
          round(100e0 * count(feedback_rating) / count(*), 1) AS feedback_cov,
          round(quantile_disc(response_time_sec, 0.9), 1) AS p90_latency FROM md GROUP BY ALL) m
      FULL JOIN (SELECT space_id, CAST(created_ts AS DATE) AS date, count(*) AS conversations FROM convs GROUP BY ALL) c
        ON c.space_id = m.space_id AND c.date = m.date""",
    "top_questions": """
      SELECT *, CAST(row_number() OVER (PARTITION BY space_id ORDER BY asked DESC, last_asked DESC, question) AS INTEGER)
        AS rk FROM (SELECT space_id, user_question AS question, count(*) AS asked, max(created_ts) AS last_asked
        FROM md WHERE user_question IS NOT NULL GROUP BY ALL) QUALIFY rk <= 8""",
    "recent_errors": _top(
        "space_id, message_id, created_ts, user_question, error_type, error_message",
        "md WHERE status <> 'COMPLETED' OR error_type IS NOT NULL", "created_ts DESC, message_id", 6),
    "feedback_samples": _top("space_id, message_id, created_ts, user_question, feedback_rating",
                             "md WHERE feedback_rating IS NOT NULL", "created_ts DESC, message_id", 6),
    "score_history": " UNION ALL ".join(
        f"SELECT snapshot_date, space_id, title, score, grade, accuracy_pct FROM scores_{day.replace('-', '')}"
        for day in _DAYS),
    "flagged_by_space": """
      SELECT user_question AS question, sql_generated, error_type, created_ts FROM md
      WHERE feedback_rating = 'NEGATIVE' AND space_id = 'sp11'""",
    "space_run_trend": "SELECT * EXCLUDE (space_id) FROM trend WHERE space_id = 'sp11'",
    "run_series": """
      SELECT space_id, run_index, quality_pct, count(*) OVER (PARTITION BY space_id) AS n_scored,
        count(*) OVER (PARTITION BY space_id) >= 2 AS has_line FROM trend WHERE quality_pct IS NOT NULL""",
    "trend_delta": """
      SELECT *, CASE WHEN n_scored >= 2 THEN round(last_pct - first_pct, 1) END AS delta_pp,
        CASE WHEN n_scored < 2 THEN NULL WHEN last_pct > first_pct THEN 'up' WHEN last_pct < first_pct THEN 'down'
          ELSE 'flat' END AS direction
      FROM (SELECT space_id, count(*) AS n_scored, arg_min(quality_pct, run_index) AS first_pct,
        arg_max(quality_pct, run_index) AS last_pct FROM trend WHERE quality_pct IS NOT NULL GROUP BY 1)""",
    "stream_daily_trend": f"""
      SELECT space_id, CAST(created_ts AS DATE) AS date, count(*) AS messages, count(DISTINCT user_id) AS users,
        CAST(sum({_ERR}) AS BIGINT) AS errors,
        count(*) FILTER (feedback_rating = 'POSITIVE') AS feedback_pos,
        count(*) FILTER (feedback_rating = 'NEGATIVE') AS feedback_neg, count(feedback_rating) AS rated
      FROM md GROUP BY ALL""",
    "stream_conversation_rollup": f"SELECT space_id, conversation_id, {_ROLLUP} FROM md GROUP BY ALL",
    # strict model
    "space_universe": "SELECT space_id, title, warehouse_id FROM spaces WHERE v = 2",
    "title_fallback": """
      SELECT s.space_id, coalesce(nullif(s.title, ''), 'Listed ' || n_name, 'Space ' || substring(s.space_id, 1, 8))
        AS title, warehouse_id
      FROM spaces s LEFT JOIN nation ON n_nationkey = s_suppkey WHERE v = 2""",
    "strict_benchmark": f"SELECT {_STRICT_COLUMNS} FROM strict",
    "benchmark_confidence": "SELECT * FROM confidence",
    "benchmark_rows": f"""
      SELECT r.space_id, title, eval_run_id AS run_id, run_ts, num_questions, num_correct,
        greatest(coalesce(num_done, num_questions) - num_correct - num_needs_review, 0) AS num_failed, num_needs_review,
        CASE WHEN num_questions > 0 THEN round(100e0 * coalesce(num_done, num_questions) / num_questions, 1)
          ELSE 0e0 END AS coverage,
        round(100e0 * num_correct / CASE WHEN full_size > 0 THEN full_size ELSE 1 END, 1) AS accuracy,
        eval_run_status AS run_status
      FROM runs r JOIN full_sizes f ON f.space_id = r.space_id LEFT JOIN meta m ON m.space_id = r.space_id""",
    "warehouse_missing": """
      SELECT space_id, warehouse_id, warehouse_id IS NOT NULL AND warehouse_id NOT IN (SELECT warehouse_id FROM wh)
        AS wh_missing FROM spaces WHERE v = 2""",
    "verdict_gate": """
      SELECT w.space_id, warehouse_id, wh_missing, msgs,
        CASE WHEN wh_missing THEN 'F' WHEN msgs IS NULL THEN '—' END AS grade,
        CASE WHEN wh_missing THEN 'SQL warehouse deleted — space is non-functional'
          WHEN msgs IS NULL THEN 'No activity harvested yet — nothing to judge.' END AS why,
        CASE WHEN wh_missing THEN 'Reassign an existing SQL warehouse in space Settings'
          WHEN msgs IS NULL THEN 'Drive usage or run an eval benchmark.' END AS fix
      FROM wh_flags w LEFT JOIN factors f ON f.space_id = w.space_id""",
    "verdict_prompt": """
      SELECT f.space_id, 'Judge how far the answers of this data assistant can be trusted. Benchmark accuracy weighs '
        || 'most; low coverage or confidence means unproven. Answer on one line as '
        || '''GRADE: <A-F> | WHY: <=20 words | FIX: <=15 words''. Space="' || title || '"; questions_asked=' || msgs
        || '; distinct_users=' || users || '; error_rate_pct=' || error_pct || '; p90_latency_sec='
        || coalesce(CAST(p90_latency_s AS VARCHAR), 'None') || '; thumbs_up=' || thumbs_up || '; thumbs_down='
        || thumbs_down || '; feedback_coverage_pct=' || feedback_coverage_pct || '; days_since_last_use='
        || days_since_active || '; benchmark_accuracy=' || coalesce(accuracy_pct || '%', 'NO BENCHMARK RUN')
        || '; benchmark_runs=' || coalesce(num_runs, 0) || '; benchmark_coverage_pct='
        || coalesce(CAST(coverage_pct AS VARCHAR), 'None') || '; benchmark_confidence=' || coalesce(confidence, 'n/a')
        || '; full_benchmark_size=' || coalesce(full_benchmark_size, 0) || '.' AS prompt
      FROM factors f JOIN meta m ON m.space_id = f.space_id LEFT JOIN confidence c ON c.space_id = f.space_id""",
    "parse_verdict": "SELECT * FROM grades",
    "grade_score": """
      SELECT doc_id, grade, CASE grade WHEN 'A' THEN 92e0 WHEN 'B' THEN 80e0 WHEN 'C' THEN 66e0 WHEN 'D' THEN 48e0
        WHEN 'F' THEN 22e0 END AS score FROM grades""",
    "cockpit_rank": """
      SELECT CAST(row_number() OVER (ORDER BY tier, coalesce(accuracy_pct, -1), space_id) AS INTEGER) AS rank, *
      FROM (SELECT CASE WHEN NOT warehouse_ok THEN 0 WHEN grade = '—' THEN 2 ELSE 1 END AS tier, space_id, grade, score,
        accuracy_pct FROM scores)""",
    "scores_snapshot": "SELECT * FROM scores",
    # serving
    "coerce_types": """
      SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line,
        l_returnflag = 'A' OR (l_returnflag <> 'N' AND l_linestatus = 'O') AS benchmark_ran,
        CASE WHEN l_linenumber = 3 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS msgs,
        CASE WHEN l_linenumber <> 4 THEN l_discount END AS coverage_pct FROM lineitem""",
    "threshold_bucket": """
      SELECT eval_run_id, quality_pct, CASE WHEN coalesce(quality_pct, 0) >= 80 THEN 'green'
        WHEN coalesce(quality_pct, 0) >= 50 THEN 'amber' ELSE 'red' END AS bucket FROM trend""",
    "health_band": "SELECT space_id, band FROM banded",
    "status_chip": """
      SELECT s.space_id, CASE WHEN benchmark_ran AND coalesce(benchmark_quality_pct, 0) < 50 THEN 'LOW ACCURACY'
          WHEN s.space_id IN (SELECT space_id FROM all_steps WHERE impact = 'high') THEN 'NEEDS FIX'
          WHEN benchmark_ran AND benchmark_quality_pct >= 80 THEN 'PROVEN' WHEN benchmark_ran THEN 'MODERATE'
          WHEN benchmark_questions_defined > 0 THEN 'DEFINED · NOT RUN' ELSE 'NO BENCHMARK' END AS chip FROM scorecard s""",
    "fleet_kpis": f"SELECT {_KPIS} FROM banded",
    "recommendation_counts": """
      SELECT space_id, count(*) AS n_recs, coalesce(bool_or(impact = 'high'), false) AS has_high FROM all_steps GROUP BY 1""",
    "owner_list": "SELECT DISTINCT owner FROM scorecard WHERE owner <> ''",
    "owner_rollup": f"SELECT owner, {_KPIS} FROM banded GROUP BY 1",
    "worst_first": """
      SELECT CAST(row_number() OVER (ORDER BY benchmark_quality_pct ASC NULLS FIRST, space_id) AS INTEGER) AS pos,
        space_id, benchmark_quality_pct FROM scorecard""",
    "best_first": """
      SELECT CAST(row_number() OVER (ORDER BY benchmark_quality_pct DESC NULLS LAST, space_id) AS INTEGER) AS pos,
        space_id, benchmark_quality_pct FROM scorecard""",
    "band_listing": """
      SELECT band_order, CAST(CASE WHEN band_order = 1
          THEN row_number() OVER (PARTITION BY band_order ORDER BY quality DESC NULLS LAST, space_id)
          ELSE row_number() OVER (PARTITION BY band_order ORDER BY quality ASC NULLS FIRST, space_id) END AS INTEGER)
          AS pos, space_id, title, chip, quality, instr_total, richness_total
      FROM (SELECT CASE band WHEN 'proven' THEN 1 WHEN 'monitor' THEN 2 ELSE 3 END AS band_order, space_id, title, chip,
        benchmark_quality_pct AS quality, sql_instructions + text_instructions AS instr_total,
        sql_instructions + text_instructions + sample_questions AS richness_total FROM banded)""",
    "space_detail": "SELECT * FROM scorecard WHERE space_id = 'sp11'",
    "matrix_cells": """
      SELECT space_id, benchmark_question_id, eval_run_id, question, CASE WHEN length(question) > 60
          THEN substring(question, 1, 60) || '…' ELSE question END AS label, run_index, assessment, n_results,
        CASE assessment WHEN 'GOOD' THEN '✓' WHEN 'BAD' THEN '✕' ELSE '~' END AS glyph,
        CASE assessment WHEN 'GOOD' THEN 'green' WHEN 'BAD' THEN 'red' ELSE 'amber' END AS colour
      FROM (SELECT space_id, benchmark_question_id, eval_run_id, run_index, arg_max(question, result_id) AS question,
          arg_max(assessment, result_id) AS assessment, count(*) AS n_results FROM matrix GROUP BY ALL)""",
    "matrix_pivot": """
      SELECT space_id, benchmark_question_id, CAST(count(*) AS INTEGER) AS n_runs,
        string_agg(run_index || ':' || eval_run_id || ':' || assessment, ' ' ORDER BY run_index, eval_run_id) AS runs
      FROM (SELECT space_id, benchmark_question_id, eval_run_id, run_index, arg_max(assessment, result_id) AS assessment
        FROM matrix GROUP BY ALL) GROUP BY ALL""",
    "improvement_listing": """
      SELECT space_id, CAST(row_number() OVER (PARTITION BY space_id ORDER BY
          CASE impact WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, rank) AS INTEGER) AS pos,
        impact, category, source, step, why, evidence FROM improvements""",
    # diagnosis
    "deterministic_findings": "SELECT * FROM rules",
    "evidence_bundle": """
      SELECT s.space_id, s.title, coalesce(part, 0) AS part, coalesce(n_parts, 1) AS n_parts, msgs, coverage_pct,
        CAST(coalesce(ni, 0) AS INTEGER) AS n_instructions, CAST(coalesce(nq, 0) AS INTEGER) AS n_questions,
        CAST(coalesce(nr, 0) AS INTEGER) AS n_results, coalesce(iids, '') AS instruction_ids,
        coalesce(qids, '') AS question_ids, coalesce(rids, '') AS result_ids
      FROM scorecard s LEFT JOIN parts p ON p.space_id = s.space_id""",
    "bundle_json": """
      SELECT s.space_id, coalesce(p.part, 0) AS part, '{"schema":{},"instructions":[' || coalesce(ij, '')
        || '],"benchmark_questions":[' || coalesce(qj, '') || '],"benchmark_results":[' || coalesce(rj, '') || ']}' AS json
      FROM scorecard s LEFT JOIN parts p ON p.space_id = s.space_id""",
    "valid_evidence_ids": "SELECT * FROM ids",
    "parse_model_steps": "SELECT * FROM steps",
    "grounded_steps": "SELECT * FROM grounded",
    "grounded_steps_strict": """
      SELECT * FROM steps s WHERE category IN ('CONFLICTING_INSTRUCTIONS', 'BAD_GROUND_TRUTH')
        AND EXISTS (SELECT 1 FROM ids i WHERE i.space_id = s.space_id
          AND list_contains(string_split(s.evidence, ' '), i.id))""",
    "space_improvements": "SELECT * FROM improvements",
    # evaluation of the diagnosis
    "case_scores": "SELECT *, n_missed = 0 AND n_wrong = 0 AS ok FROM cases",
    "exam_scores": """
      SELECT *, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 1e0 END AS recall,
        CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 1e0 END AS precision
      FROM (SELECT CAST(sum(n_hit) AS BIGINT) AS tp, CAST(sum(n_missed) AS BIGINT) AS fn,
        CAST(sum(n_wrong) AS BIGINT) AS fp FROM cases)""",
    "trimmed_bundle": "SELECT * EXCLUDE (text_instructions, lastq) FROM trimmed",
    "inject_defects": """
      SELECT space_id, mutation, CASE mutation WHEN 'conflict' THEN 'CONFLICTING_INSTRUCTIONS' ELSE 'BAD_GROUND_TRUTH' END
          AS expected,
        CAST(n_instructions + CASE mutation WHEN 'conflict' THEN 1 ELSE 0 END AS INTEGER) AS n_instructions,
        CAST(defined + CASE mutation WHEN 'conflict' THEN 0 ELSE 1 END AS INTEGER) AS n_questions,
        CASE mutation WHEN 'conflict' THEN 0 ELSE 1 END AS n_results,
        CASE mutation WHEN 'conflict' THEN lastq ELSE 'defect_question' END AS last_question,
        CASE mutation WHEN 'conflict' THEN '' ELSE 't' END AS tables
      FROM trimmed, (VALUES ('conflict'), ('bad_truth')) AS m(mutation)""",
    # specified figures
    "harvest_freshness": f"""
      SELECT space_id, max(harvested_at) AS last_harvest,
        CAST({_AS_OF} - CAST(max(harvested_at) AS DATE) AS INTEGER) AS harvest_age_days FROM md GROUP BY 1""",
    "config_freshness": f"""
      SELECT space_id, changed AS last_config, CAST({_AS_OF} - CAST(changed AS DATE) AS INTEGER) AS config_age_days
      FROM meta""",
    "richness_score": """
      SELECT space_id, accepted_instructions + sample_questions + benchmark_questions_defined AS richness_score
      FROM scorecard""",
    "fleet_medians": f"""
      SELECT CAST(median(age) AS DOUBLE) AS median_age_days,
        round(100e0 * count(*) FILTER (age <= 7) / count(age), 1) AS pct_fresh,
        CAST(median(score) AS DOUBLE) AS median_richness
      FROM (SELECT space_id, {_AS_OF} - CAST(max(harvested_at) AS DATE) AS age FROM md GROUP BY 1) h
      FULL JOIN (SELECT space_id, accepted_instructions + sample_questions + benchmark_questions_defined AS score
        FROM scorecard) r ON r.space_id = h.space_id""",
    "benchmark_funnel": """
      SELECT CAST(sum(benchmark_questions_defined) AS BIGINT) AS defined, CAST(coalesce(sum(done_eff), 0) AS BIGINT) AS run,
        CAST(sum(num_correct) AS BIGINT) AS correct,
        count(*) FILTER (benchmark_questions_defined > 0 AND num_runs = 0) AS spaces_defined_never_run FROM scorecard""",
    "space_funnel": """
      SELECT space_id, benchmark_questions_defined AS defined, coalesce(done_eff, 0) AS run, num_correct AS correct,
        benchmark_questions_defined > 0 AND num_runs = 0 AS defined_never_run FROM scorecard""",
    "ranked_examples": """
      SELECT space_id, CAST(row_number() OVER (PARTITION BY space_id ORDER BY p_partkey) AS INTEGER) AS rk,
        curated_question_id, question_text, answer_text, eval_note FROM cq
      WHERE is_deprecated = false OR is_deprecated IS NULL""",
    "fleet_trend": " UNION ALL ".join(
        f"SELECT DATE '{day}' AS snapshot_date, {_FLEET} FROM scorecard_{day.replace('-', '')}" for day in _DAYS),
}
_SQL["factors_from_states"] = _SQL["factors"]
_SQL["daily_trends_from_states"] = _SQL["daily_trends"]
_WEEK = _weekly(f"""count(*) AS msgs, count(DISTINCT user_id) AS users, round(100e0 * sum({_ERR}) / count(*), 1) AS error_pct,
      round(quantile_disc(response_time_sec, 0.9), 1) AS p90_s, count(*) FILTER (feedback_rating = 'POSITIVE') AS pos,
      count(*) FILTER (feedback_rating = 'NEGATIVE') AS neg, count(feedback_rating) AS rated""")
_SQL["weekly_trends_from_states"] = f"""
      SELECT coalesce(m.wk, c.wk) AS wk, coalesce(m.space_id, c.space_id) AS space_id, m.* EXCLUDE (wk, space_id), c.n AS conversations
      FROM ({_WEEK}) m FULL JOIN ({_weekly("count(*) AS n", "convs")}) c ON c.wk = m.wk AND c.space_id = m.space_id"""


def oracle_sql() -> dict[str, str]:
    return {name: _with(sql) for name, sql in _SQL.items()}
