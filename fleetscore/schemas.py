"""Schemas of landed payloads, of the bronze tables and of the exam file.

Payload numbers and flags are read as text first, because services send them either way; a nested
value read as text keeps its JSON, fields nobody declared included.
"""

from __future__ import annotations

# --- payloads, one JSON document per line -------------------------------------------------------
SPACE_PAYLOAD = "space_id string, title string, description string, warehouse_id string, parent_path string"

_MESSAGE = (
    "struct<message_id:string,id:string,user_id:string,content:string,status:string,created_timestamp:string,"
    "last_updated_timestamp:string,attachments:string,"
    "query_result:struct<statement_id:string,row_count:string,is_truncated:string>,"
    "error:string,feedback:string>"
)
# A long conversation may be landed in pages; `offset` is then the number of messages before the page.
CONVERSATION_PAYLOAD = (
    "space_id string, space_title string, "
    "conversation struct<conversation_id:string,id:string,title:string,user_id:string,created_timestamp:string,"
    f"last_updated_timestamp:string>, offset string, messages array<{_MESSAGE}>"
)
ATTACHMENTS = (
    "array<struct<attachment_id:string,"
    "query:struct<id:string,query:string,title:string,description:string,statement_id:string,"
    "last_updated_timestamp:string,parameters:string,"
    "query_result_metadata:struct<row_count:string,is_truncated:string>>,"
    "text:struct<id:string,content:string,purpose:string>,"
    "suggested_questions:struct<questions:string>>>"
)
EVAL_RUNS_PAYLOAD = (
    "space_id string, eval_runs array<struct<eval_run_id:string,eval_run_status:string,num_questions:string,"
    "num_correct:string,num_needs_review:string,num_done:string,created_timestamp:string,run_by_user:string>>"
)
INSTRUCTIONS_PAYLOAD = (
    "space_id string, instructions array<struct<instruction_id:string,instruction_type:string,title:string,"
    "content:string,usage_guidance:string,instruction_status:string,use_as_tool:string>>"
)
CURATED_PAYLOAD = (
    "space_id string, curated_questions array<struct<curated_question_id:string,question_type:string,"
    "question_text:string,answer_text:string,eval_note:string,is_deprecated:string>>"
)
SPACE_META_PAYLOAD = (
    "space_id string, title string, parent_path string, warehouse_id string, run_as_type string, "
    "last_updated_timestamp string, table_identifiers array<string>"
)
RESULT_LIST_PAYLOAD = (
    "space_id string, eval_run_id string, "
    "eval_results array<struct<result_id:string,benchmark_question_id:string,question:string>>"
)
RESULT_DETAIL_PAYLOAD = (
    "space_id string, eval_run_id string, result_id string, assessment string, expected_response string, "
    "actual_response string"
)

# --- bronze tables ------------------------------------------------------------------------------
BRONZE = {
    "spaces": "space_id string, title string, description string, warehouse_id string, parent_path string, "
              "harvested_at timestamp",
    "conversations": "space_id string, space_title string, conversation_id string, conversation_title string, "
                     "user_id bigint, created_ts timestamp, last_updated_ts timestamp, message_count int, "
                     "completed_count int, failed_count int, first_message_ts timestamp, last_message_ts timestamp, "
                     "conversation_duration_sec double, has_sql_output boolean, has_errors boolean, "
                     "has_feedback boolean, harvested_at timestamp",
    "message_details": "space_id string, space_title string, conversation_id string, conversation_title string, "
                       "message_id string, user_id bigint, user_question string, status string, "
                       "created_ts timestamp, completed_ts timestamp, response_time_sec double, "
                       "sql_generated string, sql_title string, sql_description string, sql_attachment_id string, "
                       "sql_statement_id string, sql_statement_ids string, sql_parameters string, "
                       "sql_last_updated_ts timestamp, row_count bigint, is_truncated boolean, "
                       "legacy_statement_id string, legacy_row_count bigint, legacy_is_truncated boolean, "
                       "text_response string, text_purpose string, text_attachment_id string, "
                       "suggested_questions string, error_type string, error_message string, "
                       "feedback_rating string, attachment_count int, has_query_attachment boolean, "
                       "has_text_attachment boolean, has_suggested_questions boolean, message_position int, "
                       "is_first_message boolean, raw_attachments_json string, harvested_at timestamp, has_error boolean, has_feedback boolean",
    "eval_runs": "space_id string, eval_run_id string, eval_run_status string, num_questions int, num_correct int, "
                 "num_needs_review int, num_done int, created_timestamp bigint, run_by_user string",
    "instructions": "space_id string, instruction_id string, instruction_type string, title string, content string, "
                    "usage_guidance string, instruction_status string, use_as_tool string",
    "curated_questions": "space_id string, curated_question_id string, question_type string, question_text string, "
                         "answer_text string, eval_note string, is_deprecated boolean",
    "space_meta": "space_id string, title string, owner string, parent_path string, warehouse_id string, "
                  "run_as_type string, last_updated_timestamp bigint, table_identifiers array<string>",
    "eval_results": "space_id string, eval_run_id string, benchmark_question_id string, question string, "
                    "assessment string, expected_response string, actual_response string, result_id string",
}
PRIMARY_KEYS = {
    "spaces": ["space_id"],
    "conversations": ["space_id", "conversation_id"],
    "message_details": ["space_id", "conversation_id", "message_id"],
    "eval_runs": ["space_id", "eval_run_id"],
    "instructions": ["space_id", "instruction_id"],
    "curated_questions": ["space_id", "curated_question_id"],
    "space_meta": ["space_id"],
    "eval_results": ["result_id"],
    "space_scorecard": ["space_id"],
    "space_improvements": ["space_id", "rank"],
    "feedback_flags": ["message_id"],
    "benchmark_runs_monthly": ["run_month"],
    "benchmark_run_trend": ["eval_run_id"],
    "benchmark_question_matrix": ["result_id"],
    "fleet_rollup": ["snapshot_date"],
}

# --- exam ---------------------------------------------------------------------------------------
EXAM_FILE = (
    "cases array<struct<case_id:string,description:string,evidence:struct<title:string,"
    "metrics:struct<benchmark_questions_defined:int,num_runs:int,coverage_pct:double,benchmark_quality_pct:double,"
    "sql_instructions:int,text_instructions:int,feedback_positive_pct:double,thumbs_down:int,msgs:int>,"
    "schema:map<string,array<string>>,"
    "instructions:array<struct<instruction_id:string,instruction_type:string,title:string,content:string>>,"
    "benchmark_questions:array<struct<benchmark_question_id:string,question_text:string,answer_text:string>>,"
    "benchmark_results:array<struct<benchmark_question_id:string,question:string,assessment:string,"
    "expected_sql:string,actual_sql:string>>>,"
    "expected:struct<must_flag:array<string>,must_not_flag:array<string>>>>"
)
