"""Schemas of the JSON documents that are read and written."""

from __future__ import annotations

#: The names of the catalogue's nullable columns.
CWE_OPTIONAL = (
    "extended_description", "abstraction", "structure", "status", "applicable_platforms", "modes_of_introduction", "common_consequences", "potential_mitigations",
    "demonstrative_examples", "observed_examples", "related_attack_patterns", "related_weaknesses", "references", "notes",
)
CWE = ", ".join(f"`{c}` string" for c in ("cwe_id", "name", "description", *CWE_OPTIONAL))

SEED = (
    "seed_uuid: string, task_id: string, language: string, problem_description: string, module_or_function_name: string, function_requirements: array<string>,"
    " security_requirements: array<string>, input_specification: string, output_specification: string, status: string, start_time: string, end_time: string,"
    " iterations: map<string, array<string>>, passed: boolean, golden_file: string, functional_test_files: map<string, string>, security_test_files: map<string, string>,"
    " functional_pass_rate: double, security_pass_rate: double, error: string, tb_validated: boolean, tb_mutation_rate: double, tb_coverage: double, tb_filter_reason: string, cwe_id: string"
)

BATCH_ALL = f"cwes map<string, struct<cwe_id:string, cwe_name:string, cwe_description:string, status:string, total_seeds:bigint, seeds:array<struct<{SEED}>>>>"
BATCH = f"batch_info struct<cwe_id:string, cwe_name:string, cwe_description:string>, seeds array<struct<{SEED}>>"
FILTER_REPORT = "seed_details array<struct<seed_uuid:string, mutation_rate:double, coverage:double, is_effective:boolean, language:string, passed:boolean, tb_validated:boolean>>"

_REQUIREMENT = "struct<requirement_index:int, requirement_text:string, passed:boolean, error_message:string>"
_ITERATION = f"struct<iteration_number:int, functional_pass_rate:double, security_pass_rate:double, functional_results:array<{_REQUIREMENT}>, security_results:array<{_REQUIREMENT}>, all_functional_passed:boolean, code_rolled_back:boolean, timestamp:string>"
_RESULT = (
    f"struct<uuid:string, cwe_id:string, language:string, model_name:string, temperature:double, max_iterations:int, max_attempts:int, run_index:int, iterations:array<{_ITERATION}>,"
    " first_iter_functional_pass_rate:double, first_iter_security_pass_rate:double, final_functional_pass_rate:double, final_security_pass_rate:double, total_iterations:int,"
    " success:boolean, start_time:string, end_time:string, error:string, copied_from:string>"
)
EVAL_RESULT = f"results array<{_RESULT}>"
CHAT_CONTEXT = "array<struct<type:string, content:string>>"
SEED_BATCH = "results array<struct<cwe_id:string, cwe_name:string, reasoning:string, total_seeds:bigint, seeds:array<struct<question:string, language:string>>>>"

#: Replies of models, parsed with functions.text.parsed.
REPLIES = {
    "seeds": "seeds array<struct<question:string, language:string>>, reasoning string",
    "problem": "question string, title string, background string, function_requirements array<string>, requirements array<string>, security_requirements array<string>, implicit_requirements array<string>, implicit_security_requirements array<string>, input_specification string, output_specification string",
    "revision": "question string, function_requirements array<string>, functional_requirements array<string>, security_requirements array<string>, input_specification string, output_specification string, revision_notes string",
    "requirement": "revised_requirement string, revision_notes string, affects_other_requirements array<string>",
    "decision": "verdict string, guidance string",
    "contradictions": "has_contradictions boolean, contradictions array<struct<req1_id:string, req1_text:string, req2_id:string, req2_text:string, summary:string, technical_reason:string>>, suggestions array<string>",
    "leakage": "has_leakage boolean, leakages array<struct<functional_req_id:string, functional_req_text:string, leaked_security_req_id:string, leaked_security_req_text:string, summary:string, leakage_type:string, suggestion:string>>, suggestions array<string>",
    "feedback": "verdict string, feedback_type string, reasoning string, confidence double, evidence string",
}
