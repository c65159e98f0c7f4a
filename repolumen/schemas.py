"""Explicit schemas of the landed tables; nothing is inferred on read."""
FILES = "repo_id string, path string, size bigint"
FILE_CONTENTS = "repo_id string, path string, content string"
TREE = "repo_id string, type string, path string, size bigint"
ENCODED_FILES = "repo_id string, path string, content string, encoding string"
NODES = "repo_id string, path string"
EDGES = "repo_id string, src string, dst string"
WEIGHTED_EDGES = "repo_id string, src string, dst string, weight double"
COMMITS_JSON = (
    "repo_id string, sha string, committed_at timestamp, author string, "
    "files array<struct<filename:string,status:string>>"
)
COMMIT_FILES = "repo_id string, sha string, committed_at timestamp, author string, path string, status string"
PULLS_JSON = (
    "url string, files array<struct<filename:string,status:string,additions:int,changes:int,patch:string>>"
)
PR_FILES = (
    "repo_id string, pr_number bigint, path string, status string, additions int, changes int, patch string"
)
TRACES = "trace_id string, repo_id string, trace string"
ANALYSES = (
    "id bigint, repo_url string, repo_name string, commit_sha string, analysis_version int, "
    "user_id string, created_at timestamp, result_json string"
)
PROFILES = "user_id string, plan_tier string, is_admin boolean"
USAGE_EVENTS = "user_id string, kind string, ts timestamp"
SUB_EVENTS = "event_id string, user_id string, event string, status string, ts timestamp"
FEEDBACK = "debug_id string, is_helpful boolean"

# nested result document; only the checked part is typed
RESULT_DOCUMENT = """
owner string, repo string, description string, stars double, language string, totalFiles double,
entryPoints array<string>, mermaidDiagram string,
analysis struct<
  architecture_pattern:string, what_it_does:string, execution_flow:array<string>,
  tech_stack:array<struct<name:string,purpose:string>>,
  key_modules:array<struct<file:string,role:string,why_it_exists:string>>,
  onboarding_guide:array<string>,
  blast_radius:array<struct<file:string,dependents:double,warning:string,safe_refactor_steps:array<string>>>,
  health_status:struct<grade:string,score:double,status:string,refactor_plan:array<string>>>,
dependencyGraph map<string,array<string>>,
fileMetrics array<struct<path:string,size:double>>,
coverageGaps array<struct<file:string,fanIn:double,riskScore:double,isTested:boolean,testFiles:array<string>>>,
fileContents array<struct<path:string,content:string>>,
_corrupt string
"""
