"""Schemas of the engine's tables."""

HIT_ITEM = (
    "struct<full_name:string, html_url:string, description:string, stargazers_count:bigint, forks_count:bigint, language:string,"
    " topics:array<string>, open_issues_count:bigint, size:bigint, default_branch:string, created_at:string, updated_at:string,"
    " pushed_at:string, fork:boolean, archived:boolean, disabled:boolean, license:struct<spdx_id:string>, clone_url:string>"
)
SEARCH_HITS = f"run_id string, term string, term_seq int, page int, pos int, item {HIT_ITEM}"
CONTRIBUTORS = "full_name string, contributor_id string"
COMMITS = "full_name string, branch string, sha string, committer_date string"
LISTED_COMMITS = COMMITS + ", pos int"
COMMIT_LINKS = "full_name string, link_header string, body_len bigint, status int"
TREE_ENTRIES = "full_name string, branch string, type string, path string"
FILES = "full_name string, branch string, path string, status int, content string"
DEP_STATE = "full_name string, category string, frameworks string, dep_files string, no_deps boolean, deep_checked boolean"
SEARCH_STATE = "kind string, key string, version bigint, payload string"
LLM_TESTS = "repo string, file string, test_function string"
