"""Fixed values that results depend on: search terms, package names, patterns and limits."""

#: The search queries for frameworks, best-known first.
FRAMEWORK_QUERIES = (
    "AI agent framework stars:>999 language:Python",
    "LLM-based agent framework stars:>999 language:Python",
    "LLM agent library stars:>999 language:Python",
    "multi-agent orchestration framework stars:>999 language:Python",
    "LLM powered agents framework stars:>999 language:Python",
)
#: The keywords that applications are searched by.
APPLICATION_TERMS = (
    "langchain", "langgraph", "autogen", "crewai", "pydantic-ai", "metagpt", "camel-ai", "agency-swarm", "griptape", "agentops",
    "openai-agents", "adalflow", "swarms", "parlant", "praisonai", "dynamiq", "openai-swarm", "superagi", "agent-zero", "ragaai-catalyst",
    "pentestgpt", "ten-framework", "livekit-agents", "agent-squad", "lavague", "superduper", "giskard", "ii-agent", "beeai-framework",
    "cheshire-cat", "solace-agent-mesh", "openlit", "nextpy", "llmstack", "lagent", "agentuniverse", "notte", "demogpt", "pentestagent",
    "redamon", "honcho", "uagents", "openakita", "patchwork", "agent-protocol", "npcpy", "infiagent", "any-agent", "sage",
)
LEAST_STARS, PUSHED_AFTER, LANGUAGE = 10, "2025-04-14", "Python"
PAGE_ROWS, MOST_PAGES = 100, 3

#: Modules whose import marks a test file, for frameworks; applications have the evaluators as well.
MODEL_MODULES = (
    "openai", "anthropic", "litellm", "cohere", "mistralai", "google.generativeai", "vertexai", "boto3", "langchain", "langchain_openai",
    "langchain_anthropic", "langchain_community", "llamaindex", "llama_index", "ollama", "groq", "together", "huggingface_hub",
    "transformers",
)
EVALUATOR_MODULES = ("opik", "deepeval", "giskard", "promptfoo", "phoenix", "arize_phoenix", "ragas")

#: Text that names a model call, and text that names a stand-in for one; both anywhere, in any case.
CALL_PATTERN = (
    "chat\\.completions\\.create|messages\\.create|generate|invoke|complete|completion|predict|run|stream|achat|ainvoke|agenerate"
    "|apredict|acomplete|astream"
)
MOCK_PATTERN = "mock|patch|fake|stub|fixture|monkeypatch|MagicMock|AsyncMock"

#: Names of test files and of dependency files, and folders that a walk leaves out.
TEST_FILE = "(^|/)test_[^/]+\\.py$"
DEP_FILE = "(^|/)(requirements[^/]*\\.txt|pyproject\\.toml|setup\\.py|setup\\.cfg)$"
VENDORED = (".git", "node_modules", ".venv", "venv", "__pycache__")
#: The dependency files looked for at a repository's root, in this order.
ROOT_DEP_FILES = (
    "requirements.txt",
    "requirements-dev.txt",
    "requirements-test.txt",
    "requirements_dev.txt",
    "requirements_test.txt",
    "pyproject.toml",
    "setup.py",
    "setup.cfg",
)
#: The evaluators, and the packages that stand for them in dependency files.
EVALUATOR_PACKAGES = {
    "giskard": "giskard",
    "deepeval": "deepeval",
    "opik": "opik",
    "ragas": "ragas",
    "promptfoo": "promptfoo",
    "phoenix": "arize-phoenix",
}


def package_pattern(package: str) -> str:
    """A dependency on a package: its name after a line's start, white space, a comma, quote or bracket, and before one of these or a version."""
    return "(?:^|[\\s,\"'\\[])" + package + "(?:\\s|[>=<!\\[,\\]\"']|$)"


#: Columns of the exported tables, in order.
FRAMEWORK_COLUMNS = (
    "full_name", "html_url", "description", "matched_query", "stars", "forks", "language", "topics", "open_issues", "size_kb",
    "default_branch", "created_at", "updated_at", "pushed_at", "latest_default_branch_commit_date", "archived", "disabled", "license",
    "contributors_count", "test_file_count", "test_function_count", "clone_url",
)
APPLICATION_V1_COLUMNS = (
    "full_name", "html_url", "description", "matched_frameworks", "stars", "forks", "language", "topics", "open_issues", "size_kb",
    "default_branch", "created_at", "updated_at", "pushed_at", "latest_default_branch_commit_date", "fork", "archived", "disabled",
    "license", "contributors_count", "total_commits", "lifetime_days", "commits_per_month", "test_file_count", "test_function_count",
    "clone_url",
)
APPLICATION_V2_COLUMNS = (
    "full_name", "html_url", "clone_url", "default_branch", "description", "matched_frameworks", "stars", "forks", "language", "topics",
    "open_issues", "size_kb", "created_at", "updated_at", "pushed_at", "license", "lifetime_days", "contributors", "total_commits",
    "commits_per_month",
)
TABLE_COLUMNS = ("AI agent framework", "# Stars (k)", "# Contributors", "# Test files", "# Test functions")
