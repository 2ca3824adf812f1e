"""Lists and tables that results depend on, in their natural order."""

DEBUG = ["fix", "bug", "error", "broken", "failing", "crash", "issue", "debug", "traceback", "exception", "stack trace", "stacktrace", "not working", "wrong", "unexpected", "status code", "404", "500", "401", "403"]
FEATURE = ["add", "create", "implement", "new", "build", "feature", "introduce", "set up", "setup", "scaffold", "generate", "make a", "make me", "make the", "write a", "write me", "write the"]
REFACTOR = ["refactor", "clean up", "cleanup", "rename", "reorganize", "simplify", "extract", "restructure", "move", "migrate", "split"]
BRAINSTORM = ["brainstorm", "idea", "what if", "explore", "think about", "approach", "strategy", "design", "consider", "how should", "what would", "opinion", "suggest", "recommend"]
RESEARCH = ["research", "investigate", "look into", "find out", "check", "search", "analyze", "review", "understand", "explain", "how does", "what is", "show me", "list", "compare"]
TEST = ["test", "pytest", "vitest", "jest", "mocha", "spec", "coverage", "npm test", "npx vitest", "npx jest"]
GIT = ["git push", "git pull", "git commit", "git merge", "git rebase", "git checkout", "git branch", "git stash", "git log", "git diff", "git status", "git add", "git reset", "git cherry-pick", "git tag"]
BUILD = ["npm run build", "npm publish", "pip install", "docker", "deploy", "make build", "npm run dev", "npm start", "pm2", "systemctl", "brew", "cargo build"]
INSTALL = ["npm install", "brew install", "apt install", "cargo add"]
KEYWORDS = {"debug": DEBUG, "feature": FEATURE, "refactor": REFACTOR, "brainstorm": BRAINSTORM, "research": RESEARCH, "test": TEST, "git": GIT, "build": BUILD, "install": INSTALL}

FILE_PATTERN = r"\.(?:py|js|ts|tsx|jsx|json|yaml|yml|toml|sql|sh|go|rs|java|rb|php|css|html|md|csv|xml)\b"
SCRIPT_PATTERN = r"\b(?:run\s+\S+\.\w+|execute|scrip?t|curl|api\s+\S+|endpoint|request\s+url|fetch\s+\S+|query|database|db\s+\S+)\b"
URL_PATTERN = r"https?://\S+"

EDIT_TOOLS = ["Edit", "Write", "FileEditTool", "FileWriteTool", "NotebookEdit", "cursor:edit"]
READ_TOOLS = ["Read", "Grep", "Glob", "FileReadTool", "GrepTool", "GlobTool"]
SHELL_TOOLS = ["Bash", "BashTool", "PowerShellTool"]
TASK_TOOLS = ["TaskCreate", "TaskUpdate", "TaskGet", "TaskList", "TaskOutput", "TaskStop", "TodoWrite"]
SEARCH_TOOLS = ["WebSearch", "WebFetch", "ToolSearch"]
CATEGORIES = ["Coding", "Debugging", "Feature Dev", "Refactoring", "Testing", "Exploration", "Planning", "Delegation", "Git Ops", "Build/Deploy", "Conversation", "Brainstorming", "General"]

TOOL_MAPS = {
    "codex": {"exec_command": "Bash", "read_file": "Read", "write_file": "Edit", "apply_diff": "Edit", "apply_patch": "Edit", "spawn_agent": "Agent", "close_agent": "Agent", "wait_agent": "Agent", "read_dir": "Glob"},
    "pi": {"bash": "Bash", "read": "Read", "edit": "Edit", "write": "Write", "glob": "Glob", "grep": "Grep", "task": "Agent", "dispatch_agent": "Agent", "fetch": "WebFetch", "search": "WebSearch", "todo": "TodoWrite", "patch": "Patch"},
    "copilot": {"bash": "Bash", "read_file": "Read", "write_file": "Edit", "edit_file": "Edit", "create_file": "Write", "delete_file": "Delete", "search_files": "Grep", "find_files": "Glob", "list_directory": "LS", "web_search": "WebSearch", "fetch_webpage": "WebFetch", "github_repo": "GitHub"},
    "opencode": {"bash": "Bash", "read": "Read", "edit": "Edit", "write": "Write", "glob": "Glob", "grep": "Grep", "task": "Agent", "fetch": "WebFetch", "search": "WebSearch", "todo": "TodoWrite", "skill": "Skill", "patch": "Patch"},
}

#: model: input, output, cache write, cache read (dollars a token), multiplier of the fast mode
FALLBACK_PRICES = {
    "claude-opus-4-7": ("0.000005", "0.000025", "0.00000625", "0.0000005", 6), "claude-opus-4-6": ("0.000005", "0.000025", "0.00000625", "0.0000005", 6),
    "claude-opus-4-5": ("0.000005", "0.000025", "0.00000625", "0.0000005", 1), "claude-opus-4-1": ("0.000015", "0.000075", "0.00001875", "0.0000015", 1),
    "claude-opus-4": ("0.000015", "0.000075", "0.00001875", "0.0000015", 1), "claude-sonnet-4-6": ("0.000003", "0.000015", "0.00000375", "0.0000003", 1),
    "claude-sonnet-4-5": ("0.000003", "0.000015", "0.00000375", "0.0000003", 1), "claude-sonnet-4": ("0.000003", "0.000015", "0.00000375", "0.0000003", 1),
    "claude-3-7-sonnet": ("0.000003", "0.000015", "0.00000375", "0.0000003", 1), "claude-3-5-sonnet": ("0.000003", "0.000015", "0.00000375", "0.0000003", 1),
    "claude-haiku-4-5": ("0.000001", "0.000005", "0.00000125", "0.0000001", 1), "claude-3-5-haiku": ("0.0000008", "0.000004", "0.000001", "0.00000008", 1),
    "gpt-4o": ("0.0000025", "0.00001", "0.0000025", "0.00000125", 1), "gpt-4o-mini": ("0.00000015", "0.0000006", "0.00000015", "0.000000075", 1),
    "gemini-2.5-pro": ("0.00000125", "0.00001", "0.00000125", "0.000000315", 1), "gpt-5.3-codex": ("0.0000025", "0.00001", "0.0000025", "0.00000125", 1),
    "gpt-5.4": ("0.0000025", "0.00001", "0.0000025", "0.00000125", 1), "gpt-5.4-mini": ("0.0000004", "0.0000016", "0.0000004", "0.0000002", 1),
    "gpt-5": ("0.0000025", "0.00001", "0.0000025", "0.00000125", 1),
}
WEB_SEARCH_PRICE = "0.01"

#: first match by prefix
SHORT_NAMES = {
    "claude-opus-4-7": "Opus 4.7", "claude-opus-4-6": "Opus 4.6", "claude-opus-4-5": "Opus 4.5", "claude-opus-4-1": "Opus 4.1", "claude-opus-4": "Opus 4",
    "claude-sonnet-4-6": "Sonnet 4.6", "claude-sonnet-4-5": "Sonnet 4.5", "claude-sonnet-4": "Sonnet 4", "claude-3-7-sonnet": "Sonnet 3.7", "claude-3-5-sonnet": "Sonnet 3.5",
    "claude-haiku-4-5": "Haiku 4.5", "claude-3-5-haiku": "Haiku 3.5", "gpt-4o-mini": "GPT-4o Mini", "gpt-4o": "GPT-4o", "gpt-5.4-mini": "GPT-5.4 Mini", "gpt-5.4": "GPT-5.4",
    "gpt-5.3-codex": "GPT-5.3 Codex", "gpt-5": "GPT-5", "gemini-2.5-pro": "Gemini 2.5 Pro",
}

SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "CNY": "¥", "KRW": "₩", "INR": "₹", "BRL": "R$", "CAD": "C$", "AUD": "A$", "CHF": "CHF", "SEK": "kr", "NOK": "kr", "DKK": "kr", "PLN": "zł", "TRY": "₺", "MXN": "MX$"}
