"""Word lists, patterns and limits that decide the results.

Nothing here is derived; every value is part of the specified behaviour and is
written out plainly.  Patterns are dialect-neutral (no ``\\b``); word
boundaries are added by :func:`bounded` as ASCII look-arounds, because the JVM
boundary is Unicode-aware and the specified one is not.
"""

from __future__ import annotations

# --- fixed values: whitespace (the ECMAScript class, spelled out) -------------
WS_CLASS = (
    r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)
WS_RUN = f"[{WS_CLASS}]+"
WS_EDGE = f"^[{WS_CLASS}]+|[{WS_CLASS}]+$"
TRIM_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def bounded(body: str) -> str:
    """``\\bbody\\b`` with ASCII word semantics, for the JVM regex engine."""
    return f"(?<![A-Za-z0-9_])(?:{body})(?![A-Za-z0-9_])"


# --- fixed values: facet stop words ------------------------------------------
FACET_STOPWORDS_EN = [
    "a", "am", "an", "and", "are", "as", "at", "be", "been", "being", "but", "by", "can", "could", "did",
    "do", "does", "done", "for", "from", "had", "has", "have", "he", "her", "hers", "herself", "him",
    "himself", "his", "i", "if", "in", "into", "is", "it", "its", "itself", "may", "me", "might", "mine",
    "my", "myself", "of", "on", "or", "our", "ours", "ourselves", "shall", "she", "should", "so", "than",
    "that", "the", "their", "theirs", "them", "themselves", "then", "there", "these", "they", "this", "those",
    "to", "too", "us", "very", "was", "we", "were", "what", "when", "where", "which", "who", "whom", "why",
    "will", "with", "would", "you", "your", "yours", "yourself", "yourselves",
]
FACET_STOPWORDS_ZH = [
    "的", "了", "和", "是", "在", "我", "也", "一个", "一些", "一样", "一直", "一下", "一种", "一般", "不是", "不会", "不能", "不用", "不过",
    "他们", "她们", "它们", "你们", "我们", "你", "你的", "你们的", "他", "他的", "他们的", "她", "她的", "她们的", "它", "它的", "我的",
    "我们的", "自己", "以及", "因为", "所以", "如果", "但是", "并且", "而且", "或者", "然后", "还有", "已经", "还是", "可以", "可能", "没有",
    "就是", "其实", "比较", "非常", "特别", "这样", "那样", "这个", "那个", "这些", "那些", "这里", "那里", "什么", "的话", "时候",
]
FACET_STOPWORDS = FACET_STOPWORDS_EN + FACET_STOPWORDS_ZH

# --- fixed values: corpus stop words -----------------------------------------
THEME_STOPWORDS_EN = [
    "the", "and", "for", "with", "from", "into", "that", "this", "have", "has", "had", "been", "were", "was",
    "will", "would", "should", "could", "there", "their", "about", "after", "before", "because", "while",
    "where", "when", "what", "which", "then", "than", "them", "they", "your", "ours", "ourselves", "myself",
    "herself", "himself", "itself", "user", "users", "agent", "assistant", "self", "team", "project", "task",
    "system", "memory", "workflow", "workflows", "group", "thing", "things", "item", "items", "info",
    "information", "data", "using", "used", "use", "like", "just", "more", "less", "very", "also", "over",
    "under", "through", "across", "within", "without", "each", "every",
]
THEME_STOPWORDS_ZH = [
    "的", "了", "和", "是", "在", "与", "及", "一个", "这个", "那个", "需要", "可以", "进行", "通过", "我们", "他们", "自己", "用户", "团队",
    "项目", "系统", "记忆", "工作流", "一些", "这种", "这个人", "这个团队", "事情", "内容", "信息", "数据", "以及", "然后", "这里",
]
THEME_DENYLIST = THEME_STOPWORDS_EN + THEME_STOPWORDS_ZH + ["end"]
ENTITY_DENYLIST = THEME_STOPWORDS_EN + THEME_STOPWORDS_ZH + ["platform"]
PROJECT_TAG_DENYLIST = [
    "work", "plan", "task", "tasks", "project", "projects", "memory", "workflow", "agent", "user",
]

# --- fixed values: dictionaries for substring hits ---------------------------
# Deployment-specific product names are not listed; pass them as extra terms.
TOOL_TERMS = [
    "react", "typescript", "javascript", "node", "go", "python", "docker", "kubernetes", "mysql", "redis",
    "neovim", "vscode", "github", "gitlab", "openai", "qwen", "claude", "terraform", "prometheus", "grafana",
    "feishu",
]
PLACE_TERMS = [
    "shanghai", "beijing", "singapore", "tokyo", "office", "home", "hangzhou",
]
TEAM_HINTS = [
    "backend", "frontend", "platform", "security", "sales", "product",
]

# --- fixed values: relation patterns (group 1 is the target) -----------------
RELATION_TARGET = f"([A-Z][a-z]+(?:{WS_RUN}[A-Z][a-z]+)?)"
RELATION_LEADS = (
    ("works_with", "works with"),
    ("collaborates_with", "collaborates with"),
    ("interacts_with", "with"),
)
RELATION_CONFIDENCE = 0.58
PROPER_NAME = f"[A-Z][a-z]+(?:{WS_RUN}[A-Z][a-z]+){{0,2}}"
TEAM_LABEL = f"([A-Za-z][A-Za-z-]+){WS_RUN}(team|group)"
ACKNOWLEDGEMENT = r"^(ok|done|noted|received|收到|好的|完成|明白了)$"
LOW_QUALITY_LENGTH = 24
LOW_QUALITY_REASON = "Very short or low-information memory"

# --- fixed values: corpus signal lexicons, in evidence order -----------------
SIGNAL_LEXICONS = {
    "preference": r"(prefer|prefers|like|likes|favorite|偏好|喜欢|更喜欢|倾向于)",
    "working_style": (
        r"(debug|refactor|review|document|structured|structure|automation|automate|iterate|迭代|自动化|"
        r"结构化|细节|详细|简洁|token|workflow|memory insight)"
    ),
    "goal": r"(goal|plan to|target|roadmap|objective|目标|计划|路线图|想要)",
    "constraint": r"(must|need to|should not|cannot|can't|avoid|禁止|不要|约束|限制|必须|不能|避免)",
    "decision": (
        r"(decide|decision|choose|selected|tradeoff|priority|prioritize|consider|决定|选择|取舍|优先级|权衡|考虑)"
    ),
    "routine": (
        r"(daily|weekly|every day|every morning|usually|routine|habit|每天|每周|经常|习惯|工作时间)"
    ),
}
HIGHLIGHT_SIGNALS = ("preference", "working_style", "goal", "constraint")
TENSION_SIGNALS = ("working_style", "preference", "constraint", "decision")
TENSION_TESTS = (
    (
        r"(concise|save token|节省|简洁)",
        r"(detail|详细|全面|完整)",
        "The corpus shows a tension between concise communication and preserving rich implementation detail.",
    ),
    (
        r"(automate|automation|自动化|脚本)",
        r"(manual|手动|人工)",
        "The user values automation but still keeps manual control in sensitive workflows.",
    ),
    (
        r"(fast|speed|效率|迅速)",
        r"(stable|quality|严格|严谨|正确)",
        "The corpus balances speed and efficiency against reliability and correctness concerns.",
    ),
)

# --- fixed values: report texts ----------------------------------------------
COVERAGE_GAP_TESTS = (
    ("people", 3, "People and collaborator mentions are sparse; relationship coverage may still be incomplete."),
    ("projects", 3, "Project-level labels are still thin; clearer project naming would improve grouping quality."),
    ("tools", 3, "Tool and environment references are limited; operational context may be underrepresented."),
    ("routines", 2, "Routines and temporal habits are under-specified, so behavioral patterns may be incomplete."),
    (
        "decisions",
        2,
        "Decision rationale is lightly captured; more explicit tradeoff memories would deepen future persona analysis.",
    ),
)
RECOMMEND_DUPLICATES = (
    "Collapse repeated memories into stronger canonical entries and clean up duplicate drift regularly."
)
RECOMMEND_LOW_QUALITY = (
    "Rewrite or filter low-information memories so future analysis has denser evidence to work with."
)
RECOMMEND_RELATIONS = (
    "Capture more explicit collaborator, stakeholder, and project interactions to strengthen relationship signals."
)
RECOMMEND_TENSIONS = (
    "Track important tradeoffs explicitly so future persona summaries can separate stable preferences from "
    "situational compromises."
)
RECOMMEND_HEALTHY = (
    "The corpus is already fairly healthy; focus next on richer relationship and decision-rationale capture."
)
PERSONA_STYLE = (
    "The user tends to capture working norms, tool choices, and preferred execution patterns rather than isolated facts."
)
PERSONA_GOALS = (
    "The memories also expose explicit goals and tradeoff decisions, which makes the persona more operational than "
    "purely descriptive."
)
PERSONA_ROUTINES = (
    "Stable routines and recurring timing references suggest habits that are strong enough to influence future memory "
    "insight features."
)
PERSONA_EMPTY = (
    "The corpus contains repeated operational memories, but the current evidence is still too sparse to form a sharper "
    "persona summary."
)
DUPLICATE_REASON = "Duplicate content matched the canonical memory in this cluster."
TRUNCATION_MARK = "\n\n[...content truncated...]\n\n"

# --- fixed values: category order and fallback tests -------------------------
CATEGORY_PRIORITY = [
    "policy", "privacy_safety", "incident_risk", "status_metric", "system_config", "environment_runtime",
    "artifact", "command_tool", "deployment", "debugging", "coding", "automation", "communication",
    "collaboration", "plan", "decision", "project", "learning", "task", "activity", "schedule",
    "relationship", "profile", "identity", "preference", "emotion", "health_wellbeing", "life_log",
    "experience",
]
LEGACY_CATEGORIES = [
    "identity", "emotion", "preference", "experience", "activity",
]
DEFAULT_CATEGORIES = [
    "task", "activity", "project", "experience",
]
UNMATCHED_CONFIDENCE = 0.35
# (pattern on the space-joined facet tokens, preferred categories in order)
FALLBACK_TESTS = (
    (r"(feel|feeling|happy|sad|angry|anxious|upset|焦虑|开心|难过|生气|烦躁)", ("emotion",)),
    (r"(burnout|burned out|tired|sleep|rest|recover|累|疲惫|休息|恢复)", ("health_wellbeing", "emotion")),
    (r"(喜欢|偏好|prefer|favorite|like|dislike|style|format|language)", ("preference",)),
    (r"(规则|策略|必须|禁止|不要|rule|policy|must|should|do not|never|only if)", ("policy", "privacy_safety")),
    (
        r"(隐私|内部使用|团队可见|权限|privacy|internal-only|visibility|permission|safety)",
        ("privacy_safety", "policy"),
    ),
    (r"(计划|下一步|待做|roadmap|next step|todo|upcoming|plan)", ("plan",)),
    (r"(决定|选择|取舍|decision|tradeoff|option|choose)", ("decision", "plan")),
    (r"(今天|明天|weekly|daily|deadline|schedule|cron|每周|截止)", ("schedule", "plan")),
    (r"(发送|回复|消息|通知|message|reply|notify|preview)", ("communication", "collaboration")),
    (r"(协作|评审|交接|reviewer|handoff|group chat|同步团队)", ("collaboration", "communication")),
    (r"(我是|name is|姓名|角色|职业|timezone|utc\+8|working hours|北京时间)", ("profile", "identity")),
    (r"(主人|负责人|团队|群|员工|owner|maintainer|manager|team|group|employee)", ("relationship", "profile")),
    (r"(学习|阅读|研究|调研|文档|learn|study|read|research|docs)", ("learning",)),
    (
        r"(调试|修复|报错|错误|排查|故障|root cause|bug|issue|error|fix|debug|investigate|triage)",
        ("debugging", "coding"),
    ),
    (r"(部署|发布|上线|回滚|deploy|release|launch|rollback)", ("deployment",)),
    (r"(自动化|定时|备份|心跳|导入|导出|backup|heartbeat|sync|index|import|export)", ("automation",)),
    (r"(代码|开发|函数|接口|schema|typescript|sql|prisma|patch|api|worker|code)", ("coding", "task")),
    (r"(配置|参数|环境变量|密钥|dsn|allowlist|setting|config|env|secrets)", ("system_config", "artifact")),
    (
        r"(\.openclaw|\.clawhub|workspace-state|runtime|session|ec2|ssh|workspace|local state)",
        ("environment_runtime", "artifact"),
    ),
    (r"(python3|node|pnpm|mysql|git|command|cli|script runner)", ("command_tool", "artifact")),
    (
        r"(文件|路径|仓库|分支|提交|脚本|repo|branch|commit|file|path|\.json|\.sql|\.toml|skill\.md)",
        ("artifact",),
    ),
    (r"(状态|结果|计数|快照|版本|流量|chart|pv|uv|count|status|result|snapshot|version)", ("status_metric",)),
    (r"(事故|风险|告警|异常|incident|risk|alert|outage|degraded)", ("incident_risk", "status_metric")),
    (r"(生活|旅行|餐厅|跑步|做饭|雍和宫|daily life|travel|restaurant|running|cooking)", ("life_log", "experience")),
    (r"(经历过|参加了|去过|第一次|tried|attended|went to|first time)", ("experience", "life_log")),
)
HIGH_VALUE_REGEX_CATEGORIES = [
    "policy", "plan", "debugging", "automation", "system_config", "environment_runtime", "artifact",
    "status_metric",
]

# --- fixed values: period dimensions -----------------------------------------
DIMENSIONS = [
    "long_term_goal", "focus_area", "emotion", "preference_signal", "growth_signal",
]

# --- fixed values: status machines and report states -------------------------
JOB_TRANSITIONS = {
    "CREATED": ("UPLOADING", "CANCELLED", "EXPIRED"),
    "UPLOADING": ("PROCESSING", "PARTIAL", "CANCELLED", "FAILED", "EXPIRED"),
    "PROCESSING": ("PARTIAL", "COMPLETED", "PARTIAL_FAILED", "FAILED", "CANCELLED", "EXPIRED"),
    "PARTIAL": ("PROCESSING", "COMPLETED", "PARTIAL_FAILED", "FAILED", "CANCELLED", "EXPIRED"),
    "COMPLETED": (),
    "PARTIAL_FAILED": ("PROCESSING", "FAILED", "CANCELLED", "EXPIRED"),
    "FAILED": (),
    "CANCELLED": (),
    "EXPIRED": (),
}
BATCH_TRANSITIONS = {
    "EXPECTED": ("UPLOADED", "FAILED"),
    "UPLOADED": ("QUEUED", "FAILED"),
    "QUEUED": ("RUNNING", "RETRYING", "FAILED", "DLQ"),
    "RUNNING": ("SUCCEEDED", "FAILED", "RETRYING", "DLQ"),
    "SUCCEEDED": (),
    "FAILED": ("RETRYING", "DLQ"),
    "RETRYING": ("RUNNING", "FAILED", "DLQ"),
    "DLQ": (),
}
ACTIVE_JOB_STATUSES = ("UPLOADING", "PROCESSING", "PARTIAL")
RUNNING_REPORT_STATUSES = ("QUEUED", "PREPARING", "ANALYZING", "SYNTHESIZING")
TERMINAL_REPORT_STATUSES = ("COMPLETED", "FAILED")
RENDER_STATUSES = ("queued", "running", "fail", "success")
REPORT_STAGES = (
    "queued",
    "fetch_source",
    "period_summary",
    "aggregation",
    "save_result",
    "complete",
    "failed",
)
EXPIRED_CODE = "MEMORY_ANALYSIS_REPORT_EXPIRED"
EXPIRED_REASON = "Previous memory analysis report expired before completion."

# --- fixed values: limits ----------------------------------------------------
CHUNK_SIZE = 180
CONTENT_CAP = 12000
CONTENT_BUDGET = 60000
MAX_BATCH_MEMORIES = 100
MAX_BATCH_BYTES = 524288
MAX_REPORT_MEMORIES = 20000
MAX_RANGE_DAYS = 14
DEFAULT_POLICY = {
    "plan_code": "default",
    "rpm_limit": 120,
    "daily_limit": 10000,
    "burst_limit": 30,
    "max_active_jobs": 5,
    "max_batches_per_job": 500,
    "enabled": True,
}
