"""Fixed values of the user profile: lexicons, labels and texts.

Names of a deployment's own products are not part of the lists; ``product_terms`` adds them where they count.
"""

from __future__ import annotations

ATTRIBUTE_LABELS = {
    "long_term_interest": "长期兴趣",
    "professional_skill": "专业技能",
    "current_project": "当前项目",
    "long_term_goal": "长期目标",
    "work_habit": "工作习惯",
    "communication_style": "沟通风格",
}
ATTRIBUTE_LEXICONS = {
    "long_term_interest": r"(长期兴趣|兴趣|关注领域|关注方向|持续关注|interest|interested|focus area)",
    "professional_skill": r"(专业技能|技能|能力|擅长|经验|技术栈|法务|律师|资格证|skill|expertise|capability|proficiency)",
    "current_project": r"(当前项目|正在做|项目|产品|repo|应用|project|working on|current work)",
    "long_term_goal": r"(长期目标|目标|愿景|长期规划|成长方向|goal|long-term|long term|aspiration)",
    "work_habit": r"(工作习惯|做事风格|工作风格|习惯|流程|节奏|结构化推进|推进方式|habit|workflow|work style|routine)",
    "communication_style": r"(沟通风格|沟通|表达|回复|直接|具体|少说教|语气|communication|tone|direct|specific)",
}
ITEM_LABELS = {
    "current_priority": "当前优先处理事项",
    "companion_style": "喜欢的陪伴方式",
    "robot_constraint": "对机器人的约束",
}
PRIORITY = (
    r"(优先|当前|现在|近期|明年|待办|处理|计划|规划|目标|任务|备考|考试|健康|工作|岗位|职业|方向|能力|资格证|法务|律师|"
    r"priority|prioritize|task|plan|goal|todo|focus|career|role|skill)"
)
ROBOT_TARGET = r"(机器人|助手|agent|AI|模型|系统|你|bot|assistant)"
ROBOT_BEHAVIOR = (
    r"(回复|回应|回答|建议|提醒|解释|输出|格式|称呼|语气|引用|召回|记住|忽略|自动|respond|reply|answer|suggest|remind|"
    r"format|tone|memory|recall)"
)
CONSTRAINT = (
    r"(约束|限制|边界|不要|不能|避免|禁止|不得|只从|必须基于|只能|不允许|constraint|avoid|should not|never|only|must use)"
)
COMPANION_TARGET = (
    r"(陪伴|回应|回复|回答|建议|提醒|沟通|语气|表达|说教|鼓励|assistant|companion|respond|reply|answer|suggest|"
    r"communication|tone)"
)
PERSONA = r"(是什么样的人|用户是|性格|特质|特点|画像|trait)"
PREFERENCE = r"(偏好|喜欢|倾向|重视|看重|prefer|preference|likes|values)"
PREFERENCE_WIDE = r"prefer|preference|likes?|喜欢|偏好|希望|更希望"
DISLIKE = r"(不喜欢|讨厌|反感|避免|不希望|dislike|hates|avoid)"
WORK_STYLE = r"(做事风格|工作风格|决策|习惯|执行方式|推进方式|结构化推进|style|habit|decision|structured)"
TEMPORAL_PLAN = (
    r"(当前|现在|近期|明年|优先事项|优先处理|待办|备考|考试|换.*岗位|资格证|需要补上|priority|todo|exam)"
)
EPHEMERAL = (
    r"(今天|昨天|明天|刚才|本次|这次|当前对话|随口|临时|一次性|暂时|已失效|过期|today|yesterday|tomorrow|temporary|"
    r"one-off|expired)"
)
STABLE = (
    r"(长期|经常|常用|持续|稳定|习惯|偏好|不喜欢|讨厌|兴趣|领域|技能|目标|学习方向|消费|决策|沟通|思维|工具|工作内容|"
    r"家庭角色|创业|AI使用|性格|特质|做事风格|long[- ]term|often|usually|habit|preference|skill|goal|trait)"
)
PRODUCT_OR_DOC = (
    r"\b(PRD|RFC|module|modules|covers|including|backend|server|endpoint|API|CRUD|Letta|MemGPT|referenced|concept|"
    r"concepts|partitioning|archival|recall|comparison|inspiration|foundation|foundations)\b|"
    r"模块|接口|后端|服务端|返回字段|实现|支持|缺少|不支持|参考|概念|分区|竞品|对比|启发|资料"
)
ABOUT_USER = (
    r"(用户|你|user)\s*(经常|常用|长期|偏好|不喜欢|喜欢|习惯|擅长|从事|使用|uses?|prefers?|likes?|dislikes?|often|usually)"
)
FACT_ONLY = r"\b(?:\d+(?:\.\d+)?\s*(?:cm|kg)|height|weighs?|weight)\b|身高|体重"
FILE_OR_DEMO = (
    r"\b(?:created|create|containing|folder|directory|path|README|requirements\.txt|\.env|script|demo|SDK|Cloud SDK|"
    r"seed_[\w-]+\.py|[\w-]+-demo)\b|/Users/|文件夹|目录|路径|脚本|创建|包含"
)
SUMMARY_PREFIX = r"^(profile_summary|persona_summary|summary|用户画像总结|画像总结)\s*[:：]"
SUMMARY_TOKENS = ("profile_summary", "persona_summary", "画像总结")

# persona signals: (group, label, pattern, second pattern or none)
FRONTEND = r"(前端|React|TypeScript|工程实践|开发工程师|frontend|front-end)"
AI_CONTEXT = r"AI|Agent|Memory|用户画像|长期记忆"
PRODUCT_ROLE = r"(产品|PRD|用户研究|用户画像|治理系统|可视化方案)"
AI_PRODUCT = r"AI|Memory|Agent|长期记忆"
ID_AI_FRONTEND = "AI 产品与前端工程实践者"
ID_FRONTEND = "前端工程实践者"
ID_AI_PRODUCT = "AI 产品实践者"
ID_DEFAULT = "目标驱动的长期成长型用户"
TEXT_SIGNALS = (
    ("domain", "AI、用户画像、Memory、Agent", r"(AI|Agent|Memory|长期记忆|用户画像)"),
    ("domain", "数据库", r"(数据库|database)"),
    ("trait", "目标驱动", r"(目标驱动|目标导向|成长驱动力|执行力|持续推进|长期目标)"),
    ("trait", "擅长系统化思考", r"(系统化|结构化|拆解|可落地|工程化|模板|自动化|复用)"),
    ("style", "习惯将复杂问题拆解为可落地方案", r"(系统化|结构化|拆解|可落地|工程化|模板|自动化|复用)"),
    ("style", "重视效率与可执行建议", r"(效率|直接给结论|简洁高效|少说教|可执行)"),
)
PLAN_SIGNALS = (
    ("英语学习", r"(英语|KET|CET|六级|单词|备考)", None),
    ("健康管理", r"(健康|减脂|饮食|步数|运动|睡眠)", None),
    ("家庭教育", r"(家庭教育|孩子|女儿|亲子)", None),
    ("AI Agent 与 Memory 学习", r"(AI Agent|Agent|Memory|长期记忆)", r"(学习|深入|关注|推进|研究)"),
    ("项目开发", r"(项目开发|开发)", r"(推进|持续|长期|工作)"),
)
STYLE_SIGNAL = (
    "偏好结构化、直接且可执行的协作方式",
    r"(直接|结论|结构化|可执行|完整|模板|风险|优化|跟进|规划|决策)",
)
STYLE_ACTION = r"拆解|落地"
STYLE_ACTION_TEXT = "擅长系统化拆解并落地方案"

# items made from pooled texts
PLAN_CONTENT = (
    r"(目标|计划|拆解|任务|进展|提醒|复盘|跟进|调整|KET|英语|健康|减脂|长期|goal|plan|progress|follow|review)"
)
COMPANION_TITLE = "目标导向陪伴"
COMPANION_PARTS = (
    (
        r"(目标|计划|进展|跟进|复盘|提醒|调整|长期|goal|plan|progress|follow|review)",
        "用户偏好目标导向、主动跟进型陪伴，而非单纯情绪安慰型",
    ),
    (
        r"(制定计划|拆解|任务|步骤|清单|模板|可执行|具体|plan|step|task|actionable)",
        "希望通过制定计划、拆解任务、记录进展、定期提醒和复盘获得持续支持",
    ),
    (
        r"(直接|结论|简洁|高效|结构化|数据|反馈|少说教|direct|concise|structured|data)",
        "交流风格简洁直接，重视结构化输出、可执行建议和数据反馈",
    ),
    (
        r"(记住|长期目标|历史|上下文|动态|调整|进度|memory|context|adjust)",
        "期待 AI 记住目标并根据进度动态调整计划",
    ),
)
CONSTRAINT_ITEMS = (
    (
        "避免空泛冗长",
        r"(空泛|说教|重复背景|绕太多|冗长|直接|结论|结构化|可执行|vague|verbose|direct|structured)",
        "回答要直接、结构化、具体可执行，避免空泛建议、重复背景和说教式表达。",
    ),
    (
        "基于证据回答",
        r"(facts|insights|证据|基于|不要编造|无依据|确认|纠错|evidence|grounded)",
        "重要判断需基于已有 facts、insights 或明确证据，不要无依据推断。",
    ),
    (
        "结合长期背景",
        r"(React|TypeScript|PRD|AI Agent|Agent|Memory|长期记忆|英文 PRD)",
        "回答需结合用户在 AI、Memory、Agent、前端工程和相关产品设计中的长期背景。",
    ),
    (
        "衔接长期目标",
        r"(英语|KET|CET|六级|健康|减脂|饮食|家庭教育|长期目标|持续推进)",
        "涉及学习、健康、家庭教育等主题时，应衔接长期目标并避免只按单次问题处理。",
    ),
)
FACETS = (
    ("整体画像", PERSONA, None),
    ("偏好", PREFERENCE, DISLIKE),
    ("不喜欢", DISLIKE, None),
    ("做事风格", WORK_STYLE, None),
)
GENERIC_FACET = "长期特征"
DESCRIPTION_LEADS = (
    ("long_term_goal", "长期目标是"),
    ("professional_skill", "专业能力涉及"),
    ("long_term_interest", "兴趣上关注"),
    ("work_habit", "做事偏"),
    ("communication_style", "沟通偏"),
)
MESSAGE_NONE = "当前没有可用于生成用户画像总结的记忆。"
MESSAGE_WEAK = "当前记忆中稳定画像信号较少，已根据现有信息生成初步总结，但画像可能不稳定。"
MESSAGE_FEW = "当前可用记忆信息较少，已根据现有记忆生成初步总结，但画像可能不稳定。"
