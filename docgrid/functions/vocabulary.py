"""Word lists, numerals, patterns and thresholds that results depend on.

Patterns read digits and white space of any script; Java's take ``UNICODE`` in front for that, Python's do so anyway.
"""

UNICODE = "(?U)"

# Digits and units of Chinese numerals.
CN_DIGITS = {
    "零": 0, "〇": 0, "壹": 1, "一": 1, "贰": 2, "二": 2, "貳": 2, "叁": 3, "三": 3, "參": 3, "肆": 4, "四": 4,
    "伍": 5, "五": 5, "陆": 6, "六": 6, "陸": 6, "柒": 7, "七": 7, "捌": 8, "八": 8, "玖": 9, "九": 9,
}
CN_UNITS = {
    "拾": 10, "十": 10, "佰": 100, "百": 100, "仟": 1000, "千": 1000, "万": 10_000, "萬": 10_000,
    "亿": 100_000_000, "億": 100_000_000,
}

# Cells that stand for no number; units; the number itself.
NO_NUMBER = ("—", "-", "–", "N/A", "n/a", "无", "/", ".")
UNIT = r"(万亿元|万元|亿元|万|亿|元|％|%)"
NUMBER = r"[−\-]?\s*[\d,]+(?:\.\d+)?"
PLAIN_AMOUNT = r"^[−\-]?[\d,.\s]*(万亿元|万元|亿元|万|亿|元)?\s*[％%]?$"
LABEL_PREFIX = ("项目", "科目", "指标")
GROWTH_WORDS = ("同比", "环比", "增长")

# Words that tell kinds of financial tables, in order of priority.
TABLE_WORDS = {
    "balance_sheet": (
        "资产总计", "负债合计", "所有者权益", "股东权益", "资产负债表", "流动资产", "非流动资产", "流动负债", "非流动负债", "货币资金",
        "应收账款", "存货", "固定资产", "无形资产", "短期借款", "应付账款", "实收资本", "资本公积", "盈余公积", "未分配利润",
    ),
    "income_statement": (
        "营业收入", "营业成本", "利润总额", "净利润", "利润表", "营业利润", "营业收入合计", "所得税", "毛利润", "营业外收入",
        "营业外支出", "管理费用", "销售费用", "财务费用", "基本每股收益", "稀释每股收益",
    ),
    "cash_flow": (
        "经营活动", "投资活动", "筹资活动", "现金流量表", "现金及现金等价物", "经营活动产生的现金流量", "投资活动产生的现金流量",
        "筹资活动产生的现金流量", "支付给职工", "收回投资", "取得投资收益",
    ),
    "equity_change": ("所有者权益变动表", "会计政策变更", "前期差错更正"),
}
FINANCE_WORDS = ("万元", "元", "%", "同比", "环比", "收入", "利润", "资产", "负债")

# Words of header rows; numeric cells of a fragment; what ends, closes and continues a sentence.
HEADER_WORDS = (
    "项目", "类别", "名称", "合计", "小计", "序号", "编号", "类型", "内容", "备注", "说明", "单位", "日期", "金额", "数量", "比率",
    "年度", "本期", "上期",
)
NUMERIC_CELL = r"^[+-]?[\d.]+[%％]?$|^[\d.]+[万亿]?(?:元|万元|亿元|美元|港币)?$"
SENTENCE_END = "。！？；：…\n.!?;:"
SENTENCE_CLOSE = "）)】》」』\"'"
CONTINUES = "而并且或以及此外同时另"
HEADING = r"^[#\d]+[.、]"

# Entities by category, in order.
ENTITIES = (
    ("company", r"([一-鿿]+(?:有限公司|股份|集团|公司|企业|事务所|研究院|研究所|中心|基金))"),
    ("money", r"([\d,，.]+\s*(?:万元|亿元|元|万|亿|人民币|美元|港币|欧元|日元|英镑))"),
    ("percentage", r"([\d.]+%|百分之[\d.]+)"),
    ("date", r"(\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日|\d{4}\s*年\s*\d{1,2}\s*月|\d{4}\s*[-/]\s*\d{1,2}\s*[-/]\s*\d{1,2})"),
    ("project", r"((?:[一-鿿]+)?(?:项目|工程|计划|方案|课题)[一-鿿]*)"),
    ("person", r"((?:Mr|Mrs|Ms|Dr|Prof)\.?\s+[A-Z][a-z]+|[一-鿿]{2,4}(?:先生|女士|教授|博士|总|经理|主任))"),
)

# Expressions that refer to something said before, in order of precedence.
REFERENCES = (
    r"该(?:公司|企业|单位|机构|组织|集团)",
    r"本(?:公司|企业|单位|机构|组织|集团|项目|期|年|月|季度|报告)",
    r"其(?:他|他)?(?:他|她|它)?(?:公司|企业|方)?",
    r"上述(?:金额|数额|数字|数据|金额|款项|费用|成本|收入|利润)",
    r"前述(?:金额|数额|数字|数据|款项|费用|成本|收入|利润)",
    r"该(?:金额|数额|数字|数据|款项|费用|成本|收入|利润|比例|比率)",
    r"以上(?:金额|数额|数字|数据|款项)",
    r"该(?:项目|合同|协议|工程|产品|方案|计划)",
    r"上述(?:项目|合同|协议|工程|产品|方案|计划)",
    r"\b其\b",
    r"\b该\b",
    r"\b此\b",
    r"上述",
    r"前述",
    r"以下",
    r"如下",
    r"同(?:期|年|月|日)",
    r"上(?:年|期|季度|月)",
    r"报告(?:期|年度|期内)",
)

# What refers to which category, and how sure that is.
REFERENCE_RULES = (
    ("company", 0.7, ("该公司", "本公司", "该企业", "本企业")),
    ("money", 0.65, ("上述金额", "前述金额", "该金额", "上述数额", "该数额", "以上金额")),
    ("project", 0.7, ("该项目", "本项目", "该工程", "该计划")),
    ("date", 0.6, ("同期", "上年", "上期", "报告期", "报告年度")),
)
GENERIC_REFERENCE = 0.4

# Words of requests.
ASSESS_WORDS = {
    "table": ("表格", "报表", "财务", "金融", "资产负债", "利润表", "table", "financial", "report", "balance sheet"),
    "chart": ("图表", "柱状图", "折线图", "饼图", "散点", "chart", "graph", "bar", "line chart", "pie"),
    "poor": ("模糊", "拍照", "手写", "扫描", "复印件", "blurry", "handwritten", "scan", "low quality"),
    "export": ("结构化", "导出", "json", "csv", "excel", "structured", "export", "spreadsheet"),
}
PLANNER_WORDS = {
    "table": ("表格", "报表", "财务", "table", "financial"),
    "chart": ("图表", "图表分析", "解析图表", "chart", "graph"),
    "poor": ("模糊", "拍照", "手写", "blurry", "handwritten"),
    "thorough": ("详细", "全面", "所有", "complete", "comprehensive", "all"),
}
VERIFY_WORDS = {
    "tables": ("表格", "报表", "财务", "table", "financial", "资产负债", "利润"),
    "charts": ("图表", "chart", "可视化", "图示"),
    "merge": ("跨页", "合并", "merge", "连续"),
}
REPAIRS = ("denoise", "enhance", "deskew")
INJECTION = (
    "ignore", "disregard", "forget", "system:", "new instruction:", "you are now", "override", "previous instructions were", "act as",
)

# Limits.
QUALITY_THRESHOLD, MAX_RETRIES, MAX_REPLANS, MAX_ERRORS = 0.7, 3, 2, 10
IMAGE_LIMITS = {
    "blur_variance_min": 100.0, "noise_std_max": 30.0, "contrast_min": 0.2, "skew_max_deg": 0.5, "dpi_min": 200.0,
    "stamp_area_ratio_min": 0.002,
}
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tiff", "tif", "webp")
SUPPORTED_SUFFIXES = {"pdf": ("pdf",), "image": IMAGE_SUFFIXES, "office": ("docx", "pptx"), "html": ("html", "htm")}
