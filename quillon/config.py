"""Defaults of the engine.  All of them are parameters somewhere; data that isn't Chinese brings its own.

Fixed values: the constants below are part of the results' definition (keyword lists, prefixes, limits, weights).
"""

from __future__ import annotations

# money
TOLERANCE = "0.01"
UP_PREFIXES = ["HSYCCG", "SJWLCG", "BOTC", "CG"]
DOWN_PREFIXES = ["HSYCXS", "SJWLXS", "SOTC", "XS"]

# Directions, roles, and the cells of the matrix that are checked
UP, DOWN, UNKNOWN = "up", "down", "unknown"
ROLES = ["contract", "settlement", "invoice", "cargo_right", "payment_receipt"]
CHECKED_CELLS = [("up", "settlement"), ("up", "invoice"), ("up", "payment_receipt"), ("down", "settlement"), ("down", "invoice")]
EXPLICIT_ROLES = {
    "contract": "contract", "settlement": "settlement", "invoice": "invoice", "cargo_right": "cargo_right",
    "payment_receipt": "payment_receipt", "contract_up": "contract", "contract_down": "contract",
}
ROLE_KEYWORDS = [
    ("payment_receipt", ["回单", "水单", "付款凭证", "收款凭证", "银行", "payment", "receipt"]),
    ("cargo_right", ["出库", "货权", "提单", "放货", "入库", "cargo", "waybill"]),
    ("invoice", ["发票", "invoice"]),
    ("settlement", ["结算", "对账", "磅单", "结算单", "settlement"]),
    ("contract", ["合同", "协议", "contract", "agreement"]),
]
TYPE_ROLES = {
    "销售合同": "contract", "采购合同": "contract", "合同": "contract", "结算单": "settlement", "发票": "invoice",
    "货权转移单": "cargo_right", "货权": "cargo_right", "货权凭证": "cargo_right", "货权转移凭证": "cargo_right",
}
FIELD_ALIASES = {
    "contract_no": ["contract_no", "合同编号", "合同号"],
    "amount": ["amount", "金额", "合同金额", "发票金额", "价税合计"],
    "date": ["date", "日期", "合同日期", "签订日期", "开票日期"],
    "invoice_no": ["invoice_no", "发票号", "发票号码"],
    "company": ["company", "购买方", "购买方名称", "买方", "采购商", "付款人", "户名"],
    "seller": ["seller", "销售方", "销售方名称", "销方", "卖方", "供应商"],
    "summary": ["summary", "摘要", "款项性质", "用途", "附言", "交易描述"],
}
DEPOSIT_WORDS = ["保证金", "押金", "定金", "订金", "履约金"]
REFUND_WORDS = ["退款", "退回", "退还", "返还", "退货款"]
NAME_NOISE = ["股份有限公司", "有限责任公司", "有限公司", "国际贸易", "贸易", "钢铁"]
OWN_ENTITIES = ["云创", "陕建"]

# Severities, statuses, resolutions
SEVERITY = {"INFO": 0, "WARNING": 1, "CRITICAL": 2}
STATUS_ORDER = {"error": 0, "warning": 1, "ok": 2, "no_data": 3}
CLOSING = ["ignore", "false_positive"]
RESOLUTIONS = ["ignore", "false_positive", "supplement", "adjust", "pending", "reopen"]

# confidence
WEIGHTS = {"rule": 0.40, "field": 0.20, "keyword": 0.15, "ai": 0.25}
AUTO, REVIEW = 0.85, 0.60
HIGH_PRIORITY = 50
AI_USABLE, AI_OVERRIDE, OTHER_TYPE = 0.5, 0.7, "其他"

# Samples, fingerprints, clusters
SAMPLE_THRESHOLD, SAMPLE_WEIGHTS = 0.68, (0.35, 0.35, 0.30)
STOP_CHARS = "的了是在和有就都而及与或一个也不"
LABEL_WORDS = [
    "合同号", "合同编号", "编号", "船名", "船舶", "日期", "数量", "单价",
    "金额", "总金额", "税率", "税额", "发票号码", "发票号", "开票日期",
    "供应商", "采购方", "采购合同", "销售合同", "需方", "供方", "买方", "卖方",
    "货物名称", "规格", "产地", "交货", "结算单", "结算", "货权", "验收",
    "质量", "付款", "收款", "开户行", "账号", "大写", "小写", "货物",
    "订单", "报价", "发货", "到货", "湿吨", "吨位", "备注", "签约地",
    "违约责任", "货物明细", "化学成分", "含量",
]
STRUCTURE_WORDS = [
    "合同", "协议", "结算", "发票", "拉运", "对账", "明细",
    "船名", "航次", "提单号", "合同号", "金额", "单价", "数量",
    "买方", "卖方", "供方", "需方", "装货港", "卸货港", "税额",
    "合计", "开票日期", "扣水", "扣杂", "净重", "毛重",
]
SIMHASH_LIMIT, DHASH_LIMIT = 5, 1
EXPECTED_ROLES = ["contract", "settlement", "invoice", "cargo_right"]
BUSINESS_PREFIXES = ["SJWLXS", "SJWLCG", "HSYCXS", "HSYCCG"]
FUZZY_LEAST, FUZZY_GAP, FIELD_LEAST = 0.75, 0.08, 0.6

# Dashboard alerts
SURGE_LEAST, SURGE_TIMES = 5, 3
FAIL_TODAY, FAIL_WEEK, FAIL_WEEK_TOTAL, FAIL_WEEK_FAILED = 0.30, 0.20, 5, 3

# search
AMOUNT_FIELDS = ["amount", "total_amount", "tax_amount", "price"]
DATE_FIELDS = ["date", "invoice_date", "ship_date", "bill_date"]

# Letters that a scan mistakes for digits, and lengths of invoice numbers
DIGIT_LIKE = {
    "O": "0", "o": "0", "I": "1", "l": "1", "i": "1", "S": "5", "s": "5", "B": "8", "b": "8", "G": "6", "g": "6", "Z": "2", "z": "2", "T": "7", "t": "7",
}
INVOICE_LENGTHS = [8, 10, 12, 20]

# Ledger columns and their headers, in order of preference
COLUMN_ALIASES = {
    "contract_no": ["销售合同编号oa", "销售合同编号", "采购合同编号oa", "采购合同编号", "合同编号", "合同号", "销售合同号", "采购合同号"],
    "vessel": ["船名", "船号"],
    "material": ["物料名称", "物料", "品名", "商品名称"],
    "quantity": ["数量", "结算数量", "销售量", "采购量", "已收货转量", "采购结算数量", "销售结算数"],
    "unit_price": ["单价", "采购单价", "销售单价"],
    "amount": ["金额", "采购合同金额", "销售合同金额", "采购结算金额", "销售结算金额", "合同金额", "结算金额", "回款金额", "支付金额", "销售金额"],
    "company": ["供应商", "供货方", "卖方"],
    "seller": ["采购商名称", "销售客户", "采购商", "客户名称"],
    "date": ["日期", "采购合同签订日期", "销售合同签订日期", "开票日期", "签约日期"],
    "order_no": ["2.0编号", "订单号", "外部编号"],
    "invoice_no": ["发票号", "发票号码", "发票代码"],
}

# Names that a file-name template may use for a field
TEMPLATE_NAMES = {
    "日期": ["date", "日期"],
    "类型": ["document_type", "type", "类型"],
    "公司": ["company", "公司"],
    "编号": ["contract_no", "order_no", "invoice_no", "no", "编号"],
    "no": ["contract_no", "order_no", "invoice_no", "no", "编号"],
    "合同编号": ["contract_no", "合同编号"],
    "合同号": ["contract_no", "合同编号", "合同号"],
    "发票号码": ["invoice_no", "发票号码"],
    "订单编号": ["order_no", "订单编号"],
    "金额": ["amount", "金额"],
    "付款方": ["payer", "付款方"],
    "收款方": ["payee", "收款方"],
    "船名": ["vessel", "船名"],
    "物料": ["material", "物料名称", "物料", "品名"],
    "品种": ["material", "品种", "物料"],
    "数量": ["quantity", "数量"],
    "合同尾号": ["contract_suffix", "合同尾号"],
    "销售方": ["seller", "company", "销售方", "公司"],
    "购买方": ["buyer", "company", "购买方", "公司"],
}
DEFAULT_TEMPLATE = "{日期}_{类型}_{公司}_{编号}"
FIELD_ORDER = ["company", "seller", "date", "contract_no", "contract_suffix", "order_no", "invoice_no", "amount", "summary", "vessel", "material", "quantity"]
#: Fixed values (FLT-17): a name that holds one of these is no company.
NOT_COMPANIES = [
    "盖章", "电子章", "签字", "签名", "日期", "金额", "数量", "单价", "合计", "备注", "编号", "合同号",
    "船名", "物料", "品种", "规格", "交货", "结算", "发票", "税号", "地址", "电话", "传真", "开户",
    "账号", "邮编", "单位", "部门", "经办人", "审核", "批准", "同意", "确认", "收到", "交付", "验收",
]
