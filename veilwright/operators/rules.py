"""Rule packs: what each detector looks for, in the pattern dialects of Spark and of DuckDB.

Patterns, cue words, labels and placeholders are fixed values: results depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Entity types in their order, with the text that replaces them.
PLACEHOLDERS = {
    "PERSON_NAME": "[姓名]",
    "ORG_NAME": "[机构]",
    "ADDRESS": "[地址]",
    "PHONE_NUMBER": "[手机号]",
    "EMAIL": "[邮箱]",
    "CN_ID_NUMBER": "[身份证号]",
    "BANK_CARD_NUMBER": "[银行卡号]",
    "FINANCIAL_AMOUNT": "[财务金额]",
    "SALARY_AMOUNT": "[薪酬金额]",
    "BUSINESS_METRIC": "[业务指标]",
    "PROJECT_CODE": "[项目代号]",
    "CONTRACT_ID": "[合同编号]",
    "CUSTOMER_NAME": "[客户名称]",
}
ENTITY_ORDER = {name: i for i, name in enumerate(PLACEHOLDERS)}
RULES_DETECTOR = "deterministic_rules_v1"
TERMS_DETECTOR = "policy_exact_terms_v1"

#: Cue words.
PUBLIC_CUES = ("公开", "官网", "宣传", "公共邮箱", "客服电话", "售后服务")
NOT_A_CARD = ("不是银行卡",)
INVALID_CUES = ("校验位无效", "不是银行卡", "版本构建号", "测试字符串")
SALARY_CUES = ("工资", "薪酬", "奖金", "税前")
QUOTE_CUES = ("底价", "最低报价", "内部报价")
FINANCE_CUES = ("内部预算", "预算草案", "未公开预算", "成本", "收入")
PERCENT_CUES = ("未公开", "毛利率", "利润率", "内部")
ADDRESS_CUES = ("省", "市", "区", "县", "街", "路", "大道", "巷", "号", "栋", "室")
CUSTOMER_CUES = ("重点客户", "客户名单", "客户名称", "客户：", "客户:")
AMOUNT_LABELS = (("SALARY_AMOUNT", SALARY_CUES), ("BUSINESS_METRIC", QUOTE_CUES), ("FINANCIAL_AMOUNT", FINANCE_CUES))

#: White space for RE2, whose own class is ASCII.
_S2 = r"[\s\x{3000}]"


@dataclass(frozen=True)
class Rule:
    """left, value and right of a pattern in both dialects; every match holds one of needs and something like probe."""

    entity: str
    code: str
    value: str
    left: str = ""
    right: str = ""
    value_sql: str | None = None
    left_sql: str | None = None
    right_sql: str | None = None
    needs: tuple[str, ...] = ()
    flags: str = ""
    probe: str | None = None

    def java(self) -> tuple[str, str, str]:
        wrap = lambda p: f"(?{self.flags}:{p})" if self.flags and p else p
        return wrap(self.value), wrap(self.left), wrap(self.right)

    def re2(self) -> tuple[str, str, str]:
        flags = "i" if "i" in self.flags else ""
        wrap = lambda p: f"(?{flags}:{p})" if flags and p else p
        pick = lambda own, other: other if own is None else own
        return wrap(pick(self.value_sql, self.value)), wrap(pick(self.left_sql, self.left)), wrap(pick(self.right_sql, self.right))


#: Eleven digits, perhaps with one sign between them.
_DIGITS = r"(?U:(?:\d[ \t\r\n-]?){10}\d)"
_NAME = r"[\p{IsHan}A-Za-z][\p{IsHan}A-Za-z0-9_.-]{2,40}"
_NAME_SQL = r"[\p{Han}A-Za-z][\p{Han}A-Za-z0-9_.-]{2,40}"
_AMOUNT = r"人民币\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?元"

#: The product's rules. Guards consume their sign, so of two values one sign apart the second is missed.
CORE = {
    "email": Rule("EMAIL", "EMAIL_FORMAT", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"(?:\A|[^A-Za-z0-9_.+-])", r"(?:\z|[^A-Za-z0-9_.-])", flags="iu", needs=("@",)),
    "cn_mobile": Rule("PHONE_NUMBER", "CN_MOBILE_FORMAT", r"1[3-9](?:[ \t\r\n-]?\d){9}", r"(?:\A|\D)", r"(?:\z|\D)", flags="U", probe=_DIGITS),
    "cn_id": Rule("CN_ID_NUMBER", "CN_ID_CHECKSUM", r"(?:\d[ \t\r\n-]?){17}[\dXx]", r"(?:\A|\D)", r"(?:\z|[^\dXx])", flags="U", probe=_DIGITS),
    "bank_card": Rule("BANK_CARD_NUMBER", "BANK_CARD_LUHN", r"(?:\d[ \t\r\n-]?){11,18}\d", r"(?:\A|\D)", r"(?:\z|\D)", flags="U", probe=_DIGITS),
    "amount": Rule("", "CONTEXTUAL_AMOUNT", _AMOUNT, flags="U", needs=("人民币",)),
    "percent": Rule("BUSINESS_METRIC", "CONTEXTUAL_PERCENTAGE", r"\d+(?:\.\d+)?%", flags="U", needs=("%",)),
    "address": Rule("ADDRESS", "ADDRESS_FIELD_CONTEXT", r"[^，。,；;\n]{6,60}", r"(?:办公)?地址\s*[:：]\s*", flags="U", needs=("地址",), left_sql=rf"(?:办公)?地址{_S2}*[:：]{_S2}*"),
    "project_field": Rule("PROJECT_CODE", "PROJECT_CODE_CONTEXT", _NAME, r"(?:保密)?项目(?:代号|代码| code)\s*[:：]\s*", flags="iuU", needs=("项目",), value_sql=_NAME_SQL, left_sql=rf"(?:保密)?项目(?:代号|代码| code){_S2}*[:：]{_S2}*"),
    "project_inline": Rule("PROJECT_CODE", "PROJECT_CODE_CONTEXT", r"[\p{IsHan}A-Za-z]{1,12}-\d{4}-[A-Za-z0-9]{1,12}", r"项目", r"(?:由|，|。|\s)", flags="U", needs=("项目",), value_sql=r"[\p{Han}A-Za-z]{1,12}-\d{4}-[A-Za-z0-9]{1,12}", right_sql=rf"(?:由|，|。|{_S2})"),
    "contract": Rule("CONTRACT_ID", "CONTRACT_ID_CONTEXT", r"[A-Za-z][A-Za-z0-9_.-]{5,50}", r"(?:合同|协议)(?:编号|号)\s*[:：]?\s*", flags="iuU", needs=("合同", "协议"), left_sql=rf"(?:合同|协议)(?:编号|号){_S2}*[:：]?{_S2}*"),
}

_HAN = r"\x{4e00}-\x{9fff}"
_FIELD = rf"[{_HAN}A-Za-z][{_HAN}A-Za-z0-9_.-]{{2,40}}"
#: The evaluation's rules, which look around instead of consuming.
BASELINE = {
    "email": Rule("EMAIL", "EMAIL", r"(?<![\w.+-])[\w.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![\w.-])", flags="U", needs=("@",)),
    "cn_mobile": Rule("PHONE_NUMBER", "PHONE_NUMBER", r"(?<!\d)1[3-9]\d{9}(?!\d)", flags="U", probe=_DIGITS),
    "cn_id": Rule("CN_ID_NUMBER", "CN_ID_NUMBER", r"(?<!\d)\d{17}[\dXx](?![\dXx])", flags="U", probe=_DIGITS),
    "bank_card": Rule("BANK_CARD_NUMBER", "BANK_CARD_NUMBER", r"(?<!\d)(?:\d[ -]?){11,18}\d(?!\d)", flags="U", probe=_DIGITS),
}
CONTEXT = {
    "amount": Rule("", "CONTEXT", _AMOUNT, flags="U", needs=("人民币",)),
    "percent": Rule("BUSINESS_METRIC", "CONTEXT", r"(?<![\d.])\d+(?:\.\d+)?%(?![\d.])", flags="U", needs=("%",)),
    "address": Rule("ADDRESS", "CONTEXT", r"[^，。,；;\n]{6,60}", r"(?:办公)?地址\s*[:：]\s*", flags="U", needs=("地址",)),
    "project_field": Rule("PROJECT_CODE", "CONTEXT", _FIELD, r"(?:保密)?项目(?:代号|代码)\s*[:：]\s*", flags="iuU", needs=("项目",)),
    "project_inline": Rule("PROJECT_CODE", "CONTEXT", rf"[{_HAN}A-Za-z]{{1,12}}-\d{{4}}-[A-Za-z0-9]{{1,12}}(?=由|，|。|\s)", r"项目", flags="U", needs=("项目",)),
    "project_english": Rule("PROJECT_CODE", "CONTEXT", _FIELD, r"Project\s+code\s*[:：]\s*", flags="iuU", probe=r"(?iuU:Project\s+code)"),
    "contract": Rule("CONTRACT_ID", "CONTEXT", r"[A-Za-z][A-Za-z0-9_.-]{5,50}", r"(?:合同|协议)(?:编号|号)\s*[:：]?\s*", flags="iuU", needs=("合同", "协议")),
}
