"""Readers' roles: what they are called, what a model is told about them, and a project's domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed: roles and the view that each maps to; unknown ones read as pm.
ROLES = {"ceo": "pm", "pm": "pm", "investor": "pm", "qa": "dev", "dev": "dev", "domain_expert": "domain_expert"}
VIEWS = ("dev", "pm", "domain_expert")
BADGES = {"dev": "开发者视角：关注代码逻辑、性能瓶颈、边界条件", "pm": "PM 视角：关注功能完整性、变更影响、风险识别", "domain_expert": "行业专家视角：关注业务规则验证、合规检查、风险识别"}
# Fixed: what status codes mean to readers who aren't developers.
HTTP_CODES = {"200": "成功", "201": "创建成功", "204": "操作成功，无返回内容", "400": "请求有误", "401": "未登录", "403": "没有权限", "404": "找不到", "409": "数据冲突", "422": "数据格式不对", "500": "系统内部错误"}
# Fixed: terms that texts for such readers avoid, and what they say instead.
BANNED_TERMS = {
    "幂等 / idempotent": "描述重复操作的具体后果", "slug": "URL 中的文章标识", "冷启动 / cold start": "描述具体缺失场景（如「新用户首页为空」）", "连接池 / connection pool": "同时处理请求的上限", "openapi / swagger": "API 调试页面", "env_file / .env": "配置文件",
    "middleware / 中间件": "请求处理的中间环节", "布尔值 / boolean": "是/否", "回调 / callback": "完成后自动触发的操作", "异步 / async": "不阻塞其他操作地执行", "序列化 / serialize": "把数据转换成可传输的格式", "AST / 抽象语法树": "代码的结构化表示", "NetworkX": "图论库", "Tree-sitter": "代码解析库",
}
# Fixed: words of a README and names of dependencies that tell a project's domain.
DOMAINS = {
    "fintech": (("金融", "支付", "交易", "钱包", "银行", "转账"), ("stripe", "braintree", "square", "wise", "alipay", "paypal")),
    "healthcare": (("医疗", "诊断", "患者", "处方", "病历"), ("fhir", "hl7", "dicom", "hl7apy")),
    "ecommerce": (("电商", "购物车", "订单", "物流", "商品"), ("shopify", "woocommerce", "bigcommerce", "prestashop")),
    "saas": (("软件即服务", "租户", "订阅", "多租户"), ("stripe-billing", "recurly", "chargebee")),
}
#: What a model is told for each view, and for experts of a domain on top of theirs.
GUIDANCE = {
    "dev": "读者是开发者。请直接引用代码：给出文件与行号、函数签名、参数与返回类型、异常与边界条件，指出性能瓶颈和循环依赖。技术术语不受限制，源代码优先于说明文字。",
    "pm": "读者是产品经理，不读代码。请用业务语言说明功能是否完整、改动影响哪些用户与业务流程、依赖什么、风险和工作量如何。不要使用技术术语，模块概览优先于源代码。",
    "domain_expert": "读者是行业专家。请把代码逻辑翻译成行业的业务规则，说明规则在哪里、是否合规、缺少哪些审计记录和风险控制，以便逐条核对。",
}
DOMAIN_GUIDANCE = {
    "fintech": "项目属于金融领域：请以 KYC、AML、资金结算、交易限额、重复支付的后果、PCI DSS 与审计日志为准绳，逐项说明身份核验、金额校验、加密存储和异常交易检测。",
    "healthcare": "项目属于医疗领域：请以患者隐私、PHI 的加密与访问日志、诊断与处方的审批、FHIR 与 HL7 的数据交换为准绳，逐项说明是否满足隐私法规。",
    "ecommerce": "项目属于电商领域：请以订单一致性、支付与退款的完整流程、库存扣减的时机、物流状态和风险控制为准绳，逐项说明超卖、重复扣款与漏检的可能。",
    "saas": "项目属于多租户软件服务：请以租户之间的数据隔离、订阅与计费周期、权限边界为准绳，逐项说明越权与误计费的可能。",
}


def role_of(name: str) -> str:
    return ROLES.get(name, "pm")


def role_column(name: Column) -> Column:
    """The same for a column of names."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), name), F.lit("pm"))


def guidance(role: str, domain: str | None = None) -> str:
    """What a model is told about its reader; of an expert's domain only where it is known."""
    view = role_of(role)
    more = DOMAIN_GUIDANCE.get(domain or "", "") if view == "domain_expert" else ""
    return GUIDANCE[view] + more


def http_annotations(codes: dict[str, str] = HTTP_CODES) -> str:
    return "\n".join(f"- {code}（{meaning}）" for code, meaning in codes.items()) or "（未配置状态码注释表）"


def banned_terms(role: str, glossary_text: str | None = None, terms: dict[str, str] = BANNED_TERMS) -> str:
    """Words to avoid and what to say instead: a repository's glossary, else the table; none for developers."""
    if role_of(role) == "dev":
        return ""
    return glossary_text or "\n".join(f"- 「{a}」→ {b}" for a, b in terms.items()) or "（未配置禁用术语表）"


def infer_domain(files: DataFrame, imports: DataFrame) -> DataFrame:
    """One row: domain (null where nothing tells one), of a README's words and of what is imported: most hits, of equal
    ones the first in order of DOMAINS. files: path, content; imports: module. Sums over both tables, nothing else."""
    readme = files.filter(F.lower("path").rlike(r"(^|/)readme(\.[a-z]+)?$"))
    module = F.lower("module")
    words = readme.agg(*[F.coalesce(F.sum(sum((F.coalesce(F.col("content"), F.lit("")).contains(w).cast("int") for w in table[0]), F.lit(0))), F.lit(0)).alias(k) for k, table in DOMAINS.items()])
    marks = imports.agg(*[F.coalesce(F.sum(sum((module.contains(w).cast("int") for w in table[1]), F.lit(0))), F.lit(0)).alias(f"{k}_m") for k, table in DOMAINS.items()])
    hits = [F.col(k) + F.col(f"{k}_m") for k in DOMAINS]
    best = F.greatest(*hits)
    out = F.lit(None).cast("string")
    for k, h in reversed(list(zip(DOMAINS, hits, strict=True))):
        out = F.when(h == best, k).otherwise(out)
    return words.crossJoin(marks).select(F.when(best > 0, out).alias("domain"))  # two tables of one row
