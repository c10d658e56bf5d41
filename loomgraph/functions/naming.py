"""Business names for code names. The tables are parameters: a caller may pass its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled

#: Up to so many segments of paths their names are sent to all tasks; more are joined by shuffles.
BROADCAST_SEGMENTS = 100_000

# Fixed: names of path segments, in the order in which partial matches are tried.
SEGMENTS = {
    "auth": "认证系统", "authentication": "认证系统", "authorization": "授权系统", "oauth": "OAuth 认证", "sso": "单点登录", "rbac": "权限管理", "permissions": "权限管理", "acl": "访问控制",
    "api": "API 接口", "rest": "REST 接口", "graphql": "GraphQL 接口", "grpc": "gRPC 接口", "gateway": "网关", "proxy": "代理服务", "websocket": "WebSocket 服务", "ws": "WebSocket 服务", "http": "HTTP 服务", "rpc": "远程调用",
    "db": "数据库", "database": "数据库", "models": "数据模型", "schema": "数据结构", "schemas": "数据结构", "migration": "数据迁移", "migrations": "数据迁移", "orm": "对象关系映射", "sql": "SQL 查询", "redis": "Redis 缓存", "cache": "缓存系统", "caching": "缓存系统", "storage": "存储服务", "store": "数据存储",
    "cli": "命令行工具", "cmd": "命令行工具", "commands": "命令集", "terminal": "终端工具", "shell": "Shell 工具", "repl": "交互式终端",
    "core": "核心模块", "kernel": "内核", "runtime": "运行时引擎", "engine": "引擎", "executor": "执行器", "scheduler": "调度器", "worker": "工作进程", "queue": "消息队列", "mq": "消息队列", "broker": "消息代理",
    "plugins": "插件系统", "plugin": "插件系统", "extensions": "扩展模块", "addons": "附加组件", "modules": "功能模块", "config": "配置管理", "configuration": "配置管理", "settings": "设置", "env": "环境配置",
    "logging": "日志系统", "logger": "日志系统", "logs": "日志", "monitor": "监控系统", "monitoring": "监控系统", "metrics": "指标采集", "telemetry": "遥测系统", "tracing": "链路追踪",
    "tests": "测试套件", "test": "测试", "fixtures": "测试固件", "mocks": "模拟数据", "ui": "用户界面", "views": "视图层", "templates": "模板", "components": "组件库", "pages": "页面", "layouts": "布局", "styles": "样式", "assets": "静态资源", "static": "静态文件", "public": "公共资源",
    "services": "业务服务", "service": "业务服务", "handlers": "处理器", "controllers": "控制器", "routes": "路由", "router": "路由器", "middleware": "中间件", "interceptors": "拦截器",
    "utils": "工具集", "utilities": "工具集", "helpers": "辅助函数", "common": "公共模块", "shared": "共享模块", "lib": "基础库", "libs": "基础库", "pkg": "软件包", "packages": "软件包", "vendor": "第三方依赖", "internal": "内部模块",
    "deploy": "部署", "deployment": "部署系统", "ci": "持续集成", "cd": "持续交付", "docker": "容器化", "k8s": "Kubernetes 编排", "kubernetes": "Kubernetes 编排", "infra": "基础设施", "terraform": "基础设施即代码", "docs": "文档", "documentation": "项目文档",
    "security": "安全模块", "crypto": "加密模块", "encryption": "加密服务", "notifications": "通知系统", "email": "邮件服务", "sms": "短信服务", "push": "推送服务", "media": "媒体处理", "upload": "文件上传", "downloads": "文件下载", "images": "图像处理",
    "search": "搜索引擎", "analytics": "数据分析", "reports": "报表系统", "i18n": "国际化", "l10n": "本地化", "locales": "语言包", "events": "事件系统", "signals": "信号处理", "hooks": "钩子系统", "tasks": "任务调度", "jobs": "后台任务", "cron": "定时任务",
    "payment": "支付系统", "payments": "支付系统", "billing": "计费系统", "cart": "购物车", "orders": "订单系统", "inventory": "库存管理", "users": "用户管理", "user": "用户模块", "profile": "用户资料", "admin": "管理后台", "dashboard": "仪表盘", "chat": "聊天系统", "messaging": "消息系统",
}
# Fixed: what functions do, by the first word of their names.
VERBS = {
    "get": "获取", "set": "设置", "create": "创建", "make": "生成", "build": "构建", "delete": "删除", "remove": "移除", "update": "更新", "modify": "修改", "patch": "局部更新", "save": "保存", "load": "加载", "read": "读取", "write": "写入",
    "send": "发送", "receive": "接收", "fetch": "拉取", "pull": "拉取", "push": "推送", "parse": "解析", "format": "格式化", "convert": "转换", "transform": "变换", "validate": "验证", "verify": "验证", "check": "检查", "test": "测试", "assert": "断言",
    "init": "初始化", "initialize": "初始化", "setup": "设置", "configure": "配置", "start": "启动", "stop": "停止", "run": "运行", "execute": "执行", "process": "处理", "handle": "处理", "dispatch": "分发", "emit": "触发", "trigger": "触发", "listen": "监听", "subscribe": "订阅", "publish": "发布", "register": "注册", "unregister": "注销",
    "login": "登录", "logout": "登出", "authenticate": "认证", "authorize": "授权", "encrypt": "加密", "decrypt": "解密", "hash": "哈希计算", "sign": "签名", "log": "记录", "print": "打印", "render": "渲染", "display": "显示", "show": "展示", "hide": "隐藏",
    "open": "打开", "close": "关闭", "connect": "连接", "disconnect": "断开连接", "bind": "绑定", "unbind": "解绑", "attach": "附加", "detach": "分离", "add": "添加", "insert": "插入", "append": "追加", "merge": "合并", "split": "拆分", "sort": "排序", "filter": "过滤", "search": "搜索", "find": "查找", "query": "查询", "list": "列出", "count": "计数",
    "aggregate": "聚合", "calculate": "计算", "compute": "计算", "compare": "比较", "diff": "差异对比", "sync": "同步", "async": "异步处理", "cache": "缓存", "flush": "刷新", "clear": "清除", "reset": "重置", "retry": "重试", "recover": "恢复", "rollback": "回滚", "migrate": "迁移", "export": "导出", "import": "导入", "upload": "上传", "download": "下载",
    "notify": "通知", "alert": "告警", "schedule": "调度", "cancel": "取消", "approve": "审批", "reject": "拒绝", "submit": "提交", "confirm": "确认", "scan": "扫描", "detect": "检测", "monitor": "监控", "track": "跟踪", "resolve": "解析", "serialize": "序列化", "deserialize": "反序列化", "encode": "编码", "decode": "解码", "compile": "编译", "evaluate": "评估",
    "map": "映射", "reduce": "归约", "collect": "收集", "generate": "生成", "extract": "提取", "apply": "应用", "wrap": "包装", "unwrap": "解包", "mount": "挂载", "unmount": "卸载", "clone": "克隆", "copy": "复制", "move": "移动", "rename": "重命名", "drop": "丢弃", "truncate": "截断", "sanitize": "清理", "normalize": "规范化", "refresh": "刷新", "reload": "重新加载",
    "revert": "还原", "revoke": "撤销", "grant": "授权", "deny": "拒绝", "lock": "加锁", "unlock": "解锁", "enable": "启用", "disable": "禁用", "activate": "激活", "deactivate": "停用", "unsubscribe": "退订", "benchmark": "基准测试", "profile": "性能分析", "debug": "调试", "inspect": "检查", "audit": "审计", "archive": "归档", "restore": "恢复", "backup": "备份", "destroy": "销毁",
    "bootstrap": "引导启动", "shutdown": "关闭", "provision": "配置资源", "allocate": "分配", "deallocate": "释放", "acquire": "获取", "release": "释放", "await": "等待", "wait": "等待", "poll": "轮询", "ping": "探测", "probe": "探测", "warm": "预热", "cooldown": "冷却", "throttle": "限流", "limit": "限制", "batch": "批量处理", "stream": "流式处理", "pipe": "管道传输",
    "route": "路由", "forward": "转发", "redirect": "重定向", "proxy": "代理", "relay": "中继", "broadcast": "广播", "multicast": "组播", "enqueue": "入队", "dequeue": "出队", "peek": "查看队首", "pop": "弹出",
}
# Fixed: what calling a module means, in the order in which partial matches are tried.
CONNECTIONS = {
    "db": "读写数据", "database": "读写数据", "sql": "查询数据", "redis": "读写缓存", "cache": "读写缓存", "auth": "验证权限", "authentication": "验证权限", "authorization": "验证权限", "logging": "写入日志", "logger": "写入日志", "log": "写入日志",
    "config": "读取配置", "settings": "读取配置", "queue": "发送消息", "mq": "发送消息", "email": "发送邮件", "sms": "发送短信", "notification": "发送通知", "storage": "读写存储", "search": "检索数据", "api": "请求接口", "gateway": "网关转发", "monitor": "上报监控", "metrics": "上报指标",
}
# Fixed: names of flows by their entry, whole or by beginning.
FLOWS = {"main": "程序主流程", "app": "应用启动流程", "run": "运行流程", "start": "启动流程", "serve": "服务启动流程", "execute": "执行流程", "cli": "命令行执行流程", "bootstrap": "引导启动流程", "launch": "启动流程", "init": "初始化流程", "initialize": "初始化流程", "setup": "设置流程"}
FLOW_VERBS = {
    "handle": "处理", "process": "处理", "dispatch": "分发", "on_": "响应", "route": "路由", "create": "创建", "update": "更新", "delete": "删除", "get": "获取", "fetch": "拉取", "send": "发送", "check": "检查", "validate": "验证", "sync": "同步",
    "import": "导入", "export": "导出", "login": "登录", "logout": "登出", "register": "注册", "upload": "上传", "download": "下载", "search": "搜索", "build": "构建", "generate": "生成", "parse": "解析", "render": "渲染", "publish": "发布",
    "subscribe": "订阅", "notify": "通知", "migrate": "迁移", "deploy": "部署", "test": "测试", "scan": "扫描", "analyze": "分析", "schedule": "调度",
}
# Fixed: endings of labels that need no "module" after them.
LABEL_SUFFIXES = ("系统", "模块", "引擎", "工具", "服务", "接口", "组件", "平台")


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _either_way(key: Column, table: dict[str, str]) -> Column:
    """The first entry whose key holds the text or is held by it. An empty text fits the first entry."""
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in table.items()])
    return F.get(F.filter(entries, lambda e: key.contains(e.k) | e.k.contains(key)), F.lit(0)).v


def business_name(path: Column, table: dict[str, str] = SEGMENTS) -> Column:
    segment = F.lower(_last(path))
    by_token = F.get(F.filter(F.transform(F.split(segment, "_"), lambda t: F.element_at(_map(table), t)), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(F.element_at(_map(table), segment), _either_way(segment, table), by_token, segment)


def connection_verb(target: Column, table: dict[str, str] = CONNECTIONS) -> Column:
    low = F.lower(target)
    return F.coalesce(F.element_at(_map(table), low), _either_way(low, table), F.lit("调用"))


def _last(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def business_names(rows: DataFrame, path: str = "path") -> DataFrame:
    """rows with name and verb: business_name() of a column of paths and connection_verb() of their last segment. Each
    tries all entries of a table, so they are worked out once for each segment, of which there are few, not for each row."""
    placed = rows.withColumn("__segment", _last(F.col(path)))
    known = placed.select("__segment").distinct().select(F.col("__segment").alias("__known"), business_name(F.col("__segment")).alias("name"), connection_verb(F.col("__segment")).alias("verb"))
    known = settled(known, "names")
    known = F.broadcast(known) if known.count() <= BROADCAST_SEGMENTS else known
    return placed.join(known, F.col("__segment").eqNullSafe(F.col("__known")), "left").drop("__segment", "__known")


def function_explanation(name: Column, params: Column, return_type: Column, docstring: Column) -> Column:
    """The docstring, else what the name tells, with parameters and result."""
    words = F.split(name, "_")
    action = F.coalesce(F.element_at(_map(VERBS), F.lower(words[0])), F.lit("处理"))
    rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), "_")
    subject = F.when(F.size(words) < 2, "数据").otherwise(F.coalesce(F.element_at(_map(SEGMENTS), F.lower(rest)), rest))
    told = F.concat(action, F.lit(" "), subject, F.when(F.size(params) > 0, F.concat(F.lit("，参数为 "), F.array_join(params, ", "))).otherwise(""), F.when(F.length(return_type) > 0, F.concat(F.lit("，返回 "), return_type)).otherwise(""))
    return F.when(F.trim(docstring) != "", F.trim(docstring)).otherwise(told)


def module_description(name: Column, function_names: Column, n_classes: Column, n_files: Column, n_lines: Column) -> Column:
    label = F.coalesce(F.element_at(_map(SEGMENTS), F.lower(name)), name)
    actions = F.slice(F.array_distinct(F.filter(F.transform(F.slice(function_names, 1, 5), lambda f: F.element_at(_map(VERBS), F.lower(F.split(f, "_")[0]))), lambda x: x.isNotNull())), 1, 3)
    told = F.concat_ws(
        "，",
        F.when(F.size(actions) > 0, F.concat(F.lit("提供"), F.array_join(actions, "/"), F.lit("等功能"))),
        F.when(n_classes > 0, F.concat(F.lit("包含 "), n_classes, F.lit(" 个类"))),
        F.when((n_files > 0) & (n_lines > 0), F.concat(F.lit("共 "), n_files, F.lit(" 个文件、"), n_lines, F.lit(" 行代码"))),
    )
    named = F.when(F.array(*[label.endswith(s) for s in LABEL_SUFFIXES]).cast("string").contains("true"), label).otherwise(F.concat(label, F.lit("模块")))
    return F.when(told == "", F.concat(named, F.lit("（空模块，暂无实现）。"))).otherwise(F.concat(named, F.lit("，"), told, F.lit("。")))


def flow_name(label: Column) -> Column:
    low = F.lower(label)
    verbs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in FLOW_VERBS.items()])
    verb = F.get(F.filter(verbs, lambda e: low.startswith(e.k)), F.lit(0))
    rest = F.ltrim(F.substring(low, F.length(verb.k) + 1, F.length(low)), F.lit("_"))
    subject = F.coalesce(F.element_at(_map(SEGMENTS), rest), F.replace(rest, F.lit("_"), F.lit(" ")))
    return F.coalesce(F.element_at(_map(FLOWS), low), F.when(verb.isNotNull(), F.concat(F.when(rest != "", subject).otherwise(""), verb.v, F.lit("流程"))), F.concat(label, F.lit("流程")))


def plain_description(text: Column) -> Column:
    """Without parameters, results, file names and node ids; never empty."""
    for noise in (r"，参数为\s*[^，。]+", r"，返回\s*[^，。]+", r"\b[a-zA-Z_][a-zA-Z0-9_]*\.(py|js|ts|go|rs|java|swift|kt)\b", r"\b[a-zA-Z_][a-zA-Z0-9_]*::[a-zA-Z_][a-zA-Z0-9_]*\b"):
        text = F.regexp_replace(text, noise, "")
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("执行处理操作"))
