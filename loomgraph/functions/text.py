"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: words that say nothing, for keywords of questions.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall",
    "should", "may", "might", "can", "could", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "into", "through", "and",
    "or", "but", "not", "this", "that", "it", "its", "my", "your", "how", "what", "when", "where", "why", "which", "who", "whom",
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "个", "上", "也", "很", "到", "说", "要", "去", "你", "会",
    "着", "没有", "看", "好", "自己", "这", "他", "她", "它", "们", "时", "时候", "如何", "怎么", "怎样", "什么", "哪个", "哪些", "为什么", "吗", "呢", "吧", "啊", "啦",
)
#: Fixed: what separates tokens of a question.
TOKEN_GAP = r"""[\s,，。！？!?'"、/\\()（）\[\]【】{}]+"""
#: Fixed: words that topics of questions leave out, tested before punctuation is taken off.
TOPIC_STOP_WORDS = ("the", "and", "how", "what", "when", "where", "why", "this", "that")


def keywords(query: Column) -> Column:
    """Tokens split at camel humps and underscores, in lower case, two characters at least, without stop words,
    each once in order of appearance. Runs of Chinese stay whole."""
    spaced = F.regexp_replace(F.regexp_replace(query, "(?U)" + TOKEN_GAP, " "), "([a-z])(?=[A-Z])", "$1 ")
    parts = F.transform(F.split(spaced, "[ _]"), lambda x: F.lower(x))
    return F.array_distinct(F.filter(parts, lambda x: (F.length(x) >= 2) & ~x.isin(*STOP_WORDS)))


def topics(text: Column) -> Column:
    """Words of a question in lower case, three characters at least once `.,!?;:` are off; repeats stay."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: ~w.isin(*TOPIC_STOP_WORDS))
    return F.filter(F.transform(words, lambda w: F.btrim(w, F.lit(".,!?;:"))), lambda w: F.length(w) >= 3)


def node_score(label: Column, file: Column, words: Column, in_scope: Column | None = None) -> Column:
    """2 for each keyword in the name, 1 for each in the path; half outside the scope."""
    name, path = F.lower(label), F.lower(file)
    score = F.aggregate(words, F.lit(0.0), lambda s, w: s + F.when(name.contains(w), 2.0).otherwise(0.0) + F.when(path.contains(w), 1.0).otherwise(0.0))
    return score if in_scope is None else F.when(in_scope, score).otherwise(score * 0.5)


def cjk_fragments(query: Column) -> Column:
    """Runs of two Chinese characters or more, then the pairs within longer ones; each once."""
    runs = F.regexp_extract_all(query, F.lit("[一-鿿]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) > 2), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(runs, pairs))


def module_score(query: Column, name: Column, body: Column, title: Column) -> Column:
    """Relevance of a module to a question: 3 or 1 for each keyword in its name or text, 4 or 2 for each Chinese
    fragment, and a half where the question, or a word of it, stands in the text."""
    text = F.concat_ws(" ", name, body, title)
    low, low_name = F.lower(text), F.lower(name)
    by_word = F.aggregate(keywords(query), F.lit(0.0), lambda s, w: s + F.when(low_name.contains(w), 3.0).when(low.contains(w), 1.0).otherwise(0.0))
    by_run = F.aggregate(cjk_fragments(query), F.lit(0.0), lambda s, w: s + F.when(name.contains(w), 4.0).when(text.contains(w), 2.0).otherwise(0.0))
    clean = F.lower(F.trim(query))
    loose = (F.length(clean) >= 2) & (low.contains(clean) | F.exists(F.split(clean, r"\s+"), lambda w: (F.length(w) >= 2) & low.contains(w)))
    return by_word + by_run + F.when(loose, 0.5).otherwise(0.0)


def repo_key(url: Column) -> Column:
    return F.left(F.sha2(url, 256), F.lit(16))


def content_hash(content: Column) -> Column:
    return F.coalesce(F.sha2(content, 256), F.lit(""))


def line_count(content: Column) -> Column:
    """Lines, an unterminated last one included."""
    feeds = F.length(content) - F.length(F.translate(content, "\n", ""))
    return (feeds + F.when((F.length(content) > 0) & ~content.endswith("\n"), 1).otherwise(0)).cast("long")


def numbered(content: Column, first: int = 1) -> Column:
    """Each line with its number, four wide."""
    return F.array_join(F.transform(F.split(content, "\n"), lambda x, i: F.concat(F.lpad((i + first).cast("string"), 4, " "), F.lit(" | "), x)), "\n")


def json_from_text(text: Column) -> Column:
    """The text itself, what a fence encloses, or the outermost braces: the first that is JSON, as a string; else null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    bare = [F.btrim(x, F.lit(" \t\r\n")) for x in (text, fenced, braces)]
    tried = [F.when(F.try_parse_json(x).isNotNull() & x.startswith("{"), x) for x in bare]
    return F.coalesce(*tried)


def project_name(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(url, r"\.git/*$", ""), r"([^/]+)/*$", 1), F.lit("")), F.lit("未知项目"))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^a-z0-9一-鿿]+", "-"), F.lit("-"))


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Known names in braces are replaced, others stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template
