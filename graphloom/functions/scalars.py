"""Expressions on note text, names, scores and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical page types and the spellings that mean them.
PAGE_TYPES = {
    "entity": "entity entities 实体 人物 组织 person org organization product tool 产品 工具 项目 project",
    "concept": "concept concepts 概念 术语 term topic 主题 theory 理论",
    "source": "source sources 资料 来源 reference paper 论文 文献 book 书籍 article 文章 video 视频 clip 剪藏",
    "synthesis": "synthesis 综述 综合 summary 总结 汇总 digest 摘要",
    "query": "query queries 查询 research 研究 检索",
    "comparison": "comparison compare 比较 对比 contrast 对照",
    "finding": "finding findings 发现 结论 result 结果 insight 洞察",
    "thesis": "thesis 论点 主张 claim 观点 hypothesis 假设",
    "methodology": "methodology method 方法论 方法 process 流程 步骤",
    "overview": "overview 概述 index 索引 moc 目录 导航 hub",
}
# Names of pages that are scaffolding, and prefixes of such names.
STRUCTURAL_NAMES = ["index", "overview", "log", "purpose", "schema", "home", "readme", "moc", "inbox", "索引", "概述", "目录", "首页", "概览", "日志"]
STRUCTURAL_PREFIXES = ["index", "overview", "log", "purpose", "schema", "moc"]
# File extensions that a source's key leaves out.
SOURCE_EXTENSIONS = ["md", "pdf", "doc", "docx", "txt", "htm", "html", "epub", "mobi", "ppt", "pptx", "xls", "xlsx"]

DAY_MS = 86_400_000


def trim(c: Column) -> Column:
    """Without Unicode blanks at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normal_path(path: Column) -> Column:
    """Slashes one way, single, none in front."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/"), "^/", "")


def strip_code(text: Column) -> Column:
    """Without fenced blocks and inline code."""
    text = F.regexp_replace(text, r"(?ms)^(`{3,}|~{3,})[^\n]*\n.*?^\1[^\n]*$", "")
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", ""), r"`[^`\n]*`", "")


def link_target(inner: Column) -> Column:
    """What a link's inside points to: before | and #."""
    return F.trim(F.substring_index(F.substring_index(inner, "|", 1), "#", 1))


def wikilinks(text: Column) -> Column:
    """Targets of the [[links]] in a text without code, in order, with repeats."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]]+)\]\]"), 1), link_target), lambda t: t != "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def without_md(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)\.md$", "")


def related_key(entry: Column) -> Column:
    """The page that an entry of a related list names."""
    return trim(without_md(basename(F.translate(link_target(F.regexp_replace(trim(entry), r"^\[\[|\]\]$", "")), "\\", "/"))))


def source_key(raw: Column) -> Column:
    """What spellings of one source have in common: its file name without extension, in lower case."""
    c = F.substring_index(F.substring_index(F.regexp_replace(trim(raw), r"^\[\[|\]\]$", ""), "|", 1), "#", 1)
    c = F.regexp_replace(basename(F.translate(c, "\\", "/")), rf"(?i)\.({'|'.join(SOURCE_EXTENSIONS)})$", "")
    return F.lower(trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def page_type(raw: Column) -> Column:
    """The canonical type of a declared one; other where it is unknown."""
    names = F.create_map(*[F.lit(x) for kind, spelt in PAGE_TYPES.items() for s in spelt.split() for x in (s, kind)])
    return F.coalesce(F.try_element_at(names, F.lower(trim(raw))), F.lit("other"))


def type_label(raw: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(trim(raw), F.lit("")), fallback)


def type_key(raw: Column, fallback: Column) -> Column:
    return F.lower(type_label(raw, fallback))


def structural_name(name: Column) -> Column:
    """Whether a page of this name is scaffolding."""
    slug = F.regexp_replace(F.lower(trim(name)), r"\.md$", "")
    return slug.isin(STRUCTURAL_NAMES) | slug.rlike(rf"^({'|'.join(STRUCTURAL_PREFIXES)})(?![0-9A-Za-z_])")


def title(declared: Column, body: Column, path: Column) -> Column:
    """The declared title, else the first heading of level one or two, else the file's name."""
    heading = F.nullif(trim(F.regexp_extract(body, r"(?m)^#{1,2}[ \t]+(.+?)[ \t]*#*[ \t]*$", 1)), F.lit(""))
    return F.coalesce(F.nullif(trim(declared), F.lit("")), heading, F.regexp_replace(without_md(basename(path)), "[-_]+", " "))


def clean_tags(tags: Column) -> Column:
    return F.transform(tags, lambda t: trim(F.regexp_replace(t, "^#", "")))


def hyphened(key: Column) -> Column:
    return F.regexp_replace(F.lower(trim(key)), r"(?U)\s+", "-")


def spaced(key: Column) -> Column:
    return F.translate(F.lower(trim(key)), "-", " ")


def saturate(x: Column) -> Column:
    return F.when(x > 0, x / (x + 1)).otherwise(0.0)


def half_saturate(x: Column, half: float) -> Column:
    return F.when(x > 0, x / (x + half)).otherwise(0.0)


def share_of(score: Column, most: Column) -> Column:
    """score over most, within 0 and 1; what isn't a number is 0."""
    x = score / most
    return F.when(F.isnan(x) | x.isNull() | (x <= 0) | (x == float("inf")), 0.0).otherwise(F.least(x, F.lit(1.0)))


def name_tokens(name: Column) -> Column:
    """Distinct lower-cased Latin words and single Han characters."""
    low = F.lower(name)
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(r"([0-9a-zÀ-ɏ]+)"), 1), F.regexp_extract_all(low, F.lit(r"(\p{IsHan})"), 1)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def strip_emphasis(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\*\*|__|`", ""), r"(?U)[*_](?=\w)", "")


def wikilink(base: Column, label: Column) -> Column:
    return F.when(F.lower(base) == F.lower(label), F.concat(F.lit("[["), base, F.lit("]]"))).otherwise(F.concat(F.lit("[["), base, F.lit("|"), label, F.lit("]]")))


def days_between(then_ms: Column, now_ms: int) -> Column:
    return F.floor((F.lit(now_ms) - then_ms) / DAY_MS)


def millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp, whatever the session's time zone."""
    return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def deviance(count: Column, rate: Column) -> Column:
    """Twice the Poisson log-likelihood ratio of a count against a rate."""
    return F.when(count > 0, 2 * (rate - count + count * F.ln(count / rate))).otherwise(2 * rate)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(":::", F.least(a, b), F.greatest(a, b))


def finding_key(shape: str, kind: Column, anchor: Column) -> Column:
    """shape: node, pair or group."""
    return F.concat_ws(":", F.lit(shape), kind, anchor)


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def describe(**signals: Column) -> Column:
    """Signals that aren't zero, as a line."""
    return F.concat_ws(" · ", *[F.when(c != 0, F.format_string(f"{k} %.2f", c)) for k, c in signals.items()])


def bare_id(path: Column) -> Column:
    return F.lower(without_md(F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")))


def density(edges: int, nodes: int) -> float:
    return edges / (nodes * (nodes - 1) / 2) if nodes > 1 else 0.0


def resolution(value: object) -> float:
    """A usable resolution: 1 for what isn't a number, else within 0.5 and 3."""
    if isinstance(value, bool) or not isinstance(value, int | float) or value != value:
        return 1.0
    return min(3.0, max(0.5, float(value)))
