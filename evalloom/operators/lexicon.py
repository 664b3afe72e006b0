"""Word lists by language and domain, concept categories, and what a dataset's name tells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalloom.functions.text import HAN, trim_ws

# Words that make no term by themselves, for all, by domain and for Chinese.
STOPWORDS = {
    "standard": [
        "a", "an", "the", "in", "on", "at", "to", "for", "of", "with", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
        "will", "would", "should", "could", "may", "might", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they",
        "what", "which", "who", "when", "where", "why", "how", "and", "or", "but", "not", "as", "by", "from",
    ],
    "dataset": ["other", "background", "content", "domain", "question", "reasoning", "tag", "option", "letter", "organization"],
    "cs": ["system", "computer", "data", "information", "memory"],
    "medical": [
        "patient", "patients", "symptom", "symptoms", "disease", "condition", "conditions", "treatment", "treatments", "therapy", "therapies",
        "clinical", "history", "histories", "case", "cases", "exam", "examination", "figure",
    ],
    "math": ["number", "numbers", "figure"],
    "zh": ["其他", "其他的", "背景", "内容", "信息", "资料", "题目", "题干", "问题", "选项", "示例", "标签", "叙述", "描述", "说法", "以下", "下面", "关于", "有关", "错误", "正确", "陈述", "程序", "步骤", "情形", "情况"],
}
# Terms refused as such, for all, by domain and for Chinese.
DENIED = {
    "standard": [
        "other", "background", "content", "domain", "question", "reasoning", "tag", "option", "letter", "organization", "a", "an", "the", "in", "is", "of", "to",
        "structure and", "based on", "due to", "example", "invalid", "misc", "miscellaneous",
    ],
    "cs": ["system", "computer", "data", "information", "memory"],
    "medical": [
        "patient", "patients", "symptom", "symptoms", "disease", "condition", "conditions", "treatment", "treatments", "therapy", "therapies",
        "medical", "clinical", "history", "histories", "case", "cases",
    ],
    "math": ["number", "numbers", "figure"],
    "zh": ["其他", "内容", "信息", "题目", "题干", "问题", "选项", "示例", "标签", "描述", "叙述", "说法", "以下", "下面", "系统", "数据", "存储", "信息", "程序", "过程"],
}
PICTURES = ["figure", "panel", "image"]
# Phrases of the computing domain that stay although a word of theirs is refused.
ALLOWED = {
    "cs": [
        "operating system", "file system", "system bus", "system call", "distributed system", "embedded system", "number system", "expert system", "database system", "computer system",
        "data structure", "data type", "data link", "data link layer", "binary data", "data transfer", "data segment", "data flow", "data bus", "data path", "metadata",
        "information retrieval", "information theory", "information hiding", "information system", "mutual information",
        "computer architecture", "computer organization", "computer network", "computer graphics", "computer science", "personal computer",
        "computer organization", "memory organization", "cache organization", "file organization", "data organization",
    ],
    "cs_zh": [
        "操作系统", "文件系统", "数据库系统", "实时系统", "嵌入式系统", "信息系统", "管理信息系统", "计算机系统", "存储系统", "存储管理", "内存管理", "虚拟内存", "主存储器", "缓存系统", "输入输出系统",
        "通道程序", "中断系统", "数据结构", "数据链路层", "数据总线", "计算机网络", "网络体系结构",
    ],
}
# Concepts of mind, feeling and social acts, words that point to them, and what is mere setting.
CONCEPTS = {
    "mental_states": [
        "belief", "false belief", "true belief", "desire", "intention", "goal", "knowledge", "ignorance", "doubt", "suspicion", "plan", "decision", "motive", "expectation",
        "信念", "错误信念", "欲望", "意图", "想法", "认为", "以为", "知道", "不知道", "怀疑",
    ],
    "emotions": [
        "happiness", "joy", "sadness", "anger", "fear", "embarrassment", "jealousy", "envy", "guilt", "shame", "disappointment", "surprise", "frustration", "anxiety", "pride", "relief", "worry",
        "开心", "高兴", "快乐", "难过", "悲伤", "生气", "愤怒", "害怕", "恐惧", "担心", "紧张", "失望", "激动", "焦虑",
    ],
    "social_acts": [
        "promise", "lie", "joke", "tease", "sarcasm", "apology", "compliment", "threat", "fairness", "cooperation", "sharing", "deception", "betrayal", "trust", "persuasion", "agreement", "secret", "confession",
        "撒谎", "说谎", "欺骗", "安慰", "鼓励", "道歉", "合作", "分享", "求助", "取笑", "嘲笑",
    ],
    "mental_verbs": [
        "think", "believe", "know", "feel", "wonder", "guess", "suspect", "imagine", "notice", "hope", "worry", "decide", "plan", "realize", "understand", "forget", "remember", "doubt",
        "相信", "认为", "觉得", "以为", "知道", "不知道", "怀疑", "希望", "打算", "计划", "喜欢", "担心",
    ],
    "emotion_words": [
        "happy", "sad", "angry", "afraid", "scared", "nervous", "calm", "upset", "relieved", "jealous", "guilty", "ashamed", "disappointed", "excited", "anxious",
        "高兴", "开心", "生气", "害怕", "紧张", "担心", "失望", "难过", "兴奋", "焦虑",
    ],
    "context_places": [
        "office", "classroom", "school", "park", "playground", "mall", "restaurant", "cafeteria", "birthday party", "meeting room", "library", "gym", "stadium", "party", "home", "apartment",
        "咖啡厅", "咖啡馆", "约会地点", "办公室", "社区", "新社区", "邻里", "邻居家", "学校", "教室", "礼堂", "走廊", "阁楼", "厨房", "柜子", "卧室", "阳台", "公园", "餐厅",
    ],
    "context_objects": [
        "gift", "document", "window", "chair", "swing", "project", "promotion", "meeting", "team", "cake", "phone", "message", "secret", "plan", "game", "competition", "neighbor", "note", "email", "invitation",
        "礼物", "公文包", "手提包", "连衣裙", "椅子", "窗户", "门锁", "入室盗窃", "咖啡杯", "礼品盒",
    ],
    "name_prefixes": ["xiao ", "little ", "lao "],
}
COLLAPSED = {"mental_state": "belief", "emotion": "emotion", "social_act": "social", "context_place": "context", "context_name": "context"}
# Chinese concepts that are put into the vocabulary, with their aliases, in order of weight.
SEEDS_ZH = [
    ("信念", ["信念", "belief"]), ("欲望", ["欲望", "渴望"]), ("意图", ["意图", "打算"]), ("目标", ["目标"]), ("知识", ["知识"]), ("无知", ["无知"]), ("怀疑", ["怀疑", "疑虑"]), ("计划", ["计划"]), ("决定", ["决定"]), ("动机", ["动机"]), ("期望", ["期望"]), ("快乐", ["快乐", "高兴"]),
    ("悲伤", ["悲伤", "难过"]), ("愤怒", ["愤怒", "生气"]), ("害怕", ["害怕", "恐惧"]), ("尴尬", ["尴尬"]), ("嫉妒", ["嫉妒"]), ("自豪", ["自豪"]), ("内疚", ["内疚"]), ("羞愧", ["羞愧"]), ("失望", ["失望"]), ("惊讶", ["惊讶"]), ("焦虑", ["焦虑"]), ("诚实", ["诚实"]),
    ("谎言", ["谎言", "说谎"]), ("承诺", ["承诺"]), ("道歉", ["道歉"]), ("合作", ["合作"]), ("分享", ["分享"]), ("欺骗", ["欺骗"]), ("嘲笑", ["嘲笑", "取笑"]), ("讽刺", ["讽刺"]), ("信任", ["信任"]), ("怀疑", ["怀疑"]), ("安慰", ["安慰"]), ("冲突", ["冲突"]),
]
# Final particles, and fragments of questions for a place.
PARTICLES, PLACE_FRAGMENTS = ["的", "了", "吗", "呢", "吧"], ["哪里", "在哪", "在何处"]
# Parts of dataset names and their domain, in order; suffixes and their language; variants of datasets.
DOMAINS = {"medxpertqa": "medical", "csbench": "cs", "tombench": "psychology", "wemath": "math", "we-math": "math", "we_math": "math", "anti": "security", "esg": "finance"}
LANGUAGES = {"_cn": "zh", "_fr": "fr", "_de": "de"}
VARIANTS = {
    "wemath_stage2_textonly": {"base": "wemath", "language": "en", "modality": "text", "suffix": "Stage 2 Text-only"},
    "wemath_stage2_visualprimed": {"base": "wemath", "language": "en", "modality": "multimodal", "suffix": "Stage 2 Visual-primed"},
    "medxpertqa_mm_stage2_textonly": {"base": "medxpertqa_mm", "language": "en", "modality": "text", "suffix": "Stage 2 Text-only"},
    "medxpertqa_mm_stage2_visualprimed": {"base": "medxpertqa_mm", "language": "en", "modality": "multimodal", "suffix": "Stage 2 Visual-primed"},
}


def _lists(table: dict[str, list[str]], language: str, domain: str, extra: list[str]) -> list[str]:
    names = ["standard", "dataset", domain] + (["zh"] if language == "zh" else [])
    return list(dict.fromkeys([x for n in names for x in table.get(n, [])] + extra))


def stopwords(language: str = "en", domain: str = "general") -> list[str]:
    return _lists(STOPWORDS, language, domain, [])


def denylist(language: str = "en", domain: str = "general") -> list[str]:
    """With mentions of pictures, alone or with a letter."""
    return _lists(DENIED, language, domain, PICTURES + [f"{p} {chr(x)}" for p in PICTURES for x in range(ord("a"), ord("z") + 1)])


def allowed(language: str = "en", domain: str = "general") -> list[str]:
    return list(dict.fromkeys(ALLOWED.get(domain, []) + (ALLOWED.get(f"{domain}_zh", []) if language == "zh" else [])))


def concept_category(term: Column) -> Column:
    """Category of a term: whole terms first, then words that point to a category, then setting and names."""
    low = F.lower(trim_ws(term))
    tokens = F.split(low, r"[\s\-_/]+")
    among = lambda name: low.isin(CONCEPTS[name])
    has = lambda name: F.exists(tokens, lambda t: t.isin(CONCEPTS[name]))
    return (
        F.when(among("mental_states"), "mental_state")
        .when(among("emotions"), "emotion")
        .when(among("social_acts"), "social_act")
        .when(has("mental_verbs"), "mental_state")
        .when(has("emotion_words"), "emotion")
        .when(among("context_places") | among("context_objects"), "context_place")
        .when(reduce(Column.__or__, (low.startswith(p) for p in CONCEPTS["name_prefixes"])), "context_name")
        .when(term.rlike(f"^{HAN}{{2,4}}$"), "context_name")
        .otherwise("other")
    )


def collapsed(category: Column) -> Column:
    return F.coalesce(*(F.when(category == k, v) for k, v in COLLAPSED.items()), F.lit("other"))


def clean_concept_terms(terms: Column) -> Column:
    """Terms without a final particle, distinct, in order.  Questions for a place and terms that a longer one
    contains go, unless they name a state of mind or a feeling."""
    safe = lambda t: concept_category(t).isin("mental_state", "emotion")
    place = lambda t: reduce(Column.__or__, (F.contains(t, F.lit(p)) for p in PLACE_FRAGMENTS))
    given = F.filter(F.transform(terms, lambda t: trim_ws(t)), lambda t: t != "")
    stems = F.transform(given, lambda t: F.when((F.length(t) > 1) & F.right(t, F.lit(1)).isin(PARTICLES), F.left(t, F.length(t) - 1)).otherwise(t))
    kept = F.array_distinct(F.filter(stems, lambda t: ~place(t) | safe(t)))
    return F.filter(kept, lambda t: safe(t) | ~F.exists(kept, lambda u: (F.length(u) > F.length(t)) & F.contains(u, t)))


def dataset_domain(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(*(F.when(F.contains(low, F.lit(k)), v) for k, v in DOMAINS.items()), F.lit("general"))


def dataset_language(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(*(F.when(F.contains(low, F.lit(k)), v) for k, v in LANGUAGES.items()), F.lit("en"))


def is_multilingual(name: Column) -> Column:
    return F.contains(name, F.lit("cn")) | F.contains(name, F.lit("tombench"))


def _variant(name: Column, field: str) -> Column:
    return F.coalesce(*(F.when(name == k, v[field]) for k, v in VARIANTS.items()))


def base_dataset(name: Column) -> Column:
    return F.coalesce(_variant(name, "base"), name)


def display_name(base: Column, name: Column) -> Column:
    """The card's name of the dataset, with the variant's suffix."""
    return F.coalesce(F.concat(base, F.lit(" ("), _variant(name, "suffix"), F.lit(")")), base)


def prompt_language(name: Column) -> Column:
    """The variant's language; else that of the name, one mathematical set being Chinese."""
    said = F.when(F.contains(name, F.lit("_cn")) | name.endswith("_zh") | (name == "wemath"), "zh").when(F.contains(name, F.lit("_fr")), "fr").when(F.contains(name, F.lit("_de")), "de")
    return F.coalesce(_variant(name, "language"), said, F.lit("en"))


def modality(name: Column, multimodal: Column, text: Column, images: Column) -> Column:
    """The variant's modality; else by what the domain card says of the dataset."""
    card = F.when(multimodal, "multimodal").when(text & images, "text+existing_image").otherwise("text")
    return F.coalesce(_variant(name, "modality"), card)
