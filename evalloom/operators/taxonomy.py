"""Taxonomy tables and taggers: keyword containment, first match, tiers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evalloom.functions.arrays import contains_any

# Keywords of each parent.
CS_PARENTS = {
    "CS.Core.DataStructuresAlgorithms": ["data structure", "data structures", "linear list", "linked list", "stack", "queue", "tree", "graph", "graph theory", "sorting", "searching", "algorithm", "dynamic programming", "hash table", "recursion", "栈", "队列", "树", "图", "排序", "查找", "算法", "递归"],
    "CS.Core.ComputerOrganization": ["computer architecture", "computer organization", "cpu architecture", "instruction cycle", "pipeline", "memory hierarchy", "cache", "register", "assembly", "计算机组成原理", "指令周期", "流水线", "寄存器", "主存", "cache"],
    "CS.Core.ComputerNetwork": ["computer network", "network", "tcp/ip", "network layer", "transport layer", "application layer", "data link layer", "网络层", "传输层", "应用层", "数据链路层", "计算机网络", "通信", "路由"],
    "CS.Core.OperatingSystem": ["operating system", "process management", "memory management", "storage system", "file system", "process scheduling", "concurrency", "synchronization", "io management", "输入输出管理", "内存管理", "进程与线程", "操作系统", "存储系统", "文件系统", "调度"],
}
MATH_PARENTS = {
    "Math.Geometry.PlaneFigures": ["triangle", "quadrilateral", "trapezoid", "plane figure", "polygon", "folding", "net", "平面图形", "三角形", "四边形", "梯形", "展开图"],
    "Math.Geometry.SolidFigures": ["solid figure", "solid geometry", "cube", "cuboid", "prism", "pyramid", "surface area", "volume", "solid mensuration", "立体图形", "立体几何", "正方体", "长方体", "棱柱", "棱锥", "表面积", "体积"],
    "Math.Geometry.TransformAndMotion": ["transformation", "translation", "rotation", "reflection", "tessellation", "partition", "motion", "折叠", "旋转", "平移", "对称", "铺砌"],
    "Math.Geometry.PositionDirection": ["spatial reasoning", "position", "direction", "coordinate", "location", "视角", "方位", "位置关系", "空间推理"],
    "Math.Geometry.Measurement": ["area", "perimeter", "measurement", "unit conversion", "length", "area calculation", "perimeter calculation", "面积", "周长", "测量", "单位换算", "长度"],
}
SPECIALTIES = {
    "neurology": ["neurology", "neurocritical care", "neuro"],
    "emergency medicine": ["emergency medicine", "acute care", "trauma"],
    "musculoskeletal disorders": ["musculoskeletal disorders", "musculoskeletal", "rheumatology"],
    "orthopedic surgery": ["orthopedic surgery", "orthopedics"],
    "infectious diseases": ["infectious diseases", "infectious disease", "id"],
    "digestive system": ["digestive system", "gastroenterology"],
    "histopathology": ["histopathology", "pathology"],
    "cardiovascular": ["cardiovascular", "cardiology"],
    "reproductive health": ["reproductive health", "obstetrics", "gynecology"],
    "radiation oncology": ["radiation oncology", "rad onc"],
    "pediatric pulmonology": ["pediatric pulmonology", "pediatric respiratory"],
    "cardiac electrophysiology": ["cardiac electrophysiology", "electrophysiology"],
    "pediatrics": ["pediatrics", "pediatric medicine"],
    "nephrology": ["nephrology", "renal"],
    "endocrinology": ["endocrinology", "endocrine"],
    "dermatology": ["dermatology", "derm"],
}
TASK_AXES = {
    "diagnostic imaging": ["diagnostic imaging", "medical imaging", "radiology", "imaging"],
    "pharmacologic therapy": ["pharmacologic therapy", "pharmacology", "drug therapy", "pharmacotherapy"],
    "clinical management": ["clinical management", "management plan", "treatment planning"],
    "physical examination": ["physical examination", "clinical examination", "phys exam"],
    "laboratory testing": ["laboratory testing", "lab diagnostics", "laboratory diagnostics"],
    "differential diagnosis": ["differential diagnosis", "differential reasoning"],
    "surgical planning": ["surgical planning", "perioperative management"],
}


def parents(labels: Column, table: dict[str, list[str]]) -> Column:
    """Sorted parents one of whose keywords a label contains."""
    low = F.transform(labels, F.lower)  # once for each parent, not once for each keyword
    has = lambda keys: F.exists(low, lambda x: reduce(Column.__or__, (F.contains(x, F.lit(k)) for k in needed(keys))))
    hits = [F.when(has(keys), F.lit(parent)) for parent, keys in table.items()]
    return F.array_sort(F.filter(F.array(*hits), lambda x: x.isNotNull()))


def needed(keys: list[str]) -> list[str]:
    """Keywords, in lower case, that hold no other: a text with "graph theory" has "graph" anyway."""
    low = list(dict.fromkeys(k.lower() for k in keys))
    return [k for k in low if not any(x in k for x in low if x != k)]


def text_parents(text: Column, *tables: dict[str, list[str]]) -> Column:
    """For each table the ``parents`` of one text; none for a null text.  The text is lower-cased once, and searched by Python, which skips through it."""
    found = [[(parent, needed(keys)) for parent, keys in sorted(table.items())] for table in tables]

    def search(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for low in texts:
            hits = [[[p for p, keys in table if any(k in x for k in keys)] if x is not None else [] for x in low] for table in found]
            yield pd.DataFrame({f"t{i}": pd.Series(h, dtype=object) for i, h in enumerate(hits)})

    search.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(search, ", ".join(f"t{i} array<string>" for i in range(len(tables))))
    return udf(F.lower(text))


def first_category(label: Column, table: dict[str, list[str]], whole_words: bool = True) -> Column:
    """First category of the table that matches; empty if none.  By default an alias must stand as a word."""
    low = F.lower(label)
    tests = [(c, low.rlike(r"(^|[^a-z])(" + "|".join(a) + r")($|[^a-z])") if whole_words else contains_any(label, a)) for c, a in table.items()]
    return F.coalesce(*(F.when(t, F.lit(c)) for c, t in tests), F.lit(""))


def tiered(values: Column, aliases: dict[str, list[str]], keywords: dict[str, list[str]], default: str) -> Column:
    """Tags by alias within a value; else by keyword anywhere in all values; else the default."""
    one = parents(values, aliases) if aliases else F.array().cast("array<string>")
    joined = F.array_join(values, " ")
    two = parents(F.array(joined), keywords)
    return F.when(F.size(one) > 0, one).when(F.size(two) > 0, two).otherwise(F.array(F.lit(default)))


def scenarios(values: Column, table: dict[str, list[str]], most: int = 3) -> Column:
    """At most three scenario labels, in the table's order."""
    joined = F.array_join(values, " ")
    return F.slice(F.filter(F.array(*(F.when(contains_any(joined, keys), F.lit(k)) for k, keys in table.items())), lambda x: x.isNotNull()), 1, most)


def enforce_labels(native: Column, text: Column, fallback: Column, table: dict[str, str], most: int = 3) -> Column:
    """Labels split at separators and mapped; else inferred from the text; else those of the sibling language; at most three, sorted."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    split = F.flatten(F.transform(native, lambda x: F.split(x, "[,;/、，；]")))
    mapped = F.filter(F.transform(split, lambda x: pairs[F.trim(x)]), lambda x: x.isNotNull())
    guessed = F.filter(F.array(*(F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in table.items())), lambda x: x.isNotNull())
    got = F.when(F.size(mapped) > 0, mapped).when(F.size(guessed) > 0, guessed).otherwise(F.coalesce(fallback, F.array().cast("array<string>")))
    return F.array_sort(F.slice(F.array_distinct(got), 1, most))
