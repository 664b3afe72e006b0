"""Context of an item by the fields its dataset's schema names: texts, tags and image paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalloom.functions.text import canonical_dataset, nz, trim_ws

# Fields and image rules of each dataset.
SCHEMA: dict[str, dict] = {
    "csbench": {"background_fields": ["Domain", "SubDomain", "Tag"], "context_fields": [], "images": {"enabled": False}},
    "wemath": {
        "background_fields": ["knowledge concept", "knowledge concept description", "key", "question number", "image_path"],
        "context_fields": [],
        "images": {
            "enabled": True,
            "mode": "prefix_rules",
            "rules": [
                {"prefix": "2steps/image/", "base": "data/raw_data/wemath/2steps/image", "strip_prefix": True},
                {"prefix": "3steps/image/", "base": "data/raw_data/wemath/3steps/image", "strip_prefix": True},
            ],
        },
    },
    "medxpertqa": {
        "background_fields": ["question_type", "medical_task", "body_system"],
        "context_fields": [],
        "images": {"enabled": True, "mode": "list_of_dicts", "dict_key": "image_path", "base": "data/raw_data/medxpertqa/images"},
    },
    "tombench": {"background_fields": ["abilities"], "context_fields": ["story"], "images": {"enabled": False}},
}
EMPTY = "array<string>"


def _none() -> Column:
    return F.array().cast(EMPTY)


def normal_path(c: Column) -> Column:
    """A path without empty, ``.`` and resolved ``..`` parts; the empty path is ``.``."""
    rooted = c.startswith("/")
    last = lambda acc: F.try_element_at(acc, F.lit(-1))

    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc) == 0, F.when(rooted, acc).otherwise(F.array_append(acc, part))).when(last(acc) == "..", F.array_append(acc, part))
        return F.when(part.isin("", "."), acc).when(part != "..", F.array_append(acc, part)).otherwise(up.otherwise(F.slice(acc, F.lit(1), F.size(acc) - 1)))

    path = F.array_join(F.aggregate(F.split(c, "/"), _none(), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), path)).when(path == "", ".").otherwise(path)


def join_path(base: str | Column, path: Column) -> Column:
    """The path below the base; an absolute path stays."""
    base = F.lit(base) if isinstance(base, str) else base
    return normal_path(F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path)))


def _below(root: str, base: str) -> str:
    return base if base.startswith("/") else f"{root.rstrip('/')}/{base}"


def images(rule: dict, paths: Column, objects: Column | None, root: str) -> Column:
    """Distinct image paths in order, by the rule's mode: objects that name a file, first prefix that fits, or as they are."""
    if not rule.get("enabled"):
        return _none()
    if rule.get("mode") == "list_of_dicts":
        if objects is None:
            return _none()
        named = F.filter(F.transform(objects, lambda o: nz(o[rule.get("dict_key", "image_path")])), lambda p: p.isNotNull())
        found = F.transform(named, lambda p: join_path(_below(root, rule.get("base", "")), p))
    elif rule.get("mode") == "prefix_rules":

        def rewrite(p: Column) -> Column:
            p = F.replace(p, F.lit("\\"), F.lit("/"))
            out = [F.when(p.startswith(r["prefix"]), join_path(_below(root, r["base"]), F.substring(p, len(r["prefix"]) + 1, 1 << 30) if r.get("strip_prefix", True) else p)) for r in rule.get("rules", [])]
            return F.coalesce(*out, p)

        found = F.transform(F.filter(paths, lambda p: p.isNotNull()), rewrite)
    else:
        found = paths
    return F.coalesce(F.array_distinct(F.filter(found, lambda p: nz(p).isNotNull())), _none())


def _gather(fields: list[str], values: dict[str, Column]) -> Column:
    have = [F.coalesce(values[f], _none()) for f in fields if f in values]
    return F.filter(F.concat(*have), lambda v: nz(v).isNotNull()) if have else _none()


def context_pack(source: Column, context: dict[str, Column], background: dict[str, Column], paths: Column, objects: Column | None = None, root: str = "", schema: dict[str, dict] = SCHEMA) -> Column:
    """struct(text, images, tags) of an item, by the schema of the dataset that its source names.

    ``context`` and ``background`` map a field to its values (arrays of strings; null: none).  Blank texts are
    left out, an unknown dataset has nothing.  Background fields give tags, no text.  Whether an image's file exists is not asked.
    """
    key = canonical_dataset(source)
    image_path = F.array(background["image_path"][0]) if "image_path" in background else _none()
    every = F.concat(F.coalesce(paths, _none()), F.coalesce(image_path, _none()))

    def by(of) -> Column:
        return F.coalesce(*(F.when(key == name, of(rules)) for name, rules in schema.items()), _none())

    return F.struct(
        F.filter(by(lambda r: _gather(r.get("context_fields", []), context)), lambda t: trim_ws(t) != "").alias("text"),
        by(lambda r: images(r.get("images", {}), every, objects, root)).alias("images"),
        by(lambda r: _gather(r.get("tag_fields", []), background)).alias("tags"),
    )
