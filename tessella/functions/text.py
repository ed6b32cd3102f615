"""Captions and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_bucket(age: Column) -> Column:
    """"40-49-year-old"; what is no positive number gives "adult"."""
    n = F.floor(_number(age) / 10).cast("bigint") * 10
    return F.when(_number(age) > 0, F.concat(n.cast("string"), F.lit("-"), (n + 9).cast("string"), F.lit("-year-old"))).otherwise("adult")


def _number(x: Column) -> Column:
    return F.nullif(x.cast("string").try_cast("double"), F.lit(float("nan")))


def sex_phrase(sex: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(sex, F.lit(""))))
    return F.when(s.startswith("f"), "female").when(s.startswith("m"), "male").otherwise("patient")


def natural_list(items: Column) -> Column:
    """"a", "a and b", "a, b, and c"; an empty array gives an empty string."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    last = F.get(items, n - 1)
    return F.when(n <= 0, "").when(n == 1, last).when(n == 2, F.concat(F.get(items, F.lit(0)), F.lit(" and "), last)).otherwise(F.concat(head, F.lit(", and "), last))


def indefinite_article(phrase: Column) -> Column:
    """"an" before a vowel and before numbers spoken with one (8, 80-89, 800-899, 11, 18)."""
    p = F.lower(F.trim(phrase))
    return F.when(p.rlike("^[aeiou]") | p.rlike(r"^8\d*\b") | p.rlike(r"^(11|18)\b"), "an").otherwise("a")


def site_clause(site: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(site, F.lit(""))))
    return F.when(s.isin("", "unknown", "nan", "none"), "").otherwise(F.concat(F.lit(" on the "), s))


def view_phrase(view: Column) -> Column:
    """"lateral" for what starts so, else "frontal"."""
    return F.when(F.lower(F.trim(F.coalesce(view, F.lit("")))).startswith("lat"), "lateral").otherwise("frontal")


# fixed values: findings in the order that clauses name them, with their phrases
FINDINGS = {
    "Enlarged Cardiomediastinum": "an enlarged cardiomediastinum",
    "Cardiomegaly": "cardiomegaly",
    "Lung Opacity": "lung opacity",
    "Lung Lesion": "a lung lesion",
    "Edema": "pulmonary edema",
    "Consolidation": "consolidation",
    "Pneumonia": "pneumonia",
    "Atelectasis": "atelectasis",
    "Pneumothorax": "pneumothorax",
    "Pleural Effusion": "pleural effusion",
    "Pleural Other": "other pleural abnormality",
    "Fracture": "a fracture",
}
NO_FINDING, DEVICE = "No Finding", "Support Devices"
NO_FINDING_PHRASE, DEVICE_PHRASE = "no acute cardiopulmonary abnormality", "Support devices are present."
# fixed values: caption templates of the multi-label and of the single-label track
CHEST = ("A {view} chest X-ray of a {age} {sex} patient. Findings: {findings}.", "Chest radiograph, {view} view, {age} {sex} patient. Findings: {findings}.", "A {view} view chest X-ray from a {age} {sex} patient showing {findings}.", "{age} {sex} patient, {view} chest X-ray. Findings: {findings}.")
SKIN = ("A dermoscopic image of {diagnosis}{site} in {article} {age} {sex} patient.", "Dermoscopy of {diagnosis}{site}, {age} {sex} patient.", "{Article} {age} {sex} patient with {diagnosis}{site}, dermoscopic view.", "Dermoscopic image, {age} {sex} patient, showing {diagnosis}{site}.")


def finding_clause(labels: Column) -> Column:
    """Phrases of the positive findings of a map (label to 1, 0, -1 or null), in their fixed order; a positive "No Finding", or none positive, gives the normal phrase."""
    value = lambda k: F.coalesce(F.try_element_at(labels, k), F.lit(0)) == 1
    items = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in FINDINGS.items()])
    found = F.transform(F.filter(items, lambda x: value(x["k"])), lambda x: x["v"])
    return F.when(value(F.lit(NO_FINDING)) | (F.size(found) == 0), NO_FINDING_PHRASE).otherwise(natural_list(found))


def device_clause(labels: Column) -> Column:
    return F.when(F.coalesce(F.try_element_at(labels, F.lit(DEVICE)), F.lit(0)) == 1, DEVICE_PHRASE).otherwise("")


def filled(template: str, parts: dict[str, Column]) -> Column:
    """A template with its names in braces replaced."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[parts[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if p])


def picked(variant: Column, templates: tuple[str, ...], parts: dict[str, Column]) -> Column:
    """The template of a variant's number, filled; variants beyond the last start again."""
    return F.get(F.array(*[filled(t, parts) for t in templates]), (variant % len(templates)).cast("int"))


def chest_caption(variant: Column, view: Column, age: Column, sex: Column, labels: Column) -> Column:
    text = picked(variant, CHEST, {"view": view_phrase(view), "age": age_bucket(age), "sex": sex_phrase(sex), "findings": finding_clause(labels)})
    return F.concat_ws(" ", text, F.nullif(device_clause(labels), F.lit("")))


def skin_caption(variant: Column, diagnosis: Column, age: Column, sex: Column, site: Column) -> Column:
    bucket = age_bucket(age)
    article = indefinite_article(bucket)
    return picked(variant, SKIN, {"diagnosis": diagnosis, "site": site_clause(site), "article": article, "Article": F.initcap(article), "age": bucket, "sex": sex_phrase(sex)})


def sanitize_id(path: Column, prefix: str = "") -> Column:
    """Path to identifier: prefix and extension (jpg, jpeg, png; any case) go, slashes become ``__``."""
    p = F.regexp_replace(path, "^" + prefix, "") if prefix else path
    return F.regexp_replace(F.regexp_replace(p, r"(?i)\.(jpg|jpeg|png)$", ""), "/", "__")
