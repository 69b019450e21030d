"""Prompt templates: role, content, task and the answer's form, as map lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .detect import family
from .tables import ANSWERS, ROLES, TASKS
from .tokens import lookup


def _choice(values: dict[str, str], label: Column) -> Column:
    """The value of the label, else of its family, else of the empty key."""
    found = [lookup(values, label), lookup(values, family(label))]
    return F.coalesce(*found, F.lit(values.get("", "")))


def role(label: Column) -> Column:
    return _choice(ROLES, label)


def task(template: str, label: Column) -> Column:
    return _choice(TASKS.get(template.lower(), TASKS[""]), label)


def answer(template: str, label: Column) -> Column:
    return _choice(ANSWERS.get(template.lower(), ANSWERS[""]), label)


def wrap(content: Column, template: str, label: Column) -> Column:
    form = answer(template, label)
    return F.concat(role(label), F.lit("\n\n"), content, F.lit("\n\n"), task(template, label), F.when(form == "", "").otherwise(F.concat(F.lit("\n\n"), form)))
