"""Prompts as templates with named places, filled as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A system message and one template for each way to ask.
TEMPLATES = {
    "system": "Respondes sobre derecho con la evidencia dada y solo con ella; cita normas y sentencias por su nombre.",
    "multiple_choice": "Tema: {area}\n\nTextos:\n{evidence}\n\n{question}\n{options}\n\nAnaliza cada opción y elige una letra.",
    "multiple_choice_pick": "Tema: {area}\n\nTextos:\n{evidence}\n\n{question}\n{options}\n\nElige una letra y justifica.",
    "multiple_choice_open": "Tema: {area}\n\nTextos:\n{evidence}\n\n{question}\n\nResponde sin opciones.",
    "multiple_choice_from_open": "Tema: {area}\n\nTextos:\n{evidence}\n\n{question}\n{options}\n\nRespuesta previa: {draft}\n\nElige la letra que coincide.",
    "semi_open": "Tema: {area}\n\nTextos:\n{evidence}\n\n{question}\n\nResponde en pocas oraciones con palabras clave.",
    "open_ended": "Tema: {area}\n\nTextos:\n{evidence}\n\n{question}\n\nDesarrolla normas, análisis, jurisprudencia y conclusión.",
}
MISSING = {"area": "no indicada", "evidence": "(sin evidencia)", "draft": "(sin respuesta previa)"}


def filled(template: str, places: dict[str, Column]) -> Column:
    """The template with each {place} replaced; empty values as MISSING has them."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        value = F.coalesce(places[piece], F.lit("")) if i % 2 else F.lit(piece)
        parts.append(F.when(value == "", F.lit(MISSING[piece])).otherwise(value) if i % 2 and piece in MISSING else value)
    return F.concat(*parts)


def prompt(kind: Column, places: dict[str, Column]) -> Column:
    """The prompt of each item by the name of its template."""
    out = F.lit(None).cast("string")
    for name, template in TEMPLATES.items():
        out = F.when(kind == name, filled(template, places)).otherwise(out)
    return out
