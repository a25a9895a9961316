"""Row and delivery checks that gather every error of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window

from archivolt.functions.grammar import CHAMBERS

# Fixed values of the inventory's contract.
TYPES = ("constitucion", "codigo", "ley", "decreto", "decreto_ley", "acto_legislativo", "resolucion", "circular", "sentencia", "decision_andina", "concepto")
NUMBERED = ("ley", "decreto", "decreto_ley", "acto_legislativo", "resolucion", "circular", "sentencia", "decision_andina")
FORCE = ("", "vigente", "derogada", "parcial")
REQUIRED = {
    "multiple_choice": ("respuesta_correcta", "justificacion", "descarte_opciones"),
    "semi_open": ("respuesta", "palabras_clave", "referencia_legal"),
    "open_ended": ("marco_normativo", "analisis", "jurisprudencia", "conclusion"),
}


def with_errors(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds errors: the names of all rules a row breaks.  A rule is the condition under which it is broken."""
    return rows.withColumn("errors", F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()])))


def clean(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("errors") == 0).drop("errors")


def repeated(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key an earlier row has, with that row's order as first_row."""
    by = Window.partitionBy(key)
    return rows.withColumn("first_row", F.min(order).over(by)).filter(F.col(order) > F.col("first_row"))


def missing_columns(rows: DataFrame, required: list[str], known: list[str]) -> tuple[list[str], list[str]]:
    """Required columns that lack (errors) and columns that are not known (warnings)."""
    have = {c.strip().lower() for c in rows.columns}
    return sorted(set(required) - have), sorted(have - set(known))


def inventory_rules(areas: list[str]) -> dict[str, Column]:
    """The rules of an inventory of sources, over its columns and seen (the row of the id's first occurrence)."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    numbered = F.col("tipo").isin(*NUMBERED)
    return {
        **{f"{c}_required": blank(c) for c in ("doc_id", "archivo", "titulo", "tipo", "organo_emisor", "fuente", "url", "fecha_consulta", "areas")},
        "doc_id_form": ~blank("doc_id") & ~F.col("doc_id").rlike("^[a-z0-9_-]+$"),
        "tipo_unknown": ~blank("tipo") & ~F.col("tipo").isin(*TYPES),
        "numero_required": numbered & blank("numero"),
        "anio_required": numbered & blank("anio"),
        "anio_form": ~blank("anio") & ~F.col("anio").rlike("^[0-9]{4}$"),
        "url_form": ~blank("url") & ~F.col("url").rlike("^https?://"),
        "fecha_form": ~blank("fecha_consulta") & (~F.col("fecha_consulta").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") | F.try_to_date("fecha_consulta", "yyyy-MM-dd").isNull()),
        "areas_unknown": ~blank("areas") & F.exists(F.split("areas", r"\|"), lambda a: ~F.trim(a).isin(*areas)),
        "vigencia_unknown": ~F.coalesce(F.trim("vigencia"), F.lit("")).isin(*FORCE),
    }


def inventory(rows: DataFrame, files: DataFrame, areas: list[str], order: str = "row") -> DataFrame:
    """Adds errors and first_row to rows(row, doc_id, archivo, ..) of an inventory: the rules of a row alone, files that
    files(path) lacks (a folder is there where a file is below it), rulings whose number has no such form, and ids that an
    earlier row has, with that row's number."""
    parts = F.split("path", "/")
    places = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    there = files.select(F.explode(places).alias("archivo")).distinct().withColumn("there", F.lit(True))
    first = F.min(order).over(Window.partitionBy("doc_id"))
    joined = rows.join(there, "archivo", "left").withColumn("first_row", F.when(F.coalesce(F.trim("doc_id"), F.lit("")) != "", first))
    rules = {
        **inventory_rules(areas),
        "doc_id_repeated": F.col("first_row") < F.col(order),
        "numero_form": (F.col("tipo") == "sentencia") & (F.coalesce(F.trim("numero"), F.lit("")) != "") & ~F.upper("numero").rlike(rf"^(?:{'|'.join(CHAMBERS).upper()})-\d+"),
        "archivo_missing": (F.coalesce(F.trim("archivo"), F.lit("")) != "") & F.col("there").isNull(),
    }
    found = with_errors(joined, rules)
    return found.withColumn("first_row", F.when(F.col("first_row") < F.col(order), F.col("first_row"))).drop("there")


def header_problems(headers: DataFrame, required: list[str], known: list[str]) -> DataFrame:
    """id, column and problem (required or unknown) of the header lines of headers(id, header), as missing_columns() has
    them for a table: separated by semicolons where those are more than the commas."""
    count = lambda mark: F.length("header") - F.length(F.replace(F.col("header"), F.lit(mark), F.lit("")))
    names = F.when(count(";") > count(","), F.split("header", ";")).otherwise(F.split("header", ","))
    have = F.array_distinct(F.transform(names, lambda n: F.lower(F.trim(n, F.lit(" \"\ufeff")))))
    rows = headers.select("id", have.alias("have"))
    wanted = lambda listed: F.array(*[F.lit(c) for c in listed])
    problems = F.concat(
        F.transform(F.array_except(wanted(required), "have"), lambda c: F.struct(c.alias("column"), F.lit("required").alias("problem"))),
        F.transform(F.array_except("have", wanted(known)), lambda c: F.struct(c.alias("column"), F.lit("unknown").alias("problem"))),
    )
    return rows.select("id", F.explode(problems).alias("p")).select("id", "p.*")


def required_fields(kind: Column) -> Column:
    """The fields that an answer of a kind must have, in the order they are to be written; null for other kinds."""
    return F.try_element_at(F.create_map(*[x for k in REQUIRED for x in (F.lit(k), F.array(*[F.lit(f) for f in output_schema(k)["required"]]))]), kind)


def aliased(values: Column, aliases: dict[str, str]) -> Column:
    """Names of a pipe-separated list by alias, without unknown ones, each once in the order given."""
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    fold = lambda v: F.lower(F.trim(F.regexp_replace(v, r"\s+", " ")))
    return F.array_distinct(F.array_compact(F.transform(F.split(values, r"\|"), lambda v: F.try_element_at(known, fold(v)))))


def submission_rules(expected: DataFrame) -> dict[str, Column]:
    """The rules of a delivered line, over its columns, known (its id is expected) and turn (of its id)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "[]", "{}")
    rules = {"id_missing": F.col("id").isNull(), "id_repeated": F.col("turn") > 1, "id_unknown": F.col("id").isNotNull() & ~F.col("known"), "format_unknown": ~F.coalesce("formato", F.lit("")).isin(*REQUIRED)}
    for kind, names in REQUIRED.items():
        for name in names:
            rules[f"{name}_missing"] = (F.col("formato") == kind) & ~F.coalesce("abstencion", F.lit(False)) & empty(name)
    rules["passages_missing"] = ~F.coalesce("abstencion", F.lit(False)) & (F.coalesce("n_passages", F.lit(0)) == 0)
    rules["passages_over"] = F.col("n_passages") > 10
    return rules


def delivery(lines: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: lines, repeated, missing and extra ids, wrong formats, lines over ten passages, abstentions.

    Lines are counted by id and format where they are read, meet the expected ids once, and are summed by id and then in
    all, so each table is read once.  A null id is an extra one."""
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    kinds = lines.groupBy("id", "formato").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_passages") > 10).alias("over"), F.count_if("abstencion").alias("abstained"))
    both = kinds.join(expected.select("id", F.col("formato").alias("wanted"), F.lit(True).alias("known")), "id", "full")
    wrong = F.when(F.col("known") & F.col("n").isNotNull() & ~F.col("formato").eqNullSafe(F.col("wanted")), F.col("n"))
    per_id = both.groupBy("id").agg(count("n").alias("n"), count("over").alias("over"), count("abstained").alias("abstained"), count(wrong).alias("wrong"), F.coalesce(F.bool_or("known"), F.lit(False)).alias("known"))
    return per_id.agg(
        count("n").alias("lines"), count("over").alias("over_ten"), count("abstained").alias("abstentions"), F.count_if(F.col("n") > 1).alias("repeated"),
        F.count_if(F.col("known") & (F.col("n") == 0)).alias("missing"), F.count_if(~F.col("known") & (F.col("n") > 0)).alias("extra"), count("wrong").alias("wrong_format"),
    )


def delivered(lines: DataFrame, path: str) -> dict:
    """Writes lines as JSON below path and tells, by what was observed beside the sink, how many there were, how many of
    each problem, and the abstentions: no second pass, and no figure that another read might give."""
    seen = Observation()
    empty = F.col("id").isNull()
    watched = lines.observe(
        seen, F.count(F.lit(1)).alias("lines"), F.count_if(empty).alias("without_id"), F.count_if(F.col("n_passages") > 10).alias("over_ten"),
        F.count_if("abstencion").alias("abstentions"), F.count_if(~F.coalesce("formato", F.lit("")).isin(*REQUIRED)).alias("unknown_format"),
    )
    watched.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return seen.get


def allowed_runs(runs: DataFrame, allowed: tuple) -> DataFrame:
    """Adds refused to runs(model, temperature): why a run may not start, or null."""
    return runs.withColumn("refused", F.when(~F.coalesce(F.col("model").isin(*allowed), F.lit(False)), "model").when(F.col("temperature") != 0, "temperature"))


def output_schema(kind: str, letters: tuple = ("A", "B", "C", "D")) -> dict:
    """The JSON schema of an answer of a format, its fields in the order they are to be written."""
    text, used = {"type": "string"}, {"type": "array", "items": {"type": "integer", "minimum": 1, "maximum": 20}, "maxItems": 10}
    by_letter = {"type": "object", "properties": dict.fromkeys(letters, text), "required": list(letters)}
    special = {
        "analisis_opciones": by_letter, "respuesta_correcta": {"type": "string", "enum": list(letters)},
        "palabras_clave": {"type": "array", "items": text, "minItems": 3, "maxItems": 6},
    }
    names = ("analisis_opciones", "respuesta_correcta", "justificacion") if kind == "multiple_choice" else REQUIRED[kind]
    fields = {**{n: special.get(n, text) for n in names}, "pasajes_usados": used}
    return {"type": "object", "properties": fields, "required": list(fields)}
