"""Main text of web pages by wrapper induction.

Every page becomes its blocks of text (path, text), without what tags, roles and names mark as menus, adverts, comments
and the like.  The pages of a host are grouped into layouts: their skeletons (the paths of blocks, down to the last node
that has a class or divides the page) are compared by simple tree matching.  Over all different pages of a layout it is
counted how many hold a block and how many hold its path.  A block that the next page would hold by these counts is
constant and the template's; what varies is content.  Where the letters that vary lie, in main, in articles or beside
them, tells where the story is, so that teasers and notes around it lose to it."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm.dom import ARTICLE, MAIN, blocks, parse, tree_match
from archivolt.llm.shared import table, written

#: How likely the next page of a layout holds a block that is the template's: (pages with it + 1) / (pages with its path
#: + 2), so that few pages prove little.  Markup speaks for blocks of an article or main, and more is asked there.
LIKELY, LIKELY_INSIDE = 0.75, 0.9
ALIKE = 0.6  # share of the nodes of two skeletons of one layout that simple tree matching pairs
ROUNDS = 3  # in which skeletons of a host meet by another of their least lines
DIVIDES = frozenset("article aside div footer header main section".split())
BLOCK = "struct<p:long,b:long,kind:int,text:string>"


def number(text: str) -> int:
    """64 bits of a text as a signed number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(text)).astype(np.int64))


def skeleton(parts: list[tuple]) -> str:
    """The different paths of blocks in page order, each without the plain nodes at its end, one a line."""
    seen: dict[str, None] = {}
    for path in dict.fromkeys(part[0] for part in parts):
        keys = path.split("/")
        while len(keys) > 2 and keys[-1] not in DIVIDES and "." not in keys[-1] and "@" not in keys[-1]:
            keys.pop()
        seen["/".join(keys)] = None
    return "\n".join(seen)


def tree_of(lines: str) -> tuple[tuple, int]:
    """A skeleton as a tree (key, children), and its nodes."""
    root, at = ("", []), {}
    for line in lines.split("\n"):
        node, path = root, ""
        for key in line.split("/")[1:]:
            path += "/" + key
            if path not in at:
                at[path] = (key, [])
                node[1].append(at[path])
            node = at[path]
    return root, len(at) + 1


def leaders_of(skeletons: list[str]) -> list[int]:
    """For each skeleton the first one before it that leads a layout and is alike, or itself."""
    first, out = [], []
    for i, lines in enumerate(skeletons):
        tree, n = tree_of(lines)
        own = next((k for k, other, m in first if 2 * min(n, m) >= ALIKE * (n + m) and 2 * tree_match(tree, other) >= ALIKE * (n + m)), i)
        if own == i:
            first.append((i, tree, n))
        out.append(own)
    return out


def host_of(url) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


OUTLINE = f"page_id long, url string, host string, page long, form long, skeleton string, blocks array<{BLOCK}>"


def outlines(batches):
    """page_id, url, host, page (a number of its blocks), form (of its skeleton), skeleton and blocks of each page."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("p", pa.int64()), ("b", pa.int64()), ("kind", pa.int32()), ("text", pa.string())]))]
    for batch in batches:
        rows = []
        for html in batch.column("html").to_pylist():
            parts = blocks(parse(html or ""))
            lines = skeleton(parts)
            held = [{"p": number(path), "b": number(f"{path}\0{text}"), "kind": kind, "text": text} for path, text, kind in parts]
            rows.append((number(repr([x["b"] for x in held])), number(lines), lines, held))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        head = [batch.column(c) for c in ("page_id", "url", "host")]
        yield pa.RecordBatch.from_arrays([*head, *(pa.array(c, t) for c, t in zip(cols, kinds[3:], strict=True))], names=["page_id", "url", "host", "page", "form", "skeleton", "blocks"])


def layouts(forms: DataFrame) -> DataFrame:
    """host, form and layout (a form that leads it) from forms(host, form, skeleton, n).

    In each round, skeletons of a host that share their least line by that round's hash meet, as alike ones mostly do,
    and only those that lead go on; the most frequent lead.  So no host's skeletons all come to one task."""

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "form"], ascending=[False, True])
        at = leaders_of(pdf["skeleton"].tolist())
        return pd.DataFrame({"host": pdf["host"], "form": pdf["form"], "leader": pdf["form"].to_numpy()[at]})

    found = None
    for turn in range(ROUNDS):
        least = F.array_min(F.transform(F.split("skeleton", "\n"), lambda line: F.xxhash64(line, F.lit(turn))))
        led = written(forms.withColumn("meet", least).groupBy("host", "meet").applyInPandas(lead, "host string, form long, leader long"), "leaders")
        found = led if found is None else written(found.join(led.select("host", F.col("form").alias("leader"), F.col("leader").alias("now")), ["host", "leader"]).select("host", "form", F.col("now").alias("leader")), "leaders")
        counts = forms.join(led, ["host", "form"]).groupBy("host", "leader").agg(F.sum("n").alias("n"))
        forms = written(forms.drop("n").join(counts.select("host", F.col("leader").alias("form"), "n"), ["host", "form"]), "forms")
    return found.withColumnRenamed("leader", "layout")


def templates(pages: DataFrame) -> DataFrame:
    """host, form and constant (the numbers of blocks that its layout holds as they are) from outlines.

    All different pages count.  Only blocks that two pages hold, and sums by path, meet their layout."""
    one = F.count(F.lit(1))
    slim = F.array_distinct(F.transform("blocks", lambda x: F.struct(x["p"], x["b"], x["kind"])))
    each = written(pages.filter(F.size("blocks") > 0).select("host", "page", "form", slim.alias("blocks")).dropDuplicates(["host", "page"]), "pages")
    kinds = pages.filter(F.size("blocks") > 0).groupBy("host", "form").agg(F.first("skeleton").alias("skeleton"))
    of = layouts(written(kinds.join(each.groupBy("host", "form").agg(one.alias("n")), ["host", "form"]), "forms"))
    by_path = each.select("host", "form", F.explode(F.array_distinct("blocks.p")).alias("p")).groupBy("host", "form", "p").agg(one.alias("n"))
    on_path = by_path.join(of, ["host", "form"]).groupBy("host", "layout", "p").agg(F.sum("n").alias("pages"))
    by_form = each.select("host", "form", F.explode("blocks").alias("x")).groupBy("host", "form", "x.p", "x.b", "x.kind").agg(one.alias("n"))
    by_layout = by_form.join(of, ["host", "form"]).groupBy("host", "layout", "p", "b", "kind").agg(F.sum("n").alias("n")).filter("n > 1")
    likely = (F.col("n") + 1) / (F.col("pages") + 2) >= F.when(F.col("kind") > 0, LIKELY_INSIDE).otherwise(LIKELY)
    constant = by_layout.join(on_path, ["host", "layout", "p"]).filter(likely).groupBy("host", "layout").agg(F.collect_list("b").alias("constant"))
    return written(of.join(constant, ["host", "layout"]).select("host", "form", "constant"), "templates")


def content(parts: Column, constant: Column) -> Column:
    """The text of a page's blocks: those that vary, of main if at least half of their letters are there, else of articles
    likewise, else of what is in neither, or all where there is neither.  A page of which nothing varies is a copy of
    others and stays whole."""
    none = F.array().cast("array<long>")
    varying = F.filter(parts, lambda x: ~F.array_contains(F.coalesce(constant, none), x["b"]))
    left = F.when(F.size(varying) > 0, varying).otherwise(parts)
    letters = lambda keep: F.aggregate(F.filter(left, keep), F.lit(0), lambda n, x: n + F.length(x["text"]))
    half = lambda kind: (2 * letters(lambda x: x["kind"] == kind) >= letters(lambda x: F.lit(True))) & F.exists(left, lambda x: x["kind"] == kind)
    outside = F.filter(left, lambda x: x["kind"] == 0)
    chosen = F.when(half(MAIN), F.filter(left, lambda x: x["kind"] == MAIN)).when(half(ARTICLE), F.filter(left, lambda x: x["kind"] == ARTICLE)).when(F.size(outside) > 0, outside).otherwise(left)
    return F.array_join(F.transform(chosen, lambda x: x["text"]), "\n\n")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text (blocks joined by an empty line; empty if none) for every row of pages(page_id, url, html).

    Null or empty html gives an empty text; null urls share one template; repeated rows are read each, and count once
    for the template; html of any length is read whole; other columns are ignored; no rows give no rows.  A block of a
    layout with a single page can't be told from a template's, so there tags, roles and names decide alone.  Forms of a
    host that as many pages have lead in the order of their hash."""
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of("url"))
    known = written(read.mapInArrow(outlines, OUTLINE), "outlines", "zstd")
    return known.join(templates(known), ["host", "form"], "left").select("page_id", "url", content(F.col("blocks"), F.col("constant")).alias("text"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
