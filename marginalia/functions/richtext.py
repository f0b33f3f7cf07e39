"""Runs of styled text as markdown, in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = "struct<type:string,content:string,link:string,page_id:string,bold:boolean,italic:boolean,strike:boolean,underline:boolean,code:boolean,color:string>"


def _wrap(text: Column, on: Column, before: str, after: str | None = None) -> Column:
    return F.when(F.coalesce(on, F.lit(False)), F.concat(F.lit(before), text, F.lit(before if after is None else after))).otherwise(text)


def run_markdown(r: Column, path: Column | None = None) -> Column:
    """One run: highlight inside code inside strike-through, underline, italic and bold; the link is outermost.

    ``path``: of the page a mention names, if it is known.
    """
    text = _wrap(r["content"], r["color"] == "yellow_background", "==")
    for mark, before, after in (("code", "`", None), ("strike", "~~", None), ("underline", "<u>", "</u>"), ("italic", "*", None), ("bold", "**", None)):
        text = _wrap(text, r[mark], before, after)
    text = F.when(F.coalesce(r["link"], F.lit("")) != "", F.concat(F.lit("["), text, F.lit("]("), r["link"], F.lit(")"))).otherwise(text)
    page = F.concat(F.lit("[["), F.coalesce(path, r["content"]) if path is not None else r["content"], F.lit("]]"))
    return (
        F.when(r["type"] == "equation", F.concat(F.lit("$"), r["content"], F.lit("$")))
        .when(r["type"] == "mention", page)
        .when(r["type"] == "user", F.concat(F.lit("@"), r["content"]))
        .when(r["type"] == "date", r["content"])
        .otherwise(text)
    )


def markdown(runs: Column, paths: Column | None = None) -> Column:
    """All runs of a block; ``paths`` is a map from page id to path."""
    return F.array_join(F.transform(runs, lambda r: run_markdown(r, F.element_at(paths, r["page_id"]) if paths is not None else None)), "")


def plain(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["content"]), "")


def link_run(target: Column, shown: Column, page_id: Column, style: str = "placeholder") -> Column:
    """A link as a run: a mention of its page, else nothing (skip), text, or red ``[[...]]`` (placeholder); null is no run."""
    run = lambda kind, content, page, color: F.struct(F.lit(kind).alias("type"), content.alias("content"), F.lit(None).cast("string").alias("link"), page.cast("string").alias("page_id"), *(F.lit(False).alias(n) for n in ("bold", "italic", "strike", "underline", "code")), F.lit(color).cast("string").alias("color"))
    none = F.lit(None)
    unresolved = {"skip": none.cast(RUN), "text": run("text", shown, none, None), "placeholder": run("text", F.concat(F.lit("[["), target, F.lit("]]")), none, "red")}[style]
    return F.when(page_id.isNotNull(), run("mention", shown, page_id, None)).otherwise(unresolved)
