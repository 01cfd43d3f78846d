"""Record -> text templates (F11).  A template is a Python function on Columns,
evaluated JVM-side; no UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(cols: dict, name: str) -> Column:
    return F.coalesce(cols[name], F.lit(""))


# fixed values: the instruction prefixes used for asymmetric retrieval
INSTRUCT_PUB = "Instruct: Compare this publication with a project \n Query:"
INSTRUCT_PROJ = "Instruct: Compare this project with a publication \n Query:"

TEMPLATES = {
    "plain": lambda c: F.concat(_c(c, "title"), F.lit(" "), _c(c, "abstract")),
    "labelled": lambda c: F.concat(F.lit("Title: "), _c(c, "title"), F.lit(" Abstract: "), _c(c, "abstract")),
    "labelled_tight": lambda c: F.concat(F.lit("Title: "), _c(c, "title"), F.lit(" Abstract:"), _c(c, "abstract")),
    "labelled_disc": lambda c: F.concat(F.lit("Title: "), _c(c, "title"), F.lit(" Abstract: "), _c(c, "abstract"),
                                        F.lit(" Disciplines: "), _c(c, "disciplines")),
    "instruct_pub": lambda c: F.concat(F.lit(INSTRUCT_PUB), _c(c, "title"), F.lit(" "), _c(c, "abstract")),
    "instruct_pub_labelled": lambda c: F.concat(F.lit(INSTRUCT_PUB + " Title: "), _c(c, "title"),
                                                F.lit(" Abstract: "), _c(c, "abstract")),
    "instruct_proj": lambda c: F.concat(F.lit(INSTRUCT_PROJ + " Title: "), _c(c, "title"), F.lit(" Abstract: "),
                                        _c(c, "abstract"), F.lit(" Disciplines: "), _c(c, "disciplines")),
}


def compose_text(template, **cols) -> Column:
    """Render record fields to one string with a named template or a callable.

    ``cols`` maps field names (title, abstract, participants, disciplines,
    dataProvider) to Columns or column names.
    """
    fn = TEMPLATES[template] if isinstance(template, str) else template
    resolved = {k: (F.col(v) if isinstance(v, str) else v) for k, v in cols.items()}
    for k in ("title", "abstract", "participants", "disciplines", "dataProvider"):
        resolved.setdefault(k, F.lit(""))
    return fn(resolved)
