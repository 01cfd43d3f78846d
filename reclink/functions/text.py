"""Column-level text functions (F1-F13, F16-F18); JVM-side but for the entities of F1."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reclink.functions.stopwords import ENGLISH_STOPWORDS

# Unicode white space spelled out, so Java regex and RE2 (DuckDB) agree.
WS_CLASS = (r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

HTML_TAG = r"</?[A-Za-z][^>]*>|<![^>]*>|<\?[^>]*>"

HTML_DROP = [
    r"(?is)<!--.*?-->",
    r"(?is)<script\b[^>]*>.*?</script\s*>",
    r"(?is)<style\b[^>]*>.*?</style\s*>",
]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# a run of white space that is not one space already: single spaces, most of a text, are left alone;
# the look-ahead passes letters by one comparison
WS_RUN = f"(?=[^!-~])(?:[{WS_CLASS[1:-1].replace(' ', '')}]{WS_CLASS}*| {WS_CLASS}+)"


def squash_ws(c) -> Column:
    """Collapse every run of (Unicode) white space to one space and trim."""
    return F.trim(F.regexp_replace(col_(c), WS_RUN, " "))


def html_to_text(c) -> Column:
    """HTML fragment -> plain text.

    NULL -> ''; comments, script and style bodies dropped; every tag, declaration
    and processing instruction becomes a space, while a ``<`` that begins none of
    them is text (``p < 0.05``); all HTML5 named and all numeric references are
    decoded; white space collapsed; trimmed.

    Entities are decoded in Arrow batches, and only rows that hold ``&`` go there
    with their text; only rows that hold ``<`` are searched for markup.  Both are
    asked of the fragment itself, so that its markup is removed once.
    """
    raw = F.coalesce(col_(c), F.lit(""))
    x = raw
    for pat in HTML_DROP:
        x = F.regexp_replace(x, pat, " ")
    x = F.when(F.contains(raw, F.lit("<")), F.regexp_replace(x, HTML_TAG, " ")).otherwise(raw)
    decoded = _unescape(F.when(F.contains(raw, F.lit("&")), x))
    return squash_ws(F.coalesce(decoded, x))


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def pick_locale(texts, locale: str = "en", value: str = "_VALUE", attr: str = "_locale") -> Column:
    """first text of the given locale in an array<struct<_VALUE,_locale>>."""
    return F.get(F.filter(col_(texts), lambda t: t[attr] == F.lit(locale)), 0)[value]


def full_names(people, first: str = "firstName", last: str = "lastName") -> Column:
    """'first last' per person; a person missing either name is skipped."""
    ok = F.filter(col_(people), lambda p: p[first].isNotNull() & p[last].isNotNull()
                  & (p[first] != "") & (p[last] != ""))
    return F.transform(ok, lambda p: F.concat_ws(" ", p[first], p[last]))


def non_null(arr) -> Column:
    return F.filter(col_(arr), lambda x: x.isNotNull())


def discipline_terms(disciplines, locale: str = "en") -> Column:
    """English term of every discipline; missing texts dropped."""
    return non_null(F.transform(col_(disciplines),
                                lambda d: pick_locale(d["description"]["texts"]["text"], locale)))


def coded_disciplines(disciplines, locale: str = "en") -> Column:
    """'code:term' for coded disciplines; missing texts dropped."""
    return non_null(F.transform(col_(disciplines),
                                lambda d: F.concat(d["_term"], F.lit(":"),
                                                   pick_locale(d["description"]["texts"]["text"], locale))))


def organisations(names) -> Column:
    """distinct non-empty organisation names, sorted."""
    return F.array_sort(F.array_distinct(F.filter(col_(names), lambda x: x.isNotNull() & (x != ""))))


def project_ids(links, path=("project", "_uuid")) -> Column:
    """linked project ids from nested link elements."""
    def pick(x):
        for p in path:
            x = x[p]
        return x
    return non_null(F.transform(col_(links), pick))


def default_provider(c) -> Column:
    """F8: missing provider -> ''."""
    return F.coalesce(col_(c), F.lit(""))


def clean_participants(c, sep: str = ", ") -> Column:
    """split on ', ', de-duplicate, sort, re-join (NULL -> '')."""
    parts = F.split(F.coalesce(col_(c), F.lit("")), _re_lit(sep))
    return F.array_join(F.array_sort(F.array_distinct(parts)), sep)


def clean_disciplines(c, sep: str = ";", drop: int = 7, out_sep: str = ", ") -> Column:
    """split on ';', drop the code prefix (first 7 chars), de-duplicate, sort, join."""
    parts = F.split(F.coalesce(col_(c), F.lit("")), _re_lit(sep))
    terms = F.transform(parts, lambda x: F.substring(x, drop + 1, 1 << 30))
    return F.array_join(F.array_sort(F.array_distinct(terms)), out_sep)


def tokens(c, stopwords=None) -> Column:
    """F12 tokens: split on single spaces, lower-case, drop stop words (empty tokens stay)."""
    sw = list(stopwords or ENGLISH_STOPWORDS)
    toks = F.split(F.lower(F.coalesce(col_(c), F.lit(""))), " ")
    return F.filter(toks, lambda x: ~x.isin(sw))


def stopword_clean(c, stopwords=None) -> Column:
    """the cleaned tokens re-joined with single spaces."""
    return F.array_join(tokens(c, stopwords), " ")


def break_before_abstract(c) -> Column:
    """move the first 'Abstract:' label (and white space around it) to a new line."""
    return F.regexp_replace(col_(c), r"(?s)^(.*?)" + WS_CLASS + r"*Abstract:" + WS_CLASS + "*",
                            "$1\nAbstract: ")


def format_hit(doc, score) -> Column:
    """F16: '<document> \\n Similarity Score: <score>'."""
    return F.concat(col_(doc), F.lit(" \n Similarity Score: "), col_(score).cast("string"))


def truncate_id(c, n: int = 50) -> Column:
    """first n characters of an id."""
    return F.substring(col_(c), 1, n)


def _re_lit(s: str) -> str:
    import re
    return re.escape(s).replace("\\ ", " ")
