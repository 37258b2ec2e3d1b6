"""Web page transforms (S4 html_to_text, S6 pdf_links) as regex projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col_

# FIXED VALUES: entities decoded by html_to_text (the common named ones and
# decimal apostrophe); ``&amp;`` is decoded last so it cannot create others.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def html_to_text(html, max_chars: int | None = None) -> Column:
    """Drop script/style/comment blocks, strip tags, decode entities.

    The whole page is converted; ``max_chars`` only when a caller asks for
    a cut."""
    t = F.regexp_replace(col_(html), r"(?is)<script\b.*?</script>", "")
    t = F.regexp_replace(t, r"(?is)<style\b.*?</style>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for ent, ch in ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return F.substring(t, 1, max_chars) if max_chars else t


def page_document_id(url, prefix: str = "page_") -> Column:
    """Id from the lower-cased last path segment of the address."""
    path = F.regexp_replace(col_(url), r"[?#].*$", "")
    return F.concat(F.lit(prefix), F.lower(F.element_at(F.split(path, "/"), -1)))


def absolutize(base, href) -> Column:
    """URL join for the common cases: absolute, scheme-relative,
    host-relative and directory-relative references."""
    b, h = col_(base), col_(href)
    origin = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    path = F.regexp_replace(b, r"[?#].*$", "")
    directory = F.regexp_replace(path, r"/[^/]*$", "/")
    directory = F.when(directory == origin, F.concat(origin, F.lit("/"))).otherwise(directory)
    return (F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h.startswith("/"), F.concat(origin, h))
            .otherwise(F.concat(directory, h)))


def pdf_links(pages: DataFrame, suffix: str = ".pdf", per_page: int | None = None, url_col: str = "url",
              html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """Anchors whose href ends with ``suffix``, in document order (the first
    ``per_page`` per page if given), made absolute; title attribute or the last
    path segment. The per-page cut is a partial top-n (WindowGroupLimit)."""
    tags = pages.select(id_col, url_col, F.posexplode(F.regexp_extract_all(col_(html_col), F.lit(r"(<a\s[^>]*>)"), 1))
                        .alias("pos", "tag"))
    links = tags.select(id_col, url_col, "pos", F.regexp_extract("tag", r'href="([^"]*)"', 1).alias("href"),
                        F.regexp_extract("tag", r'title="([^"]*)"', 1).alias("title_attr")) \
                .where((F.col("href") != "") & F.col("href").endswith(suffix))
    w = Window.partitionBy(id_col).orderBy("pos")
    top = links.withColumn("link_rank", F.row_number().over(w))
    if per_page is not None:
        top = top.where(F.col("link_rank") <= per_page)
    absu = absolutize(F.col(url_col), F.col("href"))
    return top.select(id_col, "link_rank", absu.alias("pdf_url"),
                      F.when(F.col("title_attr") != "", F.col("title_attr"))
                       .otherwise(F.element_at(F.split(absu, "/"), -1)).alias("title"),
                      F.col(url_col).alias("source"))
