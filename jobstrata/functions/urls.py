"""Url keys used to recognise the same posting."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobstrata.functions.text import strip

# fixed values: where a posting id sits in a url, in order of preference
ID_PATTERNS = (r"vacancy(\d+)", r"[?&]id=(\d+)", r"/vacancies/(\d+)", r"/jobs/(\d+)")


def _bare(url: Column) -> Column:
    return F.regexp_replace(F.lower(strip(F.coalesce(url, F.lit("")))), r"^https?://(www\.)?", "")


def _no_slash(c: Column) -> Column:
    return F.regexp_replace(c, r"/+$", "")


def url_key(url: Column) -> Column:
    """Host and path only."""
    return _no_slash(F.regexp_replace(_bare(url), r"[?#][^\n]*$", ""))


def norm_url(url: Column) -> Column:
    """As `url_key`, but the query stays (ids may live there); only the fragment goes."""
    return _no_slash(F.regexp_replace(_bare(url), r"(?s)#.*$", ""))


# the number after the first pattern of ID_PATTERNS that occurs, "" when none does
_FIRST_ID = f"(?s)^(?:{'|'.join(f'.*?{p}' for p in ID_PATTERNS)}|).*\\z"
_ITS_NUMBER = "".join(f"${i}" for i in range(1, len(ID_PATTERNS) + 1))


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once a row, however often it is used: through an array of one element."""
    return F.transform(F.array(value), use)[0]


def _id_in(bare: Column) -> Column:
    host = F.substring_index(F.substring_index(bare, "/", 1), "?", 1)
    domain = F.substring_index(host, ".", -2)
    return _once(F.regexp_replace(bare, _FIRST_ID, _ITS_NUMBER), lambda number: F.when(number != "", F.concat(domain, F.lit(":"), number)))


def posting_id(url: Column) -> Column:
    """`registrable-domain:id`, null when the url carries no id."""
    return _once(norm_url(url), _id_in)


def identity(url: Column) -> Column:
    """One key for "the same posting": its id when the url has one, else the bare url; null without a url.

    The id is a function of the bare url, so "same id or same bare url" is equality of this key: one equi-join
    instead of an OR of two."""
    return F.when(F.coalesce(url, F.lit("")) != "", _once(norm_url(url), lambda bare: F.coalesce(_id_in(bare), F.concat(F.lit("u:"), bare))))
