"""URL rules as Column expressions; Spark's own parser rejects URLs that are wanted here."""

from __future__ import annotations

from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F


WEB = ("http", "https")
_UNSEEN = str.maketrans("", "", "\t\r\n")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def url_hash(url: Column) -> Column:
    return F.sha2(F.lower(strip(url)).cast("binary"), 256)


def normalise(url: Column) -> Column:
    """http and https only, else null; scheme in lower case, no fragment, no empty query, no slashes at the end."""
    u = F.regexp_replace(strip(url), "[\t\r\n]", "")
    u = F.regexp_replace(u, r"(?s)#.*$", "")
    u = F.regexp_replace(u, r"\?$", "")
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*:", ""), "^(?!//)/*", "///")
    return F.when(scheme.isin(*WEB), F.regexp_replace(F.concat(scheme, F.lit(":"), rest), "/+$", ""))


def py_normalise(url: str) -> str | None:
    """The same rule in plain Python."""
    u = url.strip().translate(_UNSEEN).partition("#")[0].removesuffix("?")
    scheme, _, rest = u.partition(":")
    if scheme.lower() not in WEB:
        return None
    authority = rest if rest.startswith("//") else "///" + rest.lstrip("/")
    return f"{scheme.lower()}:{authority}".rstrip("/")


def domain(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def base(url: Column) -> Column:
    """scheme://authority, for robots rules."""
    return F.regexp_replace(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), "^$", "://")


def _target(href: str, page: str) -> str | None:
    """Where a link on ``page`` leads, normalised; None for other schemes and what can't be resolved."""
    try:
        return py_normalise(urljoin(page, href))
    except ValueError:
        return None


def py_links(hrefs: list[str], page: str) -> list[str]:
    """Different normalised targets of links on ``page`` in order of first appearance. Links within the page and empty
    ones lead nowhere; mail, telephone and script links are told by their scheme."""
    elsewhere = (h for h in map(str.strip, hrefs) if h and h[0] != "#")
    return list(dict.fromkeys(t for h in elsewhere if (t := _target(h, page))))


def valid_seeds(urls: list[str]) -> list[str]:
    """1 to 20 http or https URLs, or a ValueError."""
    if not 1 <= len(urls) <= 20:
        raise ValueError("give 1 to 20 seed URLs")
    for u in urls:
        if not u.startswith(("http://", "https://")):
            raise ValueError(f"not an http or https URL: {u}")
    return urls
