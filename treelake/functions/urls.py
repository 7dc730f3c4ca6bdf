"""URL functions: keys, origins, globs and outbound policy, as columns."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def cache_url(url: Column) -> Column:
    """The key form of a url: no fragment, no trailing slashes but the root's."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    cut = F.regexp_replace(bare, r"^([^?]*[^/?])/+(\?.*)?$", "$1$2")
    return F.when(cut.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]+$"), F.concat(cut, F.lit("/"))).otherwise(cut)


def cache_key(url: Column, selector: Column) -> Column:
    """Key of a cached page or of the part a selector picks; selectors other than ids in lower case."""
    s = F.trim(selector)
    named = F.when(F.startswith(s, F.lit("#")), s).otherwise(F.lower(s))
    return F.when(F.coalesce(s, F.lit("")) != "", F.concat(cache_url(url), F.lit("::selector="), named)).otherwise(cache_url(url))


def origin(url: Column) -> Column:
    """scheme://host:port with the scheme's own port where none is given; null for other schemes."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    port = F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/@?#]*@)?[^/:?#]+:(\d+)", 1)
    own = F.when(scheme == "https", "443").when(scheme == "http", "80")
    return F.when((host != "") & own.isNotNull(), F.concat(scheme, F.lit("://"), host, F.lit(":"), F.coalesce(F.when(port != "", port), own)))


def glob_regex(pattern: str) -> str:
    """The regular expression of a url glob: stars stand for anything, all else for itself."""
    return "(?s)^" + ".*".join(re.escape(part) for part in pattern.split("*")) + "$"


def glob_column(pattern: Column) -> Column:
    """``glob_regex`` of a column of patterns, quoted for the JVM."""
    return F.concat(F.lit(r"(?s)^\Q"), F.replace(pattern, F.lit("*"), F.lit(r"\E.*\Q")), F.lit(r"\E$"))


def shorten(url: Column) -> Column:
    bare = F.regexp_replace(url, r"^https?://", "")
    return F.when(F.length(bare) > 50, F.concat(F.left(bare, F.lit(47)), F.lit("..."))).otherwise(bare)


# Host names of metadata services.
METADATA_HOSTS = ("metadata.google.internal", "metadata", "instance-data")
_HOST = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#]*)@)?(\[[^\]]+\]|[^/:?#]*)")


def outbound_reason(url: str) -> str | None:
    """Why a url may not be fetched: invalid, scheme, credentials, metadata, address; else None."""
    m = _HOST.match(url.strip())
    if not m or not m.group(3):
        return "invalid"
    if m.group(1).lower() not in ("http", "https"):
        return "scheme"
    if m.group(2) is not None:
        return "credentials"
    host = m.group(3).lower().rstrip(".")
    if host in METADATA_HOSTS:
        return "metadata"
    try:
        ip = ipaddress.ip_address(host.strip("[]"))
    except ValueError:
        return None
    ip = getattr(ip, "ipv4_mapped", None) or ip
    if ip.version == 4:
        good = ip.is_global and not ip.is_multicast and int(ip) >> 24 < 224
    else:
        good = int(ip) >> 125 == 1 and ip not in ipaddress.ip_network("2001:db8::/32")
    return None if good else "address"


@F.pandas_udf(StringType())
def outbound_policy(urls: pd.Series) -> pd.Series:
    return urls.map(outbound_reason, na_action="ignore")


def joined(base: str | None, href: str | None) -> str | None:
    """A link target against its page's url; null where there is no target, the target as it is where the base is no url."""
    if href is None or not href.strip():
        return None
    try:
        return urljoin(base or "", href.strip())
    except ValueError:
        return None


@F.pandas_udf(StringType())
def resolve(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
    return pd.Series([joined(b, h) for b, h in zip(bases, hrefs)], dtype=object)
