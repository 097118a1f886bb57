"""The URL forms of the different identities; they are kept apart on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, nfkc_plain

# --- Fixed values ---
ARTICLE_TRACKING = ["fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "_ga", "_gl"]
DOCUMENT_TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid"]


#: The generic form of a URL: scheme, authority, path, query, fragment.
_FORM = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_GROUPS = {"PROTOCOL": 1, "AUTHORITY": 2, "PATH": 3, "QUERY": 4}


def _part(c: Column, name: str) -> Column:
    return F.regexp_extract(F.trim(c), _FORM, _GROUPS[name])


def _decoded(c: Column) -> Column:
    """A form field's text: blanks for plus signs, escapes undone; a percent sign without two digits stands for itself."""
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(c: Column) -> Column:
    """The text as a form field: letters, digits and ``_.-~`` as they are, plus signs for blanks."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _query(c: Column, tracking: list[str]) -> Column:
    """The query without tracking fields, sorted, each field escaped anew."""
    fields = F.filter(F.split(F.coalesce(_part(c, "QUERY"), F.lit("")), "&"), lambda p: p != "")
    # A field's value is what stands behind its first equals sign.
    cut = lambda p: F.locate("=", F.concat(p, F.lit("=")))
    pairs = F.transform(fields, lambda p: F.struct(_decoded(F.substr(p, F.lit(1), cut(p) - 1)).alias("k"), _decoded(F.substr(p, cut(p) + 1)).alias("v")))
    kept = F.filter(pairs, lambda x: ~F.lower(x["k"]).startswith("utm_") & ~F.array_contains(F.array(*map(F.lit, tracking)), F.lower(x["k"])))
    return F.array_join(F.transform(F.array_sort(kept), lambda x: F.concat(_encoded(x["k"]), F.lit("="), _encoded(x["v"]))), "&")


def _host_port(c: Column) -> Column:
    return F.regexp_replace(_part(c, "AUTHORITY"), "^.*@", "")


def _host(c: Column) -> Column:
    at = _host_port(c)
    return F.rtrim(F.lower(F.when(at.startswith("["), F.regexp_extract(at, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(at, "^([^:]*)", 1))), F.lit("."))


def _port(c: Column) -> Column:
    """Digits of the port without leading zeros; empty where there is none."""
    return F.regexp_extract(_host_port(c), r"^(?:\[[^\]]*\]|[^:]*):0*(\d+)$", 1)


def _port_ok(c: Column) -> Column:
    port = F.regexp_extract(_host_port(c), r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)
    return (port == "") | (port.rlike(r"^\d{1,9}$") & (F.try_to_number(F.nullif(port, F.lit("")), F.lit("999999999")) <= 65535))


def _built(scheme: Column, c: Column, query: Column) -> Column:
    port = _port(c)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    host = F.concat(_host(c), F.when((port != "") & ~default, F.concat(F.lit(":"), port)).otherwise(""))
    path = F.coalesce(F.nullif(_part(c, "PATH"), F.lit("")), F.lit("/"))
    return F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def article_url(c: Column) -> Column:
    """Identity of an article: http or https, host folded, default port, login, fragment and tracking fields dropped, fields sorted and escaped alike."""
    c = collapse(nfkc_plain(c))
    scheme = F.lower(_part(c, "PROTOCOL"))
    return F.when(scheme.isin("http", "https") & (_host(c) != "") & _port_ok(c), _built(scheme, c, _query(c, ARTICLE_TRACKING)))


def document_url(c: Column) -> Column:
    """Identity of a corpus document: https only, no login."""
    login = F.contains(F.coalesce(_part(c, "AUTHORITY"), F.lit("")), F.lit("@"))
    return F.when((F.lower(_part(c, "PROTOCOL")) == "https") & (_host(c) != "") & _port_ok(c) & ~login, _built(F.lit("https"), c, _query(c, DOCUMENT_TRACKING)))


def web_url(c: Column) -> Column:
    """Identity of a search hit: https only, no login, query kept as it is."""
    login = F.contains(F.coalesce(_part(c, "AUTHORITY"), F.lit("")), F.lit("@"))
    return F.when((F.lower(_part(c, "PROTOCOL")) == "https") & (_host(c) != "") & _port_ok(c) & ~login, _built(F.lit("https"), c, F.coalesce(_part(c, "QUERY"), F.lit(""))))


def url_domain(c: Column) -> Column:
    """Host of a URL, folded, without ``www.``."""
    return F.regexp_replace(_host(c), r"^www\.", "")


def domain_of(c: Column) -> Column:
    """Domain of a URL or a bare domain: login, port and ``www.`` stripped."""
    bare = F.regexp_extract(F.regexp_replace(F.lower(F.trim(c)), "^[a-z][a-z0-9+.-]*://", ""), "^([^/?#]*)", 1)
    host = F.split_part(F.element_at(F.split(bare, "@"), -1), F.lit(":"), F.lit(1))
    return F.trim(F.regexp_replace(host, r"^www\.", ""), F.lit("."))


def domain_matches(domain: Column, trusted: Column) -> Column:
    """Equal, or below the trusted domain."""
    return (domain == trusted) | F.endswith(domain, F.concat(F.lit("."), trusted))
